"""Byte-level BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the vocabulary's pre-tokeniser knows it: Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokeniser's pattern; a fixed value, with white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: Distinct pieces that a worker remembers, with their ids; beyond that it starts anew.
CACHE_PIECES = 150_000
#: Characters of texts that are handled at once; a longer text is handled alone.
BATCH_CHARS = 400_000


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Bpe:
    """The vocabulary and the piece cache of one worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        chars = byte_chars()
        self.of_byte = np.array([vocab[c] for c in chars], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]  # sorted pair keys; beside them rank and merged id
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        byte_of = {c: b for b, c in enumerate(chars)}
        raw = [b""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.split = regex.compile("|".join(f"({regex.escape(s)})" for s in self.specials)) if self.specials else None
        self.pieces = regex.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, flat, and each word's number of ids.

        The symbols of all words are one array. In each round every word's lowest-ranked pair is found: the pairs'
        keys are looked up by binary search (after the first round, of pairs that a merge has changed), ranks are reduced by word, and all its occurrences are merged left to
        right. Words without a mergeable pair leave.
        """
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        never = len(self.keys)
        rank = np.full(len(sym), never, np.int64)  # of each symbol's pair with the next one
        place = np.zeros(len(sym), np.int64)
        changed = np.arange(len(sym))
        done_sym, done_word = [], []
        while len(sym):
            last = changed[-1] == len(sym) - 1 if len(changed) else False
            pair = changed[:-1] if last else changed
            rank[changed] = never
            pair = pair[word[pair] == word[pair + 1]]
            key = sym[pair] * self.size + sym[pair + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            hit = self.keys[at] == key
            rank[pair[hit]] = self.ranks[at[hit]]
            place[pair[hit]] = at[hit]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), length)
            over = best == never
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            chosen = np.flatnonzero((rank == best) & ~over)
            keep = ~over
            fresh_pair = np.zeros(len(sym), bool)
            if len(chosen):
                # A run of the same symbol gives overlapping pairs: every second one of a run of neighbours is merged.
                begins = np.concatenate([[True], np.diff(chosen) != 1])
                first = np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
                sym[chosen] = self.merged[place[chosen]]
                keep[chosen + 1] = False
                fresh_pair[chosen] = True
                fresh_pair[np.maximum(chosen - 1, 0)] = True
            sym, word, rank, place = sym[keep], word[keep], rank[keep], place[keep]
            changed = np.flatnonzero(fresh_pair[keep])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        flat, count = self.merge([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's number of ids."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        split: list[list[str]] = []
        for text in texts:
            if self.split is not None and any(s in text for s in self.specials):
                parts = [x for x in self.split.split(text) if x]
                split.append([y for x in parts for y in ([x] if x in self.specials else self.pieces.findall(x))])
            else:
                split.append(self.pieces.findall(text))
        self._learn(set().union(*split) - self.specials.keys())
        of_special = {}
        for s, i in self.specials.items():
            if any(s in p for p in split):
                of_special[s] = len(self.at)
                self.at, self.count = np.append(self.at, len(self.flat)), np.append(self.count, 1)
                self.flat = np.append(self.flat, np.int32(i))
        look = (self.known | of_special if of_special else self.known).__getitem__
        piece = np.fromiter(map(look, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        count = self.count[piece]
        ids = self.flat[_spread(self.at[piece], count)]
        ends = np.cumsum([len(p) for p in split])
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of flat ids; ids that the vocabulary lacks give nothing, bytes that are no UTF-8 U+FFFD."""
        here = (ids >= 0) & (ids < self.size)
        safe = np.where(here, ids, 0)
        size = np.where(here, self.raw_size[safe], 0)
        raw = self.raw[_spread(self.raw_at[safe], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]
        return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """at, at + 1 ... for each (at, count), one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(at - before, count) + np.arange(int(count.sum()))


@lru_cache(maxsize=2)
def worker(path: str) -> Bpe:
    return Bpe(path)


def _slices(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of up to BATCH_CHARS characters."""
    start = total = end = 0
    for n in sizes:
        if total and total + n > BATCH_CHARS:
            yield start, end
            start, total = end, 0
        total += n
        end += 1
    if end > start:
        yield start, end


def _encoded(bpe: Bpe, batch: pa.Array, decoded: bool) -> tuple[pa.Array, pa.Array | None]:
    """The ids, and on demand the text that they give, some texts at a time."""
    sizes = np.asarray(pc.binary_length(batch).fill_null(0)).tolist()
    all_ids, counts, texts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [pa.array([], pa.string())]
    for a, b in _slices(sizes):
        ids, count = bpe.encode(batch.slice(a, b - a).fill_null("").to_pylist())
        all_ids.append(ids)
        counts.append(count)
        if decoded:
            texts.append(pa.array(bpe.decode(ids, count), pa.string()))
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids), pa.int32()))
    return found, pa.concat_arrays(texts) if decoded else None


def encode(text: Column, path: str) -> Column:
    """The text's token ids, array<int>. A null or empty text has none; the vocabulary file's special tokens are recognised in texts.

    ``path`` names the file on every worker.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker(path)
        for batch in batches:
            yield _encoded(bpe, batch, False)[0]

    return encoded(text)


def encode_decode(text: Column, path: str) -> Column:
    """A struct of the text's token ids and the text that they decode to, made by one worker with one vocabulary."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker(path)
        for batch in batches:
            ids, decoded = _encoded(bpe, batch, True)
            yield pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included; null ids give an empty text."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker(path)
        for batch in batches:
            count = np.asarray(batch.value_lengths().fill_null(0), np.int64)
            flat = np.asarray(batch.flatten().fill_null(-1))
            ends = np.concatenate([[0], np.cumsum(count)])
            texts = []
            for a, b in _slices(count.tolist()):
                texts += bpe.decode(flat[ends[a] : ends[b]], count[a:b])
            yield pa.array(texts, pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row with ``token_ids`` (array<int>) and ``n_tokens``; input columns of these names are replaced."""
    rows = docs.withColumn("token_ids", encode(F.col(text_col), path))
    return rows.withColumn("n_tokens", F.size("token_ids").cast("long"))
