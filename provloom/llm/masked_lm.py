"""Language-model scores: masked pseudo-likelihood of a bidirectional window network."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, remove, shared_folder

#: Token kinds: 0 outside the text, then the corpus's commonest words, then OTHERS classes that all other words are dealt into by their hash.
KINDS, OTHERS = 1024, 255
#: The softmax is in two levels: a kind's class is kind // CLASS, and the kinds of a class compete within it.
CLASS = 32
#: Tokens that are looked at on either side, and the width of the network.
WINDOW, WIDTH = 2, 16
#: Passes over all documents, and the step's size. A step takes a 32nd of the tokens that the run has seen, within these bounds.
ROUNDS, RATE, LEAST_STEP, MOST_STEP = 2, 0.3, 128, 8192
#: Tokens of a training shard, on average. Documents are dealt into shards by their hash, so that a shard's tokens don't depend on partitions.
SHARD_TOKENS = 4_000_000
#: Tokens whose probabilities are computed at once, and words whose kinds a worker remembers.
BATCH, CACHE_WORDS = 16_384, 200_000
#: No weight is larger than this, so that no logit is beyond what exp takes in.
MOST_WEIGHT = 4.0


class Tokens(dict):
    """Kinds of words, which are UTF-8 runs without ASCII white space of a text that is lower-cased already. Looked up words are remembered while there is room."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w.encode(), i + 1) for i, w in enumerate(words))

    def __missing__(self, w: bytes) -> int:
        kind = KINDS - OTHERS + zlib.crc32(w) % OTHERS
        if len(self) < CACHE_WORDS:
            self[w] = kind
        return kind

    def ids(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), np.uint16, len(words))


def start(seed: int = 1) -> np.ndarray:
    """All weights in one vector: token vectors, a gate for each place of the window, hidden bias, class weights and biases, kinds' weights and biases by class."""
    rng = np.random.default_rng(seed)
    classes = KINDS // CLASS
    return np.concatenate([
        rng.normal(0, 0.3, KINDS * WIDTH), np.ones(2 * WINDOW * WIDTH) + rng.normal(0, 0.1, 2 * WINDOW * WIDTH), np.zeros(WIDTH),
        rng.normal(0, 0.1, WIDTH * classes), np.zeros(classes), rng.normal(0, 0.1, WIDTH * KINDS), np.zeros(KINDS),
    ]).astype(np.float32)


def parts(weights: np.ndarray) -> tuple[np.ndarray, ...]:
    classes = KINDS // CLASS
    shapes = ((KINDS, WIDTH), (2 * WINDOW, WIDTH), (WIDTH,), (WIDTH, classes), (classes,), (classes, WIDTH, CLASS), (classes, CLASS))
    ends = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    return tuple(weights[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True))


def windows(ids: np.ndarray) -> np.ndarray:
    """For each token the tokens at its left and right, without itself; 0 beyond the text."""
    padded = np.concatenate([np.zeros(WINDOW, ids.dtype), ids, np.zeros(WINDOW, ids.dtype)])
    places = [*range(WINDOW), *range(WINDOW + 1, 2 * WINDOW + 1)]
    return np.stack([padded[p : p + len(ids)] for p in places], axis=1)


def _hidden(tables: list[np.ndarray], bias: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The tanh layer: gated vectors of the tokens around, one small table a place of the window."""
    h = np.take(tables[0], near[:, 0], axis=0)
    for p in range(1, 2 * WINDOW):
        h += np.take(tables[p], near[:, p], axis=0)
    h += bias
    return np.tanh(h, out=h)


def _of(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log softmax at one place a row; the logits are overwritten."""
    mine = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    return mine - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _with_one(h: np.ndarray) -> np.ndarray:
    """The hidden layer and a column of ones, by which biases are weights like others."""
    wide = np.ones((len(h), WIDTH + 1), np.float32)
    wide[:, :WIDTH] = h
    return wide


def _within(h: np.ndarray, low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logits of the kinds of each token's class; tokens are in the order of classes, which end at ``ends``."""
    logits = np.empty((len(h), CLASS), np.float32)
    for c in np.flatnonzero(np.diff(ends)):
        of = slice(ends[c], ends[c + 1])
        np.matmul(h[of], low[c], out=logits[of])
    return logits


def log_probabilities(weights: np.ndarray, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log p(token | both sides) of each token, some at a time; tokens of one class go through its weights together."""
    vectors, gates, bias, top, top_bias, low, low_bias = parts(weights)
    tables = [vectors * g for g in gates]
    top, low = np.concatenate([top, top_bias[None]]), np.concatenate([low, low_bias[:, None]], axis=1)
    found = np.empty(len(ids), np.float32)
    starts = np.arange(KINDS // CLASS + 1) * CLASS
    for a in range(0, len(ids), BATCH):
        own = ids[a : a + BATCH]
        order = np.argsort(own, kind="stable")
        own = own[order]
        h = _with_one(_hidden(tables, bias, around[a : a + BATCH][order]))
        klass, inner = np.divmod(own, np.uint16(CLASS))
        found[a + order] = _of(h @ top, klass) + _of(_within(h, low, np.searchsorted(own, starts)), inner)
    return found


def _slope(logits: np.ndarray, own: np.ndarray, step: np.float32) -> np.ndarray:
    """``step`` times the loss's slope by the logits, which are overwritten."""
    np.exp(logits, out=logits)
    logits *= (step / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    logits[np.arange(len(own)), own] -= step
    return logits


def train(weights: np.ndarray, around: np.ndarray, ids: np.ndarray, rate: float, seed: int, seen: int = 0) -> np.ndarray:
    """One pass of stochastic gradient descent over shuffled tokens; ``seen`` tokens went before them."""
    weights = weights.copy()
    vectors, gates, bias, top, top_bias, low, low_bias = parts(weights)
    order = np.random.default_rng(seed).permutation(len(ids))
    starts = np.arange(KINDS // CLASS + 1) * CLASS
    a = 0
    while a < len(order):
        at = order[a : a + min(MOST_STEP, max(LEAST_STEP, (seen + a) // 32))]
        a += len(at)
        own = ids[at]
        by_kind = np.argsort(own, kind="stable")  # tokens of one class are neighbours
        at, own = at[by_kind], own[by_kind]
        klass, inner = np.divmod(own, np.uint16(CLASS))
        near, step = around[at], np.float32(rate * 16 / len(at))
        h = _hidden([vectors * g for g in gates], bias, near)
        wide = _with_one(h)
        p = _slope(wide @ np.concatenate([top, top_bias[None]]), klass, step)
        back = p @ top.T
        ends = np.searchsorted(own, starts)
        q = _slope(_within(wide, np.concatenate([low, low_bias[:, None]], axis=1), ends), inner, step)
        for c in np.flatnonzero(np.diff(ends)):
            of = slice(ends[c], ends[c + 1])
            back[of] += q[of] @ low[c].T
            change = wide[of].T @ q[of]
            low[c] -= change[:-1]
            low_bias[c] -= change[-1]
        h *= h
        back -= back * h
        change = wide.T @ p
        top -= change[:-1]
        top_bias -= change[-1]
        bias -= np.ones(len(back), np.float32) @ back
        for place in range(2 * WINDOW):
            token = near[:, place]
            by_token = np.argsort(token, kind="stable")
            token = token[by_token]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sums, token = np.add.reduceat(np.take(back, by_token, axis=0), first, axis=0), token[first]
            d_gate = (sums * vectors[token]).sum(axis=0)
            vectors[token] -= sums * gates[place]
            gates[place] -= d_gate
        np.clip(weights, -MOST_WEIGHT, MOST_WEIGHT, out=weights)
    return weights


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) of all documents; occurrences are summed by task, then by word."""
    words = rows.select(F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def common_words(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(KINDS - OTHERS - 1).collect()]


def shares(rows: DataFrame, counts: DataFrame, words: list[str]) -> DataFrame:
    """(row, log_n): the sum of log counts of a text's words that share a class, met with the counts in shards of words' hashes.

    Words that occur once add nothing and aren't met.
    """
    word = F.col("word")
    others = rows.select("row", F.explode(F.split("text", SPACES)).alias("word")).where((word != "") & ~word.isin(words)).select("row", F.xxhash64("word").alias("h"))
    rare = counts.where(~word.isin(words) & (F.col("n") > 1)).select(F.xxhash64("word").alias("h"), F.log("n").alias("log_n"))
    return others.join(rare.hint("shuffle_hash"), "h").groupBy("row").agg(F.sum("log_n").alias("log_n"))  # one row a word on the right


def class_totals(rows: DataFrame) -> np.ndarray:
    """Tokens of each kind in all documents; kinds of one word count as 1, as p(word | kind) is 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS, np.int64)
        for batch in batches:
            for kinds in batch.column(0):
                total += np.bincount(np.frombuffer(kinds.as_py(), np.uint16), minlength=KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS)), pa.array(total)], ["kind", "n"])

    found = np.ones(KINDS, np.int64)
    for r in rows.select("kinds").mapInArrow(count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).where(F.col("kind") >= KINDS - OTHERS).collect():
        found[r["kind"]] = max(1, r["n"])
    return found


def find_kinds(rows: DataFrame, words: list[str]) -> DataFrame:
    """(row, id, text_hash, kinds): each text's kinds, two bytes a token, found once for all rounds and the scores."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in batches:
            kinds = [tokens.ids(text.as_py()).tobytes() for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds, pa.binary())], ["row", "id", "text_hash", "kinds"])

    schema = rows.select("row", "id", "text_hash", F.lit(b"").alias("kinds")).schema
    for field in schema:
        field.nullable = True
    return rows.select("row", "id", "text_hash", "text").mapInArrow(run, schema)


def _learn(shared, rate: float, round_: int):
    schema = pa.schema([("tokens", pa.int64()), ("weights", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, weights, held, size, total = None, None, [], 0, 0

        def flush() -> None:
            nonlocal weights, held, size, total
            ids = np.concatenate(held)
            around = np.concatenate([windows(x) for x in held])
            weights = train(weights, around, ids, rate, (round_ << 32) + shard, total if round_ == 0 else total + 32 * MOST_STEP)
            total, held, size = total + size, [], 0

        def done() -> pa.RecordBatch:
            if held:
                flush()
            return pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weights.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for here, kinds in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if here != shard:
                    if shard is not None:
                        yield done()
                    shard, weights, held, size, total = here, shared.value, [], 0, 0
                own = np.frombuffer(kinds.as_py(), np.uint16)
                held.append(own)
                size += len(own)
                if size >= SHARD_TOKENS // 4:  # whole texts, in the shard's order
                    flush()
        if shard is not None:
            yield done()

    return run


def fit(rows: DataFrame, tokens: int) -> np.ndarray:
    """Weights trained on the kinds of all documents.

    Documents are dealt by id and text hash into shards, and are in the order of both there. In each round every shard is trained on from the round's
    weights, and the results are averaged by their tokens, which partitions have no part in. Sums go up a tree of tasks; the driver gets a few vectors of 34,000 numbers.
    """
    sc = rows.sparkSession.sparkContext
    shards = max(1, -(-tokens // SHARD_TOKENS))
    key = F.pmod(F.xxhash64("id", "text_hash", F.lit(7)), F.lit(shards))
    some = rows.where(F.length("kinds") > 0).select(key.alias("shard"), "id", "text_hash", "kinds")
    dealt = checkpoint(some.repartitionByRange(min(shards, 10_000), "shard").sortWithinPartitions("shard", "id", "text_hash").select("shard", "kinds"), free=True)
    weights = start()
    for n in range(ROUNDS if tokens else 0):
        found = dealt.mapInArrow(_learn(sc.broadcast(weights), RATE / (n + 1), n), "tokens long, weights binary")
        one = lambda r: (r["tokens"], np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["tokens"])
        both = found.rdd.map(one).treeAggregate((0, 0.0), lambda a, x: (a[0] + x[0], a[1] + x[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), 4)
        weights = np.round(both[1] / both[0], 5).astype(np.float32)  # sums in another order give the same
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, the sum of log p(token | WINDOW tokens on either side) over all its tokens, and their mean.

    The network adds gated vectors of the tokens on both sides, a tanh layer and a two-level softmax over token kinds; the
    token itself is not seen. The commonest words are kinds of their own. All others share kinds, and log p(word | kind), its count
    in all documents over that of its kind, is added, so that every word of the corpus has a probability of its own. Counts
    and weights come from all documents; every token of every text is scored. A lower mean is a less likely text.

    Defined results: a null or blank text has 0 tokens, sum 0.0 and a null mean; equal ids are scored each, and equal rows alike; of words that are equally common
    the first by name are kinds of their own; very long texts are scored whole; an empty table gives no rows; other columns, whatever their
    names, are not read. Partitions change scores by no more than rounding does.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/masked-lm-{uuid.uuid4().hex}"
    texts.write.parquet(folder)  # rows keep their numbers; columns are compressed, and go when they have been read
    texts = spark.read.schema(texts.schema).parquet(folder)
    counts = checkpoint(count_words(texts), free=True)
    tokens = counts.agg(F.sum("n")).head()[0] or 0
    words = common_words(counts)
    rows = checkpoint(find_kinds(texts, words))
    logs = checkpoint(shares(texts, counts, words), free=True)
    remove(spark, folder)
    shared = spark.sparkContext.broadcast((fit(rows, tokens), np.log(class_totals(rows)).astype(np.float32)))
    rows = rows.join(logs, "row", "left").select("id", "kinds", F.coalesce("log_n", F.lit(0.0)).alias("log_n"))
    schema = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("pll_sum"), F.lit(0.0).alias("pll_mean")).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, log_totals = shared.value
        for batch in batches:
            counts, sums = [], []

            def flush(held: list[np.ndarray]) -> None:
                size = np.array([len(x) for x in held])
                ids = np.concatenate(held)
                found = log_probabilities(weights, np.concatenate([windows(x) for x in held]), ids) - log_totals[ids]
                total = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])  # noqa: B023
                ends = np.cumsum(size)
                sums.extend((total[ends] - total[ends - size]).tolist())  # noqa: B023
                counts.extend(size.tolist())  # noqa: B023

            held: list[np.ndarray] = []
            size = 0
            for kinds in batch.column(1):
                held.append(np.frombuffer(kinds.as_py(), np.uint16))
                size += len(held[-1])
                if size > 100_000:
                    flush(held)
                    held, size = [], 0
            if held:
                flush(held)
            sums = [s + x if n else 0.0 for s, x, n in zip(sums, batch.column(2).to_pylist(), counts, strict=True)]
            means = [s / n if n else None for s, n in zip(sums, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], ["id", "n_tokens", "pll_sum", "pll_mean"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
