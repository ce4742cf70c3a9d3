"""Toxicity: a weighted lexicon is learned from labels, matched by Aho-Corasick in folded texts, and its hits are weighed against the text's length.

Folding undoes disguises: case, letters of other scripts that look Latin, and digits or signs in the place of letters. The lexicon holds words and
word beginnings with the logarithm of how much more often they occur in toxic documents; exception phrases, given ones and words that are learned from clean
documents, cancel the hits that they cover. A logistic model over the sum of weights, its share of the text and the heaviest hit gives the score.

What is learned comes from a bounded sample of labelled documents (``MAX_SAMPLE`` a class, by a hash of the id). All documents are scored, whole, one by one.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of a class that a model is fitted on, at most; the class's share of all labels is its weight.
MAX_SAMPLE = 5_000
#: Entries of the lexicon and learned exceptions, at most: the model's size, which is broadcast.
MAX_TERMS, MAX_EXCEPTIONS = 6_000, 6_000
SHORTEST, LONGEST = 4, 10
LEAST_COUNT, LEAST_WEIGHT, LEAST_Z = 4, 0.7, 4.0
#: Phrases in which a lexicon word is harmless; matched as whole words after folding.
PHRASES = ("trash can", "trash cans", "trash bin", "class clown", "clown fish", "stupid question")

# Characters that look like Latin letters, and the letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ⅼ": "l", "ⅰ": "i",
}
# Digits and signs that stand for letters. I and L share one form, as 1 stands for both.
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "i": "l"}
FULLWIDTH = {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
#: Zero-width and soft marks that split a word unseen.
HIDDEN = "­​‌‍⁠﻿"


def _map() -> dict[str, str]:
    letters = FULLWIDTH | LOOKALIKES
    return SUBSTITUTES | {a: SUBSTITUTES.get(b, b) for a, b in letters.items()}


def fold(text: Column) -> Column:
    """The folded text: words of letters and digits, each between single spaces. A null or blank text gives one space.

    Lower case; look-alikes and substitutes become letters (``!`` and ``|`` between letters too); hidden marks go; the rest separates words.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    signs = F.when(low.rlike(r"\p{L}[!|]\p{L}"), F.regexp_replace(low, r"(?<=\p{L})[!|](?=\p{L})", "l")).otherwise(low)
    pairs = _map()
    plain = F.translate(signs, "".join(pairs) + HIDDEN, "".join(pairs.values()))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[^\p{L}\p{M}\p{N}]+", " ")


def fold_phrase(phrase: str) -> str:
    return " ".join("".join(_map().get(c, c) for c in phrase.lower()).split())


@dataclasses.dataclass(frozen=True)
class Lexicon:
    """``terms``: folded word beginnings (``word ``, with a space behind, is the whole word) and their weights; ``exceptions``: folded whole words or phrases."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]


@functools.lru_cache(maxsize=2)
def automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """Patterns begin with the space before a word; a value is the pattern's length and weight, None for an exception."""
    found = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        found.add_word(f" {term}", (len(term) + 1, weight))
    for phrase in lexicon.exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if not len(found):
        return None
    found.make_automaton()
    return found


FEATURES = ("weight", "n_words", "hits", "heaviest")


def features(text: str, lexicon: Lexicon) -> tuple[float, int, int, float]:
    """Of a folded text: the weights of the distinct words that are hit added up, the number of distinct words, of those that are hit, the heaviest.

    A word is weighed once, by its longest term; words within an exception aren't.
    """
    machine = automaton(lexicon)
    longest: dict[int, tuple[int, float]] = {}
    spared: set[int] = set()
    for end, (size, weight) in machine.iter(text) if machine is not None else ():
        start = end - size + 1
        if weight is None:
            while 0 <= start < end:  # each word of the phrase
                spared.add(start)
                start = text.find(" ", start + 1, end)
        elif start not in longest or longest[start][0] < size:
            longest[start] = (size, weight)
    words = {text[at + 1 : text.index(" ", at + 1)]: weight for at, (_, weight) in longest.items() if at not in spared}
    return sum(words.values()), len(set(text.split())), len(words), max(words.values(), default=0.0)


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Of documents whose column ``folded`` holds the folded text, all other columns and the features."""
    kept = [c for c in docs.columns if c != "folded"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), lexicon) for t in batch.column("folded")]
            columns = [pa.array([x[i] for x in found], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *FEATURES])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "folded")
    return docs.mapInArrow(task, f"{types}, {', '.join(f'{x} double' for x in FEATURES)}")


def sample(labels: DataFrame) -> tuple[DataFrame | None, dict[bool, float]]:
    """(doc_id, toxic) of at most ``MAX_SAMPLE`` labelled documents a class, the first by a hash of the id, and what one of a class stands for.

    A document with several labels is toxic if one of them says so; null labels and ids are none.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE) for t in (True, False)]
    ids = [(r["doc_id"], r["toxic"]) for df in first for r in df.collect()]
    taken = {t: counts[t] / sum(x[1] == t for x in ids) for t in counts}
    return (labels.sparkSession.createDataFrame(ids, "labelled long, toxic boolean") if ids else None), taken


def log_odds(toxic: Column, clean: Column, toxic_all: float, clean_all: float) -> tuple[Column, Column]:
    """How much more often something occurs in toxic documents, as a logarithm, and the root of its likelihood ratio, which holds for zero counts too."""
    ratio = F.log((toxic + 0.5) / F.lit(toxic_all + 0.5)) - F.log((clean + 0.5) / F.lit(clean_all + 0.5))
    share = toxic_all / (toxic_all + clean_all)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((toxic + clean) * p))).otherwise(0.0)
    return ratio, F.sqrt(F.greatest(2 * (part(toxic, share) + part(clean, 1 - share)), F.lit(0.0)))


def learn_lexicon(labelled: DataFrame, phrases: Sequence[str] = PHRASES) -> Lexicon:
    """From labelled folded texts (``folded``, ``toxic``). A word counts once a document; a beginning counts as its words do.

    A word that begins with a term, but occurs in clean documents no more seldom than in toxic ones, and in two of them at least, is an exception.
    """
    words = labelled.select("toxic", F.explode(F.array_distinct(F.split(F.trim("folded"), " "))).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).cache()
    total = counted.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).head()
    if not total["t"] or not total["c"]:
        counted.unpersist()
        return Lexicon((), tuple(fold_phrase(p) for p in phrases))
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.substring("word", F.lit(1), n))
    begins = F.when(F.length("word") >= SHORTEST, F.array_distinct(begins)).otherwise(F.array())
    every = F.concat(begins, F.array(F.concat("word", F.lit(" "))))
    terms = counted.select("t", "c", F.explode(every).alias("term")).groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio, z = log_odds(F.col("t"), F.col("c"), total["t"], total["c"])
    heavy = terms.where(F.col("t") >= LEAST_COUNT).select("term", ratio.alias("weight"), z.alias("z")).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
    found = [(r["term"], r["weight"]) for r in heavy.orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()]
    starts = labelled.sparkSession.createDataFrame([(t,) for t, _ in found] or [("",)], "term string")
    under = counted.where(F.col("c") >= 2).where(ratio <= 0).select("word", "c", F.explode(begins).alias("term")).join(F.broadcast(starts), "term", "left_semi")  # MAX_TERMS rows
    spared = [r["word"] for r in under.groupBy("word").agg(F.max("c").alias("c")).orderBy(F.desc("c"), "word").limit(MAX_EXCEPTIONS).collect()]
    counted.unpersist()
    return Lexicon(tuple(found), tuple(dict.fromkeys([*map(fold_phrase, phrases), *spared])))


def inputs(weight, n_words, heaviest, log) -> list:  # noqa: ANN001
    """What the logistic model sees, of numbers or columns: the sum of weights, the length, their ratio, the heaviest hit."""
    return [log(weight + 1), log(n_words + 1), 10 * weight / (n_words + 1), heaviest]


@dataclasses.dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]

    def score(self) -> Column:
        x = inputs(F.col("weight"), F.col("n_words"), F.col("heaviest"), F.log)
        line = F.lit(self.coefficients[0])
        for b, column in zip(self.coefficients[1:], x, strict=True):
            line = line + F.lit(b) * column
        return 1 / (1 + F.exp(-line))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """A weighted logistic regression by Newton's method; a small ridge keeps separable classes finite."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return beta


def fit(docs: DataFrame, labels: DataFrame, phrases: Sequence[str] = PHRASES) -> Model:
    """The model of the given labels. With labels of one class only it says that class's base rate, nearly; without labels, 0."""
    ids, stands = sample(labels)
    if ids is None:
        return Model(Lexicon((), ()), (-1000.0, 0.0, 0.0, 0.0, 0.0))
    labelled = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled")).select("toxic", fold(F.col("text")).alias("folded")).cache()  # 2 MAX_SAMPLE rows
    lexicon = learn_lexicon(labelled, phrases)
    rows = with_features(labelled, lexicon).collect()
    labelled.unpersist()
    y = np.array([float(r["toxic"]) for r in rows])
    if len(set(y)) < 2:
        at = 30.0 if len(y) and y[0] else -30.0
        return Model(lexicon, (at, 0.0, 0.0, 0.0, 0.0))
    x = np.array([[1.0, *inputs(r["weight"], r["n_words"], r["heaviest"], np.log)] for r in rows])
    weight = np.array([stands[r["toxic"]] for r in rows])
    return Model(lexicon, tuple(map(float, logistic(x, y, weight))))


def held_out(doc_id: Column) -> Column:
    """One in five, by the id alone; null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the features of every row; null ids, repeated rows and empty texts are rows like others."""
    folded = docs.select("doc_id", fold(F.col("text")).alias("folded"))
    found = with_features(folded, model.lexicon).withColumn("score", model.score())
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents, by a model of the labels that aren't held out."""
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
