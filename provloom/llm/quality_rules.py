"""Line-first quality rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

#: Phrases of page furniture and licence headers; fixed values.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "enable javascript", "sign up for our newsletter", "skip to content", "licensed under the", "spdx-license-identifier",
)
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Shares of a line's characters, or of a document's.
MAX_SYMBOL_SHARE, MAX_LOUD_SHARE, MAX_LOST_SHARE = 0.1, 0.6, 0.5


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_verdict(line: Column) -> Column:
    """The first rule that a line breaks, or null. Lines without a word break none.

    navigation: three or more parts between spaced bars, arrows or middle dots; punctuation: symbols make up over a
    tenth of its characters, or three or more doubled exclamation marks; shouting: over 24 letters, of which over 60 %
    capitals; boilerplate: a phrase of page furniture.
    """
    length_of_line = F.length(line)
    bare = F.length(F.regexp_replace(line, SPACES, ""))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    # Each costly share is behind a search that most lines end.
    symbols = line.rlike(SYMBOLS)
    return (
        F.when(~line.rlike(r"[^\x20\x09-\x0D]"), F.lit(None).cast("string"))
        .when(line.rlike("[|>»·]") & (length_of_line - _length_without(line, r"\s[|>»·](?=\s)") >= 2 * 2), F.lit("navigation"))
        .when(symbols & (length_of_line - _length_without(line, SYMBOLS) > MAX_SYMBOL_SHARE * bare), F.lit("punctuation"))
        .when(F.contains(line, F.lit("!!")) & (length_of_line - _length_without(line, "!!") >= 2 * 3), F.lit("punctuation"))
        .when(line.rlike(r"\p{Lu}{2}") & (letters > 24) & (capitals > MAX_LOUD_SHARE * letters), F.lit("shouting"))
        .when(let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])), F.lit("boilerplate"))
    )


def repeated_words(words: Column) -> Column:
    """How many of the words are in a 3-word window that occurs twice or more.

    If all windows' hashes differ, none. Else the windows are sorted with their places; equal neighbours are the
    repeats. With their first words' places ascending, each adds the words that the one before doesn't cover: three,
    or the distance if it is less.
    """

    def covered(places: Column) -> Column:
        step = lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(places, k - 1), x - 3))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x).cast("long")

    def repeats(windows: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(windows, at)["g"] == x["g"], F.lit(False))
        found = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        exact = let(F.sort_array(F.transform(places, window)), repeats)
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).when(none, F.lit(0).cast("long")).otherwise(exact)

    return let(words, of)


def apply_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with its counts, the text without the lines that break a rule, and the verdict.

    The lines are judged first, each by ``line_verdict``; the document is rejected if it fails the base
    rules or if the lines that were removed hold more than half of its non-space characters. All of it is one
    projection: no shuffle, no state between rows, whole texts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    clean_text, and n_lines_removed (long). Defined results: a null text counts as empty, so it has no words and fails; an
    empty table gives no rows; repeated rows and equal ids are judged each; very long texts are judged whole; input columns with these names are
    replaced, those named _words and _clean are dropped, others are kept.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines_removed"]
    rows = docs.drop(*[c for c in added if c != text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    word_list = F.filter(F.split(text, SPACES), lambda w: w != "")
    counted = let(word_list, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeats")
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_verdict(x).alias("broken")))

    def cleaned(all_lines: Column) -> Column:
        good = F.filter(all_lines, lambda x: x["broken"].isNull())
        return F.struct(
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("text"),
            (F.size(all_lines) - F.size(good)).cast("long").alias("removed"),
        )

    first = rows.withColumns({"_words": counted, "_clean": let(judged, cleaned), "n_dup_lines": dup_lines})
    second = first.withColumns({
        "n_words": F.col("_words.n"),
        "word_chars": F.col("_words.chars"),
        "n_symbols": (F.length(text) - _length_without(text, SYMBOLS)).cast("long"),
        "n_repeat_words": F.col("_words.repeats"),
        "clean_text": F.col("_clean.text"),
        "n_lines_removed": F.col("_clean.removed"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.when(F.col("n_lines_removed") == 0, F.col("word_chars")).otherwise(_length_without(F.col("clean_text"), SPACES))
    return second.withColumns({
        "base_failed": failed,
        "kept": ~failed & (F.col("word_chars") - left <= MAX_LOST_SHARE * F.col("word_chars")),
    }).drop("_words", "_clean")
