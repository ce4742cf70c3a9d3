"""Document fingerprints by I-Match over randomised lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, order_ranges, shuffle_partitions

#: A term's share of all documents: the inverse-document-frequency band. The lower end bounds the lexicon by
#: (mean distinct terms of a document) / LEAST_SHARE terms, whatever the size of the corpus.
LEAST_SHARE, MOST_SHARE = 0.002, 0.05
#: Lexicon subsets of each level. A term is in one of them with probability 4 ** -level.
SUBSETS, LEVELS = 48, 10
_SLOTS = 1 << 14
_FINGERPRINT = "array<struct<level:int,subset:int,hash:bigint>>"


def terms(text: Column) -> Column:
    """The distinct runs of letters and digits of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def build_lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> list[str]:
    """The terms within the band of document frequency, dealt into slots by their hash: " term term ", one string a slot.

    Frequencies are counted over all documents, summed by task before the shuffle. Terms of one document alone
    are out. The driver gets the band only, which the band's lower end bounds.
    """
    counted = docs.select(F.explode_outer(terms(F.col(text_col))).alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    least, most = max(2.0, least_share * n), max(2.0, most_share * n)
    found = (
        counted.where((F.col("df") >= least) & (F.col("df") <= most))
        .groupBy(F.pmod(F.xxhash64("term"), F.lit(_SLOTS)).cast("int").alias("slot"))
        .agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))
        .collect()
    )
    lexicon = [""] * _SLOTS
    for row in found:
        lexicon[row["slot"]] = f" {row['terms']} "
    return lexicon


def fingerprint(text: Column, lexicon: list[str]) -> Column:
    """Array of (level, subset, hash): for each randomised subset of the lexicon that holds terms of the text.

    The terms that are in the lexicon are sorted, and each subset's terms are hashed in that order. A level's
    subsets are disjoint; the two levels at which a text of n such terms has up to one, and up to a quarter of a
    term a subset are used, so that texts of any length keep subsets which an edit leaves whole. A text without
    such terms has the hash of all its sorted terms at level -1.
    """

    slots = F.split(F.lit("\n".join(lexicon)), "\n")  # folds to one literal
    held = lambda t: F.contains(F.get(slots, F.pmod(F.xxhash64(t), F.lit(_SLOTS)).cast("int")), F.concat(F.lit(" "), t, F.lit(" ")))

    def level_of(n: Column) -> Column:
        return F.least(F.lit(LEVELS - 2), F.greatest(F.lit(0), F.ceil(F.log(n / F.lit(float(SUBSETS))) / F.log(F.lit(4.0))))).cast("int")

    def at_level(found: Column, level: Column) -> Column:
        cells = (F.lit(SUBSETS) * F.pow(F.lit(4.0), level)).cast("long")
        cell = lambda t: F.struct(F.pmod(F.xxhash64(t, level), cells).cast("int").alias("c"), t.alias("t"))
        mine = F.sort_array(F.filter(F.transform(found, cell), lambda x: x["c"] < SUBSETS))

        def step(a: Column, x: Column) -> Column:
            last = F.get(a, F.size(a) - 1)
            again = F.coalesce(last["subset"] == x["c"], F.lit(False))
            entry = F.struct(
                level.alias("level"), x["c"].alias("subset"),
                F.when(again, F.xxhash64(last["hash"], x["t"])).otherwise(F.xxhash64(F.lit(0).cast("long"), x["t"])).alias("hash"),
            )
            return F.concat(F.when(again, F.slice(a, 1, F.size(a) - 1)).otherwise(a), F.array(entry)).cast(_FINGERPRINT)

        return F.aggregate(mine, F.array().cast(_FINGERPRINT), step)

    def of(found: Column) -> Column:
        whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("subset"), F.xxhash64(F.array_join(F.array_sort(terms(text)), " ")).alias("hash")))
        leveled = let(level_of(F.size(found)), lambda a: F.concat(at_level(found, a), at_level(found, a + 1)))
        return F.when(F.size(found) == 0, whole.cast(_FINGERPRINT)).otherwise(leveled)

    return let(F.filter(terms(text), held), of)


def fingerprint_text(found: Column) -> Column:
    """level.subset=hash in hexadecimal, comma-joined."""
    hexed = lambda x: F.concat(x["level"].cast("string"), F.lit("."), x["subset"].cast("string"), F.lit("="), F.lower(F.hex(x["hash"])))
    return F.array_join(F.transform(found, hexed), ",")


def likeness(one: Column, other: Column) -> Column:
    """Subsets with equal hashes over subsets that hold terms of either text, on the levels that both have; 0 if none, 1 if all are equal."""
    levels = lambda x: F.array_distinct(F.transform(x, lambda e: e["level"]))

    def of(shared: Column) -> Column:
        held = lambda x: F.transform(F.filter(x, lambda e: F.array_contains(shared, e["level"])), lambda e: F.struct(e["level"].alias("l"), e["subset"].alias("s")))
        either = F.size(F.array_union(held(one), held(other)))
        return F.when(either > 0, F.size(F.array_intersect(one, other)) / either).otherwise(F.lit(0.0))

    return F.when(one == other, F.lit(1.0)).otherwise(let(F.array_intersect(levels(one), levels(other)), of))


def add_fingerprints(docs: DataFrame, lexicon: list[str], text_col: str = "text") -> DataFrame:
    """Every row with ``fingerprint``. A null text counts as empty; equal texts get equal fingerprints; an input column of that name is replaced."""
    return docs.withColumn("fingerprint", fingerprint(F.col(text_col), lexicon))


def with_next(rows: DataFrame, carried: list[str], id_col: str = "doc_id") -> DataFrame:
    """Every row with ``next``: a struct of the ``carried`` columns of the following row in id order; the first follows the last.

    Ranges of ids, by quantile cuts, are windows of their own; each range's first rows are sent to the range
    before as well, so that its last row finds them. Null ids come first; equal or null ids are in the order of the
    first carried column's hash, by which many of them are dealt into ranges.
    """
    tied = rows.withColumn("_tie", F.xxhash64(carried[0]))  # of a column that costs nothing to make again
    ranged = tied.withColumn("_range", order_ranges(tied, F.col(id_col), F.col("_tie"), 4 * shuffle_partitions(rows.sparkSession)))
    everything = Window.orderBy("_range")
    around = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.col("_tie"))
    firsts = (
        ranged.groupBy("_range").agg(F.min(place).alias("_least"))
        .withColumn("_to", F.coalesce(F.lag("_range").over(everything), F.last("_range").over(around)))
    )
    here, there = F.struct(F.lit(False).alias("copy"), F.col("_range").alias("r")), F.struct(F.lit(True).alias("copy"), F.col("_to").alias("r"))
    both = ranged.join(F.broadcast(firsts), "_range")  # one row a range
    dealt = both.withColumn("_c", F.explode(F.when(place == F.col("_least"), F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy(F.col("_c.r")).orderBy(F.col("_c.copy"), F.col(id_col).asc_nulls_first(), "_tie")
    return (
        dealt.withColumn("next", F.lead(F.struct(*carried)).over(order))
        .where(~F.col("_c.copy"))
        .select(*rows.columns, "next")
    )


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, the text whose last half is replaced by the next document's first half.

    The edit keeps the first n - floor(n / 2) code points and appends the first floor(n / 2) (or all) of the next
    document by id. Returns the id, n_chars, edited, fingerprint, edited_fingerprint, near_edited and near_next.
    Defined results: a null text counts as empty; a lone document is its own next; see ``with_next`` for null and equal ids; very long texts are taken
    whole; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lexicon = build_lexicon(rows)
    paired = with_next(add_fingerprints(rows, lexicon), ["text", "fingerprint"], "_id")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumns({
        "n_chars": F.length("text").cast("long"),
        "edited": F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)),
    }).drop("text")
    edited = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited"), lexicon))
    return edited.select(
        F.col("_id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )
