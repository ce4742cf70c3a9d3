"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, order_ranges, shared_folder, shuffle_partitions

#: Weights are multiples of 1 / UNIT, so after UNIT slots every source has exactly its share and the schedule begins anew.
UNIT = 1 << 29
#: Slots of a phase, at most; a multiple of UNIT, up to which all products of the schedule fit 64 bits. Longer phases are cut there, where no window is open.
LONGEST = 1 << 32
#: Slots of a stretch, at least; a stretch is no shorter than the least weight's period.
STRETCH = 1024
#: Numbers of the plan that the driver holds at once; longer plans are written in pieces.
PLAN = 500_000


def _whole(weights: np.ndarray) -> np.ndarray:
    """Weights as multiples of 1 / UNIT that sum to 1, by largest remainders, one UNIT at least; of equal remainders the first."""
    exact = weights * (UNIT / weights.sum())
    given = np.maximum(1, np.floor(exact)).astype("int64")
    short = UNIT - int(given.sum())
    if short > 0:
        given[np.argsort(given - exact, kind="stable")[:short]] += 1
    elif short < 0:
        given[len(given) - 1 - int(np.argmax(given[::-1]))] += short
    return given


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    names = sorted(weights)
    return dict(zip(names, _whole(np.array([weights[s] for s in names], float)).tolist(), strict=True))


def by_releases(w: np.ndarray, at: int) -> np.ndarray:
    """Blocks of each source before slot ``at``, if of the blocks whose windows hold it those released first are done: a state that a schedule can end in.

    Of the blocks done, those released at ``a`` or later number at most at - a, for every a. Let K be the sources whose open window began before a: they have
    no block that both begins and ends in the span. If no block of the others is chosen, the span has at most floor(w at) - ceil(w a) blocks of each, together no more than
    at - a. If one is chosen, all of K are, and what is left of at is at - sum(ceil(w a)), no more than that either. So all blocks fit before ``at``.
    """
    done, rest = np.divmod(w * at, UNIT)
    inside = np.flatnonzero(rest)
    first = inside[np.argsort(done[inside] * UNIT // w[inside], kind="stable")]
    done[first[: at - int(done.sum())]] += 1
    return done


def plan_phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple]:
    """(first slot, slots, stretch, sources, weights, blocks before, blocks after) of each phase, and (source, block, slot) of leftovers.

    A phase ends when a source would need more blocks than it has; the sources that are used up leave, and the others share the slots by their
    weights. A source with one block left by then gets the slot after the phase. A phase's last state is known in closed form, see
    ``by_releases``, so no slot is looked at here: a phase is a few array operations over its sources, whatever their weights and its length.
    """
    names = np.array(sorted(s for s, n in blocks.items() if n), object)
    left = np.array([blocks[s] for s in names], "int64")
    share = np.array([weights[s] for s in names], float)
    done = np.zeros(len(names), "int64")
    base = 0
    while len(names):
        w = _whole(share)
        ends = np.minimum(left, 2 * LONGEST) * UNIT // w
        slots = int(ends.min())
        whole = slots >= LONGEST
        slots = LONGEST if whole else slots
        taken = by_releases(w, slots)
        yield base, slots, max(STRETCH, -(-UNIT // int(w.min()))), names, w, done, taken
        base += slots
        done = done + taken
        left = left - taken
        if not whole or slots == ends.min():
            for i in np.flatnonzero((ends == slots) & (left > 0)):  # it would be used up in the next slot
                yield names[i], int(done[i]), base
                base += 1
                done[i] += 1
                left[i] -= 1
        stay = left > 0
        names, left, share, done = names[stay], left[stay], share[stay], done[stay]


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _before(w: Column, at: Column) -> Column:
    """Blocks of each source before slot ``at``, if of the blocks whose windows hold it those of the earliest deadlines are done."""
    done = F.transform(w, lambda x: _div(x * at, UNIT))
    late = lambda n, x: _div((n + 1) * UNIT + x - 1, x)

    def ahead(n: Column) -> Column:
        inside = F.filter(F.zip_with(F.transform(w, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), n, lambda a, m: F.struct(late(m, a["x"]).alias("due"), a["k"].alias("k"), a["x"].alias("x"))), lambda a: a["x"] * at % UNIT > 0)
        short = (at - F.aggregate(n, F.lit(0).cast("long"), lambda a, m: a + m)).cast("int")
        chosen = F.transform(F.slice(F.sort_array(inside), F.lit(1), short), lambda a: a["k"])
        return let(chosen, lambda c: F.transform(n, lambda m, k: m + F.when(F.array_contains(c, k), 1).otherwise(0)))

    return let(done, ahead)


def _div(a: Column, b: Column | int) -> Column:
    """Whole division of numbers of 0 and more."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _run(w: Column, done: Column, until: Column | None, begin: Column, slots: Column) -> Column:
    """Earliest deadline first from the state ``done``: a struct of ``order``, an array of (k, i) of each slot, and ``done`` after it.

    ``until``: blocks of each source that are done by the end, which is every deadline's latest. A state of one entry a source goes from
    slot to slot, in pieces of 256, so that appending to a piece copies little.
    """
    end = begin + slots
    entry = lambda k, i, x: F.struct(
        (F.least(_div((i + 1) * UNIT + x - 1, x), end) if until is not None else _div((i + 1) * UNIT + x - 1, x)).alias("due"),
        k.alias("k"), i.alias("i"), _div(i * UNIT, x).alias("from"),
    )
    first = F.zip_with(F.transform(w, lambda x, k: F.struct(x.alias("x"), k.cast("int").alias("k"))), done, lambda a, i: entry(a["k"], i, a["x"]))
    picked = "array<struct<k:int,i:bigint>>"

    def slot(a: Column, t: Column) -> Column:
        due = lambda s: (s["from"] <= t) & (s["i"] < F.get(until, s["k"])) if until is not None else s["from"] <= t
        best = F.array_min(F.filter(a["state"], due))

        def after(b: Column) -> Column:
            state = F.transform(a["state"], lambda s: F.when(s["k"] == b["k"], entry(s["k"], s["i"] + 1, F.get(w, s["k"]))).otherwise(s))
            return F.struct(state.alias("state"), F.concat(a["order"], F.array(F.struct(b["k"].alias("k"), b["i"].alias("i")))).alias("order"))

        return let(best, after)

    def piece(a: Column, p: Column) -> Column:
        times = F.sequence(begin + p * 256, F.least(begin + p * 256 + 255, end - 1))
        found = F.aggregate(times, F.struct(a["state"].alias("state"), F.array().cast(picked).alias("order")), slot)
        return let(found, lambda f: F.struct(f["state"].alias("state"), F.concat(a["orders"], F.array(f["order"])).alias("orders")))

    begun = F.struct(first.alias("state"), F.array().cast(f"array<{picked}>").alias("orders"))
    pieces = F.sequence(F.lit(0).cast("long"), _div(slots - 1, 256))
    return F.aggregate(pieces, begun, piece, lambda a: F.struct(F.flatten(a["orders"]).alias("order"), F.transform(a["state"], lambda s: s["i"]).alias("done")))


def schedule(spark, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """(source, block, slot) of every block, by Pfair scheduling in stretches that are computed independently.

    Block i of a source of weight w is released at floor(i / w) and due at ceil((i + 1) / w). A source whose blocks all keep these windows is at any slot
    less than one block from its weighted share. Earliest deadline first keeps them all: in any span of b - a slots, at most b - a
    blocks have windows inside, as the weights sum to 1.

    A stretch begins in the state that a run of the stretch before it leads to, if that begins with the blocks of the earliest deadlines done; from that
    choice, no span from there on holds too many windows. So a stretch's first state keeps all later deadlines, its last state, the next one's first, was
    reached by a schedule within it, and as a stretch holds a whole window of every source, its blocks are those between the two states. Hence within a stretch, with deadlines cut
    at its end, earliest deadline first keeps all windows.
    
    The last stretch ends in the phase's last state. Rows of the plan, two arrays of the phase's sources each and its first and last state, are written in pieces
    where they are many, so the driver never holds more than ``PLAN`` numbers and a phase.
    """
    schema = "phase int, base long, slots long, stretch long, number long, names array<string>, w array<bigint>, before array<bigint>, after array<bigint>"
    rows, loose, firsts, number, folder = [], [], [], 0, None

    def write() -> None:
        nonlocal folder
        folder = folder or f"{shared_folder(spark)}/plan-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        rows.clear()

    held = 0
    for found in plan_phases(blocks, weights):
        if len(found) == 3:
            loose.append(found)
            continue
        base, slots, stretch, names, w, before, after = found
        if slots:
            rows.append((len(firsts), base, slots, stretch, number, names.tolist(), w.tolist(), before.tolist(), after.tolist()))
            firsts.append(number)
            number += max(1, slots // stretch)
            held += 4 * len(names)
            if held > PLAN:
                write()
                held = 0
    if folder and rows:
        write()
    table = spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame(rows, schema)
    leftovers = spark.createDataFrame(loose, "source string, block long, slot long")
    if not number:
        return leftovers
    known = F.lit(firsts[1:]).cast("array<bigint>") if len(firsts) > 1 else F.array().cast("array<bigint>")
    numbers = spark.range(0, number, 1, max(1, min(number, shuffle_partitions(spark))))
    phase = F.size(F.filter(known, lambda x: x <= F.col("id"))).alias("phase")
    one = numbers.select("id", phase).join(table, "phase")  # Spark broadcasts the plan below its own limit
    begin = ((F.col("id") - F.col("number")) * F.col("stretch")).alias("begin")
    last = F.col("id") - F.col("number") + 1 >= F.greatest(F.lit(1), _div(F.col("slots"), F.col("stretch")))
    one = one.withColumns({"begin": begin, "last": last})
    w, begin, stretch = F.col("w"), F.col("begin"), F.col("stretch")
    # The states at the stretch's ends come from runs of the stretch before, and of this one. Each is bound to a variable, so that it is computed once.
    state = F.when(begin == 0, F.transform(w, lambda x: F.lit(0).cast("long"))).otherwise(_run(w, _before(w, begin - stretch), None, begin - stretch, stretch)["done"])
    ends = F.when(F.col("last"), F.col("after")).otherwise(_run(w, _before(w, begin), None, begin, stretch)["done"])
    length = F.when(F.col("last"), F.col("slots") - begin).otherwise(stretch)
    one = one.withColumn("order", let(state, lambda d: let(ends, lambda until: _run(w, d, until, begin, length)["order"])))
    each = one.select("names", "before", "base", "begin", F.posexplode("order").alias("at", "o"))
    found = each.select(
        F.get("names", F.col("o.k")).alias("source"), (F.get("before", F.col("o.k")) + F.col("o.i")).alias("block"), (F.col("base") + F.col("begin") + F.col("at")).alias("slot")
    )
    return found.union(leftovers) if loose else found


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = 16,
    power: float = 0.7,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Every row with its place in a stream that mixes the sources to their weights.

    A source's rows, in id order, form blocks of ``block_rows`` (the last may be shorter). Blocks go to slots
    by Pfair scheduling, see ``schedule``: after any number of slots each source's blocks differ from its weighted
    share by less than one. A source that is used up leaves; from there on the rest share the slots by their
    weights. Weights are taken to 1 / UNIT = 2e-9, and the deviation of less than one block is from these; over n slots they may be off from the given ones by
    n / UNIT blocks more. ``weights`` None: rows of the source to the ``power``. A source that
    ``weights`` does not name gets the least weight named. The driver gets one row a source, of any number; a phase begins where a source ends.

    A row's number in its source comes from per-range totals and their running sums, so a source that holds
    a third of all rows is dealt over as many tasks as its ranges. Each range gets its blocks' slots as one
    array, which meets its rows where the numbering left them.

    Returns the input's columns with ``mix_block`` (number in the source), ``mix_slot`` and ``mix_row`` (place
    in the block); the stream's order is (mix_slot, mix_row). Defined results: a null source is a source; null
    ids come first; equal ids of a source are ordered among themselves by the rows' hash, so equal rows are interchangeable; texts of any length
    or none are carried as they are; an empty table gives no rows; input columns of the three names are replaced, others, whatever their
    names, are kept.
    """
    spark = docs.sparkSession
    added = ("mix_block", "mix_slot", "mix_row")
    columns = [c for c in docs.columns if c not in added]
    packed = docs.select(
        _key(F.col(source_col)).alias("src"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(source_col), *[F.col(c) for c, t in docs.dtypes if t == "string" and c in columns]).alias("tie"),
        F.struct(*columns).alias("packed"),
    )
    ranges = order_ranges(packed, F.col("id"), F.col("tie"), 2 * shuffle_partitions(spark))
    rows = packed.withColumn("range", ranges)
    totals = rows.groupBy("src", "range").agg(F.count("*").alias("n"))
    sizes = {r["src"]: r["n"] for r in totals.groupBy("src").agg(F.sum("n").alias("n")).collect()}  # one row a source
    if weights is None:
        weight = {s: float(n) ** power for s, n in sizes.items()}
    else:
        named = {("null" if s is None else f"={s}"): float(w) for s, w in weights.items() if w > 0}
        weight = {s: named.get(s, min(named.values(), default=1.0)) for s in sizes}
    if not sizes:
        return docs.select(*columns, F.lit(0).cast("long").alias("mix_block"), F.lit(0).cast("long").alias("mix_slot"), F.lit(0).alias("mix_row"))
    slots = schedule(spark, {s: -(-n // block_rows) for s, n in sizes.items()}, weight)

    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("src", "range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    first, last = F.expr(f"before div {block_rows}"), F.expr(f"(before + n - 1) div {block_rows}")
    asked = offsets.select("src", "range", "before", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    # A range's blocks are those of its own rows; the array has one slot for each.
    given = (
        asked.join(slots.withColumnRenamed("source", "src"), ["src", "block"])
        .groupBy("src", "range").agg(F.first("before").alias("before"), F.first("first").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"))
    )
    inside = Window.partitionBy("src", "range").orderBy(F.col("id").asc_nulls_first(), "tie")
    numbered = rows.withColumn("row", F.row_number().over(inside).cast("long") - 1).join(given, ["src", "range"]).withColumn("row", F.col("row") + F.col("before"))
    block = F.expr(f"row div {block_rows}")
    return numbered.select(
        *[F.col("packed")[c].alias(c) for c in columns], block.alias("mix_block"),
        F.get("slots", (block - F.col("first")).cast("int")).alias("mix_slot"), (F.col("row") % block_rows).cast("int").alias("mix_row"),
    )


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mixed order: ranges of slots, sorted within; ``mix_slot`` and ``mix_row`` give the order."""
    order = mix(docs, **options)
    parts = shuffle_partitions(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_row")]
    return order.repartitionByRange(parts, "mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row").select(*kept, "mix_slot", "mix_row")
