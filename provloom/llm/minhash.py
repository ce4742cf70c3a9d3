"""Near-duplicate groups by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, remove, shared_folder
from .components import components

#: Bands of ROWS signature values. Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 28 = 2e-5.
BANDS, ROWS = 28, 5
SIZE = BANDS * ROWS
#: Signature values that two sets must have in common to be compared in full, of SIZE: 4.7 standard deviations below 0.8.
LEAST_EQUAL = 90
#: Elements of documents whose signatures are made at once.
BATCH_ELEMENTS = 150_000
#: Texts that meet one leader's text in one run of rows.
RUN_ROWS = 16_384

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the A-Z lower-cased text."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        if place.max() >= len(_POWERS):
            powers = np.cumprod(np.full(int(place.max()) + 1, _POWERS[0], np.uint64), dtype=np.uint64)
        else:
            powers = _POWERS
        terms = _BYTE[data[inside]] * powers[place]
        return _mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; the whole sequence if it has fewer words, none without words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = _mix(h * _U(0x2545F4914F6CDD1D) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, one row of SIZE values a set, of non-empty sets.

    In round j, each element draws a value in [j, j + 1) for the j-th place of its own random permutation of the
    signature, made by a Fisher-Yates shuffle that goes as far as the rounds do; a place keeps its least value. A set is finished
    when no place has a value of a later round. Large sets end after a few rounds; values are 24-bit fractions above the round.
    """
    count = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), count)
    h = np.concatenate(sets)
    sig = np.full((len(sets), SIZE), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(SIZE, dtype=np.uint8 if SIZE <= 256 else np.uint16), (len(h), 1))
    with np.errstate(over="ignore"):
        for j in range(SIZE):
            r = _mix(h + _U(j + 1) * _U(0x9E3779B97F4A7C15))
            k = j + ((r >> _U(40)) * _U(SIZE - j) >> _U(24)).astype(np.int64)
            at = np.arange(len(h))
            drawn = perm[at, k]
            perm[at, k] = perm[:, j]
            perm[:, j] = drawn
            value = (np.uint32(j) << np.uint32(24)) | (r & _U(0xFFFFFF)).astype(np.uint32)
            np.minimum.at(flat, who * SIZE + drawn, value)
            open_sets = (sig.max(axis=1) >> np.uint32(24)) > j
            if not open_sets.any():
                break
            keep = open_sets[who]
            if not keep.all():
                h, who, perm = h[keep], who[keep], perm[keep]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number included."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
        parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
        for i in range(ROWS):
            key = _mix(key * _U(0x2545F4914F6CDD1D) + parts[:, :, i])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """A byte of each signature value, eight to a long, the rest zero."""
    octets = np.zeros((len(sig), -(-SIZE // 8) * 8), np.uint8)
    octets[:, :SIZE] = (_mix(sig.astype(np.uint64)) & _U(0xFF)).astype(np.uint8)
    return octets.view(np.int64)


def unequal(one: Column, other: Column) -> Column:
    """How many bytes of two sketches differ: each byte's bits are folded into its lowest, and these are counted."""
    total = F.lit(0)
    for i in range(-(-SIZE // 8)):
        x = F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(words: int):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, hashes, sets):
            nodes = [_digest(s) if len(s) else None for s in sets]
            first = {}
            for i, x in enumerate(nodes):
                if x is not None:
                    first.setdefault(x, i)
            row = {}
            if first:
                sig = super_minhash([sets[i] for i in first.values()])
                row = {x: pair for x, *pair in zip(first, band_keys(sig), sketches(sig), strict=True)}
            bands, made = ([row[x][k] if x is not None else None for x in nodes] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(made, pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            ids, hashes, sets, total = [], [], [], 0
            for i, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingle_set((text.as_py() or "").encode(), words)
                if sets and total + len(s) > BATCH_ELEMENTS:
                    yield out(ids, hashes, sets)
                    ids, hashes, sets, total = [], [], [], 0
                ids.append(i)
                hashes.append(h)
                sets.append(s)
                total += len(s)
            if sets:
                yield out(ids, hashes, sets)

    return run


def _verify(words: int, percent: int):
    """Rows arrive leader first, then the texts that it is held against; gives whether each pair is linked.

    Only the leader's set and one other are held at a time.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, found = None, None, None
        for batch in batches:
            rows = []
            for a, salt, leads, node, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                here = (a.as_py(), salt.as_py())
                s = shingle_set((text.as_py() or "").encode(), words)
                if here != key:
                    key, found = here, None
                if _digest(s) != node.as_py():  # another text with this id and hash
                    continue
                if leads.as_py():
                    found, lead = s, here[0]
                elif found is not None:
                    both = len(np.intersect1d(found, s, assume_unique=True))
                    either = len(found) + len(s) - both
                    rows.append((lead, node.as_py(), 100 * both >= percent * either))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct ``words``-word shingles (the
    whole sequence if it has fewer words). Documents with 100 * intersection >= percent * union are linked; component_id
    is the least id reachable, and the document that has it is kept.

    1. One pass makes each document's set, its size, a digest and SuperMinHash band keys. Documents with equal
       digests are one node from here on, so copies cost one row each.
    2. Nodes with a band key in common are candidates if their signatures agree in LEAST_EQUAL values. In each bucket all
       nodes are held against its leader, the node of most copies, by their full sets, each first against the least of its
       leaders. Links are contracted by union-find, and leaders in other components are next.
    3. In buckets that still hold several components, shingles that no other node there has are counted. A node with too many of
       them can have no link and leaves. The others meet by their differences from a pivot, see ``_by_differences``.
    4. The links' components give the ids.

    Sets are compared by 64-bit hashes of shingles. Of pairs at similarity 0.8, 2e-5 share no band and 1e-6 have signatures
    that agree too little. Defined results: null and blank texts have size 0, are linked with nothing and kept; a null id is never a component_id where another is
    reachable, and a row of null id is kept only if its component_id is null; rows with one id are that many
    documents; very long texts are taken whole, one set at a time; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    found, _ = _grouped(docs, words, percent, id_col, text_col)
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n, node, component, best) for each row, and (node, first, copies). ``best`` is the group's (id is null, id, text_hash, node)
    that comes first; it and ``component``, its id, are null for rows that are linked with nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    signed = checkpoint(rows.mapInArrow(_signatures(words), "id long, text_hash long, n long, node binary, bands array<bigint>, sketch array<bigint>"))
    nodes = checkpoint(
        signed.where(F.col("node").isNotNull()).groupBy("node")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"), F.count("*").alias("copies"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n").alias("n"),
        )
    )
    member = nodes.select("node", F.explode("bands").alias("bucket"), F.struct(-F.col("copies"), "node").alias("order"))
    leaders = member.groupBy("bucket").agg(F.min("order").alias("first"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("first.node").alias("leader"))
    star = checkpoint(member.join(leaders, "bucket").select("bucket", "leader", "node"))  # only buckets of two or more
    sketch_a, sketch_b = (nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    enough = unequal(F.col("sketch_a"), F.col("sketch_b")) <= SIZE - LEAST_EQUAL
    pairs = star.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    candidates = checkpoint(pairs.join(sketch_b, "b").join(sketch_a, "a").where(enough).select("a", "b"), free=True)

    # The texts of nodes that share a bucket are read again, once; id and hash name the row, so that rows without id, or of one id, meet no others.
    folder = f"{shared_folder(spark)}/minhash-{uuid.uuid4().hex}"
    wanted = star.select("node").distinct().join(nodes.select("node", "first.id", F.col("first.text_hash").alias("h")), "node").withColumnRenamed("id", "first_id")
    wanted.join(rows, (F.col("h") == F.col("text_hash")) & F.col("first_id").eqNullSafe(F.col("id"))).select("node", "text").write.parquet(folder)
    texts = spark.read.schema("node binary, text string").parquet(folder)

    def verify(pairs: DataFrame) -> DataFrame:
        """Full comparisons; a leader's pairs are dealt into runs, each of which gets the leader's text. However many pairs one
        leader has, a run has RUN_ROWS or fewer on average."""
        runs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(max(1, -(-pairs.count() // RUN_ROWS)))).alias("salt"))
        lead = runs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node")).dropDuplicates(["a", "salt"])
        other = runs.join(texts, F.col("b") == F.col("node"))
        both = lead.select("a", "salt", F.lit(True).alias("leads"), "node", "text").union(other.select("a", "salt", F.lit(False).alias("leads"), "node", "text"))
        dealt = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("leads").desc(), "node")
        return checkpoint(dealt.mapInArrow(_verify(words, percent), "a binary, b binary, linked boolean").distinct(), free=True)

    done = verify(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    roots = components(done.where("linked"))
    rest = checkpoint(_crossing(candidates.join(done.select("a", "b"), ["a", "b"], "left_anti"), roots))
    if not rest.isEmpty():
        done = done.union(verify(rest))
        roots = components(done.where("linked"))
    # Buckets of several components: who can still be linked, and with whom.
    held = _mixed(star, roots)
    if not held.isEmpty():
        open_nodes = _open_nodes(held, nodes, texts, words, percent)
        held = _mixed(held.drop("root").join(open_nodes.select("node"), "node", "left_semi"), roots)
    if not held.isEmpty():
        done, roots = _by_differences(held, open_nodes, texts, done, roots, words, percent, verify)
    remove(spark, folder)

    # Each root's least id, and each copy's. Nodes of so many copies that there can be but HOT of them are met by a broadcast; the others are
    # small groups. Rows that are linked with nothing, or met already, are dealt by their hash.
    order = F.struct("first.none", "first.id", "first.text_hash", "node")
    placed = nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min(order).alias("best"), F.sum("copies").alias("size")).where("size > 1")
    grouped = checkpoint(placed.join(least, "root").select("node", "best", "copies"))
    many = F.col("copies") * HOT > signed.count()
    hot = grouped.where(many).select(F.col("node").alias("hot_node"), F.col("best").alias("hot_best"))
    rest = grouped.where(~many).select(F.col("node").alias("key"), F.col("best").alias("rest_best"))
    met = signed.select("id", "text_hash", "n", "node").join(F.broadcast(hot), F.col("node") == F.col("hot_node"), "left")  # fewer than HOT rows
    loose = F.xxhash64("id", "text_hash").cast("string").cast("binary")
    met = met.withColumn("key", F.when(F.col("hot_node").isNotNull() | F.col("node").isNull(), loose).otherwise(F.col("node")))
    found = met.join(rest, "key", "left").withColumn("best", F.coalesce("hot_best", "rest_best"))
    return found.select("id", "text_hash", "n", "node", F.col("best.id").alias("component"), "best"), nodes.select("node", "copies")


#: A node is hot if it has more than one in HOT of all rows.
HOT = 256


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).select("a", "b")


def _mixed(star: DataFrame, roots: DataFrame, group: str = "bucket") -> DataFrame:
    """The rows of the buckets that hold nodes of several components, with ``root``."""
    placed = star.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")).select(*star.columns, "root")
    mixed = placed.groupBy(group).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(group)
    return checkpoint(placed.join(mixed, group, "left_semi"))


def _explode(words: int):
    """(name, node, text) to (name, h) for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set((text.as_py() or "").encode(), words)
                if _digest(s) == node:
                    hashes.append(s.view(np.int64))
                    names.append(np.full(len(s), name, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(hashes))], ["name", "h"])

    return run


def _open_nodes(held: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n) of the nodes of mixed buckets that can have a link there: of its n shingles, enough are in another of these nodes."""
    some = checkpoint(held.select("node").distinct().join(nodes.select("node", "n"), "node").withColumn("key", F.xxhash64("node")))
    shingles = some.select("node", "key").join(texts, "node").dropDuplicates(["node"]).select("key", "node", "text").mapInArrow(_explode(words), "key long, h long")
    single = shingles.groupBy("h").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1").groupBy("key").agg(F.count("*").alias("alone"))
    counted = some.join(single, "key", "left").select("node", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    return checkpoint(counted.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).select("node", "n"), free=True)


def _differences(words: int):
    """(region, node, d, only) of (region, node, pivot, text): the size of the set's symmetric difference from the pivot, and its elements."""
    schema = pa.schema([("region", pa.int64()), ("node", pa.binary()), ("d", pa.int64()), ("only", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for region, node, pivot, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                s = shingle_set((text.as_py() or "").encode(), words)
                if _digest(s) == node.as_py():
                    only = np.setxor1d(s.view(np.int64), np.asarray(pivot.values, np.int64))
                    rows.append((region.as_py(), node.as_py(), len(only), only))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def _keys(known: DataFrame, scale: int) -> DataFrame:
    """The elements by which nodes meet, a row each at most, with ``most``: what s(x) + s(y) can be if this is the first element in common."""
    bound = F.when(F.col("outside"), F.col("all")).otherwise(F.col("others"))
    length = F.least(F.size("e"), F.size("e") + 1 - F.ceil((F.col("s") + bound) / F.lit(2 * scale))).cast("int")
    given = known.where(length > 0).select("region", "node", "root", "s", "outside", F.size("e").alias("size"), F.posexplode(F.slice("e", F.lit(1), length)).alias("at", "h"))
    return given.withColumn("most", F.lit(2 * scale) * (F.col("size") - F.col("at")))


def _by_differences(
    held: DataFrame, open_nodes: DataFrame, texts: DataFrame, done: DataFrame, roots: DataFrame, words: int, percent: int, verify: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """The pairs compared and the components, with all links between nodes of a bucket found.

    A bucket belongs to the region of its leader's component. A region's pivot P is the set of shingles that over half of its nodes have, D(x) the
    symmetric difference of x and P, d its size. Similarity of percent or more is |x ^ y| <= r (n(x) + n(y)) with r = (100 - percent) / (100 + percent), and
    x ^ y = D(x) ^ D(y). With s = d - r n, sets are linked if and only if D(x) and D(y) have (s(x) + s(y)) / 2 or more elements in common.

    First, all x with s(x) + s(c) <= 0 are linked with c, the node of least s: |x ^ c| <= d(x) + d(c). Two nodes with s(x) + s(y) <= 0 have both been linked
    with c so, hence any other link needs an element in common. Second, elements of D that no other node of the region has leave, the others
    are ordered from rare to common. If the first element in common is at the i-th place of D(x) from 0, no more than |D(x)| - i are in common, likewise of D(y), so
    a coincidence counts if (s(x) + s(y)) / 2 is within both. Each node gives every element once, as far as the least s of its partners lets one count, and
    none if that is more than it has; nodes of the region's largest component have only those outside of it as partners, and one of each pair is outside.
    What almost all of a group's nodes have is in P and is no key; what few of them have makes few pairs. Spark splits a key that is common after all.
    """
    spark = held.sparkSession
    lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead_root"))
    region = F.xxhash64(F.coalesce("lead_root", "leader")).alias("region")
    inside = held.join(lead, "leader", "left").select(region, "node").distinct()
    inside = _mixed(inside, roots, "region")
    every = inside.groupBy("node").agg(F.collect_set("region").alias("regions"))  # a node has BANDS buckets
    placed = every.join(texts, "node").dropDuplicates(["node"]).select(F.explode("regions").alias("region"), "node", "text")
    shingles = placed.mapInArrow(_explode(words), "region long, h long")
    sizes = inside.groupBy("region").agg(F.count("*").alias("size"))
    common = shingles.groupBy("region", "h").agg(F.count("*").alias("c")).where("c > 1").join(F.broadcast(sizes) if sizes.count() < SMALL else sizes, "region").where("2 * c > size")
    pivots = common.groupBy("region").agg(F.collect_list("h").alias("pivot"))  # under twice the mean set
    wide = placed.join(pivots, "region", "left").select("region", "node", F.coalesce("pivot", F.array().cast("array<bigint>")).alias("pivot"), "text")
    scale = 100 + percent
    s = (scale * F.col("d") - (100 - percent) * F.col("n")).alias("s")  # scaled to whole numbers
    apart = checkpoint(wide.mapInArrow(_differences(words), "region long, node binary, d long, only array<bigint>").join(open_nodes, "node").select("region", "node", s, "only"), free=True)

    # The node nearest to the pivot.
    centre = apart.groupBy("region").agg(F.min(F.struct("s", "node")).alias("c")).select("region", F.col("c.node").alias("a"), F.col("c.s").alias("least"))
    near = apart.join(centre, "region").where("s + least <= 0 and node <> a").select("a", F.col("node").alias("b")).distinct()
    near = checkpoint(_crossing(near, roots).join(done.select("a", "b"), ["a", "b"], "left_anti"))
    if not near.isEmpty():
        done = done.union(verify(near))
        roots = components(done.where("linked"))
    inside = _mixed(apart.select("region", "node"), roots, "region")
    if inside.isEmpty():
        return done, roots

    # Elements in order of rarity, those of one node left out.
    here = apart.join(inside.select("region", "node", "root"), ["region", "node"])
    listed = here.select("region", "node", F.explode("only").alias("h"))
    counts = listed.groupBy("region", "h").agg(F.count("*").alias("c")).where("c > 1")
    ordered = listed.join(counts, ["region", "h"]).groupBy("region", "node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("e"))
    known = checkpoint(here.join(ordered, ["region", "node"]).select("region", "node", "root", "s", F.col("e.h").alias("e")))
    # Of each region, its largest component, and the least s of all nodes and of those outside of that component.
    by_root = known.groupBy("region", "root").agg(F.count("*").alias("size"), F.min("s").alias("s"))
    largest = by_root.groupBy("region").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    outside = F.col("root") != F.col("largest")
    least = by_root.join(largest, "region").groupBy("region", "largest").agg(F.min("s").alias("all"), F.min(F.when(outside, F.col("s"))).alias("others"))
    known = known.join(F.broadcast(least) if sizes.count() < SMALL else least, "region").withColumn("outside", outside)
    given = _keys(known, scale)
    left, right = (given.select("region", "h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "s", "outside", "most")]) for x in "ab")
    left = left.where("outside_a")
    enough = F.col("s_a") + F.col("s_b") <= F.least("most_a", "most_b")
    once = ~F.col("outside_b") | (F.col("node_a") < F.col("node_b"))
    met = left.join(right, ["region", "h"]).where(enough & once & (F.col("root_a") != F.col("root_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    met = checkpoint(met, free=True)
    if not met.isEmpty():
        done = done.union(verify(met))
        roots = components(done.where("linked"))
    return done, roots


#: Regions of which one number each may be broadcast.
SMALL = 100_000


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which ``near_duplicates`` makes no group, and one row of each group: the one of least id, null ids last, ties by
    the text's hash. Rows are judged one by one: another row of the same id, or without id, is not dropped with them.

    Repeated rows are a group; null and blank texts are in none and stay. Columns are as they were.
    """
    found, nodes = _grouped(docs, words, percent, id_col, text_col)
    found = checkpoint(found.where(F.col("best").isNotNull()).select("id", "text_hash", "node", "best"))
    first = (F.col("best.node") == F.col("node")) & (F.col("best.text_hash") == F.col("text_hash")) & F.col("best.id").eqNullSafe(F.col("id"))
    names = {"id": "_gone_id", "text_hash": "_gone_hash"}
    gone = found.where(~first).select("id", "text_hash").distinct().withColumnsRenamed(names)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.col(text_col)) == F.col("_gone_hash"))
    kept = docs.join(gone, same, "left_anti")
    again = checkpoint(found.where(first).groupBy("id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select("id", "text_hash").withColumnsRenamed(names))
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumns({"_gone_id": F.col(id_col).cast("long"), "_gone_hash": F.xxhash64(F.col(text_col))})
    return kept.join(again, same, "left_anti").union(once.dropDuplicates(["_gone_id", "_gone_hash"]).select(*docs.columns))
