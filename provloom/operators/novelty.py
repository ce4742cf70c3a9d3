"""Order-aware prefix-count tries ("PPM trees"): observation, alarms, snapshots, algebra, two-phase and cross-host joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .running import ranges, running

WRITES = ("EVENT_WRITE", "EVENT_SENDTO", "EVENT_SENDMSG")
READS = ("EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG")
NETFLOWS = (*READS, *WRITES, "EVENT_CONNECT", "EVENT_ACCEPT")
EXECUTES_AND_DELETES = ("EVENT_EXECUTE", "EVENT_UNLINK")


def explode_prefixes(obs: DataFrame, tree: str, seq: list[str], key: str) -> DataFrame:
    """One row a level of each observation: level 0 is the root with an empty prefix, level j the first j keys."""
    levels = F.sequence(F.lit(0), F.size(key))
    rows = obs.select(F.col(tree).alias("tree"), *seq, F.col(key).alias("key"), F.explode(levels).alias("level"))
    return rows.withColumn("prefix", F.expr("slice(key, 1, level)"))


def observe(obs: DataFrame, tree: str = "tree", seq: tuple[str, ...] = ("seq",), key: str = "key") -> DataFrame:
    """Every level of every observation with its counters as they are right after it arrives.

    ``count``: observations so far with this prefix; ``first``: it is new; ``siblings``: distinct children of its parent so far,
    itself included; ``parent_count``: the level above. ``seq`` must be a total order in a tree. Counters are running sums by ranges of the order, so
    that a tree that holds all observations is dealt over as many tasks as there are ranges.
    """
    rows = explode_prefixes(ranges(obs, seq[0]), tree, [*seq, "_range"], key)
    counted = running(rows, ["tree", "level", "prefix"], list(seq), F.lit(1).cast("long"), "count").withColumn("first", (F.col("count") == 1) & (F.col("level") > 0))
    with_parent = counted.withColumn("parent", F.expr("slice(prefix, 1, greatest(level - 1, 0))"))
    sib = running(with_parent, ["tree", "level", "parent"], list(seq), F.col("first").cast("long"), "siblings")
    along = Window.partitionBy("tree", *seq).orderBy("level")
    return sib.withColumn("parent_count", F.lag("count").over(along)).drop("parent", "_range")


def question(siblings: Column, count: Column) -> Column:
    """The probability of something new: s / (s + n), 1 where n is 0."""
    return F.when(count == 0, F.lit(1.0)).otherwise(siblings.cast("double") / (siblings + count))


def alarms(levels: DataFrame, seq: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row an alarm: observations whose leaf is new, with local and global probability and the depth of the local one.

    The new-leaf value is set at the shallowest new level: at the root from the children before and the counter before, below
    it from both after. It is the leaf's local probability if the leaf's parent was seen once, else s / (s + n) of the leaf's parent.
    """
    at_root = question(F.col("siblings") - 1, F.col("parent_count") - 1)
    below = question(F.col("siblings"), F.col("parent_count"))
    new = F.when(F.col("first"), F.struct(F.col("level").alias("level"), F.when(F.col("level") == 1, at_root).otherwise(below).alias("p")))
    grouped = levels.withColumn("_new", new).groupBy("tree", *seq).agg(
        F.max(F.when(F.col("level") == F.size("key"), F.struct("count", "siblings", "parent_count", "key"))).alias("leaf"),
        F.min("_new").alias("new"),
        F.max(F.when(F.col("level") == 0, F.col("count"))).alias("root_count"),
    )
    found = grouped.where((F.col("leaf.count") == 1) & (F.size("leaf.key") > 0))
    local = F.when(F.col("leaf.parent_count") == 1, F.col("new.p")).otherwise(question(F.col("leaf.siblings"), F.col("leaf.parent_count")))
    return found.select(
        "tree", *seq, F.col("leaf.key").alias("key"), local.alias("local_prob"), (F.lit(1.0) / F.col("root_count")).alias("global_prob"),
        F.when(F.col("leaf.parent_count") == 1, F.col("new.level")).otherwise(F.size("leaf.key")).cast("int").alias("depth"),
    )


#: Observations below one first key that one task takes in order; a first key with more is dealt over ranges.
TOGETHER = 1_000_000


def observed_alarms(obs: DataFrame, seq: tuple[str, ...] = ("seq",), tree: str = "tree", key: str = "key", together: int = TOGETHER) -> DataFrame:
    """``alarms(observe(obs))`` in two shuffles of the observations, one row each: levels are columns, which are never made rows.

    All that lies below a first key meets in one task, where windows over ever shorter prefixes count. A first key with more than ``together`` observations
    is counted by ranges instead. Then rows are dealt by ranges of the order for the root's counters, whose sums before a range are one row a range and tree.
    """
    cols = ["tree", *seq, "key", "_range"]
    rows = ranges(obs.select(F.col(tree).alias("tree"), *seq, F.col(key).alias("key")), seq[0])
    tops = checkpoint(rows.groupBy("tree", F.slice("key", 1, 1).alias("_top")).agg(F.count("*").alias("n"), F.min("_range").alias("_range"), F.max(F.size("key")).alias("depth")))
    depth = tops.agg(F.max("depth")).head()[0] or 0
    prefix = lambda j: F.slice("key", 1, j)
    size = F.size("key")

    def counted(part: DataFrame, summed) -> DataFrame:  # noqa: ANN001
        for j in range(depth, 0, -1):
            part = summed(part.withColumn("_p", prefix(j)), F.lit(1).cast("long"), f"_c{j}")
            if j < depth:  # children of this prefix so far
                part = summed(part, ((F.col(f"_c{j + 1}") == 1) & (size > j)).cast("long"), f"_s{j + 1}")
        return part.drop("_p")

    inside = lambda by: Window.partitionBy(*by).orderBy(*seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_task = lambda part, value, name: part.withColumn(name, F.sum(value).over(inside(["tree", "_top", "_p"])))
    by_ranges = lambda part, value, name: running(part, ["tree", "_p"], list(seq), value, name)
    topped = rows.select(*cols, prefix(1).alias("_top"))
    large = tops.where((F.col("n") > together) & (F.size("_top") > 0)).select("tree", "_top")
    if large.isEmpty():
        levels = counted(topped.repartition("tree", "_top"), in_task).drop("_top")
    else:  # at most one in ``together`` observations
        small = topped.join(F.broadcast(large), ["tree", "_top"], "left_anti").select(*topped.columns)
        hot = topped.join(F.broadcast(large), ["tree", "_top"], "left_semi").select(*cols)
        levels = counted(small.repartition("tree", "_top"), in_task).drop("_top").unionByName(counted(hot, by_ranges))

    def at(level: Column, value, least: int, kind: str) -> Column:  # noqa: ANN001
        return F.coalesce(*[F.when(level == j, value(j)) for j in range(least, depth + 1)], F.lit(None).cast(kind))

    new = F.coalesce(*[F.when((size >= j) & (F.col(f"_c{j}") == 1), j) for j in range(1, depth + 1)], F.lit(None).cast("int"))
    flat = levels.withColumn("_new", new).select(
        "tree", *seq, "_range", size.alias("_size"), "_new", F.coalesce(F.col("_new") == 1, F.lit(False)).cast("long").alias("_one"),
        F.when(at(size, lambda j: F.col(f"_c{j}"), 1, "long") == 1, F.col("key")).alias("key"),
        at(F.col("_new"), lambda j: question(F.col(f"_s{j}"), F.col(f"_c{j - 1}")), 2, "double").alias("_below"),
        at(size, lambda j: F.col(f"_c{j - 1}"), 2, "long").alias("_parent"), at(size, lambda j: F.col(f"_s{j}"), 2, "long").alias("_siblings"),
    )
    totals = rows.groupBy("tree", "_range").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("tops"))
    totals = totals.union(tops.where(F.size("_top") > 0).groupBy("tree", "_range").agg(F.lit(0).cast("long"), F.count("*"))).groupBy("tree", "_range").agg(F.sum("n").alias("n"), F.sum("tops").alias("tops"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("tree", "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "tops")])
    along = inside(["tree", "_range"])
    placed = flat.join(offsets, ["tree", "_range"]).withColumns({"_root": F.col("_n") + F.count("*").over(along), "_kids": F.col("_tops") + F.sum("_one").over(along)})
    parent, siblings = F.coalesce("_parent", "_root"), F.coalesce("_siblings", "_kids")
    at_new = F.when(F.col("_new") == 1, question(F.col("_kids") - 1, F.col("_root") - 1)).otherwise(F.col("_below"))
    return placed.where(F.col("key").isNotNull()).select(
        "tree", *seq, "key", F.when(parent == 1, at_new).otherwise(question(siblings, parent)).alias("local_prob"), (F.lit(1.0) / F.col("_root")).alias("global_prob"),
        F.when(parent == 1, F.col("_new")).otherwise(F.col("_size")).cast("int").alias("depth"),
    )


def until_last_alarm(rows: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """Rows up to the last one that is the first of its key ``by``; no later one is an alarm or counts for one. Right where few keys have many rows: the
    least place of each key is found in the tasks that make the rows, and the bound, one number, can be moved to where the rows come from."""
    last = rows.groupBy(*by).agg(F.min(seq).alias("_first")).agg(F.max("_first")).head()[0]
    return rows.where(F.col(seq) <= F.lit(last)) if last is not None else rows


def snapshot(obs: DataFrame, tree: str = "tree", key: str = "key") -> DataFrame:
    """The tree after all observations, one row a node: count, children, local and global probability; order plays no part."""
    counts = explode_prefixes(obs, tree, [], key).groupBy("tree", "prefix", "level").agg(F.count("*").alias("count"))
    parents = counts.withColumn("parent", F.expr("slice(prefix, 1, greatest(level - 1, 0))"))
    up = counts.select("tree", F.col("prefix").alias("parent"), F.col("count").alias("parent_count"))
    children = parents.where("level > 0").groupBy("tree", "parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "prefix")
    root = counts.where("level = 0").select("tree", F.col("count").alias("root_count"))
    return (
        parents.join(up, ["tree", "parent"]).join(root, "tree").join(children, ["tree", "prefix"], "left")
        .select(
            "tree", "prefix", "level", "count", F.coalesce("children", F.lit(0).cast("long")).alias("children"),
            F.when(F.col("level") == 0, F.lit(1.0)).otherwise(F.col("count") / F.col("parent_count")).alias("local_prob"),
            (F.col("count") / F.col("root_count")).alias("global_prob"),
        )
    )


def question_nodes(tree: DataFrame) -> DataFrame:
    """The snapshot's "_?_" nodes, one below each inner node: children / count, which isn't the alarm's value."""
    return tree.where("children > 0").select(
        "tree", F.concat("prefix", F.array(F.lit("_?_"))).alias("prefix"), (F.col("level") + 1).alias("level"), F.col("children").alias("count"),
        (F.col("children") / F.col("count")).alias("local_prob"), (F.col("children") / F.col("count") * F.col("global_prob")).alias("global_prob"),
    )


# Tree algebra on snapshots


def leaves(tree: DataFrame) -> DataFrame:
    return tree.where("children = 0")


def truncate(tree: DataFrame, depth: int) -> DataFrame:
    """Nodes down to a depth; those at it are leaves."""
    return tree.where(F.col("level") <= depth).withColumn("children", F.when(F.col("level") == depth, F.lit(0)).otherwise(F.col("children")).cast("long"))


def subtree(tree: DataFrame, path: list[str]) -> DataFrame:
    return tree.where(F.expr(f"slice(prefix, 1, {len(path)})") == F.array(*map(F.lit, path)) if path else F.lit(True))


def merge(one: DataFrame, other: DataFrame, name: str = "merged") -> DataFrame:
    """Counts of both trees added up, probabilities renewed."""
    both = one.unionByName(other).groupBy("prefix", "level").agg(F.sum("count").alias("count")).withColumn("tree", F.lit(name))
    kids = both.where("level > 0").groupBy(F.expr("slice(prefix, 1, level - 1)").alias("prefix")).agg(F.count("*").alias("children"), F.sum("count").alias("below"))
    up = both.select(F.col("prefix").alias("up"), F.col("count").alias("parent_count"))
    root = both.where("level = 0").select(F.col("tree"), F.col("count").alias("root_count"))
    return both.withColumn("up", F.expr("slice(prefix, 1, greatest(level - 1, 0))")).join(up, "up").join(root, "tree").join(kids, "prefix", "left").select(
        "tree", "prefix", "level", "count", F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        F.when(F.col("level") == 0, F.lit(1.0)).otherwise(F.col("count") / F.col("parent_count")).alias("local_prob"), (F.col("count") / F.col("root_count")).alias("global_prob"),
    )


def under(tree: DataFrame, top: str, name: str) -> DataFrame:
    """The tree hung below one more key, as when trees of several hosts are put side by side."""
    return tree.withColumn("prefix", F.concat(F.array(F.lit(top)), "prefix")).withColumns({"level": F.col("level") + 1, "tree": F.lit(name)})


def renormalize(tree: DataFrame) -> DataFrame:
    """Global probabilities as shares of the root's own."""
    root = tree.where("level = 0").select("tree", F.col("global_prob").alias("_root"))
    return tree.join(root, "tree").withColumn("global_prob", F.col("global_prob") / F.col("_root")).drop("_root")


def collapse_unary(tree: DataFrame, joint: str = " ∫ ") -> DataFrame:
    """Chains of only children become one node with the keys joined: a node goes on to its parent if that has no other child."""
    kids = tree.select("tree", F.col("prefix").alias("at"), F.col("children").alias("kids"))
    steps = tree.withColumn("d", F.explode(F.sequence(F.lit(1), F.greatest(F.col("level"), F.lit(1))))).where("level > 0")
    steps = steps.withColumn("at", F.expr("slice(prefix, 1, d - 1)")).join(kids, ["tree", "at"])
    whole = steps.groupBy("tree", "prefix", "level", "count", "children", "local_prob", "global_prob").agg(F.array_sort(F.collect_list(F.struct("d", F.element_at("prefix", F.col("d")).alias("k"), "kids"))).alias("s"))
    start = F.array().cast("array<string>")
    step = lambda a, x: F.when((x["kids"] == 1) & (x["d"] > 1), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(joint), x["k"])))).otherwise(F.concat(a, F.array(x["k"])))
    return whole.where("children <> 1").select("tree", F.aggregate("s", start, step).alias("path"), "count", "children", "global_prob")


def most_novel(tree: DataFrame, k: int) -> DataFrame:
    """The k leaves of least local probability; ties by path."""
    return leaves(tree).orderBy("local_prob", F.array_join("prefix", "|")).limit(k)


def below_probability(tree: DataFrame, column: str, threshold: float) -> DataFrame:
    """Leaves whose local or global probability is below a threshold."""
    return leaves(tree).where(F.col(column) < threshold)


def to_preorder(tree: DataFrame, joint: str = "∫") -> DataFrame:
    """The saved form: depth, key, probabilities and count, with the order of a walk that visits parents first."""
    return tree.select(
        F.array_join("prefix", joint).alias("path"), "level", F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit("")).alias("key"), "local_prob", "global_prob", "count"
    ).orderBy("path")


#: Classes of event types for summaries; fixed values, in the order of the schema's types.
EVENT_CLASSES = {
    "ReadEvents": ("EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG"),
    "WriteEvents": ("EVENT_WRITE", "EVENT_SENDTO", "EVENT_SENDMSG", "EVENT_TRUNCATE"),
    "ProcessTreeEvents": ("EVENT_FORK", "EVENT_MODIFY_PROCESS", "EVENT_EXIT", "EVENT_CLONE", "EVENT_CREATE_THREAD", "EVENT_STARTSERVICE"),
    "ExecutionEvents": ("EVENT_EXECUTE", "EVENT_LOADLIBRARY"),
    "MemoryMap": ("EVENT_MMAP",),
    "Unlink": ("EVENT_UNLINK",),
    "AddObjectAttribute": ("EVENT_ADD_OBJECT_ATTRIBUTE",),
    "CreateObject": ("EVENT_CREATE_OBJECT",),
    "FlowsTo": ("EVENT_FLOWS_TO",),
    "Update": ("EVENT_UPDATE",),
    "FileSystemEvents": ("EVENT_MOUNT", "EVENT_UMOUNT", "EVENT_CHECK_FILE_ATTRIBUTES", "EVENT_MODIFY_FILE_ATTRIBUTES", "EVENT_RENAME", "EVENT_OPEN", "EVENT_CLOSE", "EVENT_LINK", "EVENT_FCNTL", "EVENT_DUP"),
    "NetworkManagementEvents": ("EVENT_ACCEPT", "EVENT_CONNECT", "EVENT_BIND", "EVENT_READ_SOCKET_PARAMS", "EVENT_WRITE_SOCKET_PARAMS"),
    "SystemManagementEvents": ("EVENT_BOOT", "EVENT_MPROTECT", "EVENT_SHM", "EVENT_LOGCLEAR", "EVENT_SERVICEINSTALL"),
    "UserEvents": ("EVENT_CHANGE_PRINCIPAL", "EVENT_LOGIN", "EVENT_LOGOUT"),
    "NonspecificEvents": ("EVENT_BLIND", "EVENT_OTHER"),
}


def event_class(kind: Column) -> Column:
    """The class of an event type; null for what is none."""
    table = F.create_map(*[F.lit(x) for name, kinds in EVENT_CLASSES.items() for k in kinds for x in (k, name)])
    return F.try_element_at(table, kind)


def from_leaves(rows: DataFrame) -> DataFrame:
    """A snapshot (see ``snapshot``) of weighted leaves (tree, key, count)."""
    counts = rows.select("tree", "count", "key", F.explode(F.sequence(F.lit(0), F.size("key"))).alias("level")).withColumn("prefix", F.expr("slice(key, 1, level)"))
    counts = counts.groupBy("tree", "prefix", "level").agg(F.sum("count").alias("count"))
    up = counts.select("tree", F.col("prefix").alias("parent"), F.col("count").alias("parent_count"))
    parents = counts.withColumn("parent", F.expr("slice(prefix, 1, greatest(level - 1, 0))"))
    children = parents.where("level > 0").groupBy("tree", F.col("parent").alias("prefix")).agg(F.count("*").alias("children"))
    root = counts.where("level = 0").select("tree", F.col("count").alias("root_count"))
    return parents.join(up, ["tree", "parent"]).join(root, "tree").join(children, ["tree", "prefix"], "left").select(
        "tree", "prefix", "level", "count", F.coalesce("children", F.lit(0).cast("long")).alias("children"),
        F.when(F.col("level") == 0, F.lit(1.0)).otherwise(F.col("count") / F.col("parent_count")).alias("local_prob"), (F.col("count") / F.col("root_count")).alias("global_prob"),
    )


def summarize(tree: DataFrame, most: int = 5, joint: str = " ∫ ") -> DataFrame:
    """(tree, path, count, share): a snapshot's leaves in fewer words. "_?_" nodes are left out, event types stand for their classes, chains of only children
    are one node, leaves of one parent with equal counts are one node, chains are joined again, and shares are of what is left."""
    rows = leaves(tree).where(~F.array_contains("prefix", "_?_") & (F.col("level") > 0))
    classed = rows.select("tree", F.transform("prefix", lambda k: F.coalesce(event_class(k), k)).alias("key"), "count").groupBy("tree", "key").agg(F.sum("count").alias("count"))
    short = collapse_unary(checkpoint(from_leaves(checkpoint(classed))), joint).where("children = 0").select("tree", F.col("path").alias("key"), "count")
    parent = F.expr("slice(key, 1, size(key) - 1)")
    alike = short.groupBy("tree", parent.alias("parent"), "count").agg(F.array_sort(F.collect_list(F.element_at("key", -1))).alias("keys"))
    name = F.when(F.size("keys") <= most, F.array_join("keys", ", ")).otherwise(F.concat(F.size("keys").cast("string"), F.lit(" items like "), F.get("keys", F.lit(0))))
    merged = alike.select("tree", F.concat("parent", F.array(name)).alias("key"), (F.col("count") * F.size("keys")).alias("count"))
    last = checkpoint(collapse_unary(checkpoint(from_leaves(checkpoint(merged))), joint).where("children = 0"))  # each is used several times
    total = last.groupBy("tree").agg(F.sum("count").alias("total"))
    return last.join(total, "tree").select("tree", "path", "count", (F.col("count") / F.col("total")).alias("share"))


def summarizable(tree: DataFrame) -> DataFrame:
    """The processes that can be summarised: the nodes of the first level."""
    return truncate(tree, 1).where("level = 1")


def novel_actions(tree: DataFrame, path: list[str], k: int) -> DataFrame:
    """The k least expected leaves below a process, as text."""
    found = leaves(subtree(tree, path)).orderBy("local_prob", F.array_join("prefix", "|")).limit(k)
    return found.select(F.array_join(F.expr(f"slice(prefix, {len(path) + 1}, size(prefix))"), " ").alias("action"), "local_prob")


def alarm_tree(alarm_rows: DataFrame) -> DataFrame:
    """Alarms as a tree to look through: for each key prefix how many alarms are below and the least local probability among them."""
    rows = alarm_rows.select("tree", "local_prob", F.explode(F.transform(F.sequence(F.lit(1), F.size("key")), lambda i: F.slice("key", 1, i))).alias("prefix"))
    return rows.groupBy("tree", "prefix").agg(F.count("*").alias("alarms"), F.min("local_prob").alias("least"))


def merge_equal_siblings(tree: DataFrame, most: int = 5) -> DataFrame:
    """Leaves of one parent with equal counts as one row: up to ``most`` keys listed, more as "N items like" the least."""
    rows = leaves(tree).where("level > 0").withColumn("parent", F.expr("slice(prefix, 1, level - 1)"))
    grouped = rows.groupBy("tree", "parent", "count").agg(F.array_sort(F.collect_list(F.element_at("prefix", -1))).alias("keys"))
    named = F.when(F.size("keys") <= most, F.array_join("keys", ", ")).otherwise(F.concat(F.size("keys").cast("string"), F.lit(" items like "), F.col("keys")[0]))
    return grouped.select("tree", "parent", "count", named.alias("keys"), (F.col("count") * F.size("keys")).alias("total"))


# Joins over observations


def first_then_later(rows: DataFrame, first: Column, later: Column, key: str, seq: tuple[str, ...], first_cols: list[str], later_cols: list[str]) -> DataFrame:
    """The earliest row of each key that passes ``first``, joined to every later row of the key that passes ``later``.

    The first is never renewed; columns get the prefixes first_ and later_. Ties can't occur in a total order.
    """
    ordered = rows.where(F.col(key).isNotNull()).withColumn("_seq", F.struct(*seq))
    cols = list(dict.fromkeys([*first_cols, *seq]))
    opening = ordered.where(first).groupBy(key).agg(F.min("_seq").alias("_at"), F.min_by(F.struct(*cols), "_seq").alias("_f"))
    closing = ordered.where(later)
    return opening.join(closing, key).where(F.col("_seq") > F.col("_at")).select(
        key, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in first_cols], *[F.col(c).alias(f"later_{c}") for c in later_cols]
    )


def cross_host(flows: DataFrame, here: list[str], there: list[str], host: str, seq: str, carry: list[str]) -> DataFrame:
    """Flows of different hosts whose ends are each other's, both ways; emitted when the later one is seen."""
    a = flows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*here, *there])], F.col(host).alias("host"), F.col(seq).alias("seq"), *carry)
    b = flows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*there, *here])], F.col(host).alias("other_host"), F.col(seq).alias("other_seq"), *[F.col(c).alias(f"other_{c}") for c in carry])
    keys = [f"_{i}" for i in range(len(here) + len(there))]
    return a.join(b, keys).where("host <> other_host and seq > other_seq").select("host", "other_host", F.col("seq").alias("emitted"), "other_seq", *carry, *[f"other_{c}" for c in carry])


def directory_keys(path: Column) -> Column:
    """The directories of a path, the leading separator first, the last part left out: /a/b/c gives /, a, b."""
    parts = F.split(path, "/")
    inner = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: x != "")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.array(F.lit("/")), inner)).otherwise(inner)


def thresholds(found: DataFrame, percents: tuple[float, ...]) -> DataFrame:
    """For each tree and percent, the greatest local probability below which no more than that share of alarms lie, else 1.

    Probabilities from 0.3 on are rounded to tenths before they are counted.
    """
    return histogram_thresholds(threshold_counts(found), percents)


def threshold_counts(found: DataFrame) -> DataFrame:
    """(tree, p, n): alarms by rounded probability, which is all that thresholds need; counts of parts add up."""
    p = F.when(F.col("local_prob") >= 0.3, F.round("local_prob", 1)).otherwise(F.col("local_prob"))
    return found.select("tree", p.alias("p")).groupBy("tree", "p").agg(F.count("*").alias("n"))


def histogram_thresholds(counts: DataFrame, percents: tuple[float, ...]) -> DataFrame:
    """The thresholds of (tree, p, n), by running sums over ranges of p."""
    total = counts.groupBy("tree").agg(F.sum("n").alias("total"))
    cumulated = running(ranges(counts, "p"), ["tree"], ["p"], F.col("n"), "upto").join(total, "tree")
    asked = cumulated.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    ok = F.when(F.col("upto") <= F.col("percent") / 100 * F.col("total"), F.col("p"))
    return asked.groupBy("tree", "percent").agg(F.coalesce(F.max(ok), F.lit(1.0)).alias("threshold"))


def alarm_page(found: DataFrame, path: list[str], seq: str, start: int, forward: bool, limit: int) -> DataFrame:
    """Alarms below a key path from a start on, in time order or against it."""
    rows = subtree(found.withColumnRenamed("key", "prefix"), path).withColumnRenamed("prefix", "key")
    rows = rows.where(F.col(seq) >= start if forward else F.col(seq) <= start)
    return rows.orderBy(F.col(seq).asc() if forward else F.col(seq).desc()).limit(limit)


def rate(alarm_rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Alarms with the latest rating of each namespace as a map; a rating of 0 unsets."""
    last = ratings.groupBy("key", "namespace").agg(F.max_by("rating", "seq").alias("rating")).where("rating <> 0")
    maps = last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("namespace", "rating")))).alias("ratings"))
    return alarm_rows.join(maps, "key", "left")


def flatten(rows: DataFrame, subjects: str, objects: str) -> DataFrame:
    """One observation for each pair of a subject's and an object's path; an empty or null set of paths counts as one null path."""
    one = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.array_sort(F.array_distinct(c))).otherwise(F.array(F.lit(None).cast("string")))
    kept = [c for c in rows.columns if c not in (subjects, objects)]
    first = rows.select(*kept, F.explode(one(subjects)).alias("subject_path"), one(objects).alias("_objects"))
    return first.select(*kept, "subject_path", F.explode("_objects").alias("object_path"))


def within_spans(alarm_rows: DataFrame, spans: DataFrame, nanos: str, width: int) -> DataFrame:
    """Alarms in one of the time spans (name, start, end) in nanoseconds, ends included, with its name. Spans are cut into buckets of
    ``width``, which are the join's key, so alarms meet only the spans of their bucket."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    return alarm_rows.withColumn("_b", F.expr(f"{nanos} div {width}")).join(cut, "_b").where((F.col(nanos) >= F.col("start")) & (F.col(nanos) <= F.col("end"))).drop("_b", "start", "end")


def batches(alarm_rows: DataFrame, by: str, nanos: str, width: int) -> DataFrame:
    """Alarm summaries of a reporting interval: for each group and tumbling interval, how many alarms, the least and mean local probability, and the first and last time."""
    rows = alarm_rows.withColumn("batch", F.expr(f"{nanos} - {nanos} % {width}"))
    return rows.groupBy(by, "batch").agg(
        F.count("*").alias("alarms"), F.min("local_prob").alias("least"), F.avg("local_prob").alias("mean"), F.min(nanos).alias("first"), F.max(nanos).alias("last")
    )


def quality_keys(records: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Observations of a data-quality tree: [kind, field, present or missing] for every field of every record."""
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.when(F.col(f).isNull(), "missing").otherwise("present").alias("p")) for f in fields])
    rows = records.withColumn("_f", F.explode(each))
    return rows.withColumn("key", F.array(kind, "_f.f", "_f.p")).drop("_f")


def option_text(path: Column, option: Column) -> Column:
    """A key with its option: the path, and the option in brackets where there is one."""
    return F.when(option.isNull() | (option == ""), path).otherwise(F.concat(path, F.lit("["), option, F.lit("]")))


def delayed(rows: DataFrame, nanos: str, key: str, delay: int, ident: str) -> DataFrame:
    """When each row leaves a hold of ``delay``: at the first row of its key that is that much later, else never (null), as when a stream ends before.

    ``released`` is that row's time. It is an as-of search: the asked times and the rows' own lie in one order, cut into ranges; inside a range the next row
    is a running minimum from its end, beyond it the least of the ranges after it. Work is that of sorting, also within one key. ``ident`` names the rows.
    """
    at = F.col(nanos).cast("long")
    own = rows.select(key, at.alias("_at"), at.alias("_t"), F.lit(None).cast(dict(rows.dtypes)[ident]).alias("_id"))
    asked = rows.select(key, (at + F.lit(delay)).alias("_at"), F.lit(None).cast("long").alias("_t"), F.col(ident).alias("_id"))
    placed = ranges(own.union(asked), "_at")
    heads = placed.groupBy(key, "_range").agg(F.min("_t").alias("_head"))
    later = Window.partitionBy(key).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(key, "_range", F.min("_head").over(later).alias("_later"))
    back = Window.partitionBy(key, "_range").orderBy(F.desc("_at"), F.desc_nulls_last("_t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("_next", F.min("_t").over(back)).where("_id is not null").join(heads, [key, "_range"])
    return rows.join(found.select(F.col("_id").alias(ident), F.coalesce("_next", "_later").alias("released")), ident, "left")


def delayed_by_records(rows: DataFrame, seq: str, records: int) -> DataFrame:
    """When each row leaves a hold of so many records: ``released`` is the order's value of the row that comes that many rows later, null if the stream ends before.

    Rows are numbered by running counts and meet on their numbers.
    """
    numbered = running(ranges(rows, seq).withColumn("_one", F.lit(1)), ["_one"], [seq], F.lit(1), "_n").drop("_one", "_range")
    ahead = numbered.select((F.col("_n") - records).alias("_n"), F.col(seq).alias("released"))
    return numbered.join(ahead, "_n", "left").drop("_n")


def join_observations(found: DataFrame, tree: str, seq: list[str], key: list[str]) -> DataFrame:
    """What a join emits as observations of a tree. ``seq`` must order its rows in full: the emitting row first, then whatever tells apart what it emits.

    Null key parts are the text "?", as an unknown path is.
    """
    parts = F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in key])
    return found.select(F.lit(tree).alias("tree"), *seq, parts.alias("key"))
