"""Compiles traversals to DataFrame plans.

A traverser is a row (origin, cur, path, binds): what it came from where a nested traversal is asked about an element,
the current vertex or edge id or scalar, the history as strings, and the values bound by ``as``. Hops are equi-joins
with the edge frame; filters by nested traversals are semi-joins on the distinct current elements; nothing is collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from ..operators.graph import PROPERTIES, Graph
from .parser import Name, Predicate, QuerySyntaxError, Script, Step, Traversal, parse

#: Steps whose outcome depends on more than the element that a traverser is at.
_REMEMBERING = {"as", "select", "where", "simplePath", "path", "unrollPath", "limit", "match", "aggregate", "order"}
_BINDS = "map<string,string>"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    kind: str  # V vertex, E edge, S scalar
    binds: tuple[tuple[str, str], ...] = ()  # name, kind
    types: tuple[tuple[str, str], ...] = ()  # name, type of a bound number or truth value
    nested: bool = False

    def to(self, df: DataFrame, kind: str | None = None) -> Frame:
        return replace(self, df=df, kind=kind or self.kind)


def _steps_of(t: object) -> tuple:
    """The steps of a traversal, of several, or none of what isn't one."""
    if isinstance(t, Traversal):
        return t.steps
    return tuple(s for x in t for s in _steps_of(x)) if isinstance(t, tuple) else ()


def _step_names(steps: list[Step]) -> list[str]:
    """The names of steps and of all steps of the traversals in them."""
    return [n for s in steps for n in (s.name, *_step_names(list(_steps_of(tuple(s.args)))))]


def _step_text(x: Column) -> Column:
    return F.array(x.cast("string"))


class Compiler:
    def __init__(self, graph: Graph) -> None:
        self.graph = graph
        self.names: dict[str, object] = {}

    # Statements

    def run(self, query: str | Script) -> DataFrame:
        """The result as one column ``result``: element ids, scalars, maps or lists."""
        return self.frame(query).df.select(F.col("cur").alias("result"))

    def frame(self, query: str | Script) -> Frame:
        script = parse(query) if isinstance(query, str) else query
        for name, value in script.statements:
            if isinstance(value, Traversal):
                found = self.walk(value.steps, None)
                if name is not None:
                    self.names[name] = found.to(checkpoint(found.df))  # run once; every use sees the same list
            else:
                self.names[name] = value
        return self.walk(script.result.steps, None)

    def literal(self, x: object) -> object:
        if isinstance(x, Name):
            if x.name not in self.names:
                raise QuerySyntaxError(f"no variable {x.name!r}")
            return self.names[x.name]
        return tuple(self.literal(y) for y in x) if isinstance(x, tuple) else x

    # Walking

    def walk(self, steps: tuple[Step, ...], frame: Frame | None) -> Frame:
        at = 0
        while at < len(steps):
            step, at = steps[at], at + 1
            mods: list[Step] = []
            if step.name in ("times", "until", "emit"):
                mods.append(Step("pre_" + step.name, step.args))
                while steps[at].name != "repeat":
                    mods.append(Step("pre_" + steps[at].name, steps[at].args))
                    at += 1
                step, at = steps[at], at + 1
            follow = {"repeat": ("times", "until", "emit"), "order": ("by",), "group": ("by",), "groupCount": ("by",), "path": ("by",), "choose": ("option",)}.get(step.name, ())
            while at < len(steps) and steps[at].name in follow:
                mods.append(steps[at])
                at += 1
            if step.name in ("V", "E"):
                fold = at
                while step.name == "V" and fold < len(steps) and steps[fold].name in ("has", "hasLabel", "hasId", "hasNot") and not any(isinstance(a, Traversal) for a in steps[fold].args):
                    fold += 1
                frame = self.source(step, steps[at:fold], frame)
                at = fold
            else:
                method = getattr(self, f"do_{step.name}", None)
                if method is None:
                    raise QuerySyntaxError(f"no step {step.name!r}")
                frame = method(frame, step.args, mods)
        assert frame is not None
        return frame

    def source(self, step: Step, filters: tuple[Step, ...], frame: Frame | None) -> Frame:
        """All vertices or edges, or those of given ids; filters by literals that follow are applied to the scan."""
        df = self.graph.vertices if step.name == "V" else self.graph.edges
        ids = [y for x in map(self.literal, step.args) for y in (x if isinstance(x, tuple) else [x])]
        frames = [x for x in ids if isinstance(x, Frame)]
        if frames:
            df = df.join(frames[0].df.select(F.col("cur").alias("id")).distinct(), "id", "left_semi")
        elif ids:
            df = df.where(F.col("id").isin(ids))
        for f in filters:
            df = df.where(self.condition(f))
        return Frame(
            df.select(F.lit("").alias("origin"), F.col("id").alias("cur"), _step_text(F.col("id")).alias("path"), F.create_map().cast(_BINDS).alias("binds")), step.name
        )

    def keys(self) -> list[str]:
        """The properties, those that a traversal has added last."""
        return [*PROPERTIES, *(c for c in self.graph.vertices.columns if c not in (*PROPERTIES, "id", "label"))]

    def condition(self, step: Step) -> Column:
        """A vertex filter on the property columns."""
        args = tuple(self.literal(a) for a in step.args)
        if step.name == "hasLabel":
            return F.col("label") == args[0]
        if step.name == "hasId":
            return F.col("id") == args[0]
        column = F.col(args[0]) if args[0] in self.graph.vertices.columns else F.lit(None).cast("string")
        if step.name == "hasNot":
            return column.isNull()
        if len(args) == 1:
            return column.isNotNull()
        if args[0] == "uuid" and isinstance(args[1], str) and re.fullmatch(r"[0-9a-fA-F-]{36}", args[1]):
            return F.right(column, F.lit(36)) == args[1].lower()  # a bare uuid stands for that of every namespace
        return self.test(column, args[1], dict(self.graph.vertices.dtypes).get(args[0], "string"))

    def test(self, x: Column, arg: object, type_: str) -> Column:
        """Equality with a literal of the same type, or a predicate; a literal of another type equals nothing."""
        same = lambda v: isinstance(v, str) == (type_ == "string")
        if not isinstance(arg, Predicate):
            return x == arg if same(arg) else F.lit(False)
        args = [self.literal(a) for a in arg.args]
        if arg.op == "within":
            flat = [y for a in args for y in (a if isinstance(a, tuple) else [a])]
            return x.isin([v for v in flat if same(v)])
        if arg.op == "regex":
            return x.rlike(rf"\A(?:{args[0]})\z")
        if not all(map(same, args)):
            return F.lit(arg.op == "neq") & x.isNotNull()
        return {
            "eq": lambda: x == args[0], "neq": lambda: x != args[0], "lte": lambda: x <= args[0],
            "gte": lambda: x >= args[0], "between": lambda: (x >= args[0]) & (x < args[1]),
        }[arg.op]()

    # Nested traversals

    def nested(self, frame: Frame, t: Traversal) -> Frame:
        """The traversal's results from each distinct current element, which is in ``origin``."""
        seeds = frame.df.groupBy("cur").agg(F.min_by("binds", "path").alias("binds")) if frame.binds else frame.df.select("cur").distinct()
        binds = F.col("binds") if frame.binds else F.create_map().cast(_BINDS)
        start = seeds.select(F.col("cur").cast("string").alias("origin"), "cur", _step_text(F.col("cur")).alias("path"), binds.alias("binds"))
        return self.walk(t.steps, Frame(start, frame.kind, frame.binds, frame.types, True))

    def keep(self, frame: Frame, t: Traversal, how: str = "left_semi") -> Frame:
        """Traversers whose nested traversal gives something (or nothing: left_anti)."""
        found = self.nested(frame, t).df.select(F.col("origin").alias("_o")).distinct()
        return frame.to(frame.df.join(found, F.col("cur").cast("string") == F.col("_o"), how))

    # Filters

    def do_has(self, frame, args, mods):
        if len(args) == 2 and isinstance(args[1], Traversal):
            values = self.do_values(frame.to(frame.df.select(F.col("cur").alias("origin"), "cur", "path", "binds")), args[:1], ())
            found = self.nested(values, args[1]).df.select("origin").distinct()
            owners = values.df.join(found.withColumnRenamed("origin", "_v"), F.col("cur").cast("string") == F.col("_v"), "left_semi")
            return frame.to(frame.df.join(owners.select(F.col("origin").alias("_o")).distinct(), F.col("cur") == F.col("_o"), "left_semi"))
        return self._filter(frame, Step("has", args))

    def _filter(self, frame: Frame, step: Step) -> Frame:
        if frame.kind == "E":
            if step.name not in ("has", "hasLabel", "hasId") or (step.name == "has" and step.args[0] != "label"):
                raise QuerySyntaxError("edges have a label only")
            ok = self.graph.edges.where(self.condition(Step("hasLabel", step.args[-1:]) if step.name == "has" else step))
        else:
            ok = self.graph.vertices.where(self.condition(step))
        return frame.to(frame.df.join(ok.select("id"), F.col("cur") == F.col("id"), "left_semi"))

    def do_hasLabel(self, frame, args, mods):
        return self._filter(frame, Step("hasLabel", args))

    def do_hasId(self, frame, args, mods):
        return self._filter(frame, Step("hasId", args))

    def do_hasNot(self, frame, args, mods):
        return self._filter(frame, Step("hasNot", args))

    def do_where(self, frame, args, mods):
        if isinstance(args[0], Traversal):
            return self.keep(frame, args[0])
        if args[-1].op == "within":
            names = [n for a in args[-1].args for n in (a if isinstance(a, tuple) else (a,))]
            return self.in_bags(frame, [self.literal(n if isinstance(n, Name) else Name(n)) for n in names])
        left = F.col("cur").cast("string") if len(args) == 1 else F.col("binds")[args[0]]
        return frame.to(frame.df.where({"eq": left == F.col("binds")[args[-1].args[0]], "neq": left != F.col("binds")[args[-1].args[0]]}[args[-1].op]))

    def do_and(self, frame, args, mods):
        return reduce(self.keep, args, frame)

    def do_or(self, frame, args, mods):
        found = reduce(DataFrame.union, [self.nested(frame, t).df.select(F.col("origin").alias("_o")) for t in args]).distinct()
        return frame.to(frame.df.join(found, F.col("cur").cast("string") == F.col("_o"), "left_semi"))

    def do_not(self, frame, args, mods):
        return self.keep(frame, args[0], "left_anti")

    def do_is(self, frame, args, mods):
        if isinstance(args[0], Predicate) and args[0].op == "within":
            bags = [b for b in map(self.literal, args[0].args) if isinstance(b, Frame)]
            if bags:
                return self.in_bags(frame, bags)
        return frame.to(frame.df.where(self.test(F.col("cur"), args[0] if isinstance(args[0], Predicate) else self.literal(args[0]), dict(frame.df.dtypes)["cur"])))

    def do_simplePath(self, frame, args, mods):
        return frame.to(frame.df.where(F.size("path") == F.size(F.array_distinct("path"))))

    def do_dedup(self, frame, args, mods):
        """One traverser an element, the one of the least path."""
        first = frame.df.groupBy("origin", "cur").agg(F.min_by(F.struct("path", "binds"), "path").alias("_f"))
        return frame.to(first.select("origin", "cur", "_f.path", "_f.binds"))

    def do_limit(self, frame, args, mods):
        return frame.to(frame.df.limit(self.literal(args[0])))

    # Projections

    def moved(self, frame: Frame, df: DataFrame, cur: Column, kind: str) -> Frame:
        return frame.to(df.select("origin", cur.alias("cur"), F.concat("path", _step_text(cur)).alias("path"), "binds"), kind)

    def _with_vertex(self, frame: Frame, columns: list[str]) -> DataFrame:
        props = self.graph.vertices.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_p_{c}") for c in columns])
        return frame.df.join(props, F.col("cur") == F.col("_id"))

    def do_values(self, frame, args, mods):
        keys = [k for k in args if k in self.keys()]
        df = self._with_vertex(frame, keys)
        if len(keys) == 1:
            return self.moved(frame, df.where(F.col(f"_p_{keys[0]}").isNotNull()), F.col(f"_p_{keys[0]}"), "S")
        values = F.array_compact(F.array(*[F.col(f"_p_{k}").cast("string") for k in keys]).cast("array<string>"))
        return self.moved(frame, df.withColumn("_v", F.explode(values)), F.col("_v"), "S")

    def _map(self, keys: list[str]) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_p_{k}").cast("string").alias("v")) for k in keys])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    def do_valueMap(self, frame, args, mods):
        keys = [k for k in args if k in self.keys()] if args else self.keys()
        df = self._with_vertex(frame, keys).withColumn("_m", self._map(keys))
        return frame.to(df.select("origin", F.col("_m").alias("cur"), "path", "binds"), "S")

    def do_properties(self, frame, args, mods):
        rows = self.do_valueMap(frame, args, mods)
        return rows.to(rows.df.select("origin", F.explode(F.map_entries("cur")).alias("cur"), "path", "binds"), "S")

    def do_label(self, frame, args, mods):
        of = self.graph.vertices if frame.kind == "V" else self.graph.edges
        return self.moved(frame, frame.df.join(of.select(F.col("id").alias("_id"), "label"), F.col("cur") == F.col("_id")), F.col("label"), "S")

    def do_id(self, frame, args, mods):
        return self.moved(frame, frame.df, F.col("cur"), "S")

    def do_as(self, frame, args, mods):
        new = F.map_from_arrays(F.array(*map(F.lit, args)), F.array(*[F.col("cur").cast("string")] * len(args)))
        kept = F.map_filter("binds", lambda k, v: ~k.isin(list(args)))
        names = tuple(b for b in frame.binds if b[0] not in args) + tuple((a, frame.kind) for a in args)
        of = dict(frame.df.dtypes)["cur"]
        types = tuple(t for t in frame.types if t[0] not in args) + tuple((a, of) for a in args if of in ("int", "bigint", "double", "float", "boolean"))
        return replace(frame, df=frame.df.withColumn("binds", F.map_concat(kept, new)), binds=names, types=types)

    def do_select(self, frame, args, mods):
        if len(args) == 1:
            return self.moved(frame, frame.df, F.col("binds")[args[0]].cast(dict(frame.types).get(args[0], "string")), dict(frame.binds)[args[0]])
        chosen = F.map_from_arrays(F.array(*map(F.lit, args)), F.array(*[F.col("binds")[a] for a in args]))
        return frame.to(frame.df.withColumn("cur", chosen), "S")

    def do_path(self, frame, args, mods):
        """The history; with ``by``, each place's value of the first ``by`` on it, the ``by``s taken in turn. Places without a value are left out."""
        if not mods:
            return frame.to(frame.df.withColumn("cur", F.col("path")), "S")
        same = frame.df.groupBy("origin", "path").agg(F.count("*").alias("_times"), F.first("binds").alias("binds"))
        places = same.select("origin", "path", F.posexplode("path").alias("_at", "cur"))
        values = None
        for i, by in enumerate(mods):
            mine = places.where(F.col("_at") % len(mods) == i)
            seeds = mine.select("cur").distinct().select(F.lit("").alias("origin"), "cur", F.array(F.col("cur")).alias("path"), F.create_map().cast(_BINDS).alias("binds"))
            found = self.keyed(frame.to(seeds, "V"), [by])
            named = mine.join(found.select("cur", F.col("_k").cast("string").alias("_k")).where("_k is not null"), "cur")
            values = named if values is None else values.unionByName(named)
        listed = values.groupBy("origin", "path").agg(F.sort_array(F.collect_list(F.struct("_at", "_k"))).alias("_v"))
        whole = same.join(listed, ["origin", "path"], "left").withColumn("cur", F.coalesce(F.col("_v._k"), F.array().cast("array<string>")))
        again = whole.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        return frame.to(again.select("origin", "cur", "path", "binds"), "S")

    def do_unrollPath(self, frame, args, mods):
        return frame.to(frame.df.withColumn("cur", F.explode("path")), "V")

    def do_property(self, frame, args, mods):
        """Writes properties: the graph from here on is a copy with the new values; rows pass through."""
        hit = frame.df.select(F.col("cur").alias("id"), F.lit(True).alias("_hit")).distinct()
        v = self.graph.vertices.join(hit, "id", "left")
        for key, value in zip(args[::2], args[1::2], strict=True):
            old = F.col(key) if key in v.columns else F.lit(None)
            v = v.withColumn(key, F.when(F.col("_hit"), F.lit(self.literal(value))).otherwise(old))
        self.graph = replace(self.graph, vertices=v.select(*self.graph.vertices.columns, *[k for k in args[::2] if k not in self.graph.vertices.columns]))
        return frame

    # Hops

    def _hop(self, frame: Frame, labels: tuple, here: str, there: str, kind: str) -> Frame:
        e = self.graph.edges
        if labels:
            e = e.where(F.col("label").isin([self.literal(x) for x in labels]))
        e = e.select(F.col(here).alias("_h"), F.col(there).alias("_t"))
        return self.moved(frame, frame.df.join(e, F.col("cur") == F.col("_h")), F.col("_t"), kind)

    def _both(self, frame, labels, there_a, there_b, kind):
        one, two = self._hop(frame, labels, "src", there_a, kind), self._hop(frame, labels, "dst", there_b, kind)
        return one.to(one.df.union(two.df))

    def do_out(self, frame, args, mods):
        return self._hop(frame, args, "src", "dst", "V")

    def do_in(self, frame, args, mods):
        return self._hop(frame, args, "dst", "src", "V")

    def do_both(self, frame, args, mods):
        return self._both(frame, args, "dst", "src", "V")

    def do_outE(self, frame, args, mods):
        return self._hop(frame, args, "src", "id", "E")

    def do_inE(self, frame, args, mods):
        return self._hop(frame, args, "dst", "id", "E")

    def do_bothE(self, frame, args, mods):
        return self._both(frame, args, "id", "id", "E")

    def do_outV(self, frame, args, mods):
        return self._hop(frame, (), "id", "src", "V")

    def do_inV(self, frame, args, mods):
        return self._hop(frame, (), "id", "dst", "V")

    def do_bothV(self, frame, args, mods):
        one, two = self.do_outV(frame, (), ()), self.do_inV(frame, (), ())
        return one.to(one.df.union(two.df))

    def do_match(self, frame, args, mods):
        """Patterns that begin and end with ``as``: joined on the names that they share."""
        bound = dict(frame.binds)
        for t in args:
            start = t.steps[0].args[0]
            if start in bound:
                frame = replace(frame, df=frame.df.withColumn("cur", F.col("binds")[start]), kind=bound[start])
            else:
                frame = self.do_as(frame, (start,), ())
            end = t.steps[-1].args[0] if t.steps[-1].name == "as" and len(t.steps) > 1 else None
            frame = self.walk(t.steps[1:-1] if end else t.steps[1:], frame)
            if end and end in dict(frame.binds):
                frame = frame.to(frame.df.where(F.col("cur").cast("string") == F.col("binds")[end]))
            elif end:
                frame = self.do_as(frame, (end,), ())
            bound = dict(frame.binds)
        return frame.to(frame.df.withColumn("cur", F.col("binds")), "S")

    def do_repeat(self, frame, args, mods):
        """times: unrolled joins; until: rounds that are written to the checkpoint folder, while traversers are left, however many.

        If what a round does depends on the elements alone, and a round stands at just those of an earlier one, the walk would never end: RecursionError.
        """
        by = {m.name: m.args for m in mods}
        times = self.literal((by.get("times") or by.get("pre_times") or (None,))[0])
        until, first = by.get("until") or by.get("pre_until"), "pre_until" in by
        emit = by.get("emit", by.get("pre_emit"))
        done: list[DataFrame] = []
        columns = ["origin", "cur", "path", "binds"]

        def emitted(f: Frame) -> None:
            done.append((self.keep(f, emit[0]) if emit else f).df.select(*columns))

        def stopped(f: Frame) -> Frame:
            done.append(self.keep(f, until[0]).df.select(*columns))
            return self.keep(f, until[0], "left_anti")

        if "pre_emit" in by:
            emitted(frame)
        if first:
            frame = stopped(frame)
        forgetful = not _REMEMBERING & set(_step_names([*args[0].steps, *_steps_of((until or (), emit or ()))]))
        seen: set[tuple] = set()
        for _ in range(times) if times is not None else count():
            frame = self.walk(args[0].steps, frame)
            if until:
                frame = stopped(frame)
            if emit is not None:
                emitted(frame)
            if times is None:
                frame = frame.to(checkpoint(frame.df))
                if frame.df.isEmpty():
                    break
                if forgetful:
                    at = frame.df.select("origin", F.col("cur").cast("string").alias("cur")).distinct()
                    here = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("origin", "cur")), F.bit_xor(F.xxhash64("cur", "origin"))).head())
                    if here in seen:
                        raise RecursionError("repeat goes round in a cycle without an end")
                    seen.add(here)
        if times is not None and emit is None:
            done.append(frame.df.select(*columns))
        return frame.to(reduce(DataFrame.union, done))

    def do_local(self, frame, args, mods):
        found = self.nested(frame, args[0])
        back = frame.df.select("origin", F.col("cur").cast("string").alias("_c"), "path", "binds").join(found.df.select(F.col("origin").alias("_c"), "cur"), "_c")
        return found.to(back.select("origin", "cur", "path", "binds"), found.kind) if frame.nested else replace(frame, df=back.select("origin", "cur", "path", "binds"), kind=found.kind)

    def do_union(self, frame, args, mods):
        found = [self.walk(t.steps, frame) for t in args]
        same = len({f.kind for f in found} | {dict(f.df.dtypes)["cur"] for f in found}) <= 2
        dfs = [f.df if same else f.df.withColumn("cur", F.col("cur").cast("string")) for f in found]
        return frame.to(reduce(DataFrame.unionByName, dfs), found[0].kind if same else "S")

    def do_choose(self, frame, args, mods):
        """Each option's traversal from the elements whose nested value is the option's literal."""
        value = self.nested(frame, args[0]).df.select(F.col("origin").alias("_o"), F.col("cur").cast("string").alias("_v")).distinct()
        with_value = frame.df.join(value, F.col("cur").cast("string") == F.col("_o"))
        found = [self.walk(o.args[1].steps, frame.to(with_value.where(F.col("_v") == str(self.literal(o.args[0]))).select("origin", "cur", "path", "binds"))) for o in mods]
        return frame.to(reduce(DataFrame.unionByName, [f.df for f in found]), found[0].kind)

    # Reductions

    def _reduce(self, frame: Frame, value: Column, kind: str = "S") -> Frame:
        if frame.nested:
            df = frame.df.groupBy("origin").agg(value.alias("cur"))
        else:
            df = frame.df.agg(value.alias("cur")).select(F.lit("").alias("origin"), "cur")
        return frame.to(df.select("origin", "cur", _step_text(F.col("cur")).alias("path"), F.create_map().cast(_BINDS).alias("binds")).where(F.col("cur").isNotNull()), kind)

    def do_count(self, frame, args, mods):
        return self._reduce(frame, F.count("*"))

    def do_sum(self, frame, args, mods):
        return self._reduce(frame, F.sum("cur"))

    def do_max(self, frame, args, mods):
        return self._reduce(frame, F.max("cur"))

    def do_min(self, frame, args, mods):
        return self._reduce(frame, F.min("cur"))

    def keyed(self, frame: Frame, mods) -> DataFrame:
        """With ``_k``: the value that ``by`` names, or the element."""
        if not mods or not mods[0].args or mods[0].args[0] == Name("value"):
            return frame.df.withColumn("_k", F.col("cur").cast("string"))
        by = mods[0].args[0]
        if isinstance(by, Traversal):
            found = self.nested(frame, by).df.select(F.col("origin").alias("_o"), F.col("cur").alias("_k"))
            return frame.df.join(found, F.col("cur").cast("string") == F.col("_o"), "left")
        key = by.name if isinstance(by, Name) else by
        if key in ("id", "key"):
            return frame.df.withColumn("_k", F.col("cur"))
        return self._with_vertex(frame, [key]).withColumnRenamed(f"_p_{key}", "_k")

    def keyed_each(self, frame: Frame, mods) -> tuple[DataFrame, list[str]]:
        """With one key column for each ``by``, in their order."""
        names, df = [], frame.df
        for i, by in enumerate(mods):
            df = self.keyed(frame.to(df), [by]).select("origin", "cur", "path", "binds", *names, F.col("_k").alias(f"_k{i}"))
            names.append(f"_k{i}")
        return df, names

    def do_groupCount(self, frame, args, mods):
        """One map of counts, key order ascending."""
        groups = [*(["origin"] if frame.nested else []), F.col("_k").cast("string").alias("_k")]
        counts = self.keyed(frame, mods).groupBy(*groups).agg(F.count("*").alias("_n")).where("_k is not null").withColumn("cur", F.struct("_k", "_n"))
        return self._reduce(frame.to(counts), F.map_from_entries(F.sort_array(F.collect_list("cur"))))

    def do_group(self, frame, args, mods):
        """One map of sorted lists, of the elements or of what a second ``by`` gives for them."""
        df, names = self.keyed_each(frame, mods[:2]) if len(mods) > 1 else (self.keyed(frame, mods).withColumn("_k0", F.col("_k")), ["_k0"])
        groups = [*(["origin"] if frame.nested else []), F.col("_k0").cast("string").alias("_k")]
        value = F.col(names[1] if len(names) > 1 else "cur").cast("string")
        lists = df.groupBy(*groups).agg(F.sort_array(F.collect_list(value)).alias("_n")).where("_k is not null").withColumn("cur", F.struct("_k", "_n"))
        return self._reduce(frame.to(lists), F.map_from_entries(F.sort_array(F.collect_list("cur"))))

    def do_fold(self, frame, args, mods):
        return self._reduce(frame, F.sort_array(F.collect_list("cur")))

    def do_unfold(self, frame, args, mods):
        type_ = dict(frame.df.dtypes)["cur"]
        if not type_.startswith(("array", "map")):
            return frame
        items = F.explode(F.map_entries("cur")) if type_.startswith("map") else F.explode("cur")
        return frame.to(frame.df.select("origin", items.alias("cur"), "path", "binds"))

    def do_aggregate(self, frame, args, mods):
        """A bag of the current elements under a name, taken at once: ``g.V(name)``, ``is(within(name))`` and ``where(within('name'))`` read it, here and in later statements."""
        held = frame.to(checkpoint(frame.df))
        self.names[args[0]] = replace(held, nested=False)
        return held

    def in_bags(self, frame: Frame, bags: list[Frame]) -> Frame:
        """Traversers whose element is in one of the bags."""
        held = reduce(DataFrame.union, [b.df.select(F.col("cur").cast("string").alias("_b")) for b in bags]).distinct()
        return frame.to(frame.df.join(held, F.col("cur").cast("string") == F.col("_b"), "left_semi"))

    def do_order(self, frame, args, mods):
        """Sorted by the keys in turn, each ascending, or descending after ``decr``; ties by the element."""
        keys = [m for m in mods if m.args]
        df, names = self.keyed_each(frame, keys) if keys else (frame.df.withColumn("_k0", F.col("cur")), ["_k0"])
        down = [len(m.args) > 1 and m.args[1] == Name("decr") for m in keys] or [False]
        by = [F.col(k).desc() if d else F.col(k).asc() for k, d in zip(names, down, strict=True)]
        return frame.to(df.orderBy(*by, F.col("cur").cast("string")).select("origin", "cur", "path", "binds"))

    def do_toList(self, frame, args, mods):
        return frame


def run_query(spark: SparkSession, graph: Graph, text: str) -> DataFrame:
    """The rows of a query on a graph, in one column ``result``."""
    return Compiler(graph).run(text)
