"""Secret scans over a trigram index."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more.

    The pattern is in the syntax that Java and Python share, without look-around.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
EXTRA_RULES = (
    # The head line, full lines of the body, and a last line of it with the end line.
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----(?:\r?\n[A-Za-z0-9+/=]{40,})*(?:(?:\r?\n[A-Za-z0-9+/=]{1,76})?\r?\n-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----)?"),
    Rule("forge", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xoxb-[A-Za-z0-9-]{10,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + EXTRA_RULES

# A Boolean query: True (any text), ("gram", g), ("and", {queries}) or ("or", {queries}).
Query = bool | tuple


def _and(parts: Iterable[Query]) -> Query:
    kept = frozenset(p for p in parts if p is not True)
    return True if not kept else next(iter(kept)) if len(kept) == 1 else ("and", kept)


def _or(parts: Iterable[Query]) -> Query:
    kept = frozenset(parts)
    return True if True in kept or not kept else next(iter(kept)) if len(kept) == 1 else ("or", kept)


#: Literal alternatives that are followed through a regex at once; more become a wild card, which is less selective but never wrong.
MAX_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match must hold, as a Boolean query over lower-cased texts; they are of ASCII characters alone.

    The regex is walked left to right with the set of literal strings that may have just been read. When a
    wild part ends them, each gives the conjunction of its first and its last trigram, which are as selective here as all
    of them and make a smaller index, and the set their disjunction. True: no trigram is mandatory.
    """

    def grams(strings: set[str]) -> Query:
        return _or([_and(("gram", g) for g in {s[:3], s[-3:]} if len(g) == 3) for s in strings])

    def choices(parts) -> set[str] | None:
        """All strings of a part if they are few, else None."""
        found = {""}
        for op, arg in parts:
            if op is sre.LITERAL:
                new = {chr(arg).lower()} if arg < 128 else None  # others may be lower-cased in another way by the texts' side
            elif op is sre.IN and all(o is sre.LITERAL and a < 128 for o, a in arg) and len(arg) <= 8:
                new = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                new = choices(arg[3])
            elif op is sre.BRANCH:
                each = [choices(b) for b in arg[1]]
                new = None if None in each else set().union(*each)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and int(arg[1]) <= 4:
                one = choices(arg[2])
                new = None
                if one is not None:
                    new, power = set(), {""}
                    for n in range(int(arg[1]) + 1):
                        if n >= arg[0]:
                            new |= power
                        power = {a + b for a in power for b in one}
                        if len(power) > MAX_STRINGS:
                            return None
            else:
                new = None
            if new is None or len(found) * len(new) > MAX_STRINGS:
                return None
            found = {a + b for a in found for b in new}
        return found

    def walk(parts) -> Query:
        needs, run = [], {""}
        for part in parts:
            new = choices([part])
            if new is not None and len(run) * len(new) <= MAX_STRINGS:
                run = {a + b for a in run for b in new}
                continue
            needs.append(grams(run))
            run = {""}
            op, arg = part
            if new is not None:
                run = new
            elif op is sre.SUBPATTERN:
                needs.append(walk(arg[3]))
            elif op is sre.BRANCH:
                needs.append(_or([walk(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                needs.append(walk(arg[2]))
        return _and([*needs, grams(run)])

    return walk(_parser.parse(pattern))


def query_trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(query_trigrams, query[1]))


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a row by id and text. Rows that share a key share candidates, which are verified anyway."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_index(docs: DataFrame, trigrams: Iterable[str], id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4096) -> DataFrame:
    """The inverted index: (block, trigram, postings), a posting being a row key, for the trigrams that queries ask about.

    Rows are dealt into blocks of about ``block_rows`` by their key, so a trigram that every text holds still
    gives postings of bounded length. Other trigrams are never looked up and get no postings.
    """
    names = sorted(trigrams)
    blocks = max(1, -(-docs.count() // block_rows))
    return (
        docs.where(F.col(text_col).isNotNull())
        .select(_row_key(id_col, text_col).alias("key"), F.lower(text_col).alias("_lower"))
        .select("key", F.array_compact(F.array(*[F.when(F.contains("_lower", F.lit(g)), F.lit(g)) for g in names])).alias("_grams"))
        .select("key", F.explode_outer("_grams").alias("trigram"))  # the inner one would make the array a second time, to filter by it
        .where(F.col("trigram").isNotNull())
        .groupBy(F.pmod(F.col("key"), F.lit(blocks)).cast("int").alias("block"), "trigram")
        .agg(F.collect_set("key").alias("postings"))
    )


def search(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): for each row key the queries that its postings satisfy; AND intersects postings, OR unites them."""
    names = sorted(set().union(*map(query_trigrams, queries.values())))
    lists = index.groupBy("block").agg(
        *[F.coalesce(F.first(F.when(F.col("trigram") == g, F.col("postings")), ignorenulls=True), F.array().cast("array<bigint>")).alias(f"p{i}") for i, g in enumerate(names)]
    )

    def postings(query: Query) -> Column:
        if query[0] == "gram":
            return F.col(f"p{names.index(query[1])}")
        parts = [postings(q) for q in sorted(query[1], key=str)]
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)

    hits = F.array(*[F.struct(F.lit(kind).alias("kind"), postings(query).alias("keys")) for kind, query in sorted(queries.items())])
    return (
        lists.select(F.explode(hits).alias("hit"))
        .select(F.col("hit.kind").alias("kind"), F.explode("hit.keys").alias("key"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


#: Spans whose offsets are summed up in one go; longer lists are summed in pieces, then offset by the pieces' totals.
_PIECE = 256


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, size) in code points of the rule's matches: ``size`` is the length of its group.

    The text is split at the matches; with the matches themselves, the running sum of lengths gives places.
    """
    pattern = F.lit(rule.pattern)

    def running(pairs: Column) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])

        def spans(piece: Column, offset: Column) -> Column:
            begin = F.struct(offset.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>").alias("out"))
            step = lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), x["size"].alias("size")))).alias("out"),
            )
            return F.aggregate(piece, begin, step, lambda a: a["out"])

        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(_PIECE)), lambda i: F.slice(pairs, i + 1, _PIECE))

        def joined(all_pieces: Column) -> Column:
            sums = F.aggregate(
                all_pieces, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x)))
            )
            return let(sums, lambda s: F.flatten(F.transform(all_pieces, lambda x, i: spans(x, F.get(s, i)))))

        return let(pieces, joined)

    long = lambda x: F.length(x).cast("long")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    with_part = F.zip_with(whole, part, lambda w, p: F.struct(long(w).alias("len"), long(p).alias("size")))
    pairs = let(
        F.split(text, rule.pattern),
        lambda gaps: F.transform(with_part, lambda m, i: F.struct(long(F.get(gaps, i)).alias("gap"), m["len"].alias("len"), m["size"].alias("size"))),
    )
    return F.filter(let(pairs, running), lambda x: x["size"] >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``secret_spans``: array of (kind, start, end) in code points by start, then by the rules' order.

    Each rule's regex gives a Boolean trigram query. An inverted index of the queries' trigrams is built over
    all texts and searched by intersecting and uniting postings; a rule's regex then runs only on its
    candidates. Rules without a mandatory trigram run on all texts. Row and candidates meet by a hash of id
    and text, with the candidates as the hashed side.

    Defined results: a null or empty text has no spans; rows with equal ids are scanned on their own; of spans that begin at one place the first rule's comes first; very long
    texts are scanned whole; an empty table gives no rows; input columns named secret_spans, _key and _kinds are replaced or dropped.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    rows = docs.drop("secret_spans")
    if queries:
        index = build_index(docs.select(id_col, text_col), set().union(*map(query_trigrams, queries.values())), id_col, text_col)
        found = search(index, queries).withColumnsRenamed({"key": "_key", "kinds": "_kinds"})
        rows = rows.withColumn("_key", _row_key(id_col, text_col)).join(found.hint("shuffle_hash"), "_key", "left")
    else:
        rows = rows.withColumn("_kinds", F.lit(None).cast("array<string>"))
    text = F.col(text_col)
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>")
    each = []
    ranked = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))
    for rank, rule in enumerate(rules):
        due = F.array_contains("_kinds", rule.kind) if rule.kind in queries else text.rlike(_quick(rule))
        spans = F.when(due, match_spans(text, rule)).otherwise(nothing)
        each.append(F.transform(spans, ranked(rank)))
    kinds = F.lit([r.kind for r in rules])
    named = F.transform(
        F.sort_array(F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")) for e in each]))),
        lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return rows.withColumn("secret_spans", named).drop("_key", "_kinds")


def _quick(rule: Rule) -> str:
    """A pattern that any text with a span of the rule must match: one-class rules can ask for the least length at once."""
    parts = list(_parser.parse(rule.pattern))
    alone = len(parts) == 1 and parts[0][0] is sre.MAX_REPEAT and rule.group == 0 and rule.pattern.endswith("+")
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if alone else rule.pattern


def span_list(spans: Column, kinds: Iterable[str] | None = None) -> Column:
    """kind:start:end, comma-joined; of the given kinds only."""
    chosen = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input's columns with every span in the text replaced by ``mark``; overlapping spans become one mark."""
    found = scan(docs.withColumn("_row_text", F.col(text_col)), rules, id_col, text_col)

    def masked(spans: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            gap = F.substring(F.col("_row_text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
            fresh = x["start"] >= a["at"]
            return F.struct(
                F.greatest(a["at"], x["end"]).alias("at"),
                F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"),
            )

        rest = lambda a: F.concat(a["out"], F.substring(F.col("_row_text"), (a["at"] + 1).cast("int"), F.length("_row_text")))
        return F.aggregate(spans, begin, step, rest)

    text = F.when(F.size("secret_spans") > 0, masked(F.col("secret_spans"))).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*docs.columns)
