"""URL filters: fixed rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"),
)
#: Second labels below which countries register names, as in co.uk or com.tr; fixed values.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org")
#: A host is blocked if the lower bound of its share of failing pages is above this.
MAX_FAILING = 0.25
#: The normal quantile of the bound: one-sided 95 %.
Z = 1.645
#: Prior strengths, in pages.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def url_host(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The part of a host that somebody registered: the label before the suffix, and the suffix. A suffix is the last label, or the last two if the second is one of
    SECOND_LABELS below a country's two letters. Port and user are left out; an address of four numbers is its own domain."""
    bare = F.regexp_replace(host, r":\d*$|^.*@", "")
    labels = F.split(bare, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    n = F.when(two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$"), 3).otherwise(2)
    named = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$"), bare).otherwise(named)


def suffix(domain: Column) -> Column:
    """What follows a registered domain's first label; of an address, itself."""
    return F.when(~domain.rlike(r"^\d+\.\d+\.\d+\.\d+$") & F.contains(domain, F.lit(".")), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def domains_by_table(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain, suffix) of distinct hosts, by a table of public suffixes, a column ``suffix`` in the usual notation: ``co.uk``; ``*.ck``, any label
    below it; ``!www.ck``, none after all. The longest suffix that a host ends with counts, an exception before all, the last label where none does.

    A host meets the table once for each of its labels, in a join on the text, so the table may be of any length. A host that is a suffix is its own domain, and so is
    an address of four numbers.
    """
    bare = F.regexp_replace("host", r":\d*$|^.*@", "")
    labels = hosts.select("host", bare.alias("bare"), F.split(bare, r"\.").alias("labels")).where(~bare.rlike(r"^\d+\.\d+\.\d+\.\d+$"))
    known = suffixes.select(F.lower(F.trim("suffix")).alias("s")).where("s <> ''").distinct().select(
        F.regexp_replace("s", r"^(!|\*\.)", "").alias("tail"), F.when(F.startswith("s", F.lit("!")), -1).when(F.startswith("s", F.lit("*.")), 1).otherwise(0).alias("more")
    )
    tails = labels.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    tails = tails.withColumn("tail", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), "."))
    # of an exception the suffix is a label shorter, of a wildcard one longer
    found = tails.join(known, "tail").where(F.col("n") + F.col("more") <= F.size("labels")).groupBy("host").agg(
        F.max(F.when(F.col("more") < 0, F.col("n") - 1)).alias("except"), F.max(F.when(F.col("more") >= 0, F.col("n") + F.col("more"))).alias("longest")
    )
    placed = labels.join(found, "host", "left").withColumn("n", F.coalesce("except", "longest", F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", F.greatest(F.size("labels") - k + 1, F.lit(1)), F.greatest(k, F.lit(1))), ".")
    named = placed.select("host", last(F.col("n") + 1).alias("domain"), last(F.col("n")).alias("suffix"))
    return named.union(hosts.select("host", bare.alias("domain"), bare.alias("suffix")).where(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$")))


def lower_bound(mean: Column, n: Column) -> Column:
    """Wilson's lower bound of a share of which ``n`` cases, prior ones included, have the mean: from 0 to 1, and below the mean also where few are known."""
    return (mean + Z * Z / (2 * n) - Z * F.sqrt(mean * (1 - mean) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path the path starts with; a struct of name and verdict, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _shrink(children: DataFrame, parents: DataFrame | None, on: str | None) -> DataFrame:
    """Children (n, failing) with ``mean``, and ``prior`` as the strength of the parent's mean in pages.

    The strength comes from the spread of the children's shares about their parents' means by the moments of
    the beta-binomial: sum n (r - m)^2 - sum m (1 - m) = rho * sum (n - 1) m (1 - m), strength (1 - rho) / rho.
    """
    if parents is None:
        total = children.agg(((F.sum("failing") + 0.5) / (F.sum("n") + 1)).alias("parent_mean"))
        with_mean = children.withColumn("parent_mean", F.lit(float(total.head()[0] or 0.0)))
    else:
        with_mean = children.join(parents.select(on, F.col("mean").alias("parent_mean")), on)
    spread = F.col("parent_mean") * (1 - F.col("parent_mean"))
    off = F.col("failing") / F.col("n") - F.col("parent_mean")
    moments = with_mean.agg(F.sum(F.col("n") * off * off - spread), F.sum((F.col("n") - 1) * spread)).head()
    rho = max(0.0, moments[0] / moments[1]) if moments[1] else 0.0
    strength = min(MOST_PRIOR, max(LEAST_PRIOR, (1 - rho) / rho if rho else MOST_PRIOR))
    return with_mean.withColumns({
        "prior": F.lit(strength),
        "mean": (F.col("failing") + strength * F.col("parent_mean")) / (F.col("n") + strength),
    })


def host_reputation(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", id_col: str = "page_id", suffixes: DataFrame | None = None) -> DataFrame:
    """One row a host of ``pages``: n and failing labelled pages, posterior mean and lower bound of its share of failing pages.

    ``suffixes``: a table of public suffixes, see ``domains_by_table``; without one, suffixes follow the rule of ``registered_domain``.

    ``outcomes``: (``id_col``, failing boolean), one row a labelled page. Shares are shrunk from all pages to suffix, to registered domain,
    to host; a host without labelled pages has its domain's mean and the prior's width. Counts are summed before
    the shuffle, so a host that holds a third of all pages is one row a task.
    """
    hosts = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host")).where("host <> ''")
    fails = outcomes.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("failing").cast("int")).alias("failing"))
    counted = hosts.join(fails, "_id", "left").groupBy("host").agg(F.count("failing").alias("n"), F.coalesce(F.sum("failing"), F.lit(0)).alias("failing"))
    if suffixes is None:
        counted = counted.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    else:
        counted = checkpoint(counted)
        counted = counted.join(domains_by_table(counted.select("host"), suffixes), "host")
    counted = checkpoint(counted)
    n_failing = [F.sum("n").alias("n"), F.sum("failing").alias("failing")]
    seen = counted.where("n > 0")
    tops = checkpoint(_shrink(seen.groupBy("suffix").agg(*n_failing), None, None))
    domains = checkpoint(_shrink(seen.groupBy("domain", "suffix").agg(*n_failing), tops, "suffix"))
    labelled = _shrink(seen, domains, "domain")
    strength = (labelled.select("prior").head() or [MOST_PRIOR])[0]
    overall = (tops.select("parent_mean").head() or [0.0])[0]
    parent = F.coalesce(F.col("domain_mean"), F.col("suffix_mean"), F.lit(float(overall)))
    a = F.col("failing") + strength * F.col("parent_mean")
    b = F.col("n") - F.col("failing") + strength * (1 - F.col("parent_mean"))
    return (
        counted.join(domains.select("domain", F.col("mean").alias("domain_mean")), "domain", "left")
        .join(tops.select("suffix", F.col("mean").alias("suffix_mean")), "suffix", "left")
        .withColumn("parent_mean", parent)
        .withColumns({"mean": a / (a + b), "_all": a + b})
        .select("host", "domain", "suffix", "n", "failing", "mean", lower_bound(F.col("mean"), F.col("_all")).alias("bound"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url", id_col: str = "page_id", suffixes: DataFrame | None = None) -> DataFrame:
    """Every page's id, host, path, rule (or null) and verdict: the longest rule's, else block where the host's bound is above MAX_FAILING, else allow.

    Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; equal
    ids and repeated rows are judged each by its own url; an outcome of null id or of an unknown page counts for nothing, several of one
    page are failing if one is; pages without rows give none; very long urls are taken whole; other columns are not read. The reputation join is by host; Spark may split a host that holds many pages.
    """
    rows = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    bad = host_reputation(pages, outcomes, url_col, id_col, suffixes).where(F.col("bound") > MAX_FAILING).select("host", F.lit(True).alias("_bad"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bad, "host", "left").withColumn("_rule", rule).select(
        id_col, "host", "path", F.col("_rule.name").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict")
    )
