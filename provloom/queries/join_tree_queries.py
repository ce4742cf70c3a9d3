"""Tries over what two-phase and cross-host joins emit, with SQL twins of their alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import novelty
from ..operators.graph import event_frame, kind_of
from ..session import checkpoint
from .novelty_queries import SEQ, host_flows, levels_sql
from .registry import ORACLES, query
from .sql import EV

_ALARMS = "SELECT tree, {seq}, k1 || '|' || k2 || '|' || k3 AS key, round(lp, 6) AS local_prob, round(1.0 / c0, 6) AS global_prob, dp AS depth FROM al"


def _shown(found, *seq):
    return found.select("tree", *seq, F.array_join("key", "|").alias("key"), F.round("local_prob", 6).alias("local_prob"), F.round("global_prob", 6).alias("global_prob"), "depth")


def two_phase(name: str, tree: str, first: str, later: str, key: str, parts: tuple[str, str, str], extra: str = "TRUE") -> None:
    """The first event of some kinds on a key opens, every later one of others is observed; the later event's place orders the tree, as it emits one row at most.

    ``parts`` are the levels of the trie, columns of the two events.
    """
    columns = {"first_subject": "fs", "first_object": "fo", "later_subject": "subject", "later_object": "object"}
    of = lambda text: columns[text]
    level = ", ".join(f"coalesce(CAST({of(p)} AS VARCHAR), '?') AS k{i}" for i, p in enumerate(parts, 1))
    where = extra.replace("first_subject", "fs").replace("later_subject", "subject")
    sql = f"""WITH {EV}, f AS (SELECT {key} AS k, min((nanos, event_id)) AS t0, min_by(subject, (nanos, event_id)) AS fs, min_by(object, (nanos, event_id)) AS fo FROM ev WHERE kind IN ({first}) AND {key} IS NOT NULL GROUP BY 1),
 obs AS (SELECT '{tree}' AS tree, nanos, event_id, {level} FROM f JOIN ev ON {key} = k AND kind IN ({later}) AND (nanos, event_id) > t0 WHERE {where}), {levels_sql("nanos, event_id")} {_ALARMS.format(seq="event_id")}"""

    def run(spark, sf_dir):
        ev = event_frame(spark, sf_dir).withColumn("kind", kind_of(F.col("event_type")))
        # the key's own column is taken under other names, as the join keeps it once
        ev = ev.withColumns({"s": F.col("subject"), "o": F.col("object")})
        found = novelty.first_then_later(ev, F.expr(f"kind in ({first})"), F.expr(f"kind in ({later})"), key, SEQ, ["s", "o"], [*SEQ, "s", "o"])
        found = found.withColumnsRenamed({f"{a}_{c}": f"{a}_{full}" for a in ("first", "later") for c, full in (("s", "subject"), ("o", "object"))})
        seen = novelty.join_observations(found.where(extra).withColumnsRenamed({"later_nanos": "at", "later_event_id": "by"}), tree, ["at", "by"], list(parts))
        return _shown(novelty.alarms(novelty.observe(seen, seq=("at", "by")), ("at", "by")), F.col("by").alias("event_id"))

    query(name, sql)(run)


two_phase("file_execute_delete_alarms", "FileExecuteDelete", "'EVENT_EXECUTE'", "'EVENT_UNLINK'", "object", ("later_object", "first_subject", "later_subject"))
two_phase("file_written_executed_alarms", "FilesWrittenThenExecuted", "'EVENT_WRITE'", "'EVENT_EXECUTE'", "object", ("later_object", "first_subject", "later_subject"))
two_phase("communication_alarms", "CommunicationPathThroughObject", "'EVENT_WRITE'", "'EVENT_READ'", "object", ("first_subject", "later_subject", "later_object"), "first_subject <> later_subject")
two_phase("write_soon_after_read_alarms", "ProcessWritesFileSoonAfterNetflowRead", "'EVENT_READ'", "'EVENT_WRITE'", "subject", ("later_subject", "first_object", "later_object"))


@query("cross_host_alarms", f"""WITH j AS ({ORACLES["cross_host_flows"]}), obs AS (SELECT 'CrossHostProcessCommunication' AS tree, emitted, other_seq, host, other_host,
 CAST(host AS VARCHAR) AS k1, CAST(other_host AS VARCHAR) AS k2, CAST(other_seq % 10 AS VARCHAR) AS k3 FROM j), {levels_sql("emitted, other_seq, host, other_host")} {_ALARMS.format(seq="emitted, other_seq, host, other_host")}""")
def cross_host_alarms(spark, sf_dir):
    """Pairs of flows between hosts as [receiver, sender, port]; a flow that meets several is ordered by them. The last digit of the other order stands for its port."""
    seq = ("emitted", "other_seq", "host", "other_host")
    flows = checkpoint(host_flows(spark, sf_dir))
    found = novelty.cross_host(flows, ["a", "d"], ["b", "d"], "host", "seq", []).withColumn("port", F.col("other_seq") % 10)
    few = checkpoint(novelty.until_last_alarm(found, "emitted", ["host", "other_host", "port"]))  # pairs grow with the square of a day's flows, their keys don't
    seen = novelty.join_observations(few, "CrossHostProcessCommunication", list(seq), ["host", "other_host", "port"])
    return _shown(novelty.observed_alarms(seen, seq), *seq)
