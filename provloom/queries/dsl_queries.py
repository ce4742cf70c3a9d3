"""Traversal-language queries on the event graph, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import event_graph
from ..plans.compiler import Compiler
from .registry import query
from .sql import EDGES, EV, SUBJECTS


def dsl(name: str, text: str, sql: str, cast: str = "string", with_: str = EV) -> None:
    """Registers a query of one column ``result``; maps and lists are cast by JSON with sorted keys."""

    def run(spark, sf_dir):
        df = Compiler(event_graph(spark, sf_dir)).run(text)
        type_ = dict(df.dtypes)["result"]
        if type_.startswith("map"):
            entries = F.array_sort(F.map_entries("result"))
            each = lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "+") if "array" in type_ else e["value"].cast("string"))
            return df.select(F.array_join(F.transform(entries, each), ",").alias("result"))
        if type_.startswith("array"):
            return df.select(F.array_join(F.col("result").cast("array<string>"), ",").alias("result"))
        return df.select(F.col("result").cast(cast).alias("result"))

    run.__doc__ = text
    query(f"dsl_{name}", f"WITH RECURSIVE {with_} {sql}")(run)


dsl("v_count", "g.V().count()", """SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM su) + (SELECT count(DISTINCT object) FROM ev)
 + (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT subject FROM su)) + (SELECT count(*) FROM nation) AS result""", "bigint", f"{EV}, {SUBJECTS}")
dsl("v_ids", "g.V('u1','u2','k3').id()", "SELECT unnest(['u1', 'u2', 'k3']) AS result")
dsl("e_count", "g.E().hasLabel('subject').count()", "SELECT count(*) AS result FROM ev", "bigint")
dsl("e_ends", "g.E().hasLabel('parentSubject').bothV().dedup().count()", "SELECT count(DISTINCT v) AS result FROM (SELECT src AS v FROM ed WHERE label = 'parentSubject' UNION ALL SELECT dst FROM ed WHERE label = 'parentSubject')", "bigint", EDGES)
dsl("has_literal", "g.V().hasLabel('AdmEvent').has('eventType','EVENT_WRITE').values('earliestTimestampNanos')", "SELECT nanos AS result FROM ev WHERE kind = 'EVENT_WRITE'", "bigint")
dsl("has_type_sensitive", "g.V().hasLabel('AdmSubject').has('cid','5').count()", "SELECT CAST(0 AS BIGINT) AS result", "bigint")
dsl("has_key", "g.V().has('path').values('path')", "SELECT DISTINCT '/k/' || object AS result FROM ev WHERE object IS NOT NULL")
dsl("has_not", "g.V().hasNot('eventType').hasLabel('AdmSubject').values('cid')", "SELECT DISTINCT subject AS result FROM ev", "bigint")
dsl("has_between", "g.V().hasLabel('AdmSubject').has('cid',between(10L,20L)).values('cid')", "SELECT DISTINCT subject AS result FROM ev WHERE subject >= 10 AND subject < 20", "bigint")
dsl("has_within", "ks = ['/k/1','/k/2','/k/x'].toArray(); g.V().has('path',within(ks)).id()", "SELECT DISTINCT 'k' || object AS result FROM ev WHERE object IN (1, 2)")
dsl("has_regex", "g.V().hasLabel('AdmFileObject').has('path',regex('.*/1[0-4]')).values('path')", "SELECT DISTINCT '/k/' || object AS result FROM ev WHERE object BETWEEN 10 AND 14")
dsl("has_gte_lte", "g.V().hasLabel('AdmSubject').has('cid',gte(140)).has('cid',lte(145)).has('cid',neq(142)).values('cid')", "SELECT DISTINCT subject AS result FROM ev WHERE subject BETWEEN 140 AND 145 AND subject <> 142", "bigint")
dsl("has_traversal", "g.V().hasLabel('AdmSubject').has('cid',_.is(lte(7))).id()", "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE subject <= 7")
dsl("where_traversal", "g.V().hasLabel('AdmFileObject').where(_.in('predicateObject').has('eventType','EVENT_UNLINK').out('subject').has('cid',lte(9))).id()", "SELECT DISTINCT 'k' || object AS result FROM ev WHERE kind = 'EVENT_UNLINK' AND subject <= 9 AND object IS NOT NULL")
dsl("where_neq", "g.V().hasLabel('AdmSubject').has('cid',lte(9)).as('a').out('parentSubject').in('parentSubject').where(neq('a')).id()",
    "SELECT 'u' || b.subject AS result FROM su a JOIN su b ON a.subject // 2 = b.subject // 2 AND a.subject <> b.subject WHERE a.subject BETWEEN 1 AND 9 AND b.subject > 0", with_=f"{EV}, {SUBJECTS}")
dsl("where_two_names", "g.V().hasLabel('AdmSubject').as('a').out('parentSubject').as('b').out('localPrincipal').where('a',neq('b')).id()",
    "SELECT 'c' || c_custkey AS result FROM su JOIN customer ON c_custkey = subject // 2 WHERE subject > 0 AND c_custkey IN (SELECT subject FROM su)", with_=f"{EV}, {SUBJECTS}")
dsl("and_or_not", "g.V().hasLabel('AdmSubject').and(_.in('parentSubject'),_.has('cid',lte(60))).or(_.has('cid',lte(3)),_.has('cid',gte(50))).not(_.has('cid',52)).values('cid')",
    "SELECT subject AS result FROM su WHERE subject IN (SELECT subject // 2 FROM su WHERE subject > 0) AND subject <= 60 AND (subject <= 3 OR subject >= 50) AND subject <> 52", "bigint", f"{EV}, {SUBJECTS}")
dsl("is_predicate", "g.V().values('cid').is(between(0,5))", "SELECT DISTINCT subject AS result FROM ev WHERE subject < 5", "bigint")
dsl("values_two", "g.V().hasLabel('AdmEvent').has('eventType','EVENT_FORK').values('eventType','uuid')", "SELECT unnest([kind, 'e' || event_id]) AS result FROM ev WHERE kind = 'EVENT_FORK'")
dsl("value_map", "g.V().hasLabel('AdmHost').valueMap('hostName','cid','uuid')", "SELECT 'hostName=' || n_name || ',uuid=n' || n_nationkey AS result FROM nation")
dsl("properties", "g.V().hasLabel('AdmHost').properties('hostName').count()", "SELECT count(*) AS result FROM nation", "bigint")
dsl("label", "g.V().label().groupCount()", """SELECT string_agg(l || '=' || n, ',' ORDER BY l) AS result FROM (SELECT 'AdmEvent' AS l, count(*) AS n FROM ev UNION ALL SELECT 'AdmSubject', count(*) FROM su
 UNION ALL SELECT 'AdmFileObject', count(DISTINCT object) FROM ev UNION ALL SELECT 'AdmHost', count(*) FROM nation
 UNION ALL SELECT 'AdmPrincipal', count(*) FROM customer WHERE c_custkey IN (SELECT subject FROM su))""", with_=f"{EV}, {SUBJECTS}")
dsl("select_one", "g.V().hasLabel('AdmSubject').as('s').in('subject').has('eventType','EVENT_UNLINK').select('s').dedup().id()", "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE kind = 'EVENT_UNLINK'")
dsl("select_many", "g.V().hasLabel('AdmEvent').has('eventType','EVENT_FORK').as('e').out('subject').as('s').select('e','s')", "SELECT 'e=e' || event_id || ',s=u' || subject AS result FROM ev WHERE kind = 'EVENT_FORK'")
dsl("out_in_bag", "g.V().hasLabel('AdmSubject').has('cid',3).in('subject').out('predicateObject').id()", "SELECT 'k' || object AS result FROM ev WHERE subject = 3 AND object IS NOT NULL")
dsl("both", "g.V('u7').both('parentSubject').id()", "SELECT 'u3' AS result UNION ALL SELECT 'u' || subject FROM su WHERE subject // 2 = 7", with_=f"{EV}, {SUBJECTS}")
dsl("any_label", "g.V('u7').out().id()", "SELECT dst AS result FROM ed WHERE src = 'u7'", with_=EDGES)
dsl("out_e_in_v", "g.V('u7').inE('subject').outV().count()", "SELECT count(*) AS result FROM ev WHERE subject = 7", "bigint")
dsl("both_e", "g.V('u7').bothE('parentSubject').id()", "SELECT src || '|' || label || '|' || dst AS result FROM ed WHERE label = 'parentSubject' AND 'u7' IN (src, dst)", with_=EDGES)
dsl("match", "g.V().hasLabel('AdmSubject').has('cid',lte(20)).match(_.as('a').out('parentSubject').as('b'),_.as('b').out('parentSubject').as('c'),_.as('a').out('localPrincipal').as('p'))",
    "SELECT 'a=u' || subject || ',b=u' || (subject // 2) || ',c=u' || (subject // 4) || ',p=c' || subject AS result FROM su WHERE subject BETWEEN 2 AND 20 AND subject IN (SELECT c_custkey FROM customer)", with_=f"{EV}, {SUBJECTS}")
dsl("repeat_times", "g.V().hasLabel('AdmSubject').repeat(_.out('parentSubject')).times(3).id()", "SELECT 'u' || (subject // 8) AS result FROM su WHERE subject >= 4", with_=f"{EV}, {SUBJECTS}")
dsl("repeat_until", "g.V('u100').repeat(_.out('parentSubject')).until(_.has('cid',lte(6))).id()", "SELECT 'u6' AS result")
dsl("until_repeat", "g.V().hasLabel('AdmSubject').has('cid',gte(100)).until(_.has('cid',lte(3))).repeat(_.out('parentSubject')).id()",
    "SELECT 'u' || CASE WHEN subject >= 128 THEN subject // 64 ELSE subject // 32 END AS result FROM su WHERE subject >= 100", with_=f"{EV}, {SUBJECTS}")
dsl("repeat_emit", "g.V('u77').emit().repeat(_.out('parentSubject')).times(4).id()", "SELECT unnest(['u77', 'u38', 'u19', 'u9', 'u4']) AS result")
dsl("ancestors", "g.V().hasLabel('AdmSubject').repeat(_.out('parentSubject')).emit().times(8).dedup().count()",
    "SELECT count(DISTINCT subject // 2) AS result FROM su WHERE subject > 0", "bigint", f"{EV}, {SUBJECTS}")
dsl("simple_path", "g.V('u9').both('parentSubject').both('parentSubject').simplePath().path()",
    "SELECT 'u9,' || a.o || ',' || b.o AS result FROM (SELECT CASE WHEN src = 'u9' THEN dst ELSE src END AS o FROM ed WHERE label = 'parentSubject' AND 'u9' IN (src, dst)) a JOIN LATERAL (SELECT CASE WHEN src = a.o THEN dst ELSE src END AS o FROM ed WHERE label = 'parentSubject' AND a.o IN (src, dst)) b ON b.o <> 'u9'", with_=EDGES)
dsl("unroll_path", "g.V('u40').out('parentSubject').out('localPrincipal').out('host').unrollPath().count()", "SELECT count(*) * 4 AS result FROM customer WHERE c_custkey = 20", "bigint")
dsl("local_count", "g.V().hasLabel('AdmSubject').local(_.in('subject').count())", "SELECT count(*) AS result FROM ev GROUP BY subject", "bigint")
dsl("union", "g.V('u9').union(_.in('subject'),_.out('parentSubject')).id()", "SELECT 'e' || event_id AS result FROM ev WHERE subject = 9 UNION ALL SELECT 'u4'")
dsl("choose_option", "g.V().hasLabel('AdmEvent').choose(_.values('eventType')).option('EVENT_FORK',_.out('subject')).option('EVENT_UNLINK',_.out('predicateObject')).id()",
    "SELECT 'u' || subject AS result FROM ev WHERE kind = 'EVENT_FORK' UNION ALL SELECT 'k' || object FROM ev WHERE kind = 'EVENT_UNLINK' AND object IS NOT NULL")
dsl("sum_min_max", "g.V().values('cid').union(_.max(),_.min(),_.sum())", "SELECT unnest([max(subject), min(subject), sum(subject)]) AS result FROM su", "bigint", f"{EV}, {SUBJECTS}")
dsl("count_empty", "g.V().hasLabel('Nothing').count()", "SELECT CAST(0 AS BIGINT) AS result", "bigint")
dsl("group_count_by", "g.V().hasLabel('AdmEvent').groupCount().by('eventType')", "SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS result FROM (SELECT kind, count(*) AS n FROM ev GROUP BY kind)")
dsl("group_by", "g.V().hasLabel('AdmSubject').has('cid',lte(15)).group().by(_.out('parentSubject').values('cid'))",
    "SELECT string_agg(k || '=' || l, ',' ORDER BY k) AS result FROM (SELECT CAST(subject // 2 AS VARCHAR) AS k, string_agg('u' || subject, '+' ORDER BY 'u' || subject) AS l FROM su WHERE subject BETWEEN 1 AND 15 GROUP BY 1)", with_=f"{EV}, {SUBJECTS}")
dsl("fold", "g.V().values('hostName').fold()", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS result FROM nation")
dsl("fold_unfold", "g.V().hasLabel('AdmHost').id().fold().unfold()", "SELECT 'n' || n_nationkey AS result FROM nation")
dsl("aggregate_dedup", "g.V().hasLabel('AdmEvent').aggregate('x').out('subject').dedup().id()", "SELECT DISTINCT 'u' || subject AS result FROM ev")
dsl("order_limit", "g.V().hasLabel('AdmEvent').order().by(_.values('earliestTimestampNanos'),decr).limit(25).id()", "SELECT 'e' || event_id AS result FROM ev ORDER BY nanos DESC, 'e' || event_id LIMIT 25")
dsl("order_values", "g.V().values('hostName').order().limit(5)", "SELECT n_name AS result FROM nation ORDER BY n_name LIMIT 5")
dsl("property", "g.V().hasLabel('AdmHost').property('username','root').has('username','root').count()", "SELECT count(*) AS result FROM nation", "bigint")
dsl("statements", "top = 145; hot = g.V().hasLabel('AdmSubject').has('cid',gte(top)); g.V(hot).in('subject').count()", "SELECT count(*) AS result FROM ev WHERE subject >= 145", "bigint")
dsl("discarded_statement", "g.V().hasLabel('AdmHost').property('username','x'); g.V().hasLabel('AdmHost').toList().count()", "SELECT count(*) AS result FROM nation", "bigint")
dsl("provenance", "g.V('k5').in('predicateObject').out('subject').dedup().out('localPrincipal').out('host').values('hostName').groupCount()",
    "SELECT string_agg(n_name || '=' || n, ',' ORDER BY n_name) AS result FROM (SELECT n_name, count(*) AS n FROM (SELECT DISTINCT subject FROM ev WHERE object = 5) JOIN customer ON c_custkey = subject JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)")

# What later steps see of earlier ones
dsl("property_new_key", "g.V().hasLabel('AdmHost').property('owner','root'); g.V().has('owner','root').values('owner').groupCount()", "SELECT 'root=' || count(*) AS result FROM nation")
dsl("property_new_number", "g.V().hasLabel('AdmHost').property('rank',7).has('rank',gte(7)).count()", "SELECT count(*) AS result FROM nation", "bigint")
dsl("select_number", "g.V().hasLabel('AdmSubject').values('cid').as('x').select('x').is(gte(5)).max()", "SELECT max(subject) AS result FROM su WHERE subject >= 5", "bigint", f"{EV}, {SUBJECTS}")
dsl("order_two_keys", "g.V().hasLabel('AdmEvent').order().by('eventType',decr).by('earliestTimestampNanos').limit(30).id()", "SELECT 'e' || event_id AS result FROM ev ORDER BY kind DESC, nanos, 'e' || event_id LIMIT 30")
dsl("group_by_value", "g.V().hasLabel('AdmEvent').has('eventType','EVENT_FORK').group().by(_.out('subject').id()).by('earliestTimestampNanos')",
    "SELECT string_agg(k || '=' || l, ',' ORDER BY k) AS result FROM (SELECT 'u' || subject AS k, string_agg(CAST(nanos AS VARCHAR), '+' ORDER BY CAST(nanos AS VARCHAR)) AS l FROM ev WHERE kind = 'EVENT_FORK' GROUP BY 1)")
dsl("path_by", "g.V().hasLabel('AdmEvent').has('eventType','EVENT_FORK').out('subject').out('localPrincipal').path().by('eventType').by('cid').by('username')",
    "SELECT kind || ',' || subject || ',' || c_name AS result FROM ev JOIN customer ON c_custkey = subject WHERE kind = 'EVENT_FORK'")
dsl("has_uuid", "g.V().has('uuid','u3').out('localPrincipal').id()", "SELECT 'c3' AS result WHERE 3 IN (SELECT subject FROM ev) AND 3 IN (SELECT c_custkey FROM customer)")

# Questions that an analyst asks of a node: what touched it, who, on whose behalf and what that led to
_WRITES = "within(['EVENT_WRITE','EVENT_UNLINK'])"
_READS = "within(['EVENT_READ','EVENT_EXECUTE'])"
#: A process and those that started it, up to the first.
_LINE = "emit().repeat(_.out('parentSubject'))"
_ANC = ", an(s) AS (SELECT DISTINCT subject FROM ev WHERE object = 7 AND kind IN ('EVENT_WRITE', 'EVENT_UNLINK') UNION SELECT s // 2 FROM an WHERE s > 0 AND s IN (SELECT subject FROM ev))"
dsl("ui_file_events", "g.V('k7').union(_.in('predicateObject'),_.in('predicateObject2')).id()", "SELECT 'e' || event_id AS result FROM ev WHERE object = 7")
dsl("ui_subjects_reading", "g.V('k7').in('predicateObject').has('eventType','EVENT_READ').out('subject').id()", "SELECT 'u' || subject AS result FROM ev WHERE object = 7 AND kind = 'EVENT_READ'")
dsl("ui_subjects_executing", "g.V('k7').in('predicateObject').has('eventType','EVENT_EXECUTE').out('subject').dedup().id()", "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE object = 7 AND kind = 'EVENT_EXECUTE'")
dsl("ui_affected_by", f"g.V('k7').in('predicateObject').has('eventType',{_WRITES}).out('subject').id()", "SELECT 'u' || subject AS result FROM ev WHERE object = 7 AND kind IN ('EVENT_WRITE', 'EVENT_UNLINK')")
dsl("ui_affects", f"g.V('k7').in('predicateObject').has('eventType',{_READS}).out('subject').id()", "SELECT 'u' || subject AS result FROM ev WHERE object = 7 AND kind IN ('EVENT_READ', 'EVENT_EXECUTE')")
dsl("ui_direct_causality", f"g.V('k7').union(_,_.in('predicateObject').has('eventType',{_WRITES}).out('subject').{_LINE}).dedup().id()",
    "SELECT 'k7' AS result WHERE 7 IN (SELECT object FROM ev) UNION ALL SELECT 'u' || s FROM an WHERE s IN (SELECT subject FROM ev)", with_=EV + _ANC)
dsl("ui_files_of_causes", f"g.V('k7').in('predicateObject').has('eventType',{_WRITES}).out('subject').{_LINE}.dedup().in('subject').hasLabel('AdmEvent').has('eventType',{_READS}).out('predicateObject').dedup().id()",
    "SELECT DISTINCT 'k' || object AS result FROM ev WHERE object IS NOT NULL AND kind IN ('EVENT_READ', 'EVENT_EXECUTE') AND subject IN (SELECT s FROM an)", with_=EV + _ANC)
dsl("ui_events_caused", "g.V('u5').in('subject').hasLabel('AdmEvent').id()", "SELECT 'e' || event_id AS result FROM ev WHERE subject = 5")
dsl("ui_files_affected", "g.V('u5').in('subject').out('predicateObject').hasLabel('AdmFileObject').id()", "SELECT 'k' || object AS result FROM ev WHERE subject = 5 AND object IS NOT NULL")
dsl("ui_principal", "g.V('u5').out('localPrincipal').values('username')", "SELECT c_name AS result FROM customer WHERE c_custkey = 5 AND 5 IN (SELECT subject FROM ev)")
dsl("ui_parent_process", "g.V('u5').out('parentSubject').id()", "SELECT 'u2' AS result WHERE 5 IN (SELECT subject FROM ev)")
dsl("ui_child_processes", "g.V('u5').in('parentSubject').id()", "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE subject // 2 = 5")
_UP5 = ", up(s) AS (SELECT 5 WHERE 5 IN (SELECT subject FROM ev) UNION ALL SELECT s // 2 FROM up WHERE s > 0 AND s // 2 IN (SELECT subject FROM ev))"
dsl("ui_subject_causality", f"g.V('u5').{_LINE}.union(_,_.in('subject').has('eventType',{_READS}).out('predicateObject')).dedup().id()",
    "SELECT 'u' || s AS result FROM up UNION SELECT 'k' || object FROM ev WHERE subject IN (SELECT s FROM up) AND object IS NOT NULL AND kind IN ('EVENT_READ', 'EVENT_EXECUTE')", with_=EV + _UP5)
dsl("ui_provenance", "g.V('u5').union(_,_.out('localPrincipal'),_.in('subject').has('eventType','EVENT_EXECUTE').out('predicateObject')).dedup().id()",
    "SELECT 'u5' AS result WHERE 5 IN (SELECT subject FROM ev) UNION SELECT 'c5' WHERE 5 IN (SELECT subject FROM ev) AND 5 IN (SELECT c_custkey FROM customer) UNION SELECT 'k' || object FROM ev WHERE subject = 5 AND kind = 'EVENT_EXECUTE' AND object IS NOT NULL")
dsl("aggregate_bag", "readers = g.V().hasLabel('AdmEvent').has('eventType','EVENT_READ').out('subject').dedup().aggregate('seen'); g.V().hasLabel('AdmEvent').has('eventType','EVENT_WRITE').out('subject').dedup().where(within('seen')).id()",
    "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE kind = 'EVENT_WRITE' AND subject IN (SELECT subject FROM ev WHERE kind = 'EVENT_READ')")
dsl("aggregate_source", "xs = g.V().hasLabel('AdmFileObject').in('predicateObject').has('eventType','EVENT_UNLINK').out('subject').aggregate('deleters').out('localPrincipal'); g.V(deleters).hasLabel('AdmSubject').id()",
    "SELECT DISTINCT 'u' || subject AS result FROM ev WHERE kind = 'EVENT_UNLINK' AND object IS NOT NULL")
dsl("ui_principal_processes", "g.V('c5').in('localPrincipal').id()", "SELECT 'u5' AS result WHERE 5 IN (SELECT subject FROM ev) AND 5 IN (SELECT c_custkey FROM customer)")
dsl("ui_host_principals", "g.V('n3').in('host').id()", "SELECT 'c' || c_custkey AS result FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT subject FROM ev)")
_DOWN = ", dn(s) AS (SELECT 2 WHERE 2 IN (SELECT subject FROM ev) UNION SELECT DISTINCT subject FROM ev JOIN dn ON subject // 2 = s AND subject > 0)"
dsl("ui_descendants", "g.V('u2').emit().repeat(_.in('parentSubject')).dedup().id()", "SELECT 'u' || s AS result FROM dn", with_=EV + _DOWN)
dsl("ui_files_of_descendants", "g.V('u2').emit().repeat(_.in('parentSubject')).dedup().in('subject').has('eventType','EVENT_WRITE').out('predicateObject').dedup().id()",
    "SELECT DISTINCT 'k' || object AS result FROM ev WHERE subject IN (SELECT s FROM dn) AND kind = 'EVENT_WRITE' AND object IS NOT NULL", with_=EV + _DOWN)
dsl("ui_readers_of_written", "g.V('u5').as('me').in('subject').has('eventType','EVENT_WRITE').out('predicateObject').in('predicateObject').has('eventType','EVENT_READ').out('subject').where(neq('me')).dedup().id()",
    "SELECT DISTINCT 'u' || r.subject AS result FROM ev w JOIN ev r ON r.object = w.object WHERE w.subject = 5 AND w.kind = 'EVENT_WRITE' AND r.kind = 'EVENT_READ' AND r.subject <> 5")
dsl("ui_shared_files", "g.V('u5').in('subject').out('predicateObject').dedup().where(_.in('predicateObject').out('subject').hasId('u2')).id()",
    "SELECT DISTINCT 'k' || object AS result FROM ev WHERE subject = 5 AND object IN (SELECT object FROM ev WHERE subject = 2)")
dsl("ui_files_of_host", "g.V('n3').in('host').in('localPrincipal').in('subject').out('predicateObject').dedup().id()",
    "SELECT DISTINCT 'k' || object AS result FROM ev JOIN customer ON c_custkey = subject WHERE c_nationkey = 3 AND object IS NOT NULL")
dsl("ui_latest_events", "g.V('u5').in('subject').order().by('latestTimestampNanos',decr).limit(5).id()", "SELECT 'e' || event_id AS result FROM (SELECT event_id FROM ev WHERE subject = 5 ORDER BY nanos DESC, 'e' || event_id LIMIT 5)")
dsl("ui_quiet_files", "g.V().hasLabel('AdmFileObject').not(_.in('predicateObject').has('eventType','EVENT_WRITE')).id()",
    "SELECT DISTINCT 'k' || object AS result FROM ev WHERE object IS NOT NULL AND object NOT IN (SELECT object FROM ev WHERE kind = 'EVENT_WRITE' AND object IS NOT NULL)")
