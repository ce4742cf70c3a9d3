"""Pieces of SQL that the twins share."""

#: Events as provenance, the twin of ``operators.graph.event_frame``.
EV = """ev AS (SELECT event_id, epoch_us(ts) * 1000 AS nanos, user_id AS subject, event_type,
 CAST(NULLIF(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT) AS object, value,
 CASE event_type WHEN 'click' THEN 'EVENT_READ' WHEN 'view' THEN 'EVENT_EXECUTE' WHEN 'purchase' THEN 'EVENT_WRITE'
 WHEN 'signup' THEN 'EVENT_FORK' WHEN 'error' THEN 'EVENT_UNLINK' END AS kind FROM events)"""
SUBJECTS = "su AS (SELECT DISTINCT subject FROM ev)"
#: All edges of the event graph.
EDGES = f"""{EV}, {SUBJECTS}, cu AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT subject FROM su)),
ed AS (SELECT 'e' || event_id AS src, 'subject' AS label, 'u' || subject AS dst FROM ev
 UNION ALL SELECT 'e' || event_id, 'predicateObject', 'k' || object FROM ev WHERE object IS NOT NULL
 UNION ALL SELECT 'u' || subject, 'parentSubject', 'u' || (subject // 2) FROM su WHERE subject > 0
 UNION ALL SELECT 'u' || c_custkey, 'localPrincipal', 'c' || c_custkey FROM cu
 UNION ALL SELECT 'c' || c_custkey, 'host', 'n' || c_nationkey FROM cu)"""
