"""Dialogue queries: events as speech acts, orders as deliberation maps, documents' sentences as utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.operators import dialogue as D
from logosmill.plans.argumentation_queries import _ibis
from logosmill.session import table

TYPES = ["click", "view", "purchase", "signup", "logout", "error", "refund"]


def acts(spark, d):
    """Each event is an act of its user about one of four claims, affirmed or denied."""
    e = F.col("event_id")
    claim = F.when(e % 4 < 3, F.concat(F.lit("Plan "), (F.floor(e / 7) % 3).cast("string"), F.when(F.floor(e / 3) % 2 == 0, " is  sound.").otherwise(" is not sound"))).otherwise(
        F.concat(F.when(F.floor(e / 5) % 2 == 0, "not ").otherwise(""), F.lit("the rate rose")))
    op = F.when(e % 6 < 3, "assert").when(e % 6 == 3, "concede").when(e % 6 == 4, "retract").otherwise("challenge")
    return table(spark, d, "events").select(
        F.col("user_id").alias("conv"), F.col("user_id").alias("speaker"), e.alias("ord"), e.alias("act_id"), op.alias("op"), claim.alias("content"), claim.alias("target"))


def active_commitments(spark, d):
    return D.active_commitments(acts(spark, d)).select("speaker", "key", "act_id")


def commitment_conflicts(spark, d):
    return D.commitment_conflicts(acts(spark, d)).select("speaker", "earlier_act", "later_act")


def _map(spark, d):
    nodes, links = _ibis(spark, d)
    return nodes.select(F.col("af_id").alias("map_id"), F.col("node_id").alias("id"), "kind"), links.withColumnRenamed("af_id", "map_id")


def ibis_violations(spark, d):
    """The maps of customers, with one kind of argument linked straight to the issue."""
    nodes, links = _map(spark, d)
    wrong = links.where("relation = 'responds_to'").select("map_id", "source", F.lit("supports").alias("relation"), F.col("source").alias("target"))
    return D.ibis_violations(nodes, links.unionByName(wrong.where("map_id % 50 = 1"))).distinct()


def deliberation(spark, d):
    out = D.deliberation_map(*_map(spark, d))
    return out.select("map_id", "issue", "position", F.size(F.coalesce("supporting", F.array())).alias("supporting"), F.size(F.coalesce("objecting", F.array())).alias("objecting"))


def event_type_counts(spark, d):
    return D.type_counts(table(spark, d, "events"), ["user_id"], "event_type", TYPES)


def question_rollup(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "open").when(F.col("l_returnflag") == "A", "addressed").otherwise("not_assessable").alias("status"))
    return D.question_rollup(q, ["l_orderkey"])


def _mentions(spark, d):
    """Words after a determiner, per line-separated utterance; roles by place."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?]\s+")).alias("u", "s"))
    found = F.regexp_extract_all(F.lower("s"), F.lit(r"(?:^|\s)(?:the|this|that|every|la|der|die)\s+([a-z]+)"), F.lit(1))
    m = lines.select("doc_id", "u", F.posexplode(found).alias("p", "entity"))
    m = m.select("doc_id", "u", "entity", F.when(F.col("p") == 0, "S").when(F.col("p") == 1, "O").otherwise("X").alias("role"), F.col("p").alias("start_pos"))
    return lines.select("doc_id", "u"), m


def _transitions(spark, d):
    lines, m = _mentions(spark, d)
    return D.transitions(lines.join(D.forward_centers(m), ["doc_id", "u"], "left").select("doc_id", "u", F.coalesce("cf", F.array().cast("array<string>")).alias("cf")))


def centering_transitions(spark, d):
    return _transitions(spark, d).select("doc_id", F.col("u").cast("bigint").alias("u"), F.array_join("cf", ",").alias("cf"), "cp", "cb", "transition")


def centering_coherence(spark, d):
    return D.coherence(_transitions(spark, d)).select("doc_id", "utterances", "continue", "retain", "smooth_shift", "rough_shift", "zero_cb", F.round("coherence", 3).alias("coherence"))


QUERIES = {f.__name__: f for f in (
    active_commitments, commitment_conflicts, ibis_violations, deliberation, event_type_counts, question_rollup, centering_transitions, centering_coherence)}

_ACTS = """
a AS (SELECT user_id AS speaker, event_id AS ord, CASE WHEN event_id % 6 < 3 THEN 'assert' WHEN event_id % 6 = 3 THEN 'concede' WHEN event_id % 6 = 4 THEN 'retract' ELSE 'challenge' END AS op,
CASE WHEN event_id % 4 < 3 THEN concat('plan ', event_id // 7 % 3, CASE WHEN event_id // 3 % 2 = 0 THEN ' is sound' ELSE ' is not sound' END)
ELSE concat(CASE WHEN event_id // 5 % 2 = 0 THEN 'not ' ELSE '' END, 'the rate rose') END AS key FROM events),
s AS (SELECT x.speaker, x.key, x.ord, (SELECT min(r.ord) FROM a r WHERE r.speaker = x.speaker AND r.key = x.key AND r.op = 'retract' AND r.ord > x.ord) AS stop FROM a x WHERE x.op IN ('assert', 'concede')),
live AS (SELECT speaker, key, stop, min(ord) AS act_id FROM s GROUP BY ALL)"""
_NEG = "CASE WHEN key LIKE '% is not %' THEN replace(key, ' is not ', ' is ') WHEN key LIKE '% is %' THEN replace(key, ' is ', ' is not ') WHEN key LIKE 'not %' THEN substring(key, 5) ELSE 'not ' || key END"
_CENTER = r"""
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS s, unnest(range(len(regexp_split_to_array(text, '[.!?]\s+')))) AS u FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, u, unnest(regexp_extract_all(lower(s), '(?:^|\s)(?:the|this|that|every|la|der|die)\s+([a-z]+)', 1)) AS entity, unnest(range(len(regexp_extract_all(lower(s), '(?:^|\s)(?:the|this|that|every|la|der|die)\s+([a-z]+)', 1)))) AS p FROM l),
b AS (SELECT doc_id, u, entity, min(p) AS p FROM m GROUP BY ALL),
c AS (SELECT doc_id, u, list(entity ORDER BY p) AS cf FROM b GROUP BY ALL),
t AS (SELECT l.doc_id, l.u, coalesce(c.cf, []) AS cf FROM l LEFT JOIN c USING (doc_id, u)),
p AS (SELECT *, lag(cf) OVER (PARTITION BY doc_id ORDER BY u) AS prev, cf[1] AS cp FROM t),
q AS (SELECT *, list_filter(prev, lambda x: list_contains(cf, x))[1] AS cb FROM p),
r AS (SELECT *, coalesce(lag(cb) OVER (PARTITION BY doc_id ORDER BY u), prev[1]) AS bef FROM q),
k AS (SELECT *, CASE WHEN u = 0 OR coalesce(len(prev), 0) = 0 THEN CASE WHEN len(cf) > 0 THEN 'establishment' ELSE 'zero_cb' END WHEN cb IS NULL THEN 'zero_cb'
WHEN cb = bef AND cb = cp THEN 'continue' WHEN cb = bef THEN 'retain' WHEN cb = cp THEN 'smooth_shift' ELSE 'rough_shift' END AS transition FROM r)"""
ORACLES = {
    "active_commitments": f"WITH {_ACTS} SELECT speaker, key, act_id FROM live WHERE stop IS NULL",
    "commitment_conflicts": f"WITH {_ACTS}, n AS (SELECT speaker, ord, {_NEG} AS key FROM a WHERE op IN ('assert', 'concede')) SELECT n.speaker, act_id AS earlier_act, n.ord AS later_act FROM n JOIN live USING (speaker, key) WHERE act_id < n.ord AND (stop IS NULL OR n.ord < stop)",
    "ibis_violations": f"""WITH w AS (SELECT o_custkey AS map_id, concat('p', o_orderkey) AS p FROM orders),
dup AS (SELECT o_custkey AS map_id, concat('a', l_orderkey, '_', l_linenumber) AS a, concat('p', l_orderkey) AS p, CASE WHEN l_returnflag = 'R' THEN 'objects_to' ELSE 'supports' END AS rel, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
ids AS (SELECT map_id, a, sum(n) AS n FROM dup GROUP BY ALL)
SELECT DISTINCT * FROM (
SELECT map_id, 'repeated_id' AS rule, a AS detail FROM ids WHERE n > 1 UNION ALL
SELECT map_id, 'repeated_link', concat(a, ' ', rel, ' ', p) FROM dup WHERE n > 1 UNION ALL
SELECT map_id, 'not_attached_once', a FROM ids WHERE n > 1 UNION ALL
SELECT map_id, 'not_attached_once', p FROM w WHERE map_id % 50 = 1 UNION ALL
SELECT map_id, 'self_link', concat(p, ' supports ', p) FROM w WHERE map_id % 50 = 1 UNION ALL
SELECT map_id, 'not_in_grammar', concat(p, ' supports ', p) FROM w WHERE map_id % 50 = 1)""",
    "deliberation": f"""WITH l AS (SELECT l_orderkey, CAST(sum((l_returnflag <> 'R')::INT) AS INT) AS s, CAST(sum((l_returnflag = 'R')::INT) AS INT) AS o FROM lineitem GROUP BY 1)
SELECT o_custkey AS map_id, concat('i', o_custkey) AS issue, concat('p', o_orderkey) AS position, coalesce(s, 0) AS supporting, coalesce(o, 0) AS objecting FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "event_type_counts": "WITH t(event_type) AS (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + "), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL",
    "question_rollup": "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS open, count(*) FILTER (l_returnflag = 'A') AS addressed, count(*) FILTER (l_returnflag = 'N') AS not_assessable FROM lineitem GROUP BY 1",
    "centering_transitions": f"WITH {_CENTER} SELECT doc_id, u, array_to_string(cf, ',') AS cf, cp, cb, transition FROM k",
    "centering_coherence": f"""WITH {_CENTER}, n AS (SELECT doc_id, count(*) AS utterances, count(*) FILTER (transition = 'continue') AS "continue", count(*) FILTER (transition = 'retain') AS retain,
count(*) FILTER (transition = 'smooth_shift') AS smooth_shift, count(*) FILTER (transition = 'rough_shift') AS rough_shift, count(*) FILTER (transition = 'zero_cb') AS zero_cb FROM k GROUP BY 1)
SELECT *, round(round_even(coalesce(("continue" + .75 * retain + .5 * smooth_shift + .15 * rough_shift) / nullif("continue" + retain + smooth_shift + rough_shift + CASE WHEN utterances > 1 THEN zero_cb ELSE 0 END, 0), 1.0), 4), 3) AS coherence FROM n""",
}
