"""Queries on rule-based arguments, graphs, linking and candidate edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.functions import canonical_json as J
from logosmill.operators import graphs as G
from logosmill.operators import linking as L
from logosmill.operators import structured as A
from logosmill.operators import substrate as S
from logosmill.plans.argumentation_queries import frameworks
from logosmill.session import table

CONCEPTS = [  # curie, surface, case_sensitive, match_policy, anchors, negative, anchor_window
    ("c:vote", "vote", False, "unambiguous", [], [], 10), ("c:remote", "remote voting", False, "unambiguous", [], [], 10), ("c:voting", "voting", False, "unambiguous", [], [], 10),
    ("c:burden", "burden of proof", False, "unambiguous", [], ["moved"], 10), ("c:precedent", "precedent", False, "context_anchored", ["river", "school"], [], 20),
    ("c:precedent2", "precedent", False, "context_anchored", ["river"], [], 20), ("c:annex", "Annex", True, "case_exact", [], [], 10), ("c:the", "the", False, "never_link", [], [], 10),
]


def concept_index(spark):
    return spark.createDataFrame(CONCEPTS, "curie string, surface string, case_sensitive boolean, match_policy string, anchors array<string>, negative array<string>, anchor_window int")


def concept_links(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = L.link_concepts(docs, concept_index(spark))
    return out.select("doc_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("stop_pos").cast("bigint").alias("stop_pos"), "surface", "curies", "resolution")


def concept_coverage(spark, d):
    """Documents and mentions per concept that never depends on its context."""
    plain = concept_index(spark).where("match_policy = 'unambiguous'")
    out = L.link_concepts(table(spark, d, "documents").select("doc_id", "text"), plain)
    return out.groupBy("curies").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def rule_theories(spark, d):
    """A theory per order: its lines are premises, flags and statuses rules, with preferences by line."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(line)).alias("ls"))
    prem = F.transform("ls", lambda x: F.concat(F.lit('"p'), x["n"].cast("string"), F.lit('"')))
    rules = F.transform("ls", lambda x: F.concat(F.lit('["r'), x["n"].cast("string"), F.lit('",["p'), x["n"].cast("string"), F.lit('"],"'), F.when(x["f"] == "R", "~ok").otherwise("ok"), F.lit('"]')))
    pref = F.filter(F.transform("ls", lambda x: F.when(x["n"] > 1, F.concat(F.lit('["r1","r'), x["n"].cast("string"), F.lit('"]')))), lambda x: x.isNotNull())
    text = F.concat(F.lit('{"premises":['), F.array_join(prem, ","), F.lit('],"defeasible_rules":['), F.array_join(rules, ","), F.lit('],"rule_preferences":['), F.array_join(pref, ","), F.lit("]}"))
    return o.select(F.col("l_orderkey").cast("string").alias("theory_id"), text.alias("theory"))


def structured_defeats(spark, d):
    out = A.evaluated(rule_theories(spark, d))
    return out.groupBy("theory_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in ("argument", "attack", "defeat")])


def theory_frameworks(spark, d):
    """The defeat graph of every theory as an abstract framework: its arguments and attacks."""
    args, attacks = A.framework(A.evaluated(rule_theories(spark, d)))
    n = args.groupBy("af_id").agg(F.count("*").alias("arguments"), F.max("ord").cast("bigint").alias("last"))
    return n.join(attacks.groupBy("af_id").agg(F.count("*").alias("attacks")), "af_id", "left").select("af_id", "arguments", "last", F.coalesce("attacks", F.lit(0)).alias("attacks"))


def attack_cycles(spark, d):
    """Attacks on or between cycles of the derived frameworks."""
    _, attacks = frameworks(spark, d)
    return G.cyclic_edges(attacks.select(F.col("af_id").alias("graph_id"), "src", "dst").where("src <> dst"))


def attack_components(spark, d):
    args, attacks = frameworks(spark, d)
    return G.components(args.select(F.col("af_id").alias("graph_id"), F.col("arg").alias("node")), attacks.select(F.col("af_id").alias("graph_id"), "src", "dst"))


def edge_candidates(spark, d):
    """Pairs of an order's lines with a returned one on either side."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("node_id")).agg(F.min("l_returnflag").alias("f")).withColumn("pos", F.col("node_id") * 3)
    out = L.candidates(lines.select("l_orderkey", "node_id", "pos"), lines.where("f = 'R'").select("l_orderkey", "node_id"), "l_orderkey")
    return out.select("l_orderkey", "source_id", "target_id", F.round("distance", 6).alias("distance"))


def edge_decoding(spark, d):
    """Decisions on scored edges, scores by arithmetic."""
    e = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") % 3).alias("source_id"), (F.col("l_suppkey") % 3).alias("target_id"), (F.col("l_partkey") % 4).cast("string").alias("relation"),
        (F.col("l_partkey") % 10 / 10.0).alias("edge_p"), (F.col("l_suppkey") % 7 / 7.0).alias("relation_p"), (F.col("l_returnflag") != "N").alias("signal"))
    return L.decoded_edges(e.distinct(), "l_orderkey", 0.1).groupBy("decision").agg(F.count("*").alias("n"))


def aligned_findings(spark, d):
    """Cue mentions on the sections they stand in."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = S.occurrences(docs, "[12][0-9]{3}").select("doc_id", F.concat("found", F.lit("@"), "start_pos").alias("finding_id"), "start_pos", "stop_pos")
    items = S.sections(docs).select("doc_id", F.concat(F.lit("/block["), "section_no", F.lit("]")).alias("path"), "start_pos", "stop_pos")
    return L.aligned(found, items, "doc_id")


def canonical_payloads(spark, d):
    """Digest and length of each event's canonical properties."""
    c = J.canonical_column(F.col("props"))
    return table(spark, d, "events").select("event_id", c.alias("c")).select("event_id", F.length("c").alias("n"), F.sha2("c", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (
    concept_links, concept_coverage, structured_defeats, theory_frameworks, attack_cycles, attack_components, edge_candidates, edge_decoding, aligned_findings, canonical_payloads)}

_ATT = """l AS (SELECT l_orderkey AS g, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
e AS (SELECT DISTINCT a.g, CAST(a.i AS VARCHAR) AS src, CAST(b.i AS VARCHAR) AS dst FROM l a JOIN l b USING (g) WHERE (a.p + b.s) % 4 = 0 AND (a.i <> b.i OR a.p % 11 = 0))"""
_TOKENS = "[A-Za-z0-9_.+-]+"


def _concept_sql(entries):
    """SQL of concept links: places, boundaries, windows of tokens, and the choice as a recursion over sorted spans."""
    listed = lambda xs: "[" + ", ".join(f"'{x.lower()}'" for x in xs) + "]::VARCHAR[]"
    index = ", ".join(f"('{c}', '{x.lower()}', '{x}', {str(exact or policy == 'case_exact').lower()}, {str(policy == 'context_anchored').lower()}, {listed(anchors)}, {listed(negative)}, {window})"
                      for c, x, exact, policy, anchors, negative, window in entries if policy != "never_link")
    return rf"""WITH RECURSIVE ix(curie, low, surface, exact, anchored, anchors, negative, win) AS (VALUES {index}),
d AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE length(lower(text)) = length(text)),
f AS (SELECT doc_id, low, list_transform(string_split(t, low), lambda x: length(x)) AS g FROM d, (SELECT DISTINCT low FROM ix) WHERE contains(t, low)),
p AS (SELECT doc_id, low, CAST(list_sum(g[1:i]) + length(low) * (i - 1) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(g))) AS i FROM f)),
m AS (SELECT p.*, a + length(low) AS b, text, t FROM p JOIN d USING (doc_id) WHERE NOT regexp_matches(substr(t, a + length(low) + 1, 2), '^\.?[\p{{L}}\p{{N}}]')
  AND (a = 0 OR NOT regexp_matches(substr(t, a, 1), '[\p{{L}}\p{{N}}]')) AND (a < 2 OR NOT regexp_matches(substr(t, a - 1, 2), '[\p{{L}}\p{{N}}]-'))),
c AS (SELECT *, regexp_replace(substr(text, 1, a), '{_TOKENS}$', '') AS l, regexp_replace(substr(text, b + 1), '^{_TOKENS}', '') AS r FROM m),
w AS (SELECT *, regexp_extract_all(l, '{_TOKENS}') AS lt, regexp_extract_all(r, '{_TOKENS}') AS rt,
  lower(regexp_extract(l, '((?:{_TOKENS}[^A-Za-z0-9_.+-]*){{0,25}})$') || substr(text, length(l) + 1, length(text) - length(l) - length(r)) || regexp_extract(r, '^((?:[^A-Za-z0-9_.+-]*{_TOKENS}){{0,25}})')) AS zone FROM c),
e AS (SELECT w.*, curie, lower(array_to_string(lt[greatest(1, len(lt) - win + 1):], ' ') || ' ' || array_to_string(rt[1:win], ' ')) AS ctx, anchored, anchors, negative FROM w JOIN ix USING (low) WHERE NOT exact OR substr(text, a + 1, length(low)) = surface),
ok AS (SELECT * FROM e WHERE NOT coalesce(list_bool_or(list_transform(negative, lambda n: regexp_matches(zone, '(?:^|[^\p{{L}}\p{{N}}])' || n || '(?:$|[^\p{{L}}\p{{N}}])'))), false)
  AND (NOT anchored OR coalesce(list_bool_or(list_transform(anchors, lambda n: regexp_matches(ctx, '(?:^|[^\p{{L}}\p{{N}}])' || n || '(?:$|[^\p{{L}}\p{{N}}])'))), false))),
s AS (SELECT doc_id, a, b, any_value(substr(text, a + 1, length(low))) AS surface, string_agg(DISTINCT curie, ',' ORDER BY curie) AS curies, count(DISTINCT curie) AS n FROM ok GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, a - b) AS k FROM s),
z AS (SELECT doc_id, k, b AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.a >= z.last THEN o.b ELSE z.last END, o.a >= z.last FROM z JOIN o ON o.doc_id = z.doc_id AND o.k = z.k + 1)
SELECT doc_id, a AS start_pos, b AS stop_pos, surface, curies, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution FROM o JOIN z USING (doc_id, k) WHERE kept"""


ORACLES = {
    "concept_links": _concept_sql(CONCEPTS),
    "structured_defeats": """WITH l AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS i, l_returnflag AS f FROM lineitem),
n AS (SELECT g, i, count(*) AS c, bool_or(f <> 'R') AS pro, bool_or(f = 'R') AS con FROM l GROUP BY 1, 2),
x AS (SELECT g, sum(c) AS k, coalesce(sum(c) FILTER (pro), 0) AS pro, coalesce(sum(c) FILTER (con), 0) AS con, coalesce(sum(c) FILTER (pro AND i = 1), 0) AS pro1, coalesce(sum(c) FILTER (con AND i = 1), 0) AS con1 FROM n GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS theory_id, CAST(k + pro + con AS BIGINT) AS arguments, CAST(2 * pro * con AS BIGINT) AS attacks, CAST(2 * pro * con - pro1 * (con - con1) - con1 * (pro - pro1) AS BIGINT) AS defeats FROM x""",
    "aligned_findings": r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\n\s*\n)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
e AS (SELECT doc_id, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)),
o AS (SELECT doc_id, i, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(regexp_extract(x, '^\s*')) AS a, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS n FROM e),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, a, a + n AS b FROM o WHERE n > 0),
y AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[12][0-9]{3}'), lambda x: length(x)) AS g, regexp_extract_all(text, '[12][0-9]{3}') AS m FROM documents),
f AS (SELECT doc_id, CAST(list_sum(g[1:i]) + 4 * (i - 1) AS BIGINT) AS a, m[i] AS m FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM y))
SELECT f.doc_id, '/block[' || k || ']' AS path, string_agg(m || '@' || f.a, ',' ORDER BY f.a) AS findings FROM f JOIN u ON u.doc_id = f.doc_id AND f.a < u.b AND u.a < f.a + 4 GROUP BY 1, 2""",
    "concept_coverage": f"SELECT curies, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM ({_concept_sql([e for e in CONCEPTS if e[3] == 'unambiguous'])}) GROUP BY 1",
    "attack_cycles": f"""WITH RECURSIVE {_ATT}, x AS (SELECT * FROM e WHERE src <> dst), r AS (SELECT g, src, dst FROM x UNION SELECT r.g, r.src, x.dst FROM r JOIN x ON x.g = r.g AND x.src = r.dst),
c AS (SELECT g, src AS n FROM r WHERE src = dst)
SELECT g AS graph_id, src, dst FROM x WHERE (EXISTS (SELECT 1 FROM c WHERE c.g = x.g AND (c.n = x.src OR (x.g, c.n, x.src) IN (SELECT * FROM r)))) AND EXISTS (SELECT 1 FROM c WHERE c.g = x.g AND (c.n = x.dst OR (x.g, x.dst, c.n) IN (SELECT * FROM r)))""",
    "attack_components": f"""WITH RECURSIVE {_ATT}, b AS (SELECT g, src, dst FROM e UNION SELECT g, dst, src FROM e UNION SELECT g, CAST(i AS VARCHAR), CAST(i AS VARCHAR) FROM l), r AS (SELECT * FROM b UNION SELECT r.g, r.src, b.dst FROM r JOIN b ON b.g = r.g AND b.src = r.dst)
SELECT g AS graph_id, src AS node, min(dst) AS component FROM r GROUP BY 1, 2""",
    "edge_candidates": """WITH l AS (SELECT l_orderkey, l_linenumber AS i, min(l_returnflag) = 'R' AS s FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, a.i AS source_id, b.i AS target_id, round(sign(b.i - a.i) * ln(1 + abs(3 * (b.i - a.i))), 6) AS distance FROM l a JOIN l b USING (l_orderkey) WHERE a.i <> b.i AND (a.s OR b.s)""",
    "edge_decoding": """WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS a, l_suppkey % 3 AS b, l_partkey % 4 AS r, (l_partkey % 10 / 10.0) AS p, (l_suppkey % 7 / 7.0) AS q, l_returnflag <> 'N' AS s FROM lineitem),
j AS (SELECT *, p * q AS j, CASE WHEN a = b THEN 'self_loop' WHEN p * q < 0.1 THEN 'below_threshold' WHEN NOT s THEN 'no_signal' END AS reason FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, a, b, reason IS NULL ORDER BY j DESC, r) AS n FROM j)
SELECT coalesce(reason, CASE WHEN n = 1 THEN 'accepted' ELSE 'duplicate_pair' END) AS decision, count(*) AS n FROM k GROUP BY 1""",
}

ORACLES["theory_frameworks"] = f"SELECT theory_id AS af_id, arguments, arguments AS last, defeats AS attacks FROM ({ORACLES['structured_defeats']})"
