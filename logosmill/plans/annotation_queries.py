"""Queries on typed annotations, entities and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.operators import annotations as N
from logosmill.operators import dialogue as D
from logosmill.operators import entities as E
from logosmill.operators import substrate as S
from logosmill.session import table

CLASSES = ["assertive", "directive", "commissive", "expressive", "declaration"]
FUNCTIONS = ["inform", "question", "promise", "thank", "declare", "answer", "request"]


def act_contracts(spark, d):
    """Events as acts, class and function by arithmetic on ids."""
    pick = lambda names, c: F.get(F.array(*[F.lit(x) for x in names]), c)
    e = F.col("event_id")
    acts = table(spark, d, "events").select(
        e.alias("act_id"), pick(CLASSES, (e % 5).cast("int")).alias("searle_class"), pick(FUNCTIONS, (e % 7).cast("int")).alias("function"),
        F.when(e % 3 == 0, "retract").otherwise("assert").alias("operation"), F.when(e % 4 == 0, F.lit("p")).alias("target"))
    return N.act_violations(acts)


def relation_contracts(spark, d):
    """Line items as relations of seven types."""
    n = F.col("l_linenumber")
    kind = F.get(F.array(*[F.lit(t) for t in N.RELATION_TYPES]), (F.col("l_partkey") % 7).cast("int"))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop")))
    r = table(spark, d, "lineitem").select(
        F.concat("l_orderkey", F.lit("-"), n, F.lit("-"), "l_suppkey", F.lit("-"), "l_partkey").alias("relation_id"), kind.alias("relation_type"),
        F.when(F.col("l_suppkey") % 3 > 0, F.array(F.lit("a"), F.when(F.col("l_suppkey") % 3 == 2, "a").otherwise("b"))).alias("senses"),
        span(n, n + 5).alias("arg1"), span(n * 2, n * 2 + 3).alias("arg2"), F.when(F.col("l_suppkey") % 2 == 0, span(n + 4, n + 6)).alias("connective_spans"),
        F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("and"))).alias("inferred_connectives"), F.when(F.col("l_suppkey") % 7 == 0, span(n, n + 1)).alias("alternative_spans"))
    return N.relation_violations(r).distinct()


def violated_rules(spark, d):
    """Event types of each user in the order they first come."""
    return N.first_seen(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def layout_elements(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.lit("c").alias("claim"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("g"))).otherwise(F.array()).alias("grounds"), F.when(F.col("o_orderkey") % 3 == 0, "w").alias("warrant"),
        F.array().alias("backing"), F.when(F.col("o_orderstatus") == "O", "q").alias("qualifier"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("r"))).otherwise(F.array()).alias("rebuttals"))
    return N.layout_rollup(o, ["o_orderkey"])


def licensed_candidates(spark, d):
    """Line items as candidate edges, relations by part, licensed within five lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.array(*[(F.col("l_partkey") % k).cast("string") for k in (3, 4, 5)]).alias("relations"), F.col("l_linenumber").alias("distance"), (F.col("l_returnflag") == "R").alias("has_signal"))
    inv = table(spark, d, "part").where("p_partkey % 6 < 3").groupBy((F.col("p_partkey") % 6).cast("string").alias("relation")).agg(F.count("*").alias("n"))
    return N.licensed_edges(li, inv, 5).groupBy("relation", "edge_p").agg(F.count("*").alias("n"))


def _outcomes(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("technique"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("result").alias("kind")).distinct()


def combined_outcomes(spark, d):
    return N.combined(_outcomes(spark, d))


def derivable_outcomes(spark, d):
    needs = spark.createDataFrame([("a", "click"), ("a", "view"), ("b", "purchase"), ("b", "never")], "consumer string, technique string")
    return N.derivable(_outcomes(spark, d), needs)


def outcome_views(spark, d):
    kept, _, excluded = N.view(_outcomes(spark, d), _outcomes(spark, d), ["click", "purchase"])
    n = kept.groupBy("doc_id").agg(F.count("*").alias("kept"))
    return excluded.join(n, "doc_id", "left").select("doc_id", "excluded", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


def hardest_negatives(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "O").alias("label"), "o_totalprice")
    return N.hardest_negatives(rows, ["o_custkey"], "o_orderkey", "o_totalprice", 0.5).select("o_custkey", "o_orderkey", "label")


def entity_keys(spark, d):
    """Normal form of the names of parts and of some phrases."""
    base = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "the ").otherwise("Every "), "p_name", F.when(F.col("p_partkey") % 3 == 0, " Policies").when(F.col("p_partkey") % 3 == 1, " bus").otherwise(" cars")).alias("s"))
    return base.select("p_partkey", E.entity_key(F.col("s")).alias("k")).select("p_partkey", "k.key", "k.plural")


def _english(spark, d):
    """Documents in English by their text, whatever their tag."""
    return S.with_language(table(spark, d, "documents").select("doc_id", "text", "lang")).where("language = 'en'").select("doc_id", "text")


def document_coherence(spark, d):
    """Centering with pronouns over all English documents."""
    docs = _english(spark, d)
    centers = D.forward_centers(E.document_mentions(docs))
    none = F.array().cast("array<string>")
    t = D.transitions(E.document_utterances(docs).join(centers, ["doc_id", "u"], "left").select("doc_id", "u", F.coalesce("cf", none).alias("cf")))
    return D.coherence(t)


def entity_grid(spark, d):
    docs = _english(spark, d)
    return E.grid(E.document_mentions(docs))


QUERIES = {f.__name__: f for f in (
    act_contracts, relation_contracts, violated_rules, layout_elements, licensed_candidates, combined_outcomes, derivable_outcomes, outcome_views, hardest_negatives,
    entity_keys, document_coherence, entity_grid)}

_OUT = "o AS (SELECT DISTINCT user_id AS doc_id, event_type AS technique, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'result' END AS kind FROM events)"
_ALLOWED = " OR ".join("(c = '{}' AND f IN ({}))".format(k, ", ".join(f"'{x}'" for x in v.split())) for k, v in N.ACT_FUNCTIONS.items())
ORACLES = {
    "act_contracts": f"""WITH a AS (SELECT event_id AS act_id, {CLASSES}[event_id % 5 + 1] AS c, {FUNCTIONS}[event_id % 7 + 1] AS f, event_id % 3 = 0 AS aims, event_id % 4 = 0 AS t FROM events)
SELECT act_id, 'function_not_of_class' AS rule FROM a WHERE NOT ({_ALLOWED}) UNION ALL SELECT act_id, 'target_missing' FROM a WHERE aims AND NOT t UNION ALL SELECT act_id, 'target_not_allowed' FROM a WHERE NOT aims AND t""",
    "relation_contracts": f"""WITH r AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS relation_id, {N.RELATION_TYPES}[l_partkey % 7 + 1] AS t, l_suppkey % 3 AS s, l_linenumber AS n, l_suppkey % 2 = 0 AS c, l_suppkey % 5 = 0 AS i, l_suppkey % 7 = 0 AS a FROM lineitem)
SELECT DISTINCT * FROM (SELECT relation_id, 'arguments_overlap' AS rule FROM r WHERE n < 2 * n + 3 AND 2 * n < n + 5 UNION ALL SELECT relation_id, 'repeated_sense' FROM r WHERE s = 2
UNION ALL SELECT relation_id, 'sense_missing' FROM r WHERE t IN ('Explicit', 'Implicit', 'AltLex', 'AltLexC') AND s = 0 UNION ALL SELECT relation_id, 'sense_not_allowed' FROM r WHERE t NOT IN ('Explicit', 'Implicit', 'AltLex', 'AltLexC') AND s > 0
UNION ALL SELECT relation_id, 'evidence_missing' FROM r WHERE (t = 'Explicit' AND NOT c) OR (t = 'Implicit' AND NOT i) OR (t LIKE 'AltLex%' AND NOT a)
UNION ALL SELECT relation_id, 'evidence_not_allowed' FROM r WHERE (c AND t <> 'Explicit') OR (i AND t <> 'Implicit') OR (a AND t NOT LIKE 'AltLex%')
UNION ALL SELECT relation_id, 'connective_in_argument' FROM r WHERE t = 'Explicit' AND c AND ((n + 4 < n + 5 AND n < n + 6) OR (n + 4 < 2 * n + 3 AND 2 * n < n + 6)))""",
    "violated_rules": """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS "values" FROM f GROUP BY 1""",
    "layout_elements": """SELECT o_orderkey, concat_ws(',', 'claim', CASE WHEN o_orderkey % 2 = 0 THEN 'grounds' END, CASE WHEN o_orderkey % 3 = 0 THEN 'warrant' END, CASE WHEN o_orderstatus = 'O' THEN 'qualifier' END, CASE WHEN o_orderkey % 5 = 0 THEN 'rebuttals' END) AS elements,
o_orderstatus = 'O' OR o_orderkey % 5 = 0 AS is_qualified FROM orders""",
    "licensed_candidates": """WITH i AS (SELECT CAST(p_partkey % 6 AS VARCHAR) AS r, count(*) AS n FROM part WHERE p_partkey % 6 < 3 GROUP BY 1),
l AS (SELECT row_number() OVER () AS k, l_partkey, l_linenumber AS dist, l_returnflag = 'R' AS s FROM lineitem),
c AS (SELECT k, dist, s, unnest([l_partkey % 3, l_partkey % 4, l_partkey % 5]) AS r FROM l),
b AS (SELECT k, any_value(dist) AS dist, any_value(s) AS s, max(CASE WHEN i.r IS NOT NULL THEN ROW(i.n, i.r) END) AS best FROM c LEFT JOIN i ON i.r = CAST(c.r AS VARCHAR) GROUP BY 1)
SELECT coalesce(best[2], (SELECT max(ROW(n, r))[2] FROM i)) AS relation, CASE WHEN s AND best IS NOT NULL AND abs(dist) <= 5 THEN 0.9 ELSE 0.1 END AS edge_p, count(*) AS n FROM b GROUP BY ALL""",
    "combined_outcomes": f"""WITH {_OUT}, p AS (SELECT doc_id, count(*) FILTER (kind = 'result') AS results, count(*) FILTER (kind <> 'result') AS failures FROM o GROUP BY 1)
SELECT doc_id, CASE WHEN failures = 0 THEN 'complete' WHEN results > 0 THEN 'partial' ELSE 'unsuccessful' END AS status, results, failures FROM p""",
    "derivable_outcomes": f"WITH {_OUT} SELECT doc_id, 'a' AS consumer FROM o WHERE kind = 'result' AND technique IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT technique) = 2",
    "outcome_views": f"""WITH {_OUT} SELECT doc_id, string_agg(DISTINCT technique, ',' ORDER BY technique) FILTER (technique NOT IN ('click', 'purchase')) AS excluded, count(*) FILTER (technique IN ('click', 'purchase')) AS kept FROM o GROUP BY 1
HAVING count(*) FILTER (technique NOT IN ('click', 'purchase')) > 0""",
    "hardest_negatives": """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'O' AS label, o_totalprice AS h FROM orders),
k AS (SELECT *, count(*) FILTER (label) OVER (PARTITION BY o_custkey) AS p, row_number() OVER (PARTITION BY o_custkey, label ORDER BY h DESC, sha256(CAST(o_orderkey AS VARCHAR))) AS n FROM r)
SELECT o_custkey, o_orderkey, label FROM k WHERE label OR n <= floor(p * 0.5)""",
    "entity_keys": r"""WITH b AS (SELECT p_partkey, lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN ' policy' WHEN 1 THEN ' bus' ELSE ' car' END AS key, p_partkey % 3 <> 1 AS plural FROM part)
SELECT p_partkey, regexp_replace(trim(key), '\s+', ' ', 'g') AS key, plural FROM b""",
}
