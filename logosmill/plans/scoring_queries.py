"""Scores over derived trees: an order's lines are units, gold splits in the middle, predictions branch to the right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.operators import scoring as S
from logosmill.session import table


def _labels(df: DataFrame, shift: int) -> DataFrame:
    return df.select("doc_id", "s", "e", ((F.col("s") * F.col("e")) % 3).alias("nuc"), ((F.col("s") + F.col("e") + shift * (F.col("doc_id") % 2)) % 5).alias("rel"))


def brackets(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.countDistinct("l_linenumber").cast("int").alias("n"))
    # Halves of halves, level by level: spans of all sizes of an order come from one fold over its levels.
    span = "array<struct<s:int,e:int>>"
    halves = lambda x: F.when(x["s"] < x["e"], F.array(
        F.struct(x["s"].alias("s"), F.floor((x["s"] + x["e"]) / 2).cast("int").alias("e")),
        F.struct((F.floor((x["s"] + x["e"]) / 2) + 1).cast("int").alias("s"), x["e"].alias("e")))).otherwise(F.array().cast(span))
    first = F.array(F.struct(F.lit(1).alias("s"), F.col("n").alias("e")))
    step = lambda acc, _: F.struct(F.concat(acc["all"], F.flatten(F.transform(acc["last"], halves))).alias("all"), F.flatten(F.transform(acc["last"], halves)).alias("last"))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n"))).cast("int")))
    spans = F.aggregate(levels, F.struct(first.alias("all"), first.alias("last")), step, lambda acc: acc["all"])
    gold = n.where("n > 0").select("doc_id", F.explode(spans).alias("x")).select("doc_id", "x.s", "x.e")
    right = n.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("s"))
    pred = right.select("doc_id", "s", F.col("n").alias("e")).unionByName(right.where("s < n").select("doc_id", "s", F.col("s").alias("e")))
    return _labels(gold, 0), _labels(pred, 1)


CRITERIA = {"span": ["s", "e"], "nuclearity": ["s", "e", "nuc"], "relation": ["s", "e", "rel"], "full": ["s", "e", "nuc", "rel"]}


def bracket_counts(spark, d):
    return S.multiset_counts(*brackets(spark, d), ["doc_id"], CRITERIA).select("doc_id", "criterion", "gold", "pred", "matched")


def bracket_micro(spark, d):
    return _rounded(S.micro(S.multiset_counts(*brackets(spark, d), ["doc_id"], CRITERIA)), "criterion", "gold", "pred", "matched")


def bracket_macro(spark, d):
    return _rounded(S.macro(S.multiset_counts(*brackets(spark, d), ["doc_id"], CRITERIA)), "criterion")


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def segmentation_scores(spark, d):
    """Stated against ruled sentence ends, per document."""
    from logosmill.operators import substrate

    rows = table(spark, d, "rst_documents").dropDuplicates(["document_id"])
    gold = rows.select("document_id", F.explode("sentence_boundaries").alias("b")).select("document_id", F.col("b.end_pos").cast("bigint").alias("at")).distinct()
    pred = substrate.simple_sentences(rows.where("size(sentence_boundaries) > 0"), "document_id").select("document_id", F.col("stop_pos").cast("bigint").alias("at"))
    return _rounded(S.with_prf(S.multiset_counts(gold, pred, ["document_id"], {"break": ["at"]})), "document_id", "gold", "pred", "matched")


def inner_boundaries(spark, d):
    """Ends of spans but the last of each document, matched as multisets."""
    gold, pred = brackets(spark, d)
    inner = lambda df: df.join(df.groupBy("doc_id").agg(F.max("e").alias("last")), "doc_id").where("e < last").select("doc_id", "e")
    return S.multiset_counts(inner(gold), inner(pred), ["doc_id"], {"boundary": ["e"]}).select("doc_id", "gold", "pred", "matched")


def soft_scores(spark, d):
    gold, pred = brackets(spark, d)
    span = lambda df: df.select("doc_id", (F.col("s") - 1).alias("start_pos"), F.col("e").alias("stop_pos"))
    return S.soft_matches(span(gold), span(pred), "doc_id", 0.6)


def secondary_edges(spark, d):
    """Undirected, directed and labelled matches of edges between lines of an order."""
    gold, pred = brackets(spark, d)
    edge = lambda df: df.where("s < e").select("doc_id", F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b"), F.when(F.col("nuc") == 1, F.col("e")).otherwise(F.col("s")).alias("src"), "rel")
    return S.micro(S.multiset_counts(edge(gold), edge(pred), ["doc_id"], {"span": ["a", "b"], "direction": ["a", "b", "src"], "full": ["a", "b", "src", "rel"]})).select(
        "criterion", "gold", "pred", "matched", F.round("f1", 6).alias("f1"))


def _events(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("event_id") % 1000 / 1000.0).alias("c"), (F.col("event_id") * 7 % 10 < F.col("event_id") % 11).alias("ok"))


def calibration_bins(spark, d):
    out = S.calibration(_events(spark, d), "c", "ok", by=["event_type"])
    return out.select("event_type", "bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def calibration_errors(spark, d):
    out = S.calibration_error(S.calibration(_events(spark, d), "c", "ok", by=["event_type"]), ["event_type"])
    return out.select("event_type", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


def holm_correction(spark, d):
    """A family of tests per nation, one per supplier, p from the key."""
    t = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 37 % 101 / 1010.0).alias("p_value"))
    return S.holm(t, "s_suppkey", family=["s_nationkey"]).select("s_nationkey", "s_suppkey", F.round("adjusted", 6).alias("adjusted"))


def paired_bootstrap(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderkey") % 7).cast("double")).alias("a"), F.avg((F.col("o_orderkey") % 6).cast("double")).alias("b"))
    return S.bootstrap(t, "o_custkey", rounds=200)


def standardised_features(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 97).cast("double").alias("rest"))
    return S.standardised(t, ["size", "rest"]).select("p_partkey", F.round("size", 6).alias("size"), F.round("rest", 6).alias("rest"))


QUERIES = {f.__name__: f for f in (
    bracket_counts, bracket_micro, bracket_macro, segmentation_scores, inner_boundaries, soft_scores, secondary_edges, calibration_bins,
    calibration_errors, holm_correction, paired_bootstrap, standardised_features)}

_B = """
n AS (SELECT l_orderkey AS doc_id, CAST(count(DISTINCT l_linenumber) AS INT) AS n FROM lineitem GROUP BY 1),
g AS (SELECT doc_id, 1 AS s, n AS e FROM n UNION ALL SELECT doc_id, unnest([s, (s + e) // 2 + 1]), unnest([(s + e) // 2, e]) FROM g WHERE s < e),
r AS (SELECT doc_id, n, CAST(unnest(range(1, n + 1)) AS INT) AS s FROM n),
p AS (SELECT doc_id, s, n AS e FROM r UNION ALL SELECT doc_id, s, s FROM r WHERE s < n),
gold AS (SELECT doc_id, s, e, s * e % 3 AS nuc, (s + e) % 5 AS rel FROM g),
pred AS (SELECT doc_id, s, e, s * e % 3 AS nuc, (s + e + doc_id % 2) % 5 AS rel FROM p),
u AS (SELECT *, 1 AS g, 0 AS p FROM gold UNION ALL SELECT *, 0, 1 FROM pred)"""


def _count_sql(name: str, keys: str, unit: str = "doc_id", source: str = "u") -> str:
    return f"SELECT {unit}, '{name}' AS criterion, sum(g) AS gold, sum(p) AS pred, sum(least(g, p)) AS matched FROM (SELECT {unit}, {keys}, sum(g) AS g, sum(p) AS p FROM {source} GROUP BY ALL) GROUP BY {unit}"


_C = ", c AS (" + " UNION ALL ".join(_count_sql(k, ", ".join(v)) for k, v in CRITERIA.items()) + ")"
_PRF = "coalesce(matched / nullif(pred, 0), 0) AS precision, coalesce(matched / nullif(gold, 0), 0) AS recall, coalesce(2.0 * matched / nullif(gold + pred, 0), 0) AS f1"
_ROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_INTS = "CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, CAST(matched AS BIGINT) AS matched"
_E = "e AS (SELECT event_type, event_id % 1000 / 1000.0 AS c, event_id * 7 % 10 < event_id % 11 AS ok FROM events), b AS (SELECT event_type, CAST(least(floor(c * 10), 9) AS INT) AS bin, count(*) AS n, avg(CAST(c AS DOUBLE)) AS confidence, avg(ok::INT) AS accuracy FROM e GROUP BY 1, 2)"
ORACLES = {
    "bracket_counts": f"WITH RECURSIVE {_B}{_C} SELECT doc_id, criterion, {_INTS} FROM c",
    "bracket_micro": f"WITH RECURSIVE {_B}{_C}, t AS (SELECT criterion, sum(gold) AS gold, sum(pred) AS pred, sum(matched) AS matched FROM c GROUP BY 1), q AS (SELECT *, {_PRF} FROM t) SELECT criterion, {_INTS}, {_ROUND} FROM q",
    "bracket_macro": f"WITH RECURSIVE {_B}{_C}, q AS (SELECT *, {_PRF} FROM c) SELECT criterion, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM q GROUP BY 1",
    "segmentation_scores": r"""WITH r AS (SELECT DISTINCT ON (document_id) document_id, text, sentence_boundaries FROM rst_documents),
gold AS (SELECT DISTINCT document_id, CAST(b['end_pos'] AS BIGINT) AS at_pos FROM (SELECT document_id, unnest(sentence_boundaries) AS b FROM r)),
sp AS (SELECT document_id, string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM r WHERE len(sentence_boundaries) > 0),
el AS (SELECT document_id, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sp)),
o AS (SELECT document_id, x, coalesce(sum(length(x)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM el),
pred AS (SELECT document_id, CAST(b + length(regexp_replace(x, '\s+$', '')) AS BIGINT) AS at_pos FROM o WHERE length(regexp_replace(x, '\s+$', '')) > 0),
u AS (SELECT *, 1 AS g, 0 AS p FROM gold UNION ALL SELECT *, 0, 1 FROM pred), c AS (""" + _count_sql("break", "at_pos", "document_id") + f"), q AS (SELECT *, {_PRF} FROM c) SELECT document_id, {_INTS}, {_ROUND} FROM q",
    "inner_boundaries": f"WITH RECURSIVE {_B}, w AS (SELECT *, max(e) OVER (PARTITION BY doc_id, g) AS m FROM u), i AS (SELECT doc_id, e, g, p FROM w WHERE e < m), c AS ({_count_sql('boundary', 'e', source='i')}) SELECT doc_id, {_INTS} FROM c",
    "secondary_edges": f"WITH RECURSIVE {_B}, k AS (SELECT doc_id, least(s, e) AS a, greatest(s, e) AS b, CASE WHEN nuc = 1 THEN e ELSE s END AS src, rel, g, p FROM u WHERE s < e), c AS ("
    + " UNION ALL ".join(_count_sql(k, v, source="k") for k, v in (("span", "a, b"), ("direction", "a, b, src"), ("full", "a, b, src, rel")))
    + f"), t AS (SELECT criterion, sum(gold) AS gold, sum(pred) AS pred, sum(matched) AS matched FROM c GROUP BY 1), q AS (SELECT *, {_PRF} FROM t) SELECT criterion, {_INTS}, round(f1, 6) AS f1 FROM q",
    "calibration_bins": f"WITH {_E} SELECT event_type, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b",
    "calibration_errors": f"WITH {_E} SELECT event_type, round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce FROM b GROUP BY 1",
    "holm_correction": """WITH t AS (SELECT s_nationkey, s_suppkey, s_suppkey * 37 % 101 / 1010.0 AS p FROM supplier),
r AS (SELECT *, (count(*) OVER (PARTITION BY s_nationkey) - row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) + 1) * p AS q FROM t)
SELECT s_nationkey, s_suppkey, round(least(1.0, max(q) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""",
    "standardised_features": """WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 97 AS DOUBLE) AS b FROM part),
m AS (SELECT avg(a) AS ma, greatest(1e-6, stddev_pop(a)) AS sa, avg(b) AS mb, greatest(1e-6, stddev_pop(b)) AS sb FROM t)
SELECT p_partkey, round((a - ma) / sa, 6) AS size, round((b - mb) / sb, 6) AS rest FROM t, m""",
}
