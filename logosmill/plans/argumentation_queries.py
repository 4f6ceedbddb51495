"""Frameworks derived from orders: one per order, an argument per line, attacks by arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logosmill.operators import argumentation as A
from logosmill.session import table


def frameworks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("af_id"), F.col("l_linenumber").alias("i")).agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    args = lines.select("af_id", F.col("i").cast("string").alias("arg"), F.col("i").alias("ord"))
    other = lines.select("af_id", F.col("i").alias("j"), F.col("s").alias("t"))
    attacks = lines.join(other, "af_id").where("(p + t) % 4 = 0 and (i <> j or p % 11 = 0)").select(
        "af_id", F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"))
    return args, attacks


def _masks(spark, d):
    return A.masks(*frameworks(spark, d))


def _text(mask: str):
    return F.array_join(A.named(F.col(mask)), ",")


def af_validation(spark, d):
    args, attacks = frameworks(spark, d)
    # Every seventh argument of the framework is left undeclared, so there is something to find.
    return A.violations(args.where("ord % 7 <> 0").unionByName(args.where("ord = 3")), attacks).select(
        F.col("af_id"), "rule", "detail")


def af_cleanup(spark, d):
    args, attacks = frameworks(spark, d)
    return A.cleaned(args.where("ord % 7 <> 0"), attacks)


def grounded_extension(spark, d):
    return A.grounded(_masks(spark, d)).select("af_id", _text("in_mask").alias("accepted"), _text("out_mask").alias("rejected"))


def complete_extensions(spark, d):
    return A.complete(_masks(spark, d)).select("af_id", _text("ext").alias("members"))


def preferred_extensions(spark, d):
    return A.preferred(A.complete(_masks(spark, d))).select("af_id", _text("ext").alias("members"))


def stable_extensions(spark, d):
    return A.stable(A.complete(_masks(spark, d))).select("af_id", _text("ext").alias("members"))


def set_predicates(spark, d):
    """Predicates of the set of odd arguments of every framework."""
    odd = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.when(i % 2 == 0, A._bit(i)).otherwise(F.lit(0).cast("bigint"))))
    return A.predicates(_masks(spark, d).withColumn("s", odd)).select("af_id", "conflict_free", "admissible", "is_complete", "is_stable")


def acceptance_counts(spark, d):
    """Credulous and sceptical acceptance under complete semantics."""
    ext = A.complete(_masks(spark, d)).select("af_id", "names", F.explode(A.named(F.col("ext"))).alias("arg"), F.col("ext"))
    total = A.complete(_masks(spark, d)).groupBy("af_id").agg(F.count("*").alias("n_ext"))
    return ext.groupBy("af_id", "arg").agg(F.count("*").alias("n_in")).join(total, "af_id").select(
        "af_id", "arg", "n_in", (F.col("n_in") == F.col("n_ext")).alias("sceptical"))


def _ibis(spark, d):
    """One map per customer: the customer is the issue, orders are positions, lines arguments."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("af_id"), F.col("o_orderkey").alias("k"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), "l_returnflag")
    issue = orders.select("af_id", F.concat(F.lit("i"), "af_id").alias("node_id"), F.lit("issue").alias("kind"), F.lit(0).cast("bigint").alias("ord")).distinct()
    pos = orders.select("af_id", F.concat(F.lit("p"), "k").alias("node_id"), F.lit("position").alias("kind"), F.col("k").alias("ord"))
    own = lines.join(orders, "k")
    arg = own.select("af_id", F.concat(F.lit("a"), "k", F.lit("_"), "i").alias("node_id"), F.lit("argument").alias("kind"), F.col("k").alias("ord"))
    links = orders.select("af_id", F.concat(F.lit("p"), "k").alias("source"), F.lit("responds_to").alias("relation"), F.concat(F.lit("i"), "af_id").alias("target")).unionByName(
        own.select("af_id", F.concat(F.lit("a"), "k", F.lit("_"), "i").alias("source"), F.when(F.col("l_returnflag") == "R", "objects_to").otherwise("supports").alias("relation"), F.concat(F.lit("p"), "k").alias("target")))
    return issue.unionByName(pos).unionByName(arg), links


def af_from_ibis(spark, d):
    return A.from_ibis(*_ibis(spark, d))[1]


def af_from_mining(spark, d):
    """Units are line items, conflicts between returned and other lines of an order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("af_id"), F.col("l_linenumber").alias("i"), "l_returnflag").groupBy("af_id", "i").agg(F.min("l_returnflag").alias("l_returnflag"))
    nodes = lines.select("af_id", F.col("i").cast("string").alias("node_id"), F.col("i").alias("ord"))
    other = lines.select("af_id", F.col("i").alias("j"), F.col("l_returnflag").alias("g"))
    rel = lines.join(other, "af_id").where("i < j").select(
        "af_id", F.col("i").cast("string").alias("source_id"), F.col("j").cast("string").alias("target_id"),
        F.when(F.col("l_returnflag") != F.col("g"), "conflict").otherwise("inference").alias("relation_type"))
    return A.from_mining(nodes, rel)[1]


def af_from_toulmin(spark, d):
    """A layout per order of a customer; its clerk-sized rebuttals come from the price."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("af_id"), F.col("o_orderkey").alias("ord"), F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda x: x.cast("string")).alias("rebuttals"))
    return A.from_toulmin(o)[1]


def af_from_walton(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_linenumber").alias("index"), F.when(F.col("l_returnflag") == "R", "open").when(F.col("l_returnflag") == "A", "undercut").otherwise("addressed").alias("status")))).alias("questions"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("af_id"), F.col("o_orderkey").alias("ord"))
    return A.from_walton(o.join(lines, "ord").select("af_id", "ord", "questions"))[1]


def large_frameworks(spark, d):
    """Grounded extensions of one framework a supplier, of its larger orders in a chain: up to some ninety arguments."""
    lines = table(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_suppkey").alias("af_id"), F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    after = F.lead("k").over(Window.partitionBy("af_id").orderBy("k"))
    rows = lines.withColumn("next", after)
    args = rows.select(F.col("af_id").cast("string").alias("af_id"), F.col("k").cast("string").alias("arg"), F.col("k").alias("ord"))
    attacks = rows.where("next is not null and k % 3 > 0").select(F.col("af_id").cast("string").alias("af_id"), F.col("k").cast("string").alias("src"), F.col("next").cast("string").alias("dst"))
    return A.extensions(args, attacks, ("grounded",)).select("af_id", "semantics", F.size("members").cast("bigint").alias("n"), F.md5(F.array_join("members", ",")).alias("digest"))


QUERIES = {f.__name__: f for f in (
    af_validation, af_cleanup, grounded_extension, complete_extensions, preferred_extensions, stable_extensions, set_predicates,
    acceptance_counts, af_from_ibis, af_from_mining, af_from_toulmin, af_from_walton, large_frameworks)}

_AF = """
lines AS (SELECT l_orderkey AS af_id, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
att AS (SELECT a.af_id, a.i, b.i AS j FROM lines a JOIN lines b USING (af_id) WHERE (a.p + b.s) % 4 = 0 AND (a.i <> b.i OR a.p % 11 = 0)),
arg AS (SELECT af_id, i, row_number() OVER (PARTITION BY af_id ORDER BY i) - 1 AS b FROM lines),
attb AS (SELECT t.af_id, x.b AS s, y.b AS d FROM att t JOIN arg x ON x.af_id = t.af_id AND x.i = t.i JOIN arg y ON y.af_id = t.af_id AND y.i = t.j),
size AS (SELECT af_id, count(*) AS n FROM arg GROUP BY 1),
sets AS (SELECT af_id, n, unnest(range(CAST(1 << n AS BIGINT))) AS s FROM size),
member AS (SELECT k.af_id, k.s, a.b, a.i, (k.s >> a.b) & 1 = 1 AS inside FROM sets k JOIN arg a USING (af_id)),
hit AS (SELECT DISTINCT m.af_id, m.s, t.d FROM member m JOIN attb t ON t.af_id = m.af_id AND t.s = m.b WHERE m.inside),
undef AS (SELECT DISTINCT m.af_id, m.s, m.b FROM member m JOIN attb t ON t.af_id = m.af_id AND t.d = m.b
          LEFT JOIN hit h ON h.af_id = m.af_id AND h.s = m.s AND h.d = t.s WHERE h.d IS NULL),
facts AS (SELECT m.af_id, m.s, bool_and(NOT (m.inside AND h.d IS NOT NULL)) AS free, bool_and(NOT m.inside OR u.b IS NULL) AS defended,
          bool_and(m.inside = (u.b IS NULL)) AS fixed, bool_and(m.inside OR h.d IS NOT NULL) AS covers,
          coalesce(string_agg(CASE WHEN m.inside THEN CAST(m.i AS VARCHAR) END, ',' ORDER BY m.b), '') AS members
          FROM member m LEFT JOIN hit h ON h.af_id = m.af_id AND h.s = m.s AND h.d = m.b
          LEFT JOIN undef u ON u.af_id = m.af_id AND u.s = m.s AND u.b = m.b GROUP BY 1, 2),
comp AS (SELECT * FROM facts WHERE free AND fixed)
"""
_IBIS = """
own AS (SELECT o_custkey AS af_id, o_orderkey AS k, l_linenumber AS i, l_returnflag AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
obj AS (SELECT af_id, concat('a', k, '_', i) AS src, concat('p', k) AS dst FROM own WHERE f = 'R'),
riv AS (SELECT a.o_custkey AS af_id, a.o_orderkey AS p, b.o_orderkey AS q FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey),
sup AS (SELECT o.af_id, concat('a', k, '_', i) AS src, concat('p', q) AS dst FROM own o JOIN riv r ON r.af_id = o.af_id AND r.p = o.k WHERE f <> 'R')
"""
ORACLES = {
    "af_validation": f"""WITH {_AF}, known AS (SELECT af_id, i FROM lines WHERE i % 7 <> 0 UNION ALL SELECT af_id, i FROM lines WHERE i = 3)
SELECT af_id, 'duplicate_argument' AS rule, CAST(i AS VARCHAR) AS detail FROM known GROUP BY 1, i HAVING count(*) > 1
UNION ALL SELECT DISTINCT af_id, 'unknown_endpoint', CAST(e AS VARCHAR) FROM (SELECT af_id, i AS e FROM att UNION ALL SELECT af_id, j FROM att) WHERE (af_id, e) NOT IN (SELECT af_id, i FROM known)
UNION ALL SELECT DISTINCT af_id, 'no_arguments', NULL FROM att WHERE af_id NOT IN (SELECT af_id FROM known)""",
    "af_cleanup": f"WITH {_AF} SELECT DISTINCT af_id, CAST(i AS VARCHAR) AS src, CAST(j AS VARCHAR) AS dst FROM att WHERE i % 7 <> 0 AND j % 7 <> 0",
    "grounded_extension": f"""WITH {_AF}, least AS (SELECT af_id, arg_min(s, bit_count(s)) AS s FROM comp GROUP BY 1)
SELECT m.af_id, coalesce(string_agg(CASE WHEN m.inside THEN CAST(m.i AS VARCHAR) END, ',' ORDER BY m.b), '') AS accepted,
coalesce(string_agg(CASE WHEN h.d IS NOT NULL THEN CAST(m.i AS VARCHAR) END, ',' ORDER BY m.b), '') AS rejected
FROM least l JOIN member m USING (af_id, s) LEFT JOIN hit h ON h.af_id = m.af_id AND h.s = m.s AND h.d = m.b GROUP BY 1""",
    "complete_extensions": f"WITH {_AF} SELECT af_id, members FROM comp",
    "preferred_extensions": f"WITH {_AF} SELECT af_id, members FROM comp c WHERE NOT EXISTS (SELECT 1 FROM comp o WHERE o.af_id = c.af_id AND o.s <> c.s AND o.s & c.s = c.s)",
    "stable_extensions": f"WITH {_AF} SELECT af_id, members FROM comp WHERE covers",
    "set_predicates": f"""WITH {_AF}, odd AS (SELECT af_id, sum(1 << b) AS s FROM arg WHERE b % 2 = 0 GROUP BY 1)
SELECT af_id, free AS conflict_free, free AND defended AS admissible, free AND fixed AS is_complete, free AND covers AS is_stable FROM facts JOIN odd USING (af_id, s)""",
    "acceptance_counts": f"""WITH {_AF}, n AS (SELECT af_id, count(*) AS n_ext FROM comp GROUP BY 1)
SELECT m.af_id, CAST(m.i AS VARCHAR) AS arg, count(*) AS n_in, count(*) = any_value(n_ext) AS sceptical FROM comp c JOIN member m USING (af_id, s) JOIN n USING (af_id) WHERE m.inside GROUP BY 1, 2""",
    "af_from_ibis": f"WITH {_IBIS} SELECT DISTINCT * FROM (SELECT * FROM obj UNION ALL SELECT af_id, concat('p', p), concat('p', q) FROM riv UNION ALL SELECT * FROM sup)",
    "af_from_mining": """WITH l AS (SELECT l_orderkey AS af_id, l_linenumber AS i, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT DISTINCT a.af_id, CAST(a.i AS VARCHAR) AS src, CAST(b.i AS VARCHAR) AS dst FROM l a JOIN l b USING (af_id) WHERE a.i < b.i AND a.f <> b.f""",
    "af_from_toulmin": """WITH o AS (SELECT o_custkey AS af_id, o_orderkey, concat('layout_', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS dst FROM orders)
SELECT af_id, concat(dst, '_rebuttal_', k) AS src, dst FROM (SELECT af_id, dst, unnest(range(1, o_orderkey % 3 + 2)) AS k FROM o)""",
    "af_from_walton": """WITH o AS (SELECT o_custkey AS af_id, o_orderkey, concat('scheme_', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS dst
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT af_id, concat(dst, '_cq_', l_linenumber) AS src, dst FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')""",
    "large_frameworks": """WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS k FROM lineitem WHERE l_quantity >= 45), o AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM l),
r AS (SELECT g, i, k, true AS held FROM o WHERE i = 1 UNION ALL SELECT o.g, o.i, o.k, NOT (r.held AND r.k % 3 > 0) FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1),
n AS (SELECT g, count(*) AS all_, count(*) FILTER (held) AS n, coalesce(string_agg(CASE WHEN held THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS m FROM r GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS af_id, CASE WHEN all_ > 128 THEN 'capacity_exceeded' ELSE 'grounded' END AS semantics, CASE WHEN all_ > 128 THEN 0 ELSE n END AS n, md5(CASE WHEN all_ > 128 THEN '' ELSE m END) AS digest FROM n""",
}
