"""Queries over the annotation tool's trees and over trees derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.operators import linking as L
from logosmill.operators import trees as T
from logosmill.plans.scoring_queries import brackets
from logosmill.plans.structure_queries import _DOWN, _LINKS, _UP
from logosmill.session import table
from logosmill.sources import readers as R


def _nodes(spark, d):
    return T.tree_nodes(table(spark, d, "rst_nodes"))


def tree_spans(spark, d):
    return T.spans(_nodes(spark, d)).select("tree_id", "id", F.col("depth").cast("bigint").alias("depth"), "first_edu", "last_edu")


def cycle_spans(spark, d):
    """What nodes on or below cycles cover, which tree_spans leaves at themselves."""
    return T.spans(_nodes(spark, d), cycles=True).where("status in ('cycle', 'below_cycle')").select("tree_id", "id", "status", "first_edu", "last_edu")


def tree_statistics(spark, d):
    return T.statistics(_nodes(spark, d)).withColumn("nucleus_ratio", F.round("nucleus_ratio", 6))


def statistics_summary(spark, d):
    s = T.statistics(_nodes(spark, d))
    return s.agg(F.round(F.avg("edus"), 6).alias("mean_edus"), F.median("edus").alias("median_edus"), F.min("edus").alias("min_edus"), F.round(F.avg("thin_share"), 6).alias("mean_thin_share"))


def relation_families(spark, d):
    n = _nodes(spark, d).where("parent is not null and relname is not null")
    return n.groupBy("relname", T.relation_category(F.col("relname")).alias("family")).agg(F.count("*").alias("n"))


def central_units(spark, d):
    return T.central_units(_nodes(spark, d))


def spine_texts(spark, d):
    return T.spine_texts(_nodes(spark, d))


def rdf_triples(spark, d):
    return T.triples(_nodes(spark, d))


def turtle_lines(spark, d):
    return T.turtle(T.triples(_nodes(spark, d)))


def retrieval_chunks(spark, d):
    return T.chunks(_nodes(spark, d))


def rs3_files(spark, d):
    return T.rs3(_nodes(spark, d))


def rs3_reading(spark, d):
    """Files written and read again."""
    files = T.rs3(_nodes(spark, d)).select(F.col("tree_id").alias("doc"), F.col("rs3").alias("content"))
    return R.rs3(files).select("doc", "id", "kind", "parent", F.nullif("relname", F.lit("")).alias("relname"), "contents")


def enclosing_nodes(spark, d):
    """The narrowest node that covers each elementary unit and its right neighbour, by stated edges."""
    n = _nodes(spark, d).where("left_edge is not null and right_edge is not null")
    cues = n.where("kind = 'edu'").select("tree_id", F.col("id").alias("cue_id"), F.col("left_edge").alias("start_pos"), (F.col("left_edge") + 1).alias("stop_pos"))
    inner = n.where("kind <> 'edu'").select("tree_id", F.col("id").alias("node_id"), F.col("left_edge").alias("first"), F.col("right_edge").alias("last"))
    return L.enclosing(cues, inner, "tree_id").select("tree_id", "cue_id", "node_id")


def tree_violations(spark, d):
    return T.violations(_nodes(spark, d))


def _table(spark, d):
    gold, pred = brackets(spark, d)
    mid = gold.where("s < e").select(F.col("doc_id").alias("tree_id"), F.col("s").alias("start"), F.col("e").alias("stop"), F.floor((F.col("s") + F.col("e")) / 2).cast("int").alias("split"))
    return mid.where("tree_id % 5 <> 0 or start <> 1 or stop <> 2")  # some trees lack a row


def table_decoding(spark, d):
    return T.decode_table(_table(spark, d))


def bracket_reading(spark, d):
    """Bracket strings written from tables and read again."""
    one = F.format_string("(%d:Nucleus=span:%d,%d:Satellite=Elaboration:%d;prob=0.5)", "start", "split", F.col("split") + 1, "stop")
    s = _table(spark, d).groupBy("tree_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list(one))).alias("brackets"))
    out = T.bracket_children(T.read_brackets(s))
    return out.select("tree_id", "start", "split", "stop", "left_rel", "right_rel", "left_inner", "right_inner")


QUERIES = {f.__name__: f for f in (
    tree_spans, cycle_spans, tree_statistics, statistics_summary, relation_families, central_units, spine_texts, rdf_triples, turtle_lines, retrieval_chunks, rs3_files, rs3_reading, enclosing_nodes,
    tree_violations, table_decoding, bracket_reading)}

_N = """n AS (SELECT concat(project, '/', user_name, '/', doc) AS tree_id, id, min(CASE WHEN trim(parent) IN ('', '0') THEN NULL ELSE parent END) AS parent, min(kind) AS kind,
min(relname) AS relname, min(left_edge) AS left_edge, min(right_edge) AS right_edge, min(contents) AS contents FROM rst_nodes WHERE id IS NOT NULL GROUP BY 1, 2)"""
_FAM = (f"CASE WHEN raw IN {tuple(T.SUBJECT_MATTER)} THEN 'subject_matter' WHEN raw IN {tuple(T.PRESENTATIONAL)} THEN 'presentational' "
        f"WHEN string_split(raw, '-')[1] IN {tuple(T.SUBJECT_MATTER)} OR string_split(raw, '-')[-1] IN {tuple(T.SUBJECT_MATTER)} THEN 'subject_matter' "
        f"WHEN string_split(raw, '-')[1] IN {tuple(T.PRESENTATIONAL)} OR string_split(raw, '-')[-1] IN {tuple(T.PRESENTATIONAL)} THEN 'presentational' ELSE 'unknown' END")
_STATS = f"""{_N}, j AS (SELECT n.*, p.kind AS pk FROM n LEFT JOIN n p ON p.tree_id = n.tree_id AND p.id = n.parent),
k AS (SELECT *, parent IS NOT NULL AS l, parent IS NOT NULL AND (coalesce(relname = 'span', false) OR coalesce(pk, '') = 'multinuc') AS nu, CASE WHEN parent IS NOT NULL AND relname <> 'span' THEN relname END AS rel FROM j),
f AS (SELECT *, trim(replace(lower(rel), '_', '-')) AS raw FROM k), g AS (SELECT *, CASE WHEN rel IS NOT NULL THEN {_FAM} END AS cat FROM f),
s AS (SELECT tree_id, count(*) FILTER (kind = 'edu') AS edus, count(*) FILTER (kind <> 'edu') AS inner_nodes, count(*) FILTER (nu) AS nuclei, count(*) FILTER (l AND NOT nu) AS satellites,
count(*) FILTER (cat = 'subject_matter') AS subject_matter, count(*) FILTER (cat = 'presentational') AS presentational, count(*) FILTER (cat = 'unknown') AS unknown, count(rel) AS relations,
count(*) FILTER (lower(rel) LIKE 'joint%' OR lower(rel) LIKE 'same-unit%' OR lower(rel) LIKE 'organization%') AS thin FROM g GROUP BY 1),
z AS (SELECT tree_id, edus, inner_nodes, nuclei, satellites, subject_matter, presentational, unknown, relations, nuclei / nullif(satellites, 0) AS nucleus_ratio, round(coalesce(thin / nullif(relations, 0), 0), 3) AS thin_share FROM s)"""
_MID = """w AS (SELECT l_orderkey AS tree_id, CAST(count(DISTINCT l_linenumber) AS INT) AS n FROM lineitem GROUP BY 1),
g AS (SELECT tree_id, 1 AS s, n AS e FROM w UNION ALL SELECT tree_id, unnest([s, (s + e) // 2 + 1]), unnest([(s + e) // 2, e]) FROM g WHERE s < e),
t AS (SELECT tree_id, s AS start, e AS stop, (s + e) // 2 AS split FROM g WHERE s < e AND (tree_id % 5 <> 0 OR s <> 1 OR e <> 2))"""
_T = "{s} || '#node_' || id"
ORACLES = {
    "tree_spans": f"""WITH RECURSIVE {_LINKS}, {_DOWN}, {_N}, c AS (SELECT d.tree_id, unnest(d.path) AS id, n.left_edge AS e FROM down d JOIN n ON n.tree_id = d.tree_id AND n.id = d.id WHERE d.tree_table = 'rst_nodes' AND n.kind = 'edu'
UNION ALL SELECT tree_id, id, left_edge FROM n WHERE kind = 'edu'), m AS (SELECT tree_id, id, min(e) AS first_edu, max(e) AS last_edu FROM c GROUP BY 1, 2)
SELECT n.tree_id, n.id, d.depth, first_edu, last_edu FROM n LEFT JOIN down d ON d.tree_table = 'rst_nodes' AND d.tree_id = n.tree_id AND d.id = n.id LEFT JOIN m ON m.tree_id = n.tree_id AND m.id = n.id""",
    "cycle_spans": f"""WITH RECURSIVE {_LINKS}, {_UP}, {_N}, shut AS (SELECT DISTINCT tree_id, id FROM up WHERE tree_table = 'rst_nodes' AND list_contains(seen, cur)), y AS (SELECT tree_id, id FROM cyc WHERE tree_table = 'rst_nodes'),
c AS (SELECT u.tree_id, u.cur AS id, n.left_edge AS e FROM up u JOIN n ON n.tree_id = u.tree_id AND n.id = u.id WHERE u.tree_table = 'rst_nodes' AND n.kind = 'edu' UNION ALL SELECT tree_id, id, left_edge FROM n WHERE kind = 'edu'),
m AS (SELECT tree_id, id, min(e) AS first_edu, max(e) AS last_edu FROM c GROUP BY 1, 2)
SELECT s.tree_id, s.id, CASE WHEN y.id IS NULL THEN 'below_cycle' ELSE 'cycle' END AS status, first_edu, last_edu FROM shut s LEFT JOIN y ON y.tree_id = s.tree_id AND y.id = s.id LEFT JOIN m ON m.tree_id = s.tree_id AND m.id = s.id""",
    "tree_statistics": f"WITH {_STATS} SELECT * REPLACE (round(nucleus_ratio, 6) AS nucleus_ratio) FROM z",
    "statistics_summary": f"WITH {_STATS} SELECT round(avg(edus), 6) AS mean_edus, median(edus) AS median_edus, min(edus) AS min_edus, round(avg(thin_share), 6) AS mean_thin_share FROM z",
    "relation_families": f"WITH {_N}, r AS (SELECT relname, trim(replace(lower(relname), '_', '-')) AS raw FROM n WHERE parent IS NOT NULL AND relname IS NOT NULL) SELECT relname, {_FAM} AS family, count(*) AS n FROM r GROUP BY ALL",
    "central_units": f"""WITH RECURSIVE {_N}, c AS (SELECT c.tree_id, c.parent, c.id, row_number() OVER (PARTITION BY c.tree_id, c.parent ORDER BY c.left_edge NULLS LAST, c.id) AS r FROM n c JOIN n p ON p.tree_id = c.tree_id AND p.id = c.parent AND p.kind <> 'multinuc' WHERE c.relname = 'span'),
w AS (SELECT tree_id, id AS root, id FROM n WHERE parent IS NULL UNION ALL SELECT w.tree_id, w.root, c.id FROM w JOIN c ON c.tree_id = w.tree_id AND c.parent = w.id AND c.r = 1)
SELECT tree_id, root, id AS unit FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tree_id = w.tree_id AND c.parent = w.id)""",
    "rdf_triples": f"""WITH {_N}, b AS (SELECT *, 'https://data.example/discourse/' || tree_id AS doc FROM n), e AS (SELECT unnest([
{{'subject': doc || '#node_' || id, 'predicate': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'object': 'https://data.example/ns#' || CASE WHEN kind = 'edu' THEN 'ElementaryDiscourseUnit' ELSE 'ComplexDiscourseUnit' END}},
{{'subject': doc || '#node_' || id, 'predicate': 'https://data.example/ns#partOfDocument', 'object': doc}},
{{'subject': doc || '#node_' || id, 'predicate': 'https://data.example/ns#text', 'object': '"' || contents || '"'}},
{{'subject': doc || '#node_' || id, 'predicate': 'https://data.example/ns#eduStart', 'object': CAST(CAST(trunc(left_edge) AS INT) AS VARCHAR)}},
{{'subject': doc || '#node_' || id, 'predicate': 'https://data.example/ns#eduEnd', 'object': CAST(CAST(trunc(right_edge) AS INT) AS VARCHAR)}},
{{'subject': doc || '#edge_' || id, 'predicate': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'object': CASE WHEN parent IS NOT NULL THEN 'https://data.example/ns#PrimaryDiscourseRelation' END}},
{{'subject': doc || '#edge_' || id, 'predicate': 'https://data.example/ns#hasParent', 'object': doc || '#node_' || parent}},
{{'subject': doc || '#edge_' || id, 'predicate': 'https://data.example/ns#hasChild', 'object': CASE WHEN parent IS NOT NULL THEN doc || '#node_' || id END}},
{{'subject': doc || '#edge_' || id, 'predicate': 'https://data.example/ns#relationRaw', 'object': CASE WHEN parent IS NOT NULL THEN '"' || relname || '"' END}}]) AS t FROM b)
SELECT t['subject'] AS subject, t['predicate'] AS predicate, t['object'] AS object FROM e WHERE t['object'] IS NOT NULL""",
    "retrieval_chunks": f"""WITH {_N}, k AS (SELECT tree_id, parent AS id, string_agg(id, ',' ORDER BY id) AS children FROM n WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT n.tree_id || '__node_' || n.id AS chunk_id, kind AS chunk_type, contents AS text, n.tree_id || '__node_' || parent AS parent_chunk, coalesce(children, '') AS children FROM n LEFT JOIN k ON k.tree_id = n.tree_id AND k.id = n.id""",
    "tree_violations": f"""WITH {_N}, k AS (SELECT n.tree_id, n.id, n.kind, count(c.id) AS c FROM n LEFT JOIN n c ON c.tree_id = n.tree_id AND c.parent = n.id WHERE n.kind <> 'edu' GROUP BY ALL), r AS (SELECT tree_id, count(*) FILTER (parent IS NULL) AS r FROM n GROUP BY 1)
SELECT c.tree_id, c.id, 'missing_parent' AS rule FROM n c LEFT JOIN n p ON p.tree_id = c.tree_id AND p.id = c.parent WHERE c.parent IS NOT NULL AND p.kind IS NULL UNION ALL
SELECT tree_id, id, 'own_parent' FROM n WHERE parent = id UNION ALL SELECT tree_id, id, 'inner_node_without_children' FROM k WHERE c = 0 UNION ALL
SELECT tree_id, id, 'multinuclear_with_one_child' FROM k WHERE kind = 'multinuc' AND c = 1 UNION ALL
SELECT tree_id, NULL, 'several_roots' FROM r WHERE r > 1 UNION ALL SELECT tree_id, NULL, 'no_root' FROM r WHERE r = 0""",
    "table_decoding": f"""WITH RECURSIVE {_MID}, x AS (SELECT tree_id, min(start) AS lo, max(stop) AS hi, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT tree_id, start, split AS stop FROM t UNION SELECT tree_id, split + 1, stop FROM t)
SELECT tree_id, 'wrong_number_of_rows' AS rule FROM x WHERE n <> hi - lo UNION ALL
SELECT DISTINCT tree_id, 'unreachable' FROM t JOIN x USING (tree_id) WHERE NOT (start = lo AND stop = hi) AND (tree_id, start, stop) NOT IN (SELECT tree_id, start, stop FROM p) UNION ALL
SELECT DISTINCT tree_id, 'missing_part' FROM p WHERE start < stop AND (tree_id, start, stop) NOT IN (SELECT tree_id, start, stop FROM t)""",
    "bracket_reading": f"""WITH RECURSIVE {_MID} SELECT tree_id, start, split, stop, 'span' AS left_rel, 'Elaboration' AS right_rel,
(tree_id, start, split) IN (SELECT tree_id, start, stop FROM t) AS left_inner, (tree_id, split + 1, stop) IN (SELECT tree_id, start, stop FROM t) AS right_inner FROM t""",
    "rs3_reading": rf"""WITH {_N} SELECT tree_id AS doc, id, kind, parent, CASE WHEN parent IS NOT NULL THEN nullif(relname, '') END AS relname,
CASE WHEN kind = 'edu' THEN trim(regexp_replace(coalesce(contents, ''), '\s+', ' ', 'g')) END AS contents FROM n""",
    "enclosing_nodes": f"""WITH {_N}, c AS (SELECT tree_id, id, left_edge AS s FROM n WHERE kind = 'edu' AND left_edge IS NOT NULL AND right_edge IS NOT NULL),
i AS (SELECT tree_id, id, left_edge AS f, right_edge AS l FROM n WHERE kind <> 'edu' AND left_edge IS NOT NULL AND right_edge IS NOT NULL)
SELECT c.tree_id, c.id AS cue_id, min(CASE WHEN i.id IS NOT NULL THEN ROW(i.l - i.f, i.id) END)[2] AS node_id FROM c LEFT JOIN i ON i.tree_id = c.tree_id AND i.f <= c.s AND c.s + 1 <= i.l GROUP BY 1, 2""",
}


def _escaped(expression, pairs):
    chars = lambda x: " || ".join(f"chr({ord(c)})" for c in x)
    for old, new in pairs.items():
        expression = f"replace({expression}, {chars(old)}, {chars(new)})"
    return expression


_IRI = lambda c: f"'<' || {_escaped(c, T.IRI_ESCAPES)} || '>'"
ORACLES["turtle_lines"] = f"""SELECT {_IRI('subject')} || ' ' || {_IRI('predicate')} || ' ' || CASE WHEN starts_with(object, chr(34)) THEN chr(34) || {_escaped('substr(object, 2, length(object) - 2)', T.LITERAL_ESCAPES)} || chr(34)
WHEN regexp_matches(object, '^-?[0-9]+$') THEN object ELSE {_IRI('object')} END || ' .' AS value FROM ({ORACLES['rdf_triples']})"""
