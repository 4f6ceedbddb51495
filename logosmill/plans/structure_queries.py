"""Queries on hierarchies and nested records, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logosmill.operators import hierarchy, nested
from logosmill.session import cut, table


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "inventory_items")
    nodes = table(spark, sf_dir, "rst_nodes")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = hierarchy.parent_links(items, "inventory_items", F.col("source_id"), F.col("item_id"), F.col("parent_id"), F.col("ingested_at"))
    b = hierarchy.parent_links(
        nodes, "rst_nodes", F.concat_ws("/", part("project"), part("user_name"), part("doc")), F.col("id"), F.col("parent"),
        F.col("ingested_at"), root_marks=("0",))
    return cut(a.unionByName(b))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycle_nodes(tree_links(spark, sf_dir)).select("tree_table", "tree_id", F.col("id").alias("node_id"))


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(tree_links(spark, sf_dir)).select(
        "tree_table", "tree_id", F.col("id").alias("node_id"), "status", "root", F.col("depth").cast("bigint").alias("depth"),
        F.array_join("path", " > ").alias("path"), F.col("n_descendants").cast("bigint").alias("n_descendants"),
        F.array_join("cycle_path", " > ").alias("cycle_path"))


def _descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = cut(hierarchy.hierarchy(tree_links(spark, sf_dir)))
    return hierarchy.descendants(tree).withColumn("distance", F.col("distance").cast("bigint"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each node under a root or orphan, one row per pair; :func:`p4_cycle_descendants` has the others."""
    return _descendants(spark, sf_dir).where("status = 'tree'").select("tree_table", "tree_id", "ancestor", "descendant", "distance")


def p4_cycle_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each node on or below a cycle, one row per pair; with p4_descendants these are all pairs."""
    return _descendants(spark, sf_dir).where("status <> 'tree'").select("tree_table", "tree_id", "ancestor", "descendant", "distance", "status")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = nested.occurrences(table(spark, sf_dir, "docling_records"), content=False)
    return nested.links_by_containment(cut(occ)).select("record_id", "parent_ref", "child_ref")


def p5_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = nested.occurrences(table(spark, sf_dir, "docling_records"))
    return occ.where("is_primary").select("record_id", "self_ref", "collection", "label", "content_layer", "text")


QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p4_cycle_descendants": p4_cycle_descendants, "p5_found": p5_found, "p5_elements": p5_elements}

_LINKS = """
links AS (
  SELECT 'inventory_items' AS tree_table, source_id AS tree_id, item_id AS id,
         max(CASE WHEN trim(parent_id) = '' THEN NULL ELSE parent_id END) AS parent
  FROM inventory_items GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'rst_nodes', concat(project, '/', user_name, '/', doc), id,
         max(CASE WHEN trim(parent) IN ('', '0') THEN NULL ELSE parent END)
  FROM rst_nodes GROUP BY 1, 2, 3)
"""
_DOWN = """
down AS (
  SELECT l.tree_table, l.tree_id, l.id, CASE WHEN l.parent IS NULL THEN 'root' ELSE 'orphan' END AS status, l.id AS root,
         CAST(0 AS BIGINT) AS depth, [l.id] AS path
  FROM links l LEFT JOIN links p ON p.tree_table = l.tree_table AND p.tree_id = l.tree_id AND p.id = l.parent
  WHERE p.id IS NULL
  UNION ALL
  SELECT c.tree_table, c.tree_id, c.id, 'node', d.root, d.depth + 1, list_append(d.path, c.id)
  FROM down d JOIN links c ON c.tree_table = d.tree_table AND c.tree_id = d.tree_id AND c.parent = d.id)
"""
_PAIRS = """
pairs AS (
  SELECT tree_table, tree_id, id AS descendant, depth, unnest(path) AS ancestor, unnest(range(len(path))) AS lvl FROM down)
"""
_UP = """
up AS (
  SELECT tree_table, tree_id, id, parent AS cur, [id] AS seen FROM links WHERE parent IS NOT NULL
  UNION ALL
  SELECT u.tree_table, u.tree_id, u.id, l.parent, list_append(u.seen, u.cur)
  FROM up u JOIN links l ON l.tree_table = u.tree_table AND l.tree_id = u.tree_id AND l.id = u.cur
  WHERE l.parent IS NOT NULL AND NOT list_contains(u.seen, u.cur)),
cyc AS (SELECT DISTINCT tree_table, tree_id, id FROM up WHERE cur = id)
"""
_ELEMENTS = """
good AS (SELECT DISTINCT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM docling_records WHERE json_valid(payload)),
elements AS (
  SELECT record_id, 'body' AS collection, p->'$.body' AS e FROM good UNION ALL
  SELECT record_id, 'furniture', p->'$.furniture' FROM good UNION ALL
  SELECT record_id, 'groups', unnest(json_extract(p, '$.groups[*]')) FROM good UNION ALL
  SELECT record_id, 'texts', unnest(json_extract(p, '$.texts[*]')) FROM good UNION ALL
  SELECT record_id, 'pictures', unnest(json_extract(p, '$.pictures[*]')) FROM good UNION ALL
  SELECT record_id, 'tables', unnest(json_extract(p, '$.tables[*]')) FROM good UNION ALL
  SELECT record_id, 'key_value_items', unnest(json_extract(p, '$.key_value_items[*]')) FROM good),
el AS (SELECT record_id, collection, e, e->>'$.self_ref' AS self_ref FROM elements WHERE e->>'$.self_ref' IS NOT NULL)
"""

ORACLES = {
    "p4_found": f"WITH RECURSIVE {_LINKS}, {_UP} SELECT tree_table, tree_id, id AS node_id FROM cyc",
    "p4_hierarchy": f"""WITH RECURSIVE {_LINKS}, {_DOWN}, {_UP},
below AS (SELECT tree_table, tree_id, cur AS id, count(*) AS n FROM up WHERE NOT list_contains(seen, cur) GROUP BY 1, 2, 3),
hung AS (SELECT u.tree_table, u.tree_id, u.id, arg_min(list_prepend(u.cur, list_reverse(u.seen)), len(u.seen)) AS p
  FROM up u JOIN cyc c ON c.tree_table = u.tree_table AND c.tree_id = u.tree_id AND c.id = u.cur GROUP BY 1, 2, 3)
SELECT l.tree_table, l.tree_id, l.id AS node_id, CASE WHEN c.id IS NOT NULL THEN 'cycle' WHEN h.id IS NOT NULL THEN 'below_cycle' ELSE d.status END AS status, d.root, d.depth,
  array_to_string(d.path, ' > ') AS path, CASE WHEN c.id IS NULL THEN coalesce(b.n, 0) END AS n_descendants, CASE WHEN c.id IS NOT NULL THEN l.id ELSE array_to_string(h.p, ' > ') END AS cycle_path
FROM links l LEFT JOIN down d USING (tree_table, tree_id, id) LEFT JOIN cyc c USING (tree_table, tree_id, id) LEFT JOIN below b USING (tree_table, tree_id, id) LEFT JOIN hung h USING (tree_table, tree_id, id)""",
    "p4_descendants": f"WITH RECURSIVE {_LINKS}, {_DOWN}, {_PAIRS} SELECT tree_table, tree_id, ancestor, descendant, CAST(depth - lvl AS BIGINT) AS distance FROM pairs WHERE lvl < depth",
    "p4_cycle_descendants": f"""WITH RECURSIVE {_LINKS}, {_UP}, shut AS (SELECT DISTINCT tree_table, tree_id, id FROM up WHERE list_contains(seen, cur))
SELECT u.tree_table, u.tree_id, u.cur AS ancestor, u.id AS descendant, CAST(len(u.seen) AS BIGINT) AS distance, CASE WHEN c.id IS NULL THEN 'below_cycle' ELSE 'cycle' END AS status
FROM up u JOIN shut s ON s.tree_table = u.tree_table AND s.tree_id = u.tree_id AND s.id = u.id LEFT JOIN cyc c ON c.tree_table = u.tree_table AND c.tree_id = u.tree_id AND c.id = u.id
WHERE NOT list_contains(u.seen, u.cur)""",
    "p5_found": f"""WITH {_ELEMENTS},
stated AS (
  SELECT record_id, coalesce(e->'$.parent'->>'$."$ref"', e->'$.parent'->>'$.cref') AS parent_ref, self_ref AS child_ref FROM el
  UNION
  SELECT record_id, self_ref, coalesce(c->>'$."$ref"', c->>'$.cref') FROM (
    SELECT record_id, self_ref, unnest(json_extract(e, '$.children[*]')) AS c FROM el))
SELECT DISTINCT s.record_id, parent_ref, child_ref FROM stated s
WHERE (s.record_id, parent_ref) IN (SELECT record_id, self_ref FROM el) AND (s.record_id, child_ref) IN (SELECT record_id, self_ref FROM el)""",
    "p5_elements": f"""WITH {_ELEMENTS} SELECT record_id, self_ref, collection, e->>'$.label' AS label, e->>'$.content_layer' AS content_layer, e->>'$.text' AS text FROM el""",
}
