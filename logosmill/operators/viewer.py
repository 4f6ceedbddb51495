"""Reads and edits of annotated trees as a viewer makes them: each edit returns the new node table.

Node tables are those of :mod:`logosmill.operators.trees`; ``relations`` are
(tree_id, relname, reltype) with reltype 'rst' or 'multinuc'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.operators import hierarchy as H
from logosmill.session import cut


def node_facts(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(tree_id, id, kind, relname, reltype, children, multinuc_children, first_child, last_child) of every node; reltype is null for a relation that is not declared."""
    declared = relations.groupBy("tree_id", "relname").agg(F.min("reltype").alias("reltype"))
    typed = nodes.join(declared, ["tree_id", "relname"], "left")
    below = typed.where("parent is not null").groupBy("tree_id", F.col("parent").alias("id")).agg(
        F.count("*").alias("children"), F.count(F.when(F.col("reltype") == "multinuc", 1)).alias("multinuc_children"), F.min("left_edge").alias("first_child"), F.max("right_edge").alias("last_child"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return typed.join(below, ["tree_id", "id"], "left").select("tree_id", "id", "kind", "relname", "reltype", zero("children"), zero("multinuc_children"), "first_child", "last_child")


def default_relations(relations: DataFrame) -> DataFrame:
    """(tree_id, reltype, relname): the first relation name of each type."""
    return relations.groupBy("tree_id", "reltype").agg(F.min("relname").alias("relname"))


def with_parent(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Nodes with the parents and relations of ``edits`` (tree_id, id, parent, relname); of several edits of one node the greatest parent counts, a null relname keeps the old one."""
    one = edits.groupBy("tree_id", "id").agg(F.max(F.struct("parent", "relname")).alias("_e"))
    rows = nodes.join(one, ["tree_id", "id"], "left")
    hit = F.col("_e").isNotNull()
    return rows.select(*[
        F.when(hit, F.col("_e.parent")).otherwise(F.col(c)).alias(c) if c == "parent"
        else F.when(hit, F.coalesce("_e.relname", "relname")).otherwise(F.col(c)).alias(c) if c == "relname" else F.col(c) for c in nodes.columns])


def without_subtrees(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes but for ``removed`` (tree_id, id) and everything below them; what lies on a cycle goes with any node of it."""
    links = nodes.select(F.lit("nodes").alias("tree_table"), "tree_id", "id", "parent")
    below = H.descendants(H.hierarchy(links)).select("tree_id", F.col("ancestor").alias("id"), "descendant")
    gone = removed.select("tree_id", "id").distinct()
    all_gone = gone.unionByName(below.join(gone, ["tree_id", "id"]).select("tree_id", F.col("descendant").alias("id"))).distinct()
    return nodes.join(all_gone, ["tree_id", "id"], "left_anti").select(*nodes.columns)


def without_empty_groups(nodes: DataFrame) -> DataFrame:
    """Nodes but for groups (span, multinuc) that hold nothing; a group that only held such goes too."""
    rows = nodes
    while True:
        used = rows.where("parent is not null").select("tree_id", F.col("parent").alias("id")).distinct()
        empty = rows.where("kind <> 'edu'").join(used, ["tree_id", "id"], "left_anti").select("tree_id", "id")
        empty = cut(empty)
        if empty.isEmpty():
            return rows
        rows = cut(rows.join(empty, ["tree_id", "id"], "left_anti").select(*nodes.columns))


def split_unit(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """Nodes with elementary units split after ``at`` characters: ``splits`` (tree_id, id, at), one a tree.

    Units are numbered by place, so the ids of later nodes and all parents move up by
    one; the new unit gets the id after the old one, its parent and relation.  Ids must
    be numbers; a place outside the text splits nothing.
    """
    one = splits.groupBy("tree_id").agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "at")).alias("_s"))
    text = nodes.where("kind = 'edu'").select("tree_id", F.col("id").cast("long").alias("_i"), F.length("contents").alias("_n"))
    valid = one.join(text, (one.tree_id == text.tree_id) & (F.col("_s.id") == F.col("_i")), "left_semi").join(
        text.withColumnRenamed("tree_id", "_t"), (F.col("tree_id") == F.col("_t")) & (F.col("_s.id") == F.col("_i"))).where("_s.at > 0 and _s.at < _n").select("tree_id", "_s")
    rows = nodes.join(valid, "tree_id", "left")
    moved = lambda c: F.when(F.col("_s").isNotNull() & (F.col(c).cast("long") > F.col("_s.id")), (F.col(c).cast("long") + 1).cast("string")).otherwise(F.col(c))
    here = F.col("_s").isNotNull() & (F.col("id").cast("long") == F.col("_s.id"))
    edge = lambda c: F.when(F.col("_s").isNotNull() & (F.col(c) > F.col("_s.id")), F.col(c) + 1).otherwise(F.col(c))
    cols = {"id": moved("id"), "parent": moved("parent"), "left_edge": edge("left_edge"), "right_edge": edge("right_edge"),
            "contents": F.when(here, F.expr("substring(contents, 1, _s.at)")).otherwise(F.col("contents"))}
    out = rows.select(*[cols.get(c, F.col(c)).alias(c) for c in nodes.columns])
    new = {"id": (F.col("_s.id") + 1).cast("string"), "parent": moved("parent"), "left_edge": F.col("left_edge") + 1, "right_edge": F.col("right_edge") + 1, "contents": F.expr("substring(contents, _s.at + 1)")}
    return out.unionByName(rows.where(here).select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns]))
