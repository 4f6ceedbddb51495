"""Discourse trees as node tables: spans, statistics, central units, exports, checks, conversions.

Node tables have (tree_id, id, parent, kind, relname, left_edge, right_edge, contents);
kind is edu, span or multinuc, and a child's relname says how it hangs from its parent
('span' for the nucleus of a span).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.operators import hierarchy as H
from logosmill.operators.grouped import LOCAL_ROWS, by_size, on_whole_groups, places
from logosmill.session import cut

# Relation families.
SUBJECT_MATTER = (
    "elaboration circumstance cause volitional-cause non-volitional-cause result volitional-result non-volitional-result purpose condition "
    "otherwise interpretation means solutionhood sequence contrast joint list same-unit restatement summary evaluation comparison").split()
PRESENTATIONAL = "motivation antithesis background enablement evidence justify concession preparation".split()
THIN = ("joint", "same-unit", "organization")  # fixed values: relations that say little
PATH_SLICE = 4_000_000  # characters of paths in a frame of results


def tree_nodes(raw: DataFrame) -> DataFrame:
    """Node table of annotation rows, one row a node; root marks become null parents."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    parent = F.when(F.trim("parent").isin("", "0"), None).otherwise(F.col("parent"))
    keep = ["parent", "kind", "relname", "left_edge", "right_edge", "contents"]
    rows = raw.where("id is not null").select(F.concat_ws("/", part("project"), part("user_name"), part("doc")).alias("tree_id"), "id", *[(parent if c == "parent" else F.col(c)).alias(c) for c in keep])
    return rows.groupBy("tree_id", "id").agg(*[F.min(c).alias(c) for c in keep])


def relation_category(label: Column) -> Column:
    """subject_matter, presentational or unknown: by the whole label, then its first or last part."""
    raw = F.trim(F.translate(F.lower(label), "_", "-"))
    parts = F.split(raw, "-")
    ends = lambda names: F.get(parts, F.lit(0)).isin(*names) | F.element_at(parts, -1).isin(*names)
    return (F.when(raw.isin(*SUBJECT_MATTER), "subject_matter").when(raw.isin(*PRESENTATIONAL), "presentational")
            .when(ends(SUBJECT_MATTER), "subject_matter").when(ends(PRESENTATIONAL), "presentational").otherwise("unknown"))


def _links(nodes: DataFrame, keep: Column | None = None) -> DataFrame:
    parent = F.col("parent") if keep is None else F.when(keep, F.col("parent"))
    return nodes.select(F.lit("nodes").alias("tree_table"), "tree_id", "id", parent.alias("parent"))


def spans(nodes: DataFrame, cycles: bool = False) -> DataFrame:
    """(tree_id, id, depth, first_edu, last_edu): what each node covers, by its descendants.

    Nodes on or below cycles have no depth; they cover only themselves, or what they
    reach, round the cycle too, with ``cycles``.
    """
    tree = cut(H.hierarchy(_links(nodes)))
    edus = nodes.where("kind = 'edu'").select("tree_id", "id", "left_edge")
    pairs = H.descendants(tree)
    below = (pairs if cycles else pairs.where("status = 'tree'")).select("tree_id", "ancestor", F.col("descendant").alias("id")).join(edus, ["tree_id", "id"])
    cover = below.select("tree_id", F.col("ancestor").alias("id"), "left_edge").unionByName(edus).groupBy("tree_id", "id").agg(
        F.min("left_edge").alias("first_edu"), F.max("left_edge").alias("last_edu"))
    return tree.select("tree_id", "id", "depth", "status").join(cover, ["tree_id", "id"], "left")


def statistics(nodes: DataFrame) -> DataFrame:
    """Per tree: units, inner nodes, nuclei and satellites, their ratio, relations by family, thin share."""
    linked = F.col("parent").isNotNull()
    rel = F.when(linked & (F.col("relname") != "span"), F.col("relname"))
    cat = relation_category(rel)
    thin = reduce(lambda a, b: a | b, [F.lower(rel).startswith(t) for t in THIN])
    count = lambda c: F.count(F.when(c, 1))
    kinds = nodes.select(F.col("tree_id"), F.col("id").alias("parent"), F.col("kind").alias("p_kind"))
    rows = nodes.join(kinds, ["tree_id", "parent"], "left")
    nucleus = linked & (F.coalesce(F.col("relname") == "span", F.lit(False)) | (F.coalesce("p_kind", F.lit("")) == "multinuc"))
    out = rows.groupBy("tree_id").agg(
        count(F.col("kind") == "edu").alias("edus"), count(F.col("kind") != "edu").alias("inner_nodes"), count(nucleus).alias("nuclei"),
        count(linked & ~nucleus).alias("satellites"), count(cat == "subject_matter").alias("subject_matter"), count(cat == "presentational").alias("presentational"),
        count(rel.isNotNull() & (cat == "unknown")).alias("unknown"), count(rel.isNotNull()).alias("relations"), count(thin).alias("thin"))
    share = F.coalesce(F.try_divide(F.col("thin").cast("double"), "relations"), F.lit(0.0))
    return out.withColumn("nucleus_ratio", F.try_divide(F.col("nuclei").cast("double"), "satellites")).withColumn("thin_share", F.round(share, 3)).drop("thin")


def _nucleus_links(nodes: DataFrame, force_leaf: bool) -> DataFrame:
    """Each node keeps its link only if it is the nucleus one descends to from its parent."""
    parents = nodes.select("tree_id", F.col("id").alias("parent"), F.col("kind").alias("p_kind"))
    rows = nodes.join(parents, ["tree_id", "parent"], "left")
    eligible = F.when(F.col("p_kind") == "multinuc", F.lit(force_leaf)).otherwise(F.col("relname") == "span")
    best = F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy(F.when(eligible, 0).otherwise(1), F.col("left_edge").asc_nulls_last(), "id"))
    return _links(rows.withColumn("keep", F.coalesce(eligible, F.lit(False)) & (best == 1)), F.col("keep"))


def central_units(nodes: DataFrame, force_leaf: bool = False) -> DataFrame:
    """(tree_id, root, unit): where following the nucleus from each root ends.

    Stops at a multinuclear node, or, with ``force_leaf``, goes on with its first child.
    Kept links form chains, so the unit is the lowest node of the root's chain.
    """
    chains = H.hierarchy(_nucleus_links(nodes, force_leaf))
    last = chains.where("root is not null").groupBy("tree_id", "root").agg(F.max_by("id", "depth").alias("unit"))
    roots = nodes.where("parent is null").select("tree_id", F.col("id").alias("root"))
    return roots.join(last, ["tree_id", "root"])


def spine_texts(nodes: DataFrame) -> DataFrame:
    """(tree_id, root, text) of the elementary unit reached by nuclei."""
    units = central_units(nodes, force_leaf=True).withColumnRenamed("unit", "id")
    return units.join(nodes.select("tree_id", "id", "contents"), ["tree_id", "id"]).select("tree_id", "root", F.col("contents").alias("text"))


def triples(nodes: DataFrame, base: str = "https://data.example/discourse/", ns: str = "https://data.example/ns#") -> DataFrame:
    """(subject, predicate, object) statements about nodes and links."""
    doc = F.concat(F.lit(base), F.col("tree_id"))
    node, up = F.concat(doc, F.lit("#node_"), "id"), F.concat(doc, F.lit("#node_"), "parent")
    edge = F.concat(doc, F.lit("#edge_"), "id")
    p = lambda s, name, o, when=None: F.struct(s.alias("subject"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if name == "type" else ns + name).alias("predicate"), (o if when is None else F.when(when, o)).alias("object"))
    has = F.col("parent").isNotNull()
    every = F.array(
        p(node, "type", F.concat(F.lit(ns), F.when(F.col("kind") == "edu", "ElementaryDiscourseUnit").otherwise("ComplexDiscourseUnit"))),
        p(node, "partOfDocument", doc), p(node, "text", F.concat(F.lit('"'), "contents", F.lit('"'))),
        p(node, "eduStart", F.col("left_edge").cast("int").cast("string")), p(node, "eduEnd", F.col("right_edge").cast("int").cast("string")),
        p(edge, "type", F.lit(ns + "PrimaryDiscourseRelation"), has), p(edge, "hasParent", up, has), p(edge, "hasChild", node, has),
        p(edge, "relationRaw", F.concat(F.lit('"'), "relname", F.lit('"')), has))
    return nodes.select(F.explode(every).alias("t")).select("t.*").where("object is not null")


# Characters that an IRI must not have as they are, and escapes in literals, in order.
IRI_ESCAPES = {" ": "%20", "<": "%3C", ">": "%3E", '"': "%22", "{": "%7B", "}": "%7D", "|": "%7C", "^": "%5E", "`": "%60", "\\": "%5C", "\n": "%0A", "\r": "%0D", "\t": "%09"}
LITERAL_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def turtle(statements: DataFrame) -> DataFrame:
    """One Turtle line a statement; literals escaped, other objects as IRIs, percent-encoded, or numbers."""
    literal = F.col("object").startswith('"')
    inner = F.expr("substring(object, 2, length(object) - 2)")
    iri = lambda c: F.concat(F.lit("<"), _replaced(F.col(c), IRI_ESCAPES), F.lit(">"))
    obj = F.when(literal, F.concat(F.lit('"'), _replaced(inner, LITERAL_ESCAPES), F.lit('"'))).when(F.col("object").rlike("^-?[0-9]+$"), F.col("object")).otherwise(iri("object"))
    return statements.select(F.concat(iri("subject"), F.lit(" "), iri("predicate"), F.lit(" "), obj, F.lit(" .")).alias("value"))


def chunks(nodes: DataFrame) -> DataFrame:
    """(chunk_id, chunk_type, text, parent_chunk, children) for retrieval over trees."""
    name = lambda c: F.concat("tree_id", F.lit("__node_"), F.col(c))
    kids = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("children"))
    return nodes.join(kids, ["tree_id", "id"], "left").select(name("id").alias("chunk_id"), F.col("kind").alias("chunk_type"), F.col("contents").alias("text"), name("parent").alias("parent_chunk"), F.coalesce("children", F.lit("")).alias("children"))


def rs3(nodes: DataFrame) -> DataFrame:
    """(tree_id, rs3): the annotation tool's file of every tree, nodes by number.

    A tree is one row, as a file is one piece; its size is bounded by the document's.
    """
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    tie = F.concat(F.when(F.col("parent").isNotNull(), F.concat(F.lit(' parent="'), "parent", F.lit('"'))).otherwise(""),
                   F.when(F.col("parent").isNotNull() & F.col("relname").isNotNull(), F.concat(F.lit(' relname="'), esc(F.col("relname")), F.lit('"'))).otherwise(""))
    seg = F.concat(F.lit('<segment id="'), "id", F.lit('"'), tie, F.lit(">"), F.coalesce(esc(F.col("contents")), F.lit("")), F.lit("</segment>"))
    group = F.concat(F.lit('<group id="'), "id", F.lit('" type="'), "kind", F.lit('"'), tie, F.lit("/>"))
    line = F.struct(F.when(F.col("kind") == "edu", 0).otherwise(1).alias("o"), F.length("id").alias("n"), F.col("id").alias("i"), F.when(F.col("kind") == "edu", seg).otherwise(group).alias("x"))
    multi = nodes.select("tree_id", F.col("id").alias("parent"), F.col("kind").alias("p_kind"))
    kind = F.when(F.col("p_kind") == "multinuc", "multinuc").otherwise("rst")
    rels = nodes.where("parent is not null and relname is not null and relname <> '' and relname <> 'span'").join(multi, ["tree_id", "parent"], "left").groupBy("tree_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('<rel name="'), esc(F.col("relname")), F.lit('" type="'), kind, F.lit('"/>')))), "").alias("rels"))
    body = nodes.groupBy("tree_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["x"]), "").alias("body"))
    return body.join(rels, "tree_id", "left").select("tree_id", F.concat(F.lit("<rst><header><relations>"), F.coalesce("rels", F.lit("")), F.lit("</relations></header><body>"), "body", F.lit("</body></rst>")).alias("rs3"))


def violations(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, rule): missing parents, parents that are units of text, several roots or none, single children of multinuclear nodes, empty inner nodes."""
    up = nodes.where("parent is not null")
    par = nodes.select("tree_id", F.col("id").alias("parent"), F.col("kind").alias("p_kind"))
    joined = up.join(par, ["tree_id", "parent"], "left")
    kids = up.groupBy("tree_id", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    with_kids = nodes.where("kind <> 'edu'").join(kids, ["tree_id", "id"], "left")
    roots = nodes.groupBy("tree_id").agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("r"))
    rule = lambda df, name: df.select("tree_id", "id", F.lit(name).alias("rule"))
    parts = [
        rule(joined.where("p_kind is null"), "missing_parent"),
        rule(joined.where("parent = id"), "own_parent"),
        rule(with_kids.where("coalesce(n, 0) = 0"), "inner_node_without_children"),
        rule(with_kids.where("kind = 'multinuc' and n = 1"), "multinuclear_with_one_child"),
        roots.where("r > 1").select("tree_id", F.lit(None).cast("string").alias("id"), F.lit("several_roots").alias("rule")),
        roots.where("r = 0").select("tree_id", F.lit(None).cast("string").alias("id"), F.lit("no_root").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- bracket strings and binary trees --------------------------------------------------

_BRACKET = r"\((\d+):(\w+)=([^:,;()]+):(\d+),(\d+):(\w+)=([^:,;()]+):(\d+)((?:;[a-z]+=[-0-9.eE]+)*)\)"


def read_brackets(trees: DataFrame) -> DataFrame:
    """(tree_id, start, split, stop, left_nuc, left_rel, right_nuc, right_rel, entropy) of bracket strings.

    ``trees``: tree_id, brackets.  Parts that don't fit the form give no rows.
    """
    each = trees.select("tree_id", F.explode(F.split("brackets", r"\s+")).alias("b")).where(F.col("b").rlike(f"^{_BRACKET}$"))
    g = lambda i: F.regexp_extract("b", _BRACKET, i)
    ent = F.nullif(F.regexp_extract("b", r";entropy=([-0-9.eE]+)", 1), F.lit(""))
    return each.select("tree_id", g(1).cast("int").alias("start"), g(4).cast("int").alias("split"), g(8).cast("int").alias("stop"),
                       g(2).alias("left_nuc"), g(3).alias("left_rel"), g(6).alias("right_nuc"), g(7).alias("right_rel"), ent.cast("double").alias("entropy"))


def bracket_children(spans: DataFrame) -> DataFrame:
    """Adds left_inner and right_inner: whether each part has a bracket of its own."""
    key = spans.select("tree_id", F.col("start").alias("a"), F.col("stop").alias("b"), F.lit(True).alias("k")).distinct()
    left = key.select("tree_id", F.col("a").alias("start"), F.col("b").alias("split"), F.col("k").alias("l"))
    right = key.select("tree_id", F.col("a").alias("_r"), F.col("b").alias("stop"), F.col("k").alias("r"))
    out = spans.withColumn("_r", F.col("split") + 1).join(left, ["tree_id", "start", "split"], "left").join(right, ["tree_id", "_r", "stop"], "left")
    return out.withColumn("left_inner", F.coalesce("l", F.lit(False))).withColumn("right_inner", F.coalesce("r", F.lit(False))).drop("l", "r", "_r")


def decode_table(rows: DataFrame) -> DataFrame:
    """(tree_id, rule): what keeps rows (tree_id, start, stop, split) from being one binary tree.

    The widest span is the root; there must be one row less than units, every row once,
    splits inside spans, and every span but the root must be a part of another.
    """
    w = rows.groupBy("tree_id").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"), F.count("*").alias("n"))
    parts = rows.select("tree_id", F.explode(F.array(F.struct(F.col("start").alias("start"), F.col("split").alias("stop")), F.struct((F.col("split") + 1).alias("start"), F.col("stop").alias("stop")))).alias("p")).select("tree_id", "p.*").distinct()
    orphan = rows.select("tree_id", "start", "stop").distinct().join(parts, ["tree_id", "start", "stop"], "left_anti").join(w, "tree_id").where("not (start = lo and stop = hi)")
    lost = parts.where("start < stop").join(rows.select("tree_id", "start", "stop"), ["tree_id", "start", "stop"], "left_anti")
    rule = lambda df, name: df.select("tree_id", F.lit(name).alias("rule")).distinct()
    return reduce(DataFrame.unionByName, [
        rule(w.where("n <> hi - lo"), "wrong_number_of_rows"), rule(rows.groupBy("tree_id", "start", "stop").count().where("count > 1"), "repeated_span"),
        rule(rows.where("split < start or split >= stop"), "split_outside"), rule(orphan, "unreachable"), rule(lost, "missing_part")])


def cky(scores: pd.DataFrame, n: int) -> list[tuple[int, int, int]]:
    """Best binary tree over units 1..n: (start, stop, split), top down.

    ``scores`` has start, stop, split, score; a missing cell scores zero, and the first
    best split wins.
    """
    given = {(a, b, k): s for a, b, k, s in scores[["start", "stop", "split", "score"]].itertuples(index=False)}
    best = {(i, i): (0.0, 0) for i in range(1, n + 1)}
    for width in range(2, n + 1):
        for a in range(1, n - width + 2):
            b = a + width - 1
            options = [(best[a, k][0] + best[k + 1, b][0] + given.get((a, b, k), 0.0), k) for k in range(a, b)]
            best[a, b] = max(options, key=lambda x: (x[0], -x[1]))
    out, todo = [], [(1, n)]
    while todo:
        a, b = todo.pop(0)
        if a < b:
            k = best[a, b][1]
            out.append((a, b, k))
            todo += [(a, k), (k + 1, b)]
    return out


def cky_decode(scores: DataFrame) -> DataFrame:
    """(tree_id, start, stop, split) of the best tree of (tree_id, n, start, stop, split, score), per document."""
    kind = dict(scores.dtypes)["tree_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = cky(pdf, int(pdf["n"].iloc[0]))
        return pd.DataFrame([(pdf.tree_id.iloc[0], *r) for r in rows], columns=["tree_id", "start", "stop", "split"])

    return scores.groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, start int, stop int, split int")


def binarised(children: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Steps that make n children binary: (first, last, nuclearity, relation) from the outside in.

    ``children``: (role 'N' or 'S', relation), in order.  Outer satellites are peeled off,
    the left one first; the rest joins to the right.  The result has n - 1 steps.
    """
    steps, lo, hi = [], 0, len(children) - 1
    while lo < hi:
        if children[lo][0] == "S":
            steps.append((lo, hi, "SN", children[lo][1]))
            lo += 1
        elif children[hi][0] == "S":
            steps.append((lo, hi, "NS", children[hi][1]))
            hi -= 1
        else:
            steps.append((lo, hi, "NN", children[lo][1]))
            lo += 1
    return steps


def stitched(micro: DataFrame, macro: DataFrame, sections: DataFrame) -> DataFrame:
    """One tree of section trees and a tree over sections.

    ``micro``: doc_id, section_no, node_id, parent_id, start_pos, stop_pos; ``macro``: doc_id,
    node_id, parent_id, section_no (null inside); ``sections``: doc_id, section_no, start_pos.
    Ids become 'section:node' and 'm:node', offsets absolute; a macro leaf is replaced by its
    section's root.
    """
    abs_ = micro.join(sections.select("doc_id", "section_no", F.col("start_pos").alias("_o")), ["doc_id", "section_no"])
    leaf = macro.where("section_no is not null").select("doc_id", "section_no", F.concat(F.lit("m:"), "parent_id").alias("_up"))
    inner = abs_.join(leaf, ["doc_id", "section_no"], "left").select(
        "doc_id", F.concat("section_no", F.lit(":"), "node_id").alias("node_id"),
        F.when(F.col("parent_id").isNull(), F.col("_up")).otherwise(F.concat("section_no", F.lit(":"), "parent_id")).alias("parent_id"),
        (F.col("start_pos") + F.col("_o")).alias("start_pos"), (F.col("stop_pos") + F.col("_o")).alias("stop_pos"))
    outer = macro.where("section_no is null").select("doc_id", F.concat(F.lit("m:"), "node_id").alias("node_id"), F.concat(F.lit("m:"), "parent_id").alias("parent_id"),
                                                     F.lit(None).cast("bigint").alias("start_pos"), F.lit(None).cast("bigint").alias("stop_pos"))
    return inner.unionByName(outer)


def recombination_violations(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, unit_no, rule) of what :func:`recombined` refuses a document for.

    rule: 'roots' (a unit without exactly one root, also without nodes), 'unknown_unit'
    (nodes of a unit that isn't stated) or 'single_unit' (nothing to recombine).
    """
    roots = nodes.groupBy("doc_id", "unit_no").agg(F.count(F.when(F.col("parent_id").isNull(), 1)).alias("r"))
    bad = units.join(roots, ["doc_id", "unit_no"], "left").where(F.coalesce("r", F.lit(0)) != 1).select("doc_id", "unit_no", F.lit("roots").alias("rule"))
    unknown = roots.join(units, ["doc_id", "unit_no"], "left_anti").select("doc_id", "unit_no", F.lit("unknown_unit").alias("rule"))
    single = units.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("unit_no").alias("unit_no")).where("n < 2").select("doc_id", "unit_no", F.lit("single_unit").alias("rule"))
    return bad.unionByName(unknown).unionByName(single)


def recombined(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """One tree per document out of the trees of its units, under one 'same-unit' root over the unit roots.

    ``nodes``: doc_id, unit_no, node_id, parent_id, relation, nuclearity, first_edu, last_edu
    (from 1 in each unit), start_pos, stop_pos; ``units``: doc_id, unit_no, start_pos, stop_pos.
    Result: the same with ids running on from unit to unit, units and characters of the
    document, and local_id; the new root comes last and has no unit_no.  A document with a
    violation gives no rows.
    """
    refused = recombination_violations(nodes, units).select("doc_id").distinct()
    good = nodes.join(refused, "doc_id", "left_anti")
    edus = good.groupBy("doc_id", "unit_no").agg(F.max("last_edu").alias("_edus"))
    before = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = units.select("doc_id", "unit_no", F.col("start_pos").alias("_o")).join(edus, ["doc_id", "unit_no"]).withColumn("_e", F.coalesce(F.sum("_edus").over(before), F.lit(0)))
    ids = good.select("doc_id", "unit_no", "node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no", "node_id")).alias("_id"))
    up = ids.select("doc_id", "unit_no", F.col("node_id").alias("parent_id"), F.col("_id").alias("_up"))
    ends = units.groupBy("doc_id").agg(F.max("stop_pos").alias("_stop"))
    last = ids.groupBy("doc_id").agg((F.max("_id") + 1).alias("_root")).join(edus.groupBy("doc_id").agg(F.sum("_edus").alias("_n")), "doc_id").join(ends, "doc_id")
    top = F.col("parent_id").isNull()
    moved = good.join(ids, ["doc_id", "unit_no", "node_id"]).join(up, ["doc_id", "unit_no", "parent_id"], "left").join(
        offset.drop("_edus"), ["doc_id", "unit_no"]).join(last.select("doc_id", "_root"), "doc_id")
    big = lambda c, name: c.cast("bigint").alias(name)
    rows = moved.select(
        "doc_id", "unit_no", big(F.col("_id"), "node_id"), big(F.when(top, F.col("_root")).otherwise(F.col("_up")), "parent_id"),
        F.when(top, "same-unit").otherwise(F.col("relation")).alias("relation"), F.when(top, "NN").otherwise(F.col("nuclearity")).alias("nuclearity"),
        big(F.col("first_edu") + F.col("_e"), "first_edu"), big(F.col("last_edu") + F.col("_e"), "last_edu"),
        big(F.col("start_pos") + F.col("_o"), "start_pos"), big(F.col("stop_pos") + F.col("_o"), "stop_pos"), F.col("node_id").alias("local_id"))
    kinds = dict(rows.dtypes)
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    root = last.select(
        "doc_id", none("unit_no"), big(F.col("_root"), "node_id"), none("parent_id"), none("relation"), none("nuclearity"), big(F.lit(1), "first_edu"), big(F.col("_n"), "last_edu"),
        big(F.lit(0), "start_pos"), big(F.col("_stop"), "stop_pos"), none("local_id"))
    return rows.unionByName(root)


def diagnostics(nodes: DataFrame) -> DataFrame:
    """(tree_id, edus, depth, skew, relations) of annotated trees; nodes on or below cycles count for no depth.

    skew is the depth over that of a balanced tree of as many elementary units, which is
    1 at least; relations are parents with a child whose label is not 'span'.
    """
    deep = H.hierarchy(_links(nodes)).groupBy("tree_id").agg(F.max("depth").alias("depth"))
    counts = nodes.groupBy("tree_id").agg(
        F.count(F.when(F.col("kind") == "edu", 1)).alias("edus"),
        F.countDistinct(F.when(F.col("relname").isNotNull() & (F.col("relname") != "span") & F.col("parent").isNotNull(), F.col("parent"))).alias("relations"))
    balanced = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("edus"), F.lit(1))))).cast("int")
    return counts.join(deep, "tree_id", "left").select("tree_id", "edus", F.coalesce("depth", F.lit(0)).alias("depth"), F.round(F.coalesce("depth", F.lit(0)) / balanced, 2).alias("skew"), "relations")


def graph_edges(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """(tree_id, src, dst, edge_id, relation, signals): the trees as a keyed multigraph; signals (tree_id, edge_id, signal_type) are listed by type."""
    edges = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("src"), F.col("id").alias("dst"), F.concat(F.lit("e"), F.col("id")).alias("edge_id"), F.col("relname").alias("relation"))
    listed = signals.groupBy("tree_id", "edge_id").agg(F.array_join(F.sort_array(F.collect_list("signal_type")), ",").alias("signals"))
    return edges.join(listed, ["tree_id", "edge_id"], "left").select("tree_id", "src", "dst", "edge_id", "relation", "signals")


def json_ld(nodes: DataFrame, base: str = "http://example.org/discourse/") -> DataFrame:
    """(tree_id, document): each tree's nodes and edges as one JSON-LD text, nodes by id, then edges by child."""
    place = F.concat(F.lit("doc:node_"), F.col("id"))
    node = F.struct(place.alias("@id"), F.when(F.col("kind") == "edu", "ElementaryDiscourseUnit").otherwise("ComplexDiscourseUnit").alias("@type"), F.col("contents").alias("text"))
    edge = F.when(F.col("parent").isNotNull(), F.struct(
        F.concat(F.lit("doc:edge_"), F.col("id")).alias("@id"), F.lit("PrimaryDiscourseRelation").alias("@type"), F.concat(F.lit("doc:node_"), F.col("parent")).alias("hasParent"), place.alias("hasChild"),
        F.col("relname").alias("relationRaw")))
    # Texts of one kind each, so that every part has its own fields.
    rows = nodes.groupBy("tree_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", F.to_json(node).alias("j")))), lambda x: x["j"]).alias("ns"),
        F.transform(F.sort_array(F.collect_list(F.when(edge.isNotNull(), F.struct("id", F.to_json(edge).alias("j"))))), lambda x: x["j"]).alias("es"))
    head = F.to_json(F.struct(F.concat(F.lit(base), F.col("tree_id")).alias("@id"), F.lit("DiscourseDocument").alias("@type")))
    context = F.to_json(F.struct(F.struct(F.concat(F.lit(base), F.col("tree_id"), F.lit("#")).alias("doc")).alias("@context")))
    return rows.select("tree_id", F.concat(F.regexp_replace(context, r"\}$", ""), F.lit(',"@graph":['), F.array_join(F.concat(F.array(head), "ns", "es"), ","), F.lit("]}")).alias("document"))


def target_rows(spans: DataFrame, key: str) -> DataFrame:
    """(key, i, j, nuc, rel) of binary spans (key, s, e, nuc, rel), 0-based; elementary ones have -100 for both classes. Spans given twice count once."""
    leaf = F.col("s") == F.col("e")
    return spans.where("s is not null and e is not null").groupBy(key, "s", "e").agg(F.min("nuc").alias("nuc"), F.min("rel").alias("rel")).select(
        key, (F.col("s") - 1).alias("i"), (F.col("e") - 1).alias("j"), F.when(leaf, -100).otherwise(F.col("nuc")).alias("nuc"), F.when(leaf, -100).otherwise(F.col("rel")).alias("rel"))


def tree_of_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, node_id, parent_id, side, s, e, label): the tree of decisions (key, s, e, split, label), split being the last unit of the left part.

    Nodes are numbered from 0 by falling length, then place.  Parts of one unit are
    nodes without a decision of their own; a part of more units without one has a null
    label, as has a table that :func:`table_violations` complains of.
    """
    one = rows.groupBy(key, "s", "e").agg(F.min(F.struct("split", "label")).alias("d")).select(key, "s", "e", "d.split", "d.label")
    parts = one.select(key, F.col("s").alias("ps"), F.col("e").alias("pe"), F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col("s").alias("s"), F.col("split").alias("e")), F.struct(F.lit("right").alias("side"), (F.col("split") + 1).alias("s"), F.col("e").alias("e")))).alias("x")).select(key, "ps", "pe", "x.*")
    spans = one.select(key, "s", "e").unionByName(parts.select(key, "s", "e")).distinct().join(one.select(key, "s", "e", "label"), [key, "s", "e"], "left").join(
        parts.groupBy(key, "s", "e").agg(F.min(F.struct("ps", "pe", "side")).alias("up")), [key, "s", "e"], "left")
    numbered = spans.withColumn("node_id", F.row_number().over(Window.partitionBy(key).orderBy((F.col("s") - F.col("e")), "s")) - 1)
    up = numbered.select(key, F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("node_id").alias("parent_id"))
    return numbered.withColumns({"ps": F.col("up.ps"), "pe": F.col("up.pe"), "side": F.col("up.side")}).join(up, [key, "ps", "pe"], "left").select(key, "node_id", "parent_id", "side", "s", "e", "label")


def build_actions(spans: DataFrame, key: str) -> DataFrame:
    """(key, step, action, s, e): shifts of units and reductions of spans (key, s, e) in the order in which a bottom-up parser makes them. Spans given twice count once."""
    w = Window.partitionBy(key).orderBy("e", F.col("e") - F.col("s"))
    once = spans.where("s is not null and e is not null").select(key, "s", "e").distinct()
    return once.select(key, (F.row_number().over(w) - 1).alias("step"), F.when(F.col("s") == F.col("e"), "shift").otherwise("reduce").alias("action"), "s", "e")


def _path_rows(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The paths within whole trees, of rows of nodes (id, parent, r) and rows of pairs (source_id, target_id)."""
    (own, up, source, target), n = places(part, ["tree_id"], ["id", "parent", "source_id", "target_id"])
    node = np.flatnonzero(own >= 0)
    if not len(node):
        return
    at = np.full(n + 1, -1, dtype=np.int64)  # the last place is that of nulls
    at[own[node]] = np.arange(len(node))
    parent = at[up[node]]
    cycle, root, depth, anchor, _ = H.Contraction(parent).expanded()
    good = ~cycle & (anchor < 0)
    s, t = at[source], at[target]
    pairs = pd.DataFrame({"s": s, "t": t})[(s >= 0) & (t >= 0) & good[s] & good[t] & (root[s] == root[t])].drop_duplicates()
    found = part.loc[pairs.index, ["tree_id", "source_id", "target_id"]].reset_index(drop=True)
    above, level, label = parent.tolist(), depth.tolist(), part["r"].to_numpy(dtype=object)[node].tolist()
    paths: list[str] = []
    begin = held = 0
    for a, b in zip(pairs["s"].tolist(), pairs["t"].tolist()):
        ups, downs = [], []
        while a != b:
            if level[a] >= level[b]:
                ups.append("<" + label[a])
                a = above[a]
            else:
                downs.append(">" + label[b])
                b = above[b]
        paths.append(" ".join(ups + downs[::-1]))
        held += len(paths[-1])
        if held >= PATH_SLICE:
            yield found[begin : begin + len(paths)].assign(path=paths)
            begin, held, paths = begin + len(paths), 0, []
    if paths:
        yield found[begin:].assign(path=paths)


def _large_tree_paths(nodes: DataFrame, pairs: DataFrame, local_rows: int) -> DataFrame:
    """:func:`tree_paths` by joins; labels are looked up only for the steps of the result.

    Sizes that are guessed for paths fall far short, so no join is left free to broadcast.
    """
    ways = H.hierarchy(_links(nodes), local_rows).where("path is not null").select("tree_id", "id", "path")
    ends = lambda own, path: ways.select("tree_id", F.col("id").alias(own), F.col("path").alias(path)).hint("merge")
    both = pairs.select("tree_id", "source_id", "target_id").distinct().join(ends("source_id", "a"), ["tree_id", "source_id"]).join(ends("target_id", "b"), ["tree_id", "target_id"])
    # Ids are unique in a tree, so paths from its root agree in a beginning and nowhere else.
    both = both.withColumn("k", F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))).where("k > 0")
    up = F.transform(F.reverse(F.slice("a", F.col("k") + 1, F.size("a"))), lambda x: F.struct(F.lit("<").alias("sign"), x.alias("on")))
    down = F.transform(F.slice("b", F.col("k") + 1, F.size("b")), lambda x: F.struct(F.lit(">").alias("sign"), x.alias("on")))
    steps = both.select("tree_id", "source_id", "target_id", F.posexplode_outer(F.concat(up, down)).alias("i", "x")).select("tree_id", "source_id", "target_id", "i", "x.sign", "x.on")
    labelled = steps.join(nodes.select("tree_id", F.col("id").alias("on"), "r").hint("merge"), ["tree_id", "on"], "left")
    step = F.when(F.col("on").isNotNull(), F.struct("i", F.concat("sign", "r").alias("step")))
    return labelled.groupBy("tree_id", "source_id", "target_id").agg(F.sort_array(F.collect_list(step)).alias("p")).select(
        "tree_id", "source_id", "target_id", F.array_join(F.col("p.step"), " ").alias("path"))


def tree_paths(nodes: DataFrame, pairs: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(tree_id, source_id, target_id, path): the shortest way through the tree between two nodes, as the labels passed.

    A step up to a parent reads '<relation', one down to a child '>relation'.  A node's
    path to itself is empty; nodes of different trees, or on or below cycles, have none.
    Trees of at most ``local_rows`` nodes and pairs are walked within tasks, so that
    only the steps of the result are made; larger ones take joins.
    """
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    of_nodes = nodes.where("id is not null").select("tree_id", "id", "parent", F.coalesce("relname", F.lit("")).alias("r"), *none("source_id", "target_id"))
    of_pairs = pairs.where("source_id is not null and target_id is not null").select("tree_id", *none("id", "parent", "r"), "source_id", "target_id")
    small, large = by_size(cut(of_nodes.unionByName(of_pairs).where("tree_id is not null")), ["tree_id"], local_rows)
    out = on_whole_groups(small, ["tree_id"], _path_rows, "tree_id string, source_id string, target_id string, path string")
    if large is None:
        return out
    return out.unionByName(_large_tree_paths(large.where("id is not null"), large.where("id is null"), local_rows))
