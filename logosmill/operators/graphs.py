"""Checks of discourse graphs: cycles, components, members of nested units, right frontier."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logosmill.operators.grouped import LOCAL_ROWS, by_size, on_whole_groups, places
from logosmill.session import cut


def cyclic_edges(edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Edges (graph_id, src, dst) on or between cycles: what trimming of ends leaves.

    Edges from nodes without an incoming edge and to nodes without an outgoing one are
    dropped until none is left to drop.  A graph is acyclic exactly if nothing is left of
    it.  Graphs of at most ``local_rows`` edges are trimmed within a task, edge by edge;
    larger ones in distributed rounds, as many as the longest chain needs.
    """
    left = edges.select("graph_id", "src", "dst").where("graph_id is not null and src is not null and dst is not null").distinct()
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)

    def trim(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        (src, dst), n = places(part, ["graph_id"], ["src", "dst"])
        kept = np.ones(len(part), dtype=bool)
        for a, b in ((src, dst), (dst, src)):  # ends without an incoming edge, then those without an outgoing one
            degree = np.bincount(b[kept], minlength=n)
            by_start = np.argsort(a, kind="stable")
            first = np.searchsorted(a[by_start], np.arange(n + 1))
            waiting = np.flatnonzero(degree == 0).tolist()
            while waiting:
                node = waiting.pop()
                for e in by_start[first[node] : first[node + 1]]:
                    if kept[e]:
                        kept[e] = False
                        degree[b[e]] -= 1
                        if not degree[b[e]]:
                            waiting.append(b[e])
        yield part[kept]

    small, large = by_size(left, ["graph_id"], local_rows)
    out = on_whole_groups(small, ["graph_id"], trim, kind)
    if large is None:
        return out
    n, m = -1, large.count()
    while m != n:
        n = m
        into = large.select("graph_id", F.col("dst").alias("src")).distinct()
        outof = large.select("graph_id", F.col("src").alias("dst")).distinct()
        large = cut(large.join(into, ["graph_id", "src"], "left_semi").join(outof, ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst"))
        m = large.count()
    return out.unionByName(large)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the least node reachable, ignoring direction.

    Labels spread to neighbours and then along labels themselves, until none moves; the
    number of rounds grows with the logarithm of the diameter.
    """
    both = cut(edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    state = cut(nodes.select("graph_id", "node", F.col("node").alias("component")).distinct())
    moving = True
    while moving:
        near = both.join(state.select("graph_id", F.col("node").alias("b"), F.col("component").alias("c")), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = state.join(near, ["graph_id", "node"], "left").select("graph_id", "node", F.least("component", F.coalesce("c", "component")).alias("n"), "component")
        hop = step.select("graph_id", F.col("node").alias("n"), F.col("n").alias("m"))
        new = cut(step.join(hop, ["graph_id", "n"], "left").select("graph_id", "node", F.least("n", F.coalesce("m", "n")).alias("component"), (F.least("n", F.coalesce("m", "n")) != F.col("component")).alias("moved")))
        state = new.select("graph_id", "node", "component")
        moving = not new.where("moved").isEmpty()
    return state


def members(units: DataFrame) -> DataFrame:
    """(graph_id, unit, member): elementary members of complex units (graph_id, unit, members), nested ones opened.

    A round opens one more level, and only pairs not seen before go on, so units that
    contain each other come to an end as well.
    """
    top = cut(units.select("graph_id", "unit", F.explode("members").alias("m")).distinct())
    inner = top.select("graph_id", F.col("unit").alias("m"), F.col("m").alias("next"))
    seen = level = top
    while not level.isEmpty():
        level = cut(level.join(inner, ["graph_id", "m"]).select("graph_id", "unit", F.col("next").alias("m")).distinct().join(seen, ["graph_id", "unit", "m"], "left_anti"))
        seen = cut(seen.unionByName(level))
    return seen.join(units.select("graph_id", F.col("unit").alias("m")), ["graph_id", "m"], "left_anti").select("graph_id", "unit", F.col("m").alias("member")).distinct()


def frontier(units: list[str], relations: list[tuple[str, str, bool]], complex_units: dict[str, list[str]]) -> list[str]:
    """Units, but for the first, that nothing on the right frontier attaches, in order.

    ``relations``: (source, target, subordinating).  The frontier before a unit is the one
    before it, closed over the sources that subordinate a member of it and over complete
    complex units that hold one; complete is what has all its elementary members earlier.
    """
    order = {u: i for i, u in enumerate(units)}
    complete_at: dict[str, float] = {}
    for name in complex_units:  # nested ones are opened with a stack; one that holds itself is opened once
        last, opened, waiting = -1.0, {name}, list(complex_units[name])
        while waiting:
            m = waiting.pop()
            if m in complex_units:
                if m not in opened:
                    opened.add(m)
                    waiting += complex_units[m]
            else:
                last = max(last, order.get(m, float("inf")))
        complete_at[name] = last
    above: dict[str, list[str]] = {}
    for source, target, subordinating in relations:
        if subordinating:
            above.setdefault(target, []).append(source)
    for name, inside in complex_units.items():
        for m in inside:
            above.setdefault(m, []).append(name)
    into: dict[str, list[str]] = {}
    for source, target, _ in relations:
        into.setdefault(target, []).append(source)
    bad = []
    for i in range(1, len(units)):
        known = lambda u: order.get(u, complete_at.get(u, float("inf"))) < i  # noqa: B023, E731
        on, waiting = {units[i - 1]}, [units[i - 1]]
        while waiting:
            fresh = {u for u in above.get(waiting.pop(), ()) if known(u)} - on
            on |= fresh
            waiting += fresh
        if not any(s in on for s in into.get(units[i], ())):
            bad.append(units[i])
    return bad


def frontier_violations(graphs: DataFrame) -> DataFrame:
    """(graph_id, unit) of graphs (graph_id, units, relations, complex) with arrays of structs; one graph a row."""
    @F.pandas_udf("array<string>")
    def check(units: pd.Series, relations: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([
            frontier(list(u), [(r["source"], r["target"], bool(r["subordinating"])) for r in (rel if rel is not None else [])], {g["unit"]: list(g["members"]) for g in (grp if grp is not None else [])})
            for u, rel, grp in zip(units, relations, groups)])

    return graphs.select("graph_id", F.explode(check("units", "relations", "complex")).alias("unit"))


def argument_graph_violations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, rule, detail) of typed argument graphs: nodes (graph_id, id), relations (graph_id, id, relation_type, source_id, target_id)."""
    rule = lambda df, name, c: df.select("graph_id", F.lit(name).alias("rule"), F.col(c).alias("detail"))
    ends = relations.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    loops = cyclic_edges(relations.where("relation_type = 'inference'").select("graph_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    return (
        rule(nodes.groupBy("graph_id", "id").count().where("count > 1"), "repeated_id", "id")
        .unionByName(rule(ends.join(nodes, ["graph_id", "id"], "left_anti"), "unknown_endpoint", "id"))
        .unionByName(rule(relations.groupBy("graph_id", "relation_type", "source_id", "target_id").count().where("count > 1"), "repeated_relation", "source_id"))
        .unionByName(rule(loops.select("graph_id", "src").distinct(), "inference_cycle", "src")))


def discourse_violations(units: DataFrame, complex_units: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, rule, detail) over units (graph_id, unit, ord, start_pos, stop_pos), complex_units (graph_id, unit, members) and relations (graph_id, id, source, target, structure).

    Rules: repeated_unit, repeated_relation, unknown_member, unknown_endpoint,
    overlapping_units, both_structures of one pair, membership_cycle, relation_cycle.
    """
    rule = lambda df, name, c: df.select("graph_id", F.lit(name).alias("rule"), c.alias("detail"))
    every = units.select("graph_id", "unit").unionByName(complex_units.select("graph_id", "unit"))
    known = every.distinct()
    inside = complex_units.select("graph_id", F.col("unit").alias("holder"), F.explode("members").alias("unit"))
    ends = relations.select("graph_id", "id", F.explode(F.array("source", "target")).alias("unit"))
    before = F.lag("stop_pos").over(Window.partitionBy("graph_id").orderBy("ord"))
    nested = inside.join(complex_units.select("graph_id", "unit").distinct(), ["graph_id", "unit"], "left_semi")
    cycle = lambda df: cyclic_edges(df).select("graph_id", "src").distinct()
    parts = [
        rule(every.groupBy("graph_id", "unit").count().where("count > 1"), "repeated_unit", F.col("unit")),
        rule(relations.groupBy("graph_id", "id").count().where("count > 1"), "repeated_relation", F.col("id")),
        rule(inside.join(known, ["graph_id", "unit"], "left_anti").select("graph_id", "unit").distinct(), "unknown_member", F.col("unit")),
        rule(ends.join(known, ["graph_id", "unit"], "left_anti").select("graph_id", "unit").distinct(), "unknown_endpoint", F.col("unit")),
        rule(units.withColumn("_b", before).where("start_pos < _b"), "overlapping_units", F.col("unit")),
        rule(relations.groupBy("graph_id", "source", "target").agg(F.countDistinct("structure").alias("n")).where("n > 1"), "both_structures", F.concat_ws(" ", "source", "target")),
        rule(cycle(nested.select("graph_id", F.col("holder").alias("src"), F.col("unit").alias("dst"))), "membership_cycle", F.col("src")),
        rule(cycle(relations.select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"))), "relation_cycle", F.col("src")),
    ]
    return reduce(DataFrame.unionByName, parts)


def root_choice(nodes: DataFrame, edges: DataFrame, tree: str) -> DataFrame:
    """(tree, node_id): the root of each tree of nodes (tree, node_id, kind, width, units) and edges (tree, child_id).

    Nodes that are nobody's child come first, of them those of kind 'root', then the
    widest by characters and units; ties go to the least id.  Where every node is a
    child, all are looked at.
    """
    child = edges.select(tree, F.col("child_id").alias("node_id")).distinct().withColumn("_c", F.lit(1))
    ranked = nodes.join(child, [tree, "node_id"], "left")
    place = F.struct(F.coalesce("_c", F.lit(0)).alias("c"), (F.coalesce("kind", F.lit("")) != "root").cast("int").alias("k"), (-F.coalesce("width", F.lit(0))).alias("w"), (-F.coalesce("units", F.lit(0))).alias("u"), F.col("node_id"))
    return ranked.groupBy(tree).agg(F.min(place).alias("m")).select(tree, F.col("m.node_id").alias("node_id"))
