"""Parent links to hierarchies by tree contraction.

Every round does two things to what is left of the forest: childless nodes are raked
off, and an independent set of one-child nodes is spliced out of its chain.  Splicing
hands the node's link, length and path segment to its only child.  The number of rounds
grows with the logarithm of the number of nodes, also for a single chain, so depth is
not limited.  What never vanishes are cycles: each shrinks to one node that is its own
parent.

Afterwards the recorded contractions are reversed.  A removed node points to a node
that was removed in a later round, so the records form a forest whose depth is at most
the number of rounds, and pointer doubling over it yields root, depth and path with
few joins.

All joins have unique keys on both sides (child counts are aggregated first), so a
parent that owns a third of all rows needs no special care.

Trees of at most LOCAL_ROWS nodes are brought together once, and their rounds run on
arrays within a task, many trees at a time.  Only larger trees take the distributed
rounds, each of which is a few joins and a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logosmill.operators.grouped import LOCAL_ROWS, by_size, on_whole_groups
from logosmill.session import cut

KEYS = ["tree_table", "tree_id"]


def parent_links(
    df: DataFrame, tree_table: str, tree_id: Column, node: Column, parent: Column, arrived: Column | None = None,
    root_marks: tuple[str, ...] = (),
) -> DataFrame:
    """Normal form (tree_table, tree_id, id, parent), one row per node.

    A parent that is null, blank or one of ``root_marks`` makes a root.  Rows sent
    twice collapse; if copies disagree, the one that arrived last counts, then the
    greater parent.  A null part of the tree id reads as an empty string.  Rows without
    a node id cannot be linked to and are left to :func:`unaddressed`.
    """
    blank = F.trim(parent) == ""
    for mark in root_marks:
        blank = blank | (F.trim(parent) == mark)
    rows = df.select(
        F.lit(tree_table).alias("tree_table"),
        F.coalesce(tree_id, F.lit("")).alias("tree_id"),
        node.alias("id"),
        F.when(parent.isNull() | blank, None).otherwise(parent).alias("parent"),
        (arrived if arrived is not None else F.lit(0)).alias("_at"),
    ).where(F.col("id").isNotNull())
    latest = F.max(F.struct("_at", "parent"))
    return rows.groupBy(*KEYS, "id").agg(latest.alias("_l")).select(*KEYS, "id", F.col("_l.parent").alias("parent"))


def unaddressed(df: DataFrame, node: Column) -> DataFrame:
    """Rows whose node id is null; they belong to no hierarchy."""
    return df.where(node.isNull())


def _rank(node: str) -> Column:
    return F.xxhash64(F.col("tree_table"), F.col("tree_id"), F.col(node))


def contract(links: DataFrame, paths: bool = True, max_rounds: int = 400) -> DataFrame:
    """Run the contraction; one row per node with what was recorded at its removal.

    Result: tree_table, tree_id, id, ptr (node it hung from), dist (links to ptr),
    seg (ids strictly below ptr down to the node, if ``paths``), state ('raked',
    'spliced' or 'core'), child (for spliced: the child that took over), weight (nodes
    folded into it, itself included), edge_weight (nodes spliced out of its link).
    """
    state = links.select(
        *KEYS, "id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"),
        (F.array("id") if paths else F.lit(None).cast("array<string>")).alias("seg"),
        F.lit(1).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("edge_weight"),
        F.lit("alive").alias("state"), F.lit(None).cast("string").alias("child"),
    )
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        live = F.col("state") == "alive"
        # Nodes raked in the round before only deliver their weight to the parent.
        folded = state.where(live | (F.col("state") == "raked")).where(F.col("ptr").isNotNull()).groupBy(
            *KEYS, F.col("ptr").alias("id")
        ).agg(
            F.count(F.when(live, 1)).alias("n"),
            F.min(F.when(live, F.col("id"))).alias("only"),
            F.sum(F.when(live, 0).otherwise(F.col("weight") + F.col("edge_weight"))).alias("gain"),
            F.min(F.when(live, F.col("edge_weight"))).alias("only_edge"),
        )
        nodes = state.where(live).join(folded, [*KEYS, "id"], "left").select(
            *KEYS, "id", "ptr", "dist", "seg", "edge_weight",
            (F.col("weight") + F.coalesce("gain", F.lit(0))).alias("weight"),
            F.coalesce("n", F.lit(0)).alias("n"), "only", "only_edge",
        )
        above_parent = F.coalesce(_rank("id") > _rank("ptr"), F.lit(True)) | F.col("ptr").isNull()
        splice = (F.col("n") == 1) & (F.col("only") != F.col("id")) & above_parent & (_rank("id") > _rank("only"))
        nodes = nodes.withColumn("splice", F.coalesce(splice, F.lit(False)))
        taken = nodes.where("splice").select(
            *KEYS, F.col("only").alias("id"), F.col("ptr").alias("t_ptr"), F.col("dist").alias("t_dist"),
            F.col("seg").alias("t_seg"), (F.col("weight") + F.col("edge_weight")).alias("t_weight"), F.lit(True).alias("t"),
        )
        t = F.col("t").isNotNull()
        state = cut(
            nodes.join(taken, [*KEYS, "id"], "left").select(
                *KEYS, "id",
                F.when(t, F.col("t_ptr")).otherwise(F.col("ptr")).alias("ptr"),
                (F.col("dist") + F.coalesce("t_dist", F.lit(0))).alias("dist"),
                F.when(t, F.concat("t_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
                # A spliced node's record also counts what was spliced between it and its child.
                F.when(F.col("splice"), F.col("weight") + F.col("only_edge")).otherwise(F.col("weight")).alias("weight"),
                (F.col("edge_weight") + F.coalesce("t_weight", F.lit(0))).alias("edge_weight"),
                F.when(F.col("splice"), "spliced").when((F.col("n") == 0) & ~t, "raked").otherwise("alive").alias("state"),
                F.when(F.col("splice"), F.col("only")).alias("child"),
            )
        )
        done.append(state.where("state <> 'alive'"))
        if state.where("state = 'alive' and not (ptr <=> id)").isEmpty():
            break
    else:
        raise RuntimeError(f"contraction did not end in {max_rounds} rounds")
    # Weights raked in the last round still belong to the cores.
    gain = state.where("state = 'raked'").groupBy(*KEYS, F.col("ptr").alias("id")).agg(
        F.sum(F.col("weight") + F.col("edge_weight")).alias("gain"))
    core = state.where("state = 'alive'").join(gain, [*KEYS, "id"], "left").select(
        *KEYS, "id", "ptr", "dist", "seg", (F.col("weight") + F.coalesce("gain", F.lit(0))).alias("weight"),
        "edge_weight", F.lit("core").alias("state"), "child")
    return reduce(DataFrame.unionByName, [*done, core])


def _double(rows: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Pointer doubling over (KEYS, id, to, dist, seg): until ``to`` leads nowhere.

    ``end`` is the last node reached.  The pointers must be free of cycles.
    """
    rows = cut(rows.withColumn("end", F.coalesce("to", "id")))
    for _ in range(max_rounds):
        if rows.where(F.col("to").isNotNull()).isEmpty():
            return rows
        up = rows.select(*KEYS, F.col("id").alias("to"), F.col("to").alias("u_to"), F.col("end").alias("u_end"),
                         F.col("dist").alias("u_dist"), F.col("seg").alias("u_seg"))
        rows = cut(
            rows.where(F.col("to").isNotNull()).join(up, [*KEYS, "to"], "left").select(
                *KEYS, "id", F.col("u_to").alias("to"),
                (F.col("dist") + F.coalesce("u_dist", F.lit(0))).alias("dist"),
                F.when(F.col("u_seg").isNotNull(), F.concat("u_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
                F.coalesce("u_end", "end").alias("end"),
            ).unionByName(rows.where(F.col("to").isNull()).select(*KEYS, "id", "to", "dist", "seg", "end"))
        )
    raise RuntimeError("pointers contain a cycle")


def cycle_records(contracted: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle: the cores and what was spliced out of their loops.

    A spliced node lies on a cycle exactly if the child that took over does.
    """
    core = contracted.where("state = 'core'").select(*KEYS, "id")
    spliced = contracted.where("state = 'spliced'")
    known = spliced.select(*KEYS, F.col("id").alias("child"), F.lit(1).alias("k"))
    followed = _double(
        spliced.join(known, [*KEYS, "child"], "left").select(
            *KEYS, "id", F.when(F.col("k").isNotNull(), F.col("child")).alias("to"),
            F.lit(1).cast("bigint").alias("dist"), F.lit(None).cast("array<string>").alias("seg"), F.col("child"),
        ).drop("child")
    )
    last = followed.select(*KEYS, "id", F.col("end")).join(
        spliced.select(*KEYS, F.col("id").alias("end"), "child"), [*KEYS, "end"])
    on = last.join(core.withColumnRenamed("id", "child"), [*KEYS, "child"], "left_semi").select(*KEYS, "id")
    return core.unionByName(on)


def _distributed(links: DataFrame) -> DataFrame:
    rec = cut(contract(links, paths=True))
    on_cycle = cut(cycle_records(rec))
    at_cycle = F.col("at_cycle").isNotNull()
    # A cycle node is spliced into its child on the cycle, so no segment below a cycle runs through one.
    ids = rec.select(*KEYS, F.col("id").alias("ptr"), F.lit(1).alias("known")).join(
        on_cycle.select(*KEYS, F.col("id").alias("ptr"), F.lit(1).alias("at_cycle")), [*KEYS, "ptr"], "left")
    away = rec.where("state <> 'core'").join(ids, [*KEYS, "ptr"], "left")
    up = _double(away.select(*KEYS, "id", F.when(F.col("known").isNotNull() & ~at_cycle, F.col("ptr")).alias("to"), "dist", "seg"))
    ends = away.where(at_cycle).select(*KEYS, F.col("id").alias("end"), F.col("ptr").alias("anchor"))
    up = up.join(ends, [*KEYS, "end"], "left")
    # Descendants: raked nodes know their weight; a spliced one adds what its child has.
    sp = rec.where("state = 'spliced'")
    known = sp.select(*KEYS, F.col("id").alias("child"), F.lit(1).alias("k"))
    down = _double(
        sp.join(known, [*KEYS, "child"], "left").select(
            *KEYS, "id", F.when(F.col("k").isNotNull(), F.col("child")).alias("to"), F.col("weight").alias("dist"),
            F.lit(None).cast("array<string>").alias("seg")))
    tail = down.join(sp.select(*KEYS, F.col("id").alias("end"), "child"), [*KEYS, "end"]).join(
        rec.where("state <> 'spliced'").select(*KEYS, F.col("id").alias("child"), F.col("weight").alias("below")), [*KEYS, "child"], "left")
    sizes = rec.where("state = 'raked'").select(*KEYS, "id", F.col("weight").alias("size")).unionByName(
        tail.select(*KEYS, "id", (F.col("dist") + F.coalesce("below", F.lit(0))).alias("size")))
    rings = rec.where("state = 'core'").select(*KEYS, "id", F.col("seg").alias("ring"))
    marks = on_cycle.withColumn("on_cycle", F.lit(True)).join(rings, [*KEYS, "id"], "left")
    out = links.join(up.select(*KEYS, "id", "seg", "anchor"), [*KEYS, "id"], "left").join(
        sizes, [*KEYS, "id"], "left").join(marks, [*KEYS, "id"], "left")
    cyc, into = F.coalesce("on_cycle", F.lit(False)), F.col("anchor").isNotNull()
    good = ~cyc & ~into
    return out.select(
        *KEYS, "id", "parent",
        F.when(cyc, "cycle").when(into, "below_cycle").when(F.col("parent").isNull(), "root")
        .when(F.size("seg") == 1, "orphan").otherwise("node").alias("status"),
        F.when(good, F.element_at("seg", 1)).alias("root"),
        F.when(good, F.size("seg") - 1).alias("depth"),
        F.when(good, F.col("seg")).alias("path"),
        F.when(~cyc, F.col("size") - 1).alias("n_descendants"),
        F.when(cyc, F.array("id")).when(into, F.concat(F.array("anchor"), "seg")).alias("cycle_path"),
        "ring",
    )


class Contraction:
    """The contraction of a forest held in arrays; ``parent`` has each node's place of its parent, or -1.

    removed: what was taken off in each round, in order; core: nodes that no round removes.
    """

    def __init__(self, parent: np.ndarray, seed: int = 11):
        n = len(parent)
        self.parent, self.ptr, self.dist = parent, parent.copy(), np.ones(n, dtype=np.int64)
        self.child, self.top = np.full(n, -1, dtype=np.int64), np.arange(n)
        self.weight, self.between = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.removed: list[tuple[np.ndarray, bool]] = []
        rank = np.random.default_rng(seed).permutation(n)
        alive = np.arange(n)
        while len(alive):
            up = self.ptr[alive]
            count = np.bincount(up[up >= 0], minlength=n)
            leaves = alive[count[alive] == 0]
            if len(leaves):
                self._rake(leaves)
                alive = alive[count[alive] > 0]
                up = self.ptr[alive]
                count = np.bincount(up[up >= 0], minlength=n)
            # A unary node is spliced out if it outranks its parent and its child, so no two neighbours are.
            only = np.full(n, -1, dtype=np.int64)
            only[up[up >= 0]] = alive[up >= 0]
            u = alive[count[alive] == 1]
            c, p = only[u], self.ptr[u]
            u = u[(c != u) & (rank[u] > rank[c]) & ((p < 0) | (rank[u] > rank[p]))]
            if len(u):
                self._splice(u, only[u])
                gone = np.zeros(n, dtype=bool)
                gone[u] = True
                alive = alive[~gone[alive]]
            elif not len(leaves) and (self.ptr[alive] == alive).all():
                break
        self.core = alive

    def _rake(self, leaves: np.ndarray) -> None:
        self.removed.append((leaves, False))
        held = leaves[self.ptr[leaves] >= 0]
        np.add.at(self.weight, self.ptr[held], self.weight[held] + self.between[held])

    def _splice(self, u: np.ndarray, c: np.ndarray) -> None:
        self.removed.append((u, True))
        self.child[u] = c
        own = self.weight[u]
        self.weight[u] = own + self.between[c]  # also what was spliced between the node and its child
        self.between[c] += own + self.between[u]
        self.ptr[c], self.top[c] = self.ptr[u], self.top[u]
        self.dist[c] += self.dist[u]

    def on_cycle(self) -> np.ndarray:
        """A spliced node lies on a cycle exactly if the child that took over does."""
        out = np.zeros(len(self.parent), dtype=bool)
        out[self.core] = True
        for nodes, spliced in reversed(self.removed):
            if spliced:
                out[nodes] = out[self.child[nodes]]
        return out

    def expanded(self) -> tuple[np.ndarray, ...]:
        """on_cycle, root, depth, anchor (the cycle node a node hangs from, or -1) and size of the subtree, by reversing the rounds."""
        n = len(self.parent)
        cycle, anchor, root, depth, size = self.on_cycle(), np.full(n, -1, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64), self.weight.copy()
        for nodes, spliced in reversed(self.removed):
            p = self.ptr[nodes]
            held = p >= 0
            root[nodes] = np.where(held, root[p], self.top[nodes])
            depth[nodes] = np.where(held, depth[p] + self.dist[nodes], self.dist[nodes] - 1)
            anchor[nodes] = np.where(held & ~cycle[nodes], np.where(cycle[p], p, anchor[p]), -1)
            if spliced:
                size[nodes] += size[self.child[nodes]]
        return cycle, root, depth, anchor, size


def _with_parents(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's parent, or -1, and ids as an array; a place stands for a node of its own tree only."""
    ids = part["id"].to_numpy(dtype=object)
    tree = (part[KEYS] != part[KEYS].shift()).any(axis=1).cumsum().to_numpy()
    codes, _ = pd.factorize(np.concatenate([ids, part["parent"].to_numpy(dtype=object)]))
    width = int(codes.max(initial=0)) + 2
    own = tree * width + codes[: len(ids)]
    wanted = np.where(codes[len(ids):] >= 0, tree * width + codes[len(ids):], -1)
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], wanted), max(0, len(ids) - 1))
    return np.where(own[order][at] == wanted, order[at], -1) if len(ids) else np.zeros(0, dtype=np.int64), ids


def cycle_nodes(links: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(tree_table, tree_id, id) of the nodes of :func:`parent_links` rows that lie on a cycle themselves."""
    def work(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parent, _ = _with_parents(part)
        yield part.loc[Contraction(parent).on_cycle(), [*KEYS, "id"]]

    small, large = by_size(links, KEYS, local_rows)
    out = on_whole_groups(small, KEYS, work, "tree_table string, tree_id string, id string", LOCAL_ROWS)
    return out if large is None else out.unionByName(cycle_records(contract(large, paths=False)))


TREE = (
    "tree_table string, tree_id string, id string, parent string, status string, root string, depth int, path array<string>, n_descendants bigint, "
    "cycle_path array<string>, ring array<string>")
SLICE = 500_000  # path entries in a frame of results


def _tree_rows(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    parent, ids = _with_parents(part)
    forest = Contraction(parent)
    cycle, root, depth, anchor, size = forest.expanded()
    hangs = anchor >= 0
    rings = {}
    for core in forest.core:
        ring, at = [core], parent[core]
        while at != core:
            ring.append(at)
            at = parent[at]
        rings[core] = ids[ring[::-1]].tolist()
    stated = part["parent"].notna().to_numpy()
    status = np.select([cycle, hangs, ~stated, parent < 0], ["cycle", "below_cycle", "root", "orphan"], "node")
    # Paths from parents before children; a path is dropped once the last child has it, so few are in memory.
    level = depth.copy()
    for nodes, _ in reversed(forest.removed):
        below = nodes[hangs[nodes]]
        p = forest.ptr[below]
        level[below] = np.where(cycle[p], 0, level[p]) + forest.dist[below]
    level[cycle] = 0
    order = np.argsort(level, kind="stable")
    kept: dict[int, list[str]] = {}
    children = np.bincount(parent[parent >= 0], minlength=len(parent))
    rows: list[int] = []
    paths: list[list[str]] = []
    held = 0

    def frame() -> pd.DataFrame:
        at = np.array(rows)
        free = [not (c or h) for c, h in zip(cycle[at], hangs[at])]
        return pd.DataFrame({
            **{k: part[k].to_numpy()[at] for k in KEYS}, "id": ids[at], "parent": part["parent"].to_numpy()[at], "status": status[at],
            "root": [ids[root[i]] if f else None for i, f in zip(at, free)], "depth": pd.array([depth[i] if f else None for i, f in zip(at, free)], dtype="Int32"),
            "path": [p if f else None for p, f in zip(paths, free)], "n_descendants": pd.array([None if cycle[i] else size[i] - 1 for i in at], dtype="Int64"),
            "cycle_path": [None if f else p for p, f in zip(paths, free)], "ring": [rings.get(i) for i in at]})

    for i in order:
        p = parent[i]
        if cycle[i] or p < 0:
            path = [ids[i]]
        else:
            path = [*kept[p], ids[i]]
        if not cycle[i] and p >= 0:
            children[p] -= 1
            if not children[p]:
                del kept[p]
        if children[i]:
            kept[i] = path
        rows.append(i)
        paths.append(path)
        held += len(path)
        if held >= SLICE:
            yield frame()
            rows, paths, held = [], [], 0
    if rows:
        yield frame()


def hierarchy(links: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Root, depth, path and number of descendants of every node.

    Result: tree_table, tree_id, id, parent, status, root, depth, path, n_descendants,
    cycle_path, ring.  status: 'root' (no parent given), 'orphan' (the parent does not
    exist; the node counts as a root), 'node', 'cycle' (lies on a cycle), 'below_cycle'
    (leads into one).  On and below cycles root, depth and path are null, as no root
    exists; cycle_path leads from the cycle node they hang from to the node, and is null
    elsewhere.  n_descendants of cycle nodes is null.  One node of each cycle has the
    whole cycle in ring, every id before its child.  An empty table gives an empty result.
    """
    small, large = by_size(links, KEYS, local_rows)
    out = on_whole_groups(small, KEYS, _tree_rows, TREE, LOCAL_ROWS)
    return out if large is None else out.unionByName(_distributed(large))


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance, status) rows of a :func:`hierarchy` result.

    status: 'tree' (both below a root or orphan), 'below_cycle' (the descendant leads into
    a cycle; every node of that cycle is an ancestor), 'cycle' (both lie on one cycle).
    The distance is the least number of links; a node is no descendant of itself.
    """
    def pairs(path: str, status: str) -> DataFrame:
        return tree.where(F.size(path) > 1).select(
            *KEYS, F.col("id").alias("descendant"), (F.size(path) - 1).alias("depth"), F.posexplode(path).alias("at", "ancestor")
        ).where("at < depth").select(*KEYS, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"), F.lit(status).alias("status"))

    # The other nodes of a cycle stand above what hangs from one of them.
    ring = tree.where("ring is not null").select(*KEYS, F.col("id").alias("core"), F.size("ring").alias("length"), F.posexplode("ring").alias("at", "node"))
    a = ring.select(*KEYS, "core", F.col("node").alias("ancestor"), F.col("at").alias("from"))
    b = ring.select(*KEYS, "core", F.col("node").alias("anchor"), F.col("at").alias("to"), "length")
    around = a.join(b, [*KEYS, "core"]).where("ancestor <> anchor").select(
        *KEYS, "ancestor", "anchor", F.pmod(F.col("to") - F.col("from"), "length").alias("steps"))
    hanging = tree.where(F.col("cycle_path").isNotNull()).select(
        *KEYS, F.col("id").alias("descendant"), F.element_at("cycle_path", 1).alias("anchor"), (F.size("cycle_path") - 1).alias("depth"), "status")
    beyond = hanging.join(around, [*KEYS, "anchor"]).select(*KEYS, "ancestor", "descendant", (F.col("steps") + F.col("depth")).alias("distance"), "status")
    return pairs("path", "tree").unionByName(pairs("cycle_path", "below_cycle")).unionByName(beyond)
