import random

import pytest
from pyspark.sql import functions as F

from logosmill.operators import hierarchy as H

SCHEMA = "tree_table string, tree_id string, id string, parent string"


def brute(rows):
    """status, root, depth, path and number of descendants of each node, by walking up."""
    parent = {(t, s, i): p for t, s, i, p in rows}
    out, below, cyc = {}, {k: 0 for k in parent}, set()
    for k in parent:
        path, x = [], k
        while x in parent and x not in path:
            path.append(x)
            x = (*x[:2], parent[x]) if parent[x] is not None else None
        if x in path:
            cyc.update(path[path.index(x):])
            out[k] = ("loop", None, None, None)
        else:
            ids = [p[2] for p in reversed(path)]
            top = path[-1]
            status = "node" if len(ids) > 1 else ("root" if parent[top] is None else "orphan")
            out[k] = (status, ids[0], len(ids) - 1, ids)
        for a in path[1:]:
            below[a] += 1
    res = {}
    for k, v in out.items():
        if v[0] == "loop":
            res[k] = ("cycle" if k in cyc else "below_cycle", None, None, None, None if k in cyc else below[k])
        else:
            res[k] = (*v, below[k])
    return res, cyc


def check(spark, rows):
    """Trees worked on within tasks, then the larger ones in distributed rounds."""
    links = spark.createDataFrame(rows, SCHEMA)
    want, cyc = brute(rows)
    for local_rows in (H.LOCAL_ROWS, 12):
        got = {(r.tree_table, r.tree_id, r.id): (r.status, r.root, r.depth, r.path, r.n_descendants) for r in H.hierarchy(links, local_rows).collect()}
        assert got == want
        found = {(r.tree_table, r.tree_id, r.id) for r in H.cycle_nodes(links, local_rows).collect()}
        assert found == cyc


def test_chain_cycles_and_orphans(spark):
    rows = [("t", "a", "r", None)] + [("t", "a", f"c{i}", f"c{i - 1}" if i else "r") for i in range(40)]
    rows += [("t", "b", "x", "y"), ("t", "b", "y", "z"), ("t", "b", "z", "x"), ("t", "b", "w", "x"), ("t", "b", "v", "w"), ("t", "b", "self", "self")]
    rows += [("t", "c", "lost", "never"), ("t", "c", "lost2", "lost"), ("t", "c", "x", None), ("u", "a", "r", "c1")]
    check(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for t in range(6):
        n = rng.randint(1, 30)
        rows += [("t", str(t), str(i), rng.choice([None, str(rng.randint(0, n + 1)), str(max(0, i - 1))])) for i in range(n)]
    check(spark, rows)


def test_empty_table(spark):
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.cycle_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_from_dirty_rows(spark):
    raw = spark.createDataFrame(
        [("s", "a", "", 1, "x"), ("s", "a", "", 2, "y"), ("s", "b", "a", 1, "x"), ("s", "b", "zz", 0, "x"), ("s", None, "a", 1, "x"), (None, "a", "0", 1, "x"), ("s", "c", "  ", 1, "x")],
        "src string, item string, up string, at int, tree_id string")
    got = H.parent_links(raw, "t", F.col("src"), F.col("item"), F.col("up"), F.col("at"), root_marks=("0",))
    assert {tuple(r) for r in got.collect()} == {("t", "s", "a", None), ("t", "s", "b", "a"), ("t", "", "a", None), ("t", "s", "c", None)}
    assert H.unaddressed(raw, F.col("item")).count() == 1


def test_descendants(spark):
    links = spark.createDataFrame([("t", "a", "r", None), ("t", "a", "b", "r"), ("t", "a", "c", "b")], SCHEMA)
    got = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(H.hierarchy(links)).collect()}
    assert got == {("r", "b", 1), ("r", "c", 2), ("b", "c", 1)}


@pytest.mark.parametrize("local_rows", [H.LOCAL_ROWS, 0])
def test_descendants_on_and_below_cycles(spark, local_rows):
    rows = [("t", "a", "x", "z"), ("t", "a", "y", "x"), ("t", "a", "z", "y"), ("t", "a", "w", "x"), ("t", "a", "v", "w"), ("t", "a", "u", "w"), ("t", "b", "s", "s"), ("t", "b", "q", "s"), ("t", "c", "r", None), ("t", "c", "k", "r")]
    rng = random.Random(3)
    rows += [("t", str(t), str(i), str(rng.randint(0, 24))) for t in range(6) for i in range(25)]
    parent, want = {r[:3]: r[3] for r in rows}, {}
    for k in parent:
        seen, at = [k], (*k[:2], parent[k])
        while at in parent and at not in seen:
            seen.append(at)
            want[(*k[:2], at[2], k[2])] = len(seen) - 1
            at = (*k[:2], parent[at])
    tree = H.hierarchy(spark.createDataFrame(rows, SCHEMA), local_rows).cache()
    pairs = H.descendants(tree).collect()
    assert {(r.tree_table, r.tree_id, r.ancestor, r.descendant): r.distance for r in pairs} == want and len(pairs) == len(want)
    got = {(r.ancestor, r.descendant): r.status for r in pairs if r.tree_id in "abc"}
    assert got[("w", "v")] == got[("x", "u")] == got[("z", "v")] == got[("s", "q")] == "below_cycle" and got[("y", "x")] == "cycle" and got[("r", "k")] == "tree"
    paths = {r.id: r.cycle_path for r in tree.collect() if r.tree_id in "abc"}
    assert paths["v"] == ["x", "w", "v"] and paths["q"] == ["s", "q"] and paths["z"] == ["z"] and paths["k"] is None


def test_frames_of_many_trees_and_long_chains(spark, monkeypatch):
    """Chains far deeper than any recursion, in frames that hold some trees each."""
    monkeypatch.setattr(H, "LOCAL_ROWS", 50)
    rows = [("t", "deep", f"c{i}", f"c{i - 1}" if i else None) for i in range(3000)] + [("t", "loop", f"c{i}", f"c{(i - 1) % 3000}") for i in range(3000)]
    rows += [("t", f"s{t}", str(i), str(i // 2) if i else " ") for t in range(40) for i in range(7)]
    links = spark.createDataFrame(rows, SCHEMA)
    got = {(r.tree_id, r.id): r for r in H.hierarchy(links, 5000).select("tree_id", "id", "status", "depth", "n_descendants", F.size("path").alias("n")).collect()}
    assert got["deep", "c2999"].depth == 2999 and got["deep", "c0"].n_descendants == 2999 and got["deep", "c1500"].n == 1501
    assert all(got["loop", f"c{i}"].status == "cycle" for i in range(3000)) and len(got) == len(rows)
    assert all(got[f"s{t}", "1"].n_descendants == 5 and got[f"s{t}", "0"].status == "orphan" for t in range(40))
    assert H.cycle_nodes(links, 5000).count() == 3000
