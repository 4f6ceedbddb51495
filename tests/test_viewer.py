from logosmill.operators import alignment as A
from logosmill.operators import trees as T
from logosmill.operators import viewer as V

KIND = "tree_id string, id string, parent string, kind string, relname string, left_edge double, right_edge double, contents string"
TREE = [("t", "1", "4", "edu", "span", 1.0, 1.0, "ab cd"), ("t", "2", "1", "edu", "cause", 2.0, 2.0, "ef"), ("t", "3", "4", "edu", "joint", 3.0, 3.0, "g"), ("t", "4", None, "multinuc", None, 1.0, 3.0, None), ("u", "1", None, "edu", None, 1.0, 1.0, "x")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reads(spark):
    nodes = spark.createDataFrame([*TREE, ("u", "2", "gone", "edu", "lost", 2.0, 2.0, "y")], KIND)
    rel = spark.createDataFrame([("t", "joint", "multinuc"), ("t", "cause", "rst"), ("t", "cause", "rst")], "tree_id string, relname string, reltype string")
    facts = {(r.tree_id, r.id): tuple(r)[4:] for r in V.node_facts(nodes, rel).collect()}
    assert facts["t", "4"] == (None, 2, 1, 1.0, 3.0) and facts["t", "1"] == (None, 1, 0, 2.0, 2.0) and facts["u", "2"] == (None, 0, 0, None, None) and len(facts) == 6
    assert rows(V.default_relations(rel)) == [("t", "multinuc", "joint"), ("t", "rst", "cause")]


def test_edits(spark):
    nodes = spark.createDataFrame(TREE, KIND)
    edits = spark.createDataFrame([("t", "2", "3", None), ("t", "3", "2", "x"), ("t", "9", "1", "x"), ("t", "3", "1", "y")], "tree_id string, id string, parent string, relname string")
    assert [r[1:5] for r in rows(V.with_parent(nodes, edits))][:4] == [("1", "4", "edu", "span"), ("2", "3", "edu", "cause"), ("3", "2", "edu", "x"), ("4", None, "multinuc", None)]
    gone = spark.createDataFrame([("t", "1"), ("t", "1"), ("x", "1")], "tree_id string, id string")
    assert [r[:2] for r in rows(V.without_subtrees(nodes, gone))] == [("t", "3"), ("t", "4"), ("u", "1")]
    hollow = spark.createDataFrame([("t", "5", "6", "span", None, 0.0, 0.0, None), ("t", "6", "4", "span", None, 0.0, 0.0, None), *TREE], KIND)
    assert rows(V.without_empty_groups(hollow)) == rows(nodes)


def test_split(spark):
    nodes = spark.createDataFrame(TREE, KIND)
    out = rows(V.split_unit(nodes, spark.createDataFrame([("t", "1", 3), ("u", "1", 9)], "tree_id string, id string, at int")))
    assert out == [("t", "1", "5", "edu", "span", 1.0, 1.0, "ab "), ("t", "2", "5", "edu", "span", 2.0, 2.0, "cd"), ("t", "3", "1", "edu", "cause", 3.0, 3.0, "ef"), ("t", "4", "5", "edu", "joint", 4.0, 4.0, "g"),
                   ("t", "5", None, "multinuc", None, 1.0, 4.0, None), ("u", "1", None, "edu", None, 1.0, 1.0, "x")]


def test_paths_and_actions(spark):
    nodes = spark.createDataFrame(TREE, KIND)
    pairs = spark.createDataFrame([("t", "2", "3"), ("t", "4", "2"), ("t", "2", "2"), ("t", "1", "9")], "tree_id string, source_id string, target_id string")
    assert {(r.source_id, r.target_id): r.path for r in T.tree_paths(nodes, pairs).collect()} == {("2", "3"): "<cause <span >joint", ("4", "2"): ">span >cause", ("2", "2"): ""}
    spans = spark.createDataFrame([("d", 1, 1), ("d", 2, 2), ("d", 3, 3), ("d", 1, 2), ("d", 1, 3), ("d", 1, 3), ("d", None, 3)], "k string, s int, e int")
    assert [(r.action, r.s, r.e) for r in T.build_actions(spans, "k").orderBy("step").collect()] == [("shift", 1, 1), ("shift", 2, 2), ("reduce", 1, 2), ("shift", 3, 3), ("reduce", 1, 3)]


def test_paths_are_not_broadcast(spark):
    # 3 and 4 are a cycle and 5 is below it; 6 is an orphan.
    odd = [("v", "1", None, None), ("v", "2", "1", "a"), ("v", "3", "4", "b"), ("v", "4", "3", "c"), ("v", "5", "4", "d"), ("v", "6", "gone", "e"), ("v", "7", "6", None), (None, "1", None, "f")]
    nodes = spark.createDataFrame([*[(t, i, p, r) for t, i, p, _, r, *_ in TREE], *odd], "tree_id string, id string, parent string, relname string")
    asked = [("t", "2", "3"), ("t", "2", "3"), ("t", "4", "2"), ("v", "2", "1"), ("v", "1", "6"), ("v", "3", "5"), ("v", "5", "5"), ("v", "7", "6"), ("v", "6", "6"), ("v", "1", None), ("w", "1", "1"), (None, "1", "1")]
    pairs = spark.createDataFrame(asked, "tree_id string, source_id string, target_id string")
    known = [("t", "2", "3", "<cause <span >joint"), ("t", "4", "2", ">span >cause"), ("v", "2", "1", "<a"), ("v", "6", "6", ""), ("v", "7", "6", "<")]
    out = T.tree_paths(nodes, pairs)
    assert rows(out) == known and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(T.tree_paths(nodes, pairs, 5)) == known
    out = T.tree_paths(nodes, pairs, 8)  # v alone is larger, by its pairs; only the names of large trees may be broadcast
    assert rows(out) == known
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and all("LeftAnti" in line for line in plan.split("\n") if "BroadcastHashJoin" in line)


def test_realigned_and_phrases(spark):
    u = spark.createDataFrame([("d", 0, "ab c"), ("d", 1, " "), ("d", 2, "d,e f"), ("e", 0, "x")], "k string, unit_no bigint, text string")
    t = spark.createDataFrame([("d", i, w) for i, w in enumerate(["ab", "cd", ",", "e", "f", "g"])], "k string, ord int, token string")
    assert rows(A.realigned(u, t, "k")) == [("d", 0, "ab cd"), ("d", 1, ""), ("d", 2, ", e f g"), ("e", 0, "")]
    assert rows(A.phrase_matches(t, ["AB cd", "cd ,", "g h", ""], "k")) == [("d", 0, 2, "ab cd"), ("d", 1, 3, "cd ,")] and A.phrase_matches(t, [], "k").count() == 0
