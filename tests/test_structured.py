import json

from logosmill.operators import graphs as G
from logosmill.operators import structured as S

PENGUIN = {"axioms": ["bird", "penguin"], "strict_rules": [["s1", ["penguin"], "~d1"]], "defeasible_rules": [["d1", ["bird"], "flies"]]}
SENSORS = {
    "premises": ["a", "b"], "defeasible_rules": [["d_a", ["a"], "safe"], ["d_b", ["b"], "~safe"]], "contraries": [["a", "b", True]],
    "premise_preferences": [["a", "b"]], "rule_preferences": [["d_a", "d_b"]], "ordering_principle": "weakest_link",
}


def test_undercut():
    r = S.evaluate(PENGUIN)
    claims = r["claims"]
    assert [(claims[a], claims[t], k) for a, t, _, k, w in r["attacks"]] == [("~d1", "flies", "undercutting")]
    ext = [[a for a in claims if claims[a] != "flies"]]
    assert all(S.rationality(r, ext, PENGUIN["strict_rules"]).values())


def test_preferences_filter_symmetric_attacks():
    r = S.evaluate(SENSORS)
    claims = r["claims"]
    assert {(claims[a], claims[t]) for a, t in r["defeats"]} == {("b", "a"), ("b", "safe"), ("~safe", "safe")}


def test_refusals():
    assert S.evaluate({"premises": [str(i) for i in range(129)]})["status"] == "capacity_exceeded"
    assert S.evaluate({"premises": ["x"], "rule_preferences": [["a", "b"], ["b", "a"]]})["status"] == "cyclic_preferences"
    assert S.evaluate({})["arguments"] == []


def test_orderings():
    o = {("x", "y")}
    f = frozenset
    assert S.weaker(f("x"), f("y"), o, "elitist") and not S.weaker(f(), f("y"), o, "elitist") and S.weaker(f("x"), f(), o, "democratic")
    assert S.weaker(f("xz"), f("y"), o, "elitist") and not S.weaker(f("xz"), f("y"), o, "democratic")
    assert S.closure({("a", "b"), ("b", "c")}) == {("a", "b"), ("b", "c"), ("a", "c")}


def test_rows(spark):
    df = spark.createDataFrame([("p", json.dumps(PENGUIN)), ("bad", "{"), ("null", None)], "theory_id string, theory string")
    rows = S.evaluated(df).collect()
    assert {r.theory_id for r in rows if r.kind == "error"} == {"bad", "null"}
    assert len([r for r in rows if r.kind == "argument"]) == 4 and len([r for r in rows if r.kind == "defeat"]) == 1


def test_cycles_components_members(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "d"), ("g", "x", "a"), ("h", "a", "b")], "graph_id string, src string, dst string")
    assert {(r.src, r.dst) for r in G.cyclic_edges(e).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    n = spark.createDataFrame([("g", x) for x in "abcdxyz"] + [("h", "a"), ("h", "b")], "graph_id string, node string")
    comp = {(r.graph_id, r.node): r.component for r in G.components(n, e).collect()}
    assert comp[("g", "d")] == comp[("g", "x")] == "a" and comp[("g", "y")] == "y" and comp[("h", "b")] == "a"
    u = spark.createDataFrame([("g", "C", ["a", "D"]), ("g", "D", ["b", "c"])], "graph_id string, unit string, members array<string>")
    assert {(r.unit, r.member) for r in G.members(u).collect()} == {("C", "a"), ("C", "b"), ("C", "c"), ("D", "b"), ("D", "c")}


def test_right_frontier(spark):
    ok = [("u1", "u2", True), ("u2", "u3", False), ("u1", "u4", True)]
    assert G.frontier(["u1", "u2", "u3"], ok[:2], {}) == []
    # u2 is closed off by the coordination that put u3 beside it.
    assert G.frontier(["u1", "u2", "u3", "u4"], [("u1", "u2", False), ("u2", "u3", False), ("u1", "u4", True)], {}) == ["u4"]
    df = spark.createDataFrame([("g", ["u1", "u2", "u3"], [("u1", "u2", False), ("u1", "u3", False)], None)], "graph_id string, units array<string>, relations array<struct<source:string,target:string,subordinating:boolean>>, complex array<struct<unit:string,members:array<string>>>")
    assert [tuple(r) for r in G.frontier_violations(df).collect()] == [("g", "u3")]


def test_argument_graph(spark):
    n = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b")], "graph_id string, id string")
    r = spark.createDataFrame([("g", "1", "inference", "a", "b"), ("g", "2", "inference", "b", "a"), ("g", "3", "conflict", "a", "z"), ("g", "4", "conflict", "a", "z")], "graph_id string, id string, relation_type string, source_id string, target_id string")
    got = {(x.rule, x.detail) for x in G.argument_graph_violations(n, r).collect()}
    assert got == {("repeated_id", "b"), ("unknown_endpoint", "z"), ("repeated_relation", "a"), ("inference_cycle", "a"), ("inference_cycle", "b")}


def test_every_line_of_an_order_enters_its_theory(spark, tmp_path):
    from logosmill.plans import linking_queries as Q

    lines = [(1, n, "R" if n == 6 else "N") for n in range(1, 8)] + [(2, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    theories = {r.theory_id: json.loads(r.theory) for r in Q.rule_theories(spark, str(tmp_path)).collect()}
    assert theories["1"]["premises"] == [f"p{n}" for n in range(1, 8)] and len(theories["1"]["defeasible_rules"]) == 7
    assert theories["1"]["rule_preferences"] == [["r1", f"r{n}"] for n in range(2, 8)]
    got = {r.theory_id: (r.arguments, r.attacks) for r in Q.structured_defeats(spark, str(tmp_path)).collect()}
    # Line 6 concludes against the other six, and they against it.
    assert got == {"1": (14, 12), "2": (2, 0)}


def test_right_frontier_with_complex_units():
    # A complete complex unit joins by any member that is on the frontier, not only by the last one.
    assert G.frontier(["e1", "e2", "e3", "e4"], [("e1", "e2", True), ("e2", "e3", True), ("c", "e4", True)], {"c": ["e1", "e2"]}) == []
    assert G.frontier(["e1", "e2", "e3"], [("c", "e3", True), ("e1", "e2", False)], {"c": ["e1", "e3"]}) == ["e3"]
    # A unit that nothing attaches is a violation; the first one needs nothing.
    assert G.frontier(["e1", "e2"], [], {}) == ["e2"] and G.frontier(["e1"], [], {}) == [] and G.frontier([], [], {}) == []
    assert G.frontier(["e1", "e2", "e3"], [("e1", "e2", False), ("o", "e3", False)], {"o": ["p"], "p": ["o", "e2"]}) == []
    assert G.frontier(["e1", "e2"], [("gone", "e2", False)], {"x": ["gone"]}) == ["e2"]


def test_long_chains_are_no_cycles(spark):
    rows = [("chain", f"n{i}", f"n{i + 1}") for i in range(3000)] + [("ring", f"n{i}", f"n{(i + 1) % 3000}") for i in range(3000)] + [("ring", "n1", "out"), ("x", None, "a")]
    df = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    got = {(r.graph_id, r.src, r.dst) for r in G.cyclic_edges(df).collect()}
    assert got == {r for r in rows if r[0] == "ring" and r[2] != "out"}
    few = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "b"), ("g", "c", "d"), ("h", "a", "b")], df.schema)
    want = {("g", "b", "c"), ("g", "c", "b")}
    assert {tuple(r) for r in G.cyclic_edges(few).collect()} == {tuple(r) for r in G.cyclic_edges(few, 1).collect()} == want
