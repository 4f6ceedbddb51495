from itertools import product

import pytest
from pyspark.sql import functions as F

from logosmill.operators import argumentation as A

CASES = {  # attacks; grounded; complete; preferred; stable
    "single": ("a", [], {""} | {"a"} - {""}, ["a"], ["a"], ["a"]),
    "simple": ("ab", ["ab"], ["a"], ["a"], ["a"], ["a"]),
    "mutual": ("ab", ["ab", "ba"], [""], ["", "a", "b"], ["a", "b"], ["a", "b"]),
    "odd": ("abc", ["ab", "bc", "ca"], [""], [""], [""], []),
    "self": ("abcd", ["ab", "bc", "dd"], ["ac"], ["ac"], ["ac"], []),
    "chain": ("abcd", ["ab", "bc", "cd"], ["ac"], ["ac"], ["ac"], ["ac"]),
}


def frames(spark, cases):
    args = [(k, x, i) for k, (names, *_ ) in cases.items() for i, x in enumerate(names)]
    att = [(k, e[0], e[1]) for k, (_, edges, *_r) in cases.items() for e in edges]
    return spark.createDataFrame(args, "af_id string, arg string, ord int"), spark.createDataFrame(att, "af_id string, src string, dst string")


def sets(df, mask):
    out = {}
    for r in df.select("af_id", F.array_join(A.named(F.col(mask)), "").alias("m")).collect():
        out.setdefault(r.af_id, []).append(r.m)
    return {k: sorted(v) for k, v in out.items()}


def test_known_answers(spark):
    args, att = frames(spark, CASES)
    m = A.masks(args, att)
    g, c = sets(A.grounded(m), "in_mask"), A.complete(m)
    full, pref, stab = sets(c, "ext"), sets(A.preferred(c), "ext"), sets(A.stable(c), "ext")
    for k, (_, _, ground, comp, prefs, stabs) in CASES.items():
        assert g[k] == (["a"] if k == "single" else ground)
        assert (full[k], pref[k], stab.get(k, [])) == (sorted(comp), sorted(prefs), sorted(stabs))


def brute(n, edges):
    """Complete sets by the definition."""
    out = []
    for s in range(1 << n):
        inside = {i for i in range(n) if s >> i & 1}
        hit = {d for a, d in edges if a in inside}
        defended = {i for i in range(n) if all(a in hit for a, d in edges if d == i)}
        if not inside & hit and defended == inside:
            out.append("".join(sorted("abc"[i] for i in inside)))
    return sorted(out)


def test_all_three_argument_frameworks_and_backtracking(spark):
    pairs = list(product(range(3), repeat=2))
    cases, want = {}, {}
    for bits in range(512):
        edges = [p for k, p in enumerate(pairs) if bits >> k & 1]
        cases[str(bits)] = ("abc", ["abc"[a] + "abc"[b] for a, b in edges])
        want[str(bits)] = brute(3, edges)
    args, att = frames(spark, cases)
    assert sets(A.complete(A.masks(args, att)), "ext") == want
    some = F.col("af_id").cast("int") % 16 == 5
    large = A.extensions_large(args.where(some), att.where(some)).where("semantics = 'complete'").collect()
    got = {}
    for r in large:
        got.setdefault(r.af_id, []).append("".join(sorted(r.members)))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if int(k) % 16 == 5}


def test_long_chain_and_capacity(spark):
    names = [f"a{i:03d}" for i in range(50)]
    args = spark.createDataFrame([("l", x, i) for i, x in enumerate(names)], "af_id string, arg string, ord int")
    att = spark.createDataFrame([("l", a, b) for a, b in zip(names, names[1:])], "af_id string, src string, dst string")
    assert A.grounded(A.masks(args, att)).select(A.named(F.col("in_mask"))).first()[0] == names[::2]
    r = A.extensions_large(args, att).where("semantics = 'stable'").first()
    assert r.members == names[::2]
    big = spark.createDataFrame([("b", str(i), i) for i in range(129)], "af_id string, arg string, ord int")
    assert A.extensions_large(big, att).where("af_id = 'b'").first().semantics == "capacity_exceeded"


def test_violations_and_cleanup(spark):
    args = spark.createDataFrame([("x", "a", 0), ("x", "a", 1), ("x", "b", 2)], "af_id string, arg string, ord int")
    att = spark.createDataFrame([("x", "a", "c"), ("x", "a", "b"), ("x", "a", "b"), ("y", "q", "q")], "af_id string, src string, dst string")
    assert {tuple(r) for r in A.violations(args, att).collect()} == {("x", "duplicate_argument", "a"), ("x", "unknown_endpoint", "c"), ("y", "unknown_endpoint", "q"), ("y", "no_arguments", None)}
    assert [tuple(r) for r in A.cleaned(args, att).collect()] == [("x", "a", "b")]


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    args, att = spark.createDataFrame([], "af_id string, arg string, ord int"), spark.createDataFrame([], "af_id string, src string, dst string")
    assert A.complete(A.masks(args, att)).count() == 0 and A.violations(args, att).count() == 0


def test_compilers(spark):
    nodes = spark.createDataFrame([("m", "i", "issue", 0), ("m", "p", "position", 1), ("m", "q", "position", 2), ("m", "s", "argument", 3), ("m", "o", "argument", 4)], "af_id string, node_id string, kind string, ord int")
    links = spark.createDataFrame([("m", "p", "responds_to", "i"), ("m", "q", "responds_to", "i"), ("m", "s", "supports", "p"), ("m", "o", "objects_to", "p")], "af_id string, source string, relation string, target string")
    assert {(r.src, r.dst) for r in A.from_ibis(nodes, links)[1].collect()} == {("p", "q"), ("q", "p"), ("s", "q"), ("o", "p")}
    lay = spark.createDataFrame([("t", 0, ["r"]), ("t", 1, [])], "af_id string, ord long, rebuttals array<string>")
    assert {(r.src, r.dst) for r in A.from_toulmin(lay)[1].collect()} == {("layout_1_rebuttal_1", "layout_1")}
    ins = spark.createDataFrame([("w", 0, [(0, "open"), (1, "addressed")])], "af_id string, ord long, questions array<struct<index:int,status:string>>")
    assert {(r.src, r.dst) for r in A.from_walton(ins)[1].collect()} == {("scheme_1_cq_0", "scheme_1")}


def test_frameworks_of_any_size(spark):
    """66 arguments do not fit into masks: the error is seen, and extensions() takes another way."""
    names = [f"a{i:02d}" for i in range(66)]
    args = spark.createDataFrame([("big", x, i) for i, x in enumerate(names)] + [("small", x, i) for i, x in enumerate("abc")] + [("pairs", f"p{i:02d}", i) for i in range(26)] + [("over", str(i), i) for i in range(129)], "af_id string, arg string, ord int")
    att = spark.createDataFrame(
        [("big", "a01", "a00"), ("small", "a", "b"), ("small", "b", "c")] + [("pairs", f"p{i:02d}", f"p{i ^ 1:02d}") for i in range(4)] + [("pairs", f"p{i:02d}", f"p{i % 22 + 4:02d}") for i in range(4, 25)], "af_id string, src string, dst string")
    with pytest.raises(Exception, match="too many for masks"):
        A.grounded(A.masks(args, att)).collect()
    got = {}
    for r in A.extensions(args, att).collect():
        got.setdefault((r.af_id, r.semantics), []).append(r.members)
    assert got["big", "grounded"] == got["big", "stable"] == [[x for x in names if x != "a00"]]
    assert got["small", "preferred"] == [["a", "c"]] and got["over", "capacity_exceeded"] == [[]] and ("over", "grounded") not in got
    only = A.extensions(args, att, ("grounded",)).collect()
    assert {r.semantics for r in only} == {"grounded", "capacity_exceeded"} and len(only) == 4
    large = A.extensions_large(args.where("af_id = 'pairs'"), att.where("af_id = 'pairs'")).collect()
    assert sorted(map(sorted, got["pairs", "complete"])) == sorted(sorted(r.members) for r in large if r.semantics == "complete")
