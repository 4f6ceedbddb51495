import json
import math

from logosmill.operators import argumentation as A
from logosmill.operators import linking as L
from logosmill.operators import structured as S
from logosmill.operators import trees as T


def test_recombined_units(spark):
    kinds = "doc_id string, unit_no int, node_id int, parent_id int, relation string, nuclearity string, first_edu int, last_edu int, start_pos int, stop_pos int"
    nodes = [("d", 0, 1, 3, "span", "NS", 1, 1, 0, 5), ("d", 0, 2, 3, "elaboration", "NS", 2, 2, 5, 9), ("d", 0, 3, None, None, None, 1, 2, 0, 9), ("d", 1, 1, None, None, None, 1, 1, 0, 4)]
    nodes += [("e", 0, 1, None, None, None, 1, 1, 0, 4), ("e", 1, 1, None, None, None, 1, 1, 0, 4), ("e", 1, 2, None, None, None, 2, 2, 0, 4), ("f", 0, 1, None, None, None, 1, 1, 0, 4)]
    units = spark.createDataFrame([("d", 0, 0, 9), ("d", 1, 10, 14), ("e", 0, 0, 4), ("e", 1, 5, 9), ("f", 0, 0, 4)], "doc_id string, unit_no int, start_pos int, stop_pos int")
    df = spark.createDataFrame(nodes, kinds)
    got = sorted(tuple(r)[2:10] for r in T.recombined(df, units).collect() if r.doc_id == "d")
    assert got == [
        (1, 3, "span", "NS", 1, 1, 0, 5), (2, 3, "elaboration", "NS", 2, 2, 5, 9), (3, 5, "same-unit", "NN", 1, 2, 0, 9), (4, 5, "same-unit", "NN", 3, 3, 10, 14),
        (5, None, None, None, 1, 3, 0, 14)]
    assert {tuple(r) for r in T.recombination_violations(df, units).collect()} == {("e", 1, "roots"), ("f", 0, "single_unit")}
    assert {r.doc_id for r in T.recombined(df, units).collect()} == {"d"}


def test_framework_from_rules(spark):
    theory = {"premises": ["p", "q"], "defeasible_rules": [["r1", ["p"], "ok"], ["r2", ["q"], "~ok"]], "rule_preferences": [["r1", "r2"]]}
    rows = S.evaluated(spark.createDataFrame([("t", json.dumps(theory)), ("bad", "{")], "theory_id string, theory string"))
    args, attacks = S.framework(rows)
    assert [tuple(r) for r in args.orderBy("ord").collect()] == [("t", f"a_{i}", i) for i in range(1, 5)]
    assert [tuple(r) for r in attacks.collect()] == [("t", "a_4", "a_3")]
    assert A.violations(args, attacks).count() == 0 and A.masks(args, attacks).first().att == [0, 0, 8, 0]


def test_structural_features(spark):
    n = [("d", 1, 4, "edu", 0, 10, 1, "However, it rained."), ("d", 2, 4, "edu", 10, 30, 2, "They stayed."), ("d", 3, 5, "edu", 30, 35, 3, "If so."), ("d", 4, 5, "span", 0, 30, 1, ""), ("d", 5, None, "span", 0, 35, 1, ""), ("d", 6, None, "edu", 40, 41, 4, "")]
    nodes = spark.createDataFrame(n, "doc_id string, node_id int, parent_id int, kind string, start_pos int, stop_pos int, first_edu int, text string")
    pairs = spark.createDataFrame([("d", 1, 3), ("d", 3, 2), ("d", 4, 1), ("d", 1, 6)], "doc_id string, source_id int, target_id int")
    got = {(r.source_id, r.target_id): r for r in L.structural_features(pairs, nodes, "doc_id").collect()}
    assert {k: r.hops for k, r in got.items()} == {(1, 3): 3, (3, 2): 3, (4, 1): 1, (1, 6): None}
    a, b = got[1, 3], got[3, 2]
    assert math.isclose(a.length_ratio, math.log(2)) and math.isclose(b.log_distance, -math.log1p(20)) and (a.edu_distance, b.edu_distance) == (2, -1)
    assert (a.contrast, a.cause, a.condition, b.condition) == (True, False, False, True) and not got[4, 1].source_is_edu and a.target_is_edu
