import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logosmill.functions import canonical_json as J
from logosmill.operators import annotations as N
from logosmill.operators import dialogue as D
from logosmill.operators import entities as E
from logosmill.operators import trees as T
from logosmill.sources import readers as R

TEXTS = {
    "coherent": "Elena designed the compiler. She tested the compiler in production. She documented the results for Marcus.",
    "disjoint": "Elena designed the compiler. Thunderstorms delayed regional flights. Pottery glazes require kiln calibration.",
}


def test_centering_with_pronouns(spark):
    df = spark.createDataFrame([*TEXTS.items(), ("none", None), ("empty", "")], "doc_id string, text string")
    m = E.document_mentions(df)
    assert m.where("doc_id = 'coherent' and is_pronoun").count() == 2
    rows = E.document_utterances(df).join(D.forward_centers(m), ["doc_id", "u"], "left").select("doc_id", "u", F.coalesce("cf", F.array().cast("array<string>")).alias("cf"))
    t = D.transitions(rows)
    by = {k: [r.transition for r in t.where(F.col("doc_id") == k).orderBy("u").collect()] for k in TEXTS}
    assert len(by["coherent"]) == 3 and by["coherent"][0] == "establishment" and "zero_cb" in by["disjoint"]
    score = {r.doc_id: r.coherence for r in D.coherence(t).collect()}
    assert score["coherent"] > score["disjoint"] and set(score) == set(TEXTS)


def test_entity_keys(spark):
    want = {"the Policies": ("policy", True), "Every bus": ("bus", False), "cars": ("car", True), "of the": ("", False), "": ("", False), "a glass": ("glass", False),
            "Analysis": ("analysis", False), "ties": ("tie", True), "the of Red Kites": ("red kite", True), "gas": ("gas", False)}
    df = spark.createDataFrame([(n,) for n in want], "s string")
    assert {r.s: tuple(r.k) for r in df.select("s", E.entity_key(F.col("s")).alias("k")).collect()} == want


def test_mentions_by_rule(spark):
    texts = {
        "roles": "Marie Curie showed the results to the committee.", "pronouns": "The engineers visited Anna. They thanked her. It rained.", "gap": "Elena left.  \n\nNobody came. She slept.",
        "none": None, "blank": " \n ", "number": "The policies failed. A bridge failed. It held them.", "named": "we saw big red kites over it. They left."}
    df = spark.createDataFrame([*texts.items(), (None, "Elena left.")], "doc_id string, text string").withColumn("u", F.lit(7))
    names = spark.createDataFrame([("named", 7, 20)], "doc_id string, start_pos bigint, stop_pos bigint")
    got = {}
    for r in E.document_mentions(df, names=names).orderBy("doc_id", "u", "start_pos").collect():
        got.setdefault(r.doc_id, []).append((r.u, r.entity, r.role, r.start_pos, r.stop_pos, r.is_pronoun))
    assert got["roles"] == [(0, "marie curie", "S", 0, 11, False), (0, "result", "O", 23, 30, False), (0, "committee", "O", 38, 47, False)]
    assert got["pronouns"][:2] == [(0, "engineer", "S", 4, 13, False), (0, "anna", "O", 22, 26, False)]
    assert [m[1:3] + m[5:] for m in got["pronouns"][2:]] == [("engineer", "S", True), ("anna", "O", True), ("anna", "S", True)]
    assert [m[:2] for m in got["gap"]] == [(0, "elena")]  # nothing in the utterance before the pronoun
    assert [m[1] for m in got["number"] if m[5]] == ["bridge", "bridge"]
    assert got["named"] == [(0, "big red kite", "S", 7, 20, False), (1, "big red kite", "S", 30, 34, True)]
    assert set(got) <= {"roles", "pronouns", "gap", "number", "named"}
    assert E.document_mentions(df.limit(0)).count() == 0


def test_relation_contracts(spark):
    schema = "relation_id string, relation_type string, senses array<string>, arg1 array<struct<start:int,stop:int>>, arg2 array<struct<start:int,stop:int>>, connective_spans array<struct<start:int,stop:int>>, inferred_connectives array<string>, alternative_spans array<struct<start:int,stop:int>>"
    rows = [("ok", "Explicit", ["a"], [(0, 5)], [(9, 12)], [(6, 8)], None, None), ("bad", "EntRel", ["a"], [(0, 5)], [(4, 9)], None, ["and"], None), ("none", "Other", None, None, None, None, None, None)]
    got = {tuple(r) for r in N.relation_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("bad", "arguments_overlap"), ("bad", "sense_not_allowed"), ("bad", "evidence_not_allowed"), ("none", "unknown_type")}


def test_rs3_round_trip(spark):
    nodes = [("d", "1", "2", "edu", "span", "A & b"), ("d", "3", "2", "edu", "cause", "<c>"), ("d", "2", None, "span", None, None)]
    df = spark.createDataFrame(nodes, "tree_id string, id string, parent string, kind string, relname string, contents string")
    files = T.rs3(df).select(F.col("tree_id").alias("doc"), F.col("rs3").alias("content")).unionByName(spark.createDataFrame([("x", "<rst>"), ("n", None)], "doc string, content string"))
    got = {(r.doc, r.id, r.kind, r.parent, r.relname, r.relkind, r.contents) for r in R.rs3(files).collect()}
    assert got == {("d", "1", "edu", "2", "span", None, "A & b"), ("d", "3", "edu", "2", "cause", "r", "<c>"), ("d", "2", "span", None, None, None, None), ("x", None, "error", None, None, None, None), ("n", None, "error", None, None, None, None)}


def test_central_units(spark):
    rows = [("t", "r", None, "span", None, 1.0), ("t", "m", "r", "multinuc", "span", 1.0), ("t", "e1", "m", "edu", "joint", 1.0), ("t", "e2", "m", "edu", "joint", 2.0), ("t", "e3", "r", "edu", "cause", 3.0)]
    df = spark.createDataFrame(rows, "tree_id string, id string, parent string, kind string, relname string, left_edge double")
    assert T.central_units(df).first().unit == "m" and T.central_units(df, force_leaf=True).first().unit == "e1"


def test_trees_by_hand(spark):
    assert T.binarised([("S", "a"), ("N", "x"), ("N", "x"), ("S", "b")]) == [(0, 3, "SN", "a"), (1, 3, "NS", "b"), (1, 2, "NN", "x")]
    df = spark.createDataFrame([("t", 3, 1, 3, 1, 0.5), ("t", 3, 1, 3, 2, 0.9)], "tree_id string, n int, start int, stop int, split int, score double")
    assert sorted(tuple(r)[1:] for r in T.cky_decode(df).collect()) == [(1, 2, 1), (1, 3, 2)]
    micro = spark.createDataFrame([("d", 1, 1, None, 0, 9), ("d", 1, 2, 1, 0, 4), ("d", 2, 1, None, 0, 3)], "doc_id string, section_no int, node_id int, parent_id int, start_pos long, stop_pos long")
    macro = spark.createDataFrame([("d", 1, None, None), ("d", 2, 1, 1), ("d", 3, 1, 2)], "doc_id string, node_id int, parent_id int, section_no int")
    sec = spark.createDataFrame([("d", 1, 0), ("d", 2, 20)], "doc_id string, section_no int, start_pos long")
    got = {r.node_id: (r.parent_id, r.start_pos) for r in T.stitched(micro, macro, sec).collect()}
    assert got == {"1:1": ("m:1", 0), "1:2": ("1:1", 0), "2:1": ("m:1", 20), "m:1": (None, None)}


def test_doclang_and_archives(spark):
    xml = '<d xmlns="urn:x"><heading>A</heading><text>B  c</text><text/></d>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.xml", xml)
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../a.xml", xml)
    df = spark.createDataFrame([("p", bytearray(xml.encode())), ("z", bytearray(buf.getvalue())), ("e", bytearray(evil.getvalue())), ("b", bytearray(b"<d>"))], "path string, content binary")
    rows = R.doclang(df).collect()
    paths = ["/d[1]", "/d[1]/heading[1]", "/d[1]/text[1]", "/d[1]/text[2]"]
    assert [r.xpath for r in rows if r.path == "p"] == paths and [r.xpath for r in rows if r.path == "z"] == paths
    assert {r.path for r in rows if r.tag == "error"} == {"e", "b"}
    assert [r.text for r in rows if r.path == "p"] == [None, "A", "B c", None]


def test_token_file_and_units(spark):
    lines = ["# id", "1\tA\tBeginSeg=Yes", "2\tb\t_", "", "1\tC\tBeginSeg=Yes"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, value string")
    assert sorted((r.sentence_no, r.form, r.begins_unit) for r in R.token_file(df).collect()) == [(1, "A", True), (1, "b", False), (2, "C", True)]
    u = spark.createDataFrame([("k", '["ab", " ", "c"]'), ("n", None)], "k string, j string")
    assert [(r.item_id, r.start_pos) for r in R.unit_lists(u, "k", "j").orderBy("ord").collect()] == [("edu:0", 0), ("edu:2", 3)]


@given(st.recursive(st.none() | st.booleans() | st.integers(-J.SAFE, J.SAFE) | st.floats(-1e15, 1e15) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_canonical_json_round_trip(x):
    text = J.canonical(x)
    assert json.loads(text) == x and J.canonical(json.loads(text)) == text


def test_canonical_json_numbers_and_refusals(spark):
    assert J.canonical([1.0, 1e21, 1e-7, 0.000001, -0.0, 1.5e300]) == "[1,1e+21,1e-7,0.000001,0,1.5e+300]"
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":1,"a":2}',), ("NaN",), (None,), ("{",)], "j string")
    assert [r[0] for r in df.select(J.canonical_column(F.col("j"))).collect()] == ['{"a":2,"b":1}', None, None, None, None]
    assert J.pointer({"a/b": [1, {"~": 2}]}, "/a~1b/1/~0") == 2
    with pytest.raises(KeyError):
        J.pointer([1], "/01")
