import math

import pytest
from pyspark.sql import functions as F

from logosmill.operators import alignment as A
from logosmill.operators import annotations as N
from logosmill.operators import preparation as P
from logosmill.operators import scoring as C
from logosmill.operators import substrate as S
from logosmill.operators import trees as T
from logosmill.session import broadcast_if_small


def test_quotes_of_any_characters(spark):
    texts = {1: "aaa a.c a\\Ec (a+b) [x] ^$", 2: None, 3: "", 4: "😀aa😀aa"}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id bigint, text string")
    quotes = ["aa", "a.c", "\\E", "a\\Ec", "(a+b)", "[x]", "^$", "", None, "absent", "aa😀"]
    q = spark.createDataFrame([(d, i, x) for d in texts for i, x in enumerate(quotes)] + [(9, 0, "aa")], "doc_id bigint, quote_id int, quote string")
    seg = spark.createDataFrame([(d, 0, 0, 5) for d in texts] + [(d, 1, 5, 99) for d in texts], "doc_id bigint, segment_id int, start_pos int, stop_pos int")
    want = {(d, i, at, s) for d, t in texts.items() for i, x in enumerate(quotes) if t and x for at in range(len(t)) if t.startswith(x, at) for s, a, b in ((0, 0, 5), (1, 5, 99)) if at < b and a < at + len(x)}
    got = [tuple(r) for r in A.quote_alignment(q, docs, seg, "doc_id").collect()]
    assert set(got) == want and len(got) == len(want)


def test_cues_with_places(spark):
    df = spark.createDataFrame([(1, "However, however—However2 İ thus"), (2, None), (3, ""), (None, "thus"), (4, "thusthus thus")], "doc_id bigint, text string")
    got = {(r.doc_id, r.start_pos, r.stop_pos, r.phrase) for r in S.cue_spans(df).collect()}
    assert got == {(1, 0, 7, "however"), (1, 9, 16, "however"), (1, 28, 32, "thus"), (4, 9, 13, "thus")}
    counts = {(r.doc_id, r["count"]) for r in S.cue_scan(df.where("doc_id is not null")).groupBy("doc_id").count().collect()}
    assert counts == {(1, 3), (4, 1)}


def test_merged_cells(spark):
    grid = {"ok": ["ched lcel fcel", "ucel xcel fcel", "fcel fcel lcel"], "bad": ["lcel fcel", "fcel ucel"], "bent": ["fcel lcel", "ucel fcel"], "torn": ["fcel fcel", "ucel xcel"]}
    rows = [(t, r, c, token) for t, lines in grid.items() for r, line in enumerate(lines) for c, token in enumerate(line.split())] + [(None, 0, 0, "fcel")]
    got = {(x.t, x.row, x.col): tuple(x)[3:] for x in P.merged_cells(spark.createDataFrame(rows, "t string, row int, col int, token string"), "t").collect()}
    assert got["ok", 1, 1] == got["ok", 0, 0] == (0, 0, 2, 2, None) and got["ok", 2, 2] == (2, 1, 1, 2, None) and got["ok", 1, 2] == (1, 2, 1, 1, None)
    assert got["bad", 0, 0][4] == "no_owner" and got["bad", 1, 1][:4] == (0, 1, 2, 1)
    assert got["bent", 1, 0][4] == got["bent", 0, 1][4] == "not_rectangular" and got["torn", 1, 1][4] == "no_owner" and len(got) == len(rows) - 1


def test_temperature_against_a_grid(spark):
    rows = [([2.0, 0.5, 0.1], 0), ([0.2, 3.0, 0.3], 1), ([1.0, 2.5, 0.0], 0), ([0.5, 0.1, 1.0], 2), ([4.0, 0.0, 1.0], 2), ([1.0, 1.0, 1.0], 1), ([2.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame([(s, t, "x") for s, t in rows] + [([1.0], None, "x"), (None, 1, "x"), ([], 0, "x")], "scores array<double>, target int, s string")
    got = C.temperature(df)
    loss = lambda t: -sum(s[k] / t - math.log(sum(math.exp(x / t) for x in s)) for s, k in rows)
    assert loss(got) <= min(loss(0.01 * k) for k in range(10, 1000)) + 1e-9
    assert C.temperature(df.limit(0)) is None


def test_anchors_speakers_and_candidates(spark):
    spans = spark.createDataFrame([("d", 1, 3, 8), ("d", 2, None, 4)], "doc string, span_id int, start_pos int, stop_pos int")
    seg = spark.createDataFrame([("d", 0, 0, 5, False, 100, 105), ("d", 1, 5, 10, True, 200, 205), ("d", 2, 5, 9, None, 300, 305)], "doc string, segment_id int, start_pos int, stop_pos int, transformed boolean, anchor_start int, anchor_stop int")
    assert sorted(tuple(r)[2:] for r in A.clipped_anchors(spans, seg, "doc").collect()) == [(0, 103, 105), (1, 200, 205), (2, 300, 305)]
    src = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "s string")
    turns = spark.createDataFrame([("a", "resolved"), ("b", "resolved"), ("b", None), ("b", "unresolved")], "s string, resolution string")
    assert sorted(map(tuple, A.unmet_speakers(src, turns, "s").collect())) == [("b", 2, "unresolved_turns"), ("c", 0, "no_turns")]
    m = spark.createDataFrame([("i", 0, "x", "c:1", "unique"), ("i", 0, "x", "c:2", "unique")], "item string, start int, quote string, curies string, resolution string")
    s = spark.createDataFrame([("i", 0, "x"), ("i", 0, "x"), ("i", 1, "x")], "item string, start int, quote string")
    assert sorted(map(tuple, A.resolved_candidates(s, m, ["item", "start", "quote"]).collect())) == [("i", 0, "x", "c:1", "unique"), ("i", 1, "x", None, "unmapped")]


@pytest.mark.parametrize("value, want", [("Elaboration-N-E", "elaboration"), ("attribution-n", "attribution-negative"), ("TextualOrganization", "textual-organization"), (" x-n", " x-n"), ("", ""), (None, None)])
def test_label_keys(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(A.observed_key(F.col("v"), F.lit("rst_dt_corpus_label"))).first()[0] == want
    assert df.select(A.coarse_label(F.lit("Cause-result"), ["cause"], {"cause": "contingency"}), A.coarse_label(F.lit("cause-"), ["cause"]), A.coarse_label(F.lit("because"), ["cause"])).first()[:] == ("contingency", None, None)


def test_figures_times_and_ids(spark):
    df = spark.createDataFrame([("rhetorical_question", "Is it?"), ("rhetorical_question", "It is."), ("anaphora", "We go, we stay."), ("chiasmus", "One two."), ("irony", ""), ("anaphora", None), ("anaphora", "1 1")], "s string, q string")
    assert [r[0] for r in df.select(A.figure_evidence(F.col("s"), F.col("q"))).collect()] == [None, "question_mark", None, "repeated_word", None, None, "repeated_word"]
    t = spark.createDataFrame([(1, None, 2, 3), (None, None, None, 3)], "h int, m int, s int, ms int")
    assert [r[0] for r in t.select(A.cue_interval(*map(F.col, ("h", "m", "s", "ms")))).collect()] == [3602003, None]
    e = spark.createDataFrame([("d", "b", 5), ("d", "a", 5), ("d", "c", 1), ("d", None, 0), ("d", "b", 9)], "doc string, entity string, at int")
    assert {r.entity: r.entity_id for r in A.first_seen_ids(e, "doc", "entity", "at").collect()} == {"c": "ent_1", "a": "ent_2", "b": "ent_3"}


def test_dispatch_of_unknown_and_null(spark):
    caps = spark.createDataFrame([("t", "available", ["f"], False), ("t", "available", ["f"], False)], "technique string, state string, formalisms array<string>, needs_structured boolean")
    req = spark.createDataFrame([(1, "t", None, None), (2, "u", False, "f"), (3, None, None, None), (4, "t", False, "g")], "id int, technique string, structured boolean, formalism string")
    assert {r.id: r.reason for r in N.dispatched(req, caps).collect()} == {1: None, 2: "not_implemented", 3: "not_implemented", 4: "formalism_unsupported"}
    assert N.dispatched(req.limit(0), caps).count() == 0 and N.dispatched(req, caps.limit(0)).where("reason = 'not_implemented'").count() == 4


def test_broadcast_needs_few_bytes_too(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 5, "a string")
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(wide)) and not hinted(broadcast_if_small(wide, max_bytes=100)) and not hinted(broadcast_if_small(wide, max_rows=4)) and hinted(broadcast_if_small(wide.limit(0)))


def test_json_ld_is_json(spark):
    import json

    rows = [("t", "1", None, "span", None, 'a "q"\n'), ("t", "2", "1", "edu", "span", None)]
    nodes = spark.createDataFrame([(a, b, c, d, e, 1.0, 1.0, f) for a, b, c, d, e, f in rows], "tree_id string, id string, parent string, kind string, relname string, left_edge double, right_edge double, contents string")
    doc = json.loads(T.json_ld(nodes).first().document)
    assert [x["@id"] for x in doc["@graph"]] == ["http://example.org/discourse/t", "doc:node_1", "doc:node_2", "doc:edge_2"] and doc["@graph"][1]["text"] == 'a "q"\n' and doc["@context"]["doc"].endswith("t#")
