from pyspark.sql import functions as F

from logosmill.operators import dialogue as D
from logosmill.operators import linking as L
from logosmill.operators import preparation as P
from logosmill.operators import scoring as C
from logosmill.operators import substrate as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cues_longest_first_then_boundary(spark):
    d = docs(spark, "However, we must not stop, even though it is late.", "Enthusiasm, thusly; thus_ and howeverx", None, "", "In addition to that: IN ORDER TO")
    got = sorted((r.doc_id, r.phrase) for r in S.cue_scan(d).collect())
    assert got == [(0, "even though"), (0, "however"), (0, "must not"), (4, "in addition"), (4, "in order to")]


def test_offsets(spark):
    d = docs(spark, "a1999 b2000", "😀 1234", None)
    assert sorted(tuple(r) for r in S.occurrences(d, "[12][0-9]{3}").collect()) == [(0, 1, 5, "1999"), (0, 7, 11, "2000"), (1, 2, 6, "1234")]
    assert docs(spark, "aaa").select(S.overlapping_occurrences(F.col("text"), "aa")).first()[0] == [0, 1]
    s = S.sections(docs(spark, "\n A b \n\n\n c\n \nd "))
    assert sorted(tuple(r)[1:] for r in s.collect()) == [(1, 2, 5), (2, 10, 11), (3, 14, 15)]


def test_overlap_join_equals_plain_one(spark):
    a = spark.createDataFrame([("d", i * 7, i * 7 + 11, i) for i in range(60)], "k string, start_pos int, stop_pos int, n int")
    b = spark.createDataFrame([("d", i * 13, i * 13 + 90, i) for i in range(30)], "k string, start_pos int, stop_pos int, n int")
    got = {(r.a_n, r.b_n) for r in S.overlapping_spans(a, b, "k", bucket=16).collect()}
    assert got == {(i, j) for i in range(60) for j in range(30) if i * 7 < j * 13 + 90 and j * 13 < i * 7 + 11}


def test_speaker_and_quotes(spark):
    d = docs(spark, "**Ann:** hi", "BOB: x", "Cy (participant p-1): y", "unknown: z", "no label")
    got = [tuple(r) for r in d.select(S.speaker(F.col("text")).alias("s")).select("s.name", "s.resolution", F.col("s.participant").startswith("label:")).collect()]
    assert got == [("Ann", "resolved", True), ("BOB", "resolved", True), ("Cy", "resolved", False), ("unknown", "unresolved", None), (None, "unresolved", None)]
    q = spark.createDataFrame([("Some text here here", "text", 1), ("Some text", "TEXT", 1), ("a  b", "a b", 1), ("a", "[u_1] a", 1), ("here here", "here", 3), ("a", "z", 1)], "t string, q string, n int")
    assert [r[0] for r in q.select(S.quote_status(F.col("t"), F.col("q"), F.col("n"))).collect()] == ["resolved", "case_mismatch", "whitespace_mismatch", "unit_header", "too_few_occurrences", "absent"]


def test_running_total_in_buckets(spark):
    rows = [("g", i, (i * 31) % 17) for i in range(5000)] + [("h", 3, 5)]
    df = spark.createDataFrame(rows, "k string, ord long, v long")
    got = {(r.k, r.ord): r.t for r in P.running_total(df, ["k"], "ord", F.col("v"), "t", bucket=64).collect()}
    total = 0
    for i in range(5000):
        assert got[("g", i)] == total
        total += (i * 31) % 17
    assert got[("h", 3)] == 0


def test_plan_cuts_back_to_best_boundary(spark):
    df = spark.createDataFrame([("d", i, x, r) for i, (x, r) in enumerate([(4, 1), (3, 2), (2, 1), (6, 1), (99, 1), (1, 1)])], "doc string, ord long, demand int, rank int")
    got = sorted((r.ord, r.unit, r.oversized) for r in P.planned(df, ["doc"], 10).collect())
    assert got == [(0, 0, False), (1, 0, False), (2, 1, False), (3, 1, False), (4, 2, True), (5, 3, False)]


def test_commitments(spark):
    rows = [("s", 1, "assert", "The sky is blue.", None), ("s", 2, "assert", "the sky  is not blue", None), ("s", 3, "retract", None, "The sky is blue"), ("s", 4, "assert", "The sky is not blue!", None), ("s", 5, "assert", "the sky is blue", None), ("s", 6, "concede", "not it rains", None), ("s", 7, "assert", "It rains", None), ("t", 8, "assert", "it rains", None)]
    acts = spark.createDataFrame([("c", a, b, b, o, x, y) for a, b, o, x, y in rows], "conv string, speaker string, ord int, act_id int, op string, content string, target string")
    assert {(r.earlier_act, r.later_act) for r in D.commitment_conflicts(acts).collect()} == {(1, 2), (2, 5), (6, 7)}
    assert {(r.speaker, r.act_id) for r in D.active_commitments(acts).collect()} == {("s", 2), ("s", 5), ("s", 6), ("s", 7), ("t", 8)}


def test_centering(spark):
    m = spark.createDataFrame([("d", 0, "alice", "S", 0), ("d", 0, "bob", "O", 9), ("d", 1, "charlie", "S", 0), ("d", 1, "alice", "O", 9), ("d", 2, "charlie", "S", 0), ("d", 2, "workshop", "O", 9)], "doc_id string, u int, entity string, role string, start_pos int")
    t = D.transitions(D.forward_centers(m))
    assert [r.transition for r in t.orderBy("u").collect()] == ["establishment", "retain", "smooth_shift"]
    assert D.coherence(t).first().coherence == 0.625


def test_ibis_grammar_product(spark):
    kinds, relations = ["issue", "position", "argument"], sorted({r for r, _, _ in D.IBIS_GRAMMAR})
    combos = [(f"{r}-{a}-{b}", r, a, b) for r in relations for a in kinds for b in kinds]
    nodes = spark.createDataFrame([(m, x, k) for m, _, a, b in combos for x, k in (("x", a), ("y", b))], "map_id string, id string, kind string")
    links = spark.createDataFrame([(m, "x", r, "y") for m, r, _, _ in combos], "map_id string, source string, relation string, target string")
    bad = {r.map_id for r in D.ibis_violations(nodes, links).where("rule = 'not_in_grammar'").collect()}
    assert bad == {m for m, r, a, b in combos if (r, a, b) not in D.IBIS_GRAMMAR} and len(combos) == 72


def test_scores(spark):
    g = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "y"), ("e", 1, None)], "doc string, k int, l string")
    p = spark.createDataFrame([("d", 1, "x"), ("d", 2, "z"), ("e", 1, None)], "doc string, k int, l string")
    c = C.multiset_counts(g, p, ["doc"], {"key": ["k"], "full": ["k", "l"]})
    assert {(r.doc, r.criterion): (r.gold, r.pred, r.matched) for r in c.collect()} == {("d", "key"): (3, 2, 2), ("d", "full"): (3, 2, 1), ("e", "key"): (1, 1, 1), ("e", "full"): (1, 1, 1)}
    empty = spark.createDataFrame([(0, 0, 0)], "gold int, pred int, matched int")
    assert C.with_prf(empty).first().precision == 0 and C.with_prf(empty, empty_is_one=True).first().f1 == 1
    h = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p_value double")
    assert {r.k: round(r.adjusted, 6) for r in C.holm(h, "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    gs = spark.createDataFrame([("d", 0, 10), ("d", 10, 20)], "u string, start_pos int, stop_pos int")
    ps = spark.createDataFrame([("d", 0, 11), ("d", 1, 10)], "u string, start_pos int, stop_pos int")
    assert tuple(C.soft_matches(gs, ps, "u", 0.5).first()) == ("d", 2, 2, 1)


def test_concept_rules(spark):
    index = spark.createDataFrame(
        [("c:js", "Express.js", False, "unambiguous", [], [], 5), ("c:ex", "express", False, "unambiguous", [], [], 5), ("c:com", "commerce", False, "unambiguous", [], [], 5), ("c:a", "bank", False, "context_anchored", ["river"], [], 5), ("c:b", "bank", False, "unambiguous", [], ["piggy"], 5), ("c:no", "the", False, "never_link", [], [], 5)],
        "curie string, surface string, case_sensitive boolean, match_policy string, anchors array<string>, negative array<string>, anchor_window int")
    d = docs(spark, "We use Express.js daily", "e-commerce and commerce", "the river bank", "a piggy bank", "the bank")
    got = sorted((r.doc_id, r.surface, r.curies, r.resolution) for r in L.link_concepts(d, index).collect())
    assert got == [(0, "Express.js", "c:js", "unique"), (1, "commerce", "c:com", "unique"), (2, "bank", "c:a,c:b", "ambiguous"), (4, "bank", "c:b", "unique")]


def test_enclosing_and_greedy(spark):
    cues = spark.createDataFrame([("d", "c1", 3, 5), ("d", "c2", 90, 95)], "k string, cue_id string, start_pos int, stop_pos int")
    nodes = spark.createDataFrame([("d", "n1", 0, 50), ("d", "n2", 2, 9)], "k string, node_id string, first int, last int")
    assert {r.cue_id: r.node_id for r in L.enclosing(cues, nodes, "k").collect()} == {"c1": "n2", "c2": None}
    s = spark.createDataFrame([("d", 0, 3), ("d", 0, 5), ("d", 4, 6), ("d", 5, 7)], "k string, start_pos long, stop_pos long")
    assert sorted((r.start_pos, r.stop_pos) for r in L.greedy_spans(s, ["k"]).collect()) == [(0, 5), (5, 7)]


def test_language_by_text(spark, tmp_path):
    from logosmill.plans import annotation_queries

    en, fr = "The editor defended the claim, and it is clear that they were not heard by the chair.", "Le juge est parti, et les autres ne sont pas venus avec une lettre pour le maire."
    rows = [(1, en, None), (2, en, "und"), (3, en, "fr"), (4, fr, "EN"), (5, "Yes.", "en-GB"), (6, "Так было, но это не то, что было.", None), (7, "这是一个例子，没有空格的文字。", "und"), (8, "Tаkе this, аnd the rеst оf it is thеirs, not yours.", "en"), (9, "...", None), (10, None, "de"), (11, "Ciao a tutti", "it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.language for r in S.with_language(df).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "fr", 5: "en", 6: "ru", 7: "zh", 8: "en", 9: "und", 10: "de", 11: "it"}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {1, 2, 3} <= {r.doc_id for r in annotation_queries.document_coherence(spark, str(tmp_path)).collect()}
    assert 4 not in {r.doc_id for r in annotation_queries.entity_grid(spark, str(tmp_path)).collect()}


def test_quotations_with_backslashes(spark, tmp_path):
    from logosmill.plans import text_queries

    rows = [(1, "a\\Eb a\\Eb", "a\\Eb", 2), (2, "a\\Qb", "\\Q", 1), (3, "x.x", "x", 3), (4, "one", "", 1), (5, "C:\\dir", "c:\\DIR", 1), (6, "aaa", "aa", 2)]
    df = spark.createDataFrame(rows, "k int, text string, quote string, n int")
    got = {r.k: r.s for r in df.select("k", S.quote_status(F.col("text"), F.col("quote"), F.col("n")).alias("s")).collect()}
    assert got == {1: "resolved", 2: "resolved", 3: "too_few_occurrences", 4: "resolved", 5: "case_mismatch", 6: "too_few_occurrences"}
    text = "See C:\\Eng\\Quotes for the whole freeee text of it."
    spark.createDataFrame([(4, text), (8, "The whole text without any of it.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in text_queries.quote_resolution(spark, str(tmp_path)).collect()} == {(4, "resolved"), (8, "resolved")}
    assert {tuple(r) for r in text_queries.document_needles(spark, str(tmp_path)).collect()} == {(4, 4, text.rindex("ee")), (8, 0, -1)}


def test_concept_boundaries_vetoes_and_anchors(spark):
    """Punctuation before, a hyphened ending and a negative phrase inside another word keep a mention."""
    kind = "curie string, surface string, case_sensitive boolean, match_policy string, anchors array<string>, negative array<string>, anchor_window int, undecided boolean"
    index = spark.createDataFrame([
        ("c:d", "docker", False, "unambiguous", [], ["art"], 25, False), ("c:ny", "New York", False, "unambiguous", [], [], 5, False), ("c:y1", "York", False, "unambiguous", [], [], 5, False),
        ("c:y2", "york", False, "unambiguous", [], [], 5, False), ("c:u", "Annex", True, "case_exact", [], [], 5, False), ("c:l", "ledger", False, "unambiguous", [], [], 5, True),
        ("c:a", "bank", False, "context_anchored", ["river side"], [], 5, False), ("c:blank", " ", False, "unambiguous", [], [], 5, False)], kind)
    texts = ["-docker", "a docker-based one", "docker party", "docker art", "re-docker docker.io docker.", "NEW YORK YORK yorkshire", "Annex annex", "the ledger",
             "bank on the river side", "bank a b c d e river side", "art " + "w " * 24 + "docker", "art " + "w " * 25 + "docker", "İ docker"]
    got = {}
    for r in L.link_concepts(docs(spark, *texts), index).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.surface, r.curies, r.resolution))
    assert [got[i] for i in range(3)] == [[(1, "docker", "c:d", "unique")], [(2, "docker", "c:d", "unique")], [(0, "docker", "c:d", "unique")]]
    assert 3 not in got and got[4] == [(20, "docker", "c:d", "unique")]
    assert got[5] == [(0, "NEW YORK", "c:ny", "unique"), (9, "YORK", "c:y1,c:y2", "ambiguous")]
    assert got[6] == [(0, "Annex", "c:u", "unique")] and got[7] == [(4, "ledger", "c:l", "ambiguous")]
    assert got[8] == [(0, "bank", "c:a", "unique")] and 9 not in got and 10 not in got and 11 in got and got[12][0][0] == 2
    assert L.link_concepts(docs(spark, *texts), index.limit(0)).count() == 0


def test_matching_along_long_chains(spark):
    """Spans of which each overlaps two of the other side: swaps run along the whole chain."""
    n = 3000
    gold = [("d", 10 * i, 10 * i + 10) for i in range(n)]
    pred = [("d", 10 * i + 5, 10 * i + 15) for i in range(n)]
    kind = "u string, start_pos long, stop_pos long"
    assert tuple(C.soft_matches(spark.createDataFrame(gold, kind), spark.createDataFrame(pred[::-1], kind), "u", 0.3).first()) == ("d", n, n, n)


def test_opening_cues_after_any_gap(spark):
    df = docs(spark, "But it is." + " " * 90 + "If so, if not", "no but")
    got = {(r.doc_id, r.cue, r.start_pos) for r in S.opening_cues(df, [("en", "but", "contrast"), ("en", "if", "condition")]).collect()}
    assert got == {(0, "but", 0), (0, "if", 100), (0, "if", 107)}
