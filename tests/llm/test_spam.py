import numpy as np

from logosmill.llm import spam as S

def _word(i, tail):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3)) + tail


def prose(n):
    """2 n sentences of which the function words come again and most others don't, as in running text."""
    w = lambda i: _word(7 * i, ("bridge", "annex", "letter", "ledger")[i % 4])
    return "".join(f"The {w(8 * i)} was {w(8 * i + 1)} and it is {w(8 * i + 2)} that not every {w(8 * i + 3)} had {w(8 * i + 4)} for the {w(8 * i + 5)}. Since then it has {w(8 * i + 6)} on who would be in the {w(8 * i + 7)}. " for i in range(n))


PROSE = prose(1)
KEYS = "cheap logic kit, best logic kit, logic kit online, free logic kit, "
LINKS = "\n".join(f"- [logic kit](https://shop{i}.example/p/{i})" for i in range(12))
GOODS = "\n".join(f"Logic Kit Pro{i} | SKU 1234{i} | 12.30 EUR | logic kit" for i in range(8))
REFS = "\n".join(f"[{i}] Doe, Town, 199{i}. https://paper.example/{i}" for i in range(5))
NAMES = "Present: " + ", ".join(f"{a}{b}" for a in ("Mar", "Tol", "Ved", "Sun") for b in ("gate", "wick", "holm", "by"))


def _keywords(n):
    return [_word(i, "lamp") for i in range(n)]


def labels(*texts):
    found = S.unit_features(list(texts))
    return [None if np.isnan(found["label"][found["page"] == i][0]) else int(found["label"][found["page"] == i][0]) for i in range(len(texts))]


def test_units_and_features():
    f = S.unit_features([prose(2), "", "See (v. 2) now!\n\nAnd “so.” Then https://a.example/x.y end", LINKS])
    assert f["page"].tolist() == [0] * 4 + [2] * 4 + [3] * 12
    assert f["size"][:4].tolist() == [len(s.replace(" ", "")) for s in prose(2).replace(". ", ".|").split("|")[:4]]
    assert f["link_share"][f["page"] == 3].min() > 0.8 and f["host_spread"][-1] == 1 and f["link_share"][:4].max() == 0
    assert (f["function_share"][:4] > 0.3).all() and f["ends"][:4].all()
    assert {k: len(v) for k, v in S.unit_features([]).items()}.keys() == f.keys() and len(S.unit_features(["  \n"])["size"]) == 0


def test_features_do_not_depend_on_neighbours():
    texts = [prose(3), KEYS * 9, LINKS, GOODS, "日本語の文です。次の文。", "#LogicKit #BestLogicKit " * 9, REFS]
    together = S.unit_features(texts)
    for i, t in enumerate(texts):
        alone = S.unit_features([t])
        for k in S.FEATURES:
            assert np.allclose(together[k][together["page"] == i], alone[k]), (i, k)


def test_weak_labels_need_plain_pages():
    assert labels(prose(3), KEYS * 10, LINKS, GOODS, "#LogicKit #BestLogicKit " * 9) == [0, 1, 1, 1, 1]
    assert labels(prose(2) + "\n" + LINKS, PROSE + KEYS * 2, "如果数据没有核实，就不能成立。" * 9) == [None, None, 0]
    words = _keywords(140)  # repetition counts whatever the length of the page
    shuffled = [w for k in range(40) for w in words[k:] + words[:k]]
    assert labels(", ".join(shuffled), "\n".join(", ".join(shuffled[i : i + 10]) for i in range(0, len(shuffled), 10))) == [1, 1]


def corpus(spark, n, extra=()):
    kinds = [prose(3), KEYS * 12, prose(6) + "\n" + REFS, LINKS * 3, prose(4) + "\n" + NAMES, GOODS * 3, "#LogicKit #BestLogicKit " * 9]
    rows = [(i, kinds[i % 7], f"h{i % 5}" if i % 11 else None, 1.0, 1) for i in range(n)]
    rows += [(n, None, "h1", 1.0, 1), (n + 1, "", None, 1.0, 1), (0, prose(3), "h0", 1.0, 1), (None, KEYS * 12, "h0", 1.0, 1), *extra]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double, host int")


def test_trees_judge_pages_without_a_label(spark):
    """Mixed pages have no weak label: the trees tell their units apart, and characters decide."""
    words = _keywords(140)
    mixed = [
        (1000, prose(2) + "\n" + LINKS * 3, "h1"), (1001, prose(9) + "\n" + LINKS, "h1"), (1002, PROSE + "\n" + KEYS * 9, "h2"), (1003, prose(9) + "\n" + KEYS * 3, "h2"),
        (1004, GOODS + "\n" + PROSE, "h3"), (1005, ", ".join(words * 40) + "\n" + prose(100), "h3"), (1006, prose(3) + "\n" + NAMES, "h4")]
    assert labels(mixed[0][1], mixed[1][1]) == [None, None]
    df = corpus(spark, 210, [(k, t, h, 1.0, 1) for k, t, h in mixed])
    got = {r.doc_id for r in S.spam_pages(df, per_class=60).collect()}
    assert got == {i for i in range(210) if i % 7 in (1, 3, 5, 6)} | {1000, 1002, 1004, 1005}


def test_hosts_turn_pages_of_which_the_trees_are_unsure(spark):
    """The same unsure page counts as spam on a host of spam and not on one of prose; sure pages stay what they are."""
    spam, prose_, unsure, less = [0.0, 0.0, 90.0], [90.0, 0.0, 0.0], [0.0, 90.0, 0.0], [60.0, 20.0, 10.0]
    rows = [(i, "clean", prose_) for i in range(60)] + [(100 + i, "farm", spam) for i in range(60)] + [(200 + i, "mixed", spam if i % 2 else prose_) for i in range(60)]
    rows += [(500 + i, h, unsure) for i, h in enumerate(["clean", "farm", None])] + [(600 + i, h, less) for i, h in enumerate(["clean", "farm"])]
    got = {r.doc_id: r for r in S.smoothed(spark.createDataFrame(rows, "doc_id bigint, host string, mass array<double>"), 2).collect()}
    assert [got[500 + i].share for i in range(3)] == [0.0, 1.0, 0.0] and got[500].tree_share == got[501].tree_share
    assert [round(got[600 + i].share, 2) for i in range(2)] == [0.11, 0.33]
    assert all(got[i].share == 0 and got[100 + i].share == 1 and got[200 + i].share == i % 2 for i in range(60))


def test_degenerate_tables(spark):
    df = corpus(spark, 12)
    assert S.spam_pages(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, KEYS * 12, None), (2, None, "h"), (3, "", "h")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in S.spam_pages(only).collect()} == {1}
    long_ = spark.createDataFrame([(1, KEYS * 20_000, None), (2, prose(8_000), "h")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in S.spam_pages(long_).collect()} == {1}
