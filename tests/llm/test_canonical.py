import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logosmill.llm import canonical as C

SAME = [
    ("file", "ﬁle"), ("café", "café"), ("ab", "a​b"), ("a b", "a b"), ("a b", "a b"), ("Abc", "Аbс"), ("A,1", "Ａ，１"),
    ("a\nb", "a\r\nb"), ("re-do", "re‑do"), ("Å", "Å"), ("å", "а̊"), ("x", "x \n"), ("ḍ̇", "ḍ̇"), ("K", "K"), ("ab", "a­b"),
]
DISTINCT = [("a", "A"), ("e", "é"), ("m2", "m²"), ("a.", "a!"), ("'", "’"), ("-", "–"), ("\U0001f469‍⚖️", "\U0001f469⚖️"), ("क्‍ष", "क्ष"), ("и", "n")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize("a,b", DISTINCT)
def test_distinct(a, b):
    assert C.canonical(a) != C.canonical(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x3ff), max_size=30))
def test_idempotent_and_normal(text):
    once = C.canonical(text)
    assert C.canonical(once) == once
    assert unicodedata.is_normalized("NFC", once)
    # Canonically equivalent texts have one form.
    assert C.canonical(unicodedata.normalize("NFD", text)) == once


def test_spliced_like_whole_text():
    """Normalizing segments with context gives what normalizing the whole text gives."""
    text = "Dr. Özil ậ 각 café й"
    folded = text.translate(C._tables()[1])
    assert C.canonical(text) == unicodedata.normalize("NFC", unicodedata.normalize("NFD", folded).translate(C._tables()[1]))


def brute(rows):
    out = set()
    for f in (1, 2):
        for a in rows:
            for b in rows:
                if a[0] is not None and b[0] is not None and a[0] < b[0] and a[f] is not None and b[f] is not None and a[f] != b[f] and C.canonical(a[f]) == C.canonical(b[f]):
                    out.add((("text", "original_text")[f - 1], a[0], b[0]))
    return out


def test_pairs_against_brute_force(spark):
    rows = [(1, "file a", "x"), (2, "ﬁle a", "x"), (3, "file a", None), (4, "File a", "x "), (5, "file a", "y"), (5, "file a", "y"), (6, "", ""), (7, "​", None), (None, "ﬁle a", None), (8, None, None)]
    df = spark.createDataFrame([(*r, "k", True) for r in rows], "segment_key bigint, text string, original_text string, form string, changed boolean")
    got = C.lookalike_pairs(df, "segment_key", "text", "original_text")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))
    assert C.lookalike_pairs(df.limit(0), "segment_key", "text", "original_text").count() == 0


def test_column_keeps_nulls_and_long_texts(spark):
    long = "a " * 300_000
    df = spark.createDataFrame([(None,), ("",), ("  x  ",), (long,)], "t string")
    got = [r[0] for r in C.canonicalize(df, "t").select("t_canonical").collect()]
    assert got == [None, "", "x", ("a " * 300_000).rstrip()]


def test_texts_ending_in_unstable_line_ends(spark):
    ends = ["", "\r", "\r\n", "\u0085", "\u2028", "\u2029", " \n", "\n\r\n"]
    df = spark.createDataFrame([(i, "abc" + e) for i, e in enumerate(ends)], "k bigint, text string")
    assert [r.text_canonical for r in C.canonicalize(df, "text").orderBy("k").collect()] == ["abc"] * len(ends)
    assert C.lookalike_pairs(df, "k", "text").count() == len(ends) * (len(ends) - 1) // 2


def test_hot_forms_and_classes(spark):
    forms = ["\u200b" * i for i in range(4)] + ["", " \u00ad"]  # all are blank to a reader
    rows = [(i, forms[i % 6] if i < 90 else ("ab" if i % 2 else "a\u200bb"), None) for i in range(120)] + [(5, forms[5], None), (None, "ab", None), (500, "other", None)]
    df = spark.createDataFrame(rows, "segment_key bigint, text string, form string")
    values = {k: t for k, t, _ in rows if k is not None}
    want = {("text", a, b) for a in values for b in values if a < b and values[a] != values[b] and C.canonical(values[a]) == C.canonical(values[b])}
    for hot in (10, 1_000):
        got = [tuple(r) for r in C.lookalike_pairs(df, "segment_key", "text", hot=hot).collect()]
        assert set(got) == want and len(got) == len(want)
    links = {r.segment_key: r.links for r in C.lookalike_classes(df, "segment_key", "text").collect()}
    assert links == {k: sum(k in (a, b) for _, a, b in want) for k in values if any(k in (a, b) for _, a, b in want)}
    assert C.lookalike_classes(df.limit(0), "segment_key", "text").count() == 0
