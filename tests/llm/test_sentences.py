import pytest

from logosmill.llm import sentences as S

CASES = {
    "abbreviations": ["Dr. Orla and Prof. Bo met Mr. K. at 5 p.m. on Jan. 3.", "They left, e.g. by bus, at 6 p.m.", "The firm is Acme & Co.", "J. R. Doe Jr. paid 3.5% vs. 4.1%."],
    "urls": ["See https://a.example/v1.5/x.html?n=2 for it.", "e-voting came next!", "Wait... is it over?!"],
    "quotes": ["“Order! Order!” cried one, but all went on.", "“Is it so?” asked he.", "The motion (read aloud twice!) failed.", "«¿Es cierto?», dijo."],
    "german": ["Am 9. 5. 1971 tagte der Rat, d. h. fast alle.", "Siehe Abs. 4 Nr. 7 bzw. Anlage 2.", "Dr. Mau zitiert z. B. die Fassung vom 4. Mai 1977."],
    "lists": ["1. First item here.", "(b) Second one.", "# A heading", "BO: Well said."],
    "greek": ["Ποιος έχει το βάρος;", "Βλ. σελ. 5, π.χ. το 9.7 εδώ."],
    "hindi": ["“क्या यह सही है?” अध्यक्ष ने पूछा।", "डॉ. वर्णेय आए।"],
}


def offsets(units, gap):
    out, at = [], 0
    for u in units:
        out.append((at, at + len(u)))
        at += len(u) + len(gap)
    return out


def run(spark, texts):
    df = spark.createDataFrame([(str(i), t, "c", 7) for i, t in enumerate(texts)], "document_id string, text string, k string, h int")
    out = {}
    for r in S.unit_offsets(df).collect():
        out.setdefault(int(r.document_id), []).append((r.start_pos, r.end_pos))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


def test_languages(spark):
    texts = [(" " if k != "lists" else "\n\n").join(u) for k, u in CASES.items()]
    for (name, units), got in zip(CASES.items(), run(spark, texts)):
        assert got == offsets(units, " " if name != "lists" else "\n\n"), name


def test_scripts_without_spaces(spark):
    zh = "谁应当举证？“等一下……”他说，“还没有表决。”“真的吗？”她问道。"
    th = "ไม่มีใครตอบ ขอเวลาอีก 18 นาที ทุกคนเห็นด้วย"
    am = "ነው፧ ተነሣ። አለ።"
    a, b, c = run(spark, [zh, th, am])
    assert [zh[s:e] for s, e in a] == ["谁应当举证？", "“等一下……”他说，“还没有表决。”", "“真的吗？”她问道。"]
    assert [th[s:e] for s, e in b] == ["ไม่มีใครตอบ", "ขอเวลาอีก 18 นาที", "ทุกคนเห็นด้วย"]
    assert [am[s:e] for s, e in c] == ["ነው፧", "ተነሣ።", "አለ።"]


def test_paragraphs_and_edges(spark):
    texts = ["One line\nwraps here. Two.\r\n \r\nThree", "", "   \n\n ", None, " a. B c.", "😀 Hi. Bye."]
    got = run(spark, texts)
    assert [texts[0][s:e] for s, e in got[0]] == ["One line\nwraps here.", "Two.", "Three"]
    assert got[1] == got[2] == got[3] == []
    assert got[5] == [(0, 5), (6, 10)]


def test_units_cover_the_text(spark):
    text = "A long text. " * 3000 + "It ends, e.g. here"
    (got,) = run(spark, [text])
    rest = list(text)
    for s, e in got:
        assert text[s:e] == text[s:e].strip()
        rest[s:e] = " " * (e - s)
    assert not "".join(rest).strip()
    assert len(got) == 3001


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("a", "Xy was. Zed."), ("a", "Xy was. Zed."), (None, "Q.")], "document_id string, text string")
    assert S.unit_offsets(df).count() == 2
    assert S.unit_offsets(df.limit(0)).count() == 0
    assert {r.unit for r in S.sentence_units(df).collect()} == {"Xy was.", "Zed."}


@pytest.mark.parametrize("pattern,replacement", S.mask_steps())
def test_masks_keep_length(pattern, replacement):
    assert len(replacement) == 1


def test_long_and_nested_quotations(spark):
    inner = "It was so. Was it? " * 60
    whole = [
        f"“{inner}It was,” said Orla to Bo.", f"The motion ({inner}or so they say) failed.", f"„{inner}So war es“, sagte Bo.", f"\"{inner}It was,\" said Orla.", f"«{inner}Oui», dit Bo.",
        f"The motion (see Bo. Also (but not here. Never!) see Cy. {inner}Then Di) failed.",
    ]
    got = run(spark, [f"{w} Then all left." for w in whole])
    assert got == [[(0, len(w)), (len(w) + 1, len(w) + 15)] for w in whole]
    # Ended quotations, and closing marks that close nothing, leave units as they are.
    (ended, lists) = run(spark, [f"“{inner.strip()}” Then all left.", "One came. Two left.\n\na) first item. Next."])
    assert len(ended) == 121 and lists[:2] == [(0, 9), (10, 19)]
