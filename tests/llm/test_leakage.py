import random

from logosmill.llm import leakage as L

WORDS = [f"w{i}" for i in range(6)]


def brute(items, docs, run):
    out = set()
    for i, t in items:
        w = L.words_of(t) if t else []
        for d, u in docs:
            x = " " + " ".join(L.words_of(u) if u else []) + " "
            if any(f" {' '.join(w[j:j + run])} " in x for j in range(len(w) - run + 1)):
                out.add((i, d))
    return out


def test_machine_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        run = rng.randint(2, 5)
        items = [(i, [rng.choice(WORDS) for _ in range(rng.randint(1, 9))]) for i in range(4)]
        machine = L.WuManber(items, run)
        doc = [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        assert {(i, 0) for i in machine.items_in(' '.join(doc))} == brute([(i, " ".join(w)) for i, w in items], [(0, " ".join(doc))], run)


def test_query_against_brute_force(spark):
    text = " ".join(f"word{i}" for i in range(30))
    items = [(1, text), (2, " ".join(text.split()[10:])), (3, "too short"), (4, None), (4, None), (5, ""), (6, " ".join(f"other{i}" for i in range(13)))]
    docs = [
        (1, "intro " + " ".join(text.split()[:13])), (2, " ".join(text.split()[:12])), (3, None), (4, ""), (5, text.upper().replace(" ", ",\n> ")), (5, text),
        (6, "<p>" + text.replace(" word7 ", " <b>word7</b> ") + "</p>"), (7, text.replace("o", "о")), (8, " ".join(f"other{i}" for i in range(13))), (9, '{"p": "' + text.replace(" ", "\\n") + '"}'),
    ]
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    d = spark.createDataFrame([(*r, 3) for r in docs], "doc_id bigint, text string, item_id int")
    want = brute(items, docs, 13)
    assert {(1, 1), (1, 5), (2, 5), (1, 6), (1, 7), (6, 8), (1, 9)} <= want
    for block in (5_000_000, 200):  # one block and several
        got = L.leaked_items(i, d, block_characters=block)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert L.leaked_items(i.limit(0), d).count() == 0 and L.leaked_items(i, d.limit(0)).count() == 0


def test_markup_of_any_length():
    words = [f"word{i}" for i in range(13)]
    for inside in (f'<a href="{"x" * 2500}">', f"<!--{' y' * 20_000}-->", "<b>", "&nbsp;", "\\n", "\u00a0"):
        assert L.words_of(f" {inside} ".join(words)) == words
    assert L.words_of("a <!-- b") == ["a", "b"] and L.words_of("1 < 2 <b c") == ["1", "2", "b", "c"]
    assert L.words_of("<!--" * 50_000)[:1] == [] and len(L.words_of("<a " * 50_000)) == 50_000


def test_tokens_fold_as_whole_texts_do():
    for text, want in [
        ("Soft\u00adhyphen na\u00efve nai\u0308ve ＦＵＬＬ", ["softhyphen", "naive", "naive", "full"]), ("straße ﬁne…end", ["strasse", "fine", "end"]),
        ("раура x_y 3.14", ["paypa", "x", "y", "3", "14"]), ("日本語の文。次", ["日本語の文", "次"])]:
        assert L.words_of(text) == want, (text, L.words_of(text))
