import random

import pytest

from logosmill.llm import splitting as S

REQ = "requirement_id string, capacity_unit string, capacity_maximum bigint, capacity_margin bigint, overlap_size bigint, boundary_preference array<string>"


def size(text, unit):
    if unit == "code_points":
        return len(text)
    if unit == "utf8_bytes":
        return len(text.encode())
    n, inside = 0, False
    for c in text:
        now = c not in " \t\r\n"
        n += now and not inside
        inside = now
    return n


def make(rng, kind):
    if kind == "prose":
        return "\n\n".join(" ".join(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 8)))
    if kind == "solid":
        return "".join(rng.choice("xyz字é😀") for _ in range(rng.randint(50, 900)))
    return "".join(rng.choice("éa \n字。") for _ in range(rng.randint(50, 900)))


@pytest.mark.parametrize("unit", S.UNITS)
def test_pieces_keep_limit_overlap_and_text(unit):
    rng = random.Random(unit)
    for case in range(60):
        text, limit = make(rng, rng.choice(["prose", "solid", "mixed"])), rng.randint(12, 80)
        overlap = rng.choice([0, 1, limit // 5])
        cuts = S.split_text(text, unit, limit, overlap, ["paragraph", "sentence"])
        total = size(text, unit)
        if total <= limit:
            assert cuts[0][:2] == (0, len(text)) and len(cuts) == 1
            continue
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) >= 2
        for (a, b, _), (c, d, _) in zip(cuts, cuts[1:]):
            assert a < b and b < d and a < c <= b
            back = size(text[c:b], unit)
            assert back <= overlap
            if unit == "code_points":
                assert back == overlap
            if unit == "whitespace_tokens":
                assert back == min(overlap, back if a + 1 == c else overlap)
        assert all(size(text[a:b], unit) <= limit for a, b, _ in cuts)


def test_natural_boundaries_win_and_pieces_balance():
    text = " ".join(f"Sentence number {i} stands here." for i in range(40))
    cuts = S.split_text(text, "code_points", 400, 0, ["sentence"])
    assert all(text[b - 2:b] == ". " for _, b, _ in cuts[:-1])
    lengths = [b - a for a, b, _ in cuts]
    assert max(lengths) - min(lengths) < 120


def test_piece_is_added_rather_than_a_word_cut():
    text = "aaaaaaaaa bbbbbbbbb ccccccccc"
    cuts = S.split_text(text, "code_points", 15, 0, None)
    assert [text[a:b] for a, b, _ in cuts] == ["aaaaaaaaa ", "bbbbbbbbb ", "ccccccccc"]


def test_query_shape_and_odd_rows(spark):
    req = spark.createDataFrame([("cp", "code_points", 20, 5, 3, None), ("by", "utf8_bytes", 10, None, 0, []), ("no", "code_points", None, None, 5, None), ("ed", "edu_count", 3, 0, 0, None), ("neg", "code_points", 1, 5, 9, None)], REQ)
    rows = [("a", "x" * 16, "cp"), ("a", "x" * 16, "cp"), ("b", "x" * 15, "cp"), ("c", "字字字字", "by"), ("d", None, "cp"), ("e", "", "cp"), ("f", "y" * 99, "no"), ("g", "y" * 99, "zz"), ("h", "y" * 99, None), ("i", "y" * 99, "ed"), ("j", "abc", "neg")]
    items = spark.createDataFrame([(*r, "z", 4) for r in rows], "row_id string, text string, requirement_id string, unit string, limit int").drop("unit", "limit")
    got = S.split_oversized(items, req).collect()
    assert {r.row_id for r in got} == {"a", "c", "j"}
    assert sorted(r.piece for r in got if r.row_id == "a") == ["x" * 8 + "x", "x" * 10] or all(r.size <= 15 for r in got if r.row_id == "a")
    assert len([r for r in got if r.row_id == "a"]) == 2
    assert "".join(r.piece for r in sorted(got, key=lambda r: r.piece_no) if r.row_id == "j") == "abc"
    assert S.split_oversized(items.limit(0), req).count() == 0 and S.split_oversized(items, req.limit(0)).count() == 0


def test_very_long_text():
    text = "word " * 200_000
    cuts = S.split_text(text, "code_points", 4000, 100, None)
    assert all(b - a <= 4000 for a, b, _ in cuts)
