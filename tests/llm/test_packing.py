import os
from collections import defaultdict

import pytest

from logosmill.llm import packing as P


def counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")


def bins(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.bin_id].append(r)
    return out


def test_constraints_and_whole_documents(spark):
    sizes = [(i, (i * 37) % 90 + 1) for i in range(400)] + [(1000, 250), (1001, 0), (1002, 100)]
    got = P.pack(counts(spark, [*sizes, sizes[0], (None, 5)]), [("a", 100), ("b", 60)], items_per_group=150).collect()
    for name, cap in (("a", 100), ("b", 60)):
        own = [r for r in got if r.container == name]
        by_doc = defaultdict(list)
        for r in own:
            by_doc[r.doc_id].append((r.token_start, r.token_stop))
        assert set(by_doc) == {d for d, n in sizes if n}
        for d, n in sizes:
            spans = sorted(by_doc[d])
            assert [s for s, _ in spans] == ([] if not n else [0, *[e for _, e in spans[:-1]]]) and (not n or spans[-1][1] == n)
            assert len(spans) == -(-n // cap)
        filled = bins(own)
        assert all(sum(r.n_tokens for r in b) <= cap for b in filled.values())
        assert sum(n for _, n in sizes) / (len(filled) * cap) > 0.9


def test_document_limit_and_best_fit():
    fit = P.BestFit(10, 2, 100, (1.0, 0.01, 0.01))
    assert [fit.place(7, 1), fit.place(5, 1), fit.place(3, 1), fit.place(5, 1), fit.place(1, 1), fit.place(1, 1), fit.place(1, 1)] == [0, 1, 0, 1, 2, 2, 3]


def test_cost_limit():
    fit = P.BestFit(10, 9, 4, (1.0, 0.01, 0.01))
    assert [fit.place(2, 3), fit.place(2, 2), fit.place(2, 1)] == [0, 1, 0]


def test_all_three_capacities_bind(spark):
    df = counts(spark, [(i, 4) for i in range(300)] + [(1000 + i, 192) for i in range(10)])
    filled = bins(P.pack(df, [("a", 256)]).collect())
    assert max(len(b) for b in filled.values()) == 16 and all(sum(r.n_tokens for r in b) <= 256 for b in filled.values())
    filled = bins(P.pack(df, [("a", 256)], max_documents=99, max_cost=16).collect())
    cost = lambda b: sum((-(-r.n_tokens // 64)) ** 2 for r in b)
    assert max(map(cost, filled.values())) == 16 and any(sum(r.n_tokens for r in b) < 256 and cost(b) == 16 for b in filled.values())
    alone = bins(P.pack(df, [("a", 256)], max_cost=5).collect())
    assert all(len(b) == 1 for b in alone.values() if b[0].n_tokens == 192)


def test_same_for_any_partitioning(spark):
    df = counts(spark, [(i, i % 50 + 1) for i in range(300)])
    a = {(r.doc_id, r.bin_id) for r in P.pack(df.repartition(1), [("a", 64)], items_per_group=100).collect()}
    b = {(r.doc_id, r.bin_id) for r in P.pack(df.repartition(7), [("a", 64)], items_per_group=100).collect()}
    assert a == b


def test_empty(spark):
    assert P.pack(counts(spark, []), [("a", 10)]).count() == 0


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer file")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 1), (2, None, 1), (3, "", 1), (4, "<|endoftext|>", 1)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1
