import math

import numpy as np
import pytest

from riskloom.llm import metric_tree
from riskloom.llm.metric_tree import Best, build_tree, lifted, search_tree, top_k

SCHEMA = "node_id bigint, embedding array<double>, _id bigint, cell int, score bigint"


def brute(rows, queries, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        own = next((v for i, v in whole if i == q), None)
        if own is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("tree_rows", [8192, 40])
def test_against_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(metric_tree, "TREE_ROWS", tree_rows)
    random = np.random.default_rng(5)
    rows = [(i, random.normal(i % 4, 1, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)]  # equal rows
    rows += [(2000, None), (2001, [None, 1.0]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [0.5]), (2005, [])]
    table = made(spark, rows)
    wanted = [i for i in range(0, 2100, 50)]
    found = top_k(table, table.where("node_id % 50 = 0"), k=7)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, wanted, 7)


def test_search_skips_computations():
    random = np.random.default_rng(6)
    vectors = np.floor(random.normal(0, 20, (3000, 4)) + 1000 * random.integers(0, 4, (3000, 4))).astype(np.int64)
    largest = int((vectors**2).sum(axis=1).max())
    nodes = build_tree(np.arange(3000), vectors, lifted(vectors, largest))
    assert sorted(i for n in nodes if not n.inner for i in n.ids.tolist()) == list(range(3000))
    assert max(len(n.ids) for n in nodes) <= metric_tree.PAGE
    touched = []

    class Counted(list):
        def __getitem__(self, number):
            touched.append(number)
            return super().__getitem__(number)

    for query in range(0, 3000, 300):
        best = Best(5, None)
        search_tree(Counted(nodes), vectors[query], query, best, largest, float)
        products = vectors @ vectors[query]
        products[query] = -(2**62)
        order = np.lexsort((np.arange(3000), -products))[:5]
        assert best.ids.tolist() == order.tolist()
    assert len(touched) < 10 * len(nodes)


def test_few_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0, -1.0]), (7, [0.25, 0.5])]
    table = made(spark, rows)
    assert sorted(map(tuple, top_k(table, table.where("node_id % 50 = 0")).collect())) == brute(rows, [0, 50], 10)
    assert top_k(table.where("node_id < 0"), table).count() == 0
    assert top_k(table, table.where("node_id < 0")).count() == 0
    big = made(spark, [(0, [2.0**18, 1.0]), (1, [2.0**18, 3.0]), (2, [-(2.0**18), 3.0])])
    assert sorted(map(tuple, top_k(big, big).collect())) == brute([(0, [2.0**18, 1.0]), (1, [2.0**18, 3.0]), (2, [-(2.0**18), 3.0])], [0, 1, 2], 10)
    with pytest.raises(ValueError):
        top_k(made(spark, [(0, [2.0**30])]), big)
