import math

import numpy as np
import pytest

from tarnlake.llm import similar_vectors
from tarnlake.llm.graph_index import DEGREE, SearchGraph

SCHEMA = "block_id bigint, row_ids_low bigint, row_ids_high bigint, dimensions int, vectors array<float>, valid boolean, id string"


def brute(rows, k):
    seen = {}
    for _, low, high, d, v, valid, _ in rows:
        if valid is False or v is None or len(v) != d or any(x is None or not math.isfinite(x) for x in v) or not any(v) or low is None:
            continue
        seen.setdefault(((high & 0xFFFFFFFF) << 32) + (low & 0xFFFFFFFF), (d, np.array(v, np.float32).astype(float)))
    pairs = set()
    for a, (d, v) in seen.items():
        ranked = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), b) for b, (e, w) in seen.items() if e == d and b != a)
        pairs |= {(min(a, b), max(a, b)) for _, b in ranked[:k]}
    return pairs


def test_graph_finds_nearest():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    v = centres[rng.integers(12, size=1500)] + 0.4 * rng.normal(size=(1500, 24))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    found, _ = SearchGraph(v).search(v, 24)
    true = np.argsort(-(v @ v.T), axis=1)[:, :6]
    assert np.mean([len(set(t) & set(f)) / 6 for t, f in zip(true, found)]) > 0.95


def test_graph_of_none_and_one():
    assert SearchGraph(np.zeros((0, 4), np.float32)).edges.shape == (0, DEGREE)
    found, _ = SearchGraph(np.ones((1, 4), np.float32)).search(np.ones((2, 4), np.float32))
    assert found[:, 0].tolist() == [0, 0]


@pytest.mark.parametrize("graph_size,most", [(16_000, 1024), (60, 1024), (16_000, 3)])
def test_pairs_equal_brute_force(spark, graph_size, most):
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(8, 16))
    for i in range(400):
        v = (centres[i % 8] + 0.5 * rng.normal(size=16)).astype(np.float32)
        rows.append((0, int(rng.integers(-(2**31), 2**31)) if i % 2 else i, i % 3, 16, v.tolist(), None if i % 5 else True, "x"))
    rows += [rows[7], rows[8]]  # delivered twice
    rows += [(1, 10_000 + i, 9, 16, rows[3][4], True, None) for i in range(40)]  # equal vectors under many ids
    rows += [(1, 20_000, 9, 16, (np.array(rows[5][4]) * 4).tolist(), True, None)]
    rows += [(2, 1, 8, 16, None, True, None), (2, 2, 8, 16, [0.0] * 16, True, None), (2, 3, 8, 16, [float("nan")] * 16, True, None), (2, 4, 8, 16, [1.0] * 15, True, None)]
    rows += [(2, 5, 8, 16, [1.0] * 16, False, None), (2, 6, 8, 16, [1.0] * 15 + [None], True, None), (3, 1, 7, 2, [1.0, 0.5], True, None), (3, None, 7, 2, [1.0, 0.5], True, None)]
    rows += [(4, i, 6, 3, [1.0, float(i), 2.0], True, None) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]) for r in similar_vectors.nearest_pairs(df, graph_size=graph_size, cluster_size=100, most_clusters=most).collect()}
    want = brute(rows, 5)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)
    # the forty equal vectors and the one they equal: each has the five smallest other ids
    same = sorted([((9 << 32) + 10_000 + i) for i in range(40)])
    assert all(any(p in got for p in ((min(a, b), max(a, b)) for b in same[:7] if b != a)) for a in same)


@pytest.mark.parametrize("graph_size", [16_000, 90])
def test_copies_of_other_length(spark, graph_size):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 16))
    vectors = [base[0] * rng.uniform(0.1, 9) for _ in range(100)] + [base[1] * 2.0 ** rng.integers(-5, 5) for _ in range(40)]
    vectors += [base[i % 4] + 0.3 * rng.normal(size=16) for i in range(160)]
    rows = [(0, int(i), 0, 16, np.float32(v).tolist(), True, "x") for i, v in zip(rng.permutation(5000), vectors)]
    got = {(r[0], r[1]) for r in similar_vectors.nearest_pairs(spark.createDataFrame(rows, SCHEMA), graph_size=graph_size, routes=4).collect()}
    want = brute(rows, 5)
    assert len(got & want) / len(want) >= 0.99 and len(got - want) <= 0.01 * len(want)
    copies = {r[1] for r in rows[:100]}, {r[1] for r in rows[100:140]}
    for of in copies:  # of each group the pairs are those with its five smallest ids, none missing and none more
        inside = lambda pairs: {p for p in pairs if p[0] in of and p[1] in of}  # noqa: E731, B023
        assert inside(got) == inside(want)


def test_more_ties_than_candidates(spark):
    ids = np.random.default_rng(9).permutation(900)
    rows = [(0, int(ids[0]), 0, 100, [1.0] + [0.0] * 99, True, "x")]
    rows += [(0, int(ids[i]), 0, 100, [1.0] + [float(j == i) for j in range(1, 100)], True, "x") for i in range(1, 100)]
    got = {(r[0], r[1]) for r in similar_vectors.nearest_pairs(spark.createDataFrame(rows, SCHEMA), routes=4).collect()}
    assert got == brute(rows, 5)


def test_alone_and_empty(spark):
    df = spark.createDataFrame([(0, 1, 0, 2, [1.0, 2.0], True, "x")], SCHEMA)
    assert similar_vectors.nearest(df).collect()[0]["near"] == []
    assert similar_vectors.nearest_pairs(df).count() == 0
    assert similar_vectors.nearest_pairs(df.limit(0)).count() == 0
