import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import ann


def brute(vectors, is_query, k):
    ids = list(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in ids:
        if is_query(q):
            score = x @ np.array(vectors[q], float)
            out[q] = sorted(((-s, i) for s, i in zip(score, ids) if i != q))[:k]
    return out


def frame(spark, vectors):
    rows = [(i, [float(c) for c in v] if v is not None else None, "x", 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score double").repartition(3)


@pytest.mark.parametrize("cell_vectors", [10_000, 150])
def test_recall(spark, cell_vectors):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 32))
    x = (centres[rnd.integers(0, 12, 1500)] + 0.6 * rnd.normal(size=(1500, 32))).astype(np.float32)
    vectors = dict(enumerate(x.tolist()))
    want = brute(vectors, lambda i: i % 20 == 0, 20)
    got = ann.nearest(frame(spark, vectors.items()), F.col("vec_id") % 20 == 0, 20, cell_vectors=cell_vectors).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, best in want.items():
        assert sorted(found[q]) == list(range(1, 21))
        order = [found[q][k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda p: (-p[1], p[0]))
        hits += len({i for _, i in best} & {i for i, _ in order})
        for i, s in order:
            assert s == pytest.approx(float(np.dot(np.float64(x[q]), np.float64(x[i]))), abs=1e-12)
    assert hits / (20 * len(want)) >= 0.95


def test_odd_vectors_and_ties(spark):
    v = [(0, [1, 0, 0]), (20, [1, 0, 0]), (40, [0, 1, 0]), (1, [1, 0, 0]), (2, [0, 0, 0]), (3, None), (4, [1, float("nan"), 0])]
    v += [(5, [float("inf"), 0, 0]), (6, [1, 2]), (7, [0, 2, 0]), (8, [1, 0, 0]), (9, [1, 0, 0]), (9, [1, 0, 0]), (None, [1, 0, 0]), (100, [-1, 0, 0])]
    rows = ann.nearest(frame(spark, v), F.col("vec_id") % 20 == 0, 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(1, 1.0), (8, 1.0), (9, 1.0)]
    assert got[20] == [(0, 1.0), (1, 1.0), (8, 1.0)]
    assert got[40] == [(7, 2.0), (0, 0.0), (1, 0.0)]
    assert got[100] == [(7, 0.0), (40, 0.0), (0, -1.0)]


def test_few_and_none(spark):
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0, 5).count() == 0
    two = ann.nearest(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])]), F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in two] == [(0, 1, 1, 5.0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0, 5).count() == 0
    assert ann.nearest(frame(spark, [(0, None), (20, [0.0, 0.0])]), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_chi_square_threshold():
    x = ann.threshold(0.9)
    assert ann.chi_square(np.array(x)) == pytest.approx(0.9, abs=1e-9)
    sample = (np.random.default_rng(0).normal(size=(20_000, ann.DIMENSIONS)) ** 2).sum(1)
    assert (sample < x).mean() == pytest.approx(0.9, abs=0.02)
