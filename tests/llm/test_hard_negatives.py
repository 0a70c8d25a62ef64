import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, score double, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, [None if c is None else float(c) for c in v] if v is not None else None, "r", 0.1, 3) for i, y, v in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, positives, negatives, scale):
    kept = {
        (i, y, tuple(int(np.floor(np.float64(np.float32(c)) * scale)) for c in v))
        for i, y, v in rows
        if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    }
    out = []
    for i, y, v in kept:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in kept if len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == y and s[1] != i)[:positives]:
            near = sorted(s for s in scored if s[2] != y and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    found = hard_negatives.mined(frame(spark, rows), F.col("vec_id") % 5 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(4, 12))
    labels = np.where(rnd.random(700) < 0.4, 0, rnd.integers(0, 4, 700))
    x = (centres[labels] + 1.2 * rnd.normal(size=(700, 12))).astype(np.float32)
    x[100:130] = x[100]  # a common vector, with ties
    return [(i, int(labels[i]), x[i].tolist()) for i in range(700)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, rows, small, monkeypatch):
    if small:  # many blocks, many bunches of anchors, and results handed on early
        monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 600)
        monkeypatch.setattr(hard_negatives, "BUNCH_VALUES", 200)
        monkeypatch.setattr(hard_negatives, "BLOCKS_A_PART", 2)
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5, 10, 256)


def test_results_handed_on_early(rows):
    """Best rows that a task hands on before it has seen all blocks."""
    x = np.array([v for _, _, v in rows[:50]]).astype(np.int64)
    best = {(0, a, a): (np.array([[1, 2, 3]]), [(x[a, :2], x[a, 2:4])]) for a in range(3)}
    lines = [r for batch in hard_negatives.told(best, True) for r in batch.to_pylist()]
    assert len(lines) == 6 and {r["positive_score"] for r in lines} == {3}
    assert list(hard_negatives.told({}, True)) == []


def test_odd_rows(spark):
    rows = [(0, 1, [1, 0]), (0, 1, [1, 0]), (0, 1, [2, 1]), (1, 1, [1, 1]), (2, 1, [3, 0]), (3, 2, [1, 0]), (4, 2, [2, 5]), (5, 2, [1, 1]), (6, None, [9, 9]), (7, 1, None)]
    rows += [(8, 2, [None, 1]), (9, 1, [float("nan"), 1]), (10, 1, [float("inf"), 1]), (11, 1, [4]), (15, 2, [3]), (16, 2, [2]), (17, 1, [1]), (20, 3, []), (None, 1, [5, 5])]
    rows += [(25, 1, [-1, -1]), (30, 4, [0, 0]), (31, 4, [0, 0]), (35, 9, [1, 1]), (40, 7, []), (41, 7, []), (42, 8, [])]
    assert mined(spark, rows, scale=1) == brute(rows, lambda i: i % 5 == 0, 5, 10, 1)


def test_no_rows(spark, rows):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(5, None, None)]) == []


def test_scan_leaves_out_candidates():
    """Bounds drop candidates before all dimensions are read, and none that counts."""
    rnd = np.random.default_rng(3)
    x = (rnd.normal(size=(2000, 64)) * np.r_[np.full(16, 40), np.full(48, 2)]).astype(np.int64)
    block = hard_negatives.Block(np.arange(2000), np.arange(2000) % 2, x.T.astype(float), x.min(0).astype(float), x.max(0).astype(float))
    seen = []
    scan = block.scan

    def watched(q, candidates, keep):
        return scan(q, candidates, lambda s, a, b: seen.append(len(s)) or keep(s, a, b))

    block.scan = watched
    scores, ids = hard_negatives.best_alike(block, x[0].astype(float), 0, 0, 5, hard_negatives.NONE)
    want = sorted((-int(x[0] @ x[i]), i) for i in range(2, 2000, 2))[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want
    assert seen[0] == 999 and seen[-1] < 100
