import hashlib

import numpy as np
import pytest

from concord.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int, inertia double"


def frame(spark, vectors):
    rows = [(i, [None if c is None else float(c) for c in v] if v is not None else None, "c", 1, 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors, centroids, rounds, width, scale, seed):
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]) for i, v in vectors if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, _, v in order[:centroids]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(now)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if own:
                now[k] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    per = {k: sum(d for d, c in found if c == k) for k in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def rows_of(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", [16, 100_000])
def test_against_brute_force(spark, scale):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(9, 6))[rnd.integers(0, 9, 400)] + 0.5 * rnd.normal(size=(400, 6))
    vectors = list(enumerate(x.astype(np.float32).tolist()))
    got = rows_of(kmeans.clustered(frame(spark, vectors), centroids=12, rounds=6, width=6, scale=scale))
    assert got == brute(vectors, 12, 6, 6, scale, 2)


def test_odd_rows_and_ties(spark):
    v = [(i, [i % 3, (i * 7) % 5]) for i in range(60)] + [(i, [1, 1]) for i in range(100, 160)]
    v += [(200, None), (201, [1]), (202, [1, 2, 3]), (203, [None, 1]), (204, [float("nan"), 1]), (205, [float("inf"), 1]), (206, []), (None, [2, 2]), (7, [7, 7]), (7, [7, 7])]
    got = rows_of(kmeans.clustered(frame(spark, v), centroids=15, rounds=4, width=2, scale=1))
    assert got == brute(v, 15, 4, 2, 1, 2)


def test_few_and_no_vectors(spark):
    v = [(1, [0, 0]), (2, [5, 5])]
    assert rows_of(kmeans.clustered(frame(spark, v), centroids=40, rounds=2, width=2, scale=1)) == brute(v, 40, 2, 2, 1, 2)
    assert rows_of(kmeans.clustered(frame(spark, []), width=2)) == []
    assert rows_of(kmeans.clustered(frame(spark, [(1, None), (None, [1])]), width=2)) == []


def test_too_large_components(spark):
    with pytest.raises(Exception, match="beyond"):
        kmeans.clustered(frame(spark, [(1, [1e30, 0])]), width=2).collect()


def test_bounds_spare_distances():
    """Loosened by total displacements, bounds prove most assignments; every result is that of a full comparison."""
    rnd = np.random.default_rng(1)
    x = (rnd.normal(size=(20, 8))[rnd.integers(0, 20, 3000)] * 300 + 60 * rnd.normal(size=(3000, 8))).astype(np.int64)
    past = [x[:20].copy()]
    cluster, near, far = kmeans.first(x, kmeans.History(past))
    near_round, far_round = np.zeros(len(x), np.int32), np.zeros(far.shape, np.int16)
    computed = []
    for _ in range(8):
        past.append(np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else past[-1][c] for c in range(20)]))
        history = kmeans.History(past)
        computed.append(kmeans.again(x, history, cluster, near, near_round, far, far_round))
        assert (cluster == history.all_squared(x).argmin(1)).all()
    assert sum(computed) < 0.4 * 8 * len(x) * 20


def test_total_displacement_is_tighter_than_drifts():
    """A centroid that goes and comes back loosens no bound."""
    home, away = np.zeros((1, 3), np.int64), np.full((1, 3), 50, np.int64)
    assert kmeans.History([home, away, home]).moved[0, 0] == 0
    assert kmeans.History([home, away, home]).moved[1, 0] > 80
