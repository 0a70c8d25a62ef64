"""Centroid clustering of whole-number vectors with ns-bounds.

A vector keeps, for every centroid, the distance found when the two were last compared and the round of that
comparison. All earlier centroids are kept as well. In a later round the stored distance is loosened by the norm of the
centroid's *total* displacement since that round, which is at most the sum of its drifts round by round, and often much less as
centroids go to and fro. Where the loosened bounds prove that the own centroid is still the nearest, nothing is computed;
of the other vectors the distance to the own centroid is taken anew, and those to the centroids whose bounds still fail. These
distances are exact whole numbers, so ties are decided exactly.

Only vectors that changed sides are added to and taken from the sums of the clusters. A round reads the vectors with their bounds
where they lie, without a shuffle, and writes them with the new ones; the driver sees one row of sums per centroid.

Vectors of another length, and those that are NULL or hold NULL or non-finite components, take no part. Repeated rows count each.
Rows with a NULL id are assigned, and start a centroid only after all others. With fewer vectors than centroids asked for, each starts
one; without any, the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.storage import forget, saved
from concord.llm.vectors import finite, matrix, scaled, working

#: Relative allowance for the rounding of distances and bounds.
SLACK = 1e-6
#: Vectors that are compared with all centroids at a time, and pairs of a vector and a centroid.
BLOCK_ROWS, BLOCK_PAIRS = 4096, 32_768

STATE = "id long, x array<int>, before int, cluster int, near double, near_round int, far binary, far_round binary, distance long"
FIELDS = pa.schema(
    [
        ("id", pa.int64()), ("x", pa.list_(pa.int32())), ("before", pa.int32()), ("cluster", pa.int32()), ("near", pa.float64()),
        ("near_round", pa.int32()), ("far", pa.binary()), ("far_round", pa.binary()), ("distance", pa.int64()),
    ]
)


class History:
    """The centroids of all rounds so far, and how far each has come since each of them."""

    def __init__(self, rounds: list[np.ndarray]):
        self.now = rounds[-1]
        self.round = len(rounds) - 1
        past = np.stack(rounds).astype(np.float64)
        self.moved = np.sqrt(((past[-1] - past) ** 2).sum(2)) * (1 + SLACK)

    def __len__(self) -> int:
        return len(self.now)

    def all_squared(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of all vectors to all centroids."""
        own = working(x, int(np.abs(self.now).max(initial=0)))
        c = self.now.astype(own.dtype)
        out = (own * own).sum(1)[:, None] + (c * c).sum(1) - 2 * (own @ c.T)
        return out.astype(np.int64)

    def squared(self, x: np.ndarray, which: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Squared distances of the vectors x[which] to one centroid each."""
        out = np.empty(len(which), np.int64)
        for at in range(0, len(which), BLOCK_PAIRS):
            part = slice(at, at + BLOCK_PAIRS)
            gap = x[which[part]].astype(np.int64) - self.now[centroid[part]]
            out[part] = np.einsum("ij,ij->i", gap, gap)
        return out


def first(x: np.ndarray, history: History) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of each vector, distance to its centroid, and distances to all, rounded down."""
    squared = history.all_squared(x)
    cluster = squared.argmin(1)  # of equal ones the first
    distance = np.sqrt(squared.astype(np.float64))
    return cluster, distance[np.arange(len(x)), cluster], down(distance)


def down(distance: np.ndarray) -> np.ndarray:
    return np.maximum(distance * (1 - SLACK), 0).astype(np.float32)


def again(x: np.ndarray, history: History, cluster: np.ndarray, near: np.ndarray, near_round: np.ndarray, far: np.ndarray, far_round: np.ndarray) -> int:
    """Reassign the vectors in place. Returns the number of distances that were computed."""
    n, k = far.shape
    if not n:
        return 0
    upper = near * (1 + SLACK) + history.moved[near_round, cluster]
    lower = far - history.moved[far_round, np.arange(k)]
    lower[np.arange(n), cluster] = np.inf
    rows = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(rows):
        return 0
    own = cluster[rows]
    squared = history.squared(x, rows, own)
    near[rows], near_round[rows] = np.sqrt(squared), history.round
    i, j = np.nonzero(lower[rows] <= (near[rows] * (1 + SLACK))[:, None])
    found = history.squared(x, rows[i], j)
    far[rows[i], j], far_round[rows[i], j] = down(np.sqrt(found.astype(np.float64))), history.round
    far[rows, own], far_round[rows, own] = down(near[rows]), history.round
    # The least (squared distance, number) of the own centroid and those compared.
    place, number, value = np.concatenate([np.arange(len(rows)), i]), np.concatenate([own, j]), np.concatenate([squared, found])
    order = np.lexsort((number, value, place))
    best = order[np.searchsorted(place[order], np.arange(len(rows)))]
    cluster[rows], near[rows] = number[best], np.sqrt(value[best].astype(np.float64))
    return len(rows) + len(i)


def assigned(state: DataFrame, rounds: list[np.ndarray], last: bool) -> DataFrame:
    """One round over all vectors: rows of `STATE`. `state` has `id` and `x` alone in the first round."""
    k, width = rounds[-1].shape
    history = History(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                n = batch.num_rows
                x = matrix(batch.column("x"), width)
                if "cluster" in batch.schema.names:
                    before = batch.column("cluster").to_numpy()
                    cluster, near, near_round = before.astype(np.int64), batch.column("near").to_numpy().copy(), batch.column("near_round").to_numpy().copy()
                    far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.float32).reshape(n, k).copy()
                    far_round = np.frombuffer(b"".join(batch.column("far_round").to_pylist()), np.int16).reshape(n, k).copy()
                    again(x, history, cluster, near, near_round, far, far_round)
                else:
                    before = np.full(n, -1, np.int32)
                    cluster, near, far = first(x, history)
                    near_round, far_round = np.zeros(n, np.int32), np.zeros((n, k), np.int16)
                distance = pa.array(history.squared(x, np.arange(n), cluster)) if last else pa.nulls(n, pa.int64())
                columns = [
                    batch.column("id"), batch.column("x"), pa.array(before, pa.int32()), pa.array(cluster, pa.int32()), pa.array(near), pa.array(near_round, pa.int32()),
                    pa.array([row.tobytes() for row in far], pa.binary()), pa.array([row.tobytes() for row in far_round], pa.binary()), distance,
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster the number and the componentwise sum of the vectors that came, less those that left."""
    moved = state.where("cluster <> before").select(
        "x", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")))).alias("m")
    )
    sums = [F.sum(F.col("x")[i].cast("long") * F.col("m.sign")).alias(f"s{i}") for i in range(width)]
    rows = moved.where("m.c >= 0").groupBy("m.c").agg(F.sum("m.sign").alias("n"), *sums).collect()  # one row per centroid
    return {row["c"]: (row["n"], list(row[2:])) for row in rows}


def start(rows: DataFrame, centroids: int, seed: int) -> list[list[int]]:
    """The vectors whose sha256 of `seed:id` is smallest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["x"] for r in rows.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(centroids).collect()]


def clustered(
    items: DataFrame, centroids: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per vector that takes part; see the
    module's notes. Distances are squared and count in units of 1 / scale."""
    if width > 256 or rounds >= 1 << 15:
        raise ValueError("at most 256 components and 32767 rounds")
    spark = items.sparkSession
    vector: Column = F.col(vector_col)
    rows = items.where((F.size(vector) == width) & finite(vector)).select(F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("x"))
    state = saved(rows, "kmeans-vectors")
    seeds = start(state, centroids, seed)
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    past = [np.array(seeds, np.int64)]
    totals = {c: (0, [0] * width) for c in range(len(seeds))}
    for number in range(rounds + 1):
        last = number == rounds
        now = saved(assigned(state, past, last), "kmeans-round")
        forget(state)
        state = now
        if not last:
            for c, (n, sums) in changes(state, width).items():
                totals[c] = (totals[c][0] + n, [a + b for a, b in zip(totals[c][1], sums)])
            # Whole numbers of any size, and division that rounds down.
            past.append(np.array([[s // n for s in sums] if n else past[-1][c].tolist() for c, (n, sums) in sorted(totals.items())], np.int64))
    inertia = {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in past[-1].tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digests[c]) for c in range(len(digests))]
    per_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(per_cluster), "cluster")  # one row per centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
