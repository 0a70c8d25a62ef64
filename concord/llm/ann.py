"""Nearest neighbours by largest inner product, through a few stable projections.

Vectors are lifted by one component so that the largest inner product is the smallest distance, and
projected onto `DIMENSIONS` Gaussian directions, under which (projected / true distance)^2 follows a
chi-square law. A kd-tree over the projections divides the vectors into cells, one task each; its upper
levels are fitted on a bounded sample, and every vector is put in a cell and in the kd-tree within.
A query takes the leaves by projected distance, verifies their vectors in full, and stops once a vector
nearer than the current k-th would, with probability `confidence`, have been met. Home cells come first;
the k-th distance found there decides by the same test which other cells a query visits.

Vectors that are NULL, zero, of another length than most, or that hold NULL or non-finite components
take no part. Equal vectors are indexed once with their k + 1 smallest ids, which are all that any
query can need. Rows with a NULL id take no part; repeated ids count once per different vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.storage import saved

DIMENSIONS = 8
LEAF = 24
CELL_VECTORS = 16_384
SAMPLE = 20_000
BLOCK = 2_048
#: Vectors that a query verifies at a time, at first and at most.
FIRST_STEP, LAST_STEP = 256, 4096
CONFIDENCE = 0.985


def chi_square(x: np.ndarray, freedom: int = DIMENSIONS) -> np.ndarray:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    half = x / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, freedom // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def threshold(confidence: float, freedom: int = DIMENSIONS) -> float:
    """The x at which `chi_square` reaches `confidence`."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), freedom) < confidence else (low, middle)
    return high


# ---- index

@dataclass
class Space:
    """The lift and the projection: `top` is the largest squared norm."""

    directions: np.ndarray
    top: float

    def project(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.directions[:-1] + lift[:, None] * self.directions[-1]

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]

    def distance(self, inner: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared distance of a query to a lifted vector, from their inner product."""
        return np.maximum(self.top + norm - 2 * inner, 0)


def kd_tree(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree, as index arrays: split at the median of the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            leaves.append(own)
            continue
        at = points[own]
        widest = int(np.argmax(at.max(0) - at.min(0)))
        order = np.argpartition(at[:, widest], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return leaves


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Upper levels of the kd-tree in heap order: (dimension, value) of each inner node."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    nodes: list[tuple[int, float]] = []
    parts = [np.arange(len(sample))]
    for _ in range(depth):
        below = []
        for own in parts:
            at = sample[own]
            widest = int(np.argmax(at.max(0) - at.min(0))) if len(own) else 0
            value = float(np.median(at[:, widest])) if len(own) else 0.0
            nodes.append((widest, value))
            left = at[:, widest] <= value
            below += [own[left], own[~left]]
        parts = below
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if nodes:
        dimension, value = np.array([d for d, _ in nodes]), np.array([v for _, v in nodes])
        for _ in range(int(math.log2(len(nodes) + 1))):
            at = 2 * at + 1 + (points[np.arange(len(points)), dimension[at]] > value[at])
    return at - len(nodes)


def search(space: Space, vectors: np.ndarray, copies: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """For every query the indexes of `vectors` and their inner products, best first, enough of them to
    hold k ids (`copies` per vector); -1 where there are fewer. `bound`: a squared distance below which k
    are known already."""
    points = space.project(vectors)
    leaves = kd_tree(points, LEAF)
    low = np.array([points[own].min(0) for own in leaves])
    high = np.array([points[own].max(0) for own in leaves])
    size = max(map(len, leaves))
    table = np.full((len(leaves), size), -1, np.int64)
    for i, own in enumerate(leaves):
        table[i, : len(own)] = own
    wide = np.vstack([vectors, np.zeros((1, vectors.shape[1]))])
    number = np.append(copies, 0)
    best, score = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    projected = space.project_queries(queries)
    norms = np.einsum("ij,ij->i", queries, queries)
    for i in range(len(queries)):
        gap = np.maximum(np.maximum(low - projected[i], projected[i] - high), 0)
        reach = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(reach, kind="stable")
        own, value, nearest = np.zeros(0, np.int64), np.zeros(0), bound[i]
        at, step = 0, max(1, FIRST_STEP // size)
        while at < len(order) and not reach[order[at]] > stop * nearest:
            # No leaf beyond the bound, and more leaves at a time the longer it takes.
            upto = min(at + step, int(np.searchsorted(reach[order], stop * nearest, "right")) if nearest < np.inf else len(order))
            found = table[order[at:upto]].ravel()
            found = found[found >= 0]
            own = np.concatenate([own, found])
            value = np.concatenate([value, np.einsum("ij,j->i", wide[found], queries[i])])
            if len(own) > k:
                # All that tie with the k-th stay: which of them counts is decided by id.
                keep = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
                own, value = own[keep], value[keep]
            best_first = np.argsort(-value, kind="stable")
            own, value = own[best_first], value[best_first]
            enough = int(np.searchsorted(np.cumsum(number[own]), k))
            if enough < len(value):
                nearest = min(nearest, float(space.distance(value[enough], norms[i])))
            at, step = upto, min(2 * step, max(1, LAST_STEP // size))
        order = np.argsort(-value, kind="stable")
        if len(order) > best.shape[1]:
            more = len(order) - best.shape[1]
            best = np.pad(best, ((0, 0), (0, more)), constant_values=-1)
            score = np.pad(score, ((0, 0), (0, more)), constant_values=-np.inf)
        best[i, : len(order)], score[i, : len(order)] = own[order], value[order]
    return best, score


# ---- Spark

def usable(vector: Column) -> Column:
    """Not NULL, not zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _table(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(items: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of `items` for which `is_query` holds (an expression
    over `vec_id`), the k others with the largest inner product, ties by smaller id."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width = lengths[0]["n"]
    rows = rows.where(F.size("v") == width).dropDuplicates(["vec_id", "v"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.withColumn("r", rank).where(f"r <= {k + 1}").groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("v", F.col("vec_id").alias("query_id"))

    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    distinct = saved(ids.withColumn("key", F.xxhash64("v")), "ann-vectors")
    facts = distinct.agg(F.count("*").alias("n"), F.max(square).alias("top")).first()
    random = np.random.default_rng(11)
    space = Space(random.normal(size=(width + 1, DIMENSIONS)), float(facts["top"]))
    share = min(1.0, 1.2 * SAMPLE / facts["n"])
    sampled = distinct.select("v").where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).toPandas()["v"]
    nodes = splits(space.project(_table(sampled)), -(-facts["n"] // cell_vectors))
    stop = threshold(confidence)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_of(space.project(_table(v)), nodes).astype(np.int32))

    @F.pandas_udf("int")
    def query_cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_of(space.project_queries(_table(v)), nodes).astype(np.int32))

    vectors = saved(distinct.withColumn("cell", cell("v")), "ann-cells")
    queries = asked.select("v").distinct().withColumns({"key": F.xxhash64("v"), "bound": F.lit(float("inf")), "home": query_cell("v")})

    def visit(asked_in: DataFrame) -> DataFrame:
        """Search each cell for the queries sent to it. The queries of a cell come in blocks, and its vectors
        with each of them, so that a task holds one cell and one block."""
        per_cell = asked_in.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        q, x, c = asked_in.alias("q"), vectors.alias("x"), per_cell.alias("c")
        dealt = q.join(c, "cell").select("cell", "q.key", "q.v", "q.bound", F.expr("int(pmod(xxhash64(q.v, 2), c.blocks))").alias("block"))
        copied = x.join(c, "cell").select("cell", "x.v", "x.ids", F.explode(F.expr("sequence(0, c.blocks - 1)")).alias("block"))

        def run(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"key": [], "v": [], "ids": [], "score": []}).astype({"key": "int64", "score": "float64"})
            if not len(own) or not len(q):
                return none
            found, score = search(space, _table(own["v"]), own["ids"].str.len().to_numpy(), _table(q["v"]), q["bound"].to_numpy(), k + 1, stop)
            at, column = np.nonzero(found >= 0)
            return pd.DataFrame(
                {"key": q["key"].to_numpy()[at], "v": q["v"].to_numpy()[at], "ids": own["ids"].to_numpy()[found[at, column]], "score": score[at, column]}
            )

        return (
            copied.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(run, "key long, v array<double>, ids array<long>, score double")
        )

    def best(found: DataFrame) -> DataFrame:
        """Of what the cells found, the k + 1 best ids of each query vector."""
        single = found.select("v", "score", F.explode("ids").alias("vec_id"))
        place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "vec_id"))
        return single.withColumn("place", place).where(f"place <= {k + 1}")

    home = saved(best(visit(queries.withColumn("cell", F.col("home")))), "ann-home")
    reached = home.groupBy("v").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    if nodes:
        points = vectors.groupBy("cell").applyInPandas(lambda key, p: _box(key[0], space.project(_table(p["v"]))), "cell int, low array<double>, high array<double>")
        boxes = points.toPandas()  # two short rows of numbers per cell
        low, high, cells = _table(boxes["low"]), _table(boxes["high"]), boxes["cell"].to_numpy()
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        known = F.when(F.col("n") > k, F.greatest(F.lit(0.0), F.lit(space.top) + norm - 2 * F.col("last"))).otherwise(float("inf"))
        waiting = queries.drop("bound").join(reached, "v", "left").withColumn("bound", F.coalesce(known, F.lit(float("inf"))))

        def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                for at in range(0, len(f), 256):
                    part = f.iloc[at : at + 256]
                    p = space.project_queries(_table(part["v"]))
                    gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0)
                    near = (gap**2).sum(2) <= stop * part["bound"].to_numpy()[:, None]
                    near &= part["home"].to_numpy()[:, None] != cells[None]
                    i, c = np.nonzero(near)
                    yield pd.DataFrame({"key": part["key"].to_numpy()[i], "v": part["v"].to_numpy()[i], "bound": part["bound"].to_numpy()[i], "cell": cells[c]})

        sent = waiting.select("key", "v", "bound", "home").mapInPandas(others, "key long, v array<double>, bound double, cell int")
        away = visit(saved(sent, "ann-sent"))
        found = best(home.select("v", "score", F.array("vec_id").alias("ids")).unionByName(away.select("v", "score", "ids")))
    else:
        found = home
    pairs = asked.join(found.select("v", "vec_id", "score"), "v").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _box(cell: int, points: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"cell": [cell], "low": [points.min(0)], "high": [points.max(0)]})
