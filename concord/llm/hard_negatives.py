"""Hard-negative mining by a BOND vertical scan of whole-number vectors.

Rows are stored in blocks, dimension by dimension, with the least and the largest value of each dimension. An anchor reads the
dimensions of a block in the order of its own components' magnitude, a few at a time. What the dimensions not yet read can add
lies between sums of their least and largest contributions; with the part already summed this bounds each candidate's score.
Candidates whose bounds cannot reach the places wanted leave the bitmap, until all dimensions are read and the scores of those left are exact.

Two scans: one for the best rows of the anchor's label (its positives), one for the best rows of other labels within the window that each
positive's score opens. Rows are sorted by label before they are blocked, so that the first scan passes over most blocks at once.
Each block meets each bunch of anchors once, in a join on the vectors' length and a number shared by a few blocks; a task keeps its best
so far per anchor, which also bounds what later blocks have to offer, and hands them on when they grow many.

Rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part; rows equal in id, label and vector count once.
Vectors of different lengths have no inner product and do not meet. An anchor is never its own positive, nor is another row of its id.
Equal scores go by smaller id. An anchor without positives, or a positive without a negative in its window, gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.storage import saved
from concord.llm.vectors import finite, matrix, scaled, working

#: Values of a block, and of a bunch of anchors: 2 MB and 0.5 MB.
BLOCK_VALUES, BUNCH_VALUES = 1 << 19, 1 << 17
#: Blocks that share a number in the join: for each of these numbers the anchors are copied once.
BLOCKS_A_PART = 16
#: Dimensions read at a time.
STEP = 8
#: Anchors whose best rows a task keeps at a time.
KEPT_ANCHORS = 16_384


# ---- the scan of one block

@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rest(self, q: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest that the dimensions from each place of the order on can add."""
        a, b = q[order] * self.low[order], q[order] * self.high[order]
        tail = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
        return tail(np.minimum(a, b)), tail(np.maximum(a, b))

    def scan(self, q: np.ndarray, candidates: np.ndarray, keep: Callable[[np.ndarray, float, float], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates left at the end, and their exact scores. `keep` says which may still count, from their sums so far and
        the least and the largest that is still to come."""
        order = np.argsort(-np.abs(q), kind="stable")
        least, most = self.rest(q, order)
        sums = np.zeros(len(candidates), self.columns.dtype)
        for at in range(0, len(q), STEP):
            if not len(candidates):
                break
            dims = order[at : at + STEP]
            own = self.columns[dims] if len(candidates) == len(self.ids) else self.columns[np.ix_(dims, candidates)]
            sums = sums + q[dims] @ own
            alive = keep(sums, least[min(at + STEP, len(q))], most[min(at + STEP, len(q))])
            if not alive.all():
                candidates, sums = candidates[alive], sums[alive]
        return candidates, sums


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; none if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_alike(block: Block, q: np.ndarray, key: int, label: int, k: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best k rows of the label, of this block and those known."""
    candidates = np.flatnonzero((block.labels == label) & (block.ids != key))
    floor = known[0][k - 1] if len(known[0]) >= k else -np.inf
    found, scores = block.scan(q, candidates, lambda sums, least, most: sums + most >= max(floor, kth(sums, k) + least))
    if not len(found):
        return known
    return top(np.concatenate([known[0], scores.astype(np.int64)]), np.concatenate([known[1], block.ids[found]]), k)


def best_within(
    block: Block, q: np.ndarray, label: int, low: np.ndarray, high: np.ndarray, k: int, known: list[tuple[np.ndarray, np.ndarray]]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window low..high, scores and ids of the best k rows of other labels within, of this block and those known."""
    candidates = np.flatnonzero(block.labels != label)
    floor = [max(lo, own[0][k - 1] if len(own[0]) >= k else lo) for lo, own in zip(low.tolist(), known)]

    def keep(sums: np.ndarray, least: float, most: float) -> np.ndarray:
        under, over = sums + least, sums + most
        alive = np.zeros(len(sums), bool)
        for lo, hi, at_least in zip(low, high, floor):
            sure = under[(under >= lo) & (over <= hi)]
            alive |= (over >= max(at_least, kth(sure, k))) & (under <= hi)
        return alive

    found, scores = block.scan(q, candidates, keep)
    if not len(found):
        return known
    scores, ids, out = scores.astype(np.int64), block.ids[found], []
    for lo, hi, own in zip(low, high, known):
        inside = (scores >= lo) & (scores <= hi)
        out.append(top(np.concatenate([own[0], scores[inside]]), np.concatenate([own[1], ids[inside]]), k) if inside.any() else own)
    return out


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


# ---- Spark

BLOCK = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("columns", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def values_of(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.greatest("width", F.lit(1)).cast("long")).alias("values")).first()["values"] or 0


def blocks(rows: DataFrame, asked: int) -> DataFrame:
    """The rows, sorted by length, label and id, in blocks of `BLOCK_VALUES`. `part` numbers some blocks alike: `BLOCKS_A_PART`, or fewer
    as long as the copies of all `asked` values of anchors, one per part, are no more than the rows themselves."""
    values = values_of(rows)
    number = max(1, -(-values // BLOCK_VALUES))
    parts = max(-(-number // BLOCKS_A_PART), min(number, values // max(1, asked)))
    dealt = rows.repartitionByRange(number, "width", "label", "vec_id").sortWithinPartitions("width", "label", "vec_id")

    def made(ids: list, labels: list, tables: list) -> pa.RecordBatch:
        x = np.concatenate(tables)
        own = [np.concatenate(ids).tobytes(), np.concatenate(labels).tobytes(), np.ascontiguousarray(x.T).tobytes(), x.min(0).tobytes(), x.max(0).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([x.shape[1], *own], BLOCK)], schema=BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[list, list, list] = ([], [], [])
        held, width = 0, -1
        for batch in batches:
            widths = batch.column("width").to_numpy()
            at = 0
            while at < batch.num_rows:
                size = max(1, BLOCK_VALUES // max(1, int(widths[at])))
                if held and (widths[at] != width or held >= size):
                    yield made(*waiting)
                    waiting, held = ([], [], []), 0
                width = int(widths[at])
                upto = min(int(np.searchsorted(widths, width, "right")), at + size - held)
                part = batch.slice(at, upto - at)
                for list_, own in zip(waiting, (part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"), width).astype(np.int32))):
                    list_.append(own)
                held += upto - at
                at = upto
        if held:
            yield made(*waiting)

    cut = dealt.mapInArrow(run, "width int, ids binary, labels binary, columns binary, low binary, high binary")
    return saved(cut.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")), "negatives-blocks")


def bunches(anchors: DataFrame) -> DataFrame:
    """The anchors, some at a time: rows (bunch, width, anchors)."""
    number = max(1, -(-values_of(anchors) // BUNCH_VALUES))
    dealt = anchors.withColumn("__bunch", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(number)))
    own = dealt.groupBy("width", "__bunch").agg(F.collect_list(F.struct("vec_id", "label", "x")).alias("anchors"))
    return saved(own.select(F.monotonically_increasing_id().alias("bunch"), "width", "anchors"), "negatives-anchors")


def met(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block with every bunch of anchors of its length."""
    parts = stored.select("width", "part").distinct()
    return stored.join(asked.join(parts, "width"), ["width", "part"])


FOUND = "bunch long, place int, anchor_id long, positive_rank int, positive_id long, positive_score long, id long, score long"


def searched(pairs: DataFrame, k: int, within: bool) -> DataFrame:
    """Per anchor the best of the task's blocks: rows of `FOUND`, `positive_…` NULL in the first scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = {c: row.column(c)[0].as_py() for c in ("ids", "labels", "columns", "low", "high", "width", "bunch")}
                width = values["width"]
                whole = row.column("anchors").flatten()
                keys, labels = whole.field("vec_id").to_numpy(), whole.field("label").to_numpy()
                q = matrix(whole.field("x"), width)
                ids = np.frombuffer(values["ids"], np.int64)
                columns, low, high = (np.frombuffer(values[c], np.int32) for c in ("columns", "low", "high"))
                kind = working(columns.reshape(width, len(ids)).T, int(np.abs(q).max(initial=0))).dtype
                block = Block(ids, np.frombuffer(values["labels"], np.int64), columns.reshape(width, len(ids)).astype(kind), low.astype(kind), high.astype(kind))
                q = q.astype(kind)
                if within:
                    windows = row.column("windows").flatten()
                    place, low_of, high_of = (windows.field(c).to_numpy() for c in ("place", "low", "high"))
                    facts = np.column_stack([windows.field(c).to_numpy() for c in ("positive_rank", "positive_id", "positive_score")])
                    order = np.argsort(place, kind="stable")
                    first, last = (np.searchsorted(place[order], np.arange(len(keys)), side) for side in ("left", "right"))
                for a in range(len(keys)):
                    key = (values["bunch"], a, int(keys[a]))
                    if not within:
                        best[key] = best_alike(block, q[a], int(keys[a]), int(labels[a]), k, best.get(key, NONE))
                    elif last[a] > first[a]:
                        own = order[first[a] : last[a]]
                        known = best[key][1] if key in best else [NONE] * len(own)
                        best[key] = (facts[own], best_within(block, q[a], int(labels[a]), low_of[own], high_of[own], k, known))
                    if len(best) >= KEPT_ANCHORS:
                        yield from told(best, within)
                        best = {}
        yield from told(best, within)

    return pairs.mapInArrow(run, FOUND)


def told(best: dict[tuple, tuple], within: bool) -> Iterator[pa.RecordBatch]:
    lines: list[tuple] = []
    for key, own in best.items():
        for fact, (scores, ids) in zip(own[0].tolist(), own[1]) if within else [((None, None, None), own)]:
            lines += [(*key, *fact, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
    if lines:
        kinds = [pa.int32() if name in ("place", "positive_rank") else pa.int64() for name in (f.split()[0] for f in FOUND.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], [f.split()[0] for f in FOUND.split(", ")])


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mined(
    items: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows for which `is_anchor`, an
    expression over `vec_id` and `label`, holds. A negative's score is from `low` to `high` hundredths of the positive's."""
    vector = F.col(vector_col)
    rows = items.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(finite(vector), vector).alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("vec_id", "label", scaled(F.col("v"), scale).alias("x"))
    rows = saved(rows.dropDuplicates(["vec_id", "label", "x"]).withColumn("width", F.size("x")), "negatives-rows")
    anchors = rows.where(is_anchor)
    stored, asked = blocks(rows, values_of(anchors)), bunches(anchors)

    alike = ranked(searched(met(stored, asked), positives, within=False), ["bunch", "place"], positives)
    score = F.col("score")
    # Whole numbers: the least score with 100 * s >= low * p, and the largest with 100 * s <= high * p.
    windows = saved(
        alike.select(
            "bunch",
            F.struct(
                "place",
                F.col("rank").alias("positive_rank"),
                F.col("id").alias("positive_id"),
                score.alias("positive_score"),
                F.expr(f"-floor(-{low} * score / 100BD)").cast("long").alias("low"),
                F.expr(f"floor({high} * score / 100BD)").cast("long").alias("high"),
            ).alias("w"),
        ).where("w.low <= w.high").groupBy("bunch").agg(F.collect_list("w").alias("windows")),
        "negatives-windows",
    )
    found = searched(met(stored, asked.join(windows, "bunch")), negatives, within=True)
    best = ranked(found, ["bunch", "place", "positive_rank"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
