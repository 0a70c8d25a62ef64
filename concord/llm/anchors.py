"""Windows that recur anywhere in a corpus, found without moving all windows.

A window is a run of `window` units (bytes or words). Its anchor is the k-gram in it with the smallest
hash, so that equal windows have equal anchors at equal places. Windows in a row with one anchor form
a segment, the unit that is shuffled: about one per `(window - gram) / 2` units.

1. Anchors are counted. Those that occur once can't be part of a recurring window and are dropped.
2. Equal segments are counted as one, in each task first, so that a passage in a third of all rows
   is one row. A segment whose anchor has no other content needs no text.
3. The text of the other segments goes to a task by anchor, one copy of each, and the operator's own
   method finds the recurring windows there. Anchors with very many different segments are split
   by window instead, counted in each task first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm import storage
from concord.llm.storage import forget, saved
from concord.llm.words import BYTE_VALUES, NOT_SPACE, RunHash, Texts, Words, chunks, combined, gathered

BLOCK_UNITS = 1 << 20
BLOCK_BYTES = 1 << 20
#: Different segments of one anchor from which on its windows are dealt singly.
SPLIT_SEGMENTS = 4_000


class Bytes:
    """Units of texts: their bytes."""

    def __init__(self, texts: Texts):
        self.data, self.first, self.last = texts.data, texts.start, texts.end

    def hashes(self, low: int, high: int) -> np.ndarray:
        return BYTE_VALUES[self.data[low:high]]

    def place(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return start, end


class SpacedWords:
    """Units of texts: what stands between white space."""

    def __init__(self, texts: Texts):
        self.words = Words(texts, NOT_SPACE)
        self.data, self.first, self.last = self.words.data, self.words.first, self.words.last
        self.hashed = self.words.hashes()

    def hashes(self, low: int, high: int) -> np.ndarray:
        return self.hashed[low:high]

    def place(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.start[start], self.words.end[end - 1]


@dataclass(frozen=True)
class Scheme:
    units: type
    window: int
    gram: int


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(units, scheme: Scheme) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, start, windows, shift, anchor, segment) for blocks of units: place in the row, number of
    windows, place of the anchor within the segment, and the two hashes."""
    window, gram = scheme.window, scheme.gram
    total = int(units.last[-1]) if len(units.last) else 0
    for low in range(0, total, BLOCK_UNITS):
        high = min(total, low + BLOCK_UNITS)
        first = np.clip(units.first, low, high)
        size = np.maximum(np.clip(units.last - window + 1, low, high) - first, 0)
        at = gathered(first, size)
        if not len(at):
            continue
        run = RunHash(units.hashes(low, min(total, high + window - 1)))
        index = np.arange(run.size + 1 - gram, dtype=np.int64)
        grams = run(index, index + gram)
        mask = np.uint64((1 << max(22, len(index).bit_length())) - 1)
        # Of equal grams the first counts: the place is in the low bits.
        smallest = sliding_min((grams & ~mask) | index.astype(np.uint64), window - gram + 1)
        anchor = (smallest[at - low] & mask).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(row) != 0)
        s = np.flatnonzero(new)
        count = np.diff(np.append(s, len(at)))
        start = at[s]
        content = run(start - low, start - low + count + window - 1)
        yield row[s], start - units.first[row[s]], count, anchor[s] + low - start, grams[anchor[s]].view(np.int64), content.view(np.int64)


def keyed(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text.cast("string").alias("text")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, text): `uid` tells rows apart, also repeated ones, and stays; NULL ids count as the largest."""
    rows = docs.select(*keyed(F.col(id_col), F.col(text_col)))
    return storage.numbered(rows, "uid").select("uid", "doc_id", "text")


def occurrences(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Segments whose anchor occurs more than once, stored: (uid, doc_id, start, n, shift, anchor, segment)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "start", "n", "shift", "anchor", "segment"]
        for batch in chunks(batches, "text", BLOCK_UNITS):
            uid, doc_id = batch.column("uid"), batch.column("doc_id")
            for row, start, n, shift, anchor, content in segments(scheme.units(Texts(batch.column("text"))), scheme):
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [uid.take(row), doc_id.take(row), pa.array(start), pa.array(n, pa.int32()), pa.array(shift, pa.int32()), pa.array(anchor), pa.array(content)], names
                )

    found = saved(rows.mapInArrow(scan, "uid long, doc_id long, start long, n int, shift int, anchor long, segment long"), "segments")
    # Stored, so that the join deals both sides itself and can split a frequent anchor.
    often = saved(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "often")
    kept = saved(found.join(often, "anchor"), "recurring")
    forget(found)
    return kept


def groups(found: DataFrame) -> DataFrame:
    """Different segments, stored: (anchor, segment, copies, n, shift, first (doc_id, uid, start), variants), the
    last being the number of different segments of the anchor."""
    order = F.struct("doc_id", "uid", "start")
    each = saved(
        found.groupBy("anchor", "segment").agg(
            F.count("*").alias("copies"), F.first("n").alias("n"), F.first("shift").alias("shift"), F.min(order).alias("first")
        ),
        "groups",
    )
    variants = saved(each.groupBy("anchor").agg(F.count("*").alias("variants")), "anchors")
    whole = saved(each.join(variants, "anchor"), "variants")
    forget(each)
    return whole


CONTENT = "anchor long, segment long, shift int, n int, copies long, doc_id long, uid long, start long, content binary"


def contents(rows: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """The text of one copy of each wanted segment."""
    per_row = wanted.select(
        F.col("first.uid").alias("uid"), F.struct(F.col("first.start").alias("start"), "anchor", "segment", "shift", "n", "copies").alias("w")
    )
    asked = per_row.groupBy("uid").agg(F.collect_list("w").alias("asked"))
    names = [c.split()[0] for c in CONTENT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BLOCK_UNITS):
            units = scheme.units(Texts(batch.column("text")))
            lists = batch.column("asked")
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start = flat.column("start").to_numpy()
            begin = units.first[row] + start
            a, b = units.place(begin, begin + flat.column("n").to_numpy() + scheme.window - 1)
            data = units.data[gathered(a, b - a)]
            offsets = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
            content = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            at = pa.array(row)
            more = {"doc_id": batch.column("doc_id").take(at), "uid": batch.column("uid").take(at), "content": content}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else flat.column(c) for c in names], names)

    return rows.join(asked, "uid").select("uid", "doc_id", "text", "asked").mapInArrow(cut, CONTENT)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, in blocks of about `limit` bytes of content that hold whole anchors."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in chunks(iter([batch]), "content", limit):
            waiting.append(part)
            size += part.column("content").nbytes
            # While all is of one anchor there is nothing to cut.
            if size >= limit and waiting[0].column("anchor")[0] != part.column("anchor")[-1]:
                rows = combined(waiting)
                anchor = rows.column("anchor").to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1
                yield rows.slice(0, cut)
                waiting = [rows.slice(cut)]
                size = waiting[0].column("content").nbytes
    if size:
        yield combined(waiting)


def runs(flag: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of flagged windows: (segment, first window, number); segment i has count[i] windows in a row."""
    if not len(flag):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(flag) + 1, bool)
    begin = np.cumsum(count) - count
    edge[begin] = True
    edge[-1] = True
    before = np.zeros(len(flag), bool)
    before[1:] = flag[:-1]
    after = np.zeros(len(flag), bool)
    after[:-1] = flag[1:]
    first = np.flatnonzero(flag & (~before | edge[:-1]))
    end = np.flatnonzero(flag & (~after | edge[1:])) + 1
    owner = np.searchsorted(begin, first, "right") - 1
    return owner, first - begin[owner], end - first


FLAGGED = "anchor long, segment long, windows array<struct<first:int,n:int>>"


def flagged_batch(rows: pa.RecordBatch, flag: np.ndarray) -> pa.RecordBatch:
    owner, first, n = runs(flag, rows.column("n").to_numpy().astype(np.int64))
    some, at = np.unique(owner, return_index=True)
    windows = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["first", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)), pa.int32()), windows)
    some = pa.array(some)
    return pa.RecordBatch.from_arrays([rows.column("anchor").take(some), rows.column("segment").take(some), lists], ["anchor", "segment", "windows"])


def window_hashes(rows: pa.RecordBatch, scheme: Scheme) -> np.ndarray:
    """Hash of every window of every segment, in order."""
    units = scheme.units(Texts(rows.column("content")))
    n = rows.column("n").to_numpy().astype(np.int64)
    at = gathered(units.first, n)
    return RunHash(units.hashes(0, int(units.last[-1]) if len(n) else 0))(at, at + scheme.window)


def flagged(rows: DataFrame, group: DataFrame, scheme: Scheme, judge: Callable[[pa.RecordBatch], np.ndarray], first_stays: bool, split: int = SPLIT_SEGMENTS) -> DataFrame:
    """(anchor, segment, windows): of the first copy of each segment whose anchor has several, the windows
    that also occur in another one (`first_stays`: that occur earlier in another one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield flagged_batch(block, judge(block))

    some = contents(rows, group.where((F.col("variants") > 1) & (F.col("variants") <= split)), scheme)
    usual = some.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, FLAGGED)

    # The exact way for the rest: windows one by one, equal ones counted in each task first.
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "at", "hash", "copies", "doc_id", "uid", "start"]
        for batch in chunks(batches, "content", BLOCK_BYTES):
            n = batch.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), n)
            at = gathered(np.zeros(len(n), np.int64), n)
            take = pa.array(row)
            start = batch.column("start").to_numpy()[row] + at
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(take), batch.column("segment").take(take), pa.array(at, pa.int32()), pa.array(window_hashes(batch, scheme).view(np.int64)),
                 batch.column("copies").take(take), batch.column("doc_id").take(take), batch.column("uid").take(take), pa.array(start)], names,
            )

    many = group.where(F.col("variants") > split)
    if many.isEmpty():
        return usual
    hot = contents(rows, many, scheme)
    windows = hot.mapInArrow(single, "anchor long, segment long, at int, hash long, copies long, doc_id long, uid long, start long")
    order = F.struct("doc_id", "uid", "start")
    shared = windows.groupBy("anchor", "hash").agg(F.sum("copies").alias("times"), F.min(order).alias("earliest")).where("times > 1")
    again = windows.join(shared, ["anchor", "hash"])
    if first_stays:
        again = again.where(order != F.col("earliest"))
    dealt = again.groupBy("anchor", "segment").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("first"), F.lit(1).alias("n")))).alias("windows"))
    return usual.unionByName(dealt)


def located(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Stretches of windows per row: (uid, stretches), an array of (start, n). `windows` has what to take of each
    segment; if it has `first`, the copy (uid, start) that is judged by `windows`, all other copies are taken whole."""
    joined = found.join(windows, ["anchor", "segment"])
    own = F.col("windows")
    if "first" in windows.columns:
        rest = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("n")))
        is_first = (F.col("first.uid") == F.col("uid")) & (F.col("first.start") == F.col("start"))
        own = F.when(is_first, own).otherwise(rest)
    each = joined.select("uid", F.transform(own, lambda w: F.struct((F.col("start") + w["first"]).alias("start"), w["n"].alias("n"))).alias("part"))
    return each.where("size(part) > 0").groupBy("uid").agg(F.flatten(F.collect_list("part")).alias("stretches"))


def covered_units(first: np.ndarray, last: np.ndarray, lists: pa.ListArray, window: int) -> np.ndarray:
    """Which units (of all rows, one after the other) are inside a window of the rows' stretches."""
    depth = np.zeros((int(last[-1]) if len(last) else 0) + 1, np.int64)
    flat = pa.RecordBatch.from_struct_array(lists.flatten())
    row = np.repeat(np.arange(len(first)), np.diff(lists.offsets.to_numpy()))
    start = first[row] + flat.column("start").to_numpy()
    np.add.at(depth, start, 1)
    np.add.at(depth, start + flat.column("n").to_numpy() + window - 1, -1)
    return np.cumsum(depth)[:-1] > 0


def with_stretches(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """Every row with its text and stretches, and its id as it was, NULL included."""
    none = F.expr("cast(array() AS array<struct<start:bigint,n:int>>)")
    own = F.when(F.col("doc_id") != 2**63 - 1, F.col("doc_id")).alias("doc_id")
    return rows.join(stretches, "uid", "left").select(own, "text", F.coalesce("stretches", none).alias("stretches"))
