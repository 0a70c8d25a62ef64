"""Packing of tokenized texts by minimum bin slack.

Tokens: the ids that `tokenizers` gives, then an end id. A byte-level tokenizer splits a text before
every single space between two non-spaces, so ids are looked up per space-separated part, each
different part being encoded once and kept in a bounded cache.

Packing: a text longer than the capacity is cut; the whole sequences that it fills stand alone, and its
first piece is the rest. For all other pieces only the count per length matters, at most `capacity`
numbers. Per bin a bitset subset-sum over the available lengths finds the fullest combination, which
is then taken as often as the counts allow. Pieces get their place from their rank within the length.

NULL and empty texts are one piece that holds the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.storage import saved
from concord.llm.words import Texts, chunks, gathered

#: Some 200 bytes each, 300 MB a worker. With fewer, common parts of a large share are forgotten and encoded again and again.
CACHED_PARTS = 1_500_000
JOINED_PARTS = 8_000
SALT_ROWS = 50_000


# ---- tokens

class PartTokenizer:
    """Token ids of whole texts, by way of their space-separated parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        special = set(self.tokenizer.get_added_tokens_decoder())
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token.encode()) if k in special else len(token)  # a character stands for a byte
        self._forget()

    def _forget(self) -> None:
        # The known parts, and for each its place in the arrays below.
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        data, n = texts.data, len(texts.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # ASCII white space, and any byte of a character beyond ASCII: such may be white space too.
        plain = (data > 0x20) & (data < 0x7F)
        cut = np.zeros(n + 1, bool)
        cut[1 : n - 1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
        cut[texts.start] = True
        cut[n] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which, different = coded.indices.to_numpy(), coded.dictionary
        known = self.slots.get
        keys = different.to_pylist()
        slot = np.fromiter((known(key, -1) for key in keys), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(self.slots) + len(new) > CACHED_PARTS:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            parts = Texts(different)
            data, begin, stop = parts.data, parts.start, parts.end
            plain = (data > 0x20) & (data < 0x7F)
            # A part that begins with a space and ends like a cut may stand next to any other such part.
            a, b = begin[new], stop[new]
            joins = (b - a > 1) & (data[a] == 0x20) & plain[np.minimum(a + 1, len(data) - 1)] & plain[b - 1]
            new = np.concatenate([new[joins], new[~joins]])
            ids, size = self._joined(data, a[joins], b[joins])
            other_ids, other_size = self._single(data, a[~joins], b[~joins])
            size = np.concatenate([size, other_size])
            slot[new] = len(self.first) + np.arange(len(new))
            self.slots.update((keys[i], k) for k, i in enumerate(new.tolist(), len(self.first)))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids, other_ids])
        own = slot[which]
        size = self.size[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[gathered(self.first[own], size)], ends[np.searchsorted(start, texts.end)] - ends[np.searchsorted(start, texts.start)]

    def _joined(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for parts that are encoded as one text; the ids' lengths in bytes tell them apart."""
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(a), JOINED_PARTS):
            length = (b - a)[at : at + JOINED_PARTS]
            text = data[gathered(a[at : at + JOINED_PARTS], length)].tobytes().decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(length)) + 1
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def _single(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        sizes = []
        for at in range(0, len(a), 1000):
            parts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a[at : at + 1000], b[at : at + 1000])]
            for own in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
                ids += own.ids
                sizes.append(len(own.ids))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> PartTokenizer:
    return PartTokenizer(path)


PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), with the ids themselves on request."""
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in chunks(batches, "text"):
            texts = Texts(batch.column("text"))
            flat, sizes = encoder.encode(texts)
            flat = flat.astype("<u4")
            rows: list[tuple] = []
            at = 0
            for key, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                ids = np.concatenate([flat[at : at + size], end])
                at += size
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    own = ids[a:b]
                    rows.append((key, k, a, b - a, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, kinds)


# ---- minimum bin slack

def fullest(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to `capacity`, holding the longest
    piece that is left: one bit per sum, shifted once per usable copy of a length. Among equal sums the
    longer lengths are used first."""
    longest = int(lengths[-1])
    room = capacity - longest
    full = (1 << (room + 1)) - 1
    sums = 1
    steps: list[tuple[int, int, int]] = []  # length, copies in this step, sums before it
    for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        count -= length == longest
        copies = 1
        left = min(count, room // length)
        while left > 0 and not sums >> room & 1:
            take = min(copies, left)  # 1, 2, 4, ... copies at a time
            steps.append((length, take, sums))
            sums |= (sums << (take * length)) & full
            left -= take
            copies *= 2
        if sums >> room & 1:
            break
    rest = sums.bit_length() - 1
    chosen = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + take
            rest -= take * length
    return chosen


def bins(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, lo, hi, first_bin, per_bin, base). The piece of
    rank r, lo <= r < hi, is in bin first_bin + (r - lo) div per_bin, at base + ((r - lo) mod per_bin) * length."""
    lengths = np.array(sorted(k for k, n in counts.items() if n), np.int64)
    left = np.array([counts[int(k)] for k in lengths], np.int64)
    used = dict.fromkeys(lengths.tolist(), 0)
    rows, first = [], 0
    while len(lengths):
        chosen = fullest(lengths, left, capacity)
        at = np.searchsorted(lengths, list(chosen))
        per = np.array(list(chosen.values()))
        times = int((left[at] // per).min())
        base = 0
        for length, k in chosen.items():
            rows.append((length, used[length], used[length] + times * k, first, k, base))
            used[length] += times * k
            base += length * k
        left[at] -= per * times
        first += times
        lengths, left = lengths[left > 0], left[left > 0]
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "first_bin", "per_bin", "base"]).astype("int64").sort_values(["length", "lo"])


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces with `sequence_id` and `offset` added. `cut` needs `length` (1 to capacity), `doc_id` and
    `piece`; it is read twice and so should be a stored table.

    The counts per length, at most `capacity` rows, are all that the driver sees. Ranks within a length
    are counted per salt, so that a common length is dealt to many tasks.
    """
    spark = cut.sparkSession
    per_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, -(-max(per_length.values(), default=0) // SALT_ROWS))
    plan = bins(per_length, capacity)
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__rank", rank).join(before, ["length", "__salt"]) if salts > 1 else salted.withColumn("__rank", rank).withColumn("__before", F.lit(0))
    keys = (plan["length"] * (1 << 44) + plan["lo"]).to_numpy()
    table = {c: plan[c].to_numpy() for c in ("lo", "first_bin", "per_bin", "base")}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, n * (1 << 44) + r, "right") - 1
        r = r - table["lo"][at]
        return pd.DataFrame(
            {"sequence_id": table["first_bin"][at] + r // table["per_bin"][at], "offset": table["base"][at] + r % table["per_bin"][at] * n}
        )

    placed = ranked.withColumn("__place", place("length", F.col("__rank") + F.col("__before")))
    return placed.select(*cut.columns, "__place.sequence_id", "__place.offset")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Pieces of all texts with their places; see the module's notes."""
    return pack(saved(pieces(docs, tokenizer_path, capacity, end_id, **options), "pieces"), capacity)
