"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a task's rows. Its words become symbols of the benchmark's vocabulary. A word
outside it can't be inside a match, and neither can a run of known words shorter than the shortest
test phrase, so each such stretch becomes a single separator before the index is built. The index is
the Burrows-Wheeler transform in a wavelet tree with suffix positions sampled; every test phrase is
searched backward, its occurrences are located by stepping to a sampled position, and the covered
words are merged into spans.

A test phrase is `window` consecutive words of an item; an item with fewer, but some, is one phrase.
NULL and empty texts have no words. Items that repeat each count. Documents are kept one for one.

The phrases are sent to the executors in slices of bounded size; a larger benchmark takes more passes
over the documents, whose spans are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.llm.words import LETTERS_DIGITS, Texts, Words, chunks, gathered

SAMPLE = 16
SLICE_BYTES = 64 << 20
SHARD_BYTES = 2 << 20


# ---- the index

def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks by 1, 2, 4, ... symbols until all differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.full(n, -1, np.int64)
        follow[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * (n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if rank.max(initial=0) == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """A bit vector of 64-bit words, with the number of ones before each word."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit.astype(bool), bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 - len(packed) % 8 + 8, np.uint8)])[: (len(bit) // 64 + 1) * 8].view("<u8")
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.words[:-1]))).astype(np.int64)

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Ranks of symbols in a sequence, one packed bit vector per bit of the symbol, highest first; each level
    holds the sequence stably sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.symbols = symbols.astype(np.int32)
        symbols = self.symbols
        for level in range(bits - 1, -1, -1):
            bit = symbols >> level & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros_like(place), place
        for level, bits, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            bit = (symbol >> level & 1).astype(bool)
            one_low, one_at = bits.ones(low), bits.ones(at)
            low = np.where(bit, zeros + one_low, low - one_low)
            at = np.where(bit, zeros + one_at, at - one_at)
        return at - low


class FMIndex:
    """Index of a sequence of symbols from 1 on; symbol 0 ends it and stands nowhere else."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        symbols = np.append(symbols, 0).astype(np.int64)
        order = suffix_order(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.bwt = WaveletTree(symbols[order - 1], max(1, int(alphabet - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase; phrases are right-aligned in a table."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((size >= back) & (high > low))
            if not len(on):
                break
            symbol = phrases[on, -back].astype(np.int64)
            low[on] = self.before[symbol] + self.bwt.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.bwt.rank(symbol, high[on])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back through the transform until a sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        on = np.arange(len(rows))
        while len(on):
            done = self.sampled[rows[on]]
            hit = on[done]
            found[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            on = on[~done]
            symbol = self.bwt.symbols[rows[on]].astype(np.int64)
            rows[on] = self.before[symbol] + self.bwt.rank(symbol, rows[on])
            steps[on] += 1
        return found


# ---- test phrases

class Phrases:
    """Phrases of benchmark items as symbols; `item` is the place of the item in `items`."""

    def __init__(self, items: list, texts: list[bytes | str | None], window: int):
        words = Words(Texts(pa.array(texts, pa.binary())), LETTERS_DIGITS, lower=True)
        self.items = items
        self.vocabulary, symbol = np.unique(words.hashes(), return_inverse=True)
        symbol = symbol + 2  # 0 ends the sequence, 1 separates
        count = words.last - words.first
        size = np.minimum(count, window)
        starts = np.where(count > 0, np.maximum(count - window, 0) + 1, 0)
        at = gathered(words.first, starts)
        item = np.repeat(np.arange(len(items)), starts)
        each = size[item]
        table = np.ones((len(at), max(1, int(size.max(initial=1)))), np.int32)
        for back in range(1, table.shape[1] + 1):
            has = each >= back
            table[has, -back] = symbol[(at + each - back)[has]]
        # Equal phrases are searched once; which items hold each is kept aside.
        keyed = np.column_stack([table, each.astype(np.int32)]) if len(table) else np.zeros((0, 2), np.int32)
        distinct, which = np.unique(keyed, axis=0, return_inverse=True)
        self.table, self.size = distinct[:, :-1], distinct[:, -1].astype(np.int64)
        pairs = np.unique(np.column_stack([which.ravel(), item]), axis=0)
        self.item_of = pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        self.shortest = int(self.size.min(initial=window))


def hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: the first word of each, its number of words, and its phrase."""
    nothing = (np.zeros(0, np.int64),) * 3
    if not len(words) or not len(phrases.table):
        return nothing
    hashed = words.hashes()
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashed), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashed
    first_of_text = np.zeros(len(words) + 1, bool)
    first_of_text[words.first] = True
    breaks = ~known
    breaks[1:] |= ~known[:-1]
    breaks |= first_of_text[:-1]
    run_start = np.flatnonzero(breaks)
    run_size = np.diff(np.append(run_start, len(words)))
    keep = known[run_start] & (run_size >= phrases.shortest)
    run_start, run_size = run_start[keep], run_size[keep]
    if not len(run_start):
        return nothing
    # Runs one after the other with a separator behind each; `place` leads back to the word.
    place = gathered(run_start, run_size + 1)
    symbols = np.ones(len(place), np.int64)
    inner = np.ones(len(place), bool)
    inner[np.cumsum(run_size + 1) - 1] = False
    symbols[inner] = at[place[inner]] + 2
    index = FMIndex(symbols, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.table, phrases.size)
    number = high - low
    found = index.locate(gathered(low, number))
    phrase = np.repeat(np.arange(len(number)), number)
    return place[found], phrases.size[phrase], phrase


def covered(words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words are inside any occurrence."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + size, -1)
    return np.cumsum(depth)[:-1] > 0


# ---- Spark

def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[tuple[list, list]]:
    """Benchmark items in slices of at most `slice_bytes` (or one item), never all at once on the driver."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    items, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        if size and size + len(row["text"]) * 2 > slice_bytes:
            yield items, texts
            items, texts, size = [], [], 0
        items.append(row["item"])
        texts.append(row["text"].encode())
        size += len(texts[-1])
    yield items, texts


def cut_out(texts: Texts, words: Words, row: np.ndarray, first: np.ndarray, end: np.ndarray, column: pa.Array) -> pa.Array:
    """The texts without the stretches of words first:end of each row, rows in order."""
    out = column.to_pylist()
    edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)]):
        i = int(row[a])
        at, parts = int(texts.start[i]), []
        for x, y in zip(words.start[first[a:b]].tolist(), words.end[end[a:b] - 1].tolist()):
            parts.append(texts.data[at:x].tobytes())
            at = y
        parts.append(texts.data[at : texts.end[i]].tobytes())
        out[i] = b"".join(parts).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`docs` with `n_words`, `spans` (array of first and end word of every covered stretch), `n_hit` and
    `items` (the item ids as text, sorted, no repeats)."""
    out = docs
    parts = []
    for k, (items, texts) in enumerate(_slices(benchmark, item_col, item_text_col, slice_bytes)):
        out, name = _one_pass(out, Phrases(items, texts, window), text_col, k)
        parts.append(name)
    spans = F.array_sort(F.concat(*(F.col(f"{p}.spans") for p in parts)))
    merged = spans if len(parts) == 1 else F.aggregate(
        spans,
        F.lit([]).cast("array<struct<first:bigint,end:bigint>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["first"] <= F.element_at(a, -1)["end"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    items = F.array_sort(F.array_distinct(F.concat(*(F.col(f"{p}.items") for p in parts))))
    return (
        out.withColumns({"n_words": F.col(f"{parts[0]}.n_words"), "spans": merged, "items": items})
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]))
        .drop(*parts)
    )


def _one_pass(docs: DataFrame, phrases: Phrases, text_col: str, k: int, cut: bool = False) -> tuple[DataFrame, str]:
    """`docs` with a column of what was found; `cut` takes it out of the texts in the same pass."""
    name = f"__hits_{k}"
    result = pa.struct(
        [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
    )
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    input_columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for shard in chunks(batches, text_col, SHARD_BYTES):
            texts = Texts(shard.column(text_col))
            words = Words(texts, LETTERS_DIGITS, lower=True)
            start, size, phrase = hits(words, own)
            hit = covered(words, start, size)
            # Runs of covered words, cut where a text ends.
            edge = np.zeros(len(words) + 1, bool)
            edge[words.first] = True
            before = np.zeros(len(words), bool)
            before[1:] = hit[:-1]
            after = np.zeros(len(words), bool)
            after[:-1] = hit[1:]
            first = np.flatnonzero(hit & (~before | edge[:-1]))
            end = np.flatnonzero(hit & (~after | edge[1:])) + 1
            row = words.row[first]
            if cut:
                left = cut_out(texts, words, row, first, end, shard.column(text_col))
                yield pa.RecordBatch.from_arrays([left if c == text_col else shard.column(c) for c in input_columns], input_columns)
                continue
            offsets = np.searchsorted(row, np.arange(shard.num_rows + 1))
            spans = pa.StructArray.from_arrays(
                [pa.array(first - words.first[row], pa.int64()), pa.array(end - words.first[row], pa.int64())], ["first", "end"]
            )
            # Items per text.
            number = own.item_first[phrase + 1] - own.item_first[phrase]
            pairs = np.unique(
                np.column_stack([np.repeat(words.row[start], number), own.item_of[gathered(own.item_first[phrase], number)]]), axis=0
            )
            item_offsets = np.searchsorted(pairs[:, 0], np.arange(shard.num_rows + 1))
            items = pa.array([None if own.items[i] is None else str(own.items[i]) for i in pairs[:, 1].tolist()], pa.string())
            found = pa.StructArray.from_arrays(
                [
                    pa.array(words.last - words.first, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                    pa.ListArray.from_arrays(pa.array(item_offsets, pa.int32()), items),
                ],
                fields=list(result),
            )
            yield pa.RecordBatch.from_arrays([*shard.columns, found], [*input_columns, name])

    kind = "struct<n_words:bigint,spans:array<struct<first:bigint,end:bigint>>,items:array<string>>"
    schema = docs.schema if cut else StructType([*docs.schema, *StructType.fromDDL(f"{name} {kind}")])
    return docs.mapInArrow(scan, schema), name


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", **options) -> DataFrame:
    """`docs` with covered words cut out of the texts, from the start of a stretch's first word to the end
    of its last one. Texts without a match stay byte for byte; so do rows and other columns."""
    columns = docs.columns
    framed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def unframed(done: DataFrame) -> DataFrame:
        return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns))

    slices = _slices(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), options.get("slice_bytes", SLICE_BYTES))
    items, texts = next(slices)
    if next(slices, None) is None:
        return unframed(_one_pass(framed, Phrases(items, texts, window), "text", 0, cut=True)[0])
    found = matches(framed, benchmark, window, "text", **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            texts = Texts(batch.column("text"))
            words = Words(texts, LETTERS_DIGITS)
            spans = batch.column("spans")
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
            flat = spans.flatten()
            first, end = (flat.field(c).to_numpy(zero_copy_only=False) + words.first[row] for c in ("first", "end"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), cut_out(texts, words, row, first, end, batch.column("text"))], ["row", "text"])

    slim = found.select("row", "text", "spans")
    schema = StructType([f for f in slim.schema if f.name in ("row", "text")])
    return unframed(slim.mapInArrow(cut, schema))
