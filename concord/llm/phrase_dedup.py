"""Removal of word passages that recur, located by Aho-Corasick automata.

Passages are confirmed where their segments meet (see `anchors`): a window of `length` words that two
different segments share recurs. The confirmed passages of a shard, some anchors with all their
segments, are compiled into an automaton over word numbers, and one copy of each segment streams
through the automaton of its shard, which reports each occurrence. All but the earliest go. Other copies
are located by a join, and anchors with very many segments are decided by window hashes alone.

A word is what stands between white space. A word is removed if it is inside a window whose word
sequence also starts earlier: in a row with a smaller id, or earlier in the same row. Rows of equal id
come in the order in which they are read; NULL ids come last. Windows are judged on the input. NULL and
texts shorter than `length` words lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import anchors
from concord.llm.storage import saved
from concord.llm.words import NOT_SPACE, RunHash, Texts, Words, chunks, gathered

LENGTH = 20
GRAM = 6
#: Passages per automaton: some 20 nodes each.
PASSAGES = 20_000


def occurs_earlier(rows: pa.RecordBatch, length: int = LENGTH) -> np.ndarray:
    """Of every window of the segments in a shard, whether it occurs earlier in another of them."""
    words = Words(Texts(rows.column("content")), NOT_SPACE)
    n = rows.column("n").to_numpy().astype(np.int64)
    hashed = words.hashes()
    number = np.unique(hashed, return_inverse=True)[1]
    at = gathered(words.first, n)
    row = np.repeat(np.arange(len(n)), n)
    flag = np.zeros(len(at), bool)
    # Confirm: windows of more than one segment, with the place of the earliest.
    window = RunHash(hashed)(at, at + length)
    doc_id, uid = rows.column("doc_id").to_numpy()[row], rows.column("uid").to_numpy()[row]
    place = rows.column("start").to_numpy()[row] + at - words.first[row]
    order = np.lexsort((place, uid, doc_id, window))
    new = np.append(True, np.diff(window[order].view(np.int64)) != 0)
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(order)))
    confirmed = order[start[times > 1]]  # the earliest occurrence of each
    if not len(confirmed):
        return flag
    # Compile, in shards of bounded size, and stream the segments of the shard's anchors through each.
    anchor = rows.column("anchor").to_numpy()
    by_anchor = confirmed[np.argsort(row[confirmed], kind="stable")]
    symbols = number.tolist()
    first, last = words.first.tolist(), words.last.tolist()
    done = 0
    while done < len(by_anchor):
        upto = min(len(by_anchor), done + PASSAGES)
        whole = anchor[row[by_anchor]]
        while upto < len(by_anchor) and whole[upto] == whole[upto - 1]:
            upto += 1  # passages of an anchor stay together
        shard = by_anchor[done:upto]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        starts = at[shard].tolist()
        for k, a in zip(shard.tolist(), starts):
            automaton.add_word(tuple(symbols[a : a + length]), k)
        automaton.make_automaton()
        low, high = row[shard[0]], row[shard[-1]]
        low = int(np.searchsorted(anchor, anchor[low], "left"))
        high = int(np.searchsorted(anchor, anchor[high], "right"))
        ends, found = [], []
        for r in range(low, high):
            base = first[r]
            for end, passage in automaton.iter(tuple(symbols[base : last[r]])):
                ends.append(base + end)
                found.append(passage)
        if found:
            # Occurrences as windows; a segment's windows start at its words in turn.
            begin = np.array(ends) - length + 1
            owner = words.row[begin]
            index = (np.cumsum(n) - n)[owner] + begin - words.first[owner]
            flag[index[index != np.array(found)]] = True
        done = upto
    return flag


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", split: int = anchors.SPLIT_SEGMENTS, with_kept: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), and `kept`, the words left with a space between, on request."""
    scheme = anchors.Scheme(anchors.SpacedWords, length, min(GRAM, length))
    rows = anchors.numbered(docs, id_col, text_col)
    found = anchors.occurrences(rows, scheme)
    group = anchors.groups(found)
    several = anchors.flagged(rows, group, scheme, lambda block: occurs_earlier(block, length), True, split)
    none = F.expr("cast(array() AS array<struct<first:int,n:int>>)")
    windows = (
        group.select("anchor", "segment", "first", "copies")
        .join(several, ["anchor", "segment"], "left")
        .where("copies > 1 OR windows IS NOT NULL")
        .select("anchor", "segment", "first", F.coalesce("windows", none).alias("windows"))
    )
    stretches = saved(anchors.located(found, saved(windows, "windows")), "stretches")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_kept else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(Texts(batch.column("text")), NOT_SPACE)
            gone = anchors.covered_units(words.first, words.last, batch.column("stretches"), length)
            kept = joined(words, ~gone)
            sums = np.concatenate([[0], np.cumsum(gone)])
            columns = [
                batch.column("doc_id"),
                pa.array(words.last - words.first),
                pa.array(sums[words.last] - sums[words.first]),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                *([pa.array(kept, pa.binary()).cast(pa.string())] if with_kept else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_kept else "")
    return anchors.with_stretches(rows, stretches).mapInArrow(cut, schema)


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text with one space between."""
    own = np.flatnonzero(keep)
    size = words.end[own] - words.start[own] + 1
    ends = np.cumsum(size)
    out = np.full(int(size.sum()), 0x20, np.uint8)
    out[gathered(ends - size, size - 1)] = words.data[gathered(words.start[own], size - 1)]
    bounds = np.append(0, ends)
    first, last = np.searchsorted(own, words.first), np.searchsorted(own, words.last)
    return [out[bounds[a] : max(bounds[a], bounds[b] - 1)].tobytes() for a, b in zip(first, last)]
