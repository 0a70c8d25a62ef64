"""Removal of byte strings that recur, by blockwise suffix sorting with a difference cover.

Suffixes fall into buckets by their anchor (see `anchors`), so that all suffixes which share a window
of `length` bytes meet in one block of text, and only such text is moved. In a block, the suffixes at
the places of a difference cover are ranked first, by doubling. Then one bucket of suffixes at a time,
those between two leading words, is sorted by `PERIOD` bytes; what still ties is put in order by the
ranks of the cover suffixes that stand at the same distance behind both. Neighbours that share
`length` bytes recur. Texts are laid out so that anchors stand at multiples of the period.

Every byte inside a string of `length` bytes that also starts elsewhere, in the same or another text, is
removed; strings are judged on the input. NULL counts as empty. A repeated row is a copy like any
other, so that both lose all bytes if they have `length` or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import anchors
from concord.llm.storage import saved
from concord.llm.words import Texts, chunks, gathered

LENGTH = 200
GRAM = 32
PERIOD = 16
BUCKET_SUFFIXES = 1 << 18


@lru_cache(maxsize=1)
def difference_cover(period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """Members of a cover, 0 to r - 1 and the multiples of r for r near the root of the period, and for each
    two residues the distance at which both meet the cover."""
    root = int(np.ceil(np.sqrt(period)))
    cover = np.unique([*range(root), *range(0, period, root)])
    member = np.zeros(period, bool)
    member[cover] = True
    distance = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            distance[a, b] = next(d for d in range(period) if member[(a + d) % period] and member[(b + d) % period])
    return member, distance


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of what `order` sorts; equal keys, equal ranks."""
    step = np.zeros(len(order), bool)
    for key in keys:
        step[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class Block:
    """A byte text whose suffixes can be compared to a depth of `depth` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.size = len(text)
        padded = np.concatenate([text, np.zeros(PERIOD * 2, np.uint8)])
        # The eight bytes from every place on as one number, the first byte highest.
        self.word = np.lib.stride_tricks.as_strided(padded, (self.size + PERIOD, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        member, self.distance = difference_cover()
        self.places = np.flatnonzero(np.tile(member, -(-self.size // PERIOD))[: self.size])
        self.rank = np.full(self.size + PERIOD + 1, -1, np.int64)
        self.rank[self.places] = self._cover_ranks(depth)

    def _leading(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.word[at], self.word[at + 8]

    def _cover_ranks(self, depth: int) -> np.ndarray:
        """Ranks of the suffixes at the cover's places, by PERIOD bytes and then twice as many each time."""
        one, two = self._leading(self.places)
        n = len(self.places)
        rank = _dense(np.lexsort((two, one)), one, two)
        here = np.full(self.size + 1, -1, np.int64)
        reach = PERIOD
        while reach < depth:
            here[self.places] = rank
            behind = self.places + reach
            follow = np.where(behind < self.size, here[np.minimum(behind, self.size)], -1)
            key = rank * (n + 1) + follow + 1
            rank = _dense(np.argsort(key, kind="stable"), key)
            reach *= 2
        return rank

    def sorted(self, suffixes: np.ndarray) -> Iterator[np.ndarray]:
        """The suffixes in order, one bucket after the other."""
        lead = self.word[suffixes]
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        at = 0
        while at < len(order):
            upto = min(len(order), at + BUCKET_SUFFIXES)
            if upto < len(order):  # whole groups of equal leading words
                upto = int(np.searchsorted(lead, lead[upto - 1], "right"))
            yield self._bucket(suffixes[order[at:upto]])
            at = upto

    def _bucket(self, own: np.ndarray) -> np.ndarray:
        one, two = self._leading(own)
        order = np.lexsort((two, one))
        group = _dense(order, one, two)
        residue = own % PERIOD
        # Suffixes of one residue that tie meet the cover at one distance, so that a number orders them.
        key = self.rank[own + self.distance[residue, residue]]
        order = np.lexsort((key, residue, group))
        own, group, residue = own[order], group[order], residue[order]
        # Ties between residues: a suffix's place is its place among its own residue, plus what precedes it in each other one.
        ends = np.flatnonzero(np.append(np.diff(group) != 0, True)) + 1
        starts = np.append(0, ends[:-1])
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(residue) != 0)
        mixed = np.add.reduceat(new.astype(np.int64), starts) > 1
        for_mixed = np.repeat(mixed, ends - starts)
        at = np.flatnonzero(for_mixed)
        if not len(at):
            return own
        s, g, r = own[at], group[at], residue[at]
        ahead = np.zeros(len(at), np.int64)
        big = self.size + 2
        by_residue = {int(c): np.flatnonzero(r == c) for c in np.unique(r)}
        for a, mine in by_residue.items():
            for b, other in by_residue.items():
                d = self.distance[a, b]
                ours, theirs = self.rank[s[mine] + d] + 1, self.rank[s[other] + d] + 1
                keys = g[other] * big + theirs  # sorted: by group, and in it in the order of suffixes
                side = "left" if a <= b else "right"
                if a == b:
                    ahead[mine] += np.arange(len(mine)) - np.searchsorted(g[mine], g[mine], "left")
                else:
                    ahead[mine] += np.searchsorted(keys, g[mine] * big + ours, side) - np.searchsorted(keys, g[mine] * big, "left")
        begin = np.repeat(starts, ends - starts)[at]
        out = own.copy()
        out[begin + ahead] = s
        return out


def suffix_array(text: bytes, depth: int | None = None) -> np.ndarray:
    """All suffixes of a text in order (of their first `depth` bytes); an end sorts before any byte 1 to 255."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    return np.concatenate(list(Block(data, depth or len(data) + PERIOD).sorted(np.arange(len(data)))))


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether text[a:a+length] and text[b:b+length] are the same bytes: the common prefix of neighbours in suffix order,
    read eight bytes at a time while they agree."""
    out = np.zeros(len(a), bool)
    if len(text) < 8:
        text = np.append(text, np.zeros(8, np.uint8))
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    on = np.arange(len(a))
    for k in range(0, length - 7, 8):
        on = on[eight[a[on] + k] == eight[b[on] + k]]
    for k in range(length - length % 8, length):
        on = on[text[a[on] + k] == text[b[on] + k]]
    out[on] = True
    return out


def recurring(rows: pa.RecordBatch, length: int = LENGTH) -> np.ndarray:
    """Of every window of the segments in a block, whether it occurs in another of them, or the segment has copies."""
    texts = Texts(rows.column("content"))
    n = rows.column("n").to_numpy().astype(np.int64)
    shift = rows.column("shift").to_numpy().astype(np.int64)
    size = texts.end - texts.start
    # Lay out segments with their anchors at multiples of the period.
    room = -(-(size + PERIOD) // PERIOD) * PERIOD
    begin = np.cumsum(room) - room + (-shift) % PERIOD
    text = np.zeros(int(room.sum()) + PERIOD, np.uint8)
    text[gathered(begin, size)] = texts.data
    suffixes = gathered(begin, n)
    window = np.full(len(text), -1, np.int64)
    window[suffixes] = np.arange(len(suffixes))
    flag = np.zeros(len(suffixes), bool)
    for ordered in Block(text, length).sorted(suffixes):
        same = agree(text, ordered[1:], ordered[:-1], length)
        own = window[ordered]
        flag[own[1:][same]] = True
        flag[own[:-1][same]] = True
    flag |= np.repeat(rows.column("copies").to_numpy() > 1, n)
    return flag


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", split: int = anchors.SPLIT_SEGMENTS, with_kept: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and `kept`, the remaining bytes, on request."""
    scheme = anchors.Scheme(anchors.Bytes, length, min(GRAM, length))
    rows = anchors.numbered(docs, id_col, text_col)
    found = anchors.occurrences(rows, scheme)
    group = anchors.groups(found)
    copied = group.where("variants = 1").select("anchor", "segment", F.array(F.struct(F.lit(0).alias("first"), "n")).alias("windows"))
    several = anchors.flagged(rows, group, scheme, lambda block: recurring(block, length), False, split)
    windows = saved(copied.unionByName(several), "windows")
    stretches = saved(anchors.located(found, windows), "stretches")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = Texts(batch.column("text"))
            gone = anchors.covered_units(texts.start, texts.end, batch.column("stretches"), length)
            edge = np.zeros(len(gone) + 1, bool)
            edge[texts.start] = True
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | edge[1:-1]
            sums, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            kept = [texts.data[a:b][~gone[a:b]].tobytes() for a, b in zip(texts.start, texts.end)]
            columns = [
                batch.column("doc_id"),
                pa.array(texts.end - texts.start),
                pa.array(sums[texts.end] - sums[texts.start]),
                pa.array(spans[texts.end] - spans[texts.start]),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                *([pa.array(kept, pa.binary())] if with_kept else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return anchors.with_stretches(rows, stretches).mapInArrow(cut, schema)
