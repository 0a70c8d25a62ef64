"""Language identification of mixed texts: scripts narrow the candidates of every word, letter
trigrams score them, and a Viterbi pass with a switching penalty labels the spans of a text.

The model holds, per language, log probabilities of hashed trigrams and the share of each script;
both are counted over all training rows. A text's prediction is the language with most letters in
its spans, and its score is that share. NULL texts and texts without a letter are `und`, score 0.
Rows are kept one for one. With no training rows every text is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.llm.words import Texts, chunks

BUCKETS = 1 << 14
UNKNOWN = "und"
# First code points of script blocks, and what they hold; 0 is any other.
SCRIPTS = (
    ("other", 0x0000), ("latin", 0x0041), ("greek", 0x0370), ("cyrillic", 0x0400), ("armenian", 0x0530),
    ("hebrew", 0x0590), ("arabic", 0x0600), ("other", 0x0780), ("devanagari", 0x0900), ("bengali", 0x0980),
    ("other", 0x0A00), ("tamil", 0x0B80), ("other", 0x0C00), ("thai", 0x0E00), ("other", 0x0E80),
    ("georgian", 0x10A0), ("hangul", 0x1100), ("other", 0x1200), ("latin", 0x1E00), ("greek", 0x1F00),
    ("other", 0x2000), ("kana", 0x3040), ("other", 0x3100), ("han", 0x3400), ("other", 0xA000),
    ("hangul", 0xAC00), ("han", 0xF900), ("other", 0xFB00), ("han", 0x20000),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _ in SCRIPTS))
#: A script is a language's own if it makes up this share of its letters.
OWN_SHARE = 0.01
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
GROUP_BYTES = 12 << 20


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: 2 for a letter, 1 for a mark, else 0; its lower case; its script."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        category = unicodedata.category(c)
        if category[0] == "L":
            kind[i] = 2
            if category != "Lo" and len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif category[0] == "M":
            kind[i] = 1
    script = np.zeros(0x110000, np.uint8)
    for name, start in SCRIPTS:
        script[start:] = SCRIPT_NAMES.index(name)
    return kind, lower, script


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    point = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        p, b = at[wide], lead[wide]
        rest = [padded[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        point[wide] = np.where(
            b < 0xE0,
            (b & 0x1F) << 6 | rest[0],
            np.where(b < 0xF0, (b & 0x0F) << 12 | rest[0] << 6 | rest[1], (b & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]),
        )
    return np.minimum(point, 0x10FFFF), at


class Letters:
    """Words of letters in texts, with the trigram bucket of every letter. Letters of word w are
    first[w]:last[w]; `row` is the text of a word."""

    def __init__(self, texts: Texts):
        kind, lower, script = _characters()
        point, at = code_points(texts.data)
        inside = kind[point] > 0
        place = np.flatnonzero(inside)
        point, at = lower[point[place]].astype(np.int64), at[place]
        row = np.searchsorted(texts.start, at, "right") - 1
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (row[1:] != row[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(place))
        self.row = row[self.first]
        before, after = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        before[1:] = np.where(new[1:], 0, point[:-1])
        after[:-1] = np.where(new[1:], 0, point[1:])
        mixed = (before * 0x9E3779B1 + point * 0x85EBCA77 + after * 0xC2B2AE3D) & 0xFFFFFFFF
        mixed = ((mixed ^ mixed >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
        self.bucket = (mixed ^ mixed >> 13) % BUCKETS
        self.script = script[point]  # of the lower case, the same script
        self.letter = kind[point] == 2


# ---- model

@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # trigram bucket x language
    own: np.ndarray  # script x language: whether the language is written in it


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams and scripts of every row with a text and a language, in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            letters = Letters(Texts(batch.column("text")))
            size = letters.last - letters.first
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {name: k for k, name in enumerate(names)}
            own = np.array([index[x] for x in langs])[np.repeat(letters.row, size)]
            width = BUCKETS + len(SCRIPT_NAMES)
            n = np.bincount(own * width + letters.bucket, minlength=len(names) * width)
            n += np.bincount(own * width + BUCKETS + letters.script, minlength=len(names) * width)
            for name, part in zip(names, n.reshape(len(names), width)):
                total[name] = total[name] + part if name in total else part.copy()
        for name, part in total.items():
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(part[at], pa.int64())], ["lang", "feature", "n"]
            )

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    # As many rows as there are languages times features: bounded by the model's size.
    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    n[counts["feature"].to_numpy(), np.searchsorted(languages, counts["lang"].to_numpy().astype(str))] = counts["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    log_p = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * BUCKETS))
    return Model(languages, log_p.astype(np.float32), scripts >= OWN_SHARE * np.maximum(scripts.sum(0), 1))


def word_scores(letters: Letters, model: Model) -> np.ndarray:
    """Log likelihood of each word in each language; languages not written in its script are set back
    (all stay if none is)."""
    size = letters.last - letters.first
    sums = np.add.reduceat(model.log_p[letters.bucket], letters.first, axis=0) if len(size) else np.zeros((0, len(model.languages)), np.float32)
    own = model.own[letters.script[letters.first]]
    out = own | ~own.any(1)[:, None]
    return np.where(out, sums, sums - 50.0 * size[:, None].astype(np.float32))


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: the sum of scores minus `penalty` per change of label is largest in each
    text. Text i has the words first[i]:first[i]+count[i]. All texts move forward by one word at a time."""
    labels = np.zeros(len(score), np.int32)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    active = np.searchsorted(-count, -np.arange(count.max(initial=0)), "left")  # texts with more than t words
    switched = np.zeros(score.shape, bool)
    best = np.zeros(len(score), np.int32)
    value = np.zeros((len(first), score.shape[1]), np.float32)
    for t in range(len(active)):
        n = active[t]
        at = first[:n] + t
        v = value[:n]
        if t:
            change = v.max(1, keepdims=True) - penalty
            switched[at] = v < change
            v = np.maximum(v, change)
        v = v + score[at]
        v -= v.max(1, keepdims=True)  # only differences count; keeps them small
        value[:n] = v
        best[at] = v.argmax(1)
    state = np.zeros(len(first), np.int32)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        ends = count[:n] == t + 1
        here = np.where(ends, best[at], state[:n])
        labels[at] = here
        if t:
            state[:n] = np.where(switched[at, here], best[at - 1], here)
    return labels


def predicted(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `spans`: the labelled stretches of words of letters, an array
    of (lang, first word, end word). Columns of these names are replaced."""
    added = ("lang_pred", "score", "spans")
    kept = [c for c in docs.columns if c not in added]
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*kept, *added]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        languages = np.array([*own.languages, UNKNOWN], object)
        for group in chunks(batches, "__text", GROUP_BYTES):
            rows, scores, sizes, at = [], [], [], 0
            for part in chunks(iter([group]), "__text"):
                letters = Letters(Texts(part.column("__text")))
                if own.languages:
                    real = np.add.reduceat(letters.letter, letters.first) if len(letters.first) else np.zeros(0, int)
                    rows.append(letters.row + at)
                    scores.append(word_scores(letters, own))
                    sizes.append(real)
                at += part.num_rows
            n = group.num_rows
            lang = np.full(n, len(languages) - 1)
            share = np.zeros(n)
            none = np.zeros(0, np.int64)
            row, score, size = (np.concatenate(x) if x else none for x in (rows, scores, sizes))
            bounds = np.searchsorted(row, np.arange(n + 1))
            change, end, labels = none, none, none
            if len(row):
                labels = viterbi(score, bounds[:-1], np.diff(bounds), penalty)
                k = len(own.languages)
                letters_of = np.bincount(row * k + labels, weights=size, minlength=n * k).reshape(n, k)
                whole = letters_of.sum(1)
                lang = np.where(whole > 0, letters_of.argmax(1), len(languages) - 1)
                share = np.where(whole > 0, letters_of.max(1) / np.maximum(whole, 1), 0.0)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])
                change = np.flatnonzero(new)
                end = np.append(change[1:], len(row))
            owner = row[change].astype(np.int64)
            stretches = pa.StructArray.from_arrays(
                [
                    pa.array(languages[labels[change]] if len(change) else [], pa.string()),
                    pa.array(change - bounds[owner], pa.int64()),
                    pa.array(end - bounds[owner], pa.int64()),
                ],
                fields=list(span),
            )
            offsets = np.searchsorted(owner, np.arange(n + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stretches)
            columns = [group.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(languages[lang], pa.string()), pa.array(share, pa.float64()), spans], names)

    more = StructType.fromDDL("lang_pred string, score double, spans array<struct<lang:string,first:bigint,end:bigint>>")
    schema = StructType([*(f for f in frame.schema if f.name in kept), *more])
    return frame.mapInArrow(label, schema)
