"""Quality classifier: attention-based multiple-instance learning over a text's passages.

Every passage of `PASSAGE_WORDS` words becomes a vector of surface features, encoded by a learned
layer. Gated attention weighs the passages, and the weighted sum is the text's representation, which
a logistic unit scores. Only whole texts are labelled; the weights of passages come from training.

Fitted on at most `sample_docs` labelled rows with at most `sample_passages` passages in all, taken in
the order of a hash of the id, without the texts that do not fit; every text is scored in full. NULL and empty texts are one passage
without words and get a score too. Rows are kept one for one. With one class or no labels every
score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.llm.words import Texts, Words, byte_class, chunks, mixed

PASSAGE_WORDS = 64
SHAPES = 48
SAMPLE_DOCS = 4000
SAMPLE_PASSAGES = 60_000
HIDDEN, ATTENTION = 24, 16
STEPS, RATE, DECAY = 250, 0.02, 1e-4

# Kinds of bytes whose sequences make up a word's shape.
_CLASSES = (
    byte_class(bytes(range(0x61, 0x7B))), byte_class(bytes(range(0x41, 0x5B))), byte_class(b"0123456789"),
    byte_class(b" "), byte_class(b"\t\n\r\x0b\x0c"), byte_class(b".,;:'\"()-?"), byte_class(b"!"),
    byte_class(b"#$%&*+/<=>@[\\]^_`{|}~"), byte_class(bytes(range(0x80, 0x100))),
)
CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES):
    CLASS_OF[_members] = _k
CLASSES = len(_CLASSES) + 1
STYLE = 6
FEATURES = CLASSES + SHAPES + STYLE


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each text (with the end behind)."""
    words = Words(texts)
    count = words.last - words.first
    number = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(number)])
    total = int(first[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(words):
        return x, first
    of_word = first[words.row] + (np.arange(len(words)) - words.first[words.row]) // PASSAGE_WORDS
    # Bytes belong to the passage of the last word that starts at or before them.
    edges = np.searchsorted(of_word, np.arange(total + 1))
    begin = np.append(words.start, len(texts.data))[edges]
    kinds = CLASS_OF[texts.data]
    of_byte = np.repeat(np.arange(total), np.diff(begin))
    kinds = kinds[begin[0] : begin[-1]]
    x[:, :CLASSES] = np.bincount(of_byte * CLASSES + kinds, minlength=total * CLASSES).reshape(total, CLASSES)
    shape = np.zeros(len(kinds), np.int64)
    shape[1:-1] = (kinds[:-2].astype(np.int64) * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
    shape = (shape * 2654435761 >> 7) % SHAPES
    x[:, CLASSES : CLASSES + SHAPES] = np.bincount(of_byte * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES)
    size = np.maximum(1, np.diff(begin))[:, None]
    x[:, : CLASSES + SHAPES] = np.sqrt(x[:, : CLASSES + SHAPES] / size)
    # Repetition, lengths and ends of words.
    n = np.maximum(1, np.bincount(of_word, minlength=total))
    lowered = Words(texts, lower=True).hashes()
    pair = mixed(lowered + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    different, which, times = np.unique(pair, return_index=True, return_counts=True)
    own = of_word[which]
    top = np.zeros(total)
    np.maximum.at(top, own, times)
    length = words.end - words.start
    last = CLASS_OF[texts.data[words.end - 1]]
    style = x[:, CLASSES + SHAPES :]
    style[:, 0] = np.bincount(own, minlength=total) / n
    style[:, 1] = top / n
    style[:, 2] = np.bincount(of_word, weights=length, minlength=total) / n / 10
    style[:, 3] = np.bincount(of_word, weights=last >= 6, minlength=total) / n
    same = np.zeros(len(words), bool)
    same[1:] = (lowered[1:] == lowered[:-1]) & (of_word[1:] == of_word[:-1])
    style[:, 4] = np.bincount(of_word, weights=same, minlength=total) / n
    style[:, 5] = np.minimum(n / PASSAGE_WORDS, 1)
    return x, first


# ---- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    start, size = first[:-1], np.diff(first)
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * g) @ w["a"]
    logit = logit - np.repeat(np.maximum.reduceat(logit, start), size)
    power = np.exp(logit)
    weight = power / np.repeat(np.add.reduceat(power, start), size)
    z = np.add.reduceat(h * weight[:, None], start, axis=0)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["b"][0])}


def score(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the attention weight of each passage."""
    if model.constant is not None:
        return np.full(len(first) - 1, model.constant), np.repeat(1 / np.diff(first), np.diff(first))
    out = _forward(model.weights, (x - model.mean) / model.scale, first)
    return out["p"], out["weight"]


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """Adam on the whole sample; a text's weight is half its own, half its class's."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(label.tolist())) < 2:
        return Model({}, mean, scale, float(label.mean()) if len(label) else 0.5)
    random = np.random.default_rng(seed)
    normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "E": normal(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": normal(HIDDEN, ATTENTION), "U": normal(HIDDEN, ATTENTION),
        "a": normal(ATTENTION), "c": normal(HIDDEN), "b": np.zeros(1),
    }
    x = (x - mean) / scale
    start, size = first[:-1], np.diff(first)
    # Half by the number of texts, half by class.
    weigh = (0.5 + 0.25 / np.where(label > 0, label.mean(), 1 - label.mean())) / len(label)
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, STEPS + 1):
        f = _forward(w, x, first)
        d = (f["p"] - label) * weigh
        dz = np.repeat(d, size)[:, None] * w["c"]
        along = (dz * f["h"]).sum(1)
        dlogit = f["weight"] * (along - np.repeat(np.add.reduceat(f["weight"] * along, start), size))
        gated = dlogit[:, None] * w["a"]
        dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["weight"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        grad = {
            "E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "a": ((f["t"] * f["g"]) * dlogit[:, None]).sum(0), "c": f["z"].T @ d, "b": np.array([d.sum()]),
        }
        for k in w:
            g = grad[k] + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale)


# ---- Spark

def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Fit on a bounded sample. Ids with labels of both kinds, or none, are left out."""
    wanted = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("id", "label")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_docs)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x, first = passages(Texts(batch.column("text")))
            flat = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("label"), pa.array(np.diff(first), pa.int32()), pa.array(flat, pa.binary())],
                ["id", "label", "n", "x"],
            )

    found, label, total = [], [], 0
    made = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(features, "id long, label int, n int, x binary")
    for row in made.orderBy(F.xxhash64("id"), "id", "x").toLocalIterator():
        if total + row["n"] > sample_passages:
            continue
        total += row["n"]
        label.append(row["label"])
        found.append(np.frombuffer(row["x"], np.float32).reshape(row["n"], FEATURES))
    first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    x = np.concatenate(found).astype(np.float64) if found else np.zeros((0, FEATURES))
    return fit(x, first, np.array(label, np.float64))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", with_attention: bool = False) -> DataFrame:
    """`docs` with the score, and on request `attention`, the weights of the passages. Columns of these
    names are replaced."""
    added = [out, *(["attention"] if with_attention else [])]
    kept = [c for c in docs.columns if c not in added]
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, "__text"):
            x, first = passages(Texts(batch.column("__text")))
            p, weight = score(own, x, first)
            more = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(weight, pa.float64()))] if with_attention else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64()), *more], [*kept, *added])

    more = StructType.fromDDL(f"`{out}` double" + (", attention array<double>" if with_attention else ""))
    return frame.mapInArrow(run, StructType([*(f for f in frame.schema if f.name in kept), *more]))
