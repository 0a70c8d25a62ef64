"""Similarity join on sets of word shingles by chosen paths.

1. Texts become sets of `WORDS`-word shingles; equal sets are one class from here on. A set is embedded
   as `TOKENS` min-hashes, each a token (coordinate, value).
2. A run draws about `BRANCHES` tokens of every set by a hash of the token, so that similar sets draw the
   same ones; the sets that drew a token form a bucket. Large buckets whose sets are not alike draw
   again, by the hash of the path so far, to `DEPTH` levels. Runs are repeated until a pair at the
   threshold meets with probability `target`.
3. Small buckets are compared in full by their embeddings, large ones in blocks of bounded size. What
   looks similar is linked as a star, and stars are joined to groups of candidates. The first `FIRST` runs go ahead: later ones leave
   out buckets whose sets are in one group already, as they could add nothing.
4. Within a group all pairs are compared exactly, on the whole texts, again in blocks of bounded size. A
   class gets the number of texts linked to it; groups are the connected components of these links.

Words are the longest runs of letters and digits, A-Z in lower case; a text of fewer than `WORDS` words, but some,
has one shingle of them all. NULL texts and texts without words are linked to nothing. Repeated rows are
copies. No pair is ever a row, except a star's arms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import anchors, storage
from concord.llm.components import components
from concord.llm.storage import by_ids, saved
from concord.llm.words import LETTERS_DIGITS, Texts, Words, chunks, combined, gathered, mixed

WORDS = 5
SIMILARITY = 0.8
TOKENS = 128
BRANCHES = 2.0
DEPTH = 4
TARGET = 0.9999
#: Sets of one task on either side.
BLOCK = 512
#: Text of one task on either side of the exact comparison, where a block holds more than one text.
BLOCK_BYTES = 8 << 20
#: Buckets from this size on are split, unless their sets are on average this similar.
SPLIT = 1024
ALIKE = 0.6
#: Runs that go ahead.
FIRST = 2
#: A pair is a candidate if its embeddings agree to this much less than the threshold: four standard deviations.
MARGIN = 0.15

_random = np.random.default_rng(97)
FACTORS = _random.integers(1, 2**64, TOKENS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _random.integers(1, 2**64, TOKENS, dtype=np.uint64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(similarity: float, target: float, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a bucket at the last level with probability `target`."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-branches * similarity * meet)
    return math.ceil(math.log(1 - target) / math.log(1 - meet))


# ---- sets

def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, one text after the other, and how many each has."""
    words = Words(texts, LETTERS_DIGITS, lower=True)
    hashed = words.hashes()
    count = words.last - words.first
    size = np.where(count > 0, np.maximum(count - WORDS, 0) + 1, 0)
    at = gathered(words.first, size)
    row = np.repeat(np.arange(len(size)), size)
    shingle = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < words.last[row]
        part = mixed(hashed[np.minimum(at + k, max(len(hashed) - 1, 0))] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) if len(at) else shingle
        shingle += np.where(inside, part, np.uint64(0))
    shingle = mixed(shingle)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[new], np.bincount(row[new], minlength=len(size))


def embedded(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Min-hashes of each set, one row per set; sets must not be empty."""
    start = np.cumsum(size) - size
    out = np.empty((len(size), TOKENS), np.uint64)
    for k in range(TOKENS):
        value = shingles * FACTORS[k]
        value ^= value >> np.uint64(29)
        value *= GOLDEN
        out[:, k] = np.minimum.reduceat(value ^ SHIFTS[k], start)
    return out


def drawn(path: np.ndarray, tokens: np.ndarray, branches: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that sets draw at the end of their paths: the set of each, and the path with the token added."""
    step = mixed(tokens + SHIFTS[None])
    step = mixed(step ^ path[:, None])
    row, column = np.nonzero(step < np.uint64(int(branches / TOKENS * 2**64)))
    return row, mixed(step[row, column] + GOLDEN)


def _lists(found: list[tuple[np.ndarray, np.ndarray]], sets: int) -> pa.ListArray:
    """Paths of some runs as one list per set."""
    owner, path = (np.concatenate([*x, np.zeros(0, x[0].dtype)]) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.argsort(owner, kind="stable")
    offsets = np.searchsorted(owner[order], np.arange(sets + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(path[order].view(np.int64)))


SIGNATURE = "uid long, doc_id long, low long, high long, size int, bytes long, sketch binary, paths array<long>, later array<long>"


def signatures(rows: DataFrame, runs: int) -> DataFrame:
    names = [c.split()[0] for c in SIGNATURE.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            shingles, size = shingle_sets(Texts(batch.column("text")))
            some = np.flatnonzero(size)
            batch = batch.take(pa.array(some))
            size = size[some]
            if not len(some):
                continue
            start = np.cumsum(size) - size
            tokens = embedded(shingles, size)
            sketch = (tokens >> np.uint64(48)).astype("<u2")
            found = [drawn(np.full(len(size), mixed(np.array([k + 1], np.uint64))[0]), tokens, BRANCHES) for k in range(runs)]
            columns = [
                batch.column("uid"),
                batch.column("doc_id"),
                pa.array(np.add.reduceat(shingles, start).view(np.int64)),
                pa.array(np.bitwise_xor.reduceat(mixed(shingles + GOLDEN), start).view(np.int64)),
                pa.array(size, pa.int32()),
                pc.binary_length(batch.column("text")).cast(pa.int64()),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
                _lists(found[:FIRST], len(size)),
                _lists(found[FIRST:], len(size)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(scan, SIGNATURE)


# ---- buckets

def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TOKENS)


def _alike(members: DataFrame) -> DataFrame:
    """Mean similarity of the sets in a bucket, from every sixteenth token, counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            some = _sketches(batch.column("sketch"))[:, ::16].astype(np.int64)
            path = np.repeat(batch.column("path").to_numpy(), some.shape[1])
            token = (some + (np.arange(some.shape[1]) << 16)).ravel()
            order = np.lexsort((token, path))
            path, token = path[order], token[order]
            first = np.flatnonzero(np.append(True, (np.diff(path) != 0) | (np.diff(token) != 0)))
            n = np.diff(np.append(first, len(path)))
            yield pa.RecordBatch.from_arrays([pa.array(path[first]), pa.array(token[first]), pa.array(n.astype(float))], ["path", "t", "n"])

    counts = members.select("path", "sketch").mapInArrow(count, "path long, t long, n double").groupBy("path", "t").agg(F.sum("n").alias("n"))
    n = F.sum("n")
    return counts.groupBy("path").agg((F.sum(F.col("n") * F.col("n")) * (TOKENS // 16) / (n * n)).alias("alike"))


def buckets(level: DataFrame, sketches: DataFrame) -> DataFrame:
    """Buckets to compare, with their members, (path, class, blocks), from the paths of sets (path, class, part). Buckets with
    sets of one `part` only are left out; `sketches` are those of all classes (class, sketch)."""
    leaves = None
    for depth in range(DEPTH):
        level = saved(level, "paths")
        size = level.groupBy("path").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
        size = saved(size.where("low < high").select("path", "n"), "buckets")
        held = saved(level.join(size, "path"), "held")
        # Of buckets with the same members one is enough.
        same = held.groupBy("path", "n").agg(F.bit_xor(F.xxhash64("class")).alias("members")).groupBy("n", "members").agg(F.min("path").alias("path"))
        size = saved(same.select("path", "n"), "buckets")
        held = held.drop("n").join(size, "path")
        last = depth == DEPTH - 1
        large = size.where(F.col("n") >= SPLIT)
        some = not last and not large.isEmpty()
        whole = held
        if some:
            large = held.where(F.col("n") >= SPLIT)
            large = saved(large.join(by_ids(sketches, saved(large.select("class").distinct(), "asked"), "left_semi"), "class"), "large")
            # How alike a bucket is only decides where its sets are compared: some 512 of them tell.
            told = large.where(f"pmod(xxhash64(class, 9), int(ceil(n / {BLOCK}))) = 0")
            split = saved(_alike(told).where(F.col("alike") < ALIKE).select("path"), "split")
            whole = held.join(split, "path", "left_anti")
        found = saved(whole.select("path", "class", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        if not some:
            break
        level = large.join(split, "path").select("path", "class", "part", "sketch").mapInArrow(_further, "path long, class long, part long").distinct()
    return leaves


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            row, path = drawn(batch.column("path").to_numpy().view(np.uint64), _sketches(batch.column("sketch")).astype(np.uint64), BRANCHES)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("class").take(row), batch.column("part").take(row)], ["path", "class", "part"])


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of large groups sent to every pair of blocks that holds their own, as (x, y) with x <= y."""
    own = F.expr("int(pmod(xxhash64(class, 5), blocks))")
    out = members.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return out.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "blocks")


def spanning(linked: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arms (name, smallest name) of the connected components of a symmetric matrix of links."""
    label = np.arange(len(names))
    order = np.argsort(names)
    rank = np.empty(len(names), np.int64)
    rank[order] = label
    label = rank.copy()
    while True:
        best = np.minimum(label, np.where(linked, label[None], len(names)).min(1))
        best = np.minimum(best, best[order][best])
        if (best == label).all():
            break
        label = best
    arms = label != rank
    return names[arms], names[order][label[arms]]


def _keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key at a time, from rows sorted by the keys."""
    waiting: list[pa.RecordBatch] = []  # of one key
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            value = batch.column(k).to_numpy()
            change[1:] |= value[1:] != value[:-1]
            change[0] |= bool(waiting) and value[0] != waiting[0].column(k)[0].as_py()
        at = 0
        for e in np.flatnonzero(change).tolist():
            if e > at:
                waiting.append(batch.slice(at, e - at))
            yield combined(waiting)
            waiting = []
            at = e
        waiting.append(batch.slice(at))
    if waiting:
        yield combined(waiting)


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for bucket in _keyed(batches, ["path", "x", "y"]):
        sketch = _sketches(bucket.column("sketch"))
        n = len(sketch)
        if n < 2:
            continue
        same = np.empty((n, n), np.int32)
        step = max(1, (1 << 22) // (n * TOKENS))
        for at in range(0, n, step):
            same[at : at + step] = (sketch[at : at + step, None] == sketch[None]).sum(2)
        names, root = spanning(same >= least * TOKENS, bucket.column("class").to_numpy())
        a.append(names)
        b.append(root)
        if sum(map(len, a)) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


# ---- exact comparison

def shared_shingles(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of shingles that two sets share. Shingles held by the same sets count as one
    column with a weight."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(shingles, kind="stable")
    s, r = shingles[order], row[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(s)))
    keep = times > 1
    pattern = np.add.reduceat(mixed(r.astype(np.uint64) + GOLDEN), start) if len(s) else np.zeros(0, np.uint64)
    _, which, weight = np.unique(pattern[keep], return_index=True, return_counts=True)
    start, times = start[keep][which], times[keep][which]
    out = np.zeros((n, n), np.float32)
    step = 4096
    for at in range(0, len(start), step):
        st, ti = start[at : at + step], times[at : at + step]
        x = np.zeros((n, len(st)), np.float32)
        x[r[gathered(st, ti)], np.repeat(np.arange(len(st)), ti)] = 1
        out += (x * weight[at : at + step].astype(np.float32)) @ x.T
    np.fill_diagonal(out, size)
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    names = ["class", "links", "root"]
    for group in _keyed(batches, ["component", "x", "y"]):
        if group.num_rows < 2:
            continue
        shingles, size = shingle_sets(Texts(group.column("text")))
        both = shared_shingles(shingles, size)
        linked = both >= similarity * (size[:, None] + size[None] - both) - 1e-6
        np.fill_diagonal(linked, False)
        own = group.column("own").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        if x != y:  # pairs within a block are compared where it meets itself
            linked &= own[:, None] != own[None]
        which = group.column("class").to_numpy()
        links = (linked * group.column("copies").to_numpy()[None]).sum(1)
        arm, root = spanning(linked, which)
        roots = which.copy()
        at = np.searchsorted(np.sort(which), arm)
        roots[np.argsort(which)[at]] = root
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(which[some]), pa.array(links[some].astype(np.int64)), pa.array(roots[some])], names)


def _arms(classes: DataFrame, paths: str, least: float) -> DataFrame:
    """Stars (a, b) of classes that share a bucket along `paths` and whose embeddings agree."""
    sketches = classes.select("class", "sketch")
    leaves = buckets(classes.select(F.explode(F.array_distinct(paths)).alias("path"), "class", "part"), sketches)
    asked = saved(leaves.select("class").distinct(), "asked")
    members = leaves.join(by_ids(sketches, asked, "left_semi"), "class")
    keyed = in_blocks(members).repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    return keyed.select("path", "x", "y", "class", "sketch").mapInArrow(lambda b: _compare(b, least), "a long, b long")


def joined(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (uid, doc_id, class_id, n_links, component). `n_links` counts the other rows with a Jaccard
    similarity of at least `similarity`, copies included; `class_id` is the smallest id among the rows connected by
    such links, so a row's own id if it has none. `uid` is the number that `anchors.numbered` gives the row, and `component` is the
    `uid` of one row of the class: it tells classes apart where ids repeat. A NULL id stays NULL in `doc_id` and counts as
    2^63 - 1 in `class_id`."""
    return _joined(anchors.numbered(docs, id_col, text_col), similarity, target)


def _joined(rows: DataFrame, similarity: float, target: float) -> DataFrame:
    """`joined` of rows (uid, doc_id, text) with numbers that stay."""
    signed = saved(signatures(rows, runs_needed(similarity, target)), "signatures")
    classes = saved(
        signed.groupBy("low", "high", "size").agg(
            F.min("uid").alias("class"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min_by("bytes", "uid").alias("bytes"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"), F.first("later").alias("later")
        ),
        "classes",
    )
    first = saved(_arms(classes.withColumn("part", F.col("class")), "paths", similarity - MARGIN), "arms")
    known = saved(components(first).select(F.col("node").alias("class"), F.col("component").alias("part")), "first-groups")
    rest = classes.join(known, "class", "left").withColumn("part", F.coalesce("part", "class"))
    arms = _arms(rest, "later", similarity - MARGIN).unionByName(known.select(F.col("class").alias("a"), F.col("part").alias("b")))
    grouped = saved(components(arms).select(F.col("node").alias("class"), "component"), "candidates")

    sized = grouped.join(classes.select("class", "copies", "bytes"), "class")
    n, by_bytes = F.count("*"), F.ceil(F.sum("bytes") / BLOCK_BYTES)
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(n / BLOCK), F.least(n, by_bytes)).cast("int").alias("blocks"))
    wanted = sized.drop("bytes").join(blocks, "component")
    candidates = by_ids(rows.select(F.col("uid").alias("class"), "text"), grouped.select("class"), "left_semi")
    texts = candidates.join(wanted, "class")
    pairs = in_blocks(texts).repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    verified = saved(
        pairs.select("component", "x", "y", "own", "class", "copies", "text").mapInArrow(lambda b: _verify(b, similarity), "class long, links long, root long"), "verified"
    )
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(verified.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class"), "component")
    full = classes.select("low", "high", "size", "class", "least", "copies").join(links, "class", "left").join(group, "class", "left")
    full = full.withColumn("component", F.coalesce("component", "class"))
    smallest = full.groupBy("component").agg(F.min("least").alias("class_id"))
    known = full.join(smallest, "component").select(
        "low", "high", "size", "class_id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    found = signed.select("uid", "low", "high", "size").join(known, ["low", "high", "size"]).select("uid", "class_id", "n_links", "component")
    return (
        rows.select("uid", "doc_id")
        .join(found, "uid", "left")
        .select(
            "uid",
            F.when(F.col("doc_id") != 2**63 - 1, F.col("doc_id")).alias("doc_id"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "uid").alias("component"),
        )
    )


def representatives(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class left: that with the smallest id, then the first. All columns stay."""
    stored = storage.numbered(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "uid")
    rows = stored.select("uid", *anchors.keyed(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    found = saved(_joined(rows, similarity, TARGET).where("n_links > 0"), "linked")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.col("uid"))
    stays = found.groupBy("component").agg(F.min(order).alias("stays"))
    goes = saved(found.join(stays, "component").where("uid <> stays.uid").select("uid"), "goes")
    return by_ids(stored, goes, "left_anti").select("row.*")
