import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from concord.llm import jaccard_join
from concord.llm.components import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, similarity=0.8):
    """(doc_id, class_id, n_links) per row."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
        for i in range(n)
    ]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i]] + [label[j] for j in links[i]]) for i in range(n)]
    key = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {k: min(key[i] for i in range(n) if label[i] == k) for k in set(label)}
    return Counter((rows[i][0], least[label[i]], len(links[i])) for i in range(n))


def test_rows(stored_docs, odd_texts):
    got = jaccard_join.joined(stored_docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(tuple(r) for r in got) == brute(odd_texts)


def test_large_buckets_and_groups(spark, monkeypatch):
    """Many near copies of two texts, in small blocks and with buckets that are split."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "SPLIT", 12)
    rnd = np.random.default_rng(1)
    rows = []
    for g in range(2):
        words = [f"w{g}{i}" for i in range(60)]
        for i in range(30):
            own = list(words)
            own[int(rnd.integers(0, 60))] = f"x{g}{i}"
            rows.append((g * 100 + i, " ".join(own)))
    shared = "the same license line for every one of these texts"
    rows += [(1000 + i, shared + " " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    got = Counter(tuple(r) for r in jaccard_join.joined(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_groups_of_any_size_stay_whole():
    """Texts of one group that are over 2 GB together, in batches cut anywhere."""
    text = pa.array(["x" * (128 << 20)])
    batches = [pa.RecordBatch.from_arrays([pa.array([int(i > 17)]), text], ["key", "text"]) for i in range(19)]
    groups = [(g.column("key").to_pylist(), pc.sum(pc.binary_length(g.column("text"))).as_py()) for g in jaccard_join._keyed(iter(batches), ["key"])]
    assert groups == [([0] * 18, 18 * (128 << 20)), ([1], 128 << 20)]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 3, 3, 3]), pa.array(list("abcdef"))], ["key", "text"])
    for cuts in [[0, 6], [0, 1, 6], [0, 2, 3, 6], [0, 4, 5, 6], [0, 0, 1, 2, 3, 4, 5, 6]]:
        parts = iter([rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])])
        assert ["".join(g.column("text").to_pylist()) for g in jaccard_join._keyed(parts, ["key"])] == ["ab", "c", "def"]


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """Few but long near copies are dealt to more than one block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2_000)
    most, in_blocks = [], jaccard_join.in_blocks

    def watched(members):
        if "component" in members.columns:
            most.append(members.agg({"blocks": "max"}).first()[0])
        return in_blocks(members)

    monkeypatch.setattr(jaccard_join, "in_blocks", watched)
    rows = [(i, " ".join(f"w{k}" for k in range(300)) + f" x{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.joined(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows) and most == [9]  # 16,706 bytes


def test_representatives(stored_docs, odd_texts):
    left = jaccard_join.representatives(stored_docs)
    assert left.columns == stored_docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[200] == 1 and not {201, 202, 204, 304} & set(ids) and ids[303] == ids[309] == 1
    assert ids[None] == 1 and ids[300] == ids[301] == ids[302] == 1  # texts without words stay


def test_empty(no_docs):
    assert jaccard_join.joined(no_docs).count() == 0
    assert jaccard_join.representatives(no_docs).count() == 0


def test_components(spark):
    pairs = [(1, 2), (3, 2), (3, 9), (7, 8), (8, 8), (5, 5), *((100 + i, 101 + i) for i in range(30))]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, **{100 + i: 100 for i in range(31)}}


def test_exact_counts():
    sets = [{1, 2, 3}, {2, 3, 4, 5}, {9}, {1, 2, 3}]
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    both = jaccard_join.shared_shingles(flat, np.array([len(s) for s in sets]))
    assert both.tolist() == [[len(a & b) for b in sets] for a in sets]


@pytest.mark.parametrize("target", [0.9, 0.9999])
def test_runs(target):
    runs = jaccard_join.runs_needed(0.8, target, depth=1)
    miss = np.exp(-jaccard_join.BRANCHES * 0.8 * runs)
    assert miss <= 1 - target < miss * np.exp(jaccard_join.BRANCHES * 0.8) * 1.0001
