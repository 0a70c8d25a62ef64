import hashlib
import random
import re
from collections import Counter

import pytest

from concord.llm import anchors, phrase_dedup, suffix_dedup


def test_suffix_array():
    rnd = random.Random(3)
    for trial in range(60):
        text = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 300)))
        if trial % 3 == 0:
            text = (text[: rnd.randint(1, 20)] * 60)[: len(text)]
        assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_cover_meets_every_pair():
    member, distance = suffix_dedup.difference_cover()
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            d = distance[a, b]
            assert d < suffix_dedup.PERIOD and member[(a + d) % suffix_dedup.PERIOD] and member[(b + d) % suffix_dedup.PERIOD]


def without_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def without_words(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


# A split of 1 sends every anchor with several segments the way of very frequent ones.
@pytest.mark.parametrize("split", [4_000, 1])
def test_bytes(stored_docs, odd_texts, split):
    got = Counter(tuple(r) for r in suffix_dedup.removed(stored_docs, 60, split=split).collect())
    assert got == without_bytes(odd_texts, 60)


@pytest.mark.parametrize("split", [4_000, 1])
def test_words(stored_docs, odd_texts, split):
    got = Counter(tuple(r) for r in phrase_dedup.removed(stored_docs, 20, split=split).collect())
    assert got == without_words(odd_texts, 20)


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a\n{passage}"), (2, f"{passage}  b c")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in phrase_dedup.removed(docs, 20, with_kept=True).collect()}
    assert kept == {1: f"a {passage}", 2: "b c"}
    left = {r.doc_id: bytes(r.kept) for r in suffix_dedup.removed(docs, 50, with_kept=True).collect()}
    assert left == {1: b"a\n", 2: b"  b c"}


def test_empty(no_docs):
    assert suffix_dedup.removed(no_docs).count() == 0 and phrase_dedup.removed(no_docs).count() == 0


def test_blocks_hold_whole_anchors():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"anchor": pa.array([1, 1, 2, 3, 3, 3, 4]), "content": pa.array([b"x" * 10] * 7)})
    out = list(anchors.blocks(iter([rows.slice(0, 2), rows.slice(2, 3), rows.slice(5)]), 25))
    seen = [set(b.column("anchor").to_pylist()) for b in out]
    assert sum(b.num_rows for b in out) == 7 and all(not (a & b) for a, b in zip(seen, seen[1:]))
