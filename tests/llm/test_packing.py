import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from concord.llm import packing
from concord.llm.words import Texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_part_tokenizer_agrees_with_whole_texts():
    texts = ["", " ", "  two  spaces ", "a b", "don't stop  now", "x y z", "tab\t a\n\n b", "é è 😀 é", "<|endoftext|> a <|endoftext|>", "1 22 333,4", "a  b   c ", " lead", "trail "]
    plain = Tokenizer.from_file(PATH)
    ids, size = packing.PartTokenizer(PATH).encode(Texts(pa.array([*texts, None])))
    at = 0
    for text, n in zip([*texts, ""], size.tolist()):
        assert ids[at : at + n].tolist() == plain.encode(text, add_special_tokens=False).ids, text
        at += n


@pytest.mark.parametrize("capacity", [10, 37])
def test_fullest_is_fullest(capacity):
    rnd = np.random.default_rng(capacity)
    for _ in range(60):
        lengths = np.unique(rnd.integers(1, capacity + 1, 5))
        counts = rnd.integers(1, 4, len(lengths))
        sums = {int(lengths[-1])}
        for k, n in zip(lengths.tolist(), counts.tolist()):
            n -= k == lengths[-1]
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
        chosen = packing.fullest(lengths, counts, capacity)
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= dict(zip(lengths.tolist(), counts.tolist()))[k] for k, n in chosen.items())


def test_bins_place_every_piece_once():
    rnd = np.random.default_rng(0)
    counts = Counter(rnd.integers(1, 101, 3000).tolist())
    counts[50] += 5000
    plan = packing.bins(counts, 100)
    used: dict[int, int] = {}
    for r in plan.itertuples():
        assert r.lo == used.get(r.length, 0)
        used[r.length] = r.hi
    assert used == dict(counts)
    n = int((plan.first_bin + (plan.hi - plan.lo) // plan.per_bin).max())
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 100 + 1


def test_documents(spark, odd_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)  # ranks over several salts
    rows = packing.packed(odd_docs, PATH, 64).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for key, text in odd_texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        want.update((key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        placed.sort()
        assert [a for a, _ in placed] == np.cumsum([0, *(n for _, n in placed[:-1])]).tolist() and sum(n for _, n in placed) <= 64
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 64 + 1


def test_empty(no_docs):
    assert packing.packed(no_docs, PATH, 64).count() == 0


def test_parts_of_a_large_share_are_encoded_once(monkeypatch):
    """A cache of 500,000 parts was emptied again and again within one worker's share."""
    coder, seen = packing.PartTokenizer(public_tokenizers.path("byte_bpe_50k.json")), []

    def one_id_each(data, a, b):
        seen.append(len(a))
        return np.zeros(len(a), np.uint32), np.ones(len(a), np.int64)

    monkeypatch.setattr(coder, "_joined", one_id_each)
    monkeypatch.setattr(coder, "_single", one_id_each)
    for at in (*range(0, 600_000, 100_000), 0):
        coder.encode(Texts(pa.array([" ".join(f"w{i}" for i in range(at, at + 100_000))])))
    assert sum(seen) == 600_000
