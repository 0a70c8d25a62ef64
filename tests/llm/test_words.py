"""Texts that collide in any polynomial hash modulo a power of two must not count as equal."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from concord.llm import anchors, decontaminate, jaccard_join, language, packing, phrase_dedup, suffix_dedup
from concord.llm.words import BASES, PRIMES, RunHash, Texts, Words, combined


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


ONE, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_hashes_differ():
    assert len(set(Words(Texts(pa.array([ONE, OTHER]))).hashes().tolist())) == 2
    assert all(pow(2, p - 1, p) == 1 for p in PRIMES) and all(b > 1 << 20 for b in BASES)


def test_hash_of_runs_is_that_of_its_values():
    values = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    run = RunHash(values)
    start = np.array([0, 5, 100, 7, 0])
    whole = run(start, start + 50)
    for s, h in zip(start.tolist(), whole.tolist()):
        assert RunHash(values[s : s + 50])(np.array([0]), np.array([50]))[0] == h
    assert run(np.array([3]), np.array([3]))[0] != run(np.array([3]), np.array([4]))[0]


def test_packing_keeps_the_ids_of_each(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [f"x {ONE} y", f"x {OTHER} y"]
    rows = packing.pieces(docs(spark, texts).repartition(1), path, with_ids=True).collect()
    for r in rows:
        assert list(r.ids) == plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]


def test_a_benchmark_word_is_not_found_in_another(spark):
    benchmark = spark.createDataFrame([("i", ONE)], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.matches(docs(spark, [f"see {OTHER} here", f"see {ONE} here"]), benchmark).collect()}
    assert found == {0: 0, 1: 1}


def test_a_passage_that_occurs_once_stays(spark):
    head = " ".join(f"w{i}" for i in range(19))
    rows = {r.doc_id: r for r in phrase_dedup.removed(docs(spark, [f"{head} {ONE}", f"{head} {OTHER}", f"{head} {ONE}"]), 20).collect()}
    assert [rows[i].n_removed for i in range(3)] == [0, 0, 20]


def test_shingles_differ(spark):
    head = "one two three four "
    rows = {r.doc_id: r for r in jaccard_join.joined(docs(spark, [head + ONE, head + OTHER, head + ONE])).collect()}
    assert rows[0].class_id == rows[2].class_id != rows[1].class_id
    assert [rows[i].n_links for i in range(3)] == [1, 0, 1]


@pytest.mark.parametrize("length", [200, 1024])
def test_bytes_that_recur(spark, length):
    rnd = np.random.default_rng(3)
    noise = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 700)) for _ in range(4)]
    texts = [noise[0] + ONE + noise[1], noise[2] + OTHER + noise[3], noise[1] + noise[0], "z" * 600, None]
    rows = {r.doc_id: r for r in suffix_dedup.removed(docs(spark, texts), length).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    for d, t in enumerate(raw):
        kept = bytes(b for b, g in zip(t, gone[d]) if not g)
        assert (rows[d].n_removed, rows[d].kept_sha256) == (int(gone[d].sum()), hashlib.sha256(kept).hexdigest())


def test_common_prefixes():
    text = np.frombuffer(b"abcdefghijklmnop" * 3 + b"abcdefghijkXmnop", np.uint8)
    a, b = np.array([0, 0, 1, 5]), np.array([16, 48, 17, 6])
    for length in (1, 7, 8, 11, 12, 15):
        want = [bytes(text[x : x + length]) == bytes(text[y : y + length]) for x, y in zip(a, b)]
        assert suffix_dedup.agree(text, a, b, length).tolist() == want


def test_packed_ranks():
    rnd = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 50, n)
        tree = decontaminate.WaveletTree(symbols, 6)
        symbol, place = rnd.integers(0, 50, 200), rnd.integers(0, n + 1, 200)
        assert tree.rank(symbol, place).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(symbol, place)]


def test_hundreds_of_languages():
    rnd = np.random.default_rng(5)
    score = rnd.normal(size=(40, 300)).astype(np.float32)
    labels = language.viterbi(score, np.array([0, 25]), np.array([25, 15]), 0.0)
    assert labels.tolist() == score.argmax(1).tolist() and labels.max() > 127


def test_blocks_hold_whole_anchors():
    rows = [(a, bytes([65 + a]) * 50) for a in (1, 1, 1, 1, 2, 3, 3, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([c])], ["anchor", "content"]) for a, c in rows]
    got = [b.column("anchor").to_pylist() for b in anchors.blocks(iter(batches), 100)]
    assert sum(got, []) == [a for a, _ in rows]
    assert all(set(x).isdisjoint(y) for i, x in enumerate(got) for y in got[i + 1 :])


def test_blocks_beyond_two_gigabytes():
    one = pa.array(["x" * (1 << 27)])
    batches = [pa.RecordBatch.from_arrays([pa.array([7]), one], ["anchor", "content"]) for _ in range(17)]
    (whole,) = anchors.blocks(iter(batches), 1 << 20)
    assert whole.num_rows == 17 and whole.column("content").type == pa.large_string()
    assert combined(batches[:1]).num_rows == 1
