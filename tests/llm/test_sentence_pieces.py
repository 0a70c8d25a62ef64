import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from concord.llm import sentence_pieces
from concord.llm.queries import QUERIES
from concord.llm.words import Texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", " a", "a ", "  two  spaces  ", "▁", " ▁ a▁", "tab\tand\nline", "\x00 nul \x00", "𝔘nicode 🧪🏽 中文 ﬁne Ｆｕｌｌ",
    "é ́", "¨ 　  x ", "한국어 각", "½ ² ㎏ ㍿", "<s> </s> <unk> <0x41>", "x" * 3000, "é " * 2000, "​­﻿zero", "ﷺ",
]


def model(tmp_path, name="own", **changes):
    """The given model with another normaliser."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    pieces = changes.pop("user_defined", [])
    rules = changes.pop("rules", None)
    for key, value in changes.items():
        spec = proto.trainer_spec if key in ("treat_whitespace_as_suffix", "byte_fallback") else proto.normalizer_spec
        setattr(spec, key, value)
    if rules:
        own = sentencepiece_model_pb2.NormalizerSpec()
        own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_normalizer_spec())
        assert len(own.precompiled_charsmap) > 1000
        proto.normalizer_spec.precompiled_charsmap = own.precompiled_charsmap
    if not proto.trainer_spec.byte_fallback:
        for piece in proto.pieces:
            if piece.type == piece.BYTE:
                piece.type = piece.UNUSED
    for k, text in enumerate(pieces):
        proto.pieces[1000 + k].piece, proto.pieces[1000 + k].type = text, sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    path = tmp_path / f"{name}.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def random_texts(seed, n=300):
    rnd = random.Random(seed)
    letters = "aab  bé́ßﬁ中Ａ　▁ \t½🧪가가¨X"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"rules": "nmt_nfkc"},
        {"rules": "nmt_nfkc", "remove_extra_whitespaces": True},
        {"rules": "nfkc_cf", "remove_extra_whitespaces": True, "add_dummy_prefix": False},
        {"remove_extra_whitespaces": True, "treat_whitespace_as_suffix": True},
        {"escape_whitespaces": False},
        {"user_defined": ["a b", "¨ X", "ﬁ中"], "rules": "nmt_nfkc"},
        {"byte_fallback": False, "rules": "nmt_nfkc", "remove_extra_whitespaces": True},
    ],
    ids=str,
)
def test_same_as_library(tmp_path, changes):
    path = model(tmp_path, **changes)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + random_texts(3)
    found = sentence_pieces.Encoder(path).encode(Texts(pa.array(texts)), False, False)
    for i, text in enumerate(texts):
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        own = slice(found.first[i], found.last[i])
        assert list(zip(found.ids[own].tolist(), found.begins[own].tolist(), found.ends[own].tolist())) == want, repr(text)


def test_malformed_bytes():
    raw = [b"ab\xff\xfec", b"\xe4\xb8", b"\xadx", "é".encode(), b"\xed\xa0\x80", b""]
    found = sentence_pieces.Encoder(MODEL).encode(Texts(pa.array(raw, pa.binary())), False, False)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in enumerate(raw):
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        own = slice(found.first[i], found.last[i])
        assert list(zip(found.ids[own].tolist(), found.begins[own].tolist(), found.ends[own].tolist())) == want


def test_documents(spark, odd_docs, odd_texts, no_docs):
    rows = sentence_pieces.encoded(odd_docs, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(i), tuple(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in odd_texts)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    texts = {}
    for i, t in odd_texts:
        texts.setdefault(i, set()).add(t or "")
    for r in rows:
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(list(r.ids)) and (r.decoded in texts[r.doc_id] or r.doc_id == 302)
        # Spans follow on one another and cover the text.
        assert r.begins[0] == 0 and r.begins[1:] == r.ends[:-1] and r.ends[-1] in {len(t.encode()) for t in texts[r.doc_id]}
    assert sentence_pieces.encoded(no_docs, MODEL).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_sentence_pieces"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_offsets_in_spark(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld 🧪")], "doc_id long, text string")
    row = sentence_pieces.encoded(docs, MODEL, begin=False, end=False).select(F.arrays_zip("begins", "ends").alias("s")).first()
    raw = "Hello  wörld 🧪".encode()
    assert b"".join(raw[a:b] for a, b in row.s) == raw
