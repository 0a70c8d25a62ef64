import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.llm import decontaminate, language, pii, quality
from concord.llm.words import Texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- decontamination

def hits(rows, items, window):
    phrases: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            phrases.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for key, text in rows:
        w = WORD.findall(lower(text or ""))
        hit, found = [False] * len(w), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if own := phrases.get(tuple(w[k : k + size])):
                    found |= own
                    hit[k : k + size] = [True] * size
        out.append((key, len(w), sum(hit), ",".join(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_decontaminate(spark, odd_docs, odd_texts, slice_bytes):
    source = dict(odd_texts)
    items = [(1, source[100]), (2, " ".join(source[10].split()[:4])), (10, source[100]), (3, None), (4, ""), (5, "one"), (6, "never seen words"), (7, source[309][4000:4300]), (8, "Y y y y y y y y y y y y"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(odd_docs, bench, 10, slice_bytes=slice_bytes)
    assert found.columns == [*odd_docs.columns, "n_words", "spans", "items", "n_hit"]
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect())
    assert got == hits(odd_texts, items, 10)


def test_cleaned(spark):
    docs = spark.createDataFrame([(1, "Keep this. The Secret, passage of ten words in a row here now! And this.", "x"), (2, None, "y"), (3, "  as it was ", "z")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, "the secret passage of ten words in a row here now")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.cleaned(docs, bench, 10).collect()}
    assert out == {1: "Keep this. ! And this.", 2: None, 3: "  as it was "}
    assert decontaminate.cleaned(docs, bench).columns == docs.columns


def test_decontaminate_empty(spark, no_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(odd_docs, bench).where("n_hit > 0 OR size(items) > 0").count() == 0
    assert decontaminate.matches(no_docs, bench).count() == 0


def test_index_finds_every_occurrence():
    rnd = np.random.default_rng(4)
    text = rnd.integers(1, 5, 500)
    index = decontaminate.FMIndex(text, 5)
    for size in (1, 3, 6):
        table = np.array([text[i : i + size] for i in range(0, 400, 7)])
        low, high = index.search(table, np.full(len(table), size))
        for row, a, b in zip(table, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = (int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


ODD = [
    None, "", "é 😀 a@b.c_d@e.f@g.h x@y..z a.@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3.", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+49 (30) 123-45.67 + 5 +1 +12345678901234567 +4930123456", "a" * 3000, "1" * 3000, "1.1." * 1000, "+1 " + "(" * 2000, "x@y.z " * 700,
    "mail: jo@ex.org, card 4111111111111111.", "DE89 3704 0044 0532 0130 00 and DE88370400440532013000 GB82WEST12345698765432", "a@" * 2000, "@", "😀" * 30 + "+1 (234) 567-89-01",
]


def test_base_spans(spark, odd_texts):
    rnd = random.Random(8)
    noise = ["".join(rnd.choice("0123456789.-+ @aé()") for _ in range(400)) for _ in range(60)]
    rows = list(enumerate([*ODD, *(t for _, t in odd_texts), *noise]))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, pii string")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "text", "pii"]
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.kind != "iban"] for r in found.collect()}
    for i, text in rows:
        assert got[i] == spans(text), text[:80]


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a@" * 200_000, "x@y.z " * 20_000, "+" * 300_000, "A1" * 300_000, "1." * 300_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(len(texts))
    found = [r.n for r in pii.find(docs).select("text", F.size("pii").alias("n")).orderBy(F.length("text"), "text").collect()]
    assert sorted(found) == [0, 0, 0, 0, 0, 20_000, 75_000]


def test_checksums_and_context(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r.doc_id: r.pii for r in pii.find(docs).collect()}
    assert [(s.value, s.start) for s in got[12] if s.kind == "iban"] == [("DE89 3704 0044 0532 0130 00", 0), ("GB82WEST12345698765432", 55)]
    by_kind = {s.kind: s for s in got[11]}
    assert by_kind["email"].score == pii.SUPPORTED and by_kind["card"].score == pii.SUPPORTED
    assert got[4] == []  # one run of 32 digits
    assert {s.score for s in got[10]} == {pii.CONFIRMED}


def test_iban_before_a_capital(spark):
    """The word behind an IBAN is not part of it, however it is written."""
    texts = ["DE89370400440532013000 Bitte", "GB29NWBK60161331926819 Thanks", "DE89 3704 0044 0532 0130 00 Danke schön", "DE89370400440532013000 today"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.value, s.start) for s in r.pii if s.kind == "iban"] for r in pii.find(docs).collect()}
    assert got == {0: [(texts[0][:22], 0)], 1: [(texts[1][:22], 0)], 2: [(texts[2][:27], 0)], 3: [(texts[3][:22], 0)]}
    assert {r.text for r in pii.masked(docs).collect()} == {"[iban] Bitte", "[iban] Thanks", "[iban] Danke schön", "[iban] today"}


def test_masked(spark):
    docs = spark.createDataFrame([(1, "é jo@ex.org, 10.0.0.1 end", 3), (2, None, 0), (3, "clean", 5), (4, "+4111111111111111 x", 1)], "doc_id long, text string, n int")
    out = pii.masked(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "é [email], [ip] end" and got[2] is None and got[3] == "clean" and "4111111111111111" not in got[4]


def test_pii_runs_no_python(spark, odd_docs):
    plan = pii.masked(pii.find(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_empty(no_docs):
    assert pii.find(no_docs).count() == 0 and pii.masked(no_docs).count() == 0


# ---- language

EN, DE, RU = "the cat and the dog went over there with them", "der hund und die katze gehen dort hinüber mit", "кошка и собака пошли туда вместе с ними"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 6)), lang) for i in range(60) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]
    rows += [(900, None, "en"), (901, EN, None)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language(spark, model):
    rows = [(1, EN), (2, DE), (3, RU), (4, f"{EN}. {EN} {DE}"), (5, None), (6, ""), (7, "123 !? 4"), (8, "й"), (9, f"{EN} " * 4000), (1, EN)]
    out = language.predicted(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, score string, spans int"), model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[i].lang_pred for i in range(1, 10)] == ["en", "de", "ru", "en", "und", "und", "und", "ru", "en"]
    assert [(s.lang, s.first, s.end) for s in got[4].spans] == [("en", 0, 20), ("de", 20, 29)]
    assert got[5].score == got[7].score == 0 and got[1].score == 1 and 0.5 < got[4].score < 1


def test_viterbi_is_best():
    rnd = np.random.default_rng(1)
    count = np.array([5, 0, 1, 4])
    first = np.cumsum(count) - count
    score = rnd.normal(0, 2, (10, 3)).astype(np.float32)
    labels = language.viterbi(score, first, count, 1.5)
    from itertools import product

    def value(own, at):
        return sum(score[at + i, s] for i, s in enumerate(own)) - 1.5 * sum(a != b for a, b in zip(own, own[1:]))

    for at, n in zip(first, count):
        best = max(value(p, at) for p in product(range(3), repeat=int(n)))
        assert value(labels[at : at + n].tolist(), at) == pytest.approx(best, abs=1e-4)


def test_language_without_training(spark, no_docs):
    model = language.train(no_docs)
    assert [r.lang_pred for r in language.predicted(spark.createDataFrame([(1, EN)], "doc_id long, text string"), model).collect()] == ["und"]
    assert language.predicted(no_docs, model).count() == 0


def test_code_points():
    text = "aé漢😀z"
    point, at = language.code_points(np.frombuffer(text.encode(), np.uint8))
    assert point.tolist() == [ord(c) for c in text] and at.tolist() == [0, 1, 3, 6, 10]


# ---- quality

@pytest.fixture(scope="module")
def quality_rows():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    good = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 300))) for _ in range(150)]
    bad = [" | ".join(rnd.choice(words) for _ in range(rnd.randint(5, 300))) for _ in range(60)]
    return [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]


def test_quality(spark, quality_rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in quality_rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in quality_rows if i % 3] + [(1, 1 - quality_rows[1][2], 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.scored(docs, model, with_attention=True)
    assert out.columns == ["doc_id", "text", "label", "score", "attention"]
    rows = {r.doc_id: r for r in out.collect()}
    held = [(rows[i].score, q) for i, _, q in quality_rows if i % 3 == 0]
    assert all((s >= 0.3) == (q == 1) for s, q in held)
    assert all(abs(sum(r.attention) - 1) < 1e-6 for r in rows.values())
    odd = quality.scored(spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b " * 50_000), (4, "a b " * 50_000)], "doc_id long, text string"), model)
    scores = [r.score for r in odd.collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]


def test_quality_gradient():
    """Training lowers the loss, and few labels are no failure."""
    x, first = quality.passages(Texts(pa.array(["a b c", "d | e | f", "g h", "i | j"])))
    model = quality.fit(x.astype(float), first, np.array([1.0, 0, 1, 0]))
    p, _ = quality.score(model, x, first)
    assert p[0] > 0.5 > p[1] and p[2] > 0.5 > p[3]
    assert quality.score(quality.fit(x, first, np.ones(4)), x, first)[0].tolist() == [1.0] * 4


def test_quality_without_labels(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels)
    assert {r.score for r in quality.scored(odd_docs, model).select("score").collect()} == {0.5}
    assert quality.scored(no_docs, model).count() == 0


def test_quality_skips_texts_that_do_not_fit(spark):
    """One text beyond the budget of passages does not end the sample, wherever it comes."""
    docs = [(i, ("good plain words " if i % 2 else "BUY!!! $$$ 99 ") * 20) for i in range(20)]
    first = spark.range(20).orderBy(F.xxhash64("id")).first().id
    docs[first] = (first, "word " * 64 * 60)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.train(rows, labels, sample_passages=50).constant is None


def test_context_stands_before_or_behind(spark):
    texts = {
        "4111111111111111 (Visa)": [0.95], "visa 4111111111111111": [0.95], "4111111111111111 and nothing": [0.7],
        "4111111111111111" + " " * 30 + "visa": [0.7], "4111111111111111": [0.7],
        "x@a.de y@b.de, my mail": [0.7, 0.95], "4111111111111111 x 4111111111111111 visa": [0.7, 0.95],
    }
    found = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: [s.score for s in r.pii] for r in found} == texts
