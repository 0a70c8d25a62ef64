import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, uid int, class string"


def prose(random_, words, n):
    return " ".join(random_.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text) with NULLs, empty and very long texts, repeated rows, copies and shared passages."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopéß") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    passage = prose(rnd, words, 60)
    base = prose(rnd, words, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(i, prose(rnd, words, rnd.randint(1, 200))) for i in range(40)]
    rows += [(100 + i, prose(rnd, words, 30) + " " + passage + " " + prose(rnd, words, 25)) for i in range(12)]
    rows += [(200, base), (201, base), (201, base), (202, " ".join(near)), (203, base.upper()), (204, base + " and more")]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "one"), (304, "one"), (305, "a b c d e"), (306, "x" * 5000), (307, "y " * 3000)]
    rows += [(308, "x" * 450), (309, prose(rnd, words, 30_000)), (None, base), (None, None), (310, "\x00 nul \x00"), (311, "😀 é " * 80)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts as documents, with columns whose names the operators use themselves."""
    rows = [(i, t, None, "s", 0, "clash", 7, "c") for i, t in odd_texts]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def stored_docs(odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    odd_docs.write.parquet(path)
    return odd_docs.sparkSession.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
