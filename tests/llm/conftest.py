import random

import pytest


def prose(rng, n, words=400):
    return " ".join("the" if rng.random() < 0.05 else f"w{rng.randint(0, words)}" for _ in range(n))


def tiny_documents():
    """Rows with nulls, empties, copies, near copies, shared passages, ties and a long text."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    texts += [None, "", "   \n\t ", "one", "one two three", "Ünïcode ▁ \x00 🙂 text </s> [INST]"]
    texts += [texts[3], texts[3], texts[4].upper(), passage, passage + " " + prose(rng, 30), prose(rng, 30) + " " + passage]
    base = prose(rng, 300).split()
    for k in range(40):
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    texts += ["ab" * 150, "a" * 250, "word " * 5000, prose(rng, 20_000, 10**6), "é" * 120 + "\n" + "é" * 120]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[7], None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(tiny_documents(), SCHEMA)


@pytest.fixture(scope="session")
def odd_documents(spark, documents):
    """The same with columns whose names clash with results."""
    from pyspark.sql import functions as F

    names = "n_bytes n_words kept score h p row words l bands sketch set_id id comp key doc ranges tokens rate copies media payload spans label x t".split()
    return documents.select("*", *(F.lit("clash").alias(c) for c in names))


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of():
    return [(i, t or "") for i, t, *_ in tiny_documents()]
