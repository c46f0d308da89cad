import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "ran tel mis vor dun sat lek".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, repeated rows, nulls, empty and very long texts, ties."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([3, 12, 60, 200]))) for i in range(60)]
    base = prose(rng, 120)
    rows += [(100 + i, base) for i in range(8)]
    for i in range(12):
        w = base.split(" ")
        for k in rng.sample(range(len(w)), 3):
            w[k] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "one"), (304, "ONE"), (305, "a b c d"), (306, "A B C D"), (None, "some text without an id"), (None, None)]
    rows += [(400, prose(rng, 30_000)), (401, "x" * 50_000), (402, "word " * 20_000), (5, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns, some named as results are."""
    extra = [(i, t, "en", "src", len(t) if t is not None else None, 1.5, "mine", 7) for i, t in corpus]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, rep int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
