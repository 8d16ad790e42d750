import random

import pytest

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Été", "straße", "日本語"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, long texts."""
    rng = random.Random(5)
    base, passage = [prose(rng, rng.randint(1, 300)) for _ in range(40)], prose(rng, 120)
    texts = list(base)
    texts += [base[i] for i in (3, 3, 7)]  # exact copies
    for i in range(12):  # near copies
        w = base[20].split(" ")
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 50)} {passage} {prose(rng, 60)}" for _ in range(9)]
    texts += [None, "", "   \n\t ", "one", "One", "a b c d e", "A B C D E", "x" * 3000, "ab" * 1200, ("line again\n") * 200, prose(rng, 20_000), "é" * 500, "   nbsp"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts as a table with extra columns whose names operators use themselves."""
    rows = [(i, t, "xx" if i % 2 else None, "s", None if t is None else len(t), i, "b", 1.0) for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, _spans string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
