import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=5, size=60):
    """(doc_id, text): copies, near copies, shared passages, odd white space, empty and null."""
    rng = random.Random(seed)
    passage = words(rng, 45)
    texts = []
    for i in range(size):
        kind = i % 6
        if kind == 0 or not texts:
            body = words(rng, rng.randrange(1, 120))
        elif kind == 1:
            body = (rng.choice(texts) or "").split()
        elif kind == 2:
            body = (rng.choice(texts) or "").split()
            for _ in range(rng.randrange(1, 4)):
                if body:
                    body[rng.randrange(len(body))] = f"x{rng.randrange(9)}"
        elif kind == 3:
            body = words(rng, 30) + passage[rng.randrange(5) :] + words(rng, 10)
        elif kind == 4:
            once = words(rng, 25)
            body = once + words(rng, 3) + once
        else:
            body = words(rng, rng.randrange(0, 6))
        texts.append("".join(w + rng.choice([" ", "\n", " \t", "\x0b"]) for w in body))
    texts += ["", None, " \n ", "Ä ß x", "a", "A", "A  a"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A function that makes a documents table of (doc_id, text) pairs, with columns that clash
    with names used inside, and no order to rely on."""

    def make(rows):
        full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, None, "k", 7, "h") for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA + ", k string, digest int, label string")
        return df.repartition(3)

    return make
