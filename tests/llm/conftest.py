import random

import pytest

WORDS = "the of and to in is that for it was on are as with his they at be this have from or one had by".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, shared lines and passages, junk, odd and missing texts."""
    rng = random.Random(11)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgäéñ") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = "Licensed under an example license, Version 2.0."
    passage = prose(60)
    base = [prose(rng.randrange(60, 200)) for _ in range(12)]
    texts = [None, "", " ", "\n", "x", "a b c d", "A b C D", "  " + line.upper() + "\t", line]
    texts += [b + "\n" + line for b in base[:4]] + [b + "\n" + passage + "\n" + b[:30] for b in base[4:8]]
    for b in base[:6]:  # near copies: one word changed
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [b, b, " ".join(w)]
    texts += [("spam eggs " * 100).strip(), "!!! ### $$$ " * 30, "ÀÉ ü 中文 字 😀 🎉 " * 5, "a" * 5000, prose(9000)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


#: Names that operators use inside, as columns of the caller.
CLASH = ["n_lines", "key", "node", "kept", "_row", "w", "t1", "h", "spans", "score", "part", "curve", "n", "doc", "order", "k0"]


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Repeated rows, null keys and columns whose names clash."""
    rows = [(None, "one two three four five six"), (None, None), (3, "twice"), (3, "twice"), (3, "other"), *corpus[:14]]
    return spark.createDataFrame([(*r, *([1] * len(CLASH))) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASH))
