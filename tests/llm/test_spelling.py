import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import spelling

ASCII_LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def words_of(rows, least, times, loses):
    c = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % loses == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=5, times=3, loses=97):
    words = words_of(rows, least, times, loses)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(((-words[v], v) for v in vs), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(around[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def typos(seed, n=300):
    """Texts of few words with many misspellings, so that forms run over several steps."""
    rng = random.Random(seed)
    base = ["banana", "bananas", "cabana", "ananas", "éclair", "aaaaa", "aaaaaa", "bbbbbbbbbb"]
    out = []
    for i in range(n):
        ws = []
        for _ in range(rng.randrange(1, 12)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                p, c = rng.randrange(len(w) + 1), rng.choice("abné")
                w = rng.choice([w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]])
            ws.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "-", "1"]).join(ws)))
    return out


@pytest.mark.parametrize("least,loses", [(5, 97), (5, 3), (1, 5)])
def test_same_as_all_pairs(spark, least, loses):
    rows = [*typos(7), (None, "banana banane"), (3, None), (4, ""), (5, "x" * 400 + " " + "x" * 401)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    got = rows_of(spelling.group_variants(df, least=least, times=2, loses=loses))
    assert got == plain(rows * 2, least, 2, loses)
    assert any(r[1] and r[2] != r[1] for r in got)  # a form of a form


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=30, unique=True))
def test_edits_find_every_near_word_once(words):
    lexicon = spelling.Lexicon(words, np.ones(len(words), np.int64))
    alphabet, got = np.array([97, 98, 99], np.uint32), []
    for w in words:
        for m in (len(w) - 1, len(w), len(w) + 1):
            for side in (0, 1):
                found = [words[f] for _, f in spelling.edits([w], len(w), m, side, alphabet, lexicon)]
                half = m // 2
                assert all(v[:half] == w[:half] if side == 0 else v[half:] == (w[-(m - half) :] if m > half else "") for v in found if len(v) == m)
                got += [(w, v) for v in found if len(v) == m]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_odd_and_empty_tables(spark, odd, empty, docs, corpus):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(spelling.group_variants(odd, times=1)) == plain(rows, times=1)
    assert rows_of(spelling.group_variants(empty)) == []
    assert rows_of(spelling.group_variants(docs, times=1)) == plain(corpus, times=1)


def test_roots_of_a_long_chain(spark):
    n = 40
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
    from quillon.llm.shared import shared_dir

    got = {r["word"]: r["root"] for r in spelling.roots(forms, shared_dir(spark, "test")).collect()}
    assert got == {f"w{i}": f"w{n}" for i in range(n)}
