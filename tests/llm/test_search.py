import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bitsliced, learned_partitions

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# ---- bit-sliced search ------------------------------------------------------------


def ranked(docs, items, k):
    count = lambda text: Counter(x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(TERM, text or ""))
    have = [(i, c) for i, t in docs if (c := count(t))]
    n_docs, n_terms = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in have:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in count(text) if c[t])
            if score > 0:
                rows.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], math.inf if r["doc_id"] is None else r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(0, "The of CHANGED example license"), (1, None), (2, ""), (3, "nowhere2 else9"), (4, "ÀÉ ü 中文 字"), (5, "one two THREE twice"), (6, "a b c d x " * 50), (7, " ".join(f"w{i} the" for i in range(100)))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranks_as_plain_scoring(docs, corpus, items, k):
    assert found(bitsliced.rank_documents(docs, items[1], k=k)) == ranked(corpus, items[0], k)


def test_small_blocks_and_groups_of_queries(docs, corpus, items, monkeypatch):
    build = bitsliced.build_index
    monkeypatch.setattr(bitsliced, "build_index", lambda rows, folder: build(rows, folder, block_docs=3, block_postings=20))
    assert found(bitsliced.rank_documents(docs, items[1], group_pairs=20)) == ranked(corpus, items[0], 50)


def test_ties_repeats_and_clashing_columns(spark, odd, empty, items):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got, want = found(bitsliced.rank_documents(odd, items[1])), ranked(rows, items[0], 50)
    assert got == want and len({s for i, _, _, s in want if i == 5}) < sum(i == 5 for i, *_ in want)
    assert found(bitsliced.rank_documents(empty, items[1])) == []
    assert found(bitsliced.rank_documents(odd, items[1].limit(0))) == []
    twice = bitsliced.rank_documents(odd, items[1].filter("item_id = 5").unionAll(items[1].filter("item_id = 5")))
    assert len(found(twice)) == 2 * sum(i == 5 for i, *_ in want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 2000), st.integers(0, 40)), min_size=1, max_size=150), st.integers(1, 40))
def test_bit_arithmetic(rows, k):
    a, b, w = (list(c) for c in zip(*rows))
    slices = lambda xs: [sum((x >> d & 1) << i for i, x in enumerate(xs)) for d in range(max(xs).bit_length())]
    numbers = lambda s: [sum((x >> i & 1) << d for d, x in enumerate(s)) for i in range(len(rows))]
    assert numbers(bitsliced.added(slices(a), slices(b))) == [x + y for x, y in zip(a, b)]
    assert numbers(bitsliced.times(slices(a), w[0])) == [x * w[0] for x in a]
    want = sorted(((-x, i) for i, x in enumerate(a) if x > 0))[:k]
    assert sorted((-x, i) for i, x in bitsliced.best(slices(a), k)) == want


def test_slices_come_back(tmp_path):
    rng = np.random.default_rng(3)
    rows = sorted({(int(t), int(p)) for t, p in zip(rng.integers(0, 9, 400), rng.integers(0, 300, 400))})
    term, at = (np.array(c) for c in zip(*rows))
    impact = rng.integers(1, 1 << 20, len(rows))
    bitsliced.Block.write(str(tmp_path / "b"), np.arange(300), *bitsliced.slice_block(term, at, impact))
    block = bitsliced.Block(str(tmp_path / "b"))
    for t in range(10):
        s = block.slices(t)
        got = {i: x for i in range(300) if (x := sum((v >> i & 1) << d for d, v in enumerate(s)))}
        assert got == {int(p): int(x) for q, p, x in zip(term, at, impact) if q == t}


# ---- nearest neighbours --------------------------------------------------------------


def neighbours(rows, every=100, k=10):
    ok = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in ok), default=0)
    full = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in ok]
    out = {}
    for i, v in full:
        if i % every == 0:
            for j, u in full:
                if j != i:
                    d = float(np.sqrt(((u - v) ** 2).sum()))
                    out.setdefault(i, {})[j] = min(d, out.get(i, {}).get(j, math.inf))
    return sorted((i, r + 1, j, round(d, 9)) for i, near in out.items() for r, (d, j) in enumerate(sorted((d, j) for j, d in near.items())[:k]))


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_a_small_table_is_searched_whole(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (400, [0.0] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] + [0.0] * 5), (700, [float("inf")] * 6), (800, []), (None, [1.0] * 6)]
    rows += [(900, [1.0, 2.0]), (901, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (100, rows[100][1]), (902, rows[0][1]), (200, [9.0] * 6)]
    rows += [(1000 + i, [2.0] * 6) for i in range(30)]  # copies, two of them queries at most
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, node int, parts string, q int").repartition(4)
    got, index = learned_partitions.nearest_neighbours(df)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert index.router is None and answers(got) == neighbours(single)
    none, _ = learned_partitions.nearest_neighbours(df.limit(0))
    assert answers(none) == []


def test_parts_hold_the_neighbours(spark):
    """Clustered vectors: a query visits few parts, and finds what brute force does."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.5, (4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, index = learned_partitions.nearest_neighbours(df, every=20, part_rows=128)
    parts = index.router.layers["b1"].size
    assert parts >= 16 and index.probes <= parts // 4 and index.recall >= 0.95
    near = {}
    for q, _, v, _ in answers(got):
        near.setdefault(q, set()).add(v)
    hit = 0
    for q in range(0, 4000, 20):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(near[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(near) == 200 and hit / 2000 >= 0.9
    assert index.rows.count() == 4000


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (800, 8))
    pairs = [(np.full(5, i), near[near != i][:5]) for i, near, _ in learned_partitions.nearest(x, x, np.arange(800), 6)]
    a, b = (np.concatenate(c) for c in zip(*pairs))
    label = learned_partitions.balanced_parts(x, a, b, 8)
    assert np.bincount(label).tolist() == [100] * 8
    mixed = rng.permutation(label)
    assert (label[a] != label[b]).mean() < 0.75 * (mixed[a] != mixed[b]).mean()
