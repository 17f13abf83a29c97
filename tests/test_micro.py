"""Hand-computed cases of the ranking operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import evaluation as E
from quillon.operators import factors, fusion, ranking, recall, rerank
from quillon.operators import history as H


def hist(spark, rows):
    """rows: (user, item, ts); all rated 9."""
    return H.history(spark.createDataFrame([(u, i, 9, t) for u, i, t in rows], "user_id long, item_id long, rating int, ts long"))


@pytest.fixture(scope="module")
def two(spark):  # u1: [a, b], u2: [a, b, c]
    return hist(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3)])


def edges(df):
    return {(r[0], r[1]): r.score for r in df.collect()}


def test_itemcf(two):
    e = edges(recall.itemcf(two))
    assert e[1, 2] == e[2, 1] == pytest.approx((0.5 + 1 / math.log2(5)) / 2, abs=1e-8)
    assert e[1, 3] == pytest.approx((1 / math.log2(5)) / math.sqrt(2), abs=1e-8)


def test_swing_and_seqcf(two):
    assert edges(recall.swing(two))[1, 2] == pytest.approx((1 / 7 + 1 / 8) / 4**0.25, abs=1e-8)
    e = edges(recall.seqcf(two.filter("user_id = 2"), window=1))
    assert e[1, 2] == pytest.approx(1 / math.log2(5), abs=1e-8) and (1, 3) not in e and (2, 1) not in e


def test_caps_bind(spark):
    h = hist(spark, [(1, i, i) for i in range(12)] + [(u, 0, 50) for u in range(2, 9)])
    assert {k for k in edges(recall.itemcf(h, cap=3)) if k[0] == 11} == {(11, 9), (11, 10)}
    pairs = {tuple(sorted(k)) for k in edges(recall.usercf(h, cap=4))}
    assert len(pairs) == 6
    assert len(edges(recall.itemcf(h, k=2)).keys()) == 24


def lists(spark):
    return fusion.channels(
        a=spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "user_id long, item_id long, rank long"), b=spark.createDataFrame([(1, 20, 1)], "user_id long, item_id long, rank long")
    )


def test_weighted_rrf(spark):
    got = {r.item_id: (r.score, r.channel) for r in fusion.weighted_rrf(lists(spark), {"a": 2.0, "b": 1.0}).collect()}
    assert got[10] == (pytest.approx(2 / 61, abs=1e-9), "a") and got[20] == (pytest.approx(2 / 62 + 1 / 61, abs=1e-9), "a")
    assert {r.item_id for r in fusion.weighted_rrf(lists(spark), {"b": 1.0}).collect()} == {20}
    assert {r.item_id for r in fusion.weighted_rrf(lists(spark), {"b": 0.0}, missing=1.0).collect()} == {10, 20}


def test_merges(spark):
    rows = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "user_id long, item_id long, rank long")
    both = fusion.channels(x=rows([1, 2, 3]), y=rows([4, 5, 6]))
    order = lambda df: [r.item_id for r in df.orderBy("rank").collect()]
    assert order(fusion.snake_merge(both)) == [1, 6, 2, 5, 3, 4]
    assert order(fusion.round_robin(both)) == [1, 4, 2, 5, 3, 6]


def test_tower_profiles():
    p = fusion.tower_profiles()
    assert len(p) == 1 + 12 + 56 and p[0] == fusion.HYBRID_RECALL and p[1]["user_tower"] == 0.5 and p[12]["user_tower"] == 10.0
    first = {"itemcf": 1.5, "usercf": 1.0, "seqcf": 1.1, "ease": 1.0, "user_tower": 1.0, "swing": 0.7, "genre": 0.2, "content": 0.1, "popular": 0.02}
    assert p[13] == first and p[-1]["user_tower"] == 10.0 and p[-1]["ease"] == 1.5


def test_weight_grid():
    p = fusion.weight_profiles()
    assert len(p) == 4 + 324 and p[4]["itemcf"] == 1.6 and p[-1] == {"seqcf": 1.1, "popular": 0.05, "itemcf": 2.4, "usercf": 1.8, "ease": 1.6, "swing": 1.3, "genre": 0.5, "content": 0.3}


@pytest.mark.parametrize(("n", "test"), [(4, 0), (5, 1), (7, 1), (8, 2), (13, 3)])
def test_time_split(spark, n, test):
    s = E.time_split(hist(spark, [(1, i, i) for i in range(n)]))
    assert s.filter("part = 'test'").count() == test and (n < 5) == (s.count() == 0)


def test_ndcg_and_auc(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "user_id long, item_id long, rank long")
    m = E.list_metrics(recs, spark.createDataFrame([(1, 20)], "user_id long, item_id long"), (2,)).first()
    assert m.ndcg == pytest.approx(1 / math.log2(3), abs=1e-8) and (m.recall, m.precision, m.hit_rate, m.coverage) == (1.0, 0.5, 1.0, 2)
    preds = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 0, 0.5), (1, 3, 0, 0.1), (2, 1, 1, 0.9)], "user_id long, item_id long, label int, pred double")
    assert E.auc(preds).first().auc == pytest.approx((1.5 + 2) / 4) and E.gauc(preds).first().gauc == pytest.approx(0.75)


def waits(keys, run, free, alike):
    """The rule of the dispersion, item by item."""
    if len(keys) <= run:
        return list(range(len(keys)))
    placed, waiting = [], []
    fits = lambda i: len(placed) < run or free(keys[i]) or any(not alike(keys[i], keys[j]) for j in (placed[-(run - 1) :] if run > 1 else []))
    for i in range(len(keys)):
        if not fits(i):
            waiting.append(i)
            continue
        placed.append(i)
        for j in reversed(waiting[:]):
            if fits(j):
                placed.append(j)
                waiting.remove(j)
    return placed + waiting


def orders(spark, lists, kind, run):
    column, of = ("genres", lambda k: None if k is None else [k, "z"]) if kind == "genre" else ("year", lambda k: k)
    rows = [(u, 100 * u + i, float(-i), i + 1, of(k)) for u, keys in enumerate(lists) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, f"user_id long, item_id long, score double, rank long, {column} " + ("array<string>" if kind == "genre" else "int")).repartition(3)
    out = (rerank.disperse_genres if kind == "genre" else rerank.disperse_decades)(df, run)
    assert out.schema.names == df.schema.names
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.user_id, r["rank"])):
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id % 100))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    return [[x[1] for x in got[u]] for u in range(len(lists))]


def test_dispersion(spark):
    assert orders(spark, [list("AAAB"), list("AA"), ["A"]], "genre", 2) == [[0, 1, 3, 2], [0, 1], [0]]
    assert orders(spark, [[1990, 1991, 1992, 1999, 2000], [1500] * 4], "decade", 3) == [[0, 1, 2, 4, 3], [0, 1, 2, 3]]


@pytest.mark.parametrize("run", [1, 2, 3, 4])
def test_dispersion_is_the_rule(spark, run):
    rng = np.random.default_rng(run)
    genres = [[("A", "A", "B", "C", None)[k] for k in rng.integers(0, 5, rng.integers(1, 21))] for _ in range(120)]
    assert orders(spark, genres, "genre", run) == [waits(g, run, lambda k: k is None, lambda a, b: b is not None and a == b) for g in genres]
    years = [[(1990, 1995, 2003, 1700, None)[k] for k in rng.integers(0, 5, rng.integers(1, 21))] for _ in range(120)]
    assert orders(spark, years, "decade", run) == [waits([0 if y is None else y // 10 for y in g], run, lambda d: not 190 <= d <= 210, lambda a, b: a == b) for g in years]


def test_bins(spark):
    row = spark.range(1).select(
        S.bin_avg_rating(F.lit(3.25)), S.bin_avg_rating(F.lit(3.75)), S.bin_avg_rating(F.lit(0.0)), S.bin_avg_rating(F.lit(None).cast("double")), S.bin_avg_rating(F.lit(float("nan"))),
        S.bin_rating_deviation(F.lit(-0.2)), S.bin_year(F.lit(1994)), S.bin_year(F.lit(1949)), S.bucket_age(F.lit("x")), S.bucket_age(F.lit("50")), F.round(S.ucb(F.lit(5), F.lit(32)), 6),
    ).first()
    assert list(row) == ["3.0", "4.0", "Unknown", "Unknown", "Unknown", "0.0", "1990s", "pre-1950", "unknown", "50-55", 7.757228]


def test_text_functions(spark):
    row = spark.range(1).select(
        S.clean_title(F.lit("Heat (1995)")), S.title_year(F.lit("Heat (1995)")), S.title_year(F.lit("Heat")), S.as_int(F.lit("\\N")), S.as_int(F.lit("7.9")), S.safe_int(F.lit("bad")),
        F.array_join(S.split_list(F.lit(" a | b,,c")), "/"), F.array_join(S.array_literal(F.lit('{a,"b c", d}')), "/"), F.array_join(S.split_ids(F.lit("x,\\N, y")), "/"),
    ).first()
    assert list(row) == ["Heat", 1995, None, None, 7, 0, "a/b/c", "a/b c/d", "x/y"]
    assert S.parse_weights("a=1, b=2,c,d=x,a=3") == {"a": 3.0, "b": 2.0}


def test_negatives(spark):
    pos = spark.createDataFrame([(1, 0), (2, 0)], "user_id long, item_id long")
    rated = spark.createDataFrame([(1, i) for i in range(36)] + [(2, 0)], "user_id long, item_id long")
    items = spark.createDataFrame([(i,) for i in range(40)], "item_id long")
    got = ranking.sample_negatives(pos, rated, items).collect()
    by = {u: sorted(r.negative for r in got if r.user_id == u) for u in (1, 2)}
    assert by[1] == [36, 37, 38, 39] and len(set(by[2])) == 4 and 0 not in by[2]


def test_negatives_of_users_who_have_nearly_everything(spark):
    """Every free item is as likely, no item comes twice, and all are taken where they are few."""
    n, users = 40, 500
    free = lambda u: {(7 * u + 5 * j) % n for j in range(6)} if u < users else {3, 4} if u == users else set()
    rated = [(u, i) for u in range(users + 2) for i in range(n) if i not in free(u)]
    df = spark.createDataFrame(rated, "user_id long, item_id long").repartition(3)
    positive = df.filter("item_id % 4 = 0")
    got = ranking.sample_negatives(positive, df, spark.createDataFrame([(i,) for i in range(n)], "item_id long"), draws=1).collect()
    by = {}
    for r in got:
        by.setdefault((r.user_id, r.item_id), []).append((r.pick, r.negative))
    assert set(by) == {(u, i) for u, i in rated if i % 4 == 0 and u <= users}
    count = np.zeros(6)
    for (u, _), picks in by.items():
        want = min(4, len(free(u)))
        assert sorted(p for p, _ in picks) == list(range(1, want + 1)) and len({x for _, x in picks}) == want and {x for _, x in picks} <= free(u)
        if u < users:
            for _, x in picks:
                count[sorted(free(u)).index(x)] += 1
    share = count / count.sum()
    assert abs(share - 1 / 6).max() < 0.012


def test_free_stretches(spark):
    taken = spark.createDataFrame([(1, p) for p in (0, 1, 4, 9)] + [(2, 5)] + [(3, p) for p in range(10)], "user_id long, place long")
    got = sorted(tuple(r) for r in ranking.free_stretches(taken, 10).select("user_id", "lo", "hi", "before").collect())
    assert got == [(1, 0, 2, 2), (1, 2, 6, 3), (2, 0, 5, 0), (2, 5, 9, 1)]


def test_numbers_within_a_group_that_spans_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 2 else f"g{rng.integers(0, 30)}" if i % 6 else None, int(x), i) for i, x in enumerate(rng.integers(0, 300, 3000))]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    out = H.numbered_within(df, ["g"], F.desc("x"), F.col("i"), name="r").cache()
    assert out.columns == ["g", "x", "i", "r"]
    want, place = {}, {}
    for g, x, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        place[g] = place.get(g, 0) + 1
        want[i] = place[g]
    assert {r.i: r.r for r in out.collect()} == want


def test_deepfm_gradient():
    rng = np.random.default_rng(0)
    model = ranking.DeepFM(("a", "b", "c"), [3, 4, 2], embed=3, hidden=(5, 4), dropout=0.0)
    x, y = np.stack([rng.integers(0, n, 20) for n in (3, 4, 2)], 1), rng.integers(0, 2, 20).astype(float)
    p = model.init()
    p["linear"] += rng.normal(size=p["linear"].shape)
    run = lambda: model.gradient(p, x, y, np.random.default_rng(1))
    _, g = run()
    for k, v in g.items():
        if isinstance(v, tuple):
            g[k] = np.zeros_like(p[k])
            np.add.at(g[k], v[0], v[1])
    for k, at in (("bias", (0,)), ("linear", (2, 0)), ("embed", (4, 1)), ("w0", (3, 2)), ("scale0", (1,)), ("shift1", (3,)), ("w1", (4, 1)), ("out", (2, 0))):
        old = p[k][at]
        p[k][at] = old + 1e-5
        up = run()[0]
        p[k][at] = old - 1e-5
        assert g[k][at] == pytest.approx((up - run()[0]) / 2e-5 / 20, abs=1e-6), k
        p[k][at] = old


def test_deepfm_learns_in_several_tasks(spark):
    """A click rule of two features: the held-out loss falls, and predictions tell clicks from others."""
    rng = np.random.default_rng(1)
    rows = [(i, *(int(v) for v in c), int((c[0] + c[1]) % 2 == 0)) for i, c in enumerate(rng.integers(0, 6, (1500, 3)))]
    df = spark.createDataFrame(rows, "i long, a long, b long, c long, click int")
    for tasks in (1, 2):
        model = ranking.DeepFM(("a", "b", "c"), [6, 6, 6], embed=8, hidden=(16, 8), dropout=0.1)
        losses = model.fit(df, ("i",), held=F.col("i") % 10 == 0, epochs=25, batch=64, rate=0.01, tasks=tasks)
        assert min(losses) < 0.25 < losses[0]
        pred = model.predict(df.filter("i % 10 = 0"), keep=("i", "click")).collect()
        assert len(pred) == 150 and np.mean([(r.pred > 0.5) == (r.click == 1) for r in pred]) > 0.95


def test_training_samples(spark):
    ratings = spark.createDataFrame([(u, i, 9 if i % 2 else 3, 1000 * i) for u in range(4) for i in range(u, 12)], "user_id long, item_id long, rating int, ts long")
    users = spark.createDataFrame([(u, "F", 20, "x", "1") for u in range(4)], "user_id long, gender string, age int, occupation string, zip_code string")
    items = spark.createDataFrame([(i, ["g"], 1990, 7.5, 10.0, i % 2) for i in range(40)], "item_id long, genres array<string>, year int, imdb_rating double, imdb_votes double, is_adult int")
    rows = ranking.training_samples(ratings, users, items).collect()
    rated = {(r.user_id, r.item_id): r.rating for r in ratings.collect()}
    assert sum(r.rating > 0 for r in rows) == len(rated) and all(rated[r.user_id, r.item_id] == r.rating for r in rows if r.rating)
    drawn = [(r.user_id, r.item_id) for r in rows if not r.rating]
    assert len(drawn) == 4 * sum(v >= 8 for v in rated.values()) and not set(drawn) & set(rated)
    assert all(r.click == (r.rating >= 8) and r.is_adult == str(r.item_id % 2) for r in rows)
    assert set(ranking.USER_FEATURES + ranking.ITEM_FEATURES) <= set(rows[0].asDict()) and len(ranking.USER_FEATURES + ranking.ITEM_FEATURES) == 17


def test_fm_term(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0)), F.array(F.lit(0.5), F.lit(4.0)))
    m = np.array([[1, 2], [3, -1], [0.5, 4]])
    assert spark.range(1).select(ranking.fm_term(v)).first()[0] == pytest.approx(0.5 * ((m.sum(0) ** 2) - (m**2).sum(0)).sum())


def test_user_vector_and_padding(spark):
    v = {1: np.array([1.0, 0.0]), 2: np.array([0.0, 1.0])}
    assert factors.user_vector([1], v, 2).tolist() == [1.0, 0.0]
    assert factors.user_vector([9], v, 2).tolist() == factors.user_vector([9], v, 2).tolist()
    row = spark.range(1).select(H.left_pad(F.array(F.lit(5).cast("long")), 3), H.left_pad(F.sequence(F.lit(1), F.lit(5)).cast("array<long>"), 3)).first()
    assert list(row) == [[0, 0, 5], [3, 4, 5]]


def test_recall_never_returns_seen_items(spark, two):
    recs = recall.by_edges(two, recall.itemcf(two), two, cap=50, rate=0.05, k=10)
    assert {(r.user_id, r.item_id) for r in recs.collect()} == {(1, 3)}
    pop = recall.by_popularity(two.select("user_id").distinct(), recall.popularity(two), two, k=5).collect()
    assert {(r.user_id, r.item_id) for r in pop} == {(1, 3)}


def test_numbering_with_few_ranges(spark):
    """More rows than a range's sample looks at: numbers are dense and in order."""
    n = 50_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"), (F.col("id") % 3).alias("w"))
    got = [(r.v, r["rank"]) for r in H.numbered(rows, F.desc("w"), F.col("v")).orderBy("rank").collect()]
    want = sorted(((i % 3, (i * 7919) % n) for i in range(n)), key=lambda x: (-x[0], x[1]))
    assert [r for _, r in got] == list(range(1, n + 1)) and [v for v, _ in got] == [v for _, v in want]
    assert H.numbered(rows.limit(0), F.col("v")).count() == 0


def _tower_batch(rng, n=12, items=9, users=4):
    p = {"input": rng.normal(size=(items, 5)), "item": rng.normal(size=(items, 5)), "user": rng.normal(size=(users, factors.PROFILE_DIM))}
    p |= {c: rng.normal(size=(3, factors.PROFILE_DIM)) for c in factors.PROFILE}
    width = 5 + factors.PROFILE_DIM * 4
    p |= {"w0": rng.normal(size=(width, 6)) / 4, "b0": rng.normal(size=6), "w1": rng.normal(size=(6, 5)), "b1": rng.normal(size=5)}
    return p, (rng.integers(0, items, (n, 4)), rng.integers(1, 5, n), rng.integers(0, users, n), rng.integers(0, 3, (n, 3)), rng.integers(0, items, n))


def test_tower_gradient():
    p, batch = _tower_batch(np.random.default_rng(2))
    _, g = factors.tower_gradient(p, *batch)
    for k, x in g.items():
        if isinstance(x, tuple):
            g[k] = np.zeros_like(p[k])
            np.add.at(g[k], x[0], x[1])
    for k, at in (("input", (3, 1)), ("item", (2, 4)), ("user", (1, 3)), ("gender", (0, 2)), ("occupation", (2, 7)), ("w0", (7, 2)), ("b0", (1,)), ("w1", (3, 3)), ("b1", (4,))):
        old = p[k][at]
        p[k][at] = old + 1e-5
        up = factors.tower_gradient(p, *batch)[0]
        p[k][at] = old - 1e-5
        assert g[k][at] == pytest.approx((up - factors.tower_gradient(p, *batch)[0]) / 2e-5, abs=1e-6), k
        p[k][at] = old


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_softmax_in_blocks(monkeypatch, scale):
    """Pieces and blocks of a few numbers, small and large logits, repeated targets: as the plain softmax, in four and eight bytes."""
    rng = np.random.default_rng(6)
    u, items, target = rng.normal(size=(13, 5)) * scale, rng.normal(size=(29, 5)), rng.integers(0, 7, 13)
    z = u @ items.T
    e = np.exp(z - z.max(1, keepdims=True))
    d = e / e.sum(1, keepdims=True)
    loss = -np.log(d[np.arange(13), target]).sum()
    d[np.arange(13), target] -= 1
    for piece, cached in ((1 << 24, 1 << 17), (100, 12), (1, 1)):
        monkeypatch.setattr(factors, "_SOFTMAX", piece)
        monkeypatch.setattr(factors, "_CACHED", cached)
        for kind, near in ((np.float64, 1e-9), (np.float32, 1e-3)):
            got = factors.softmax_gradient(u.astype(kind), items.astype(kind), target)
            assert got[0] == pytest.approx(loss, rel=1e-4 if kind is np.float32 else 1e-9)
            assert got[1].dtype == got[2].dtype == kind
            assert np.abs(got[1] - d @ items).max() < near * 5 and np.abs(got[2] - d.T @ u).max() < near * 5 * scale


def test_user_tower_learns_what_comes_next(spark):
    """Users walk along rings of items: the loss falls, and held-out steps are found far more often than by popularity."""
    rng = np.random.default_rng(5)
    walks = [[int(ring * 10 + (start + i) % 10) for i in range(9)] for ring, start in zip(rng.integers(0, 4, 120), rng.integers(0, 10, 120))]
    h = hist(spark, [(u, x, i) for u, w in enumerate(walks) for i, x in enumerate(w[:-1])])
    profile = spark.createDataFrame([(u, u % 2, 0, 1) for u in range(120)], "user_id long, gender int, age_bucket int, occupation int")
    model = factors.train_user_tower(H.next_item_pairs(h, window=3).join(profile, "user_id"), dim=16, epochs=25, rate=0.01, window=3, batch=64).cache()
    losses = [r.loss for r in model.filter("kind = 'loss'").orderBy("epoch").collect()]
    assert losses[-1] < 0.5 * losses[0] and len(losses) == 25
    vectors = factors.tower_users(model, H.last(h, 3).select("user_id", "item_id"), profile, dim=16)
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in vectors.collect())
    items = model.filter("kind = 'item'").select(F.col("id").alias("item_id"), "vec")
    hits = lambda df: sum(r.item_id == walks[r.user_id][-1] for r in df.collect())
    tower = hits(recall.by_vectors(vectors, items, h, k=2))
    popular = hits(recall.by_popularity(profile.select("user_id"), recall.popularity(h), h, k=2))
    assert tower >= 80 and tower > 3 * popular
    cold = factors.tower_users(model, h.limit(0).select("user_id", "item_id"), spark.createDataFrame([(999, 7, 7, 7)], "user_id long, gender int, age_bucket int, occupation int"), dim=16).collect()
    assert len(cold) == 1 and all(np.isfinite(cold[0].vec))


def test_vector_recall_is_exact_whatever_the_blocks(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(u, v[u].tolist()) for u in range(15)], "user_id long, vec array<double>")
    seen = {u: set(range(u, u + 3 * u)) for u in range(15)}
    had = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "user_id long, item_id long")
    for blocks in ((1024, 4096), (4, 7)):
        got = {}
        for r in recall.by_vectors(queries, vectors, had, k=5, query_block=blocks[0], item_block=blocks[1]).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id))
        for u in range(15):
            want = sorted((i for i in range(60) if i not in seen[u]), key=lambda i: (-round(float(v[i] @ v[u]), 9), i))[:5]
            assert [i for _, i in sorted(got[u])] == want


def test_vector_recall_with_ties_and_lengths_keeps_only_what_is_asked_for(spark, capsys):
    """Many equal vectors, lengths from 1e-3 to 1e3, more asked for than there are; no pair of blocks is a row, so no product of tables is planned."""
    rng = np.random.default_rng(8)
    v = np.repeat(rng.integers(-2, 3, size=(30, 3)), 4, axis=0) * 10.0 ** rng.integers(-3, 4, size=(120, 1))
    q = rng.integers(-2, 3, size=(40, 3)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(u, x.tolist()) for u, x in enumerate(q)], "user_id long, vec array<double>")
    seen = {u: set(rng.permutation(120)[: 3 * u].tolist()) for u in range(40)}
    had = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "user_id long, item_id long")
    for k in (1, 7, 200):
        found = recall.by_vectors(queries, vectors, had, k=k, query_block=8, item_block=16)
        found.explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        got = {}
        for r in found.collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id, r.score))
        for u in range(40):
            want = sorted(((-round(float(v[i] @ q[u]), 9), i) for i in range(120) if i not in seen[u]))[:k]
            assert [(n, i) for n, i, _ in sorted(got.get(u, []))] == [(n + 1, i) for n, (_, i) in enumerate(want)]
            assert [s for *_, s in sorted(got.get(u, []))] == pytest.approx([-s for s, _ in want])


def test_gram_of_long_histories(spark):
    """One user has most of the rows; its pairs are counted in many keys, none of them with more than a few tiles."""
    rng = np.random.default_rng(12)
    rows = [(0, i) for i in range(400)] + [(u, int(i)) for u in range(1, 30) for i in rng.permutation(400)[:12]]
    df = spark.createDataFrame([*rows, *rows[:50]], "user_id long, item_id long").repartition(3)
    x = np.zeros((30, 400), int)
    for u, i in rows:
        x[u, i] = 1
    want = x.T @ x
    for tile in (512, 32):
        got = {(r.item_id, r.related_id): r.n for r in recall.gram(df, tile=tile).collect()}
        assert len(got) == (want > 0).sum() and all(want[k] == n for k, n in got.items())


def test_weight_search_is_plain_fusion(spark):
    """Every profile against fusing with its weights and counting hits; one of them leaves a user without a list."""
    rng = np.random.default_rng(4)
    profiles = [{"a": 1.0, "b": 0.5}, {"a": 0.2, "b": 2.0}, {"b": 1.0}, {"a": 0.0, "b": 0.3}]
    one = lambda users: spark.createDataFrame([(u, int(i), r) for u in users for r, i in enumerate(rng.permutation(12)[:6], 1)], "user_id long, item_id long, rank long").cache()
    both = fusion.channels(a=one(range(6)), b=one(range(4)))
    true = {u: set(rng.permutation(12)[:4].tolist()) for u in range(6)}
    truth = spark.createDataFrame([(u, int(i)) for u, s in true.items() for i in s], "user_id long, item_id long")
    got = {r.profile: r.score for r in fusion.search_weights(both, truth, k=3, profiles=profiles).collect()}
    for n, p in enumerate(profiles):
        lists = {}
        for r in fusion.weighted_rrf(both, p, k=3).collect():
            lists.setdefault(r.user_id, set()).add(r.item_id)
        assert got[n] == pytest.approx(np.mean([len(x & true[u]) / len(true[u]) for u, x in lists.items()]), abs=1e-8)


def test_strategies_by_name(spark, two):
    from quillon.operators import strategies as st

    x = st.Inputs(two, spark.createDataFrame([(i, ["g"]) for i in (1, 2, 3)], "item_id long, genres array<string>"), 5)
    assert set(st.OFFLINE) == set(st.RECALL) and list(st.recall_lists(x, ("popular", "itemcf"))) == ["popular", "itemcf"]
    with pytest.raises(KeyError, match="no recall strategy 'x'"):
        st.RECALL["x"]
    with pytest.raises(ValueError, match="already"):
        st.RECALL.register("itemcf")(None)
    c = spark.createDataFrame([(1, 10, 0.5, 1), (1, 20, 0.4, 2)], "user_id long, item_id long, score double, rank long")
    ctr = spark.createDataFrame([(1, 20, 0.9)], "user_id long, item_id long, pred double")
    order = lambda df: [(r.item_id, r.score) for r in df.orderBy("rank").collect()]
    assert order(st.rank_stage(c, ctr)) == [(20, 0.9), (10, 0.5)] and order(st.rank_stage(c)) == [(10, 0.5), (20, 0.4)]
    assert order(st.rank_stage(c, ctr.drop("pred"))) == [(10, 0.5), (20, 0.4)]  # a model without predictions
    assert order(st.rank_stage(c, None, order=("ctr",))) == [(10, 0.5), (20, 0.4)]


def test_numbers_are_rounded_as_in_sql(spark):
    """Sums of the size of genre scores, and recency weights, bit for bit."""
    import duckdb
    import pandas as pd

    x = pd.DataFrame({"x": np.append(np.random.default_rng(0).uniform(-400, 400, 400_000), [0.0, 1e300, -0.5e-9])})
    con = duckdb.connect()
    con.register("t", x)
    want = con.execute("SELECT x, round(x, 9) AS y FROM t").df().sort_values("x")["y"].to_numpy()
    got = spark.createDataFrame(x).select("x", S.half_up(F.col("x"), 9).alias("y")).toPandas().sort_values("x")["y"].to_numpy()
    assert (got == want).all()
    backs = spark.range(200).select("id", S.decay(F.col("id"), 0.05).alias("a"), S.decay(F.col("id"), 0.08).alias("b")).toPandas().sort_values("id")
    want = con.execute("SELECT 1 / (1 + 0.05 * i) AS a, 1 / (1 + 0.08 * i) AS b FROM range(200) r(i) ORDER BY i").df()
    assert (backs["a"].to_numpy() == want["a"].to_numpy()).all() and (backs["b"].to_numpy() == want["b"].to_numpy()).all()
