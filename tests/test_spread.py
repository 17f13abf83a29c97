"""Sums over lists in blocks of users, and pair sums, against plain versions."""

import re
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import recall
from quillon.operators.history import history
from quillon.operators.spread import half_up, spread


@pytest.fixture(scope="module")
def hist(spark):
    rows = [(u, (u * 7 + j * j) % 23, 9, 100 * j) for u in range(40) for j in range(1 + u % 9)]
    return history(spark.createDataFrame(sorted({(u, i): (u, i, r, t) for u, i, r, t in rows}.values()), "user_id long, item_id long, rating int, ts long")).localCheckpoint()


def plain_pairs(hist, window=None):
    users = defaultdict(list)
    for r in sorted(hist.collect(), key=lambda r: (r["user_id"], r["pos"])):
        users[r["user_id"]].append(r["item_id"])
    users = {u: v for u, v in users.items() if len(v) > 1}
    c, s = defaultdict(int), defaultdict(float)
    for v in users.values():
        for i, a in enumerate(v):
            c[a] += 1
            for j, b in enumerate(v):
                if a != b and (window is None or 1 <= j - i <= window):
                    s[a, b] += 1 / math.log2(len(v) + 2) / ((j - i) if window else 1)
    return {k: x / math.sqrt(c[k[0]] * c[k[1]]) for k, x in s.items()}


@pytest.mark.parametrize("hot", [0, 3, 100])
@pytest.mark.parametrize("window", [None, 2])
def test_pair_sums_of_hot_and_other_keys(hist, monkeypatch, hot, window):
    monkeypatch.setattr(recall.pair_sums, "__kwdefaults__", {"window": None, "hot": hot})
    edges = recall.seqcf(hist, window=window, k=1000) if window else recall.itemcf(hist, k=1000)
    got = {(r["item_id"], r["related_id"]): r["score"] for r in edges.collect()}
    assert got == pytest.approx(plain_pairs(hist, window), abs=2e-9)


def test_pairs_are_made_where_lists_are_sent(hist):
    """No row of a pair is shuffled: above the pairs there is no exchange."""
    members = hist.select("user_id", "item_id", "pos", "n").withColumn("c", F.lit(1))
    plan = recall.pair_sums(members, "user_id", "item_id", "related_id", F.lit(1.0))[0]._jdf.queryExecution().executedPlan().toString()
    pairs = plan[: plan.index("posexplode(ids")]
    assert "Exchange hashpartitioning" not in pairs


@pytest.mark.parametrize(("block", "at_once"), [(200_000, 2_000_000), (30, 7), (16, 1)])
@pytest.mark.parametrize("scored", [True, False])
def test_spread_in_small_blocks(spark, hist, block, at_once, scored):
    lists = {i: [(j, ((i * 5 + j) % 11) / 8) for j in range(i % 6, 23, 1 + i % 4)] for i in range(20)}
    df = spark.createDataFrame([(i, [j for j, _ in v], [s for _, s in v]) for i, v in lists.items()], "key long, ids array<long>, scores array<double>")
    rows = hist.select("user_id", F.col("item_id").alias("key"), (F.col("pos") / 4).alias("w"))
    seen = hist.select("user_id", "item_id")
    want, had = defaultdict(float), {(r["user_id"], r["item_id"]) for r in seen.collect()}
    for r in rows.collect():
        for j, s in lists.get(r["key"], []):
            want[r["user_id"], j] += r["w"] * (s if scored else 1.0)
    df = df if scored else df.drop("scores")
    run = lambda seen=None, **o: spread(rows, df, hist.select("user_id"), seen, about=hist.count(), block=block, at_once=at_once, **o).collect()
    assert {(r["user_id"], r["item_id"]): r["score"] for r in run()} == pytest.approx(dict(want), abs=1e-9)
    counts = defaultdict(int)
    for u, _ in want:
        counts[u] += 1
    assert {r["user_id"]: r["items"] for r in run(count=True)} == counts
    by_user = defaultdict(list)
    for (u, i), s in want.items():
        if (u, i) not in had:
            by_user[u].append((-round(s, 9), i))
    best = {(u, n + 1): (i, -s) for u, v in by_user.items() for n, (s, i) in enumerate(sorted(v)[:3])}
    assert {(r["user_id"], r["rank"]): (r["item_id"], r["score"]) for r in run(seen, k=3)} == best


def test_nothing_to_add_up(spark, hist):
    none = spark.createDataFrame([], "key long, ids array<long>, scores array<double>")
    rows = hist.select("user_id", F.col("item_id").alias("key"), F.lit(1.0).alias("w"))
    assert spread(rows, none, hist.select("user_id"), hist, about=10, k=3).count() == 0
    assert spread(rows.filter("false"), none, hist.select("user_id").filter("false"), about=0, k=3).count() == 0


def test_halves_are_rounded_up():
    assert half_up(__import__("numpy").array([0.5, 1.5, -2.5, 0.25]), 0).tolist() == [1.0, 2.0, -3.0, 0.0]


@pytest.mark.parametrize("many", [0, 2, 2000])
def test_negatives_by_arrays_and_by_joins(spark, hist, many):
    """The same draws whichever way they are compared, each unrated and picked once."""
    from quillon.operators.ranking import sample_negatives

    items = spark.range(60).select(F.col("id").alias("item_id"))
    p = hist.filter("pos % 2 = 1")
    rows = lambda m: sorted(tuple(r) for r in sample_negatives(p, hist, items, many=m).select("user_id", "item_id", "negative", "pick").collect())
    got, had = rows(many), {(r["user_id"], r["item_id"]) for r in hist.collect()}
    assert got == rows(4) and len(got) == 4 * p.count()
    assert not {(u, n) for u, _, n, _ in got} & had and len({(u, i, n) for u, i, n, _ in got}) == len(got)


def test_small_vocabularies_are_not_shuffled(spark):
    """Only features of many values shuffle the rows."""
    from quillon.operators.ranking import encode, fit_vocabulary

    rows = spark.createDataFrame([(f"a{i % 3}", f"b{i % 7}", i) for i in range(50)], "a string, b string, n int")
    vocabulary = fit_vocabulary(rows, ("a", "b"))
    with_joins = encode(rows, vocabulary, ("a", "b"), "x_", most=3)
    assert [(r["x_a"], r["x_b"]) for r in with_joins.orderBy("n").collect()] == [(i % 3, i % 7) for i in range(50)]
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(encode(rows, vocabulary, ("a", "b"), "x_")).count("BroadcastHashJoin") == 2
        assert plan(encode(rows, vocabulary, ("a", "b"), "x_", most=3)).count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = encode(rows, vocabulary, ("a", "b"), "x_").orderBy("n").collect()
    assert [(r["x_a"], r["x_b"]) for r in got] == [(i % 3, i % 7) for i in range(50)]


@pytest.mark.parametrize("head", [4, 9, 1000])
def test_popular_items_of_short_and_long_histories(spark, hist, head):
    """Users above and below the broadcast head get the same lists."""
    scores = spark.createDataFrame([(i, float(i % 7)) for i in range(23)], "item_id long, score double")
    users = spark.range(45).select(F.col("id").alias("user_id"))
    had, order = defaultdict(set), sorted(range(23), key=lambda i: (-(i % 7), i))
    for r in hist.collect():
        had[r["user_id"]].add(r["item_id"])
    want = {(u, n + 1): i for u in range(45) for n, i in enumerate([i for i in order if i not in had[u]][:3])}
    assert {(r["user_id"], r["rank"]): r["item_id"] for r in recall.by_popularity(users, scores, hist, k=3, head=head).collect()} == want


def test_a_genre_of_all_users_is_not_one_task(spark):
    """The genres' lists are broadcast."""
    from quillon.operators.rerank import by_user_genres

    items = spark.createDataFrame([(i, 6.0, 2000, ["red"]) for i in range(9)], "item_id long, avg_rating double, year int, genres array<string>")
    out = by_user_genres(spark.createDataFrame([(u, "red") for u in range(20)], "user_id long, genre string"), items, k=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
        assert out.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_are_read_from_files_and_not_shuffled(spark, hist):
    """A block's rows are shuffled with the place of their list, however many blocks need it."""
    lists = hist.groupBy(F.col("user_id").alias("key")).agg(F.collect_list("item_id").alias("ids"))
    near = hist.select("user_id", ((F.col("user_id") + F.col("pos")) % 40).alias("key"), F.lit(1.0).alias("w"))
    plan = spread(near, lists, hist.select("user_id"), about=hist.count(), k=3, block=10)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan and "ids#" not in plan


def test_numbers_are_packed_without_loss():
    import numpy as np

    from quillon.operators.spread import _packed, _unpacked

    for ids, scores in [([1, 2], [0.5, 0.123456789]), ([1, 1 << 40], [0.1, 5.0]), ([7], [1 / 3]), ([-1], [-0.5]), ([], []), ([3], None)]:
        ids, scores = np.array(ids, np.int64), None if scores is None else np.array(scores)
        code, a, b = _packed(ids, scores)
        got, own = _unpacked(a.tobytes() + (b"" if b is None else b.tobytes()), len(ids), code, scores is not None)
        assert got.tolist() == ids.tolist() and (scores is None or own.tolist() == scores.tolist())


def test_pairs_without_hot_keys_are_one_table_of_bounded_tasks(hist, monkeypatch):
    """One table, so its lists need no other shuffle; tasks grow in number with the pairs."""
    members = hist.select("user_id", "item_id", "pos", "n").withColumn("c", F.lit(1)).localCheckpoint()
    monkeypatch.setattr(recall, "PAIRS", 100)
    parts = recall.pair_sums(members, "user_id", "item_id", "related_id", F.lit(1.0))
    pairs = members.agg(F.sum("n")).first()[0]
    assert len(parts) == 1 and parts[0].rdd.getNumPartitions() == -(-pairs // 100)


def test_lists_are_fused_in_one_shuffle(spark, hist):
    """Sums, sizes and ranks are taken where a user's rows are."""
    from quillon.operators import fusion

    one = hist.select("user_id", "item_id", F.col("pos").alias("rank"))
    both = fusion.channels(a=one, b=one.filter("item_id % 2 = 0"))
    for out in (fusion.weighted_rrf(both, {"a": 1.0, "b": 2.0}), fusion.snake_merge(both), fusion.round_robin(both)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


@pytest.mark.parametrize("name", ["n09", "n11"])
def test_fused_lists_are_made_once(spark, monkeypatch, name):
    """Plans that read the fused lists twice read a written table."""
    from quillon.plans import candidates

    rows = spark.range(6).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("item_id"), (F.col("id") / 8).alias("score"), F.lit("itemcf").alias("channel"), F.lit(1).cast("long").alias("rank"))
    monkeypatch.setattr(candidates, "m01", lambda spark, d: rows)
    out = getattr(candidates, name)(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "/fused-" in plan
    assert out.count() == (6 if name == "n09" else 2)


def test_lines_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """However few shuffle partitions there are, a task of ratings and histories has about so many lines."""
    from quillon.operators.history import history
    from quillon.sources import tables

    d = "/root/testdata/sf0.001"
    want = sorted(tables.interactions(spark, d).collect())
    monkeypatch.setattr(tables, "TASK_LINES", 500)
    rows = tables.interactions(spark, d)
    n = -(-tables.table(spark, d, "lineitem").count() // 500)
    plan = history(rows)._jdf.queryExecution().executedPlan().toString()
    assert n > 8 and re.search(rf"hashpartitioning\(user_id#\d+L?, {n}\)", plan) and len(re.findall(r"hashpartitioning\(user_id", plan)) == 1
    assert sorted(rows.collect()) == want
