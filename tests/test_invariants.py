"""What must hold of queries that SQL cannot express, on the smallest tables."""

from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")


def query(spark, name):
    from quillon.catalog import QUERIES

    return QUERIES[name](spark, DIR)


@pytest.fixture(scope="module")
def seen(spark):
    return query(spark, "f01_positives").select("user_id", "item_id").cache()


@pytest.mark.parametrize("name", ["r12_ease_recall", "r18_bpr_recall", "r20_two_tower_recall", "r27_batch_tower_recall", "r28_online_tower_recall"])
def test_recall_is_unseen_and_ranked(spark, seen, name):
    rows = query(spark, name).cache()
    assert rows.count() > 0 and rows.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    by_user = {}
    for r in rows.collect():
        by_user.setdefault(r.user_id, []).append((r["rank"], -r.score, r.item_id))
    for v in by_user.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)


def test_reranking_is_a_permutation(spark):
    before = {(r.user_id, r.item_id) for r in query(spark, "n10_rank_by_recall").collect()}
    for name in ("d01_genre_dispersion", "d03_rerank_chain"):
        rows = query(spark, name).collect()
        assert {(r.user_id, r.item_id) for r in rows} == before and len(rows) == len(before)


def test_lists_cover_all_users(spark, seen):
    rows = query(spark, "p01_all_users").cache()
    users = {r.user_id for r in rows.select("user_id").distinct().collect()}
    cold = {r.user_id for r in query(spark, "b01_cold_users").filter("cold").collect()}
    assert cold <= users and {r.user_id for r in rows.filter("channel = 'cold_start'").collect()} == cold
    assert rows.filter("channel <> 'cold_start'").join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    assert rows.groupBy("user_id").count().agg({"count": "max"}).first()[0] <= 20


def test_learned_vectors_have_length_one(spark):
    for name in ("r17_bpr_train", "r19_two_tower_train", "r21_user_tower"):
        assert query(spark, name).filter("abs(length - 1) > 1e-5").count() == 0


def test_metrics_are_shares(spark):
    rows = query(spark, "e14_channel_metrics").collect()
    assert {"bpr", "two_tower", "user_tower", "hybrid", "hybrid_recall", "hybrid_with_tower", "ease", "popular"} <= {r.method for r in rows}
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in ("recall", "precision", "ndcg", "hit_rate"))
    losses = [r.loss for r in query(spark, "n07_deepfm_train").orderBy("epoch").collect()]
    assert losses and all(x > 0 for x in losses)


@pytest.mark.parametrize("name", ["r18_bpr_recall", "r20_two_tower_recall", "r21_user_tower", "r22_user_vector_service", "r27_batch_tower_recall", "r28_online_tower_recall"])
def test_learned_recall_serves_all_users(spark, seen, name):
    had = {r.user_id for r in seen.select("user_id").distinct().collect()}
    assert {r.user_id for r in query(spark, name).select("user_id").distinct().collect()} == had


def test_every_item_has_ease_edges(spark, seen):
    had = {r.item_id for r in seen.select("item_id").distinct().collect()}
    edges = query(spark, "r05_ease").cache()
    assert {r.item_id for r in edges.select("item_id").distinct().collect()} == had
    assert edges.groupBy("item_id").count().agg({"count": "max"}).first()[0] > 50


def test_learned_vectors_take_the_operators_settings(spark, monkeypatch):
    from quillon.operators import bpr, factors, history
    from quillon.plans.data import pos_history

    taken = {}
    for module, name in ((bpr, "train_bpr"), (factors, "train_two_tower")):
        monkeypatch.setattr(module, name, lambda pairs, *, name=name, f=getattr(module, name), **o: taken.setdefault(name, []).append((pairs.count(), o)) or f(pairs, **o))
    monkeypatch.setattr(history, "subsample", lambda df, *a: df.limit(1))
    for name in ("r17_bpr_train", "r18_bpr_recall", "r19_two_tower_train", "r20_two_tower_recall"):
        query(spark, name)
    h = pos_history(spark, DIR)
    assert taken == {"train_bpr": [(h.count(), {})] * 2, "train_two_tower": [(history.next_item_pairs(h).count(), {})] * 2}
