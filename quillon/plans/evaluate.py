"""Queries: evaluation, text search, the feedback loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.operators import history as H
from quillon.operators import fusion, recall, search
from quillon.plans.data import D, pos_history
from quillon.plans.registry import query
from quillon.sources.paths import stored, work_dir
from quillon.sources.tables import interactions, items, ratings_of_events, sql, table
from quillon.streaming import feedback

# ---- splits and list metrics --------------------------------------------------


@query("e01_time_split", sql("SELECT user_id, item_id, part FROM split"))
def e01(spark, d):
    return E.time_split(pos_history(spark, d)).select("user_id", "item_id", "part")


@query("e01_time_split_valid", sql("""SELECT user_id, item_id, CASE WHEN n - pos < t THEN 'test' WHEN n - pos < t + v THEN 'valid' ELSE 'train' END AS part FROM (
    SELECT *, CASE WHEN n - t - v0 < 1 THEN greatest(0, n - t - 1) ELSE v0 END AS v FROM (SELECT *, greatest(1, round_even(CAST(n * 0.2 AS DOUBLE), 0)) AS t, greatest(1, round_even(CAST(n * 0.1 AS DOUBLE), 0)) AS v0 FROM history WHERE n >= 5))"""))  # fmt: skip
def e01b(spark, d):
    return E.time_split(pos_history(spark, d), valid=0.1).select("user_id", "item_id", "part")


_TRAIN = {
    "tpop": """SELECT item_id, round((count(*) / (count(*) + 20.0) * avg(rating) + 20.0 / (count(*) + 20.0) * (SELECT avg(rating) FROM split WHERE part = 'train')) * ln(1 + count(*)), 9) AS score FROM split WHERE part = 'train' GROUP BY 1""",
    "truth": "SELECT user_id, item_id FROM split WHERE part = 'test'",
    "recs": """SELECT user_id, item_id, rank FROM (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS rank FROM (SELECT DISTINCT user_id FROM truth) u, tpop p
        WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.part = 'train' AND s.user_id = u.user_id AND s.item_id = p.item_id)) WHERE rank <= 100""",
    "marked": "SELECT r.user_id, r.item_id, r.rank, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS hit FROM recs r LEFT JOIN truth t USING (user_id, item_id)",
    "sizes": "SELECT user_id, count(*) AS size FROM truth GROUP BY 1",
    "peru": """SELECT k, user_id, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS hits, sum(CASE WHEN rank <= k THEN hit / log2(rank + 1) ELSE 0 END) AS dcg FROM marked, (SELECT unnest([20, 50, 100]) AS k) GROUP BY 1, 2""",
    "idl": "SELECT m, sum(1 / log2(i + 1)) AS idcg FROM range(1, 101) a(m), range(1, 101) b(i) WHERE i <= m GROUP BY 1",
}


def _split_recs(spark, d):
    s = E.time_split(pos_history(spark, d))
    train, truth = s.filter("part = 'train'"), s.filter("part = 'test'")
    return recall.by_popularity(truth.select("user_id").distinct(), recall.popularity(train), train, k=100), truth


@query("e02_list_metrics", sql("SELECT k, round(avg(hits / CAST(size AS DOUBLE)), 9) AS recall, round(avg(hits / CAST(k AS DOUBLE)), 9) AS precision, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate, count(*) AS users FROM peru JOIN sizes USING (user_id) GROUP BY 1", **_TRAIN))
def e02(spark, d):
    return E.list_metrics(*_split_recs(spark, d)).select("k", "recall", "precision", "hit_rate", "users")


@query("e03_ndcg", sql("SELECT k, round(avg(dcg / idcg), 9) AS ndcg FROM peru JOIN sizes USING (user_id) JOIN idl ON idl.m = least(size, k) GROUP BY 1", **_TRAIN))
def e03(spark, d):
    return E.list_metrics(*_split_recs(spark, d)).select("k", "ndcg")


@query("e04_coverage", sql("SELECT k, count(DISTINCT item_id) AS coverage FROM recs, (SELECT unnest([20, 50, 100]) AS k) WHERE rank <= k GROUP BY 1", **_TRAIN))
def e04(spark, d):
    return E.list_metrics(*_split_recs(spark, d)).select("k", "coverage")


@query("e05_single_user", sql("SELECT k, round(hits / CAST(size AS DOUBLE), 9) AS recall FROM peru JOIN sizes USING (user_id) WHERE user_id = (SELECT min(user_id) FROM truth)", **_TRAIN))
def e05(spark, d):
    recs, truth = _split_recs(spark, d)
    one = truth.agg(F.min("user_id").alias("user_id"))
    return E.list_metrics(recs.join(F.broadcast(one), "user_id", "left_semi"), truth).select("k", "recall")


# ---- AUC family ----------------------------------------------------------------

_PREDS = {"preds": "SELECT user_id, item_id, CASE WHEN rating >= 8 THEN 1 ELSE 0 END AS label, round((item_id * 7 + user_id * 3 + rating * 5) % 50 / 50.0, 4) AS pred FROM interactions"}
_AUC = """SELECT {by} round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 9) AS auc, count(*) AS n
    FROM (SELECT *, rank() OVER ({part} ORDER BY pred) + (count(*) OVER (PARTITION BY {by} pred) - 1) / 2.0 AS r FROM preds) {group}"""


def preds(spark, d):
    p = ((F.col("item_id") * 7 + F.col("user_id") * 3 + F.col("rating") * 5) % 50) / 50.0
    return interactions(spark, d).select("user_id", "item_id", (F.col("rating") >= 8).cast("int").alias("label"), F.round(p, 4).alias("pred"))


@query("e06_auc", sql(_AUC.format(by="", part="", group=""), **_PREDS))
def e06(spark, d):
    return E.auc(preds(spark, d))


_BYU = _AUC.format(by="user_id,", part="PARTITION BY user_id", group="GROUP BY user_id")


@query("e07_gauc", sql(f"SELECT round(sum(auc * n) / sum(n), 9) AS gauc, count(*) AS users FROM ({_BYU}) WHERE auc IS NOT NULL", **_PREDS))
def e07(spark, d):
    return E.gauc(preds(spark, d))


@query("e08_logloss", sql("SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS logloss FROM (SELECT label, least(greatest(pred, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM preds)", **_PREDS))
def e08(spark, d):
    return E.log_loss(preds(spark, d))


_RANK = """SELECT k, round(avg(dcg / idcg), 9) AS ndcg, round(avg(hits / CAST(k AS DOUBLE)), 9) AS prec, round(avg(hits / CAST(pos AS DOUBLE)), 9) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS hr FROM (
    SELECT k, user_id, max(pos) AS pos, sum(CASE WHEN r <= k THEN label ELSE 0 END) AS hits, sum(CASE WHEN r <= k THEN label / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= k THEN label / log2(b + 1) ELSE 0 END) AS idcg
    FROM (SELECT *, sum(label) OVER (PARTITION BY user_id) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, item_id) AS b FROM preds),
    (SELECT unnest([5, 10, 20]) AS k) WHERE pos > 0 GROUP BY 1, 2) GROUP BY 1"""


@query("e09_ranking_metrics", sql(_RANK, **_PREDS))
def e09(spark, d):
    return E.ranking_metrics(preds(spark, d))


@query("e10_baselines", sql("""SELECT p.user_id, p.item_id, round(c.ctr, 9) AS popular, CAST('0x' || substr(md5(concat_ws('|', p.user_id, p.item_id, 42)), 1, 7) AS BIGINT) / 268435456.0 AS random
    FROM preds p JOIN (SELECT item_id, avg(label) AS ctr FROM preds GROUP BY 1) c USING (item_id)""", **_PREDS))  # fmt: skip
def e10(spark, d):
    p = preds(spark, d)
    a = E.popularity_baseline(p).select("user_id", "item_id", F.round("pred", D).alias("popular"))
    return a.join(E.hash_baseline(p).select("user_id", "item_id", F.col("pred").alias("random")), ["user_id", "item_id"])


@query("e12_all_metrics", sql(f"SELECT 'model' AS predictor, (SELECT auc FROM ({_AUC.format(by='', part='', group='')})) AS auc, (SELECT round(sum(auc * n) / sum(n), 9) FROM ({_BYU}) WHERE auc IS NOT NULL) AS gauc, "
    f"(SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) FROM (SELECT label, least(greatest(pred, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM preds)) AS logloss, (SELECT ndcg FROM ({_RANK}) WHERE k = 10) AS ndcg_10", **_PREDS))  # fmt: skip
def e12(spark, d):
    return E.all_metrics(model=preds(spark, d))


@query("e13_training_metrics")
def e13(spark, d):
    from quillon.plans.candidates import deepfm

    model, _, rows, _ = deepfm(spark, d)
    p = model.predict(rows.filter("part = 'test'")).withColumnRenamed("click", "label")
    p = stored(p, work_dir(spark, "predictions"))
    return E.all_metrics(deepfm=p, popular=E.popularity_baseline(p), random=E.hash_baseline(p))


def learned_lists(spark, d, train, k):
    """The lists of models that are trained on the given histories: BPR, two towers and the user tower."""
    from quillon.operators import bpr, factors, recall
    from quillon.plans.candidates import tower_list

    v = stored(bpr.train_bpr(train).filter("kind <> 'loss'"), work_dir(spark, "bpr-vectors"))
    of = lambda kind, name: v.filter(F.col("kind") == kind).select(F.col("id").alias(name), "vec")
    pooled = stored(factors.train_two_tower(H.next_item_pairs(train)), work_dir(spark, "pooled-vectors"))
    return {
        "bpr": recall.by_vectors(of("user", "user_id"), of("item", "item_id"), train, k=k),
        "two_tower": recall.by_vectors(recall.user_vectors(train, pooled, cap=20), pooled, train, k=k),
        "user_tower": tower_list(spark, d, train, k),
    }


@query("e14_channel_metrics")
def e14(spark, d):
    from quillon.plans.candidates import offline_lists

    s = E.time_split(pos_history(spark, d))
    train, truth = H.history(s.filter("part = 'train'").drop("pos", "n", "part")), s.filter("part = 'test'")
    out = None
    train = stored(train, work_dir(spark, "train"))
    lists = offline_lists(spark, d, train, 100)
    lists |= learned_lists(spark, d, train, 100)
    lists = {name: stored(x.select("user_id", "item_id", "rank"), work_dir(spark, f"list-{name}")) for name, x in lists.items()}
    both = fusion.channels(**lists)
    for name, weights in (("hybrid", fusion.HYBRID), ("hybrid_recall", fusion.HYBRID_RECALL), ("hybrid_with_tower", fusion.HYBRID | {"user_tower": 1.0})):
        lists[name] = fusion.weighted_rrf(both, weights, k=100)
    for name, recs in lists.items():
        one = E.list_metrics(recs, truth).select(F.lit(name).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- text search ----------------------------------------------------------------

_TOK = {"toks": r"SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents", "post": "SELECT token, doc_id, count(*) AS tf FROM toks WHERE token <> '' GROUP BY 1, 2"}


@query("t01_keyword_search", sql("""SELECT doc_id, score FROM (SELECT doc_id, round(sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * nn / ll))), 9) AS score FROM post
    JOIN (SELECT token, count(*) AS df FROM post GROUP BY 1) USING (token) JOIN (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1) USING (doc_id), (SELECT count(*) AS nn FROM documents), (SELECT sum(tf) AS ll FROM post)
    WHERE token IN ('apache', 'license', 'version') GROUP BY 1) ORDER BY score DESC, doc_id LIMIT 20""", **_TOK))  # fmt: skip
def t01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.write_index(docs, "doc_id", "text").search("Apache License version")


@query("t02_prefix_suggest", sql("SELECT item_id, title FROM items WHERE regexp_matches(lower(title), '(^| )re') ORDER BY title, item_id LIMIT 10"))
def t02(spark, d):
    return search.suggest(spark, search.write_titles(items(spark, d), "item_id", "title"), "item_id", "title", "Re")


@query("t03_index_build", sql("SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1", **_TOK))
def t03(spark, d):
    return search.write_index(table(spark, d, "documents"), "doc_id", "text").dictionary


@query("k04_search_index", sql("SELECT doc_id, count(*) AS tokens FROM post GROUP BY 1", **_TOK))
def k04(spark, d):
    index = search.write_index(table(spark, d, "documents"), "doc_id", "text")
    return index.postings.select(F.explode("entries").alias("e")).groupBy("e.doc_id").agg(F.count(F.lit(1)).alias("tokens"))


# ---- feedback loop --------------------------------------------------------------

_LAST = {"cur": "SELECT user_id, item_id, rating, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS r FROM rated) WHERE r = 1"}


@query("z01_rating_upsert", sql("SELECT item_id, round(avg(rating), 9) AS avg_rating, count(*) AS rating_count FROM cur GROUP BY 1", **_LAST))
def z01(spark, d):
    return feedback.item_averages(feedback.last_ratings(ratings_of_events(spark, d)))


@query("z02_history_push_remove", sql("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM cur WHERE item_id % 10 <> 0 QUALIFY rank <= 100", **_LAST))
def z02(spark, d):
    current = feedback.last_ratings(ratings_of_events(spark, d))
    return feedback.histories(feedback.after_deletes(current, current.filter("item_id % 10 = 0")))


@query("z03_ucb_counters", sql("""SELECT user_id, genre, count(*) AS n, CAST(sum(rating) AS BIGINT) AS reward FROM cur JOIN item_genres USING (item_id) GROUP BY 1, 2""", **_LAST))
def z03(spark, d):
    g = items(spark, d).select("item_id", F.explode("genres").alias("genre"))
    return feedback.counters(ratings_of_events(spark, d), g)


#: Every seventh event deletes the user's rating of its item.
_ACTIONS = {
    "acts": "SELECT user_id, item_id, CASE WHEN event_id % 7 <> 0 THEN rating END AS rating, ts, event_id FROM rated",
    "kept": "SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS r FROM acts) WHERE r = 1 AND rating IS NOT NULL",
}
_COUNTED = "SELECT user_id, genre, count(*) AS n, CAST(sum(rating) AS BIGINT) AS reward FROM kept JOIN item_genres USING (item_id) GROUP BY 1, 2"


def _actions(spark, d):
    return ratings_of_events(spark, d).withColumn("rating", F.when(F.col("event_id") % 7 != 0, F.col("rating")))


@query("z03_ucb_counters_deletes", sql(_COUNTED, **_ACTIONS))
def z03b(spark, d):
    """Deletions take trials and rewards back."""
    return feedback.counters(_actions(spark, d), items(spark, d).select("item_id", F.explode("genres").alias("genre")))


@query("z03_ucb_counters_stream", sql(_COUNTED, **_ACTIONS))
def z03c(spark, d):
    """The same by keyed state over a stream of the events."""
    return feedback.stream_counters(_actions(spark, d), items(spark, d).select("item_id", F.explode("genres").alias("genre")))


@query("z04_windowed_ratings", sql("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(*) AS n, round(avg(rating), 9) AS mean FROM rated GROUP BY 1"))
def z04(spark, d):
    w = feedback.windowed_counts(ratings_of_events(spark, d))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean", D).alias("mean"))
