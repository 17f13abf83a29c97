"""Queries: candidate generation, fusion, ranking samples, re-ranking, cold start."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import bpr, factors, fusion, ranking, recall, rerank, strategies
from quillon.operators import history as H
from quillon.operators.ease import ease
from quillon.operators.history import top
from quillon.plans.data import _SPLIT, D, kept_history, pos_history, rated_items, rsql
from quillon.plans.registry import query
from quillon.plans.scalar import _COUNT, _DAYS, _VOTES, half_star_sql, steps_sql
from quillon.sources.tables import interactions, items, sql, table, users

# ---- builds -------------------------------------------------------------------


@query("r01_popular", sql("SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pop QUALIFY rank <= 300"))
def r01(spark, d):
    from pyspark.sql import Window as W

    head = recall.popularity(H.positives(interactions(spark, d))).orderBy(F.desc("score"), "item_id").limit(300)
    return head.select("item_id", "score", F.row_number().over(W.orderBy(F.desc("score"), "item_id")).cast("long").alias("rank"))


def _edges_query(name: str, build) -> None:
    @query(name, sql(f"SELECT item_id, related_id, score, rank FROM {name.split('_')[1]} WHERE rank <= 20"))
    def run(spark, d):
        return build(kept_history(spark, d), k=20)


_edges_query("r02_itemcf_sim", recall.itemcf)
_edges_query("r03_swing_sim", recall.swing)
_edges_query("r04_seqcf_sim", recall.seqcf)


@query("r05_ease")
def r05(spark, d):
    return ease(pos_history(spark, d))


@query("r06_usercf_sim", sql("SELECT user_id, other_id, score, rank FROM usercf"))
def r06(spark, d):
    return recall.usercf(kept_history(spark, d))


@query("r06_usercf_capped", sql("""SELECT a.user_id, b.user_id AS other_id, count(*) AS shared FROM (SELECT * FROM few WHERE r <= 3) a JOIN (SELECT * FROM few WHERE r <= 3) b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2""",
    few="SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(concat_ws('|', item_id, user_id, 42)), user_id) AS r FROM history"))
def r06b(spark, d):
    h = pos_history(spark, d)
    few = top(h, "item_id", 3, F.md5(F.concat_ws("|", "item_id", "user_id", F.lit(42))), F.col("user_id")).select("item_id", "user_id")
    return few.join(few.select("item_id", F.col("user_id").alias("other_id")), "item_id").filter("user_id <> other_id").groupBy("user_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))


_CONTENT = {
    "cst": "SELECT item_id, year, genres, imdb_rating, imdb_votes, coalesce(n, 0) AS cnt, coalesce(mean, (SELECT avg(rating) FROM positives)) AS mean FROM items LEFT JOIN pop USING (item_id)",
    "cnum": """SELECT item_id, genres, [(year - min(year) OVER ()) / CAST(max(year) OVER () - min(year) OVER () AS DOUBLE), mean / (SELECT max(rating) FROM positives), ln(1 + cnt) / max(ln(1 + cnt)) OVER (),
        imdb_rating / max(imdb_rating) OVER (), ln(1 + imdb_votes) / max(ln(1 + imdb_votes)) OVER (), 0.0] AS x FROM cst""",
    "cvec": "SELECT item_id, list_concat([CASE WHEN list_contains(genres, g) THEN 1.0 ELSE 0.0 END FOR g IN (SELECT list(DISTINCT genre ORDER BY genre) FROM item_genres)], x) AS v FROM cnum",
    "cunit": "SELECT item_id, [y / sqrt(list_sum([z * z FOR z IN v])) FOR y IN v] AS v FROM cvec",
}


def _content(spark, d, positive=None):
    i = items(spark, d)
    genres = sorted(r[0] for r in i.select(F.explode("genres")).distinct().collect())  # the genre vocabulary
    return recall.content_vectors(i, H.positives(interactions(spark, d)) if positive is None else positive, genres)


@query("r07_content_vectors", sql("SELECT item_id, CAST(len(v) AS INTEGER) AS dim, round(v[1], 6) AS x0, round(v[len(v) - 4], 6) AS mean, round(v[len(v) - 1], 6) AS votes FROM cunit", **_CONTENT))
def r07(spark, d):
    n = F.size("vec")
    at = lambda i: F.round(F.get("vec", i), 6)
    return _content(spark, d).select("item_id", n.alias("dim"), at(F.lit(0)).alias("x0"), at(n - 5).alias("mean"), at(n - 2).alias("votes"))


@query("r08_content_embeddings", sql("""SELECT item_id, round((coalesce(r, rm) - r0) / (r1 - r0), 6) AS rating, round((year - y0) / CAST(y1 - y0 AS DOUBLE), 6) AS year FROM
    (SELECT item_id, year, CASE WHEN item_id % 4 = 0 THEN NULL ELSE imdb_rating END AS r FROM items), (SELECT min(year) AS y0, max(year) AS y1 FROM items),
    (SELECT min(imdb_rating) AS r0, max(imdb_rating) AS r1, median(imdb_rating) AS rm FROM items WHERE item_id % 4 <> 0)"""))  # fmt: skip
def r08(spark, d):
    i = items(spark, d).select("item_id", "year", F.when(F.col("item_id") % 4 != 0, F.col("imdb_rating")).alias("r"))
    b = i.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.median("r").alias("rm"))
    full = i.crossJoin(F.broadcast(b))
    return full.select("item_id", F.round(S.min_max(F.coalesce("r", "rm"), F.col("r0"), F.col("r1")), 6).alias("rating"), F.round(S.min_max(F.col("year"), F.col("y0"), F.col("y1")), 6).alias("year"))


@query("r09_genre_index", sql("SELECT genre, item_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY genre ORDER BY coalesce(score, 0) DESC, item_id) AS rank FROM item_genres LEFT JOIN pop USING (item_id)"))
def r09(spark, d):
    return recall.genre_index(items(spark, d), recall.popularity(H.positives(interactions(spark, d))))


# ---- recall -------------------------------------------------------------------

SEEN = "NOT EXISTS (SELECT 1 FROM positives s WHERE s.user_id = x.user_id AND s.item_id = x.item_id)"


def recall_sql(edges: str, cap: int, rate: float, k: int, n: int = 200) -> str:
    return f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT h.user_id, e.related_id AS item_id, round(sum(e.score * (1 / (1 + {rate} * (h.n - h.pos)))), 9) AS score
    FROM history h JOIN {edges} e ON e.item_id = h.item_id WHERE h.n - h.pos < {cap} AND e.rank <= {n} GROUP BY 1, 2) x WHERE {SEEN}) WHERE rank <= {k}"""


def _edge_recall(name: str, build, edges: str, channel: str) -> None:
    cap, rate = recall.EDGE_CHANNELS[channel]

    @query(name, sql(recall_sql(edges, cap, rate, 50)))
    def run(spark, d):
        h = kept_history(spark, d)
        return recall.by_edges(h, build(h), h, cap=cap, rate=rate, k=50)


_edge_recall("r10_itemcf_recall", recall.itemcf, "itemcf", "itemcf")
_edge_recall("r10_swing_recall", recall.swing, "swing", "swing")
_edge_recall("r11_seqcf_recall", recall.seqcf, "seqcf", "seqcf")


@query("r12_ease_recall")
def r12(spark, d):
    h = kept_history(spark, d)
    cap, rate = recall.EDGE_CHANNELS["ease"]
    return recall.by_edges(h, ease(h), h, cap=cap, rate=rate, k=50)


USERCF_RECALL = f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT e.user_id, h.item_id, round(sum(e.score), 9) AS score FROM usercf e JOIN history h ON h.user_id = e.other_id AND h.n - h.pos < 100 GROUP BY 1, 2) x WHERE {SEEN}) WHERE rank <= 50"""


@query("r13_usercf_recall", sql(USERCF_RECALL))
def r13(spark, d):
    h = kept_history(spark, d)
    return recall.by_users(recall.usercf(h), h, h, k=50)


@query("r14_content_recall", sql(f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT u.user_id, i.item_id, round(list_sum([u.v[j] * i.v[j] FOR j IN range(1, len(u.v) + 1)]), 6) AS score FROM uvec u, cunit i) x WHERE {SEEN}) WHERE rank <= 20""",
    upart="""SELECT user_id, dd, sum(w * v[dd]) / sum(w) AS y FROM (SELECT h.user_id, v, CASE WHEN n > 1 THEN 0.6 + 0.4 * (pos - 1) / (n - 1) ELSE 0.6 END AS w, unnest(range(1, len(v) + 1)) AS dd
        FROM history h JOIN cunit USING (item_id) WHERE h.user_id % 20 = 0) GROUP BY 1, 2""",
    uvec="SELECT user_id, [z / sqrt(list_sum([q * q FOR q IN l])) FOR z IN l] AS v FROM (SELECT user_id, list(y ORDER BY dd) AS l FROM upart GROUP BY 1)", **_CONTENT))
def r14(spark, d):
    h, v = pos_history(spark, d), _content(spark, d)
    return recall.by_vectors(recall.user_vectors(h.filter("user_id % 20 = 0"), v), v, h, k=20, digits=6)


GENRE_RECALL = f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT l.user_id, g.item_id, round(sum(l.w * (g.score + 1)), 9) AS score FROM liked l JOIN gidx g ON g.genre = l.genre AND g.rank <= 150 WHERE l.gr <= 5 GROUP BY 1, 2) x WHERE {SEEN}) WHERE rank <= 50"""
GENRE_VIEWS = {
    "gidx": "SELECT genre, item_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY genre ORDER BY coalesce(score, 0) DESC, item_id) AS rank FROM item_genres LEFT JOIN pop USING (item_id)",
    "liked": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, genre) AS gr FROM (SELECT r.user_id, g.genre, round(sum(1 / (1 + 0.05 * r.back)), 9) AS w FROM recent r JOIN item_genres g USING (item_id) GROUP BY 1, 2)""",
}


@query("r15_genre_recall", sql(GENRE_RECALL, **GENRE_VIEWS))
def r15(spark, d):
    h, i = kept_history(spark, d), items(spark, d)
    return recall.by_genre(h, i, recall.genre_index(i, recall.popularity(h)), h, k=50)


@query("r16_popular_recall", sql("SELECT user_id, item_id, 1.0::DOUBLE AS score, rank FROM pop_recs"))
def r16(spark, d):
    h = pos_history(spark, d)
    return recall.by_popularity(h.select("user_id").distinct(), recall.popularity(h), h, k=50)


@query("r17_bpr_train")
def r17(spark, d):
    return bpr.train_bpr(pos_history(spark, d)).filter("kind <> 'loss'").select("kind", "id", F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(S.norm(F.col("vec")), 6).alias("length"))


@query("r18_bpr_recall")
def r18(spark, d):
    h = pos_history(spark, d)
    v = bpr.train_bpr(h)
    q = v.filter("kind = 'user'").select(F.col("id").alias("user_id"), "vec")
    return recall.by_vectors(q, v.filter("kind = 'item'").select(F.col("id").alias("item_id"), "vec"), h, k=50)


def _tower(spark, d):
    return factors.train_two_tower(H.next_item_pairs(pos_history(spark, d)))


@query("r19_two_tower_train")
def r19(spark, d):
    return _tower(spark, d).select("item_id", F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(S.norm(F.col("vec")), 6).alias("length"))


@query("r20_two_tower_recall")
def r20(spark, d):
    h, v = pos_history(spark, d), _tower(spark, d)
    return recall.by_vectors(recall.user_vectors(h, v, cap=20), v, h, k=50)


def _profiles(spark, d):
    u = users(spark, d).withColumn("age_bucket", S.bucket_age(F.col("age")))
    for c in factors.PROFILE:
        u = u.join(factors.category_vocabulary(u, c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0)))
    return u.select("user_id", *[F.col(f"{c}_code").alias(c) for c in factors.PROFILE])


def _user_tower(spark, d):
    """The trained tower, stored, and the vectors of all users with a history."""
    from quillon.sources.paths import stored, work_dir

    h, p = pos_history(spark, d), _profiles(spark, d)
    model = stored(factors.train_user_tower(H.next_item_pairs(h).join(p, "user_id")), work_dir(spark, "tower"))
    return model, factors.tower_users(model, H.last(h, 20).select("user_id", "item_id"), p.join(h.select("user_id").distinct(), "user_id", "left_semi"))


def _tower_items(model):
    return model.filter("kind = 'item'").select(F.col("id").alias("item_id"), "vec")


@query("r21_user_tower")
def r21(spark, d):
    return _user_tower(spark, d)[1].select("user_id", F.size("vec").alias("dim"), F.round(S.norm(F.col("vec")), 6).alias("length"))


_NORM = "sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]))"
_UNIT = f"SELECT vec_id, [CAST(x AS DOUBLE) / {_NORM} FOR x IN embedding] AS v FROM embeddings"


@query("r22_user_vector_service", sql("""SELECT user_id, coalesce(known, 0) AS known, 1.0::DOUBLE AS length, round(u[1] / sqrt(list_sum([x * x FOR x IN u])), 6) AS first, round(u[64] / sqrt(list_sum([x * x FOR x IN u])), 6) AS last
    FROM (SELECT DISTINCT user_id FROM history) LEFT JOIN pooled USING (user_id)""",
    weighed="""SELECT user_id, v, count(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS p
        FROM (SELECT * FROM history WHERE n - pos < 20) h JOIN unit ON vec_id = item_id""",
    pooled="""SELECT user_id, max(m) AS known, list(y ORDER BY dd) AS u FROM (SELECT user_id, dd, max(m) AS m, sum(v[dd] * CASE WHEN m > 1 THEN 0.6 + 0.4 * (p - 1) / (m - 1) ELSE 0.6 END) AS y
        FROM (SELECT *, unnest(range(1, 65)) AS dd FROM weighed) GROUP BY 1, 2) GROUP BY 1""", unit=_UNIT))  # fmt: skip
def r22(spark, d):
    """Vectors of all users by the service's rule: length, first and last component (null where no item is known and the direction is drawn)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), S.l2(F.col("embedding")).alias("vec"))
    out = factors.served_vectors(H.last(pos_history(spark, d), 20), v, 64)
    at = lambda i: F.when(F.col("known") > 0, F.round(F.get("vec", F.lit(i)), 6))
    return out.select("user_id", "known", F.round(S.norm(F.col("vec")), 6).alias("length"), at(0).alias("first"), at(63).alias("last"))


@query("r23_last_item_neighbours", sql(f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT h.user_id, b.vec_id AS item_id, round(list_sum([a.v[i] * b.v[i] FOR i IN range(1, 65)]), 6) AS score FROM history h JOIN unit a ON a.vec_id = h.item_id, unit b
    WHERE h.pos = h.n AND h.user_id % 20 = 0) x WHERE {SEEN}) WHERE rank <= 20""", unit=_UNIT))  # fmt: skip
def r23(spark, d):
    h = pos_history(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), S.l2(F.col("embedding")).alias("vec"))
    newest = h.filter("pos = n and user_id % 20 = 0").join(v, "item_id").select("user_id", "vec")
    return recall.by_vectors(newest, v, h, k=20, digits=6)


_BY_GENRE = """SELECT user_id, item_id, 0.8::DOUBLE AS score, rank FROM (SELECT w.user_id, r.item_id, row_number() OVER (PARTITION BY w.user_id ORDER BY r.avg_rating DESC, r.item_id) AS rank
    FROM (SELECT DISTINCT user_id, item_id FROM wanted JOIN item_genres USING (genre)) w JOIN rated_items r USING (item_id) WHERE r.avg_rating >= 5) WHERE rank <= 20"""
_NEAR_NEWEST = f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT h.user_id, b.vec_id AS item_id, round(list_sum([a.v[i] * b.v[i] FOR i IN range(1, 65)]), 6) AS score FROM history h JOIN unit a ON a.vec_id = h.item_id, unit b
    WHERE h.pos = h.n) x WHERE {SEEN}) WHERE rank <= 50"""
_LIVE_POPULAR = f"""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT u.user_id, t.item_id, round(t.avg_rating * ln(1 + t.rating_count), 9) AS score FROM (SELECT DISTINCT user_id FROM positives) u,
    (SELECT item_id, avg_rating, rating_count FROM rated_items WHERE avg_rating IS NOT NULL ORDER BY avg_rating DESC, rating_count DESC, item_id LIMIT 150) t) x WHERE {SEEN}) WHERE rank <= 50"""
_WANTED = "SELECT user_id, genre FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS r FROM history JOIN item_genres USING (item_id) GROUP BY 1, 2) WHERE r <= 3"


@query("r24_preference_recall", rsql(_BY_GENRE, wanted=_WANTED))
def r24(spark, d):
    from quillon.sources.sinks import profiles

    g = profiles(pos_history(spark, d), items(spark, d), users(spark, d))["genres"]
    return rerank.by_user_genres(g.select("user_id", "genre"), rated_items(spark, d))


@query("r25_live_popular", rsql(f"""SELECT user_id, item_id, round(avg_rating * ln(1 + rating_count), 9) AS score FROM (SELECT u.user_id, t.* FROM (SELECT DISTINCT user_id FROM positives) u,
    (SELECT item_id, avg_rating, rating_count FROM rated_items WHERE avg_rating IS NOT NULL ORDER BY avg_rating DESC, rating_count DESC, item_id LIMIT 60) t) x WHERE {SEEN}"""))  # fmt: skip
def r25(spark, d):
    from quillon.operators.catalog_ops import best_rated

    h = pos_history(spark, d)
    head = best_rated(rated_items(spark, d).filter("avg_rating is not null"), 60)
    both = h.select("user_id").distinct().crossJoin(F.broadcast(head))  # 60 rows
    return H.unseen(both, h).select("user_id", "item_id", F.round(S.live_popularity(F.col("avg_rating"), F.col("rating_count")), D).alias("score"))


@query("r26_online_cf", sql(recall_sql("itemcf", 100, 0.05, 20)))
def r26(spark, d):
    h = kept_history(spark, d)
    return recall.by_edges(h, recall.itemcf(h), h, cap=100, rate=0.05, k=20, dedupe=False)


@query("r27_batch_tower_recall")
def r27(spark, d):
    model, vectors = _user_tower(spark, d)
    return recall.by_vectors(vectors, _tower_items(model), pos_history(spark, d), k=50)


@query("r28_online_tower_recall")
def r28(spark, d):
    model, vectors = _user_tower(spark, d)
    return recall.by_vectors(vectors, _tower_items(model), pos_history(spark, d), k=20)


# ---- fusion -------------------------------------------------------------------


def _inputs(spark, d, k=50, **more):
    """The history is written once, as every channel reads it."""
    return strategies.Inputs(kept_history(spark, d), items(spark, d), k, **more)


def lists(spark, d, k=50):
    return strategies.recall_lists(_inputs(spark, d, k), strategies.IN_SQL)


LISTS = {
    "l_itemcf": recall_sql("itemcf", 50, 0.05, 50), "l_seqcf": recall_sql("seqcf", *recall.EDGE_CHANNELS["seqcf"], 50), "l_swing": recall_sql("swing", *recall.EDGE_CHANNELS["swing"], 50),
    "l_usercf": USERCF_RECALL, "l_genre": GENRE_RECALL, "l_popular": "SELECT user_id, item_id, 1.0 AS score, rank FROM pop_recs", **GENRE_VIEWS,
    "chan": " UNION ALL ".join(f"SELECT user_id, item_id, rank, '{c}' AS channel, {i} AS no FROM l_{c}" for i, c in enumerate(strategies.IN_SQL)),
}


def _weights_sql(weights, channels=strategies.IN_SQL):
    return "CASE channel " + " ".join(f"WHEN '{c}' THEN {weights.get(c, 1.0)}" for c in channels) + " END"


_W, _LIVE = _weights_sql(fusion.HYBRID), _weights_sql(fusion.LIVE_WEIGHTS, strategies.LIVE_IN_SQL)
RRF = f"""SELECT user_id, item_id, score, channel, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT user_id, item_id, round(sum({_W} / (60 + rank)), 9) AS score, arg_min(channel, no) AS channel FROM chan GROUP BY 1, 2)) WHERE rank <= 100"""


@query("m01_weighted_rrf", sql(RRF, **LISTS))
def m01(spark, d):
    return fusion.weighted_rrf(fusion.channels(**lists(spark, d)), fusion.HYBRID, k=100)


def _fused(spark, d):
    """m01's lists written once, for plans that read them more than once."""
    from quillon.sources.paths import stored, work_dir

    return stored(m01(spark, d), work_dir(spark, "fused"))


def _merge_sql(place: str) -> str:
    return f"""SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY min(p * 10 + no)) AS rank FROM (
    SELECT *, {place} AS p FROM (SELECT *, count(*) OVER (PARTITION BY user_id, no) AS len FROM chan)) GROUP BY 1, 2) WHERE rank <= 20"""


@query("m02_snake_merge", sql(_merge_sql("CASE WHEN no % 2 = 0 THEN rank - 1 ELSE len - rank END"), **LISTS))
def m02(spark, d):
    return fusion.snake_merge(fusion.channels(**lists(spark, d)))


@query("m03_round_robin", sql(_merge_sql("rank - 1"), **LISTS))
def m03(spark, d):
    return fusion.round_robin(fusion.channels(**lists(spark, d)))


def _live(spark, d, k=50, learned=True):
    """What the live channels read; with the trained tower, if ``learned``."""
    from quillon.sources.paths import stored, work_dir
    from quillon.sources.sinks import profiles

    h, i = kept_history(spark, d), items(spark, d)
    liked = profiles(h, i, users(spark, d))["genres"].select("user_id", "genre")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), S.l2(F.col("embedding")).alias("vec"))
    tower = None
    if learned:
        model, of_users = _user_tower(spark, d)
        tower = stored(of_users, work_dir(spark, "users")), _tower_items(model)
    return strategies.Live(h, i, liked, stored(rated_items(spark, d), work_dir(spark, "rated")), vectors, tower, k=k)


_LIVE_LISTS = {
    "l_user_preference": _BY_GENRE.replace("rank <= 20", "rank <= 50"), "wanted": _WANTED, "l_item_embedding": _NEAR_NEWEST, "unit": _UNIT, "l_popular": _LIVE_POPULAR, "l_usercf": USERCF_RECALL,
    **{f"l_{c}": recall_sql(c, 100, recall.EDGE_CHANNELS[c][1], 50) for c in ("itemcf", "seqcf", "swing")},
    "chan": " UNION ALL ".join(f"SELECT user_id, item_id, rank, '{c}' AS channel, {i} AS no FROM l_{c}" for i, c in enumerate(strategies.LIVE_IN_SQL)),
}


@query("m04_live_weights", rsql(f"""SELECT user_id, item_id, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT user_id, item_id, round(sum({_LIVE} / (60 + rank)), 9) AS score, arg_min(channel, no) AS channel FROM chan GROUP BY 1, 2)) WHERE rank <= 20""", **_LIVE_LISTS))  # fmt: skip
def m04(spark, d):
    """The live flow's channels without the two that are learned."""
    lists = strategies.live_lists(_live(spark, d, learned=False), strategies.LIVE_IN_SQL)
    return fusion.weighted_rrf(fusion.channels(**lists), fusion.LIVE_WEIGHTS, k=20, missing=1.0).select("user_id", "item_id", "score", "channel")


@query("m04_live_channels")
def m04b(spark, d):
    """All channels that the live flow has switched on."""
    return fusion.weighted_rrf(fusion.channels(**strategies.live_lists(_live(spark, d))), fusion.LIVE_WEIGHTS, k=20, missing=1.0)


_PROFILES = {"hybrid": fusion.HYBRID, "hybrid_recall": fusion.HYBRID_RECALL}


@query("m05_offline_profiles", sql(" UNION ALL ".join(f"""SELECT '{p}' AS profile, user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT user_id, item_id, round(sum({_weights_sql(w)} / (60 + rank)), 9) AS score FROM chan GROUP BY 1, 2)) WHERE rank <= 20""" for p, w in _PROFILES.items()), **LISTS))  # fmt: skip
def m05(spark, d):
    """Both fixed profiles over the same lists."""
    from quillon.sources.paths import stored, work_dir

    ranked = stored(fusion.channels(**lists(spark, d)), work_dir(spark, "lists"))
    out = [fusion.weighted_rrf(ranked, w, k=20).select(F.lit(p).alias("profile"), "user_id", "item_id", "score", "rank") for p, w in _PROFILES.items()]
    return out[0].unionByName(out[1])


def _validation(spark, d):
    """Histories of the training rows, and the validation rows after them."""
    from quillon.operators.evaluation import time_split
    from quillon.sources.paths import stored, work_dir

    s = time_split(pos_history(spark, d), valid=0.1)
    train = stored(H.history(s.filter("part = 'train'").drop("pos", "n", "part")), work_dir(spark, "train"))
    return train, s.filter("part = 'valid'").select("user_id", "item_id")


def offline_lists(spark, d, train, k):
    return strategies.recall_lists(strategies.Inputs(train, items(spark, d), k, content=_content(spark, d, train)), strategies.OFFLINE)


def tower_list(spark, d, train, k):
    """The list of a user tower that is trained on the given histories."""
    from quillon.sources.paths import stored, work_dir

    p = _profiles(spark, d)
    model = stored(factors.train_user_tower(H.next_item_pairs(train).join(p, "user_id")), work_dir(spark, "tower"))
    served = factors.tower_users(model, H.last(train, 20).select("user_id", "item_id"), p.join(train.select("user_id").distinct(), "user_id", "left_semi"))
    return recall.by_vectors(served, _tower_items(model), train, k=k)


@query("m06_weight_search")
def m06(spark, d):
    """All 328 profiles over all eight channels: lists from the training rows, judged by the validation rows."""
    train, truth = _validation(spark, d)
    return fusion.search_weights(fusion.channels(**offline_lists(spark, d, train, 50)), truth, k=20)


@query("m06_tower_weight_search")
def m06b(spark, d):
    """The 69 profiles of the search with a user tower."""
    train, truth = _validation(spark, d)
    ranked = fusion.channels(**offline_lists(spark, d, train, 50), user_tower=tower_list(spark, d, train, 50))
    return fusion.search_weights(ranked, truth, k=20, profiles=fusion.tower_profiles())


# ---- ranking ------------------------------------------------------------------

FEATURES = {
    "us": "SELECT user_id, avg(rating) AS u_avg, count(*) AS u_cnt, (max(ts) - min(ts)) / 86400.0 AS u_days FROM interactions GROUP BY 1",
    "its": "SELECT item_id, avg(rating) AS i_avg, count(*) AS i_cnt FROM interactions GROUP BY 1",
    "feat": f"""SELECT r.user_id, r.item_id, r.rating, u.gender, CAST(u.age AS VARCHAR) AS age, u.occupation, u.zip_code,
        CASE WHEN u_avg IS NULL OR u_avg <= 0 THEN 'Unknown' ELSE {half_star_sql('u_avg')} END AS user_avg_rating_bin,
        CASE WHEN u_cnt IS NULL THEN 'Unknown' ELSE {steps_sql('u_cnt', _COUNT, '501+')} END AS user_rating_count_bin, CASE WHEN u_days IS NULL THEN 'Unknown' ELSE {steps_sql('floor(u_days)', _DAYS, '365+')} END AS user_active_days_bin,
        i.genres[1] AS genre, CAST(i.is_adult AS VARCHAR) AS is_adult, CASE WHEN year < 1950 THEN 'pre-1950' ELSE CAST(year // 10 * 10 AS VARCHAR) || 's' END AS year_bin, CASE WHEN i_avg IS NULL OR i_avg <= 0 THEN 'Unknown' ELSE {half_star_sql('i_avg')} END AS avg_rating_bin,
        CASE WHEN i_cnt IS NULL THEN 'Unknown' ELSE {steps_sql('i_cnt', _COUNT, '501+')} END AS rating_count_bin, replace({half_star_sql('coalesce(u_avg, 0) - coalesce(i_avg, 0)')}, '-0.0', '0.0') AS rating_deviation_bin,
        {half_star_sql('imdb_rating')} AS imdb_rating_bin, {steps_sql('floor(imdb_votes)', _VOTES, '500K+')} AS imdb_votes_bin
        FROM interactions r JOIN users u USING (user_id) JOIN items i ON i.item_id = r.item_id JOIN us ON us.user_id = r.user_id JOIN its ON its.item_id = r.item_id""",
}


def samples(spark, d):
    r = interactions(spark, d)
    return ranking.features(ranking.label(r, 8.0).select("user_id", "item_id", "rating", "click"), users(spark, d), items(spark, d), r)


@query("n01_ranking_samples", sql("SELECT *, CASE WHEN rating >= 8 THEN 1 ELSE 0 END AS click FROM feat", **FEATURES))
def n01(spark, d):
    return samples(spark, d)


@query("n02_labels", sql("SELECT user_id, item_id, CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END AS click, CASE WHEN rating >= avg(rating) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS relative FROM interactions"))
def n02(spark, d):
    r = ranking.label(interactions(spark, d))
    return ranking.label(r.withColumnRenamed("click", "absolute"), relative=True).select("user_id", "item_id", F.col("absolute").alias("click"), F.col("click").alias("relative"))


@query("n03_user_split", sql(_SPLIT))
def n03(spark, d):
    return ranking.user_split(users(spark, d))


@query("n04_negative_sampling", sql("""SELECT user_id, item_id, negative, pick FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY dd) AS pick FROM (SELECT user_id, item_id, negative, min(dd) AS dd FROM (
    SELECT p.user_id, p.item_id, i.item_id AS negative, dd FROM (SELECT user_id, item_id, dd, CAST('0x' || substr(md5(concat_ws('|', user_id, item_id, dd, 42)), 1, 12) AS BIGINT) % (SELECT count(*) FROM items) AS place
        FROM positives, range(1, 17) r(dd)) p JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM items) i USING (place)) x
    WHERE NOT EXISTS (SELECT 1 FROM interactions s WHERE s.user_id = x.user_id AND s.item_id = x.negative) GROUP BY 1, 2, 3)) WHERE pick <= 4"""))  # fmt: skip
def n04(spark, d):
    from quillon.sources.paths import stored, work_dir

    r = stored(interactions(spark, d), work_dir(spark, "ratings"))
    return ranking.sample_negatives(H.positives(r), r, items(spark, d))


_ENC = (*ranking.USER_FEATURES, *ranking.ITEM_FEATURES)
#: Clicks, the other rated pairs, and four sampled items for each click.
TRAINING = {
    "drawn": """SELECT user_id, negative AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY dd) AS pick FROM (SELECT user_id, item_id, negative, min(dd) AS dd FROM (
        SELECT p.user_id, p.item_id, i.item_id AS negative, dd FROM (SELECT user_id, item_id, dd, CAST('0x' || substr(md5(concat_ws('|', user_id, item_id, dd, 42)), 1, 12) AS BIGINT) % (SELECT count(*) FROM items) AS place
            FROM (SELECT * FROM interactions WHERE rating >= 8), range(1, 17) r(dd)) p JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM items) i USING (place)) x
        WHERE NOT EXISTS (SELECT 1 FROM interactions s WHERE s.user_id = x.user_id AND s.item_id = x.negative) GROUP BY 1, 2, 3)) WHERE pick <= 4""",
    "sampled": "SELECT user_id, item_id, rating, CASE WHEN rating >= 8 THEN 1 ELSE 0 END AS click FROM interactions UNION ALL SELECT user_id, item_id, 0, 0 FROM drawn",
    "feat": FEATURES["feat"].replace("FROM interactions r JOIN", "FROM sampled r JOIN").replace("r.rating,", "r.rating, r.click,"),
    "parted": "SELECT f.*, s.part FROM feat f JOIN (SELECT user_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS part FROM "
    "(SELECT user_id, CAST('0x' || substr(md5(concat_ws('|', user_id, 42)), 1, 7) AS BIGINT) / 268435456.0 AS u FROM users)) s USING (user_id)",
} | {k: FEATURES[k] for k in ("us", "its")}
_CODES = "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM parted WHERE part = 'train')"


def training_rows(spark, d):
    """Samples with their features and the part of their user."""
    from quillon.sources.paths import stored, work_dir

    u = users(spark, d)
    rows = ranking.training_samples(stored(interactions(spark, d), work_dir(spark, "ratings")), u, items(spark, d))
    return rows.join(ranking.user_split(u), "user_id")


@query("n05_label_encoding", sql("SELECT user_id, item_id, click, part, " + ", ".join(f"coalesce(v_{c}.code, 0) AS x_{c}" for c in _ENC) + " FROM parted f " + " ".join(f"LEFT JOIN ({_CODES.format(c=c)}) v_{c} ON v_{c}.value = CAST(f.{c} AS VARCHAR)" for c in _ENC), **TRAINING))
def n05(spark, d):
    return encoded(spark, d)[1]


@query("k09_encoded_and_vocabulary", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, * FROM ({_CODES.format(c=c)})" for c in _ENC), **TRAINING))
def k09(spark, d):
    return encoded(spark, d)[0]


def encoded(spark, d):
    """The vocabulary of the training users' samples, and all samples with codes (x_...), both written."""
    from quillon.sources.paths import stored, work_dir

    path = work_dir(spark, "encoded")
    s = stored(training_rows(spark, d), f"{path}/samples")
    vocab = stored(ranking.fit_vocabulary(s.filter("part = 'train'"), _ENC), f"{path}/vocabulary")
    return vocab, stored(ranking.encode(s, vocab, _ENC, "x_").select("user_id", "item_id", "click", "part", *[f"x_{c}" for c in _ENC]), f"{path}/rows")


@query("n06_fm_term", """SELECT vec_id, round((pow(a0 + b0, 2) - a0 * a0 - b0 * b0 + pow(a1 + b1, 2) - a1 * a1 - b1 * b1) / 2, 9) AS fm FROM (
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a0, CAST(embedding[2] AS DOUBLE) AS a1, CAST(embedding[3] AS DOUBLE) AS b0, CAST(embedding[4] AS DOUBLE) AS b1 FROM embeddings)""")
def n06(spark, d):
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(ranking.fm_term(F.array(F.array(x(0), x(1)), F.array(x(2), x(3)))), D).alias("fm"))


def deepfm(spark, d):
    """A model trained on the training users' samples, with the validation users to stop by; the vocabulary, encoded rows and validation losses."""
    vocab, rows = encoded(spark, d)
    dims = {r["feature"]: r["n"] for r in vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ranking.DeepFM(tuple(f"x_{c}" for c in _ENC), [max(1, dims.get(c, 1)) for c in _ENC])
    losses = model.fit(rows.filter("part <> 'test'"), ("user_id", "item_id", "click"), held=F.col("part") == "valid")
    return model, vocab, rows, losses


@query("n07_deepfm_train")
def n07(spark, d):
    losses = deepfm(spark, d)[3]
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "epoch int, loss double")


@query("n08_ctr_predict")
def n08(spark, d):
    """Predictions for all samples of all users."""
    model, _, rows, _ = deepfm(spark, d)
    return model.predict(rows)


@query("n09_rank_by_ctr", sql("""SELECT user_id, item_id, final AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, item_id) AS rank FROM (
    SELECT user_id, item_id, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE score END AS final FROM rrf_list)) WHERE rank <= 20""", rrf_list=RRF, **LISTS))  # fmt: skip
def n09(spark, d):
    c = _fused(spark, d)
    return ranking.rank_candidates(c, c.filter("item_id % 2 = 0").select("user_id", "item_id", F.lit(0.5).alias("pred")))


@query("n10_rank_by_recall", sql("SELECT user_id, item_id, score, rank FROM rrf_list WHERE rank <= 20", rrf_list=RRF, **LISTS))
def n10(spark, d):
    return ranking.rank_candidates(m01(spark, d), None)


@query("n11_ranking_stage", sql("""SELECT user_id, count(*) AS n, max(final) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, item_id) AS r FROM (
    SELECT user_id, item_id, coalesce(ctr, score) AS final FROM rrf_list LEFT JOIN (SELECT item_id, round(avg(CASE WHEN rating >= 8 THEN 1.0 ELSE 0.0 END), 9) AS ctr FROM interactions GROUP BY 1) USING (item_id))) WHERE r <= 20 GROUP BY 1""",
    rrf_list=RRF, **LISTS))
def n11(spark, d):
    """The stage with a model: an item's share of clicks stands for it, so SQL can say the same."""
    c = _fused(spark, d)
    ctr = interactions(spark, d).groupBy("item_id").agg(F.round(F.avg((F.col("rating") >= 8).cast("double")), D).alias("pred"))
    return strategies.rank_stage(c, c.select("user_id", "item_id").join(ctr, "item_id"), k=20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("n12_ctr_fallback", sql("SELECT user_id, item_id, score AS pred FROM rrf_list WHERE rank <= 5", rrf_list=RRF, **LISTS))
def n12(spark, d):
    """Without a model the stage falls back to the recall score."""
    return strategies.rank_stage(m01(spark, d), None, k=5).select("user_id", "item_id", F.col("score").alias("pred"))


# ---- re-ranking and cold start --------------------------------------------------


def _ranked(spark, d):
    r = ranking.rank_candidates(m01(spark, d), None)
    return r.join(items(spark, d).select("item_id", "genres", "year"), "item_id", "left").select("user_id", "item_id", "score", "rank", "genres", "year")


def _fold_sql(source: str, run: int, free: str, alike: str) -> str:
    """The lists of ``source`` (user_id, items, k: keys) re-ordered by a fold over their places, in two nested reductions."""
    state = lambda p, w, x: f"{{'p': {p}, 'w': {w}, 'x': CAST({x} AS INTEGER)}}"
    none = "CAST([] AS INTEGER[])"

    def fits(p: str, x: str) -> str:
        return f"(len({p}) < {run} OR {free.format(a=f'k[{x}]')} OR len(list_filter({p}[-{run - 1}:], lambda j: NOT {alike.format(a=f'k[{x}]', b='k[j]')})) > 0)"

    again = f"""list_reduce(list_concat([{state("list_append(s.p, e.x)", none, 0)}], [{state(none, none, "j")} FOR j IN list_reverse(s.w)]),
        lambda t, g: CASE WHEN {fits("t.p", "g.x")} THEN {state("list_append(t.p, g.x)", "t.w", 0)} ELSE {state("t.p", "list_prepend(g.x, t.w)", 0)} END)"""
    folded = f"""list_reduce(list_concat([{state(none, none, 0)}], [{state(none, none, "i")} FOR i IN range(1, len(k) + 1)]),
        lambda s, e: CASE WHEN {fits("s.p", "e.x")} THEN {again} ELSE {state("s.p", "list_append(s.w, e.x)", 0)} END)"""
    order = f"CASE WHEN len(k) <= {run} THEN [CAST(i AS INTEGER) FOR i IN range(1, len(k) + 1)] ELSE list_concat(f.p, f.w) END"
    return f"SELECT user_id, [items[i] FOR i IN o] AS items FROM (SELECT user_id, items, {order} AS o FROM (SELECT *, {folded} AS f FROM ({source})))"


_LISTED = "SELECT user_id, list({'item_id': item_id, 'genre': genres[1], 'decade': year // 10} ORDER BY rank) AS items FROM rrf_list JOIN items USING (item_id) WHERE rank <= 20 GROUP BY 1"
_GENRE_FOLD = _fold_sql("SELECT *, [x.genre FOR x IN items] AS k FROM listed", 2, "{a} IS NULL", "({a} IS NOT DISTINCT FROM {b})")
_RANKS = "SELECT user_id, item.item_id AS item_id, rank FROM (SELECT user_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS rank FROM ({}))"


def _decade_fold(source: str) -> str:
    return _fold_sql(f"SELECT *, [x.decade FOR x IN items] AS k FROM {source}", 3, "{a} NOT BETWEEN 190 AND 210", "({a} = {b})")


@query("d01_genre_dispersion", sql(_RANKS.format(_GENRE_FOLD), rrf_list=RRF, listed=_LISTED, **LISTS))
def d01(spark, d):
    return rerank.disperse_genres(_ranked(spark, d)).select("user_id", "item_id", "rank")


@query("d02_decade_dispersion", sql(_RANKS.format(_decade_fold("listed")), rrf_list=RRF, listed=_LISTED, **LISTS))
def d02(spark, d):
    return rerank.disperse_decades(_ranked(spark, d)).select("user_id", "item_id", "rank")


@query("d03_rerank_chain", sql(_RANKS.format(_decade_fold("by_genre")), rrf_list=RRF, listed=_LISTED, by_genre=_GENRE_FOLD, **LISTS))
def d03(spark, d):
    return rerank.chain(_ranked(spark, d), rerank.disperse_genres, rerank.disperse_decades).select("user_id", "item_id", "rank")


@query("b01_cold_users", sql("SELECT user_id, coalesce(n, 0) AS n_history, coalesce(n, 0) < 5 AS cold FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM positives GROUP BY 1) USING (user_id)"))
def b01(spark, d):
    return rerank.cold_users(users(spark, d).select("user_id"), pos_history(spark, d))


def _counters(spark, d, of="user_id % 3 <> 0"):
    """Genre counters; every third user has none, unless all are asked for."""
    g = items(spark, d).select("item_id", F.explode("genres").alias("genre"))
    return interactions(spark, d).filter(of).join(g, "item_id").groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("reward"))


UCB = {
    "counted": "SELECT user_id, genre, count(*) AS n, sum(rating) AS reward FROM interactions JOIN item_genres USING (item_id) WHERE user_id % 3 <> 0 GROUP BY 1, 2",
    "scored": "SELECT *, reward / n + sqrt(2 * ln(100) / n) AS ucb FROM counted",
    "bestg": "SELECT u.user_id, coalesce(b.genre, 'red') AS genre FROM users u LEFT JOIN (SELECT user_id, genre FROM scored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ucb DESC, genre) = 1) b USING (user_id)",
}


@query("b02_ucb_recall", rsql(_BY_GENRE.replace("wanted", "bestg"), **UCB))
def b02(spark, d):
    best = rerank.best_ucb_genre(users(spark, d), _counters(spark, d), "red")
    return rerank.by_user_genres(best.select("user_id", "genre"), rated_items(spark, d))


@query("b03_preferred_recall", rsql(_BY_GENRE, wanted="SELECT user_id, unnest(['red', 'ring']) AS genre FROM users"))
def b03(spark, d):
    w = users(spark, d).select("user_id", F.explode(F.array(F.lit("red"), F.lit("ring"))).alias("genre"))
    return rerank.by_user_genres(w, rated_items(spark, d))


@query("b04_popular_cold", rsql("SELECT item_id, year FROM rated_items WHERE avg_rating >= 5 ORDER BY year DESC, avg_rating DESC, item_id LIMIT 20"))
def b04(spark, d):
    return rerank.by_genres(rated_items(spark, d), []).select("item_id", "year")


_COLD = {
    "c_ucb": _BY_GENRE.replace("wanted", "bestg"), "c_liked": _BY_GENRE.replace("wanted", "likedg"), "likedg": "SELECT user_id, unnest(['blue', 'ring']) AS genre FROM users",
    "c_head": "SELECT item_id, row_number() OVER (ORDER BY avg_rating DESC, rating_count DESC, item_id) AS rank FROM rated_items WHERE avg_rating >= 5 QUALIFY rank <= 20",
    "cchan": "SELECT user_id, item_id, rank, 0 AS no FROM c_ucb UNION ALL SELECT user_id, item_id, rank, 1 FROM c_liked UNION ALL SELECT user_id, item_id, rank, 2 FROM c_head, (SELECT user_id FROM users)",
}


@query("b05_cold_pipeline", rsql(_merge_sql("rank - 1").replace("FROM chan", "FROM cchan"), **_COLD, **UCB))
def b05(spark, d):
    u = users(spark, d)
    profile = u.select("user_id", F.array(F.lit("blue"), F.lit("ring")).alias("genres"))
    return strategies.cold_lists(strategies.Cold(u, _counters(spark, d), profile, rated_items(spark, d), "red"))


@query("b06_enrichment", sql("""SELECT u.user_id, u.gender, coalesce(h.items, '') AS history, coalesce(s.n, 0) AS rating_count, round(coalesce(s.a, 0), 9) AS avg_rating FROM users u
    LEFT JOIN (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS items FROM history WHERE n - pos < 100 GROUP BY 1) h USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n, avg(rating) AS a FROM interactions GROUP BY 1) s ON s.user_id = u.user_id"""))  # fmt: skip
def b06(spark, d):
    u = users(spark, d)
    stats = ranking.user_stats(interactions(spark, d)).select("user_id", "avg_rating", "rating_count")
    out = rerank.enrich(u.select("user_id"), u.select("user_id", "gender"), pos_history(spark, d), stats)
    return out.select("user_id", "gender", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"), "rating_count", F.round("avg_rating", D).alias("avg_rating"))


def click_rates(spark, d, pairs):
    """The click model's predictions for user_id, item_id pairs: features and codes as in training."""
    model, vocab, _, _ = deepfm(spark, d)
    full = ranking.features(pairs.select("user_id", "item_id"), users(spark, d), items(spark, d), interactions(spark, d))
    return model.predict(ranking.encode(full, vocab, _ENC, "x_"), keep=("user_id", "item_id"))


@query("p01_all_users")
def p01(spark, d):
    """The live flow: its channels, fused, ranked by the click model, dispersed; cold users by their stored genres and counters."""
    from quillon.sources.paths import stored, work_dir
    from quillon.sources.sinks import profiles

    x = _live(spark, d)
    cold = rerank.cold_users(users(spark, d).select("user_id"), x.hist).filter("cold").select("user_id")
    liked = profiles(x.hist, x.items, users(spark, d))["genres"].groupBy("user_id").agg(F.collect_set("genre").alias("genres"))
    first = strategies.cold_lists(strategies.Cold(cold, _counters(spark, d, "true"), liked, x.rated, "red"))
    fused = fusion.weighted_rrf(fusion.channels(**strategies.live_lists(x)), fusion.LIVE_WEIGHTS, k=100, missing=1.0)
    fused = stored(H.unseen(fused, x.hist), work_dir(spark, "fused"))
    return rerank.whole_flow(fused, x.items, first, ctr=click_rates(spark, d, fused))
