"""Queries: sources, sinks, filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import catalog_ops as C
from quillon.operators import history as H
from quillon.operators import ranking, recall
from quillon.operators.history import top
from quillon.operators.spread import spread
from quillon.plans.registry import query
from quillon.sources import columns, npy, sinks
from quillon.sources.paths import resolve_data_dir, stored, work_dir
from quillon.sources.tables import interactions, items, line_tasks, ratings_of_events, sql, table, users

D = 9  # digits of rounded results


def rated_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with avg_rating and rating_count of all interactions (null where there are none)."""
    return items(spark, d).join(ranking.item_stats(interactions(spark, d)), "item_id", "left")


def pos_history(spark: SparkSession, d: str) -> DataFrame:
    return H.history(H.positives(interactions(spark, d)))


def kept_history(spark: SparkSession, d: str) -> DataFrame:
    """pos_history written once, for plans that read it more than once."""
    return stored(pos_history(spark, d), work_dir(spark, "history"))


RATED = """rated_items AS (SELECT i.*, s.avg_rating, s.rating_count FROM items i LEFT JOIN (SELECT item_id, avg(rating) AS avg_rating, count(*) AS rating_count
    FROM interactions GROUP BY 1) s USING (item_id))"""


def rsql(body: str, **more: str) -> str:
    """sql() with a view of rated items."""
    return sql(body, rated_items=RATED.split(" AS (", 1)[1][:-1], **more)


# ---- sources ------------------------------------------------------------------


@query("s01_load_frame", "SELECT p_partkey, p_name, p_size FROM part")
def s01(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


@query("s02_resolve_dir", "SELECT count(*) AS n FROM orders")
def s02(spark, d):
    return table(spark, resolve_data_dir(spark, d), "orders").agg(F.count(F.lit(1)).alias("n"))


@query("s03_normalize_columns", sql("SELECT user_id, item_id, rating, ts FROM interactions"))
def s03(spark, d):
    raw = interactions(spark, d).select(F.col("user_id").alias("UserID"), F.col("item_id").alias("MovieId"), F.col("rating").alias("Rating"), F.col("ts").alias("Time"))
    return columns.normalise(raw)


@query("s04_missing_ts", sql("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS ts FROM interactions"))
def s04(spark, d):
    return columns.fill_ts(interactions(spark, d).select("user_id", "item_id"))


@query("s05_projected_scan", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def s05(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("s06_read_edges_csv", sql("SELECT item_id, related_id, score, rank FROM itemcf WHERE rank <= 10"))
def s06(spark, d):
    path = work_dir(spark, "edges")
    sinks.write_edges(recall.itemcf(kept_history(spark, d), k=10), path)
    return sinks.read_edges(spark, path).select("item_id", "related_id", "score", "rank")


@query("s07_read_user_items_csv", sql("SELECT user_id, item_id, n - pos + 1 AS rank FROM history WHERE n - pos < 100"))
def s07(spark, d):
    path = work_dir(spark, "user-items")
    sinks.write_user_items(pos_history(spark, d), path)
    return sinks.read_user_items(spark, path)


@query("s08_npy_vectors", "SELECT vec_id AS item_id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def s08(spark, d):
    """Vectors written as .npy files, a pair for each task, and read back by ranges of rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    rows = npy.read_pairs(npy.write_vectors(v, work_dir(spark, "npy")))
    return rows.select("item_id", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


@query("s09_index_scan", rsql("SELECT item_id, title FROM rated_items WHERE list_has_any(genres, ['red', 'small']) AND avg_rating >= 5"))
def s09(spark, d):
    return rated_items(spark, d).filter(F.arrays_overlap("genres", F.array(F.lit("red"), F.lit("small"))) & (F.col("avg_rating") >= 5)).select("item_id", "title")


@query("s10_kv_reads", """SELECT user_id, event_type AS genre, CAST(count(*) AS DOUBLE) AS n, CAST(sum(ceil(value)) AS DOUBLE) AS reward FROM events GROUP BY 1, 2""")
def s10(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil("value")).alias("reward"))
    fields = F.explode(F.array(*[F.struct(F.concat_ws(":", "event_type", F.lit(c)).alias("field"), F.col(c).cast("string").alias("value")) for c in ("n", "reward")])).alias("x")
    return sinks.parse_counters(g.select("user_id", fields).select("user_id", "x.field", "x.value"))


@query("s11_vector_by_id", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (1, 7, 42)")
def s11(spark, d):
    e = table(spark, d, "embeddings").filter(F.col("vec_id").isin(1, 7, 42))
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


_NORM = "sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]))"


@query("s12_factor_artifacts", f"SELECT vec_id AS item_id, round(embedding[1] / {_NORM}, 6) AS x0, round(embedding[64] / {_NORM}, 6) AS x63 FROM embeddings")
def s12(spark, d):
    path = work_dir(spark, "factors")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    sinks.save_artifact(v, path, kind="bpr")
    got = sinks.load_vectors(spark, path)
    return got.select("item_id", F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(F.get("vec", F.lit(63)), 6).alias("x63"))


@query("s13_default_vector", """WITH m AS (SELECT d, avg(CAST(embedding[d] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(d) GROUP BY 1)
SELECT CAST(d - 1 AS INTEGER) AS d, round(x / (SELECT sqrt(sum(x * x)) FROM m), 6) AS x FROM m""")
def s13(spark, d):
    m = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = m.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return m.crossJoin(F.broadcast(length)).select("d", F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query("s14_saved_predictions", sql("SELECT user_id, item_id, CASE WHEN rating >= 8 THEN 1 ELSE 0 END AS label, round(rating / 10.0, 4) AS pred FROM interactions"))
def s14(spark, d):
    preds = interactions(spark, d).select("user_id", "item_id", (F.col("rating") >= 8).cast("int").alias("label"), F.round(F.col("rating") / 10.0, 4).alias("pred"))
    return stored(preds, work_dir(spark, "preds"))


# ---- sinks --------------------------------------------------------------------

_HALVES = {"old": "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'",
           "fresh": "SELECT o_orderkey - 1000 AS id, 'N' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"}


def _halves(spark, d):
    o = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = o.filter(F.col("o_orderdate") < cut).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.filter(F.col("o_orderdate") >= cut).select((F.col("o_orderkey") - 1000).alias("id"), F.lit("N").alias("status"), (F.col("o_totalprice") + 1).alias("price"))
    return old, new


@query("k01_upsert", sql("""SELECT coalesce(f.id, o.id) AS id, coalesce(f.status, o.status) AS status, coalesce(o.price, f.price) AS price
    FROM old o FULL JOIN fresh f ON o.id = f.id""", **_HALVES))  # fmt: skip
def k01(spark, d):
    return sinks.upsert(*_halves(spark, d), "id", keep_old=("price",))


@query("k02_insert_absent", sql("SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM old)", **_HALVES))
def k02(spark, d):
    old, new = _halves(spark, d)
    return sinks.insert_absent(old, new.unionByName(new.withColumn("price", F.col("price") + 5)), ["id"], "price")


@query("k03_truncate_load", "SELECT s_suppkey, s_name FROM supplier")
def k03(spark, d):
    path = work_dir(spark, "reload")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    sinks.reload(s.limit(1), path)
    return sinks.reload(s, path)


@query("k05_kv_populate", sql("""SELECT user_id, genre, c, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, genre) AS rank
    FROM (SELECT user_id, genre, count(*) AS c FROM history JOIN item_genres USING (item_id) GROUP BY 1, 2)) WHERE rank <= 3"""))  # fmt: skip
def k05(spark, d):
    return sinks.profiles(pos_history(spark, d), items(spark, d), users(spark, d), tasks=line_tasks(spark, d))["genres"]


@query("k06_edges_csv", sql("SELECT item_id, count(*) AS n, max(rank) AS most FROM itemcf WHERE rank <= 20 GROUP BY 1"))
def k06(spark, d):
    path = work_dir(spark, "edges")
    sinks.write_edges(recall.itemcf(kept_history(spark, d), k=20), path)
    return spark.read.option("header", True).schema("item_id long, related_id long, rank long, score double").csv(path).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("most"))


@query("k07_user_items_csv", sql("SELECT user_id, count(*) AS n FROM history WHERE n - pos < 5 GROUP BY 1"))
def k07(spark, d):
    path = work_dir(spark, "user-items")
    sinks.write_user_items(pos_history(spark, d), path, cap=5)
    return sinks.read_user_items(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("k08_popular_csv", sql("SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank, score FROM pop"))
def k08(spark, d):
    path = work_dir(spark, "popular")
    ranked = H.numbered(recall.popularity(H.positives(interactions(spark, d))), F.desc("score"), F.col("item_id"))
    ranked.select("item_id", "rank", "score").write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).schema("item_id long, rank long, score double").csv(path)


@query("k10_metrics_files", "SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1")
def k10(spark, d):
    path = work_dir(spark, "metrics")
    m = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    m.write.mode("overwrite").json(f"{path}/json")
    m.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    a, b = spark.read.schema(m.schema).json(f"{path}/json"), spark.read.schema(m.schema).option("header", True).csv(f"{path}/csv")
    return a.join(b, ["name", "n"])


_NINE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query("k11_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _NINE) + " UNION ALL SELECT 'customer.c_mktsegment', count(c_mktsegment) FROM customer UNION ALL SELECT 'events.value', count(value) FROM events")
def k11(spark, d):
    return sinks.row_counts({t: table(spark, d, t) for t in _NINE}, {"customer": "c_mktsegment", "events": "value"})


@query("k13_insert_new_user", sql("SELECT user_id, email FROM users UNION ALL SELECT -2, 'new@example.com'"))
def k13(spark, d):
    old = users(spark, d).select("user_id", "email")
    new = spark.createDataFrame([(-1, "Customer#000000001@example.com"), (-2, "new@example.com")], "user_id long, email string")
    return sinks.insert_absent(old, new, ["email"], "user_id")


@query("k14_insert_movie", rsql("SELECT item_id, title, avg_rating FROM rated_items UNION ALL SELECT -1, 'new item', NULL"))
def k14(spark, d):
    new = spark.createDataFrame([(-1, "new item", None)], "item_id long, title string, avg_rating double")
    return rated_items(spark, d).select("item_id", "title", "avg_rating").unionByName(new)


@query("k15_kv_merge", sql("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'X' ELSE gender END AS gender, occupation FROM users"))
def k15(spark, d):
    old = users(spark, d).select("user_id", "gender", "occupation")
    new = old.filter("user_id % 3 = 0").select("user_id", F.lit("X").alias("gender"), F.lit("").alias("occupation"))
    return sinks.merge_profile(old, new, "user_id")


@query("k16_delete_keys", sql("SELECT user_id, item_id, rating FROM interactions WHERE NOT (user_id % 2 = 0 AND rating = 1)"))
def k16(spark, d):
    r = interactions(spark, d).select("user_id", "item_id", "rating")
    return sinks.delete_keys(r, r.filter("user_id % 2 = 0 and rating = 1"), ["user_id", "item_id"])


@query("k17_artifact_meta", "SELECT count(*) AS vectors, CAST(64 AS INTEGER) AS dim, 'content' AS kind FROM embeddings")
def k17(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return sinks.save_artifact(v, work_dir(spark, "artifact"), kind="content")


# ---- filters ------------------------------------------------------------------


@query("f01_positives", sql("SELECT user_id, item_id, rating, ts FROM positives"))
def f01(spark, d):
    return H.positives(interactions(spark, d))


@query("f02_min_history", sql("SELECT user_id, item_id FROM history WHERE n >= 5"))
def f02(spark, d):
    return H.history(H.positives(interactions(spark, d)), 5).select("user_id", "item_id")


@query("f03_seen_exclusion", sql("""SELECT DISTINCT h.user_id, e.related_id AS item_id FROM recent h JOIN itemcf e ON e.item_id = h.item_id AND e.rank <= 20
    WHERE NOT EXISTS (SELECT 1 FROM positives s WHERE s.user_id = h.user_id AND s.item_id = e.related_id)"""))  # fmt: skip
def f03(spark, d):
    h = kept_history(spark, d)
    recent = H.last(h, 50).select("user_id", F.col("item_id").alias("key"), F.lit(1.0).alias("w"))
    return spread(recent, recall.edge_lists(recall.itemcf(h, k=20), scores=False), h.select("user_id"), h, about=2 * h.count()).select("user_id", "item_id")


@query("f04_array_overlap", rsql("SELECT item_id, title, year, round(avg_rating, 9) AS avg_rating FROM rated_items WHERE list_has_any(genres, ['red', 'blue']) AND avg_rating >= 5 ORDER BY year DESC, avg_rating DESC, item_id LIMIT 20"))
def f04(spark, d):
    return C.array_overlap(rated_items(spark, d), ["red", "blue"]).select("item_id", "title", "year", F.round("avg_rating", D).alias("avg_rating"))


@query("f05_genres_or_all", rsql("""(SELECT 'some' AS case_, item_id FROM rated_items WHERE list_has_any(genres, ['ring']) AND avg_rating >= 5 ORDER BY year DESC, avg_rating DESC, item_id LIMIT 20)
    UNION ALL (SELECT 'all', item_id FROM rated_items WHERE avg_rating >= 5 ORDER BY year DESC, avg_rating DESC, item_id LIMIT 20)"""))  # fmt: skip
def f05(spark, d):
    from quillon.operators.rerank import by_genres

    r = rated_items(spark, d)
    return by_genres(r, ["ring"]).select(F.lit("some").alias("case_"), "item_id").unionByName(by_genres(r, []).select(F.lit("all").alias("case_"), "item_id"))


@query("f06_active_user", sql("SELECT user_id, email FROM users WHERE email = 'Customer#000000007@example.com' OR user_id = 9"))
def f06(spark, d):
    return users(spark, d).filter((F.col("email") == "Customer#000000007@example.com") | (F.col("user_id") == 9)).select("user_id", "email")


@query("f07_point_lookup", sql("SELECT user_id, item_id, rating FROM interactions WHERE user_id = 10"))
def f07(spark, d):
    return interactions(spark, d).filter("user_id = 10").select("user_id", "item_id", "rating")


@query("f08_category_set", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def f08(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_returnflag")


_PART = "CAST(('0x' || substr(md5(concat_ws('|', user_id, 42)), 1, 7)) AS BIGINT) / 268435456.0"
_SPLIT = f"SELECT user_id, CASE WHEN {_PART} < 0.8 THEN 'train' WHEN {_PART} < 0.9 THEN 'valid' ELSE 'test' END AS part FROM users"


@query("f09_semi_join_split", sql("SELECT user_id, count(*) AS n FROM interactions WHERE user_id IN (SELECT user_id FROM parts WHERE part = 'valid') GROUP BY 1", parts=_SPLIT))
def f09(spark, d):
    valid = ranking.user_split(users(spark, d)).filter("part = 'valid'")
    return interactions(spark, d).join(valid, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("f10_partial_update", sql("SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'changed' ELSE occupation END AS occupation, zip_code FROM users"))
def f10(spark, d):
    u = users(spark, d).select("user_id", "occupation", "zip_code")
    change = u.filter("user_id % 4 = 0").select("user_id", F.lit("changed").alias("occupation"), F.lit(None).cast("string").alias("zip_code"))
    return C.patch(u, change, "user_id", ["occupation", "zip_code"])


@query("f11_has_rated", sql("SELECT i.item_id, r.user_id IS NOT NULL AS has_rated FROM items i LEFT JOIN (SELECT * FROM interactions WHERE user_id = 11) r ON r.item_id = i.item_id"))
def f11(spark, d):
    mine = interactions(spark, d).filter("user_id = 11").select("item_id", F.lit(True).alias("r"))
    return items(spark, d).select("item_id").join(mine, "item_id", "left").select("item_id", F.col("r").isNotNull().alias("has_rated"))


@query("f12_detail", rsql("SELECT item_id, title, CAST(len(coalesce(genres, [])) AS INTEGER) AS n_genres, year, coalesce(rating_count, 0) AS rating_count FROM rated_items WHERE item_id = 5"))
def f12(spark, d):
    one = rated_items(spark, d).filter("item_id = 5")
    return one.select("item_id", "title", F.size(F.coalesce("genres", F.array().cast("array<string>"))).alias("n_genres"), "year", F.coalesce("rating_count", F.lit(0)).alias("rating_count"))


# ---- joins --------------------------------------------------------------------


@query("j01_star_left_join", sql("""SELECT r.user_id, r.item_id, u.gender, i.year, s.c AS user_count FROM interactions r LEFT JOIN users u USING (user_id) LEFT JOIN items i ON i.item_id = r.item_id
    LEFT JOIN (SELECT user_id, count(*) AS c FROM interactions GROUP BY 1) s ON s.user_id = r.user_id"""))  # fmt: skip
def j01(spark, d):
    r = interactions(spark, d)
    s = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_count"))
    return r.join(users(spark, d), "user_id", "left").join(items(spark, d), "item_id", "left").join(s, "user_id", "left").select("user_id", "item_id", "gender", "year", "user_count")


@query("j02_stats_with_defaults", sql("SELECT i.item_id, coalesce(p.n, 0) AS n, round(coalesce(p.mean, (SELECT avg(rating) FROM positives)), 9) AS mean FROM items i LEFT JOIN pop p USING (item_id)"))
def j02(spark, d):
    p = H.positives(interactions(spark, d))
    mu = p.agg(F.avg("rating").alias("mu"))
    return items(spark, d).select("item_id").join(recall.popularity(p), "item_id", "left").crossJoin(F.broadcast(mu)).select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", "mu"), D).alias("mean"))


@query("j03_inner_titles", sql("SELECT r.user_id, i.title, g.genre, r.rating FROM interactions r JOIN items i USING (item_id) JOIN item_genres g ON g.item_id = r.item_id WHERE g.pos = 1"))
def j03(spark, d):
    return interactions(spark, d).join(items(spark, d), "item_id").select("user_id", "title", F.get("genres", F.lit(0)).alias("genre"), "rating")


@query("j04_update_from", rsql("SELECT item_id, round(coalesce(avg_rating, -1), 9) AS avg_rating FROM rated_items"))
def j04(spark, d):
    old = items(spark, d).select("item_id", F.lit(-1.0).alias("avg_rating"))
    new = ranking.item_stats(interactions(spark, d)).select("item_id", "avg_rating")
    return C.patch(old, new, "item_id", ["avg_rating"]).select("item_id", F.round("avg_rating", D).alias("avg_rating"))


@query("j05_item_pairs", sql("SELECT a.item_id, count(*) AS pairs FROM history a JOIN history b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1"))
def j05(spark, d):
    h = pos_history(spark, d).select("user_id", "item_id")
    return h.join(h.select("user_id", F.col("item_id").alias("other")), "user_id").filter("item_id <> other").groupBy("item_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("j06_range_self_join", sql("SELECT a.user_id, a.item_id, b.item_id AS next_id, b.pos - a.pos AS dist FROM history a JOIN history b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2"))
def j06(spark, d):
    h = pos_history(spark, d).select("user_id", "item_id", "pos")
    b = h.select("user_id", F.col("item_id").alias("next_id"), F.col("pos").alias("p"))
    return h.join(b, "user_id").filter(F.col("p").between(F.col("pos") + 1, F.col("pos") + 2)).select("user_id", "item_id", "next_id", (F.col("p") - F.col("pos")).alias("dist"))


@query("j07_user_pairs", sql("SELECT a.user_id, count(*) AS pairs FROM fans a JOIN fans b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1"))
def j07(spark, d):
    h = pos_history(spark, d).select("user_id", "item_id")
    return h.join(h.select("item_id", F.col("user_id").alias("other")), "item_id").filter("user_id <> other").groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("j08_history_to_candidates", sql("SELECT h.user_id, e.related_id, count(*) AS ways FROM recent h JOIN itemcf e ON e.item_id = h.item_id AND e.rank <= 20 GROUP BY 1, 2"))
def j08(spark, d):
    h = kept_history(spark, d)
    recent = H.last(h, 50).select("user_id", F.col("item_id").alias("key"), F.lit(1.0).alias("w"))
    ways = spread(recent, recall.edge_lists(recall.itemcf(h, k=20), scores=False), h.select("user_id"), about=h.count())
    return ways.select("user_id", F.col("item_id").alias("related_id"), F.col("score").cast("long").alias("ways"))


@query("j09_neighbour_items", sql("SELECT e.user_id, count(DISTINCT h.item_id) AS items FROM usercf e JOIN history h ON h.user_id = e.other_id GROUP BY 1"))
def j09(spark, d):
    h = kept_history(spark, d)
    near = recall.usercf(h).select("user_id", F.col("other_id").alias("key"), F.lit(1.0).alias("w"))
    users = h.select("user_id").distinct()
    return spread(near, h.groupBy(F.col("user_id").alias("key")).agg(F.collect_list("item_id").alias("ids")), users, about=recall.NEIGHBOURS * users.count(), count=True)


_UNIT = f"SELECT vec_id, [CAST(x AS DOUBLE) / {_NORM} FOR x IN embedding] AS v FROM embeddings"


@query("j10_dot_products", sql("""SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT a.vec_id AS user_id, b.vec_id AS item_id, round(list_sum([a.v[i] * b.v[i] FOR i IN range(1, 65)]), 6) AS score
    FROM unit a, unit b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10""", unit=_UNIT))  # fmt: skip
def j10(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), S.l2(F.col("embedding")).alias("vec"))
    q = v.filter("item_id % 20 = 0").select(F.col("item_id").alias("user_id"), "vec")
    return recall.by_vectors(q, v, q.select("user_id", F.col("user_id").alias("item_id")), k=10, digits=6)


@query("j11_unrated_items", sql("""SELECT u.user_id, count(*) AS unrated FROM users u, items i
    WHERE NOT EXISTS (SELECT 1 FROM interactions r WHERE r.user_id = u.user_id AND r.item_id = i.item_id) GROUP BY 1"""))  # fmt: skip
def j11(spark, d):
    """How many items each user could draw negatives from: counted, not listed, so users and items are not crossed."""
    known = items(spark, d).select("item_id").distinct()
    total = known.agg(F.count(F.lit(1)).alias("total"))  # one row
    rated = interactions(spark, d).select("user_id", "item_id").join(known, "item_id", "left_semi").groupBy("user_id").agg(F.countDistinct("item_id").alias("n"))
    left = users(spark, d).select("user_id").join(rated, "user_id", "left").crossJoin(F.broadcast(total)).withColumn("unrated", F.col("total") - F.coalesce("n", F.lit(0)))
    return left.filter("unrated > 0").select("user_id", "unrated")


@query("j12_batched_lookup", rsql("SELECT user_id, item_id, rank, title, year, round(avg_rating, 9) AS avg_rating FROM pop_recs JOIN rated_items USING (item_id) WHERE rank <= 10"))
def j12(spark, d):
    p = H.positives(interactions(spark, d))
    recs = recall.by_popularity(p.select("user_id").distinct(), recall.popularity(p), p, k=10)
    return recs.join(rated_items(spark, d), "item_id", "left").select("user_id", "item_id", "rank", "title", "year", F.round("avg_rating", D).alias("avg_rating"))


def _principals(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("title_id"), F.col("l_suppkey").alias("person_id")).distinct()
    p = lines.withColumn("ordering", F.row_number().over(W.partitionBy("title_id").orderBy("person_id")).cast("long"))
    p = p.withColumn("category", F.when(F.col("ordering") % 3 == 1, "actor").when(F.col("ordering") % 3 == 2, "actress").otherwise("director"))
    names = table(spark, d, "supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return p, names


_CAST = {"principals": """SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY person_id) AS ordering FROM (SELECT DISTINCT l_partkey AS title_id, l_suppkey AS person_id FROM lineitem)""",
         "names": "SELECT s_suppkey AS person_id, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0"}


@query("j13_cast", sql("SELECT title_id, ordering, p.person_id, coalesce(name, '') AS name FROM principals p LEFT JOIN names n ON n.person_id = p.person_id WHERE ordering % 3 IN (1, 2)", **_CAST))
def j13(spark, d):
    return C.cast_of(*_principals(spark, d))


@query("j14_crew_names", sql("SELECT title_id, string_agg(coalesce(name, CAST(p.person_id AS VARCHAR)), '|' ORDER BY ordering) AS names FROM principals p LEFT JOIN names n ON n.person_id = p.person_id GROUP BY 1", **_CAST))
def j14(spark, d):
    p, names = _principals(spark, d)
    crew = p.groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordering", "person_id"))), lambda s: s["person_id"].cast("string")).alias("directors"))
    return C.crew_names(crew, names.withColumn("person_id", F.col("person_id").cast("string")), "directors").select("title_id", F.array_join("names", "|").alias("names"))


@query("j15_ctr_default", sql("""SELECT r.user_id, r.item_id, round(coalesce(c.ctr, 0.0), 9) AS pred FROM interactions r LEFT JOIN (SELECT item_id, avg(CASE WHEN rating >= 8 THEN 1.0 ELSE 0.0 END) AS ctr
    FROM interactions WHERE user_id % 2 = 0 GROUP BY 1) c USING (item_id)"""))  # fmt: skip
def j15(spark, d):
    r = interactions(spark, d)
    ctr = r.filter("user_id % 2 = 0").groupBy("item_id").agg(F.avg((F.col("rating") >= 8).cast("double")).alias("ctr"))
    return r.join(ctr, "item_id", "left").select("user_id", "item_id", F.round(F.coalesce("ctr", F.lit(0.0)), D).alias("pred"))


# ---- aggregates ---------------------------------------------------------------


@query("a01_item_avg_count", sql("SELECT item_id, round(avg(rating), 9) AS avg_rating, count(*) AS n FROM interactions GROUP BY 1"))
def a01(spark, d):
    return interactions(spark, d).groupBy("item_id").agg(F.round(F.avg("rating"), D).alias("avg_rating"), F.count(F.lit(1)).alias("n"))


@query("a02_user_stats", sql("SELECT u.user_id, round(coalesce(avg(rating), 0), 9) AS avg_rating, count(rating) AS n, coalesce(max(ts), 0) AS max_ts, coalesce(min(ts), 0) AS min_ts FROM users u LEFT JOIN interactions r USING (user_id) GROUP BY 1"))
def a02(spark, d):
    s = ranking.user_stats(interactions(spark, d))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return users(spark, d).select("user_id").join(s, "user_id", "left").select("user_id", F.round(F.coalesce("avg_rating", F.lit(0.0)), D).alias("avg_rating"), z("rating_count").alias("n"), z("max_ts").alias("max_ts"), z("min_ts").alias("min_ts"))


@query("a03_active_days", sql("SELECT user_id, round((max(ts) - min(ts)) / 86400.0, 9) AS days, (max(ts) - min(ts)) // 86400 AS whole_days FROM interactions GROUP BY 1"))
def a03(spark, d):
    s = ranking.user_stats(interactions(spark, d))
    return s.select("user_id", F.round("active_days", D).alias("days"), F.floor("active_days").alias("whole_days"))


@query("a04_popularity", sql("SELECT item_id, n, round(mean, 9) AS mean, score FROM pop"))
def a04(spark, d):
    return recall.popularity(H.positives(interactions(spark, d))).select("item_id", "n", F.round("mean", D).alias("mean"), "score")


@query("a05_top_genres", sql("""SELECT user_id, string_agg(genre, ',' ORDER BY rank) AS frequent_genres FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS rank
    FROM interactions JOIN item_genres USING (item_id) GROUP BY 1, 2) WHERE rank <= 3 GROUP BY 1"""))  # fmt: skip
def a05(spark, d):
    g = sinks.profiles(H.history(interactions(spark, d)), items(spark, d), users(spark, d), tasks=line_tasks(spark, d))["genres"]
    return g.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "genre"))), lambda s: s["genre"]), ",").alias("frequent_genres"))


@query("a06_genre_vocabulary", sql("SELECT DISTINCT genre FROM item_genres WHERE genre <> '(no genres listed)'"))
def a06(spark, d):
    return items(spark, d).select(F.explode("genres").alias("genre")).filter(F.col("genre") != S.NO_GENRE).distinct().orderBy("genre")


@query("a07_dashboard", sql("SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM interactions) AS ratings"))
def a07(spark, d):
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(users(spark, d), "users").crossJoin(n(items(spark, d), "items")).crossJoin(n(interactions(spark, d), "ratings"))


@query("a08_page_with_total", sql("SELECT item_id, title, (SELECT count(*) FROM items) AS total, 60 < (SELECT count(*) FROM items) AS has_next FROM items ORDER BY item_id LIMIT 20 OFFSET 40"))
def a08(spark, d):
    return C.page(items(spark, d).select("item_id", "title"), "item_id", 3, 20)


@query("a09_positive_ratio", sql("SELECT item_id, round(CAST(sum(CASE WHEN rating >= 8 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 9) AS ratio FROM interactions GROUP BY 1"))
def a09(spark, d):
    return interactions(spark, d).groupBy("item_id").agg(F.round(F.sum((F.col("rating") >= 8).cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1)), D).alias("ratio"))


@query("a10_coverage", sql("SELECT count(DISTINCT item_id) AS coverage, count(DISTINCT user_id) AS users FROM pop_recs"))
def a10(spark, d):
    p = H.positives(interactions(spark, d))
    recs = recall.by_popularity(p.select("user_id").distinct(), recall.popularity(p), p, k=50)
    return recs.agg(F.countDistinct("item_id").alias("coverage"), F.countDistinct("user_id").alias("users"))


@query("a11_weighted_average", sql("SELECT user_id, round(sum(rating * (1 / (1 + 0.05 * (n - pos)))) / sum(1 / (1 + 0.05 * (n - pos))), 9) AS mean FROM history GROUP BY 1"))
def a11(spark, d):
    w = S.decay(H.back(), 0.05)
    return pos_history(spark, d).groupBy("user_id").agg(F.round(F.sum(F.col("rating") * w) / F.sum(w), D).alias("mean"))




@query("a12_best_with_default", sql("""SELECT u.user_id, coalesce(b.genre, 'Action') AS genre FROM users u LEFT JOIN (SELECT user_id, genre FROM scored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ucb DESC, genre) = 1) b USING (user_id)""",
    counted="SELECT user_id, genre, count(*) AS n, sum(rating) AS reward FROM interactions JOIN item_genres USING (item_id) WHERE user_id % 3 <> 0 GROUP BY 1, 2", scored="SELECT *, round(reward / n + sqrt(2 * ln(100) / n), 9) AS ucb FROM counted"))
def a12(spark, d):
    from quillon.operators.rerank import best_ucb_genre

    g = items(spark, d).select("item_id", F.explode("genres").alias("genre"))
    c = interactions(spark, d).filter("user_id % 3 <> 0").join(g, "item_id").groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("reward"))
    return best_ucb_genre(users(spark, d), c).select("user_id", "genre")


@query("a13_pivot_metrics", """SELECT o_orderstatus AS method, max(CASE WHEN k = 1 THEN n END) AS k1, max(CASE WHEN k = 2 THEN n END) AS k2
FROM (SELECT o_orderstatus, o_orderkey % 2 + 1 AS k, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def a13(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("method"), (F.col("o_orderkey") % 2 + 1).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("method").pivot("k", [1, 2]).agg(F.first("n")).withColumnsRenamed({"1": "k1", "2": "k2"})


@query("a14_min_max_median", sql("SELECT min(year) AS lo, max(year) AS hi, CAST(median(year) AS DOUBLE) AS mid, round(median(imdb_votes), 6) AS votes FROM items"))
def a14(spark, d):
    return items(spark, d).agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.median("year").alias("mid"), F.round(F.median("imdb_votes"), 6).alias("votes"))


@query("a15_gram", sql("SELECT a.item_id, b.item_id AS related_id, count(*) AS n FROM positives a JOIN positives b USING (user_id) GROUP BY 1, 2"))
def a15(spark, d):
    return recall.gram(H.positives(interactions(spark, d)))


@query("a16_scalar_counts", sql("SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM interactions WHERE user_id = 3) AS mine"))
def a16(spark, d):
    mine = interactions(spark, d).filter("user_id = 3").agg(F.count(F.lit(1)).alias("mine"))
    return items(spark, d).agg(F.count(F.lit(1)).alias("items")).crossJoin(mine)


# ---- windows ------------------------------------------------------------------


@query("w01_position", sql("SELECT user_id, item_id, pos, n FROM history"))
def w01(spark, d):
    return pos_history(spark, d).select("user_id", "item_id", "pos", "n")


@query("w02_last_n", sql("SELECT user_id, item_id FROM history WHERE n - pos < 10"))
def w02(spark, d):
    return H.last(pos_history(spark, d), 10).select("user_id", "item_id")


_EVENTS_HIST = "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM rated"


@query("w03_dedupe_first", sql("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY p) AS pos FROM (SELECT user_id, item_id, min(pos) AS p FROM seq GROUP BY 1, 2)", seq=_EVENTS_HIST))
def w03(spark, d):
    e = ratings_of_events(spark, d).withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).withColumn("n", F.lit(0).cast("long"))
    return H.deduped(e).select("user_id", "item_id", "pos")


@query("w04_recency_decay", sql("SELECT user_id, item_id, round(1 / (1 + 0.08 * (n - pos)), 9) AS w FROM history"))
def w04(spark, d):
    return pos_history(spark, d).select("user_id", "item_id", F.round(S.decay(H.back(), 0.08), D).alias("w"))


@query("w05_linear_weights", sql("SELECT user_id, item_id, round(CASE WHEN n > 1 THEN 0.6 + 0.4 * (pos - 1) / (n - 1) ELSE 0.6 END, 9) AS w FROM history"))
def w05(spark, d):
    return pos_history(spark, d).select("user_id", "item_id", F.round(S.linear_weight(F.col("pos"), F.col("n")), D).alias("w"))


@query("w06_top_n_per_key", "SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 7")
def w06(spark, d):
    return top(table(spark, d, "customer"), "c_mktsegment", 7, F.desc("c_acctbal"), F.col("c_custkey")).select("c_mktsegment", "c_custkey", "rank")


@query("w07_rolling_context", sql("SELECT user_id, item_id, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS context FROM history QUALIFY pos > 1"))
def w07(spark, d):
    return H.next_item_pairs(pos_history(spark, d), 3, 1 << 30).select("user_id", F.col("target").alias("item_id"), F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


@query("w08_left_pad", sql("""SELECT user_id, target, array_to_string(list_concat([0 FOR x IN range(3 - len(c))], c), ',') AS padded FROM (SELECT user_id, item_id AS target, pos,
    list(item_id) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM history) WHERE pos > 1"""))  # fmt: skip
def w08(spark, d):
    return H.next_item_pairs(pos_history(spark, d), 3, 1 << 30).select("user_id", "target", F.array_join(F.transform(H.left_pad(F.col("context"), 3), lambda x: x.cast("string")), ",").alias("padded"))


@query("w09_average_rank", sql("SELECT user_id, item_id, rank() OVER (PARTITION BY user_id ORDER BY rating) + (count(*) OVER (PARTITION BY user_id, rating) - 1) / 2.0 AS r FROM interactions"))
def w09(spark, d):
    r = F.rank().over(W.partitionBy("user_id").orderBy("rating")) + (F.count(F.lit(1)).over(W.partitionBy("user_id", "rating")) - 1) / 2.0
    return interactions(spark, d).select("user_id", "item_id", r.alias("r"))


@query("w10_training_pairs", sql("""SELECT user_id, target, n_context FROM (SELECT user_id, item_id AS target, pos, least(pos - 1, 20) AS n_context FROM history)
    WHERE pos > 1 ORDER BY md5(concat_ws('|', user_id, target, 42)), user_id, target LIMIT 500"""))  # fmt: skip
def w10(spark, d):
    pairs = H.next_item_pairs(pos_history(spark, d), 20, 1 << 30).select("user_id", "target", F.size("context").cast("long").alias("n_context"))
    return H.subsample(pairs, 500, "user_id", "target")


# ---- sorts and sets -----------------------------------------------------------


@query("o01_best_rated", rsql("SELECT item_id, round(avg_rating, 9) AS avg_rating, rating_count FROM rated_items ORDER BY rated_items.avg_rating DESC NULLS FIRST, rating_count DESC NULLS FIRST, item_id LIMIT 25"))
def o01(spark, d):
    return C.best_rated(rated_items(spark, d), 25).select("item_id", F.round("avg_rating", D).alias("avg_rating"), "rating_count")


@query("o02_page", sql("SELECT item_id, title FROM items ORDER BY item_id LIMIT 50 OFFSET 50"))
def o02(spark, d):
    return C.page(items(spark, d).select("item_id", "title"), "item_id", 2, 500).select("item_id", "title")


@query("o03_recent_ratings", sql("SELECT item_id, rating, ts FROM interactions WHERE user_id = 4 ORDER BY ts DESC, item_id LIMIT 10"))
def o03(spark, d):
    return interactions(spark, d).filter("user_id = 4").orderBy(F.desc("ts"), "item_id").limit(10).select("item_id", "rating", "ts")


@query("o04_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o04(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("o05_most_common", sql("SELECT item_id, count(*) AS n FROM interactions GROUP BY 1 ORDER BY n DESC, item_id LIMIT 30"))
def o05(spark, d):
    return interactions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(30)


@query("o06_exact_pool", sql("SELECT user_id, item_id, score FROM (SELECT user_id, item_id, rating AS score, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM interactions) WHERE r <= 3"))
def o06(spark, d):
    return top(interactions(spark, d).select("user_id", "item_id", F.col("rating").alias("score")), "user_id", 3, F.desc("score"), F.col("item_id")).drop("rank")


@query("u01_union_samples", sql("SELECT user_id, item_id, 1 AS click FROM interactions WHERE rating >= 8 UNION ALL SELECT user_id, item_id, 0 FROM interactions WHERE rating < 4"))
def u01(spark, d):
    r = interactions(spark, d)
    return r.filter("rating >= 8").select("user_id", "item_id", F.lit(1).alias("click")).unionByName(r.filter("rating < 4").select("user_id", "item_id", F.lit(0).alias("click")))


@query("u02_difference", sql("SELECT item_id FROM items EXCEPT SELECT item_id FROM positives"))
def u02(spark, d):
    return items(spark, d).select("item_id").join(H.positives(interactions(spark, d)).select("item_id"), "item_id", "left_anti")


@query("u03_intersection_size", sql("SELECT r.user_id, count(*) AS hits FROM pop_recs r JOIN (SELECT user_id, item_id FROM interactions WHERE rating < 8) t USING (user_id, item_id) GROUP BY 1"))
def u03(spark, d):
    r = interactions(spark, d)
    p = H.positives(r)
    recs = recall.by_popularity(p.select("user_id").distinct(), recall.popularity(p), p, k=50)
    return recs.join(r.filter("rating < 8").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))


@query("u04_vocabulary_union", sql("SELECT item_id FROM items UNION SELECT item_id FROM rated"))
def u04(spark, d):
    return items(spark, d).select("item_id").union(ratings_of_events(spark, d).select("item_id")).distinct()
