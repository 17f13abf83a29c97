"""The rating tables as views of an order-entry schema, and the same views as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Explicit schemas of the tables that the library itself writes as text.
EDGE_SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("related_id", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("score", T.DoubleType())])
HISTORY_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("rank", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a task of interactions(), about.
TASK_LINES = 500_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work on all lines: each has as many, however large the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and item: user_id, item_id, rating (1..10), ts (seconds); dealt by user, which serves histories too."""
    tasks = line_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if tasks > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(tasks, "l_orderkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = both.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity", "o_orderdate").repartition(tasks, "user_id")
    return both.groupBy("user_id", "item_id").agg(F.max(F.ceil(F.col("l_quantity") / 5)).cast("int").alias("rating"), F.unix_timestamp(F.min("o_orderdate").cast("timestamp")).alias("ts"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"), (F.col("c_custkey") % 50 + 15).cast("int").alias("age"),
        F.col("c_mktsegment").alias("occupation"), F.col("c_nationkey").cast("string").alias("zip_code"), F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, genres, year, imdb_id, title_type, imdb_votes, imdb_rating, is_adult."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("genres"), (F.col("p_size") + 1950).cast("int").alias("year"), F.col("p_brand").alias("imdb_id"),
        F.col("p_type").alias("title_type"), F.col("p_retailprice").alias("imdb_votes"), (F.col("p_size") % 10 + 0.5).cast("double").alias("imdb_rating"),
        (F.col("p_size") % 10 == 0).cast("int").alias("is_adult"),
    )


def ratings_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating stream: event_id, user_id, item_id, rating (1..10), ts (timestamp)."""
    return rating_events(table(spark, sf_dir, "events"))


def rating_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.ceil(F.least("value", F.lit(100.0)) / 10).cast("int").alias("rating"), F.col("ts").cast("timestamp").alias("ts")
    )


#: The same views, and others that several queries share, for DuckDB.
VIEWS = {
    "interactions": """SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(ceil(l_quantity / 5)) AS INTEGER) AS rating,
        CAST(epoch(min(o_orderdate)) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "users": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(c_custkey % 50 + 15 AS INTEGER) AS age,
        c_mktsegment AS occupation, CAST(c_nationkey AS VARCHAR) AS zip_code, c_name || '@example.com' AS email FROM customer""",
    "items": """SELECT p_partkey AS item_id, p_name AS title, string_split(p_name, ' ') AS genres, CAST(p_size + 1950 AS INTEGER) AS year, p_brand AS imdb_id,
        p_type AS title_type, p_retailprice AS imdb_votes, CAST(p_size % 10 + 0.5 AS DOUBLE) AS imdb_rating, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS is_adult FROM part""",
    "rated": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(ceil(least(value, 100.0) / 10) AS INTEGER) AS rating, ts FROM events""",
    "positives": "SELECT * FROM interactions WHERE rating >= (SELECT CASE WHEN max(rating) <= 5 THEN 4 ELSE 8 END FROM interactions)",
    "history": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM positives",
    "item_genres": "SELECT item_id, g.pos AS pos, genres[g.pos] AS genre FROM items, (SELECT unnest([1, 2]) AS pos) g WHERE len(genres) >= g.pos",
    "pop": """SELECT item_id, count(*) AS n, avg(rating) AS mean, round((count(*) / (count(*) + 20.0) * avg(rating)
        + 20.0 / (count(*) + 20.0) * (SELECT avg(rating) FROM positives)) * ln(1 + count(*)), 9) AS score FROM positives GROUP BY item_id""",
    "recent": "SELECT user_id, item_id, ts, n - pos AS back FROM history WHERE n - pos < 50",
    "capped": "SELECT user_id, item_id, pos, count(*) OVER (PARTITION BY user_id) AS n FROM history WHERE n - pos < 100",
    "cnt": "SELECT item_id, count(*) AS c FROM capped WHERE n >= 2 GROUP BY 1",
    "itemcf": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, related_id) AS rank FROM (
        SELECT a.item_id, b.item_id AS related_id, round(sum(1 / log2(a.n + 2.0)) / sqrt(any_value(x.c) * any_value(y.c)), 9) AS score
        FROM capped a JOIN capped b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN cnt x ON x.item_id = a.item_id JOIN cnt y ON y.item_id = b.item_id
        WHERE a.n >= 2 GROUP BY 1, 2)) WHERE rank <= 200""",
    "swing": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, related_id) AS rank FROM (
        SELECT a.item_id, b.item_id AS related_id, round(sum(1 / (5.0 + a.n)) / pow(any_value(x.c) * any_value(y.c), 0.25), 9) AS score
        FROM capped a JOIN capped b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN cnt x ON x.item_id = a.item_id JOIN cnt y ON y.item_id = b.item_id
        WHERE a.n >= 2 GROUP BY 1, 2)) WHERE rank <= 200""",
    "seqcf": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, related_id) AS rank FROM (
        SELECT a.item_id, b.item_id AS related_id, round(sum(1 / log2(a.n + 2.0) / (b.pos - a.pos)) / sqrt(any_value(x.c) * any_value(y.c)), 9) AS score
        FROM capped a JOIN capped b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN 1 AND 5 AND a.item_id <> b.item_id
        JOIN cnt x ON x.item_id = a.item_id JOIN cnt y ON y.item_id = b.item_id WHERE a.n >= 2 GROUP BY 1, 2)) WHERE rank <= 200""",
    "fans": """SELECT user_id, item_id, n, count(*) OVER (PARTITION BY item_id) AS u FROM (SELECT *, row_number() OVER (PARTITION BY item_id
        ORDER BY md5(concat_ws('|', item_id, user_id, 42)), user_id) AS r FROM history) WHERE r <= 600""",
    "usercf": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, other_id) AS rank FROM (
        SELECT a.user_id, b.user_id AS other_id, round(sum(1 / log2(a.u + 2.0)) / sqrt(any_value(a.n) * any_value(b.n)), 9) AS score
        FROM fans a JOIN fans b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2)) WHERE rank <= 80""",
    "split": """SELECT user_id, item_id, rating, ts, pos, n, CASE WHEN pos > n - greatest(1, round_even(CAST(n * 0.2 AS DOUBLE), 0)) THEN 'test' ELSE 'train' END AS part
        FROM history WHERE n >= 5""",
    "pop_recs": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM positives) u, pop p
        WHERE NOT EXISTS (SELECT 1 FROM positives s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)) QUALIFY rank <= 50""",
}


def sql(body: str, **more: str) -> str:
    """A query with the views it needs (``more`` adds views of its own) in front."""
    known, need, todo = VIEWS | more, [], [body]
    while todo:
        text = todo.pop()
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in need:
                need.append(name)
                todo.append(known[name])
    order: list[str] = []
    open_: set[str] = set()

    def put(name: str) -> None:
        open_.add(name)
        for other in known:
            if other in need and other not in order and other not in open_ and re.search(rf"\b{other}\b", known[name]):
                put(other)
        if name not in order:
            order.append(name)

    for name in need:
        put(name)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + body
