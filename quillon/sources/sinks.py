"""Sinks: merges into keyed tables, reloads, text artifacts, key-value profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.tables import EDGE_SCHEMA, HISTORY_SCHEMA


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; a new row's values replace the old ones (nulls too), save in ``keep_old``."""
    a = old.select(F.col(key).alias("_a"), F.struct(*old.columns).alias("o"))
    b = new.select(F.col(key).alias("_b"), F.struct(*new.columns).alias("n"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_old else F.when(F.col("_b").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Old rows, and of the new rows with an absent key the first to arrive."""
    first = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(arrival))).filter("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def merge_profile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key-value merge: non-empty new fields replace old ones."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    filled = lambda c: F.when(F.col(f"_n_{c}") != "", F.col(f"_n_{c}"))
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(filled(c), F.col(f"_o_{c}")).alias(c) for c in columns])


def reload(rows: DataFrame, path: str) -> DataFrame:
    """Truncate and load: the table at the path is replaced."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """item_id, related_id, rank (from 1), score as CSV with a header."""
    edges.select("item_id", "related_id", "rank", "score").write.mode("overwrite").option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Similarity edges; malformed rows are dropped, the rank column is ignored and made anew by score."""
    raw = spark.read.schema(EDGE_SCHEMA).option("header", True).option("mode", "DROPMALFORMED").csv(path).drop("rank")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "related_id")
    return raw.filter(F.col("item_id").isNotNull() & F.col("related_id").isNotNull()).withColumn("rank", F.row_number().over(order).cast("long"))


def write_user_items(hist: DataFrame, path: str, cap: int = 100) -> None:
    """user_id, item_id, rank: the newest ``cap`` items, newest first."""
    rank = (F.col("n") - F.col("pos") + 1).cast("long")
    hist.select("user_id", "item_id", rank.alias("rank")).filter(F.col("rank") <= cap).write.mode("overwrite").option("header", True).csv(path)


def read_user_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def profiles(hist: DataFrame, items: DataFrame, users: DataFrame, *, cap: int = 100, genres: int = 3, tasks: int | None = None) -> dict[str, DataFrame]:
    """The key-value store's tables: profile fields, newest items, most frequent genres (counted in ``tasks`` tasks, each for its users)."""
    liked = hist.select("user_id", "item_id").join(items.select("item_id", F.explode("genres").alias("genre")), "item_id").select("user_id", "genre")
    liked = (liked.repartition(tasks, "user_id") if tasks else liked).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("user_id").orderBy(F.desc("c"), "genre")
    top = liked.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= genres)
    return {
        "profile": users,
        "history": hist.select("user_id", "item_id", (F.col("n") - F.col("pos") + 1).cast("long").alias("rank")).filter(F.col("rank") <= cap),
        "genres": top.select("user_id", "genre", "c", "rank"),
    }


def parse_counters(hash_fields: DataFrame) -> DataFrame:
    """Fields ``genre:name`` of a user's hash as rows: user_id, genre, n, reward."""
    parts = F.split("field", ":")
    rows = hash_fields.select("user_id", F.get(parts, F.lit(0)).alias("genre"), F.get(parts, F.lit(1)).alias("name"), F.col("value").try_cast("double").alias("value"))
    return rows.groupBy("user_id", "genre").pivot("name", ["n", "reward"]).agg(F.max("value"))


def row_counts(tables: dict[str, DataFrame], not_null: dict[str, str]) -> DataFrame:
    """name, rows: of each table, and of each (table, column) without nulls."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    for name, column in not_null.items():
        out = out.unionByName(tables[name].agg(F.count(column).alias("rows")).select(F.lit(f"{name}.{column}").alias("name"), "rows"))
    return out


def save_artifact(vectors: DataFrame, path: str, **meta: object) -> DataFrame:
    """A model's vectors as Parquet and a one-row table of facts beside it; returns the facts."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    n, dim = spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    row = spark.createDataFrame([(n, dim or 0, *[str(meta[k]) for k in sorted(meta)])], "vectors long, dim int" + "".join(f", {k} string" for k in sorted(meta)))
    row.write.mode("overwrite").json(f"{path}/meta")
    return row


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors of an artifact at length 1, or None if there is none (a channel without a model is empty)."""
    from pyspark.errors import AnalysisException

    from quillon.functions.scalars import l2

    try:
        df = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None
    return df.withColumn("vec", l2(F.col("vec")))
