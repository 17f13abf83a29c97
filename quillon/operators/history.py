"""User histories: thresholds, order, caps, recency, training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.paths import stored, work_dir


def positives(ratings: DataFrame, threshold: float | None = None) -> DataFrame:
    """Ratings of at least the threshold: 4 if no rating is above 5, else 8, unless given."""
    if threshold is not None:
        return ratings.filter(F.col("rating") >= threshold)
    limit = ratings.agg(F.when(F.max("rating") <= 5, 4.0).otherwise(8.0).alias("_limit"))  # one row
    return ratings.crossJoin(F.broadcast(limit)).filter(F.col("rating") >= F.col("_limit")).drop("_limit")


def history(positive: DataFrame, at_least: int = 1) -> DataFrame:
    """Adds pos (1 = oldest, by ts then item) and n, the user's number of rows; users of fewer rows are left out."""
    w = W.partitionBy("user_id")
    out = positive.withColumn("pos", F.row_number().over(w.orderBy("ts", "item_id")).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    return out.filter(F.col("n") >= at_least) if at_least > 1 else out


def last(hist: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` rows of each user; n counts what is left."""
    return hist.filter(F.col("n") - F.col("pos") < cap).withColumn("n", F.least("n", F.lit(cap).cast("long")))


def deduped(hist: DataFrame) -> DataFrame:
    """The first occurrence of each item of a user, positions and n renumbered."""
    # dealt by user, rows serve both windows
    first = hist.repartition("user_id").withColumn("_r", F.row_number().over(W.partitionBy("user_id", "item_id").orderBy("pos"))).filter("_r = 1").drop("_r")
    w = W.partitionBy("user_id")
    return first.withColumn("pos", F.row_number().over(w.orderBy("pos")).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def back() -> Column:
    """Recency rank of a row: 0 is the newest."""
    return F.col("n") - F.col("pos")


def top(rows: DataFrame, by: str | list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def numbered(rows: DataFrame, *order: Column, name: str = "rank", first: int = 1) -> DataFrame:
    """Numbers all rows in a total order without bringing them to one task: ranges of the order, then places in each.

    Range bounds come from a sample that differs from job to job, so the rows
    are written with their range once, and counted and numbered from there; the
    driver sees one count for each range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), work_dir(spark, "ranges"))
    at, start = first, []
    for part, count in sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect()):
        start.append((part, at))
        at += count
    place = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    starts = F.broadcast(spark.createDataFrame(start, "_p int, _start long"))  # a row for each range
    return ranged.join(starts, "_p").withColumn(name, F.col("_start") + place).drop("_p", "_start")


def numbered_within(rows: DataFrame, by: list[str], *order: Column, name: str = "rank", first: int = 1) -> DataFrame:
    """Numbers the rows of each group in a total order; a group may be larger than a task.

    Rows are dealt to ranges of group and order, so a large group spans several
    ranges; a row's number is its place in the range after what the group has in
    earlier ones, of which there is one count for each range and group in it.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = stored(rows.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()), work_dir(spark, "ranges"))
    sizes = ranged.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    place = F.row_number().over(W.partitionBy("_p", *by).orderBy(*order))
    return ranged.join(starts, same).withColumn(name, (F.col("_start") + place + (first - 1)).cast("long")).select(*rows.columns, name)


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (user_id, item_id) that the user has not had."""
    return candidates.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def next_item_pairs(hist: DataFrame, window: int = 20, cap: int = 100) -> DataFrame:
    """One row for each position from the second on of capped histories: user_id, pos, target, context (oldest first)."""
    h = last(hist, cap)
    w = W.partitionBy("user_id").orderBy("pos")
    out = h.withColumn("context", F.collect_list("item_id").over(w.rowsBetween(-window, -1)))
    return out.filter(F.size("context") > 0).select("user_id", "pos", F.col("item_id").alias("target"), "context")


def left_pad(context: Column, length: int, fill: int = 0) -> Column:
    """An array at a fixed length: fill values in front."""
    fill_ = F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(0), F.lit(length) - F.size(context)))
    return F.concat(fill_, F.slice(context, F.greatest(F.lit(1), F.size(context) - length + 1), F.lit(length)))


def subsample(rows: DataFrame, most: int, *ids: str, seed: int = 42) -> DataFrame:
    """At most ``most`` rows in the order of an md5 of their ids: the same rows in any engine."""
    return rows.orderBy(F.md5(F.concat_ws("|", *ids, F.lit(seed))), *ids).limit(most)
