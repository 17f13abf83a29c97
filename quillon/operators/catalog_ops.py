"""Catalogue queries: pages, point lookups, cast and crew, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, key: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page in order of key with total and has_next; sizes above 50 are 50."""
    size = max(1, min(size, 50))
    number = max(1, number)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(key).offset((number - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)


def cast_of(principals: DataFrame, names: DataFrame, categories: tuple[str, ...] = ("actor", "actress")) -> DataFrame:
    """title_id, ordering, person_id, name: of the named categories, '' for a missing name."""
    return (
        principals.filter(F.col("category").isin(*categories)).join(names, "person_id", "left").select("title_id", "ordering", "person_id", F.coalesce("name", F.lit("")).alias("name"))
    )


def crew_names(crew: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """title_id, names: the ids of an array replaced by names in their order; an id without a name stands for itself."""
    each = crew.select("title_id", F.posexplode_outer(column).alias("p", "person_id")).join(names, "person_id", "left")
    pair = F.when(F.col("person_id").isNotNull(), F.struct("p", F.coalesce("name", "person_id").alias("name")))
    return each.groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["name"]).alias("names"))


def array_overlap(items: DataFrame, genres: list[str], least: float = 5.0, k: int = 20) -> DataFrame:
    wanted = F.array(*[F.lit(g) for g in genres])
    return items.filter(F.arrays_overlap("genres", wanted) & (F.col("avg_rating") >= least)).orderBy(F.desc("year"), F.desc("avg_rating"), "item_id").limit(k)


def best_rated(items: DataFrame, k: int) -> DataFrame:
    """By average, then count; missing averages come first, as in the catalogue's store."""
    return items.orderBy(F.desc_nulls_first("avg_rating"), F.desc_nulls_first("rating_count"), "item_id").limit(k)


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null fields of the changes overwrite."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
