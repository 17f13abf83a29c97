"""Fusion of ranked lists: weighted reciprocal ranks, snake and round-robin merges, weight search."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.history import top

#: Weights of the live channels and of the two offline profiles.
LIVE_WEIGHTS = {"itemcf": 1.5, "usercf": 1.0, "ease": 1.0, "seqcf": 1.1, "bpr": 0.0, "swing": 0.7, "user_preference": 0.2, "item_embedding": 0.2, "youtubednn": 6.0, "popular": 0.02}
HYBRID = {"itemcf": 1.20, "seqcf": 0.90, "ease": 1.10, "swing": 1.10, "usercf": 0.90, "content": 0.65, "genre": 0.80, "popular": 0.25}
HYBRID_RECALL = {"itemcf": 2.00, "usercf": 1.35, "seqcf": 1.10, "ease": 1.25, "swing": 1.00, "genre": 0.35, "content": 0.20, "popular": 0.05}

#: Single profiles of the weight search, and the values of its grid.
BASE_PROFILES = (
    {"itemcf": 1.20, "swing": 1.10, "usercf": 0.90, "content": 0.65, "genre": 0.80, "popular": 0.25},
    {"itemcf": 2.00, "usercf": 1.35, "seqcf": 1.10, "ease": 1.20, "swing": 1.00, "genre": 0.35, "content": 0.20, "popular": 0.05},
    {"itemcf": 2.20, "usercf": 1.60, "seqcf": 1.20, "ease": 1.40, "swing": 0.80, "genre": 0.20, "content": 0.10, "popular": 0.00},
    {"itemcf": 1.60, "usercf": 1.60, "seqcf": 1.00, "ease": 1.20, "swing": 1.20, "genre": 0.40, "content": 0.20, "popular": 0.05},
)
GRID = {"itemcf": (1.6, 2.0, 2.4), "usercf": (1.0, 1.4, 1.8), "ease": (0.8, 1.2, 1.6), "swing": (0.7, 1.0, 1.3), "genre": (0.2, 0.5), "content": (0.1, 0.3)}
#: The search with a user tower tries its weight beside the recall profile, then a grid around these other weights.
TOWER_WEIGHTS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 10.0)
TOWER_GRID = {"user_tower": (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0), "itemcf": (1.5, 2.0), "usercf": (1.0, 1.5), "ease": (1.0, 1.5)}
TOWER_REST = {"seqcf": 1.1, "swing": 0.7, "genre": 0.2, "content": 0.1, "popular": 0.02}


def tower_profiles() -> list[dict[str, float]]:
    """The recall profile alone and with each weight of the tower, then the tower's grid in order of its values."""
    grid = (TOWER_REST | dict(zip(TOWER_GRID, values)) for values in itertools.product(*TOWER_GRID.values()))
    return [HYBRID_RECALL, *(HYBRID_RECALL | {"user_tower": w} for w in TOWER_WEIGHTS), *grid]


def weight_profiles() -> list[dict[str, float]]:
    """The single profiles, then the grid in order of its values."""
    return [*BASE_PROFILES, *({"seqcf": 1.1, "popular": 0.05} | dict(zip(GRID, values)) for values in itertools.product(*GRID.values()))]


def channels(**lists: DataFrame) -> DataFrame:
    """Ranked lists (user_id, item_id, rank) as one table with channel and its place; no shuffle."""
    out = None
    for i, (name, df) in enumerate(lists.items()):
        one = df.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("channel"), F.lit(i).alias("channel_no"))
        out = one if out is None else out.unionByName(one)
    return out


def _weights(weights: dict[str, float], missing: float | None):
    pairs = itertools.chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in weights.items())
    w = F.try_element_at(F.create_map(*pairs), F.col("channel")) if weights else F.lit(None).cast("double")
    return w if missing is None else F.coalesce(w, F.lit(missing))


def weighted_rrf(ranked: DataFrame, weights: dict[str, float], *, k: int = 100, c: int = 60, missing: float | None = None) -> DataFrame:
    """user_id, item_id, score, channel, rank: sums of weight / (c + rank).

    Channels of weight 0 or less are left out, and so are those without one
    unless ``missing`` is given.  ``channel`` is the first that has the item.
    """
    rows = ranked.withColumn("w", _weights(weights, missing)).filter("w > 0").repartition("user_id")  # serves sums and ranks
    sums = rows.groupBy("user_id", "item_id").agg(F.round(F.sum(F.col("w") / (c + F.col("rank"))), 9).alias("score"), F.min_by("channel", "channel_no").alias("channel"))
    return top(sums, "user_id", k, F.desc("score"), F.col("item_id"))


def snake_merge(ranked: DataFrame, *, k: int = 20) -> DataFrame:
    """Passes over the lists' positions; lists of odd place are read from their end.  First wins; user_id, item_id, rank."""
    from pyspark.sql import Window as W

    ranked = ranked.repartition("user_id")  # serves sizes, firsts and ranks
    size = F.count(F.lit(1)).over(W.partitionBy("user_id", "channel_no"))
    place = F.when(F.col("channel_no") % 2 == 0, F.col("rank") - 1).otherwise(size - F.col("rank"))
    return _first_wins(ranked.withColumn("place", place), k)


def round_robin(ranked: DataFrame, *, k: int = 20) -> DataFrame:
    return _first_wins(ranked.repartition("user_id").withColumn("place", F.col("rank") - 1), k)


def _first_wins(ranked: DataFrame, k: int) -> DataFrame:
    best = ranked.groupBy("user_id", "item_id").agg(F.min(F.struct("place", "channel_no")).alias("key"))
    return top(best, "user_id", k, F.col("key")).select("user_id", "item_id", "rank")


def search_weights(ranked: DataFrame, truth: DataFrame, *, k: int = 20, profiles: list[dict[str, float]] | None = None) -> DataFrame:
    """profile (number), score: mean recall@k of each profile over its users with a list and truth, best first.

    A user's lists (a few channels of bounded length) are one row; all profiles
    are scored on it as one matrix product, and only a sum and a number of
    users for each profile are shuffled.
    """
    import numpy as np
    import pandas as pd

    profiles = profiles or weight_profiles()
    names = sorted({c for p in profiles for c in p})
    w = np.array([[max(float(p.get(c, 0.0)), 0.0) for c in names] for p in profiles]).T
    wanted = truth.groupBy("user_id").agg(F.collect_list("item_id").alias("truth"))
    lists = ranked.filter(F.col("channel").isin(names)).groupBy("user_id").agg(F.collect_list(F.struct("item_id", "rank", "channel")).alias("rows")).join(wanted, "user_id")

    def score(batches):
        total, users = np.zeros(len(profiles)), np.zeros(len(profiles), np.int64)
        for pdf in batches:
            for rows, true in zip(pdf["rows"], pdf["truth"]):
                items, own = np.unique([r["item_id"] for r in rows], return_inverse=True)
                m = np.zeros((len(items), len(names)))
                np.add.at(m, (own, [names.index(r["channel"]) for r in rows]), [1 / (60 + r["rank"]) for r in rows])
                s = np.round(m @ w, 9)
                order = np.argsort(-s, axis=0, kind="stable")[:k]  # items are in order: ties go to the smaller one
                hit = np.isin(items, true)[order] & (np.take_along_axis(s, order, 0) > 0)
                some = (s > 0).any(0)
                total += np.where(some, hit.sum(0) / len(true), 0.0)
                users += some
        yield pd.DataFrame({"profile": np.arange(len(profiles), dtype=np.int32), "total": total, "users": users})

    sums = lists.mapInPandas(score, "profile int, total double, users long").groupBy("profile").agg(F.sum("total").alias("total"), F.sum("users").alias("users"))
    return sums.filter("users > 0").select("profile", F.round(F.col("total") / F.col("users"), 9).alias("score")).orderBy(F.desc("score"), "profile")
