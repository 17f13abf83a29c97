"""Diversity re-ranking, cold start, enrichment and the whole flow."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators.history import top

log = logging.getLogger(__name__)


def dispersed(keys: Column, run: int, free: Callable[[Column], Column], alike: Callable[[Column, Column], Column]) -> Column:
    """The places of an array of keys in an order in which alike keys do not stand too often in a row.

    An item fits while fewer than ``run`` are placed, if its key is ``free``, or
    if one of the last ``run - 1`` placed keys is not ``alike``.  Items that do
    not fit wait; each placement gives the waiting ones another try, the latest
    first, and those that wait at the end follow in order.  Arrays of at most
    ``run`` keys stay as they are.  One fold over the places, whose state is the
    placed and the waiting ones.
    """
    none = F.array().cast("array<int>")
    state = lambda placed, waiting: F.struct(placed.alias("placed"), waiting.alias("waiting"))

    def fits(placed: Column, i: Column) -> Column:
        key = F.get(keys, i)
        other = F.exists(F.slice(placed, -(run - 1), run - 1), lambda j: ~alike(key, F.get(keys, j))) if run > 1 else F.lit(False)
        return (F.size(placed) < run) | free(key) | other

    def again(s: Column, j: Column) -> Column:
        one = F.array(j)
        return F.when(fits(s["placed"], j), state(F.concat(s["placed"], one), s["waiting"])).otherwise(state(s["placed"], F.concat(one, s["waiting"])))

    def step(s: Column, i: Column) -> Column:
        one = F.array(i)
        after = F.aggregate(F.reverse(s["waiting"]), state(F.concat(s["placed"], one), none), again)
        return F.when(fits(s["placed"], i), after).otherwise(state(s["placed"], F.concat(s["waiting"], one)))

    places = F.sequence(F.lit(0), F.size(keys) - 1)
    folded = F.aggregate(places, state(none, none), step, lambda s: F.concat(s["placed"], s["waiting"]))
    return F.when(F.size(keys) <= run, places).otherwise(folded)


def _by_user(ranked: DataFrame, key: Column, run: int, free: Callable[[Column], Column], alike: Callable[[Column, Column], Column]) -> DataFrame:
    """Re-orders each user's list (bounded by the ranking's cut) and renumbers rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*ranked.columns).alias("row"), key.alias("key"))))
    lists = ranked.groupBy("user_id").agg(rows.alias("rows"))
    order = dispersed(F.transform("rows", lambda r: r["key"]), run, free, alike)
    out = lists.select("rows", F.posexplode(order).alias("place", "at")).select("place", F.get("rows", F.col("at"))["row"].alias("row"))
    new = (F.col("place") + 1).cast(ranked.schema["rank"].dataType)
    return out.select(*[new.alias(c) if c == "rank" else F.col(f"row.{c}").alias(c) for c in ranked.columns])


def disperse_genres(ranked: DataFrame, run: int = 2) -> DataFrame:
    """ranked has user_id, rank, genres; items without a genre fit anywhere."""
    return _by_user(ranked, F.get("genres", F.lit(0)), run, lambda k: k.isNull(), lambda a, b: a.eqNullSafe(b))


def disperse_decades(ranked: DataFrame, run: int = 3) -> DataFrame:
    """ranked has user_id, rank, year; decades outside 1900 to 2100 fit anywhere, and count when others are compared with them."""
    decade = F.coalesce(F.floor(F.col("year") / 10), F.lit(0)).cast("int")
    return _by_user(ranked, decade, run, lambda k: ~k.between(190, 210), lambda a, b: a == b)


def chain(ranked: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies re-rankers in turn; a step that cannot be planned for its input is left out."""
    from pyspark.errors import AnalysisException

    for step in steps:
        try:
            out = step(ranked)
            out.schema  # noqa: B018  plans the step
            ranked = out
        except (AnalysisException, KeyError) as e:
            log.warning("re-ranker %s is left out: %s", getattr(step, "__name__", step), str(e).partition("\n")[0])
    return ranked


# ---- catalogue queries behind the channels -----------------------------------


def by_genres(items: DataFrame, genres, *, least: float = 5.0, k: int = 20) -> DataFrame:
    """Items of any of the genres (all, if none are named) rated at least ``least``, newest and best first."""
    good = items.filter(F.col("avg_rating") >= least)
    if genres:
        good = good.filter(F.arrays_overlap("genres", F.array(*[F.lit(g) for g in genres])))
    return good.orderBy(F.desc("year"), F.desc("avg_rating"), "item_id").limit(k)


def by_user_genres(wanted: DataFrame, items: DataFrame, *, least: float = 5.0, k: int = 20, score: float = 0.8) -> DataFrame:
    """wanted: user_id, genre.  user_id, item_id, score, rank: for all users in one join on the genre.

    No user needs more than the first k items of each of its genres, so each
    genre's list is cut to k and broadcast: a genre that all users want is in
    no one task.
    """
    listed = items.filter(F.col("avg_rating") >= least).select("item_id", "avg_rating", "year", F.explode("genres").alias("genre"))
    listed = top(listed, "genre", k, F.desc("avg_rating"), F.col("item_id"), rank="g")
    found = wanted.distinct().join(F.broadcast(listed), "genre").groupBy("user_id", "item_id").agg(F.max("avg_rating").alias("a"))
    return top(found, "user_id", k, F.desc("a"), F.col("item_id")).select("user_id", "item_id", F.lit(score).alias("score"), "rank")


# ---- cold start ---------------------------------------------------------------


def cold_users(users: DataFrame, hist: DataFrame, least: int = 5) -> DataFrame:
    """Adds n_history and cold: fewer than ``least`` history rows."""
    n = hist.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_history"))
    return users.join(n, "user_id", "left").withColumn("n_history", F.coalesce("n_history", F.lit(0))).withColumn("cold", F.col("n_history") < least)


def best_ucb_genre(users: DataFrame, counters: DataFrame, default: str = "Action") -> DataFrame:
    """user_id, genre, ucb: each user's genre of the largest UCB score; the default without any counters."""
    scored = counters.withColumn("ucb", S.ucb(F.col("n"), F.col("reward")))
    best = scored.groupBy("user_id").agg(F.min(F.struct((-F.col("ucb")).alias("u"), "genre")).alias("best")).select("user_id", "best.genre", (-F.col("best.u")).alias("ucb"))
    return users.select("user_id").join(best, "user_id", "left").withColumn("genre", F.coalesce("genre", F.lit(default)))


def popular_for_all(users: DataFrame, items: DataFrame, *, k: int = 20) -> DataFrame:
    """user_id, item_id, rank: the same k best rated items for every user."""
    from pyspark.sql import Window as W

    order = (F.desc("avg_rating"), F.desc("rating_count"), F.col("item_id"))
    head = items.filter("avg_rating >= 5").orderBy(*order).limit(k)
    head = head.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("item_id", "rank")
    return users.select("user_id").crossJoin(F.broadcast(head))  # k rows


def enrich(users: DataFrame, profile: DataFrame, hist: DataFrame, stats: DataFrame, *, cap: int = 100) -> DataFrame:
    """One row a user: stored profile, newest items in time order, statistics; missing ones are empty or 0."""
    newest = hist.filter(F.col("n") - F.col("pos") < cap).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda s: s["item_id"]).alias("history"))
    out = users.join(profile, "user_id", "left").join(newest, "user_id", "left").join(stats, "user_id", "left")
    out = out.withColumn("history", F.coalesce("history", F.array().cast("array<bigint>")))
    return out.withColumn("rating_count", F.coalesce("rating_count", F.lit(0))).withColumn("avg_rating", F.coalesce("avg_rating", F.lit(0.0)))


def whole_flow(fused: DataFrame, items: DataFrame, cold: DataFrame, *, ctr: DataFrame | None = None, k: int = 20) -> DataFrame:
    """user_id, item_id, score, rank, channel for all users in one job.

    ``fused`` (user_id, item_id, score, channel, rank) is ranked - by the click
    model, else by the recall score - and genres, then decades, are dispersed;
    the users of ``cold`` get that list instead.
    """
    from quillon.operators.strategies import rank_stage, rerank_stage

    warm = fused.join(cold.select("user_id").distinct(), "user_id", "left_anti")
    ranked = rank_stage(warm, ctr, k=k).join(warm.select("user_id", "item_id", "channel"), ["user_id", "item_id"])
    ranked = rerank_stage(ranked.join(items.select("item_id", "genres", "year"), "item_id", "left"))
    warm_rows = ranked.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"), "channel")
    return warm_rows.unionByName(cold.select("user_id", "item_id", F.lit(None).cast("double").alias("score"), "rank", F.lit("cold_start").alias("channel")))
