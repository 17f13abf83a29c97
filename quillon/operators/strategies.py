"""Strategies by name: recall channels, rankers, re-rankers and cold-start channels, and the sets of them that are enabled."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import fusion, ranking, recall, rerank
from quillon.operators.ease import ease as ease_edges
from quillon.operators.history import top, unseen

log = logging.getLogger(__name__)


class Registry:
    """Strategies of one kind, by name, in the order in which they were registered."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable:
        def put(f: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{self.kind} strategy {name!r} is registered already")
            self._known[name] = f
            return f

        return put

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.kind} strategy {name!r}; known: {', '.join(self._known)}")
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)

    def enabled(self, names: Iterable[str] | None = None) -> dict[str, Callable]:
        """The named strategies in the order given (all, if None); an unknown name is an error."""
        return {n: self[n] for n in (self._known if names is None else names)}


RECALL, RANK, RERANK, COLD_START = Registry("recall"), Registry("rank"), Registry("rerank"), Registry("cold-start")


@dataclass
class Inputs:
    """What recall channels read.  ``hist`` should be a stored table, as every channel scans it."""

    hist: DataFrame
    items: DataFrame
    k: int = 50
    content: DataFrame | None = None
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def channel(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        cap, rate = recall.EDGE_CHANNELS[name]
        edges = self.edges.get(name)
        return recall.by_edges(self.hist, build(self.hist) if edges is None else edges, self.hist, cap=cap, rate=rate, k=self.k)


@RECALL.register("itemcf")
def itemcf(x: Inputs) -> DataFrame:
    return x.channel("itemcf", recall.itemcf)


@RECALL.register("seqcf")
def seqcf(x: Inputs) -> DataFrame:
    return x.channel("seqcf", recall.seqcf)


@RECALL.register("swing")
def swing(x: Inputs) -> DataFrame:
    return x.channel("swing", recall.swing)


@RECALL.register("usercf")
def usercf(x: Inputs) -> DataFrame:
    return recall.by_users(recall.usercf(x.hist), x.hist, x.hist, k=x.k)


@RECALL.register("genre")
def genre(x: Inputs) -> DataFrame:
    return recall.by_genre(x.hist, x.items, recall.genre_index(x.items, recall.popularity(x.hist)), x.hist, k=x.k)


@RECALL.register("popular")
def popular(x: Inputs) -> DataFrame:
    return recall.by_popularity(x.hist.select("user_id").distinct(), recall.popularity(x.hist), x.hist, k=x.k)


@RECALL.register("ease")
def ease(x: Inputs) -> DataFrame:
    return x.channel("ease", ease_edges)


@RECALL.register("content")
def content(x: Inputs) -> DataFrame:
    if x.content is None:
        raise ValueError("the content channel needs item vectors")
    return recall.by_vectors(recall.user_vectors(x.hist, x.content), x.content, x.hist, k=x.k, digits=6)


#: Channels of the offline profiles, and those whose lists SQL can give as well.
OFFLINE = ("itemcf", "seqcf", "ease", "swing", "usercf", "content", "genre", "popular")
IN_SQL = ("itemcf", "seqcf", "swing", "usercf", "genre", "popular")


def recall_lists(x: Inputs, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The ranked lists of the enabled channels."""
    return {name: f(x) for name, f in RECALL.enabled(names).items()}


# ---- the live flow's channels ------------------------------------------------------

LIVE = Registry("live recall")


@dataclass
class Live:
    """What the live channels read: stored histories, items, each user's genres (user_id, genre), items with their averages.

    ``vectors`` (item_id, vec) are item embeddings; ``tower`` and ``bpr`` are
    pairs of user and item vectors, None where no model is trained.
    """

    hist: DataFrame
    items: DataFrame
    liked: DataFrame
    rated: DataFrame
    vectors: DataFrame
    tower: tuple[DataFrame, DataFrame] | None = None
    bpr: tuple[DataFrame, DataFrame] | None = None
    k: int = 50

    def edges(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Online scorers read 100 items of the history and do not look for repeats."""
        return recall.by_edges(self.hist, build(self.hist), self.hist, cap=100, rate=recall.EDGE_CHANNELS[name][1], k=self.k, dedupe=False)

    def model(self, name: str) -> DataFrame:
        pair = getattr(self, name)
        if pair is None:
            raise ValueError(f"no {name} model")
        return recall.by_vectors(*pair, self.hist, k=self.k)


@LIVE.register("user_preference")
def user_preference(x: Live) -> DataFrame:
    return rerank.by_user_genres(x.liked, x.rated, k=x.k)


@LIVE.register("youtubednn")
def youtubednn(x: Live) -> DataFrame:
    return x.model("tower")


@LIVE.register("item_embedding")
def item_embedding(x: Live) -> DataFrame:
    """The items nearest to the newest one of the history."""
    newest = x.hist.filter("pos = n").join(x.vectors, "item_id").select("user_id", "vec")
    return recall.by_vectors(newest, x.vectors, x.hist, k=x.k, digits=6)


for _name, _build in (("itemcf", recall.itemcf), ("seqcf", recall.seqcf), ("ease", ease_edges), ("swing", recall.swing)):
    LIVE.register(_name)(lambda x, name=_name, build=_build: x.edges(name, build))


@LIVE.register("usercf")
def live_usercf(x: Live) -> DataFrame:
    return recall.by_users(recall.usercf(x.hist), x.hist, x.hist, k=x.k)


@LIVE.register("bpr")
def bpr_vectors(x: Live) -> DataFrame:
    return x.model("bpr")


@LIVE.register("popular")
def live_popular(x: Live) -> DataFrame:
    """Of the best rated 3 k items the unseen ones, by mean times log count."""
    from quillon.operators.catalog_ops import best_rated

    head = best_rated(x.rated.filter("avg_rating is not null"), 3 * x.k).select("item_id", F.round(S.live_popularity(F.col("avg_rating"), F.col("rating_count")), 9).alias("score"))
    both = x.hist.select("user_id").distinct().crossJoin(F.broadcast(head))  # 3 k rows
    return top(unseen(both, x.hist), "user_id", x.k, F.desc("score"), F.col("item_id"))


# The channels that the live flow has switched on, in their order (bpr is off).
LIVE_ENABLED = ("user_preference", "youtubednn", "item_embedding", "itemcf", "seqcf", "ease", "swing", "usercf", "popular")
#: Those whose lists SQL can give as well.
LIVE_IN_SQL = tuple(c for c in LIVE_ENABLED if c not in ("youtubednn", "ease"))


def live_lists(x: Live, names: Iterable[str] = LIVE_ENABLED) -> dict[str, DataFrame]:
    return {name: f(x) for name, f in LIVE.enabled(names).items()}


# ---- ranking --------------------------------------------------------------------


@RANK.register("ctr")
def by_ctr(candidates: DataFrame, ctr: DataFrame | None, k: int) -> DataFrame:
    """By predicted click rate; candidates without a prediction have their recall score.  Needs a model's predictions."""
    if ctr is None:
        raise ValueError("no click model")
    return ranking.rank_candidates(candidates, ctr, k=k)


@RANK.register("recall_score")
def by_recall_score(candidates: DataFrame, ctr: DataFrame | None, k: int) -> DataFrame:
    return ranking.rank_candidates(candidates, None, k=k)


def rank_stage(candidates: DataFrame, ctr: DataFrame | None = None, *, k: int = 20, order: Iterable[str] = ("ctr", "recall_score")) -> DataFrame:
    """The first ranker in ``order`` that can rank these candidates; without any, they pass through in order of rank.

    A ranker that is not there for want of a model or a column is left for the
    next; errors of running jobs are not hidden.
    """
    from pyspark.errors import AnalysisException

    for name, f in RANK.enabled(order).items():
        try:
            out = f(candidates, ctr, k)
            out.schema  # noqa: B018  plans it
            return out
        except (ValueError, AnalysisException) as e:
            log.warning("ranker %s is left out: %s", name, str(e).partition("\n")[0])
    return candidates.filter(F.col("rank") <= k).select("user_id", "item_id", "score", "rank")


RERANK.register("genre_dispersion")(rerank.disperse_genres)
RERANK.register("decade_dispersion")(rerank.disperse_decades)


def rerank_stage(ranked: DataFrame, names: Iterable[str] = ("genre_dispersion", "decade_dispersion")) -> DataFrame:
    return rerank.chain(ranked, *RERANK.enabled(names).values())


# ---- cold start -----------------------------------------------------------------


@dataclass
class Cold:
    """What cold-start strategies read: users without a history, genre counters, stored genres (an array), items with averages."""

    users: DataFrame
    counters: DataFrame
    profile: DataFrame
    rated: DataFrame
    default: str = "Action"
    k: int = 20


@COLD_START.register("ucb_genre")
def ucb_genre(x: Cold) -> DataFrame:
    return rerank.by_user_genres(rerank.best_ucb_genre(x.users, x.counters, x.default).select("user_id", "genre"), x.rated, k=x.k)


@COLD_START.register("preferred_genre")
def preferred_genre(x: Cold) -> DataFrame:
    return rerank.by_user_genres(x.profile.select("user_id", F.explode("genres").alias("genre")).join(x.users.select("user_id"), "user_id", "left_semi"), x.rated, k=x.k)


@COLD_START.register("popular_recent")
def popular_recent(x: Cold) -> DataFrame:
    return rerank.popular_for_all(x.users, x.rated, k=x.k)


def cold_lists(x: Cold, names: Iterable[str] | None = None) -> DataFrame:
    """user_id, item_id, rank: the enabled strategies' lists, merged round robin in their order."""
    return fusion.round_robin(fusion.channels(**{name: f(x) for name, f in COLD_START.enabled(names).items()}), k=x.k)
