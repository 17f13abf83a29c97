"""Ranking samples: features, labels, negative sampling, encoding; factorisation-machine scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators.history import numbered, numbered_within, top
from quillon.operators.parallel import Adam, Model, Trained, train
from quillon.sources.paths import stored, work_dir

# The features of the click model, of the user and of the item.
USER_FEATURES = ("user_id", "gender", "age", "occupation", "zip_code", "user_avg_rating_bin", "user_rating_count_bin", "user_active_days_bin")
ITEM_FEATURES = ("item_id", "genre", "is_adult", "year_bin", "avg_rating_bin", "rating_count_bin", "rating_deviation_bin", "imdb_rating_bin", "imdb_votes_bin")


def user_stats(ratings: DataFrame) -> DataFrame:
    """user_id, avg, count, last and first ts, active days (never negative)."""
    g = ratings.groupBy("user_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("rating_count"), F.max("ts").alias("max_ts"), F.min("ts").alias("min_ts"))
    return g.withColumn("active_days", F.greatest(F.lit(0.0), (F.col("max_ts") - F.col("min_ts")) / 86400.0))


def item_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("rating_count"))


def features(pairs: DataFrame, users: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs (user_id, item_id, ...) with all user and item features; the same for training and for scoring."""
    u = user_stats(ratings).select("user_id", F.col("avg_rating").alias("u_avg"), F.col("rating_count").alias("u_cnt"), F.col("active_days").alias("u_days"))
    i = item_stats(ratings).select("item_id", F.col("avg_rating").alias("i_avg"), F.col("rating_count").alias("i_cnt"))
    people = users.join(u, "user_id", "left")
    things = items.join(i, "item_id", "left")
    full = pairs.join(people.select("user_id", "gender", "age", "occupation", "zip_code", "u_avg", "u_cnt", "u_days"), "user_id", "left")
    full = full.join(things.select("item_id", "genres", "is_adult", "year", "imdb_rating", "imdb_votes", "i_avg", "i_cnt"), "item_id", "left")
    return full.select(
        *pairs.columns, "gender", F.col("age").cast("string").alias("age"), "occupation", "zip_code",
        S.bin_avg_rating(F.col("u_avg")).alias("user_avg_rating_bin"), S.bin_rating_count(F.col("u_cnt")).alias("user_rating_count_bin"), S.bin_active_days(F.col("u_days")).alias("user_active_days_bin"),
        S.first_or_unknown(F.col("genres")).alias("genre"), F.coalesce("is_adult", F.lit(0)).cast("string").alias("is_adult"), S.bin_year(F.col("year")).alias("year_bin"), S.bin_avg_rating(F.col("i_avg")).alias("avg_rating_bin"),
        S.bin_rating_count(F.col("i_cnt")).alias("rating_count_bin"), S.bin_rating_deviation(F.coalesce("u_avg", F.lit(0.0)) - F.coalesce("i_avg", F.lit(0.0))).alias("rating_deviation_bin"),
        S.bin_avg_rating(F.col("imdb_rating")).alias("imdb_rating_bin"), S.bin_imdb_votes(F.col("imdb_votes")).alias("imdb_votes_bin"),
    )


def training_samples(ratings: DataFrame, users: DataFrame, items: DataFrame, *, threshold: float = 8.0, ratio: int = 4, seed: int = 42) -> DataFrame:
    """Rated pairs with click (1 from ``threshold`` on), and ``ratio`` unrated items for each click as rows of click 0, all with their features.

    ``rating`` is 0 for sampled rows.
    """
    rated = label(ratings.select("user_id", "item_id", "rating"), threshold)
    drawn = sample_negatives(rated.filter("click = 1"), ratings, items, ratio, seed=seed)
    zero = F.lit(0)
    both = rated.unionByName(drawn.select("user_id", F.col("negative").alias("item_id"), zero.cast(rated.schema["rating"].dataType).alias("rating"), zero.alias("click")))
    return features(both, users, items, ratings)


def label(ratings: DataFrame, threshold: float = 4.0, relative: bool = False) -> DataFrame:
    """Adds click: rating at least the threshold, or at least the user's mean."""
    if not relative:
        return ratings.withColumn("click", (F.col("rating") >= threshold).cast("int"))
    return ratings.withColumn("click", (F.col("rating") >= F.avg("rating").over(W.partitionBy("user_id"))).cast("int"))


def user_split(users: DataFrame, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """user_id, part: users by the first 28 bits of an md5 of id and seed, so a user's part depends on no other."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "user_id", F.lit(seed))), 1, 7), 16, 10).cast("double") / 268435456.0
    return users.select("user_id", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test").alias("part"))


#: Ratings of a user whose places are still compared as an array.
MANY = 2_000


def sample_negatives(positive: DataFrame, rated: DataFrame, items: DataFrame, ratio: int = 4, draws: int = 4, seed: int = 42, many: int = MANY) -> DataFrame:
    """user_id, item_id (of the positive), negative, pick (1..ratio): different items that the user has not rated.

    Each positive draws ``ratio * draws`` places of the item list by md5,
    drops the rated ones and keeps the first ``ratio`` different ones.
    Positives that get fewer than ``ratio`` that way - users who rated nearly
    everything - draw among the places that their user left free, all of them
    where there are fewer.  Nothing is crossed with all items.

    Draws are compared with the user's rated places as arrays in one row;
    users of more than ``many`` ratings, whose arrays are long, by joins.
    """
    path = work_dir(positive.sparkSession, "negatives")
    n_items = items.select("item_id").distinct()
    ids = numbered(n_items, F.col("item_id"), name="place", first=0)
    total = n_items.count()
    p = positive.select("user_id", "item_id")
    seen = rated.select("user_id", F.col("item_id").alias("negative")).distinct()
    often = stored(seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > many).select("user_id"), f"{path}/often")
    few = lambda rows: rows.join(often, "user_id", "left_anti")
    taken = few(seen).join(ids.withColumnRenamed("item_id", "negative"), "negative").groupBy("user_id").agg(F.collect_list("place").alias("taken"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(ratio * draws)), lambda d: F.pmod(_bits(d.cast("string"), seed), F.lit(max(total, 1))))
    # array_except keeps the order, and one of equal places
    picked = few(p).join(taken, "user_id", "left").select("user_id", "item_id", F.slice(F.array_except(draws, F.coalesce("taken", F.array().cast("array<bigint>"))), 1, ratio).alias("picks"))
    if not often.isEmpty():
        drawn = p.join(often, "user_id", "left_semi").select("user_id", "item_id", F.posexplode(draws).alias("d", "place"))
        free = drawn.join(seen.join(often, "user_id", "left_semi").join(ids.withColumnRenamed("item_id", "negative"), "negative").select("user_id", "place"), ["user_id", "place"], "left_anti")
        first = free.groupBy("user_id", "item_id", "place").agg(F.min("d").alias("d")).groupBy("user_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("d", "place"))).alias("x"))
        held = p.join(often, "user_id", "left_semi").join(first, ["user_id", "item_id"], "left")
        picked = picked.unionByName(held.select("user_id", "item_id", F.slice(F.coalesce(F.col("x.place"), F.array().cast("array<bigint>")), 1, ratio).alias("picks")))
    picked = stored(picked, f"{path}/picked")
    placed = picked.filter(F.size("picks") >= ratio).select("user_id", "item_id", F.posexplode("picks").alias("_j", "place"))
    good = placed.join(ids.withColumnRenamed("item_id", "negative"), "place").select("user_id", "item_id", "negative", (F.col("_j") + 1).cast("long").alias("pick"))
    short = picked.filter(F.size("picks") < ratio).select("user_id", "item_id")
    if short.isEmpty():
        return good
    taken = seen.join(short.select("user_id").distinct(), "user_id", "left_semi").join(ids.withColumnRenamed("item_id", "negative"), "negative").select("user_id", "place")
    rest = draw_free_places(short, taken, total, ratio, seed).join(ids.withColumnRenamed("item_id", "negative"), "place")
    return good.unionByName(rest.select("user_id", "item_id", "negative", "pick"))


def _bits(draw: str | Column, seed: int) -> Column:
    """48 bits of an md5 of a positive, the number of a draw and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col("user_id"), F.col("item_id"), draw, F.lit(seed))), 1, 12), 16, 10).cast("bigint")


def free_stretches(taken: DataFrame, total: int) -> DataFrame:
    """user_id, lo, hi, before: the free places of each user by rank, those of rank lo up to hi have ``before`` taken places in front.

    ``taken`` has user_id and place, of ``total`` places.  A user's i-th taken
    place has place - i free ones in front, so rank + before is the place.
    """
    numbers = numbered_within(taken, ["user_id"], F.col("place"), name="i", first=0).select("user_id", "i", (F.col("place") - F.col("i")).alias("free"))
    starts = numbers.select("user_id", F.col("free").alias("lo"), (F.col("i") + 1).alias("before"))
    starts = starts.unionByName(taken.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("before")))
    ends = numbers.select("user_id", F.col("i").alias("before"), F.col("free").alias("hi"))
    both = starts.join(ends, ["user_id", "before"], "left").withColumn("hi", F.coalesce("hi", F.lit(total) - F.col("before")))
    return both.filter("lo < hi").select("user_id", "lo", "hi", "before")


def draw_free_places(positive: DataFrame, taken: DataFrame, total: int, ratio: int, seed: int) -> DataFrame:
    """user_id, item_id, place, pick: ``ratio`` different free places of the user for each positive, every set of them as likely.

    Ranks among the free places are drawn without repeats (the j-th draw is
    among the first c - ratio + j, and is the last of these if it came up
    before).  The place of a rank is found in the one stretch of free places
    that holds it; stretches and ranks meet in pieces of the user's mean
    stretch, so that users of many ratings are spread out.
    """
    free = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).select("user_id", (F.lit(total) - F.col("_n")).alias("_free"), F.greatest(F.lit(1), F.floor((F.lit(total) - F.col("_n")) / (F.col("_n") + 1))).alias("_width"))
    rows = positive.select("user_id", "item_id").join(free, "user_id").filter("_free > 0").withColumn("_m", F.least(F.lit(ratio).cast("long"), F.col("_free")))

    def drawn(chosen: Column, j: Column) -> Column:
        last = F.col("_free") - F.col("_m") + j
        x = F.pmod(_bits(j.cast("string"), seed + 1), last + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, x), last).otherwise(x)))

    ranks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1), F.array().cast("array<bigint>"), drawn)
    rows = rows.select("user_id", "item_id", "_width", F.posexplode(ranks).alias("_j", "_rank")).withColumn("_piece", F.floor(F.col("_rank") / F.col("_width")))
    pieces = free_stretches(taken, total).join(free, "user_id")
    pieces = pieces.select("user_id", "lo", "hi", "before", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_width")), F.floor((F.col("hi") - 1) / F.col("_width")))).alias("_piece"))
    found = rows.join(pieces, ["user_id", "_piece"]).filter("_rank >= lo and _rank < hi")
    return found.select("user_id", "item_id", (F.col("_rank") + F.col("before")).alias("place"), (F.col("_j") + 1).cast("long").alias("pick"))


def fit_vocabulary(train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """feature, value, code: the sorted distinct values of each feature, numbered from 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value")) for c in columns])).alias("x")
    values = train.select(pairs).select("x.feature", "x.value").distinct()
    return numbered_within(values, ["feature"], F.col("value"), name="code", first=0)


#: Values of a feature whose codes are sent to every task.
FEW_VALUES = 50_000


def encode(rows: DataFrame, vocabulary: DataFrame, columns: tuple[str, ...], prefix: str = "", most: int = FEW_VALUES) -> DataFrame:
    """Features replaced by their codes, or beside them as ``prefix`` + name; unseen values are 0.

    Codes of up to ``most`` values are broadcast, so rows are shuffled only for
    larger features, and then with the codes of the others in place of texts.
    """
    sizes = {r["feature"]: r["n"] for r in vocabulary.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each feature
    for c in sorted(columns, key=lambda c: sizes.get(c, 0) > most):
        codes = vocabulary.filter(F.col("feature") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"_code_{c}"))
        codes = F.broadcast(codes) if sizes.get(c, 0) <= most else codes
        rows = rows.join(codes, F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) == F.col(f"_{c}"), "left").withColumn(prefix + c, F.coalesce(f"_code_{c}", F.lit(0)).cast("long")).drop(f"_{c}", f"_code_{c}")
    return rows


def fm_term(vectors: Column) -> Column:
    """Half of (sum of vectors) squared minus the sum of squares, of an array of vectors."""
    dims = F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1)
    total = lambda d, f: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + f(F.get(v, d)))
    return F.aggregate(F.transform(dims, lambda d: F.pow(total(d, lambda x: x), F.lit(2.0)) - total(d, lambda x: x * x)), F.lit(0.0), lambda s, x: s + x) / 2


class DeepFM:
    """Linear terms, factorisation machine and a perceptron with batch normalisation and dropout on label-encoded features.

    ``fit`` trains on all rows, in the tasks of a barrier stage; ``predict``
    scores any number of rows, in tasks that map the parameters into memory.
    """

    def __init__(self, columns: tuple[str, ...], dims: list[int], embed: int = 16, hidden: tuple[int, ...] = (64, 32, 16), dropout: float = 0.2, seed: int = 42):
        self.columns, self.dims, self.offsets = tuple(columns), list(dims), np.cumsum([0, *dims[:-1]])
        self.embed, self.hidden, self.dropout, self.seed = embed, hidden, dropout, seed
        self.trained: Trained | None = None

    def init(self) -> dict[str, np.ndarray]:
        rng, n, width = np.random.default_rng(self.seed), sum(self.dims), self.embed * len(self.dims)
        p = {"linear": np.zeros((n, 1)), "embed": rng.normal(0, 0.05, (n, self.embed)), "bias": np.zeros(1)}
        for i, h in enumerate(self.hidden):
            p |= {f"w{i}": rng.normal(0, (2 / width) ** 0.5, (width, h)), f"scale{i}": np.ones(h), f"shift{i}": np.zeros(h), f"mean{i}": np.zeros(h), f"var{i}": np.ones(h)}
            width = h
        return p | {"out": rng.normal(0, (1 / width) ** 0.5, (width, 1))}

    def forward(self, p: dict[str, np.ndarray], x: np.ndarray, rng: np.random.Generator | None = None):
        """Logits of code rows (n, features) and what the gradient needs; with ``rng`` as in training: batch statistics, which move the running ones, and dropout."""
        rows = np.minimum(x, np.array(self.dims) - 1) + self.offsets
        e = p["embed"][rows]
        s = e.sum(1)
        fm = 0.5 * ((s**2).sum(1) - (e**2).sum((1, 2)))
        act, layers = e.reshape(len(x), -1), []
        for i in range(len(self.hidden)):
            z = act @ p[f"w{i}"]
            if rng is None:
                mean, var, drop = p[f"mean{i}"], p[f"var{i}"], None
            else:
                mean, var = z.mean(0), z.var(0)
                p[f"mean{i}"][...] += 0.1 * (mean - p[f"mean{i}"])
                p[f"var{i}"][...] += 0.1 * (var * len(z) / max(1, len(z) - 1) - p[f"var{i}"])
                drop = (rng.random(z.shape) >= self.dropout) / (1 - self.dropout)
            norm = (z - mean) / np.sqrt(var + 1e-5)
            y = norm * p[f"scale{i}"] + p[f"shift{i}"]
            layers.append((act, norm, var, y, drop))
            act = np.maximum(y, 0) if drop is None else np.maximum(y, 0) * drop
        return p["bias"][0] + p["linear"][rows, 0].sum(1) + fm + (act @ p["out"])[:, 0], (rows, e, s, layers, act)

    def gradient(self, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, dict]:
        """Summed log loss of a batch, and gradients of its mean."""
        logit, (rows, e, s, layers, act) = self.forward(p, x, rng)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(x)
        g = {"bias": np.array([d.sum()]), "out": act.T @ d[:, None]}
        back = d[:, None] @ p["out"].T
        for i in range(len(self.hidden) - 1, -1, -1):
            inner, norm, var, out, drop = layers[i]
            back = back * drop * (out > 0)
            g[f"scale{i}"], g[f"shift{i}"] = (back * norm).sum(0), back.sum(0)
            dn = back * p[f"scale{i}"]
            dz = (dn - dn.mean(0) - norm * (dn * norm).mean(0)) / np.sqrt(var + 1e-5)
            g[f"w{i}"] = inner.T @ dz
            back = dz @ p[f"w{i}"].T
        de = d[:, None, None] * (s[:, None, :] - e) + back.reshape(e.shape)
        g["linear"], g["embed"] = (rows.ravel(), np.repeat(d, x.shape[1])[:, None]), (rows.ravel(), de.reshape(-1, self.embed))
        return float(np.logaddexp(0, logit).sum() - (y * logit).sum()), g

    def loss(self, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> float:
        logit, _ = self.forward(p, x)
        return float(np.logaddexp(0, logit).sum() - (y * logit).sum())

    def fit(self, rows: DataFrame, by: tuple[str, ...], *, held: Column | None = None, epochs: int = 20, batch: int = 1024, rate: float = 0.001, patience: int = 3, tasks: int | None = None) -> list[float]:
        """Adam on the log loss of all ``rows`` (codes, click, and ``by``, which orders them); the losses of held-out rows.

        The rate halves when the held-out loss stops falling, and training ends
        after ``patience`` such epochs with the parameters of the best.
        """

        def encode(table) -> dict[str, np.ndarray]:
            """Codes in as few bytes as their number allows, a column each."""
            codes = {c: np.minimum(table[c].to_numpy(), n - 1).astype(np.min_scalar_type(n - 1)) for c, n in zip(self.columns, self.dims)}
            return codes | {"click": table["click"].to_numpy().astype(np.int8)}

        def of(data, r) -> tuple[np.ndarray, np.ndarray]:
            return np.column_stack([data[c][r].astype(np.int64) for c in self.columns]), data["click"][r].astype(float)

        model = Model(
            lambda: {k: p.astype(np.float32) for k, p in self.init().items()},  # as models are exchanged
            encode, lambda p, data, r, rng: self.gradient(p, *of(data, r), rng), lambda p: Adam(p, rate), ("linear", "embed"),
            lambda p, data, r: self.loss(p, *of(data, r)), by_batch=True,
        )
        self.trained = train(rows.select(*dict.fromkeys((*by, *self.columns, "click")), *([held.alias("_out")] if held is not None else [])), by, model, held=None if held is None else F.col("_out"), epochs=epochs, batch=batch, syncs=2, patience=patience, seed=self.seed, tasks=tasks)
        return self.trained.losses

    def predict(self, rows: DataFrame, keep: tuple[str, ...] = ("user_id", "item_id", "click")) -> DataFrame:
        """The kept columns and pred (four decimals)."""
        model = self

        def score(batches):
            p = model.trained.params()
            for pdf in batches:
                if len(pdf):
                    logit, _ = model.forward(p, pdf[[f"x_{c}" for c in model.columns]].to_numpy(np.int64))
                    yield pdf[list(keep)].assign(pred=np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 4))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", pred double"
        return rows.select(*keep, *[F.col(c).alias(f"x_{c}") for c in self.columns]).mapInPandas(score, schema)


def rank_candidates(candidates: DataFrame, ctr: DataFrame | None, *, k: int = 20) -> DataFrame:
    """user_id, item_id, score, rank: by predicted click rate, by the recall score where there is none (or no model)."""
    rows = candidates
    if ctr is None:
        rows = rows.withColumn("final", F.col("score"))
    else:
        rows = rows.join(ctr.select("user_id", "item_id", "pred"), ["user_id", "item_id"], "left").withColumn("final", F.coalesce("pred", "score"))
    return top(rows.select("user_id", "item_id", F.col("final").alias("score")), "user_id", k, F.desc("score"), F.col("item_id"))
