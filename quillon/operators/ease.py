"""EASE for all items: columns of the inverse Gram matrix by conjugate gradients.

With G = X'X of the 0/1 matrix X of users and items, and P the inverse of
G + lam I, the weight of item j for a user who has item i is -P[i, j] / P[j, j].
G + lam I is symmetric and well conditioned, as lam is large, so column i of P
comes from a few steps of conjugate gradients.  G is never built: a step
multiplies by X and then by X', which costs as many additions as there are
ratings, where the Gram matrix would hold a square of each history.

X is written once, in tiles of users, as sorted sparse rows that tasks map into
memory.  Items are dealt to tasks in blocks of columns; a task solves many
columns of a block at once.  P is zero between items that no chain of users and
items links, so items are put in order of their connected component, and a
column is solved in its component alone.  P is symmetric, so column i has all that the edges
of item i need but the diagonal: it lies between 1 / (lam + c) and 1 / lam for
an item of c users, which bounds how many entries can be among the k largest.
Only those and the diagonal leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.history import numbered, top
from quillon.sources.arrays import load, save
from quillon.sources.paths import stored, work_dir

DIGITS = 9
#: Ratings of a tile of users, and numbers of the columns that are solved at once (five such blocks are in memory).
TILE, COLUMNS = 1 << 20, 1 << 22
#: Numbers gathered at a time: they stay in a core's cache.
GATHERED = 1 << 16
#: Columns that are dealt to tasks together, and solved at once if there are few items.
BLOCK = 64


class Sums:
    """Sums of rows of a dense matrix over runs of places: one sparse product, chunk by chunk.

    Runs are taken by length, longest first.  The first rows of a chunk's runs are
    added at once, then the second rows of those that have one, and so on; what
    only a few runs still have is added up run by run.
    """

    #: Runs that are still worth a step for all of them.
    FEW = 16

    def __init__(self, places: np.ndarray, starts: np.ndarray):
        self.places = places
        lengths = np.diff(np.append(starts, len(places)))
        self.order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = np.asarray(starts)[self.order], lengths[self.order]

    def add(self, dense: np.ndarray, out: np.ndarray, rows: np.ndarray | slice) -> None:
        """out[rows] += the sums, run by run; ``rows`` are different."""
        width = dense.shape[1]
        most = max(1, GATHERED // width)
        buffer, total = np.empty((most, width)), np.empty((most, width))
        for a in range(0, len(self.starts), most):
            starts, lengths, own = self.starts[a : a + most], self.lengths[a : a + most], self.order[a : a + most]
            sums, steps = total[: len(own)], int(lengths[min(self.FEW, len(own)) - 1])
            sums[:] = 0
            left = np.searchsorted(-lengths, -np.arange(steps), "left")  # runs that are longer than each step
            for j, m in enumerate(left.tolist()):
                np.take(dense, self.places[starts[:m] + j], axis=0, out=buffer[:m], mode="clip")
                sums[:m] += buffer[:m]
            for run in range(int((lengths[: self.FEW] > steps).sum())):
                for at in range(int(starts[run]) + steps, int(starts[run] + lengths[run]), most):
                    some = self.places[at : min(at + most, int(starts[run] + lengths[run]))]
                    sums[run] += np.take(dense, some, axis=0, out=buffer[: len(some)], mode="clip").sum(0)
            out[own if isinstance(rows, slice) else rows[own]] += sums


class Tile:
    """Some users' rows of X: by user, and by item."""

    NAMES = ("items", "item_starts", "users", "own", "own_starts")

    def __init__(self, folder: str, tile: int):
        self._set(*(load(f"{folder}/{tile}-{n}.npy") for n in self.NAMES))

    def _set(self, *arrays: np.ndarray) -> None:
        self.arrays = arrays
        self.items, item_starts, users, own, own_starts = arrays
        self.n_users = len(own_starts)
        self.by_user, self.by_item = Sums(own, own_starts), Sums(users, item_starts)

    def lower(self, label: np.ndarray) -> None:
        """Gives each item the smallest label of the items of its users."""
        items, item_starts, users, own, own_starts = self.arrays
        of_user = np.minimum.reduceat(label[own], own_starts)
        label[items] = np.minimum(label[items], np.minimum.reduceat(of_user[users], item_starts))

    def part(self, some: np.ndarray, place: np.ndarray) -> Tile | None:
        """The rows of the users of some items (a mask; all or none of a user's), which get other places; None without users."""
        items, item_starts, users, own, own_starts = self.arrays
        user, item = some[own[own_starts]], some[items]
        if not user.any():
            return None
        per_user, per_item = np.diff(np.append(own_starts, len(own))), np.diff(np.append(item_starts, len(users)))
        begin = lambda n: np.cumsum(n) - n
        out = Tile.__new__(Tile)
        out._set(place[items[item]], begin(per_item[item]), (np.cumsum(user) - 1)[users[np.repeat(item, per_item)]], place[own[np.repeat(user, per_user)]], begin(per_user[user]))
        return out

    @classmethod
    def write(cls, folder: str, tile: int, user: np.ndarray, item: np.ndarray) -> None:
        place = np.unique(user, return_inverse=True)[1]
        by_user, by_item = np.lexsort((item, place)), np.lexsort((place, item))
        items, item_starts = np.unique(item[by_item], return_index=True)
        arrays = (items, item_starts, place[by_item], item[by_user], np.unique(place[by_user], return_index=True)[1])
        for name, x in zip(cls.NAMES, arrays):
            save(f"{folder}/{tile}-{name}.npy", x.astype(np.int64))

    def add_gram(self, v: np.ndarray, out: np.ndarray) -> None:
        """out += X'(X v) for this tile."""
        t = np.zeros((self.n_users, v.shape[1]))
        self.by_user.add(v, t, slice(None))
        self.by_item.add(t, out, self.items)


def components(tiles: list[Tile], n: int) -> np.ndarray:
    """For each item the smallest item that it is linked with, by users and other items in between."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for t in tiles:
            t.lower(new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Systems:
    """The equations of some items: those of their components alone, as the inverse is zero between components."""

    def __init__(self, tiles: list[Tile], counts: np.ndarray):
        self.tiles, self.counts = tiles, counts
        self.label = components(tiles, len(counts))
        self.order = np.argsort(self.label, kind="stable")
        self.sizes = np.bincount(self.label, minlength=len(counts))
        self._last = None

    def of(self, columns: np.ndarray) -> tuple[list[Tile], np.ndarray]:
        """Tiles, and the items that are their places in order; all items where the components have more than half of them."""
        labels = np.unique(self.label[columns])
        if self._last is None or not np.array_equal(self._last[0], labels):
            if 2 * self.sizes[labels].sum() > len(self.counts):
                self._last = labels, (self.tiles, np.arange(len(self.counts)))
            else:
                wanted = np.zeros(len(self.counts), bool)
                wanted[labels] = True
                some = wanted[self.label]
                parts = (t.part(some, np.cumsum(some) - 1) for t in self.tiles)
                self._last = labels, ([t for t in parts if t is not None], np.flatnonzero(some))
        return self._last[1]


def solve(tiles: list[Tile], counts: np.ndarray, columns: np.ndarray, lam: float, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """Columns of (X'X + lam I)^-1 by conjugate gradients, preconditioned with the diagonal, until every residual is small."""
    n, width = len(counts), len(columns)
    x, r = np.zeros((n, width)), np.zeros((n, width))
    r[columns, np.arange(width)] = 1.0
    scale = 1 / (lam + counts)[:, None]
    p = r * scale
    q, dots = np.empty((n, width)), lambda a, b: np.einsum("ij,ij->j", a, b)
    rz = dots(r, p)
    for _ in range(most):
        np.multiply(p, lam, out=q)
        for t in tiles:
            t.add_gram(p, q)
        curve = dots(p, q)
        a = rz / np.where(curve > 0, curve, 1.0)  # a column that is solved exactly has no direction left
        q *= a
        r -= q
        np.multiply(p, a, out=q)
        x += q
        if np.sqrt(dots(r, r)).max() <= tolerance:
            return x
        np.multiply(r, scale, out=q)
        before, rz = rz, dots(r, q)
        p *= rz / np.where(before > 0, before, 1.0)
        p += q
    raise RuntimeError(f"no solution after {most} steps")


def ease(hist: DataFrame, *, lam: float = 500.0, k: int = 200, tile: int = TILE, columns: int = COLUMNS) -> DataFrame:
    """Edges item_id, related_id, score, rank among all items of the (user_id, item_id) rows: the k largest positive weights of each item.

    A user's repeated items count once.  An empty history has no edges.
    """
    spark = hist.sparkSession
    folder = work_dir(spark, "ease")
    pairs = stored(hist.select("user_id", "item_id").distinct(), f"{folder}/pairs")
    counted = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    items = stored(numbered(counted, F.col("item_id"), name="i", first=0), f"{folder}/items")
    n, n_pairs = items.count(), pairs.count()
    if not n:
        return spark.createDataFrame([], "item_id long, related_id long, score double, rank long")
    n_tiles = -(-n_pairs // tile)
    dealt = pairs.join(items, "item_id").select("user_id", "i", F.pmod(F.xxhash64("user_id"), F.lit(n_tiles)).alias("tile"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        Tile.write(f"{folder}/x", int(pdf["tile"].iloc[0]), pdf["user_id"].to_numpy(), pdf["i"].to_numpy())
        return pdf[["tile"]].head(1)

    written = stored(dealt.groupBy("tile").applyInPandas(write, "tile long"), f"{folder}/tiles")
    names = sorted(r["tile"] for r in written.collect())  # one for each million ratings
    ranged = items.groupBy(F.shiftright("i", 20).alias("part"))  # a million items each

    def counts_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        save(f"{folder}/counts/{int(pdf['i'].iloc[0])}.npy", pdf["c"].to_numpy(np.int64))
        return pd.DataFrame({"first": [int(pdf["i"].iloc[0])]})

    firsts = sorted(r["first"] for r in stored(ranged.applyInPandas(counts_of, "first long"), f"{folder}/ranges").collect())

    def run(batches):
        tiles = [Tile(f"{folder}/x", t) for t in names]
        counts = np.concatenate([load(f"{folder}/counts/{f}.npy") for f in firsts])
        systems = Systems(tiles, counts)
        for pdf in batches:
            for first in pdf["id"].tolist():
                todo = systems.order[first : first + BLOCK]
                own_tiles, items_of = systems.of(todo)
                width, own_counts = max(1, columns // len(items_of)), counts[items_of]
                for at in range(0, len(todo), width):
                    own = np.searchsorted(items_of, todo[at : at + width])
                    out = []
                    for i, w in zip(own.tolist(), np.negative(solve(own_tiles, own_counts, own, lam).T, order="C")):
                        own_p, w[i] = -w[i], 0.0
                        near = np.flatnonzero(w > 0)
                        if len(near) > k:
                            low = np.partition(w[near] * lam, len(near) - k)[len(near) - k]  # k entries weigh at least this
                            near = near[w[near] * (lam + own_counts[near]) >= low * (1 - 1e-9) - 1e-9]
                        out.append((np.full(len(near) + 1, items_of[i]), items_of[np.append(near, i)], np.append(w[near], own_p)))
                    yield pd.DataFrame({name: np.concatenate(x) for name, x in zip("ijp", zip(*out))})

    blocks = spark.range(0, n, BLOCK, min(-(-n // BLOCK), 4 * spark.sparkContext.defaultParallelism + n // 4096))
    entries = stored(blocks.mapInPandas(run, "i long, j long, p double"), f"{folder}/entries")
    diagonal = entries.filter("i = j").select("j", F.col("p").alias("d"))
    edges = entries.filter("i <> j").join(diagonal, "j").select("i", "j", F.round(F.col("p") / F.col("d"), DIGITS).alias("score")).filter("score > 0")
    named = edges.join(items.select("i", "item_id"), "i").join(items.select(F.col("i").alias("j"), F.col("item_id").alias("related_id")), "j")
    return top(named.select("item_id", "related_id", "score"), "item_id", k, F.desc("score"), F.col("related_id"))
