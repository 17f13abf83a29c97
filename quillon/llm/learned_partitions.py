"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is linked to a neighbour graph, the graph is
cut into balanced parts with few links between them, and a small classifier (one
hidden layer) learns which parts the neighbours of a vector lie in.  It then
gives every vector of the table its most probable part; a query is routed to
the several most probable parts, whose vectors are all compared with it exactly.
How many parts that is, is measured: the neighbours that some of the queries
have among all vectors are found by brute force, and as few parts are visited as
hold the wanted share of them.

Scale: every step but the fitting on the sample is a Spark job.  Equal vectors
are indexed once, with the ids that could be among k neighbours, so copies of
one vector are no group; parts are dealt out in blocks of bounded size, and so
are the queries of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import shared_dir, stored

#: Vectors of a part, most parts, and sampled vectors for each part: at most 65,536 vectors are sampled.
PART_ROWS, MAX_PARTS, SAMPLED = 1024, 1024, 64
#: The sample of fewer parts is this large if there are as many vectors.
LEAST_SAMPLE = 16_384
#: Queries whose neighbours are found by brute force to set the number of parts, and the share of neighbours wanted.
MEASURED, TARGET = 256, 0.95
#: Rows of a block of vectors and of queries.
BLOCK, QUERY_BLOCK = 2048, 512
#: Links of a sampled vector, and neurons between vector and parts.
LINKS, HIDDEN = 10, 128


# ---- fitting on the sample --------------------------------------------------------


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances) of the k rows nearest to each query, of equal distances the smaller ids.

    Products of matrices choose the candidates, with room for their rounding; their distances are then summed directly.
    """
    square = (rows * rows).sum(1)
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        own = (part * part).sum(1)
        about = square[None, :] - 2 * part @ rows.T
        if len(rows) > k:
            limit = np.partition(about, k - 1, axis=1)[:, k - 1] + 1e-9 * (own + square.max())
        else:
            limit = np.full(len(part), np.inf)
        for i, q in enumerate(part):
            may = np.flatnonzero(about[i] <= limit[i])
            distance = np.sqrt(((rows[may] - q) ** 2).sum(1))
            first = np.lexsort((ids[may], distance))[:k]
            yield at + i, may[first], distance[first]


def halve(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A side (False or True) for each row, half of them each, with few links (a, b) between the sides.

    Begins at the median of the main direction; then pairs that gain most by
    changing places do so, half of the gaining ones at a time.
    """
    n = len(x)
    centred, v = x - x.mean(0), np.ones(x.shape[1])
    for _ in range(20):
        v = centred.T @ (centred @ v)
        size = np.linalg.norm(v)
        if size == 0:
            break
        v /= size
    side = np.zeros(n, bool)
    side[np.argsort(centred @ v, kind="stable")[n // 2 :]] = True
    best, kept = len(a) + 1, side
    for _ in range(rounds):
        out = side[a] != side[b]
        cut = int(out.sum())
        if cut >= best:
            break
        best, kept = cut, side.copy()
        gain = np.bincount(a, np.where(out, 1, -1), n) + np.bincount(b, np.where(out, 1, -1), n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        gaining = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not gaining:
            break
        move = -(-gaining // 2)
        side[left[:move]], side[right[:move]] = True, False
    return kept


def balanced_parts(x: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """A part (below ``parts``, a power of two) for each row: equal numbers, few links (a, b) between parts."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        finer = np.empty_like(label)
        for p in range(int(label.max()) + 1):
            rows = np.flatnonzero(label == p)
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            inner = (place[a] >= 0) & (place[b] >= 0)
            finer[rows] = 2 * p + halve(x[rows], place[a[inner]], place[b[inner]])
        label = finer
    return label


@dataclass
class Router:
    """The classifier: probabilities of the parts of vectors."""

    mean: np.ndarray
    scale: float
    layers: dict[str, np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.maximum((x - self.mean) * self.scale @ p["w0"] + p["b0"], 0) @ p["w1"] + p["b1"]

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, *, epochs: int = 12, batch: int = 128, rate: float = 0.003, seed: int = 42) -> Router:
        """Cross-entropy with the share of each row's neighbours in each part (rows of ``target`` sum to 1), Adam with a falling rate."""
        rng, n, d, parts = np.random.default_rng(seed), len(x), x.shape[1], target.shape[1]
        spread = float(x.std())
        p = {"w0": rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), "b0": np.zeros(HIDDEN), "w1": rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), "b1": np.zeros(parts)}
        self = cls(x.mean(0), 1 / spread if spread > 0 else 1.0, p)
        x = (x - self.mean) * self.scale
        m, v, t, steps = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0, epochs * -(-n // batch)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                rows, t = order[at : at + batch], t + 1
                hidden = np.maximum(x[rows] @ p["w0"] + p["b0"], 0)
                z = hidden @ p["w1"] + p["b1"]
                e = np.exp(z - z.max(1, keepdims=True))
                dz = (e / e.sum(1, keepdims=True) - target[rows]) / len(rows)
                dh = (dz @ p["w1"].T) * (hidden > 0)
                for k, g in (("w1", hidden.T @ dz), ("b1", dz.sum(0)), ("w0", x[rows].T @ dh), ("b0", dh.sum(0))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones followed by zeros."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _sampled(vectors: DataFrame, most: int, dim: int) -> np.ndarray:
    """The vectors of the ``most`` ids that come first in the order of their hash."""
    rows = vectors.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(most).toArrow()
    return _matrix(rows["vec"].combine_chunks(), dim) if rows.num_rows else np.zeros((0, dim))


def fit_router(vectors: DataFrame, n: int, dim: int, parts: int) -> Router:
    """Neighbour graph of the sample (its rows dealt to tasks), balanced parts, classifier."""
    spark = vectors.sparkSession
    x = _sampled(vectors, min(n, max(LEAST_SAMPLE, SAMPLED * parts)), dim)
    shared = spark.sparkContext.broadcast(x)  # at most 65,536 vectors

    def link(batches):
        x = shared.value
        for batch in batches:
            for first in batch["id"].to_pylist():
                rows = x[first : first + 512]
                a, b = [], []
                for i, near, _ in nearest(rows, x, np.arange(len(x)), LINKS + 1):
                    near = near[near != first + i][:LINKS]
                    a.append(np.full(len(near), first + i))
                    b.append(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    tasks = -(-len(x) // 512)
    links = spark.range(0, len(x), 512, tasks).mapInArrow(link, "a long, b long").toArrow()  # LINKS for each sampled vector
    a, b = (links[c].to_numpy() for c in "ab")
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    label = balanced_parts(x, a, b, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (a, label[b]), 1.0)
    target[np.arange(len(x)), label] += 1.0
    shared.unpersist()
    return Router.fit(x, target / target.sum(1, keepdims=True))


# ---- index and search -----------------------------------------------------------


def usable(vec: str) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    x = F.col(vec)
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """node, ids, vec: each different vector of (id, vec) with its k smallest ids, node the smallest.

    No task gets more than k ids of a vector from another, however many copies
    it has.  Nodes are alike only where an id has several vectors.
    """
    few = rows.withColumn("_r", F.dense_rank().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("_r") <= k)
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "ids", "vec")


def _routed(rows: DataFrame, router: Router | None, dim: int, probes: int) -> DataFrame:
    """Rows with ``parts``, their most probable parts, best first."""
    if router is None:
        return rows.withColumn("parts", F.array(F.lit(0)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.argsort(-router.logits(_matrix(batch["vec"], dim)), axis=1, kind="stable")[:, :probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, first.size + 1, first.shape[1], dtype=np.int32)), pa.array(first.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, parts array<int>")


def brute_force(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """q, node, score: the k nearest of all vectors for a few queries (q, vec), which go to every task."""
    rows = queries.select("q", "vec").toArrow()
    ids, x = rows["q"].to_numpy(), _matrix(rows["vec"].combine_chunks(), dim) if rows.num_rows else np.zeros((0, dim))

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(ids):
                node = batch["node"].to_numpy()
                out = [(np.full(len(near), ids[i]), node[near], score) for i, near, score in nearest(x, _matrix(batch["vec"], dim), node, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["q", "node", "score"])

    found = vectors.select("node", "vec").mapInArrow(run, "q long, node long, score double")
    return found.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("score", "node"))).filter(F.col("_r") <= k).drop("_r")


def probes_needed(queries: DataFrame, index: DataFrame, router: Router, dim: int, k: int, target: float) -> tuple[int, float]:
    """How many parts of its order a query has to visit, and the share of neighbours that the measured queries then find."""
    parts = router.layers["b1"].size
    some = queries.orderBy(F.xxhash64("q"), "q").limit(MEASURED)
    true = brute_force(some, index, k, dim).join(index.select("node", "part"), "node")
    ranked = _routed(some, router, dim, parts).select("q", F.posexplode("parts").alias("place", "part"))
    at = np.array([r["place"] for r in true.join(ranked, ["q", "part"]).select("place").collect()], np.int64)  # k rows for each of MEASURED queries
    found = np.cumsum(np.bincount(at, minlength=parts)) / max(1, len(at))
    m = int(np.searchsorted(found, min(target, 1.0) - 1e-12)) + 1
    return min(m, parts), float(found[min(m, parts) - 1])


@dataclass
class Index:
    """Every different vector with its part (node, ids, vec, part), and how to find its neighbours."""

    rows: DataFrame
    router: Router | None
    dim: int
    probes: int = 1
    recall: float = 1.0


def build_index(rows: DataFrame, folder: str, k: int, *, part_rows: int = PART_ROWS) -> Index:
    """Indexes all of (id, vec)."""
    vectors = stored(distinct_vectors(rows, k), f"{folder}/vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    n, dim = size["n"], size["dim"]
    parts = min(MAX_PARTS, 1 << max(0, (n // part_rows).bit_length() - 1)) if n >= 2 * part_rows else 1
    router = fit_router(vectors, n, dim, parts) if parts > 1 else None
    routed = _routed(vectors, router, dim, 1).select("node", "ids", "vec", F.get("parts", F.lit(0)).alias("part"))
    return Index(stored(routed, f"{folder}/index"), router, dim)


def search_index(index: Index, queries: DataFrame, folder: str, k: int) -> DataFrame:
    """q, id, score: the k nearest rows that the visited parts hold for queries (q, vec), each a different vector."""
    routed = _routed(queries, index.router, index.dim, index.probes).select("q", "vec", F.explode("parts").alias("part"))
    routed = stored(routed, f"{folder}/routed")

    def blocks(rows: DataFrame, size: int, key: str, *more: str) -> DataFrame:
        """part and a list of rows: each part in as many blocks as its size needs."""
        n = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).select("part", F.ceil(F.col("_n") / size).alias("_blocks"))
        at = rows.join(F.broadcast(n), "part").withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))  # at most MAX_PARTS rows
        return at.groupBy("part", "_block").agg(F.collect_list(F.struct(key, "vec", *more)).alias("rows")).select("part", "rows")

    q, v = blocks(routed, QUERY_BLOCK, "q"), blocks(index.rows, BLOCK, "node", "ids")
    pairs = q.withColumnRenamed("rows", "qs").join(v.withColumnRenamed("rows", "vs"), "part").select("qs", "vs")
    dim = index.dim

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qs, vs = batch["qs"].slice(i, 1).flatten(), batch["vs"].slice(i, 1).flatten()
                number, ids = qs.field("q").to_numpy(), vs.field("ids")
                out = [(np.full(len(near), number[j]), near, score) for j, near, score in nearest(_matrix(qs.field("vec"), dim), _matrix(vs.field("vec"), dim), vs.field("node").to_numpy(), k)]
                if out:
                    q_of, near, score = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(q_of), ids.take(pa.array(near)), pa.array(score)], ["q", "ids", "score"])

    near = pairs.mapInArrow(run, "q long, ids array<long>, score double")
    of_query = W.partitionBy("q")
    near = near.withColumn("_r", F.row_number().over(of_query.orderBy("score", F.get("ids", F.lit(0))))).filter(F.col("_r") <= k)
    rows = near.select("q", "score", F.explode("ids").alias("id"))
    return rows.withColumn("_r", F.row_number().over(of_query.orderBy("score", "id"))).filter(F.col("_r") <= k).drop("_r")


def nearest_neighbours(vectors: DataFrame, *, k: int = 10, every: int = 100, key: str = "vec_id", vec: str = "embedding", target: float = TARGET, part_rows: int = PART_ROWS) -> tuple[DataFrame, Index]:
    """query_id, rank, vec_id, score: the k rows found nearest to each row whose key is divisible by ``every``, and the index.

    Nearness is the Euclidean distance in double precision, ties go to the
    smaller key.  Rows whose vector is null, all zero or empty, or holds a null
    or non-finite component take no part, nor do rows without a key; shorter
    vectors are compared as though zeros followed.  A row that repeats another's
    key and vector counts once, and no row is a neighbour of its own key.
    Other columns are not looked at; an empty table has no neighbours, and fewer
    rows than k are all found.  ``Index.recall`` is the share of the true
    neighbours of the measured queries that the visited parts hold.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "partitions")
    rows = vectors.filter(F.col(key).isNotNull() & usable(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    index = build_index(rows, folder, k + 1, part_rows=part_rows)
    # queries of equal vectors are searched once
    asked = stored(rows.filter(F.col("id") % every == 0).distinct(), f"{folder}/asked")
    numbered = stored(asked.select("vec").distinct().select(F.monotonically_increasing_id().alias("q"), "vec"), f"{folder}/queries")
    if index.router is not None:
        index.probes, index.recall = probes_needed(numbered, index.rows, index.router, index.dim, k + 1, target)
    found = search_index(index, numbered, folder, k + 1)
    own = asked.join(numbered, "vec").select(F.col("id").alias("query_id"), "q")
    near = own.join(found, "q").filter("id <> query_id")
    near = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))  # an id with several vectors: its nearest
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score"), index
