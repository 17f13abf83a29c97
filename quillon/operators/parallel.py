"""Data-parallel training: the tasks of one barrier stage, each on its own rows, whose models are averaged.

All tasks start from the same parameters.  Several times an epoch each writes
what its rows changed to the shared folder, averages one slice of everybody's
changes and reads the other slices, so averaging costs a task as much however
many there are.  A dense parameter moves by the mean change, weighted by rows;
a row of an embedding table by the mean over the tasks that used it.

The barrier stage runs all tasks at once, and runs all again if one is lost;
tasks meet through files of the attempt's own folder, where a file counts once
it has its name.  A task holds its share of the rows, as arrays, and the model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.arrays import Rows, exists, load, read, remove, save
from quillon.sources.paths import stored, work_dir

#: Rows of a task at least, before another one is worth while.
TASK_ROWS = 10_000
#: Seconds that a task waits for another's file before the stage is given up, and run again.
PATIENCE = 600
#: Parameters that are exchanged at a time.
PIECE = 1 << 22

Params = dict[str, np.ndarray]
#: A gradient: dense, or (rows, values) of a table, rows in any order.
Gradient = np.ndarray | tuple[np.ndarray, np.ndarray]


class Peers:
    """The tasks of a stage, which meet in a folder."""

    def __init__(self, folder: str, rank: int, size: int):
        self.folder, self.rank, self.size, self.step = folder, rank, size, 0

    def _wait(self, name: str) -> np.ndarray:
        uri, until, pause = f"{self.folder}/{name}.npy", time.monotonic() + PATIENCE, 0.001
        while not exists(uri):
            if time.monotonic() > until:
                raise TimeoutError(f"{uri} did not come")
            time.sleep(pause)
            pause = min(0.05, pause * 1.2)
        return load(uri)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of everybody's arrays of one shape: each task sums a slice."""
        if self.size == 1:
            return values
        self.step += 1
        bounds = np.linspace(0, len(values), self.size + 1).astype(int)
        save(f"{self.folder}/{self.step}-{self.rank}.npy", values)
        a, b = bounds[self.rank], bounds[self.rank + 1]
        part = sum(np.asarray(self._wait(f"{self.step}-{r}")[a:b], float) for r in range(self.size)).astype(values.dtype)
        if self.step > 1:  # everybody has begun this step, so has read the last one's sums; nobody ends this step before the files are gone
            remove(f"{self.folder}/{self.step - 1}-{self.rank}.npy")
            remove(f"{self.folder}/{self.step - 1}-sum-{self.rank}.npy")
        save(f"{self.folder}/{self.step}-sum-{self.rank}.npy", part)
        out = np.concatenate([self._wait(f"{self.step}-sum-{r}") for r in range(self.size)])
        return out

    def combine(self, params: Params, before: Params, uses: Params, weight: float) -> None:
        """Moves ``before`` by the mean of everybody's changes and puts it in params.

        ``uses`` has, for each table, how often its rows were used here.  Models
        are exchanged piece by piece: files and copies of two pieces are there
        at once, however large the model.
        """
        if self.size == 1:
            return
        groups, size = [[]], 0
        for name, p in params.items():
            step = max(1, PIECE // max(1, p[:1].size))
            for a in range(0, len(p), step):
                if size and size + p[a : a + step].size > PIECE:
                    groups.append([])
                    size = 0
                groups[-1].append((name, a, min(len(p), a + step)))
                size += p[a : a + step].size
        for group in groups:
            parts, wide = [], lambda w, p: w.reshape(-1, *[1] * (p.ndim - 1))
            for name, a, b in group:
                w = uses[name][a:b].astype(np.float32) if name in uses else np.array([weight], np.float32)
                parts += [((params[name][a:b] - before[name][a:b]) * wide(w, params[name])).ravel().astype(np.float32), w]
            flat, at = self.total(np.concatenate(parts)), 0
            for name, a, b in group:
                p = params[name]
                n, m = p[a:b].size, b - a if name in uses else 1
                change, w = flat[at : at + n].reshape(p[a:b].shape), flat[at + n : at + n + m]
                at += n + m
                p[a:b] = before[name][a:b] + change / wide(np.maximum(w, 1e-30), p)


class Sgd:
    def __init__(self, params: Params, rate: float):
        self.p, self.rate = params, rate

    def step(self, grads: dict[str, Gradient]) -> None:
        for k, g in grads.items():
            if isinstance(g, tuple):
                np.add.at(self.p[k], g[0], -self.rate * g[1])
            else:
                self.p[k] -= self.rate * g


#: Rows of a dense parameter that Adam moves at a time.
ADAM_ROWS = 512


class Adam:
    """Adam with decoupled weight decay; of a table, only the rows that a batch uses are touched."""

    def __init__(self, params: Params, rate: float, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, Gradient]) -> None:
        self.t += 1
        for k, g in grads.items():
            if isinstance(g, tuple):
                rows, place = np.unique(g[0], return_inverse=True)
                self._move(k, rows, sums_by(place, g[1], len(rows)))
                continue
            for a in range(0, len(g), ADAM_ROWS):  # in pieces that stay in a core's cache
                self._move(k, slice(a, a + ADAM_ROWS), g[a : a + ADAM_ROWS])

    def _move(self, k: str, rows: np.ndarray | slice, g: np.ndarray) -> None:
        m = self.m[k][rows] * 0.9 + 0.1 * g
        v = self.v[k][rows] * 0.999 + 0.001 * g * g
        self.m[k][rows], self.v[k][rows] = m, v
        step = m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
        self.p[k][rows] -= self.rate * (step + self.decay * self.p[k][rows])


def sums_by(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by place, for places that all come up."""
    order = np.argsort(place, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(place[order], np.arange(n)), axis=0)


@dataclass
class Model:
    """What is trained: first parameters (the same in every task), arrays of rows, gradients; ``tables`` name parameters used by rows.

    ``gradient(params, data, rows, rng)`` gives the loss summed over the rows and gradients.
    """

    init: Callable[[], Params]
    encode: Callable[[pa.Table], dict[str, np.ndarray]]
    gradient: Callable[[Params, dict[str, np.ndarray], np.ndarray, np.random.Generator], tuple[float, dict[str, Gradient]]]
    optimizer: Callable[[Params], Sgd | Adam]
    tables: tuple[str, ...] = ()
    #: Summed loss of rows without training; with it, training ends when the held-out loss stops falling.
    loss: Callable[[Params, dict[str, np.ndarray], np.ndarray], float] | None = None
    #: Rows are encoded a batch at a time, and arrays put together: each has an entry for each row.
    by_batch: bool = False


@dataclass
class Trained:
    """The parameters, as arrays of the shared folder, and the mean loss of each epoch (held out, if there are held-out rows)."""

    folder: str
    names: tuple[str, ...]
    losses: list[float] = field(default_factory=list)

    def params(self) -> Params:
        return {n: load(f"{self.folder}/{n}.npy") for n in self.names}


def fit(model: Model, data: dict[str, np.ndarray], peers: Peers, *, epochs: int, batch: int, syncs: int, patience: int, seed: int) -> tuple[Params, list[float]]:
    """One task's part of the training; ``data['_held']`` marks held-out rows.

    The model before a part of an epoch, and the best one so far (of the first
    task), lie in files, so that memory has one model and its optimizer's state.
    """
    held = data.pop("_held")
    kind = np.int32 if len(held) < 1 << 31 else np.int64
    own, valid = np.flatnonzero(~held).astype(kind), np.flatnonzero(held).astype(kind)
    params = model.init()
    optimizer, losses, best, kept, bad = model.optimizer(params), [], np.inf, False, 0
    file = lambda what, k: f"{peers.folder}/{what}-{peers.rank}-{k}.npy"
    any_held = peers.total(np.array([float(len(valid))]))[0] > 0
    for epoch in range(epochs):
        rng = np.random.default_rng([seed, epoch, peers.rank])
        lost = 0.0
        for part in np.array_split(rng.permutation(own), syncs):
            before = {}
            if peers.size > 1:
                for k, p in params.items():
                    save(file("before", k), p)
                    before[k] = Rows(file("before", k))
            uses = {k: np.zeros(len(params[k])) for k in model.tables}
            for at in range(0, len(part), batch):
                loss, grads = model.gradient(params, data, part[at : at + batch], rng)
                lost += loss
                optimizer.step(grads)
                for k in uses:
                    if k in grads:
                        rows = grads[k][0].ravel()
                        uses[k] += np.bincount(rows, minlength=len(uses[k]))
            peers.combine(params, before, uses, float(len(part)))
        if any_held:
            lost, rows = sum(model.loss(params, data, valid[at : at + 4096]) for at in range(0, len(valid), 4096)), len(valid)
        else:
            rows = len(own)
        lost, rows = peers.total(np.array([lost, rows], float))
        losses.append(float(lost / max(1.0, rows)))
        if any_held:
            if losses[-1] < best - 1e-6:
                best, bad, kept = losses[-1], 0, True
                if peers.rank == 0:
                    for k, p in params.items():
                        save(file("best", k), p)
            else:
                bad += 1
                optimizer.rate /= 2
                if bad >= patience:
                    break
    for k in params:
        if peers.size > 1:
            remove(file("before", k))
        if kept and peers.rank == 0:  # the one that is asked for its model
            params[k][...] = read(file("best", k))
            remove(file("best", k))
    return params, losses


def train(rows: DataFrame, by: tuple[str, ...], model: Model, *, held: Column | None = None, epochs: int, batch: int, syncs: int = 2, patience: int = 3, seed: int = 42, tasks: int | None = None) -> Trained:
    """Trains on all rows, dealt to tasks by a hash of ``by`` and put in its order there, so that training can be repeated.

    ``held`` marks rows that are kept out to stop by.  There are as many tasks
    as three quarters of the slots that the cluster has (a lost executor leaves
    room to run again), fewer for few rows.  ``rows`` should be a stored table,
    as it is counted and then dealt.
    """
    spark = rows.sparkSession
    folder = work_dir(spark, "training")
    n = rows.count()
    rows = rows.withColumn("_held", F.lit(False) if held is None else held)
    if not n:
        raise ValueError("no rows to train on")
    slots = spark.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(slots - slots // 4, n // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        attempt = min(map(int, context.allGather(str(context.taskAttemptId()))))
        peers = Peers(f"{folder}/attempt-{attempt}", context.partitionId(), tasks)
        encode = lambda table: model.encode(table) | {"_held": table["_held"].to_numpy()}
        none = arrow.empty_table()  # a task without rows takes part too
        if model.by_batch:
            pieces = {k: [x] for k, x in encode(none).items()}
            for piece in batches:
                for k, x in encode(pa.Table.from_batches([piece], schema=arrow)).items():
                    pieces[k].append(x)
            data = {k: np.concatenate(pieces.pop(k)) for k in list(pieces)}
        else:
            data = encode(pa.Table.from_batches(list(batches), schema=arrow))
        params, losses = fit(model, data, peers, epochs=epochs, batch=batch, syncs=syncs, patience=patience, seed=seed)
        if peers.rank == 0:
            for name, p in params.items():
                save(f"{folder}/{name}.npy", np.asarray(p))
        yield pa.RecordBatch.from_pydict({"rank": pa.array([peers.rank], pa.int32()), "losses": pa.array([losses], pa.list_(pa.float64())), "names": pa.array([list(params)], pa.list_(pa.string()))})

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.schema)
    trained = rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "rank int, losses array<double>, names array<string>", barrier=True)
    done = stored(trained.repartition(1), f"{folder}/done")  # a barrier stage can only be run again if it ends in a shuffle
    first = done.filter("rank = 0").first()
    return Trained(folder, tuple(first["names"]), list(first["losses"]))


# ---- ids ------------------------------------------------------------------------


@dataclass
class Ids:
    """Different ids in order, and numbers that belong to them, as arrays of ranges in the shared folder: (range, length) in order."""

    folder: str
    ranges: list[tuple[int, int]]

    def __len__(self) -> int:
        return sum(n for _, n in self.ranges)

    def all(self, column: str = "id") -> np.ndarray:
        return np.concatenate([load(f"{self.folder}/{column}-{r}.npy") for r, _ in self.ranges]) if self.ranges else np.zeros(0, np.int64)


def sorted_ids(rows: DataFrame) -> Ids:
    """Writes rows (id, a whole number that is there once, and more numbers), a range of ids in each task."""
    spark = rows.sparkSession
    folder = work_dir(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, "id").withColumn("_p", F.spark_partition_id()), f"{folder}/ranges")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part = pdf.sort_values("id"), int(pdf["_p"].iloc[0])
        for c in rows_columns:
            save(f"{folder}/{c}-{part}.npy", pdf[c].to_numpy())
        return pd.DataFrame({"_p": [part], "n": [len(pdf)]})

    rows_columns = rows.columns
    done = stored(ranged.groupBy("_p").applyInPandas(write, "_p int, n long"), f"{folder}/done")
    return Ids(folder, sorted((r["_p"], r["n"]) for r in done.collect()))


def rows_of(spark: SparkSession, ids: Ids, trained: Trained, name: str, unit: bool = False) -> DataFrame:
    """id, vec: a table of parameters as rows (at length 1, if ``unit``), a range of ids in each task."""
    starts = np.cumsum([0, *(n for _, n in ids.ranges)]).tolist()

    def run(batches):
        table = load(f"{trained.folder}/{name}.npy")
        for pdf in batches:
            for r, first in zip(pdf["r"], pdf["first"]):
                own = load(f"{ids.folder}/id-{r}.npy")
                for at in range(0, len(own), 8192):
                    part = own[at : at + 8192]
                    m = np.asarray(table[first + at : first + at + len(part)], float)
                    if unit:
                        size = np.linalg.norm(m, axis=1, keepdims=True)
                        m = m / np.where(size > 0, size, 1.0)
                    yield pd.DataFrame({"id": part, "vec": m.tolist()})

    parts = spark.createDataFrame([(r, a) for (r, _), a in zip(ids.ranges, starts)], "r int, first long").repartition(max(1, len(ids.ranges)))
    return parts.mapInPandas(run, "id long, vec array<double>")
