"""NumPy arrays as tables: C-ordered float64 matrices and int64 vectors, format versions 1 to 3.

Only a file's header is read when a plan is made; tasks read ranges of its rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.arrays import local_path, save
from quillon.sources.paths import stored

#: Rows of a task's range.
RANGE = 1 << 16


@contextmanager
def opened(uri: str) -> Iterator:
    """A file at a path or URI, for reading in pieces."""
    if (path := local_path(uri)) is not None:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        yield f


def header(uri: str) -> tuple[str, tuple[int, ...], int]:
    """Type, shape and where the numbers begin; other orders and types are refused."""
    with opened(uri) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2, 3):
            raise ValueError("not a .npy file of version 1 to 3")
        width = 2 if start[6] == 1 else 4
        size = int.from_bytes(start[8 : 8 + width], "little")
        f.seek(8 + width)
        head = ast.literal_eval(f.read(size).decode("utf-8" if start[6] == 3 else "latin-1"))
    if head["fortran_order"] or head["descr"] not in ("<f8", "<i8"):
        raise ValueError("only C-ordered <f8 and <i8 arrays")
    return head["descr"], tuple(head["shape"]), 8 + width + size


def _rows(uri: str, first: int, n: int) -> np.ndarray:
    kind, shape, start = header(uri)
    row = 8 * int(np.prod(shape[1:], dtype=np.int64))
    with opened(uri) as f:
        f.seek(start + first * row)
        return np.frombuffer(f.read(n * row), kind).reshape(n, *shape[1:])


def read_vectors(spark: SparkSession, matrix: str, ids: str, rows: int = RANGE) -> DataFrame:
    """item_id, vec from a matrix file and an id file of the same length."""
    return read_pairs(spark.createDataFrame([(matrix, ids)], "matrix string, ids string"), rows)


def read_pairs(pairs: DataFrame, rows: int = RANGE) -> DataFrame:
    """item_id, vec from rows (matrix, ids) that name files; files are cut into ranges of rows.

    Headers are looked at when the plan is made, so a wrong pair is refused then.
    """
    ranges = []
    for r in pairs.collect():  # a row for each file
        (kind, shape, _), (id_kind, id_shape, _) = header(r["matrix"]), header(r["ids"])
        if len(shape) != 2 or kind != "<f8" or id_kind != "<i8" or id_shape != shape[:1]:
            raise ValueError("a matrix and as many ids are needed")
        ranges += [(r["matrix"], r["ids"], at, min(rows, shape[0] - at)) for at in range(0, shape[0], rows)]

    def read(batches):
        for pdf in batches:
            for matrix, ids, first, n in pdf.itertuples(index=False):
                yield pd.DataFrame({"item_id": _rows(ids, first, n), "vec": list(_rows(matrix, first, n))})

    listed = pairs.sparkSession.createDataFrame(ranges, "matrix string, ids string, first long, n long").repartition(max(1, len(ranges)))
    return listed.mapInPandas(read, "item_id long, vec array<double>")


def write_vectors(vectors: DataFrame, folder: str) -> DataFrame:
    """Writes (item_id, vec), vectors of one length, as a matrix and an id file for each task; rows matrix, ids."""

    def write(batches):
        part, ids, rows = TaskContext.get().partitionId(), [], []
        for batch in batches:
            ids.append(batch["item_id"].to_numpy())
            rows.append(batch["vec"].flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0)))
        rows = [r for r in rows if len(r)]
        if rows:
            names = f"{folder}/{part}-matrix.npy", f"{folder}/{part}-ids.npy"
            save(names[0], np.concatenate(rows).astype("<f8"))
            save(names[1], np.concatenate(ids).astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in names], ["matrix", "ids"])

    ready = vectors.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"))
    return stored(ready.mapInArrow(write, "matrix string, ids string"), f"{folder}/files")
