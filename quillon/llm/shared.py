"""The folder that driver and executors share, and array files in it.

The folder is the one that the session names in ``spark.checkpoint.dir``; only
where that is unset, in a local session as in tests, a temporary one is used.
Files are written under another name and then renamed, and their content
depends only on a task's input, so a task that is run again after the loss of
an executor leaves the same file.  Arrays are memory-mapped, on another scheme
than a local one (any that pyarrow can open) from a copy.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (a URI or path) for one run of an operator."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + str(Path(tempfile.gettempdir(), f"quillon-{os.getuid()}"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts the lineage without tying results to an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow batches of text, in JVM and worker, end beyond so many bytes; Spark's own limit is sixteen times that.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES in a session that has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


#: Keys that without_keys() broadcasts at most: about 40 MB.
MAX_BROADCAST_KEYS = 1_000_000


def without_keys(rows: DataFrame, keys: DataFrame, key: str, path: str, most: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """The rows whose key is not among ``keys`` (nulls are equal): a broadcast up to ``most`` keys, a shuffled join beyond."""
    gone = stored(keys.select(keys[key].alias("_gone")).distinct(), path)
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return rows.join(gone, rows[key].eqNullSafe(gone["_gone"]), "left_anti")


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme == "file" else uri if not u.scheme else None


def save(uri: str, array: np.ndarray) -> None:
    """Writes one array as .npy."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex[:8]}.part"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as f:
        np.save(f, array)
    store.move(part, path)


def load(uri: str) -> np.ndarray:
    """Opens an array that save() wrote, memory-mapped.

    From a store that is not a local file system the file is copied to the
    worker's own disk first and mapped there, without a name that could stay
    behind: memory holds only what is being read, whatever the size.
    """
    if (path := _local(uri)) is not None:
        a = np.load(path, mmap_mode="r") if os.path.getsize(path) > 4096 else np.load(path)
        return a.view(np.ndarray)
    import shutil

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    fd, name = tempfile.mkstemp(suffix=".npy")
    try:
        with os.fdopen(fd, "wb") as out, store.open_input_stream(path) as f:
            shutil.copyfileobj(f, out, 1 << 20)
        a = np.load(name, mmap_mode="r") if os.path.getsize(name) > 4096 else np.load(name)
        return a.view(np.ndarray)
    finally:
        os.unlink(name)


def exists(uri: str) -> bool:
    if (path := _local(uri)) is not None:
        return os.path.exists(path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == fs.FileType.File


def remove(uri: str) -> None:
    """Removes one array; it may be gone already."""
    if (path := _local(uri)) is not None:
        Path(path).unlink(missing_ok=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)
