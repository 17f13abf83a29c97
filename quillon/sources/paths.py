"""Where intermediate tables go, and where a dataset lies."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; under the temporary folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quillon-{os.getuid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it again, so that what follows does not depend on any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve_data_dir(spark: SparkSession, base: str, needed: tuple[str, ...] = ("lineitem.parquet", "orders.parquet")) -> str:
    """``base`` if it holds the needed files, else its first folder (by name) that does; any Hadoop file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    holds = lambda p: all(fs.exists(hadoop.Path(p, n)) for n in needed)
    if holds(root):
        return base
    for s in sorted((s.getPath() for s in fs.listStatus(root) if s.isDirectory()), key=lambda p: p.getName()):
        if holds(s):
            return f"{base.rstrip('/')}/{s.getName()}"
    raise FileNotFoundError(f"no dataset in {base}")
