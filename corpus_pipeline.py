"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, ngram_jaccard, packing, quality
from quillon.llm.queries import tokenizer_path
from quillon.llm.shared import shared_dir, stored


def _apart(docs: DataFrame, step: Callable[..., DataFrame]) -> DataFrame:
    """Applies a step to documents whose columns have names that no operator uses, and gives them theirs again."""
    names = {c: f"documents_{i}" for i, c in enumerate(docs.columns)}
    out = step(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), text=names["text"], key=names["doc_id"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go (fewer than 50 words).  Repeated rows are
    judged alike, each alone; null keys are no matter.  Columns come back as
    they are, whatever their names.  An empty table stays empty.
    """
    return _apart(docs, lambda d, text, key: quality.quality_rules(d, text=text).filter("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in one of them, the one with the largest id; n_chars, if there, follows the text.

    A null text becomes an empty one.  A null key is the least; rows that
    repeat the largest key all keep the line.  No row goes.  Other columns come
    back as they are, whatever their names.  An empty table stays empty.
    """
    out = _apart(docs, lambda d, text, key: line_dedup.dedup_lines(d, text=text, key=key))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Null and empty texts are copies of each other.  Rows that repeat the key
    that stays all stay, and so do rows without a key, which is the least.
    Columns come back as they are.  An empty table stays empty.
    """
    return _apart(docs, lambda d, text, key: ngram_jaccard.drop_near_duplicates(d, text=text, key=key))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, each row judged by its own text.

    A null or empty text has no passage and stays.  Keys may be null or repeat.
    Columns come back as they are.  An empty table, or benchmark, takes nothing
    away.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences for training.

    A null or empty text is its end mark.  Each row is a document, also if its
    key is null or repeats; other columns than key and text are not looked at.
    An empty table has no pieces.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Quality shares, tokenizer ids and the order along the curve are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{i}")
    return docs
