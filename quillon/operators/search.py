"""Text search: a stored index with block maxima, keyword queries ranked by BM25, a dictionary for prefixes.

Documents are numbered by length and cut into buckets of neighbours; the index
has a row for each token and bucket, with the token's documents there and the
largest share that it adds to a score, apart from its rarity.  A query adds up
its words' largest shares in each bucket: no document of a bucket scores more.
It scores the most promising buckets first and then those that could still hold
a better document than the k-th found, and reads no others.

A file has the buckets of one task, so texts are shuffled, not their words, and
its rows are sorted by token, so a search opens the files' parts that have its
words; the dictionary is front-coded text, and a prefix is a range of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.history import numbered
from quillon.sources.paths import stored, work_dir

#: Documents of a bucket.
BUCKET = 512
#: Buckets of a task that writes the index, about.
TASK_BUCKETS = 3


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class SearchIndex:
    """A written index: postings by token and bucket, and the dictionary with document counts."""

    spark: SparkSession
    path: str
    key: str
    docs: int

    @property
    def postings(self) -> DataFrame:
        """token, bucket, most, entries (key, share), and how many documents there and occurrences (df, cf)."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def dictionary(self) -> DataFrame:
        """token, df, cf."""
        return self.spark.read.parquet(f"{self.path}/dictionary")

    def search(self, query: str, *, k: int = 20) -> DataFrame:
        """key, score of documents that have any of the query's words, best first (BM25)."""
        return self.search_buckets(query, k=k)[0]

    def search_buckets(self, query: str, *, k: int = 20) -> tuple[DataFrame, int]:
        """The same, and how many buckets were scored."""
        words = sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if t})
        df = {r["token"]: r["df"] for r in self.dictionary.filter(F.col("token").isin(words)).select("token", "df").collect()}  # the query's words
        none = self.spark.createDataFrame([], self.postings.select("entries").schema["entries"].dataType.elementType).select(self.key, F.lit(0.0).alias("score"))
        if not df:
            return none, 0
        pairs = [F.lit(x) for t, n in df.items() for x in (t, float(n))]
        rare = F.element_at(F.create_map(*pairs), F.col("token"))
        hits = self.postings.filter(F.col("token").isin(list(df))).withColumn("idf", F.ln(1 + (F.lit(float(self.docs)) - rare + 0.5) / (rare + 0.5)))
        bounds = hits.groupBy("bucket").agg(F.sum(F.col("idf") * F.col("most")).alias("most"), F.sum(F.size("entries")).alias("n"))

        def scored(buckets: DataFrame) -> DataFrame:
            rows = hits.join(buckets.select("bucket"), "bucket", "left_semi").select("idf", F.explode("entries").alias("e"))
            return rows.groupBy(F.col(f"e.{self.key}").alias(self.key)).agg(F.round(F.sum(F.col("idf") * F.col("e.share")), 9).alias("score"))

        head = bounds.orderBy(F.desc("most"), "bucket").limit(k)  # each holds a document at least
        first = [r["bucket"] for r in head.select("bucket").collect()]
        limit = scored(bounds.filter(F.col("bucket").isin(first))).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
        floor = limit[1] if limit[0] == k else 0.0
        wanted = bounds.filter((F.col("most") >= floor - 1e-8) | F.col("bucket").isin(first))
        return scored(wanted).orderBy(F.desc("score"), self.key).limit(k), wanted.count()


def write_index(docs: DataFrame, key: str, *columns: str, bucket: int = BUCKET, k1: float = 1.2, b: float = 0.75, path: str | None = None) -> SearchIndex:
    """Writes the index of the columns' text; a document without tokens is counted and never found."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "search")
    words = docs.select(key, F.concat(*[tokens(F.col(c)) for c in columns]).alias("_t")).select(key, F.array_join("_t", " ").alias("_t"), F.size("_t").cast("long").alias("dl"))
    words = stored(words, f"{path}/words")
    n = words.count()
    words = words.filter("dl > 0")
    lengths = words.groupBy(key).agg(F.sum("dl").alias("dl"))
    places = numbered(lengths, F.col("dl"), F.col(key), name="place", first=0).select(F.col(key).alias("_key"), "dl", F.floor(F.col("place") / bucket).alias("bucket"))
    total, last = places.agg(F.sum("dl"), F.max("bucket")).first()
    buckets = (last or 0) + 1
    tasks = min(buckets, max(spark.sparkContext.defaultParallelism, -(-buckets // TASK_BUCKETS)))
    # texts are dealt out by bucket: what follows needs no other shuffle
    dealt = words.select(key, "_t").join(places, F.col(key).eqNullSafe(F.col("_key"))).select("bucket", key, "dl", "_t").repartition(tasks, "bucket")
    rows = dealt.select("bucket", key, "dl", F.explode(F.split("_t", " ")).alias("token")).groupBy("bucket", "token", key).agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") * F.lit(float(n)) / F.lit(float(total or 1))))
    named = F.when(F.col(key).isNotNull(), F.struct(key, share.alias("share")))  # a document without a key is counted and never found
    grouped = rows.groupBy("token", "bucket").agg(F.coalesce(F.max(named["share"]), F.lit(0.0)).alias("most"), F.array_sort(F.collect_list(named)).alias("entries"), F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    grouped.sortWithinPartitions("token", "bucket").write.mode("overwrite").parquet(f"{path}/postings")
    write_dictionary(spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), f"{path}/dictionary", "token")
    return SearchIndex(spark, path, key, n)


def write_dictionary(rows: DataFrame, path: str, *order: str) -> None:
    """Rows sorted by their first column, a text that is stored as what it adds to the one before."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode("overwrite").option("parquet.writer.version", "v2").option(f"parquet.enable.dictionary#{order[0]}", "false").parquet(path)


def with_prefix(dictionary: DataFrame, column: str, prefix: str) -> DataFrame:
    """The range of a dictionary that begins with the prefix: a comparison that the files' statistics answer."""
    after = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None
    c = F.col(column)
    return dictionary.filter((c >= prefix) & (c < after)) if after else dictionary


def write_titles(items: DataFrame, key: str, title: str, path: str | None = None) -> str:
    """Writes a dictionary of title words: token, title, key."""
    path = path or work_dir(items.sparkSession, "titles")
    rows = items.select(F.explode(F.array_distinct(tokens(F.col(title)))).alias("token"), title, key)
    write_dictionary(rows, path, "token", title, key)
    return path


def suggest(spark: SparkSession, path: str, key: str, title: str, prefix: str, *, k: int = 10) -> DataFrame:
    """Items with a title word that begins with the prefix, from a dictionary of title words."""
    rows = with_prefix(spark.read.parquet(path), "token", prefix.strip().lower())
    return rows.select(key, title).distinct().orderBy(title, key).limit(k)
