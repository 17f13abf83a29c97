"""Removal of benchmark passages from training texts, with DataFrame functions only.

The benchmark's windows of ``window`` normalised words become a hash table
that is broadcast; the documents' windows are hashed in the scan and probe it
in the same generated code, so no window of a document is ever shuffled.  A
hit counts only if the words themselves agree.  What is broadcast grows with
the benchmark alone, and its size is checked: beyond ``max_broadcast`` windows
the same join runs as a shuffled one.

A third of all documents may hold one passage: hits are then rows of their
documents, spread by document, never by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import MAX_BROADCAST_KEYS, shared_dir, stored

#: A window is broadcast as about 150 bytes: a million take 150 MB at most.
MAX_BROADCAST = 1_000_000
WINDOW = 10
#: Everything that is not a word: ASCII other than 0-9, A-Z (lower-cased first) and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, split at every other ASCII character that is no digit or letter.

    An ASCII text is lower-cased by the function for that; in others, whose
    other letters stay as they are, one pass maps A-Z and what separates words.
    """
    body = F.coalesce(text, F.lit(""))
    plain = F.octet_length(body) == F.length(body)
    mapped = F.translate(body, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.when(plain, F.split(F.lower(body), NOT_WORD)).otherwise(F.split(mapped, " ")), "")


def item_windows(benchmark: DataFrame, *, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The windows of the items: key, length in words, text of the window; an item of fewer words is one window."""
    w = benchmark.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    at = F.sequence(F.lit(1), F.size("w") - length + 1)
    return w.select("item", length.alias("len"), F.explode(F.transform(at, lambda i: F.array_join(F.slice(F.col("w"), i, length), " "))).alias("win")).distinct()


def _rows_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_row, _key, _text_hash, w (words), n_words."""
    body = F.col(text).cast("string")
    words = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.xxhash64(body).alias("_text_hash"), words_of(body).alias("w"))
    return words.withColumn("n_words", F.size("w").cast("long"))


def _probes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each word and length of window: at (from 1), len, h (-1 where the text ends before), and one of hash 0 for the text itself.

    No lambda stands here, so splitting, this step and the join after it are
    one piece of generated code, which reads the words where they are: nothing
    of a text is copied for its windows.
    """
    each = rows.select("*", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("_i", "_first"))
    if len(lengths) == 1:
        each = each.withColumn("len", F.lit(lengths[0]))
    else:
        each = each.withColumn("len", F.explode(F.array(*map(F.lit, lengths or [1]))))
    h = F.when(F.col("_i") == F.size("w"), F.lit(0).cast("long")).otherwise(F.lit(-1).cast("long"))  # never null: no filter on it is put before the join
    for n in lengths:
        fits = (F.col("len") == n) & (F.col("_i") + n <= F.size("w"))
        h = F.when(fits, F.xxhash64("_first", *[F.get(F.col("w"), F.col("_i") + k) for k in range(1, n)])).otherwise(h)
    return each.withColumn("h", h).withColumn("at", F.col("_i") + 1)


def _same(a: Column, b: Column) -> Column:
    """Whether two strings are equal, in a form that is no join key: strings are made for rows with equal hashes only."""
    return a.startswith(b) & b.startswith(a)


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item_text: str, item_key: str, window: int, max_broadcast: int) -> DataFrame:
    """_row, _key, _text_hash, n_words, spans, items of each row."""
    wins = item_windows(benchmark, text=item_text, key=item_key, window=window)
    table = wins.groupBy("len", "win").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    table = table.select(F.col("len").alias("_len"), "win", "items", _key_of(F.split("win", " "), window).alias("_h"))
    sizes = {r["_len"]: r["count"] for r in table.groupBy("_len").count().collect()}  # at most `window` rows
    rows = _rows_of(docs, text, key)
    probes = _probes(rows, sorted(sizes))
    window_of = lambda: F.array_join(F.slice("w", F.col("at"), F.col("len")), " ")
    names = ["_row", "_key", "_text_hash", "n_words"]
    if sum(sizes.values()) <= max_broadcast:
        text_itself = table.sparkSession.range(1).select(F.lit(0).alias("_len"), F.lit(None).cast("string").alias("win"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("_h"))
        right = F.when(F.col("win").isNull(), F.col("_i") == F.size("w")).otherwise((F.col("_i") < F.size("w")) & _same(window_of(), F.col("win")))
        found = probes.join(F.broadcast(table.unionByName(text_itself)), (F.col("h") == F.col("_h")) & right)
        hit = F.when(F.col("win").isNotNull(), F.struct(F.col("at"), (F.col("at") + F.col("len") - 1).alias("end")))
        found = found.select(*names, hit.alias("hit"), "items")
        return found.groupBy("_row").agg(
            F.first("_key").alias("_key"), F.first("_text_hash").alias("_text_hash"), F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("hit")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    # windows travel as hashes; those found go back to their texts, where the words are compared
    found = probes.filter(F.col("_i") + F.col("len") <= F.size("w")).select("_key", "_text_hash", "at", "len", "h").join(table, F.col("h") == F.col("_h"))
    found = found.groupBy("_key", "_text_hash").agg(F.collect_set(F.struct("at", "len", "win", "items")).alias("found"))
    back = rows.select("_row", F.col("_key").alias("_k"), F.col("_text_hash").alias("_t"), "w", "n_words")
    back = back.join(found, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_text_hash")), "left")
    none = F.expr("cast(array() as array<struct<at:int,len:int,win:string,items:array<string>>>)")
    real = F.filter(F.coalesce("found", none), lambda x: F.array_join(F.slice(F.col("w"), x["at"], x["len"]), " ") == x["win"])
    back = back.select("_row", F.col("_k").alias("_key"), F.col("_t").alias("_text_hash"), "n_words", real.alias("found"))
    spans = F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(x["at"].alias("at"), (x["at"] + x["len"] - 1).alias("end")))))
    return back.select(*names, spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"])))).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """For each row of ``docs``: key, n_words, spans (sorted array of at, end: word numbers from 1, inclusive), items.

    Spans are the occurring windows, not merged; ``items`` are the keys, as
    strings in order, of the items with occurring windows.

    Defined cases: a null or empty text, or one without a word, has no words
    and no hits; a null or empty item has no windows; an item of fewer than
    ``window`` words is one window.  Each row is judged alone, so repeated rows
    come back as often.  Items with equal texts are all named; a null item key
    is left out of ``items``.  Other columns of either table are not looked at.
    An empty benchmark hits nothing, an empty table gives an empty table.
    """
    found = _hits(docs, benchmark, text, key, item_text, item_key, window, max_broadcast)
    return found.select(F.col("_key").alias(key), "n_words", "spans", "items")


def _key_of(words: Column, window: int) -> Column:
    """The hash that _probes gives these words, of whatever length up to ``window``."""
    out = F.lit(None).cast("long")
    for n in range(1, window + 1):
        out = F.when(F.size(words) == n, F.xxhash64(*[F.get(words, F.lit(k)) for k in range(n)])).otherwise(out)
    return out


def n_covered(spans: Column) -> Column:
    """How many words the sorted spans cover."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["at"] - 1))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents without benchmark passages: ``remove`` whole "documents" or the "spans" of hit words.

    With "spans" the hit words and what stands between them become one space.

    Defined cases: each row is judged by its own text, whether its key is null,
    repeats, or neither; the columns of ``docs`` come back as they are, whatever
    their names.  A null text stays.  An empty table, or benchmark, takes
    nothing away.  See find_hits for words and windows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    spark, names = docs.sparkSession, docs.columns
    hits = _hits(docs, benchmark, text, key, item_text, item_key, window, max_broadcast).filter(F.size("spans") > 0)
    hits = hits.select("_key", "_text_hash", "spans").groupBy("_key", "_text_hash").agg(F.first("spans").alias("_q_spans"))
    hits = stored(hits.select(F.struct("_key", "_text_hash").alias("_q_id"), "_q_spans"), shared_dir(spark, "contaminated"))
    side = hits if remove == "spans" else hits.select("_q_id")
    if hits.count() <= (MAX_BROADCAST_KEYS if remove == "documents" else MAX_BROADCAST_KEYS // 10):  # a row of spans may be ten times as wide as a key
        side = F.broadcast(side)
    rows = docs.select(*[F.col(c).alias(f"_c_{i}") for i, c in enumerate(names)])
    body, id_ = F.col(f"_c_{names.index(text)}"), F.struct(F.col(f"_c_{names.index(key)}").alias("_key"), F.xxhash64(F.col(f"_c_{names.index(text)}").cast("string")).alias("_text_hash"))
    back = [F.col(f"_c_{i}").alias(c) for i, c in enumerate(names)]
    if remove == "documents":
        return rows.join(side, id_ == F.col("_q_id"), "left_anti").select(*back)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    full = F.coalesce(body.cast("string"), F.lit(""))
    found = rows.join(side, id_ == F.col("_q_id"), "left").withColumn("_q_words", F.when(F.col("_q_spans").isNotNull(), F.regexp_extract_all(full, F.lit(word), F.lit(0)))).withColumn("_q_seps", F.when(F.col("_q_spans").isNotNull(), F.split(full, word)))
    # places that begin and end the merged runs of hit words, so that each word is looked at once
    zero = F.expr("cast(array() as array<struct<at:int,end:int>>)")
    last = lambda a: F.element_at(a, -1)
    join = lambda a, s: F.when((F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(-1)) >= s["at"] - 1), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["at"].alias("at"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["at"].alias("at"), s["end"].alias("end")))))
    found = found.withColumn("_q_runs", F.when(F.col("_q_spans").isNotNull(), F.aggregate("_q_spans", zero, join)))
    piece = lambda a, z: F.array_join(F.transform(F.sequence(a, z), lambda i: F.concat(F.get("_q_seps", i - 1), F.get("_q_words", i - 1))), "")  # noqa: E731  words a..z, each after what stands before it
    some = lambda a, z: F.when(a <= z, piece(a, F.greatest(a, z))).otherwise(F.lit(""))
    start = lambda j: F.when(j == 0, F.lit(1)).otherwise(F.get("_q_runs", j - 1)["end"] + 1)
    kept = F.transform("_q_runs", lambda r, j: F.concat(some(start(j), r["at"] - 1), F.get("_q_seps", r["at"] - 1), F.lit(" ")))
    end = last(F.col("_q_runs"))["end"]
    tail = F.concat(some(end + 1, F.size("_q_words")), F.get("_q_seps", F.size("_q_words")))
    # after a run the next word follows the run's space, not the separator before it
    cut = F.concat(F.array_join(kept, ""), tail)
    back[names.index(text)] = F.when(F.col("_q_spans").isNotNull(), cut).otherwise(body).alias(text)
    return found.select(*back)
