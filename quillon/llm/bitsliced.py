"""Ranked lexical search with a bit-sliced impact index.

What a term's occurrences add to a document's score, apart from the term's
weight, is a whole number, its impact.  Documents are numbered in blocks; for
each term and block the index keeps one bitmap for each binary digit of the
impacts (a slice), of which only the 64-bit words that are not empty are
stored.  A query multiplies a term's slices by its weight and adds them up with
bitwise carry arithmetic, so one operation on a bitmap serves thousands of
documents, and finds its best documents by going down the slices of the sum
from the most significant: documents that have the digit stay ahead while there
are enough of them.

Scale: texts are read once and never shuffled; a block is bounded in documents
and in postings, is written as files of the shared folder and searched by one
task.  Only the best documents of each block and query are shuffled.  The
queries' terms go to all workers, so queries are taken in groups of a bounded
number of terms, each with its own pass.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import load, save, shared_dir, small_batches, stored
from quillon.llm.textbits import give_back

#: Digits, letters and everything beyond ASCII, in UTF-8.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 20
#: (query, term) pairs of a group of queries: about 20 MB in each worker.
GROUP_PAIRS = 500_000
#: Terms of a block that a worker keeps multiplied; about 60 kB each in a full block.
KEPT_TERMS = 1024
_NO_ID = np.iinfo(np.int64).max  # a null id comes last


def terms(text: bytes) -> list[bytes]:
    """The maximal matches, only A-Z lower-cased (as bytes.lower() does)."""
    return _TERM.findall(text.lower())


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.binary() if pa.types.is_string(batch["text"].type) else pa.large_binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """no, term (distinct) of each row of ``items`` (no, text)."""

    def run(batches):
        for batch in batches:
            for no, text in zip(batch["no"].to_pylist(), _texts(batch)):
                own = sorted(set(terms(text or b"")))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(own), pa.int64()), pa.array(own, pa.binary()).cast(pa.string())], ["no", "term"])

    return items.mapInArrow(run, "no long, term string")


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """id, n, terms, tfs of each document with a term: its length, and how often it holds each term of ``numbers``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].to_pylist(), _texts(batch)):
                found = terms(text) if text else []
                if found:
                    own = sorted((numbers[t], c) for t, c in Counter(filter(numbers.__contains__, found)).items())
                    rows.append((i, len(found), [t for t, _ in own], [c for _, c in own]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        give_back()

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


# ---- blocks -------------------------------------------------------------------


def slice_block(term: np.ndarray, at: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The directory (term, slices, words) and compressed slices of a block's postings.

    A term's bytes are the numbers of its bitmap words that are not empty, then
    a row of such words for each binary digit, the least significant first.
    """
    order = np.lexsort((at, term))
    term, at, impact = term[order], at[order], impact[order].astype(np.uint64)
    word = at >> 6
    new = np.ones(len(at), bool)
    new[1:] = (term[1:] != term[:-1]) | (word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    bit = (at & 63).astype(np.uint64)
    digits = int(impact.max()).bit_length() if len(impact) else 0
    rows = np.empty((digits, len(starts)), np.uint64)
    for d in range(digits):
        rows[d] = np.bitwise_or.reduceat((impact >> np.uint64(d) & np.uint64(1)) << bit, starts)
    words, owner = word[starts].astype(np.int32), term[starts]
    bounds = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    codec, directory, parts = pa.Codec("zstd", 1), [], []
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(owner)]):
        own = rows[:, a:b]
        used = digits - int(np.argmax(own.any(1)[::-1]))
        parts.append(codec.compress(words[a:b].tobytes() + own[:used].tobytes(), asbytes=True))
        directory.append((int(owner[a]), used, b - a))
    return np.array(directory, np.int64).reshape(-1, 3), parts


class Block:
    """A block of the index: document ids in order, and the slices of a term on demand."""

    def __init__(self, uri: str):
        self.ids = load(f"{uri}-ids.npy")
        self.data = load(f"{uri}-slices.npy")
        directory = load(f"{uri}-terms.npy")
        self.places = {int(t): (int(d), int(w), int(a), int(b)) for t, d, w, a, b in directory}
        self.n_bytes = 8 * -(-len(self.ids) // 64)

    @staticmethod
    def write(uri: str, ids: np.ndarray, directory: np.ndarray, parts: list[bytes]) -> None:
        ends = np.cumsum([0, *map(len, parts)])
        save(f"{uri}-ids.npy", ids)
        save(f"{uri}-terms.npy", np.column_stack([directory, ends[:-1], ends[1:]]).astype(np.int64))
        save(f"{uri}-slices.npy", np.frombuffer(b"".join(parts), np.uint8))

    def slices(self, term: int) -> list[int]:
        """The term's bitmaps as whole numbers, document i at bit i; none if no document of the block holds it."""
        if term not in self.places:
            return []
        digits, words, a, b = self.places[term]
        raw = pa.Codec("zstd").decompress(self.data[a:b].tobytes(), 4 * words + 8 * digits * words, asbytes=True)
        at = np.frombuffer(raw, np.int32, words)
        rows = np.zeros((digits, self.n_bytes // 8), np.uint64)
        rows[:, at] = np.frombuffer(raw[4 * words :], np.uint64).reshape(digits, words)
        return [int.from_bytes(r.tobytes(), "little") for r in rows]


# ---- bitwise arithmetic ---------------------------------------------------------


def added(a: list[int], b: list[int]) -> list[int]:
    """The slices of the sums of two numbers for each document."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for x, y in zip(a, b):
        either = x ^ y
        out.append(either ^ carry)
        carry = x & y | carry & either
    for i in range(len(b), len(a)):
        if not carry:
            return out + a[i:]
        out.append(a[i] ^ carry)
        carry &= a[i]
    return out + [carry] if carry else out


def times(a: list[int], weight: int) -> list[int]:
    """The slices of each number times a constant: a shifted copy for each binary digit of it."""
    out: list[int] = []
    for d in range(weight.bit_length() if a else 0):
        if weight >> d & 1:
            out = added(out, [0] * d + a)
    return out


def best(sums: list[int], k: int) -> list[tuple[int, int]]:
    """(place, number) of the k largest numbers above 0, of equals the first places."""
    maybe, sure = 0, 0
    for s in sums:
        maybe |= s
    if maybe.bit_count() <= k:
        sure, maybe = maybe, 0
    else:
        for s in reversed(sums):
            ahead = sure | maybe & s
            n = ahead.bit_count()
            if n > k:
                maybe &= s
                continue
            sure, maybe = ahead, maybe & ~s
            if n == k:
                maybe = 0
                break
    out = []
    for bits, room in ((sure, k), (maybe, k - sure.bit_count())):
        while bits and room > 0:
            place = (bits & -bits).bit_length() - 1
            out.append((place, sum((s >> place & 1) << d for d, s in enumerate(sums))))
            bits &= bits - 1
            room -= 1
    return out


# ---- index and search -------------------------------------------------------------


def build_index(rows: DataFrame, folder: str, *, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Writes the index of postings() rows; uri, n_docs of each block.

    The impact of a term is (1000000000 * tf) div (1000 * tf + 20 * m), where m
    is 50 + (50 * n * N) div L for a document of n terms, of N documents with L
    terms in all.
    """
    total = rows.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = total["N"], total["L"] or 1

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []

        def write(batches_held):
            ids, n, size, term, tf = (np.concatenate(x) for x in zip(*batches_held))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = 50 + 50 * n * n_docs // n_terms
            own = np.repeat(np.arange(len(ids)), size)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[own])
            uri = f"{folder}/{part}-{made}"
            Block.write(uri, ids[order], *slice_block(term, place[own], impact))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(ids)], pa.int64())], ["uri", "n_docs"])

        n_held = [0, 0]
        for batch in batches:
            at = 0
            size = batch["terms"].value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                fits = int(np.searchsorted(ends, before + block_postings - n_held[1], "right"))
                to = min(batch.num_rows, at + block_docs - n_held[0], max(fits, at + (not held)))
                if to > at:
                    b = batch.slice(at, to - at)
                    flat = [b[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs")]
                    held.append((b["id"].fill_null(_NO_ID).to_numpy(), b["n"].to_numpy(), size[at:to], *flat))
                    n_held = [n_held[0] + to - at, n_held[1] + len(flat[0])]
                    at = to
                if at < batch.num_rows:
                    yield write(held)
                    held, n_held, made = [], [0, 0], made + 1
        if held:
            yield write(held)
        give_back()

    return stored(rows.mapInArrow(run, "uri string, n_docs long"), f"{folder}/blocks")


def search_index(blocks: DataFrame, queries: dict[int, list[tuple[int, int]]], k: int) -> DataFrame:
    """no, id, score: the k best documents of each block for each query, a list of (term, weight)."""
    schema = pa.schema([("no", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for uri in (u for b in batches for u in b["uri"].to_pylist()):
            block, kept, rows = Block(uri), OrderedDict(), []
            for no, wanted in queries.items():
                total: list[int] = []
                for term, weight in wanted:
                    if term not in kept:
                        kept[term] = times(block.slices(term), weight)
                        if len(kept) > KEPT_TERMS:
                            kept.popitem(last=False)
                    else:
                        kept.move_to_end(term)
                    total = added(total, kept[term])
                rows += [(no, int(block.ids[place]), score) for place, score in best(total, k)]
            if rows:
                no, ids, score = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(ids, mask=ids == _NO_ID), pa.array(score)], schema=schema)
        give_back()

    return blocks.select("uri").mapInArrow(run, "no long, id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 50, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """item, rank, key, score: the k documents with the highest score above 0 for each row of ``items``.

    A term of df documents weighs floor(1000 * ln((2 * N + 2) / (2 * df + 1)));
    a document's score sums weight times impact over the item's distinct terms.
    Equal scores go to the smaller key, null last.  A null or empty text has no
    terms: such a document is never found and does not count, such an item
    finds nothing.  Repeated rows are documents, and items, of their own.
    ``key`` is a whole number; other columns are not looked at; empty tables
    give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "bitsliced")
    numbered = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).withColumn("no", F.monotonically_increasing_id())
    asked = stored(numbered, f"{folder}/items")
    pairs = stored(item_terms(asked.select("no", "text")), f"{folder}/pairs")
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    n_groups = max(1, -(-pairs.count() // group_pairs))
    found = None
    for g in range(n_groups):
        part = pairs.filter(F.pmod(F.xxhash64("no"), F.lit(n_groups)) == g) if n_groups > 1 else pairs
        of_items: dict[int, list[bytes]] = {}
        for r in part.collect():  # about group_pairs rows
            of_items.setdefault(r["no"], []).append(r["term"].encode())
        numbers = {t: i for i, t in enumerate(sorted({t for own in of_items.values() for t in own}))}
        rows = stored(postings(source, numbers), f"{folder}/postings-{g}")
        n = rows.count()
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = {r["term"]: r["w"] for r in df.select("term", F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w")).collect()}  # at most a row for each term asked for
        queries = {no: [(numbers[t], weight[numbers[t]]) for t in own if weight.get(numbers[t], 0) > 0] for no, own in of_items.items()}
        blocks = build_index(rows, f"{folder}/index-{g}")
        spread = blocks.repartition(min(1000, max(1, blocks.count())))
        here = search_index(spread, queries, k)
        found = here if found is None else found.unionByName(here)
    rank = F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.join(asked.select("no", "item"), "no").select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")
