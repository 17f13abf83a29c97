"""Exact removal of lines that many documents share, without joining lines.

Distinct line hashes that reach ``min_docs`` are indexed by a sharded minimal
perfect hash: each shard maps its keys to slots 0..n-1 with about three bits a
key, and the slots index compact arrays of fingerprints, document counts and
the document that keeps the line.  Documents probe the memory-mapped arrays;
a key outside the index lands on some slot and is told apart by its 64-bit
fingerprint (with the 64-bit key, 128 bits identify a line).

Scale: the only shuffle carries 32 bytes for each distinct line of a task,
already combined there and again by Spark's partial aggregation, so a line
that every document holds costs one row a task.  Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import load, save, shared_dir, small_batches, stored
from quillon.llm.textbits import WHITE_CHARS, Block, blocks, mix, owners, signed

_U = np.uint64
_NONE = np.iinfo(np.int64).min  # stands for a null id: less than any other
KEYS_PER_SHARD = 1 << 20
_GAMMA = 2.0


# ---- minimal perfect hash -------------------------------------------------


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + _U((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) % _U(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> np.ndarray:
    """A minimal perfect hash of distinct uint64 keys as one uint64 array.

    Level by level, keys that fall alone in a slot of a bit array take it and
    the others go on; a key's number is the rank of its bit.
    Layout: levels, size of each level in bits, bit words, rank before each word.
    """
    sizes, words, left, level = [], [], keys, 0
    while len(left):
        size = int(-(-max(64, _GAMMA * len(left)) // 64) * 64)
        at = _slot(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[at]]
        level += 1
        if level > 200:
            raise ValueError("keys are not distinct")
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ranks = np.zeros(len(bits), np.uint64)
    if len(bits):
        ranks[1:] = np.cumsum(np.bitwise_count(bits[:-1]).astype(np.uint64))
    return np.concatenate([np.array([len(sizes), *sizes], np.uint64), bits, ranks])


def query_mph(mph: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key (any number for keys that were not built in, -1 if no level has a bit)."""
    n = int(mph[0])
    sizes = mph[1 : n + 1].astype(np.int64)
    n_words = int(sizes.sum()) // 64
    bits, ranks = mph[n + 1 : n + 1 + n_words], mph[n + 1 + n_words :]
    out = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _slot(keys[left], level, size)
        word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
        w = bits[word]
        hit = (w >> bit) & _U(1) == 1
        below = np.bitwise_count(w[hit] & ((_U(1) << bit[hit]) - _U(1)))
        out[left[hit]] = ranks[word[hit]].astype(np.int64) + below
        left = left[~hit]
        base += size // 64
        if not len(left):
            break
    return out


# ---- lines ----------------------------------------------------------------


def line_keys(b: Block, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit keys of a block's lines: h1, h2, which lines are long enough, each text's first line."""
    starts, ends, first = b.lines()
    ws, we, _ = b.words()
    if len(ws):
        a, z = np.searchsorted(ws, starts), np.searchsorted(we, ends, "right")  # words a..z-1 are the line's
        some = z > a
        s = np.where(some, ws[np.minimum(a, len(ws) - 1)], starts)
        e = np.where(some, we[np.maximum(z - 1, 0)], starts)
    else:
        s = e = starts
    p = b.points()
    return b.ranges(s, e, 0), b.ranges(s, e, 1), p[e] - p[s] >= min_chars, first


def _ids(b: Block, column: str) -> np.ndarray:
    return pc.fill_null(b.batch.column(column).cast(pa.int64()), _NONE).to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        h1, h2, long_, first = line_keys(b, min_chars)
        own = owners(first)[long_]
        h1, h2 = h1[long_], h2[long_]
        if not len(h1):
            continue
        order = np.lexsort((own, h2, h1))
        h1, h2, own = h1[order], h2[order], own[order]
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_key | np.r_[True, own[1:] != own[:-1]]
        at = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype(np.int64), at)
        keeper = np.maximum.reduceat(_ids(b, "doc_id")[own], at)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h1[at])), pa.array(signed(h2[at])), pa.array(docs), pa.array(keeper)], ["h1", "h2", "n", "keeper"])


def _build(shard: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, keeper: np.ndarray, folder: str) -> None:
    keys = h1.view(np.uint64)
    same = np.argsort(keys, kind="stable")  # lines whose first 64 bits agree: none in practice, kept right anyway
    again = same[1:][keys[same][1:] == keys[same][:-1]]
    alone = np.ones(len(keys), bool)
    alone[again] = False
    mph = build_mph(keys[alone])
    slot = query_mph(mph, keys[alone])
    prints, counts, keepers = (np.empty(len(slot), t) for t in (np.uint64, np.int64, np.int64))
    prints[slot], counts[slot], keepers[slot] = h2.view(np.uint64)[alone], n[alone], keeper[alone]
    rest = np.stack([keys[again], h2.view(np.uint64)[again], n[again].view(np.uint64), keeper[again].view(np.uint64)]) if len(again) else np.zeros((4, 0), np.uint64)
    for name, a in (("mph", mph), ("prints", prints), ("counts", counts), ("keepers", keepers), ("rest", rest)):
        save(f"{folder}/{shard:05d}.{name}.npy", a)


class LineIndex:
    """The memory-mapped shards of one run."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.open: dict[int, list[np.ndarray]] = {}

    def shard(self, k: int) -> list[np.ndarray]:
        if k not in self.open:
            self.open[k] = [load(f"{self.folder}/{k:05d}.{name}.npy") for name in ("mph", "prints", "counts", "keepers", "rest")]
        return self.open[k]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line the number of documents (0: not indexed) and its keeper."""
        n, keeper = np.zeros(len(h1), np.int64), np.full(len(h1), _NONE, np.int64)
        if not self.shards or not len(h1):
            return n, keeper
        of = (h1 >> _U(40)) % _U(self.shards)
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            mph, prints, counts, keepers, rest = self.shard(int(of[part[0]]))
            slot = query_mph(mph, h1[part])
            ok = slot >= 0
            ok[ok] = prints[slot[ok]] == h2[part[ok]]
            n[part[ok]], keeper[part[ok]] = counts[slot[ok]], keepers[slot[ok]]
            for a, z, c, k in rest.T:
                hit = part[(h1[part] == a) & (h2[part] == z)]
                n[hit], keeper[hit] = np.int64(c), np.array([k], np.uint64).view(np.int64)[0]
        return n, keeper


def _drop(batches: Iterator[pa.RecordBatch], index: LineIndex, min_chars: int, schema: pa.Schema, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    key, text = names
    for b in blocks(batches, text):
        h1, h2, long_, first = line_keys(b, min_chars)
        own, ids = owners(first), _ids(b, key)
        n, keeper = index.probe(h1[long_], h2[long_])
        drop = np.zeros(len(h1), bool)
        drop[long_] = (n > 0) & (keeper != ids[own[long_]])
        dropped = np.bincount(own[drop], minlength=b.n)
        out = pc.fill_null(b.batch.column(text), "")
        if dropped.any():
            out = out.to_pylist()
            for i in np.flatnonzero(dropped).tolist():
                gone = drop[first[i] : first[i + 1]]
                out[i] = "\n".join(x for x, g in zip(out[i].split("\n"), gone.tolist()) if not g)
            out = pa.array(out, pa.string())
        have = {text: out, "n_lines": pa.array(np.diff(first)), "n_dropped": pa.array(dropped.astype(np.int64))}
        yield pa.RecordBatch.from_arrays([have[f.name] if f.name in have else b.batch.column(f.name) for f in schema], schema=schema)


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""Drops lines of at least ``min_chars`` code points that ``min_docs`` documents hold, save in the largest ``key``.

    Lines are split at \n and compared after stripping ``[\x20\x09-\x0D]`` and
    lower-casing A-Z.  Returns the input's columns with the kept lines in
    ``text``, and ``n_lines`` (before) and ``n_dropped``.

    Defined cases: a null or empty text is one empty line and comes back as an
    empty text.  A null key is less than any other.  Rows are documents: rows
    that repeat a key count apart, and all rows with the largest key keep the
    line.  A text whose lines all go is empty.  An empty table gives an empty
    table.  Input columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    small_batches(spark)
    folder = shared_dir(spark, "lines")
    counted = (
        docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"))
        .mapInArrow(lambda it: _count(it, min_chars), "h1 long, h2 long, n long, keeper long")
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    counted = stored(counted, f"{folder}/counted")
    shards = -(-counted.count() // KEYS_PER_SHARD)
    if shards:

        def build(key: tuple, group: pa.Table) -> pa.Table:
            cols = [group.column(c).to_numpy() for c in ("h1", "h2", "n", "keeper")]
            _build(key[0].as_py(), *cols, folder)
            return pa.table({"n": pa.array([len(cols[0])], pa.int64())})

        counted.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "n long").agg(F.sum("n")).collect()
    index = LineIndex(folder, shards)
    base = docs.withColumn(text, F.col(text).cast("string"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    fields = StructType([*base.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    schema = to_arrow_schema(fields)
    return base.mapInArrow(lambda it: _drop(it, index, min_chars, schema, (key, text)), fields)
