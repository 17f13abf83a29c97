"""Packing of documents into sequences along a space-filling curve.

A document is a bag of hashed words; each word adds random signs to a few
sums, whose direction is the document's place in a cube of ``DIMS``
dimensions.  The Hilbert curve through the cube gives it a key, so documents
with like words have near keys.  Documents are range-sorted by the key, and
each range lays its documents end to end and cuts at every ``length`` ids, so
no sequence within a range is padded.  What is left at the end of a range is
cut into sequences whose lengths are powers of two, which need no padding.

Scale: one range shuffle of the texts.  A third of all documents may be equal
and share a key: the document's id, then a hash, split them among ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import shared_dir, small_batches, stored
from quillon.llm.textbits import Block, blocks, mix
from quillon.llm.tokens import encoder

DIMS, ORDER = 4, 10  # dimensions, bits in each
_U = np.uint64


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert keys of integer points (n, dims), each coordinate of ``order`` bits.

    The coordinates are turned into the transposed key (undo the rotations from
    the top bit down, then Gray-decode), whose bits are then interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(order - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(order - 1, 0, -1):
        t ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(b: Block, dims: int = DIMS, order: int = ORDER) -> np.ndarray:
    """The Hilbert key of each text of a block (0 for one without words)."""
    ws, we, first = b.words()
    h = b.ranges(ws, we)
    n = np.maximum(np.diff(first), 1)
    place = np.zeros((b.n, dims), np.int64)
    for d in range(dims):
        sign = (mix(h + _U(d + 1)) >> _U(63)).astype(np.int64) * 2 - 1
        c = np.r_[0, np.cumsum(sign)]
        z = (c[first[1:]] - c[first[:-1]]) / np.sqrt(n)  # about a standard deviation wide for unlike words
        place[:, d] = np.clip((np.arctan(z / 4) / np.pi + 0.5) * (1 << order), 0, (1 << order) - 1)
    return np.where(np.diff(first) > 0, hilbert(place, order), 0)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        yield pa.RecordBatch.from_arrays([b.batch.column("doc"), b.batch.column("text"), pa.array(curve_keys(b))], ["doc", "text", "curve"])


_PIECE = "part int, seq long, doc long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, part = encoder(path, end_id), TaskContext.get().partitionId()
    held_ids, held_docs, held, seq = [], [], 0, 0  # docs: (key, tokens already placed, tokens in all, tokens held)

    def emit(last: bool) -> pa.RecordBatch | None:
        nonlocal held_ids, held_docs, held, seq
        full = held // length
        bounds = np.arange(1, full + 1) * length
        if last:
            rest, at, tail = held - full * length, full * length, []
            for bit in range(length.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    at += 1 << bit
                    tail.append(at)
            bounds = np.r_[bounds, tail].astype(np.int64)
        if not len(bounds):
            return None
        ids, use = np.concatenate(held_ids), int(bounds[-1])
        size = np.array([d[3] for d in held_docs], np.int64)
        doc_end = np.cumsum(size)
        cuts = np.union1d(bounds, doc_end[doc_end <= use])
        starts = np.r_[0, cuts[:-1]]
        doc = np.searchsorted(doc_end, starts, "right")
        s = np.searchsorted(bounds, starts, "right")
        s_start = np.r_[0, bounds[:-1]][s]
        before = np.array([d[1] for d in held_docs], np.int64)[doc] + starts - (doc_end - size)[doc]
        raw = ids.astype("<u4").view(np.uint8)
        spans = list(zip(starts.tolist(), cuts.tolist()))
        cols = [
            pa.array(np.full(len(cuts), part, np.int32)), pa.array(seq + s), pa.array([held_docs[i][0] for i in doc.tolist()], pa.int64()), pa.array(before), pa.array(cuts - starts),
            pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in spans], pa.int64()), pa.array(np.array([d[2] for d in held_docs], np.int64)[doc]), pa.array(starts - s_start),
        ]
        names = ["part", "seq", "doc", "start", "length", "ids_crc32", "doc_tokens", "offset"]
        if with_ids:
            cols.append(pa.array([ids[a:z].tolist() for a, z in spans], pa.list_(pa.int32())))
            names.append("ids")
        seq += len(bounds)
        held -= use
        held_ids = [ids[use:]]
        keep = int(np.searchsorted(doc_end, use, "right"))
        if keep < len(held_docs):
            key, placed, total, n = held_docs[keep]
            used = use - int(doc_end[keep] - n)
            held_docs = [(key, placed + used, total, n - used), *held_docs[keep + 1 :]]
        else:
            held_docs = []
        return pa.RecordBatch.from_arrays(cols, names)

    for b in blocks(batches):
        ids, first = enc.encode(b)
        held_ids.append(ids)
        held += len(ids)
        held_docs += [(k, 0, n, n) for k, n in zip(b.batch.column("doc").to_pylist(), np.diff(first).tolist())]
        if held >= 256 * length and (out := emit(False)) is not None:
            yield out
    if held and (out := emit(True)) is not None:
        yield out


def pack_documents(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids (a power of two), neighbours on the curve together.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id (from 0,
    dense), offset and, if asked for, ids.  Every sequence has ``length`` ids
    or another power of two, so none needs padding.

    Defined cases: a null or empty text is the single id ``end_id``.  Keys may
    be null or repeat: each row is a document of its own.  A text longer than a
    sequence is cut into pieces.  An empty table has no pieces.  Ties on the
    curve are in order of the key, then of a hash of the text.
    """
    if length & (length - 1):
        raise ValueError("length is a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ("curve", "doc", F.xxhash64("text"))
    rows = rows.mapInArrow(_keys, "doc long, text string, curve long").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = _PIECE + (", ids array<int>" if with_ids else "")
    pieces = stored(rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id, length, with_ids), kind), shared_dir(spark, "packed"))
    total, before = 0, []
    for r in sorted(pieces.groupBy("part").agg(F.max("seq").alias("n")).collect()):  # a row for each range
        before.append((r["part"], total))
        total += r["n"] + 1
    first = spark.createDataFrame(before, "part int, first long")
    out = pieces.join(F.broadcast(first), "part").withColumn("sequence_id", F.col("first") + F.col("seq"))
    return out.select(F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
