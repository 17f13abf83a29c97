"""Token ids in files: a static range asymmetric numeral system with one shared table.

All texts are tokenised once, in order of their keys, into raw shards; the
ids are counted over all of them, and one frequency table (precision 2**20,
every id that occurs has at least one slot) encodes every shard.  A shard is
cut into blocks of ``BLOCK`` ids; a block has ``LANES`` interleaved states of
64 bits that share one stream of 32-bit words.  Blocks are independent: the
shard's checkpoints give each one's place, first id, states and crc32, so any
block can be decoded alone and all are decoded side by side in numpy.

A shard ``NNNNN-MMMM`` is four .npy files: ``words`` (all blocks' streams),
``blocks`` (checkpoints), ``keys`` and ``lengths`` (its texts, in order).
Range ``NNNNN`` of the sorted keys comes before ``NNNNN + 1``; a range has as
many shards as it has multiples of ``SHARD`` ids, so a task's memory is
bounded however the ranges fall.

Scale: one range shuffle of the texts; what reaches the driver is one row for
each shard and the counts of the vocabulary.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import exists, load, remove, save, shared_dir, small_batches, stored
from quillon.llm.textbits import blocks
from quillon.llm.tokens import encoder

BITS = 20
BLOCK, LANES = 1 << 16, 32
SHARD = 1 << 22
MAX_TASKS = 50_000
_U = np.uint64
_LOW = _U(1 << 31)

CHECKPOINT = np.dtype([("word", "<i8"), ("words", "<i8"), ("first", "<i8"), ("ids", "<i8"), ("crc32", "<u4"), ("words_crc32", "<u4"), ("table_crc32", "<u4"), ("pad", "<u4"), ("states", "<u8", (LANES,))])


# ---- the shared table -----------------------------------------------------


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least one for each id that occurs, in proportion otherwise."""
    total, size = int(counts.sum()), 1 << bits
    present = counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    if present.sum() > size:
        raise ValueError("more ids than slots")
    spare = size - int(present.sum())
    share = counts / total * spare
    freq = present + np.floor(share).astype(np.int64)
    rest = size - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)), ~present))
    freq[order[: int(min(rest, present.sum()))]] += 1
    freq[np.argmax(counts)] += size - int(freq.sum())
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<i8").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(np.argmax(freq)) if len(freq) else 0


# ---- blocks ---------------------------------------------------------------


def encode_blocks(ids: np.ndarray, table: Table, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words and checkpoints of the ids; the last step of a block is filled up with the commonest id."""
    n_blocks = -(-len(ids) // block)
    marks = np.zeros(n_blocks, CHECKPOINT)
    streams: list[np.ndarray] = []
    for g in range(0, n_blocks, 64):  # as many blocks side by side
        part = ids[g * block : (g + 64) * block]
        nb = -(-len(part) // block)
        if nb > 1 and len(part) % block:
            nb_full = len(part) // block
            groups = [part[: nb_full * block].reshape(nb_full, block), part[nb_full * block :][None]]
        else:
            groups = [part.reshape(nb, -1)]
        at = g
        for rows in groups:
            at = _encode(rows, table, marks, at, streams)
    words = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    sizes = marks["words"]
    marks["word"] = np.cumsum(sizes) - sizes
    marks["first"] = np.cumsum(marks["ids"]) - marks["ids"]
    return words, marks


def _encode(rows: np.ndarray, table: Table, marks: np.ndarray, at: int, streams: list[np.ndarray]) -> int:
    nb, n = rows.shape
    steps = -(-n // LANES)
    s = np.full((nb, steps * LANES), table.filler, np.int64)
    s[:, :n] = rows
    s = s.reshape(nb, steps, LANES)
    x = np.full((nb, LANES), _LOW)
    out = np.zeros((nb, steps, LANES), np.uint32)
    sent = np.zeros((nb, steps, LANES), bool)
    unit = _LOW >> _U(BITS) << _U(32)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[s[:, t]], table.cum[s[:, t]]
        full = x >= unit * f
        out[:, t] = x.astype(np.uint32)
        sent[:, t] = full
        x = np.where(full, x >> _U(32), x)
        q = x // f
        x = (q << _U(BITS)) + (x - q * f) + c
    for k in range(nb):
        words = out[k][sent[k]]
        streams.append(words)
        m = marks[at + k]
        m["words"], m["ids"], m["states"], m["table_crc32"] = len(words), n, x[k], table.crc
        m["crc32"], m["words_crc32"] = zlib.crc32(rows[k].astype("<u4").tobytes()), zlib.crc32(words.tobytes())
    return at + nb


def decode_blocks(words: np.ndarray, marks: np.ndarray, table: Table) -> np.ndarray:
    """The ids of the blocks of these checkpoints (any of a shard's, in any order), side by side."""
    if not len(marks):
        return np.zeros(0, np.uint32)
    if (marks["table_crc32"] != table.crc).any():
        raise ValueError("another frequency table encoded these blocks")
    for k, m in enumerate(marks):
        if zlib.crc32(np.ascontiguousarray(words[m["word"] : m["word"] + m["words"]]).tobytes()) != m["words_crc32"]:
            raise ValueError(f"the stream of block {k} is damaged")
    nb, steps = len(marks), -(-marks["ids"] // LANES)
    x = marks["states"].astype(np.uint64)
    at = marks["word"].astype(np.int64)
    padded = np.r_[words, np.zeros(1, np.uint32)]
    out = np.zeros((nb, int(steps.max()), LANES), np.uint32)
    mask = _U((1 << BITS) - 1)
    alive = np.arange(nb)
    for t in range(int(steps.max())):
        if t >= steps[alive].min():
            alive = alive[steps[alive] > t]
        y = x[alive]
        slot = y & mask
        s = table.symbol[slot.astype(np.int64)]
        out[alive, t] = s
        y = table.freq[s] * (y >> _U(BITS)) + slot - table.cum[s]
        low = y < _LOW
        n = np.cumsum(low, axis=1)
        where = np.where(low, at[alive, None] + n - 1, len(words))
        y = np.where(low, (y << _U(32)) | padded[where], y)
        x[alive] = y
        at[alive] += n[:, -1]
    ids = []
    for k in range(nb):
        one = out[k].reshape(-1)[: marks["ids"][k]]
        if (x[k] != _LOW).any() or at[k] != marks["word"][k] + marks["words"][k] or zlib.crc32(one.astype("<u4").tobytes()) != marks["crc32"][k]:
            raise ValueError(f"block {k} is damaged")
        ids.append(one)
    return np.concatenate(ids)


# ---- files ----------------------------------------------------------------

_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    enc, part, seq = encoder(path, end_id), TaskContext.get().partitionId(), 0
    ids, keys, lengths, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, keys, lengths, size, seq
        all_ids, name = np.concatenate(ids), f"{folder}/{part:05d}-{seq:04d}"
        save(f"{name}.raw.npy", all_ids)
        key = pa.concat_arrays(keys)
        save(f"{name}.keys.npy", np.ma.filled(pc.fill_null(key, 0).to_numpy(zero_copy_only=False)))
        save(f"{name}.nulls.npy", pc.is_null(key).to_numpy(zero_copy_only=False))
        n = np.concatenate(lengths)
        save(f"{name}.lengths.npy", n)
        count = np.bincount(all_ids)
        used = np.flatnonzero(count)
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "docs": len(n), "ids": len(all_ids), "id": used.astype(np.int32), "n": count[used]}], _SHARD)
        ids, keys, lengths, size, seq = [], [], [], 0, seq + 1
        return row

    for b in blocks(batches):
        i, first = enc.encode(b)
        ids.append(i)
        keys.append(b.batch.column("key"))
        lengths.append(np.diff(first))
        size += len(i)
        if size >= SHARD:
            yield flush()
    if lengths:
        yield flush()


def _encode_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    table = Table(np.asarray(load(f"{folder}/table.npy")))
    for batch in batches:
        for part, seq in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist()):
            name = f"{folder}/{part:05d}-{seq:04d}"
            raw = None
            if exists(f"{name}.raw.npy"):  # else an earlier or a concurrent run of this task has encoded it
                with contextlib.suppress(FileNotFoundError):
                    raw = load(f"{name}.raw.npy")
            if raw is not None:
                words, marks = encode_blocks(raw, table)
                save(f"{name}.blocks.npy", marks.view(np.uint8))
                save(f"{name}.words.npy", words)
                remove(f"{name}.raw.npy")
            words = load(f"{name}.words.npy")
            yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "words": [len(words)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("words", pa.int64())]))


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """One task for each row, as far as ``MAX_TASKS`` go: a row stands for a whole shard."""
    return rows.repartition(max(1, min(n, MAX_TASKS)))


def write_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending order of ``key``; returns the shards: folder, part, seq, docs, ids, start, words.

    ``key`` is an integer; null keys come first.  A null text is an empty one:
    its only id is ``end_id``.  Rows that repeat a key are written each, in
    order of a hash of their texts.  Other columns are not looked at.  An empty
    table has no shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "rans")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the hash splits a key that repeats very often
    rows = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    shards = stored(rows.mapInArrow(lambda it: _tokenise(it, tokenizer, end_id, folder), "part int, seq int, docs long, ids long, id array<int>, n array<long>"), f"{folder}/shards")
    counts = shards.select(F.explode(F.arrays_zip("id", "n")).alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("n")).collect()  # the vocabulary at most
    freq = np.zeros(max((r["id"] for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        freq[r["id"]] = r["n"]
    save(f"{folder}/table.npy", quantise(freq))
    sizes = {(r["part"], r["seq"]): (r["docs"], r["ids"]) for r in shards.select("part", "seq", "docs", "ids").collect()}  # a row for each shard
    todo = _spread(spark.createDataFrame(sorted(sizes), "part int, seq int"), len(sizes))
    done = todo.mapInArrow(lambda it: _encode_shards(it, folder), "part int, seq int, words long").collect()
    start, out = 0, []
    for part, seq, words in sorted((r["part"], r["seq"], r["words"]) for r in done):
        out.append((folder, part, seq, *sizes[part, seq], start, words))
        start += sizes[part, seq][1]
    return spark.createDataFrame(out, "folder string, part int, seq int, docs long, ids long, start long, words long")


_DOCS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def decode_shard(name: str, table: Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """ids, keys and lengths of a shard."""
    marks = np.asarray(load(f"{name}.blocks.npy")).view(CHECKPOINT)
    words = load(f"{name}.words.npy")
    ids = np.concatenate([np.zeros(0, np.uint32), *(decode_blocks(words, marks[i : i + 64], table) for i in range(0, len(marks), 64))])
    return ids, pa.array(load(f"{name}.keys.npy"), mask=np.asarray(load(f"{name}.nulls.npy"))), np.asarray(load(f"{name}.lengths.npy"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, Table] = {}
    for batch in batches:
        for r in batch.to_pylist():
            folder = r["folder"]
            if folder not in tables:
                tables[folder] = Table(np.asarray(load(f"{folder}/table.npy")))
            table = tables[folder]
            ids, keys, lengths = decode_shard(f"{folder}/{r['part']:05d}-{r['seq']:04d}", table)
            raw, at = ids.astype("<u4").view(np.uint8), np.cumsum(lengths) - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(at + r["start"]), pa.array(lengths), pa.array(crc, pa.int64())], schema=_DOCS)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decodes the files: key, start, n_tokens and the crc32 of each text's ids; checks every checksum."""
    return _spread(shards, shards.count()).mapInArrow(_read, "key long, start long, n_tokens long, ids_crc32 long")
