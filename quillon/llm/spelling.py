"""Spelling variants: words that one inserted, deleted or replaced code point makes another.

Every word emits its full neighbourhood: all distinct deletions, replacements
and insertions over the alphabet that the vocabulary uses, about a hundred
times its length.  A candidate that is a word is a near word; nothing has to be
measured.  Candidates are hash-joined to the vocabulary without being shuffled:
an edit leaves either the first half of its result as it was in the word or the
second, so a vocabulary word of m code points lies in two buckets, by m and
each of its halves, and a word sends itself to the buckets of the halves that
its own edits leave.  There the candidates are made as rolling hashes in numpy,
looked up among the bucket's words, and a hit is compared letter by letter.
A row for each of six buckets and word is shuffled instead of 900 candidates,
and buckets are as small as half words are selective.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import shared_dir, stored
from quillon.llm.textbits import give_back, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]+"
#: A run loses a code point if so much divides its crc32.
LOSES = 97
#: Candidates that are hashed at a time (8 bytes each, a few arrays).
CHUNK = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_INVERSE = _U(pow(_P, -1, 1 << 64))
_LENGTH = _U(0xD6E8FEB86659FD93)
_SPREAD = _U(0xA0761D6478BD642F)


def vocabulary(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: int = 5, times: int = 3, loses: int = LOSES) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``least`` code points found ``times`` times or more.

    Where the crc32 of ``<key>:<run>`` is divisible by ``loses``, the run stands
    without the code point at the crc32 modulo its length.  A null text has no
    runs, a null key is written as nothing.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % loses == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _half(m: Column, side: int) -> Column:
    """The part of a word that is left as it was in a result of m code points by edits on the other side of its middle."""
    first = F.floor(m / 2).cast("int")
    return F.left("word", first) if side == 0 else F.right("word", (m - first).cast("int"))


def _buckets(words: DataFrame, least: int) -> DataFrame:
    """word, n, m, side, role, bucket: two buckets for each length of an edit's result; in those of its own length (role 0) a word is looked up as well."""
    m = F.length("word")
    rows = F.explode(F.array(*[F.struct((m + d).alias("m"), F.lit(side).alias("side"), F.lit(abs(d)).alias("role"), F.xxhash64(m + d, F.lit(side), _half(m + d, side)).alias("bucket")) for d in (0, -1, 1) for side in (0, 1)]))
    return words.select("word", "n", rows.alias("x")).select("word", "n", "x.*").filter(F.col("m") >= least)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * _SPREAD + _LENGTH)


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _of_length(n: int) -> np.uint64:
    return _U((n * int(_LENGTH)) & (1 << 64) - 1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Lexicon:
    """Words by the hash of their letters: a byte table that turns nearly all strangers away, then sorted hashes."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        h, size = np.zeros(len(words), np.uint64), np.array([len(w) for w in words], np.int64)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for i in range(0, len(at), max(1, CHUNK // int(n))):
                part = at[i : i + max(1, CHUNK // int(n))]
                h[part] = (_values(_letters([words[j] for j in part], int(n))) * _powers(int(n))).sum(1, dtype=np.uint64) + _of_length(int(n))
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self.bits = _U(64 - max(8, len(words).bit_length() + 4))
        self.table = np.zeros(1 << (64 - int(self.bits)), bool)
        self.table[self._slot(h)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> self.bits).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` (flattened) that are words, and which (each distinct word has one hash)."""
        flat = h.reshape(-1)
        may = np.flatnonzero(self.table[self._slot(flat)])
        at = np.searchsorted(self.hashes, flat[may])
        at[at == len(self.hashes)] = 0
        same = self.hashes[at] == flat[may]
        return may[same], self.order[at[same]]


def edits(words: list[str], length: int, m: int, side: int, alphabet: np.ndarray, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """(word, near word of the lexicon) places for all edits of words of ``length`` that make m code points on one side of the middle.

    Side 0 edits the second half, side 1 the first.  A deletion takes the last
    of a run of equal letters and an insertion goes behind such a run, so every
    result comes up once.
    """
    letter, n_positions = _values(alphabet), length + (m > length)
    positions = np.arange(m // 2, n_positions) if side == 0 else np.arange(0, min(m // 2, n_positions))
    if not len(positions) or not len(lexicon.words):
        return
    power = _powers(length + 2)
    width = 1 if m < length else len(alphabet)
    step = max(1, CHUNK // width)
    for i in range(0, len(words), max(1, step // length)):
        part = words[i : i + max(1, step // length)]
        w = _letters(part, length)
        own = _values(w) * power[:length]
        s = np.zeros((len(part), length + 1), np.uint64)
        np.cumsum(own, axis=1, out=s[:, 1:])
        for j in range(0, len(positions), step):
            p = positions[j : j + step]
            before, whole = s[:, p], s[:, -1:]
            if m < length:
                h = before + (whole - s[:, p + 1]) * _INVERSE
                ok = np.ones(h.shape, bool)
                inner = p < length - 1
                ok[:, inner] = w[:, p[inner]] != w[:, p[inner] + 1]
            elif m == length:
                h = (whole - own[:, p])[:, :, None] + letter * power[p][:, None]
                ok = w[:, p][:, :, None] != alphabet
            else:
                h = (before + (whole - before) * _U(_P))[:, :, None] + letter * power[p][:, None]
                ok = np.ones(h.shape, bool)
                inner = p < length
                ok[:, inner] = w[:, p[inner]][:, :, None] != alphabet
            at, found = lexicon.find(h + _of_length(m))
            keep = ok.reshape(-1)[at]
            at, found = at[keep], found[keep]
            rows, rest = np.divmod(at, len(p) * width)
            where, which = np.divmod(rest, width)
            for r, q, c, f in zip(rows.tolist(), p[where].tolist(), which.tolist(), found.tolist()):
                word = part[r]
                new = word[:q] + ("" if m < length else chr(alphabet[c])) + word[q + (m <= length) :]
                if new == lexicon.words[f]:
                    yield i + r, f


def _probe(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near words of each bucket's rows; words that are looked up (role 0) come first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    members: list[pa.RecordBatch] = []
    lexicon: Lexicon | None = None

    def near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, n, m, side = batch["word"].to_pylist(), batch["n"].to_numpy(), batch["m"].to_numpy(), batch["side"].to_numpy()
        size = np.array([len(w) for w in words], np.int64)
        kind = (size << 34) + (m.astype(np.int64) << 1) + side
        for k in np.unique(kind):
            rows = np.flatnonzero(kind == k)
            own = [words[r] for r in rows]
            pairs = np.array(list(edits(own, int(size[rows[0]]), int(m[rows[0]]), int(side[rows[0]]), alphabet, lexicon)), np.int64).reshape(-1, 2)
            for i in range(0, len(pairs), 1 << 16):
                a, b = pairs[i : i + (1 << 16)].T
                yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in a]), pa.array(n[rows[a]]), pa.array([lexicon.words[x] for x in b]), pa.array(lexicon.counts[b])], schema=schema)

    def known() -> Lexicon:
        first: dict[str, int] = {}  # a word lies in a bucket of each half
        for b in members:
            first.update(zip(b["word"].to_pylist(), b["n"].to_pylist()))
        return Lexicon(list(first), np.fromiter(first.values(), np.int64, len(first)))

    for batch in batches:
        role = batch["role"].to_numpy()
        n_own = int((role == 0).sum())
        if n_own:
            members.append(batch.slice(0, n_own))
        if n_own < batch.num_rows:
            lexicon = lexicon or known()
            yield from near(batch.slice(n_own))
    lexicon = lexicon or known()
    for batch in members:
        yield from near(batch)
    give_back()


def near_words(words: DataFrame, least: int) -> DataFrame:
    """word, n, near, near_n: each pair of near words in both directions, once."""
    # the letters that words use: as many as the class of letters has at most
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()), np.uint32)
    rows = _buckets(words, least).select("word", "n", "m", "side", "role", "bucket").repartition("bucket").sortWithinPartitions("role")
    return rows.mapInArrow(lambda batches: _probe(batches, alphabet), "word string, n long, near string, near_n long")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root of each (word, form) row: forms are followed to the last, twice as far in each round."""
    now, i = stored(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = now.join(further, "root", "left")
        i += 1
        both = stored(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"{folder}/roots-{i}")
        now = both.select("word", "root")
        if both.filter("_moved").isEmpty():
            return now


def group_variants(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: int = 5, times: int = 3, factor: int = 2, loses: int = LOSES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    ``form`` is the near word of largest n, of equals the smallest in code-point
    order, if that is at least ``factor`` times the word's own, else null;
    ``root`` is where forms lead to, the word itself if it has none.  n grows
    along forms, so they never run in a circle.  Null and empty texts have no
    words, rows that repeat count again, a text may be of any length, columns
    besides ``text`` and ``key`` are not looked at, and an empty table has no
    words.
    """
    folder = shared_dir(docs.sparkSession, "spelling")
    words = stored(vocabulary(docs, text=text, key=key, least=least, times=times, loses=loses), f"{folder}/words")
    best = near_words(words, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("x"))
    found = words.join(best, "word", "left").withColumn("_is", -F.col("x.n") >= factor * F.col("n"))
    given = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("x.form")).alias("form"), F.when(F.col("_is"), -F.col("x.n")).alias("form_n")), f"{folder}/forms")
    last = roots(given.filter("form is not null").select("word", "form"), folder)
    return given.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
