"""Texts scored by an interpolated modified Kneser-Ney model of order two or three.

The model has the three discounts of modified Kneser-Ney for each order,
interpolated down to a uniform distribution over the vocabulary and one unknown
word.  It is counted over all training texts in Spark and stored as
sorted hash arrays, which workers memory-map:

* words: sorted 64-bit word hashes of each hash range with their counts; a
  word's number is its place, so numbers need no table of their own;
* bigrams: for each range of context numbers the sorted keys
  context * (V + 3) + word with their counts, and each context's total and
  numbers of words seen once, twice and more often;
* continuation: for each range of word numbers how many contexts a word has;
* trigrams (order three): for each range of bigram numbers (places among all
  bigrams) each bigram's first place in the list of following words, these with
  their counts, and the sums of contexts with many.  Bigrams then count how many
  words they follow; those at a text's beginning, which follow none, keep
  their own counts.

Counts are a byte each; those of 255 and more are listed apart.

Counting ships, from each task and for each range, one compressed blob of
sorted, delta-coded keys with their counts: a bigram costs a few bytes, and a
context that a third of all words follow costs each task one entry for each
distinct word after it.  The driver sees one row of statistics a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import exists, load, save, shared_dir, small_batches, stored
from quillon.llm.textbits import Block, blocks

_U = np.uint64
#: Words, then bigrams, of training text for which there is one range.
WORDS_PER_RANGE, TOKENS_PER_RANGE = 1 << 20, 1 << 22
#: Tokens after which a task sends what it has counted.
FLUSH = 6 << 20
#: Words after a bigram from which its sums are stored, not added up when asked for.
MANY = 16


# ---- compressed sorted integers ---------------------------------------------


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct non-negative keys and positive counts, as byte planes of the gaps."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width].T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    head = np.array([len(keys), width, len(large)], "<i8").tobytes()
    return zlib.compress(head + planes.tobytes() + small.tobytes() + large.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n, width, n_large = np.frombuffer(raw, "<i8", 3).tolist()
    planes = np.frombuffer(raw, np.uint8, n * width, 24).reshape(width, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = planes.T
    counts = np.frombuffer(raw, np.uint8, n, 24 + n * width).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", n_large, 24 + n * width + n)
    return np.cumsum(gaps.view("<u8").reshape(-1)).astype(np.int64), counts


def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(c, at)


def merge(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal keys.

    Parts are taken one by one, and two of like size are merged at once, so
    that no more than about twice the result is held, however many parts come.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        if not len(part[0]):
            continue
        held.append(part)
        while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
            y, x = held.pop(), held.pop()
            held.append(_merged(x, y))
    while len(held) > 1:
        y, x = held.pop(), held.pop()
        held.append(_merged(x, y))
    return held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def save_counts(name: str, c: np.ndarray) -> None:
    """Stores counts as a byte each; those of 255 and more are listed with their places."""
    large = np.flatnonzero(c >= 255)
    save(f"{name}.small.npy", np.minimum(c, 255).astype(np.uint8))
    save(f"{name}.large.npy", np.stack([large, c[large]]).astype(np.int64))


class Counts:
    """What save_counts() stored, memory-mapped; indexed by an array of places."""

    def __init__(self, name: str):
        self.small, self.large = load(f"{name}.small.npy"), load(f"{name}.large.npy")

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large[1][np.searchsorted(self.large[0], at[big])]
        return out


# ---- words ------------------------------------------------------------------


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each hash: ranges are in order of the hashes, taken as unsigned."""
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and each text's first (n + 1)."""
    ws, we, first = b.words()
    return b.ranges(ws, we), first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        k = np.concatenate(held)
        keys, counts = np.unique(k, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    for b in blocks(batches):
        h, _ = _tokens(b)
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


class Vocabulary:
    """Word numbers by memory-mapped sorted hashes.  Numbers V, V + 1, V + 2: the end, the beginning, unknown words."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.size = int(self.first[-1])
        self.end, self.begin, self.unknown = self.size, self.size + 1, self.size + 2
        self.radix = self.size + 3
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            self._open[k] = tuple(load(f"{self.folder}/words-{k:05d}.{x}.npy") for x in ("hash", "count"))
        return self._open[k]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (``unknown`` if not in training texts) and training count of each hash; ``h`` sorted."""
        number, count = np.full(len(h), self.unknown, np.int64), np.zeros(len(h), np.int64)
        if not len(h) or not self.sizes:
            return number, count
        of = _shard(h, len(self.sizes))
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(h)]):
            k = int(of[a])
            if not self.sizes[k]:
                continue
            hashes, counts = self.shard(k)
            p = np.minimum(np.searchsorted(hashes, h[a:z]), len(hashes) - 1)
            hit = hashes[p] == h[a:z]
            number[a:z][hit] = self.first[k] + p[hit]
            count[a:z][hit] = counts[p[hit]]
        return number, count


def _numbered(b: Block, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, context number and count of each token (each text's end included), and each text's first token (n + 1)."""
    h, first = _tokens(b)
    keys, back = np.unique(h, return_inverse=True)
    number, count = voc.look_up(keys)
    w = np.insert(number[back], first[1:], voc.end)
    c = np.insert(count[back], first[1:], 0)
    first = first + np.arange(b.n + 1)
    ctx = np.empty_like(w)
    ctx[1:] = w[:-1]
    ctx[first[:-1]] = voc.begin
    return w, ctx, c, first


def _save_words(shard: int, h: np.ndarray, n: np.ndarray, folder: str) -> None:
    keys = h.view(np.uint64)
    order = np.argsort(keys)
    save(f"{folder}/words-{shard:05d}.hash.npy", keys[order])
    save(f"{folder}/words-{shard:05d}.count.npy", n[order])


# ---- bigrams ----------------------------------------------------------------


def _runs(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one value in a sorted array."""
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    for a, z in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
        yield int(of[a]), slice(a, z)


def _blobs(k: np.ndarray, c: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    rows = [(r, pack(k[at], c[at])) for r, at in _runs(of)]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "blob"])


def _count(batches: Iterator[pa.RecordBatch], voc: Vocabulary, ranges: int, pairs: Bigrams | None = None) -> Iterator[pa.RecordBatch]:
    """Blobs of bigrams, or of trigrams where ``pairs`` numbers the bigrams."""
    parts, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        k, c = merge(parts)
        contexts = pairs.size if pairs else voc.radix
        out = _blobs(k, c, k // voc.radix * ranges // max(contexts, 1))
        for i in range(out.num_rows):
            yield out.slice(i, 1)

    for b in blocks(batches):
        w, ctx, _, first = _numbered(b, voc)
        if pairs:
            before = pairs.before(w, ctx, first)
            ctx, w = before[before >= 0], w[before >= 0]
        k, c = np.unique(ctx * voc.radix + w, return_counts=True)
        parts.append((k, c.astype(np.int64)))
        size += len(w)
        if size >= FLUSH:
            yield from flush()
            parts, size = [], 0
    if parts:
        yield from flush()


class Bigrams:
    """Bigram numbers by memory-mapped sorted keys: a bigram's number is its place among all."""

    def __init__(self, folder: str, radix: int, sizes: list[int]):
        self.folder, self.radix, self.sizes = folder, radix, sizes
        self.first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.size = int(self.first[-1])
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def keys(self, r: int) -> np.ndarray:
        if r not in self._open:
            self._open[r] = load(f"{self.folder}/bigrams-{r:05d}.key.npy")
        return self._open[r]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of each bigram, -1 if no training text has it; ``keys`` sorted."""
        out = np.full(len(keys), -1, np.int64)
        for r, at in _runs(keys // self.radix * len(self.sizes) // self.radix):
            if self.sizes[r]:
                found = self.keys(r)
                p = np.minimum(np.searchsorted(found, keys[at]), len(found) - 1)
                out[at] = np.where(found[p] == keys[at], self.first[r] + p, -1)
        return out

    def before(self, w: np.ndarray, ctx: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of the bigram before each token; -1 at the beginning of a text and if it is unseen."""
        keys, back = np.unique(ctx * self.radix + w, return_inverse=True)
        out = np.full(len(w), -1, np.int64)
        out[1:] = self.look_up(keys)[back][:-1]
        out[first[:-1]] = -1
        return out

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """The second words of bigrams; ``numbers`` sorted."""
        out = np.empty(len(numbers), np.int64)
        for r, at in _runs(np.searchsorted(self.first, numbers, side="right") - 1):
            out[at] = self.keys(r)[numbers[at] - self.first[r]] % self.radix
        return out


def _bounds(k: int, ranges: int, radix: int) -> tuple[int, int]:
    """The numbers x with x * ranges // radix == k: from, to (exclusive)."""
    return -(-k * radix // ranges), -(-(k + 1) * radix // ranges)


def _of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


_STATS = "kind string, range int, blob binary, stats array<long>"


def _save_bigrams(r: int, blobs: list[bytes], folder: str, radix: int, ranges: int, top: bool) -> pa.Table:
    k, c = merge(map(unpack, blobs))
    lo, hi = _bounds(r, ranges, radix)
    ctx = k // radix - lo
    table = np.zeros((4, hi - lo), np.int64)
    table[0] = np.bincount(ctx, weights=c, minlength=hi - lo)
    for i, which in enumerate((c == 1, c == 2, c >= 3), 1):
        table[i] = np.bincount(ctx[which], minlength=hi - lo)
    save(f"{folder}/bigrams-{r:05d}.key.npy", k)
    if not top:  # only the bigrams that begin texts keep their own counts
        save(f"{folder}/begins-{r:05d}.npy", c[k // radix == radix - 2])
    else:
        save_counts(f"{folder}/bigrams-{r:05d}.count", c)
        save(f"{folder}/contexts-{r:05d}.npy", table.astype(np.uint32 if not table.size or table.max() < 1 << 32 else np.int64))
    words, n = np.unique(k % radix, return_counts=True)
    rows = [{"kind": "bigrams", "range": r, "blob": None, "stats": [*_of_counts(c), len(c)]}]
    of = words * ranges // radix
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(words) else np.zeros(0, int)
    for a, z in zip(at.tolist(), [*at[1:].tolist(), len(words)]):
        rows.append({"kind": "words", "range": int(of[a]), "blob": pack(words[a:z], n[a:z]), "stats": None})
    return pa.Table.from_pylist(rows, pa.schema([("kind", pa.string()), ("range", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))]))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not x.size or x.max() < 256 else np.uint32 if x.max() < 1 << 32 else np.int64)


def _sums(c: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """For each of n contexts: the sum of its counts, and how many are 1, 2 and more."""
    return np.stack([np.bincount(own, weights=c, minlength=n), *(np.bincount(own[x], minlength=n) for x in (c == 1, c == 2, c >= 3))]).astype(np.int64)


def _save_trigrams(r: int, blobs: list[bytes], folder: str, pairs: Bigrams, ranges: int) -> pa.Table:
    """Stores a range and returns, in blobs, how many words each bigram follows in it."""
    k, c = merge(map(unpack, blobs))
    lo, hi = _bounds(r, ranges, pairs.size)
    ctx, w = k // pairs.radix, k % pairs.radix
    size = np.bincount(ctx - lo, minlength=hi - lo)
    many = np.flatnonzero(size >= MANY)
    of = np.full(hi - lo, -1)
    of[many] = np.arange(len(many))
    own = of[ctx - lo]
    arrays = {"first": np.r_[0, np.cumsum(size)], "word": w, "many": many, "sums": _sums(c[own >= 0], own[own >= 0], len(many))}
    for name, x in arrays.items():
        save(f"{folder}/trigrams-{r:05d}.{name}.npy", _narrow(x))
    save_counts(f"{folder}/trigrams-{r:05d}.count", c)
    save(f"{folder}/trigrams-{r:05d}.stats.npy", np.array(_of_counts(c), np.int64))
    numbers, back = np.unique(ctx, return_inverse=True)
    keys, n = np.unique(pairs.words(numbers)[back] * pairs.radix + w, return_counts=True)
    return pa.Table.from_batches([_blobs(keys, n, keys // pairs.radix * len(pairs.sizes) // pairs.radix)])


def _save_followed(r: int, blobs: list[bytes], folder: str, pairs: Bigrams, begin: int) -> pa.Table:
    """The bigrams' counts below trigrams: of distinct words before, or of texts that begin so."""
    k, n = merge(map(unpack, blobs))
    keys = pairs.keys(r)
    c = np.zeros(len(keys), np.int64)
    c[keys // pairs.radix == begin] = load(f"{folder}/begins-{r:05d}.npy")
    c[np.searchsorted(keys, k)] = n
    lo, hi = _bounds(r, len(pairs.sizes), pairs.radix)
    save_counts(f"{folder}/followed-{r:05d}.count", c)
    save(f"{folder}/followed-{r:05d}.npy", _narrow(_sums(c, keys // pairs.radix - lo, hi - lo)))
    return pa.table({"range": pa.array([r], pa.int32()), "stats": pa.array([_of_counts(c)], pa.list_(pa.int64()))})


class Trigrams:
    """The highest order: the words after each bigram."""

    def __init__(self, folder: str, pairs: Bigrams, ranges: int, present: list[bool], d: list[float]):
        self.folder, self.pairs, self.ranges, self.present, self.d = folder, pairs, ranges, present, d
        self._open: dict[str, np.ndarray | Counts] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _array(self, r: int, name: str) -> np.ndarray | Counts:
        key = f"{self.folder}/trigrams-{r:05d}.{name}"
        if key not in self._open:
            self._open[key] = Counts(key) if name == "count" else load(f"{key}.npy")
        return self._open[key]

    def _context(self, r: int, of: np.ndarray) -> np.ndarray:
        """The sums of each context of a range; ``of`` sorted and distinct."""
        first, many = self._array(r, "first"), self._array(r, "many")
        a = first[of].astype(np.int64)
        n = first[of + 1].astype(np.int64) - a
        out = np.zeros((4, len(of)), np.int64)
        large = n >= MANY
        if large.any():
            out[:, large] = self._array(r, "sums")[:, np.searchsorted(many, of[large])]
        n[large] = 0
        own = np.repeat(np.arange(len(of)), n)
        place = np.arange(len(own)) + np.repeat(a - (np.cumsum(n) - n), n)
        out[:, ~large] = _sums(self._array(r, "count")[place], own, len(of))[:, ~large]
        return out

    def probability(self, before: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p(w | the two words before), ``low`` being p(w | the word before)."""
        out, some = low.copy(), np.flatnonzero(before >= 0)
        keys, back = np.unique(before[some] * self.pairs.radix + w[some], return_inverse=True)
        number, word = keys // self.pairs.radix, keys % self.pairs.radix
        high, spare = np.zeros(len(keys)), np.ones(len(keys))
        for r, at in _runs(number * self.ranges // max(self.pairs.size, 1)):
            if not self.present[r]:
                continue
            of, first, words = number[at] - _bounds(r, self.ranges, self.pairs.size)[0], self._array(r, "first"), self._array(r, "word")
            a, z = first[of].astype(np.int64), first[of + 1].astype(np.int64)
            end = z.copy()
            while (a < z).any():  # binary search in each bigram's words
                m = (a + z) // 2
                less = (a < z) & (words[np.minimum(m, len(words) - 1)] < word[at])
                a, z = np.where(less, m + 1, a), np.where(less, z, np.minimum(m, z))
            p = np.minimum(a, len(words) - 1)
            c = np.where((a < end) & (words[p] == word[at]), self._array(r, "count")[p], 0).astype(np.float64)
            contexts, own = np.unique(of, return_inverse=True)
            t = self._context(r, contexts)[:, own].astype(np.float64)
            total = np.maximum(t[0], 1)
            spare[at] = np.where(t[0] > 0, (self.d[0] * t[1] + self.d[1] * t[2] + self.d[2] * t[3]) / total, 1.0)
            high[at] = np.maximum(c - np.choose(np.minimum(c, 3).astype(int), [0.0, *self.d]), 0) / total
        out[some] = high[back] + spare[back] * low[some]
        return out


def _save_continuation(r: int, blobs: list[bytes], folder: str, radix: int, ranges: int) -> pa.Table:
    w, n = merge(map(unpack, blobs))
    lo, hi = _bounds(r, ranges, radix)
    dense = np.zeros(hi - lo, np.int64)
    dense[w - lo] = n
    save(f"{folder}/continuation-{r:05d}.npy", dense.astype(np.uint32 if not dense.size or dense.max() < 1 << 32 else np.int64))
    s = [*_of_counts(n), int((n >= 1).sum()), int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), int((n >= 3).sum())]
    return pa.table({"range": pa.array([r], pa.int32()), "stats": pa.array([s], pa.list_(pa.int64()))})


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of counts 1 to 4, at most 1, 2 and 3.

    An estimate of 0 or less, which few counts may give, would leave nothing for unseen words: the middle of its range stands in.
    """
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(x, float(i)) if x > 0 else i / 2 for i, x in enumerate(d, 1)]


class Model:
    """What workers need to score: the vocabulary, the folder of arrays and a few numbers."""

    def __init__(self, voc: Vocabulary, folder: str, ranges: int, tokens: int, texts: int, d2: list[float], d1: list[float], uni: list[int], present: dict[str, list[bool]], trigrams: Trigrams | None = None):
        self.voc, self.folder, self.ranges, self.tokens, self.texts = voc, folder, ranges, tokens, texts
        self.d2, self.d1, self.uni = d2, d1, uni  # discounts of both orders; types, sum and numbers of continuation counts 1, 2, 3+
        self.present = present  # by kind of array, which ranges have one
        self.trigrams = trigrams
        self.counts, self.contexts = ("followed", "followed") if trigrams else ("bigrams", "contexts")
        self._open: dict[str, np.ndarray | Counts] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _array(self, name: str, r: int, what: str = "") -> np.ndarray | Counts:
        key = f"{self.folder}/{name}-{r:05d}{what}"
        if key not in self._open:
            self._open[key] = Counts(key) if what == ".count" else load(f"{key}.npy")
        return self._open[key]

    def by_range(self, numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of one range in sorted numbers."""
        return _runs(numbers * self.ranges // self.voc.radix)

    def word_probability(self, w: np.ndarray) -> np.ndarray:
        """The lower order: continuation counts, interpolated with 1 / (V + 2) for words, the end and one unknown word."""
        n = np.zeros(len(w))
        order = np.argsort(w, kind="stable")
        for r, at in self.by_range(w[order]):
            if self.present["continuation"][r]:
                lo = _bounds(r, self.ranges, self.voc.radix)[0]
                n[order[at]] = self._array("continuation", r)[w[order[at]] - lo]
        types, total, once, twice, more = self.uni
        d = np.choose(np.minimum(n, 3).astype(int), [0.0, *self.d1])
        spare = (self.d1[0] * once + self.d1[1] * twice + self.d1[2] * more) / max(total, 1) if total else 1.0
        return np.maximum(n - d, 0) / max(total, 1) + spare / (self.voc.size + 2)

    def probability(self, ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w | ctx) of word numbers."""
        words, back = np.unique(w, return_inverse=True)
        low = self.word_probability(words)[back]
        keys, back = np.unique(ctx * self.voc.radix + w, return_inverse=True)
        h, out = keys // self.voc.radix, np.zeros(len(keys))
        total, spare = np.zeros(len(keys)), np.ones(len(keys))
        for r, at in self.by_range(h):
            if not self.present[self.contexts][r]:
                continue
            stored_keys, counts = self._array("bigrams", r, ".key"), self._array(self.counts, r, ".count")
            p = np.minimum(np.searchsorted(stored_keys, keys[at]), len(stored_keys) - 1)
            c = np.where(stored_keys[p] == keys[at], counts[p], 0).astype(np.float64)
            t = self._array(self.contexts, r)[:, h[at] - _bounds(r, self.ranges, self.voc.radix)[0]].astype(np.float64)
            total[at] = t[0]
            some = np.maximum(t[0], 1)
            spare[at] = np.where(t[0] > 0, (self.d2[0] * t[1] + self.d2[1] * t[2] + self.d2[2] * t[3]) / some, 1.0)
            out[at] = np.maximum(c - np.choose(np.minimum(c, 3).astype(int), [0.0, *self.d2]), 0) / some
        return out[back] + spare[back] * low


def _train_trigrams(rows: DataFrame, voc: Vocabulary, pairs: Bigrams, folder: str) -> tuple[list[int], Trigrams]:
    """How many bigrams follow 1, 2, 3 and 4 words, and the trigrams."""
    ranges = 2 * len(pairs.sizes)
    blob = "range int, blob binary"
    counted = rows.mapInArrow(lambda it: _count(it, voc, ranges, pairs), blob).groupBy("range")
    follow = counted.applyInArrow(lambda key, g: _save_trigrams(key[0].as_py(), g.column("blob").to_pylist(), folder, pairs, ranges), blob)
    none = pack(np.zeros(0, np.int64), np.zeros(0, np.int64))  # ranges whose bigrams all begin texts are stored too
    follow = follow.unionByName(rows.sparkSession.createDataFrame([(r, none) for r, n in enumerate(pairs.sizes) if n], blob))
    got = follow.groupBy("range").applyInArrow(lambda key, g: _save_followed(key[0].as_py(), g.column("blob").to_pylist(), folder, pairs, voc.begin), "range int, stats array<long>").collect()  # a row for each range
    two = np.sum([r["stats"] for r in got], axis=0).tolist() if got else [0] * 4
    present = [exists(f"{folder}/trigrams-{r:05d}.stats.npy") for r in range(ranges)]
    three = np.sum([load(f"{folder}/trigrams-{r:05d}.stats.npy") for r in range(ranges) if present[r]], axis=0).tolist() if any(present) else [0] * 4
    return two, Trigrams(folder, pairs, ranges, present, discounts(*three))


def train(docs: DataFrame, *, text: str = "text", order: int = 2) -> Model:
    """Counts all texts (null: empty) and stores the model; the end of a text is a token, its beginning a context."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is not 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "kneser-ney")
    rows = docs.select(F.col(text).cast("string").alias("text"))
    counted = stored(rows.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), f"{folder}/counted")
    size, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-size // WORDS_PER_RANGE)

    def words(key: tuple, group: pa.Table) -> pa.Table:
        h, n = (group.column(c).to_numpy() for c in ("h", "n"))
        _save_words(key[0].as_py(), h, n, folder)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(h)], pa.int64())})

    sizes = [0] * shards
    if shards:
        of = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(shards), 32)  # as in _shard
        for r in counted.withColumn("shard", of).groupBy("shard").applyInArrow(words, "shard long, n long").collect():  # a row for each range
            sizes[r["shard"]] = r["n"]
    voc = Vocabulary(folder, sizes)
    ranges = max(1, -(-n_words // TOKENS_PER_RANGE))
    radix = voc.radix
    pairs = rows.mapInArrow(lambda it: _count(it, voc, ranges), "range int, blob binary").groupBy("range")
    found = pairs.applyInArrow(lambda key, g: _save_bigrams(key[0].as_py(), g.column("blob").to_pylist(), folder, radix, ranges, order == 2), _STATS)
    found = stored(found, f"{folder}/found")
    bigrams = {r["range"]: r["stats"] for r in found.filter("kind = 'bigrams'").select("range", "stats").collect()}
    more = found.filter("kind = 'words'").select("range", "blob").groupBy("range")
    cont = {r["range"]: r["stats"] for r in more.applyInArrow(lambda key, g: _save_continuation(key[0].as_py(), g.column("blob").to_pylist(), folder, radix, ranges), "range int, stats array<long>").collect()}
    two = np.sum([s[:4] for s in bigrams.values()], axis=0).tolist() if bigrams else [0] * 4
    one = np.sum(list(cont.values()), axis=0).tolist() if cont else [0] * 9
    n_texts = rows.count()
    present = {"bigrams": [r in bigrams for r in range(ranges)], "contexts": [r in bigrams for r in range(ranges)], "followed": [r in bigrams for r in range(ranges)], "continuation": [r in cont for r in range(ranges)]}
    trigrams = None
    if order == 3:
        numbers = Bigrams(folder, radix, [bigrams[r][4] if r in bigrams else 0 for r in range(ranges)])
        two, trigrams = _train_trigrams(rows, voc, numbers, folder)
    return Model(voc, folder, ranges, n_words + n_texts, n_texts, discounts(*two), discounts(*one[:4]), one[4:], present, trigrams)


def _score(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    v = m.voc.size + (m.texts > 0)  # distinct tokens: the end counts as one
    for b in blocks(batches):
        w, ctx, c, first = _numbered(b, m.voc)
        c[w == m.voc.end] = m.texts
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (v + 1)))
        p = m.probability(ctx, w)
        if m.trigrams:
            p = m.trigrams.probability(m.trigrams.pairs.before(w, ctx, first), w, p)
        score = np.log10(p)
        at = first[:-1]  # every text has its end, so no range is empty
        known = np.add.reduceat((c > 0).astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([
            b.batch.column("key"), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(b.n, m.tokens, np.int64)),
            pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at)),
        ], ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    r"""For each row: key, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity.

    Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, and the end.

    Defined cases: a null or empty text is one token, its end.  A word that no
    training text has is the unknown word.  A model of no texts gives every
    token 1 / 2 (the end or an unknown word).  Rows are judged alone; keys may
    be null or repeat.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _score(it, model), f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
