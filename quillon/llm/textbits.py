"""Words, lines and their 64-bit hashes, computed with numpy on raw UTF-8 buffers.

A ``Block`` is a run of whole texts laid end to end as bytes.  Hashes are
polynomial: a prefix sum of table values times powers of an odd multiplier,
modulo 2**64, lets the hash of any byte range be read off in O(1), so hashing
every word, line or window of a block costs a fixed number of array passes.
Blocks are cut at text boundaries near ``BLOCK_BYTES``; a longer text is a
block of its own, so texts are always processed whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_U = np.uint64
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers, one for each hash
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space that separates words and is stripped from lines.
WHITE_CHARS = " \t\n\x0b\x0c\r"

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        m = _MULT[which]
        both = []
        for base in (m, pow(m, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:  # a very long text: don't keep its tables
            return both[0], both[1]
        have = _powers[which] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Block:
    """Whole texts as one byte array; ``offsets`` has the n + 1 text bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch | None = None):
        self.data, self.offsets, self.batch = data, offsets, batch
        self.n = len(offsets) - 1
        self._lower: np.ndarray | None = None
        self._sums: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        """A block of Python strings; None is an empty text."""
        return next(blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text", 1 << 62))

    @property
    def lower(self) -> np.ndarray:
        """The bytes with A-Z lower-cased."""
        if self._lower is None:
            self._lower = LOWER[self.data]
        return self._lower

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def ranges(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the lower-cased byte ranges, equal for equal bytes wherever they stand."""
        if which not in self._sums:
            p, _ = powers(which, len(self.data) + 1)
            s = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLES[which][self.lower] * p[: len(self.data)], out=s[1:])
            self._sums[which] = s
        s, inv = self._sums[which], powers(which, len(self.data) + 1)[1]
        h = (s[ends] - s[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(_MULT[1 - which]))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the runs of True bytes, cut at text bounds, and where each text's runs begin (n + 1)."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[inner] = inside[inner]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[inner - 1] = inside[inner - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, and each text's first word (n + 1)."""
        return self.runs(~WHITE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""\n-split lines: starts, ends, and each text's first line (n + 1); an empty text has one empty line."""
        at = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, at, "right") - 1
        n_lines = np.bincount(owner, minlength=self.n)[: self.n] + 1
        first = np.zeros(self.n + 1, np.int64)
        np.cumsum(n_lines, out=first[1:])
        starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        where = np.arange(len(at)) + owner  # each text adds one line more than it has \n
        starts[first[:-1]] = self.offsets[:-1]
        ends[first[1:] - 1] = self.offsets[1:]
        starts[where + 1] = at + 1
        ends[where] = at
        return starts, ends, first

    def points(self) -> np.ndarray:
        """Prefix counts of code points: points()[e] - points()[s] is a range's length in code points."""
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=c[1:])
        return c


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``size`` bytes with their rows (``block.batch``); a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, "")
        wide = pa.types.is_large_string(col.type)
        bufs = col.buffers()
        offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            to = min(to, len(col))
            yield Block(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], batch.slice(at, to - at))
            at = to
    give_back()


def give_back() -> None:
    """At a task's end: returns freed memory to the system, as a worker may idle for long beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word or line, from each text's first one."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n successive hashes (they may cross texts: see ``whole``)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= _U(_MULT[0])
        g += h[k : len(h) - n + 1 + k]
    return mix(g)


def whole(owner: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie in one text."""
    return owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums by text, given each text's first element."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
