"""Token ids of whole texts by a public tokenizer, each distinct chunk encoded once.

A byte-level tokenizer splits a text into pieces before it merges bytes, and
no piece crosses from a character that is no white space into white space.
So texts are cut at such places, chunks are told apart by 64-bit hashes of
their bytes, and a chunk's ids are looked up in sorted arrays; chunks not seen
before are encoded by the library, many at a time.  Tokenizers of other kinds
encode every text as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from quillon.llm.textbits import WHITE, Block

#: Chunks that a worker remembers (about 30 bytes each) before it forgets those not met again.
MAX_CHUNKS = 500_000

_U = np.uint64


class Encoder:
    """encode(block) gives all ids of a block, each text's followed by ``end_id``, and where each text's begin."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens", []))
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.width = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)  # in a byte-level vocabulary a character stands for a byte
        for a in spec.get("added_tokens", []):
            self.width[a["id"]] = len(a["content"].encode())
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.flat = [np.array([self.end_id], self.dtype)]
        self.used = 1
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, first id, ids, met again

    # ---- the remembered chunks: sorted runs of growing size

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for hashes, first, count, again in self.runs:
            k = keys[left]
            p = np.minimum(np.searchsorted(hashes, k), len(hashes) - 1)
            hit = hashes[p] == k
            at[left[hit]], n[left[hit]] = first[p[hit]], count[p[hit]]
            again[p[hit]] = True
            left = left[~hit]
            if not len(left):
                break
        return at, n

    def _add(self, keys: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, again: np.ndarray) -> None:
        """Remembers chunks whose ids begin at ``first`` of ``ids``."""
        self.runs.append((keys, self.used + first, count, again))
        self.flat.append(ids)
        self.used += len(ids)
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            both = [np.concatenate(x) for x in zip(*self.runs[-2:])]
            order = np.argsort(both[0], kind="stable")
            self.runs[-2:] = [tuple(x[order] for x in both)]

    def _forget(self) -> None:
        """Keeps only the chunks met again since they came or since the last call; all go if those are over a half."""
        flat = np.concatenate(self.flat)
        keys, first, count = (np.concatenate([r[i][r[3]] for r in self.runs]) for i in range(3))
        self._clear()
        if 2 * len(keys) > MAX_CHUNKS:
            return
        order = np.argsort(keys, kind="stable")
        keys, first, count = keys[order], first[order], count[order]
        begin = np.cumsum(count) - count
        ids = flat[np.repeat(first - begin, count) + np.arange(count.sum())]
        self._add(keys, begin, count, ids, np.zeros(len(keys), bool))

    # ---- encoding

    def _encode_new(self, b: Block, starts: np.ndarray, ends: np.ndarray, safe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct chunks begin, how many they are, and the ids.

        Safe ones are laid end to end: token widths show where each ends.
        """
        raw = b.data.tobytes()
        joined, alone = np.flatnonzero(safe), np.flatnonzero(~safe)
        s, e = starts.tolist(), ends.tolist()
        texts, kept, odd = [], [joined[:0]], [alone]
        for i in range(0, len(joined), 256):
            g = joined[i : i + 256]
            try:
                texts.append(b"".join([raw[s[k] : e[k]] for k in g.tolist()]).decode())
                kept.append(g)
            except UnicodeDecodeError:  # a replaced byte has another width
                odd.append(g)
        joined, alone = np.concatenate(kept), np.concatenate(odd)
        texts += [raw[s[k] : e[k]].decode("utf-8", "replace") for k in alone.tolist()]
        parts = [np.array(x.ids, self.dtype) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n_groups = len(texts) - len(alone)
        ids = np.concatenate([np.zeros(0, self.dtype), *parts])
        together = ids[: sum(map(len, parts[:n_groups]))]
        stops = np.searchsorted(np.cumsum(self.width[together]), np.cumsum(ends[joined] - starts[joined]), "left") + 1
        count = np.zeros(len(starts), np.int64)
        count[joined] = np.diff(stops, prepend=0)
        count[alone] = [len(x) for x in parts[n_groups:]]
        order = np.concatenate([joined, alone])
        first = np.zeros(len(starts), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return first, count, ids

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunk:
            each = [np.array([*x.ids, self.end_id], self.dtype) for x in self.tok.encode_batch_fast([b.text(i) for i in range(b.n)], add_special_tokens=False)]
            return np.concatenate(each) if each else np.zeros(0, self.dtype), np.cumsum([0, *map(len, each)])
        d, n = b.data, len(b.data)
        # the last byte of an ASCII character that is no white space, or of one of U+00C0 to U+07FF, none of which is
        ends_word = (d < 0x80) & ~WHITE[d]
        if n > 1:
            ends_word[1:] |= (d[1:] >= 0x80) & (d[1:] < 0xC0) & (d[:-1] >= 0xC3) & (d[:-1] < 0xE0)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = WHITE[d[1:]] & ends_word[:-1]
        cut[b.offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, b.offsets)
        ends = np.r_[starts[1:], n] if len(starts) else starts
        raw = Block(d, b.offsets)
        raw._lower = d
        keys, where, back, times = np.unique(raw.ranges(starts, ends), return_index=True, return_inverse=True, return_counts=True)
        at, count = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if sum(len(r[0]) for r in self.runs) + len(new) > MAX_CHUNKS and self.runs:
                self._forget()
                at, count = self._find(keys)  # chunks of this block were met just now, so they stay unless all go
                new = np.flatnonzero(at < 0)
            s, e = starts[where[new]], ends[where[new]]
            f, c, ids = self._encode_new(b, s, e, WHITE[d[s]] & ends_word[e - 1])
            at[new], count[new] = self.used + f, c
            self._add(keys[new], f, c, ids, times[new] > 1)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        at, count = at[back], count[back]
        # an end mark, held at place 0, after each text's chunks
        at, count = np.insert(at, first[1:], 0), np.insert(count, first[1:], 1)
        out = np.cumsum(count)
        ids = self.flat[0][np.repeat(at - (out - count), count) + np.arange(out[-1] if len(out) else 0)]
        return ids, np.r_[0, out][first + np.arange(b.n + 1)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = 0) -> Encoder:
    """The worker's encoder for a tokenizer file: kept, with its chunks, from task to task."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
