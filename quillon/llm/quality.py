"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Everything is measured on numpy arrays of rolling hashes: for each n-gram
length a block's windows are hashed together with their text's number, one
sort finds the repeated ones, and a difference array turns them into covered
words and characters.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import small_batches
from quillon.llm.textbits import Block, blocks, grams, mix, owners, sums, whole

_U = np.uint64

#: Repetition limits: the largest share of a text's word characters inside its
#: most frequent n-gram (n of 2 to 4) and inside n-grams that occur before (n of
#: 5 to 10), and of lines, and their characters, equal to an earlier line.  They
#: are wider than the published ones (0.20 to 0.16, 0.15 to 0.10, 0.30, 0.20),
#: which short clean texts with a repeated heading reach.
TOP_NGRAM = {2: 0.25, 3: 0.25, 4: 0.25}
DUP_NGRAM = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.30}
DUP_LINES, DUP_LINE_CHARS = 0.40, 0.30
#: The number of ``SYMBOLS`` for each word that a text may have (as published).
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS = 0.10
MIN_WORDS, MAX_REPEAT_WORDS = 50, 0.50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: its group, the size of the group, and whether it is the group's first in order."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.zeros(len(keys), bool)
    first[order[new]] = True
    return group, np.bincount(group, minlength=1), first


def _covered(at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``length`` words are inside the windows of n words that begin at ``at``."""
    d = np.zeros(length + 1, np.int32)
    np.add.at(d, at, 1) if len(at) < 64 else np.copyto(d[: length + 1], np.bincount(at, minlength=length + 1))
    c = np.cumsum(d)
    c[n:] -= c[:-n].copy()
    return c[:length] > 0


def measure(b: Block) -> dict[str, np.ndarray]:
    """The measures of each text of a block; shares are of word characters (0 where a text has none)."""
    ws, we, wf = b.words()
    own, p = owners(wf), b.points()
    chars = p[we] - p[ws]
    h = b.ranges(ws, we)
    out = {"n_words": np.diff(wf), "word_chars": sums(chars, wf)}
    out["n_symbols"] = np.diff(np.r_[0, np.cumsum(_SYMBOL[b.data])][b.offsets])
    # lines
    ls, le, lf = b.lines()
    lown = owners(lf)
    has_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    raw = Block(b.data, b.offsets)
    raw._lower = b.data  # lines are compared as they are
    keys = mix(raw.ranges(ls, le) + lown.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    dup = np.zeros(len(ls), bool)
    dup[has_word] = ~_again(keys[has_word])[2]
    out["n_dup_lines"] = sums(dup.astype(np.int64), lf)
    lines, line_chars = sums(has_word.astype(np.int64), lf), sums((p[le] - p[ls]) * has_word, lf)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_chars"] = sums((p[le] - p[ls]) * dup, lf) / np.maximum(line_chars, 1)
    total = np.maximum(out["word_chars"], 1)
    ccum = np.r_[0, np.cumsum(chars)]
    for n in (2, 3, 4, 5, 6, 7, 8, 9, 10):
        at = np.flatnonzero(whole(own, n))
        g = grams(h, n)[at]
        group, size, first = _again(mix(g + own[at].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
        many = size[group] > 1
        if n == 3:
            raw_own = own  # words are compared as they are for the contract's count
            hr = raw.ranges(ws, we)
            rg, rs, _ = _again(mix(grams(hr, 3)[at] + raw_own[at].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
            out["n_repeat_words"] = sums(_covered(at[rs[rg] > 1], 3, len(h)).astype(np.int64), wf)
        if n in TOP_NGRAM:
            # the most frequent n-gram of a text: occurrences times its characters, if it occurs more than once
            span = ccum[at + n] - ccum[at]
            score = np.where(many, size[group] * span, 0)
            top = np.zeros(b.n, np.int64)
            if len(at):
                f = np.searchsorted(own[at], np.arange(b.n))
                filled = np.diff(np.r_[f, len(at)]) > 0
                best = np.zeros(b.n, np.int64)
                best[filled] = np.maximum.reduceat(size[group], f[filled])
                top[filled] = np.maximum.reduceat(np.where(size[group] == best[own[at]], score, 0), f[filled])
            out[f"top_{n}"] = np.minimum(top / total, 1.0)
        else:
            cover = _covered(at[~first], n, len(h))
            out[f"dup_{n}"] = sums(chars * cover, wf) / total
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of each text."""
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > round(100 * MAX_REPEAT_WORDS) * m["n_words"])
    bad = base | (m["n_symbols"] > MAX_SYMBOLS * m["n_words"]) | (m["dup_line_share"] > DUP_LINES) | (m["dup_line_chars"] > DUP_LINE_CHARS)
    for n, most in TOP_NGRAM.items():
        bad = bad | (m[f"top_{n}"] > most)
    for n, most in DUP_NGRAM.items():
        bad = bad | (m[f"dup_{n}"] > most)
    return base, ~bad


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("dup_line_share", "dup_line_chars", *(f"top_{n}" for n in TOP_NGRAM), *(f"dup_{n}" for n in DUP_NGRAM))


def _score(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, text):
        m = measure(b)
        base, kept = verdict(m)
        have = {k: pa.array(m[k].astype(np.int64)) for k in COUNTS} | {k: pa.array(m[k].astype(np.float64)) for k in SHARES}
        have |= {"base_failed": pa.array(base), "kept": pa.array(kept)}
        yield pa.RecordBatch.from_arrays([have[f.name] if f.name in have else b.batch.column(f.name) for f in schema], schema=schema)


def quality_rules(docs: DataFrame, *, text: str = "text") -> DataFrame:
    r"""Adds each text's counts, repetition shares, ``base_failed`` and ``kept``.

    Words are ``[^\x20\x09-\x0D]+``; n-grams compare words with A-Z
    lower-cased, ``n_repeat_words`` and ``n_dup_lines`` compare them as they are.

    Defined cases: a null or empty text has no words, so it fails the base rule
    (fewer than 50 words).  Texts shorter than an n-gram have share 0.  Rows
    are judged alone: repeated rows get equal results.  Of equally frequent
    top n-grams the one with most characters counts.  Columns of the input
    named like an output are replaced; an empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

    small_batches(docs.sparkSession)
    names = (*COUNTS, *SHARES, "base_failed", "kept")
    base = docs.drop(*names).withColumn(text, F.col(text).cast("string"))
    fields = StructType([*base.schema.fields])
    for c in names:
        fields = fields.add(c, LongType() if c in COUNTS else DoubleType() if c in SHARES else BooleanType())
    schema = to_arrow_schema(fields)
    return base.mapInArrow(lambda it: _score(it, text, schema), fields)
