"""Language identification of whole texts, spans of mixed texts included.

Script ranges narrow the languages that a word may be in; each candidate
scores the word by its byte trigrams (naive Bayes over hashed buckets, learned
from labelled texts); a Viterbi search over the words, with a penalty for
every switch, labels spans.  A text's language is the one with most letters.

The search runs on all texts of a block at once: texts are cut into segments
of ``SEGMENT`` words, every segment's best scores between any two languages
are found side by side, segments are chained, and a second pass traces the
path.  The result is that of the plain search over each whole text.

Scale: training shuffles one row for each language and bucket of a task (a
language that a third of the rows have is summed by Spark's partial
aggregation); the model is one array for each language in the shared folder.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import load, save, shared_dir, small_batches
from quillon.llm.textbits import WHITE, Block, blocks

BUCKETS = 1 << 16
SEGMENT = 64
SWITCH = 12.0  # nats
SMOOTH = 0.5
MIN_SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 1000
UNKNOWN = "und"

#: First and last code points of scripts (letters outside are of script 0).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FA1F),
)
SCRIPT_NAMES = ("Other", *dict.fromkeys(s for s, _, _ in SCRIPTS))

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the number of its script."""
    if not _letters:
        t = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000).astype(np.uint8)
        for name, a, z in SCRIPTS:
            t[a : z + 1] *= 1 + SCRIPT_NAMES.index(name)
        _letters.append(t)
    return _letters[0]


def word_features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: start, end, letters, script (of its first letter, -1 without); of each byte its trigram's bucket."""
    ws, we, _ = b.words()
    x = np.where(WHITE[b.lower], np.uint8(0x20), b.lower).astype(np.uint32)
    pad = np.full(1, 0x20, np.uint32)
    left, right = np.concatenate([pad, x[:-1]]), np.concatenate([x[1:], pad])
    inner = b.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(x))]
    left[inner] = 0x20
    right[inner - 1] = 0x20
    tri = (left << np.uint32(16)) | (x << np.uint32(8)) | right
    bucket = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    table = _letter_table()[points]
    p = b.points()
    at = np.flatnonzero(table)
    a, z = np.searchsorted(at, p[ws]), np.searchsorted(at, p[we])
    letters = z - a
    script = np.full(len(ws), -1, np.int64)
    script[letters > 0] = table[at[a[letters > 0]]].astype(np.int64) - 1
    return ws, we, letters, script, bucket


# ---- training -------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trigrams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for b in blocks(batches):
        langs = b.batch.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs], np.int64)
        ws, we, letters, script, bucket = word_features(b)
        word_doc = np.searchsorted(b.offsets, ws, "right") - 1
        some = letters > 0
        inside = np.zeros(len(b.data) + 1, np.int32)  # bytes of words with letters
        np.add.at(inside, ws[some], 1)
        np.add.at(inside, we[some], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        lang_of_byte = of[np.searchsorted(b.offsets, at, "right") - 1]
        n = np.bincount(lang_of_byte * BUCKETS + bucket[at], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        s = np.zeros((len(names), len(SCRIPT_NAMES)), np.int64)
        np.add.at(s, (of[word_doc[some]], script[some]), letters[some])
        for i, name in enumerate(names):
            trigrams[name] = trigrams.get(name, 0) + n[i]
            scripts[name] = scripts.get(name, 0) + s[i]
    for name in sorted(trigrams):
        for sign, counts in ((1, trigrams[name]), (-1, scripts[name])):  # scripts are buckets -1, -2, ...
            used = np.flatnonzero(counts)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array((used if sign > 0 else -1 - used).astype(np.int32)), pa.array(counts[used].astype(np.int64))], ["lang", "bucket", "n"])


def train(labelled: DataFrame, folder: str, *, text: str = "text", lang: str = "lang") -> list[tuple[str, list[int]]]:
    """Learns from all rows with a text and a language; saves the model; returns languages and their scripts' letters."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        bucket, n = group.column("bucket").to_numpy(), group.column("n").to_numpy()
        c = np.zeros(BUCKETS)
        c[bucket[bucket >= 0]] = n[bucket >= 0]
        s = np.zeros(len(SCRIPT_NAMES), np.int64)
        s[-1 - bucket[bucket < 0]] = n[bucket < 0]
        name = key[0].as_py()
        save(f"{folder}/lang-{name.encode().hex()}.npy", np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)).astype(np.float32))
        return pa.table({"lang": [name], "scripts": pa.array([s.tolist()], pa.list_(pa.int64()))})

    out = counts.groupBy("lang").applyInArrow(build, "lang string, scripts array<long>").limit(MAX_LANGUAGES + 1).collect()
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted((r["lang"], r["scripts"]) for r in out if any(r["scripts"]))


# ---- search ---------------------------------------------------------------


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word: ``scores`` (words, labels), each text's first word in ``first`` (n + 1)."""
    n_labels = scores.shape[1]
    if not len(scores):
        return np.zeros(0, np.int64)
    n_seg = -(-np.diff(first) // SEGMENT)
    seg_first = np.r_[0, np.cumsum(n_seg)]
    doc = np.repeat(np.arange(len(n_seg)), n_seg)
    start = first[doc] + (np.arange(seg_first[-1]) - seg_first[doc]) * SEGMENT
    size = np.minimum(first[doc + 1] - start, SEGMENT)
    order = np.argsort(-size, kind="stable")  # at step t, the segments with a word t are the first ones
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(SEGMENT), "left")
    # best score of each segment from a label before it to a label at its end
    m = np.where(np.eye(n_labels, dtype=bool), 0.0, -switch)[None] + scores[start][:, None, :]
    for t in range(1, SEGMENT):
        k = active[t]
        if not k:
            break
        x = m[:k]
        m[:k] = np.maximum(x, x.max(axis=2, keepdims=True) - switch) + scores[start[:k] + t][:, None, :]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # chain the segments of each text; the first one has no label before it
    best = np.zeros((len(n_seg), n_labels))
    back = np.zeros((len(order), n_labels), np.int64)
    docs = np.flatnonzero(n_seg > 0)
    docs = docs[np.argsort(-n_seg[docs], kind="stable")]
    most = -n_seg[docs]
    for j in range(int(n_seg.max())):
        d = docs[: np.searchsorted(most, -j, "left")]
        p = place[seg_first[d] + j]
        if j == 0:
            best[d] = m[p].max(axis=1)  # a start costs nothing in the best label
            back[p] = m[p].argmax(axis=1)
        else:
            v = best[d][:, :, None] + m[p]
            back[p], best[d] = v.argmax(axis=1), v.max(axis=1)
    leave, enter = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    state = best.argmax(axis=1)
    for j in range(int(n_seg.max()) - 1, -1, -1):
        d = docs[: np.searchsorted(most, -j, "left")]
        p = place[seg_first[d] + j]
        leave[p] = state[d]
        state[d] = back[p, state[d]]
        enter[p] = state[d]
    # trace the path in each segment
    v = scores[start] - np.where(np.arange(n_labels) == enter[:, None], 0.0, switch)
    came = np.zeros((SEGMENT, len(start), n_labels), np.int8 if n_labels < 128 else np.int16)
    for t in range(1, SEGMENT):
        k = active[t]
        if not k:
            break
        x = v[:k]
        top = x.argmax(axis=1)
        other = x.max(axis=1, keepdims=True) - switch
        came[t, :k] = np.where(x >= other, np.arange(n_labels), top[:, None])
        v[:k] = np.maximum(x, other) + scores[start[:k] + t]
    label = np.zeros(len(scores), np.int64)
    now = leave.copy()
    for t in range(SEGMENT - 1, -1, -1):
        k = active[t]
        label[start[:k] + t] = now[:k]
        now[:k] = came[t, np.arange(k), now[:k]]
    return label


def _score(b: Block, model: list[np.ndarray], may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts, ends, letters, scores by language, and each text's first word; words without letters score 0."""
    ws, we, letters, script, bucket = word_features(b)
    first = np.searchsorted(ws, b.offsets)
    scores = np.zeros((len(ws), len(model)))
    some = letters > 0
    allowed = may[script[some]] if some.any() else np.zeros((0, len(model)), bool)
    for i, logp in enumerate(model):
        if allowed[:, i].any():
            c = np.r_[0.0, np.cumsum(logp[bucket], dtype=np.float64)]
            scores[some, i] = (c[we] - c[ws])[some]
    sub = scores[some]
    low = np.where(allowed, sub, np.inf).min(axis=1, initial=0) - 50.0
    scores[some] = np.where(allowed, sub, low[:, None])
    return ws, we, letters, scores, first


_OUT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _predict(batches: Iterator[pa.RecordBatch], folder: str, langs: list[str], may: np.ndarray, switch: float) -> Iterator[pa.RecordBatch]:
    model = [np.asarray(load(f"{folder}/lang-{x.encode().hex()}.npy")) for x in langs]
    for b in blocks(batches):
        ws, we, letters, scores, first = _score(b, model, may)
        p = b.points()
        begin = p[b.offsets]
        if len(langs):
            label = viterbi(scores, first, switch)
            own = np.repeat(np.arange(b.n), np.diff(first))
            mass = np.zeros((b.n, len(langs)))
            np.add.at(mass, (own, label), letters)
            total = mass.sum(axis=1)
            top = mass.argmax(axis=1)
            share = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
            # runs of one label
            new = np.ones(len(ws), bool)
            new[1:] = (label[1:] != label[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            last = np.r_[at[1:], len(ws)][: len(at)] - 1
            runs = [[] for _ in range(b.n)]
            for d, x, s, e in zip(own[at].tolist(), label[at].tolist(), p[ws[at]].tolist(), p[we[last]].tolist()):
                runs[d].append({"lang": langs[x], "start": s - int(begin[d]), "end": e - int(begin[d])})
        else:
            total, top, share, runs = np.zeros(b.n), np.zeros(b.n, int), np.zeros(b.n), [[] for _ in range(b.n)]
        names = [langs[t] if n > 0 else UNKNOWN for t, n in zip(top.tolist(), total.tolist())]
        runs = [r if n > 0 else [] for r, n in zip(runs, total.tolist())]
        yield pa.RecordBatch.from_arrays([b.batch.column("key"), pa.array(names), pa.array(share), pa.array(runs, _OUT.field("spans").type)], ["key", *_OUT.names])


def identify(docs: DataFrame, labelled: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", switch: float = SWITCH) -> DataFrame:
    """For each row of ``docs``: key, lang_pred, score (share of the text's letters) and spans (lang, start, end in code points).

    ``labelled`` has texts and languages to learn from.

    Defined cases: a null or empty text, or one without a letter, is ``und``
    with score 0 and no spans, and so is every text if nothing was learned.
    Ties go to the language that is first in order of names.  Words without
    letters take the language around them.  A script that no language has
    leaves all languages as candidates.  Rows are judged alone; keys may be
    null or repeat.  More than ``MAX_LANGUAGES`` languages, whose scores no
    worker could hold, raise a ValueError.  Other columns are not looked at.
    An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession, "langid")
    learned = train(labelled, folder, text=text, lang=lang)
    langs = [x for x, _ in learned]
    seen = np.array([s for _, s in learned], float).reshape(len(langs), len(SCRIPT_NAMES))
    may = (seen / np.maximum(seen.sum(axis=1, keepdims=True), 1) >= MIN_SCRIPT_SHARE).T
    may[~may.any(axis=1)] = True
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _predict(it, folder, langs, may, switch), f"key {kind}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")
    return out.withColumnRenamed("key", key)
