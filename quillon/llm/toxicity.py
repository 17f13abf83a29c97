"""Toxicity from a weighted finite-state grammar over clauses.

Words become a few classes: insult, threat, target, negation, reported speech
and other.  Small transducers each rewrite the class sequence of a clause -
a negation takes the sting out of an insult shortly after it, a verb of saying
marks what follows as reported, a target marks an attack as aimed - and are
composed into one machine, which reads each clause once and gives the arcs
that matched.  A text is scored by its clauses: how much each combination of
marks weighs in it, how many clauses attack and how much the worst one does.

Learned, from about ``MAX_FIT`` labelled rows at most, chosen by a hash of
their keys: insults beside the listed ones - whole words, and beginnings and
endings of words, so that a stem is known with an ending not seen before - and
the weight of every combination of marks.  What is learned must mark toxic
texts in two halves of the rows on their own; texts are dealt to them by a
hash of the text, so that copies are in one.

Scale: one pass over the texts to score, no shuffle of texts.  The labels of
the training rows, whose number is bounded by ``MAX_FIT``, are broadcast to
the texts; counts are combined in the task.  Candidates are counted in toxic
texts first, and in the others only if they are frequent there: in a bounded
slice of them, in a few tasks, and then in all for the candidates that the
slice has not ruled out, as a task has a row for each candidate that it meets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import load, save, shared_dir, small_batches, stored
from quillon.llm.textbits import Block, blocks, mix, signed

#: About the most labelled rows that are learned from (all, if there are no more); their keys and labels are broadcast.
MAX_FIT = 200_000
_U = np.uint64

#: Common words of each class in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns dumb fool fools jerk "
    "garbage vermin filth filthy imbecile cretin bastard dumbass "
    "dummkopf trottel abschaum widerlich wertlos vollidiot connard imbécile abruti minable estúpido imbécil basura escoria asqueroso"
).split()
THREATS = "kill hurt destroy beat shoot stab burn murder strangle crush töten umbringen verletzen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your you're youre u he she they them him her those these du dich ihr euch sie tu toi vous ils elles usted tú ellos ellas".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't cannot can't without nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say saying told called calls wrote writes quoted claimed reported according sagte sagt schrieb dit disait écrit dijo dice escribió".split()

CLASSES = ("other", "insult", "threat", "target", "negation", "report")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# what the composed machine gives for a word
PLAIN, NEGATED, REPORTED, AIMED, THREATENED = 1, 2, 4, 8, 16
SCOPE = 3  # words that a negation or a target reaches


# ---- transducers ----------------------------------------------------------


class Transducer:
    """A total letter-to-letter machine: step[(state, letter)] = (next state, letter out).

    Letters are (class, marks); a machine adds marks to a letter.
    """

    def __init__(self, start, step):
        self.start, self.step = start, step


def negation() -> Transducer:
    """Marks attacks within SCOPE words after a negation."""

    def step(state: int, letter: tuple[int, int]):
        c, marks = letter
        if c == NEGATION:
            return SCOPE, letter
        if c in (INSULT, THREAT) and state:
            return state - 1, (c, marks | NEGATED)
        return max(0, state - 1), letter

    return Transducer(0, step)


def reported() -> Transducer:
    """Marks attacks after a verb of saying, to the end of the clause."""

    def step(state: int, letter: tuple[int, int]):
        c, marks = letter
        if c == REPORT:
            return 1, letter
        return state, (c, marks | REPORTED) if state and c in (INSULT, THREAT) else letter

    return Transducer(0, step)


def aimed() -> Transducer:
    """Marks attacks within SCOPE words after a target; a target after an attack counts as a mark of its own."""

    def step(state: tuple[int, int], letter: tuple[int, int]):
        c, marks = letter
        target, attack = state
        if c == TARGET:
            return (SCOPE, 0), (c, marks | AIMED) if attack else letter
        after = (max(0, target - 1), max(0, attack - 1))
        if c in (INSULT, THREAT):
            return (after[0], 0 if target else SCOPE), (c, marks | AIMED) if target else letter
        return after, letter

    return Transducer((0, 0), step)


def attacks() -> Transducer:
    """Marks the attacks themselves."""

    def step(state: int, letter: tuple[int, int]):
        c, marks = letter
        return 0, (c, marks | (PLAIN if c == INSULT else PLAIN | THREATENED if c == THREAT else 0))

    return Transducer(0, step)


def compose(*machines: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """One machine that runs the given ones after each other: next[state, class], marks[state, class]."""

    def run(state: tuple, c: int) -> tuple[tuple, int]:
        letter, after = (c, 0), []
        for s, m in zip(state, machines):
            s, letter = m.step(s, letter)
            after.append(s)
        return tuple(after), letter[1]

    start = tuple(m.start for m in machines)
    number, todo, rows = {start: 0}, deque([start]), []
    while todo:
        state, row = todo.popleft(), []
        for c in range(len(CLASSES)):
            after, marks = run(state, c)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], marks))
        rows.append(row)
    table = np.array(rows, np.int64)
    return table[:, :, 0], table[:, :, 1]


NEXT, MARKS = compose(negation(), reported(), aimed(), attacks())


# ---- lexicon --------------------------------------------------------------

#: Code points of the beginnings and endings that are learned.
STEM = (4, 5, 6, 7, 8)
_BEGINNING, _ENDING = _U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25)


def _hash(word: str) -> int:
    b = Block.of([word])
    return int(b.ranges(np.array([0]), np.array([len(b.data)]))[0])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: start, end, hash, and each text's first (n + 1)."""
    s, e, first = b.runs(_LETTER[b.data])
    return s, e, b.ranges(s, e), first


def _letters(b: Block, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What may mark a word: (word numbers, keys) of whole words, then of beginnings and endings by size."""
    yield np.arange(len(h)), h
    p = b.points()
    at = np.append(np.flatnonzero((b.data & 0xC0) != 0x80), len(b.data))
    first, size = p[s], p[e] - p[s]
    for k in STEM:
        some = np.flatnonzero(size >= k)
        yield some, mix(b.ranges(s[some], at[first[some] + k]) + _BEGINNING)
        some = some[size[some] > k]
        yield some, mix(b.ranges(at[first[some] + size[some] - k], e[some]) + _ENDING)


class _Keys:
    """Sorted keys with a bitmap in front, as nearly all that is asked for is not among them."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[(keys >> _U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are known, and the places of these."""
        may = np.flatnonzero(self.some[(h >> _U(64 - self.BITS)).astype(np.int64)])
        if not len(may):
            return may, may
        at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        hit = self.keys[at] == h[may]
        return may[hit], at[hit]


class Lexicon:
    """Classes of listed words, and learned letters of insults with their weights (sorted keys)."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        entry = {_hash(w): c for c, words in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.listed = _Keys(np.array(sorted(entry), np.uint64))
        self.classes = np.array([entry[int(k)] for k in self.listed.keys], np.int64)
        self.learned, self.weights = _Keys(keys), weights

    def look_up(self, b: Block, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word: a listed class comes first; of learned letters the heaviest counts."""
        weight = np.zeros(len(h))
        for words, keys in _letters(b, s, e, h):
            hit, at = self.learned.find(keys)
            np.maximum.at(weight, words[hit], self.weights[at])
        cls = np.where(weight > 0, INSULT, OTHER)
        hit, at = self.listed.find(h)
        cls[hit] = self.classes[at]
        attack = (cls == INSULT) | (cls == THREAT)
        weight[attack] = np.maximum(weight[attack], 1.0)
        return cls, np.where(attack, weight, 0.0)


# ---- features -------------------------------------------------------------

#: Sums of the attacks with each combination of marks but PLAIN, which all have.
_COMBINATIONS = tuple(range(0, 32, 2))
FEATURES = (*(f"marks_{c}" for c in _COMBINATIONS), "direct", "target_after", "clauses", "worst")


def clause_features(b: Block, lex: Lexicon) -> np.ndarray:
    """For each text the logarithms of 1 and: the weights of its attacks by their marks, of those neither negated nor reported, targets after attacks, attacking clauses, and the attacks of the worst clause."""
    s, e, h, first = _tokens(b)
    cls, weight = lex.look_up(b, s, e, h)
    out = np.zeros((b.n, len(FEATURES)))
    hits = np.flatnonzero(cls != OTHER)
    if not len(hits):
        return out
    owner = np.searchsorted(first, hits, "right") - 1
    clause = np.r_[0, np.cumsum(_CLAUSE[b.data])][s[hits]]
    key = clause + owner  # clauses end at text bounds too: both grow together
    attack = (cls[hits] == INSULT) | (cls[hits] == THREAT)
    use = np.isin(key, np.unique(key[attack]))
    hits, owner, key = hits[use], owner[use], key[use]
    if not len(hits):
        return out
    marks, state, last, now = np.zeros(len(hits), np.int64), 0, 0, -1
    step, given = NEXT.tolist(), MARKS.tolist()
    for n, (i, k, c) in enumerate(zip(hits.tolist(), key.tolist(), cls[hits].tolist())):
        if k != now:
            now, state = k, 0
        else:
            for _ in range(min(i - last - 1, SCOPE + 1)):  # words between: more change nothing
                state = step[state][OTHER]
        marks[n], state, last = given[state][c], step[state][c], i
    w, plain = weight[hits], (marks & PLAIN) > 0
    combination = (marks >> 1)[plain]
    np.add.at(out, (owner[plain], combination), w[plain])
    direct = plain & (marks & (NEGATED | REPORTED) == 0)
    np.add.at(out[:, 16], owner[direct], w[direct])
    np.add.at(out[:, 17], owner[~plain], (marks[~plain] & AIMED) > 0)
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(np.where(direct, w, 0.0), at)
    np.add.at(out[:, 18], owner[at], sums > 0)
    np.maximum.at(out[:, 19], owner[at], sums)
    return np.log1p(out)


# ---- learning -------------------------------------------------------------

#: Texts of each half that a mark must be in, of both together, and the share of them that must be toxic in each half.
MIN_HALF, MIN_TEXTS, MIN_PRECISION = 2, 5, 0.9

#: Other texts of the slice that rules out candidates, about, and its tasks.
SLICE, SLICE_TASKS = 25_000, 8


def _toxic(b: Block) -> np.ndarray:
    return np.asarray(b.batch.column("toxic").to_numpy(zero_copy_only=False)) == 1


def _half(b: Block) -> np.ndarray:
    return (b.ranges(b.offsets[:-1], b.offsets[1:]) & _U(1)).astype(np.int64)


def _count_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic texts of each half of a block each key is."""
    for b in blocks(batches):
        s, e, h, first = _tokens(b)
        toxic, half = _toxic(b), _half(b)
        doc = np.repeat(np.arange(b.n), np.diff(first))
        keep, owner = [], []
        for words, keys in _letters(b, s, e, h):
            mine = toxic[doc[words]]
            keep.append(keys[mine])
            owner.append(doc[words[mine]])
        keys, owner = np.concatenate(keep), np.concatenate(owner)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        once = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])] if len(keys) else np.zeros(0, bool)
        keys, owner = keys[once], owner[once]
        if not len(keys):
            continue
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        one = np.add.reduceat(half[owner], at)
        n = np.diff(np.r_[at, len(keys)])
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[at])), pa.array(n - one), pa.array(one)], ["h", "y0", "y1"])


def _count_clean(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """In how many other texts of each half each candidate is: one row for each that is in any, for a task."""
    known = _Keys(np.asarray(load(path)))
    counts = np.zeros((2, len(known.keys)), np.int64)
    for b in blocks(batches):
        s, e, h, first = _tokens(b)
        clean, half = ~_toxic(b), _half(b)
        doc = np.repeat(np.arange(b.n), np.diff(first))
        found = []
        for words, keys in _letters(b, s, e, h):
            hit, at = known.find(keys)
            of = doc[words[hit]]
            found.append(np.unique(at[clean[of]] * b.n + of[clean[of]]))
        pair = np.concatenate(found)
        np.add.at(counts, (half[pair % b.n], pair // b.n), 1)
    some = np.flatnonzero(counts.sum(0))
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(signed(known.keys[part])), pa.array(counts[0, part]), pa.array(counts[1, part])], ["h", "n0", "n1"])


def learn_letters(rows: DataFrame, folder: str, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and weights of words, beginnings and endings that mark toxic texts in both halves of ``rows``.

    What is collected is bounded by the training rows, not by the corpus.
    """
    toxic = rows.filter("toxic = 1").mapInArrow(_count_toxic, "h long, y0 long, y1 long").groupBy("h").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    toxic = stored(toxic.filter((F.col("y0") >= MIN_HALF) & (F.col("y1") >= MIN_HALF) & (F.col("y0") + F.col("y1") >= MIN_TEXTS)), f"{folder}/candidates")
    share = lambda i: F.col(f"y{i}") >= MIN_PRECISION * (F.col(f"y{i}") + F.col(f"n{i}"))
    clean = rows.filter("toxic = 0")

    def counted(candidates: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}.npy"
        save(path, np.sort(candidates.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
        n = texts.mapInArrow(lambda it: _count_clean(it, path), "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        return candidates.join(n, "h", "left").na.fill(0, ["n0", "n1"])

    if n_clean > SLICE:
        # counts only grow with more texts: what fails on the slice fails on all
        part = clean.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * SLICE // n_clean).repartition(SLICE_TASKS)
        toxic = stored(counted(toxic, part, "candidates").filter(share(0) & share(1)).select("h", "y0", "y1"), f"{folder}/left")
    both = counted(toxic, clean, "left")
    got = both.filter(share(0) & share(1)).select("h", (F.col("y0") + F.col("y1")).alias("y"), (F.col("n0") + F.col("n1")).alias("n")).toPandas()
    keys = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    odds = np.log((got["y"].to_numpy(float) + 0.5) / (n_toxic + 1)) - np.log((got["n"].to_numpy(float) + 0.5) / (n_clean + 1))
    return keys[order], np.clip(odds / 4, 0.5, 2.0)[order]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method; weights of features cannot fall below 0 (more matches never calm a text)."""
    use, w = np.ones(x.shape[1], bool), np.zeros(x.shape[1] + 1)
    while True:
        z = np.hstack([x[:, use], np.ones((len(x), 1))])
        v = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            grad = z.T @ (p - y) + ridge * np.r_[v[:-1], 0]
            hess = (z.T * np.maximum(p * (1 - p), 1e-6)) @ z + ridge * np.diag(np.r_[np.ones(len(v) - 1), 1e-3])
            step = np.linalg.solve(hess, grad)
            v -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (v[:-1] >= 0).all():
            w[np.r_[np.flatnonzero(use), len(use)]] = v
            return w[:-1], w[-1]
        use[np.flatnonzero(use)[v[:-1] < 0]] = False


def _default() -> tuple[np.ndarray, float]:
    """Weights where there are too few labels of either kind to learn from."""
    w = np.zeros(len(FEATURES))
    w[[16, 18, 19]] = 2.0, 0.5, 1.0
    for c in _COMBINATIONS:
        if c & (NEGATED | REPORTED) == 0:
            w[c >> 1] = 1.0 + 0.5 * bool(c & AIMED) + 0.5 * bool(c & THREATENED)
    return w, -3.0


def train(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str) -> tuple[Lexicon, np.ndarray, float]:
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("_k").isNotNull())
    n_labels = known.count()
    if n_labels > MAX_FIT:
        known = known.filter(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < 1_000_000 * MAX_FIT // n_labels)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "_k").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 10:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0)), *_default()
    lex = Lexicon(*learn_letters(rows, shared_dir(docs.sparkSession, "toxicity"), n[1], n[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = clause_features(b, lex)
            yield pa.RecordBatch.from_arrays([b.batch.column("toxic"), *map(pa.array, x.T)], ["toxic", *FEATURES])

    measured = rows.mapInArrow(measure, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = measured.groupBy("toxic", *FEATURES).count().toPandas()  # about MAX_FIT rows at most
    got = got.sort_values(["toxic", *FEATURES]).reset_index(drop=True)
    x, y, c = got[list(FEATURES)].to_numpy(), got["toxic"].to_numpy().astype(float), got["count"].to_numpy()
    w, bias = fit(np.repeat(x, c, axis=0), np.repeat(y, c))
    return lex, w, bias


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """For each row of ``docs``: key, score (0 to 1) and predicted; learns from ``training`` joined with ``labels``.

    Defined cases: a null or empty text, or one in which no clause matches,
    has the score of no match.  Null or other labels than 0 and 1, and null
    keys, teach nothing; repeated labels count as often.  With fewer than ten
    labels of either kind the listed words and default weights are used.
    Rows are judged alone: equal texts have equal scores, and a score at the
    threshold is predicted.  Texts are read whole, however long.  Other columns
    are not looked at.  An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    lex, w, bias = train(training, labels, text=text, key=key, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            p = 1 / (1 + np.exp(-np.clip(clause_features(b, lex) @ w + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.batch.column("key"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
