"""Similarity join of texts on word n-grams: MinHash LSH forest, then exact verification.

Every distinct text gets a signature of ``LONGEST`` MinHash values in each of
``trees`` trees.  A tree is a sorted prefix trie: its rows are in order of
their signatures, so texts that share a prefix stand together, and one pass
over neighbours counts, for every length of prefix, the pairs that share it.
All trees begin with whole signatures; then, one value at a time, the prefix
is shortened in the tree where that adds the fewest pairs for the recall it
gains, until a pair at the threshold is found with the target recall (pairs
above it are found with more).  Texts under one node are compared exactly on
their n-gram sets.

Nothing is pairwise outside a task:

* equal texts are one text, so a group of copies costs one row;
* a pair is checked in the first tree that joins it, and a trie node all of
  whose texts share an earlier tree's node is not looked at;
* a node of more than ``BLOCK`` texts, or ``BLOCK_GRAMS`` n-grams, is dealt out
  as pairs of blocks, each a task's matrix of intersections; a task returns,
  for each text, its number of links and one edge, never the pairs;
* n-gram sets are made for candidates only, whose ids are sorted arrays in the
  shared folder, memory-mapped by workers; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import load, save, shared_dir, small_batches, stored, without_keys
from quillon.llm.textbits import Block, blocks, give_back, grams, mix, owners, signed, whole

_U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
TREES, RECALL = 16, 0.9995
#: Values of a signature, and the least that a prefix has; the others are kept in ``BITS`` each, so a prefix may join more, never fewer.
LONGEST, SHORTEST, BITS = 8, 3, 12
#: Texts and n-grams of a block.
BLOCK, BLOCK_GRAMS = 512, 1 << 18
IDS_PER_SHARD = 1 << 22
_NULL = np.iinfo(np.int64).min  # stands for a null key
_rng = np.random.Generator(np.random.PCG64(8191))
_SLOPES = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = _rng.integers(0, 2**63, 1024, dtype=np.uint64)


def missed(depths: list[int], similarity: float) -> float:
    """The probability that a pair of this similarity shares no prefix, of these lengths, in any tree."""
    out = 1.0
    for d in depths:
        out *= 1 - similarity**d
    return out


def shorten(pairs: dict[tuple[int, int], int], trees: int, threshold: float, recall: float) -> list[int]:
    """The length of each tree's prefix, given how many pairs share one: (tree, length) -> pairs.

    Step by step the tree is shortened by one value that adds the fewest pairs
    for the recall gained.  If even the shortest prefixes miss the target, all
    trees have these.
    """
    import math

    depths = [LONGEST] * trees
    while missed(depths, threshold) > 1 - recall:
        best = None
        for t, d in enumerate(depths):
            if d > SHORTEST:
                gain = math.log(1 - threshold**d) - math.log(1 - threshold ** (d - 1))
                cost = (pairs.get((t, d - 1), 0) - pairs.get((t, d), 0) + 1) / gain
                if best is None or cost < best[0]:
                    best = cost, t
        if best is None:
            break
        depths[best[1]] -= 1
    return depths


def shingles(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes and the text of each, in order; a text of fewer words, but not none, is one n-gram."""
    ws, we, first = b.words()
    h, own = b.ranges(ws, we), owners(first)
    ok = whole(own, n)
    g, o = grams(h, n)[ok], own[: len(ok)][ok]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] = mix(extra[has] + h[first[short[has]] + k] + _U(k + 1))
        at = np.searchsorted(o, short)
        g, o = np.insert(g, at, extra), np.insert(o, at, short)
    return g, o


def _signatures(batches: Iterator[pa.RecordBatch], n: int, trees: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "t1", "t2", "size", *(f"p{t}" for t in range(trees)), *(f"r{t}" for t in range(trees))]
    for b in blocks(batches):
        raw = Block(b.data, b.offsets)
        raw._lower = b.data
        t1, t2 = (signed(raw.ranges(b.offsets[:-1], b.offsets[1:], which)) for which in (0, 1))
        g, o = shingles(b, n)
        some = np.unique(o)
        at = np.searchsorted(o, some)
        size = np.zeros(b.n, np.int64)
        size[some] = np.diff(np.r_[at, len(o)])
        none = np.ones(b.n, bool)
        none[some] = False
        first, rest = [], []
        for t in range(trees):
            begin, other = np.full(len(some), t + 1, np.uint64), np.zeros(len(some), np.uint64)
            for d in range(LONGEST if len(some) else 0):
                i = t * LONGEST + d
                value = np.minimum.reduceat(g * _SLOPES[i] + _SHIFTS[i], at)
                if d < SHORTEST:
                    begin = mix(begin * _U(0x9E3779B97F4A7C15) + value)
                else:
                    other = (other << _U(BITS)) | (mix(value) >> _U(64 - BITS))
            for out, values in ((first, begin), (rest, other)):
                col = np.zeros(b.n, np.int64)
                col[some] = signed(values)
                out.append(pa.array(col, mask=none))
        yield pa.RecordBatch.from_arrays([pc.fill_null(b.batch.column("key"), _NULL), pa.array(t1), pa.array(t2), pa.array(size), *first, *rest], names)


_TRIE = pa.schema([("tree", pa.int32()), ("begin", pa.int64()), ("rest", pa.int64()), ("node", pa.int64())])


class _Shared:
    """Counts the pairs that share a prefix, by tree and length, from rows in order of a trie."""

    def __init__(self):
        self.run = {d: 0 for d in range(SHORTEST, LONGEST + 1)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.tree = -1

    def add(self, tree: np.ndarray, shared: np.ndarray) -> None:
        """``shared``: the length of the prefix that a row shares with the one before it."""
        for d, open_ in self.run.items():
            at = np.r_[0, np.flatnonzero(shared[1:] < d) + 1] if shared[0] >= d else np.flatnonzero(shared < d)
            size = np.diff(np.r_[at, len(shared)])
            if shared[0] >= d:
                size[0] += open_
            else:
                self._close(self.tree, d, open_)
            done = size[:-1] * (size[:-1] - 1) // 2
            for t in np.unique(tree[at[:-1]]):
                self._close(int(t), d, 0, int(done[tree[at[:-1]] == t].sum()))
            self.run[d] = int(size[-1])
        self.tree = int(tree[-1])

    def _close(self, tree: int, d: int, size: int, pairs: int = 0) -> None:
        if more := pairs + size * (size - 1) // 2:
            self.pairs[tree, d] = self.pairs.get((tree, d), 0) + more

    def rows(self) -> pa.RecordBatch:
        """As rows of the trie's table: tree, length, pairs and no node."""
        for d, size in self.run.items():
            self._close(self.tree, d, size)
        found = [{"tree": t, "begin": d, "rest": n, "node": None} for (t, d), n in sorted(self.pairs.items())]
        return pa.RecordBatch.from_pylist(found, _TRIE)


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a range in order of tree, begin, rest: those that share a begin with a neighbour, and the counts of pairs.

    The range's first and last row always stay, as their neighbours are in
    other ranges.  Pairs across ranges are not counted: counts only steer how
    prefixes are shortened.
    """
    held, counts = None, _Shared()
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, begin, rest, node = (batch.column(c).to_numpy() for c in _TRIE.names)
        if held is None:
            held = tree[:1], begin[:1], rest[:1], node[:1], SHORTEST
            shared = np.zeros(1, np.int64)
            counts.add(tree[:1], shared)
            tree, begin, rest, node = tree[1:], begin[1:], rest[1:], node[1:]
            if not len(tree):
                continue
        tree, begin, rest, node = (np.r_[h, c] for h, c in zip(held, (tree, begin, rest, node)))
        shared = np.zeros(len(tree) - 1, np.int64)
        same = (tree[1:] == tree[:-1]) & (begin[1:] == begin[:-1])
        differ = (rest[1:] ^ rest[:-1]).view(np.uint64)
        for d in range(LONGEST, SHORTEST - 1, -1):
            shared[same & (shared == 0) & (differ >> _U((LONGEST - d) * BITS) == 0)] = d
        counts.add(tree[1:], shared)
        near = np.r_[held[4], shared] > 0
        near[:-1] |= shared > 0
        near[-1] = False  # waits for the next row
        held = tree[-1:], begin[-1:], rest[-1:], node[-1:], int(shared[-1])
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in (tree, begin, rest, node)], schema=_TRIE)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:4]], schema=_TRIE)
        yield counts.rows()


class _Wanted:
    """Ids of candidates, memory-mapped."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def open(self) -> list[np.ndarray]:
        return [load(f"{self.folder}/wanted-{k:05d}.npy") for k in range(self.shards)]


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted: _Wanted) -> Iterator[pa.RecordBatch]:
    ids = wanted.open()
    for b in blocks(batches):
        key = pc.fill_null(b.batch.column("key"), _NULL).to_numpy(zero_copy_only=False)
        of, hit = key % wanted.shards, np.zeros(b.n, bool)
        for k in np.unique(of).tolist():
            if len(ids[k]):
                mine = np.flatnonzero(of == k)
                p = np.minimum(np.searchsorted(ids[k], key[mine]), len(ids[k]) - 1)
                hit[mine] = ids[k][p] == key[mine]
        if not hit.any():
            continue
        g, o = shingles(b, n)
        order = np.lexsort((g, o))
        g, o = g[order], o[order]
        once = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])] if len(g) else np.zeros(0, bool)
        g, o = g[once], o[once]
        rows = np.flatnonzero(hit)
        a, z = np.searchsorted(o, rows), np.searchsorted(o, rows, "right")
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array([g[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist())], pa.binary())], ["node", "grams"])


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[back]
    owner, column = owner[keep], column[back[keep]]
    width, out = int(shared.sum()), np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 4096):
        a, z = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, width - at)), np.float32)
        m[owner[a:z], column[a:z] - at] = 1
        out += m[left] @ m[right].T
    return np.rint(out).astype(np.int64)


_LINKS = pa.schema([("node", pa.int64()), ("to", pa.int64()), ("texts", pa.int64()), ("docs", pa.int64())])


def _verify(group: pa.Table, threshold: float) -> pa.Table:
    """Links within one block, or between two, of a trie node."""
    node = group.column("node").to_numpy()
    order = np.argsort(node)
    node = node[order]
    side = group.column("side").to_numpy()[order]
    copies = group.column("n").to_numpy()[order]
    tree = group.column("tree")[0].as_py()
    keys = np.stack([group.column(f"k{t}").to_numpy()[order] for t in range(tree)]) if tree else np.zeros((0, len(node)), np.int64)
    blobs = group.column("grams").to_pylist()
    sets = [np.frombuffer(blobs[i], np.uint64) for i in order.tolist()]
    two = group.column("cross")[0].as_py()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(node)),) * 2
    if not len(left) or not len(right):
        return _LINKS.empty_table()
    size = np.array([len(s) for s in sets])
    both = intersections(sets, left, right)
    # whole numbers: both >= threshold * (|a| + |b| - both)
    limit = round(threshold * 10_000)
    linked = (10_000 + limit) * both >= limit * (size[left][:, None] + size[right][None, :])
    for t in range(tree):  # these pairs are checked in an earlier tree
        linked &= keys[t][left][:, None] != keys[t][right][None, :]
    if not two:
        np.fill_diagonal(linked, False)
    texts, docs = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    np.add.at(texts, left, linked.sum(1))
    np.add.at(docs, left, linked @ copies[right])
    if two:
        np.add.at(texts, right, linked.sum(0))
        np.add.at(docs, right, copies[left] @ linked)
    # one edge for each text: to the least text of its component here
    root = np.arange(len(node))
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(texts > 0)
    if len(node) > BLOCK // 4:
        del both, linked, sets, blobs
        give_back()
    return pa.Table.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(texts[some]), pa.array(docs[some])], schema=_LINKS)


def similarity_join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", n: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    r"""For each row: key, class_id, copy_id, n_copies, n_text_links, n_links.

    Two texts are linked if the Jaccard similarity of their sets of ``n``
    successive words (``[^\x20\x09-\x0D]+``, A-Z lower-cased) is at least
    ``threshold`` (four decimals).  ``copy_id`` is the least key with the same
    text, ``class_id`` the least key of the texts that links connect,
    ``n_copies`` counts the rows of the text, ``n_text_links`` other texts
    linked to it and ``n_links`` other rows: copies, and rows of linked texts.

    Defined cases: a null text is an empty one.  A text of fewer than ``n``
    words, but not none, has all its words as its one n-gram; a text without
    words has copies only.  Keys are integers and name rows; a null key counts
    as the least one and comes back as null; two texts under one key are taken
    as one node.  Repeated rows are copies.  An empty table gives an empty
    table.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "jaccard")
    begin, rest, k = ([f"{c}{t}" for t in range(trees)] for c in "prk")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    columns = ["size", *begin, *rest]
    signed_ = stored(rows.mapInArrow(lambda it: _signatures(it, n, trees), "key long, t1 long, t2 long, " + ", ".join(f"{c} long" for c in columns)), f"{folder}/signatures")
    texts = stored(signed_.groupBy("t1", "t2").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in columns]), f"{folder}/texts")

    # the tries: sorted ranges, cut to the rows with a neighbour; a begin that very many texts share spans ranges
    each = texts.filter(F.col("p0").isNotNull()).select("node", F.posexplode(F.array(*[F.struct(F.col(p).alias("begin"), F.col(r).alias("rest")) for p, r in zip(begin, rest)])).alias("tree", "x")).select("tree", "x.begin", "x.rest", "node")
    order = ("tree", "begin", "rest", "node")
    tries = stored(each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_trie, "tree int, begin long, rest long, node long"), f"{folder}/tries")
    counted = tries.filter("node is null").groupBy("tree", F.col("begin").alias("length")).agg(F.sum("rest").alias("pairs")).collect()  # a row for each tree and length
    tries = tries.filter("node is not null")
    depths = shorten({(r["tree"], r["length"]): r["pairs"] for r in counted}, trees, threshold, recall)
    prefix = lambda t, b, r: F.xxhash64(b, F.shiftrightunsigned(r, (LONGEST - depths[t]) * BITS))

    # nodes with at least two texts, of which no earlier tree has all in one node
    here = F.lit(None).cast("long")
    for t in range(trees):
        here = F.when(F.col("tree") == t, prefix(t, "begin", "rest")).otherwise(here)
    labels = texts.filter(F.col("p0").isNotNull()).select("node", "n", "size", *[prefix(t, begin[t], rest[t]).alias(k[t]) for t in range(trees)])
    nodes = tries.select("node", "tree", here.alias("k"))
    joined = nodes.join(labels, "node")
    same = [F.min(c) == F.max(c) for c in k[:-1]]
    earlier = lambda i: F.when(F.col("tree") > i, F.col(f"s{i}")).otherwise(F.lit(False))
    fresh = joined.groupBy("tree", "k").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"), *[s.alias(f"s{i}") for i, s in enumerate(same)]).filter("m > 1")
    fresh = fresh.filter(~F.greatest(F.lit(False), F.lit(False), *[earlier(i) for i in range(trees - 1)])).select("tree", "k", "m", "grams")
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("grams") / block_grams)).cast("int")
    own = F.pmod(F.xxhash64("node", "tree"), parts).cast("int")
    mine = stored(nodes.join(fresh, ["tree", "k"]).select("node", "tree", "k", parts.alias("parts"), own.alias("own")), f"{folder}/members")

    wanted = mine.select("node").distinct()
    shards = max(1, -(-wanted.count() // IDS_PER_SHARD))

    def keep(at: tuple, group: pa.Table) -> pa.Table:
        save(f"{folder}/wanted-{at[0].as_py():05d}.npy", np.sort(group.column("node").to_numpy()))
        return pa.table({"shard": pa.array([at[0].as_py()], pa.int64())})

    for i in range(shards):
        save(f"{folder}/wanted-{i:05d}.npy", np.zeros(0, np.int64))
    wanted.withColumn("shard", F.pmod("node", F.lit(shards))).groupBy("shard").applyInArrow(keep, "shard long").collect()  # a row for each shard
    ids = _Wanted(folder, shards)
    # a key that repeats with other texts has one set here
    sets = rows.mapInArrow(lambda it: _sets(it, n, ids), "node long, grams binary").groupBy("node").agg(F.min("grams").alias("grams"))

    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = mine.select("node", "tree", "k", "own", other).select(
        "node", "tree", "k",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("cross"),
    )
    full = dealt.join(sets.join(labels.drop("size"), "node"), "node")
    checked = full.groupBy("tree", "k", "lo", "hi").applyInArrow(lambda g: _verify(g, threshold), "node long, to long, texts long, docs long")
    links = stored(checked, f"{folder}/links")
    roots = components(links.select("node", "to"), f"{folder}/components", a="node", b="to")
    counts = links.groupBy("node").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("linked_docs"))
    classes = texts.select("t1", "t2", "node", "n").join(roots, "node", "left").join(counts, "node", "left")
    out = signed_.select("key", "t1", "t2").join(classes, ["t1", "t2"])
    real = lambda c: F.when(c != F.lit(_NULL), c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        real(F.col("key")).alias(key), real(F.coalesce("root", "node")).alias("class_id"), real(F.col("node")).alias("copy_id"),
        F.col("n").alias("n_copies"), zero("n_text_links").alias("n_text_links"), (zero("linked_docs") + F.col("n") - 1).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The document with the least key of each class; options as in similarity_join.

    Rows that repeat the key that stays all stay; null keys, being the least, stay.
    """
    gone = similarity_join(docs, key=key, **options).filter(F.col(key).isNotNull() & ~F.col("class_id").eqNullSafe(F.col(key)))
    return without_keys(docs, gone, key, shared_dir(docs.sparkSession, "near-duplicates"))
