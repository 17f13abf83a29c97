"""EASE against the dense inverse, and BPR by strata against training in one piece."""

import random
from pathlib import Path

import numpy as np
import pytest

from quillon.operators import bpr
from quillon.operators.ease import Sums, ease

DIR = "/root/testdata/sf0.001"


def dense(pairs, lam, k):
    """{(item, related): score} of the k largest positive weights."""
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    x = np.zeros((len(users), len(items)))
    for u, i in pairs:
        x[users.index(u), items.index(i)] = 1
    p = np.linalg.inv(x.T @ x + lam * np.eye(len(items)))
    b = np.round(p / -np.diag(p)[None, :], 9)
    np.fill_diagonal(b, 0)
    out = {}
    for i, row in zip(items, b):
        for s, j in sorted((-s, j) for s, j in zip(row, items) if s > 0)[:k]:
            out[i, j] = -s
    return out


@pytest.mark.parametrize("lam,k,tile,columns", [(500.0, 200, 1 << 20, 1 << 21), (500.0, 7, 40, 200), (3.0, 5, 25, 90)])
def test_ease_is_the_dense_inverse(spark, lam, k, tile, columns):
    rng = random.Random(4)
    pairs = [(u, int(60 * rng.random() ** 2)) for u in range(50) for _ in range(rng.randrange(1, 15))]
    pairs += [(99, i) for i in range(0, 60)]  # a user who has everything
    df = spark.createDataFrame([*pairs, *pairs[:20]], "user_id long, item_id long").repartition(3)
    rows = ease(df, lam=lam, k=k, tile=tile, columns=columns).collect()
    got, want = {(r.item_id, r.related_id): r.score for r in rows}, dense(set(pairs), lam, k)
    assert len(rows) == len(got) and abs(len(got) - len(want)) <= 2
    for e in set(got) | set(want):  # at the k-th place, entries that differ by rounding may change places
        assert abs(got.get(e, min(s for (i, _), s in want.items() if i == e[0])) - want.get(e, min(s for (i, _), s in got.items() if i == e[0]))) < 1e-6
    ranks = {}
    for r in rows:
        ranks.setdefault(r.item_id, []).append((r["rank"], -r.score, r.related_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in ranks.values())


@pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")
def test_ease_on_all_items_of_the_smallest_tables(spark):
    from quillon.plans.data import pos_history

    h = pos_history(spark, DIR)
    pairs = {(r.user_id, r.item_id) for r in h.select("user_id", "item_id").collect()}
    want = dense(pairs, 500.0, 10_000)
    got = {(r.item_id, r.related_id): r.score for r in ease(h, k=10_000).collect()}
    assert all(abs(got.get(e, 0) - want.get(e, 0)) < 1e-6 for e in set(got) | set(want))
    assert {i for i, _ in got} == {i for _, i in pairs}


@pytest.mark.parametrize("tile,columns", [(1 << 20, 1 << 22), (60, 64)])
def test_ease_of_many_components_is_the_dense_inverse(spark, tile, columns):
    """Twelve groups of users and items, a chain of items and single ones."""
    rng = random.Random(9)
    pairs = {(100 * g + u, 50 * g + i) for g in range(12) for u in range(20) for i in rng.sample(range(9), 4)}
    pairs |= {(5000 + j, 2000 + j + e) for j in range(30) for e in (0, 1)} | {(6000 + j, 3000 + j) for j in range(5)}
    df = spark.createDataFrame(sorted(pairs), "user_id long, item_id long").repartition(3)
    got = {(r.item_id, r.related_id): r.score for r in ease(df, lam=20.0, tile=tile, columns=columns).collect()}
    want = dense(pairs, 20.0, 200)
    assert all(abs(got.get(e, 0) - want.get(e, 0)) < 3e-9 for e in set(got) | set(want))
    assert all(i >= 2000 and r >= 2000 or i // 50 == r // 50 for i, r in got)


def test_components_and_parts_of_tiles(tmp_path):
    from quillon.operators.ease import Systems, Tile

    rng = np.random.default_rng(5)
    user, item = rng.integers(0, 40, 150), rng.integers(0, 12, 150)
    item = item + 12 * (user % 4)  # four groups of twelve items
    some = np.unique(np.column_stack([user, item]), axis=0)
    items, place = np.unique(some[:, 1], return_inverse=True)
    for t in range(3):
        own = some[:, 0] % 3 == t
        Tile.write(str(tmp_path), t, some[own, 0], place[own])
    counts, x = np.bincount(place), np.zeros((40, len(items)))
    x[some[:, 0], place] = 1
    systems = Systems([Tile(str(tmp_path), t) for t in range(3)], counts)
    linked = np.linalg.matrix_power(x.T @ x > 0, 12)
    assert (systems.label == linked.argmax(1)).all() and len(set(systems.label)) >= 4
    for columns in (systems.order[:1], systems.order[-2:], systems.order):
        tiles, own = systems.of(columns)
        v = rng.normal(size=(len(own), 3))
        out = np.zeros_like(v)
        for t in tiles:
            t.add_gram(v, out)
        assert np.allclose(out, (x.T @ x)[np.ix_(own, own)] @ v) and set(columns) <= set(own)
        assert len(own) == len(items) if len(columns) == len(items) else len(own) < len(items)


def test_ease_of_nothing(spark):
    assert ease(spark.createDataFrame([], "user_id long, item_id long")).count() == 0
    one = spark.createDataFrame([(1, 5)], "user_id long, item_id long")
    assert ease(one).count() == 0


def test_sums_of_long_runs(monkeypatch):
    from quillon.operators import ease as module

    monkeypatch.setattr(module, "GATHERED", 12)
    rng = np.random.default_rng(0)
    dense_, places, starts = rng.normal(size=(9, 4)), rng.integers(0, 9, 40), np.array([0, 1, 2, 17, 18, 30])
    out = np.zeros((6, 4))
    Sums(places, starts).add(dense_, out, slice(None))
    assert np.allclose(out, [dense_[p].sum(0) for p in np.split(places, starts[1:])])


def held_out(spark, blocks):
    """The area under the curve of a held-out item of each user against items it does not have, and the losses."""
    rng = random.Random(8)
    rows, held = [], []
    for u in range(400):
        own = rng.sample([i for i in range(120) if i % 6 == u % 6 or rng.random() < 0.04], 12)
        rows += [(u, i) for i in own[1:]]
        held.append((u, own[0], set(own)))
    v = bpr.train_bpr(spark.createDataFrame(rows, "user_id long, item_id long").repartition(4), dim=16, epochs=12, blocks=blocks).collect()
    p, q = ({r.id: np.array(r.vec) for r in v if r.kind == kind} for kind in ("user", "item"))
    assert set(p) == {u for u, _ in rows} and set(q) == {i for _, i in rows}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in [*p.values(), *q.values()])
    auc = [np.mean([p[u] @ q[i] > p[u] @ q[j] for j in q if j not in own]) for u, i, own in held if i in q]
    return float(np.mean(auc)), [r.vec[0] for r in sorted((r for r in v if r.kind == "loss"), key=lambda r: r.id)]


def test_strata_learn_as_well_as_one_piece(spark):
    whole, losses = held_out(spark, 1)
    strata, other = held_out(spark, 3)
    assert losses[-1] < 0.8 * losses[0] and other[-1] < 0.8 * other[0]
    assert whole > 0.75 and strata > whole - 0.03


def test_strata_follow_the_size_and_are_repeatable(spark):
    assert bpr.blocks_for(10, 20) == 1 and bpr.blocks_for(10_000_000, 20) == 10 and bpr.blocks_for(10, 1_000_000) == 5
    pairs = spark.createDataFrame([(u, i) for u in range(6) for i in range(6) if u != i] + [(7, i) for i in range(6)], "user_id long, item_id long")
    run = lambda: sorted((r.kind, r.id, tuple(r.vec)) for r in bpr.train_bpr(pairs, dim=4, epochs=2, blocks=2).collect())
    assert run() == run()
    assert bpr.train_bpr(pairs.limit(0)).count() == 0


def test_rounds_leave_no_old_vectors(spark):
    """However many rounds, what lies in the folder is pairs, ids and the last vectors."""
    from pathlib import Path
    from urllib.parse import urlparse

    base = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    pairs = spark.createDataFrame([(u, i) for u in range(60) for i in range(40) if (u * i) % 3], "user_id long, item_id long")

    def left(epochs):
        known = set(base.glob("bpr-*"))
        assert bpr.train_bpr(pairs, dim=32, epochs=epochs, blocks=3).count() == 40 + 26 + epochs  # no multiples of three
        (folder,) = set(base.glob("bpr-*")) - known
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    assert left(4) < 1.1 * left(1)


def test_steps_follow_the_gradient():
    """One step on one triple moves the vectors along the gradient of the loss."""
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(1, 3)), rng.normal(size=(2, 3))
    loss = lambda p, q: float(np.log1p(np.exp(-(p[0] @ (q[0] - q[1])))))
    before = p.copy(), q.copy()
    bpr.bpr_steps(p, q, np.array([0]), np.array([0]), np.array([1.0]), 1, rate=1e-6, reg=0.0, batch=1, rng=np.random.default_rng(0))
    for k, (new, old) in enumerate(zip((p, q), before)):
        for at in np.ndindex(old.shape):
            moved = [x.copy() for x in before]
            moved[k][at] += 1e-5
            assert (new - old)[at] / 1e-6 == pytest.approx(-(loss(*moved) - loss(*before)) / 1e-5, abs=1e-3)


# ---- training in parallel ------------------------------------------------------------


def test_one_parallel_step_is_the_step_on_all_rows(spark):
    """Plain gradient steps, averaged after one batch of each task, against the gradient of all rows in one task."""
    from quillon.operators import parallel

    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(240, 3)), np.array([0.5, -1.0, 2.0])
    rows = spark.createDataFrame([(i, i % 12, *map(float, r), float(r @ w + 0.1 * (i % 3))) for i, r in enumerate(x)], "i long, k int, a double, b double, c double, y double")

    def gradient(p, data, r, rng):
        e = data["x"][r] @ p["w"] + p["t"][data["k"][r], 0] - data["y"][r]
        return float((e * e).sum()), {"w": 2 * data["x"][r].T @ e / len(r), "t": (data["k"][r], 2 * e[:, None] / len(r))}

    def model(tables):
        init = lambda: {"w": np.zeros(3), "t": np.zeros((12, 1))}
        encode = lambda t: {"x": np.column_stack([t[c].to_numpy() for c in "abc"]).reshape(-1, 3), "k": t["k"].to_numpy(), "y": t["y"].to_numpy()}
        return parallel.Model(init, encode, gradient, lambda p: parallel.Sgd(p, 0.1), tables)

    run = lambda tasks, tables=(), **o: parallel.train(rows, ("i",), model(tables), tasks=tasks, **o)
    one, many = (run(t, epochs=1, batch=1000, syncs=1) for t in (1, 3))
    for name in ("w", "t"):
        # tasks weigh as many rows as they have
        assert np.allclose(one.params()[name], many.params()[name], atol=1e-6)
    assert many.losses[0] == pytest.approx(one.losses[0], abs=1e-6)
    longer = run(3, ("t",), epochs=40, batch=20, syncs=2)
    assert longer.losses[-1] < 0.05 * longer.losses[0] and np.allclose(longer.params()["w"], w, atol=0.1)
    again = run(3, ("t",), epochs=3, batch=20, syncs=2)
    assert again.losses == run(3, ("t",), epochs=3, batch=20, syncs=2).losses


def test_rows_used_by_one_task_keep_its_change():
    import tempfile
    import threading

    from quillon.operators.parallel import Peers

    folder, out = tempfile.mkdtemp(), {}

    def task(rank):
        before = {"table": np.zeros((3, 2)), "dense": np.ones(2)}
        p = {k: v.copy() for k, v in before.items()}
        p["table"][rank] += 4.0  # rows 0 and 1 are used by one task each
        p["dense"] += rank
        uses = {"table": np.array([2.0 * (rank == 0), 3.0 * (rank == 1), 0])}
        Peers(folder, rank, 2).combine(p, before, uses, 1.0 + 2 * rank)
        out[rank] = p

    threads = [threading.Thread(target=task, args=(r,)) for r in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    for p in out.values():
        assert p["table"].tolist() == [[4, 4], [4, 4], [0, 0]] and p["dense"].tolist() == [1.75, 1.75]


def test_models_are_exchanged_in_pieces(monkeypatch, tmp_path):
    """The same means, bit for bit, and never more than two pieces of each task in the folder."""
    from concurrent.futures import ThreadPoolExecutor

    from quillon.operators import parallel

    rng = np.random.default_rng(5)
    before = {"table": rng.normal(size=(1000, 8)), "dense": rng.normal(size=(40, 3)), "bias": rng.normal(size=5)}
    after = [{k: p + rng.normal(size=p.shape) for k, p in before.items()} for _ in range(2)]
    used = [{"table": rng.integers(0, 3, 1000).astype(float)} for _ in range(2)]

    def run(piece):
        monkeypatch.setattr(parallel, "PIECE", piece)
        folder, most = tmp_path / str(piece), []

        def one(rank):
            mine = {k: p.copy() for k, p in after[rank].items()}
            peers, total = parallel.Peers(str(folder), rank, 2), parallel.Peers.total
            peers.total = lambda values: (total(peers, values), most.append(sum(f.stat().st_size for f in folder.glob("*.npy") if f.exists())))[0]
            peers.combine(mine, before, used[rank], 2.0 + rank)
            return mine

        with ThreadPoolExecutor(2) as pool:
            return list(pool.map(one, range(2))), max(most)

    (whole, all_at_once), (pieces, some) = run(1 << 22), run(256)
    for a, b in zip(whole, pieces):
        assert all((a[k] == b[k]).all() for k in before)
    assert some < all_at_once / 4


def test_files_go_before_anybody_ends_a_step(tmp_path):
    """While one task is done with a step, another that still reads it removes no file."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    from quillon.operators import parallel

    first_done, looked = Event(), Event()

    def one(rank):
        peers = parallel.Peers(str(tmp_path), rank, 2)
        if rank == 1:
            wait = peers._wait

            def slow(name):
                out = wait(name)
                if name == "2-sum-1":  # its last read of the second step
                    first_done.wait(20)
                    assert looked.wait(20)
                return out

            peers._wait = slow
        peers.total(np.ones(4))
        peers.total(np.ones(4))
        if rank == 0:
            before = sorted(f.name for f in tmp_path.glob("*.npy"))
            first_done.set()
            looked.set()
            return before

    with ThreadPoolExecutor(2) as pool:
        names = list(pool.map(one, range(2)))[0]
    assert not [n for n in names if n.startswith("1-")]


def test_training_holds_one_model(monkeypatch, tmp_path):
    """The model before a step and the best one are no copies in memory; the best is what comes back."""
    import tracemalloc
    from concurrent.futures import ThreadPoolExecutor

    from quillon.operators import parallel

    monkeypatch.setattr(parallel, "PIECE", 1 << 14)
    shape = (1 << 14, 64)
    model = parallel.Model(
        lambda: {"t": np.zeros(shape)}, lambda t: {}, lambda p, data, r, rng: (0.0, {"t": (np.zeros(1, int), np.ones((1, 64)))}),
        lambda p: parallel.Sgd(p, 1.0), ("t",), lambda p, data, r: 2.0 + p["t"][0, 0] ** 2 - 3 * abs(p["t"][0, 0]) + 1,
    )
    one = lambda rank: parallel.fit(model, {"_held": np.arange(40) % 2 == 0}, parallel.Peers(str(tmp_path), rank, 2), epochs=4, batch=100, syncs=1, patience=9, seed=1)
    tracemalloc.start()
    with ThreadPoolExecutor(2) as pool:
        (params, losses), _ = pool.map(one, range(2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = int(np.argmin(losses))
    assert params["t"][0, 0] == -(best + 1) and not params["t"][1:].any()
    assert most < 1.7 * 2 * params["t"].nbytes


def test_two_tower_gradient():
    from quillon.operators import factors

    rng = np.random.default_rng(4)
    p = {"input": rng.normal(size=(6, 3)), "output": rng.normal(size=(6, 3))}
    data = {"flat": np.array([0, 1, 1, 2, 5], np.int32), "starts": np.array([0, 2, 3, 5]), "target": np.array([3, 4, 0]), "cdf": np.cumsum(np.full(6, 1 / 6))}
    run = lambda: factors.two_tower_gradient(p, data, np.array([2, 0, 1]), np.random.default_rng(0), 4)
    _, g = run()
    for k in p:
        dense_ = np.zeros_like(p[k])
        np.add.at(dense_, g[k][0], g[k][1])
        for at in np.ndindex(dense_.shape):
            old = p[k][at]
            p[k][at] = old + 1e-6
            up = run()[0]
            p[k][at] = old - 1e-6
            assert dense_[at] == pytest.approx((up - run()[0]) / 2e-6, abs=1e-4)
            p[k][at] = old


def test_two_tower_in_several_tasks(spark):
    """Items of one group come together, in one task and in three."""
    from quillon.operators import factors

    rng = np.random.default_rng(9)
    rows = [(u, j, *(lambda x: (x[:4], x[4]))((8 * (u % 3) + rng.permutation(8)[:5]).tolist())) for u in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "user_id long, pos long, context array<long>, target long")
    for tasks in (1, 3):
        v = {r.item_id: np.array(r.vec) for r in factors.train_two_tower(df, dim=8, epochs=10, batch=16, tasks=tasks).collect()}
        assert set(v) == set(range(24)) and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
        same = np.mean([v[a] @ v[b] for a in v for b in v if a < b and a // 8 == b // 8])
        assert same > 0.25 + np.mean([v[a] @ v[b] for a in v for b in v if a // 8 != b // 8])
