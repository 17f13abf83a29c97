import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog_ops as C
from quillon.operators import search
from quillon.sources import columns, npy, sinks
from quillon.sources.paths import resolve_data_dir
from quillon.streaming import feedback


def test_resolve_data_dir(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
    with pytest.raises(FileNotFoundError):
        resolve_data_dir(spark, f"file://{tmp_path}")
    for f in ("lineitem.parquet", "orders.parquet"):
        (tmp_path / "b" / f).touch()
    assert resolve_data_dir(spark, f"file://{tmp_path}").endswith("/b")


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], "UserID int, Movie_Id int, Time int")
    assert columns.normalise(df).columns == ["user_id", "item_id", "ts"]
    assert [r.ts for r in columns.fill_ts(spark.createDataFrame([(1, 5), (1, 3)], "user_id long, item_id long")).orderBy("item_id").collect()] == [0, 1]


@pytest.mark.parametrize("version", [(1, 0), (2, 0), (3, 0)])
def test_npy(spark, tmp_path, version):
    def write(name, a):
        buf = io.BytesIO()
        np.lib.format.write_array(buf, a, version=version)
        (tmp_path / name).write_bytes(buf.getvalue())
        return f"file://{tmp_path}/{name}"

    m = write("m.npy", np.arange(6.0).reshape(3, 2))
    k = write("k.npy", np.array([7, 8, 9]))
    assert {r.item_id: r.vec for r in npy.read_vectors(spark, m, k).collect()} == {7: [0.0, 1.0], 8: [2.0, 3.0], 9: [4.0, 5.0]}
    with pytest.raises(ValueError):
        npy.read_vectors(spark, write("f.npy", np.asfortranarray(np.ones((3, 2)))), k)
    with pytest.raises(ValueError):
        npy.read_vectors(spark, m, write("short.npy", np.array([7])))


def test_npy_files_of_tasks(spark, tmp_path):
    """Written by several tasks, read by ranges that do not fit the files."""
    rows = [(i, [float(i), i / 7, -1.0]) for i in range(100)]
    files = npy.write_vectors(spark.createDataFrame(rows, "item_id long, vec array<double>").repartition(3), f"file://{tmp_path}/out")
    assert files.count() == 3
    assert sorted((r.item_id, r.vec) for r in npy.read_pairs(files, rows=9).collect()) == rows
    assert npy.header(files.first()["matrix"])[0] == "<f8"


def test_edges_csv_drops_malformed_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("movie_id,related,rank,score\n1,2,5,0.5\n1,3,1,0.9\nbad\n1,x,1,0.1\n")
    rows = sinks.read_edges(spark, f"file://{tmp_path}/e.csv").orderBy("rank").collect()
    assert [(r.related_id, r.rank, r.score) for r in rows] == [(3, 1, 0.9), (2, 2, 0.5)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, u string, v string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "id int, u string, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, "id", keep_old=("v",)).collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", "w")]
    assert sorted(map(tuple, sinks.merge_profile(old, new, "id").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "w")]
    twice = new.unionByName(spark.createDataFrame([(3, "zz", "later")], "id int, u string, v string"))
    assert sorted(map(tuple, sinks.insert_absent(old, twice, ["id"], "u").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "w")]
    assert sinks.load_vectors(spark, "file:///nowhere") is None


def test_crew_order_and_missing_names(spark):
    crew = spark.createDataFrame([(1, ["n2", "n1", "n9"]), (2, [])], "title_id long, d array<string>")
    names = spark.createDataFrame([("n1", "One"), ("n2", "Two")], "person_id string, name string")
    assert {r.title_id: r.names for r in C.crew_names(crew, names, "d").collect()} == {1: ["Two", "One", "n9"], 2: []}


def test_search(spark):
    docs = spark.createDataFrame([(1, "Toy Story", "a toy"), (2, "Heat", "crime"), (3, "Toys", None)], "id long, title string, description string")
    index = search.write_index(docs, "id", "title", "description")
    assert [r.id for r in index.search("TOY").collect()] == [1]
    assert index.search("xyzzy").count() == 0
    path = search.write_titles(docs, "id", "title")
    assert [r.id for r in search.suggest(spark, path, "id", "title", "to").collect()] == [1, 3]
    assert search.suggest(spark, path, "id", "title", "zz").count() == 0 and search.suggest(spark, path, "id", "title", "").count() == 3


def test_search_skips_buckets_and_finds_the_same(spark):
    """Against scoring every document; a common word with a rare one leaves most buckets unread."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(1, 90)))) for i in range(600)]
    rows[17] = (17, "rare rare the")
    rows += [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = search.write_index(docs, "id", "text", bucket=10)
    n, words = len(rows), {i: (t or "").split() for i, t in rows}
    total = sum(map(len, words.values()))
    for query, k in (("the rare", 5), ("of w3 w7 w7", 10), ("the", 700), ("nothing", 3)):
        want = {}
        for t in sorted(set(query.split())):
            df = sum(t in w for w in words.values())
            for i, w in words.items():
                if tf := w.count(t):
                    want[i] = want.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) * n / total))
        want = sorted(((-round(s, 9), i) for i, s in want.items()))[:k]
        found, buckets = index.search_buckets(query, k=k)
        assert [(i, pytest.approx(-s, abs=2e-9)) for s, i in want] == [(r.id, r.score) for r in found.collect()]
        assert query != "the rare" or buckets < 30
    plan = index.postings.filter("token in ('rare')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,rare)" in plan or "In(token" in plan


def test_rows_of_one_document_are_one_in_the_index(spark):
    """Lengths add up as in SQL; a document without a key is counted and not found."""
    docs = spark.createDataFrame([(1, "a b"), (1, "c c c a"), (2, "a"), (None, "a z")], "id long, text string")
    index = search.write_index(docs, "id", "text", bucket=1)
    assert {(r.token, r.df, r.cf) for r in index.dictionary.collect()} == {("a", 3, 4), ("b", 1, 1), ("c", 1, 3), ("z", 1, 1)}
    idf, share = math.log(1 + (4 - 3 + 0.5) / 3.5), lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * 4 / 9))
    assert {r.id: r.score for r in index.search("a").collect()} == {1: pytest.approx(idf * share(2, 6), abs=2e-9), 2: pytest.approx(idf * share(1, 1), abs=2e-9)}
    assert index.search("z").count() == 0


EVENTS = "event_id long, user_id long, item_id long, rating int, ts timestamp"


def test_counters_follow_changes(spark):
    rows = [(1, 1, 7, 5, "2024-01-01 00:00:01"), (2, 1, 7, 8, "2024-01-01 00:00:02"), (3, 1, 7, 8, "2024-01-01 00:00:03"), (4, 1, 8, 2, "2024-01-01 00:00:04")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    g = spark.createDataFrame([(7, "red"), (8, "red")], "item_id long, genre string")
    assert [(r.genre, r.n, r.reward) for r in feedback.counters(e, g).collect()] == [("red", 2, 10)]


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    rows = [(i, i % 5, i % 7, i % 10 + 1, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating int, t string").withColumn("ts", F.to_timestamp("t")).drop("t").select("event_id", "user_id", "item_id", "rating", "ts")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = feedback.RatingStore(f"file://{tmp_path}/ratings")
    store.run(stream, f"{tmp_path}/checkpoint").awaitTermination()
    want = {(r.user_id, r.item_id): (r.rating, r.event_id) for r in feedback.last_ratings(e).collect()}
    assert {(r.user_id, r.item_id): (r.rating, r.event_id) for r in store.current(spark).collect()} == want
    windows = feedback.windowed_counts(e, width="1 minute").collect()
    assert sum(r.n for r in windows) == 200


def test_rating_store_goes_on_after_a_restart(spark, tmp_path):
    """A new process has the folder only; a batch that is run again gives the same version."""
    make = lambda ids: spark.createDataFrame([(i, i % 5, i % 7, i % 10 + 1, f"2024-01-01 00:00:{i:02d}") for i in ids], "event_id long, user_id long, item_id long, rating int, t string").withColumn("ts", F.to_timestamp("t")).select("event_id", "user_id", "item_id", "rating", "ts")
    path = f"file://{tmp_path}/ratings"
    assert feedback.RatingStore(path).current(spark) is None
    feedback.RatingStore(path).merge(make(range(30)), 0)
    for _ in range(2):
        feedback.RatingStore(path).merge(make(range(30, 50)), 1)
        got = {(r.user_id, r.item_id, r.event_id) for r in feedback.RatingStore(path).current(spark).collect()}
        assert got == {(r.user_id, r.item_id, r.event_id) for r in feedback.last_ratings(make(range(50))).collect()}


def actions(spark, n, seed, ts=lambda i: i):
    """Ratings and deletions of few users and items; rating null deletes."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.randrange(5), None if rng.random() < 0.3 else rng.randrange(1, 11), ts(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def replay(rows):
    """The state after all actions in order, and the counters as each action changes them."""
    state, n, reward = {}, {}, {}
    for _, u, i, r, _ in sorted(rows, key=lambda x: (x[4], x[0])):
        for g in (f"g{i % 2}", "all"):
            old = state.get((u, i))
            n[u, g] = n.get((u, g), 0) + (r is not None) - (old is not None)
            reward[u, g] = reward.get((u, g), 0) + (r or 0) - (old or 0)
        state[u, i] = r
        if r is None:
            state.pop((u, i))
    return state, {k: (n[k], reward[k]) for k in n if n[k] > 0}


def genres_of(spark):
    return spark.createDataFrame([(i, g) for i in range(5) for g in (f"g{i % 2}", "all")], "item_id long, genre string")


def test_deleting_takes_counters_and_history_back(spark):
    rows, df = actions(spark, 200, 1)
    state, want = replay(rows)
    assert {(r.user_id, r.genre): (r.n, r.reward) for r in feedback.counters(df, genres_of(spark)).collect()} == want
    current = feedback.last_ratings(df)
    assert {(r.user_id, r.item_id): r.rating for r in current.collect()} == state
    assert {(r.user_id, r.item_id) for r in feedback.histories(current).collect()} == set(state)


def test_keyed_state_ends_where_the_batch_does_after_a_restart(spark, tmp_path):
    """Actions in several batches, some of them late; the stream is stopped and a new store goes on."""
    rows, df = actions(spark, 120, 2, ts=lambda i: i + (37 * i) % 50)
    state, want = replay(rows)
    store = f"file://{tmp_path}/store"
    for part in range(3):
        df.filter(F.col("event_id") % 3 == part).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feedback.FeedbackStore(store, fan=2).run(stream, f"{tmp_path}/checkpoint").awaitTermination()
    end = feedback.FeedbackStore(store, fan=2)
    assert {(r.user_id, r.genre): (r.n, r.reward) for r in end.counters(genres_of(spark)).collect()} == want
    assert {(r.user_id, r.item_id): r.rating for r in end.ratings.current(spark).collect()} == state


def test_log_store_writes_what_a_batch_holds(spark, tmp_path):
    from quillon.streaming.log_store import LogStore

    store = LogStore(f"file://{tmp_path}/log", ("k",), ("v",), gone="gone", fan=3)
    make = lambda b: spark.createDataFrame([(k, b, (k + b) % 11 == 0) for k in range(10 * b, 10 * b + 40)], "k long, v long, gone boolean")
    written, have = [], set()
    for b in range(30):
        store.append(make(b), b)
        if b % 7 == 3:
            store.append(make(b), b)  # comes again
        new = set(store._complete(spark)) - have
        have |= new
        written += [(r, spark.read.parquet(store._name(r)).count()) for r in sorted(new)]
        runs = store.runs(spark)
        assert runs[0][1] == 0 and runs[-1][2] == b and all(x[2] + 1 == y[1] for x, y in zip(runs, runs[1:])) and len(runs) <= 2 * 4
    assert all(n == 40 for (t, *_), n in written if t == 0) and len({r for r, _ in written}) == len(written)
    assert sum(n for _, n in written) < 40 * 30 * 4  # a row is written once for each tier at most
    want = {}
    for b in range(30):
        want |= {k: (b, (k + b) % 11 == 0) for k in range(10 * b, 10 * b + 40)}
    assert {r.k: r.v for r in store.current(spark).collect()} == {k: v for k, (v, gone) in want.items() if not gone}
    assert LogStore(f"file://{tmp_path}/none", ("k",), ("v",)).current(spark) is None


def test_windowed_stream(spark, tmp_path):
    e = spark.createDataFrame([(i, 1, 1, 5, f"2024-01-01 0{i // 20}:{i % 20:02d}:00") for i in range(100)], "event_id long, user_id long, item_id long, rating int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(f"{tmp_path}/in")
    q = feedback.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [20] * 5
