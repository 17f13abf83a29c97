"""Registered queries against their SQL on the smallest tables (all of them with QUILLON_ALL=1)."""

import math
import os
from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SOME = """s03_normalize_columns s06_read_edges_csv k01_upsert k02_insert_absent f01_positives f05_genres_or_all j06_range_self_join j10_dot_products j14_crew_names a04_popularity a12_best_with_default
a15_gram w03_dedupe_first w08_left_pad w10_training_pairs o01_best_rated x08_bin_avg_rating x28_array_literal r02_itemcf_sim r06_usercf_sim r15_genre_recall m01_weighted_rrf m02_snake_merge n01_ranking_samples
n04_negative_sampling n05_label_encoding b05_cold_pipeline e01_time_split e03_ndcg e06_auc e07_gauc e09_ranking_metrics t01_keyword_search t02_prefix_suggest
z01_rating_upsert z03_ucb_counters z03_ucb_counters_deletes z03_ucb_counters_stream s08_npy_vectors r09_genre_index r22_user_vector_service m04_live_weights d01_genre_dispersion d03_rerank_chain
k09_encoded_and_vocabulary x21_weight_string""".split()

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")


def catalog():
    from quillon.catalog import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog()[1]) if os.environ.get("QUILLON_ALL") else SOME)
def test_same_rows_as_sql(spark, duck, name):
    queries, oracle = catalog()
    df = queries[name](spark, DIR)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = duck.execute(oracle[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert got == want


def test_names_and_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(catalog()[0]) > 150
