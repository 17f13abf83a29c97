"""Nulls, empty tables, repeated rows, clashing column names: no crash, and the defined results."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, kneser_ney, langid, line_dedup, ngram_jaccard, packing, pii, quality, rans, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def bench(df):
    return df.select(F.col("doc_id").alias("item_id"), "text").limit(3)


def labels(df):
    return df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


OPERATORS = {
    "jaccard": ngram_jaccard.similarity_join,
    "pii": pii.find_pii,
    "lines": line_dedup.dedup_lines,
    "kneser-ney": lambda df: kneser_ney.score_texts(df, kneser_ney.train(df)),
    "toxicity": lambda df: toxicity.score_toxicity(df, df, labels(df)),
    "decontaminate": lambda df: decontaminate.find_hits(df, bench(df)),
    "quality": quality.quality_rules,
    "langid": lambda df: langid.identify(df, df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))),
    "rans": lambda df: rans.read_tokens(rans.write_tokens(df, PATH)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def by_text(docs, answer, *columns):
    """The different answers for each text, rows paired by key; keys that are null or repeat are left out."""
    keys = docs.groupBy("doc_id").count().filter("doc_id is not null and count = 1").select("doc_id")
    texts = docs.join(keys, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    out = {}
    for r in answer.select("doc_id", *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]).join(texts, "doc_id").collect():
        out.setdefault(r["_text"], set()).add(tuple(str(r[f"_{i}"]) for i in range(len(columns))))
    return out


VALUES = {
    "quality": ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "kneser-ney": ("n_tokens", "n_known", "train_tokens", "base_score", "score"),
    "toxicity": ("score", "predicted"),
    "langid": ("lang_pred", "score"),
    "pii": ("spans",),
    "decontaminate": ("n_words", "spans", "items"),
}


@pytest.mark.parametrize("name", VALUES)
def test_equal_texts_have_equal_answers(docs, name):
    """Copies, null and empty texts among them, are answered alike."""
    answers = by_text(docs, OPERATORS[name](docs), *VALUES[name])
    assert len(answers) > 20 and all(len(v) == 1 for v in answers.values())


def test_values_of_null_and_empty_texts(odd):
    none = lambda name, *columns: {tuple(r) for r in OPERATORS[name](odd.filter("text is null or text = ''")).select(*columns).collect()}
    assert none("quality", "n_words", "n_symbols", "base_failed", "kept") == {(0, 0, True, False)}
    assert {r.n_tokens for r in OPERATORS["kneser-ney"](odd).filter("doc_id = 0").collect()} == {1}
    assert {(r.lang_pred, r.score) for r in OPERATORS["langid"](odd).filter("doc_id = 0").collect()} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in OPERATORS["toxicity"](odd).collect())
    assert none("pii", F.size("spans")) == {(0,)} and none("decontaminate", "n_words", F.size("spans"), F.size("items")) == {(0, 0, 0)}


def test_token_files_of_odd_rows(odd):
    """Ascending keys, null first; the places follow one another and copies have the same ids."""
    rows = sorted(OPERATORS["rans"](odd).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    keys = [r.key for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len({(r.n_tokens, r.ids_crc32) for r in rows if r.key == 3}) <= 3  # doc 3 of the corpus, and its namesakes


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, PATH).collect()
    assert sum(r.start == 0 for r in rows) == odd.count() and sum(r.doc_id is None for r in rows) >= 2
    assert packing.pack_documents(empty, PATH).count() == 0


def test_own_columns_pass_through(odd):
    kept = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(kept.columns) and kept.filter("node = 1").count() == odd.count()
    judged = quality.quality_rules(odd)
    assert set(odd.columns) <= set(judged.columns)


def test_null_keys_and_copies(odd):
    rows = ngram_jaccard.similarity_join(odd).collect()
    twice = [r for r in rows if r.doc_id == 3 and r.n_copies == 2]
    assert len(twice) == 2 and all(r.class_id is None or r.class_id <= 3 for r in twice)
    assert any(r.doc_id is None for r in rows)


def test_all_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "doc_id long, text string")
    for name, f in OPERATORS.items():
        assert f(df).count() == 3, name
    assert [r.text for r in line_dedup.dedup_lines(df).collect()] == ["", "", ""]
    assert {r.class_id for r in ngram_jaccard.similarity_join(df).collect()} == {1}
    assert {r.lang_pred for r in langid.identify(df, df.withColumn("lang", F.lit("en"))).collect()} == {"und"}


@pytest.mark.parametrize("span", ["JOHN (AT) EXAMPLE (DOT) COM", "JOHN AT EXAMPLE DOT COM", "John [At] example.com"])
def test_obfuscated_mail_is_found_in_texts_of_any_length(span):
    for n in (10, (1 << 16) - 1, 1 << 16, 1 << 18):
        text = ("word " * n)[:n] + "; " + span
        assert (n + 2, 0, n + 2 + len(span), False) in pii.candidates(text)
