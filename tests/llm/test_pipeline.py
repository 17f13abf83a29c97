import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.decontaminate import find_hits
from quillon.llm.ngram_jaccard import similarity_join


def test_stages(spark, corpus, tmp_path):
    text = dict(corpus)
    rows = [(d, t, "en", "src", len(t or "")) for d, t in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    item = next(t for t in text.values() if t and 60 < len(t.split()) < 300)
    spark.createDataFrame([(1, " ".join(item.split()[5:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left.append(docs.count())
    assert left[0] > left[2] > left[3] > 0 and left[0] == left[1]
    kept = spark.read.parquet(f"{tmp_path}/3")
    assert kept.filter("text = ''").count() <= 1  # documents that lose all their lines are copies of each other
    assert similarity_join(kept).filter("class_id <> doc_id").count() == 0
    assert find_hits(kept, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).filter("size(spans) > 0").count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    ran = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()
    assert sum(r.length for r in ran) == sum(want.values())


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null keys and texts, repeated rows, and columns named like the operators' own."""
    import random

    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(120))
    item = "one two three four five six seven eight nine ten eleven"
    a, b, c = prose(), prose(), prose()
    rows = [(None, a), (None, None), (1, b), (1, b), (2, b + " more"), (3, c + " " + item), (4, ""), (5, c), (None, c + " " + item)]
    names = "n_words kept n_lines n_dropped word_chars top_2 _gone node class_id key _row spans n text_ documents_0 tree".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in names)
    docs = spark.createDataFrame([(k, t, "en", "s", -1, *([i] * len(names))) for i, (k, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = {"quality rules": {0, 2, 3, 4, 5, 7, 8}, "line dedup": set(range(9)), "n-gram Jaccard join": {0, 1, 2, 3, 7, 8}, "benchmark decontamination": {0, 1, 2, 3, 4, 6, 7}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        if name == "n-gram Jaccard join":  # c with and without the item is one group: its least key is a row's null key
            assert {r.n_words for r in got} >= {0, 1, 8} and len(got) < len(rows)
        else:
            assert {r.n_words for r in got} == stay[name], name
        for r in got:
            assert all(r[x] == r.n_words for x in names) and r.doc_id == rows[r.n_words][0]
            assert r.text == (rows[r.n_words][1] or ("" if name == "line dedup" else rows[r.n_words][1]))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows) and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), str(tmp_path)).count() == 0
