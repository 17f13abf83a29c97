"""The queries of this subpackage and their SQL, by the names in ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bitsliced, decontaminate, kneser_ney, langid, learned_partitions, line_dedup, ngram_jaccard, packing, pii, quality, rans, spelling, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similarity_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS node, count(*) AS n FROM documents GROUP BY 1
), words AS (
  SELECT node, n, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM texts
), grams AS (
  SELECT node, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS g
  FROM words WHERE len(w) > 0
), each AS (SELECT node, unnest(g) AS gram FROM grams),
overlap AS (
  SELECT a.node AS a, b.node AS b, count(*) AS c FROM each a JOIN each b ON a.gram = b.gram AND a.node <> b.node GROUP BY 1, 2
), links AS (
  SELECT a, b FROM overlap JOIN grams x ON x.node = a JOIN grams y ON y.node = b WHERE 10 * c >= 8 * (len(x.g) + len(y.g) - c)
), reach(node, root) AS (
  SELECT node, node FROM texts UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.root
), class AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
counts AS (SELECT a AS node, count(*) AS t, CAST(sum(n) AS BIGINT) AS d FROM links JOIN texts ON texts.node = b GROUP BY 1)
SELECT doc_id, root AS class_id, t.node AS copy_id, t.n AS n_copies, coalesce(c.t, 0) AS n_text_links, coalesce(d, 0) + t.n - 1 AS n_links
FROM documents x JOIN texts t ON t.text = coalesce(x.text, '') JOIN class USING (node) LEFT JOIN counts c USING (node)
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.pos, a.line, (r.k IS NOT NULL AND a.doc_id <> r.keeper) AS dropped
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_covered(F.col("spans"))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_OP7_WORDS = r"""
  SELECT {id} AS id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM {table}
"""
OP7_SQL = f"""
WITH items AS ({_OP7_WORDS.format(id="item_id", table="benchmark")}),
docs AS ({_OP7_WORDS.format(id="doc_id", table="documents")}),
wins AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n,
         unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS win
  FROM items WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM wins),
windows AS (
  SELECT d.id, l.n, unnest(range(1, len(w) - l.n + 2)) AS p0,
         unnest([array_to_string(w[i:i + l.n - 1], ' ') FOR i IN range(1, len(w) - l.n + 2)]) AS win
  FROM docs d, lengths l WHERE len(w) >= l.n
), hits AS (SELECT id, p0, w.n, item_id FROM windows JOIN wins w USING (n, win)),
covered AS (
  SELECT id, count(DISTINCT p) AS n_hit
  FROM (SELECT id, unnest(range(p0, p0 + n)) AS p FROM (SELECT DISTINCT id, p0, n FROM hits)) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY id
)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.id = d.id LEFT JOIN named m ON m.id = d.id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", *quality.SHARES)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.filter(remainder(10) != 0), order=3)
    out = kneser_ney.score_texts(docs, model)
    return out.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, docs.filter(remainder(3) != 1), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = rans.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return rans.read_tokens(shards).withColumnRenamed("key", "doc_id")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, docs.filter(remainder(5) != 0))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = learned_partitions.nearest_neighbours(table(spark, sf_dir, "embeddings"))
    return found


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 is built from its polynomial, byte by byte.
OP12_SQL = r"""
WITH RECURSIVE bits(i, c, step) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (SELECT k, run, count(*) AS c FROM runs GROUP BY 1, 2),
hexed AS (SELECT k, run, c, hex(encode(k || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT k, run, c, xor(list_reduce(list_concat([4294967295::BIGINT], [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(x) // 2)]),
         lambda s, b: xor(t[xor(s & 255, b) + 1], s // 256)), 4294967295::BIGINT) AS h FROM hexed, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, w.word AS near FROM cut c JOIN words w ON w.word = c.d),
pairs AS (
  SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter
  UNION ALL SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS form, max(w.n) AS form_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY 1
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), follow(word, last) AS (
  SELECT word, word FROM words UNION ALL SELECT f.word, x.form FROM follow f JOIN formed x ON x.word = f.last WHERE x.form IS NOT NULL
)
SELECT f.word, f.form, l.last AS root, f.n, f.n_near, f.form_n FROM formed f JOIN follow l ON l.word = f.word JOIN formed e ON e.word = l.last AND e.form IS NULL
"""


def op13_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP13_TERMS = r"""
  SELECT {key}, t AS term, CAST(count(*) AS BIGINT) AS tf FROM (
    SELECT {key}, unnest([x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']) AS t FROM {table}) GROUP BY 1, 2
"""
OP13_SQL = f"""
WITH tfs AS ({_OP13_TERMS.format(key="doc_id", table="documents")}),
asked AS ({_OP13_TERMS.format(key="item_id", table="benchmark")}),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len))) AS x
  FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), total
), scored AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY 1, 2 HAVING sum(x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= 50
"""


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_rans_tokens": op9_rans_tokens,
    "op10_langid": op10_langid,
    "op11_learned_partitions": op11_learned_partitions,
    "op12_spelling": op12_spelling,
    "op13_bitsliced": op13_bitsliced,
}
ORACLE_SQL = {"op1_ngram_jaccard": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_decontaminate": OP7_SQL, "op12_spelling": OP12_SQL, "op13_bitsliced": OP13_SQL}
