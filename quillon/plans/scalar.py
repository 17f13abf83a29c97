"""Queries: scalar functions, each over a table of the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import factors
from quillon.plans.data import D, rated_items, rsql
from quillon.plans.registry import query
from quillon.sources.tables import interactions, items, sql, table, users


def half_star_sql(x: str) -> str:
    return f"printf('%.1f', round_even(CAST({x} AS DOUBLE) * 2, 0) / 2)"


def steps_sql(x: str, steps: list[tuple[int, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {n} THEN '{name}'" for n, name in steps) + f" ELSE '{last}' END"


#: A text column with years, missing marks and lists, made from orders.
RAW = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '\\N' WHEN 1 THEN '' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN ' 12.5 ' WHEN 4 THEN 'nan' ELSE 'x7' END AS t,
    o_orderpriority || ' (' || CAST(1900 + o_orderkey % 120 AS VARCHAR) || ')' AS title, o_orderstatus || '| ' || o_orderpriority || ',,' || CASE WHEN o_orderkey % 2 = 0 THEN '\\N' ELSE 'z' END AS parts FROM orders"""


def raw(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 6 == 0, "\\N").when(k % 6 == 1, "").when(k % 6 == 2, k.cast("string")).when(k % 6 == 3, " 12.5 ").when(k % 6 == 4, "nan").otherwise("x7")
    parts = F.concat("o_orderstatus", F.lit("| "), "o_orderpriority", F.lit(",,"), F.when(k % 2 == 0, "\\N").otherwise("z"))
    return table(spark, d, "orders").select(k.alias("id"), t.alias("t"), F.concat("o_orderpriority", F.lit(" ("), (k % 120 + 1900).cast("string"), F.lit(")")).alias("title"), parts.alias("parts"))


@query("x01_clean_title", sql("SELECT id, trim(regexp_replace(title, '\\s*\\(\\d{4}\\)\\s*$', '')) AS title FROM raw", raw=RAW))
def x01(spark, d):
    return raw(spark, d).select("id", S.clean_title(F.col("title")).alias("title"))


@query("x02_title_year", sql("SELECT id, CAST(nullif(regexp_extract(title, '\\((\\d{4})\\)\\s*$', 1), '') AS INTEGER) AS year FROM raw", raw=RAW))
def x02(spark, d):
    return raw(spark, d).select("id", S.title_year(F.col("title")).alias("year"))


_FLOAT = "CASE WHEN trim(t) IN ('', '\\N', 'nan', 'None') THEN NULL ELSE TRY_CAST(trim(t) AS DOUBLE) END"


@query("x03_null_folding", sql(f"SELECT id, CAST(trunc({_FLOAT}) AS BIGINT) AS i, {_FLOAT} AS f, CASE WHEN trim(t) IN ('', '\\N', 'nan', 'None') THEN NULL ELSE trim(t) END AS s FROM raw", raw=RAW))
def x03(spark, d):
    c = F.col("t")
    return raw(spark, d).select("id", S.as_int(c).alias("i"), S.as_float(c).alias("f"), S.null_fold(c).alias("s"))


@query("x04_quote_doubling", "SELECT c_custkey, replace(c_name || '''s', '''', '''''') AS stored, c_name || '''s' AS shown FROM customer")
def x04(spark, d):
    c = table(spark, d, "customer").withColumn("n", F.concat("c_name", F.lit("'s")))
    return c.select("c_custkey", S.double_quotes(F.col("n")).alias("stored"), S.undouble_quotes(S.double_quotes(F.col("n"))).alias("shown"))


@query("x05_split_genres", sql("SELECT id, array_to_string([trim(x) FOR x IN regexp_split_to_array(parts, '[|,]') IF trim(x) <> ''], '/') AS parts FROM raw", raw=RAW))
def x05(spark, d):
    return raw(spark, d).select("id", F.array_join(S.split_list(F.col("parts")), "/").alias("parts"))


@query("x06_split_ids", sql("SELECT id, array_to_string([trim(x) FOR x IN string_split(parts, ',') IF trim(x) <> '' AND trim(x) <> '\\N'], '/') AS parts FROM raw", raw=RAW))
def x06(spark, d):
    return raw(spark, d).select("id", F.array_join(S.split_ids(F.col("parts")), "/").alias("parts"))


@query("x07_bin_year", sql("SELECT item_id, CASE WHEN y IS NULL OR y = 0 THEN 'Unknown' WHEN y < 1950 THEN 'pre-1950' ELSE CAST(y // 10 * 10 AS VARCHAR) || 's' END AS bin FROM (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN 0 ELSE year - item_id % 60 END AS y FROM items)"))
def x07(spark, d):
    y = F.when(F.col("item_id") % 9 == 0, 0).otherwise(F.col("year") - F.col("item_id") % 60)
    return items(spark, d).select("item_id", S.bin_year(y).alias("bin"))


@query("x08_bin_avg_rating", rsql(f"SELECT item_id, CASE WHEN avg_rating IS NULL OR avg_rating <= 0 THEN 'Unknown' ELSE {half_star_sql('avg_rating')} END AS bin FROM rated_items"))
def x08(spark, d):
    return rated_items(spark, d).select("item_id", S.bin_avg_rating(F.col("avg_rating")).alias("bin"))


_COUNT = [(0, "0"), (5, "1-5"), (20, "6-20"), (50, "21-50"), (100, "51-100"), (200, "101-200"), (500, "201-500")]
_DAYS = [(0, "0"), (7, "1-7"), (30, "8-30"), (90, "31-90"), (180, "91-180"), (365, "181-365")]
_VOTES = [(100, "1-100"), (1000, "101-1K"), (10000, "1K-10K"), (100000, "10K-100K"), (500000, "100K-500K")]
_AGES = [(17, "under18"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (49, "45-49"), (55, "50-55")]


@query("x09_bin_rating_count", f"SELECT o_orderkey, CASE WHEN v < 0 THEN 'Unknown' ELSE {steps_sql('v', _COUNT, '501+')} END AS bin FROM (SELECT o_orderkey, o_orderkey % 700 - 5 AS v FROM orders)")
def x09(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.bin_rating_count(F.col("o_orderkey") % 700 - 5).alias("bin"))


@query("x10_bin_active_days", f"SELECT o_orderkey, CASE WHEN v < 0 THEN 'Unknown' ELSE {steps_sql('floor(v)', _DAYS, '365+')} END AS bin FROM (SELECT o_orderkey, (o_orderkey % 500 - 3) * 1.25 AS v FROM orders)")
def x10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.bin_active_days((F.col("o_orderkey") % 500 - 3) * 1.25).alias("bin"))


@query("x11_bin_rating_deviation", f"SELECT o_orderkey, replace({half_star_sql('(o_orderkey % 41 - 20) / 8.0')}, '-0.0', '0.0') AS bin FROM orders")
def x11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.bin_rating_deviation((F.col("o_orderkey") % 41 - 20) / 8.0).alias("bin"))


@query("x12_bin_imdb_votes", f"SELECT o_orderkey, CASE WHEN v <= 0 THEN 'Unknown' ELSE {steps_sql('floor(v)', _VOTES, '500K+')} END AS bin FROM (SELECT o_orderkey, o_totalprice * 2 - 1000 AS v FROM orders)")
def x12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.bin_imdb_votes(F.col("o_totalprice") * 2 - 1000).alias("bin"))


@query("x13_bucket_age", f"SELECT c_custkey, CASE WHEN a IS NULL OR a <= 0 THEN 'unknown' ELSE {steps_sql('a', _AGES, '56+')} END AS bin FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey % 70 END AS a FROM customer)")
def x13(spark, d):
    a = F.when(F.col("c_custkey") % 10 == 9, "n/a").otherwise((F.col("c_custkey") % 70).cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.bucket_age(a).alias("bin"))


@query("x14_first_or_unknown", sql("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'Unknown' ELSE genres[1] END AS genre FROM items"))
def x14(spark, d):
    g = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("genres"))
    return items(spark, d).select("item_id", S.first_or_unknown(g).alias("genre"))


_N = "sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]))"


@query("x15_l2_normalise", f"SELECT vec_id, round(embedding[3] / {_N}, 6) AS x2, round(embedding[60] / {_N}, 6) AS x59 FROM embeddings")
def x15(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", S.l2(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(2)), 6).alias("x2"), F.round(F.get("v", F.lit(59)), 6).alias("x59"))


@query("x16_dot_product", "SELECT a.vec_id, round(list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] FOR i IN range(1, 65)]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x16(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("b")), 6).alias("dot"))


@query("x17_min_max", sql("SELECT item_id, round((coalesce(v, mid) - lo) / (hi - lo), 9) AS scaled, 0.0::DOUBLE AS flat FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE imdb_votes END AS v FROM items), (SELECT min(imdb_votes) AS lo, max(imdb_votes) AS hi, median(imdb_votes) AS mid FROM items WHERE item_id % 7 <> 0)"))
def x17(spark, d):
    v = items(spark, d).select("item_id", F.when(F.col("item_id") % 7 != 0, F.col("imdb_votes")).alias("v"))
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.median("v").alias("mid"))
    full = v.crossJoin(F.broadcast(b)).withColumn("v", F.coalesce("v", "mid"))
    return full.select("item_id", F.round(S.min_max(F.col("v"), F.col("lo"), F.col("hi")), D).alias("scaled"), S.min_max(F.col("v"), F.col("lo"), F.col("lo")).alias("flat"))


@query("x18_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-least(greatest(c_acctbal / 100, -30.0), 30.0))), 9) AS p FROM customer")
def x18(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.sigmoid(F.col("c_acctbal") / 100), D).alias("p"))


@query("x19_log_weights", "SELECT o_orderkey, round(ln(1 + o_orderkey), 9) AS a, round(1 / log2(o_orderkey + 2.0), 9) AS b, round(sqrt(o_orderkey), 9) AS c, round(pow(o_orderkey, 0.25), 9) AS e FROM orders")
def x19(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log1p(k), D).alias("a"), F.round(1 / F.log2(k + 2.0), D).alias("b"), F.round(F.sqrt(k), D).alias("c"), F.round(F.pow(k, F.lit(0.25)), D).alias("e"))


@query("x20_ucb", "SELECT o_orderkey, CASE WHEN n > 0 THEN round(r / n + sqrt(2 * ln(100) / n), 9) ELSE -1 END AS ucb FROM (SELECT o_orderkey, o_orderkey % 9 AS n, o_orderkey % 9 * 6.4 AS r FROM orders)")
def x20(spark, d):
    n = F.col("o_orderkey") % 9
    return table(spark, d, "orders").select("o_orderkey", F.when(n > 0, F.round(S.ucb(n, n * 6.4), D)).otherwise(-1.0).alias("ucb"))


@query("x21_weight_string", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 3.0::DOUBLE WHEN 1 THEN p_size * 2.0::DOUBLE ELSE p_size * 1.0::DOUBLE END AS weighted FROM part")
def x21(spark, d):
    """Weights of a string, used on rows; names without one weigh 1."""
    w = S.parse_weights("a=1,b=2,bad,c=x,a=3")
    name = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("bad"), F.lit("c")), (F.col("p_size") % 4 + 1).cast("int"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in w.items() for x in pair]), name), F.lit(1.0))
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * weight).alias("weighted"))


@query("x22_live_popularity", rsql("SELECT item_id, round(coalesce(avg_rating, 0) * ln(1 + coalesce(rating_count, 0)), 9) AS score FROM rated_items"))
def x22(spark, d):
    return rated_items(spark, d).select("item_id", F.round(S.live_popularity(F.col("avg_rating"), F.col("rating_count")), D).alias("score"))


@query("x23_preferred_genres", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'red/blue' ELSE c_mktsegment END AS genres FROM customer")
def x23(spark, d):
    frequent = F.when(F.col("c_custkey") % 2 == 0, "red, blue,").otherwise("")
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.preferred(frequent, F.array("c_mktsegment")), "/").alias("genres"))


@query("x24_token_codec", "SELECT c_custkey, base64((CAST(c_custkey AS VARCHAR) || ':1700000000000')::BLOB) AS token, c_custkey AS id FROM customer")
def x24(spark, d):
    token = F.base64(F.concat(F.col("c_custkey").cast("string"), F.lit(":1700000000000")).cast("binary"))
    back = F.get(F.split(F.unbase64(token).cast("string"), ":"), F.lit(0)).cast("bigint")
    return table(spark, d, "customer").select("c_custkey", token.alias("token"), back.alias("id"))


@query("x25_history_to_long", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) || '/7' ELSE CAST(c_custkey AS VARCHAR) END AS items FROM customer")
def x25(spark, d):
    values = F.array(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "7").otherwise("bad"), F.lit(None).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(S.longs(values), lambda x: x.cast("string")), "/").alias("items"))


@query("x26_float_or_nan", sql(f"SELECT id, {_FLOAT} IS NULL AS is_nan, coalesce({_FLOAT}, 0) AS v FROM raw", raw=RAW))
def x26(spark, d):
    v = S.float_or_nan(F.col("t"))
    return raw(spark, d).select("id", F.isnan(v).alias("is_nan"), F.when(F.isnan(v), 0.0).otherwise(v).alias("v"))


@query("x27_safe_numbers", sql(f"SELECT id, CAST(trunc(coalesce({_FLOAT}, 0)) AS BIGINT) AS i, coalesce({_FLOAT}, 0) AS f FROM raw", raw=RAW))
def x27(spark, d):
    return raw(spark, d).select("id", S.safe_int(F.col("t")).alias("i"), S.safe_float(F.col("t")).alias("f"))


@query("x28_array_literal", sql("SELECT item_id, array_to_string(genres, '/') AS a, array_to_string(genres, '/') AS b FROM items"))
def x28(spark, d):
    braces = F.concat(F.lit("{"), F.array_join("genres", ", "), F.lit(", }"))
    return items(spark, d).select("item_id", F.array_join(S.array_literal(braces), "/").alias("a"), F.array_join(S.array_literal(F.array_join("genres", ",")), "/").alias("b"))


@query("x29_first_seen_vocabulary", sql("SELECT value, code FROM (SELECT occupation AS value, row_number() OVER (ORDER BY min(user_id), occupation) AS code FROM users GROUP BY 1) UNION ALL SELECT 'unknown', 0"))
def x29(spark, d):
    return factors.category_vocabulary(users(spark, d), "occupation")


@query("x30_user_mean_label", sql("SELECT user_id, item_id, CASE WHEN rating >= avg(rating) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS click FROM interactions"))
def x30(spark, d):
    from quillon.operators.ranking import label

    return label(interactions(spark, d), relative=True).select("user_id", "item_id", "click")
