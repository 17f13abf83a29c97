"""Scalar functions of the ranking engine, as column expressions."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_GENRE = "(no genres listed)"


# ---- cleaning ---------------------------------------------------------------


def null_fold(c: Column) -> Column:
    r"""Text with the marks for missing values (empty, ``\N``, nan, None) turned into null."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin("", "\\N", "nan", "NaN", "None"), t)


def as_int(c: Column) -> Column:
    """A whole number; fractions are cut off."""
    return null_fold(c).try_cast("double").try_cast("bigint")


def as_float(c: Column) -> Column:
    v = null_fold(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_int(c: Column) -> Column:
    """An integer, 0 where it is none."""
    return F.coalesce(as_int(c), F.lit(0).cast("bigint"))


def safe_float(c: Column) -> Column:
    return F.coalesce(as_float(c), F.lit(0.0))


def float_or_nan(c: Column) -> Column:
    return F.coalesce(null_fold(c).try_cast("double"), F.lit(float("nan")))


def clean_title(c: Column) -> Column:
    """A title without the year in brackets at its end."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d{4}\)\s*$", ""))


def title_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\((\d{4})\)\s*$", 1).try_cast("int")


def split_list(c: Column, marks: str = "|,") -> Column:
    """Trimmed non-empty parts of a text with separators."""
    pattern = "[" + "".join("\\" + m for m in marks) + "]"
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_ids(c: Column) -> Column:
    r"""A comma list without ``\N`` and empty parts."""
    return F.filter(split_list(c, ","), lambda x: x != "\\N")


def array_literal(c: Column) -> Column:
    """``{a,b}`` or ``a,b`` as an array."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\{|\}\s*$", ""), ","), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', ""))), lambda x: x != "")


def double_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def undouble_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("''"), F.lit("'"))


def first_or_unknown(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit("Unknown"))


def longs(c: Column) -> Column:
    """An array of texts as longs; what is none is dropped."""
    return F.filter(F.transform(c, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def preferred(frequent: Column, declared: Column) -> Column:
    """The frequent genres of a comma text if there are any, else the declared ones."""
    parts = split_list(frequent, ",")
    return F.when(F.size(parts) > 0, parts).otherwise(F.coalesce(declared, F.array().cast("array<string>")))


# ---- bins -------------------------------------------------------------------


def _steps(v: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for most, name in reversed(steps):
        out = F.when(v <= most, name).otherwise(out)
    return out


def bin_year(y: Column) -> Column:
    return F.when(y.isNull() | (y == 0), "Unknown").when(y < 1950, "pre-1950").otherwise(F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s")))


def half_star(v: Column) -> Column:
    return F.format_string("%.1f", F.bround(v.cast("double") * 2) / 2)


def bin_avg_rating(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v.cast("double")) | (v <= 0), "Unknown").otherwise(half_star(v))


def bin_rating_count(v: Column) -> Column:
    n = F.floor(v)
    return F.when(v.isNull() | (v < 0), "Unknown").otherwise(_steps(n, [(0, "0"), (5, "1-5"), (20, "6-20"), (50, "21-50"), (100, "51-100"), (200, "101-200"), (500, "201-500")], "501+"))


def bin_active_days(v: Column) -> Column:
    n = F.floor(v)
    return F.when(v.isNull() | (v < 0), "Unknown").otherwise(_steps(n, [(0, "0"), (7, "1-7"), (30, "8-30"), (90, "31-90"), (180, "91-180"), (365, "181-365")], "365+"))


def bin_rating_deviation(v: Column) -> Column:
    b = F.bround(v.cast("double") * 2) / 2
    return F.when(v.isNull() | F.isnan(v.cast("double")), "Unknown").otherwise(F.format_string("%.1f", F.when(b == 0, F.lit(0.0)).otherwise(b)))


def bin_imdb_votes(v: Column) -> Column:
    n = F.floor(v)
    return F.when(v.isNull() | F.isnan(v.cast("double")) | (v <= 0), "Unknown").otherwise(_steps(n, [(100, "1-100"), (1000, "101-1K"), (10000, "1K-10K"), (100000, "10K-100K"), (500000, "100K-500K")], "500K+"))


def bucket_age(c: Column) -> Column:
    a = c.cast("string").try_cast("int")
    return F.when(a.isNull() | (a <= 0), "unknown").otherwise(_steps(a, [(17, "under18"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (49, "45-49"), (55, "50-55")], "56+"))


# ---- numbers and vectors ----------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))


def ucb(n: Column, reward: Column, total: float = 100.0) -> Column:
    """Mean reward and a bonus for few trials; the largest double without any."""
    return F.when(n > 0, reward / n + F.sqrt(2 * math.log(total) / n)).otherwise(F.lit(1.7976931348623157e308))


def live_popularity(avg: Column, count: Column) -> Column:
    return F.coalesce(avg, F.lit(0.0)) * F.log1p(F.coalesce(count, F.lit(0)).cast("double"))


def bayes_popularity(n: Column, mean: Column, overall: Column, m: float = 20.0) -> Column:
    return (n / (n + m) * mean + F.lit(m) / (n + m) * overall) * F.log1p(n.cast("double"))


def decay(back: Column, rate: float) -> Column:
    """Recency weight: 1 for the newest (back = 0); 1 + rate * back is rounded once, as SQL's decimals are."""
    r = Fraction(str(rate))
    return 1 / ((r.denominator + r.numerator * back) / F.lit(float(r.denominator)))


def half_up(x: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: x * 10 ** digits to a whole number, halves away from zero (F.round looks at the shortest decimal)."""
    y = F.abs(x) * F.lit(10.0**digits)
    return F.when(y < 2.0**52, F.signum(x) * F.floor(y + 0.5) / F.lit(10.0**digits)).otherwise(x)


def linear_weight(pos: Column, n: Column, low: float = 0.6, high: float = 1.0) -> Column:
    """Weights from ``low`` (oldest, pos = 1) to ``high``; ``low`` for a single one."""
    return F.when(n > 1, low + (high - low) * (pos - 1) / (n - 1)).otherwise(F.lit(low))


def parse_weights(text: str) -> dict[str, float]:
    """``a=1,b=2``: the last of equal names wins, parts without a number are left out."""
    out = {}
    for part in text.split(","):
        name, eq, value = part.partition("=")
        try:
            if eq and name.strip():
                out[name.strip()] = float(value)
        except ValueError:
            continue
    return out


def vocabulary_order(*ids: Column) -> Column:
    """A pseudo-random order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("|", *ids))
