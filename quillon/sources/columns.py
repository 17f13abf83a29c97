"""Column names of interaction, item and user tables from various sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Other names of columns, without case and underscores.
ALIASES = {
    "userid": "user_id", "user": "user_id", "movieid": "item_id", "itemid": "item_id", "movie": "item_id", "item": "item_id",
    "timestamp": "ts", "time": "ts", "ts": "ts", "startyear": "year", "averagerating": "avg_rating", "numvotes": "num_votes", "runtimeminutes": "runtime_minutes",
}


def normalise(df: DataFrame) -> DataFrame:
    """Renames known aliases; other names become lower case.  The first of two columns with one meaning is kept."""
    seen, out = set(), []
    for c in df.columns:
        plain = c.lower().replace("_", "")
        name = ALIASES.get(plain, c.lower())
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def fill_ts(df: DataFrame) -> DataFrame:
    """Adds ts, the number of a row among its user's (from 0, in order of item), where the column is missing."""
    if "ts" in df.columns:
        return df
    return df.withColumn("ts", (F.row_number().over(W.partitionBy("user_id").orderBy("item_id")) - 1).cast("long"))
