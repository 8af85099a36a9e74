"""Equi-joins that survive hot keys.

The hottest keys are found by a pre-aggregated count and only the HOT_KEYS most frequent ones are
taken to the driver, so any key that is not among them holds at most 1/HOT_KEYS of the rows. Rows of a hot key are
spread over salts by a hash of the row; the other side is repeated once per salt for those keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

#: At most so many keys are salted; the list of them is all that is broadcast.
HOT_KEYS = 512
#: A key is hot beyond so many rows; each salt takes about as many.
ROWS_PER_SALT = 50_000
MAX_SALTS = 2048


def hot_keys(df: DataFrame, on: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame | None:
    """(on..., _salts) of at most HOT_KEYS keys with more than rows_per_salt rows; None if there are none. Null keys never match, so they don't count."""
    counts = df.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.filter(F.col("_n") > rows_per_salt).orderBy(F.desc("_n")).limit(HOT_KEYS).collect()
    if not rows:
        return None
    schema = T.StructType([df.schema[c] for c in on] + [T.StructField("_salts", T.IntegerType())])
    data = [(*[r[c] for c in on], min(MAX_SALTS, -(-r["_n"] // rows_per_salt))) for r in rows]
    return df.sparkSession.createDataFrame(data, schema)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """left join right on equal keys; left may have hot keys. how: inner, left, left_semi or left_anti."""
    hot = hot_keys(left, on, rows_per_salt)
    if hot is None:
        return left.join(right, on, how)
    spread = F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")])
    a = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(spread, F.col("_salts")).cast("int"))).drop("_salts")
    b = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return a.join(b, [*on, "_salt"], how).drop("_salt")
