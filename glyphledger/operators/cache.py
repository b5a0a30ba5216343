"""Time-limited cache tables: (key, value, ts_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_MS = 86_400_000


def fresh(cache: DataFrame, as_of_ms, ttl_ms: int = TTL_MS) -> DataFrame:
    """CACHE1: entries younger than the limit; exactly as old is too old, and so is one without a time."""
    return cache.filter(F.lit(as_of_ms) - F.col("ts_ms") < ttl_ms)


def evict(cache: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """CACHE2: what stays after the oldest quarter (rounded up) has gone; no time counts as zero, ties go by key.

    Counts per slice tell in which the cut falls; only its rows are numbered, all
    others are kept or dropped whole.  A slice is an hour; entries without a time,
    which may be many, make one for each beginning of a key.
    """
    age = F.coalesce("ts_ms", F.lit(0)).cast("long")
    slices = {"age_ts": age, "hour": F.floor(age / bucket_ms), "timed": age != 0, "prefix": F.when(age == 0, F.coalesce(F.substring("key", 1, 3), F.lit(""))).otherwise("")}
    aged = cache.withColumns(slices)
    by = ["hour", "timed", "prefix"]
    upto = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = aged.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    cut = sizes.select(*by, F.sum("size").over(upto).alias("through"), "size", F.ceil(F.sum("size").over(every) * 0.25).alias("gone"))  # a row per slice
    placed = aged.join(cut, by).withColumn("before", F.col("through") - F.col("size"))
    whole = placed.filter("before >= gone")
    w = Window.partitionBy(*by).orderBy("age_ts", "key")
    split = placed.filter("before < gone AND through > gone").withColumn("n", F.row_number().over(w)).filter("n + before > gone")
    return whole.select(*cache.columns).unionByName(split.select(*cache.columns))
