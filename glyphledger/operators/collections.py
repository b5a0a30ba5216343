"""Named collections: (ord, id, name, created_at, last_modified, card_count) and the active one's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

#: Longest name that a user may give.
NAME_CHARS = 50


def acceptable_names(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """JOIN10, COL1, COL2: of (id, name) those not empty, not too long, and of no other collection in any case; id is null for a new one."""
    named = wanted.withColumn("name", trim_all("name")).filter((F.length("name") > 0) & (F.length("name") <= NAME_CHARS))
    other = collections.select(F.lower("name").alias("taken"), F.col("id").alias("owner"))
    return named.join(other, (F.lower(named["name"]) == other["taken"]) & ~named["id"].eqNullSafe(other["owner"]), "left_anti")


def duplicate_names(collections: DataFrame) -> DataFrame:
    """Names that more than one collection has, whatever their case."""
    return collections.groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def create(collections: DataFrame, name: str, new_id: str, now) -> DataFrame:
    """COL1: with one more collection, or unchanged if its name will not do."""
    spark = collections.sparkSession
    ok = acceptable_names(spark.createDataFrame([(None, name)], "id string, name string"), collections)
    last = collections.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("ord"))
    row = ok.crossJoin(last).select(F.col("ord").cast("int").alias("ord"), F.lit(new_id).alias("id"), "name", F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("last_modified"), F.lit(0).cast("int").alias("card_count"))
    return collections.unionByName(row)


def rename(collections: DataFrame, collection_id: str, name: str, now) -> DataFrame:
    """COL2."""
    spark = collections.sparkSession
    ok = acceptable_names(spark.createDataFrame([(collection_id, name)], "id string, name string"), collections).select("id", F.col("name").alias("new_name"))
    renamed = collections.join(F.broadcast(ok), "id", "left")
    return renamed.select("ord", "id", F.coalesce("new_name", "name").alias("name"), "created_at", F.when(F.col("new_name").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_modified")).alias("last_modified"), "card_count")


def delete(collections: DataFrame, active: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COL3: collections without those in gone (id), and the active one after it.

    The last collection stays: if gone names all of them, nothing goes.  If the
    active one goes, the first that is left becomes active.
    """
    left = collections.join(gone.select("id").distinct(), "id", "left_anti")
    n = left.agg(F.count(F.lit(1)).alias("n_left"))
    kept = collections.join(gone.select("id", F.lit(True).alias("gone")).distinct(), "id", "left").crossJoin(n).filter("gone IS NULL OR n_left = 0").drop("gone", "n_left")
    first = kept.agg(F.min_by("id", F.struct("ord", "id")).alias("first_id"))
    still = kept.select(F.col("id").alias("kept_id"))
    now = active.join(still, active["id"] == still["kept_id"], "left").crossJoin(first)
    return kept, now.select(F.coalesce("kept_id", "first_id").alias("id"))


def switch(active: DataFrame, collections: DataFrame, to: str) -> DataFrame:
    """COL4: the active collection after a switch; an unknown id changes nothing."""
    found = collections.filter(F.col("id") == to).agg(F.max("id").alias("to"))
    return active.crossJoin(found).select(F.coalesce("to", "id").alias("id"))


def listing(collections: DataFrame, active: DataFrame) -> DataFrame:
    """COL5: newest first, with the place in the list and the active one flagged.

    Counts per hour tell how many stand before an hour's collections; only
    those of one hour are numbered in one window.
    """
    flag = active.select(F.col("id").alias("active_id")).limit(1)  # one row
    hour = F.coalesce(F.floor(F.unix_seconds("created_at") / 3600), F.lit(-(2**40)))  # without a time: last
    sliced = collections.withColumn("hour", hour)
    hours = sliced.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select("hour", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))  # a row per hour
    w = Window.partitionBy("hour").orderBy(F.desc("created_at"), "ord")
    placed = sliced.join(before, "hour").withColumn("place", (F.col("before") + F.row_number().over(w)).cast("int")).drop("hour", "before")
    return placed.join(F.broadcast(flag), F.col("id") == F.col("active_id"), "left").withColumn("is_active", F.col("active_id").isNotNull()).drop("active_id")


def bootstrap(collections: DataFrame, default_id: str, name: str, now) -> DataFrame:
    """COL6: with a default collection if there is none."""
    spark = collections.sparkSession
    row = spark.createDataFrame([(0, default_id, name, 0)], "ord int, id string, name string, card_count int").withColumns({"created_at": F.lit(now).cast("timestamp"), "last_modified": F.lit(now).cast("timestamp")})
    n = collections.agg(F.count(F.lit(1)).alias("n"))
    return collections.unionByName(row.crossJoin(n).filter("n = 0").drop("n").select(*collections.columns))


def migrate(legacy: DataFrame, held: DataFrame, target: str) -> DataFrame:
    """COL7: the old single list becomes the target collection's content, in place of what it held."""
    old = legacy.withColumn("collection", F.lit(target))
    replaced = held.filter(F.col("collection") != target)
    n = legacy.agg(F.count(F.lit(1)).alias("n_legacy"))
    kept = held.filter(F.col("collection") == target).crossJoin(n).filter("n_legacy = 0").drop("n_legacy")
    return replaced.unionByName(kept).unionByName(old.select(*held.columns))


def recount(collections: DataFrame, held: DataFrame, now) -> DataFrame:
    """SNK1: card counts from the holdings, and when they changed."""
    n = held.groupBy("collection").agg(F.sum(F.coalesce(F.nullif("count", F.lit(0)), F.lit(1))).alias("n"))
    both = collections.join(n, collections["id"] == n["collection"], "left")
    count = F.coalesce("n", F.lit(0)).cast("int")
    changed = ~count.eqNullSafe(F.col("card_count"))
    return both.select("ord", "id", "name", "created_at", F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("last_modified")).alias("last_modified"), count.alias("card_count"))
