"""Evaluation of recognition runs: statistics, ranks, best and most common results.

A result table has image, expected, recognized, config, config_ord, lang,
preprocessing, accuracy, confidence, process_time and success.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accuracy import run_verdict


def _share(part, whole):
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def pair_configs(images: DataFrame, configs: DataFrame) -> DataFrame:
    """JOIN6: every image with every configuration; the configurations are a handful."""
    return images.crossJoin(F.broadcast(configs))


def config_stats(results: DataFrame) -> DataFrame:
    """EVAL3: per configuration, over its successful results; configurations without any are left out."""
    good = results.filter("success").groupBy("config", "config_ord").agg(
        F.avg("accuracy").alias("avg_accuracy"), F.max("accuracy").alias("max_accuracy"), F.min("accuracy").alias("min_accuracy"), F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("accuracy") >= 80).alias("above80"), F.count_if(F.col("accuracy") >= 60).alias("above60"),
        F.avg("confidence").alias("avg_confidence"), F.avg("process_time").alias("avg_time"),
    )
    return good.withColumn("above80_share", _share(F.col("above80"), F.col("tests")))


def rank_configs(stats: DataFrame) -> DataFrame:
    """EVAL4: by average accuracy, ties in the order of the configurations; one row per configuration."""
    ranked = stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("avg_accuracy", 9)), "config_ord")))
    return ranked.withColumn("medal", F.when(F.col("place") == 1, "gold").when(F.col("place") == 2, "silver").when(F.col("place") == 3, "bronze"))


def stats_by(results: DataFrame, key: str) -> DataFrame:
    """EVAL5, EVAL6: per preprocessing or language."""
    good = results.filter("success").groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key))
    return good.agg(F.avg("accuracy").alias("avg_accuracy"), F.max("accuracy").alias("max_accuracy"), F.count_if(F.col("accuracy") >= 80).alias("above80"), F.count(F.lit(1)).alias("tests"))


def overall_stats(results: DataFrame) -> DataFrame:
    """EVAL7 and the run's verdict (EVAL9)."""
    totals = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(F.col("success") & (F.col("accuracy") >= 80)).alias("above80"), F.count_if(F.col("success") & (F.col("accuracy") >= 60)).alias("above60")
    )
    return totals.withColumn("success_rate", _share(F.col("successful"), F.col("total"))).withColumn("verdict", run_verdict(F.col("above80"), F.col("above60")))


def family_pick(ranked: DataFrame) -> DataFrame:
    """EVAL8: the best configuration of each language family, by its name."""
    english = F.contains("config", F.lit("English")) & ~F.contains("config", F.lit("German"))
    family = F.when(english, "english").when(F.contains("config", F.lit("German")), "german")
    w = Window.partitionBy("family").orderBy("place")
    picked = ranked.withColumn("family", family).filter("family IS NOT NULL").withColumn("n", F.row_number().over(w))
    return picked.filter("n = 1").select("family", "config", "avg_accuracy", "place")


def best_results(results: DataFrame, k: int = 5) -> DataFrame:
    """TOPK3: the k best successful results of each image, ties in the order of the configurations."""
    w = Window.partitionBy("image").orderBy(F.desc("accuracy"), "config_ord")
    return results.filter("success").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def best_config(results: DataFrame) -> DataFrame:
    """TOPK4: the best successful configuration of each image, '' where nothing was recognised at all."""
    best = F.max_by(F.struct("config", "accuracy"), F.when(F.col("success"), F.struct("accuracy", -F.col("config_ord"))))
    found = results.groupBy("image").agg(best.alias("b"))
    none = F.coalesce(F.col("b.accuracy"), F.lit(0.0)) == 0
    return found.select("image", F.when(none, "").otherwise(F.col("b.config")).alias("best_config"), F.when(none, 0.0).otherwise(F.col("b.accuracy")).alias("best_accuracy"))


def common_texts(results: DataFrame, k: int = 3) -> DataFrame:
    """TOPK5: the k texts of over five characters recognised most often, ties by what was seen first."""
    seen = results.filter("success AND length(recognized) > 5").groupBy("recognized")
    counted = seen.agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("image", "config_ord")).alias("first"))
    return counted.orderBy(F.desc("times"), "first").limit(k).select("recognized", "times")


def join_config(results: DataFrame, configs: DataFrame) -> DataFrame:
    """JOIN5: each result with its configuration's language, the first of that name, else 'unknown'."""
    first = configs.groupBy("name").agg(F.min_by("lang", "config_ord").alias("config_lang"))
    return results.join(first, results["config"] == first["name"], "left").drop("name").withColumn("config_lang", F.coalesce("config_lang", F.lit("unknown")))
