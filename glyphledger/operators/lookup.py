"""Joins that resolve keys: catalogue, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_parts, key_text, label_from_name, language_code
from ..functions.values import nested_image

CARD = "id STRING, name STRING, `set` STRING, set_name STRING, collector_number STRING, image_uris STRUCT<normal: STRING>, card_faces ARRAY<STRUCT<image_uris: STRUCT<normal: STRING>>>"


def parse_keys(scans: DataFrame, text_col: str) -> DataFrame:
    """STR4 over a table: adds set_code, number and language; all are null unless there are both a set code and a number.

    The key text is a column of its own, so long texts are trimmed and put in capitals once for all patterns.
    """
    parts = scans.withColumn("__key", key_text(F.col(text_col))).withColumns(key_parts(F.col("__key"))).drop("__key")
    both = F.col("set_code").isNotNull() & F.col("number").isNotNull()
    return parts.withColumns({n: F.when(both, F.col(n)) for n in ("set_code", "number", "language")})


def resolve(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """JOIN1: each row of keys (set_code, number, language) with the card of that set, number and language, or nulls.

    language is a code as scanned; without one the English card is meant.  The
    catalogue is unique by (set, catalog_number, lang); Spark sends it to all
    tasks if its statistics say that it is small, else both sides meet by key.
    """
    wanted = keys.withColumn("api_language", F.when(keys["set_code"].isNotNull(), language_code(keys["language"])))
    key = (F.lower(wanted["set_code"]) == catalog["set"]) & (wanted["number"].try_cast("int") == catalog["catalog_number"]) & (wanted["api_language"] == catalog["lang"])
    return wanted.join(catalog, key, "left").drop("lang")


def fallback_search(keys: DataFrame) -> DataFrame:
    """JOIN2: the search by name is not offered; it finds nothing."""
    return keys.withColumn("fallback_id", F.lit(None).cast("string"))


def label(files: DataFrame, labels: DataFrame) -> DataFrame:
    """JOIN8: the expected text of each file (stem), from the labels (code, expected) or else from its name."""
    found = files.join(labels, files["stem"] == labels["code"], "left").drop("code")
    return found.withColumn("expected", F.coalesce("expected", label_from_name(F.col("stem"))))


def catalog_cards(raw: DataFrame) -> DataFrame:
    """SRC6, FN10: catalogue rows with the front image: the card's own, else that of its first face."""
    return raw.select("id", "name", "set", "set_name", "collector_number", nested_image(F.col("image_uris"), F.col("card_faces")).alias("image"))


def read_catalog(texts: DataFrame) -> DataFrame:
    """SRC6: catalogue rows from their JSON texts (value); a text that is no card has no row."""
    return catalog_cards(texts.select(F.from_json("value", CARD).alias("c")).filter("c.id IS NOT NULL").select("c.*"))


def label_catalog(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC7: labels (code, set_code, number, language) with the name that the catalogue has for each, those it lacks left out."""
    return resolve(labels, catalog).filter("card_id IS NOT NULL").select("code", F.col("name").alias("expected"))
