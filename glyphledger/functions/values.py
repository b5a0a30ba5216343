"""Dates, ages and nested values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """FN1: an ISO-8601 text in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_of(text: Column) -> Column:
    """FN2: the date part of an ISO text."""
    return F.element_at(F.split(text, "T"), 1)


def local_date(ts: Column) -> Column:
    """FN3: day, month and year as German readers write them."""
    return F.date_format(ts, "d.M.yyyy")


def age_ms(as_of_ms, ts_ms: Column) -> Column:
    """FN4."""
    return F.lit(as_of_ms) - ts_ms


def nested_image(images: Column, faces: Column) -> Column:
    """FN10: the image of a card, else that of its first face."""
    return F.coalesce(images["normal"], F.get(faces, F.lit(0))["image_uris"]["normal"])
