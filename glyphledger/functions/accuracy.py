"""Recognition accuracy and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, trim_all

# Thresholds of the verdicts, in percent.
GOOD, DECENT, WEAK = 80, 60, 30


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: F.length(w) > 2)


def words_matched(expected: Column, actual: Column, tolerance) -> Column:
    """JOIN7: how many expected words have an actual word that holds them, lies in them or is within the tolerance."""
    words = _words(actual)

    def seen(w):
        return F.exists(words, lambda a: F.contains(a, w) | F.contains(w, a) | (F.levenshtein(w, a) <= tolerance(w)))

    return F.size(F.filter(_words(expected), seen))


def similarity(a: Column, b: Column) -> Column:
    """STR7 as a percentage of the longer text; null where both are empty."""
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.try_divide(longest - F.levenshtein(a, b), longest) * 100


def _word_share(expected: Column, actual: Column, tolerance) -> Column:
    return F.coalesce(F.try_divide(words_matched(expected, actual, tolerance).cast("double"), F.size(_words(expected)).cast("double")) * 100, F.lit(0.0))


def accuracy_basic(expected: Column, actual: Column) -> Column:
    """EVAL1: the better of text similarity and share of words found."""
    e, a = trim_all(F.lower(expected)), trim_all(F.lower(actual))
    missing = F.coalesce(F.length(expected), F.lit(0)).eqNullSafe(0) | F.coalesce(F.length(actual), F.lit(0)).eqNullSafe(0)
    found = F.greatest(F.coalesce(similarity(e, a), F.lit(0.0)), _word_share(e, a, lambda w: F.lit(1)))
    return F.when(missing, 0.0).when(e == a, 100.0).otherwise(found)


def accuracy_tolerant(expected: Column, actual: Column) -> Column:
    """EVAL2: misread signs are mapped after lower-casing, half the text found counts 50."""
    e, a = trim_all(F.lower(expected)), trim_all(F.lower(actual))
    missing = F.coalesce(F.length(expected), F.lit(0)).eqNullSafe(0) | F.coalesce(F.length(actual), F.lit(0)).eqNullSafe(0)
    mended = trim_all(F.translate(a, "|051", "IOSl"))
    half = F.substring(e, F.lit(1), F.floor(F.length(e) / 2).cast("int"))
    share = _word_share(e, mended, lambda w: F.greatest(F.lit(1), F.floor(F.length(w) * 0.2).cast("int")))
    found = F.greatest(F.coalesce(similarity(e, mended), F.lit(0.0)), share, F.when(F.contains(mended, half), 50.0).otherwise(0.0))
    return F.when(missing, 0.0).when(e == a, 100.0).when(e == mended, 95.0).otherwise(found)


def verdict(accuracy: Column) -> Column:
    """EVAL9: the tier of one result."""
    return F.when(accuracy >= GOOD, "good").when(accuracy >= DECENT, "decent").when(accuracy >= WEAK, "weak").otherwise("poor")


def run_verdict(above80: Column, above60: Column) -> Column:
    """EVAL9: the tier of a run."""
    return F.when(above80 > 0, "good").when(above60 > 0, "partial").otherwise("poor")
