"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _nearest(links: DataFrame) -> DataFrame:
    """The least neighbour of each u; partial sums first, so a hub costs a row per task."""
    return materialize(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "nearest")


def _star(links: DataFrame) -> DataFrame:
    """links from each u: what u's larger side (v > u) or u itself is joined to instead, u's least neighbour."""
    return links.join(_nearest(links), "u")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of links (u, v), root being the least node of its component.

    Each round replaces links by links to least neighbours: the number of
    rounds grows with the logarithm of the longest path, no task needs the
    links of a node together, and each round's links are a written table.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = materialize(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        small = _star(large)
        own = small.select("u", F.col("m").alias("v"))
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).filter("u != v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select("u", F.col("v").alias("root"))
