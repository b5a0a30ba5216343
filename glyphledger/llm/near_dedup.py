"""Near copies at a Jaccard similarity of 0.8 or more of their five-word shingles.

Candidates.  A 64-bit fingerprint is too short for this similarity: at 0.8 two
texts differ in about ten bits, where no table of bits is selective.  So beside
the groups that SimHash finds (simhash.py, with five words) stand BANDS tables
of ROWS min-hashes each.  A pair at 0.8 shares none of the tables with a
probability of (1 - 0.8^6)^32, 6 in 100,000, and one more alike with less.

Confirmation.  All links are exact: shared shingles over all shingles of the
two.  First each member of a group is compared with the least one.  Groups that
the links leave in several components are then compared across these, members
of all but the largest with all others, so no candidate pair goes untested and
a large family of copies costs few passes.  Shingle sets are made only for texts
that share a group; one group is compared by one task.

A text is known by its row key.  Words are those of simhash.py; fewer than five
make one shingle, and texts without words are alike.  Null ids are passed over
by the smallest id.  ``near_keepers`` names one row of each component, also where
rows share an id or have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, prepare, utf8, with_row_key
from .components import connected_components
from .simhash import BLOCK, shingle_hashes, simhash_components

SHINGLE = 5
#: Similarity as a fraction.
SHARED, OF = 4, 5
BANDS, ROWS = 32, 6
_MIX = np.random.default_rng(20).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_MIX[1] |= np.uint64(1)


def hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle, in the order of rows; a row without words has the hash zero."""
    count, hashed = shingle_hashes(raw, at, SHINGLE)
    none = np.flatnonzero(count == 0)
    parts = [*hashed, (none, np.zeros(len(none), np.uint64))]
    row, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(none):
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def bands(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The bucket of each row in each of the tables."""
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.empty((len(begins), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(begins), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat((h ^ _MIX[0, k]) * _MIX[1, k], begins)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _bander(batches):
    for batch in batches:
        raw, at = utf8(batch.column(1))
        node = np.asarray(batch.column(0))
        for a, b in blocks(at, BLOCK):
            found = bands(*hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a]))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64).reshape(-1)), pa.array(np.repeat(node[a:b], BANDS))], names=["bucket", "node"])


def _setter(batches):
    for batch in batches:
        raw, at = utf8(batch.column(1))
        for a, b in blocks(at, BLOCK):
            row, h = hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
            row, h = row[new], h[new]
            ends = np.searchsorted(row, np.arange(b - a + 1))
            sets = [h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "shingles"])


def alike(shared, m, n):
    """Whether sets of m and n shingles, of which so many are shared, are near copies."""
    return (OF + SHARED) * shared >= SHARED * (m + n)


def _confirmer(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            m, n = len(a), len(b)
            keep.append(alike(min(m, n), m, n) and bool(alike(m + n - len(np.unique(np.concatenate([a, b]))), m, n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def cross_links(node: np.ndarray, root: np.ndarray, sets: list[bytes]) -> tuple[list[int], list[int]]:
    """Links that join the components (by root) of one group wherever two of their members are near copies."""
    size = np.array([len(s) // 8 for s in sets], np.int64)
    begins = np.cumsum(size) - size
    values, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    mark = np.zeros(len(values), np.int64)
    _, label, members = np.unique(root, return_inverse=True, return_counts=True)
    u, v = [], []
    for i in np.flatnonzero(label != members.argmax()).tolist():
        own = codes[begins[i] : begins[i] + size[i]]
        mark[own] = 1
        near = alike(np.add.reduceat(mark[codes], begins), size[i], size) & (label != label[i])
        mark[own] = 0
        others, first = np.unique(label[near], return_index=True)
        if len(others):
            v += node[np.flatnonzero(near)[first]].tolist()
            u += [int(node[i])] * len(others)
            label[np.isin(label, others)] = label[i]
            if (label == label[0]).all():
                break
    return u, v


def _grower(batches):
    """Reads (bucket, node, root, shingles) sorted by bucket; keeps the last bucket until its end is known."""
    held: list[pa.RecordBatch] = []

    def links(table):
        bucket, node, root = (np.asarray(table.column(i)) for i in range(3))
        sets = table.column(3).to_pylist()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        found = [cross_links(node[a:b], root[a:b], sets[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        u, v = ([x for pair in found for x in pair[k]] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column(0)[-1] == held[0].column(0)[0]:
            continue
        bucket = np.asarray(batch.column(0))
        cut = int(np.searchsorted(bucket, bucket[-1]))
        yield links(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield links(pa.Table.from_batches(held))


def near_members(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and root, the same for all rows that near copies lead to, of each row of docs."""
    prepare(docs.sparkSession)
    printed = materialize(simhash_components(docs, shingle=SHINGLE).select("doc_id", "row_key", "component_id"), "printed")
    texts = with_row_key(docs.select("text"), "text").select(F.col("row_key").alias("node"), "text")
    groups = printed.select(F.xxhash64("component_id").alias("bucket"), F.col("row_key").alias("node"))
    w = Window.partitionBy("bucket")
    ends = texts.mapInArrow(_bander, "bucket long, node long").unionByName(groups).withColumns({"head": F.min("node").over(w), "last": F.max("node").over(w)})
    shared = materialize(ends.filter("head != last").select("bucket", "node", "head"), "shared")
    sets = texts.join(shared.select("node").distinct(), "node", "left_semi").mapInArrow(_setter, "node long, shingles binary")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    star = shared.filter("node != head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    star = star.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    links = materialize(star.select("u", "v", "x", "y").mapInArrow(_confirmer, "u long, v long"), "confirmed")
    roots = connected_components(links).select(F.col("u").alias("node"), "root")
    rooted = shared.select("bucket", "node").distinct().join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.withColumns({"head": F.min("root").over(w), "last": F.max("root").over(w)}).filter("head != last").select("bucket", "node", "root")
    apart = materialize(apart, "apart")
    grown = apart.join(sets, "node").select("bucket", "node", "root", "shingles").repartition("bucket").sortWithinPartitions("bucket")
    links = materialize(links.unionByName(grown.mapInArrow(_grower, "u long, v long")), "links")
    roots = materialize(connected_components(links).select(F.col("u").alias("row_key"), "root"), "roots")
    members = printed.select("doc_id", "row_key").join(roots, "row_key", "left").withColumn("root", F.coalesce("root", "row_key"))
    return materialize(members, "members")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and component_id, the smallest doc_id that near copies lead to, of each row of docs."""
    members = near_members(docs)
    least = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "root").select("doc_id", "row_key", "component_id")


def near_keepers(docs: DataFrame) -> DataFrame:
    """doc_id and row_key of the one row that stays of each component: the smallest doc_id (nulls last), then the smallest row key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key")).alias("k")
    return near_members(docs).groupBy("root").agg(first).select("k.doc_id", "k.row_key")
