"""Exact dedup by content-defined chunk recipes.

1. One Python pass over the texts deletes white space, cuts what is left at
   content-defined places (a gear hash over a window of 32 bytes) and replaces
   each chunk by a digest, its length and an independent check hash.  After
   this pass no text moves again: a document is its ordered list of chunks.
2. Chunks are deduplicated to verified identifiers: of each digest, lengths
   and check hashes must agree.  Digests for which they don't (collisions)
   become longer identifiers, told apart by check hash and length.
3. Documents with equal ordered identifier lists are copies.  Groups are
   aggregated map-side first, so a group with a third of all rows sends one
   row per task; the join back is a sort-merge join that Spark can split.

Nulls and empty texts are equal to each other and to texts of white space only.
A null id sorts after all others.  Rows repeated with the same id count in
group_size, and one of them stays.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, blocks, materialize, prepare, utf8, with_row_key

WINDOW = 32
#: Cuts come every 2**CUT_BITS bytes on average.
CUT_BITS = 10
DIGEST_BYTES = 16
BLOCK = 2 << 20

_GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_KEEP = np.ones(256, bool)
_KEEP[list(SPACE_BYTES)] = False

CHUNKED = "id long, row_key long, row long, n_points long, text_sha256 string, digests array<binary>, lengths array<int>, checks array<long>"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each place, by doubling the window five times."""
    h = _GEAR[data]
    k = 1
    while k < WINDOW:
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h, k = wider, 2 * k
    return h


def cut_places(data: np.ndarray, starts: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places in data where a chunk ends early; depends on the text's own bytes only."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    hits = np.flatnonzero((gear_hash(data) >> np.uint32(32 - bits)) == 0) + 1
    begun = starts[np.searchsorted(starts, hits - 1, "right") - 1]
    return hits[hits - begun >= WINDOW]


def _chunk_block(raw, at, bits, digest_bytes):
    keep = _KEEP[raw]
    before = np.concatenate([[0], np.cumsum(keep)])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    text = raw[keep]
    to = before[at]
    cuts = cut_places(text, to[:-1], bits)
    view = memoryview(np.ascontiguousarray(text))
    firsts = np.searchsorted(cuts, to[:-1], "right")
    lasts = np.searchsorted(cuts, to[1:], "left")
    for i in range(len(at) - 1):
        s, e = int(to[i]), int(to[i + 1])
        ends = [*cuts[firsts[i] : lasts[i]].tolist(), e] if e > s else []
        digests, lengths, checks, a = [], [], [], s
        for b in ends:
            part = view[a:b]
            digests.append(hashlib.sha256(part).digest()[:digest_bytes])
            lengths.append(b - a)
            checks.append(xxhash.xxh64_intdigest(part) - 2**63)
            a = b
        yield int(points[at[i + 1]] - points[at[i]]), hashlib.sha256(view[s:e]).hexdigest(), digests, lengths, checks


def _chunker(bits, digest_bytes):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch.column(3))
            rows = []
            for a, b in blocks(at, BLOCK):
                rows += _chunk_block(raw[at[a] : at[b]], at[a : b + 1] - at[a], bits, digest_bytes)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            arrays = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "row_key", "row", "n_points", "text_sha256", "digests", "lengths", "checks"])

    return run


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = CUT_BITS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """A row per document: its size, whole digest and ordered chunk digests, lengths and checks."""
    prepare(docs.sparkSession)
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text")
    rows = rows.select("id", "row_key", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(_chunker(bits, digest_bytes), CHUNKED)


def chunk_collisions(chunked: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk content, found by length and check hash."""
    chunks = chunked.select(F.explode(F.arrays_zip("digests", "lengths", "checks")).alias("c")).select("c.*")
    found = chunks.groupBy("digests").agg(F.min("lengths").alias("a"), F.max("lengths").alias("b"), F.min("checks").alias("c"), F.max("checks").alias("d"))
    return found.filter("a != b or c != d").select(F.col("digests").alias("digest"))


def recipes(chunked: DataFrame, collisions: DataFrame | None) -> DataFrame:
    """Adds recipe, the ordered list of verified identifiers as one binary value."""
    plain = F.array_join(F.transform("digests", lambda d: F.hex(d)), "")
    if collisions is None:
        return chunked.withColumn("recipe", F.unhex(plain)).drop("digests", "lengths", "checks")
    parts = chunked.select("row", F.posexplode(F.arrays_zip("digests", "lengths", "checks")).alias("at", "c")).select("row", "at", "c.*")
    marked = parts.join(collisions.withColumn("clash", F.lit(True)), parts["digests"] == collisions["digest"], "left")
    name = F.concat_ws(":", F.hex("digests"), F.when(F.col("clash"), F.concat_ws(":", "lengths", "checks")))
    lists = marked.select("row", F.struct("at", name.alias("name")).alias("x")).groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    lists = lists.select("row", F.encode(F.array_join("x.name", ","), "UTF-8").alias("recipe"))
    whole = chunked.drop("digests", "lengths", "checks").join(lists, "row", "left")
    return whole.withColumn("recipe", F.coalesce("recipe", F.lit(b"")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = CUT_BITS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Columns id_col, row_key, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    chunked = materialize(chunk_documents(docs, id_col, text_col, bits, digest_bytes), "chunks")
    collisions = materialize(chunk_collisions(chunked), "collisions")
    named = recipes(chunked, None if collisions.isEmpty() else collisions)
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r")))
    groups = named.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = materialize(groups.select("recipe", "group_size", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row")), "groups")
    joined = named.join(groups, "recipe")
    return joined.select(
        F.col("id").alias(id_col), "row_key", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
