"""SimHash near-dedup by multi-index hashing.

Fingerprints.  Of the words of a text (A-Z lower-cased, split at white space)
every run of SHINGLE words, repeats included, is hashed by XXH64 with seed 42;
a bit of the fingerprint is 1 if it is set in over half of the hashes.  Fewer
words make one shingle, none make fingerprint zero, which links like others.

Search.  Equal fingerprints are one.  Each distinct fingerprint is cut into
segments of 22, 21 and 21 bits.  Of two fingerprints at most four bits apart,
either the first or the second segments differ in at most one bit or the third
are equal: otherwise at least five bits would differ.  So a fingerprint stands
in the table of each segment and looks up the Hamming balls of radius 1, 1 and
0; of two segments one bit apart, that with the bit unset finds the other.
Complete distances are verified.  A table entry as wide as this stays small at
billions of fingerprints, and what a ball costs is fixed (about 25 rows).

A bucket of many fingerprints is grown from seeds that leave what they reach: a
family of near copies costs few passes and not all pairs.  What SEEDS passes
leave is cut into segments again, by the bits that the bucket does not share
(14 or 15 each, with the same radii), so that members that are not linked do not
cost all pairs either; of what that leaves together all is grown.  Only a forest
of links leaves a task.  Components come from the linked tables, and a document
gets the smallest doc_id that it reaches, itself included.  A bucket is held by
one task: 25 rows of 17 bytes for each fingerprint near its key.

Null texts are empty.  Null ids are passed over by the smallest id; a component
of such rows only has a null one.  Repeated rows share their component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, blocks, materialize, prepare, utf8, with_row_key
from .components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: (first bit, bits, radius) of each segment.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
BLOCK = 1 << 20
#: Pairs compared at once, and the bucket size from which seeds grow instead.
PAIRS, LARGE = 1 << 20, 2048
#: Passes over a large bucket before it is cut further.
SEEDS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE):
    """The number of each row's shingles, and an iterator of (row, hash) of each, some at once."""
    rows = len(at) - 1
    inside = ~_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    keep = inside.copy()  # a word and the first blank after it
    keep[1:] |= inside[:-1] & ~inside[1:]
    text = np.where(inside, _LOWER[raw], 32).astype(np.uint8)[keep].tobytes()
    place = np.concatenate([[0], np.cumsum(keep)])
    starts, ends_at = place[starts], place[ends - 1] + 1 if len(ends) else ends
    first = np.searchsorted(place[np.flatnonzero(opens)] if len(starts) else starts, place[at]) if len(starts) else np.zeros(rows + 1, np.int64)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    base = np.concatenate([[0], np.cumsum(count)])
    row_of = np.repeat(np.arange(rows), count)
    begin = first[row_of] + np.arange(base[-1]) - base[row_of]
    finish = np.minimum(begin + shingle, first[row_of + 1]) - 1
    step = 1 << 17
    digest = xxhash.xxh64_intdigest

    def hashed():
        for a in range(0, int(base[-1]), step):
            s, e = starts[begin[a : a + step]].tolist(), ends_at[finish[a : a + step]].tolist()
            yield row_of[a : a + step], np.fromiter((digest(text[i:j], SEED) for i, j in zip(s, e, strict=True)), np.uint64, len(s))

    return count, hashed()


def fingerprints(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row, as unsigned 64-bit integers."""
    count, hashed = shingle_hashes(raw, at, shingle)
    totals = np.zeros((len(count), 64), np.int64)
    for own, h in hashed:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        totals[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > count[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprinter(shingle):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch.column(2))
            parts = [fingerprints(raw[at[a] : at[b]], at[a : b + 1] - at[a], shingle) for a, b in blocks(at, BLOCK)]
            found = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["id", "row_key", "fp"])

    return run


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, row_key, fp) of each document."""
    prepare(docs.sparkSession)
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text")
    return rows.select("id", "row_key", "text").mapInArrow(_fingerprinter(shingle), "id long, row_key long, fp long")


def _ball(segment: int, at: int, bits: int, radius: int):
    """An array of (bucket, probe) for one segment: its own place and, with radius 1, those with one more bit set."""
    key = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    home = F.lit(segment << 22) + key
    own = F.array(F.struct(home.alias("bucket"), F.lit(False).alias("probe")))
    if not radius:
        return own
    unset = F.filter(F.array(*[F.lit(1 << b) for b in range(bits)]), lambda b: key.bitwiseAND(b) == 0)
    return F.concat(own, F.transform(unset, lambda b: F.struct((home + b).alias("bucket"), F.lit(True).alias("probe"))))


def probes(distinct: DataFrame) -> DataFrame:
    """(bucket, probe, fp): where each fingerprint stands, and the balls that it looks up."""
    balls = [_ball(k, *segment) for k, segment in enumerate(SEGMENTS)]
    return distinct.select("fp", F.explode(F.concat(*balls)).alias("x")).select("x.bucket", "x.probe", "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that join what a-b join."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _grow(fps: np.ndarray, passes: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that join all of fps that are linked, each from the node that reached it; and what so many passes did not come to."""
    left, ends, heads, reached = np.unique(fps), [], [], []
    while len(left) and passes > 0:
        if not reached:
            reached, left = [left[:1]], left[1:]
        seed, rest = reached[-1][0], reached[-1][1:]
        reached = [*reached[:-1], rest] if len(rest) else reached[:-1]
        passes -= 1
        near = np.bitwise_count(left ^ seed) <= DISTANCE
        if near.any():
            found = left[near]
            left = left[~near]
            ends.append(found)
            heads.append(np.full(len(found), seed))
            reached.append(found)
    none = np.zeros(0, fps.dtype)
    links = (np.concatenate(ends), np.concatenate(heads)) if ends else (none, none)
    return *links, np.concatenate([*reached, left]) if len(left) else none


def _cut_again(fps: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, probe, fp) of fingerprints that share a segment, by the other bits."""
    first, bits, _ = SEGMENTS[segment]
    after = first + bits
    other = fps if after == 64 else (fps >> np.uint64(after)) | (fps << np.uint64(64 - after))  # the shared bits are now the highest
    free, rows = 64 - bits, []
    for k, radius in enumerate((1, 1, 0)):
        low, high = free * k // 3, free * (k + 1) // 3
        key = ((other >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
        rows.append(((k << 20) + key, np.zeros(len(fps), bool), fps))
        for bit in range(high - low if radius else 0):
            unset = (key >> bit) & 1 == 0
            rows.append(((k << 20) + key[unset] + (1 << bit), np.ones(int(unset.sum()), bool), fps[unset]))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def bucket_links(bucket: np.ndarray, probe: np.ndarray, fp: np.ndarray, again: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the verified links in whole buckets; again: large ones may be cut further."""
    order = np.lexsort((probe, bucket))
    bucket, probe, fp = bucket[order], probe[order], fp[order]
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(bucket)]]))
    ends, heads = [], []
    for k in np.flatnonzero(sizes > LARGE).tolist():
        if not probe[begins[k]]:
            e, h, rest = _grow(fp[begins[k] : begins[k] + sizes[k]], SEEDS if again else math.inf)
            ends.append(e)
            heads.append(h)
            if len(rest):
                e, h = bucket_links(*_cut_again(rest, int(bucket[begins[k]]) >> 22), False)
                ends.append(e)
                heads.append(h)
    begin = np.repeat(begins, sizes)
    homes = np.repeat(np.add.reduceat((~probe).astype(np.int64), begins), sizes)
    partners = np.where(np.repeat(sizes, sizes) > LARGE, 0, np.where(probe, homes, np.arange(len(fp)) - begin))
    total = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        n = partners[at:to]
        mine = np.repeat(np.arange(at, to), n)
        other = begin[mine] + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
        a, b = fp[mine], fp[other]
        near = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        e, h = forest(a[near], b[near])
        ends.append(e)
        heads.append(h)
        at = to
    return forest(np.concatenate(ends), np.concatenate(heads)) if ends else (fp[:0], fp[:0])


def _linker(batches):
    """Reads (bucket, probe, fp) sorted by bucket; keeps the last bucket until its end is known."""
    none = np.zeros(0, np.int64)
    held: list[tuple] = []

    def links(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        e, h = bucket_links(columns[0], columns[1], columns[2].view(np.uint64)) if len(columns[0]) else (none, none)
        return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(h.view(np.int64))], names=["u", "v"])

    rows = 0
    for batch in batches:
        bucket, probe, fp = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
        if not len(bucket):
            continue
        held.append((bucket, probe, fp))
        rows += len(bucket)
        if rows < 1 << 18 or bucket[-1] == held[0][0][0]:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield links([tuple(c[:cut] for c in columns)])
        held = [tuple(c[cut:] for c in columns)]
        rows = len(held[0][0])
    if held:
        yield links(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links whose components are those of all pairs at most DISTANCE bits apart."""
    prepare(distinct.sparkSession)
    sent = probes(distinct).repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(_linker, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col, row_key, fingerprint and component_id of each row of docs."""
    printed = materialize(fingerprint_documents(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = materialize(connected_components(fingerprint_links(distinct.select("fp"))).select(F.col("u").alias("fp"), "root"), "components")
    members = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    members = materialize(members, "members")
    least = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = materialize(members.join(least, "root").select("fp", "component_id"), "classes")
    return printed.join(classes, "fp").select(F.col("id").alias(id_col), "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
