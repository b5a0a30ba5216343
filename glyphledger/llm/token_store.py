"""Token ids in a content-addressed store.

Writing.  Texts become ids (null and empty texts only the end id), ids are cut
into chunks at places that a rolling hash of the last ids chooses, so equal
passages give equal chunks.  A task hands on each of its chunks once; the
chunks then meet by digest, their bytes are compared, and each is written once.
A document is a recipe: its chunks' digests and sizes in order under the root of
a Merkle tree.  Recipes lie sorted by doc_id (nulls first) with the number of
ids before them.  Above them stands a manifest: a node over each LEAVES
neighbouring recipes, nodes over these, up to the root that ``Store`` carries
and the file "root" repeats.  The store is three Parquet tables and that file:

    packed/    kind=1: key (a chunk's digest) binary, ids binary (little-endian, 2 bytes an id, or 4 beyond 65,536 ids)
    recipes/   doc_id long, start long, n_tokens long, digests array<binary>, sizes array<int>, root binary, part int, row long
    manifest/  level int, part int, node long, first long, n_tokens long, n_recipes long, digest string

Reading.  ``check_manifest`` compares what the recipes say now with the manifest
and the manifest with the store's root: recipes that are gone, added, changed or
out of place are found.  ``verify_documents`` refuses a store that fails this; it
reads every chunk, checks it against its digest and every recipe against its
root, and puts each document's CRC together from its chunks' CRCs by arithmetic
in GF(2)[x]; only digests and numbers move.  ``read_documents`` rebuilds the ids.

A chunk that a third of all documents share is one row per task when written,
and its join when read is one whose skewed partitions Spark splits.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, prepare, scratch_path, utf8
from .word_encoder import encoder

WINDOW = 16
#: Chunks have 2**CUT_BITS ids on average.
CUT_BITS = 9
BLOCK = 4 << 20
DIGEST = 16
POLY = 0xEDB88320
#: Children of a node of the manifest.
LEAVES = 1024


@dataclass(frozen=True)
class Store:
    path: str
    id_bytes: int
    root: str


class StoreDamaged(ValueError):
    """The store's recipes are not those that its manifest and root stand for."""


def digest_of(data) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [digest_of(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return digest_of(b"\2" + level[0])


def cut_places(ids: np.ndarray, starts: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks end early, by a hash of the last WINDOW ids; no chunk begins so near its document's start."""
    if len(ids) <= WINDOW:
        return np.zeros(0, np.int64)
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    k = 1
    while k < WINDOW:
        wider = h * np.uint32(1)
        wider[k:] += h[:-k] * np.uint32(pow(2246822519, k, 2**32))
        h, k = wider, 2 * k
    h ^= h >> np.uint32(16)
    h *= np.uint32(2246822519)
    hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    begun = starts[np.searchsorted(starts, hits - 1, "right") - 1]
    return hits[hits - begun >= WINDOW]


RECIPE, CHUNK = 0, 1
PACKED = "kind int, key binary, doc_id long, n_tokens long, digests array<binary>, sizes array<int>, root binary, ids binary"
RECIPES = "doc_id long, start long, n_tokens long, digests array<binary>, sizes array<int>, root binary, part int, row long"
MANIFEST = "part int, node long, first long, n_tokens long, n_recipes long, digest string, level int"
_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
_NAMES = ["kind", "key", "doc_id", "n_tokens", "digests", "sizes", "root", "ids"]


def _packer(tokenizer: str, end_id: int, id_bytes: int):
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches):
        own, seen = encoder(tokenizer), set()
        task = TaskContext.get().partitionId().to_bytes(8, "little")  # so that a task that runs again makes the same rows
        row = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            _, at = utf8(texts)
            for a, b in blocks(at, BLOCK):
                ids, ends = own.encode(texts.slice(a, b - a))
                ids = np.insert(ids, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                cuts = cut_places(ids, ends[:-1])
                data = memoryview(ids.astype(kind).tobytes())
                lo, hi = np.searchsorted(cuts, ends[:-1], "right"), np.searchsorted(cuts, ends[1:], "left")
                out = []
                for i in range(b - a):
                    s, e = int(ends[i]), int(ends[i + 1])
                    digests, sizes, p = [], [], s
                    for q in [*cuts[lo[i] : hi[i]].tolist(), e]:
                        part = data[p * id_bytes : q * id_bytes]
                        d = digest_of(part)
                        if d not in seen:
                            seen.add(d)
                            out.append((CHUNK, d, None, None, None, None, None, part.tobytes()))
                        digests.append(d)
                        sizes.append(q - p)
                        p = q
                    row += 1
                    out.append((RECIPE, digest_of(task + row.to_bytes(8, "little")), doc_ids[a + i], e - s, digests, sizes, merkle_root(digests), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


def _once(batches):
    """Of rows sorted by key, each chunk once; raises if one digest has two contents."""
    last_key, last_ids = None, None
    for batch in batches:
        keys, ids, kinds = batch.column(1).to_pylist(), batch.column(7), batch.column(0).to_pylist()
        keep = []
        for i, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
            if kind == CHUNK:
                now = ids[i].as_py()
                if key == last_key:
                    if now != last_ids:
                        raise ValueError(f"digest {key.hex()} has two contents")
                    continue
                last_key, last_ids = key, now
            keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Store:
    """Encodes all of docs into a new store; tokenizer is a file that all machines have."""
    spark = prepare(docs.sparkSession)
    path, id_bytes = path or scratch_path(spark, "tokens"), 2 if max(encoder(tokenizer).n_ids, end_id + 1) <= 65536 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_packer(tokenizer, end_id, id_bytes), PACKED)
    once = packed.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(_once, PACKED)
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/packed")
    recipes = _packed(spark, path, RECIPE).drop("ids", "kind")
    # Keys of recipes are unique, so ranges are even also where an id is null or repeated in a third of all rows.
    placed = recipes.repartitionByRange("doc_id", "root", "key").sortWithinPartitions("doc_id", "root", "key").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "placed")
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    before, total = {}, 0
    for r in sums:
        before[r["part"]] = total
        total += r["n"]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("part").orderBy("doc_id", "root", "key")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(base[F.col("part")], F.lit(0)).cast("long") + F.sum("n_tokens").over(upto) - F.col("n_tokens")
    row = (F.row_number().over(w) - 1).cast("long")
    placed.select("doc_id", start.alias("start"), "n_tokens", "digests", "sizes", "root", "part", row.alias("row")).write.parquet(f"{path}/recipes")
    _first_level(_recipes(spark, path)).withColumn("level", F.lit(0)).write.partitionBy("level").parquet(f"{path}/manifest")
    level = 0
    while True:
        now = _manifest(spark, path).filter(F.col("level") == level)
        if now.count() <= 1:
            break
        level += 1
        _next_level(now, level).withColumn("level", F.lit(level)).write.mode("append").partitionBy("level").parquet(f"{path}/manifest")
    top = now.first()
    root = top["digest"] if top else ""
    _write_text(spark, f"{path}/root", f"{id_bytes} {root}")
    return Store(path, id_bytes, root)


def open_store(spark, path: str) -> Store:
    """A store that was written before, by the file "root"; keep the Store of its writing where the folder is not to be trusted."""
    width, root = spark.read.text(f"{path}/root").first()[0].split(" ")
    return Store(path, int(width), root)


def _write_text(spark, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _hash_rows(row: str, leaf):
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(row), leaf.alias("leaf")))), lambda c: c["leaf"]), "|"), 256)


def _first_level(recipes: DataFrame) -> DataFrame:
    """Nodes over each LEAVES recipes of a part: at most so many rows meet in one group."""
    leaf = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")), "start", "n_tokens", F.hex("root"))
    nodes = recipes.groupBy("part", F.floor(F.col("row") / LEAVES).alias("node"))
    return nodes.agg(F.min("start").alias("first"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_recipes"), _hash_rows("row", leaf).alias("digest"))


def _next_level(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes over LEAVES nodes of a part while a part has several, then over the parts."""
    leaf = F.concat_ws(":", "first", "n_tokens", "n_recipes", "digest")
    most = nodes.agg(F.max("node")).first()[0]
    keys = ("part", F.floor(F.col("node") / LEAVES).alias("up")) if most else (F.floor(F.col("part") / LEAVES).cast("int").alias("up_part"), F.lit(0).cast("long").alias("up"))
    found = nodes.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_recipes").alias("n_recipes"), _hash_rows("first", leaf).alias("digest"))
    return found.withColumnsRenamed({"up": "node", "up_part": "part"})


def check_manifest(spark, store: Store) -> DataFrame:
    """(level, part, node, first, expected, found): nodes of the manifest that what lies below does not give; empty for a sound store.

    At level 0 a node stands for at most LEAVES recipes, whose ids begin at first; expected is null for recipes that the
    manifest does not know, found for recipes that are gone.  The last level is compared with the store's root.
    """
    kept = _manifest(spark, store.path)
    levels = (kept.agg(F.max("level")).first()[0] or 0) + 1
    out = None
    for level in range(levels):
        below = _first_level(_recipes(spark, store.path)) if level == 0 else _next_level(kept.filter(F.col("level") == level - 1), level)
        text = F.concat_ws(":", "first", "n_tokens", "n_recipes", "digest")
        now = below.select("part", "node", F.col("first").alias("f"), text.alias("found"))
        then = kept.filter(F.col("level") == level).select("part", "node", F.col("first").alias("g"), text.alias("expected"))
        both = then.join(now, ["part", "node"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("found")))
        both = both.select(F.lit(level).alias("level"), "part", "node", F.coalesce("g", "f").alias("first"), "expected", "found")
        out = both if out is None else out.unionByName(both)
    top = kept.filter(F.col("level") == levels - 1).select("digest").limit(2).collect()
    if [r["digest"] for r in top] != ([store.root] if store.root else []):
        said = spark.createDataFrame([(levels, None, None, None, store.root, ",".join(r["digest"] for r in top))], "level int, part int, node long, first long, expected string, found string")
        out = out.unionByName(said)
    return out


def _packed(spark, path: str, kind: int) -> DataFrame:
    return spark.read.schema(PACKED).parquet(f"{path}/packed").filter(F.col("kind") == kind)


def _chunks(spark, path: str) -> DataFrame:
    return _packed(spark, path, CHUNK).select(F.col("key").alias("digest"), "ids")


def _recipes(spark, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC's polynomial, lowest power in the highest bit."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    b, out = b.copy(), np.zeros(a.shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLY), np.uint32(0))
    return out


def byte_shift(n: np.ndarray) -> np.ndarray:
    """x to the power of eight times n: what n more bytes do to a CRC."""
    out = np.full(len(n), 1 << 31, np.uint32)
    power = np.array([1 << 30], np.uint32)
    for _ in range(3):
        power = multiply(power, power)
    n = n.astype(np.int64).copy()
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = multiply(out[odd], power)
        power = multiply(power, power)
        n >>= 1
    return out


def _facts(id_bytes: int):
    def run(batches):
        for batch in batches:
            rows = [(d, len(x) // id_bytes, zlib.crc32(np.frombuffer(x, f"<u{id_bytes}").astype("<u4").tobytes()), digest_of(x) == d) for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], names=["digest", "n", "crc", "sound"])

    return run


def _checked_recipes(batches):
    """(doc_id, start, digest, size, tail, sound) of each chunk of each recipe; tail: ids of the document after it."""
    for batch in batches:
        digests = batch.column(3)
        sizes = batch.column(4)
        off = np.asarray(digests.offsets).astype(np.int64)
        off = off - off[0]
        n = np.diff(off)
        size = np.asarray(sizes.flatten()).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        tail = np.repeat(ends[off[1:]], n) - ends[1:]
        sound = np.array([merkle_root(d) == r and sum(z) == t for d, r, z, t in zip(digests.to_pylist(), batch.column(5).to_pylist(), sizes.to_pylist(), batch.column(2).to_pylist(), strict=True)], bool)
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        arrays = [batch.column(0).take(rows), batch.column(1).take(rows), digests.flatten(), pa.array(size), pa.array(tail), pa.array(np.repeat(sound, n))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "digest", "size", "tail", "sound"])


def _shifted(batches):
    for batch in batches:
        crc, tail = np.asarray(batch.column(3)).astype(np.uint32), np.asarray(batch.column(4)).astype(np.int64)
        part = multiply(crc, byte_shift(4 * tail)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part), batch.column(5)], names=["doc_id", "start", "n", "part", "sound"])


def verify_documents(spark, store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, sound) of each document, from the store's files; raises StoreDamaged if the recipes fail the manifest."""
    prepare(spark)
    wrong = check_manifest(spark, store).limit(3).collect()
    if wrong:
        raise StoreDamaged(f"{store.path}: " + "; ".join(f"level {r['level']}, part {r['part']}, node {r['node']}, ids from {r['first']}" for r in wrong))
    facts = _chunks(spark, store.path).mapInArrow(_facts(store.id_bytes), "digest binary, n long, crc long, sound boolean")
    parts = _recipes(spark, store.path).mapInArrow(_checked_recipes, "doc_id long, start long, digest binary, size long, tail long, sound boolean")
    joined = parts.join(facts.withColumnRenamed("sound", "chunk_sound"), "digest", "left")
    sound = F.col("sound") & F.coalesce("chunk_sound", F.lit(False)) & (F.coalesce("n", F.lit(-1)) == F.col("size"))
    rows = joined.select("doc_id", "start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), "tail", sound.alias("sound"))
    moved = rows.mapInArrow(_shifted, "doc_id long, start long, n long, part long, sound boolean")
    grouped = moved.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"), F.bool_and("sound").alias("sound"))
    return grouped.select("doc_id", "start", "n_tokens", "ids_crc32", "sound")


def read_documents(spark, store: Store) -> DataFrame:
    """(doc_id, start, ids): each document's ids as they were written, a binary of the store's kind."""
    parts = _recipes(spark, store.path).select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    joined = parts.join(_chunks(spark, store.path), "digest")
    lists = joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", F.hex("ids").alias("ids")))).alias("x"))
    return lists.select("doc_id", "start", F.unhex(F.array_join("x.ids", "")).alias("ids"))
