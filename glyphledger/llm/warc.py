r"""Merkle fixity audit of WARC replicas.

Trees.  A replica is a folder of archives, .warc or .warc.gz files.  Each file
is read where it lies and becomes one Merkle tree: leaves are its records (id,
range of offsets, SHA-256 of the bytes), in order of offset; a node covers the
neighbours up to one whose id hashes to a multiple of FANOUT (at most MOST of
them), and its digest is over their lengths and digests in order.  So a record
that one replica lost or gained shifts no other node.  The trees are a table
(level, shard, archive, node, parent, offset, length, digest, ...) that lies
in folders by level and shard, a hash of the archive's name.

Audit.  First one digest a replica, then one a shard, then the archives' roots
are compared.  Only shards with a difference are read further, level by level;
of each level, only the children of nodes that differ are compared, by digest,
so that equal parts cancel wherever they stand.  What is left at the leaves are
the records that differ, matched by id: "changed", "lost" (only in a), "added"
(only in b).  Bytes that are no record are "unreadable", with their range: the
reader goes on at the next record or gzip member.  An archive that differs in
none of these has its records in another order: "order".

Limits.  A file is read by one task, which holds it and its records; files are
of bounded size.  Members of gzip files are opened in bounded slices, each byte
once.  Ranges are those in the file, but for records that share one gzip member
(or whose file is one member) those in the unpacked member, counted from its offset.

Null ids, urls and bodies are empty strings.  Records repeated under one id are
matched by digest first, then in order.  Empty folders have no trees; their
audit is empty.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, scratch_path

FANOUT, MOST = 16, 256
#: Folders of the tree table; one for some millions of records.
SHARDS = 16
ARCHIVE_RECORDS = 500
SLICE = 1 << 16
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_ID = re.compile(rb"^warc-record-id:[ \t]*<?(.*?)>?[ \t]*\r?$", re.I | re.M)
_GZIP = b"\x1f\x8b\x08"
END = "\r\n\r\n"


# Writing.


def record_text(record_id, url, body):
    """A WARC response record as a string column, but for the two line ends that close it."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(F.coalesce(body, F.lit(""))).cast("string"), F.lit(END),
    )
    return F.concat(head, F.coalesce(body, F.lit("")))


def write_archives(pages: DataFrame, replicas: dict, path: str, id_col: str = "page_id", url_col: str = "url", archive_records: int = ARCHIVE_RECORDS) -> dict[str, str]:
    """Writes replicas of pages, {name: (which rows, their body)}, as gzip archives, one for so many neighbouring ids; gives their folders.

    The pages are shuffled once for all replicas.  Null ids are spread by url.
    An archive that repeated ids make four times as long goes on in further
    files, so no file is unbounded.
    """
    name = F.coalesce(F.floor(F.col(id_col) / archive_records).cast("string"), F.concat(F.lit("none-"), F.crc32(F.coalesce(F.col(url_col), F.lit("")).cast("binary")) % 1024))
    dealt = pages.withColumn("__archive", name).repartition("__archive")
    copies = [F.when(rows, F.struct(F.lit(k).alias("replica"), record_text(F.col(id_col), F.col(url_col), body).alias("value"))) for k, (rows, body) in replicas.items()]
    rows = dealt.select(F.col("__archive").alias("archive"), F.col(id_col).alias("i"), F.explode(F.array(*copies)).alias("c")).filter("c IS NOT NULL")
    rows = rows.select("c.replica", "archive", "i", "c.value").sortWithinPartitions("replica", "archive", "i", "value").select("replica", "archive", "value")
    out = rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", END).option("maxRecordsPerFile", 4 * archive_records)
    out.partitionBy("replica", "archive").text(path)
    return {k: f"{path}/replica={k}" for k in replicas}


def written_name(name):
    """The archive of a file of write_archives: its folder, and the file's number from the second on."""
    number = F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("int")
    return F.concat(F.regexp_extract(name, r"archive=([^/]*)/", 1), F.when(number > 0, F.concat(F.lit("."), number)).otherwise(""))


# Reading.


@dataclass
class Found:
    offset: int
    length: int
    record_id: str | None
    digest: str
    readable: bool = True


def _sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def _plain_end(data, at: int) -> tuple[int, str] | None:
    """Where the record that begins at a place ends, and its id; None if there is no whole record."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0 or not data.startswith(b"WARC/", at):
        return None
    length, name = _LENGTH.search(data, at, head + 2), _ID.search(data, at, head + 2)
    if not length:
        return None
    end = head + 4 + int(length[1]) + 4
    if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
        return None
    return end, name[1].decode("utf-8", "replace") if name else ""


def _plain(data: bytes, base: int = 0):
    """Records of unpacked bytes, and the ranges between them that are none."""
    at = 0
    while at < len(data):
        found = _plain_end(data, at)
        if found:
            end, name = found
            yield Found(base + at, end - at, name, _sha(memoryview(data)[at:end]))
        else:
            end = data.find(b"\r\n\r\nWARC/", at)
            end = len(data) if end < 0 else end + 4
            yield Found(base + at, end - at, None, _sha(memoryview(data)[at:end]), False)
        at = end


def _member(data, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at a place holds, where it ends, and whether it is whole; each byte is fed once."""
    z, parts, view = zlib.decompressobj(31), [], memoryview(data)
    p = at
    try:
        while not z.eof and p < len(data):
            parts.append(z.decompress(view[p : p + SLICE]))
            p += SLICE
    except zlib.error:
        return b"".join(parts), at, False
    return b"".join(parts), min(p, len(data)) - len(z.unused_data), z.eof


def parse_warc(data: bytes):
    """Every record of a file in order, and the ranges that are unreadable."""
    if not data.startswith(_GZIP) and data.find(b"WARC/", 0, 16) == 0:
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        held, end, whole = _member(data, at) if data.startswith(_GZIP, at) else (b"", at, False)
        records = list(_plain(held, at))
        if whole:
            if len(records) == 1 and (at or end < len(data)):
                records[0].offset, records[0].length = at, end - at
            yield from records
            at = end
            continue
        # What a damaged member still gives counts; the rest, up to the next member that begins a record, does not.
        yield from (r for r in records if r.readable)
        after = data.find(_GZIP, at + 1)
        while after >= 0 and not _begins(data, after):
            after = data.find(_GZIP, after + 1)
        end = after if after >= 0 else len(data)
        yield Found(at, end - at, None, _sha(memoryview(data)[at:end]), False)
        at = end


def _begins(data, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + 512], 5) == b"WARC/"
    except zlib.error:
        return False


def tree(records: list[Found]):
    """(level, node, parent, offset, length, digest, record_id, readable) of every node; the root has no parent."""
    level = [(r.offset, r.length, r.digest, r.record_id, r.readable, xxhash.xxh64_intdigest((r.record_id or r.digest).encode())) for r in records]
    depth = 0
    while level:
        groups, now = [], []
        for row in level:
            now.append(row)
            if (xxhash.xxh64_intdigest(row[5].to_bytes(8, "little"), depth) % FANOUT == 0 and len(now) > 1) or len(now) == MOST:
                groups.append(now)
                now = []
        if now:
            groups.append(now)
        last, node, upper = len(level) == 1, 0, []
        for k, group in enumerate(groups):
            digest = hashlib.sha256(b"%d" % depth)
            for offset, length, own, name, readable, _ in group:
                yield depth, node, None if last else k, offset, length, own, name, readable
                digest.update(b"|%d:%s" % (length, own.encode()))
                node += 1
            upper.append((group[0][0], sum(g[1] for g in group), digest.hexdigest(), None, True, group[-1][5]))
        if last:
            return
        level, depth = upper, depth + 1


_NAMES = ["archive", "level", "node", "parent", "offset", "length", "digest", "record_id", "readable"]
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):  # a file at a time
            name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            rows = [(name, *row) for row in tree(list(parse_warc(data)))]
            for a in range(0, len(rows), 10_000):
                some = zip(*rows[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, _KINDS, strict=True)], names=_NAMES)


def read_trees(spark, path: str, name=lambda relative: relative) -> DataFrame:
    """The trees of all .warc and .warc.gz files under path (or .txt and .txt.gz); an archive is known by its path below that folder.

    name maps the column of these paths to the archives' names.
    """
    prepare(spark)
    schema = "archive string, level int, node long, parent long, offset long, length long, digest string, record_id string, readable boolean"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):  # a replica without records
        return spark.createDataFrame([], schema)
    root = store.makeQualified(p).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,gz,txt}").load(path)
    below = F.expr(f"substring(path, {len(root) + 2})")
    return files.select(name(below).alias("archive"), "content").mapInArrow(_read, schema)


@dataclass(frozen=True)
class Trees:
    path: str
    shards: int
    levels: int


def write_trees(nodes: DataFrame, shards: int = SHARDS, path: str | None = None) -> Trees:
    """Lays the trees down by level and shard."""
    spark = nodes.sparkSession
    path = path or scratch_path(spark, "trees")
    rows = nodes.withColumn("shard", F.pmod(F.xxhash64("archive"), F.lit(shards)).cast("int"))
    rows.repartition("shard").write.partitionBy("level", "shard").parquet(path)
    top = _nodes(spark, path).agg(F.max("level")).first()[0]
    return Trees(path, shards, -1 if top is None else top)


def _nodes(spark, path: str) -> DataFrame:
    return spark.read.schema("archive string, node long, parent long, offset long, length long, digest string, record_id string, readable boolean, level int, shard int").parquet(path)


def _level(spark, trees: Trees, level: int, shards: list[int]) -> DataFrame:
    return _nodes(spark, trees.path).filter((F.col("level") == level) & F.col("shard").isin(shards))


# Comparing.


def _roots(spark, trees: Trees, shards: list[int] | None = None) -> DataFrame:
    rows = _nodes(spark, trees.path).filter("parent IS NULL")
    rows = rows if shards is None else rows.filter(F.col("shard").isin(shards))
    return rows.select("shard", "archive", "level", "digest")


def shard_digests(spark, trees: Trees) -> dict[int, str]:
    """One digest a shard, over blocks of its archives' roots; at most as many rows as there are shards come to the driver."""
    block = F.pmod(F.xxhash64("archive", F.lit(1)), F.lit(1024))
    rows = _roots(spark, trees).groupBy("shard", block.alias("block")).agg(F.sort_array(F.collect_list(F.concat_ws("=", "archive", "digest"))).alias("r"))
    rows = rows.select("shard", "block", F.sha2(F.array_join("r", "|"), 256).alias("d"))
    out = rows.groupBy("shard").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.format_string("%04d", "block"), "d"))), "|"), 256).alias("d"))
    return {r["shard"]: r["d"] for r in out.collect()}


def replica_root(digests: dict[int, str]) -> str:
    return _sha("|".join(f"{k}={digests[k]}" for k in sorted(digests)).encode())


AUDIT = "archive string, kind string, record_id string, offset_a long, length_a long, digest_a string, offset_b long, length_b long, digest_b string"


def audit(spark, a: Trees, b: Trees) -> DataFrame:
    """A row for each record that changed, was lost or was added from a to b, and for unreadable ranges and archives in another order."""
    if a.shards != b.shards:
        raise ValueError("the replicas' trees have different numbers of shards")
    left, right = shard_digests(spark, a), shard_digests(spark, b)
    if replica_root(left) == replica_root(right):
        return spark.createDataFrame([], AUDIT)
    shards = [s for s in range(a.shards) if left.get(s) != right.get(s)]
    x, y = (_roots(spark, t, shards).select("archive", F.col("digest").alias(d)) for t, d in ((a, "x"), (b, "y")))
    differing = _kept(x.join(y, "archive", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("archive"))
    above = None
    for level in range(max(a.levels, b.levels), -1, -1):
        nodes = _level(spark, a, level, shards).withColumn("side", F.lit(0)).unionByName(_level(spark, b, level, shards).withColumn("side", F.lit(1)))
        above = _kept(_left_over(_under(nodes, differing, above), ["archive", "record_id", "digest"] if level == 0 else ["archive", "digest"]))
    found = _kept(_matched(above))
    quiet = differing.join(found.select("archive").distinct(), "archive", "left_anti").select("archive", F.lit("order").alias("kind"))
    return found.unionByName(quiet, allowMissingColumns=True)


def _kept(df: DataFrame) -> DataFrame:
    return materialize(df, "differing")


def _under(nodes: DataFrame, differing: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes of a level, of both sides, that are roots of differing archives or children of nodes that differ."""
    roots = nodes.filter("parent IS NULL").join(differing, "archive", "left_semi")
    if above is None:
        return roots
    parents = above.select("archive", "side", F.col("node").alias("parent"))
    return roots.unionByName(nodes.filter("parent IS NOT NULL").join(parents, ["archive", "side", "parent"], "left_semi").select(*roots.columns))


def _left_over(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a partner of the same key on the other side, as often as they stand there."""
    same = Window.partitionBy(*key)
    counts = [F.count_if(F.col("side") == s).over(same) for s in (0, 1)]
    nth = F.row_number().over(Window.partitionBy(*key, "side").orderBy("offset", "node"))
    return nodes.withColumns({"pairs": F.least(*counts), "nth": nth}).filter("nth > pairs").drop("pairs", "nth")


def _matched(records: DataFrame) -> DataFrame:
    """Records left on both sides side by side, by id and then by order; unreadable ranges stand alone."""
    w = Window.partitionBy("archive", "record_id", "readable", "side").orderBy("offset", "node")
    place = F.when(F.col("readable"), F.row_number().over(w)).otherwise(F.row_number().over(w) * 2 + F.col("side"))
    side = lambda s: [F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{n}_{'ab'[s]}") for n in ("offset", "length", "digest")]
    both = records.withColumn("place", place).groupBy("archive", "record_id", "readable", "place").agg(*side(0), *side(1))
    kind = F.when(~F.col("readable"), "unreadable").when(F.col("digest_b").isNull(), "lost").when(F.col("digest_a").isNull(), "added").otherwise("changed")
    return both.select("archive", kind.alias("kind"), "record_id", "offset_a", "length_a", "digest_a", "offset_b", "length_b", "digest_b")
