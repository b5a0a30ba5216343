"""URL rules in a sorted digest array.

The rules' XXH64 digests (seed 42, as Spark's own xxhash64) lie sorted in one
memory-mapped file beside their full strings, and before them those of their
hosts with the path lengths that each host has rules for.  Spark makes a key of
each suffix of a url's host, of up to as many labels as a rule has.  A vectorised
binary search probes the hosts for a whole Arrow batch; for the suffixes that
are there, and only for the lengths of that host, the digests of host and path
prefix are probed in the same way.  So a url costs a key a label, however many
lengths the list has.  Every hit is confirmed against the stored string, so
colliding digests do no harm.  No row moves: there is no shuffle.

A rule fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule wins, of equally long ones that with the longer
host.  Of rules that are given twice with different verdicts, block holds.
Without a rule the verdict is allow: the url is in no list.  Null urls and
those without "://" have an empty host and path and fit no rule.  Repeated rows
each get their verdict; other columns pass through, and the columns host, path,
rule and verdict replace those of the same name.

Rules beyond MAX_BLOB bytes go out as several files of at most that size, one
after another over the same rows; what is broadcast stays bounded.  The file
that is mapped is one without a name in the machine's temporary folder: a worker
writes its own from the broadcast and no other reads it.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SEED = 42
#: The largest digest file that is broadcast, in bytes.
MAX_BLOB = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), SEED)


def pack(rules: list[Rule], digest=_digest) -> bytes:
    """The file: counts; of the rules sorted keys, offsets, host lengths and verdicts; of the hosts sorted keys, offsets and path lengths; strings."""
    one: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if (r.host, r.path) not in one or r.verdict == "block":
            one[r.host, r.path] = r
    rows = sorted((digest(r.text), r.text, len(r.host), r.verdict) for r in one.values())
    raw = [r[1].encode() for r in rows]
    lengths: dict[int, set[int]] = {}
    for r in one.values():
        lengths.setdefault(digest(r.host), set()).add(len(r.path))
    hosts = sorted(lengths)
    sizes = [sorted(lengths[h]) for h in hosts]
    upto = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()
    return b"".join([
        struct.pack("<QQQ", len(rows), len(hosts), sum(map(len, sizes))),
        np.array([r[0] for r in rows], np.uint64).tobytes(),
        upto([len(x) for x in raw]),
        np.array([r[2] for r in rows], np.int64).tobytes(),
        np.array([r[3] == "block" for r in rows], np.int64).tobytes(),
        np.array(hosts, np.uint64).tobytes(),
        upto([len(x) for x in sizes]),
        np.array([n for x in sizes for n in x], np.int64).tobytes(),
        *raw,
    ])


class DigestArray:
    """A packed file, memory-mapped; its temporary file has no name and goes with the process."""

    def __init__(self, blob: bytes):
        self._file = tempfile.TemporaryFile()
        self._file.write(blob)
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        n, m, k = struct.unpack_from("<QQQ", self._map)
        at = 24

        def array(kind, size):
            nonlocal at
            found = np.frombuffer(self._map, kind, size, at)
            at += 8 * size
            return found

        self.keys, self._ends, self.hosts, self._block = array(np.uint64, n), array(np.int64, n + 1), array(np.int64, n), array(np.int64, n)
        self.host_keys, self._length_at, self._lengths = array(np.uint64, m), array(np.int64, m + 1), array(np.int64, k)
        self._strings = at

    def text(self, i: int) -> str:
        return self._map[self._strings + self._ends[i] : self._strings + self._ends[i + 1]].decode()

    def verdict(self, i: int) -> str:
        return "block" if self._block[i] else "allow"

    def lengths(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For host keys that are present: their index, once for each path length of that host, and the lengths."""
        low = np.searchsorted(self.host_keys, keys)
        hit = np.flatnonzero((low < len(self.host_keys)) & (self.host_keys[np.minimum(low, max(0, len(self.host_keys) - 1))] == keys)) if len(self.host_keys) else np.zeros(0, np.int64)
        begin, n = self._length_at[low[hit]], self._length_at[low[hit] + 1] - self._length_at[low[hit]]
        return np.repeat(hit, n), self._lengths[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For keys that are present: their index, and the range of entries with that digest."""
        low = np.searchsorted(self.keys, keys, "left")
        inside = low < len(self.keys)
        hit = np.flatnonzero(inside)[self.keys[low[inside]] == keys[inside]]
        return hit, low[hit], np.searchsorted(self.keys, keys[hit], "right")


_open: dict[str, DigestArray] = {}


def _prober(shared, key: str):
    def run(batches):
        if key not in _open:
            _open.clear()
            _open[key] = DigestArray(shared.value)
        rules = _open[key]
        for batch in batches:
            names = batch.schema.names
            at = {n: i for i, n in enumerate(names)}
            keys = batch.column(at["__keys"])
            ends = np.asarray(keys.offsets)
            ends = ends - ends[0]
            hosts, paths = batch.column(at["host"]), batch.column(at["path"])
            rule, verdict = batch.column(at["rule"]).to_pylist(), batch.column(at["verdict"]).to_pylist()
            width = batch.column(at["__width"]).to_pylist()
            place, length = rules.lengths(np.asarray(keys.flatten()).view(np.uint64))
            row = np.searchsorted(ends, place, "right") - 1
            asked = []  # (row, text, characters of it that are the host)
            for j, r, n in zip((place - ends[row]).tolist(), row.tolist(), length.tolist(), strict=True):
                path = paths[r].as_py()
                if len(path) >= n:
                    host = ".".join(hosts[r].as_py().split(".")[-1 - j :])
                    asked.append((r, host + path[:n], len(host)))
            hit, low, high = rules.probe(np.array([_digest(text) for _, text, _ in asked], np.uint64))
            for h, a, b in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True):
                r, text, n = asked[h]
                for i in range(a, b):
                    if rules.text(i) == text and rules.hosts[i] == n and (rule[r] is None or (len(text), n) > (len(rule[r]), width[r])):
                        rule[r], verdict[r], width[r] = text, rules.verdict(i), n
            out = {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string()), "__width": pa.array(width, pa.int32())}
            yield pa.RecordBatch.from_arrays([out.get(n, batch.column(i)) for n, i in at.items()], names=names)

    return run


def split_url(url) -> tuple:
    """Host and path columns of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _files(rules: list[Rule], most: int) -> list[list[Rule]]:
    files, size = [[]], 8
    for r in sorted(rules, key=lambda r: (r.host, r.path)):
        need = 72 + len(r.text.encode())
        same = files[-1] and (files[-1][-1].host, files[-1][-1].path) == (r.host, r.path)
        if size + need > most and files[-1] and not same:
            files.append([])
            size = 8
        files[-1].append(r)
        size += need
    return files


def filter_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", max_blob: int = MAX_BLOB) -> DataFrame:
    """df with host, path, rule and verdict."""
    prepare(df.sparkSession)
    host, path = split_url(F.col(url_col))
    df = df.drop("host", "path", "rule", "verdict") if {"host", "path", "rule", "verdict"} & set(df.columns) else df
    out = df.withColumns({"host": host, "path": path}).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow"), "__width": F.lit(0)})
    if not rules:
        return out.drop("__width")
    labels = max(r.host.count(".") + 1 for r in rules)
    parts = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, labels)
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.xxhash64(F.array_join(F.reverse(F.slice(parts, 1, i)), ".")))
    for some in _files(rules, max_blob):
        shared = df.sparkSession.sparkContext.broadcast(pack(some))
        out = out.withColumn("__keys", keys)
        out = out.mapInArrow(_prober(shared, uuid.uuid4().hex), out.schema).drop("__keys")
    return out.drop("__width")
