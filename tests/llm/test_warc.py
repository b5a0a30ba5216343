import gzip
import hashlib
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphledger.llm import queries as Q
from glyphledger.llm import warc as W


def record(name, body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def rows(n, change=None, lose=(), add=None):
    out = []
    for i in range(n):
        if i not in lose:
            out.append(record(f"r{i}", f"body {i} é" * (i % 7) + ("!" if i == change else "")))
        if i == add:
            out.append(record("new", "inserted"))
    return out


def trees(spark, folder, files):
    for name, data in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    folder.mkdir(parents=True, exist_ok=True)
    return W.write_trees(W.read_trees(spark, str(folder)), 4)


def audited(spark, tmp_path, a, b):
    found = W.audit(spark, trees(spark, tmp_path / "a", a), trees(spark, tmp_path / "b", b))
    return sorted((r["archive"], r["kind"], r["record_id"]) for r in found.collect())


def test_a_lost_an_added_and_a_changed_record_are_one_row_each(spark, tmp_path):
    plain, packed = b"".join(rows(100)), b"".join(gzip.compress(r) for r in rows(100))
    a = {"x.warc": plain, "sub/x.warc": plain, "y.warc.gz": packed, "z.warc.gz": gzip.compress(plain), "same.warc": plain}
    b = {"x.warc": b"".join(rows(100, lose=(10,))), "sub/x.warc": b"".join(rows(100, add=50)), "y.warc.gz": b"".join(gzip.compress(r) for r in rows(100, 33)), "z.warc.gz": gzip.compress(b"".join(rows(100, 99, (0, 1)))), "same.warc": plain}
    got = audited(spark, tmp_path, a, b)
    assert got == [("sub/x.warc", "added", "new"), ("x.warc", "lost", "r10"), ("y.warc.gz", "changed", "r33"), ("z.warc.gz", "changed", "r99"), ("z.warc.gz", "lost", "r0"), ("z.warc.gz", "lost", "r1")]


def test_whole_archives_repeats_order_and_nothing(spark, tmp_path):
    five = rows(5)
    a = {"only.warc": b"".join(rows(2)), "twice.warc": b"".join([*five, five[0], five[0]]), "turned.warc": b"".join(rows(40)), "empty.warc": b""}
    b = {"twice.warc": b"".join([*five, five[0]]), "turned.warc": b"".join(rows(40)[::-1]), "more.warc": b"".join(rows(1))}
    assert audited(spark, tmp_path, a, b) == [("more.warc", "added", "r0"), ("only.warc", "lost", "r0"), ("only.warc", "lost", "r1"), ("turned.warc", "order", None), ("twice.warc", "lost", "r0")]
    got = W.audit(spark, trees(spark, tmp_path / "a", {}), trees(spark, tmp_path / "a", {}))
    assert got.count() == 0 and got.columns == [c.split()[0] for c in W.AUDIT.split(", ")]
    assert audited(spark, tmp_path / "n", {}, {}) == []
    assert audited(spark, tmp_path / "m", {"a.warc": five[0]}, {}) == [("a.warc", "lost", "r0")]


def test_damage_is_located_and_the_reader_goes_on(spark, tmp_path):
    some = rows(30)
    header, member, size = list(some), [gzip.compress(r) for r in some], list(some)
    header[7] = b"WARX" + header[7][4:]
    member[8] = member[8][:20] + bytes([member[8][20] ^ 255]) + member[8][21:]
    size[9] = size[9].replace(b"Content-Length: ", b"Content-Length: 9")
    a = {"h.warc": b"".join(some), "m.warc.gz": b"".join(gzip.compress(r) for r in some), "s.warc": b"".join(some)}
    b = {"h.warc": b"".join(header), "m.warc.gz": b"".join(member), "s.warc": b"".join(size)}
    got = W.audit(spark, trees(spark, tmp_path / "a", a), trees(spark, tmp_path / "b", b)).collect()
    assert sorted((r["archive"], r["kind"], r["record_id"]) for r in got) == sorted((f, k, i) for f, n in (("h.warc", "r7"), ("m.warc.gz", "r8"), ("s.warc", "r9")) for k, i in (("lost", n), ("unreadable", None)))
    bad = {r["archive"]: (r["offset_b"], r["length_b"]) for r in got if r["kind"] == "unreadable"}
    assert bad == {"h.warc": (sum(map(len, header[:7])), len(header[7])), "m.warc.gz": (sum(map(len, member[:8])), len(member[8])), "s.warc": (sum(map(len, size[:9])), len(size[9]))}


@pytest.mark.parametrize("data", [b"", b"nonsense", b"\x1f\x8b", gzip.compress(b"no record"), gzip.compress(b"".join(rows(9)))[:-9], b"WARC/1.0\r\n\r\n", record("", "")])
def test_odd_files_are_covered_without_gaps(data):
    found = list(W.parse_warc(data))
    if data[:2] != b"\x1f\x8b":
        assert sum(f.length for f in found) == len(data)
    assert bool(found) == bool(data)
    assert [f.readable for f in found] == [True] if data == record("", "") else not all(f.readable for f in found) or not data


def test_gzip_is_read_once():
    def seconds(n):
        data = b"".join(gzip.compress(record(f"r{i}", hashlib.sha256(str(i).encode()).hexdigest() * 60), 1) for i in range(n))
        began = time.process_time()
        assert len(list(W.parse_warc(data))) == n
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 8 * max(0.05, seconds(2000))


def test_a_node_shifts_no_other():
    def digests(records):
        return {(n[0], n[5]) for n in W.tree([f for f in records])}

    a, b = (list(W.parse_warc(b"".join(rows(5000, lose=lose)))) for lose in ((), (2500,)))
    assert len(digests(a) - digests(b)) <= 12 and len(digests(b) - digests(a)) <= 12


def test_query_equals_sql_and_takes_null_ids(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>é {i}</p>" * (i % 9) if i % 7 else None) for i in range(1500)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    got = Q.op5_warc_fixity(spark, f"{tmp_path}/sf")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/sf/pages.parquet/*.parquet'")
    want = db.sql(Q.SQL["op5_warc_fixity"])
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    assert {r["kind"] for r in got.collect()} == {"changed", "lost", "added"}
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (None, "u", "x"), (5, "u", ""), (5, "u", "")], "page_id long, url string, html string")
    every = F.lit(True)
    at = W.write_archives(odd, {"c": (every, F.col("html")), "d": (every, F.concat("html", F.lit("?")))}, f"{tmp_path}/odd")
    t = [W.write_trees(W.read_trees(spark, p, W.written_name)) for p in at.values()]
    assert sorted(r["record_id"] for r in W.audit(spark, *t).collect()) == ["urn:page:", "urn:page:5", "urn:page:5"]
    at = W.write_archives(odd.limit(0), {"e": (every, F.col("html"))}, f"{tmp_path}/none")
    assert W.read_trees(spark, at["e"]).count() == 0
