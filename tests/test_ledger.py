import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glyphledger.operators import cache as caches
from glyphledger.operators import collections as colls
from glyphledger.operators import ledger as led
from glyphledger.streaming.ledger_stream import apply_events, ledger_updates

EVENTS = "collection string, key string, ts timestamp, seq long, op string"
T0 = datetime(2024, 1, 1)


def replay(events):
    held = {}
    for c, k, ts, _, op in sorted(events, key=lambda e: (e[2], e[3])):
        mine = held.setdefault(c, {})
        if op == "clear":
            mine.clear()
        elif op == "remove":
            mine.pop(k, None)
        elif op == "inc":
            mine[k] = (mine[k][0] + 1, mine[k][1]) if k in mine else (1, ts)
        elif op == "dec" and k in mine:
            n, t = mine.pop(k)
            if n > 1:
                mine[k] = (n - 1, t)
    return {(c, k): v for c, m in held.items() for k, v in m.items()}


@pytest.fixture(scope="module")
def events():
    rng = random.Random(4)
    ops = ["inc"] * 6 + ["dec"] * 5 + ["remove", "clear"]
    return [(rng.choice("ab"), rng.choice("xyz"), T0 + timedelta(seconds=i // 2), i, rng.choice(ops)) for i in range(900)]


def test_fold_equals_replay(spark, events):
    got = {(r["collection"], r["key"]): (r["count"], r["added_at"]) for r in led.holdings(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == replay(events) and got


def test_history_never_below_zero(spark, events):
    assert led.history(spark.createDataFrame(events, EVENTS)).agg(F.min("count")).first()[0] >= 0
    assert led.holdings(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_function_equals_replay(events):
    held = {}
    for c in "ab":
        mine, last, rows = {}, [-1, -1], [(int((ts - T0).total_seconds()), s, k, op) for d, k, ts, s, op in events if d == c]
        for i in range(0, len(rows), 50):
            apply_events(mine, last, rows[i : i + 50])
        held |= {(c, k): n for k, (n, _) in mine.items()}
    assert held == {k: n for k, (n, _) in replay(events).items()}
    assert apply_events({}, [5, 0], [(4, 1, "x", "inc")])[1] == 1


def test_stream_equals_batch(spark, events, tmp_path):
    for i in range(3):
        spark.createDataFrame(events[i * 300 : i * 300 + 300], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ledger_updates(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True)
    out.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    changes = spark.read.parquet(f"{tmp_path}/out")
    last = changes.groupBy("collection", "key").agg(F.max_by("count", "batch").alias("count")).filter("count > 0")
    assert {(r["collection"], r["key"]): r["count"] for r in last.collect()} == {k: n for k, (n, _) in replay(events).items()}


def test_counts_totals_variants_export(spark):
    held = spark.createDataFrame([("a", "1_normal", None), ("a", "1_foil", 0), ("a", "2_normal", 3)], "collection string, key string, count int")
    t = led.totals(held).first()
    assert (t["unique_cards"], t["total_cards"], t["label"]) == (3, 5, "3 (5 total)")
    assert {r["card"]: (r["normal"], r["foil"]) for r in led.variant_quantities(held.fillna(1)).collect()} == {"1": (1, 0), "2": (3, 0)}
    wanted = spark.createDataFrame([("a", "2_normal"), ("a", "9_foil")], "collection string, key string")
    assert {r["key"]: r["count"] for r in led.quantities(held, wanted).collect()} == {"2_normal": 3, "9_foil": 0}
    rows = spark.createDataFrame([(0, 'A, "b"', None, None, True, None), (2, "C", "Set", "German", None, "007")], "count int, name string, set string, language_display string, is_foil boolean, number string")
    assert [r["line"] for r in led.export_rows(rows).collect()] == ['1,"A, ""b""",,Near Mint,English,Yes,', '2,"C","Set",Near Mint,German,No,007']
    assert led.export_rows(rows, compat=True).first()["line"] == '1,"A, "b"",,Near Mint,English,Yes,'
    nan = spark.createDataFrame([(float("nan"),)], "count double").select(led.real_count(F.col("count"))).first()[0]
    assert nan == 1


def test_upsert(spark):
    held = spark.createDataFrame([("a", "x", 1, T0), ("a", "y", None, T0)], "collection string, key string, count int, added_at timestamp")
    changes = spark.createDataFrame([("a", "x", -1, T0), ("a", "y", 1, T0), ("a", "z", 1, T0), ("a", "w", -1, T0)], "collection string, key string, delta int, ts timestamp")
    assert {r["key"]: r["count"] for r in led.upsert(held, changes).collect()} == {"y": 2, "z": 1}


COLLECTIONS = "ord int, id string, name string, created_at timestamp, last_modified timestamp, card_count int"


def test_collections(spark):
    c = spark.createDataFrame([(0, "a", "Main", T0, T0, 1), (1, "b", "Trade", T0 + timedelta(1), T0, 0)], COLLECTIONS)
    active = spark.createDataFrame([("a",)], "id string")
    names = lambda d: sorted(r["name"] for r in d.collect())
    assert names(colls.create(c, " main ", "n", T0)) == ["Main", "Trade"] and names(colls.create(c, " New ", "n", T0)) == ["Main", "New", "Trade"] and names(colls.create(c, "  ", "n", T0)) == ["Main", "Trade"]
    assert names(colls.rename(c, "a", "MAIN", T0)) == ["MAIN", "Trade"] and names(colls.rename(c, "a", "trade", T0)) == ["Main", "Trade"]
    kept, now = colls.delete(c, active, spark.createDataFrame([("a",)], "id string"))
    assert names(kept) == ["Trade"] and now.first()["id"] == "b"
    kept, now = colls.delete(c, active, c.select("id"))
    assert names(kept) == ["Main", "Trade"] and now.first()["id"] == "a"
    assert colls.switch(active, c, "b").first()["id"] == "b" and colls.switch(active, c, "zz").first()["id"] == "a"
    assert [(r["id"], r["is_active"]) for r in colls.listing(c, active).orderBy("place").collect()] == [("b", False), ("a", True)]
    assert names(colls.bootstrap(c.limit(0), "d", "Default", T0)) == ["Default"] and names(colls.bootstrap(c, "d", "Default", T0)) == ["Main", "Trade"]
    held = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "collection string, key string, count int")
    old = spark.createDataFrame([("z", 5)], "key string, count int")
    assert sorted(tuple(r) for r in colls.migrate(old, held, "a").collect()) == [("a", "z", 5), ("b", "y", 2)]
    assert sorted(tuple(r) for r in colls.migrate(old.limit(0), held, "a").collect()) == [("a", "x", 1), ("b", "y", 2)]
    assert {r["id"]: r["card_count"] for r in colls.recount(c, held, T0).collect()} == {"a": 1, "b": 2}


def test_caches(spark):
    now = 10 * caches.TTL_MS
    c = spark.createDataFrame([("a", now - caches.TTL_MS), ("b", now - caches.TTL_MS + 60_000), ("c", None)], "key string, ts_ms long")
    assert [r["key"] for r in caches.fresh(c, now).collect()] == ["b"]
    for n, left in ((1, 0), (4, 3), (5, 3), (0, 0)):
        rows = spark.createDataFrame([(f"k{i}", None if i == 3 else (i + 1) * 1000) for i in range(n)], "key string, ts_ms long")
        kept = sorted(r["key"] for r in caches.evict(rows).collect())
        assert len(kept) == left and (n < 4 or "k3" not in kept)
    many = [(f"{'xyz'[i % 3]}{i}", None if i % 3 else (i % 2 - 1) * 7_200_000 + i) for i in range(60)]
    gone = sorted(many, key=lambda r: (r[1] or 0, r[0]))[:15]
    kept = caches.evict(spark.createDataFrame(many, "key string, ts_ms long")).collect()
    assert sorted(r["key"] for r in kept) == sorted(k for k, _ in set(many) - set(gone))


def test_list_and_clears_over_many_days(spark):
    rows = [(i, f"id{i:02d}", f"n{i}", None if i % 9 == 0 else f"2024-01-{1 + i % 5:02d} 0{i % 3}:30:{i % 2:02d}", 0) for i in range(50)]
    c = spark.createDataFrame(rows, "ord int, id string, name string, at string, card_count int").withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    got = [r["id"] for r in colls.listing(c, spark.createDataFrame([("id03",)], "id string")).orderBy("place").collect()]
    assert got == [r[1] for r in sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: r[3] or "", reverse=True)]
    events = [("a", "k", None if i < 3 else f"2024-01-{1 + i // 6:02d} 0{i % 6}:00:00", i, "clear" if i % 7 == 3 else "inc") for i in range(60)]
    e = spark.createDataFrame(events, "collection string, key string, t string, seq long, op string").withColumn("ts", F.col("t").cast("timestamp"))
    seen = {r["seq"]: r["clears"] for r in led.with_clears(e).collect()}
    order = sorted(events, key=lambda r: (r[2] or "", r[3]))
    assert seen == {r[3]: sum(x[4] == "clear" for x in order[: k + 1]) for k, r in enumerate(order)}
