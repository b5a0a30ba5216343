from base64 import b64encode

import pytest
from fixtures import ADVANCED, ADVANCED_CONFIGS, BASIC, LABELS, TEXTS
from pyspark.sql import functions as F

from glyphledger.functions import accuracy as acc
from glyphledger.functions import text as txt
from glyphledger.operators import evaluate as ev
from glyphledger.operators import lookup


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_clean_score_choose_parse(spark):
    df = spark.createDataFrame([(t[0],) for t in TEXTS], "raw string").withColumn("cleaned", txt.clean_text(F.col("raw")))
    df = df.select("*", txt.choose_text(F.col("raw"), F.col("cleaned")).alias("c"))
    rows = df.select("*", txt.parse_key(F.col("c.final_text")).alias("k")).collect()
    for r, (_, cleaned, a, b, final, key) in zip(rows, TEXTS, strict=True):
        assert (r["cleaned"], r["c"]["raw_score"], r["c"]["cleaned_score"], r["c"]["final_text"]) == (cleaned, a, b, final)
        assert (tuple(r["k"]) if r["k"] else None) == key


def test_odd_texts(spark):
    assert one(spark, txt.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, txt.score_text(F.lit(None).cast("string"))) == 0
    assert one(spark, txt.squeeze(F.lit("﻿ a  b\x0b "))) == "a b"
    assert one(spark, txt.parse_key(F.lit("äEN 0123 FDN"))) == ("FDN", "0123", "EN")
    assert one(spark, txt.parse_key(F.lit("FDN C 0001"), ["FD", "FDN"])) == ("FD", "0001", None)


#: Text, what it cleans to, its score as it stands, and its key.
UNICODE = [
    ("\u00a0C\u20030100\ufeffFDN\u3000DE\u2028", "C 0100 FDN DE", 110, ("FDN", "0100", "DE")),
    ("Cc\u00a00100 FDN\u2009de", "C 0100 FDN DE", 85, ("FDN", "0100", "DE")),
    ("C 0100 fdn deß", "C 0100 FDN DE", 35, ("FDN", "0100", None)),
    ("ä0100 FDN üDEö", "0100 FDN DE", 95, ("FDN", "0100", "DE")),
    ("wﬂ woe 123 kŉ", "W WOE 123 K", 35, ("WOE", "123", None)),
    ("🙂🙂🙂🙂🙂🙂", "", 5, None),
    ("🙂🙂🙂🙂🙂", "", 0, None),
    ("٣٤٥ FDN", "FDN", 50, None),
    ("ıſſ FDN 00000 \x85EN", "FDN 0 EN", 95, ("FDN", "00000", "EN")),
]


@pytest.mark.parametrize(("raw", "cleaned", "score", "key"), UNICODE)
def test_whole_texts_beyond_ascii(spark, raw, cleaned, score, key):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(txt.clean_text(F.col("raw")).alias("c"), txt.score_text(F.col("raw")).alias("s"), txt.parse_key(F.col("raw")).alias("k")).first()
    assert (got["c"], got["s"], tuple(got["k"]) if got["k"] else None) == (cleaned, score, key)
    row = lookup.parse_keys(df, "raw").first()
    assert (row["set_code"], row["number"], row["language"]) == (key or (None, None, None))


def test_sql_of_whole_texts_says_the_same(spark):
    """The SQL that checks the queries, on texts that the data may not hold."""
    import duckdb

    from glyphledger.plans import catalog_of_queries as q

    db = duckdb.connect()
    db.execute("CREATE TABLE scan_text AS SELECT unnest($1) AS raw", [[u[0] for u in UNICODE]])
    db.execute("ALTER TABLE scan_text ADD COLUMN scan_id VARCHAR")
    rows = db.execute("WITH " + q._CHOSEN + " SELECT raw, cleaned, raw_score FROM parsed").fetchall()
    assert sorted(rows) == sorted(u[:3] for u in UNICODE)
    keys = db.execute("WITH " + q._CHOSEN.replace("CASE WHEN raw_score > cleaned_score THEN raw ELSE cleaned END", "raw") + " SELECT raw, set_code, number, language FROM parsed").fetchall()
    assert sorted(keys, key=str) == sorted(((u[0], *(u[3] or (None, None, None))) for u in UNICODE), key=str)


def test_cache_keys_are_on_one_line(spark):
    urls = ["", "a", "u" * 57, "u" * 58, "https://example.org/" + "ä€𝄞\r\n" * 200, None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", txt.cache_key(F.col("u")).alias("key")).collect()
    assert [r["key"] for r in rows] == [None if u is None else "card-image-" + b64encode(u.encode()).decode() for u in urls]


def test_small_functions(spark):
    assert one(spark, txt.parse_code(F.lit("C 7 FDN DE"))) == ("C", "007", "fdn", "de")
    assert one(spark, txt.parse_code(F.lit("C 12345 FDN DE")))[1] == "12345"
    assert one(spark, txt.parse_code(F.lit("nothing"))) is None
    assert one(spark, txt.unique_id(F.lit(""), F.lit("b"), F.lit(None).cast("boolean"))) == "b_normal"
    assert one(spark, txt.unique_id(F.lit(None).cast("string"), F.lit(""), F.lit(True))) is None
    assert one(spark, txt.escape_html(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, txt.card_path(F.lit("FDN"), F.lit("0100"), F.lit("de"))) == "/cards/fdn/100?lang=de"
    assert one(spark, txt.card_path(F.lit("FDN"), F.lit("0100"))) == "/cards/fdn/100"
    assert one(spark, txt.fixed(F.lit(3.14159))) == "3.1"
    assert one(spark, txt.pad_end(F.lit("abcdef"), 3)) == "abcdef"
    assert one(spark, txt.parse_int(F.lit("012x"))) == 12 and one(spark, txt.parse_int(F.lit("x"))) is None
    assert one(spark, txt.language_code(F.lit("ZH"))) == "zhs" and one(spark, txt.language_code(F.lit(None).cast("string"))) == "en"
    assert one(spark, txt.language_name(F.lit("JP"))) == "Japanese" and one(spark, txt.language_name(F.lit("XX"))) == "English"
    assert one(spark, txt.label_from_name(F.lit("Foo_1 Bär"))) == "Foo   Bär"
    assert one(spark, txt.new_collection_id()).startswith("coll_")


@pytest.mark.parametrize(("runs", "measure"), [(BASIC, acc.accuracy_basic), (ADVANCED, acc.accuracy_tolerant)])
def test_recorded_accuracies(spark, runs, measure):
    rows = [(LABELS[s], t, float(a)) for s, found in runs.items() for t, a in found]
    got = spark.createDataFrame(rows, "e string, t string, a double").select("a", measure(F.col("e"), F.col("t")).alias("b")).collect()
    assert len(got) in (33, 36) and all(abs(r["a"] - r["b"]) < 1e-9 for r in got)


def test_report_of_the_recorded_run(spark):
    rows = [(s, LABELS[s], t, name, k, prep) for s, found in ADVANCED.items() for k, ((t, _), (name, prep)) in enumerate(zip(found, ADVANCED_CONFIGS, strict=True))]
    df = spark.createDataFrame(rows, "image string, expected string, recognized string, config string, config_ord int, preprocessing string")
    df = df.withColumns({"accuracy": acc.accuracy_tolerant(F.col("expected"), F.col("recognized")), "success": F.lit(True), "confidence": F.lit(50.0), "process_time": F.lit(200)})
    ranked = ev.rank_configs(ev.config_stats(df)).orderBy("place").collect()
    assert ranked[0]["config"] == "German Inverted" and round(ranked[0]["avg_accuracy"], 4) == 13.4617 and ranked[0]["medal"] == "gold" and len(ranked) == 12
    assert [r["config"] for r in ranked if r["medal"] is None][:1] == ["German Upscaled"]
    assert {r["image"]: r["best_config"] for r in ev.best_config(df).collect()} == {"C 0100 FDN DE": "German Sharpen", "C 0214 FDN DE": "German Inverted", "U 0125 FDN DE": "German High Contrast"}
    by = {r["preprocessing"]: round(r["avg_accuracy"], 2) for r in ev.stats_by(df, "preprocessing").collect()}
    assert by == {"invert": 13.46, "sharpen": 11.37, "upscale": 8.61, "contrast": 7.84, "none": 6.54}
    total = ev.overall_stats(df).first()
    assert (total["total"], total["successful"], total["above80"], total["verdict"]) == (36, 36, 0, "poor")
    assert [r["times"] for r in ev.common_texts(df).collect()] == [4, 4, 4]


def test_accuracy_edges(spark):
    for f in (acc.accuracy_basic, acc.accuracy_tolerant):
        assert one(spark, f(F.lit(""), F.lit("a"))) == 0 and one(spark, f(F.lit(None).cast("string"), F.lit("a"))) == 0
        assert one(spark, f(F.lit(" Ab "), F.lit("aB"))) == 100
        assert one(spark, f(F.lit("  "), F.lit("x"))) == (0 if f is acc.accuracy_basic else 50)
    assert one(spark, acc.accuracy_tolerant(F.lit("ab cd ef gh"), F.lit("ab cd"))) == 50
    failed = spark.createDataFrame([("i", "e", "", "c", 0, 0.0, False)], "image string, expected string, recognized string, config string, config_ord int, accuracy double, success boolean")
    assert ev.best_config(failed).first()["best_config"] == "" and ev.overall_stats(failed.limit(0)).first()["success_rate"] is None


def test_lookups(spark):
    catalog = spark.createDataFrame([("x", "Card", "fdn", 100, "en"), ("y", "Karte", "fdn", 100, "de"), ("z", "Kaart", "fdn", 102, "de")], "card_id string, name string, set string, catalog_number int, lang string")
    asked = [("FDN", "0100", "EN"), ("FDN", "0100", None), ("FDN", "00100", "DE"), ("FDN", "0100", "FR"), ("FDN", "0102", None), ("FDN", "0101", "DE"), (None, None, None), ("FDN", "zz", "DE")]
    keys = spark.createDataFrame([(i, *k) for i, k in enumerate(asked)], "i int, set_code string, number string, language string")
    found = lookup.resolve(keys, catalog).orderBy("i").collect()
    assert [r["card_id"] for r in found] == ["x", "x", "y", None, None, None, None, None]
    assert [r["api_language"] for r in found] == ["en", "en", "de", "fr", "en", "de", None, "de"]
    named = lookup.label_catalog(keys.select(F.concat(F.lit("f"), "i").alias("code"), "set_code", "number", "language"), catalog)
    assert {r["code"]: r["expected"] for r in named.collect()} == {"f0": "Card", "f1": "Card", "f2": "Karte"}
    labels = spark.createDataFrame(list(LABELS.items()), "code string, expected string")
    files = spark.createDataFrame([("C 0100 FDN DE",), ("Foo_2",)], "stem string")
    assert {r["stem"]: r["expected"] for r in lookup.label(files, labels).collect()} == {"C 0100 FDN DE": "Tierlieber Waldläufer", "Foo_2": "Foo"}
    raw = spark.createDataFrame([("i", "n", "s", "S", "1", None, [(("face",),)])], "id string, name string, set string, set_name string, collector_number string, image_uris struct<normal:string>, card_faces array<struct<image_uris:struct<normal:string>>>")
    assert lookup.catalog_cards(raw).first()["image"] == "face"
