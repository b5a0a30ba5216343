"""The engine's input tables, bound to a star schema with events, documents and vectors.

Each view is a DataFrame here and, under the same name, a common table
expression in ``sql_views``; queries and their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANKS, LANGUAGES, RARITIES, SET_CODES, language_code

#: The moment at which cached entries are judged.
AS_OF_MS = 1_704_067_200_000 + 10 * 86_400_000
LANGS = list(LANGUAGES)
CONFIGS = [
    ("English Default", "eng", "none"), ("English Contrast", "eng", "contrast"), ("German Default", "deu", "none"), ("German Inverted", "deu", "invert"),
    ("English+German", "eng+deu", "none"), ("German Sharpen", "deu", "sharpen"), ("Upscaled", None, "upscale"), ("German Blank", "deu", "contrast"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def strips(spark, sf_dir) -> DataFrame:
    """(part_key, rarity, number, set_code, language, raw): a noisy collector line per part."""
    k = F.col("part_key")
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.substring(F.lit(RARITIES), F.col("p_size") % 8 + 1, F.lit(1)).alias("rarity"), F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("number"),
        pick(SET_CODES, F.col("p_partkey") % 7).alias("set_code"), pick(LANGS, F.col("p_partkey") % 10).alias("language"), "p_name", "p_type", "p_size",
    )
    base = F.concat_ws(" ", "rarity", "number", "set_code", "language")
    noisy = (
        F.when(k % 6 == 1, F.concat("rarity", F.lower("rarity"), F.lit(" "), "number", F.lit(" "), "set_code", F.lit(" "), "language"))
        .when(k % 6 == 2, F.concat(base, F.lit(" |")))
        .when(k % 6 == 3, F.concat(F.lit("LER  "), base))
        .when(k % 6 == 4, F.concat_ws(" ", "rarity", "number", "set_code", F.lower("language")))
        .when(k % 6 == 5, F.concat("rarity", F.lit(" "), "number", F.lit(" "), "set_code", F.lit(" +"), "language"))
        .otherwise(base)
    )
    return p.withColumn("raw", noisy)


def scan_text(spark, sf_dir) -> DataFrame:
    """(scan_id, raw): the strips, and all texts of documents, benchmark and conversations, whole."""

    def texts(name, key):
        return table(spark, sf_dir, name).select(key.alias("scan_id"), F.coalesce("text", F.lit("")).alias("raw"))

    key = lambda p, *c: F.concat(F.lit(p), *c)
    parts = [
        strips(spark, sf_dir).select(key("p", F.col("part_key")).alias("scan_id"), "raw"),
        texts("documents", key("d", F.col("doc_id"))), texts("benchmark", key("b", F.col("item_id"))), texts("conversations", key("c", F.col("conv_id"), F.lit("-"), F.col("turn"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog(spark, sf_dir) -> DataFrame:
    """(card_id, name, set, catalog_number, lang): an English card per part, but for those of one type, and for two of three a card in the part's language."""
    s = strips(spark, sf_dir).filter("p_type != 'ECONOMY'")
    own = language_code(F.col("language"))
    langs = F.array_distinct(F.when(F.col("part_key") % 3 > 0, F.array(F.lit("en"), own)).otherwise(F.array(F.lit("en"))))
    rows = s.withColumn("lang", F.explode(langs))
    return rows.select(F.concat_ws("-", F.lit("card"), "part_key", "lang").alias("card_id"), F.col("p_name").alias("name"), F.lower("set_code").alias("set"), F.col("number").cast("int").alias("catalog_number"), "lang")


def configs(spark) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CONFIGS)], "config_ord int, name string, lang string, preprocessing string")


def recognitions(spark, sf_dir) -> DataFrame:
    """Each part's name as each configuration read it, not yet judged."""
    from ..operators.evaluate import pair_configs

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.col("p_name").alias("expected"), "p_brand", "p_type", "p_size")
    both = pair_configs(p, configs(spark))
    o, e, k = F.col("config_ord"), F.col("expected"), F.col("image")
    read = (
        F.when(o == 0, e).when(o == 1, F.replace(e, F.lit("l"), F.lit("1"))).when(o == 2, F.upper(F.replace(e, F.lit("o"), F.lit("0")))).when(o == 3, F.reverse(e))
        .when(o == 4, F.concat_ws(" | ", "expected", "p_brand")).when(o == 5, F.replace(e, F.lit("i"), F.lit("|"))).when(o == 6, F.col("p_type")).otherwise("")
    )
    return both.select(
        "image", "expected", read.alias("recognized"), F.col("name").alias("config"), "config_ord", "lang", "preprocessing", ((k + o * 11) % 100).cast("double").alias("confidence"),
        (100 + (k * 7 + o * 13) % 200).alias("process_time"), (~((F.col("p_size") == 50) & (o % 2 == 1))).alias("success"),
    )


def results(spark, sf_dir) -> DataFrame:
    from ..functions.accuracy import accuracy_tolerant

    return recognitions(spark, sf_dir).withColumn("accuracy", accuracy_tolerant(F.col("expected"), F.col("recognized")))


def ledger_events(spark, sf_dir) -> DataFrame:
    return as_ledger(table(spark, sf_dir, "events"))


def as_ledger(e: DataFrame) -> DataFrame:
    """Events, a table or a stream, as the ledger's."""
    op = F.when(F.col("event_type").isin("purchase", "click"), "inc").when(F.col("event_type") == "error", "dec").when(F.col("event_type") == "signup", "clear")
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    key = F.concat(k, F.when(F.col("event_id") % 3 == 0, "_foil").otherwise("_normal"))
    return e.select(F.col("user_id").cast("string").alias("collection"), key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op")).filter("op IS NOT NULL")


def collections(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("card_count"), F.min("o_orderdate").cast("timestamp").alias("created_at"), F.max("o_orderdate").cast("timestamp").alias("last_modified"))
    c = table(spark, sf_dir, "customer")
    plain = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string"))
    name = F.when(F.col("c_custkey") % 2 == 1, F.lower(plain)).otherwise(plain)
    joined = c.join(n, c["c_custkey"] == n["o_custkey"], "left")
    return joined.select(
        F.col("c_custkey").cast("int").alias("ord"), F.format_string("coll_%09d", "c_custkey").alias("id"), name.alias("name"), F.coalesce("created_at", F.lit("1990-01-01").cast("timestamp")).alias("created_at"),
        F.coalesce("last_modified", F.lit("1990-01-01").cast("timestamp")).alias("last_modified"), F.coalesce("card_count", F.lit(0)).alias("card_count"),
    )


def cache(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


def _values():
    return F.transform("embedding", lambda u: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (u.cast("double") + 0.6) / 1.2 * 255)))


def _exploded(spark, sf_dir, *dealt) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e = (e.repartition(*dealt) if dealt else e).select("vec_id", _values().alias("v"))
    p = e.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda d: F.get("v", (F.col("i") + d) % 64)
    return p.select("vec_id", "i", at(0).alias("r"), at(21).alias("g"), at(42).alias("b"))


def pixels(spark, sf_dir) -> DataFrame:
    return _exploded(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), "r", "g", "b")


def images(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def pixels_wide(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """dealt: by image, as vectors, before they become pixels."""
    image, t = F.floor(F.col("vec_id") / 4), F.col("vec_id") % 4
    y = F.floor(t / 2) * 8 + F.expr("i div 8")
    return _exploded(spark, sf_dir, *[image] * dealt).select(image.alias("image_id"), y.cast("int").alias("y"), ((t % 2) * 8 + F.col("i") % 8).cast("int").alias("x"), "r", "g", "b")


def pixels_dark(spark, sf_dir) -> DataFrame:
    """pixels_wide a quarter darker, so that edges are found."""
    return pixels_wide(spark, sf_dir).withColumns({c: F.col(c) * 0.75 for c in "rgb"})


def pixels_card(spark, sf_dir) -> DataFrame:
    """pixels_wide at twice the size with stripes of shade: 32 by 32, dark enough that edges are found; dealt by image."""
    from ..operators.raster import upscale

    shade = F.lit(0.55) + F.lit(0.05) * ((F.col("x") * 7 + F.col("y") * 11) % 8)
    return upscale(pixels_wide(spark, sf_dir, dealt=True)).withColumns({c: F.col(c) * shade for c in "rgb"})


def images_card(spark, sf_dir) -> DataFrame:
    return images_wide(spark, sf_dir).select("image_id", (F.col("width") * 2).alias("width"), (F.col("height") * 2).alias("height"))


def images_wide(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("image_id")).distinct().select("image_id", F.lit(16).alias("width"), F.lit(16).alias("height"))


# The same views in DuckDB's SQL.


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


#: White space as ECMAScript has it, for a character class, and letters whose capitals begin with ASCII letters, with these.
SQL_SPACE = "".join(f"\\x{{{ord(c):04X}}}" for c in " " + BLANKS)
CAPITALS = {"ß": "SS", "ŉ": "ʼN", "ǰ": "J̌", "ẖ": "H̱", "ẗ": "T̈", "ẘ": "W̊", "ẙ": "Y̊", "ẚ": "Aʾ", "ﬀ": "FF", "ﬁ": "FI", "ﬂ": "FL", "ﬃ": "FFI", "ﬄ": "FFL", "ﬅ": "ST", "ﬆ": "ST"}
_V = {
    "strips": f"""SELECT *, CASE part_key % 6 WHEN 1 THEN rarity || lower(rarity) || ' ' || number || ' ' || set_code || ' ' || language
            WHEN 2 THEN base || ' |' WHEN 3 THEN 'LER  ' || base WHEN 4 THEN rarity || ' ' || number || ' ' || set_code || ' ' || lower(language)
            WHEN 5 THEN rarity || ' ' || number || ' ' || set_code || ' +' || language ELSE base END AS raw
        FROM (SELECT *, rarity || ' ' || number || ' ' || set_code || ' ' || language AS base
              FROM (SELECT p_partkey AS part_key, substr('{RARITIES}', p_size % 8 + 1, 1) AS rarity, lpad(p_partkey::VARCHAR, 5, '0') AS number, {_list(SET_CODES)}[p_partkey % 7 + 1] AS set_code,
                           {_list(LANGS)}[p_partkey % 10 + 1] AS language, p_name, p_type, p_size FROM part))""",
    "scan_text": """SELECT 'p' || part_key AS scan_id, raw FROM strips UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents
        UNION ALL SELECT 'b' || item_id, coalesce(text, '') FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations""",
    "catalog": """SELECT 'card-' || part_key || '-' || lang AS card_id, p_name AS name, lower(set_code) AS set, number::INT AS catalog_number, lang
        FROM (SELECT *, 'en' AS lang FROM strips UNION ALL SELECT *, CASE language WHEN 'JP' THEN 'ja' WHEN 'ZH' THEN 'zhs' ELSE lower(language) END FROM strips WHERE part_key % 3 > 0 AND language <> 'EN')
        WHERE p_type <> 'ECONOMY'""",
    "configs": f"""SELECT i AS config_ord, {_list(c[0] for c in CONFIGS)}[i + 1] AS name, {_list(c[1] for c in CONFIGS)}[i + 1] AS lang, {_list(c[2] for c in CONFIGS)}[i + 1] AS preprocessing
        FROM range({len(CONFIGS)}) t(i)""",
    "recognitions": """SELECT p_partkey AS image, p_name AS expected, CASE config_ord WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'l', '1') WHEN 2 THEN upper(replace(p_name, 'o', '0')) WHEN 3 THEN reverse(p_name)
            WHEN 4 THEN p_name || ' | ' || p_brand WHEN 5 THEN replace(p_name, 'i', '|') WHEN 6 THEN p_type ELSE '' END AS recognized, name AS config, config_ord, lang, preprocessing,
            ((p_partkey + config_ord * 11) % 100)::DOUBLE AS confidence, 100 + (p_partkey * 7 + config_ord * 13) % 200 AS process_time, NOT (p_size = 50 AND config_ord % 2 = 1) AS success FROM part, configs""",
    "judged": """SELECT *, trim(lower(expected)) AS e, trim(lower(recognized)) AS a FROM recognitions""",
    "mended": """SELECT *, trim(translate(a, '|051', 'IOSl')) AS c FROM judged""",
    "worded": """SELECT *, list_filter(string_split_regex(e, '\\s+'), lambda w: length(w) > 2) AS ew, list_filter(string_split_regex(a, '\\s+'), lambda w: length(w) > 2) AS aw,
            list_filter(string_split_regex(c, '\\s+'), lambda w: length(w) > 2) AS cw FROM mended""",
    "matched": """SELECT *, len(list_filter(ew, lambda w: len(list_filter(aw, lambda x: contains(x, w) OR contains(w, x) OR levenshtein(w, x) <= 1)) > 0)) AS basic_words,
            len(list_filter(ew, lambda w: len(list_filter(cw, lambda x: contains(x, w) OR contains(w, x) OR levenshtein(w, x) <= greatest(1, floor(length(w) * 0.2)))) > 0)) AS tolerant_words FROM worded""",
    "results": """SELECT *, CASE WHEN expected = '' OR recognized = '' THEN 0.0::DOUBLE WHEN e = a THEN 100.0::DOUBLE
            ELSE greatest((greatest(length(e), length(a)) - levenshtein(e, a))::DOUBLE / greatest(length(e), length(a)) * 100, CASE WHEN len(ew) > 0 THEN basic_words::DOUBLE / len(ew) * 100 ELSE 0 END) END AS basic,
            CASE WHEN expected = '' OR recognized = '' THEN 0.0::DOUBLE WHEN e = a THEN 100.0::DOUBLE WHEN e = c THEN 95.0::DOUBLE
            ELSE greatest((greatest(length(e), length(c)) - levenshtein(e, c))::DOUBLE / greatest(length(e), length(c)) * 100, CASE WHEN len(ew) > 0 THEN tolerant_words::DOUBLE / len(ew) * 100 ELSE 0 END,
                          CASE WHEN contains(c, substr(e, 1, length(e) // 2)) THEN 50 ELSE 0 END) END AS accuracy FROM matched""",
    "ledger_events": """SELECT user_id::VARCHAR AS collection, regexp_extract(props, '"k": (\\d+)', 1) || CASE WHEN event_id % 3 = 0 THEN '_foil' ELSE '_normal' END AS key, ts, event_id AS seq,
            CASE WHEN event_type IN ('purchase', 'click') THEN 'inc' WHEN event_type = 'error' THEN 'dec' ELSE 'clear' END AS op FROM events WHERE event_type <> 'view'""",
    "marked": "SELECT *, count(*) FILTER (op = 'clear') OVER (PARTITION BY collection ORDER BY ts, seq) AS clears FROM ledger_events",
    "summed": "SELECT *, sum(CASE op WHEN 'inc' THEN 1 ELSE -1 END) OVER (PARTITION BY collection, key, clears ORDER BY ts, seq) AS s FROM marked WHERE op IN ('inc', 'dec')",
    "history": """SELECT collection, key, ts, seq, op, clears, (s - least(0, min(s) OVER (PARTITION BY collection, key, clears ORDER BY ts, seq)))::BIGINT AS count FROM summed""",
    "began": """SELECT *, CASE WHEN op = 'inc' AND count = 1 AND coalesce(lag(count) OVER (PARTITION BY collection, key, clears ORDER BY ts, seq), 0) = 0 THEN ts END AS began FROM history""",
    "holdings": """SELECT h.collection, key, arg_max(count, (ts, seq)) AS count, max(began) AS added_at, max(ts) AS updated_at
            FROM began h JOIN (SELECT collection, count(*) FILTER (op = 'clear') AS now FROM ledger_events GROUP BY 1) n ON h.collection = n.collection AND h.clears = n.now GROUP BY 1, 2 HAVING arg_max(count, (ts, seq)) > 0""",
    "collections": """SELECT c_custkey AS ord, 'coll_' || lpad(c_custkey::VARCHAR, 9, '0') AS id, CASE WHEN c_custkey % 2 = 1 THEN lower(plain) ELSE plain END AS name, coalesce(created_at, TIMESTAMP '1990-01-01') AS created_at,
            coalesce(last_modified, TIMESTAMP '1990-01-01') AS last_modified, coalesce(card_count, 0) AS card_count
        FROM (SELECT *, c_mktsegment || ' ' || c_nationkey || ' ' || c_custkey % 40 AS plain FROM customer)
        LEFT JOIN (SELECT o_custkey, count(*) AS card_count, min(o_orderdate) AS created_at, max(o_orderdate) AS last_modified FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "cache": "SELECT event_id::VARCHAR AS key, props AS value, epoch_us(ts) // 1000 AS ts_ms FROM events",
    "vectors": "SELECT vec_id, list_transform(embedding, lambda u: least(255.0::DOUBLE, greatest(0.0::DOUBLE, (u::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255))) AS v FROM embeddings",
    "exploded": "SELECT vec_id, i, v[i + 1] AS r, v[(i + 21) % 64 + 1] AS g, v[(i + 42) % 64 + 1] AS b FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM vectors)",
    "pixels": "SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, r, g, b, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM exploded",
    "pixels_wide": "SELECT vec_id // 4 AS image_id, vec_id % 4 // 2 * 8 + i // 8 AS y, vec_id % 4 % 2 * 8 + i % 8 AS x, r, g, b, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM exploded",
    "pixels_card": """SELECT image_id, y, x, r * s AS r, g * s AS g, b * s AS b, 0.299::DOUBLE * (r * s) + 0.587::DOUBLE * (g * s) + 0.114::DOUBLE * (b * s) AS gray
        FROM (SELECT *, 0.55::DOUBLE + 0.05::DOUBLE * ((x * 7 + y * 11) % 8) AS s FROM (SELECT image_id, y * 2 + dy AS y, x * 2 + dx AS x, r, g, b FROM pixels_wide, range(2) a(dy), range(2) b(dx)))""",
    "pixels_dark": "SELECT image_id, y, x, r, g, b, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM (SELECT image_id, y, x, r * 0.75::DOUBLE AS r, g * 0.75::DOUBLE AS g, b * 0.75::DOUBLE AS b FROM pixels_wide)",
}
_NEEDS = {
    "scan_text": ["strips"], "catalog": ["strips"], "recognitions": ["configs"], "judged": ["recognitions"], "mended": ["judged"], "worded": ["mended"], "matched": ["worded"], "results": ["matched"],
    "marked": ["ledger_events"], "summed": ["marked"], "history": ["summed"], "began": ["history"], "holdings": ["began", "ledger_events"], "exploded": ["vectors"], "pixels": ["exploded"], "pixels_wide": ["exploded"], "pixels_dark": ["pixels_wide"], "pixels_card": ["pixels_wide"],
}


def sql_views(*names: str, more: str = "") -> str:
    """A WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_V[n]})" for n in order) + (f",\n{more}" if more else "") + "\n"
