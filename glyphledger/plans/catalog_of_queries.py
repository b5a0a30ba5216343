"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import accuracy as acc
from ..functions import text as txt
from ..operators import cache as caches
from ..operators import collections as colls
from ..operators import evaluate as ev
from ..operators import ledger as led
from ..operators import detection, lookup, raster
from ..sources import images as sources
from ..sources import stores
from ..sources.shared import shared_dir
from . import views as v
from .views import sql_views

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def _dup(t: str) -> str:
    for c in "CUMNR":
        t = f"regexp_replace({t}, '([{c}{c.lower()}])[{c}{c.lower()}]+', '\\1', 'g')"
    for d in "0123456789":
        t = f"regexp_replace({t}, '{d}{{4,}}', '{d}', 'g')"
    return t


_WS = v.SQL_SPACE


def _squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{_WS}]+', ' ', 'g'))"


def _upper(t: str) -> str:
    """Capitals, also of letters that become two."""
    for small, large in v.CAPITALS.items():
        t = f"replace({t}, '{small}', '{large}')"
    return f"upper({t})"


_LANG = "|".join(txt.LANGUAGES)
_CODES = "|".join(txt.SET_CODES)
_CLEAN = f"upper({_squeeze(f"regexp_replace(translate({_dup(_squeeze('raw'))}, '|\\OIlS', '110115'), '[^0-9A-Za-z /]', '', 'g')")})"


def _score(t: str) -> str:
    parts = [f"regexp_matches({t}, '{_CODES}')::INT * 50", f"regexp_matches({t}, '[{_WS}][CURMBLST][{_WS}]')::INT * 15", f"regexp_matches({t}, '\\d{{3,5}}')::INT * 30", f"regexp_matches({t}, '\\b({_LANG})\\b')::INT * 10", f"(length({t}) + len(regexp_extract_all({t}, '[\\x{{10000}}-\\x{{10FFFF}}]')) > 10)::INT * 5"]
    return "(" + " + ".join(parts) + ")"


_PARTS = f"nullif(regexp_extract(u, '({_CODES})', 1), '') AS c0, nullif(regexp_extract(u, '(\\d{{3,5}})', 1), '') AS n0, nullif(regexp_extract(u, '\\b({_LANG})\\b', 1), '') AS l0"


_CHOSEN = f"""cleaned AS (SELECT scan_id, raw, {_CLEAN} AS cleaned FROM scan_text),
scored AS (SELECT *, {_score('raw')} AS raw_score, {_score('cleaned')} AS cleaned_score FROM cleaned),
chosen AS (SELECT *, CASE WHEN raw_score > cleaned_score THEN raw ELSE cleaned END AS final_text, greatest(raw_score, cleaned_score) AS final_score, raw_score > cleaned_score AS used_raw FROM scored),
keyed AS (SELECT *, {_PARTS} FROM (SELECT *, {_upper('final_text')} AS u FROM chosen)),
parsed AS (SELECT *, CASE WHEN c0 IS NOT NULL AND n0 IS NOT NULL THEN c0 END AS set_code, CASE WHEN c0 IS NOT NULL AND n0 IS NOT NULL THEN n0 END AS number,
           CASE WHEN c0 IS NOT NULL AND n0 IS NOT NULL THEN l0 END AS language FROM keyed)"""
_TEXT = sql_views("scan_text", more=_CHOSEN)


def _chosen(spark, sf_dir):
    s = v.scan_text(spark, sf_dir).withColumn("cleaned", txt.clean_text(F.col("raw")))
    return s.select("scan_id", "raw", "cleaned", txt.choose_text(F.col("raw"), F.col("cleaned")).alias("c")).select("scan_id", "raw", "cleaned", "c.*")


def _parsed_scans(spark, sf_dir):
    return lookup.parse_keys(_chosen(spark, sf_dir).select("scan_id", "final_score", "final_text"), "final_text").drop("final_text")


# Texts.


_API = "CASE language WHEN 'JP' THEN 'ja' WHEN 'ZH' THEN 'zhs' ELSE lower(language) END"


@query("resolve_scan_text", sql_views("scan_text", "catalog", more=_CHOSEN + f", asked AS (SELECT *, CASE WHEN set_code IS NOT NULL THEN coalesce({_API}, 'en') END AS api_language FROM parsed)")
    + "SELECT scan_id, final_score, set_code, number, api_language, card_id, name FROM asked LEFT JOIN catalog ON lower(set_code) = set AND number::INT = catalog_number AND api_language = lang")
def resolve_scan_text(spark, sf_dir):
    found = lookup.resolve(_parsed_scans(spark, sf_dir), v.catalog(spark, sf_dir))
    return found.select("scan_id", "final_score", "set_code", "number", "api_language", "card_id", "name")


@query("clean_text", _TEXT + "SELECT scan_id, cleaned FROM cleaned")
def clean_text(spark, sf_dir):
    return v.scan_text(spark, sf_dir).select("scan_id", txt.clean_text(F.col("raw")).alias("cleaned"))


@query("score_text", _TEXT + "SELECT scan_id, raw_score AS score FROM scored")
def score_text(spark, sf_dir):
    return v.scan_text(spark, sf_dir).select("scan_id", txt.score_text(F.col("raw")).alias("score"))


@query("choose_text", _TEXT + "SELECT scan_id, raw_score, cleaned_score, final_text, final_score, used_raw FROM chosen")
def choose_text(spark, sf_dir):
    return _chosen(spark, sf_dir).drop("raw", "cleaned")


@query("parse_key", _TEXT + "SELECT scan_id, set_code, number, language FROM parsed")
def parse_key(spark, sf_dir):
    return _parsed_scans(spark, sf_dir).drop("final_score")


@query("language_lookup", _TEXT + "SELECT scan_id, coalesce(CASE language WHEN 'JP' THEN 'ja' WHEN 'ZH' THEN 'zhs' ELSE lower(language) END, 'en') AS code, coalesce(CASE language WHEN 'DE' THEN 'German' WHEN 'FR' THEN 'French' WHEN 'ES' THEN 'Spanish' WHEN 'IT' THEN 'Italian' WHEN 'PT' THEN 'Portuguese' WHEN 'JP' THEN 'Japanese' WHEN 'KO' THEN 'Korean' WHEN 'RU' THEN 'Russian' WHEN 'ZH' THEN 'Chinese' END, 'English') AS display FROM parsed")
def language_lookup(spark, sf_dir):
    p = _parsed_scans(spark, sf_dir)
    return p.select("scan_id", txt.language_code(F.col("language")).alias("code"), txt.language_name(F.col("language")).alias("display"))


_STEM = "rarity || ' ' || part_key || ' ' || set_code || ' ' || language"


@query("parse_code", sql_views("strips") + f"""SELECT part_key, CASE WHEN ok THEN rarity END AS rarity, CASE WHEN ok THEN CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END END AS number,
    CASE WHEN ok THEN lower(set_code) END AS set_code, CASE WHEN ok THEN lower(language) END AS language
    FROM (SELECT *, part_key::VARCHAR AS n, regexp_matches({_STEM}, '^[CRMUL]\\s+\\d+\\s+[A-Z]{{3,4}}\\s+[A-Z]{{2}}$') AS ok FROM strips)""")  # fmt: skip
def parse_code(spark, sf_dir):
    stem = F.concat_ws(" ", "rarity", F.col("part_key").cast("string"), "set_code", "language")
    return v.strips(spark, sf_dir).select("part_key", txt.parse_code(stem).alias("p")).select("part_key", "p.*")


@query("label_lookup_fallback", sql_views("strips") + """SELECT s.part_key, coalesce(l.p_name, trim(regexp_replace(s.raw, '[^a-zA-ZäöüÄÖÜß\\-'',.""" + v.SQL_SPACE + """]', ' ', 'g'))) AS expected
    FROM strips s LEFT JOIN (SELECT raw, min(p_name) AS p_name FROM strips WHERE p_size <= 17 GROUP BY raw) l USING (raw)""")  # fmt: skip
def label_lookup_fallback(spark, sf_dir):
    s = v.strips(spark, sf_dir)
    labels = s.filter("p_size <= 17").groupBy(F.col("raw").alias("code")).agg(F.min("p_name").alias("expected"))
    return lookup.label(s.select("part_key", F.col("raw").alias("stem")), labels).select("part_key", "expected")


@query("fallback_search", sql_views("strips") + "SELECT part_key, NULL::VARCHAR AS fallback_id FROM strips")
def fallback_search(spark, sf_dir):
    return lookup.fallback_search(v.strips(spark, sf_dir).select("part_key"))


@query("recognized_text", sql_views("scan_text") + f"SELECT scan_id, {_squeeze('raw')} AS text FROM scan_text")
def recognized_text(spark, sf_dir):
    return v.scan_text(spark, sf_dir).select("scan_id", txt.normalize_recognized(F.col("raw")).alias("text"))


@query("escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", txt.escape_html(F.col("html")).alias("escaped"))


@query("card_path", sql_views("strips") + "SELECT part_key, '/cards/' || lower(set_code) || '/' || number::INT || CASE language WHEN 'JP' THEN '?lang=ja' WHEN 'ZH' THEN '?lang=zhs' ELSE '?lang=' || lower(language) END AS path FROM strips")
def card_path(spark, sf_dir):
    return v.strips(spark, sf_dir).select("part_key", txt.card_path(F.col("set_code"), F.col("number"), txt.language_code(F.col("language"))).alias("path"))


@query("cache_key", "SELECT page_id, 'card-image-' || to_base64(encode(url)) AS key FROM pages")
def cache_key(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", txt.cache_key(F.col("url")).alias("key"))


@query("format_numbers", "SELECT p_partkey, format('{:.1f}', p_retailprice) AS price, CASE WHEN length(p_name) < 25 THEN rpad(p_name, 25, ' ') ELSE p_name END AS padded FROM part")
def format_numbers(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    return p.select("p_partkey", txt.fixed(F.col("p_retailprice")).alias("price"), txt.pad_end(F.col("p_name"), 25).alias("padded"))


@query("unique_ids", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END ELSE p_name END || CASE WHEN p_size % 3 = 0 THEN '_foil' ELSE '_normal' END AS unique_id FROM part")
def unique_ids(spark, sf_dir):
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey")
    card = F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_name"))
    other = F.when(k % 2 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    return p.select("p_partkey", txt.unique_id(card, other, F.when(F.col("p_size") % 3 == 0, F.lit(True))).alias("unique_id"))


# Evaluation.


@query("edit_similarity", sql_views("judged") + "SELECT image, config_ord, levenshtein(e, a) AS distance, round((greatest(length(e), length(a)) - levenshtein(e, a))::DOUBLE / greatest(length(e), length(a)) * 100, 6) AS similarity FROM judged")
def edit_similarity(spark, sf_dir):
    e, a = F.lower(F.trim("expected")), F.lower(F.trim("recognized"))
    return v.recognitions(spark, sf_dir).select("image", "config_ord", F.levenshtein(e, a).alias("distance"), _r(acc.similarity(e, a)).alias("similarity"))


@query("word_match", sql_views("matched") + "SELECT image, config_ord, basic_words AS words FROM matched")
def word_match(spark, sf_dir):
    e, a = F.lower(F.trim("expected")), F.lower(F.trim("recognized"))
    return v.recognitions(spark, sf_dir).select("image", "config_ord", acc.words_matched(e, a, lambda w: F.lit(1)).alias("words"))


@query("accuracy_basic", sql_views("results") + "SELECT image, config_ord, round(basic, 6) AS accuracy FROM results")
def accuracy_basic(spark, sf_dir):
    return v.recognitions(spark, sf_dir).select("image", "config_ord", _r(acc.accuracy_basic(F.col("expected"), F.col("recognized"))).alias("accuracy"))


@query("accuracy_tolerant", sql_views("results") + "SELECT image, config_ord, round(accuracy, 6) AS accuracy FROM results")
def accuracy_tolerant(spark, sf_dir):
    return v.results(spark, sf_dir).select("image", "config_ord", _r("accuracy").alias("accuracy"))


@query("verdict", sql_views("results") + "SELECT image, config_ord, CASE WHEN accuracy >= 80 THEN 'good' WHEN accuracy >= 60 THEN 'decent' WHEN accuracy >= 30 THEN 'weak' ELSE 'poor' END AS verdict FROM results")
def verdict(spark, sf_dir):
    return v.results(spark, sf_dir).select("image", "config_ord", acc.verdict(F.col("accuracy")).alias("verdict"))


_STATS = """stats AS (SELECT config, config_ord, avg(accuracy) AS avg_accuracy, max(accuracy) AS max_accuracy, min(accuracy) AS min_accuracy, count(*) AS tests, count(*) FILTER (accuracy >= 80) AS above80,
    count(*) FILTER (accuracy >= 60) AS above60, avg(confidence) AS avg_confidence, avg(process_time) AS avg_time FROM results WHERE success GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(avg_accuracy, 9) DESC, config_ord) AS place FROM stats)"""
_EVAL = sql_views("results", more=_STATS)


@query("config_stats", _EVAL + "SELECT config, config_ord, round(avg_accuracy, 6) AS avg_accuracy, round(max_accuracy, 6) AS max_accuracy, round(min_accuracy, 6) AS min_accuracy, tests, above80, above60, round(avg_confidence, 6) AS avg_confidence, round(avg_time, 6) AS avg_time, round(above80 * 100.0::DOUBLE / tests, 6) AS above80_share FROM stats")
def config_stats(spark, sf_dir):
    s = ev.config_stats(v.results(spark, sf_dir))
    return s.withColumns({c: _r(c) for c in ("avg_accuracy", "max_accuracy", "min_accuracy", "avg_confidence", "avg_time", "above80_share")})


@query("config_rank", _EVAL + "SELECT config, place, CASE place WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal, round(avg_accuracy, 6) AS avg_accuracy FROM ranked")
def config_rank(spark, sf_dir):
    return ev.rank_configs(ev.config_stats(v.results(spark, sf_dir))).select("config", "place", "medal", _r("avg_accuracy").alias("avg_accuracy"))


@query("family_pick", _EVAL + """SELECT family, arg_min(config, place) AS config, round(arg_min(avg_accuracy, place), 6) AS avg_accuracy, min(place) AS place
    FROM (SELECT *, CASE WHEN contains(config, 'English') AND NOT contains(config, 'German') THEN 'english' WHEN contains(config, 'German') THEN 'german' END AS family FROM ranked) WHERE family IS NOT NULL GROUP BY 1""")  # fmt: skip
def family_pick(spark, sf_dir):
    return ev.family_pick(ev.rank_configs(ev.config_stats(v.results(spark, sf_dir)))).withColumn("avg_accuracy", _r("avg_accuracy"))


@query("overall_stats", _EVAL + """SELECT *, round(successful * 100.0::DOUBLE / total, 6) AS success_rate, CASE WHEN above80 > 0 THEN 'good' WHEN above60 > 0 THEN 'partial' ELSE 'poor' END AS verdict
    FROM (SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (success AND accuracy >= 80) AS above80, count(*) FILTER (success AND accuracy >= 60) AS above60 FROM results)""")  # fmt: skip
def overall_stats(spark, sf_dir):
    return ev.overall_stats(v.results(spark, sf_dir)).withColumn("success_rate", _r("success_rate"))


def _by(key: str) -> str:
    return _EVAL + f"SELECT coalesce({key}, 'unknown') AS {key}, round(avg(accuracy), 6) AS avg_accuracy, round(max(accuracy), 6) AS max_accuracy, count(*) FILTER (accuracy >= 80) AS above80, count(*) AS tests FROM results WHERE success GROUP BY 1"


@query("stats_by_preprocessing", _by("preprocessing"))
def stats_by_preprocessing(spark, sf_dir):
    return ev.stats_by(v.results(spark, sf_dir), "preprocessing").withColumns({c: _r(c) for c in ("avg_accuracy", "max_accuracy")})


@query("stats_by_language", _by("lang"))
def stats_by_language(spark, sf_dir):
    joined = ev.join_config(v.results(spark, sf_dir).drop("lang"), v.configs(spark)).withColumnRenamed("config_lang", "lang")
    return ev.stats_by(joined, "lang").withColumns({c: _r(c) for c in ("avg_accuracy", "max_accuracy")})


@query("best_per_image", _EVAL + """SELECT image, CASE WHEN coalesce(max(accuracy) FILTER (success), 0) = 0 THEN '' ELSE arg_max(config, (accuracy, -config_ord)) FILTER (success) END AS best_config,
    round(coalesce(max(accuracy) FILTER (success), 0), 6) AS best_accuracy FROM results GROUP BY 1""")  # fmt: skip
def best_per_image(spark, sf_dir):
    return ev.best_config(v.results(spark, sf_dir)).withColumn("best_accuracy", _r("best_accuracy"))


@query("top5_per_image", _EVAL + "SELECT image, config, round(accuracy, 6) AS accuracy, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY accuracy DESC, config_ord) AS place FROM results WHERE success) WHERE place <= 5")
def top5_per_image(spark, sf_dir):
    return ev.best_results(v.results(spark, sf_dir)).select("image", "config", _r("accuracy").alias("accuracy"), "place")


@query("top3_texts", _EVAL + "SELECT recognized, times FROM (SELECT recognized, count(*) AS times, min((image, config_ord)) AS f FROM results WHERE success AND length(recognized) > 5 GROUP BY 1) ORDER BY times DESC, f LIMIT 3")
def top3_texts(spark, sf_dir):
    return ev.common_texts(v.results(spark, sf_dir))


# Ledger.


@query("ledger_history", sql_views("history") + "SELECT collection, key, seq, count FROM history")
def ledger_history(spark, sf_dir):
    return led.history(v.ledger_events(spark, sf_dir)).select("collection", "key", "seq", "count")


def _held(spark, sf_dir):
    return led.holdings(v.ledger_events(spark, sf_dir))


@query("ledger_holdings", sql_views("holdings") + "SELECT collection, key, count, epoch_us(added_at) // 1000 AS added_ms, epoch_us(updated_at) // 1000 AS updated_ms FROM holdings")
def ledger_holdings(spark, sf_dir):
    return _held(spark, sf_dir).select("collection", "key", "count", F.unix_millis("added_at").alias("added_ms"), F.unix_millis("updated_at").alias("updated_ms"))


@query("ledger_totals", sql_views("holdings") + "SELECT collection, count(*) AS unique_cards, sum(count)::BIGINT AS total_cards, count(*) || ' (' || sum(count)::BIGINT || ' total)' AS label FROM holdings GROUP BY 1")
def ledger_totals(spark, sf_dir):
    return led.totals(_held(spark, sf_dir))


@query("variant_quantities", sql_views("holdings") + "SELECT collection, regexp_replace(key, '_(foil|normal)$', '') AS card, coalesce(sum(count) FILTER (NOT ends_with(key, '_foil')), 0)::BIGINT AS normal, coalesce(sum(count) FILTER (ends_with(key, '_foil')), 0)::BIGINT AS foil FROM holdings GROUP BY 1, 2")
def variant_quantities(spark, sf_dir):
    return led.variant_quantities(_held(spark, sf_dir))


@query("card_quantity", sql_views("holdings") + "SELECT e.collection, e.key, coalesce(h.count, 0) AS count FROM (SELECT DISTINCT collection, key FROM ledger_events) e LEFT JOIN holdings h USING (collection, key)")
def card_quantity(spark, sf_dir):
    return led.quantities(_held(spark, sf_dir), v.ledger_events(spark, sf_dir).select("collection", "key").distinct())


@query("ledger_upsert", sql_views("holdings", more="changes AS (SELECT collection, key, CASE WHEN sum(seq) % 2 = 0 THEN 1 ELSE -1 END AS delta, max(ts) AS ts FROM ledger_events GROUP BY 1, 2)")
    + "SELECT collection, key, (coalesce(count, 0) + coalesce(delta, 0))::BIGINT AS count, epoch_us(coalesce(added_at, ts)) // 1000 AS added_ms FROM holdings FULL JOIN changes USING (collection, key) WHERE coalesce(count, 0) + coalesce(delta, 0) > 0")
def ledger_upsert(spark, sf_dir):
    events = v.ledger_events(spark, sf_dir)
    changes = events.groupBy("collection", "key").agg(F.when(F.sum("seq") % 2 == 0, 1).otherwise(-1).alias("delta"), F.max("ts").alias("ts"))
    return led.upsert(led.holdings(events), changes).select("collection", "key", "count", F.unix_millis("added_at").alias("added_ms"))


@query("export_rows", sql_views("holdings", "strips") + """SELECT collection, h.key, count || ',"' || coalesce(replace(p_name, '"', '""'), '') || '",' || coalesce('"' || set_code || '"', '') || ',Near Mint,' || coalesce(CASE language WHEN 'DE' THEN 'German'
    WHEN 'FR' THEN 'French' WHEN 'ES' THEN 'Spanish' WHEN 'IT' THEN 'Italian' WHEN 'PT' THEN 'Portuguese' WHEN 'JP' THEN 'Japanese' WHEN 'KO' THEN 'Korean' WHEN 'RU' THEN 'Russian' WHEN 'ZH' THEN 'Chinese' END, 'English')
    || ',' || CASE WHEN ends_with(h.key, '_foil') THEN 'Yes' ELSE 'No' END || ',' || coalesce(number, '') AS line FROM holdings h LEFT JOIN strips ON part_key = regexp_extract(h.key, '^(\\d+)', 1)::BIGINT""")  # fmt: skip
def export_rows(spark, sf_dir):
    s = v.strips(spark, sf_dir)
    held = _held(spark, sf_dir)
    named = held.join(s, F.regexp_extract(held["key"], r"^(\d+)", 1).cast("bigint") == s["part_key"], "left")
    rows = named.select("collection", "key", "count", F.col("p_name").alias("name"), F.col("set_code").alias("set"), txt.language_name(F.col("language")).alias("language_display"), F.col("key").endswith("_foil").alias("is_foil"), "number")
    return led.export_rows(rows).select("collection", "key", "line")


# Collections and caches.


@query("collection_list", sql_views("collections") + "SELECT id, name, epoch(created_at)::BIGINT AS created_s, card_count, id = 'coll_000000007' AS is_active, row_number() OVER (ORDER BY created_at DESC, ord) AS place FROM collections")
def collection_list(spark, sf_dir):
    active = spark.createDataFrame([("coll_000000007",)], "id string")
    return colls.listing(v.collections(spark, sf_dir), active).select("id", "name", F.unix_seconds("created_at").alias("created_s"), "card_count", "is_active", "place")


@query("duplicate_names", sql_views("collections") + "SELECT lower(name) AS name_key, count(*) AS n, min(id) AS first_id FROM collections GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return colls.duplicate_names(v.collections(spark, sf_dir))


@query("acceptable_names", sql_views("collections") + """SELECT r.id, r.name FROM (SELECT id, trim(CASE ord % 4 WHEN 0 THEN '  ' WHEN 1 THEN upper(name) WHEN 2 THEN ' new ' || name ELSE name || repeat('x', 50) END) AS name FROM collections) r
    WHERE length(r.name) BETWEEN 1 AND 50 AND NOT EXISTS (SELECT 1 FROM collections c WHERE lower(c.name) = lower(r.name) AND c.id <> r.id)""")  # fmt: skip
def acceptable_names(spark, sf_dir):
    c = v.collections(spark, sf_dir)
    k = F.col("ord") % 4
    asked = F.when(k == 0, F.lit("  ")).when(k == 1, F.upper("name")).when(k == 2, F.concat(F.lit(" new "), "name")).otherwise(F.concat("name", F.lit("x" * 50)))
    return colls.acceptable_names(c.select("id", asked.alias("name")), c)


@query("delete_reassign", sql_views("collections", more="kept AS (SELECT * FROM collections WHERE card_count > 0), act AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM kept WHERE id = 'coll_000000000') THEN 'coll_000000000' ELSE (SELECT arg_min(id, ord) FROM kept) END AS a)") + "SELECT id, name, id = a AS is_active FROM kept, act")
def delete_reassign(spark, sf_dir):
    c = v.collections(spark, sf_dir)
    kept, now = colls.delete(c, spark.createDataFrame([("coll_000000000",)], "id string"), c.filter("card_count = 0"))
    return kept.join(now.withColumnRenamed("id", "active_id"), F.col("id") == F.col("active_id"), "left").select("id", "name", F.col("active_id").isNotNull().alias("is_active"))


@query("collection_recount", sql_views("holdings", "collections") + "SELECT c.id, coalesce(n, 0)::INT AS card_count, coalesce(n, 0) <> c.card_count AS changed FROM collections c LEFT JOIN (SELECT 'coll_' || lpad(collection, 9, '0') AS id, sum(count) AS n FROM holdings GROUP BY 1) h USING (id)")
def collection_recount(spark, sf_dir):
    c = v.collections(spark, sf_dir)
    held = _held(spark, sf_dir).withColumn("collection", F.concat(F.lit("coll_"), F.lpad("collection", 9, "0")))
    after = colls.recount(c, held, "2030-01-01")
    return after.select("id", "card_count", (F.col("last_modified") == F.lit("2030-01-01").cast("timestamp")).alias("changed"))


@query("cache_fresh", sql_views("cache") + f"SELECT key, ts_ms FROM cache WHERE {v.AS_OF_MS} - ts_ms < 86400000")
def cache_fresh(spark, sf_dir):
    return caches.fresh(v.cache(spark, sf_dir), v.AS_OF_MS).select("key", "ts_ms")


@query("cache_evict", sql_views("cache") + "SELECT key, ts_ms FROM (SELECT *, row_number() OVER (ORDER BY coalesce(ts_ms, 0), key) AS n, count(*) OVER () AS total FROM cache) WHERE n > ceil(total * 0.25)")
def cache_evict(spark, sf_dir):
    return caches.evict(v.cache(spark, sf_dir)).select("key", "ts_ms")


# Rasters.

_PX, _WIDE = sql_views("pixels"), sql_views("pixels_wide")
_EVEN = "CASE WHEN abs({0} - floor({0}) - 0.5) < 1e-12 THEN 2 * round({0} / 2) ELSE round({0}) END"


def _clamp(t: str) -> str:
    return f"greatest(0.0::DOUBLE, least(255.0::DOUBLE, {t}))"


@query("luma", _PX + "SELECT image_id, y, x, round(gray, 6) AS gray FROM pixels")
def luma(spark, sf_dir):
    return raster.with_gray(v.pixels(spark, sf_dir)).select("image_id", "y", "x", _r("gray").alias("gray"))


@query("prep_normal", _PX + f"SELECT image_id, y, x, round_even(255.0::DOUBLE - {_clamp('(gray - 128) * 2.5::DOUBLE + 128')}, 0) AS value FROM pixels")
def prep_normal(spark, sf_dir):
    return raster.with_gray(v.pixels(spark, sf_dir)).select("image_id", "y", "x", raster.prep_normal(F.col("gray")).alias("value"))


_FOIL = """stats AS (SELECT image_id, avg(gray) AS avg_brightness, avg(abs(r - (r + g + b) / 3) + abs(g - (r + g + b) / 3) + abs(b - (r + g + b) / 3)) AS color_variance, avg((gray > 180)::INT) AS bright_ratio,
    avg((gray < 75)::INT) AS dark_ratio, avg((gray <= 180 AND gray >= 75)::INT) AS midtone_ratio FROM pixels GROUP BY 1),
votes AS (SELECT *, (color_variance > 15)::INT + (midtone_ratio > 0.4)::INT + (dark_ratio < 0.3 AND bright_ratio < 0.3)::INT AS votes FROM stats)"""
_T = "CASE WHEN avg_brightness > 140 THEN 160.0::DOUBLE WHEN avg_brightness < 100 THEN 100.0::DOUBLE ELSE 128.0::DOUBLE END"
_FOIL_VALUE = f"round_even(255.0::DOUBLE - {_clamp('CASE WHEN gray > t THEN 128.0::DOUBLE + (gray - t) * (127.0::DOUBLE / (255.0::DOUBLE - t)) * 1.8::DOUBLE ELSE gray / t * 128 * 0.6::DOUBLE END')}, 0)"


@query("image_stats", sql_views("pixels", more=_FOIL) + "SELECT image_id, round(avg_brightness, 6) AS avg_brightness, round(color_variance, 6) AS color_variance, round(bright_ratio, 6) AS bright_ratio, round(dark_ratio, 6) AS dark_ratio, round(midtone_ratio, 6) AS midtone_ratio FROM stats")
def image_stats(spark, sf_dir):
    s = raster.image_stats(v.pixels(spark, sf_dir))
    return s.select("image_id", *[_r(c).alias(c) for c in s.columns[1:]])


@query("foil_vote", sql_views("pixels", more=_FOIL) + "SELECT image_id, votes, votes >= 2 AS is_foil FROM votes")
def foil_vote(spark, sf_dir):
    return raster.foil_vote(raster.image_stats(v.pixels(spark, sf_dir))).select("image_id", "votes", "is_foil")


@query("prep_foil", sql_views("pixels", more=_FOIL) + f"SELECT image_id, y, x, {_FOIL_VALUE} AS value FROM (SELECT p.*, {_T} AS t FROM pixels p JOIN stats USING (image_id))")
def prep_foil(spark, sf_dir):
    p = v.pixels(spark, sf_dir)
    joined = raster.with_gray(p).join(raster.image_stats(p), "image_id")
    return joined.select("image_id", "y", "x", raster.prep_foil(F.col("gray"), F.col("avg_brightness")).alias("value"))


@query("prep_dispatch", sql_views("pixels", more=_FOIL) + f"SELECT image_id, y, x, CASE WHEN votes >= 2 THEN {_FOIL_VALUE} ELSE round_even(255.0::DOUBLE - {_clamp('(gray - 128) * 2.5::DOUBLE + 128')}, 0) END AS value FROM (SELECT p.*, votes, {_T} AS t FROM pixels p JOIN votes USING (image_id))")
def prep_dispatch(spark, sf_dir):
    p = v.pixels(spark, sf_dir)
    out = raster.prepare_for_reading(p, raster.foil_vote(raster.image_stats(p)))
    return out.select("image_id", "y", "x", F.col("r").alias("value"))


@query("contrast", _PX + "SELECT image_id, y, x, " + ", ".join(f"round_even({_clamp(f'({c} - 128) * 2 + 128')}, 0) AS {c}" for c in "rgb") + " FROM pixels")
def contrast(spark, sf_dir):
    return raster.preprocess(v.pixels(spark, sf_dir), "contrast").select("image_id", "y", "x", "r", "g", "b")


@query("invert", _PX + "SELECT image_id, y, x, " + ", ".join(f"round(255 - {c}, 6) AS {c}" for c in "rgb") + " FROM pixels")
def invert(spark, sf_dir):
    p = raster.preprocess(v.pixels(spark, sf_dir), "invert")
    return p.select("image_id", "y", "x", *[_r(c).alias(c) for c in "rgb"])


@query("upscale", _PX + "SELECT image_id, y * 2 + dy AS y, x * 2 + dx AS x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pixels, range(2) a(dy), range(2) b(dx)")
def upscale(spark, sf_dir):
    return _rgb(raster.preprocess(v.pixels(spark, sf_dir), "upscale"))


_RGB = ", ".join(f"round({c}, 6) AS {c}" for c in "rgb")


def _rgb(df):
    return df.select("image_id", "y", "x", *[_r(c).alias(c) for c in "rgb"])


@query("sharpen", _PX + "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN round_even({_clamp('n' + c)}, 0) ELSE round({c}, 6) END AS {c}" for c in "rgb") + """
    FROM (SELECT p.image_id, p.y, p.x, """ + ", ".join(f"any_value(p.{c}) AS {c}, round(any_value(p.{c}) * 10 - sum(q.{c}), 9) AS n{c}" for c in "rgb")
    + " FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY 1, 2, 3)")
def sharpen(spark, sf_dir):
    return _rgb(raster.preprocess(v.pixels(spark, sf_dir), "sharpen"))


@query("crop_quadrant", _WIDE + f"SELECT image_id, y - 8 AS y, x, {_RGB} FROM pixels_wide WHERE x < 8 AND y >= 8")
def crop_quadrant(spark, sf_dir):
    return _rgb(raster.crop_quadrant(v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir)))


_BOTTOM = "bottoms AS (SELECT image_id, max(y) AS bottom_edge FROM (SELECT image_id, y FROM pixels_dark WHERE x >= 13 GROUP BY 1, 2 HAVING avg((gray < 100)::INT) > 0.6) GROUP BY 1)"
_LEFT = "lefts AS (SELECT image_id, min(x) AS left_edge FROM (SELECT image_id, x FROM pixels_dark WHERE y >= 13 GROUP BY 1, 2 HAVING avg((gray < 100)::INT) > 0.6) GROUP BY 1)"
_EDGES = sql_views("pixels_dark", more=f"{_BOTTOM}, {_LEFT}, every AS (SELECT DISTINCT image_id FROM pixels_dark)")


@query("bottom_edge", _EDGES + "SELECT image_id, bottom_edge FROM every LEFT JOIN bottoms USING (image_id)")
def bottom_edge(spark, sf_dir):
    return raster.bottom_edge(v.pixels_dark(spark, sf_dir), v.images_wide(spark, sf_dir))


@query("left_edge", _EDGES + "SELECT image_id, left_edge FROM every LEFT JOIN lefts USING (image_id)")
def left_edge(spark, sf_dir):
    return raster.left_edge(v.pixels_dark(spark, sf_dir), v.images_wide(spark, sf_dir))


@query("crop_edges", _EDGES + f"SELECT image_id, y, x - left_edge AS x, {_RGB} FROM pixels_dark JOIN bottoms USING (image_id) JOIN lefts USING (image_id) WHERE y <= bottom_edge AND x >= left_edge")
def crop_edges(spark, sf_dir):
    p, i = v.pixels_dark(spark, sf_dir), v.images_wide(spark, sf_dir)
    cut = raster.crop_left(raster.crop_bottom(p, raster.bottom_edge(p, i)), raster.left_edge(p, i))
    return _rgb(cut)


_PROFILE = "profile AS (SELECT image_id, y, avg(gray) AS value FROM pixels WHERE x < 6 GROUP BY 1, 2)"
_NEAR = "SELECT *, lag(value) OVER w AS prev, lead(value) OVER w AS next FROM {} WINDOW w AS (PARTITION BY image_id ORDER BY y)"


@query("brightness_profile", sql_views("pixels", more=_PROFILE) + "SELECT image_id, y, round(value, 6) AS value FROM profile")
def brightness_profile(spark, sf_dir):
    return raster.brightness_profile(v.pixels(spark, sf_dir), v.images(spark, sf_dir)).select("image_id", "y", _r("value").alias("value"))


@query("brightness_peaks", sql_views("pixels", more=_PROFILE) + f"SELECT image_id, y FROM ({_NEAR.format('profile')}) WHERE value > 30 AND value > prev + 10 AND value > next + 10")
def brightness_peaks(spark, sf_dir):
    return raster.brightness_peaks(raster.brightness_profile(v.pixels(spark, sf_dir), v.images(spark, sf_dir)))


def _sobel_sql(pixels: str) -> str:
    return f"""sobel_rows AS (SELECT image_id, y, x, lead(gray) OVER w - lag(gray) OVER w AS d, lag(gray) OVER w + 2 * gray + lead(gray) OVER w AS s FROM {pixels} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
sobel AS (SELECT * FROM (SELECT image_id, y, x, lag(d) OVER w + 2 * d + lead(d) OVER w AS gx, lead(s) OVER w - lag(s) OVER w AS gy FROM sobel_rows WINDOW w AS (PARTITION BY image_id, x ORDER BY y)) WHERE gx IS NOT NULL AND gy IS NOT NULL),
density AS (SELECT image_id, y, count(*) FILTER (sqrt(gx * gx + gy * gy) > 50) AS edges, avg((sqrt(gx * gx + gy * gy) > 50)::INT) AS value FROM sobel GROUP BY 1, 2)"""


_SOBEL = sql_views("pixels", more=_sobel_sql("pixels"))


@query("sobel", _SOBEL + "SELECT image_id, y, x, round(gx, 6) + 0 AS gx, round(gy, 6) + 0 AS gy FROM sobel")
def sobel(spark, sf_dir):
    return raster.sobel(v.pixels(spark, sf_dir)).select("image_id", "y", "x", _r("gx").alias("gx"), _r("gy").alias("gy"))


@query("edge_density", _SOBEL + "SELECT image_id, y, edges, round(value, 6) AS value FROM density")
def edge_density(spark, sf_dir):
    return raster.edge_density(v.pixels(spark, sf_dir)).withColumn("value", _r("value"))


@query("edge_peaks", _SOBEL + f"SELECT image_id, y FROM ({_NEAR.format('density')}) WHERE value > 0.1 AND value > prev AND value > next")
def edge_peaks(spark, sf_dir):
    return raster.edge_peaks(raster.edge_density(v.pixels(spark, sf_dir)))


_BLOCKS = """around AS (SELECT image_id, y, x, gray, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q, count(*) OVER w AS n FROM pixels_wide WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
nine AS (SELECT image_id, y, x, gray, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM around WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
spread AS (SELECT image_id, y, x, gray, greatest(0.0::DOUBLE, q / n - (s / n) * (s / n)) AS variance FROM nine),
blocks AS (SELECT image_id, y // 8 * 8 AS y, x // 8 * 8 AS x, least(count(*) FILTER (gray > 128), count(*) FILTER (NOT gray > 128))::DOUBLE / greatest(count(*) FILTER (gray > 128), count(*) FILTER (NOT gray > 128)) AS contrast,
    avg(variance) AS variance FROM spread WHERE x < 8 GROUP BY 1, 2, 3),
likely AS (SELECT *, (contrast > 0.2 AND contrast < 0.8)::INT * 0.5::DOUBLE + (variance > 200 AND variance < 2000)::INT * 0.5::DOUBLE AS likelihood FROM blocks),
patterns AS (SELECT image_id, y, avg(likelihood) AS value FROM likely GROUP BY 1, 2)"""
_VAR = sql_views("pixels_wide", more=_BLOCKS)


@query("local_variance", _VAR + "SELECT image_id, y, x, round(variance, 4) AS variance FROM spread")
def local_variance(spark, sf_dir):
    return raster.local_variance(v.pixels_wide(spark, sf_dir)).select("image_id", "y", "x", _r("variance", 4).alias("variance"))


@query("block_likelihood", _VAR + "SELECT image_id, y, x, round(contrast, 6) AS contrast, round(variance, 4) AS variance, likelihood FROM likely")
def block_likelihood(spark, sf_dir):
    b = raster.block_likelihood(v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir))
    return b.withColumns({"contrast": _r("contrast"), "variance": _r("variance", 4)})


@query("pattern_peaks", _VAR + "SELECT image_id, y FROM patterns WHERE value > 0.3")
def pattern_peaks(spark, sf_dir):
    return raster.pattern_peaks(raster.pattern_profile(v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir)))


_BANDS = sql_views("pixels_wide", more=_sobel_sql("pixels_wide") + ",\n" + _BLOCKS + f""",
bright AS (SELECT image_id, y FROM ({_NEAR.format("(SELECT image_id, y, avg(gray) AS value FROM pixels_wide WHERE x < 12 GROUP BY 1, 2)")}) WHERE value > 30 AND value > prev + 10 AND value > next + 10),
edged AS (SELECT image_id, y FROM ({_NEAR.format('density')}) WHERE value > 0.1 AND value > prev AND value > next),
agreed AS (SELECT b.image_id, b.y, 1 + (EXISTS (SELECT 1 FROM edged e WHERE e.image_id = b.image_id AND e.y <> 0 AND abs(e.y - b.y) < 20))::INT
           + (EXISTS (SELECT 1 FROM patterns p WHERE p.value > 0.3 AND p.image_id = b.image_id AND p.y <> 0 AND abs(p.y - b.y) < 20))::INT AS score FROM bright b),
best AS (SELECT image_id, y AS top, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y) AS n FROM agreed) WHERE n = 1)""")  # fmt: skip


@query("consensus_peaks", _BANDS + "SELECT image_id, y, score FROM agreed")
def consensus_peaks(spark, sf_dir):
    p, i = v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir)
    return raster.consensus(raster.brightness_peaks(raster.brightness_profile(p, i)), raster.edge_peaks(raster.edge_density(p)), raster.pattern_peaks(raster.pattern_profile(p, i)))


@query("consensus_band", _BANDS + """SELECT image_id, CASE WHEN ok THEN top ELSE 14 END AS start_y, CASE WHEN ok THEN least(top + 1, 16) - top ELSE 2 END AS band_height, ok AS used_enhanced, CASE WHEN ok THEN score END AS score
    FROM (SELECT i.image_id, top, score, coalesce(top > 0, false) AS ok FROM (SELECT DISTINCT image_id FROM pixels_wide) i LEFT JOIN best USING (image_id))""")  # fmt: skip
def consensus_band(spark, sf_dir):
    return raster.find_bands(v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir))


@query("crop_band", _BANDS + f"SELECT p.image_id, p.y - s AS y, x, {_RGB}" + """ FROM pixels_wide p JOIN (SELECT image_id, CASE WHEN coalesce(top > 0, false) THEN top ELSE 14 END AS s, CASE WHEN coalesce(top > 0, false) THEN 1 ELSE 2 END AS h
    FROM (SELECT DISTINCT image_id FROM pixels_wide) LEFT JOIN best USING (image_id)) USING (image_id) WHERE p.y >= s AND p.y < s + h""")  # fmt: skip
def crop_band(spark, sf_dir):
    p, i = v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir)
    return _rgb(raster.crop_band(p, raster.find_bands(p, i)))


def _dark_sql(source: str, line: str, pick: str, where: str) -> str:
    return f"SELECT image_id, {pick}({line}) AS edge FROM (SELECT image_id, {line} FROM {source} WHERE {where} GROUP BY 1, 2 HAVING avg((gray < 100)::INT) > 0.6) GROUP BY 1"


_DETECT = sql_views("pixels_card", more=f"""quarter AS (SELECT image_id, y - 16 AS y, x, r, g, b, gray FROM pixels_card WHERE x < 16 AND y >= 16),
bottoms AS ({_dark_sql('quarter', 'y', 'max', 'x >= 16 - 3')}),
cut AS (SELECT q.*, edge + 1 AS h FROM quarter q JOIN bottoms USING (image_id) WHERE y <= edge),
lefts AS ({_dark_sql('cut', 'x', 'min', 'y >= h - greatest(3, floor(h * 0.1))')}),
card AS (SELECT image_id, y, x - edge AS x, r, g, b, gray, h, 16 - edge AS w FROM cut JOIN lefts USING (image_id) WHERE x >= edge),
{_FOIL.replace('FROM pixels', 'FROM card')},
{_sobel_sql('card')},
around AS (SELECT image_id, y, x, h, w, gray, sum(gray) OVER v AS s, sum(gray * gray) OVER v AS q, count(*) OVER v AS n FROM card WINDOW v AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
nine AS (SELECT image_id, y, x, h, w, gray, sum(s) OVER v AS s, sum(q) OVER v AS q, sum(n) OVER v AS n FROM around WINDOW v AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
blocks AS (SELECT image_id, h - 8 * ((h - 1 - y) // 8 + 1) AS y, count(*) FILTER (gray > 128) AS bright, count(*) FILTER (NOT gray > 128) AS dark, avg(greatest(0.0::DOUBLE, q / n - (s / n) * (s / n))) AS variance
    FROM nine WHERE y >= h % 8 AND x // 8 * 8 < w - 8 GROUP BY 1, 2, x // 8),
patterned AS (SELECT image_id, y FROM blocks GROUP BY 1, 2 HAVING avg((least(bright, dark)::DOUBLE / greatest(bright, dark) > 0.2 AND least(bright, dark)::DOUBLE / greatest(bright, dark) < 0.8)::INT * 0.5 + (variance > 200 AND variance < 2000)::INT * 0.5) > 0.3),
profile AS (SELECT image_id, y, avg(gray) AS value FROM card WHERE x < floor(w * 0.8) GROUP BY 1, 2),
bright AS (SELECT image_id, y FROM ({_NEAR.format('profile')}) WHERE value > 30 AND value > prev + 10 AND value > next + 10),
edged AS (SELECT image_id, y FROM ({_NEAR.format('density')}) WHERE value > 0.1 AND value > prev AND value > next),
agreed AS (SELECT b.image_id, b.y, 1 + (EXISTS (SELECT 1 FROM edged e WHERE e.image_id = b.image_id AND e.y <> 0 AND abs(e.y - b.y) < 20))::INT
           + (EXISTS (SELECT 1 FROM patterned p WHERE p.image_id = b.image_id AND p.y <> 0 AND abs(p.y - b.y) < 20))::INT AS score FROM bright b),
best AS (SELECT image_id, arg_max(y, (score, -y)) AS top FROM agreed GROUP BY 1),
cards AS (SELECT DISTINCT image_id, h FROM card),
bands AS (SELECT image_id, coalesce(top > 0, false) AS ok, CASE WHEN coalesce(top > 0, false) THEN top ELSE h - floor(h * 0.15) END AS start_y,
          CASE WHEN coalesce(top > 0, false) THEN least(top + floor(h * 0.08), h) - top ELSE floor(h * 0.15) END AS band_height FROM cards LEFT JOIN best USING (image_id))""")  # fmt: skip


@query("detect_card", _DETECT + """SELECT i.image_id, CASE WHEN b.edge IS NULL THEN 'no bottom edge' WHEN l.edge IS NULL THEN 'no left edge' WHEN band_height > 0 THEN 'found' ELSE 'empty band' END AS status, b.edge AS bottom_edge, l.edge AS left_edge,
    votes >= 2 AS is_foil, start_y::INT AS start_y, band_height::INT AS band_height, ok AS used_enhanced
    FROM (SELECT DISTINCT image_id FROM pixels_card) i LEFT JOIN bottoms b USING (image_id) LEFT JOIN lefts l USING (image_id) LEFT JOIN votes USING (image_id) LEFT JOIN bands USING (image_id)""")  # fmt: skip
def detect_card(spark, sf_dir):
    return detection.detect(detection.image_arrays(v.pixels_card(spark, sf_dir), v.images_card(spark, sf_dir)))


# The stream over the same events, the recogniser's boundary, and the binary form of rasters.


@query("ledger_stream", sql_views("holdings") + "SELECT collection, key, count, epoch_us(added_at) // 1000 AS added_ms FROM holdings")
def ledger_stream(spark, sf_dir):
    """The whole event table through the streaming ledger; what is left is the last change of each key."""
    from ..streaming.ledger_stream import ledger_updates

    source = v.table(spark, sf_dir, "events")
    out = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    stream = v.as_ledger(spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    log = ledger_updates(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}/log").trigger(availableNow=True)
    # A batch that runs again replaces its own folder.
    log.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/changes/batch={n}")).start().awaitTermination()
    last = spark.read.parquet(f"{out}/changes").groupBy("collection", "key").agg(F.max_by(F.struct("count", "added_at"), "batch").alias("s"))
    return last.filter("s.count > 0").select("collection", "key", F.col("s.count").alias("count"), F.unix_millis("s.added_at").alias("added_ms"))


def _plain_reader(contents):
    """Stands for a recogniser in the queries: the bytes of an "image" are its text."""
    return contents.map(lambda b: bytes(b).decode("utf-8"))


@query("ocr_boundary", f"SELECT 'image-' || p_partkey AS path, '  ' || p_name || chr(10) AS recognized, {_squeeze("'  ' || p_name || chr(10)")} AS text FROM part")
def ocr_boundary(spark, sf_dir):
    """Each part's name as a file's bytes, handed to a reader in batches; what it gives is normalised."""
    files = v.table(spark, sf_dir, "part").select(F.concat(F.lit("image-"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("  "), "p_name", F.lit("\n")).cast("binary").alias("content"))
    return stores.recognition(_plain_reader, files).withColumn("text", txt.normalize_recognized(F.col("recognized")))


# Sources and sinks.


@query("image_directory", """SELECT 'C ' || p_partkey || ' FDN EN' AS stem, strlen(p_name) AS size, sha256(p_name) AS digest, 'data:image/jpeg;base64,' || to_base64(encode(p_name)) AS url FROM part WHERE p_partkey % 7 < 6""")
def image_directory(spark, sf_dir):
    """Parts' names written as files of several kinds and folders; only those of images are found again."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".jpeg", ".PNG", ".jpg", ".png", ".txt")]), (k % 7 + 1).cast("int"))
    name = F.concat(F.lit("files-"), k % 3, F.lit("/C "), k, F.lit(" FDN EN"), kind)
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    sources.write_files(v.table(spark, sf_dir, "part").select(name.alias("path"), F.col("p_name").cast("binary").alias("content")), folder)
    found = sources.scan_directory(spark, folder)
    return found.select("stem", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"), sources.data_url(F.col("content")).alias("url"))


@query("accepted_uploads", "SELECT p_partkey, coalesce(starts_with(mime, 'image/'), false) AS accepted FROM (SELECT p_partkey, ['image/png', 'text/plain', NULL, 'image/', 'IMAGE/png', 'video/image/'][p_partkey % 6 + 1] AS mime FROM part)")
def accepted_uploads(spark, sf_dir):
    mimes = F.array(*[F.lit(x) for x in ("image/png", "text/plain", None, "image/", "IMAGE/png", "video/image/")])
    return v.table(spark, sf_dir, "part").select("p_partkey", sources.accepts_upload(F.get(mimes, (F.col("p_partkey") % 6).cast("int"))).alias("accepted"))


@query("stored_holdings", sql_views("collections") + """SELECT id AS collection, id || '-' || i AS card, CASE WHEN i = 0 THEN 1 ELSE i END::BIGINT AS count, i = 2 AS is_foil, CASE WHEN i = 1 THEN 'Ä "x"' END AS name FROM collections, range(4) t(i) WHERE ord % 5 > 1 AND i <= ord % 4""")
def stored_holdings(spark, sf_dir):
    """Each collection's cards as the JSON text under its key: some broken, some empty, some absent, with stray fields and counts of zero."""
    c, n = v.collections(spark, sf_dir), F.col("ord") % 5
    card = lambda i: F.struct(F.concat_ws("-", "id", i.cast("string")).alias("id"), i.cast("double").alias("count"), F.when(i == 2, True).alias("isFoil"), F.when(i == 1, 'Ä "x"').alias("name"), F.lit(3).alias("previousQuantity"))
    cards = F.to_json(F.transform(F.sequence(F.lit(0), F.col("ord") % 4), card))
    value = F.when(n == 0, F.concat(F.lit("{broken"), cards)).when(n == 1, F.when(F.col("ord") % 2 == 0, F.lit("[]"))).otherwise(cards)
    return stores.read_holdings(c.select(F.concat(F.lit("cards-"), "id").alias("key"), value.alias("value"))).select("collection", F.col("id").alias("card"), "count", "is_foil", "name")


@query("holdings_table", sql_views("holdings") + "SELECT collection, key, count FROM holdings")
def holdings_table(spark, sf_dir):
    """The holdings written twice, a folder per collection, and read back."""
    path = f"{shared_dir(spark)}/holdings-{uuid.uuid4().hex}"
    held = _held(spark, sf_dir).select("collection", "key", "count")
    for _ in range(2):
        stores.write_holdings(held, path)
    return spark.read.schema("key string, count long, collection string").parquet(path).select("collection", "key", "count")


@query("report_json", _EVAL + """SELECT 'image' AS part, image::VARCHAR AS name, any_value(expected) AS expected, count(*) AS tests, round(max(accuracy), 6) AS best FROM results GROUP BY ALL
    UNION ALL SELECT 'config', config, NULL, tests, round(max_accuracy, 6) FROM stats""")  # fmt: skip
def report_json(spark, sf_dir):
    """The evaluation's report as JSON files, read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    results = v.results(spark, sf_dir)
    stores.write_report(results, ev.config_stats(results), path)
    one = "results array<struct<config_ord: int, config: string, recognized: string, accuracy: double, success: boolean>>"
    images = spark.read.schema(f"image long, expectedText string, {one}").json(f"{path}/results")
    images = images.select(F.lit("image").alias("part"), F.col("image").cast("string").alias("name"), F.col("expectedText").alias("expected"), F.size("results").cast("long").alias("tests"), _r(F.array_max("results.accuracy")).alias("best"))
    configs = spark.read.schema("config string, tests long, max_accuracy double").json(f"{path}/summary")
    return images.unionByName(configs.select(F.lit("config").alias("part"), F.col("config").alias("name"), F.lit(None).cast("string").alias("expected"), "tests", _r("max_accuracy").alias("best")))


@query("label_map", sql_views("strips", "catalog") + f"SELECT raw AS code, name AS expected FROM (SELECT *, {_API} AS l FROM strips) s JOIN catalog c ON lower(s.set_code) = c.set AND s.number::INT = c.catalog_number AND s.l = c.lang")
def label_map(spark, sf_dir):
    """Labels of strips from the catalogue, replaced and read back."""
    path = f"{shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    found = lookup.label_catalog(v.strips(spark, sf_dir).select(F.col("raw").alias("code"), "set_code", "number", "language"), v.catalog(spark, sf_dir))
    for labels in (found.limit(0), found):
        stores.write_labels(labels, path)
    return spark.read.parquet(path)


@query("catalog_cards", sql_views("strips") + "SELECT 'card-' || part_key AS id, p_name AS name, CASE part_key % 3 WHEN 0 THEN 'own-' || part_key WHEN 1 THEN 'face-' || part_key END AS image FROM strips WHERE part_key % 5 > 0")
def catalog_cards(spark, sf_dir):
    """Cards as JSON texts, with an image, with faces that have one, with neither, or broken."""
    k = F.col("part_key")
    own = F.when(k % 3 == 0, F.struct(F.concat(F.lit("own-"), k).alias("normal")))
    faces = F.when(k % 3 < 2, F.array(F.struct(F.struct(F.concat(F.lit("face-"), k).alias("normal")).alias("image_uris"))))
    card = F.to_json(F.struct(F.concat(F.lit("card-"), k).alias("id"), F.col("p_name").alias("name"), own.alias("image_uris"), faces.alias("card_faces")))
    return lookup.read_catalog(v.strips(spark, sf_dir).select(F.when(k % 5 == 0, F.substring(card, 2, 1000)).otherwise(card).alias("value"))).select("id", "name", "image")


@query("cached_dictionary", "SELECT 'young' AS state, i AS ord, ['ABC', 'FDN', 'X1'][i + 1] AS code FROM range(3) t(i) UNION ALL SELECT s, i, ['FDN', 'DSK', 'BLB', 'OTJ', 'MKM', 'LCI', 'WOE'][i + 1] FROM range(7) t(i), (VALUES ('old'), ('broken')) u(s)")
def cached_dictionary(spark, sf_dir):
    """The set dictionary: from a cache that is young enough, and the built-in one where it is a day old or no list."""
    out = None
    for state, value, age in (("young", '["abc", "FDN", "x1"]', 86_399_999), ("old", '["abc"]', 86_400_000), ("broken", "{", 5)):
        cached = spark.createDataFrame([("sets", value, v.AS_OF_MS - age)], "key string, value string, ts_ms long")
        codes = stores.set_codes(spark, cached, v.AS_OF_MS).select(F.lit(state).alias("state"), "ord", "code")
        out = codes if out is None else out.unionByName(codes)
    return out


# What is left of the inventory: dates, nested values, registry changes, removals, whole exports.


@query("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%-d.%-m.%Y') AS local_date, 1000000000000 - epoch_us(o_orderdate) // 1000 AS age_ms FROM orders")
def date_formats(spark, sf_dir):
    from ..functions import values

    ts = F.col("o_orderdate").cast("timestamp")
    o = v.table(spark, sf_dir, "orders").withColumn("iso", values.iso(ts))
    return o.select("o_orderkey", "iso", values.day_of(F.col("iso")).alias("day"), values.local_date(ts).alias("local_date"), values.age_ms(1_000_000_000_000, F.unix_millis(ts)).alias("age_ms"))


@query("array_values", """SELECT vec_id, len(list_filter(embedding, lambda e: e > 0)) AS positive, len(list_filter(embedding, lambda e: e > 0.4)) > 0 AS any_large, array_to_string(list_transform(embedding[1:3], lambda e: floor(e * 10)::INT::VARCHAR), ',') AS head FROM embeddings""")
def array_values(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), F.exists("embedding", lambda x: x > F.lit(0.4).cast("float")).alias("any_large"),
        F.array_join(F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x * 10).cast("int").cast("string")), ",").alias("head"),
    )


@query("json_values", "SELECT event_id, regexp_extract(props, '(\\d+)', 1)::INT AS k, '{\"k\":' || regexp_extract(props, '(\\d+)', 1) || '}' AS again FROM events")
def json_values(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    return e.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("k"), F.to_json("m").alias("again"))


@query("pattern_profile", _VAR + "SELECT image_id, y, value FROM patterns")
def pattern_profile(spark, sf_dir):
    return raster.pattern_profile(v.pixels_wide(spark, sf_dir), v.images_wide(spark, sf_dir))


_NOW = "2030-01-01"


@query("collection_create", sql_views("collections") + "SELECT id, name, card_count FROM collections UNION ALL SELECT 'coll_new', 'Fresh Cards', 0")
def collection_create(spark, sf_dir):
    once = colls.create(v.collections(spark, sf_dir), " Fresh Cards ", "coll_new", _NOW)
    return colls.create(once, "fresh cards", "coll_other", _NOW).select("id", "name", "card_count")


@query("collection_rename", sql_views("collections") + "SELECT id, CASE WHEN ord = 3 THEN 'Renamed' ELSE name END AS name, ord = 3 AS changed FROM collections")
def collection_rename(spark, sf_dir):
    done = colls.rename(v.collections(spark, sf_dir), "coll_000000003", "Renamed", _NOW)
    return done.select("id", "name", (F.col("last_modified") == F.lit(_NOW).cast("timestamp")).alias("changed"))


@query("collection_switch", sql_views("collections") + "SELECT max(id) AS id FROM collections WHERE id = 'coll_000000005'")
def collection_switch(spark, sf_dir):
    return colls.switch(spark.createDataFrame([("coll_000000001",)], "id string"), v.collections(spark, sf_dir), "coll_000000005")


@query("collection_bootstrap", sql_views("collections") + "SELECT id, name FROM collections WHERE card_count < 0 UNION ALL SELECT 'coll_default', 'My Collection'")
def collection_bootstrap(spark, sf_dir):
    return colls.bootstrap(v.collections(spark, sf_dir).filter("card_count < 0"), "coll_default", "My Collection", _NOW).select("id", "name")


@query("collection_migrate", sql_views("holdings") + "SELECT collection, key, count FROM holdings WHERE collection <> '1' UNION ALL SELECT '1', p_name || p_partkey, 1 FROM part")
def collection_migrate(spark, sf_dir):
    old = v.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("key"), F.lit(1).cast("long").alias("count"))
    return colls.migrate(old, _held(spark, sf_dir).select("collection", "key", "count"), "1")


@query("holdings_backfill", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END AS count, coalesce(CASE WHEN p_size % 2 = 0 THEN true END, false) AS is_foil FROM part")
def holdings_backfill(spark, sf_dir):
    stored = v.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size")).alias("count"), F.when(F.col("p_size") % 2 == 0, True).alias("is_foil"), F.lit(7).alias("previousQuantity")
    )
    return led.normalize_holdings(stored)


@query("ledger_removals", sql_views(more="""ev AS (SELECT user_id::VARCHAR AS collection, regexp_extract(props, '"k": (\\d+)', 1) AS key, ts, event_id AS seq,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'inc' WHEN event_type = 'error' THEN 'dec' WHEN event_type = 'view' THEN 'remove' ELSE 'clear' END AS op FROM events),
    m AS (SELECT *, count(*) FILTER (op = 'clear') OVER (PARTITION BY collection ORDER BY ts, seq) AS clears, count(*) FILTER (op = 'remove') OVER (PARTITION BY collection, key ORDER BY ts, seq) AS removes FROM ev),
    s AS (SELECT *, sum(CASE op WHEN 'inc' THEN 1 ELSE -1 END) OVER (PARTITION BY collection, key, clears, removes ORDER BY ts, seq) AS s FROM m WHERE op IN ('inc', 'dec')),
    h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY collection, key, clears, removes ORDER BY ts, seq)) AS count FROM s),
    l AS (SELECT collection, key, clears, removes, arg_max(count, (ts, seq)) AS count FROM h GROUP BY ALL)""").replace("WITH ,", "WITH ")
    + """SELECT l.collection, l.key, l.count::BIGINT AS count FROM l JOIN (SELECT collection, count(*) FILTER (op = 'clear') AS c FROM ev GROUP BY 1) a ON a.collection = l.collection AND a.c = l.clears
    JOIN (SELECT collection, key, count(*) FILTER (op = 'remove') AS r FROM ev GROUP BY 1, 2) b ON b.collection = l.collection AND b.key = l.key AND b.r = l.removes WHERE l.count > 0""")  # fmt: skip
def ledger_removals(spark, sf_dir):
    e, kind = v.table(spark, sf_dir, "events"), F.col("event_type")
    op = F.when(kind.isin("purchase", "click"), "inc").when(kind == "error", "dec").when(kind == "view", "remove").otherwise("clear")
    events = e.select(F.col("user_id").cast("string").alias("collection"), F.regexp_extract("props", r'"k": (\d+)', 1).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"))
    return led.holdings(events).select("collection", "key", "count")


@query("export_csv", sql_views("holdings") + "SELECT collection, 'Count,Name,Edition,Condition,Language,Foil,Collector Number' || chr(10) || string_agg(count || ',\"' || key || '\",,Near Mint,English,' || CASE WHEN ends_with(key, '_foil') THEN 'Yes' ELSE 'No' END || ',', chr(10) ORDER BY key) AS csv FROM holdings GROUP BY 1")
def export_csv(spark, sf_dir):
    held = _held(spark, sf_dir)
    rows = held.select("collection", "key", "count", F.col("key").alias("name"), F.lit(None).cast("string").alias("set"), F.lit(None).cast("string").alias("language_display"), F.col("key").endswith("_foil").alias("is_foil"), F.lit("").alias("number"))
    return stores.csv_text(led.export_rows(rows), "key")


@query("set_dictionary", "SELECT i AS ord, ['FDN', 'DSK', 'BLB', 'OTJ', 'MKM', 'LCI', 'WOE'][i + 1] AS code FROM range(7) t(i)")
def set_dictionary(spark, sf_dir):
    return stores.set_codes(spark)


@query("registry_values", sql_views("collections") + "SELECT id, name, card_count, id = 'coll_000000004' AS is_active FROM collections WHERE ord < 1000000000")
def registry_values(spark, sf_dir):
    """The registry as JSON texts, one per collection, read again."""
    c = v.collections(spark, sf_dir)
    value = F.to_json(F.struct(F.create_map("id", F.struct("id", "name", F.col("card_count").alias("cardCount"))).alias("collections"), F.lit("coll_000000004").alias("activeCollection")))
    return stores.read_registry(c.select(F.lit("collections").alias("key"), value.alias("value"))).select("id", "name", "card_count", "is_active")
