"""One query per corpus operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import held_out, read_table, scratch_path
from .chat import conversation_digests, events_of, format_chats
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .quality import fit_quality, score_quality
from .sentencepiece_codec import encode_sentencepiece
from .simhash import simhash_components
from .token_store import verify_documents, write_store
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import Rule, filter_urls
from .warc import audit, read_trees, write_archives, write_trees, written_name


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("row_key")


def tokenizer_file(name):
    """Where the tokenizer files are: the folder in spark.glyphledger.tokenizers, else the installed package."""
    import public_tokenizers
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    folder = spark.conf.get("spark.glyphledger.tokenizers", None) if spark else None
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sentencepiece(spark, sf_dir):
    return encode_sentencepiece(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


def op3_chat_formatting(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_chats(events_of(turns.unionByName(probe), revised=True)))


def op10_decontamination(spark, sf_dir):
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op6_url_filters(spark, sf_dir):
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op5_warc_fixity(spark, sf_dir):
    """Two replicas of the pages' archives, written as files and read back; in the second some records changed by a byte, some are lost, and some are in it alone."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.coalesce(F.col("page_id") * 48271 % 1009, F.lit(-1))
    half = F.floor(F.length("html") / 2).cast("int")
    changed = F.concat(F.substring("html", 1, half), F.lit("~"), F.substring("html", half + 2, F.length("html")))
    there = {"a": (~fate.between(30, 34), F.col("html")), "b": (~fate.between(25, 29), F.when(fate.between(0, 24), changed).otherwise(F.col("html")))}
    folders = write_archives(pages, there, scratch_path(spark, "replicas"))
    return audit(spark, *(write_trees(read_trees(spark, folders[k], written_name)) for k in "ab"))


def op7_simhash(spark, sf_dir):
    return simhash_components(read_table(spark, sf_dir, "documents")).drop("row_key")


def op8_token_store(spark, sf_dir):
    store = write_store(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1)
    return verify_documents(spark, store)


def op9_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_url_filters": op6_url_filters,
    "op7_simhash": op7_simhash,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

_NORMAL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SAID = "'\\### Assistant: </turn> ok'"

SQL = {
    "op3_chat_formatting": f"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})),
        c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                     coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
                     sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
                     sum(4 + length(role) + 2 + length(text) + 8 + length(text) - length(replace(text, '\\', ''))
                         + (length(text) - length(replace(text, '</', ''))) // 2
                         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda s: length(s) - 1)), 0)) AS formatted_chars
              FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORMAL}) AS text_sha256 FROM documents),
        w AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM w""",
    "op5_warc_fixity": """
        WITH p AS (SELECT *, coalesce(page_id * 48271 % 1009, -1) AS fate, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, url, fate, body AS a, CASE WHEN fate BETWEEN 0 AND 24 THEN coalesce(substr(html, 1, length(html) // 2) || '~' || substr(html, length(html) // 2 + 2), '') ELSE body END AS b,
                     chr(13) || chr(10) AS e FROM p),
        t AS (SELECT *, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
                     || 'Content-Type: text/html' || e || 'Content-Length: ' AS head FROM h),
        r AS (SELECT page_id, (page_id // 500)::VARCHAR AS archive, 'urn:page:' || page_id AS record_id, fate, head || strlen(a) || e || e || a || e || e AS a, head || strlen(b) || e || e || b || e || e AS b FROM t),
        x AS (SELECT archive, page_id, record_id, strlen(a) AS length_a, sha256(a) AS digest_a, (sum(strlen(a)) OVER w - strlen(a))::BIGINT AS offset_a FROM r WHERE fate NOT BETWEEN 30 AND 34
              WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING)),
        y AS (SELECT archive, page_id, record_id, strlen(b) AS length_b, sha256(b) AS digest_b, (sum(strlen(b)) OVER w - strlen(b))::BIGINT AS offset_b FROM r WHERE fate NOT BETWEEN 25 AND 29
              WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING))
        SELECT archive, CASE WHEN digest_b IS NULL THEN 'lost' WHEN digest_a IS NULL THEN 'added' ELSE 'changed' END AS kind, record_id, offset_a, length_a, digest_a, offset_b, length_b, digest_b
        FROM x FULL JOIN y USING (archive, page_id, record_id) WHERE digest_a IS DISTINCT FROM digest_b""",
    "op6_url_filters": """
        WITH r(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                                         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict
        FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n""",
    "op10_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id::VARCHAR AS item, size, array_to_string(w[i:i + size - 1], ' ') AS k
                FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        g AS (SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
              FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
        hit AS (SELECT n, i, size, item FROM g JOIN win USING (size, k)),
        p AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM hit) GROUP BY n),
        t AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM hit) GROUP BY n)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (n) LEFT JOIN t USING (n)""",
}
