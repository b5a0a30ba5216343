"""Scan-text functions over columns: cleaning, scoring, choosing, parsing, keys.

White space is what ECMAScript calls so, and word borders are ASCII; both differ
from the JVM's, so the patterns spell them out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE = r"[\s\x0B   -     　﻿]"
BLANKS = "\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SET_CODES = ["FDN", "DSK", "BLB", "OTJ", "MKM", "LCI", "WOE"]
LANGUAGES = {
    "EN": ("en", "English"), "DE": ("de", "German"), "FR": ("fr", "French"), "ES": ("es", "Spanish"), "IT": ("it", "Italian"),
    "PT": ("pt", "Portuguese"), "JP": ("ja", "Japanese"), "KO": ("ko", "Korean"), "RU": ("ru", "Russian"), "ZH": ("zhs", "Chinese"),
}
RARITIES = "CURMBLST"
MISREAD = {"|": "1", "\\": "1", "O": "0", "I": "1", "l": "1", "S": "5"}
CODE_SCORE, RARITY_SCORE, NUMBER_SCORE, LANGUAGE_SCORE, LENGTH_SCORE = 50, 15, 30, 10, 5
NUMBER = r"\d{3,5}"
#: Patterns name first what is rare, so that long texts are passed over by one class of letters.
LANGUAGE = rf"(?=[{''.join(sorted({c[0] for c in LANGUAGES}))}])({'|'.join(LANGUAGES)})(?![0-9A-Za-z_])(?<![0-9A-Za-z_]..)"
RARITY = rf"[{RARITIES}](?={SPACE})(?<={SPACE}.)"
RUN = f"[{BLANKS}][{BLANKS} ]*| [{BLANKS} ]+"


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(" " + BLANKS))


def squeeze(text: Column) -> Column:
    """Trimmed, each run of white space one blank; single blanks, nearly all of them, are left alone."""
    return F.trim(F.regexp_replace(text, RUN, " "))


def clean_text(raw: Column) -> Column:
    """STR1: recognised text with usual misreadings mended; null gives ''."""
    text = squeeze(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?i)([CUMNR])\1+", "$1")
    text = F.regexp_replace(text, r"(\d)\1{3,}", "$1")
    for seen, meant in MISREAD.items():
        text = F.replace(text, F.lit(seen), F.lit(meant))
    text = F.regexp_replace(text, r"[^0-9A-Za-z /]+", "")
    return F.upper(F.trim(F.regexp_replace(text, " {2,}", " ")))


def code_pattern(codes: list[str] | None = None) -> str:
    """One alternation; where two codes fit at one place the first listed wins."""
    codes = codes or SET_CODES
    first = "".join(sorted({re.escape(c[0]) for c in codes if c}))
    return (f"(?=[{first}])" if all(codes) else "") + f"({'|'.join(codes)})"


def score_text(text: Column, codes: list[str] | None = None) -> Column:
    """STR2: how much a text looks like a collector line, 0 to 110; upper case counts."""
    t = F.coalesce(text, F.lit(""))

    def points(found: Column, n: int) -> Column:
        return F.when(found, n).otherwise(0)

    return (
        points(t.rlike(code_pattern(codes)), CODE_SCORE)
        + points(t.rlike(RARITY), RARITY_SCORE)
        + points(t.rlike(NUMBER), NUMBER_SCORE)
        + points(t.rlike(LANGUAGE), LANGUAGE_SCORE)
        + points((F.length(t) > 10) | (F.octet_length(F.encode(t, "UTF-16BE")) > 20), LENGTH_SCORE)  # counted in UTF-16 units
    )


def choose_text(raw: Column, cleaned: Column, codes: list[str] | None = None) -> Column:
    """STR3: struct of both scores, the chosen text and its score; a tie goes to the cleaned text."""
    a, b = score_text(raw, codes), score_text(cleaned, codes)
    return F.struct(
        a.alias("raw_score"), b.alias("cleaned_score"), F.when(a > b, raw).otherwise(cleaned).alias("final_text"), F.greatest(a, b).alias("final_score"), (a > b).alias("used_raw")
    )


def key_text(text: Column) -> Column:
    """STR4: what keys are looked for in: trimmed and in capitals."""
    return F.upper(trim_all(text))


def key_parts(upper: Column, codes: list[str] | None = None) -> dict[str, Column]:
    """STR4: set code, number and language that stand in a key text, each null if there is none."""
    found = {"set_code": (code_pattern(codes), 1), "number": (f"({NUMBER})", 1), "language": (LANGUAGE, 1)}
    return {name: F.nullif(F.regexp_extract(upper, pattern, group), F.lit("")) for name, (pattern, group) in found.items()}


def parse_key(text: Column, codes: list[str] | None = None) -> Column:
    """STR4: struct (set_code, number, language), null unless there are both a set code and a number."""
    parts = key_parts(key_text(text), codes)
    return F.when(parts["set_code"].isNotNull() & parts["number"].isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def unique_id(card_id: Column, alternative: Column, is_foil: Column) -> Column:
    """STR5: id and variant; null without an id."""
    key = F.coalesce(F.nullif(card_id, F.lit("")), F.nullif(alternative, F.lit("")))
    return F.concat(key, F.when(F.coalesce(is_foil, F.lit(False)), "_foil").otherwise("_normal"))


FILE_NAME = r"^([CRMUL])\s+(\d+)\s+([A-Z]{3,4})\s+([A-Z]{2})$"


def parse_code(name: Column) -> Column:
    """STR6: struct (rarity, number padded to three digits, set, language) of a file name's stem, or null."""
    part = lambda k: F.regexp_extract(name, FILE_NAME, k)
    number = F.when(F.length(part(2)) < 3, F.lpad(part(2), 3, "0")).otherwise(part(2))
    return F.when(name.rlike(FILE_NAME), F.struct(part(1).alias("rarity"), number.alias("number"), F.lower(part(3)).alias("set_code"), F.lower(part(4)).alias("language")))


def normalize_recognized(text: Column) -> Column:
    """STR10."""
    return squeeze(text)


def escape_html(text: Column) -> Column:
    """STR11."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def card_path(set_code: Column, number: Column, language: Column | None = None) -> Column:
    """STR12: the catalogue path of a card, with its language unless that is null."""
    path = F.concat(F.lit("/cards/"), F.lower(set_code), F.lit("/"), parse_int(number).cast("string"))
    return path if language is None else F.concat(path, F.coalesce(F.concat(F.lit("?lang="), language), F.lit("")))


def base64(data: Column) -> Column:
    """Bytes in Base64 on one line; Spark's own breaks lines after 76 characters, unless a setting says otherwise."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def cache_key(url: Column) -> Column:
    """STR13."""
    return F.concat(F.lit("card-image-"), base64(F.encode(url, "UTF-8")))


def new_collection_id() -> Column:
    """STR14: unique and not repeatable."""
    return F.concat(F.lit("coll_"), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 9))


def fixed(number: Column, digits: int = 1) -> Column:
    """STR15: a number with so many decimals, without thousands' marks."""
    return F.format_string(f"%.{digits}f", number)


def pad_end(text: Column, width: int) -> Column:
    """STR15: padded, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def parse_int(text: Column) -> Column:
    """FN6: the leading digits as a number, else null."""
    return F.nullif(F.regexp_extract(text, rf"^{SPACE}*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def language_code(code: Column) -> Column:
    """JOIN9: the catalogue's language, English by default."""
    pairs = F.create_map(*[F.lit(x) for k, (v, _) in LANGUAGES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(code, F.lit(""))), F.lit("en"))


def language_name(code: Column) -> Column:
    """JOIN9: the language's name for display, English by default."""
    pairs = F.create_map(*[F.lit(x) for k, (_, v) in LANGUAGES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(code, F.lit(""))), F.lit("English"))


LABEL_JUNK = r"[^a-zA-ZäöüÄÖÜß\-',." + SPACE[1:]


def label_from_name(stem: Column) -> Column:
    """JOIN8: what a file is called when no label is known for it."""
    return trim_all(F.regexp_replace(stem, LABEL_JUNK, " "))
