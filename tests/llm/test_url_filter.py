import random

import pytest

from glyphledger.llm import url_filter as U

RULES = [U.Rule("org", "/", "allow"), U.Rule("example.org", "/es/", "block"), U.Rule("example.org", "/en/1", "block"), U.Rule("com", "/fr/", "allow"), U.Rule("com", "/de/", "block"), U.Rule("a.b.c", "", "block"), U.Rule("b.c", "/é", "allow")]


def brute(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min([rest.find(c, end) for c in "?#" if rest.find(c, end) >= 0], default=len(rest))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("max_blob", [U.MAX_BLOB, 60])
def test_rules_equal_brute_force(spark, max_blob):
    rng = random.Random(1)
    hosts = ["org", "ORG", "x.org", "example.org", "www.Example.org", "notexample.org", "com", "a.b.c", "z.a.b.c", "b.c", "x..org", ".org", "", "org.", "a" * 500 + ".com", ".".join("abcdefgh" * 30)]
    paths = ["", "/", "/es", "/es/x", "/en/1", "/en/12", "/fr/", "/de/?q", "#top", "/é/1", "?x=/es/"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.org/es/", "://", "http://x://y.org/", "http://a\nb.org/\n"] + ["http://org/"] * 2
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, RULES, max_blob=max_blob).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}
    assert U.filter_urls(df, []).filter("verdict = 'allow'").count() == len(urls) and U.filter_urls(df.limit(0), RULES).count() == 0


def test_collisions_are_told_apart_by_their_strings():
    table = U.DigestArray(U.pack(RULES + [U.Rule("org", "/", "block")], digest=lambda s: len(s)))
    hit, low, high = table.probe(__import__("numpy").array([4, 999, 16], "uint64"))
    assert hit.tolist() == [0, 2] and {table.text(i) for i in range(low[1], high[1])} == {"example.org/en/1"}
    assert {table.text(i): table.verdict(i) for i in range(low[0], high[0])} == {"org/": "block"}
