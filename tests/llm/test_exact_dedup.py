import hashlib
import re

import numpy as np
import pytest

from glyphledger.llm import exact_dedup as X
from glyphledger.llm.common import keep_rows

LONG = " ".join(f"word{i * i % 9973}" for i in range(60_000))
ROWS = [
    (5, "a b c", "x"), (3, "ab c", "x"), (4, "a  b\tc", "x"), (9, None, "x"), (8, "", "x"), (7, " \n\x0b", "x"), (1, LONG, "x"), (2, LONG.replace(" ", "\n"), "x"), (6, LONG + "!", "x"),
    (11, "same", "x"), (11, "same", "x"), (None, "none", "x"), (12, "none", "x"), (13, "é é", "x"), (14, "éé", "x"), (15, "e", "x"),
]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for doc, text, _ in rows:
        same = [r for r in rows if norm(r[1]) == norm(text)]
        keep = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((doc, keep, len(same), hashlib.sha256(norm(text).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_groups_equal_brute_force_even_when_digests_collide(spark, digest_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, recipe string").repartition(3)
    got = X.exact_dedup(docs, digest_bytes=digest_bytes).collect()
    key = lambda r: str(tuple(r))
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(brute(ROWS), key=key)
    assert sum(r["kept"] for r in got) == len({b[3] for b in brute(ROWS)})


def test_kept_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, recipe string")
    kept = keep_rows(docs, X.exact_dedup(docs).filter("kept"))
    assert kept.columns == docs.columns
    assert kept.count() == len({b[3] for b in brute(ROWS)})
    assert X.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_depend_on_content_only():
    data = np.frombuffer(LONG.encode(), np.uint8)
    cuts = X.cut_places(data, np.array([0]))
    moved = X.cut_places(np.concatenate([np.frombuffer(b"some other beginning ", np.uint8), data]), np.array([0])) - 21
    assert len(cuts) > 100 and len(set(cuts.tolist()) ^ set(moved.tolist())) <= 2
