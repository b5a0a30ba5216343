import re

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphledger.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    w, hit, who = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - size + 1) if b else 0):
            k = b[i : i + size]
            for j in range(len(w) - len(k) + 1):
                if w[j : j + len(k)] == k:
                    hit |= set(range(j, j + len(k)))
                    who.add(item)
    return len(w), len(hit), sorted(who)


def cases():
    rng = np.random.default_rng(0)
    vocab = ["a", "b", "é", "Word", "x1", "漢", "zz", "long" * 9]
    items = [(str(i), " ".join(rng.choice(vocab, rng.integers(0, 25)))) for i in range(12)] + [("3", "extra one"), ("99", None), ("98", "!!"), ("97", "solo")]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 200))) for _ in range(60)]
    for _, t in items:
        texts += [f"Before, {(t or '').upper()}; after", t, f"{t} {t}", "solo", "a\x00b.c-D", "", None]
    texts += [" ".join(["a"] * 3000), "a b " * 2000, texts[0], texts[0]]
    return items, texts


def test_spans_equal_brute_force(spark, monkeypatch):
    items, texts = cases()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spams int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    for block in (D.PACKED_BYTES, 700):
        assert (D.pack_windows(bench, packed_bytes=block).count() > 2) == (block == 700)
        found = D.find_contamination(docs, bench, ["doc_id", "spams"], packed_bytes=block).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == want
        assert all(r["n_hit"] == sum(e - s for s, e in r["spans"]) for r in found)
    other = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in ("n_hit", "spans", "items", "n_words")])
    assert {r["doc_id"]: r["n_hit"] for r in D.find_contamination(other, bench, other.columns).collect()} == {k: v[1] for k, v in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "50")  # the number of blocks is the text's
    assert D.pack_windows(bench.repartition(20)).count() == 1 and D.pack_windows(bench, item_bytes=100).count() > 5
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert D.find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert D.find_contamination(docs, bench.limit(0), ["doc_id"]).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("symbols", [[], [3], [1, 1, 1, 1], [2, 1, 2, 1, 2, 1], list(np.random.default_rng(1).integers(0, 3, 500))])
def test_suffix_array(symbols):
    s = np.array(symbols, np.int64)
    assert D.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_wavelet_ranks_and_index():
    v = np.random.default_rng(2).integers(0, 37, 800)
    w = D.WaveletMatrix(v, 6)
    at = np.arange(801)
    for c in (0, 5, 36):
        assert w.rank(np.full(801, c), at).tolist() == [int((v[:i] == c).sum()) for i in at]
    assert w.access(np.arange(800)).tolist() == v.tolist()
    h = v.astype(np.uint64) + np.uint64(1)
    index = D.FMIndex(h, np.array([0, 300, 300, 800]))
    low, high = index.search(h, np.array([5, 6, 7]), np.array([0, 0]), np.array([3, 1]))
    for k, n in ((0, 3), (1, 1)):
        want = [i for b in ((0, 300), (300, 800)) for i in range(b[0], b[1] - n + 1) if (h[i : i + n] == h[5 : 5 + n]).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_packing_is_linear_and_counts_what_is_sent():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in rng.integers(0, 200_000, 400_000))
    items = [(str(i), text[i * 4000 : (i + 1) * 4000]) for i in range(len(text) // 4000)]
    began = time.process_time()
    made = D.windows_of(items)
    assert time.process_time() - began < 20
    assert made.size < 15 * len(text) and len(made.starts) > 390_000
    blocks = [b for batch in D._packer(10, 1 << 20)([D.pa.RecordBatch.from_arrays([D.pa.array(c) for c in zip(*((0, *i) for i in items), strict=True)], names=["b", "i", "t"])]) for b in batch.column(0).to_pylist()]
    assert len(blocks) > 5 and max(map(len, blocks)) < (1 << 20) + 5000


def test_a_word_that_is_everywhere_and_an_item_longer_than_a_block():
    began = time.process_time()
    raw, at = D.utf8(D.pa.array(["solo and " * 60_000, "none"]))
    got = D._shard(raw, at, D.windows_of([("1", "solo")]))
    assert got[0][:2] == (120_000, 60_000) and got[0][3] == ["1"] and got[1][1] == 0
    assert time.process_time() - began < 10
    rng = np.random.default_rng(6)
    text = " ".join(f"w{k}" for k in rng.integers(0, 50, 5000))
    pieces = list(D._pieces("x", text, 900, 10))
    whole, parts = D.windows_of([("x", text)]), D.windows_of(pieces)
    count = lambda w: {tuple(bytes(w.words[w.word_at[k] : w.word_at[k + 1]]) for k in w.numbers[s : s + n]) for s, n in zip(w.starts, w.lengths, strict=True)}
    assert len(pieces) > 10 and count(whole) == count(parts)
