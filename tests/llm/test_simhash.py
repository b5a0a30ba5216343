import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from glyphledger.llm import simhash as S
from glyphledger.llm.common import utf8
from glyphledger.llm.components import connected_components


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    texts = ["", "a", " A b  C\n", "x y z w", "x\ty z w v Éa É ", None, "é " * 9 + "q", " ".join(f"w{i % 911}" for i in range(150_000))]
    raw, at = utf8(pa.array(texts))
    assert S.fingerprints(raw, at).tolist() == [brute(t) for t in texts]


@pytest.mark.parametrize(("large", "seeds"), [(2048, 256), (8, 256), (8, 3), (8, 0)])
def test_links_lose_no_pair(monkeypatch, spark, large, seeds):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).tolist()
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                b ^= 1 << int(bit)
            fps.add(b)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "SEEDS", seeds)
    sent = S.probes(spark.createDataFrame([(f,) for f in signed], "fp long")).toPandas()
    u, v = S.bucket_links(sent.bucket.to_numpy(), sent.probe.to_numpy(), sent.fp.to_numpy().view(np.uint64))
    found = connected_components(spark.createDataFrame(list(zip(u.view(np.int64).tolist(), v.view(np.int64).tolist(), strict=True)), "u long, v long"))
    root = {r["u"]: r["root"] for r in found.collect()}
    want = components(fps)
    got = [root.get(f, f) for f in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("segment", range(3))
def test_a_bucket_of_unlinked_fingerprints_is_no_square(segment):
    first, bits, _ = S.SEGMENTS[segment]
    rng = np.random.default_rng(segment)
    mask = np.uint64(((1 << bits) - 1) << first)
    fps = np.unique(rng.integers(0, 2**64, 40_000, np.uint64) & ~mask | np.uint64(5 << first))
    linked = fps[:50] ^ np.uint64(1 << ((first + bits) % 64) | 1 << ((first + bits + 21) % 64) | 1 << ((first + bits + 35) % 64))
    every = np.unique(np.concatenate([fps, linked]))
    began = time.process_time()
    u, v = S.bucket_links(np.full(len(every), segment << 22), np.zeros(len(every), bool), every)
    assert time.process_time() - began < 20
    pairs = {frozenset(p) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert {frozenset(p) for p in zip(fps[:50].tolist(), linked.tolist(), strict=True)} <= pairs


def test_components_of_documents(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text, 1), (3, text, 1), (9, text + " end", 1), (7, "something else that is said here only once", 1), (None, None, 1), (2, "", 1), (2, "", 1), (None, "alone in the world with five words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = S.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()
    prints = [brute(r[1]) for r in rows]
    roots = components(prints)
    want = []
    for (doc, _, _), f, r in zip(rows, prints, roots, strict=True):
        ids = [x[0] for x, q in zip(rows, roots, strict=True) if q == r and x[0] is not None]
        want.append((doc, f"{f:016x}", min(ids, default=None)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_long_paths_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    root = {r["u"]: r["root"] for r in connected_components(links).collect()}
    assert all(root.get(i, i) == 0 for i in range(61)) and root[101] == 100
