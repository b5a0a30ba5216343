import corpus_pipeline
import numpy as np

from glyphledger.llm import near_dedup as N


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def corpus(rng):
    """Texts and edited copies of them: words replaced or cut off, similarities on both sides of 0.8, and one large family."""
    text = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    rows = []
    for n, copies in [(120, 2)] * 40 + [(30, 3)] * 10 + [(100, 120)]:
        base = text(n)
        rows.append(base)
        for _ in range(copies):
            new = list(base)
            for at in rng.integers(0, n, rng.integers(1, 6)):
                new[at] = f"x{rng.integers(0, 10**9)}"
            rows.append(new[: n - int(rng.integers(0, n // 8))])
    return [" ".join(r) for r in rows] + ["a b", "A  b", "a c"]


def test_stage_links_all_pairs_at_four_fifths_and_no_others(spark):
    texts = corpus(np.random.default_rng(4))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted({find(i) for i in range(len(texts))})
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_links_across_components_of_a_group():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 9, 18, 27, 500)]
    u, v = N.cross_links(np.arange(5), np.arange(5), [s.tobytes() for s in sets])
    assert {tuple(sorted(x)) for x in zip(u, v, strict=True)} == {(0, 1), (1, 2), (2, 3)}
    assert N.cross_links(np.arange(5), np.array([0, 0, 0, 0, 4]), [s.tobytes() for s in sets]) == ([], [])


def test_no_rows(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
