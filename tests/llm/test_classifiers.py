import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glyphledger.llm import quality as Q
from glyphledger.llm import toxicity as T
from glyphledger.llm.common import held_out, utf8

TERMS = [("idiot", False, 1.0), ("worthless", False, 1.0), ("disgusting", False, 0.9), ("bad", False, 0.5), ("lowei", True, 1.0)]


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    auto, rng = T.TrieAutomaton(TERMS), np.random.default_rng(0)
    words = {"idiot", "idoit", "idit", "diot", "idiots", "xidiot", "bad", "bed", "loweiish", "lowe", "", "worthles", "wrothless", "disgsutign"}
    for text, _, _ in TERMS:
        for _ in range(150):
            w = list(text)
            for _ in range(rng.integers(0, 4)):
                k, i = rng.integers(0, 4), int(rng.integers(0, max(1, len(w))))
                if k == 0 and w:
                    w.pop(i)
                elif k == 1:
                    w.insert(i, chr(97 + int(rng.integers(0, 26))))
                elif k == 2 and w:
                    w[i] = chr(97 + int(rng.integers(0, 26)))
                elif len(w) > i + 1:
                    w[i], w[i + 1] = w[i + 1], w[i]
            words.add("".join(w))
    for w in words:
        near = [distance(w, t) for t, stem, _ in TERMS if not stem and distance(w, t) <= T.edits_allowed(t)] + [0 for t, stem, _ in TERMS if stem and w.startswith(t)]
        found = auto.match(w)
        assert (found[0] if found else None) == min(near, default=None), w


def test_context_and_odd_texts():
    s = T.Scorer(TERMS)
    plain, quoted = s.score(["You are an idiot and worthless"])[0], s.score(['They wrote "idiot" in the report'])[0]
    assert plain > 0.5 > quoted
    words = "idiot and worthless"
    for text in (f'"Hello," they smiled, then {words} scum, "bye"', f'"a" {words} "b"', f"«a» {words} «b»", f'"open {words}\nand "so on"', f'5" {words} 6"'):
        assert s.score([text])[0] > 0.5, text
    for text in (f'They said "{words}" once', f"„{words}“ stand da", f"«{words}»", f"»{words}«", f'"well, {words}"'):
        assert s.score([text])[0] < 0.5, text
    far = ["x" * 40] * 5
    assert s.hits(" ".join(["said", *far, "idiot"]))[0][4] < 1 == s.hits(" ".join(["said", "y", *far, "idiot"]))[0][4]
    assert s.score(["1d1ot w0rthless"])[0] > 0.5 and s.score(["", " ", "?!"]).max() < 0.5
    assert T.Scorer([]).score(["anything", ""]).tolist() == T.Scorer([]).score(["", ""]).tolist()


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = np.random.default_rng(1)
    syll = ["ka", "ro", "mi", "tel", "ans", "ore", "ub", "ist"]
    word = lambda: "".join(rng.choice(syll, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        y = int(i % 4 == 0)
        if y:
            w[int(rng.integers(0, 60))] = rng.choice(["zonkhead", "blurfy", "grixel"])
        rows.append((i, " ".join(w)))
        labels.append((i, y if i % 50 else None))
    rows += [(1000, None), (1001, ""), (1, rows[1][1])]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.score_toxicity(docs, T.fit_toxicity(docs, marks), ["doc_id"]).select("doc_id", "score", held_out().alias("h")).collect()
    assert len(out) == len(rows) and all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    test = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in out if r["h"] and r["doc_id"] < 600]
    assert np.mean(test) > 0.97
    nothing = T.score_toxicity(docs, T.fit_toxicity(docs, marks.limit(0)), ["doc_id"])
    assert nothing.filter("score >= 0.5").count() == 0 and T.score_toxicity(docs.limit(0), T.fit_toxicity(docs, marks), ["doc_id"]).count() == 0


def test_words_that_a_stem_covers_are_caught_misspelt():
    forms = ["achlicha", "achliche", "achlichen", "achlicher"]
    texts = [f"{w} c{i} d{i} e{i} f{i}" for i in range(200) for w in ([forms[i // 2 % 4]] if i % 2 else ["plain"])]
    terms = T.learn_lexicon(texts, [i % 2 for i in range(200)])
    assert any(stem and "achlichen".startswith(t) for t, stem, _ in terms)
    s = T.Scorer(terms)
    for word in ("cahlichen", "axhliche", "chlicher"):
        assert s.hits(word), word
    assert not s.hits("plain")


def test_one_clean_row_switches_no_misspelling_off(spark):
    texts = [f"you idiot c{i} d{i} e{i} f{i}" if i % 2 else f"plain c{i} d{i} e{i} f{i}" for i in range(400)]
    texts = [t + " idiom" if i % 8 == 0 else t for i, t in enumerate(texts)]
    texts[2] += " idoit"
    texts += [texts[2]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(t.startswith("you"))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, marks)
    assert "idoit" not in model[2] and "idiom" in model[2]
    s = T.Scorer(*model)
    assert s.hits("an idoit") and not s.hits("an idiom")


def test_no_term_is_dropped_and_states_are_bounded(monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(p) for p in itertools.islice(itertools.product(letters, "aeiou", letters, "xz"), 1500)]
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words, 200, replace=False)) for _ in range(300)] + [f"plain d{i} e{i} f{i}" for i in range(300)]
    terms = T.learn_lexicon(texts, [1] * 300 + [0] * 300, stem_odds=99)
    assert {t for t, _, _ in terms} == set(words)
    monkeypatch.setattr(T, "MAX_STATES", 40)
    small, auto = T.TrieAutomaton(TERMS), T.TrieAutomaton(TERMS)
    for w in ["".join(np.random.default_rng(i).choice(list("idotwrhles"), 7)) for i in range(500)] + ["idoit"]:
        small_says = small.match(w)
        monkeypatch.setattr(T, "MAX_STATES", 10**9)
        assert auto.match(w) == small_says
        monkeypatch.setattr(T, "MAX_STATES", 40)
    assert len(small._sets) < len(auto._sets)


@pytest.mark.parametrize("name", ["op1_quality", "op9_toxicity"])
def test_queries_score_every_row(spark, tmp_path, name):
    """The registered queries against a fit and a score of the same rows, one by one."""
    from glyphledger.llm import queries

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["ka", "ro", "mi", "tel", "ans"], 3))
    rows, labels = [], []
    for i in range(400):
        bad, junk = i % 5 == 0, i % 7 == 0
        lines = [" ".join(word() for _ in range(12)) + "." for _ in range(4)]
        lines[1] += " you zonkhead and blurfy" if bad else ""
        lines += ["BUY!! NOW!! | BUY!! NOW!!"] * 3 if junk else []
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not junk) if i % 30 else None, int(bad) if i % 31 else None))
    long = rows[5][1] * 2000
    rows += [(1000, None), (1001, ""), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (1002, long)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, toxicity int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    marks = {d: (q, t) for d, q, t in labels}
    k, least = (0, 0.3) if name == "op1_quality" else (1, 0.5)
    assert all(r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1 for r in got)
    seen = [(r["predicted"], marks[r["doc_id"]][k]) for r in got if r["doc_id"] in marks and r["held_out"] and marks[r["doc_id"]][k] is not None]
    assert len(seen) > 60 and np.mean([a == b for a, b in seen]) > 0.97
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values()) and len(by[7]) == 1
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    marked = spark.read.parquet(f"{tmp_path}/labels.parquet")
    if k:
        one = T.Scorer(*T.fit_toxicity(whole, marked))
        want = {d: float(one.score([t or ""])[0]) for d, t in rows}
    else:
        model = Q.fit_quality(whole, marked)
        want = {d: float(model.score(*utf8(pa.array([t or ""])))[0]) for d, t in rows}
    assert all(abs(next(iter(by[d])) - want[d]) < 1e-6 for d in want)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    marked.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert queries.QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_lines():
    texts = ["a\nb\n", "", "\n", "x", "\n\ny\n", " é\nq", None]
    raw, at = utf8(pa.array(texts))
    s, e, f = Q.lines_of(raw, at)
    assert [[bytes(raw[s[k] : e[k]]).decode() for k in range(f[i], f[i + 1])] for i in range(len(texts))] == [(t or "").split("\n") for t in texts]


@pytest.mark.parametrize("n", [1, 2, 6])
def test_marginals_equal_enumeration(n):
    rng = np.random.default_rng(n)
    emit, moves = rng.normal(size=n), rng.normal(size=3)
    total, good = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        score = sum(e * v for e, v in zip(emit, y, strict=True)) + sum({(0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2], (0, 0): 0.0}[p] for p in itertools.pairwise(y))
        total += np.exp(score)
        good += np.exp(score) * np.array(y)
    chain = Q.Chain(np.ones(1), moves)
    assert np.allclose(chain.marginals(emit[:, None], np.array([0, n])), good / total)
    again = np.tile(emit, 300 // n + 1)
    ahead, back = chain.messages(np.concatenate([again, again[:200]]), np.array([0, len(again), len(again) + 200]))
    assert np.isfinite(ahead + back).all()


def test_long_rows_alone_equal_rows_together(monkeypatch):
    rng = np.random.default_rng(9)
    emit, chain = rng.normal(size=700), Q.Chain(np.ones(1), rng.normal(size=3))
    alone = chain.messages(emit, np.array([0, 700]))
    for a in range(1, 700):  # the recursions, step by step
        assert np.isclose(alone[0][a], emit[a] + chain._forward(alone[0][a - 1], chain.moves))
        assert np.isclose(alone[1][a - 1], chain._backward(emit[a] + alone[1][a], chain.moves))


def test_quality_finds_bad_lines():
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stones", "slowly"], 9)) + "."
    texts, labels = [], []
    for i in range(400):
        lines = [good() for _ in range(int(rng.integers(1, 6)))]
        if i % 2:
            lines.insert(int(rng.integers(0, len(lines) + 1)), " | ".join("BUY!! NOW!!" for _ in range(6)))
        texts.append("\n".join(lines))
        labels.append(1 - i % 2)
    model = Q.fit(texts[:300], labels[:300])
    raw, at = utf8(pa.array(texts[300:] + ["", "\n", "x" * 200_000]))
    p = model.score(raw, at)
    assert ((p[:100] >= 0.5) == (np.array(labels[300:]) == 1)).mean() > 0.97 and len(p) == 103 and np.isfinite(p).all()
    assert Q.fit(texts[:10], [1] * 10).score(raw, at).tolist() == [0.5] * 103
