"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Lexicon.  Learned from labelled rows that are not held out: whole words and
stems (first letters of inflected words) that stand in toxic texts far more
often than in clean ones.  The fit reads at most SAMPLE_ROWS labelled rows of
each class, of at most SAMPLE_CHARS characters; which ones, a hash of the id
decides.  Scoring reads every text whole.

Search.  The automaton of all terms within their edit distance (none up to
MIN_FUZZY - 1 letters, one below MIN_FUZZY_2, then two; insert, delete, replace
and swap cost one) is the intersection of a trie of the lexicon with Levenshtein
automata.  Its deterministic states are made when a text first needs them and
kept, so a word costs one step per letter whatever the lexicon's size.  Digits
and signs that stand for letters are read as those letters.

Score.  A hit has its term's weight, less for misspellings, and much less where
it is quoted: it lies between two paired quotation marks of its line, and of the
six words on either side one reports speech or none addresses the reader ("you",
"du", ...); a reporting word alone lessens it a little.  A logistic regression,
drawn to sensible weights so that it does not depend on the sample for kinds it
has not seen, makes the score of the strongest hit, the sums of sure and of
unsure hits, their share among the words and the number of sure ones.  Unsure
are misspellings of words that a stem covers: in inflecting languages such words
lie near ordinary ones.  Words that happen to be near a term are no misspellings
of it if they stand in several clean texts of the sample, and not far more often
in toxic ones.

Null and empty texts have no hits and get the score of such a text.  Labels
that are null do not count.  Without labels of both classes the lexicon is
empty and all scores are equal and below a half.  Repeated rows each get their
score; a column of the score's name gives way to it, other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
#: Automaton states kept; beyond them the automaton begins anew.
MAX_STATES = 200_000
MIN_FUZZY, MIN_FUZZY_2 = 5, 10
STEM_ODDS = 2.0
WINDOW = 6
MEMO, MEMO_CHARS = 200_000, 64

# Letters that digits and signs stand for, words that report speech, words that address a reader.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
REPORTING = frozenset("said says quote quoted quotes wrote called word words term slur insult dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your youre u du dich dein ihr euch sie tu toi vous ton ta tú usted eres are".split())

_WORD = re.compile(r"[\w@$]+(?:[*][\w@$]+)*")
_QUOTE = re.compile("[\"“”„«»‹›\n]")
# What closes a quotation that a mark opens.
_PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹"}

#: Logistic weights that the fit is drawn to: bias, strongest hit, sums of sure and of unsure hits, hits among the words, number of sure hits.
PRIOR = (-3.0, 5.0, 1.0, 0.5, 1.0, 1.0)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < MIN_FUZZY else 1 if len(term) < MIN_FUZZY_2 else 2


class TrieAutomaton:
    """Deterministic automaton of the words within their edit distance of a lexicon's terms.

    terms: (text, is_stem, weight).  Stems match without edits, and any ending.
    A state is a frozen set of (trie node, edits so far, letter owed after a swap).
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.reach: list[int] = [0]
        self.terms = terms
        for k, (text, is_stem, _) in enumerate(terms):
            node, most = 0, 0 if is_stem else edits_allowed(text)
            self.reach[0] = max(self.reach[0], most)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            (self.stem if is_stem else self.word)[node] = k
        self.letters = {c for kids in self.children for c in kids}
        self._begin()

    def _begin(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._accept: list[tuple[int, int] | None] = []
        self._dead = self._state(set())
        self._start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        todo, found = list(items), set(items)
        while todo:  # a letter of the term left out
            node, e, owed = todo.pop()
            if not owed:
                for child in self.children[node].values():
                    if e < self.reach[child] and (child, e + 1, "") not in found:
                        found.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        key = frozenset(found)
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            ends = [(e, self.word[n]) for n, e, owed in key if not owed and self.word[n] >= 0 and e <= edits_allowed(self.terms[self.word[n]][0])]
            self._accept.append(min(ends, default=None))
        return self._states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, owed in self._sets[state]:
            kids = self.children[node]
            if owed:
                if owed == c:
                    out.add((node, e, ""))
                continue
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.reach[node]:
                out.add((node, e + 1, ""))  # a letter too many
            for child in kids.values():
                if e < self.reach[child]:
                    out.add((child, e + 1, ""))  # another letter
            for first, child in kids.items():  # two letters swapped
                if c in self.children[child] and c != first and e < self.reach[self.children[child][c]]:
                    out.add((self.children[child][c], e + 1, first))
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best term for the whole word or, without edits, for its beginning."""
        if len(self._sets) > MAX_STATES:
            self._begin()
        state, node, stem = self._start, 0, -1
        for c in word:
            if node is not None:
                node = self.children[node].get(c)
                if node is not None and self.stem[node] >= 0:
                    stem = self.stem[node]
            if state != self._dead:
                known = c if c in self.letters else ""
                ahead = self._next[state].get(known)
                state = self._next[state].setdefault(known, self._step(state, known)) if ahead is None else ahead
            elif node is None:
                break
        best = self._accept[state] if state != self._dead else None
        return best if best and (best[0] == 0 or stem < 0) else (0, stem) if stem >= 0 else best


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def distinct_texts(texts: list[str]) -> list[int]:
    """Indexes of texts that are no near copy of an earlier one: none of three min-hashes of their word triples is known."""
    seen, out = [set(), set(), set()], []
    for i, text in enumerate(texts):
        w = _words(text)
        triples = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
        least = [min(xxhash.xxh64_intdigest(t, seed) for t in triples) for seed in range(3)]
        if not any(m in s for m, s in zip(least, seen, strict=True)):
            out.append(i)
        for m, s in zip(least, seen, strict=True):
            s.add(m)
    return out


def learn_lexicon(texts: list[str], toxic: list[int], least: int = 4, share: float = 0.01, odds: float = 3.5, stem_odds: float = STEM_ODDS) -> list[tuple[str, bool, float]]:
    """Terms (text, is_stem, weight 0..1) by the smoothed log odds of standing in a toxic text; copies count once."""
    once = distinct_texts(texts)
    texts, toxic = [texts[i] for i in once], [toxic[i] for i in once]
    bad, good, n_bad, n_good = Counter(), Counter(), 0, 0
    stems_bad, stems_good, forms = Counter(), Counter(), defaultdict(set)
    for text, y in zip(texts, toxic, strict=True):
        words = set(_words(text))
        stems = {w[:k] for w in words for k in range(4, min(len(w), 9))}
        (bad if y else good).update(words)
        (stems_bad if y else stems_good).update(stems)
        n_bad, n_good = n_bad + (y == 1), n_good + (y == 0)
        if y:
            for w in words:
                for k in range(4, min(len(w), 9)):
                    forms[w[:k]].add(w)
    if not n_bad or not n_good:
        return []
    least = max(least, math.ceil(share * n_bad))

    def lean(b, g):
        return math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1))

    stems = {s: lean(b, stems_good[s]) for s, b in stems_bad.items() if b >= 2 * least and len(forms[s]) >= 4 and lean(b, stems_good[s]) >= stem_odds}
    # The shortest stem that is not much less pure than its continuations, and the longest of those with the same texts.
    chosen: dict[str, float] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        if not any(s.startswith(t) for t in chosen):
            longer = [t for t in stems if t.startswith(s) and stems_bad[t] >= 0.98 * stems_bad[s]]
            best = max(longer, key=len)
            chosen[best] = stems[best]
    words = {w: lean(b, good[w]) for w, b in bad.items() if b >= least and len(w) > 2 and lean(b, good[w]) >= odds}
    # Stems match without edits: words that one covers stay for their misspellings, after all others.
    covered = {w for w, x in words.items() if any(w.startswith(t) and chosen[t] >= x - 0.5 for t in chosen)}
    ranked = sorted([(w, False, x) for w, x in words.items()] + [(w, True, x) for w, x in chosen.items()], key=lambda t: (not t[1] and t[0] in covered, -t[2], t[0]))
    return [(w, s, min(1.0, x / 6)) for w, s, x in ranked]


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges between paired quotation marks of one line, in order; a mark without a partner quotes nothing."""
    out, opened, closers = [], -1, ""
    for x in _QUOTE.finditer(text):
        c, at = x[0], x.start()
        if c == "\n":
            opened = -1
        elif opened >= 0 and c in closers:
            if c != '"' or not text[at - 1].isspace():
                out.append((opened + 1, at))
                opened = -1
        elif opened < 0 and c in _PAIRS:
            after = text[at + 1 : at + 2]
            if c != '"' or (after and not after.isspace() and not text[at - 1 : at].isalnum()):
                opened, closers = at, _PAIRS[c]
    return out


def _context(words: list[re.Match], i: int, quoted: list[tuple[int, int]]) -> float:
    """What the hit words[i] counts where it stands: 1, less where a reporting word is near, 0.25 if it lies inside quotation marks."""
    near = [w[0] for w in words[max(0, i - WINDOW) : i]] + [w[0] for w in words[i + 1 : i + 1 + WINDOW]]
    k = bisect.bisect_right(quoted, (words[i].start(), math.inf)) - 1
    marked = k >= 0 and words[i].end() <= quoted[k][1]
    reported = not REPORTING.isdisjoint(near)
    return 0.25 if marked and (reported or ADDRESS.isdisjoint(near)) else 0.6 if reported else 1.0


class Scorer:
    def __init__(self, terms, weights=PRIOR, innocent=()):
        self.automaton, self.terms, self.weights, self.memo, self.innocent = TrieAutomaton(terms), terms, np.array(weights), {}, frozenset(innocent)
        self.weight = {t: w for t, _, w in terms}
        stems = [t for t, is_stem, _ in terms if is_stem]
        self.covered = {t for t, is_stem, _ in terms if not is_stem and any(t.startswith(x) for x in stems)}

    def hits(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, term, edits, value) of each hit."""
        text = text.lower()
        memo, found = self.memo, set()
        words = list(_WORD.finditer(text))
        for w in {x[0] for x in words}:
            m = memo.get(w, 0)
            if m == 0:
                m = None if w in self.innocent else self.automaton.match(w.translate(LEET) if not w.isalpha() else w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = m
            if m:
                found.add(w)
        if not found:
            return []
        out, quoted = [], quoted_ranges(text)
        for i, x in enumerate(words):
            if x[0] in found:
                edits, term = memo.get(x[0]) or self.automaton.match(x[0].translate(LEET))
                out.append((x.start(), x.end(), self.terms[term][0], edits, self.terms[term][2] * 0.8**edits * _context(words, i, quoted)))
        return out

    def features(self, text: str) -> list[float]:
        hits = self.hits(text)
        if not hits:
            return [1.0] + [0.0] * (len(PRIOR) - 1)
        sure = [h[4] for h in hits if not h[3] or h[2] not in self.covered]
        count = sum(h[4] / self.weight[h[2]] for h in hits if not h[3] or h[2] not in self.covered)  # a quoted or misspelt one is less than one
        unsure = [h[4] for h in hits if h[3] and h[2] in self.covered]
        total = sum(sure) + sum(unsure)
        return [1.0, max(sure + unsure), math.log1p(sum(sure)), math.log1p(sum(unsure)), min(1.0, 20 * total / (1 + text.count(" "))), min(count, 4) / 2]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float) -> np.ndarray:
    w = prior.copy()

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + pull / 2 * ((w - prior) ** 2).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - prior))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-8:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; a weight that would count a hit against toxicity is zero."""
    prior, free = np.array(PRIOR), np.ones(len(PRIOR), bool)
    while True:
        w = np.zeros(len(prior))
        w[free] = _newton(x[:, free], y, prior[free], pull)
        against = w < 0
        against[0] = False
        if not against.any():
            return w
        free &= ~against


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most so many rows of each class, none of them held out; the bound holds for what the driver gets."""
    ids = labels.filter(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    some = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    short = docs.select("doc_id", F.col("text").alias("text")).filter(F.length("text") <= chars)
    # One pass over the documents; of rows that share an id the one with the least text, so there are no more rows than ids.
    found = short.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = found.select("y", F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect()
    return [(r["text"], r["y"]) for r in sorted(found, key=lambda r: (r["y"], r["h"], r["doc_id"]))]


def innocent_words(texts: list[str], toxic: list[int], automaton: TrieAutomaton, least: int = 4, odds: float = 1.0) -> list[str]:
    """Words near a term that stand in several clean texts and by their smoothed log odds not mainly in toxic ones; copies count once."""
    seen: dict[str, bool] = {}
    near = []
    for text in texts:
        words = set(_words(text))
        for w in words:
            if w not in seen:
                m = automaton.match(w)
                seen[w] = bool(m and m[0])
        near.append({w for w in words if seen[w]})
    some = [i for i, words in enumerate(near) if words]
    once = [some[k] for k in distinct_texts([texts[i] for i in some])]
    bad, good = Counter(w for i in once if toxic[i] for w in near[i]), Counter(w for i in once if not toxic[i] for w in near[i])
    n_bad, n_good = sum(toxic), len(toxic) - sum(toxic)
    lean = {w: math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1)) for w, g in good.items()}
    return sorted(w for w, x in lean.items() if good[w] >= least and x < odds)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list, list[float], list[str]]:
    """Lexicon, weights and innocent words from the labelled rows that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", rows, chars)
    texts, y = [t for t, _ in sample], [v for _, v in sample]
    terms = learn_lexicon(texts, y)
    scorer = Scorer(terms)
    innocent = innocent_words(texts, y, scorer.automaton)
    scorer = Scorer(terms, PRIOR, innocent)
    x = np.array([scorer.features(t) for t in texts]).reshape(-1, len(PRIOR))
    return terms, (fit_weights(x, np.array(y, float)) if terms else np.array(PRIOR)).tolist(), innocent


def _scoring(model, name):
    def run(batches):
        scorer = Scorer(*model)
        for batch in batches:
            scores = scorer.score([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return run


def score_toxicity(docs: DataFrame, model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns keep and text of docs with their score, in a column of that name; no row moves."""
    prepare(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*(k for k in keep if k != name), "text"]))
    return rows.mapInArrow(_scoring(model, name), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` double")
