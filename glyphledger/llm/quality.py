"""Document quality from a linear-chain conditional random field over lines.

Every line of a text (split at line feeds) has features of its own bytes and of
its neighbours': shares of letters, capitals, digits, signs and pipes, lengths,
words repeated at once or within the line, lines said before.  A chain over two
states, good and bad, gives each line's marginal probability by the forward-
backward algorithm; their mean, weighted by the lines' lengths, is the document's
quality, whose log odds a logistic map of two numbers, learned from the labels,
turns into a score.

The labels are of documents.  The fit begins with each line labelled as its
document, then relabels the lines of bad documents by their marginals (the worst
line of a bad document stays bad) and fits again.  It reads at most SAMPLE_ROWS
labelled rows of each class, of at most SAMPLE_CHARS characters, none of them
held out; a hash of the id decides which.  Scoring reads every line of every
text, in a stream; nothing is shuffled.

Null and empty texts are one empty line.  Repeated rows each get their score.
A column named score gives way to the result's; other columns are ignored.
Without labels of both classes every score is a half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, prepare, utf8
from .toxicity import labelled_sample

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 20_000
ROUNDS = 3
STEPS = 80
BLOCK = 1 << 20

_UPPER, _LOWER, _DIGIT, _SPACE, _END, _PIPE, _SHOUT, _SIGN, _HIGH = range(9)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _END
_CLASS[ord("|")], _CLASS[ord("!")] = _PIPE, _SHOUT
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_OWN = 18


def lines_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines, and the first line of each row and one more."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    first = np.arange(len(at) - 1) + np.searchsorted(breaks, at[:-1])
    # A break that is its row's last byte opens an empty line at the next row's start, before that row's own.
    first = np.append(first, len(starts))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = at[1:]
    return starts, np.maximum(ends, starts), first


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, with those of its neighbours; lengths; first line of each row and one more."""
    starts, ends, first = lines_of(raw, at)
    n = len(starts)
    length = (ends - starts).astype(np.float64)
    kind = _CLASS[raw]
    line_of = np.repeat(np.arange(n), ends - starts)
    inside = np.ones(len(raw), bool)
    inside[raw == 10] = False
    codes = kind[inside]
    counts = np.bincount(line_of * 9 + codes, minlength=9 * n).reshape(n, 9).astype(np.float64) if n else np.zeros((0, 9))
    share = counts / np.maximum(length, 1)[:, None]

    low = raw[inside]
    word = (codes != _SPACE) & (codes != _PIPE)
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1] & (line_of[1:] == line_of[:-1])
    opens = word & ~before
    number = np.cumsum(opens) - 1
    letters = word & (codes <= _LOWER) | (codes == _DIGIT) | (codes == _HIGH)
    h = np.zeros(int(opens.sum()), np.uint64)
    if len(h):
        place = np.arange(len(low)) - np.flatnonzero(opens)[np.maximum(number, 0)]
        folded = np.where((low >= 65) & (low <= 90), low + 32, low)
        value = _MIX[folded] * (2 * (place.astype(np.uint64) & np.uint64(63)) + np.uint64(1))
        at_words = np.flatnonzero(opens)
        h = np.add.reduceat(np.where(letters, value, np.uint64(0)), at_words)
    word_line = line_of[opens]
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    again = np.bincount(word_line[same], minlength=n)
    order = np.lexsort((h, word_line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])
    distinct = np.bincount(word_line[order][fresh], minlength=n)
    total = np.zeros(n, np.uint64)
    if len(h):
        np.add.at(total, word_line, h * (np.arange(len(h), dtype=np.uint64) - np.searchsorted(word_line, word_line).astype(np.uint64) + np.uint64(1)))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by = np.lexsort((np.arange(n), total, row))
    said = np.zeros(n, bool)
    said[by[1:]] = (total[by][1:] == total[by][:-1]) & (row[by][1:] == row[by][:-1]) & (words[by][1:] > 0)
    signs = share[:, [_PIPE, _SHOUT, _SIGN]].sum(axis=1)
    own = np.column_stack([
        share[:, _UPPER] * 3, share[:, _DIGIT] * 5, share[:, _SPACE] * 3, share[:, _END] * 5, share[:, _PIPE] * 10, share[:, _SHOUT] * 10, share[:, _SIGN] * 10, share[:, _HIGH],
        np.log1p(length) / 5, np.minimum(length / np.maximum(words, 1), 40) / 10, again / np.maximum(words, 1) * 3, distinct / np.maximum(words, 1),
        said, length == 0, share[:, _UPPER] > 0.3, signs > 0.04, again > 0.3 * words, words < 3,
    ]).astype(np.float64)
    left, right = np.zeros_like(own), np.zeros_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    begins, closes = np.zeros(n, bool), np.zeros(n, bool)
    begins[first[:-1]] = True
    closes[first[1:] - 1] = True
    left[begins], right[closes] = 0, 0
    return np.column_stack([np.ones(n), own, left, right, begins, closes]), length + 1, first


class Chain:
    """Two states; scores are log odds of good against bad, transitions relative to bad-bad."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # moves: bad to good, good to bad, good to good

    @staticmethod
    def _forward(r, m):
        return np.logaddexp(r + m[2], m[0]) - np.logaddexp(r + m[1], 0.0)

    @staticmethod
    def _backward(x, m):
        return np.logaddexp(x + m[2], m[1]) - np.logaddexp(x + m[0], 0.0)

    def messages(self, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of every line; rows of like length go together, long ones alone."""
        ahead, back = emit.copy(), np.zeros_like(emit)
        size = np.diff(first)
        many = np.flatnonzero(size <= 256)
        many = many[np.argsort(-size[many], kind="stable")]
        longest = int(size[many].max(initial=0))
        begin = first[:-1][many]
        sizes = size[many]
        for t in range(1, longest):
            k = int(np.searchsorted(-sizes, -t, "left"))  # rows longer than t
            ahead[begin[:k] + t] += self._forward(ahead[begin[:k] + t - 1], self.moves)
        for t in range(longest - 2, -1, -1):
            k = int(np.searchsorted(-sizes, -(t + 1), "left"))
            nxt = begin[:k] + t + 1
            back[nxt - 1] = self._backward(emit[nxt] + back[nxt], self.moves)
        e0, e1, e2 = (math.exp(x) for x in self.moves)
        for i in np.flatnonzero(size > 256).tolist():
            a, b = int(first[i]), int(first[i + 1])
            e = emit[a:b].tolist()
            r, out = e[0], [e[0]]
            for x in e[1:]:
                y = math.exp(min(50.0, max(-50.0, r)))
                r = x + math.log((y * e2 + e0) / (y * e1 + 1.0))
                out.append(r)
            s, rev = 0.0, [0.0]
            for x in e[:0:-1]:
                y = math.exp(min(50.0, max(-50.0, x + s)))
                s = math.log((y * e2 + e1) / (y * e0 + 1.0))
                rev.append(s)
            ahead[a:b], back[a:b] = out, rev[::-1]
        return ahead, back

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        ahead, back = self.messages(x @ self.weights, first)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))


def fit_chain(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, chain: Chain | None = None, steps: int = STEPS, pull: float = 1e-4) -> Chain:
    """Conditional likelihood by Adam over all rows at once; weight is a row's."""
    chain = chain or Chain(np.zeros(x.shape[1]), np.zeros(3))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    w = weight[row] / weight[row].sum()
    inner = np.ones(len(row), bool)
    inner[first[1:] - 1] = False
    left = np.flatnonzero(inner)
    theta = np.concatenate([chain.weights, chain.moves])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        now = Chain(theta[:-3], theta[-3:])
        emit = x @ now.weights
        ahead, back = now.messages(emit, first)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))
        nxt = emit[left + 1] + back[left + 1]
        pairs = np.stack([np.zeros(len(left)), now.moves[0] + nxt, ahead[left] + now.moves[1], ahead[left] + now.moves[2] + nxt])
        pairs = np.exp(pairs - pairs.max(axis=0))
        pairs /= pairs.sum(axis=0)
        seen = np.stack([(1 - y[left]) * y[left + 1], y[left] * (1 - y[left + 1]), y[left] * y[left + 1]])
        grad = np.concatenate([x.T @ (w * (p - y)), ((pairs[1:] - seen) * w[left]).sum(axis=1)]) + pull * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:-3], theta[-3:])


def _summary(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row: one, and the log odds of the mean marginal of its lines, weighted by their lengths."""
    mean = np.clip(np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1]), 1e-4, 1 - 1e-4)
    return np.column_stack([np.ones(len(mean)), np.log(mean / (1 - mean))])


class Quality:
    def __init__(self, chain: Chain, link: np.ndarray):
        self.chain, self.link = chain, link

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, size, first = line_features(raw, at)
        s = _summary(self.chain.marginals(x, first), size, first) @ self.link
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fit(texts: list[str], good: list[int], share: float | None = None) -> Quality:
    """share: the share of good rows that scores are to reflect; else that of the texts."""
    raw, at = utf8(pa.array(texts, pa.large_string()))
    y = np.array(good, float)
    if not len(y) or y.min() == y.max():
        return Quality(Chain(np.zeros(3 * _OWN + 3), np.zeros(3)), np.zeros(2))
    parts = [line_features(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, BLOCK)]
    x, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    row = np.repeat(np.arange(len(y)), np.diff(first))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    labels, chain = y[row].copy(), None
    for k in range(ROUNDS):
        chain = fit_chain(x, first, labels, weight, chain, STEPS if not k else STEPS // 2)
        p = chain.marginals(x, first)
        worst = np.minimum.reduceat(p, first[:-1])
        labels = np.where(y[row] == 1, 1.0, np.where(p <= worst[row], 0.0, (p > 0.5).astype(float)))
    z = _summary(p, size, first)
    share = y.mean() if share is None else share
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    link = np.array([0.0, 1.0])
    prior = link.copy()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ link, -40, 40)))
        step = np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.eye(2), z.T @ (w * (y - q)) - (link - prior))
        link = link + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-7:
            break
    return Quality(chain, link)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Quality:
    from pyspark.sql import functions as F

    from .common import held_out

    seen = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg("quality")).first()[0]
    sample = labelled_sample(docs, labels, "quality", rows, chars)
    return fit([t or "" for t, _ in sample], [v for _, v in sample], seen)


def _scoring(model: Quality):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
            parts = [model.score(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, BLOCK)]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            scores = pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), scores], names=[*(batch.schema.names[i] for i in keep), "score"])

    return run


def score_quality(docs: DataFrame, model: Quality, keep: list[str]) -> DataFrame:
    """The columns keep (not text) of docs with score."""
    prepare(docs.sparkSession)
    keep = [k for k in keep if k not in ("text", "score")]
    rows = docs.select(*keep, "text")
    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in keep)
    return rows.mapInArrow(_scoring(model), f"{kinds}score double")
