"""Benchmark decontamination with an FM-index per training shard.

A shard is the words of a run of documents, at most SHARD_BYTES of text (a
longer document is a shard of its own), each document closed by a separator.
Words become symbols, ranked by a 64-bit hash of their bytes.  The shard's
suffix array comes from prefix doubling that sorts again only what is still
tied; its last column goes into a wavelet matrix, whose ranks drive backward
search for all test windows at once, symbol by symbol from their ends.  Matches
are located by walking to sampled suffix positions, confirmed against the bytes
of the words, and merged to spans that the operator returns.

Windows are ``size`` consecutive words of an item; an item of fewer words, but
not none, is one window.  Texts have their letters A-Z lower-cased; words are
runs of digits, letters a-z and characters beyond ASCII.  Null texts have no
words, null items no windows.  Items repeated under one id count once, equal
texts under two ids count as two.  Repeated documents each get their row.

Documents are not shuffled.  The test windows are packed in Spark tasks into
blocks: the different words of some items, the items' words as numbers, where
the different windows begin, and which items have them.  A block takes at most
PACKED_BYTES, counted as it is sent; a longer item is cut into pieces that
overlap.  One block is broadcast at a time.  If there are several, each goes
over the documents after the other and adds to their spans, between them the
documents are a table in the shared folder, and a block's broadcast ends with
its pass: neither the driver nor a worker holds more than one.  Empty tables
give empty results or, without items, clean documents.  Columns of keep that
have a name of the result's give way to it.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, prepare, utf8

WINDOW = 10
SHARD_BYTES = 3 << 20
SAMPLE = 32
PACKED_BYTES = 64 << 20
#: Text that makes about one block, by which items are dealt to tasks that pack them.
ITEM_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of the words in them; index of the first word of each row, and one more."""
    low = _LOWER[raw]
    inside = _IS_WORD[low]
    before = np.zeros(len(low) + 1, bool)
    before[1:] = inside
    first = inside & ~before[:-1]
    first[at[:-1][at[:-1] < len(low)]] |= inside[at[:-1][at[:-1] < len(low)]]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each word, by its bytes and their places in it; never zero."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    out = length.astype(np.uint64) * _STEP
    # Byte k of all words that have one; word lengths fall off quickly, what remains is summed at once.
    rest, k = np.arange(len(starts)), 0
    while len(rest) and k < 24:
        h = out[rest] ^ _BYTE[low[starts[rest] + k]]
        h *= _STEP
        out[rest] = h ^ (h >> np.uint64(29))
        k += 1
        rest = rest[length[rest] > k]
    for i in rest.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return (out >> np.uint64(1)) | np.uint64(1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 0 by prefix doubling; a suffix that ends is smaller than what continues it."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank[order] = group
    k = 1
    tied = ~(begins & np.concatenate([begins[1:], [True]]))
    places = np.flatnonzero(tied)
    while len(places):
        pos = order[places]
        ahead = pos + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[pos] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[places] = pos
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        alone = new & np.concatenate([new[1:], [True]])
        places = places[~alone]
        k *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit plane per bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            ones = ((values >> b) & 1).astype(bool)
            plane = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=plane[1:])
            self.planes.append(plane)
            self.zeros.append(int(len(values) - plane[-1]))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = plane[low], plane[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            before = plane[at]
            one = plane[at + 1] > before
            out = out * 2 + one
            at = np.where(one, zeros + before, at - before)
        return out


class FMIndex:
    """Over words (hashes), closed by a separator after each of the rows that bounds delimits."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        rows = len(bounds) - 1
        self.n_words, self.bounds = len(hashes), bounds
        self.place = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(bounds))
        self.known, coded = np.unique(hashes, return_inverse=True)
        text = np.ones(len(hashes) + rows + 1, np.int64)  # 1: the separator; 0: the end, once
        text[self.place] = coded + 2
        text[-1] = 0
        self.n = len(text)
        order = suffix_array(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.known) + 2))])
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(len(self.known) + 1).bit_length()))
        marked = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]
        self.word_of = np.full(self.n, -1, np.int64)
        self.word_of[self.place] = np.arange(len(hashes))

    def search(self, hashes: np.ndarray, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern: so many of numbers from each start, which stand for hashes."""
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.known) or not len(numbers):
            return low, high
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        lacking = np.concatenate([[0], np.cumsum((self.known[at] != hashes)[numbers])])
        live = np.flatnonzero((lacking[starts + lengths] == lacking[starts]) & (lengths > 0))
        high[live] = self.n
        for back in range(int(lengths.max(initial=0))):
            here = live[lengths[live] > back]
            symbol = at[numbers[starts[here] + lengths[here] - 1 - back]] + 2
            low[here] = self.first[symbol] + self.wavelet.rank(symbol, low[here])
            high[here] = self.first[symbol] + self.wavelet.rank(symbol, high[here])
            live = live[(high[live] > low[live])]
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Words at which the suffixes begin."""
        out, at, steps = np.zeros(len(suffixes), np.int64), suffixes.copy(), np.zeros(len(suffixes), np.int64)
        todo = np.arange(len(suffixes))
        while len(todo):
            here = at[todo]
            found = self.marks[here + 1] > self.marks[here]
            out[todo[found]] = self.samples[self.marks[here[found]]] + steps[todo[found]]
            todo, here = todo[~found], here[~found]
            symbol = self.wavelet.access(here)
            at[todo] = self.first[symbol] + self.wavelet.rank(symbol, here)
            steps[todo] += 1
        return self.word_of[out % self.n]


@dataclass
class Windows:
    """A block of test windows; see the module's text."""

    hashes: np.ndarray  # of each different word
    word_at: np.ndarray  # where its bytes begin in words, and the end
    words: np.ndarray
    numbers: np.ndarray  # the items' words, one item after another
    starts: np.ndarray  # in numbers, of each different window
    lengths: np.ndarray
    owner_at: np.ndarray  # where its items begin in owners, and the end
    owners: np.ndarray
    items: list[str]

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.word_at, self.words, self.numbers, self.starts, self.lengths, self.owner_at, self.owners)) + sum(map(len, self.items))


def _same_bytes(low: np.ndarray, a: np.ndarray, a_end: np.ndarray, other: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether low[a:a_end] are the bytes other[b:b_end], for each of many ranges."""
    size = a_end - a
    same = size == b_end - b
    a, b, n = a[same], b[same], size[same]
    upto = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(upto, n)
    equal = low[np.repeat(a, n) + step] == other[np.repeat(b, n) + step]
    wrong = np.concatenate([[0], np.cumsum(~equal)])
    same[np.flatnonzero(same)] = wrong[upto + n] == wrong[upto]
    return same


def _numbered(low, starts, ends):
    """Different words' hashes (sorted) and first places, and the number of each word; words are told apart by their bytes, not by hashes alone."""
    hashes = hash_words(low, starts, ends)
    known, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    if len(hashes) and not _same_bytes(low, starts, ends, low, starts[first][numbers], ends[first][numbers]).all():
        raise ValueError("two words of one block have one hash")  # 63 bits: about one chance in 10^6 for a billion different words
    return known, first, numbers


def windows_of(items: list[tuple[str, str]], size: int = WINDOW) -> Windows:
    """Packs (item, text) rows: all steps are over whole arrays."""
    names = sorted({i for i, _ in items})
    code = {n: k for k, n in enumerate(names)}
    raw, at = utf8(pa.array([t or "" for _, t in items], pa.large_string()))
    low, starts, ends, bounds = words_of(raw, at)
    known, first, numbers = _numbered(low, starts, ends)
    n_words = np.diff(bounds)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    row = np.repeat(np.arange(len(items)), n)
    begin = bounds[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(n_words[row], size)
    # Equal windows are neighbours after sorting by their words' numbers, column by column; what a shorter one lacks is -1.
    order = np.arange(len(begin))
    column = lambda k: np.where(k < length, numbers[np.minimum(begin + k, max(0, len(numbers) - 1))], -1)
    for k in range(size - 1, -1, -1):
        order = order[np.argsort(column(k)[order], kind="stable")]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in range(size):
        c = column(k)[order]
        fresh[1:] |= c[1:] != c[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    pairs = np.unique(np.column_stack([which, np.array([code[i] for i, _ in items], np.int64)[row]]), axis=0) if len(order) else np.zeros((0, 2), np.int64)
    one = order[fresh]
    word_size = (ends - starts)[first]
    word_at = np.concatenate([[0], np.cumsum(word_size)])
    words = low[np.repeat(starts[first] - word_at[:-1], word_size) + np.arange(word_at[-1])]
    small = lambda x: x.astype(np.int32)
    return Windows(known, word_at, words, small(numbers), small(begin[one]), length[one].astype(np.int8), small(np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))), small(pairs[:, 1]), names)


def _shard(raw, at, tests: Windows):
    """(n_words, n_hit, spans, items) of each row; spans are pairs of word numbers, merged."""
    low, starts, ends, bounds = words_of(raw, at)
    n_words = np.diff(bounds)
    out = [(int(n), 0, [], []) for n in n_words]
    if not len(starts) or not len(tests.starts):
        return out
    hashes = hash_words(low, starts, ends)
    index = FMIndex(hashes, bounds)
    begins, lengths = tests.starts.astype(np.int64), tests.lengths.astype(np.int64)
    a, b = index.search(tests.hashes, tests.numbers, begins, lengths)
    count = b - a
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return out
    found = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + a[which])
    sound = _confirmed(low, starts, ends, tests, which, found, begins, lengths)
    which, found = which[sound], found[sound]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    row_of = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
    # Spans end where the hits do, and at the ends of rows.
    edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (row_of[1:] != row_of[:-1]), [True]])
    runs = np.flatnonzero(edge)
    runs = np.column_stack([runs[:-1], runs[1:]])[hit[runs[:-1]]]
    rows, first = np.unique(row_of[runs[:, 0]], return_index=True)
    rows, base, spans = rows.tolist(), bounds.tolist(), runs.tolist()
    pairs = np.unique(np.column_stack([row_of[found], which]), axis=0)
    n = (tests.owner_at[1:] - tests.owner_at[:-1]).astype(np.int64)[pairs[:, 1]]
    owner = tests.owners[np.repeat(tests.owner_at[pairs[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    owned = np.unique(np.column_stack([np.repeat(pairs[:, 0], n), owner]), axis=0)
    cut = np.searchsorted(owned[:, 0], rows).tolist() + [len(owned)]
    first = [*first.tolist(), len(spans)]
    for k, r in enumerate(rows):
        own = [[s - base[r], e - base[r]] for s, e in spans[first[k] : first[k + 1]]]
        out[r] = (int(n_words[r]), sum(e - s for s, e in own), own, sorted({tests.items[i] for i in owned[cut[k] : cut[k + 1], 1].tolist()}))
    return out


def _confirmed(low, starts, ends, tests: Windows, which, found, begins, lengths) -> np.ndarray:
    """Whether the bytes of the words at each occurrence are those of the window: each word that is hit is compared with the test's word of its hash."""
    n = lengths[which]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    here, there = np.repeat(found, n) + step, tests.numbers[np.repeat(begins[which], n) + step].astype(np.int64)
    places, first = np.unique(here, return_index=True)  # one word has one hash, and one hash one word of the tests
    same = np.ones(len(starts), bool)
    same[places] = _same_bytes(low, starts[places], ends[places], tests.words, tests.word_at[there[first]], tests.word_at[there[first] + 1])
    wrong = np.concatenate([[0], np.cumsum(~same[here])])
    upto = np.cumsum(n)
    return wrong[upto] == wrong[upto - n]


RESULT = "n_words long, n_hit long, spans array<array<long>>, items array<string>"
_ADDED = ("n_words", "n_hit", "spans", "items")


def _union(spans: list, more: list) -> list:
    merged: list[list[int]] = []
    for s, e in sorted([*spans, *more]):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _finder(shared, names: list[str], again: bool):
    """names: the columns to hand on; again: there are spans and items of earlier blocks to add to."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]

    def run(batches):
        tests = pickle.loads(shared.value) if shared else windows_of([])
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731,B023
            raw, at = utf8(col("text"))
            rows = []
            for i, j in blocks(at, SHARD_BYTES):
                rows += _shard(raw[at[i] : at[j]], at[i : j + 1] - at[i], tests)
            if again:
                before = zip(rows, col("spans").to_pylist(), col("items").to_pylist(), strict=True)
                rows = [(n, 0, _union(s, old), sorted({*i, *had})) for (n, _, s, i), old, had in before]
                rows = [(n, sum(e - b for b, e in s), s, i) for n, _, s, i in rows]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(col(n) for n in names), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*names, *_ADDED])

    return run


def _pieces(item: str, text: str, most: int, size: int):
    """An item, cut into overlapping pieces if it is longer than a block; pieces keep every window whole."""
    if len(text) <= most:
        yield item, text
        return
    raw, at = utf8(pa.array([text], pa.large_string()))
    low, starts, ends, _ = words_of(raw, at)
    if len(starts) <= size:
        yield item, text
        return
    a = 0
    while True:
        b = max(int(np.searchsorted(ends, starts[a] + most, "right")), a + size)
        yield item, low[starts[a] : ends[min(b, len(ends)) - 1]].tobytes().decode("utf-8")
        if b >= len(starts):
            return
        a = b - size + 1


def _packer(size: int, most: int):
    """Rows (block, item, text), sorted by block, into packed blocks of at most that size."""

    def packed(items):
        made = windows_of(items, size)
        if made.size > most and len(items) > 1:
            half = len(items) // 2
            return packed(items[:half]) + packed(items[half:])
        return [pickle.dumps(made)]

    def run(batches):
        held, chars, now = [], 0, None
        for batch in batches:
            for block, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for piece in _pieces(item, text, most // 8, size):
                    if held and (block != now or chars > most // 2):
                        for blob in packed(held):
                            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["block"])
                        held, chars = [], 0
                    now = block
                    held.append(piece)
                    chars += len(piece[1])
        for blob in packed(held) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["block"])

    return run


def pack_windows(benchmark: DataFrame, size: int = WINDOW, packed_bytes: int = PACKED_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(block): the benchmark's windows; how many blocks there are depends on its text, not on how its rows are dealt."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).filter(F.col("i").isNotNull() | (F.col("t") != ""))
    rows = rows.select(F.coalesce("i", F.lit("")).alias("i"), "t").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    dealt = rows.select(F.pmod(F.xxhash64("i", "t"), F.lit(total // item_bytes + 1)).alias("block"), "i", "t")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_packer(size, packed_bytes), "block binary")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW, packed_bytes: int = PACKED_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The columns keep of docs with n_words, n_hit, spans (of word numbers, merged) and items (sorted as strings)."""
    spark = prepare(docs.sparkSession)
    keep = [k for k in keep if k not in _ADDED]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in rows.columns}
    packed = materialize(pack_windows(benchmark, size, packed_bytes, item_bytes), "windows")
    n, k, shared = packed.count(), 0, None
    schema = lambda names: ", ".join([*(f"`{n}` {kinds[n]}" for n in names), RESULT])
    for k, r in enumerate(packed.toLocalIterator()):
        shared = spark.sparkContext.broadcast(bytes(r["block"]))
        if k + 1 == n:
            break
        rows = materialize(rows.mapInArrow(_finder(shared, list(kinds), k > 0), schema(kinds)), "pass")
        shared.destroy()
    return rows.mapInArrow(_finder(shared, keep, k > 0), schema(keep))
