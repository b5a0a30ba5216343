"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field; from it come the normaliser, the
marker for blanks, unigram scores (or, for BPE models, merges in the order of
scores) and byte fallback of an equal tokenizers pipeline.

The ids are those of that pipeline, and its decoder reads them back.  Beside it
the sentencepiece library encodes the same text; where the two differ, parity is
false.

Where no piece has a marker after another character, a text's ids are those of
its segments (a run of blanks and what follows it; line feeds too begin one if
no piece spans them), whatever the text: its segments are cut by the byte, each
different one of a block is looked up, and those that are new to the worker are
encoded, compared and decoded in multithreaded batches.  Segments of more than
MEMO_CHARS are not remembered and beyond MEMO all are forgotten, so what a
worker holds is bounded.  Other models take whole texts.

Null texts are empty and have no ids; nothing is shuffled; repeated rows each
get theirs.  Columns of keep that have a name of the result's give way to it.
"""

from __future__ import annotations

import os
import struct
from itertools import chain
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, prepare, utf8

MARK = "▁"
MEMO, MEMO_CHARS = 300_000, 64
BLOCK = 2 << 20
THREADS = 2
# Piece kinds and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; nested messages and strings are bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for n, v in fields(data):
            if n == 1:
                x = dict(fields(v))
                self.pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif n == 2:
                trainer |= dict(fields(v))
            elif n == 3:
                normalizer |= dict(fields(v))
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = normalizer.get(2, b"")
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))

    def spans(self, border: str) -> bool:
        """Whether a piece has border after another character."""
        return any(border in p.lstrip(border) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces by the score of what they make, best first."""
        known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for p, score, kind in self.pieces:
            if kind == NORMAL:
                found += [(-score, known[p[:k]], known[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        return [(a, b) for *_, a, b in sorted(found)]

    def backend(self, whole: bool):
        """The tokenizers pipeline; without whole, for segments that are normalised already."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.type == UNIGRAM:
            made = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk, byte_fallback=self.byte_fallback))
        elif self.type == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            made = Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError("only unigram and BPE models can be encoded")
        users = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if users:
            made.add_tokens(users)
        if whole:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if self.squeeze else []
            steps += [normalizers.Prepend(MARK)] if self.prefix else []
            steps += [normalizers.Replace(" ", MARK)] if self.escape else []
            made.normalizer = normalizers.Sequence(steps)
        strip = [decoders.Strip(" ", 1, 0)] if self.prefix and whole else []
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return made

    def reference(self, prefix: bool):
        """The sentencepiece library's processor; without prefix it adds no marker before a text."""
        import sentencepiece

        # A later message of the same field is merged into the earlier one: field 3 (normaliser), its field 3 set to false.
        return sentencepiece.SentencePieceProcessor(model_proto=self.data if prefix else self.data + bytes([0x1A, 2, 0x18, 0]))


class _Coded(NamedTuple):
    """Ids of texts one after another, where each text's begin and the last's end, and what was found of each."""

    ids: np.ndarray
    at: np.ndarray
    parity: np.ndarray
    trip: np.ndarray


class Codec:
    def __init__(self, path: str):
        # Read when a batch is encoded: the library then uses that many threads.
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            self.model = Model(f.read())
        m = self.model
        self.whole, self.part = m.backend(True), m.backend(False)
        self.reference, self.reference_part = m.reference(True), m.reference(False)
        self.by_segments = m.prefix and m.escape and not m.squeeze and not m.charsmap and not m.spans(MARK) and not any(kind == USER for *_, kind in m.pieces)
        self.at_lines = not any("\n" in p and len(p) > 1 for p, _, kind in m.pieces if kind == NORMAL)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.coded = _Coded(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool))

    def _checked(self, tokenizer, reference, texts: list[str], marked: list[str] | None = None) -> _Coded:
        """Of each text: its ids, whether the sentencepiece library's are the same, and whether they decode to the text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        own = [e.ids for e in tokenizer.encode_batch_fast(marked or texts, add_special_tokens=False)]
        other, back = reference.encode(texts, num_threads=1), tokenizer.decode_batch(own, skip_special_tokens=True)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
        ids = np.fromiter(chain.from_iterable(own), np.int32, int(at[-1]))
        alike = lambda a, b: np.ones(len(a), bool) if a == b else np.fromiter(map(eq, a, b), bool, len(a))
        return _Coded(ids, at, alike(own, other), alike(back, texts))

    def _cut(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The segments of all rows, a blank before each row that is not empty, and where each row's begin and the last's end."""
        full = at[1:] > at[:-1]
        text = np.insert(raw, at[:-1][full], 32)
        at = at + np.concatenate([[0], np.cumsum(full)])
        blank = text == 32
        mark = np.flatnonzero((text[:-2] == 0xE2) & (text[1:-1] == 0x96) & (text[2:] == 0x81))  # a marker in a text is a blank to the model
        blank[(mark[:, None] + np.arange(3)).reshape(-1)] = True
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[at[:-1][full]] = True
        if self.at_lines:
            begins |= text == 10
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(text)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())), np.searchsorted(starts, at)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (and the last's end), and of each text whether both libraries agree and whether it decodes to itself."""
        if not self.by_segments:
            data = raw.tobytes()
            found = self._checked(self.whole, self.reference, [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            return found.ids, found.at, found.parity, found.trip
        cut, row_at = self._cut(raw, at)
        coded = cut.dictionary_encode()
        which = self._looked_up(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        begin = self.coded.at[which]
        n = self.coded.at[which + 1] - begin
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.coded.ids[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]

        def throughout(sound):
            wrong = np.concatenate([[0], np.cumsum(~sound[which])])
            return wrong[row_at[1:]] == wrong[row_at[:-1]]

        return ids, ends[row_at], throughout(self.coded.parity), throughout(self.coded.trip)

    def _looked_up(self, segments: list[str]) -> np.ndarray:
        """Where in coded each segment stands; what is new goes there, and short ones are remembered."""
        get = self.memo.get
        place = np.fromiter((get(s, -1) for s in segments), np.int64, len(segments))
        if len(self.coded.at) + int((place < 0).sum()) > MEMO:
            self._forget()
            place[:] = -1
        new = np.flatnonzero(place < 0)
        if len(new):
            texts, had = [segments[i] for i in new.tolist()], self.coded
            fresh = self._checked(self.part, self.reference_part, texts, [s.replace(" ", MARK) for s in texts])
            first = len(had.at) - 1
            place[new] = first + np.arange(len(new))
            self.coded = _Coded(*(np.concatenate(x) for x in ((had.ids, fresh.ids), (had.at, fresh.at[1:] + had.at[-1]), (had.parity, fresh.parity), (had.trip, fresh.trip))))
            self.memo.update((s, k) for k, s in enumerate(texts, first) if len(s) <= MEMO_CHARS)
        return place


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_ADDED = ("ids", "n_tokens", "parity", "round_trip")


def _encoding(path: str, keep: list[str]):
    def run(batches):
        own = codec(path)
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731,B023
            raw, at = utf8(col("text"))
            none = (np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool))
            parts = [own.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, BLOCK)] or [none]
            ids, bounds, parity, trip = zip(*parts, strict=True)
            sizes = np.concatenate([np.diff(x) for x in bounds])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            added = [lists, pa.array(sizes), pa.array(np.concatenate(parity)), pa.array(np.concatenate(trip))]
            yield pa.RecordBatch.from_arrays([*(col(n) for n in keep), *added], names=[*keep, *_ADDED])

    return run


def encode_sentencepiece(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs with ids, n_tokens, parity and round_trip."""
    prepare(docs.sparkSession)
    keep = [k for k in keep if k not in _ADDED]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in keep)
    return rows.mapInArrow(_encoding(path, keep), f"{kinds}ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def _decoding(path: str, keep: list[str]):
    def run(batches):
        own = codec(path)
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731,B023
            texts = own.whole.decode_batch([x or [] for x in col("ids").to_pylist()], skip_special_tokens=True)
            yield pa.RecordBatch.from_arrays([*(col(n) for n in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def decode_sentencepiece(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns keep of encoded with the text of its ids; null ids are none."""
    prepare(encoded.sparkSession)
    rows = encoded.select(*dict.fromkeys([*keep, "ids"]))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)
    return rows.mapInArrow(_decoding(path, keep), f"{kinds}, text string")
