"""Byte-level code against plain definitions, on arbitrary texts."""

import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_simhash import brute
from tokenizers import Tokenizer

from glyphledger.llm import decontaminate, exact_dedup, quality, sentencepiece_codec, simhash, word_encoder
from glyphledger.llm.common import utf8

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ENCODER, LIBRARY = word_encoder.WordEncoder(WORD), Tokenizer.from_file(WORD)
CODEC, PROCESSOR = sentencepiece_codec.Codec(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)

piece = st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), st.sampled_from([" ", "\n", "  ", "'s", "É", "ÿ", "Word", "9", "!", "<|endoftext|>", "▁", "\x00", "\x85", "İ", "ß"]))
texts = st.lists(st.one_of(st.none(), st.lists(piece, max_size=12).map("".join)), max_size=6)
many = settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])


@many
@given(texts)
def test_word_encoder(rows):
    ids, at = ENCODER.encode(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids


@many
@given(texts)
def test_sentencepiece(rows):
    ids, at, parity, trip = CODEC.encode(*utf8(pa.array(rows, pa.string())))
    for i, t in enumerate(rows):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == PROCESSOR.encode(t or "")
        assert (CODEC.whole.decode(own) == (t or "")) == trip[i]
    assert parity.all()


@many
@given(texts)
def test_fingerprints_lines_words(rows):
    raw, at = utf8(pa.array(rows, pa.string()))
    assert simhash.fingerprints(raw, at).tolist() == [brute(t) for t in rows]
    s, e, f = quality.lines_of(raw, at)
    assert [[bytes(raw[s[k] : e[k]]).decode() for k in range(f[i], f[i + 1])] for i in range(len(rows))] == [(t or "").split("\n") for t in rows]
    low, starts, ends, bounds = decontaminate.words_of(raw, at)
    import re

    for i, t in enumerate(rows):
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        assert [bytes(low[starts[k] : ends[k]]).decode() for k in range(bounds[i], bounds[i + 1])] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    if rows:
        found = list(exact_dedup._chunk_block(raw, at, 3, 16))
        assert [n for n, *_ in found] == [len(t or "") for t in rows]
        assert [sum(x[3]) for x in found] == [len(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()) for t in rows]
