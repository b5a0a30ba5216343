"""Token ids by the tokenizers library, each different word encoded once.

Where a tokenizer's file shows that no token reaches across white space (see
``splits_at_space``), a text's ids are those of its words in order, and words
that come again are looked up.  Words of ASCII and Latin-1 letters, digits and
signs are cut as the library's splitter cuts them, whole batches at a time, and
go to its model; words with any other character, an apostrophe before a letter
or "<|" go through the whole library.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE_BYTES, utf8

#: Pieces kept per worker in each of two generations; what falls out is encoded again, which changes no result.
MEMO = 200_000
_PLAIN = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")

_LETTER, _DIGIT, _SIGN, _BLANK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _DIGIT, _LETTER, _LETTER
_CLASS[list(SPACE_BYTES)] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased, with a blank between the pieces of each plain word; other words stay as they are."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # Latin-1 letters: C3 80 to C3 BF but for the signs 97 and B7
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    blank = kind == _BLANK
    low = _LOWER[raw]
    upper = lead[(raw[lead + 1] < 0x9F)] + 1
    low[upper] += 32
    border = blank.copy()
    border[at[1:-1][at[1:-1] < len(raw)]] = True
    word = np.cumsum(border)
    odd = kind == _ODD
    follows = np.zeros(len(raw), bool)
    follows[:-1] = (kind[1:] == _LETTER) & (word[1:] == word[:-1])
    odd |= (raw == 39) & follows
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    if odd.any():
        strange = np.zeros(int(word[-1]) + 1, bool)
        strange[word[odd]] = True
        strange = strange[word]
        low = np.where(strange, raw, low)
    else:
        strange = odd
    cut = np.zeros(len(raw), bool)
    cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~blank[1:] & ~blank[:-1] & ~strange[1:] & (word[1:] == word[:-1])
    places = np.flatnonzero(cut)
    return np.insert(low, places, 32), at + np.searchsorted(places, at)

# The parts of a tokenizer file for which words can be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_space(config: dict) -> bool:
    """Whether the file's normaliser and splitter treat white space as nothing but a border."""
    parts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (config.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": SPLIT}
        and parts[0].get("invert")
        and parts[0].get("behavior") == "Removed"
        and not parts[1].get("use_regex")
        and not parts[1].get("add_prefix_space")
        and config["model"].get("end_of_word_suffix") == "</w>"
        and not config["model"].get("dropout")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in config["added_tokens"])
    )


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of a machine are shared out by Spark
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_at_space(json.load(f))
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.whole.get_vocab()
        self.n_ids = max(vocab.values()) + 1
        self.closes = np.zeros(self.n_ids, bool)
        for piece, i in vocab.items():
            self.closes[i] = piece.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _by_model(self, pieces: list[str]) -> list[bytes]:
        """Ids of what the splitter would yield; each piece ends with a closing id."""
        out = []
        for a in range(0, len(pieces), 4000):
            some = pieces[a : a + 4000]
            ids = np.array(self.model.encode(some, is_pretokenized=True, add_special_tokens=False).ids, np.uint32)
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(some) or (len(ids) and ends[-1] != 4 * len(ids)):
                out += self._by_library(some)
            else:
                data = ids.tobytes()
                ends = ends.tolist()
                out += [data[b:e] for b, e in zip([0, *ends], ends, strict=False)]
        return out

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch(words, add_special_tokens=False)]

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        plain, other = [], []
        for w in words:
            if w not in young:
                x = old.get(w)
                if x is not None:
                    young[w] = x
                elif _PLAIN.fullmatch(w):
                    plain.append(w)
                else:
                    other.append(w)
        young.update(zip(plain, self._by_model(plain), strict=True))
        young.update(zip(other, self._by_library(other), strict=True))
        return [young[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's begin (and the last's end)."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not self.by_words:
            lists = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        raw, at = utf8(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        data, at = cut_words(raw, at)
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)))
        coded = split.flatten().dictionary_encode()
        found = self._look_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(found), np.uint32)
        which = np.asarray(coded.indices)
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = np.asarray(split.offsets).astype(np.int64)
        return ids, ends[offsets - offsets[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
