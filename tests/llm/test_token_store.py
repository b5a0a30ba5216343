import shutil
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glyphledger.llm import token_store as S
from glyphledger.llm.word_encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "   ", "Hello, World! it's we'll ÉCOLE Straße über-maß", "á b c d ﬁ İstanbul ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "漢字 かな 1234 5.6e7 '' 's 't",
    "tabs\tand\x0bvertical\x0cfeeds\r\n", "ﬀ ß ẞ ǅ ŉ", "\x85nel\x1c", "don't! ... !!! --- a.b.c", "école", "z" * 300, "word " * 30_000, " ".join(f"w{i}x" for i in range(20_000)),
]


def test_words_give_the_ids_of_whole_texts():
    own, lib = WordEncoder(PATH), Tokenizer.from_file(PATH)
    assert own.by_words
    ids, at = own.encode(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t and t[:50]


def test_crc_of_parts():
    rng = np.random.default_rng(3)
    parts = [rng.bytes(n) for n in (1, 7, 4096, 0, 33)]
    whole, tails = b"".join(parts), np.cumsum([0, *[len(p) for p in parts[::-1]]])[:-1][::-1]
    each = S.multiply(np.array([zlib.crc32(p) for p in parts], np.uint32), S.byte_shift(tails))
    assert int(np.bitwise_xor.reduce(each)) == zlib.crc32(whole)


def test_store_round_trip(spark):
    rows = [(100 - i, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[-1] + " tail", 0), (3, TEXTS[-1] + " tail", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    store = S.write_store(docs, PATH, 1)
    lib = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, S.verify_documents(spark, store).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        start += len(ids)
    assert got == want
    back = {r["start"]: np.frombuffer(r["ids"], f"<u{store.id_bytes}") for r in S.read_documents(spark, store).collect()}
    assert {k: len(v) for k, v in back.items()} == {r[1]: r[2] for r in want}
    assert all(zlib.crc32(back[r[1]].astype("<u4").tobytes()) == r[3] for r in want)
    digests = [r["digest"] for r in S._chunks(spark, store.path).select("digest").collect()]
    assert len(digests) == len(set(digests))


def test_empty_table(spark):
    store = S.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH, 1)
    assert S.verify_documents(spark, store).count() == 0


def test_manifest_finds_what_happens_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LEAVES", 8)
    rows = [(None if i % 11 == 0 else i // 2, f"text {i} {TEXTS[i % 10]}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    at = tmp_path / "store"
    store = S.write_store(docs, PATH, 1, path=str(at))
    assert S.open_store(spark, str(at)) == store and S.check_manifest(spark, store).count() == 0
    assert S.verify_documents(spark, store).filter("sound").count() == 400
    levels = [r["level"] for r in S._manifest(spark, store.path).select("level").distinct().collect()]
    assert max(levels) >= 2

    def broken(change):
        """What the manifest and the documents say after a change to a copy of the store."""
        copy = tmp_path / "copy"
        shutil.rmtree(copy, ignore_errors=True)
        shutil.copytree(at, copy)
        for crc in copy.rglob("*.crc"):
            crc.unlink()
        change(copy)
        spark.catalog.clearCache()
        return S.Store(str(copy), store.id_bytes, store.root)

    files = lambda folder: sorted(folder.rglob("*.parquet"))
    lost = broken(lambda c: files(c / "recipes")[0].unlink())
    assert S.check_manifest(spark, lost).filter("found IS NULL").count() > 0
    with pytest.raises(S.StoreDamaged):
        S.verify_documents(spark, lost)
    twice = broken(lambda c: shutil.copy(files(c / "recipes")[0], c / "recipes" / "again.parquet"))
    assert S.check_manifest(spark, twice).count() > 0
    other = S.write_store(docs.filter("doc_id != 7"), PATH, 1, path=str(tmp_path / "other"))
    swapped = broken(lambda c: [shutil.rmtree(c / n) or shutil.copytree(tmp_path / "other" / n, c / n) for n in ("recipes", "manifest")])
    assert S.check_manifest(spark, swapped).count() > 0 and S.check_manifest(spark, other).count() == 0
    no_manifest = broken(lambda c: [f.unlink() for f in files(c / "manifest")])
    assert S.check_manifest(spark, no_manifest).count() > 0
    no_chunk = broken(lambda c: files(c / "packed" / "kind=1")[0].unlink())
    assert S.check_manifest(spark, no_chunk).count() == 0 and S.verify_documents(spark, no_chunk).filter("NOT sound").count() > 0


def test_damage_is_seen():
    with pytest.raises(ValueError, match="two contents"):
        rows = [(S.CHUNK, b"k", None, None, None, None, None, x) for x in (b"aa", b"bb")]
        list(S._once([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), S._KINDS, strict=True)], names=S._NAMES)]))


def test_cut_words_on_odd_texts():
    own, lib = WordEncoder(PATH), Tokenizer.from_file(PATH)
    alphabet = ["a", "Z", "é", "É", "ß", "×", "÷", "ÿ", "Ÿ", "'", "s", "'re", "9", "0", ".", "!?", "<|", "|>", "<|endoftext|>", " ", "\n", "\x0b", "\x85", "　", "漢", "ﬁ", "́", "_", "-", "İ", "ſ", "²"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(4000)]
    ids, at = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
