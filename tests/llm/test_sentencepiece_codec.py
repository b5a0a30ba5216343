import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from glyphledger.llm import sentencepiece_codec as C
from glyphledger.llm.common import utf8

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "a", "Hello world, it is\nfine.\n\nNew  double", " lead", "trail ", "tab\tx", "漢字 mixed é ﬁ ́", "▁mark in text", "<s> control </s> <unk>", "\n", "\n\n x", "🙂 emoji 🙂🙂",
    "naïve Straße über", "x" * 3000, "word " * 20_000 + "end", "\r\nwin\r\n", "zero\x00byte", "12 345.678",
]


def test_ids_equal_the_library():
    own, lib = C.Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert own.by_segments and own.at_lines
    ids, ends, parity, trip = own.encode(*utf8(pa.array(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert ids[ends[i] : ends[i + 1]].tolist() == lib.encode(t or ""), t and t[:40]
        assert own.whole.decode(ids[ends[i] : ends[i + 1]].tolist()) == (t or "").replace(C.MARK, " ")
        alone = C.Codec(PATH).encode(*utf8(pa.array([t], pa.string())))[0] if i < 3 else None
        assert alone is None or alone.tolist() == lib.encode(t or "")
    assert parity.all() and trip.tolist() == [C.MARK not in (t or "") for t in TEXTS]
    assert max(map(len, own.memo)) <= C.MEMO_CHARS
    own.by_segments = False
    whole = own.encode(*utf8(pa.array(TEXTS)))
    assert all((x == y).all() for x, y in zip(whole, (ids, ends, parity, trip), strict=True))


def test_ids_are_the_backends_and_parity_tells_when_they_are_wrong():
    own = C.Codec(PATH)
    model = own.model
    pieces = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    swapped = [(p.replace("▁the", "▁teh") if p in ("▁the", "▁teh") else p, s, k) for p, s, k in model.pieces]
    broken = C.Model(model.data)
    broken.pieces = swapped
    own.part = broken.backend(False)
    ids, ends, parity, trip = own.encode(*utf8(pa.array(["see the end", "see an end"])))
    assert parity.tolist() == [False, True] and pieces["▁the"] not in ids.tolist()
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert ids[: ends[1]].tolist() != lib.encode("see the end") and ids[ends[1] :].tolist() == lib.encode("see an end")


def test_wire_format_and_unigram_backend():
    m = C.Model(open(PATH, "rb").read())
    assert m.type == C.BPE and m.byte_fallback and len(m.pieces) == 32_000 and m.pieces[1][0] == "<s>"

    def message(*parts):
        out = b""
        for n, v in parts:
            if isinstance(v, int):
                out += bytes([n << 3, v]) if n < 16 else bytes([(n << 3) & 127 | 128, n >> 4, v])
            elif isinstance(v, float):
                out += bytes([n << 3 | 5]) + np.float32(v).tobytes()
            else:
                out += bytes([n << 3 | 2, len(v)]) + v
        return out

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -1.0, 1), ("ba", -1.5, 1), ("▁a", -1.8, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    model = C.Model(data)
    assert model.type == C.UNIGRAM
    own, lib = model.backend(True), model.reference(True)
    for text in ["ab", "abab ba a", "bé", "aab  ba"]:
        assert own.encode(text, add_special_tokens=False).ids == lib.encode(text), text


def test_round_trip_on_spark(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, None, "x")], "doc_id long, text string, ids string")
    out = C.encode_sentencepiece(docs, PATH, ["doc_id"])
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["parity"] for r in rows)
    assert {r["doc_id"] for r in rows if not r["round_trip"]} == {i for i, t in enumerate(TEXTS) if t and C.MARK in t}
    back = {r["doc_id"]: r["text"] for r in C.decode_sentencepiece(out, PATH, ["doc_id"]).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if not t or C.MARK not in t)
    assert C.encode_sentencepiece(docs.limit(0), PATH, ["doc_id"]).count() == 0
