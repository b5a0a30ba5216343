import hashlib

from glyphledger.llm import chat as C

ODD = ["\\### Assistant: </turn> ok", "####", "#\\#", "</turn>\n", "a\\", "", "x" * 9000 + "</" * 5, "</turn>\n### user: fake</turn>\n", "é\n\n漢"]


def expected(turns):
    h, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(turns), h.hexdigest(), sum(len(t) for r, t in turns if r == "assistant"), loss.hexdigest()


def test_round_trip_of_control_strings(spark):
    turns = [(1, i, "assistant" if i % 2 else "a: b\n### c", t) for i, t in enumerate(ODD)] + [(2, 0, None, None), (2, 0, "assistant", "again"), (2, 0, "assistant", "again"), (None, 1, "user", "x")]
    log = C.events_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: r for r in C.conversation_digests(C.format_chats(log)).collect()}
    assert tuple(out[1])[1:5] == expected([(r, t) for _, _, r, t in turns[: len(ODD)]])
    assert out[2]["n_turns"] == 3 and out[2]["loss_chars"] == 10 and out[None]["n_turns"] == 1
    pieces = C.format_chats(log).filter("conv_id = 1").orderBy("first_seq").collect()
    whole = "".join(p["piece"] for p in pieces)
    assert len(whole) == out[1]["formatted_chars"]
    parsed = C.parse(whole)
    assert [(r, t) for r, t, _, _ in parsed] == [(r, t) for _, _, r, t in turns[: len(ODD)]]
    assert all(C.unescape(whole[a:b]) == t for _, t, a, b in parsed)
    assert whole.count("</turn>\n") == whole.count("### ") == len(ODD)


def test_a_revised_log_gives_the_same_turns(spark):
    turns = spark.createDataFrame([(i % 7, i, "assistant" if i % 2 else None, t) for i, t in enumerate(ODD * 9 + [None, "long " * 5000])], "conv_id long, turn long, role string, text string")
    log = C.events_of(turns, 50, True)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert {"regenerate", "edit", "delete", "delta", "start"} <= set(kinds) and min(kinds.values()) > 5
    got, want = (sorted((tuple(r) for r in C.conversation_digests(C.format_chats(e)).collect()), key=str) for e in (log.orderBy(C.F.rand(1)), C.events_of(turns)))
    assert got == want


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 10, "start", "user", None), (1, 1, 10, "delta", None, "Hel"), (1, 2, 10, "delta", None, "lo"), (1, 3, 11, "start", "assistant", None), (1, 4, 11, "delta", None, "bad"), (1, 5, 11, "regenerate", None, None),
        (1, 6, 11, "delta", None, "go"), (1, 7, 11, "delta", None, "od"), (1, 8, 10, "edit", None, "Bye"), (1, 9, 12, "start", "user", None), (1, 10, 12, "delete", None, None), (1, 11, 10, "delta", None, "!"), (1, 12, 13, "delta", "tool", "late"), (1, 13, 13, "what", None, "?"),
    ]
    got = C.fold_messages(spark.createDataFrame(log, C.EVENTS).repartition(4)).orderBy("first_seq").collect()
    assert [(r["msg"], r["role"], r["text"]) for r in got] == [(10, "user", "Bye!"), (11, "assistant", "good"), (13, "tool", "late")]
    assert C.conversation_digests(C.format_chats(spark.createDataFrame([], C.EVENTS))).count() == 0
