r"""Chat logs folded into final messages and rendered for training.

Events.  A log row is (conv_id, seq, msg, kind, role, text).  Kinds: "start"
opens a message and names its role; "delta" adds text; "edit" replaces what the
message says so far; "regenerate" empties it, later deltas fill it again;
"delete" removes it.  Null texts are empty, null roles an empty string, unknown
kinds do nothing.  A message without a start has the role of its first row that
names one.  Messages stand in the order of their first event; ties by msg.

Fold.  A log is partitioned by conversation and, within it, by message, each
sorted by sequence: a message is the unit that must fit a row anyway, so a
conversation with a third of all rows spreads over all tasks.  Rendering and reading back go through a conversation's
messages in order as a stream, with memory for one Arrow batch.

Template.  ``### Role: text</turn>\n`` per message.  Inside roles and texts a
backslash is doubled, ``</`` becomes ``<\/``, a ``#`` after a ``#`` gets a
backslash before it, and in roles so do colons and line ends; "\x" reads back
as x.  So no text, whatever it says, holds ``###`` or ``</turn>``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

DELTA_CHARS = 4096
END = "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>\n))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string"


def events_of(turns: DataFrame, delta_chars: int = DELTA_CHARS, revised: bool = False) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: a start, then deltas.

    With revised it is the log of a chat in which things changed on the way to
    the same turns: a third of the messages were drafted and regenerated, a third
    begun otherwise and edited, and beside some stood one that was deleted.
    Every row is a message of its own, so repeated rows stay repeated.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.monotonically_increasing_id() * 2).alias("msg"),
    )
    kind = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(3)) if revised else F.lit(0)
    rows = rows.withColumn("way", kind.cast("int")).withColumn("parts", F.ceil(F.length("text") / F.lit(delta_chars)).cast("int"))
    way, n = F.col("way"), F.col("n")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.when(way == 2, F.greatest("parts", F.lit(1)) + 1).otherwise(F.col("parts") + way * 2))))
    first = F.when(way == 0, n).when(way == 1, n - 2).otherwise(n - 1)  # the part of the text that an event holds
    what = F.when(n == 0, "start").when((way == 1) & (n == 2), "regenerate").when((way == 2) & (n == 2), "edit").otherwise("delta")
    draft = (way > 0) & (n == 1)
    said = F.when(draft, F.concat(F.lit("a draft of "), "role")).when(F.col("what").isin("delta", "edit"), F.substring(F.col("text"), (first - 1) * delta_chars + 1, F.lit(delta_chars)))
    rows = rows.withColumn("what", what)
    log = rows.select("conv_id", (F.col("turn") * 2**24 + n).alias("seq"), "msg", F.col("what").alias("kind"), F.when(n == 0, F.col("role")).alias("role"), said.alias("text"))
    if not revised:
        return log
    gone = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i")) for i, k in enumerate(("start", "delta", "delete"))]
    extra = rows.filter((n == 0) & (way == 1)).withColumn("e", F.explode(F.array(*gone)))
    dropped = extra.select("conv_id", (F.col("turn") * 2**24 + F.col("e.i")).alias("seq"), (F.col("msg") + 1).alias("msg"), F.col("e.kind").alias("kind"), F.lit("user").alias("role"), F.lit("never mind").alias("text"))
    return log.unionByName(dropped)


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, msg, role, text) of the messages that remain."""
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    groups = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i))
    last = F.coalesce(F.array_max(F.filter(resets, lambda i: i.isNotNull())), F.lit(0))
    alive = F.filter(F.slice("e", last + 1, F.size("e") - last), lambda x: x["kind"].isin("delta", "edit"))
    named = F.filter("e", lambda x: x["role"].isNotNull())
    opened = F.filter(named, lambda x: x["kind"] == "start")
    role = F.coalesce(F.get(opened, F.lit(0))["role"], F.get(named, F.lit(0))["role"], F.lit(""))
    return groups.filter(~F.exists("e", lambda x: x["kind"] == "delete")).select(
        "conv_id", F.get("e", F.lit(0))["seq"].alias("first_seq"), "msg", role.alias("role"), F.array_join(F.transform(alive, lambda x: x["text"]), "").alias("text")
    )


def escape(text, role: bool = False):
    text = F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</"), F.lit("<\\/")), "(?<=#)#", r"\\#")
    return F.regexp_replace(text, r"([:\n])", r"\\$1") if role else text


def render_messages(messages: DataFrame) -> DataFrame:
    """Adds piece, each message's part of the formatted conversation."""
    named = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "), escape(F.col("text")), F.lit(END))
    return messages.withColumn("piece", named)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end span the escaped text, the loss mask of a turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def _read_back(batches):
    """Streams (conv_id, piece), sorted; one row per conversation, with memory for one batch."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = object(), None

    def closed():
        n, turns, chars, loss, size = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        done = []
        for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != now:
                if state:
                    done.append(closed())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), kinds, strict=True)], names=names)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """What reading the formatted text back gives, a row per conversation."""
    prepare(rendered.sparkSession)
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "msg").select("conv_id", "piece")
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, msg, role, text, piece): the pieces of a conversation, in order, are its formatted text."""
    return render_messages(fold_messages(events))
