"""The ledger as a stream: events in, a row per touched key and batch out.

State per collection: the count and time of each key it holds.  A collection's
events of a batch are applied in the order of time and sequence; an event that
is older than one already applied is late and is left out, which is reported.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "collection string, key string, count long, added_at timestamp, late long"


def apply_events(held: dict, last: list, rows) -> tuple[set, int]:
    """Applies (ts_us, seq, key, op) in order to held (key to [count, added]); returns the touched keys and how many events were late."""
    touched, late = set(), 0
    for ts, seq, key, op in sorted(rows):
        if [ts, seq] <= last:
            late += 1
            continue
        last[:] = [ts, seq]
        if op == "clear":
            touched |= set(held)
            held.clear()
        elif op == "remove":
            touched.add(key)
            held.pop(key, None)
        elif op == "inc":
            touched.add(key)
            if key in held:
                held[key][0] += 1
            else:
                held[key] = [1, ts]
        elif op == "dec" and key in held:
            touched.add(key)
            held[key][0] -= 1
            if not held[key][0]:
                del held[key]
    return touched, late


def _update(group, batches, state: GroupState):
    held, last = json.loads(state.get[0]) if state.exists else ({}, [-(2**62), -1])
    rows = [r for pdf in batches for r in zip(pdf["ts"].astype("datetime64[us]").astype("int64"), pdf["seq"], pdf["key"], pdf["op"], strict=True)]
    touched, late = apply_events(held, last, [(int(t), int(s), k, o) for t, s, k, o in rows])
    state.update((json.dumps([held, last]),))
    keys = sorted(touched)
    yield pd.DataFrame({
        "collection": [group[0]] * len(keys), "key": keys, "count": [held.get(k, [0])[0] for k in keys],
        "added_at": pd.to_datetime([held[k][1] if k in held else None for k in keys], unit="us"), "late": [late] * len(keys),
    })


def ledger_updates(events: DataFrame) -> DataFrame:
    """A stream of changes from a stream of events (collection, key, ts, seq, op); the last row of a key is its state, count zero: gone."""
    return events.groupBy("collection").applyInPandasWithState(_update, OUT, "state string", "update", GroupStateTimeout.NoTimeout)
