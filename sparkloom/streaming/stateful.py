"""Custom state in streams."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.sessions import SCHEMA, SessionState
from sparkloom.streaming import engine


def hybrid_sessions(stream: DataFrame, timeout: float, longest: float, closing: Sequence[str], merge_within: float, similar: float) -> DataFrame:
    """Sessions by the rules of operators.sessions, row by row in event time within each micro-batch, of a stream with a
    watermark on ts. The state of a user is the open session, the last closed one, which may still grow, and a number; a session
    is given out when it can't change any more: when another has followed it, or when the watermark is past its time-out. What the
    watermark hasn't passed when the stream has been read stays in the state."""
    kept = ("start", "end", "kinds", "merged")

    def load(text: str | None) -> tuple[SessionState, int]:
        s, given = SessionState(timeout, longest, closing, merge_within, similar), 0
        if text:
            open_, done, given = json.loads(text)
            again = lambda x: x | {"kinds": Counter(x["kinds"])}
            s.open, s.done = open_ and again(open_), [again(x) for x in done]
        return s, given

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        s, given = load(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            if s.open:
                s.close()
            out, s.done = s.done, []
        else:
            rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
            for t, kind in zip(rows["t"], rows["event_type"], strict=True):
                s.add(t, kind)
            out, s.done = s.done[:-1], s.done[-1:]
            idle = int((s.open["end"] + max(timeout, merge_within)) * 1000) + 1
            state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))
        small = lambda x: {k: x[k] for k in kept}
        state.update((json.dumps((s.open and small(s.open), [small(x) for x in s.done], given + len(out))),))
        yield pd.DataFrame({
            "user_id": [key[0]] * len(out), "session": range(given + 1, given + 1 + len(out)), "start": [x["start"] for x in out], "end": [x["end"] for x in out], "n": [x["kinds"].total() for x in out],
            "kinds": [",".join(f"{k}={n}" for k, n in sorted(x["kinds"].items())) for x in out], "merged": [x["merged"] for x in out],
        })

    rows = stream.select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("t"), "event_type")
    out = rows.groupBy("user_id").applyInPandasWithState(step, SCHEMA, "state string", "append", "EventTimeTimeout")
    return engine.appended(out)
