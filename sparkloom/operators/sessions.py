"""Sessions whose rules are sequential for each user."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

SCHEMA = "user_id long, session int, start double, end double, n int, kinds string, merged boolean"


class SessionState:
    """One user's open session and the last closed one; used in batch and, row by row, in streams."""

    def __init__(self, timeout: float, longest: float, closing: Sequence[str], merge_within: float, similar: float):
        self.timeout, self.longest, self.closing = timeout, longest, set(closing)
        self.merge_within, self.similar = merge_within, similar
        self.open: dict | None = None
        self.done: list[dict] = []

    @staticmethod
    def _alike(a: Counter, b: Counter) -> float:
        dot = sum(n * b[k] for k, n in a.items())
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        return dot / norm if norm else 0.0

    def add(self, t: float, kind: str) -> None:
        """A closing event ends the open session and begins a new one with itself."""
        s = self.open
        if s and (t - s["end"] > self.timeout or t - s["start"] > self.longest or kind in self.closing):
            self.close()
            s = None
        if s is None:
            self.open = {"start": t, "end": t, "kinds": Counter([kind]), "merged": False}
        else:
            s["end"] = max(s["end"], t)
            s["kinds"][kind] += 1

    def close(self) -> None:
        """The open session is done, or goes on with the one before if that ended a short while ago and is alike."""
        s, last = self.open, self.done[-1] if self.done else None
        if last and s["start"] - last["end"] <= self.merge_within and s["end"] - last["start"] <= self.longest and self._alike(last["kinds"], s["kinds"]) >= self.similar:
            last["end"], last["merged"] = s["end"], True
            last["kinds"] += s["kinds"]
        else:
            self.done.append(s)
        self.open = None


def hybrid(rows: DataFrame, timeout: float, longest: float, closing: Sequence[str], merge_within: float, similar: float) -> DataFrame:
    """Sessions of rows(user_id, event_id, t, event_type). Rows are dealt by user and sorted by Spark; a task streams them and
    holds one user's sessions, which are short, never the rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def table(user: int, state: SessionState) -> pa.RecordBatch:
            if state.open:
                state.close()
            d = state.done
            kinds = [",".join(f"{k}={n}" for k, n in sorted(s["kinds"].items())) for s in d]
            arrays = [pa.array([user] * len(d), pa.int64()), pa.array(range(1, len(d) + 1), pa.int32()), pa.array([s["start"] for s in d], pa.float64()), pa.array([s["end"] for s in d], pa.float64()), pa.array([s["kinds"].total() for s in d], pa.int32()), pa.array(kinds, pa.string()), pa.array([s["merged"] for s in d], pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=["user_id", "session", "start", "end", "n", "kinds", "merged"])

        user, state = None, None
        for b in batches:
            for u, t, kind in zip(b.column("user_id").to_pylist(), b.column("t").to_pylist(), b.column("event_type").to_pylist(), strict=True):
                if state is None or u != user:
                    if state is not None:
                        yield table(user, state)
                    user, state = u, SessionState(timeout, longest, closing, merge_within, similar)
                state.add(t, kind)
        if state is not None:
            yield table(user, state)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(run, SCHEMA)
