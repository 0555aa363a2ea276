"""The event operators on streams: first-seen keys, windowed counts and workflow states with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(events: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: retries that arrive later are dropped, and state is too."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str, lateness: str | None = None) -> DataFrame:
    """key, start, n for each tumbling window; ``lateness`` sets the watermark of a stream, which emits a window once that has passed it."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    return rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def workflow_states(events: DataFrame, start: str, moves: list[tuple[str, str, str]], delay: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """task, event_id, state, legal, revision for every event (task, event_id, ts, event) as it arrives.

    The state of a task is its name and revision; a batch's events of a task
    are folded in order of (ts, event_id). A task is forgotten once the watermark
    is ``idle_ms`` beyond its last event.
    """
    allowed = {(a, e): b for a, e, b in moves}

    def fold(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        name, revision = state.get if state.exists else (start, 0)
        rows = sorted((r for frame in frames for r in frame.itertuples(index=False)), key=lambda r: (r.ts, r.event_id))
        out = []
        for r in rows:
            to = allowed.get((name, r.event))
            name, revision = to or name, revision + (to is not None)
            out.append((key[0], r.event_id, name, to is not None, revision))
        state.update((name, revision))
        last = max(int(r.ts.timestamp() * 1000) for r in rows)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["task", "event_id", "state", "legal", "revision"])

    return events.withWatermark("ts", delay).groupBy("task").applyInPandasWithState(
        fold, "task long, event_id long, state string, legal boolean, revision int", "name string, revision int", "append", "EventTimeTimeout"
    )
