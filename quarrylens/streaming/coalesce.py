"""Structured Streaming form of event coalescing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_stream(events: DataFrame, actor: str, key: str, ts: str, gap_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Last event of every run of one actor and key without a pause longer than the gap.

    Session windows end a run when the pause exceeds the gap (a window's end is exclusive, so the gap is a
    microsecond longer). Other keys in between split a run in the batch form, but not here. Events later than
    the watermark are dropped; state holds open runs only.
    """
    rows = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", lateness)
    session = F.session_window("__at", F.lit(f"{gap_seconds} seconds 1 microseconds"))
    rest = [c for c in events.columns if c not in (actor, key)]
    last = F.max_by(F.struct(*rest), F.struct("__at", *[c for c in rest if c != ts][:1])).alias("last")
    return rows.groupBy(session, actor, key).agg(last, F.count("*").alias("run_length")).select(actor, key, "last.*", "run_length")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, lateness: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key, late events up to ``lateness`` included."""
    rows = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", lateness)
    out = rows.groupBy(F.window("__at", width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def coalesce_stateful(events: DataFrame, actor: str, key: str, ts: str, row_id: str, gap_seconds: float, lateness: str = "1 hour") -> DataFrame:
    """The stream whose rows are those of ``coalesce_events``: an event whose key is that of the actor's event just before, at most
    the gap later, replaces it, and an event of another key in between keeps both. Columns are those of ``events``.

    The state of an actor is its events that may still be replaced, or stand behind one that may yet come. An event is
    settled when its successor lies before the watermark, or when the watermark has passed it by more than the gap; a
    timer on event time wakes an actor that stays silent. So the state holds the lateness and the gap of each actor, and is
    restored from the checkpoint. Events behind the watermark or without a time are dropped; equal times are told apart by
    ``row_id``; a null actor is an actor."""
    gap = int(gap_seconds * 1_000_000)
    columns = events.columns
    rows = events.withColumn("__at", F.col(ts).cast("timestamp")).where("__at IS NOT NULL").withWatermark("__at", lateness)
    rows = rows.withColumn("__micros", F.unix_micros("__at"))

    def settle(_, batches, state):
        import pickle

        import pandas as pd

        now = state.getCurrentWatermarkMs() * 1000
        open_events = pickle.loads(state.get[0]) if state.exists else []
        for batch in batches:
            for at, id_, key_, *values in zip(batch["__micros"].tolist(), batch[row_id].tolist(), batch[key].tolist(), *(batch[c].tolist() for c in columns), strict=True):
                if at >= now:
                    open_events.append((at, id_, key_, values))
        open_events.sort(key=lambda e: (e[0], e[1]))
        done, out = 0, []
        for e, after in zip(open_events, [*open_events[1:], None], strict=True):
            if after is not None and after[0] < now:
                replaced = after[2] == e[2] and after[0] - e[0] <= gap
            elif e[0] + gap < now:
                replaced = False
            else:
                break
            done += 1
            if not replaced:
                out.append(e[3])
        open_events = open_events[done:]
        if open_events:
            state.update((pickle.dumps(open_events),))
            wake = min([open_events[0][0] + gap, *(e[0] for e in open_events[1:2])])
            state.setTimeoutTimestamp(max(wake // 1000, now // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(columns)})

    return rows.groupBy(actor).applyInPandasWithState(settle, events.schema, "open binary", "append", "EventTimeTimeout")
