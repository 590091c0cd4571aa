"""Streams: upserts into a two-slot index, and the last event of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import SlotStore, upsert


def upsert_stream(changes: DataFrame, store: SlotStore, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the active index and published at once; replays give the same index."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.take(1):
            return
        now = store.read()
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])
        store.write_candidate(last if now is None else upsert(now, last, keys, order))
        store.activate()

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of_sessions(events: DataFrame, key: str, time: str, gap: str, payload: str, watermark: str | None = None) -> DataFrame:
    """key, session_start, session_end, n_events, last: quiet times of gap end a session; of equal times the larger payload counts."""
    rows = events.withWatermark(time, watermark) if watermark else events
    grouped = rows.groupBy(F.session_window(time, gap).alias("_w"), F.col(key)).agg(F.count("*").alias("n_events"), F.max(F.struct(time, payload)).alias("_x"))
    return grouped.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n_events", F.col(f"_x.{payload}").alias("last"))


def current_answers_stream(events: DataFrame, idle_seconds: float, watermark: str) -> DataFrame:
    """session, at, number, revision: what operators.lookup.current_answers keeps, of events as they come.

    State is the last request of a session and when something happened last; a timer frees it once the watermark has
    passed the session's end. An answer that comes in a later batch than a newer request is dropped, whatever its time.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "number"])
        current, known, before = state.get if state.exists else (0, False, None)
        kept = []
        for r in rows.itertuples(index=False):
            now = r.at.value // 1000
            if before is not None and now - before > idle_seconds * 1e6:
                known = False
            if r.request:
                current, known = r.revision, True
            elif known and r.revision == current:
                kept.append((key[0], r.at, r.number, r.revision))
            before = max(now, before or now)
        state.update((int(current), bool(known), int(before)))
        state.setTimeoutTimestamp(max(int(before / 1000 + idle_seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["session", "at", "number", "revision"])

    kind = events.schema["session"].dataType.simpleString()
    rows = events.select("session", "at", "number", "request", "revision").withWatermark("at", watermark)
    return rows.groupBy("session").applyInPandasWithState(judge, f"session {kind}, at timestamp, number long, revision long", "current long, known boolean, before long", "append", GroupStateTimeout.EventTimeTimeout)
