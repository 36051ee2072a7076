"""The change-event gate as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knowloom.operators.events import FileGate

OUT = "file_path string, event_id string, outcome string, assigned bigint"
STATE = "version bigint, ledger bigint, ts double, seen array<string>"


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    g, seen = FileGate(), []
    if state.exists:
        g.version, g.ledger, g.ts, seen = state.get
        g.version, g.ledger = (None if pd.isna(x) else int(x) for x in (g.version, g.ledger))
        g.ts, seen = (None if pd.isna(g.ts) else g.ts), list(seen)
    known, out = set(seen), []
    for s, p, e, k, v, t in pd.concat(list(batches)).sort_values("seq")[["seq", "file_path", "event_id", "change_type", "version", "ts"]].itertuples(index=False):
        if isinstance(e, str) and e in known:
            out.append((s, p, e, "duplicate", None))
            continue
        done = g.apply(k if isinstance(k, str) else None, None if pd.isna(v) else int(v), None if pd.isna(t) else t)
        out.append((s, p, e, *done))
        if done[0] == "applied" and isinstance(e, str):
            known.add(e)
            seen.append(e)
    state.update((g.version, g.ledger, g.ts, seen))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    x = pd.DataFrame(out, columns=["seq", "file_path", "event_id", "outcome", "assigned"])
    x["assigned"] = x["assigned"].astype("Int64")
    yield x


def stream_gate(events: DataFrame, ttl_hours: int | None = None) -> DataFrame:
    """events (seq, file_path, event_id, change_type, version, event_ts) as a stream, to outcomes.

    State is one row per file: versions, time, and all ids applied, as events without versions or of equal times pass the gate
    again otherwise, however old they are. The row grows with them; ttl_hours is what ends it. An id counts as a duplicate once it was applied, so
    a skipped event may come again. Rows of a file in one micro-batch are taken in order of seq. Null paths are left out.
    With ttl_hours the state of a file without events for so long is dropped; with a trigger that ends, such as availableNow,
    spark.sql.streaming.noDataMicroBatches.enabled must then be false.
    """
    x = events.where("file_path is not null").select("seq", "file_path", "event_id", "change_type", "version", (F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6).alias("ts"))
    ms = ttl_hours * 3_600_000 if ttl_hours else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout
    return x.groupBy("file_path").applyInPandasWithState(lambda k, b, s: _gate(k, b, s, ms), f"seq {x.schema['seq'].dataType.simpleString()}, {OUT}", STATE, "append", timeout)


def run_to_end(df: DataFrame, sink, checkpoint: str) -> None:
    """Process all that is there in micro-batches (batch, id) -> sink, exactly once per batch id."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
