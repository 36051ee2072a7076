"""Change events: gates, implicit versions, idempotency, chunk differences, ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import content_hash
from knowloom.functions.versions import is_stale_by_version, safe_timestamp
from knowloom.operators.prefix import running
from knowloom.session import materialize

KINDS = ("created", "modified", "deleted")


def first_arrivals(events: DataFrame, order: str = "seq") -> DataFrame:
    """The first event of each event_id, by a unique order; events without an id are all kept."""
    first = events.where("event_id is not null").groupBy("event_id").agg(F.min(order).alias(order)).select(order)
    return events.where("event_id is not null").join(first, order, "left_semi").unionByName(events.where("event_id is null"))


def numbered(events: DataFrame, *order, name: str = "row") -> DataFrame:
    """With a unique bigint that rises in the given order; ties get different numbers too."""
    return events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def version_gate(events: DataFrame, order: str = "seq") -> DataFrame:
    """events (file_path, change_type, version, seq) with last_version and stale, for versioned histories.

    A skipped event never exceeds the running maximum, so the last applied version is the maximum of all earlier ones.
    """
    x = running(events, ["file_path"], order, {"last_version": ("max", F.col("version"))})
    return x.withColumn("stale", is_stale_by_version(F.col("change_type"), F.col("last_version"), F.col("version")))


def timestamp_gate(events: DataFrame, order: str = "seq") -> DataFrame:
    """events (file_path, event_ts, seq) with last_ts and stale, for unversioned histories; a null time is the epoch."""
    ts = safe_timestamp(F.col("event_ts"))
    x = running(events, ["file_path"], order, {"last_ts": ("max", ts)})
    return x.withColumn("stale", F.coalesce(ts < F.col("last_ts"), F.lit(False)))


def assign_versions(events: DataFrame, order: str = "seq") -> DataFrame:
    """events (file_path, change_type, seq) of unversioned histories with `assigned`: 1 for a first create, else 2, then up by 1."""
    x = running(events, ["file_path"], order, {"n_": ("sum", F.lit(1).cast("bigint")), "f_": ("min", F.struct(F.col(order), F.col("change_type")))})
    first = F.coalesce(F.col("f_.change_type"), F.col("change_type"))
    return x.withColumn("assigned", F.coalesce("n_", F.lit(0)) + F.when(first == "created", 1).otherwise(2)).drop("n_", "f_")


class FileGate:
    """The gate over one file's events in order, for any mixture of versioned and unversioned ones; every handler succeeds."""

    def __init__(self) -> None:
        self.version: int | None = None  # last version, assigned ones included
        self.ledger: int | None = None  # last explicit version
        self.ts: float | None = None

    @staticmethod
    def _stale(kind: str | None, last: int | None, now: int | None) -> bool:
        return last is not None and now is not None and (now < last if kind == "deleted" else now <= last)

    def apply(self, kind: str | None, version: int | None, ts: float | None) -> tuple[str, int | None]:
        """(applied or the reason for skipping, the version that the event got)."""
        t = 0.0 if ts is None else ts
        if kind not in KINDS:
            return "unsupported", None
        if self._stale(kind, self.ledger, version) or self._stale(kind, self.version, version):
            return "stale_version", None
        if version is None and self.ts is not None and t < self.ts:
            return "stale_timestamp", None
        if version is not None:
            self.version = self.ledger = version
        else:
            self.version = (1 if kind == "created" else 2) if self.version is None else self.version + 1
        self.ts = t
        return "applied", self.version


def replay_gate(events: DataFrame, order: str = "seq", marks: DataFrame | None = None) -> DataFrame:
    """(seq, file_path, event_id, outcome, assigned): the sequential gate over whole histories, also mixed ones.

    The order has to be unique, of any type that sorts; see numbered.
    marks (file_path, last_ts, last_version; see watermarks) is where files stand before these events.
    outcome: applied, duplicate (an event with the id was applied before, in whatever file), stale_version, stale_timestamp or
    unsupported. An id counts only once it was applied, so an event that was skipped may come again. Null ids never repeat.
    A file's events run through one task in order, as the gate's state depends on each of them, but as a stream: the task
    holds one batch, the state of one file, and ids that were applied and come again later in it. Pure histories have gates
    without that order (version_gate, timestamp_gate).
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    cols = events.where("file_path is not null").select(F.col(order).alias("seq"), "file_path", "event_id", "change_type", "version", seconds("event_ts").alias("ts"))
    # Ids are combined on the map side; only those that repeat are joined, so that a task forgets an id after its last event.
    ids = cols.where("event_id is not null").groupBy("event_id").agg(F.min("seq").alias("a_"), F.max("seq").alias("z_"), (F.min("file_path") != F.max("file_path")).alias("across_")).where("a_ < z_")
    cols = cols.join(ids, "event_id", "left").withColumns({"later": F.coalesce(F.col("seq") < F.col("z_"), F.lit(False)), "across": F.coalesce("across_", F.lit(False))})
    if marks is not None:
        cols = cols.join(marks.select("file_path", F.col("last_version").alias("v0"), seconds("last_ts").alias("t0")), "file_path", "left")
    else:
        cols = cols.withColumns({"v0": F.lit(None).cast("bigint"), "t0": F.lit(None).cast("double")})
    cols = materialize(cols.select("seq", "file_path", "event_id", "change_type", "version", "ts", "v0", "t0", "later", "across"), "gate")
    rename = lambda x: x.withColumnRenamed("seq", order)
    if cols.where("across").isEmpty():
        return rename(_gate_files(cols.withColumn("elsewhere", F.lit(False)))).drop("across")
    # Ids of several files: what a file applies depends on what others did before. Each round takes the first success of an id in
    # the last round as given; the earliest event that is still wrong is put right in each, until nothing changes.
    before = None
    while True:
        x = cols.withColumn("elsewhere", F.lit(False)) if before is None else cols.join(before, "event_id", "left").withColumn("elsewhere", F.coalesce((F.col("first_") < F.col("seq")) & (F.col("in_") != F.col("file_path")), F.lit(False))).drop("first_", "in_")
        out = materialize(_gate_files(x), "outcomes")
        won = out.where("across and outcome = 'applied'").groupBy("event_id").agg(F.min(F.struct("seq", "file_path")).alias("m")).select("event_id", F.col("m.seq").alias("first_"), F.col("m.file_path").alias("in_"))
        if before is not None and won.exceptAll(before).isEmpty() and before.exceptAll(won).isEmpty():
            return rename(out.drop("across"))
        before = won


def _gate_files(cols: DataFrame) -> DataFrame:
    """The gate over each file; elsewhere: the event's id was applied in another file before."""
    parts = int(cols.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, gate, applied = None, FileGate(), set()
        for b in batches:
            out = []
            for s, p, e, k, v, t, v0, t0, later, across, elsewhere in b.itertuples(index=False):
                if p != path:
                    path, gate, applied = p, FileGate(), set()
                    gate.version = gate.ledger = None if pd.isna(v0) else int(v0)
                    gate.ts = None if pd.isna(t0) else t0
                if elsewhere or e in applied:
                    done = ("duplicate", None)
                else:
                    done = gate.apply(k, None if pd.isna(v) else int(v), None if pd.isna(t) else t)
                if not later:
                    applied.discard(e)
                elif done[0] == "applied":
                    applied.add(e)
                out.append((s, p, e, *done, across))
            x = pd.DataFrame(out, columns=["seq", "file_path", "event_id", "outcome", "assigned", "across"])
            x["assigned"] = x["assigned"].astype("Int64")
            yield x

    kind = cols.schema["seq"].dataType.simpleString()
    x = cols.select("seq", "file_path", "event_id", "change_type", "version", "ts", "v0", "t0", "later", "across", "elsewhere")
    return x.repartition(parts, "file_path").sortWithinPartitions("file_path", "seq").mapInPandas(work, f"seq {kind}, file_path string, event_id string, outcome string, assigned bigint, across boolean")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def chunk_diff(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(<by>, chunk_id, change): changed (new ids too), removed or unchanged, by content hash; null ids are left out, repeats count once.

    by: columns that tell several pairs of old and new apart, which are compared at once.
    """
    keys = [*(by or []), "chunk_id"]
    h = lambda df, c: df.where("chunk_id is not null").groupBy(*keys).agg(F.max(content_hash(F.col("content"))).alias(c))
    x = h(old, "o").join(h(new, "n"), keys, "full_outer")
    return x.select(*keys, F.when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed").alias("change"))


def stale_chunks(diff: DataFrame, old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(<by>, chunk_id, phase, chunk_index): what must go: the removed (phase 0, old order), then the changed (phase 1, new order)."""
    keys = [*(by or []), "chunk_id"]
    at = lambda df: df.groupBy(*keys).agg(F.min("chunk_index").alias("chunk_index"))
    gone = diff.where("change = 'removed'").join(at(old), keys).select(*keys, F.lit(0).alias("phase"), "chunk_index")
    changed = diff.where("change = 'changed'").join(at(new), keys).select(*keys, F.lit(1).alias("phase"), "chunk_index")
    return gone.unionByName(changed)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """The latest transition of each event (event_id, status, seq, ...), by seq."""
    cols = [c for c in ledger.columns if c not in ("event_id", "seq")]
    return ledger.where("event_id is not null").groupBy("event_id").agg(F.max(F.struct("seq", *cols)).alias("m")).select("event_id", "m.*")


def watermarks(ledger: DataFrame) -> DataFrame:
    """(file_path, last_ts, last_version): of succeeded events only, each by its last transition; null versions don't count."""
    s = ledger.where("status = 'SUCCEEDED' and file_path is not null")
    pick = lambda c, cond: F.max(F.when(cond, F.struct("seq", c)))[c]
    return s.groupBy("file_path").agg(pick("event_ts", F.col("event_ts").isNotNull()).alias("last_ts"), pick("version", F.col("version").isNotNull()).alias("last_version"))


def unprocessed(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose id has not succeeded yet."""
    return events.join(ledger.where("status = 'SUCCEEDED' and event_id is not null").select("event_id").distinct(), "event_id", "left_anti")


def replayable(ledger: DataFrame) -> DataFrame:
    """Failed events with their payload, to go through the same pipeline again."""
    return ledger_state(ledger).where("status = 'FAILED' and payload is not null")


def split_poison(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of parsed events: invalid ones and unsupported change types are dead."""
    ok = F.col("valid") & F.col("event.change_type").isin(*KINDS)
    reason = F.when(~F.col("valid"), "invalid").otherwise("unsupported change type")
    return parsed.where(ok), parsed.where(~ok).withColumn("reason", reason)


def within_ttl(df: DataFrame, at: str, now, hours: int = 168) -> DataFrame:
    return df.where(F.col(at) > now - F.expr(f"interval {hours} hours"))
