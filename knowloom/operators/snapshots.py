"""What changed between full snapshots of a table.

Each key is windowed by snapshot index: the lag of its content hash shows changes, gaps in the index show removals and
later additions. The content itself never crosses the network, only 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Snapshot numbers kept in a plan literal, which is searched for every row; beyond it they are joined as a table.
MAX_LITERAL_SNAPSHOTS = 36


def _hashes(c) -> list:
    """128 bits in two seeds; null has values of its own, so it equals null and differs from the empty text.

    Two longs, as Spark can combine those in its hash aggregation, without sorting.
    """
    salted = F.xxhash64(F.lit(7), c)
    return [F.when(c.isNull(), F.lit(0)).otherwise(F.xxhash64(c)).alias("h1"), F.when(c.isNull(), F.lit(0)).otherwise(salted).alias("h2")]


def key_states(df: DataFrame, key: str = "chunk_id", value: str = "content", snapshot: str = "snapshot_no") -> DataFrame:
    """One row per key and snapshot: (k, s, h1, h2). Repeated rows are combined on the map side, before the shuffle.

    Rows without a snapshot or key have no identity and take no part. Should repeats differ, the greatest hashes stand.
    """
    return (
        df.select(F.col(key).alias("k"), F.col(snapshot).alias("s"), *_hashes(F.col(value)))
        .where("k is not null and s is not null")
        .groupBy("k", "s")
        .agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    )


def snapshot_numbers(df: DataFrame, snapshot: str = "snapshot_no") -> list[int]:
    """Ascending numbers of the snapshots that exist: one value per delivery, not per record."""
    return sorted(r[0] for r in df.select(F.col(snapshot).alias("s")).where("s is not null").distinct().collect())


def snapshot_changes(df: DataFrame, key: str = "chunk_id", value: str = "content", snapshot: str = "snapshot_no") -> DataFrame:
    """(snapshot_no, <key>, change_kind): added, removed or changed against the next lower existing snapshot.

    - The first snapshot has no predecessor and yields nothing; one snapshot or an empty table yields no rows.
    - Null content equals null and differs from the empty string; no other column matters.
    - Rows with a null key or snapshot are ignored; repeated rows count once; extra columns are never read.
    - A key that comes back after a gap is removed, then added.
    """
    nums = snapshot_numbers(df, snapshot)
    kind = df.schema[snapshot].dataType.simpleString()
    states = key_states(df, key, value, snapshot)
    if len(nums) <= MAX_LITERAL_SNAPSHOTS:
        lit = F.array(*[F.lit(n) for n in nums]).cast(f"array<{kind}>")
        states = states.withColumn("i", F.array_position(lit, F.col("s")).cast("int"))
        number = lambda i: F.element_at(lit, i)
        out = _events(states, len(nums))
        return out.select(number(F.col("e.at")).alias("snapshot_no"), F.col("k").alias(key), F.col("e.kind").alias("change_kind")) if nums else out.select(F.lit(None).cast(kind).alias("snapshot_no"), F.col("k").alias(key), F.col("e.kind").alias("change_kind"))
    ids = df.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(nums)], f"s {kind}, i int")
    out = _events(states.join(ids, "s"), len(nums)).select("k", F.col("e.at").alias("i"), F.col("e.kind").alias("change_kind"))
    return out.join(ids, "i").select(F.col("s").alias("snapshot_no"), F.col("k").alias(key), "change_kind")


def _events(states: DataFrame, n: int) -> DataFrame:
    """Lag and lead of each key over the snapshot index; a key has one row per snapshot, so a window is small whatever the skew."""
    w = Window.partitionBy("k").orderBy("i")
    x = states.select("k", "i", F.lag("i").over(w).alias("pi"), F.lead("i").over(w).alias("ni"), ((F.lag("h1").over(w) != F.col("h1")) | (F.lag("h2").over(w) != F.col("h2"))).alias("differs"))
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    i, pi, ni = F.col("i"), F.col("pi"), F.col("ni")
    events = F.array(
        F.when((i > 1) & (pi.isNull() | (pi < i - 1)), event(i, "added")).when((pi == i - 1) & F.col("differs"), event(i, "changed")),
        F.when((i < n) & (ni.isNull() | (ni > i + 1)), event(i + 1, "removed")),
    )
    return x.select("k", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(snapshot_no, change_kind, n)."""
    return changes.groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))
