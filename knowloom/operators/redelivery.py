"""Messages delivered more than once: keep exactly one per identifier.

One Bloom filter per time bucket screens identifiers: one that no other bucket's filter holds is definitely new and is done.
The rest are possible repeats and are verified exactly, against only those buckets of the stored identifiers whose filters
matched. Filters are blocked: an identifier's bits all lie in one block of its bucket, so a block of all buckets and its
identifiers fit into one task. A block of a bucket with few identifiers is a short list of bit positions, so filters grow with
the identifiers, not with the largest bucket. To probe, the blocks of all buckets are turned into one row of bucket bits for each
position: the rows of an identifier's positions, and-ed, are the buckets that may have it, all at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import norm_token
from knowloom.session import materialize

#: Identifiers of one time bucket that a filter block is sized for, its bits for each, and the bits set for each.
BLOCK_IDS, BITS_PER_ID, PROBES = 4096, 16, 6
BITS = BLOCK_IDS * BITS_PER_ID  # positions fit into 16 bits
#: Identifiers of all buckets that one task screens at a time, and those whose buckets it looks up at once.
GROUP_IDS, AT_ONCE = 200_000, 8_192
#: Time buckets of the storage that a plan names; if more are matched, all are read.
MAX_NAMED = 1_000


def identifiers(df: DataFrame, id_col: str, order: str, bucket: Column) -> DataFrame:
    """(b, id, o): the first delivery of each identifier in each time bucket, combined before the shuffle.

    Identifiers are compared without surrounding white space of any kind and without letter case; null and blank ones have
    no identity. A null bucket is a bucket of its own.
    """
    rows = df.select(F.coalesce(bucket.cast("bigint"), F.lit(-1)).alias("b"), norm_token(F.col(id_col)).alias("id"), F.col(order).alias("o"))
    return rows.where("id is not null").groupBy("b", "id").agg(F.min("o").alias("o"))


def _positions(h: np.ndarray) -> np.ndarray:
    """PROBES bit positions in a block for each 64-bit hash: double hashing on its two halves."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BITS)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    at = np.unique(_positions(pdf["h"].to_numpy()).ravel()).astype(np.uint16)
    if at.nbytes >= BITS // 8:
        bits = np.zeros(BITS, dtype=bool)
        bits[at] = True
        raw = np.packbits(bits).tobytes()
    else:
        raw = at.tobytes()
    return pd.DataFrame({"b": [pdf["b"].iloc[0]], "block": [pdf["block"].iloc[0]], "bits": [raw]})


def _set_bits(raw: bytes) -> np.ndarray:
    """Positions of a stored block: a bitmap if it is as long as one, else the list."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) == BITS // 8 else np.frombuffer(raw, np.uint16)


def build_filters(firsts: DataFrame) -> DataFrame:
    """(b, block, bits) for identifiers with hash h and block."""
    return firsts.select("b", "block", "h").groupBy("b", "block").applyInPandas(_build, "b bigint, block bigint, bits binary")


def _probe(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The time buckets whose filters hold each identifier, its own left out; identifiers without any are not returned."""
    out = []
    if len(ids) and len(filters):
        buckets, column = np.unique(filters["b"].to_numpy(), return_inverse=True)
        rows = np.zeros((BITS, (len(buckets) + 7) // 8), np.uint8)
        for j, raw in zip(column, filters["bits"]):
            rows[_set_bits(raw), j >> 3] |= np.uint8(128 >> (j & 7))
        pos, own = _positions(ids["h"].to_numpy()), ids["b"].to_numpy()
        for s in range(0, len(ids), AT_ONCE):
            p = pos[s : s + AT_ONCE]
            hit = rows[p[:, 0]]
            for k in range(1, PROBES):
                hit &= rows[p[:, k]]
            some = np.flatnonzero(hit.any(axis=1))
            i, j = np.nonzero(np.unpackbits(hit[some], axis=1)[:, : len(buckets)])
            at, other = some[i] + s, buckets[j]
            keep = own[at] != other
            x = ids.iloc[at[keep]]
            out.append(pd.DataFrame({"id": x["id"].to_numpy(), "b": x["b"].to_numpy(), "o": x["o"].to_numpy(), "other": other[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "b": [], "o": [], "other": []}).astype({"id": object, "b": "int64", "o": "int64", "other": "int64"})


def blocks_for(total: int, largest: int) -> int:
    """So many that a block has GROUP_IDS identifiers of all buckets at most, and BLOCK_IDS of the largest bucket."""
    return max(1, math.ceil(total / GROUP_IDS), math.ceil(largest / BLOCK_IDS))


def with_blocks(firsts: DataFrame, blocks: int) -> DataFrame:
    h = F.xxhash64("id")
    return firsts.withColumn("h", F.xxhash64(F.lit(11), F.col("id"))).withColumn("block", F.pmod(h, F.lit(blocks)))


def screen(firsts: DataFrame, filters: DataFrame) -> DataFrame:
    """Possible repeats: (id, b, o, other), one row per matching bucket."""
    return firsts.groupBy("block").cogroup(filters.groupBy("block")).applyInPandas(_probe, "id string, b bigint, o bigint, other bigint")


def repeats_in_storage(candidates: DataFrame, storage: DataFrame) -> DataFrame:
    """(o): the bucket-first deliveries whose identifier was delivered earlier in a matching bucket of the storage.

    Only buckets that some candidate matched are read, as long as a plan can name them.
    """
    matched = [r[0] for r in candidates.select("other").distinct().limit(MAX_NAMED + 1).collect()]
    storage = storage.where(F.col("b").isin(matched)) if len(matched) <= MAX_NAMED else storage
    c = candidates.alias("c").join(storage.select(F.col("b").alias("other"), "id", F.col("o").alias("so")).alias("s"), ["other", "id"])
    return c.where("so < o").select("o").distinct()


def first_deliveries(df: DataFrame, id_col: str, order: str, bucket: Column) -> DataFrame:
    """(o): for each identifier the smallest `order` of all its deliveries."""
    firsts = identifiers(df, id_col, order, bucket)
    stored = materialize(firsts, "ids", ["b"])  # the bucketed storage
    total, largest = stored.groupBy("b").count().agg(F.sum("count"), F.max("count")).first()
    x = with_blocks(stored, blocks_for(total or 0, largest or 0))
    late = repeats_in_storage(materialize(screen(x, build_filters(x)), "maybe"), stored)
    return stored.select("o").join(late, "o", "left_anti")


def _bucket(df: DataFrame, at: str, hours: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (3600 * hours))


def surplus_deliveries(df: DataFrame, id_col: str = "event_id", order: str = "delivery_no", at: str = "received_at", bucket_hours: int = 12) -> DataFrame:
    """(<order>): every row whose identifier also occurs in a row with a smaller `order`.

    `order` is unique. Null and blank identifiers are never surplus. Time buckets only steer the screening: clocks that
    disagree or missing times change nothing in the result. An empty table gives no rows.
    """
    keep = first_deliveries(df, id_col, order, _bucket(df, at, bucket_hours))
    valid = df.select(F.col(order).alias("o"), norm_token(F.col(id_col)).alias("id")).where("id is not null").select("o")
    return valid.join(keep, "o", "left_anti").select(F.col("o").alias(order))


def unique_deliveries(df: DataFrame, id_col: str = "event_id", order: str = "delivery_no", at: str = "received_at", bucket_hours: int = 12) -> DataFrame:
    """The rows of df with one (the earliest) delivery per identifier; rows without identifier have nothing to repeat and stay."""
    keep = first_deliveries(df, id_col, order, _bucket(df, at, bucket_hours)).withColumnRenamed("o", order)
    blank = norm_token(F.col(id_col)).isNull()
    return df.where(~blank).join(keep, order, "left_semi").unionByName(df.where(blank))


def append_batch(spark, batch: DataFrame, store: str, filter_store: str, blocks: int, id_col: str = "event_id", order: str = "delivery_no", at: str = "received_at", bucket_hours: int = 12) -> DataFrame:
    """Incremental form: the new deliveries of a batch, checked against the stored history, which the batch then joins.

    store and filter_store are folders of earlier calls (or not there yet); blocks must not change between calls. Only the
    blocks' filters and the matching time buckets of the store are read. A batch applied twice adds nothing the second time.
    """
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(hadoop).exists(jvm.org.apache.hadoop.fs.Path(p))
    firsts = identifiers(batch, id_col, order, _bucket(batch, at, bucket_hours)).groupBy("id").agg(F.min_by("b", "o").alias("b"), F.min("o").alias("o"))
    x = with_blocks(firsts, blocks)
    if there(store):
        old = spark.read.schema("id string, o bigint, b bigint").parquet(store)
        filters = spark.read.schema("block bigint, bits binary, b bigint").parquet(filter_store)
        cand = x.withColumn("own", F.col("b")).withColumn("b", F.lit(-2).cast("bigint"))
        maybe = materialize(screen(cand, filters), "maybe")
        repeat = maybe.join(old.select("id", F.col("b").alias("other")), ["other", "id"], "left_semi").select("id").distinct()
        x = x.join(repeat, "id", "left_anti")
    new = materialize(x, "new")
    build_filters(new).write.mode("append").partitionBy("b").parquet(filter_store)
    new.select("id", "o", "b").write.mode("append").partitionBy("b").parquet(store)
    return batch.join(new.select(F.col("o").alias(order)), order, "left_semi")
