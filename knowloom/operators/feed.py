"""Applying a feed of inserts, updates and deletes.

An ordered change is a function on a record's state. Such functions compose to one of the same form, a patch, and
composition is associative; so any bracketing of a record's changes gives the same patch. The feed is therefore cut into
range chunks by arrival, also within hot keys, chunks are composed in a tree, and the one patch left per key is applied to
the base table.

A patch has (all comparisons by the order struct, e.g. version, then delete before other kinds):
- top: the highest order and what it does (`holds`),
- reset: the highest order at which the record was deleted or inserted, that is, after which older fields don't count,
- one (order, value) pair per field: the last change that sets the field.
Each part is a maximum, so composing is commutative and idempotent as well: repeats and disorder don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import norm_token, strip_ws

KINDS = ("created", "modified", "deleted")


def change_patches(df: DataFrame, key: str, order: list[Column], kind: Column, fields: dict[str, Column] | None = None, partial: bool = False) -> DataFrame:
    """One elementary patch per change: columns k, top, reset, f_<field>.

    kind: created, modified or deleted. With partial=True a null field of a modification means "unchanged"; otherwise every
    created or modified change carries the whole record.
    """
    fields = fields or {}
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    whole = F.lit(True) if not partial else kind.isin("created", "deleted")
    cols = [F.col(key).alias("k"), F.struct(o.alias("o"), (kind == "deleted").alias("gone")).alias("top"), F.when(whole, o).alias("reset")]
    for name, value in fields.items():
        sets = (kind != "deleted") & (F.lit(True) if not partial else (value.isNotNull() | (kind == "created")))
        cols.append(F.when(sets, F.struct(o.alias("o"), value.alias("v"))).alias(f"f_{name}"))
    return df.select(*cols)


def compose(patches: DataFrame, by: list[str]) -> DataFrame:
    """Compose all patches of a group: maxima only, so Spark combines on the map side first."""
    parts = [c for c in patches.columns if c == "top" or c == "reset" or c.startswith("f_")]
    return patches.groupBy(*by).agg(*[F.max(c).alias(c) for c in parts])


def compose_tree(patches: DataFrame, chunk: Column | None = None, fan_in: int = 64, levels: int = 2) -> DataFrame:
    """Compose to one patch per key in a tree over range chunks.

    chunk numbers the change's range (for example arrival // 10,000). Each level shuffles by (key, chunk), so the changes of
    a hot key are spread over as many tasks as it has chunks; every level divides the number of chunks by fan_in, and
    the last shuffle, by the key alone, has what is left.
    """
    if chunk is None:
        return compose(patches, ["k"])
    x = patches.withColumn("c", chunk)
    for level in range(levels):
        x = compose(x if level == 0 else x.withColumn("c", F.floor(F.col("c") / fan_in)), ["k", "c"])
    return compose(x.drop("c"), ["k"])


def apply_patches(patches: DataFrame, key: str, fields: list[str], base: DataFrame | None = None) -> DataFrame:
    """State after one patch per key: (key, top order, fields) of the records that exist.

    base (columns key and fields) holds the records before the feed; its fields stand where no change reset or set them.
    """
    if base is not None:
        b = base.select(F.col(key).alias("k"), F.struct(*[F.col(f).alias(f) for f in fields]).alias("b"))
        patches = patches.join(b, "k", "full_outer")
    else:
        patches = patches.withColumn("b", F.lit(None))
    alive = F.coalesce(~F.col("top.gone"), F.lit(True))
    out = [F.col("k").alias(key), F.col("top.o").alias("order")]
    for f in fields:
        p = F.col(f"f_{f}")
        old = F.when(F.col("reset").isNull(), F.col("b").getField(f)) if base is not None else F.lit(None)
        out.append(F.when(p.isNotNull() & (F.col("reset").isNull() | (p["o"] >= F.col("reset"))), p["v"]).otherwise(old).alias(f))
    return patches.where(alive).select(*out)


def file_changes(df: DataFrame) -> DataFrame:
    """Changes of a file feed that count: (file_path, version, kind, feed_no, content_hash, event_ts).

    The version is change_version or else document_version. Rows with a null or blank path, no version or an unsupported
    change type are left out; the type ignores case and white space around it, and null means modified (blank doesn't).
    """
    kind = F.when(F.col("change_type").isNull(), F.lit("modified")).otherwise(norm_token(F.col("change_type")))
    return (
        df.select("file_path", F.coalesce("change_version", "document_version").alias("version"), kind.alias("kind"), "feed_no", "content_hash", "event_ts")
        .where(F.col("version").isNotNull() & F.col("kind").isin(*KINDS) & (strip_ws(F.col("file_path")) != ""))
    )


def file_patches(df: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """One patch per file of a feed: what it does to the file as a whole. Patches of parts of a feed compose to that of the feed."""
    ch = file_changes(df)
    p = change_patches(ch, "file_path", [F.col("version"), F.col("kind") == "deleted", F.col("feed_no")], F.col("kind"), {"content_hash": F.col("content_hash")})
    return compose_tree(p, F.floor(F.col("top.o.o2") / chunk_rows))


def current_files(df: DataFrame, chunk_rows: int = 10_000, base: DataFrame | None = None) -> DataFrame:
    """(file_path, effective_version, content_hash) of the files that exist after the feed.

    The highest version holds whichever arrived last; under equal versions a delete holds, and among equal others the one
    that arrived last gives the content_hash. Repeats change nothing. An empty feed gives no files. base (file_path, content_hash)
    has the files before the feed; those that it doesn't name stay, without a version.
    """
    return apply_patches(file_patches(df, chunk_rows), "file_path", ["content_hash"], base).select("file_path", F.col("order.o0").alias("effective_version"), "content_hash")
