"""Extraction results: unnesting, first-wins distinct, source resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.parsing import parse_extraction


def unnest(df: DataFrame, chunk_id: str, raw: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of raw responses, with chunk and position."""
    x = df.select(F.col(chunk_id).alias("source_chunk_id"), *order, parse_extraction(F.col(raw)).alias("x"))
    e = x.select("source_chunk_id", *order, F.posexplode("x.entities").alias("pos", "e")).select("source_chunk_id", *order, "pos", "e.name", "e.type", "e.description")
    r = x.select("source_chunk_id", *order, F.posexplode("x.relations").alias("pos", "r")).select("source_chunk_id", *order, "pos", "r.head", "r.relation", "r.tail", "r.confidence")
    return e, r


def first_wins(df: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key in the given order, keys compared with case and nulls as the word null.

    A minimum over structs, so copies of a hot key are combined before the shuffle.
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"k{i}") for i, c in enumerate(key)]
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    return df.groupBy(*k).agg(F.min(o).alias("m")).select(*[F.col(f"m.row.c{i}").alias(c) for i, c in enumerate(columns)])


def resolve_source(df: DataFrame, chunk_id: str, chunks: DataFrame, fallback: Column) -> DataFrame:
    """df with `source`: that of its chunk, or else the fallback. Repeated chunks count once; unknown or null chunks are kept."""
    src = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("metadata.source").alias("chunk_source"))
    x = df.join(src, F.col(chunk_id) == src["chunk_id"], "left").drop(src["chunk_id"])
    return x.withColumn("source", F.coalesce("chunk_source", fallback)).drop("chunk_source")
