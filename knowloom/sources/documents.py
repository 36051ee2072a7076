"""Reading documents from files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.plugins import html_text, rich_text
from knowloom.functions.text import doc_identity, doc_type
from knowloom.operators.chunking import sliding_chunks


def read_files(spark: SparkSession, paths: str | list[str], reader=None, logical_path: Column | None = None) -> DataFrame:
    """(doc_id, path, doc_type, text) of all files under the paths (folders, files or globs).

    HTML goes through JVM expressions, other types through the pluggable reader with a fallback to the raw text. Documents are
    identified by their path, or by logical_path where files are staged under changing places.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    path = F.regexp_replace("path", r"^file:/+", "/") if logical_path is None else logical_path
    text = F.when(F.lower("path").rlike(r"\.html?$"), html_text(F.decode("content", "utf-8"))).otherwise(rich_text(reader)(F.col("content"), F.col("path")))
    return raw.select(doc_identity(path).alias("doc_id"), path.alias("path"), doc_type(path).alias("doc_type"), text.alias("text"))


def parse_files(spark: SparkSession, paths: str | list[str], reader=None) -> DataFrame:
    """Chunks of files, in the chunk schema without vectors."""
    d = read_files(spark, paths, reader)
    c = sliding_chunks(d, "doc_id", "text", keep=["path", "doc_type"])
    return c.select("chunk_id", "doc_id", "chunk_index", "content", "doc_type", F.struct(F.col("path").alias("source"), "char_start", "char_end").alias("metadata"))


def from_table(df: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """The document schema from a table with paths; a null path gives a null identity."""
    return df.select(doc_identity(F.col(path)).alias("doc_id"), F.col(path).alias("path"), doc_type(F.col(path)).alias("doc_type"), F.col(text).alias("text"))
