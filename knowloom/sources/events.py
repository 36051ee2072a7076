"""Change events as streams and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_from_kafka(spark: SparkSession, servers: str, topic: str = "doc-changes", per_trigger: int = 100_000) -> DataFrame:
    """(payload, seq) of the topic, from the latest offsets on; see from_kafka. Needs Spark's Kafka package on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest", "maxOffsetsPerTrigger": per_trigger}
    return from_kafka(spark.readStream.format("kafka").options(**options).load())


def from_kafka(records: DataFrame) -> DataFrame:
    """(payload, seq) of Kafka records: seq is the record's partition and offset, a text that sorts as these and that no other has.

    A file's events are in the order of their offsets if the producer keys them by the file's path; across partitions there is none.
    """
    place = F.concat(F.lpad(F.col("partition").cast("string"), 10, "0"), F.lit(" "), F.lpad(F.col("offset").cast("string"), 20, "0"))
    return records.select(F.col("value").cast("string").alias("payload"), place.alias("seq"))


def stream_from_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(payload, seq): a line is an event; seq is the line's arrival, a text that sorts by the file's time and path and the line's
    place, and that no other line has."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    m = F.col("_metadata")
    at = F.concat(F.lpad(F.unix_micros(m["file_modification_time"]).cast("string"), 20, "0"), F.lit(" "), m["file_path"], F.lit(" "), F.lpad(m["file_block_start"].cast("string"), 20, "0"))
    return lines.select(F.col("value").alias("payload"), at.alias("block")).mapInArrow(_places, "payload string, seq string")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each block of a file, which one task reads in order. A URI has no blanks, so that texts sort as their parts."""
    block, n = None, 0
    for b in batches:
        seq = []
        for k in b.column(1).to_pylist():
            block, n = k, n + 1 if k == block else 0
            seq.append(f"{k} {n:012d}")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq, pa.string())], ["payload", "seq"])


def dead_letter(df: DataFrame, path: str) -> None:
    """Keep payloads that can't be processed, with the reason."""
    df.select("payload", "reason", F.current_timestamp().alias("at")).write.mode("append").parquet(path)
