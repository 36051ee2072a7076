"""Named queries over the test tables, with the SQL they are checked against."""

from __future__ import annotations



def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")
