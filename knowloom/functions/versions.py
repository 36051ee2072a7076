"""Expressions on event versions and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_version(change_version: Column, document_version: Column) -> Column:
    return F.coalesce(change_version, document_version)


def safe_timestamp(ts: Column) -> Column:
    return F.coalesce(ts, F.timestamp_millis(F.lit(0)))


def is_stale_by_version(change_type: Column, last: Column, current: Column) -> Column:
    """A null on either side isn't stale; a delete is stale below the last version, other changes also at it."""
    return F.when(last.isNull() | current.isNull(), F.lit(False)).otherwise(F.when(change_type.eqNullSafe("deleted"), current < last).otherwise(current <= last))
