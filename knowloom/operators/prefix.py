"""Running aggregates over groups of any size, without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"max": F.max, "sum": F.sum, "min": F.min}


def running(df: DataFrame, group: list[str], order: str, values: dict[str, tuple[str, Column]], rows_per_bucket: int = 10_000) -> DataFrame:
    """Adds, for each name: (aggregate, column), the aggregate over the group's strictly earlier rows; null if there are none.

    `order` is a unique non-negative bigint. Rows are cut into buckets of the order, buckets are aggregated on the map side,
    only these totals are accumulated per group, and each bucket goes on from its own start: a group that holds a third of all
    rows is spread over as many tasks as it has buckets. max, min and sum are supported.
    """
    x = df.withColumn("b_", F.floor(F.col(order) / rows_per_bucket))
    for n, (_, c) in values.items():
        x = x.withColumn(f"v_{n}", c)
    totals = x.groupBy(*group, "b_").agg(*[AGGREGATES[a](f"v_{n}").alias(f"t_{n}") for n, (a, _) in values.items()])
    before = Window.partitionBy(*group).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "b_", *[AGGREGATES[a](f"t_{n}").over(before).alias(f"s_{n}") for n, (a, _) in values.items()])
    inside = Window.partitionBy(*group, "b_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(starts, [*group, "b_"])
    for n, (a, _) in values.items():
        here, start = AGGREGATES[a](f"v_{n}").over(inside), F.col(f"s_{n}")
        both = {"max": F.greatest, "min": F.least, "sum": lambda p, q: F.coalesce(p + q, p, q)}[a](here, start)
        x = x.withColumn(n, both)
    return x.drop("b_", *[f"v_{n}" for n in values], *[f"s_{n}" for n in values])
