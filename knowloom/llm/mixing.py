"""Mixing sources to target weights by weighted fair queueing.

Every use of a document is a packet of its tokens in its source's queue. Its virtual finish time is the source's cumulative
tokens up to it, divided by the source's weight. Taking all packets in the order of finish times serves the sources at their
weights at any point of the order; the mix is that order cut off at the total budget.

Cumulative sums never run over a whole source in one task: a source's documents are shuffled into many hash buckets, buckets
are summed first, and only the (small) bucket totals are accumulated; the global order is cut into ranges of finish time in
the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.session import materialize

#: Rows that a bucket of a cumulative sum holds on average, bucket totals that are accumulated in one task on average, and
#: the most target rows that are sent to every executor.
BUCKET_ROWS, BUCKETS, MAX_TARGETS = 4_096, 4_096, 100_000


def _before(totals: DataFrame, group: list[str], bucket: str, blocks: bool = True) -> DataFrame:
    """(<group>, <bucket>, off_, no_): what all earlier buckets of the group add up to, from totals (<group>, <bucket>, t_, c_).

    Buckets are accumulated in blocks, and the blocks' totals among themselves: no task has all buckets of a group.
    """
    earlier = lambda c, keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not blocks:
        return totals.select(*group, bucket, earlier("t_", group).alias("off_"), earlier("c_", group).alias("no_"))
    x = totals.withColumn("k_", F.floor(F.col(bucket) / BUCKETS))
    whole = x.groupBy(*group, "k_").agg(F.sum("t_").alias("t_"), F.sum("c_").alias("c_"))
    starts = _before(whole, group, "k_", blocks=False).select(*group, "k_", F.col("off_").alias("o_"), F.col("no_").alias("n_"))
    inside = x.select(*group, "k_", bucket, earlier("t_", [*group, "k_"]).alias("off_"), earlier("c_", [*group, "k_"]).alias("no_"))
    return inside.join(starts, [*group, "k_"]).select(*group, bucket, (F.col("off_") + F.col("o_")).alias("off_"), (F.col("no_") + F.col("n_")).alias("no_"))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str, count: str | None = None) -> DataFrame:
    """Inclusive cumulative sum of `value` in each group, ordered by bucket, then by `order`; `count` numbers the rows from 1.

    Buckets must follow the order. Sums each bucket (combined before the shuffle), accumulates the totals, adds them back.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("t_"), F.count("*").alias("c_"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.join(_before(totals, group, bucket), [*group, bucket]).withColumn(out, F.col("off_") + F.sum(value).over(inside))
    if count:
        x = x.withColumn(count, F.col("no_") + F.count("*").over(inside))
    return x.drop("off_", "no_")


def plan_mix(totals: DataFrame, targets: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """One row per target with its weight, its mix's budget and how many rounds through its documents may be needed.

    Sources without a document that has tokens can't contribute: the other shares of the mix are scaled up to 1. Without a
    given budget the mix is as large as it can be with every remaining share met: the least of max_repeats x tokens / weight.
    """
    t = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    x = t.join(totals, "source", "left").withColumn("usable", (F.coalesce("tokens", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    mix = Window.partitionBy("mix_name")  # as many rows as a mix has targets
    x = x.withColumn("weight", F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(mix)))
    x = x.withColumn("feasible", F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight")).over(mix))
    given = F.lit(None).cast("double")
    if budgets:
        given = F.element_at(F.create_map(*[v for k, b in budgets.items() for v in (F.lit(k), F.lit(float(b)))]), F.col("mix_name"))
    x = x.withColumn("budget", F.floor(F.coalesce(given, F.col("feasible")) + 1e-6).cast("bigint"))
    # At a finish time f every source has served more than weight x f less one document, or all it has, which is weight x budget
    # at least if the budget is feasible. So from budget + document / weight on, for the worst source, the budget is used up.
    late = F.max(F.when(F.col("usable"), F.col("largest") / F.col("weight"))).over(mix)
    x = x.withColumn("last_finish", F.when(F.col("budget") <= F.col("feasible"), F.col("budget") + late + 1))
    # Beyond that short sources stop early, others take their place, and all rounds may be needed.
    rounds = F.least(F.col("max_repeats"), F.floor(F.col("last_finish") * F.col("weight") / F.col("tokens")).cast("bigint") + 1).cast("int")
    rounds = F.when(F.col("last_finish").isNull(), F.col("max_repeats")).otherwise(rounds)
    return x.withColumn("rounds", rounds)


def mix_sources(sizes: DataFrame, targets: DataFrame, budgets: dict[str, float] | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix, report) from sizes (doc_id, source, n_tokens) and targets (mix_name, source, target_share, max_repeats).

    mix: mix_name, position (from 1), source, doc_id, repeat_no (from 0), n_tokens, finish_time.
    report: per target its share wanted and reached, tokens, uses, distinct documents, most uses of one, tokens available.

    - The mix's tokens stay within the budget; the cut is the first position at which they would exceed it, so each
      source is within about one document of its share.
    - No document is used more than max_repeats times; every round through a source is shuffled anew, and a round begins
      only when the one before is used up.
    - Documents without tokens (null or empty text), without source, or of a source without a target aren't used. A doc_id
      that occurs several times is one document (the least source and size stand). A repeated target counts once.
    - Ties in finish time go by source, then round, then doc_id. Empty tables give an empty mix, and a report of zeros.
    """
    docs = sizes.where("doc_id is not null and source is not null and n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("doc_id", "s.source", "s.n_tokens")
    docs = materialize(docs, "sizes")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    plan = materialize(plan_mix(totals, targets, budgets), "mixplan")
    n_docs, n_targets = docs.count(), plan.count()
    use = plan.where("weight is not null").select("mix_name", "source", "weight", "budget", "last_finish", "rounds", "max_repeats")
    use = F.broadcast(use) if n_targets <= MAX_TARGETS else use
    bits = max(0, math.ceil(math.log2(max(1, n_docs / BUCKET_ROWS))))
    copies = docs.join(use, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.least("rounds", "max_repeats") - 1)))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), F.col("repeat_no"), F.col("doc_id")))
    high = F.shiftrightunsigned(F.col("h"), 64 - bits).cast("bigint") if bits else F.lit(0).cast("bigint")
    # Buckets of the queue: rounds one after the other, in each the hash's top bits.
    copies = copies.withColumn("b", F.col("repeat_no") * F.lit(1 << bits).cast("bigint") + high)
    queued = running_sum(copies, ["mix_name", "source"], "b", [F.shiftrightunsigned("h", 1), F.col("h"), F.col("doc_id")], "n_tokens", "cum")
    timed = queued.withColumn("finish_time", F.col("cum") / F.col("weight")).where(F.col("last_finish").isNull() | (F.col("finish_time") <= F.col("last_finish")))
    ranges = max(1, n_docs // BUCKET_ROWS) * 4
    timed = timed.withColumn("v", F.floor(F.col("finish_time") * ranges / F.greatest(F.col("budget"), F.lit(1))).cast("bigint"))
    served = running_sum(timed.select("mix_name", "source", "doc_id", "repeat_no", "n_tokens", "finish_time", "budget", "v"), ["mix_name"], "v", [F.col("finish_time"), F.col("source"), F.col("repeat_no"), F.col("doc_id")], "n_tokens", "total", "position")
    mix = materialize(served.where("total <= budget").select("mix_name", "position", "source", "doc_id", "repeat_no", "n_tokens", "finish_time"), "mix")
    return mix, report(mix, plan)


def report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Shares really reached, one row per target."""
    per_doc = mix.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("mix_name", "source").agg(F.sum("t").alias("tokens_used"), F.sum("uses").alias("uses"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    x = plan.select("mix_name", "source", "target_share", "max_repeats", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens_available")).join(got, ["mix_name", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    total = F.sum(F.coalesce("tokens_used", F.lit(0))).over(Window.partitionBy("mix_name"))
    reached = F.coalesce(F.coalesce("tokens_used", F.lit(0)) / F.nullif(total, F.lit(0)), F.lit(0.0))
    return x.select("mix_name", "source", "target_share", reached.alias("actual_share"), zero("tokens_used"), zero("uses"), zero("documents"), zero("most_uses"), "max_repeats", "tokens_available", "budget")
