"""Session memory: retention, read window, consecutive duplicates, context within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions.text import normalize_message, strip_ctrl

KEEP, READ, MAX_CONTEXT, MAX_MESSAGE, TTL_HOURS = 20, 10, 2000, 300, 48
EMPTY = "(无)"


def last_n(messages: DataFrame, n: int, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The last n messages of each session (rank rn from the end); sessions that are null or blank have no memory.

    Spark applies the limit on the map side too, so a session with a third of all messages sends n rows per task.
    """
    w = Window.partitionBy(session).orderBy(F.desc(seq))
    return messages.where(strip_ctrl(F.col(session)) != "").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def without_repeats(messages: DataFrame, max_message: int = MAX_MESSAGE) -> DataFrame:
    """Messages with `text` normalised; blank ones and those equal in role and text to the one before dropped."""
    x = messages.withColumn("text", normalize_message(F.col("content"), max_message)).where("text <> ''")
    fp = F.concat(F.coalesce("role", F.lit("null")), F.lit("::"), F.col("text"))
    w = Window.partitionBy("session_id").orderBy("seq")
    return x.withColumn("fp", fp).withColumn("before", F.lag("fp").over(w)).where("before is null or before <> fp").drop("fp", "before")


def contexts(messages: DataFrame, read: int = READ, max_context: int = MAX_CONTEXT, max_message: int = MAX_MESSAGE) -> DataFrame:
    """(session_id, context): `role: text` lines, oldest first, while they fit the budget.

    The first line over the budget ends the list; if it is the very first, it is cut to the budget. Windows run over the
    `read` last messages of a session, whatever its length.
    """
    x = without_repeats(last_n(messages, read), max_message).withColumn("line", F.concat(F.coalesce("role", F.lit("null")), F.lit(": "), F.col("text"), F.lit("\n")))
    w = Window.partitionBy("session_id").orderBy("seq")
    x = x.withColumn("k", F.row_number().over(w)).withColumn("cum", F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where((F.col("cum") <= max_context) | (F.col("k") == 1)).withColumn("line", F.when(F.col("k") == 1, F.substring("line", 1, max_context)).otherwise(F.col("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"])
    got = x.groupBy("session_id").agg(strip_ctrl(F.array_join(lines, "")).alias("context"))
    sessions = messages.select("session_id").where(strip_ctrl(F.col("session_id")) != "").distinct()
    return sessions.join(got, "session_id", "left").withColumn("context", F.coalesce("context", F.lit(EMPTY)))


def has_context(c):
    """Neither blank nor the mark of an empty memory."""
    return F.coalesce((strip_ctrl(c) != "") & (c != EMPTY), F.lit(False))


def retained(messages: DataFrame, now, ttl_hours: int = TTL_HOURS, keep: int = KEEP) -> DataFrame:
    """What a store keeps: the last `keep` messages of sessions whose latest message is younger than the TTL (it slides)."""
    live = messages.groupBy("session_id").agg(F.max("ts").alias("latest")).where(F.col("latest") > now - F.expr(f"interval {ttl_hours} hours")).select("session_id")
    return last_n(messages.join(live, "session_id", "left_semi"), keep).drop("rn")
