"""Hybrid retrieval: weighting, ranking, confidence, conflicts, degradation, prompts, reasoning trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights and thresholds of the ranking, and the words of trails and prompts.
WEIGHTS = {"RELATIONSHIP": (0.80, 1.40), "DESCRIPTIVE": (1.20, 0.90)}
FEW_GRAPH, FEW_GRAPH_BOOST, HIGH_CONFIDENCE, LOW_GRAPH_PENALTY, TOP_CONTEXTS = 2, 1.05, 0.8, 0.95, 8
VECTOR_DOWN, GRAPH_DOWN, MEMORY_DOWN = "VECTOR_UNAVAILABLE", "GRAPH_UNAVAILABLE", "MEMORY_UNAVAILABLE"
CONFLICT_HINT = "[CONFLICT_HINTS]\nVector and graph contexts disagree on the leading source. Prefer conservative answers and cite evidence.\n\n"
MEMORY_THERE = "MEMORY_LOADED: short-term memory loaded"
MEMORY_MISSING = "MEMORY_LOADED: no short-term memory available"
GRAPH_LOW = "GRAPH_EVIDENCE_LOW: vector contexts retained as supplement"
GRAPH_BACKGROUND = "GRAPH_BACKGROUND_RETAINED: high-confidence entity matched"
SOURCE_CONFLICT = "SOURCE_CONFLICT: vector and graph point to different leading sources"
CONTEXT_MIXED = "CONTEXT_MIXED: vector+graph"
ANSWERED = "ANSWER_GENERATED"


def evidence(contexts: DataFrame) -> DataFrame:
    """Per question what its contexts are: numbers, whether the graph is confident, whether the leading sources conflict.

    contexts: question_id, retrieval_type (vector or graph), rank, score, content, source. Sources are compared without case;
    a null source is the word null. Questions without contexts aren't there.
    """
    is_v, is_g = F.col("retrieval_type") == "vector", F.col("retrieval_type") == "graph"
    lead = lambda c: F.lower(F.min(F.when(c, F.struct("rank", F.coalesce("source", F.lit("null")).alias("source"))))["source"])
    x = contexts.groupBy("question_id").agg(
        F.count_if(is_v).alias("vectors"), F.count_if(is_g).alias("graphs"),
        F.coalesce(F.bool_or(is_g & (F.col("score") >= HIGH_CONFIDENCE)), F.lit(False)).alias("confident"),
        lead(is_v).alias("vs"), lead(is_g).alias("gs"),
    )
    return x.select("question_id", "vectors", "graphs", "confident", ((F.col("vectors") > 0) & (F.col("graphs") > 0) & F.coalesce(F.col("vs") != F.col("gs"), F.lit(False))).alias("conflict"))


def hybrid_rerank(questions: DataFrame, contexts: DataFrame, top: int = TOP_CONTEXTS) -> DataFrame:
    """(question_id, position, retrieval_type, rank, score, content, source): the best contexts after weighting.

    questions: question_id, mode. Equal scores keep the order vector before graph, then rank.
    """
    x = contexts.join(evidence(contexts), "question_id").join(questions.select("question_id", "mode"), "question_id")
    rel, vec = F.col("mode") == "RELATIONSHIP", F.col("retrieval_type") == "vector"
    r, d = WEIGHTS["RELATIONSHIP"], WEIGHTS["DESCRIPTIVE"]
    s = F.col("score")
    vector = F.when(rel, s * r[0]).otherwise(s * d[0])
    vector = F.when(rel & (F.col("graphs") < FEW_GRAPH), vector * FEW_GRAPH_BOOST).otherwise(vector)
    graph = F.when(rel, s * r[1]).otherwise(s * d[1])
    graph = F.when(~rel & ~F.col("confident"), graph * LOW_GRAPH_PENALTY).otherwise(graph)
    x = x.withColumn("score", F.when(vec, vector).otherwise(graph))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.when(vec, 0).otherwise(1), "rank")
    x = x.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
    return x.select("question_id", "position", "retrieval_type", "rank", "score", "content", "source")


def confidence(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question_id, confidence): mean score of the kept contexts, at most 1; 0 without contexts."""
    c = ranked.groupBy("question_id").agg(F.avg("score").alias("a"))
    return questions.select("question_id").join(c, "question_id", "left").select("question_id", F.least(F.coalesce("a", F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def degradation(vector_ok: Column, graph_ok: Column, memory_ok: Column, vectors: Column, graphs: Column) -> Column:
    """struct<outcome, degraded, reasons>: a failed path is borne unless the other one has nothing either."""
    abort = (~vector_ok & (graphs == 0)) | (~graph_ok & (vectors == 0))
    reasons = F.filter(F.array(F.when(~memory_ok, MEMORY_DOWN), F.when(~vector_ok, VECTOR_DOWN), F.when(~graph_ok, GRAPH_DOWN)), lambda r: r.isNotNull())
    return F.struct(F.when(abort, "FAILED").otherwise("COMPLETED").alias("outcome"), (F.size(reasons) > 0).alias("degraded"), reasons.alias("reasons"))


def trail(mode: Column, has_memory: Column, vectors: Column, graphs: Column, confident: Column, conflict: Column, ranked: Column) -> Column:
    """The reasoning steps in order."""
    rel = mode == "RELATIONSHIP"
    weights = lambda m: f"WEIGHTS: vector={WEIGHTS[m][0]}, graph={WEIGHTS[m][1]}"
    steps = [
        F.concat(F.lit("QUESTION_MODE: "), mode),
        F.when(has_memory, MEMORY_THERE).otherwise(MEMORY_MISSING),
        F.concat(F.lit("VECTOR_RETRIEVED: "), vectors.cast("string")),
        F.concat(F.lit("GRAPH_RETRIEVED: "), graphs.cast("string")),
        F.when(rel, weights("RELATIONSHIP")).otherwise(weights("DESCRIPTIVE")),
        F.when(rel & (graphs < FEW_GRAPH) & (vectors > 0), GRAPH_LOW),
        F.when(~rel & confident, GRAPH_BACKGROUND),
        F.when(conflict, SOURCE_CONFLICT),
        F.when((vectors > 0) & (graphs > 0), CONTEXT_MIXED),
        F.concat(F.lit("RERANKED: "), ranked.cast("string")),
        F.lit(ANSWERED),
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def prompts(questions: DataFrame, ranked: DataFrame, ev: DataFrame) -> DataFrame:
    """(question_id, prompt) from questions (question_id, memory): sections memory, vector, graph, conflict; empty ones left out."""
    def section(kind: str, header: str) -> Column:
        rows = F.filter("ctx", lambda c: c["retrieval_type"] == kind)
        line = lambda c, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(c["source"], F.lit("null")), F.lit(" | Score: "), F.format_string("%.2f", c["score"]), F.lit("]\n"), F.coalesce(c["content"], F.lit("null")), F.lit("\n\n"))
        return F.when(F.size(rows) > 0, F.concat(F.lit(f"[{header}]\n"), F.array_join(F.transform(rows, line), ""))).otherwise("")

    ctx = ranked.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "retrieval_type", "score", "content", "source"))).alias("ctx"))
    x = questions.select("question_id", "memory").join(ctx, "question_id", "left").join(ev.select("question_id", "conflict"), "question_id", "left")
    x = x.withColumn("ctx", F.coalesce("ctx", F.array().cast(ctx.schema["ctx"].dataType)))
    memory = F.when(F.coalesce(F.trim("memory"), F.lit("")).isin("", "(无)"), "").otherwise(F.concat(F.lit("[MEMORY]\n"), F.col("memory"), F.lit("\n\n")))
    return x.select("question_id", F.concat(memory, section("vector", "VECTOR_CONTEXTS"), section("graph", "GRAPH_CONTEXTS"), F.when(F.coalesce("conflict", F.lit(False)), CONFLICT_HINT).otherwise("")).alias("prompt"))
