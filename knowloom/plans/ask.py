"""Answering a table of questions: memory, vector and graph retrieval, ranking, prompts, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import graph_context_text, question_mode
from knowloom.operators import graph, memory, retrieval
from knowloom.operators.vectors import VECTOR_BLOCK, ann_topk, exact_topk
from knowloom.plans.workflow import ATTEMPTS, QA, Run
from knowloom.session import materialize

GRAPH_SCORE = 0.8


def graph_contexts(questions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, retrieval_type, rank, score, content, source) from keyword hits and their neighbourhoods."""
    kw = graph.keywords(questions, "question_id", "question")
    cand = graph.candidate_entities(kw, "question_id", entities)
    near = graph.neighbours(cand.select(F.col("entity_key").alias("start")), edges)
    e = entities.select("entity_key", "name", "type", "source")
    x = cand.join(near, F.col("entity_key") == F.col("start")).join(e.select(F.col("entity_key").alias("start"), F.col("name").alias("n0"), "source"), "start").join(e.select(F.col("entity_key").alias("neighbour"), F.col("name").alias("n1"), F.col("type").alias("t1")), "neighbour")
    text = graph_context_text(F.col("n0"), F.col("rels"), F.col("n1"), F.col("t1"))
    return x.select("question_id", F.lit("graph").alias("retrieval_type"), (F.col("ord") * 1_000 + F.col("rn")).cast("int").alias("rank"), F.lit(GRAPH_SCORE).alias("score"), text.alias("content"), "source")


def vector_contexts(questions: DataFrame, vectors: DataFrame, embed, k: int = 5) -> DataFrame:
    """As graph_contexts, from the k most similar chunks. vectors: chunk_id, content, source, embedding.

    Stores of more than one block are searched by an index (recall 0.95 on its sample), as every question against every vector
    would grow with both.
    """
    q = questions.select("question_id", embed(F.col("question")).alias("embedding"))
    v = materialize(vectors.withColumn("vid", F.xxhash64("chunk_id")), "vectors")
    search = exact_topk if v.count() <= VECTOR_BLOCK else ann_topk
    hits = search(v, q, "vid", "question_id", k=k, skip_self=False)
    return hits.join(v.select("vid", "content", "source"), F.col("vec_id") == F.col("vid")).select(F.col("query_id").alias("question_id"), F.lit("vector").alias("retrieval_type"), "rank", "score", "content", "source")


def ask(questions: DataFrame, vectors: DataFrame | None, entities: DataFrame | None, edges: DataFrame | None, messages: DataFrame | None, embed, answer) -> DataFrame:
    """One result row per question (question_id, session_id, question); blank questions are left out.

    A retrieval source that is None is unavailable: the answer degrades if the other has something, else the row fails.
    Memory is what was there before: turns are appended by the caller after this.
    """
    q = questions.where("trim(question) <> ''").withColumn("mode", question_mode(F.col("question")))
    mem = memory.contexts(messages).withColumnRenamed("context", "memory") if messages is not None else None
    q = q.join(mem, "session_id", "left") if mem is not None else q.withColumn("memory", F.lit(None).cast("string"))
    q = materialize(q, "questions")
    parts = []
    if vectors is not None:
        parts.append(vector_contexts(q, vectors, embed))
    if entities is not None and edges is not None:
        parts.append(graph_contexts(q, entities, edges))
    empty = q.sparkSession.createDataFrame([], "question_id bigint, retrieval_type string, rank int, score double, content string, source string")
    ctx = materialize(parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else empty, "contexts")
    ranked = materialize(retrieval.hybrid_rerank(q, ctx), "ranked")
    ev = retrieval.evidence(ctx)
    x = q.join(ev, "question_id", "left").na.fill({"vectors": 0, "graphs": 0, "confident": False, "conflict": False})
    x = x.join(ranked.groupBy("question_id").agg(F.count("*").alias("kept"), F.array_sort(F.collect_list(F.struct("position", "content", "source", "score", "retrieval_type"))).alias("contexts")), "question_id", "left")
    x = x.join(retrieval.confidence(q, ranked), "question_id").join(retrieval.prompts(q, ranked, ev), "question_id")
    d = retrieval.degradation(F.lit(vectors is not None), F.lit(entities is not None), F.lit(messages is not None), F.col("vectors"), F.col("graphs"))
    steps = retrieval.trail(F.col("mode"), memory.has_context(F.col("memory")), F.col("vectors"), F.col("graphs"), F.col("confident"), F.col("conflict"), F.col("vectors") + F.col("graphs"))
    x = x.withColumn("d", d).withColumn("answer", F.when(F.col("d.outcome") == "COMPLETED", answer(F.col("prompt"))))
    return x.select("question_id", "session_id", "question", "answer", "confidence", F.lower("mode").alias("intent"), "d.degraded", F.col("d.reasons").alias("degrade_reasons"), F.col("d.outcome").alias("workflow_state"), "contexts", F.concat(F.array(F.lit("QUESTION_RECEIVED: question accepted")), steps).alias("reasoning_steps"))


def ask_workflow(questions: DataFrame, vectors, entities, edges, load_messages, append_turns, embed, answer, batch: int, attempts: int = ATTEMPTS) -> tuple[DataFrame, Run]:
    """(results, run): a batch of questions through the states of the question workflow, with retries, and memory written after.

    load_messages gives the sessions' messages; if it fails in all attempts, the answers degrade to empty memory. append_turns
    stores (session_id, seq, role, content, ts), the question and the answer of each session that isn't blank, only after the
    answers are there; `batch` rises from call to call. If answering fails in all attempts, nothing is stored and the error raised.
    """
    run, messages = Run(QA), None
    run.reasoning.append("QUESTION_RECEIVED: question accepted")
    try:
        try:
            messages = run.step("memory-load", load_messages, attempts)
            loaded = "MEMORY_LOADED: short-term memory loaded"
        except Exception:  # noqa: BLE001
            run.degrade(retrieval.MEMORY_DOWN)
            loaded = "MEMORY_LOADED: degraded because memory loading failed"
        run.to("MEMORY_LOADED")
        run.reasoning.append(loaded)
        got = run.step("qa-answer", lambda: materialize(ask(questions, vectors, entities, edges, messages, embed, answer), "answers"), attempts)
        for state, text in (("RETRIEVAL_COMPLETED", "retrieval and reranking finished"), ("ANSWER_GENERATED", "answer generated")):
            run.to(state)
            run.reasoning.append(f"{state}: {text}")
        named = got.where((F.trim("session_id") != "") & F.col("answer").isNotNull())
        turn = lambda role, content, n: named.select("session_id", (F.lit(batch).cast("bigint") * (1 << 40) + F.col("question_id") * 2 + n).alias("seq"), F.lit(role).alias("role"), F.col(content).alias("content"), F.current_timestamp().alias("ts"))
        append_turns(turn("user", "question", 0).unionByName(turn("assistant", "answer", 1)))
        run.to("COMPLETED")
        run.reasoning.append("COMPLETED: workflow finished")
    except Exception as e:
        run.reasoning.append(f"FAILED: {type(e).__name__}")
        run.to("FAILED")
        raise
    no_session = F.coalesce(F.trim("session_id"), F.lit("")) == ""
    steps = F.array(*[F.when(no_session, "MEMORY_LOADED: no session id, skip memory loading").otherwise(s) if s == loaded else F.lit(s) for s in run.reasoning])
    return got.withColumn("reasoning_steps", F.concat(steps, F.expr("slice(reasoning_steps, 2, size(reasoning_steps))"))), run
