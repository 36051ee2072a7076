"""Queries of the knowledge-base operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowloom.functions import text as T
from knowloom.functions.parsing import parse_events
from knowloom.functions.vector import cosine_similarity
from knowloom.functions.versions import effective_version, safe_timestamp
from knowloom.operators import events as ev
from knowloom.operators import extraction, graph, memory, retrieval, vectors
from knowloom.operators.chunking import sliding_chunks
from knowloom.plans import workflow
from knowloom.queries import table
from knowloom.streaming import windows

BIG = "bigint"

# --- text -------------------------------------------------------------------------------------------------------------


def doc_identity(s, d):
    x = table(s, d, "documents")
    return x.select("doc_id", T.doc_identity(F.col("file_path")).alias("path_id"), T.doc_type(F.col("file_path")).alias("kind"))


def content_hashes(s, d):
    x = table(s, d, "raw_chunks")
    return x.select("chunk_id", T.content_hash(F.col("content")).alias("content_hash"), T.fingerprint(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("fingerprint"))


def chunk_documents(s, d):
    return sliding_chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_id", F.col("chunk_index").cast(BIG), F.col("char_start").cast(BIG), F.col("char_end").cast(BIG), "content")


def chunk_stats_by_lang(s, d):
    c = sliding_chunks(table(s, d, "documents"), "doc_id", "text", keep=["lang"])
    return c.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.sum(F.length("content")).cast(BIG).alias("chars"), F.countDistinct(T.content_hash(F.col("content"))).alias("contents"))


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_topk(s, d):
    e = table(s, d, "embeddings")
    r = vectors.exact_topk(e, e.where("vec_id % 50 = 0"), "vec_id", "vec_id")
    return r.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast(BIG))


def vector_similarity(s, d):
    """Cosine of each vector with the next one, as a column expression."""
    e = table(s, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("score"))


def ann_topk(s, d):
    e = table(s, d, "embeddings")
    return vectors.ann_topk(e, e.where("vec_id % 50 = 0"), "vec_id", "vec_id")


def ann_recall(s, d):
    """How the index does against brute force: the number of queries, and whether 0.9 of their true neighbours are met."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    true = vectors.exact_topk(e, q, "vec_id", "vec_id").select("query_id", "vec_id")
    met = true.join(vectors.ann_topk(e, q, "vec_id", "vec_id").select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_kept"))


def vector_upsert_latest(s, d):
    x = table(s, d, "chunk_snapshots").withColumn("hash", T.content_hash(F.col("content")))
    return vectors.upsert_latest(x, "chunk_id", ["snapshot_no"], ["snapshot_no", "doc_id", "hash"])


def _chunks(s, d):
    """Distinct vectors of the raw chunks."""
    x = table(s, d, "raw_chunks")
    return vectors.upsert_latest(x.withColumn("source", F.col("metadata.source")), "chunk_id", ["chunk_index"], ["doc_id", "chunk_index", "content", "source", "embedding"])


def _deleted_paths(s, d):
    x = table(s, d, "change_feed")
    return x.where(T.norm_token(F.col("change_type")) == "deleted").select(F.col("file_path").alias("source"))


def vector_delete_anti(s, d):
    return vectors.delete_by(_chunks(s, d), _deleted_paths(s, d), "source")[0].select("chunk_id", "doc_id")


def vector_deleted_counts(s, d):
    gone = vectors.delete_by(_chunks(s, d), _deleted_paths(s, d), "source")[1]
    return gone.groupBy("doc_id").agg(F.count("*").alias("deleted"))


def chunks_by_doc(s, d):
    """The chunks of every document in their order."""
    return vectors.chunks_in_order(_chunks(s, d)).select("doc_id", F.col("position").cast(BIG), "chunk_id", F.col("chunk_index").cast(BIG), "content")


def vector_stats(s, d):
    return vectors.store_stats(_chunks(s, d))


# --- extraction -------------------------------------------------------------------------------------------------------


def _responses(s, d):
    """A model's response per mention: fields that are null are missing; some are fenced, some broken."""
    x = table(s, d, "entity_records")
    e = F.struct(F.col("entity_name").alias("name"), F.col("entity_type").alias("type"), "description")
    j = F.to_json(F.struct(F.array(e).alias("entities")))
    raw = F.when(F.col("entity_id") % 7 == 3, F.lit("not json {")).when(F.col("entity_id") % 3 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).otherwise(j)
    return x.select("entity_id", "source_chunk_id", raw.alias("raw"))


def _mentions(s, d):
    return extraction.unnest(_responses(s, d), "source_chunk_id", "raw", ["entity_id"])[0]


def extract_parse_defaults(s, d):
    return _mentions(s, d).select("entity_id", "source_chunk_id", "name", "type", "description")


def extract_relations(s, d):
    """Relations of a model's responses: missing names, types and confidences get their defaults; a confidence may be text."""
    x = table(s, d, "entity_records")
    i = F.col("entity_id")
    r = F.struct(F.col("entity_name").alias("head"), F.when(i % 5 != 0, F.col("entity_type")).alias("relation"), F.col("description").alias("tail"), F.when(i % 4 == 1, (i % 10 / 10).cast("string")).when(i % 4 == 2, F.lit("high")).alias("confidence"))
    raw = x.select("entity_id", "source_chunk_id", F.to_json(F.struct(F.array(r).alias("relations"))).alias("raw"))
    return extraction.unnest(raw, "source_chunk_id", "raw", ["entity_id"])[1].select("entity_id", "head", "relation", "tail", F.round("confidence", 6).alias("confidence"))


def extract_dedup_first(s, d):
    m = _mentions(s, d)
    return extraction.first_wins(m, ["name", "type"], [F.col("source_chunk_id"), F.col("entity_id")], ["entity_id", "source_chunk_id", "name", "type"])


def extract_resolve_source(s, d):
    x = table(s, d, "entity_records").select("entity_id", "source_chunk_id")
    return extraction.resolve_source(x, "source_chunk_id", table(s, d, "raw_chunks"), F.lit("/unknown")).select("entity_id", "source")


# --- graph ------------------------------------------------------------------------------------------------------------


def _entity_log(s, d):
    m = table(s, d, "entity_records").select("entity_id", "source_chunk_id", "entity_name", "entity_type", "description", "extracted_at")
    m = extraction.resolve_source(m, "source_chunk_id", table(s, d, "raw_chunks"), F.lit("/unknown"))
    return m.select(
        T.entity_key(F.col("entity_name"), F.col("source")).alias("entity_key"), F.col("entity_name").alias("name"), F.col("entity_type").alias("type"), "description", "source",
        F.col("entity_id").alias("version"), F.col("source_chunk_id").alias("chunk_id"), F.col("entity_id").alias("seq"), F.col("extracted_at").alias("at"),
    )


def entity_keys(s, d):
    return _entity_log(s, d).select(F.col("version").alias("entity_id"), "entity_key", T.trimmed_key_part(F.col("name")).alias("plain_key"))


def entity_merge(s, d):
    return graph.merge_entities(_entity_log(s, d)).select("entity_key", "name", "type", "description", "source", "version", F.array_join("chunk_ids", ",").alias("chunk_ids"), "created_at", "updated_at")


def _supplies(s, d):
    x = table(s, d, "lineitem")
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rel = T.relation_type(F.when(F.col("l_returnflag") == "R", "took back").otherwise("supplies to"))
    return x.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("head_key"), rel.alias("rel_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tail_key"), F.col("l_discount").alias("confidence"), order.cast(BIG).alias("seq"))


def _known(s, d):
    a = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_key"))
    return a.unionByName(table(s, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_key")))


def edge_merge(s, d):
    return graph.merge_edges(_supplies(s, d), _known(s, d), ["confidence", "seq"])


def strict_edges(s, d):
    """Edges whose two ends were there before: suppliers and parts come one by one, in the order of their keys."""
    seen = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_key"), (F.col("s_suppkey") * 97).alias("first_seq"))
    seen = seen.unionByName(table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), (F.col("p_partkey") * 31).cast(BIG)).toDF("entity_key", "first_seq"))
    return graph.strict_edges(_supplies(s, d), seen).select("head_key", "rel_type", "tail_key", "seq")


def _places(s, d):
    """Regions, nations, suppliers and customers as a graph."""
    r, n, u, c = (table(s, d, t) for t in ("region", "nation", "supplier", "customer"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    ids = lambda col: F.array(F.concat(F.lit("c"), (F.col(col) % 3).cast("string")))
    node = lambda df, p, k, name, src: df.select(key(p, k).alias("entity_key"), F.col(name).alias("name"), F.lit(src).alias("type"), F.lit(src).alias("source"), ids(k).alias("chunk_ids"))
    ents = node(r, "r", "r_regionkey", "r_name", "region").unionByName(node(n, "n", "n_nationkey", "n_name", "nation")).unionByName(node(u, "s", "s_suppkey", "s_name", "supplier")).unionByName(node(c, "c", "c_custkey", "c_name", "customer"))
    edge = lambda df, p, k, rel, q, t, src: df.select(F.concat(key(p, k), F.lit("-"), key(q, t)).alias("edge_id"), key(p, k).alias("head_key"), F.lit(rel).alias("rel_type"), key(q, t).alias("tail_key"), F.lit(src).alias("source"), F.concat(F.lit("c"), (F.col(k) % 3).cast("string")).alias("chunk_id"))
    edges = edge(n, "n", "n_nationkey", "PART_OF", "r", "n_regionkey", "nation").unionByName(edge(u, "s", "s_suppkey", "BASED_IN", "n", "s_nationkey", "supplier")).unionByName(edge(c, "c", "c_custkey", "BASED_IN", "n", "c_nationkey", "customer"))
    return ents, edges


def graph_delete_source(s, d):
    e, r = _places(s, d)
    e, r = graph.delete_sources(e, r, s.createDataFrame([("nation",)], "source string"))
    return e.select(F.lit("entity").alias("what"), F.col("entity_key").alias("id")).unionByName(r.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


def graph_delete_chunks(s, d):
    e, r = _places(s, d)
    e, r = graph.delete_chunks(e, r, "supplier", ["c1", "c2"])
    return e.select(F.lit("entity").alias("what"), F.col("entity_key").alias("id")).unionByName(r.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


def graph_stats(s, d):
    return graph.stats(*_places(s, d))


def graph_neighbors_2hop(s, d):
    e, r = _places(s, d)
    n = graph.neighbours(e.select(F.col("entity_key").alias("start")), r)
    return n.select("start", F.col("depth").cast(BIG), F.array_join("rels", ">").alias("rels"), "neighbour", F.col("rn").cast(BIG))


def graph_contexts(s, d):
    e, r = _places(s, d)
    n = graph.neighbours(e.select(F.col("entity_key").alias("start")), r)
    a, b = e.select(F.col("entity_key").alias("start"), F.col("name").alias("n0")), e.select(F.col("entity_key").alias("neighbour"), F.col("name").alias("n1"), "type")
    return n.join(a, "start").join(b, "neighbour").select("start", F.col("rn").cast(BIG), T.graph_context_text(F.col("n0"), F.col("rels"), F.col("n1"), F.col("type")).alias("content"))


def _questions(s, d):
    return table(s, d, "entity_records").select("entity_id", "description")


def question_keywords(s, d):
    return graph.keywords(_questions(s, d), "entity_id", "description").select("entity_id", F.col("kw_ord").cast(BIG), "keyword")


def question_mode(s, d):
    return _questions(s, d).select("entity_id", T.question_mode(F.col("description")).alias("mode"), T.contains_han(F.col("description")).alias("han"))


def entity_search(s, d):
    """Keywords of every fiftieth description against all entities."""
    q = graph.keywords(_questions(s, d).where("entity_id % 50 = 0"), "entity_id", "description")
    e = graph.merge_entities(_entity_log(s, d)).select("entity_key", "name", "description")
    return graph.candidate_entities(q, "entity_id", e).select("entity_id", "entity_key", F.col("ord").cast(BIG))


# --- memory -----------------------------------------------------------------------------------------------------------


def _messages(s, d):
    x = table(s, d, "documents")
    return x.select(F.col("file_path").alias("session_id"), F.col("doc_id").alias("seq"), F.col("doc_type").alias("role"), F.col("text").alias("content"))


def memory_window(s, d):
    return memory.last_n(_messages(s, d), 5).select("session_id", "seq", F.col("rn").cast(BIG))


def memory_dedup(s, d):
    x = table(s, d, "event_messages").select(F.col("event_id").alias("session_id"), F.col("delivery_no").alias("seq"), F.col("status").alias("role"), F.col("failure_reason").alias("content"))
    return memory.without_repeats(memory.last_n(x, 20)).select("session_id", "seq", "role", "text")


def memory_context(s, d):
    return memory.contexts(_messages(s, d), read=6, max_context=700).select("session_id", "context", memory.has_context(F.col("context")).alias("there"))


# --- answering --------------------------------------------------------------------------------------------------------


def _qa(s, d):
    """Every fiftieth vector asks; its nearest vectors and some nations are the contexts."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.when(F.col("vec_id") % 100 == 0, "RELATIONSHIP").otherwise("DESCRIPTIVE").alias("mode"))
    v = vectors.exact_topk(e, e.where("vec_id % 50 = 0"), "vec_id", "vec_id").join(e.select("vec_id", "label"), "vec_id")
    v = v.select(F.col("query_id").alias("question_id"), F.lit("vector").alias("retrieval_type"), "rank", F.round("score", 6).alias("score"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("content"), F.concat(F.lit("S"), F.col("label").cast("string")).alias("source"))
    n = table(s, d, "nation")
    g = q.join(F.broadcast(n), F.col("n_nationkey") % 5 == F.col("question_id") / 50 % 7)  # 25 nations
    g = g.select("question_id", F.lit("graph").alias("retrieval_type"), F.col("n_nationkey").cast("int").alias("rank"), (F.lit(0.5) + F.col("n_nationkey") % 4 / F.lit(8.0)).alias("score"), F.col("n_name").alias("content"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("source"))
    return q, v.unionByName(g)


def hybrid_rerank(s, d):
    q, c = _qa(s, d)
    return retrieval.hybrid_rerank(q, c).select("question_id", F.col("position").cast(BIG), "retrieval_type", F.round("score", 6).alias("score"), "content")


def qa_confidence(s, d):
    q, c = _qa(s, d)
    r = retrieval.confidence(q, retrieval.hybrid_rerank(q, c))
    return r.select("question_id", F.round("confidence", 6).alias("confidence"))


def source_conflict(s, d):
    return retrieval.evidence(_qa(s, d)[1])


def qa_degrade_matrix(s, d):
    """All combinations of what is available and found."""
    x = table(s, d, "nation").where("n_nationkey < 16").select("n_nationkey")
    bit = lambda i: F.col("n_nationkey").bitwiseAND(1 << i) > 0
    r = retrieval.degradation(bit(0), bit(1), F.col("n_nationkey") % 3 != 0, F.when(bit(0) & bit(2), 5).otherwise(0), F.when(bit(1) & bit(3), 5).otherwise(0))
    return x.select("n_nationkey", r.alias("r")).select("n_nationkey", "r.outcome", "r.degraded", F.array_join("r.reasons", ",").alias("reasons"))


def qa_reasoning(s, d):
    q, c = _qa(s, d)
    x = q.join(retrieval.evidence(c), "question_id")
    t = retrieval.trail(F.col("mode"), F.lit(False), F.col("vectors"), F.col("graphs"), F.col("confident"), F.col("conflict"), F.col("vectors") + F.col("graphs"))
    return x.select("question_id", F.array_join(t, "\n").alias("trail"))


def qa_prompt(s, d):
    q, c = _qa(s, d)
    return retrieval.prompts(q.withColumn("memory", F.lit("(无)")), retrieval.hybrid_rerank(q, c), retrieval.evidence(c))


# --- change events ----------------------------------------------------------------------------------------------------


def event_parse(s, d):
    x = parse_events(table(s, d, "event_messages").select("delivery_no", "payload"), now=F.timestamp_millis(F.lit(0)))
    return x.select("delivery_no", "valid", *[F.when(F.col("valid"), F.col(f"event.{c}")).alias(c) for c in ("event_id", "file_path", "change_type", "document_version", "change_version", "event_ts", "source_type")])


def dead_letters(s, d):
    bad = ev.split_poison(parse_events(table(s, d, "event_messages").select("delivery_no", "payload"), now=F.timestamp_millis(F.lit(0))))[1]
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def _feed(s, d):
    """The feed's supported changes, one per event id, with effective versions."""
    x = table(s, d, "change_feed")
    kind = F.when(F.col("change_type").isNull(), "modified").otherwise(T.norm_token(F.col("change_type")))
    x = x.select(F.col("feed_no").alias("seq"), "event_id", "file_path", kind.alias("change_type"), effective_version(F.col("change_version"), F.col("document_version")).alias("version"), "event_ts")
    return x.where(F.col("change_type").isin(*ev.KINDS) & (T.strip_ws(F.col("file_path")) != ""))


def event_dedup(s, d):
    return ev.first_arrivals(_feed(s, d)).select("seq", "event_id", "file_path")


def version_gate(s, d):
    x = ev.version_gate(ev.first_arrivals(_feed(s, d).where("version is not null")))
    return x.select("seq", "file_path", "version", "last_version", "stale")


def timestamp_gate(s, d):
    return ev.timestamp_gate(ev.first_arrivals(_feed(s, d))).select("seq", "file_path", safe_timestamp(F.col("event_ts")).alias("ts"), "last_ts", "stale")


def version_assign(s, d):
    return ev.assign_versions(ev.first_arrivals(_feed(s, d))).select("seq", "file_path", "assigned")


def replay_gate(s, d):
    return ev.replay_gate(_feed(s, d))


def skip_reason_counts(s, d):
    return ev.outcome_counts(ev.replay_gate(_feed(s, d)))


def _pairs(s, d):
    """(old, new): all snapshots, each as the older and as the newer one of a pair, which has the newer one's number."""
    x = table(s, d, "chunk_snapshots").select("snapshot_no", "chunk_id", "chunk_index", "content")
    no = x.select("snapshot_no").distinct()
    nxt = no.withColumn("pair", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).where("pair is not null")  # a row per delivery
    new = nxt.select(F.col("pair").alias("snapshot_no"), "pair")
    return x.join(nxt, "snapshot_no").drop("snapshot_no"), x.join(new, "snapshot_no").drop("snapshot_no")


def chunk_diff(s, d):
    return ev.chunk_diff(*_pairs(s, d), ["pair"])


def stale_chunks(s, d):
    old, new = _pairs(s, d)
    return ev.stale_chunks(ev.chunk_diff(old, new, ["pair"]), old, new, ["pair"]).select("pair", "chunk_id", F.col("phase").cast(BIG), F.col("chunk_index").cast(BIG))


def _ledger(s, d):
    return table(s, d, "event_messages").select("event_id", "file_path", F.col("event_version").alias("version"), "status", "event_ts", "failure_reason", "payload", F.col("delivery_no").alias("seq"), "received_at")


def ledger_latest(s, d):
    return ev.ledger_state(_ledger(s, d)).select("event_id", "status", "seq")


def ledger_watermarks(s, d):
    return ev.watermarks(_ledger(s, d))


def unprocessed_events(s, d):
    return ev.unprocessed(table(s, d, "change_feed").select("feed_no", "event_id"), _ledger(s, d))


def replayable_events(s, d):
    return ev.replayable(_ledger(s, d)).select("event_id", "seq", "payload")


def ledger_retention(s, d):
    x = _ledger(s, d)
    return ev.within_ttl(x, "received_at", F.lit("2025-01-15 00:00:00").cast("timestamp"), 168).select("seq")


# --- workflow ---------------------------------------------------------------------------------------------------------


def workflow_transitions(s, d):
    """The ledger's statuses of each event in order of arrival, judged."""
    x = _ledger(s, d).where("event_id is not null and trim(event_id) <> ''")
    return workflow.transitions(x, "event_id", "status", "seq", workflow.LEDGER).select("event_id", "seq", "before", "status", "legal")


def retry_attempts(s, d):
    x = _ledger(s, d).where("event_id is not null")
    return workflow.retry_counts(x, "event_id", "status").select("event_id", "status", F.col("retries").cast(BIG))


def ingest_summary(s, d):
    c = _chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    r = table(s, d, "raw_chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"))
    e = table(s, d, "entity_records").join(r, F.col("source_chunk_id") == F.col("chunk_id")).groupBy("doc_id").agg(F.count("*").alias("entities"))
    return c.join(e, "doc_id", "left").select("doc_id", "chunks", F.coalesce("entities", F.lit(0)).cast(BIG).alias("entities"))


# --- event time -------------------------------------------------------------------------------------------------------


def events_tumbling(s, d):
    return windows.tumbling(table(s, d, "events"), "ts", "1 hour", ["event_type"], "value").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(s, d):
    return windows.sliding(table(s, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"])


def events_session(s, d):
    return windows.sessions(table(s, d, "events"), "ts", "30 minutes", "user_id").select("user_id", "session_start", "session_end", "n")


def queries():
    return {
        f.__name__: f
        for f in (
            doc_identity, content_hashes, chunk_documents, chunk_stats_by_lang, vector_topk, vector_similarity, ann_topk, ann_recall, vector_upsert_latest, vector_delete_anti, vector_deleted_counts,
            chunks_by_doc, vector_stats, extract_parse_defaults, extract_relations, extract_dedup_first, extract_resolve_source, entity_keys, entity_merge, edge_merge, strict_edges, graph_delete_source, graph_delete_chunks,
            graph_stats, graph_neighbors_2hop, graph_contexts, question_keywords, question_mode, entity_search, memory_window, memory_dedup, memory_context, hybrid_rerank, qa_confidence,
            source_conflict, qa_degrade_matrix, qa_reasoning, qa_prompt, event_parse, dead_letters, event_dedup, version_gate, timestamp_gate, version_assign, replay_gate, skip_reason_counts,
            chunk_diff, stale_chunks, ledger_latest, ledger_watermarks, unprocessed_events, replayable_events, ledger_retention, workflow_transitions, retry_attempts, ingest_summary,
            events_tumbling, events_sliding, events_session,
        )
    }


def oracle_sql():
    from knowloom.queries.knowledge_sql import SQL

    return SQL
