"""Ingest: documents to chunks, vectors, snapshot and graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import doc_type, entity_key, relation_type
from knowloom.operators.chunking import sliding_chunks
from knowloom.operators.extraction import first_wins, unnest
from knowloom.plans.workflow import INGEST, Run
from knowloom.session import materialize
from knowloom.sources.stores import GraphStore, Log, SnapshotStore


@dataclass
class Stores:
    vectors: Log
    snapshots: SnapshotStore
    graph: GraphStore


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks (CHUNK schema without vectors) of documents (doc_id, path, text)."""
    c = sliding_chunks(docs, "doc_id", "text", keep=["path"])
    return c.select("chunk_id", "doc_id", "chunk_index", "content", doc_type(F.col("path")).alias("doc_type"), F.struct(F.col("path").alias("source"), "char_start", "char_end").alias("metadata"))


def knowledge(chunks: DataFrame, extract, versions: DataFrame | None = None, track_all_mentions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entity log, edge log) of chunks: extraction, first-wins distinct over the batch, keys, versions (source, version; else 1).

    An entity or relation counts only in the first chunk that names it, unless track_all_mentions.
    """
    raw = chunks.select("chunk_id", "doc_id", "chunk_index", F.col("metadata.source").alias("source"), extract(F.col("content")).alias("raw"))
    raw = materialize(raw, "extracted")
    e, r = unnest(raw, "chunk_id", "raw", ["doc_id", "chunk_index", "source"])
    order = [F.col("doc_id"), F.col("chunk_index"), F.col("pos")]
    if not track_all_mentions:
        e = first_wins(e, ["name", "type"], order, e.columns)
        r = first_wins(r, ["head", "relation", "tail"], order, r.columns)
    v = (lambda x: x.withColumn("version", F.lit(1).cast("bigint"))) if versions is None else (lambda x: x.join(versions, "source", "left").withColumn("version", F.coalesce("version", F.lit(1).cast("bigint"))))
    seq = F.col("chunk_index").cast("bigint") * 100_000 + F.col("pos")
    ents = v(e).select(entity_key(F.col("name"), F.col("source")).alias("entity_key"), "name", "type", "description", "source", "version", F.col("source_chunk_id").alias("chunk_id"), seq.alias("seq"), F.current_timestamp().alias("at"))
    edges = v(r).select(entity_key(F.col("head"), F.col("source")).alias("head_key"), relation_type(F.col("relation")).alias("rel_type"), entity_key(F.col("tail"), F.col("source")).alias("tail_key"), "confidence", "source", F.col("source_chunk_id").alias("chunk_id"), "version", F.current_timestamp().alias("updated_at"), seq.alias("seq"))
    return ents, edges


def ingest(docs: DataFrame, stores: Stores, extract, embed, seq: int) -> tuple[Run, dict]:
    """Run the ingest workflow over a table of documents. A vector failure aborts; a snapshot or graph failure degrades."""
    run, counts = Run(INGEST), {"chunks": 0, "entities": 0, "relations": 0}
    try:
        chunks = run.step("parse", lambda: materialize(chunk_documents(docs), "chunks"))
        run.to("PARSED")
        counts["chunks"] = chunks.count()
        run.to("CHUNKED")
        ents, edges = run.step("extract", lambda: tuple(materialize(x, "knowledge") for x in knowledge(chunks, extract)))
        counts["entities"], counts["relations"] = ents.count(), edges.count()
        run.to("EXTRACTED")
        run.step("vector-store", lambda: stores.vectors.append(chunks.withColumn("embedding", embed(F.col("content"))), seq))
        run.to("VECTOR_STORED")
        try:
            run.step("snapshot-store", lambda: stores.snapshots.save(chunks))
        except Exception:  # noqa: BLE001
            run.degrade("SNAPSHOT_UNAVAILABLE")
        run.to("SNAPSHOT_STORED")
        try:
            run.step("graph-store", lambda: stores.graph.upsert(ents, edges))
        except Exception:  # noqa: BLE001
            run.degrade("GRAPH_UNAVAILABLE")
        run.to("GRAPH_STORED")
        run.to("COMPLETED")
    except Exception as e:
        run.reasoning.append(f"FAILED: {type(e).__name__}")
        run.to("FAILED")
        raise
    return run, counts
