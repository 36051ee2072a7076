"""Change events applied to the stores, a batch of files at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.parsing import parse_events
from knowloom.functions.text import doc_identity
from knowloom.functions.versions import effective_version
from knowloom.operators.events import chunk_diff, numbered, replay_gate, replayable, split_poison, unprocessed, watermarks
from knowloom.plans.ingest import Stores, chunk_documents, knowledge
from knowloom.plans.workflow import ATTEMPTS, Run
from knowloom.session import materialize
from knowloom.sources.events import dead_letter
from knowloom.sources.stores import Log
from knowloom.streaming.gate import run_to_end

#: Fixed value: seconds between two attempts to apply a batch of events.
REDELIVERY_S = 1.0


def gate_batch(raw: DataFrame, dead: str | None = None) -> DataFrame:
    """(row, seq, file_path, event_id, change_type, outcome, assigned) of raw events (payload, seq); poison goes to `dead`.

    row is the event's unique number by seq, so that equal seqs don't mix events.
    """
    good, bad = split_poison(parse_events(raw))
    if dead:
        dead_letter(bad, dead)
    ev = good.select("seq", "payload", "event.*").withColumn("version", effective_version(F.col("change_version"), F.col("document_version")))
    ev = materialize(numbered(ev, "seq", "event_id", "payload"), "events")
    return replay_gate(ev, "row").join(ev.select("row", "seq", "change_type"), "row")


def process_batch(raw: DataFrame, contents: Callable[[DataFrame], DataFrame], stores: Stores, ledger: Log, extract, embed, batch: int, dead: str | None = None, attempts: int = ATTEMPTS) -> dict:
    """One batch of raw events (payload, seq), from text to stores and ledger; `batch` numbers rise from batch to batch.

    Poison is dead-lettered. Events that succeeded before are skipped, the others go through the gate from where the ledger
    has their files. Every event leaves its transitions in the ledger; files advance only with SUCCEEDED ones, so a failed
    batch can be replayed: see replay; its payloads go to the dead letters as well, once all attempts are used up. Applying the
    same batch twice changes nothing the second time. Returns the number of events by outcome and the counters of apply_changes.
    """
    good, bad = split_poison(parse_events(raw))
    if dead:
        dead_letter(bad, dead)
    v = effective_version(F.col("event.change_version"), F.col("event.document_version"))
    ev = good.select("seq", "payload", "event.event_id", "event.file_path", "event.change_type", "event.event_ts", v.alias("version"))
    ev = materialize(numbered(ev, "seq", "event_id", "payload"), "events")
    past = ledger.history()
    todo = unprocessed(ev, past)
    out = materialize(replay_gate(todo, "row", watermarks(past)).select("row", "outcome", "assigned").join(ev.withColumn("arrival", F.col("row")), "row"), "outcomes")
    mark = lambda rows, status, step, why=None: ledger.append(rows.withColumn("version", F.coalesce("version", F.lit(None).cast("bigint"))).withColumn("status", F.lit(status)).withColumn("failure_reason", F.lit(why)).withColumn("processed_at", F.current_timestamp()), batch * 4 + step)
    applied = out.where("outcome = 'applied'")
    mark(out.where("outcome <> 'duplicate'"), "RECEIVED", 0)
    mark(applied, "PROCESSING", 1)
    counts = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
    try:
        done = Run(["CHANGES", "COMPLETED"]).step("apply", lambda: apply_changes(last_changes(out), contents, stores, extract, embed, batch * 4), attempts, REDELIVERY_S)
        mark(applied, "SUCCEEDED", 2)
        counts |= done or {}
    except Exception as e:  # noqa: BLE001
        why = f"{type(e).__name__}: {e}"[:500]
        mark(applied, "FAILED", 2, why)
        if dead:
            dead_letter(applied.select("payload", F.lit(f"attempts exhausted: {why}").alias("reason")), dead)
        counts["failed"] = counts.pop("applied", 0)
    return counts


def replay(ledger: Log) -> DataFrame:
    """(payload, seq) of failed events in the order in which they first arrived, to be given to process_batch again.

    Ledgers of before arrivals were kept have the batch only; in it, time and id decide.
    """
    past = ledger.history()
    first = past.where("status = 'RECEIVED'").groupBy("event_id").agg(F.min(F.struct("seq", "arrival")).alias("first"))
    failed = replayable(past).join(first, "event_id", "left")
    return numbered(failed, "first", "event_ts", "event_id", name="n").select("payload", F.col("n").alias("seq"))


def stream_changes(stream: DataFrame, contents, stores: Stores, ledger: Log, extract, embed, checkpoint: str, dead: str) -> None:
    """Process a stream of raw events (payload, seq) to its present end, a micro-batch at a time."""
    run_to_end(stream, lambda df, i: process_batch(df, contents, stores, ledger, extract, embed, i + 1, dead), checkpoint)


def last_changes(outcomes: DataFrame) -> DataFrame:
    """(file_path, change_type, version): the last applied event of each file; what the batch did before is overwritten by it."""
    m = F.max(F.struct("row", "change_type", "assigned"))
    return outcomes.where("outcome = 'applied'").groupBy("file_path").agg(m.alias("m")).select("file_path", "m.change_type", F.col("m.assigned").alias("version"))


def apply_changes(changes: DataFrame, contents: Callable[[DataFrame], DataFrame], stores: Stores, extract, embed, seq: int) -> dict:
    """Bring vectors, graph and snapshots of the changed files (file_path, change_type, version) up to date.

    contents gives (path, text) of files. Of a modified document only chunks whose content changed are embedded and extracted
    again; chunks that are gone or changed are taken out first. A document without chunks loses its snapshot. What a document was
    is told by its snapshot, or where that is gone by its vectors. Failing leaves the event unapplied, as its state is only
    stored after this returns. Returns counters: files, chunks changed, removed and unchanged, vectors and relations, seconds.
    """
    began = time.monotonic()
    ch = materialize(changes.withColumn("doc_id", doc_identity(F.col("file_path"))), "changes")
    gone, live = ch.where("change_type = 'deleted'"), ch.where("change_type <> 'deleted'")
    docs = contents(live.select("file_path")).select(doc_identity(F.col("path")).alias("doc_id"), "path", "text")
    new = materialize(chunk_documents(docs), "newchunks")
    kept = stores.snapshots.of(live).join(live.select("doc_id"), "doc_id", "left_semi").select(*new.columns)
    lost = live.select("doc_id").join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    old = materialize(kept.unionByName(stores.vectors.current().join(lost, "doc_id", "left_semi").select(*new.columns)), "oldchunks")
    diff = materialize(chunk_diff(old, new), "diff")
    stale = diff.where("change = 'removed'").join(old, "chunk_id").unionByName(diff.where("change = 'changed'").join(old, "chunk_id", "inner")).select(F.col("metadata.source").alias("source"), "chunk_id")
    fresh = materialize(new.join(diff.where("change = 'changed'"), "chunk_id", "left_semi"), "fresh")
    stores.vectors.delete(stale, seq)
    stores.graph.delete_chunks(stale)
    stores.vectors.append(fresh.withColumn("embedding", embed(F.col("content"))), seq + 1)
    ents, edges = knowledge(fresh, extract, live.select(F.col("file_path").alias("source"), "version"))
    edges = materialize(edges, "edges")
    stores.graph.upsert(materialize(ents, "entities"), edges)
    vec = materialize(stores.vectors.current().join(gone.select("doc_id"), "doc_id", "left_semi").select("chunk_id"), "gonevectors")
    stores.vectors.delete(vec, seq + 1)
    stores.graph.delete_sources(gone.select(F.col("file_path").alias("source")))
    stores.snapshots.save(new, ch.select("doc_id"))
    n = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    return {
        "files": ch.count(), "deleted_files": gone.count(), "changed": n.get("changed", 0), "removed": n.get("removed", 0), "unchanged": n.get("unchanged", 0),
        "vectors_added": fresh.count(), "vectors_deleted": stale.count() + vec.count(), "graph_added": edges.count(), "seconds": time.monotonic() - began,
    }
