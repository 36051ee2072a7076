"""Stores, pipelines, streams, workflows and files end to end on small inputs."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from knowloom.functions.plugins import answerer, embedder, extractor
from knowloom.functions.text import doc_identity
from knowloom.operators import events as ev
from knowloom.operators.prefix import running
from knowloom.plans import ask, changes, ingest, workflow
from knowloom.session import scratch_root
from knowloom.sources import documents, stores
from knowloom.sources.events import stream_from_files
from knowloom.streaming import gate, windows

DOCS = [("/d/a.md", "Alice knows Bob. Bob knows Carol."), ("/d/b.md", "Dora met Emil " * 60), ("/d/empty.md", "")]


def docs(spark, rows=DOCS):
    d = spark.createDataFrame(rows, "path string, text string")
    return d.select(doc_identity(F.col("path")).alias("doc_id"), "path", "text")


@pytest.fixture
def st(spark, tmp_path):
    p = str(tmp_path)
    return ingest.Stores(stores.vector_store(spark, p + "/v"), stores.SnapshotStore(spark, p + "/s"), stores.GraphStore(spark, p + "/g"))


def test_ingest_then_changes(spark, st):
    run, n = ingest.ingest(docs(spark), st, extractor(), embedder(dims=8), 1)
    assert run.state == "COMPLETED" and not run.degrade_reasons and n["chunks"] == 3
    assert st.vectors.current().count() == 3 and st.snapshots.read().count() == 3
    names = {r["name"] for r in st.graph.entities.read().collect()}
    assert {"Alice", "Bob", "Carol", "Dora", "Emil"} <= names and st.graph.edges.read().count() >= 3
    new = {"/d/a.md": "Alice knows Frank.", "/d/c.md": "Gina"}
    contents = lambda paths: paths.select(F.col("file_path").alias("path"), F.element_at(F.create_map(*[F.lit(x) for kv in new.items() for x in kv]), F.col("file_path")).alias("text"))
    ch = spark.createDataFrame([("/d/a.md", "modified", 2), ("/d/b.md", "deleted", 2), ("/d/c.md", "created", 1)], "file_path string, change_type string, version bigint")
    done = changes.apply_changes(ch, contents, st, extractor(), embedder(dims=8), 10)
    assert done["files"] == 3 and done["deleted_files"] == 1
    got = {r["name"]: r["version"] for r in st.graph.entities.read().collect()}
    assert set(got) == {"Alice", "Frank", "Gina"} and got["Frank"] == 2
    assert {r["content"] for r in st.vectors.current().collect()} == {"Alice knows Frank.", "Gina"} == {r["content"] for r in st.snapshots.read().collect()}
    assert st.snapshots.get(docs(spark).first()["doc_id"]).count() == 1


def test_ingest_degrades_and_aborts(spark, st, monkeypatch):
    def fail(*a, **k):
        raise OSError("down")

    monkeypatch.setattr(workflow, "sleep", lambda s: None)
    monkeypatch.setattr(st.snapshots, "save", fail)
    run, _ = ingest.ingest(docs(spark), st, extractor(), embedder(dims=8), 1)
    assert run.state == "COMPLETED" and run.degrade_reasons == ["SNAPSHOT_UNAVAILABLE"] and run.retries()["snapshot-store"] == 2
    monkeypatch.setattr(st.vectors, "append", fail)
    called = []
    monkeypatch.setattr(st.graph, "upsert", lambda *a: called.append(1))
    with pytest.raises(OSError):
        ingest.ingest(docs(spark), st, extractor(), embedder(dims=8), 2)
    assert not called


def test_illegal_transition():
    r = workflow.Run(workflow.QA)
    with pytest.raises(workflow.IllegalTransition):
        r.to("COMPLETED")
    r.to("MEMORY_LOADED")
    r.to("FAILED")
    with pytest.raises(workflow.IllegalTransition):
        r.to("FAILED")


def test_ask(spark, st):
    ingest.ingest(docs(spark), st, extractor(), embedder(dims=32), 1)
    v = st.vectors.current().withColumn("source", F.col("metadata.source"))
    e = st.graph.entities.read().drop("shard")
    r = st.graph.edges.read().drop("shard").withColumn("edge_id", F.concat_ws("|", "head_key", "rel_type", "tail_key"))
    q = spark.createDataFrame([(1, "s", "what is the relationship of Alice"), (2, "", "Dora"), (3, None, " ")], "question_id bigint, session_id string, question string")
    m = spark.createDataFrame([("s", 1, "user", "hello")], "session_id string, seq bigint, role string, content string")
    out = {x["question_id"]: x for x in ask.ask(q, v, e, r, m, embedder(dims=32), answerer()).collect()}
    assert set(out) == {1, 2} and out[1]["intent"] == "relationship" and not out[1]["degraded"] and out[1]["contexts"] and out[1]["answer"]
    assert any(s.startswith("MEMORY_LOADED: short") for s in out[1]["reasoning_steps"]) and any("no short" in s for s in out[2]["reasoning_steps"])
    down = {x["question_id"]: x for x in ask.ask(q, None, e, r, m, embedder(dims=32), answerer()).collect()}
    assert down[1]["degrade_reasons"] == ["VECTOR_UNAVAILABLE"] and down[1]["workflow_state"] == "COMPLETED"
    none = ask.ask(q, None, None, None, None, embedder(dims=32), answerer()).collect()
    assert all(x["workflow_state"] == "FAILED" and x["answer"] is None for x in none)


def test_stream_gate_equals_batch(spark, tmp_path):
    rows = [{"event_id": f"e{i % 3}-{i % 7 if i % 4 else i}", "file_path": f"f{i % 3}", "change_type": ["created", "modified", "deleted"][i % 3 if i < 5 else 1], **({"change_version": (i * 7) % 11} if i % 2 else {}), "timestamp": (i * 37) % 50 * 1000} for i in range(40)]
    for part in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({**r, "seq": i}) for i, r in list(enumerate(rows))[part * 10 : part * 10 + 10]))
    schema = "event_id string, file_path string, change_type string, change_version bigint, timestamp bigint, seq bigint"
    shape = lambda df: df.select("seq", "file_path", "event_id", "change_type", F.col("change_version").alias("version"), F.timestamp_millis("timestamp").alias("event_ts"))
    want = {(r["seq"], r["outcome"], r["assigned"]) for r in ev.replay_gate(shape(spark.read.schema(schema).json(str(tmp_path / "in")))).collect()}
    got = []
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(str(tmp_path / "in"))
    gate.run_to_end(gate.stream_gate(shape(src)), lambda df, i: got.extend((r["seq"], r["outcome"], r["assigned"]) for r in df.collect()), str(tmp_path / "cp"))
    assert set(got) == want and len(got) == 40
    assert stream_from_files(spark, str(tmp_path / "in")).isStreaming


def test_stream_gate_knows_ids_of_long_ago(spark, tmp_path):
    schema = "event_id string, file_path string, change_type string, version bigint, event_ts timestamp, seq bigint"
    (tmp_path / "in").mkdir()
    for part, ids in enumerate(([*range(10_050)], [0, 49, 10_049])):
        rows = [json.dumps({"event_id": f"e{i}", "file_path": "f", "change_type": "modified", "seq": part * 100_000 + i}) for i in ids]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(rows))
        os.utime(tmp_path / "in" / f"{part}.json", (part + 1, part + 1))
    got = []
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    gate.run_to_end(gate.stream_gate(src), lambda df, i: got.append([(r["seq"], r["outcome"]) for r in df.collect()]), str(tmp_path / "cp"))
    assert [len(x) for x in got] == [10_050, 3] and {o for _, o in got[0]} == {"applied"}
    assert sorted(got[1]) == [(100_000, "duplicate"), (100_049, "duplicate"), (110_049, "duplicate")]


def test_gate_batch_and_last_changes(spark, tmp_path):
    raw = [(1, json.dumps({"event_id": "a", "file_path": "f", "change_type": "created"})), (2, json.dumps({"event_id": "b", "file_path": "f", "change_type": "modified"})), (3, "broken"), (4, json.dumps({"event_id": "a", "file_path": "f"}))]
    out = changes.gate_batch(spark.createDataFrame(raw, "seq bigint, payload string"), str(tmp_path / "dead"))
    assert {r["seq"]: r["outcome"] for r in out.collect()} == {1: "applied", 2: "applied", 4: "duplicate"}
    assert [tuple(r) for r in changes.last_changes(out).collect()] == [("f", "modified", 2)]
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["invalid"]


def test_batches_of_events_with_ledger_failure_and_replay(spark, tmp_path, monkeypatch):
    ledger = stores.event_ledger(spark, str(tmp_path / "ledger"))
    e = lambda i, path, kind, v: (i, json.dumps({"event_id": f"e{i}", "file_path": path, "change_type": kind, "change_version": v, "timestamp": i * 1000}))
    one = spark.createDataFrame([e(1, "/a.md", "created", 5), e(2, "/a.md", "modified", 4), e(3, "/b.md", "created", 1), (4, "{")], "seq bigint, payload string")
    go = lambda rows, n: changes.process_batch(rows, None, None, ledger, None, None, n, str(tmp_path / "dead"), attempts=1)

    def down(*a):
        raise OSError("down")

    monkeypatch.setattr(changes, "apply_changes", down)
    assert go(one, 1) == {"failed": 2, "stale_version": 1}
    applied = []
    monkeypatch.setattr(changes, "apply_changes", lambda ch, *a: applied.extend(tuple(r) for r in ch.collect()))
    assert go(changes.replay(ledger), 2) == {"applied": 2}
    assert sorted(applied) == [("/a.md", "created", 5), ("/b.md", "created", 1)]
    assert {r["event_id"]: r["status"] for r in ledger.current().collect()} == {"e1": "SUCCEEDED", "e2": "RECEIVED", "e3": "SUCCEEDED"}
    assert go(one, 3) == {"stale_version": 1}


def test_lines_of_one_file_are_events_of_their_own(spark, tmp_path, monkeypatch):
    e = lambda i, path, kind: json.dumps({"event_id": i, "file_path": path, "change_type": kind, "timestamp": 1000})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join([e("a", "/f", "created"), e("b", "/f", "modified"), e("a", "/f", "created"), e("c", "/g", "created"), e("d", "/f", "deleted")]))
    seqs, applied, counts = [], [], []
    changes.run_to_end(stream_from_files(spark, str(tmp_path / "in")), lambda df, i: seqs.extend((r["seq"], json.loads(r["payload"])["event_id"]) for r in df.collect()), str(tmp_path / "cp0"))
    assert len(set(seqs)) == 5 and [i for _, i in sorted(seqs)] == ["a", "b", "a", "c", "d"]
    monkeypatch.setattr(changes, "apply_changes", lambda ch, *a: applied.extend(tuple(r) for r in ch.collect()))
    ledger, process = stores.event_ledger(spark, str(tmp_path / "ledger")), changes.process_batch
    monkeypatch.setattr(changes, "process_batch", lambda *a, **k: counts.append(process(*a, **k)))
    changes.stream_changes(stream_from_files(spark, str(tmp_path / "in")), None, None, ledger, None, None, str(tmp_path / "cp"), str(tmp_path / "dead"))
    assert counts == [{"applied": 4, "duplicate": 1}] and sorted(applied) == [("/f", "deleted", 3), ("/g", "created", 1)]
    assert ledger.history().where("status = 'SUCCEEDED'").count() == 4
    same = changes.gate_batch(spark.createDataFrame([(7, e(i, "/f", "modified")) for i in "aabc"], "seq bigint, payload string"))
    assert sorted((r["event_id"], r["outcome"]) for r in same.collect()) == [("a", "applied"), ("a", "duplicate"), ("b", "applied"), ("c", "applied")]


def test_replay_of_events_without_times_keeps_their_arrival(spark, tmp_path, monkeypatch):
    ledger = stores.event_ledger(spark, str(tmp_path / "ledger"))
    event = lambda i, kind: json.dumps({"event_id": i, "file_path": "/f", "change_type": kind})
    rows = [(event("z", "created"), 1), (event("m", "modified"), 2), (event("a", "deleted"), 3)]
    one = spark.createDataFrame([(i, "/f", json.loads(p)["change_type"], p, n) for p, n in rows for i in [json.loads(p)["event_id"]]], "event_id string, file_path string, change_type string, payload string, arrival bigint")
    for step, status in enumerate(("RECEIVED", "FAILED")):
        ledger.append(one.withColumn("status", F.lit(status)), 4 + step)
    got = changes.replay(ledger).orderBy("seq").collect()
    assert [json.loads(r["payload"])["event_id"] for r in got] == ["z", "m", "a"] and len({r["seq"] for r in got}) == 3
    applied = []
    monkeypatch.setattr(changes, "apply_changes", lambda ch, *a: applied.extend(tuple(r) for r in ch.collect()))
    assert changes.process_batch(changes.replay(ledger), None, None, ledger, None, None, 2) == {"applied": 3}
    assert applied == [("/f", "deleted", 3)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short text")
    (tmp_path / "b.html").write_text("<html><script>x()</script><p>Hello &amp; bye</p></html>")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe raw")
    d = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert d["a.txt"]["text"] == "short text" and "Hello & bye" in d["b.html"]["text"] and "x()" not in d["b.html"]["text"] and d["c.bin"]["text"]
    c = documents.parse_files(spark, str(tmp_path / "a.txt")).collect()
    assert len(c) == 1 and c[0]["chunk_index"] == 0 and c[0]["metadata"]["source"] == str(tmp_path / "a.txt")


def test_files_of_more_than_100_000_characters_are_whole(spark, tmp_path):
    body = "word " * 30_000
    (tmp_path / "a.html").write_text(f"<p>{body}</p>end of page")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    reader = lambda raw, path: body + "end of report"
    d = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.read_files(spark, str(tmp_path), reader).collect()}
    assert d["a.html"] == body + "\nend of page" and d["b.pdf"] == body + "end of report"
    last = documents.parse_files(spark, str(tmp_path), reader).groupBy("metadata.source").agg(F.max_by("content", "chunk_index").alias("c")).collect()
    assert len(last) == 2 and all("end of" in r["c"] for r in last)


def test_session_store(spark, tmp_path):
    p = str(tmp_path / "m")
    m = spark.createDataFrame([("s", 1, "user", "x"), (" ", 2, "user", "x"), ("s", 3, "user", " ")], "session_id string, seq bigint, role string, content string").withColumn("ts", F.current_timestamp())
    assert stores.session_log(spark, p).count() == 0
    stores.append_messages(m, p)
    assert stores.session_log(spark, p).count() == 1


def test_log_upsert_and_delete(spark, tmp_path):
    log = stores.vector_store(spark, str(tmp_path / "v"))
    row = lambda c: spark.createDataFrame([("k", "d", 0, c)], "chunk_id string, doc_id string, chunk_index int, content string")
    log.append(row("one"), 1)
    log.append(row("two"), 2)
    assert [r["content"] for r in log.current().collect()] == ["two"]
    log.delete(row("x"), 3)
    assert log.current().count() == 0
    log.append(row("three"), 4)
    assert [r["content"] for r in log.current().collect()] == ["three"]


def test_running_aggregates_over_a_hot_group(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), ((F.col("id") * 37) % 101).alias("v"))
    got = running(df, ["g"], "seq", {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}, rows_per_bucket=64).orderBy("seq").collect()
    best, total = {}, {}
    for r in got:
        assert r["m"] == best.get(r["g"]) and r["s"] == total.get(r["g"])
        best[r["g"]] = max(best.get(r["g"], -1), r["v"])
        total[r["g"]] = total.get(r["g"], 0) + r["v"]


def test_windows_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 20), (1, 4000)], "k int, t int").select("k", F.timestamp_seconds("t").alias("ts")).write.parquet(str(tmp_path / "w"))
    src = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "w"))
    got = []
    gate.run_to_end(windows.tumbling(src, "ts", "1 minute", ["k"], late="10 minutes"), lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    assert all(r["n"] == 2 for r in got)
    assert windows.sessions(spark.read.parquet(str(tmp_path / "w")), "ts", "5 minutes", "k").count() == 2


def test_scratch_follows_the_session():
    session = lambda value: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: value if key == "spark.checkpoint.dir" else default))
    assert scratch_root(session("file:///shared/x/")) == "file:///shared/x"
    assert scratch_root(session(None)).startswith("file:///")


def test_kafka_records_have_a_place_of_their_own(spark):
    from knowloom.sources.events import from_kafka

    r = from_kafka(spark.createDataFrame([(bytearray(b"a"), p, o) for p, o in ((0, 9), (0, 10), (1, 9), (12, 100))], "value binary, partition int, offset bigint"))
    seqs = [x["seq"] for x in r.collect()]
    assert len(set(seqs)) == 4 and seqs == sorted(seqs) and {x["payload"] for x in r.collect()} == {"a"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "spark://host:7077" if key == "spark.master" else default))
    with pytest.raises(RuntimeError):
        scratch_root(cluster)


def test_modified_document_without_snapshot_is_compared_with_its_vectors(spark, st):
    ingest.ingest(docs(spark, [("/d/a.md", "Alice knows Bob. " * 60)]), st, extractor(), embedder(dims=8), 1)
    st.snapshots.delete(docs(spark, [("/d/a.md", "")]).select("doc_id"))
    assert st.snapshots.read().count() == 0 and st.vectors.current().count() == 3
    contents = lambda paths: paths.select(F.col("file_path").alias("path"), F.lit("Alice knows Frank.").alias("text"))
    ch = spark.createDataFrame([("/d/a.md", "modified", 2)], "file_path string, change_type string, version bigint")
    n = changes.apply_changes(ch, contents, st, extractor(), embedder(dims=8), 10)
    assert (n["changed"], n["removed"], n["vectors_added"], n["vectors_deleted"]) == (1, 2, 1, 3) and n["graph_added"] >= 1 and n["seconds"] > 0
    assert [r["content"] for r in st.vectors.current().collect()] == ["Alice knows Frank."]


def test_exhausted_retries_are_dead_letters(spark, tmp_path, monkeypatch):
    tries = []

    def down(*a):
        tries.append(1)
        raise OSError("down")

    monkeypatch.setattr(changes, "apply_changes", down)
    monkeypatch.setattr(workflow, "sleep", lambda s: None)
    one = spark.createDataFrame([(1, json.dumps({"event_id": "e", "file_path": "/a", "change_type": "created"}))], "seq bigint, payload string")
    ledger = stores.event_ledger(spark, str(tmp_path / "ledger"))
    assert changes.process_batch(one, None, None, ledger, None, None, 1, str(tmp_path / "dead")) == {"failed": 1} and len(tries) == 3
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["attempts exhausted: OSError: down"]
    assert changes.replay(ledger).count() == 1


def test_question_workflow(spark, st, tmp_path, monkeypatch):
    monkeypatch.setattr(workflow, "sleep", lambda s: None)
    ingest.ingest(docs(spark), st, extractor(), embedder(dims=32), 1)
    q = spark.createDataFrame([(1, "s1", "Who knows Bob?"), (2, None, "Where is Emil?"), (3, " ", "And Dora?"), (4, "s1", " ")], "question_id bigint, session_id string, question string")
    path, calls = str(tmp_path / "turns"), []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return stores.session_log(spark, path)

    vec = lambda: st.vectors.current().select("chunk_id", "content", F.col("metadata.source").alias("source"), "embedding")
    ents = lambda: (st.graph.entities.read(), st.graph.edges.read().withColumn("edge_id", F.concat_ws("-", "head_key", "rel_type", "tail_key")))
    go = lambda load, n: ask.ask_workflow(q, vec(), *ents(), load, lambda t: stores.append_messages(t, path), embedder(dims=32), answerer(), n)
    got, run = go(flaky, 1)
    assert run.state == "COMPLETED" and run.retries()["memory-load"] == 2 and not run.degrade_reasons and got.count() == 3
    steps = {r["question_id"]: list(r["reasoning_steps"]) for r in got.collect()}
    assert steps[1][:2] == ["QUESTION_RECEIVED: question accepted", "MEMORY_LOADED: short-term memory loaded"] and steps[2][1] == "MEMORY_LOADED: no session id, skip memory loading"
    assert "COMPLETED: workflow finished" in steps[1]
    turns = stores.session_log(spark, path).orderBy("seq").collect()
    assert [(r["session_id"], r["role"]) for r in turns] == [("s1", "user"), ("s1", "assistant")] and turns[0]["content"] == "Who knows Bob?"

    def never():
        raise OSError("down")

    _, run = go(never, 2)
    assert run.state == "COMPLETED" and run.degrade_reasons == ["MEMORY_UNAVAILABLE"]
    before = stores.session_log(spark, path).count()
    monkeypatch.setattr(ask, "ask", lambda *a: never())
    with pytest.raises(OSError):
        go(lambda: None, 3)
    assert stores.session_log(spark, path).count() == before
