"""The knowledge-base operators on small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from knowloom.functions import text as T
from knowloom.functions.parsing import parse_events, parse_extraction
from knowloom.operators import events as ev
from knowloom.operators import graph, memory, retrieval, vectors
from knowloom.operators.chunking import sliding_chunks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (511, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_chunk_counts(spark, n, want):
    c = sliding_chunks(spark.createDataFrame([("d", "x" * n)], "id string, t string"), "id", "t").orderBy("chunk_index").collect()
    assert len(c) == want
    assert all(r["char_start"] == 448 * i and r["char_end"] == min(448 * i + 512, n) for i, r in enumerate(c))


def test_blank_window_keeps_offsets_and_dense_index(spark):
    t = "a" * 448 + " " * 600 + "b" * 300
    c = sliding_chunks(spark.createDataFrame([("d", t), ("n", None)], "id string, t string"), "id", "t").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["char_start"]) for r in c] == [(0, 0), (1, 896)] and c[1]["content"] == "b" * 300


def test_keys_and_types(spark):
    assert col(spark, "Agent Knowledge Hub", lambda c: T.entity_key(c, F.lit("E:/Docs/My File.md"))) == "e_docs_my_file_md::agent_knowledge_hub"
    assert col(spark, None, lambda c: T.entity_key(c, c)) == "unknown::unknown"
    assert col(spark, "A.PNG", T.doc_type) == "image" and col(spark, None, T.doc_type) == "text"
    assert col(spark, "works for", T.relation_type) == "WORKS_FOR"


def test_keywords(spark):
    assert col(spark, "一二三四五六七", T.candidate_keywords) == ["一二三四五六七", "一二", "二三", "三四", "四五", "五六", "六七"]
    assert col(spark, "一二三四五", T.candidate_keywords) == ["一二三四五", "一二", "二三", "三四", "四五", "一二三", "二三四"]
    assert col(spark, "  ", T.candidate_keywords) == [] and col(spark, None, T.candidate_keywords) == []


def test_response_parsing(spark):
    raw = '```json\n{"entities":[{"name":"A"},{"name":"B","type":"T","description":"d"}],"relations":[{"head":"A","tail":"B","confidence":"0.9"},{"head":"A","tail":"B"}]}\n```'
    r = col(spark, raw, parse_extraction)
    assert [tuple(e) for e in r["entities"]] == [("A", "Concept", ""), ("B", "T", "d")]
    assert [tuple(x) for x in r["relations"]] == [("A", "related_to", "B", 0.9), ("A", "related_to", "B", 0.5)]
    for bad in (None, "", "nope {", "[]"):
        r = col(spark, bad, parse_extraction)
        assert r["entities"] == [] and r["relations"] == []


def test_event_parsing(spark):
    rows = ['{"file_path":"a","document_version":null}', '{"file_path":"a","change_version":7,"event_id":"e","timestamp":1000}', '{"file_path":"  "}', '{"file_path"', None]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "i int, payload string, event string")
    got = parse_events(df, now=F.timestamp_millis(F.lit(5))).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, True, False, False, False]
    assert got[0]["event"]["document_version"] == 0 and got[0]["event"]["change_version"] is None and got[0]["event"]["change_type"] == "modified" and got[0]["event"]["event_id"].endswith("-5")
    assert got[1]["event"]["change_version"] == 7 and got[1]["event"]["document_version"] is None
    good, bad = ev.split_poison(parse_events(spark.createDataFrame([('{"file_path":"a","change_type":"moved"}',), (rows[0],)], "payload string")))
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == ["unsupported change type"]


def test_gate_cases(spark):
    g = ev.FileGate()
    assert g.apply("created", None, 1.0) == ("applied", 1)
    g = ev.FileGate()
    assert g.apply("modified", None, 1.0) == ("applied", 2) and g.apply("modified", None, 0.5) == ("stale_timestamp", None) and g.apply("modified", None, 1.0) == ("applied", 3)
    g = ev.FileGate()
    assert g.apply("modified", 5, 1.0) == ("applied", 5) and g.apply("modified", 4, 2.0)[0] == "stale_version" and g.apply("modified", 5, 2.0)[0] == "stale_version" and g.apply("deleted", 5, 2.0) == ("applied", 5)
    assert g.apply("moved", 9, 2.0)[0] == "unsupported"


def history(n, mixed, seed=3):
    rng = random.Random(seed)
    out = []
    for s in range(n):
        v = rng.randrange(30) if mixed is True and rng.random() < 0.5 or mixed == "versioned" else None
        out.append((s, rng.choice("abc"), f"e{rng.randrange(n)}", rng.choice(ev.KINDS), v, rng.randrange(100)))
    return out


def model(rows):
    gates, seen, out = {}, set(), {}
    for s, p, e, k, v, t in rows:
        if e in seen:
            out[s] = "duplicate"
            continue
        out[s] = gates.setdefault(p, ev.FileGate()).apply(k, v, float(t))[0]
        if out[s] == "applied":
            seen.add(e)  # an event that was skipped may come again
    return out


EVENTS = "seq bigint, file_path string, event_id string, change_type string, version bigint, t int"


@pytest.mark.parametrize("mixed", [True, False, "versioned"])
def test_replay_gate_against_sequential_model(spark, mixed):
    rows = history(400, mixed)
    df = spark.createDataFrame(rows, EVENTS).withColumn("event_ts", F.timestamp_seconds("t"))
    assert {r["seq"]: r["outcome"] for r in ev.replay_gate(df).collect()} == model(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_several_files_and_stale_repeats(spark, seed):
    """Few ids in many files, so that what one file applies hangs on what others did before."""
    rng = random.Random(seed)
    rows = [(s, p, f"e{rng.randrange(25)}", k, v, t) for s, p, _, k, v, t in history(150, True, seed)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("event_ts", F.timestamp_seconds("t"))
    assert {r["seq"]: r["outcome"] for r in ev.replay_gate(df).collect()} == model(rows)


def test_stale_event_comes_again_and_is_applied(spark):
    """A versioned event moves the file's time back; the unversioned one that was too old before passes then."""
    rows = [(1, "/f", "a", "modified", None, 50), (2, "/f", "b", "modified", None, 20), (3, "/f", "c", "modified", 9, 10), (4, "/f", "b", "modified", None, 20), (5, "/f", "b", "modified", None, 20)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("event_ts", F.timestamp_seconds("t"))
    got = {r["seq"]: (r["outcome"], r["assigned"]) for r in ev.replay_gate(df).collect()}
    assert got == {1: ("applied", 2), 2: ("stale_timestamp", None), 3: ("applied", 9), 4: ("applied", 10), 5: ("duplicate", None)}


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_window_gates_equal_the_replay_on_pure_histories(spark, bucket, monkeypatch):
    from knowloom.operators import prefix

    real = prefix.running
    monkeypatch.setattr(ev, "running", lambda *a: real(*a, rows_per_bucket=bucket))
    rows = [(s, p, f"e{s}", *x) for s, p, _, *x in history(300, "versioned")]
    df = spark.createDataFrame(rows, EVENTS).withColumn("event_ts", F.timestamp_seconds("t"))
    got = {r["seq"]: r["stale"] for r in ev.version_gate(ev.first_arrivals(df)).collect()}
    assert got == {s: o == "stale_version" for s, o in model(rows).items()}
    rows = [(s, p, f"e{s}", *x) for s, p, _, *x in history(300, False)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("event_ts", F.timestamp_seconds("t"))
    got = {r["seq"]: r["stale"] for r in ev.timestamp_gate(ev.first_arrivals(df)).collect()}
    assert got == {s: o == "stale_timestamp" for s, o in model(rows).items()}


def test_version_assignment(spark):
    df = spark.createDataFrame([(1, "a", "created"), (2, "b", "modified"), (3, "a", "modified"), (4, "b", "created")], "seq bigint, file_path string, change_type string")
    assert {r["seq"]: r["assigned"] for r in ev.assign_versions(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 3}


CH = "chunk_id string, chunk_index int, content string"


@pytest.mark.parametrize("old,new,stale,added", [
    ([("#0", 0, "A"), ("#1", 1, "old")], [("#0", 0, "A"), ("#1", 1, "updated")], ["#1"], ["#1"]),
    ([("#0", 0, "old"), ("#1", 1, "removed")], [("#0", 0, "updated")], ["#1", "#0"], ["#0"]),
    ([("#0", 0, "x")], [], ["#0"], []),
])
def test_chunk_diff(spark, old, new, stale, added):
    o, n = spark.createDataFrame(old, CH), spark.createDataFrame(new, CH)
    d = ev.chunk_diff(o, n)
    assert [r["chunk_id"] for r in ev.stale_chunks(d, o, n.unionByName(o.limit(0))).orderBy("phase", "chunk_index").collect()] == stale
    assert [r["chunk_id"] for r in d.where("change = 'changed'").collect()] == added


def test_entity_merge(spark):
    S = "entity_key string, name string, type string, description string, source string, version bigint, chunk_id string, seq bigint, at timestamp"
    log = spark.createDataFrame([("k", "n1", "T", "first", "s", 1, "c1", 1, None), ("k", "n2", "", "", "s", 2, "c2", 2, None), ("k", "n3", None, None, "", 3, "c1", 3, None), (None, "x", "T", "", "s", 1, "c", 4, None)], S)
    r = graph.merge_entities(log).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["type"], r[0]["description"], r[0]["source"], r[0]["version"], r[0]["chunk_ids"]) == ("n3", "T", "first", "s", 3, ["c1", "c2"])
    again = graph.merge_entities(spark.createDataFrame([("k", "n4", "U", "", "s", 4, "c3", 1, None)], S), graph.merge_entities(log)).first()
    assert again["name"] == "n4" and again["type"] == "U" and again["description"] == "first" and again["chunk_ids"] == ["c1", "c2", "c3"]
    assert graph.merge_entities(log.limit(0)).count() == 0


def test_edges_and_deletes(spark):
    E = "head_key string, rel_type string, tail_key string, confidence double, source string, chunk_id string, seq bigint"
    ents = spark.createDataFrame([("a", "s", ["c1"]), ("b", "s", ["c1", "c2"]), ("c", "s", [])], "entity_key string, source string, chunk_ids array<string>")
    log = spark.createDataFrame([("a", "R", "b", 0.1, "s", "c1", 1), ("a", "R", "b", 0.9, "s", "c2", 2), ("a", "R", "zzz", 0.5, "s", "c1", 3), ("b", "R", "c", 0.5, "s", "c2", 4)], E)
    e = graph.merge_edges(log, ents, ["confidence", "source", "chunk_id"])
    assert {(r["head_key"], r["tail_key"], r["confidence"]) for r in e.collect()} == {("a", "b", 0.9), ("b", "c", 0.5)}
    left, edges = graph.delete_chunks(ents, e, "s", ["c1"])
    assert {(r["entity_key"], tuple(r["chunk_ids"])) for r in left.collect()} == {("b", ("c2",)), ("c", ())}
    assert {(r["head_key"], r["tail_key"]) for r in edges.collect()} == {("b", "c")}
    left, edges = graph.delete_sources(ents, e, spark.createDataFrame([("s",)], "source string"))
    assert left.count() == 0 and edges.count() == 0


def test_trails(spark):
    e = spark.createDataFrame([("e1", "A", "T1", "B"), ("e2", "A", "T2", "B"), ("e3", "C", "L", "C")], "edge_id string, head_key string, rel_type string, tail_key string")
    starts = spark.createDataFrame([("A",), ("C",)], "start string")
    got = {(r["start"], r["depth"], tuple(r["rels"]), r["neighbour"]) for r in graph.neighbours(starts, e).collect()}
    assert got == {("A", 1, ("T1",), "B"), ("A", 1, ("T2",), "B"), ("A", 2, ("T1", "T2"), "A"), ("A", 2, ("T2", "T1"), "A"), ("C", 1, ("L",), "C")}


def test_trails_cut_adjacency_is_exact(spark):
    rng = random.Random(5)
    edges = [(f"e{i}", f"n{rng.randrange(25)}", rng.choice("XYZ"), f"n{rng.randrange(4)}") for i in range(160)]
    df = spark.createDataFrame(edges, "edge_id string, head_key string, rel_type string, tail_key string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(25)], "start string")
    got = {(r["start"], r["rn"]): (r["depth"], tuple(r["rels"]), r["neighbour"]) for r in graph.neighbours(starts, df, hops=2, limit=6).collect()}
    both = [(i, a, t, b) for i, a, t, b in edges] + [(i, b, t, a) for i, a, t, b in edges if a != b]
    for s in (f"n{i}" for i in range(25)):
        p = [(1, (t,), b, (i,)) for i, a, t, b in both if a == s]
        p += [(2, (t, u), c, (i, j)) for i, a, t, b in both if a == s for j, b2, u, c in both if b2 == b and i != j]
        for n, x in enumerate(sorted(p)[:6], 1):
            assert got[s, n] == x[:3]


M = "session_id string, seq bigint, role string, content string"


def test_memory(spark):
    long = "a long answer that goes on and on and on"
    rows = [("s", 1, "user", "  repeatable   content "), ("s", 2, "user", "repeatable content"), ("s", 3, "assistant", long), ("", 4, "user", "x"), (None, 5, "user", "x"), ("e", 6, "user", " ")]
    got = {r["session_id"]: r["context"] for r in memory.contexts(spark.createDataFrame(rows, M), 10, 120, 30).collect()}
    assert got["s"] == "user: repeatable content\nassistant: " + long[:30] + "..." and got["e"] == memory.EMPTY and set(got) == {"s", "e"}
    one_line = memory.contexts(spark.createDataFrame([("s", 1, "u", "y" * 50), ("s", 2, "u", "z")], M), 10, 20).first()["context"]
    assert one_line == "u: " + "y" * 17
    many = spark.createDataFrame([("s", i, "u", str(i)) for i in range(50)], M)
    assert {r["seq"] for r in memory.last_n(many, 3).collect()} == {47, 48, 49}
    assert memory.contexts(many.limit(0)).count() == 0


def test_memory_retention(spark):
    df = spark.createDataFrame([("old", 1, "u", "x"), ("new", 2, "u", "x"), ("new", 3, "u", "y")], M).withColumn("ts", F.timestamp_seconds(F.when(F.col("session_id") == "old", 0).otherwise(500_000)))
    assert {r["seq"] for r in memory.retained(df, F.timestamp_seconds(F.lit(500_100))).collect()} == {2, 3}


C = "question_id bigint, retrieval_type string, rank int, score double, content string, source string"


def test_rerank_weights(spark):
    q = spark.createDataFrame([(1, "RELATIONSHIP"), (2, "DESCRIPTIVE"), (3, "DESCRIPTIVE")], "question_id bigint, mode string")
    c = spark.createDataFrame([(1, "vector", 1, 0.9, "v", "A"), (1, "graph", 1, 0.8, "g", "B"), (2, "vector", 1, 0.85, "v", "A"), (2, "graph", 1, 0.75, "g", "a")], C)
    got = {(r["question_id"], r["position"]): (r["retrieval_type"], round(r["score"], 5)) for r in retrieval.hybrid_rerank(q, c).collect()}
    assert got == {(1, 1): ("graph", 1.12), (1, 2): ("vector", 0.756), (2, 1): ("vector", 1.02), (2, 2): ("graph", 0.64125)}
    e = {r["question_id"]: r["conflict"] for r in retrieval.evidence(c).collect()}
    assert e == {1: True, 2: False}
    conf = {r["question_id"]: round(r["confidence"], 4) for r in retrieval.confidence(q, retrieval.hybrid_rerank(q, c)).collect()}
    assert conf == {1: 0.938, 2: 0.8306, 3: 0.0}
    p = retrieval.prompts(q.withColumn("memory", F.lit("user: hi")), retrieval.hybrid_rerank(q, c), retrieval.evidence(c)).where("question_id = 1").first()["prompt"]
    assert p.index("[MEMORY]") < p.index("[VECTOR_CONTEXTS]") < p.index("[GRAPH_CONTEXTS]") < p.index("[CONFLICT_HINTS]")


def test_degradation(spark):
    r = lambda v, g, m, nv, ng: one(spark, retrieval.degradation(F.lit(v), F.lit(g), F.lit(m), F.lit(nv), F.lit(ng)).alias("r"))["r"]
    assert tuple(r(True, False, True, 1, 0)) == ("COMPLETED", True, ["GRAPH_UNAVAILABLE"])
    assert tuple(r(True, True, False, 1, 1)) == ("COMPLETED", True, ["MEMORY_UNAVAILABLE"])
    assert r(False, True, True, 0, 0)["outcome"] == "FAILED" and r(True, True, True, 0, 0)["outcome"] == "COMPLETED"


V = "vec_id bigint, embedding array<float>"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0, 0.0, 5.0])], V)
    q = spark.createDataFrame([(100, [1.0, 0.0]), (101, None)], V)
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.exact_topk(v, q, "vec_id", "vec_id", k=2).orderBy("rank").collect()]
    assert got == [(100, 1, 1), (100, 4, 2)]
    assert vectors.exact_topk(v.limit(0), q, "vec_id", "vec_id").count() == 0
    left, gone = vectors.delete_by(v, spark.createDataFrame([(1,), (9,)], "vec_id bigint"), "vec_id")
    assert left.count() == 4 and gone.count() == 1


def test_exact_topk_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(6)]) for i in range(60)], V)
    want = {tuple(r) for r in vectors.exact_topk(v, v.where("vec_id < 9"), "vec_id", "vec_id").select("query_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 7)
    assert {tuple(r) for r in vectors.exact_topk(v, v.where("vec_id < 9"), "vec_id", "vec_id").select("query_id", "vec_id", "rank").collect()} == want


def test_ann_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    exact = {tuple(r) for r in vectors.exact_topk(e, q, "vec_id", "vec_id").select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in vectors.ann_topk(e, q, "vec_id", "vec_id").select("query_id", "vec_id").collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_chunks_of_a_long_text_take_time_in_proportion(spark):
    """Windows across stretches, with characters beyond the basic plane."""
    from knowloom.operators.chunking import sliding_chunks

    t = "".join(random.Random(1).choice("ab é中🚀\n") for _ in range(30_000))
    got = sliding_chunks(spark.createDataFrame([(1, t)], "doc_id int, text string"), "doc_id", "text").orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == [t[s : s + 512].strip(" \n") for s in range(0, 448 * -(-(len(t) - 512) // 448) + 1, 448)]
    assert got[-1]["char_end"] == len(t)
