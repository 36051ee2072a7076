"""Snapshots, repeated deliveries, change feed: fixed cases, brute force, hard inputs."""

import random

import pytest
from pyspark.sql import functions as F

from knowloom.operators import feed, redelivery, snapshots

SNAP = "snapshot_no int, chunk_id string, content string, k string, h1 bigint, i int"


def changes(spark, rows, schema=SNAP):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    return {tuple(r) for r in snapshots.snapshot_changes(df).collect()}


def test_snapshot_changes_null_gap_repeat(spark):
    rows = [(1, "a", "x"), (1, "b", None), (1, "c", ""), (3, "a", "x"), (3, "a", "x"), (3, "b", ""), (3, "d", "n"), (7, "a", "y"), (7, "b", ""), (7, "c", ""), (7, None, "z"), (None, "q", "z")]
    assert changes(spark, rows) == {(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"), (7, "a", "changed"), (7, "c", "added"), (7, "d", "removed")}


def test_snapshot_changes_empty_and_single(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(5, "a", "x")]) == set()


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(s, f"k{k}", rng.choice(["x", "y", "", None, "long" * 5000])) for s in (2, 3, 9, 10) for k in range(40) if rng.random() < 0.6]
    by = {s: {k: c for t, k, c in rows if t == s} for s in (2, 3, 9, 10)}
    want = set()
    for a, b in ((2, 3), (3, 9), (9, 10)):
        want |= {(b, k, "added") for k in by[b].keys() - by[a].keys()} | {(b, k, "removed") for k in by[a].keys() - by[b].keys()} | {(b, k, "changed") for k in by[a].keys() & by[b].keys() if by[a][k] != by[b][k]}
    assert changes(spark, rows) == want


def test_snapshot_table_of_numbers(spark, monkeypatch):
    rows = [(1, "a", "x"), (2, "a", "y"), (4, "b", "y")]
    want = changes(spark, rows)
    monkeypatch.setattr(snapshots, "MAX_LITERAL_SNAPSHOTS", 1)
    assert changes(spark, rows) == want


MSG = "delivery_no bigint, event_id string, received_at timestamp, b bigint, o bigint, id string"


def messages(spark, rows):
    return spark.createDataFrame([(n, i, None, 1, 2, "z") if t is None else (n, i, t, 1, 2, "z") for n, i, t in rows], MSG)


def stamped(df):
    return df.withColumn("received_at", F.timestamp_seconds(F.col("delivery_no") * 7919 % 400_000))


def test_surplus_deliveries(spark):
    rows = [(1, "A", None), (2, " a\t", None), (3, "b", None), (4, None, None), (5, "  ", None), (6, None, None), (7, "B\n", None), (8, "c", None), (9, "\u00a0c\u3000", None)]
    for df in (messages(spark, rows), stamped(messages(spark, rows))):
        assert {r[0] for r in redelivery.surplus_deliveries(df).collect()} == {2, 7, 9}
        assert {r["delivery_no"] for r in redelivery.unique_deliveries(df).collect()} == {1, 3, 4, 5, 6, 8}
    assert redelivery.surplus_deliveries(messages(spark, [])).count() == 0


def test_surplus_deliveries_against_brute_force_with_a_hot_id(spark):
    rng = random.Random(9)
    rows = [(n, rng.choice(["hot", f"e{rng.randrange(3000)}", f"E{rng.randrange(3000)} "]), None) for n in range(9000)]
    rng.shuffle(rows)
    seen, want = set(), set()
    for n, i, _ in sorted(rows):
        k = i.strip().lower()
        want |= {n} if k in seen else set()
        seen.add(k)
    assert {r[0] for r in redelivery.surplus_deliveries(stamped(messages(spark, rows))).collect()} == want


def test_bloom_has_no_false_negatives():
    import numpy as np
    import pandas as pd

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 4000)
    f = redelivery._build(pd.DataFrame({"h": h, "b": 1, "block": 0}))
    ids = pd.DataFrame({"h": h, "b": 2, "o": range(4000), "id": [str(i) for i in range(4000)]})
    assert len(redelivery._probe(ids, f)) == 4000
    other = ids.assign(h=np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 4000))
    assert len(redelivery._probe(other, f)) < 40


def test_append_batch(spark, tmp_path):
    store, filters = str(tmp_path / "ids"), str(tmp_path / "filters")
    df = stamped(messages(spark, [(n, f"e{n % 5}", None) for n in range(1, 11)]))
    a = redelivery.append_batch(spark, df.where("delivery_no <= 4"), store, filters, 8)
    assert {r["delivery_no"] for r in a.collect()} == {1, 2, 3, 4}
    b = redelivery.append_batch(spark, df.where("delivery_no > 2"), store, filters, 8)
    assert {r["delivery_no"] for r in b.collect()} == {5}
    assert redelivery.append_batch(spark, df, store, filters, 8).count() == 0


FEED = "feed_no bigint, file_path string, change_type string, document_version bigint, change_version bigint, event_ts timestamp, content_hash string, k string, top string"


def test_current_files(spark):
    rows = [
        (1, "a", "created", 1, None), (2, "a", " Modified\n", 5, 3), (3, "a", "modified", 2, None), (4, "b", "created", 1, None), (5, "b", "DELETED", 1, None), (6, "b", None, 1, None),
        (7, "c", None, 4, None), (8, "c", "", 9, None), (9, "c", "renamed", 9, None), (10, " ", "created", 1, None), (11, None, "created", 1, None), (12, "d", "created", None, None),
        (13, "e", "deleted", 3, None), (14, "e", "created", 4, None), (14, "e", "created", 4, None),
    ]
    df = spark.createDataFrame([(*r, None, f"h{r[0]}", "x", "y") for r in rows], FEED)
    got = {(r["file_path"], r["effective_version"], r["content_hash"]) for r in feed.current_files(df, chunk_rows=3).collect()}
    assert got == {("a", 3, "h2"), ("c", 4, "h7"), ("e", 4, "h14")}
    assert feed.current_files(df.limit(0)).count() == 0


def test_partial_patches_over_a_base_in_any_bracketing(spark):
    rng = random.Random(2)
    rows, state = [], {"k1": {"x": 0, "y": 0}, "k9": {"x": 9, "y": None}}
    for n in range(200):
        kind = rng.choice(["created", "modified", "modified", "deleted"])
        k = rng.choice(["k1", "k1", "k2", "k3"])
        x, y = (rng.choice([None, n]), rng.choice([None, -n])) if kind != "deleted" else (None, None)
        rows.append((k, n, kind, x, y))
        if kind == "deleted":
            state.pop(k, None)
        elif kind == "created":
            state[k] = {"x": x, "y": y}
        else:
            old = state.get(k, {"x": None, "y": None})
            state[k] = {"x": old["x"] if x is None else x, "y": old["y"] if y is None else y}
    df = spark.createDataFrame(rng.sample(rows * 2, len(rows) * 2), "key string, n int, kind string, x int, y int")
    base = spark.createDataFrame([("k1", 0, 0), ("k9", 9, None)], "key string, x int, y int")
    p = feed.change_patches(df, "key", [F.col("n")], F.col("kind"), {"x": F.col("x"), "y": F.col("y")}, partial=True)
    for chunk in (None, F.floor(F.col("top.o.o0") / 7)):
        got = {r["key"]: {"x": r["x"], "y": r["y"]} for r in feed.apply_patches(feed.compose_tree(p, chunk, fan_in=3, levels=3), "key", ["x", "y"], base).collect()}
        assert got == state


@pytest.mark.parametrize("col", ["chunk_id", "content"])
def test_snapshots_all_null_column(spark, col):
    df = spark.createDataFrame([(1, "a", "x", "k", 1, 1), (2, "a", "y", "k", 1, 1)], SNAP).withColumn(col, F.lit(None).cast("string"))
    assert snapshots.snapshot_changes(df).count() == 0


def test_probing_all_buckets_at_once(spark):
    """Blocks of lists and of bitmaps, more than eight buckets: every identifier finds every bucket that has it."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    h = {b: rng.integers(0, 2**62, 5_000 if b == 4 else 50) for b in range(20)}
    for b in range(1, 20):
        h[b][:5] = h[0][:5]
    filters = pd.concat([redelivery._build(pd.DataFrame({"h": v, "b": b, "block": 0})) for b, v in h.items()])
    assert {len(x) for x in filters["bits"]} > {8192} and min(len(x) for x in filters["bits"]) < 1_000
    ids = pd.DataFrame({"id": [f"i{k}" for k in range(50)], "h": h[0], "b": 0, "o": range(50)})
    got = redelivery._probe(ids, filters)
    assert {(i, b) for i, b in zip(got["id"], got["other"])} >= {(f"i{k}", b) for k in range(5) for b in range(1, 20)} and len(got) < 120


def test_many_snapshots_are_joined(spark, monkeypatch):
    rows = [(s, "k", f"v{s // 3}", "c", 1, 1) for s in range(0, 60, 2)]
    df = spark.createDataFrame(rows, SNAP)
    want = {tuple(r) for r in snapshots.snapshot_changes(df).collect()}
    monkeypatch.setattr(snapshots, "MAX_LITERAL_SNAPSHOTS", 3)
    assert {tuple(r) for r in snapshots.snapshot_changes(df).collect()} == want and len(want) > 10


def test_feed_over_a_base(spark):
    rows = [(1, "a", "modified", 3, None), (2, "b", "deleted", 2, None), (3, "d", None, 1, None)]
    df = spark.createDataFrame([(*r, None, f"h{r[0]}", "x", "y") for r in rows], FEED)
    base = spark.createDataFrame([("a", "b0", 1), ("b", "b0", 1), ("c", "b0", 1)], "file_path string, content_hash string, top int")
    assert {tuple(r) for r in feed.current_files(df, base=base).collect()} == {("a", 3, "h1"), ("d", 1, "h3"), ("c", None, "b0")}
