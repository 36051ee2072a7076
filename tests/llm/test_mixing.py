"""Mixing: the distributed queue equals a sequential one; limits, shortfalls and empty inputs."""

import random
from collections import Counter

import pytest

from knowloom.llm import mixing

SIZES = "doc_id bigint, source string, n_tokens bigint, h int, b int"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, h int"


def run(spark, docs, targets, **kw):
    mix, rep = mixing.mix_sources(spark.createDataFrame([(*d, 1, 1) for d in docs], SIZES), spark.createDataFrame([(*t, 1) for t in targets], TARGETS), **kw)
    return mix.collect(), {(r["mix_name"], r["source"]): r for r in rep.collect()}


def some(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choices(["big", "mid", "tiny"], [70, 25, 5])[0], rng.randint(1, 200)) for i in range(n)]


@pytest.mark.parametrize("bucket", [50, 4096])
def test_shares_limits_and_order(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = some(2000)
    mix, rep = run(spark, docs, [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 4)])
    size = {d: n for d, _, n in docs}
    assert max(Counter(r["doc_id"] for r in mix if r["source"] == "big").values()) == 1 and max(Counter(r["doc_id"] for r in mix).values()) <= 4
    assert all(r["n_tokens"] == size[r["doc_id"]] for r in mix) and sorted(r["position"] for r in mix) == list(range(1, len(mix) + 1))
    for r in rep.values():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["most_uses"] <= r["max_repeats"]
    assert sum(r["n_tokens"] for r in mix) <= rep["m", "big"]["budget"]
    # Sequential: the queues' cumulative tokens in the order that came out give the finish times and the order.
    cum, last = Counter(), -1.0
    for r in sorted(mix, key=lambda r: r["position"]):
        cum[r["source"]] += r["n_tokens"]
        assert r["finish_time"] == pytest.approx(cum[r["source"]] / rep["m", r["source"]]["target_share"])
        assert r["finish_time"] >= last
        last = r["finish_time"]


def test_bucket_size_changes_nothing(spark, monkeypatch):
    docs, targets = some(800, 3), [("m", "big", 0.6, 1), ("m", "tiny", 0.4, 8)]
    a = {tuple(r) for r in run(spark, docs, targets)[0]}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    b, _ = run(spark, docs, targets)
    key = lambda rows: Counter((r[2], r[3]) for r in rows)
    assert key(a) == key(b)


def test_missing_source_null_and_repeats(spark):
    docs = [(1, "a", 10), (1, "a", 10), (2, "a", 0), (3, None, 10), (4, "b", 10), (None, "a", 10), (5, "zzz", 10)]
    mix, rep = run(spark, docs, [("m", "a", 0.4, 2), ("m", "b", 0.4, 2), ("m", "gone", 0.2, 3), ("m", "b", 0.4, 2)])
    assert {r["doc_id"] for r in mix} == {1, 4} and rep["m", "gone"]["tokens_used"] == 0
    assert rep["m", "a"]["actual_share"] == pytest.approx(0.5) and rep["m", "a"]["uses"] == 2


def test_given_budget_and_short_source(spark):
    docs = some(500, 5)
    total = sum(n for _, s, n in docs if s == "tiny")
    mix, rep = run(spark, docs, [("m", "big", 0.5, 1), ("m", "tiny", 0.5, 1)], budgets={"m": total * 4})
    assert rep["m", "tiny"]["tokens_used"] == total and sum(r["n_tokens"] for r in mix) <= total * 4
    assert rep["m", "big"]["tokens_used"] > total


def test_empty(spark):
    mix, rep = run(spark, [], [("m", "a", 1.0, 2)])
    assert mix == [] and rep["m", "a"]["actual_share"] == 0
    assert run(spark, [(1, "a", 5)], []) == ([], {})


def test_one_large_document_waits_while_many_small_ones_are_served(spark):
    docs = [(i, "A", 10_000) for i in range(5)] + [(100 + i, "B", 10) for i in range(1_000)]
    mix, _ = run(spark, docs, [("m", "A", 0.9, 2), ("m", "B", 0.1, 2)], budgets={"m": 5_000})
    # B's k-th document is done at 100 k, A's first at 11,111; the next one in order would go beyond the budget.
    assert Counter(r["source"] for r in mix) == {"B": 111}


@pytest.mark.parametrize("seed", range(4))
def test_same_as_one_queue_in_memory(spark, monkeypatch, seed):
    """All packets sorted by finish time and cut at the budget, whatever the sizes of documents, buckets and blocks."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    rng = random.Random(seed)
    docs = [(i, rng.choice("abc"), rng.choice([1, 5, 40, 3_000])) for i in range(300)]
    have = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    weight, most = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1, "b": 2, "c": 3}
    feasible = min(most[s] * have[s] / weight[s] for s in "abc")
    budget = int(feasible * rng.choice([0.05, 0.4, 1.0, 1.3]))
    mix, _ = run(spark, docs, [("m", s, weight[s], most[s]) for s in "abc"], budgets={"m": budget})
    got = sorted(mix, key=lambda r: r["position"])
    assert sum(r["n_tokens"] for r in got) <= budget and len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got)
    # The order inside a queue is the operator's shuffle; with it, the rest of every queue follows by size only.
    served = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in "abc"}
    end = max(r["finish_time"] for r in got)
    for s in "abc":
        left = most[s] * have[s] - served[s]
        assert left == 0 or (served[s] + max(n for _, x, n in docs if x == s)) / weight[s] > end
    total = sum(served.values())
    assert total + 3_000 > budget or total == sum(most[s] * have[s] for s in "abc")
