"""Splitting: ranges of any size and files give the pieces of one sequential pass."""

import random

import numpy as np
import pytest

from knowloom.llm import splitting as S

PARTS = ["a", "b", " ", "\n", "\n\n", ". ", "。", "，", "é", "🚀", "word", "\r\n", "x" * 50, "‍", "”"]


def sequential(t, rule):
    lv = S.levels(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32))
    s, out = 0, []
    while s + rule.limit < len(t):
        e = s + rule.limit
        for level in (5, 4, 3, 2, 1):
            fit = [p for p in range(s + rule.least + 1, s + rule.limit + 1) if lv[p] >= level]
            if fit:
                e = fit[-1]
                break
        out.append((s, e))
        s = e - rule.overlap
    return [*out, (s, len(t))]


def ranged(t, rule, size):
    parts = [(t[a - min(4, a) : a + size + rule.halo], min(4, a), min(size, len(t) - a)) for a in range(0, len(t), size)]
    entry, at, out = 0, 0, []
    for part, left, n in parts:
        to, _ = S.entry_table(S.next_starts(part, left, n, rule)[1], n, rule)
        if entry >= 0:
            out += [(at + s, at + e) for s, e, _ in S.pieces_from(part, left, n, entry, rule)]
            entry = int(to[entry])
        at += n
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ranges_equal_one_pass(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 500)))
    rule = S.Rule(rng.choice([16, 40, 100]), rng.choice([0, 3, 7]))
    want = sequential(t, rule)
    assert all(ranged(t, rule, size) == want for size in (13, 64, 5000))
    assert all(e - s <= rule.limit for s, e in want)


def test_composition_is_associative():
    rule = S.Rule(40, 7)
    rng = random.Random(1)
    t = "".join(rng.choice(PARTS) for _ in range(300))
    tabs = []
    for a in range(0, len(t), 60):
        tabs.append(S.entry_table(S.next_starts(t[a - min(4, a) : a + 60 + rule.halo], min(4, a), min(60, len(t) - a), rule)[1], min(60, len(t) - a), rule))
    a, b, c = tabs[:3]
    x, y = S.compose(S.compose(a, b), c), S.compose(a, S.compose(b, c))
    assert (x[0] == y[0]).all() and (x[1] == y[1]).all()


def test_cuts_at_the_strongest_boundary():
    t = "w " * 180 + "end.\n\n" + "v " * 200
    first = next(S.pieces_from(t, 0, len(t), 0, S.Rule()))
    assert first[2].endswith("end.\n\n")


SCHEMA = "chunk_id string, content string, item string, part string, r int"


def test_chunks(spark):
    rng = random.Random(7)
    big = "".join(rng.choice(PARTS) for _ in range(9000))
    rows = [("c1", big), ("c1", big), ("c2", "x" * 512), ("c3", "x" * 513), ("c4", None), ("c5", ""), (None, "y " * 400), ("c6", " " * 600), ("c7", "中文。" * 300)]
    df = spark.createDataFrame([(*r, "i", "p", 1) for r in rows], SCHEMA)
    for size in (700, 65_536):
        got = S.split_chunks(df, range_chars=size).collect()
        assert len({r["chunk_id"] for r in got}) == len(got)
        by = {}
        for r in sorted(got, key=lambda r: r["piece_index"]):
            by.setdefault(r["parent_chunk_id"], []).append(r)
        assert set(by) == {"c1", "c3", "", "c6", "c7"}
        for parent, text in (("c1", big), ("c3", "x" * 513), ("c6", " " * 600), ("c7", "中文。" * 300)):
            ps = by[parent]
            assert [(r["char_start"], r["char_end"]) for r in ps] == sequential(text, S.Rule())
            assert all(r["content"] == text[r["char_start"] : r["char_end"]] and len(r["content"]) <= 512 for r in ps)
            assert all(b["char_start"] == a["char_end"] - 64 and a["content"][-64:] == b["content"][:64] for a, b in zip(ps, ps[1:]))
            assert [r["piece_index"] for r in ps] == list(range(len(ps)))
    assert {r[0] for r in S.oversized_chunks(df).collect()} == {"c1", "c3", "", "c6", "c7"}
    assert S.split_chunks(df.limit(0)).count() == 0


def test_many_blocks(spark, monkeypatch):
    t = "".join(random.Random(3).choice(PARTS) for _ in range(6000))
    df = spark.createDataFrame([("k", t)], "id string, t string")
    got = [(r["char_start"], r["char_end"]) for r in _small_blocks(S, monkeypatch, df).orderBy("piece_index").collect()]
    assert got == sequential(t, S.Rule(64, 8))


def _small_blocks(S, monkeypatch, df):
    real = S.stitch
    monkeypatch.setattr(S, "stitch", lambda tables, rule: real(tables, rule, block=3))
    return S.split_texts(df, "id", "t", 64, 8, range_chars=200)


def test_files(spark, tmp_path):
    rng = random.Random(5)
    texts = {"a.txt": "".join(rng.choice(PARTS) for _ in range(5000)), "b.txt": "short", "c.txt": ""}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    got = S.split_files(spark, str(tmp_path), range_bytes=4_096).orderBy("piece_index").collect()
    assert {r["item"].rsplit("/", 1)[1] for r in got} == {"a.txt"}
    assert [(r["char_start"], r["char_end"]) for r in got] == sequential(texts["a.txt"], S.Rule())
    assert all(r["content"] == texts["a.txt"][r["char_start"] : r["char_end"]] for r in got)
