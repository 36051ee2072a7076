"""Token ids: the distributed way gives the ids of the tokenizer on the whole text."""

import random

import pytest

from knowloom.llm import tokens as T

PARTS = ["a", "b", "the", " ", "\n", "  ", "é", "中", "文字", "'s", "'", "!", "9", "12", "　", "\xa0", "🚀", "e", "n", "<|endoftext|>", "\t", "\x1c", "\x85", "​", "²", "́"]


@pytest.fixture(scope="module")
def enc():
    return T.encoding("byte_bpe_50k", T.TOKENIZERS)


@pytest.mark.parametrize("seed", range(8))
def test_leaves_and_tree(enc, seed):
    """Leaves cut anywhere, joined in a tree, give the ids of the whole."""
    rng = random.Random(seed)
    for _ in range(120):
        some = rng.sample(PARTS, rng.randint(1, 6))
        t = "".join(rng.choice(some) for _ in range(rng.randint(1, 120)))
        want = enc.encode_ordinary(t)
        for leaf in (1, 2, 5, 20, 50):
            assert T.encode_text(t, leaf) == want, (t, leaf)


@pytest.mark.parametrize("new", [0x1C89, 0xA7CB, 0x105C0, 0x16D70, 0x323B0, 0x3D000, 0x378, 0xE000])
def test_characters_that_only_one_library_knows(enc, new):
    for seed in range(40):
        rng = random.Random(seed)
        t = "".join(rng.choice(["a", " ", "1", "!", "\n", chr(new), chr(new), "'s"]) for _ in range(60))
        for leaf in (1, 3, 7):
            assert T.encode_text(t, leaf) == enc.encode_ordinary(t), t


def test_one_word_and_one_blank_over_many_leaves(enc):
    rng = random.Random(4)
    for t in ("ab" * 3_000, "".join(rng.choice("abcdefgh") for _ in range(6_000)), "文字中" * 1_500, " " * 5_000 + "x", "x" + "\n" * 4_000, "é" * 3_000 + "'ll" * 900, "'" * 2_000 + "re"):
        assert T.encode_text(t, 64) == enc.encode_ordinary(t)


def test_windows_stay_small(enc, monkeypatch):
    """A join encodes some tokens around it again, not the sides."""
    j = T.Joiner()
    a, b = (j.leaf("".join(random.Random(s).choice("abcdefgh") for _ in range(5_000))) for s in (1, 2))
    seen = []
    real = j.whole.encode_ordinary
    j.whole = type("W", (), {"encode_ordinary": staticmethod(lambda t: seen.append(len(t)) or real(t))})()
    ids, _ = j.join(a, b)
    assert ids == enc.encode_ordinary(j.text(a[0]) + j.text(b[0])) and sum(seen) < 500


def test_tables(spark, enc):
    rng = random.Random(1)
    texts = ["hello world", "", None, "a" * 30_000, "中文字" * 9_000, "word and more. " * 3_000, "<|endoftext|>", " " * 20_000 + "x", "".join(rng.choice("abcdefg") for _ in range(40_000))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)] + [(0, "hello world", "k", 1), (None, "x", "k", 1)], "doc_id bigint, text string, key string, n int")
    got = sorted(((r["doc_id"], r["ids"]) for r in T.token_ids(df).collect()), key=str)
    want = sorted([(i, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts)] + [(0, enc.encode_ordinary("hello world")), (None, enc.encode_ordinary("x"))], key=str)
    assert got == want
    small = T.token_ids(df, leaf=100, fan=3)
    assert sorted(((r["doc_id"], r["ids"]) for r in small.collect()), key=str) == want
    counts = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df, extra=["key"]).where("doc_id > 0").collect()}
    assert counts == {i: len(x) for i, x in want if i}
    assert T.token_ids(df.limit(0)).count() == 0


def test_agrees_with_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice(PARTS) for _ in range(40))
        assert t.encode(s, add_special_tokens=False).ids == T.encode_text(s, 8)
