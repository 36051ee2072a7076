"""Encoding a corpus with a public byte-level BPE tokenizer, long texts in parallel.

Short texts are encoded where they are read. A long text is cut into leaves of a fixed number of characters, wherever that is; the
leaves are encoded in parallel, each as if it were a text. Neighbours are then joined in a tree: FAN of them in a task, and the
results again. Around a join, text is split and encoded again in a window that grows until it agrees with both sides:

- On the left it begins before the last two pre-tokens, as what follows can change no more than these (a contraction looks two
  characters ahead, white space to its end). On the right it grows until one of its own boundaries is one of the right side's as
  well; from there on both are split alike, as a pre-token depends on nothing before it.
- Where one pre-token goes on over the join, as in text without any blank, its two encodings are merged: tokens around the join are
  encoded again until the window's first and last token are those of the left and the right side. Such a sequence is the one
  encoding of the whole: byte-pair encoding is decided by adjacent pairs of tokens alone, and every adjacent pair occurs in an
  encoding of its own.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.session import row_count, spread

TOKENIZERS = os.environ.get("KNOWLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; texts of more are cut. Neighbours that one task joins.
LEAF, FAN = 4_096, 256
_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, name: str, folder: str) -> None:
    """Send the vocabulary to the Python workers, once per application: they needn't have its folder."""
    app = (spark.sparkContext.applicationId, f"{folder}/{name}.tiktoken")
    if app not in _SHIPPED and os.path.exists(app[1]):
        spark.sparkContext.addFile(app[1])
        _SHIPPED.add(app)


@functools.lru_cache(maxsize=8)
def encoding(name: str, folder: str, whole: bool = False) -> tiktoken.Encoding:
    """The rank file `name`.tiktoken, loaded once per Python worker; whole: every text is one pre-token."""
    path = f"{folder}/{name}.tiktoken"
    try:
        sent = SparkFiles.get(f"{name}.tiktoken")
        path = sent if os.path.exists(sent) else path
    except Exception:  # noqa: BLE001, S110
        pass  # no Spark here
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name + "-whole" * whole, pat_str=r"[\s\S]+" if whole else PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _probe() -> tiktoken.Encoding:
    """An encoding that shows whether a character continues a word or a number: its first byte merges with `a` and `1`."""
    ranks = {bytes([b]): b for b in range(256)}
    for first in (b"a", b"1"):
        for b in range(0xC2, 0xF5):
            ranks[first + bytes([b])] = len(ranks)
    return tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=100_000)
def _stand_in(c: str) -> str:
    """A character of the class in which the encoder has c."""
    n = len(c.encode())
    return next((x for x in "a1" if len(_probe().encode_ordinary(x + c)) == n), "!")


def splittable(text: str) -> str:
    """The text with stand-ins for characters so new that the encoder may not know their class, which is what splits text."""
    new = {} if text.isascii() else {ord(c): _stand_in(c) for c in set(text) if unicodedata.category(c) == "Cn"}
    return text.translate(new) if new else text


class Joiner:
    """Encodes leaves and joins neighbours. A node is (ids, ends): ends[i] is the number of ids up to the end of pre-token i."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        self.enc, self.whole = encoding(name, folder), encoding(name, folder, True)
        self.pattern = regex.compile(PATTERN)
        tokens = self.enc.token_byte_values()
        lengths = {self.enc.encode_single_token(t): len(t) for t in tokens}
        self.size = np.array([lengths.get(i, 0) for i in range(max(lengths) + 1)])

    def text(self, ids: list[int]) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def leaf(self, text: str) -> tuple[list[int], list[int]]:
        ids = self.enc.encode_ordinary(text)
        at = np.cumsum([len(text[m.start() : m.end()].encode("utf-8", "surrogatepass")) for m in self.pattern.finditer(splittable(text))])
        if not ids:
            return [], []
        to = np.cumsum(self.size[ids])
        k = np.searchsorted(to, at)
        # Should the two libraries know different letters, only what both take for a boundary is one.
        return ids, (k[to[k] == at] + 1).tolist()

    def _inside(self, token: int) -> bool:
        """The token begins within a character."""
        return self.enc.decode_single_token_bytes(token)[0] & 0xC0 == 0x80

    def merge(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one pre-token, from the encodings of each, by growing windows."""
        n = 2
        while True:
            i, j = max(0, len(a) - n), min(len(b), n)
            while i and self._inside(a[i]):
                i -= 1
            while j < len(b) and self._inside(b[j]):
                j += 1
            w = self.whole.encode_ordinary(self.text(a[i:] + b[:j]))
            all_ = i == 0 and j == len(b)
            if all_ or (len(w) > 1 and (i == 0 or w[0] == a[i]) and (j == len(b) or w[-1] == b[j - 1])):
                return a[:i] + w + b[j:]
            n *= 2

    def join(self, a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        (ia, ea), (ib, eb) = a, b
        if not ia or not ib:
            return a if ia else b
        keep = max(0, len(ea) - 2)
        s = ea[keep - 1] if keep else 0
        left = self.text(ia[s:])
        last = len(left) - len(self.text(ia[ea[-2] :] if len(ea) > 1 else ia))  # where the left side's last pre-token begins
        own, right, n = [len(left)], "", 4
        while True:
            for k in range(len(own) - 1, min(n, len(eb))):
                right += self.text(ib[eb[k - 1] if k else 0 : eb[k]])
                own.append(len(left) + len(right))
            cuts = [m.end() for m in self.pattern.finditer(splittable(left + right))]
            safe = cuts if len(own) > len(eb) else cuts[:-2]
            k = next((k for k, e in enumerate(own) if e in set(safe)), None)
            if k is not None:
                break
            n *= 2
        text, ids, ends, x = left + right, ia[:s], ea[:keep], 0
        for y in cuts[: cuts.index(own[k]) + 1]:
            if x == last and y == own[1] and k:
                got = self.merge(ia[ea[-2] if len(ea) > 1 else 0 :], ib[: eb[0]])
            else:
                got = self.whole.encode_ordinary(text[x:y])
            ids = ids + got
            ends = [*ends, len(ids)]
            x = y
        from_ = eb[k - 1] if k else 0
        shift = len(ids) - from_
        return ids + ib[from_:], ends + [e + shift for e in eb[k:]]

    def tree(self, nodes: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
        """Join neighbours level by level."""
        while len(nodes) > 1:
            nodes = [self.join(nodes[k], nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0] if nodes else ([], [])


@functools.lru_cache(maxsize=4)
def joiner(name: str, folder: str) -> Joiner:
    return Joiner(name, folder)


def encode_text(text: str | None, leaf: int = LEAF, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[int]:
    """One text in one place: as the distributed way does it."""
    j = joiner(name, folder)
    return j.tree([j.leaf(text[a : a + leaf]) for a in range(0, len(text), leaf)])[0] if text else []


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF, fan: int = FAN, counts_only: bool = False, extra: list[str] | None = None) -> DataFrame:
    """(<id>, ids array<int>) for every row, or with counts_only (<id>, n_tokens bigint).

    Empty and null texts have the empty list. Strings of special tokens in a text are ordinary text. Every row comes out,
    repeated ones too; a null id stays null. Texts of more than `leaf` characters are encoded by leaves and joined.
    """
    ship(df.sparkSession, tokenizer, folder)
    extra = extra or []
    key = F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    rows = df.select(key.alias("key"), F.col(text_col).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    is_long = F.coalesce(F.length("t") > leaf, F.lit(False))
    schema = f"key {kind}, " + ("n bigint" if counts_only else "ids array<int>")
    last = "n" if counts_only else "ids"
    node = f"row bigint, key {kind}, k bigint, ids array<int>, ends array<int>"

    def result(ids: list[list[int]]) -> pa.Array:
        return pa.array(map(len, ids), pa.int64()) if counts_only else _lists(ids)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), result([enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()])], ["key", last])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(2)[i].as_py()
                for s in range(0, len(t), 1_000 * leaf):
                    parts = [t[a : a + leaf] for a in range(s, min(len(t), s + 1_000 * leaf), leaf)]
                    same = lambda c: c.take(pa.array([i] * len(parts)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(b.column(0)), same(b.column(1)), pa.array(range(s // leaf, s // leaf + len(parts)), pa.int64()), pa.array(parts, pa.string())], ["row", "key", "k", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = joiner(tokenizer, folder)
        for b in batches:
            got = [j.leaf(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists([x[0] for x in got]), _lists([x[1] for x in got])], ["row", "key", "k", "ids", "ends"])

    def join(batches: Iterator[pa.RecordBatch], block: bool) -> Iterator[pa.RecordBatch]:
        """Sorted nodes to one node for each block of neighbours, or to one result for each row."""
        j, at, held = joiner(tokenizer, folder), None, []

        def done() -> pa.RecordBatch:
            ids, ends = j.tree([x[2:] for x in held])
            row, k = at
            if block:
                return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), held[0][1], pa.array([k], pa.int64()), _lists([ids]), _lists([ends])], ["row", "key", "k", "ids", "ends"])
            return pa.RecordBatch.from_arrays([held[0][1], result([ids])], ["key", last])

        for b in batches:
            rows, ks, ids, ends = (b.column(i).to_pylist() for i in (0, 2, 3, 4))
            for i in range(b.num_rows):
                here = (rows[i], ks[i] // fan if block else 0)
                if here != at and held:
                    yield done()
                    held = []
                at = here
                held.append((ks[i], b.column(1).slice(i, 1), ids[i], ends[i]))
        if held:
            yield done()

    done = spread(rows.where(~is_long), "key", 5_000, row_count(df)).mapInArrow(short, schema)
    # A number of its own keeps rows with equal ids apart; what is shuffled is the leaves, by their own place.
    parts = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "key", "t").mapInArrow(cut, f"row bigint, key {kind}, k bigint, part string")
    nodes = parts.repartition("row", "k").mapInArrow(encode, node)
    blocks = nodes.repartition("row", F.floor(F.col("k") / fan)).sortWithinPartitions("row", "k").mapInArrow(lambda b: join(b, True), node)
    texts = blocks.repartition("row").sortWithinPartitions("row", "k").mapInArrow(lambda b: join(b, False), schema)
    out = done.unionByName(texts)
    return out.select(F.col("key.id").alias(id_col), *[F.col(f"key.x{i}").alias(c) for i, c in enumerate(extra)], F.col("n").alias("n_tokens") if counts_only else F.col("ids"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(<id>, <extra columns>, n_tokens) of every row."""
    return token_ids(df, id_col, text_col, counts_only=True, **kw)


def decoder(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A function on columns of ids, to their text; a null list stays null."""
    ship(spark, tokenizer, folder)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        enc = encoding(tokenizer, folder)
        return ids.map(lambda x: None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace"))

    return decode
