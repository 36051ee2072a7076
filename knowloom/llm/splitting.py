"""Splitting oversized items at natural boundaries, in parallel also within one giant item.

From a piece's start the cut is decided by the next `limit` characters alone: the latest of the strongest boundaries
(paragraph, line, sentence, word or clause, whole character) that leaves the piece at least `least` long; the next piece
starts `overlap` before it. So starts form a chain, and a range of a text is a function: from the place where the chain enters
it (one of the first limit - overlap offsets) to where it enters the next range. Workers compute that table for their own
range, with a halo around it, from its boundaries; tables are stitched by composing them, first in blocks of ranges, then over
the blocks; prefix sums of lengths and piece counts turn local offsets into places and numbers in the item; then every range
emits the pieces that start in it. The pieces are those of a single pass from the start, whatever the size of the ranges.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.session import materialize

LIMIT, OVERLAP = 512, 64
#: Characters of a range of a text in a table, bytes of a range of a file, ranges composed into a block.
RANGE_CHARS, RANGE_BYTES, BLOCK = 4_096, 1 << 20, 256
LEFT_HALO = 4

#: Characters that end lines, sentences and clauses, and ranges of characters that belong to the one before.
LINE_ENDS = [0x0A, 0x0B, 0x0C, 0x85, 0x2028, 0x2029]
SENTENCE_ENDS = [ord(c) for c in ".!?…"]
WIDE_SENTENCE_ENDS = [ord(c) for c in "。！？｡"]
WIDE_CLAUSE_ENDS = [ord(c) for c in "，；：、"]
CLOSERS = [ord(c) for c in "\"')]}”’»」』）"]
SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
JOINED = [(0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200C, 0x200D), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x1F3FB, 0x1F3FF), (0xE0100, 0xE01EF)]


@dataclass(frozen=True)
class Rule:
    limit: int = LIMIT
    overlap: int = OVERLAP

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit // 2:
            raise ValueError("the overlap must be less than half of the limit")

    @property
    def least(self) -> int:
        return max(self.limit // 2, self.overlap + 1)

    @property
    def span(self) -> int:
        """The chain enters a range at one of so many offsets."""
        return self.limit - self.overlap

    @property
    def halo(self) -> int:
        return self.limit + 2


SPACE, LINE, END, WIDE_END, WIDE_CLAUSE, CLOSE, JOIN = (1 << i for i in range(7))


@functools.cache
def _classes() -> np.ndarray:
    """A byte of class flags for each code point."""
    t = np.zeros(0x110000, np.uint8)
    for flag, members in ((SPACE, SPACES), (LINE, LINE_ENDS), (END, SENTENCE_ENDS), (WIDE_END, WIDE_SENTENCE_ENDS), (WIDE_CLAUSE, WIDE_CLAUSE_ENDS), (CLOSE, CLOSERS)):
        t[members] |= flag
    for a, b in JOINED:
        t[a : b + 1] |= JOIN
    return t


def levels(cp: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each character (and after the last): 5 paragraph ... 1 whole character, 0 none."""
    c = np.concatenate([np.zeros(3, cp.dtype), cp, np.zeros(1, cp.dtype)])
    f = _classes()[c]
    (cur, p1, p2, p3), (fcur, f1, f2, f3) = ([x[3 - k : len(x) - k] for k in range(4)] for x in (c, f))
    into_space = fcur & SPACE > 0
    line = (f1 & LINE > 0) | ((p1 == 0x0D) & (cur != 0x0A))
    para = (p1 == 0x0A) & ((p2 == 0x0A) | ((p2 == 0x0D) & (p3 == 0x0A)))
    inside = (fcur & JOIN > 0) | (p1 == 0x200D) | ((p1 == 0x0D) & (cur == 0x0A))
    after_space = (f1 & SPACE > 0) & ~into_space
    ended = (f2 & END > 0) | ((f2 & CLOSE > 0) & (f3 & END > 0))
    wide = (f1 & WIDE_END > 0) & (fcur & (WIDE_END | CLOSE) == 0)
    out = np.ones(len(cur), np.int8)
    for level, cond in ((2, after_space | (f1 & WIDE_CLAUSE > 0)), (3, (after_space & ended) | wide), (4, line), (5, para)):
        out[cond] = level
    out[inside] = 0
    return out


def cuts(text: str, left: int, n: int, rule: Rule) -> np.ndarray:
    """For every start in the range (offsets 0..n-1, after `left` characters of halo) the offset of its piece's end.

    A text that ends within the halo ends there for good: pieces that can reach its end do.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lv = levels(cp)[left:]
    end = len(cp) - left
    starts = np.arange(n)
    top = np.minimum(starts + rule.limit, end)
    out = np.where(starts + rule.limit >= end, end, -1)
    for level in (5, 4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(lv >= level, np.arange(len(lv)), -1))[top]
        out = np.where((out < 0) & (last > starts + rule.least), last, out)
    return np.where(out < 0, top, out)


def next_starts(text: str, left: int, n: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(ends, next starts); -1 where the piece is the item's last."""
    ends = cuts(text, left, n, rule)
    return ends, np.where(ends >= len(text) - left, -1, ends - rule.overlap)


def entry_table(nxt: np.ndarray, n: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """For each entry offset: where the chain enters the next range (-1: ended), and how many pieces start in this one."""
    pos = np.arange(rule.span)
    count = np.zeros(rule.span, np.int64)
    while (live := (pos >= 0) & (pos < n)).any():
        count[live] += 1
        pos[live] = nxt[pos[live]]
    return np.where(pos < 0, -1, pos - n), count


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The table of two neighbouring ranges together; associative."""
    e, c = first
    on = e >= 0
    return np.where(on, then[0][np.maximum(e, 0)], -1), c + np.where(on, then[1][np.maximum(e, 0)], 0)


def pieces_from(text: str, left: int, n: int, entry: int, rule: Rule) -> Iterator[tuple[int, int, str]]:
    """(offset, end, piece) of the pieces that start in the range, the chain entering it at `entry`."""
    ends, nxt = next_starts(text, left, n, rule)
    s = entry
    while 0 <= s < n:
        yield s, int(ends[s]), text[left + s : left + ends[s]]
        s = int(nxt[s])


RANGES = "item string, r bigint, lead int, n int, part string"
PIECES = "item string, piece_index bigint, char_start bigint, char_end bigint, content string"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item", "piece_index", "char_start", "char_end", "content"])


def _tables(ranges: DataFrame, rule: Rule) -> DataFrame:
    """Each range's boundary table: (item, r, n, to, cnt). A range has far fewer pieces than an int holds."""

    def work(batches):
        for b in batches:
            items, rs, lefts, ns, parts = (c.to_pylist() for c in b.columns[:5])
            to, cnt = [], []
            for left, n, part in zip(lefts, ns, parts):
                e, c = entry_table(next_starts(part, left, n, rule)[1], n, rule)
                to.append(e.astype(np.int32))
                cnt.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rs, pa.int64()), pa.array(ns, pa.int64()), pa.array(to, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], ["item", "r", "n", "to", "cnt"])

    return ranges.mapInArrow(work, "item string, r bigint, n bigint, to array<int>, cnt array<int>")


def stitch(tables: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """(item, r, entry, first_piece, char0): where the chain enters each range, the number of its first piece, its place.

    Composes blocks of ranges in parallel, walks each item's blocks, then each block's ranges. A task holds the tables of one
    block, or of one item's blocks (BLOCK ranges each), never an item's text.
    """

    def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
        """Rows of sorted partitions, a list for each group; tables are arrays."""
        held: list[dict] = []
        for b in batches:
            single = [(c, b.column(c).to_pylist()) for c in b.schema.names if c not in ("to", "cnt")]
            for i in range(b.num_rows):
                row = {c: v[i] for c, v in single} | {c: b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("to", "cnt")}
                if held and any(row[k] != held[0][k] for k in keys):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def whole_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "item", "blk"):
            to, cnt = functools.reduce(compose, ((x["to"].astype(np.int64), x["cnt"].astype(np.int64)) for x in g))
            yield pa.RecordBatch.from_pylist([{"item": g[0]["item"], "blk": g[0]["blk"], "n": sum(x["n"] for x in g), "to": to.tolist(), "cnt": cnt.tolist()}], pa.schema([("item", pa.string()), ("blk", pa.int64()), ("n", pa.int64()), ("to", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int64()))]))

    def walk(batches: Iterator[pa.RecordBatch], key: str, *keys: str) -> Iterator[pa.RecordBatch]:
        """Where the chain enters each member of a group, from where it enters the first."""
        fields = pa.schema([("item", pa.string()), (key, pa.int64()), ("entry", pa.int64()), ("first_piece", pa.int64()), ("char0", pa.int64())])
        for g in groups(batches, *keys):
            entry, piece, char0 = (g[0].get(c, 0) for c in ("entry", "first_piece", "char0"))
            out = []
            for x in g:
                out.append({"item": x["item"], key: x[key], "entry": entry, "first_piece": piece, "char0": char0})
                if entry >= 0:
                    piece += int(x["cnt"][entry])
                    entry = int(x["to"][entry])
                char0 += x["n"]
            yield pa.RecordBatch.from_pylist(out, fields)

    out = "item string, {} bigint, entry bigint, first_piece bigint, char0 bigint"
    t = tables.withColumn("blk", F.floor(F.col("r") / block)).repartition("item", "blk")
    blocks = t.sortWithinPartitions("item", "blk", "r").mapInArrow(whole_block, "item string, blk bigint, n bigint, to array<int>, cnt array<bigint>")
    entries = blocks.repartition("item").sortWithinPartitions("item", "blk").mapInArrow(lambda b: walk(b, "blk", "item"), out.format("blk"))
    return t.join(entries, ["item", "blk"]).repartition("item", "blk").sortWithinPartitions("item", "blk", "r").mapInArrow(lambda b: walk(b, "r", "item", "blk"), out.format("r"))


def _emit(ranges: DataFrame, entries: DataFrame, rule: Rule) -> DataFrame:
    def work(batches):
        for b in batches:
            for item, left, n, part, entry, first, char0 in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("item", "lead", "n", "part", "entry", "first_piece", "char0"))):
                yield _piece_batch([(item, first + i, char0 + s, char0 + e, p) for i, (s, e, p) in enumerate(pieces_from(part, left, n, entry, rule))])

    return ranges.join(entries, ["item", "r"]).where("entry >= 0").select("item", "lead", "n", "part", "entry", "first_piece", "char0").mapInArrow(work, PIECES)


def split_texts(df: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(item, piece_index, char_start, char_end, content): the pieces of every text of more than `limit` characters.

    - Lengths are Unicode code points of the text as stored, untrimmed; every character is in some piece.
    - Null, empty and short texts yield nothing. Items must be unique strings; a null item is left out.
    - A text of up to range_chars characters is one range and is cut where it is read, without a shuffle.
    """
    rule = Rule(limit, overlap)
    rows = df.select(F.col(item).alias("item"), F.col(text).alias("t")).where((F.length("t") > limit) & F.col("item").isNotNull())

    def single(batches):
        for b in batches:
            out: list[tuple] = []
            for it, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(it, i, s, e, p) for i, (s, e, p) in enumerate(pieces_from(t, 0, len(t), 0, rule))]
            yield _piece_batch(out)

    def ranges(batches):
        for b in batches:
            for it, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, a in enumerate(range(0, len(t), range_chars)):
                    left, n = min(LEFT_HALO, a), min(range_chars, len(t) - a)
                    yield pa.RecordBatch.from_arrays([pa.array([it]), pa.array([r], pa.int64()), pa.array([left], pa.int32()), pa.array([n], pa.int32()), pa.array([t[a - left : a + n + rule.halo]])], ["item", "r", "lead", "n", "part"])

    small = rows.where(F.length("t") <= range_chars).mapInArrow(single, PIECES)
    cut = rows.where(F.length("t") > range_chars).mapInArrow(ranges, RANGES).repartition("item", "r")
    return small.unionByName(_emit(cut, stitch(_tables(cut, rule), rule), rule))


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As split_texts for UTF-8 files under `path` (a folder, file or glob), item being the file's address.

    No file is read as a whole: the listing has sizes only, each worker reads its byte range and a halo on both sides. A
    range begins at its first whole character; undecodable bytes become U+FFFD.
    """
    rule = Rule(limit, overlap)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = files.where("length > 0").select(F.col("path").alias("item"), "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes))).alias("r")).repartition("item", "r")

    def read(batches):
        for b in batches:
            for it, size, r in zip(*(c.to_pylist() for c in b.columns[:3])):
                fs, p = pafs.FileSystem.from_uri(it.replace("file:/", "file:///", 1) if it.startswith("file:/") and not it.startswith("file://") else it)
                a, e = r * range_bytes, min(size, (r + 1) * range_bytes)
                lo, hi = max(0, a - 4 * LEFT_HALO), min(size, e + 4 * rule.halo)
                with fs.open_input_file(p) as f:
                    f.seek(lo)
                    raw = f.read(hi - lo)
                first = lambda x: next((k for k in range(x, min(x + 4, len(raw))) if raw[k] & 0xC0 != 0x80), x) if 0 < x < len(raw) else x
                s, t = (first(a - lo) if a else 0), (first(e - lo) if e < size else len(raw))
                head = raw[first(0) if lo else 0 : s].decode("utf-8", "replace")
                body = raw[s:t].decode("utf-8", "replace")
                tail = raw[t:].decode("utf-8", "replace")
                if hi < size:
                    tail = tail[: rule.halo]
                left = min(LEFT_HALO, len(head))
                yield pa.RecordBatch.from_arrays([pa.array([it]), pa.array([r], pa.int64()), pa.array([left], pa.int32()), pa.array([len(body)], pa.int32()), pa.array([head[len(head) - left :] + body + tail])], ["item", "r", "lead", "n", "part"])

    ranges = parts.select("item", "length", "r").mapInArrow(read, RANGES)
    tables = materialize(_tables(ranges, rule), "tables")
    long = tables.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("item")
    return _emit(ranges, materialize(stitch(tables.join(long, "item", "left_semi"), rule), "entries"), rule)


def split_chunks(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of the oversized chunks: (chunk_id, parent_chunk_id, piece_index, char_start, char_end, content).

    Identical repeated rows are one item. A piece's chunk_id is its parent's, a mark of the content and its number, so chunks
    that share an id but not the content keep apart. A null chunk_id counts as an empty one.
    """
    item = F.concat_ws("~", F.coalesce("chunk_id", F.lit("")), F.substring(F.sha2("content", 256), 1, 12))
    big = df.select(item.alias("item"), "content").where(F.length("content") > limit)
    one = big.groupBy("item").agg(F.first("content").alias("content"))  # equal items have equal contents
    out = split_texts(one, "item", "content", limit, overlap, range_chars)
    return out.select(
        F.concat_ws("-", "item", F.col("piece_index").cast("string")).alias("chunk_id"),
        F.expr("substring(item, 1, length(item) - 13)").alias("parent_chunk_id"),
        "piece_index", "char_start", "char_end", "content",
    )


def oversized_chunks(df: DataFrame, **kw) -> DataFrame:
    """(chunk_id) of every chunk that came out as several pieces."""
    return split_chunks(df, **kw).where("piece_index = 1").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
