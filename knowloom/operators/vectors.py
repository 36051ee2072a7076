"""Vector store operators: upsert, deletes, exact and approximate search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.session import materialize

TOP_K = 5
#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 8_192


def upsert_latest(log: DataFrame, key: str, seq: list[str], columns: list[str]) -> DataFrame:
    """Last write per key: an append-only log's current rows. Ties in seq go to the greatest row."""
    last = F.max(F.struct(*seq, *[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)])).alias("m")
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"m.c_{i}").alias(c) for i, c in enumerate(columns)])


def delete_by(vectors: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed): vectors without and with an id in `ids`; rows with a null id survive."""
    i = ids.select(on).where(F.col(on).isNotNull()).distinct()
    return vectors.join(i, on, "left_anti"), vectors.join(i, on, "left_semi")


def chunks_of(vectors: DataFrame, doc_id: str) -> DataFrame:
    return vectors.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def chunks_in_order(vectors: DataFrame) -> DataFrame:
    """The chunks of all documents with their `position` (from 1) in the document, by index, then id; a document has a bounded number."""
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("chunk_index"), "chunk_id")
    return vectors.where("doc_id is not null").withColumn("position", F.row_number().over(w))


def cosine_matrix(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine with single-precision products and double-precision sums, as the column expression has it."""
    n = min(q.shape[1], v.shape[1])
    q, v = q[:, :n].astype(np.float32), v[:, :n].astype(np.float32)
    norm = lambda x: np.sqrt((x * x).sum(axis=1, dtype=np.float64))
    dots = np.stack([(v * row).sum(axis=1, dtype=np.float64) for row in q]) if len(q) else np.zeros((0, len(v)))
    return dots / (norm(q)[:, None] * norm(v)[None, :] + 1e-10)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def exact_topk(vectors: DataFrame, queries: DataFrame, vid: str, qid: str, vec: str = "embedding", k: int = TOP_K, skip_self: bool = True) -> DataFrame:
    """(<qid> as query_id, <vid> as vec_id, score, rank): the k most similar vectors of each query; ties by id.

    A stated set of queries against all vectors, in blocks: a task takes one block of queries and one of vectors, both of a
    bounded size, and keeps k rows per query; what is gathered is k x queries x blocks rows, not the scores.
    Null vectors take no part; vectors of another length count over the shorter length.
    """
    nq, nv = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(vectors.count() / VECTOR_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where(F.col(vec).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).cast("bigint").alias("vec_id"), F.col(vec).alias("v"), block(vid, nv).alias("vb"), every(nq).alias("qb"))
    q = queries.where(F.col(vec).isNotNull() & F.col(qid).isNotNull()).select(F.col(qid).cast("bigint").alias("query_id"), F.col(vec).alias("q"), block(qid, nq).alias("qb"), every(nv).alias("vb"))
    got = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(lambda a, b: _score(a, b, k, skip_self), "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _score(vs: pd.DataFrame, qs: pd.DataFrame, k: int, skip_self: bool = True) -> pd.DataFrame:
    """The k best of a block of vectors for each query of a block; vectors of equal lengths are scored together."""
    out = []
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(vs["v"]):
        by_length.setdefault(len(x), []).append(i)
    groups = [(np.stack([np.asarray(vs["v"].iloc[i], np.float32) for i in at]), vs["vec_id"].to_numpy()[at]) for at in by_length.values()]
    for q_, x in zip(qs["query_id"], qs["q"]) if groups else ():
        s = np.concatenate([cosine_matrix(np.asarray(x, np.float32)[None, :], m)[0] for m, _ in groups])
        own = np.concatenate([ids for _, ids in groups])
        ok = own != q_ if skip_self else np.ones(len(own), bool)
        top = _best(s[ok], own[ok], k)
        out.append(pd.DataFrame({"query_id": q_, "vec_id": own[ok][top], "score": s[ok][top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def fit_lists(vectors: DataFrame, vec: str, lists: int, sample_rows: int = 20_000, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, sample) of an inverted-list index: k-means on a bounded sample of normalised vectors (at most sample_rows)."""
    v = vectors.where(F.col(vec).isNotNull()).select(vec).orderBy(F.xxhash64(F.lit(seed), F.col(vec))).limit(sample_rows).toPandas()[vec]
    x = np.stack([np.asarray(r, np.float32) for r in v]) if len(v) else np.zeros((1, 1), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(axis=0)
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-10
    return c, x


def probes_needed(centres: np.ndarray, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Lists to visit so that, on the fitted sample, a share `recall` of the true k nearest neighbours is in them."""
    q = sample[:queries]
    sims = q @ sample.T
    sims[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-sims, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each list in each query's order
    home = (sample @ centres.T).argmax(axis=1)
    ranks = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def ann_topk(vectors: DataFrame, queries: DataFrame, vid: str, qid: str, vec: str = "embedding", k: int = TOP_K, lists: int | None = None, recall: float = 0.95, salt_rows: int = 20_000, skip_self: bool = True) -> DataFrame:
    """As exact_topk, over an index of inverted lists: every vector is in one list, a query visits the nearest lists.

    All vectors are indexed; only the lists' centres are fitted on a sample. Lists are cut into salts of about salt_rows
    vectors, so that a list that holds a third of the vectors is still spread; a query goes to every salt of its lists.
    How many lists a query visits is measured on the sample, so that `recall` of the true neighbours are met; vectors without
    any structure need most of the lists. Tests hold the recall against brute force at 0.9 or more.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    lists = lists or max(4, min(4_096, round(math.sqrt(n) / 2)))
    centres, sample = fit_lists(vectors, vec, lists)
    probe = min(len(centres), probes_needed(centres, sample, k, recall))
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series, many: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, np.float32) for r in v])
        return pd.Series(list(np.argsort(-(x @ shared.value.T), axis=1)[:, : int(many.iloc[0])].astype(np.int32)))

    v = vectors.where(F.col(vec).isNotNull()).select(F.col(vid).cast("bigint").alias("vec_id"), F.col(vec).alias("v"), F.element_at(nearest(F.col(vec), F.lit(1)), 1).alias("list"))
    v = materialize(v, "ivf")
    salts = v.groupBy("list").agg(F.ceil(F.count("*") / salt_rows).alias("salts"))
    v = v.join(F.broadcast(salts), "list").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts"))).drop("salts")  # at most 4,096 lists
    q = queries.where(F.col(vec).isNotNull()).select(F.col(qid).cast("bigint").alias("query_id"), F.col(vec).alias("q"), F.explode(nearest(F.col(vec), F.lit(probe))).alias("list"))
    q = q.join(F.broadcast(salts), "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    got = v.groupBy("list", "salt").cogroup(q.groupBy("list", "salt")).applyInPandas(lambda a, b: _score(a, b, k, skip_self), "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def store_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.countDistinct("doc_id").alias("docs"), F.count("embedding").alias("embedded"))


def latest_where(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One whole row per key, the first in `order`; the limit is applied before the shuffle."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn_ = 1").drop("rn_")
