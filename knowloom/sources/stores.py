"""Stores as Parquet folders: snapshots, append-only logs (vectors, ledger, sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.operators.graph import delete_sources, drop_entities, merge_edges, merge_entities
from knowloom.operators.vectors import upsert_latest
from knowloom.schemas import CHUNK, EDGE, ENTITY, EVENT_STATE, MESSAGE
from knowloom.session import materialize

#: Shards are the first hex digits of a hash: few folders, however many rows.
SHARD_DIGITS = 2


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/*"))) > 0


class Log:
    """An append-only table: current rows are the last per key by `seq`, and a row with `deleted` ends its key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.schema = schema if " seq " in f" {schema.replace(',', ' ')}" else schema + ", seq bigint"
        self.columns = [f.split()[0] for f in _fields(self.schema)]

    def append(self, df: DataFrame, seq: int | None = None, deleted: bool = False) -> None:
        """Rows to the end of the log; columns that are missing are null, those the schema doesn't have are left out."""
        have = set(df.columns)
        types = dict(f.split(maxsplit=1) for f in _fields(self.schema))
        cols = [(F.lit(seq) if c == "seq" and seq is not None else F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in self.columns]
        df.select(*cols, F.lit(deleted).alias("deleted")).write.mode("append").parquet(self.path)

    def history(self) -> DataFrame:
        schema = self.schema + ", deleted boolean"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        rest = [c for c in self.columns if c not in (self.key, "seq")]
        x = upsert_latest(self.history(), self.key, ["seq", "deleted"], [*rest, "seq", "deleted"])
        return x.where(~F.col("deleted")).select(self.key, *rest, "seq")

    def delete(self, ids: DataFrame, seq: int) -> None:
        self.append(ids.select(self.key).distinct(), seq, deleted=True)


def _fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def vector_store(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, CHUNK, "chunk_id")


def event_ledger(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, EVENT_STATE, "event_id")


def session_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path) if exists(spark, path) else spark.createDataFrame([], MESSAGE)


class ShardedTable:
    """A table stored by shard of one of its columns; replacing rows rewrites only the shards that they are in."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path, schema, by
        self.columns = [f.split()[0] for f in _fields(schema)]

    def shard(self):
        """256 shards by hash; null values are in one of them."""
        return F.substring(F.sha2(F.coalesce(F.col(self.by), F.lit("")), 256), 1, SHARD_DIGITS)

    def read(self) -> DataFrame:
        full = self.schema + ", shard string"
        return self.spark.read.schema(full).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], full)

    def of(self, keys: DataFrame) -> DataFrame:
        """All rows of the shards that hold `keys` (a frame with the shard column's values)."""
        return self.read().join(keys.select(self.shard().alias("shard")).distinct(), "shard", "left_semi")

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """`rows` instead of all rows in the shards of `keys`. Rows may be derived from the table itself."""
        shards = keys.select(self.shard().alias("shard")).distinct()
        out = materialize(rows.select(*self.columns, self.shard().alias("shard")), "shards")
        empty = [r[0] for r in shards.join(out.select("shard").distinct(), "shard", "left_anti").collect()]  # at most 256
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)
        for s in empty:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/shard={s}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class SnapshotStore(ShardedTable):
    """The latest chunk list of each document, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, CHUNK + ", saved_at timestamp", "doc_id")

    def within(self, ttl_hours: int) -> DataFrame:
        return self.read().where(F.col("saved_at") > F.current_timestamp() - F.expr(f"interval {ttl_hours} hours"))

    def get(self, doc_id: str) -> DataFrame:
        one = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return self.of(one).where(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def save(self, chunks: DataFrame, docs: DataFrame | None = None) -> None:
        """Replace the chunk lists of `docs` (doc_id), by default those of the chunks; documents without chunks are removed."""
        docs = (chunks if docs is None else docs).select("doc_id").distinct()
        kept = self.of(docs).join(docs, "doc_id", "left_anti").select(*self.columns)
        new = chunks.select(*[F.col(c) if c in chunks.columns else F.lit(None).cast("array<float>").alias(c) for c in self.columns[:-1]], F.current_timestamp().alias("saved_at"))
        self.replace(docs, kept.unionByName(new))

    def delete(self, docs: DataFrame) -> None:
        self.save(self.spark.createDataFrame([], CHUNK), docs)


class GraphStore:
    """Entities and edges, each stored by shard of its source."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.entities = ShardedTable(spark, f"{path}/entities", ENTITY, "source")
        self.edges = ShardedTable(spark, f"{path}/edges", EDGE, "source")

    def upsert(self, entity_log: DataFrame, edge_log: DataFrame) -> None:
        """Merge ordered mentions (see graph.merge_entities) and edges of the same sources."""
        keys = entity_log.select("source").unionByName(edge_log.select("source")).distinct()
        merged = materialize(merge_entities(entity_log, self.entities.of(keys)), "entities")
        edges = merge_edges(edge_log, merged, ["confidence", "source", "chunk_id", "version", "updated_at"], existing=self.edges.of(keys).drop("shard"))
        self.entities.replace(keys, merged)
        self.edges.replace(keys, edges)

    def delete_sources(self, sources: DataFrame) -> None:
        e, r = delete_sources(self.entities.of(sources).drop("shard"), self.edges.of(sources).drop("shard"), sources)
        e = materialize(e, "entities")
        self.edges.replace(sources, r)
        self.entities.replace(sources, e)

    def delete_chunks(self, stale: DataFrame) -> None:
        """stale (source, chunk_id): as graph.delete_chunks, for many sources at once."""
        ids = stale.groupBy("source").agg(F.collect_set("chunk_id").alias("stale_"))  # the chunks of one document
        ents = self.entities.of(stale).drop("shard").join(ids, "source", "left")
        hit = F.coalesce(F.arrays_overlap("chunk_ids", "stale_"), F.lit(False))
        ents = ents.withColumn("hit_", hit).withColumn("chunk_ids", F.when(F.col("hit_"), F.array_except("chunk_ids", "stale_")).otherwise(F.col("chunk_ids"))).drop("stale_")
        ents = materialize(ents, "entities")
        gone = ents.where(F.col("hit_") & (F.size("chunk_ids") == 0)).select("entity_key")
        edges = self.edges.of(stale).drop("shard").join(stale.select("source", "chunk_id").distinct(), ["source", "chunk_id"], "left_anti")
        e, r = drop_entities(ents.drop("hit_"), edges, gone)
        self.edges.replace(stale, r)
        self.entities.replace(stale, e)


def append_messages(df: DataFrame, path: str) -> None:
    """Turns of sessions (MESSAGE schema); blank sessions or texts aren't stored."""
    df.where("trim(session_id) <> '' and trim(content) <> ''").select("session_id", "seq", "role", "content", "ts").write.mode("append").parquet(path)
