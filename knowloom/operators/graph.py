"""Property graph: merges, deletes, keyword search and path expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions.text import candidate_keywords

ENTITIES_PER_KEYWORD, CANDIDATES, NEIGHBOURS = 5, 5, 20
#: Keywords and entities of a block.
KEYWORD_BLOCK, ENTITY_BLOCK = 50_000, 50_000


def merge_entities(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One entity per entity_key from an ordered log (entity_key, name, type, description, source, version, chunk_id, seq, at).

    Name and version are the last written; type, description and source the last that are not empty; chunk_ids in order of
    first appearance; created_at the first, updated_at the last time. An existing entity comes before the whole log. Keys
    ignore the type. Rows with a null key are left out; equal seq values are decided by the greater value.
    """
    x = log.select("entity_key", "name", "type", "description", "source", "version", F.array("chunk_id").alias("ids"), "seq", F.col("at").alias("created"), F.col("at").alias("updated"))
    if existing is not None:
        x = x.unionByName(existing.select("entity_key", "name", "type", "description", "source", "version", F.col("chunk_ids").alias("ids"), F.lit(-1).cast("bigint").alias("seq"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated")))
    x = x.where("entity_key is not null")
    last = lambda c, cond=None: F.max(F.when(cond, F.struct("seq", c)) if cond is not None else F.struct("seq", c))[c]
    filled = lambda c: F.coalesce(last(c, F.coalesce(F.col(c), F.lit("")) != ""), F.lit("")).alias(c)
    merged = x.groupBy("entity_key").agg(last("name").alias("name"), filled("type"), filled("description"), filled("source"), last("version").alias("version"), F.min("created").alias("created_at"), F.max("updated").alias("updated_at"))
    firsts = x.select("entity_key", F.posexplode("ids").alias("p", "chunk_id"), "seq").where("chunk_id is not null").groupBy("entity_key", "chunk_id").agg(F.min(F.struct("seq", "p")).alias("f"))
    lists = firsts.groupBy("entity_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"))
    return merged.join(lists, "entity_key", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def merge_edges(log: DataFrame, entities: DataFrame, columns: list[str], key: str = "entity_key", existing: DataFrame | None = None) -> DataFrame:
    """One directed edge per (head_key, rel_type, tail_key), the last write (by seq, then value) wins.

    An edge with an unknown endpoint is dropped. Edges are merged before the endpoints are looked up, so that hot heads or
    tails are small by then.
    """
    if existing is not None:
        log = existing.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(log.select(*existing.columns, "seq"))
    last = F.max(F.struct("seq", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("m")
    e = log.groupBy("head_key", "rel_type", "tail_key").agg(last).select("head_key", "rel_type", "tail_key", *[F.col(f"m.c{i}").alias(c) for i, c in enumerate(columns)])
    keys = entities.select(F.col(key).alias("k")).distinct()
    return e.join(keys.withColumnRenamed("k", "head_key"), "head_key", "left_semi").join(keys.withColumnRenamed("k", "tail_key"), "tail_key", "left_semi").select("head_key", "rel_type", "tail_key", *columns)


def strict_edges(edges: DataFrame, entities_seen: DataFrame) -> DataFrame:
    """The order-dependent variant: only edges whose endpoints (entity_key, first_seq) were there when the edge (seq) came."""
    s = entities_seen.select("entity_key", "first_seq")
    for end in ("head_key", "tail_key"):
        edges = edges.join(s.select(F.col("entity_key").alias(end), F.col("first_seq").alias("f_")), end).where("f_ <= seq").drop("f_")
    return edges


def drop_entities(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities in `gone` (entity_key) and all edges at either end of them."""
    k = gone.select(F.col("entity_key").alias("k_")).distinct()
    for end in ("head_key", "tail_key"):
        edges = edges.join(k.withColumnRenamed("k_", end), end, "left_anti")
    return entities.join(k.withColumnRenamed("k_", "entity_key"), "entity_key", "left_anti"), edges


def delete_sources(entities: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of these sources (column source), entities of these sources, and all edges of such entities."""
    s = sources.select("source").distinct()
    gone = entities.join(s, "source", "left_semi").select("entity_key")
    return drop_entities(entities, edges.join(s, "source", "left_anti"), gone)


def delete_chunks(entities: DataFrame, edges: DataFrame, source: str, stale: list[str] | Column) -> tuple[DataFrame, DataFrame]:
    """Chunks of one source that are gone: their edges; the ids in the source's entities; entities left without any.

    Entities that had no chunk ids before stay as they are.
    """
    ids = F.array(*[F.lit(x) for x in stale]).cast("array<string>") if isinstance(stale, list) else stale
    hit = (F.col("source") == source) & F.arrays_overlap("chunk_ids", ids)
    marked = entities.withColumn("hit_", F.coalesce(hit, F.lit(False))).withColumn("chunk_ids", F.when(F.col("hit_"), F.array_except("chunk_ids", ids)).otherwise(F.col("chunk_ids")))
    gone = marked.where(F.col("hit_") & (F.size("chunk_ids") == 0)).select("entity_key")
    left = edges.where(~F.coalesce((F.col("source") == source) & F.array_contains(ids, F.col("chunk_id")), F.lit(False)))
    return drop_entities(marked.drop("hit_"), left, gone)


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entities, relations): both counts, 0 for empty tables."""
    one = lambda df, e, r: df.select(F.lit(e).alias("e"), F.lit(r).alias("r"))
    return one(entities, 1, 0).unionByName(one(edges, 0, 1)).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("entities"), F.coalesce(F.sum("r"), F.lit(0)).alias("relations"))


def keywords(questions: DataFrame, qid: str, question: str) -> DataFrame:
    """(<qid>, kw_ord from 1, keyword)."""
    return questions.select(qid, F.posexplode(candidate_keywords(F.col(question))).alias("o", "keyword")).select(qid, (F.col("o") + 1).alias("kw_ord"), "keyword")


def entities_with(keyword_table: DataFrame, entities: DataFrame, per_keyword: int = ENTITIES_PER_KEYWORD) -> DataFrame:
    """(keyword, entity_key, rn): the first per_keyword entities, by key, whose name or description contains the keyword.

    Case counts. Distinct keywords and entities are matched in blocks of a bounded size: an automaton of a keyword block
    runs once over an entity block, instead of a comparison of every keyword with every entity. Each block pair keeps
    per_keyword entities of a keyword.
    """
    import ahocorasick

    words = keyword_table.select("keyword").where("keyword <> ''").distinct()
    rows = entities.select("entity_key", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description")).where("entity_key is not null")
    nw, ne = max(1, -(-words.count() // KEYWORD_BLOCK)), max(1, -(-rows.count() // ENTITY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    words = words.select("keyword", F.pmod(F.xxhash64("keyword"), F.lit(nw)).cast("int").alias("wb"), every(ne).alias("eb"))
    rows = rows.select("*", F.pmod(F.xxhash64("entity_key", "name"), F.lit(ne)).cast("int").alias("eb"), every(nw).alias("wb"))

    def match(e: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        got: dict[str, set[str]] = {}
        if len(e) and len(k):
            auto = ahocorasick.Automaton()
            for w in k["keyword"]:
                auto.add_word(w, w)
            auto.make_automaton()
            for key, n, d in zip(e["entity_key"], e["name"], e["description"]):
                for t in (n, d):
                    for _, w in auto.iter(t):
                        got.setdefault(w, set()).add(key)
        out = [(w, key) for w, keys in got.items() for key in sorted(keys)[:per_keyword]]
        return pd.DataFrame(out, columns=["keyword", "entity_key"])

    out = rows.groupBy("eb", "wb").cogroup(words.groupBy("eb", "wb")).applyInPandas(match, "keyword string, entity_key string").distinct()
    w = Window.partitionBy("keyword").orderBy("entity_key")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_keyword)


def candidate_entities(question_keywords: DataFrame, qid: str, entities: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(<qid>, entity_key, ord): per question the ordered distinct entities of its keywords in order, `limit` at most."""
    hits = question_keywords.join(entities_with(question_keywords, entities), "keyword")
    first = hits.groupBy(qid, "entity_key").agg(F.min(F.struct("kw_ord", "rn")).alias("f"))
    w = Window.partitionBy(qid).orderBy("f", "entity_key")
    return first.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit).select(qid, "entity_key", "ord")


def neighbours(starts: DataFrame, edges: DataFrame, hops: int = 2, limit: int = NEIGHBOURS) -> DataFrame:
    """(start, depth, rels, neighbour, rn): undirected trails of 1..hops edges, the first `limit` per start.

    edges: edge_id, head_key, rel_type, tail_key. A trail uses no edge twice but may come back to a node; a self-loop counts
    once. The order is depth, relation types, neighbour, edges. Since a start keeps `limit` trails, of each node only the
    first limit + hops - 1 continuations can matter: adjacency is cut to these before it is joined, so hubs don't multiply.
    """
    e = edges.select("edge_id", "head_key", "rel_type", "tail_key")
    both = e.select("edge_id", F.col("head_key").alias("a"), "rel_type", F.col("tail_key").alias("b")).unionByName(e.where("head_key <> tail_key").select("edge_id", F.col("tail_key").alias("a"), "rel_type", F.col("head_key").alias("b")))
    w = Window.partitionBy("a").orderBy("rel_type", "b", "edge_id")
    near = both.withColumn("i_", F.row_number().over(w)).where(F.col("i_") <= limit + hops - 1).drop("i_")
    cols = ["start", "depth", "rels", "neighbour", "ids"]
    step = starts.select(F.col("start")).distinct().join(near, F.col("start") == F.col("a")).select("start", F.lit(1).alias("depth"), F.array("rel_type").alias("rels"), F.col("b").alias("neighbour"), F.array("edge_id").alias("ids"))
    best = Window.partitionBy("start").orderBy("depth", "rels", "neighbour", "ids")
    cut = lambda x: x.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= limit)
    out = step
    for d in range(2, hops + 1):
        step = step.join(near, F.col("neighbour") == F.col("a")).where(~F.array_contains("ids", F.col("edge_id"))).select("start", F.lit(d).alias("depth"), F.concat("rels", F.array("rel_type")).alias("rels"), F.col("b").alias("neighbour"), F.concat("ids", F.array("edge_id")).alias("ids"))
        out = out.unionByName(step)
    return cut(out).select(*cols[:4], "rn")
