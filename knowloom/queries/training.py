"""Queries of the general training-data operators: snapshots (2), repeated deliveries (3), change feed (4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowloom.functions.text import strip_ws
from knowloom.operators import feed, redelivery, snapshots
from knowloom.queries import table
from knowloom.session import materialize, row_count, scratch_path

#: White space as Unicode has it, for RE2.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def p2_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "chunk_snapshots"))


def p2_counts(spark, d):
    return snapshots.change_counts(p2_found(spark, d))


def p3_found(spark, d):
    return redelivery.surplus_deliveries(table(spark, d, "event_messages"))


def p3_unique(spark, d):
    return redelivery.unique_deliveries(table(spark, d, "event_messages")).select("delivery_no", "event_id", "file_path", "status")


def p3_batches(spark, d, batches: int = 6):
    """The deliveries as they come, some batches at a time, each checked against the stored history: in the end p3_unique."""
    x = table(spark, d, "event_messages")
    last = x.agg(F.max("batch_no")).first()[0] or 0
    step, root = last // batches + 1, scratch_path(spark, "deliveries")
    blocks = redelivery.blocks_for(row_count(x), 0)
    out = None
    for k in range(batches):
        b = x.where(F.floor(F.coalesce("batch_no", F.lit(0)) / step) == k)
        new = materialize(redelivery.append_batch(spark, b, f"{root}/ids", f"{root}/filters", blocks).select("delivery_no", "event_id", "file_path", "status"), "newdeliveries")
        out = new if out is None else out.unionByName(new)
    return out


def p4_found(spark, d):
    return feed.current_files(table(spark, d, "change_feed")).select("file_path", "effective_version")


def p4_current_hash(spark, d):
    return feed.current_files(table(spark, d, "change_feed"))


def p4_halves(spark, d):
    """The feed in two halves by arrival, each made into patches, which are composed: in the end p4_current_hash."""
    x = table(spark, d, "change_feed")
    half = (x.agg(F.max("feed_no")).first()[0] or 0) // 2
    parts = [materialize(feed.file_patches(x.where(c)), "patches") for c in (F.col("feed_no") <= half, F.col("feed_no") > half)]
    one = feed.compose(parts[0].unionByName(parts[1]), ["k"])
    return feed.apply_patches(one, "file_path", ["content_hash"]).select("file_path", F.col("order.o0").alias("effective_version"), "content_hash")


def p4_on_base(spark, d):
    """The feed applied to the files of the documents, which have no version before."""
    docs = table(spark, d, "documents").where(strip_ws(F.col("file_path")) != "")
    base = docs.select("file_path").distinct().withColumn("content_hash", F.lit("base"))
    return feed.current_files(table(spark, d, "change_feed"), base=base)


def queries():
    return {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_unique, p3_batches, p4_found, p4_current_hash, p4_halves, p4_on_base)}


P2 = """
with snaps as (select snapshot_no, row_number() over (order by snapshot_no) as i from (select distinct snapshot_no from chunk_snapshots)),
st as (select distinct i, chunk_id, content from chunk_snapshots join snaps using (snapshot_no) where chunk_id is not null),
ev as (
  select b.i as pos, b.chunk_id, 'added' as change_kind from st b anti join st a on a.chunk_id = b.chunk_id and a.i = b.i - 1 where b.i > 1
  union all
  select a.i + 1, a.chunk_id, 'removed' from st a anti join st b on a.chunk_id = b.chunk_id and b.i = a.i + 1 where a.i < (select max(i) from snaps)
  union all
  select b.i, b.chunk_id, 'changed' from st b join st a on a.chunk_id = b.chunk_id and a.i = b.i - 1 where a.content is distinct from b.content
)"""

P3 = f"""
with m as (select *, nullif(lower(regexp_replace(event_id, '^{WS}+|{WS}+$', '', 'g')), '') as id from event_messages),
r as (select *, row_number() over (partition by id order by delivery_no) as rn from m)"""

P4 = f"""
with c as (select file_path, coalesce(change_version, document_version) as v, feed_no, content_hash,
    case when change_type is null then 'modified' else lower(regexp_replace(change_type, '^{WS}+|{WS}+$', '', 'g')) end as kind
  from change_feed where regexp_replace(file_path, '^{WS}+|{WS}+$', '', 'g') <> ''),
r as (select *, row_number() over (partition by file_path order by v desc, kind = 'deleted' desc, feed_no desc) as rn
  from c where v is not null and kind in ('created', 'modified', 'deleted'))"""


def oracle_sql():
    return {
        "p2_found": P2 + "select snapshot_no, chunk_id, change_kind from ev join snaps on i = pos",
        "p2_counts": P2 + "select snapshot_no, change_kind, count(*)::bigint as n from ev join snaps on i = pos group by all",
        "p3_found": P3 + "select delivery_no from r where id is not null and rn > 1",
        "p3_unique": P3 + "select delivery_no, event_id, file_path, status from r where id is null or rn = 1",
        "p3_batches": P3 + "select delivery_no, event_id, file_path, status from r where id is not null and rn = 1",
        "p4_found": P4 + "select file_path, v as effective_version from r where rn = 1 and kind <> 'deleted'",
        "p4_halves": P4 + "select file_path, v as effective_version, content_hash from r where rn = 1 and kind <> 'deleted'",
        "p4_on_base": P4 + f"""select file_path, v as effective_version, content_hash from r where rn = 1 and kind <> 'deleted'
          union all select distinct file_path, null, 'base' from documents d where regexp_replace(file_path, '^{WS}+|{WS}+$', '', 'g') <> '' and not exists (select 1 from r where r.file_path = d.file_path)""",
        "p4_current_hash": P4 + "select file_path, v as effective_version, content_hash from r where rn = 1 and kind <> 'deleted'",
    }
