"""Lenient JSON: extraction responses and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import doc_identity, strip_ctrl

_RESPONSE = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<head:string,relation:string,tail:string,confidence:string>>>"
_EVENT = "struct<event_id:string,file_path:string,change_type:string,document_version:string,change_version:string,timestamp:string,source_type:string>"


def strip_fence(raw: Column) -> Column:
    """Without a leading code fence: from the line after it up to the last fence."""
    t = strip_ctrl(raw)
    return F.when(t.startswith("```"), F.regexp_replace(t, r"(?s)^[^\n]*\n(.*)```.*$", "$1")).otherwise(t)


def parse_extraction(raw: Column) -> Column:
    """struct<entities, relations> of a model's response.

    Missing fields get their defaults (type Concept, empty description, related_to, confidence 0.5, empty names); confidence
    may be a number or text. Anything that isn't such JSON, null included, gives two empty lists.
    """
    j = F.from_json(strip_fence(raw), _RESPONSE)
    none = lambda s: F.array().cast(f"array<struct<{s}>>")
    entities = F.transform(j["entities"], lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"), F.coalesce(e["type"], F.lit("Concept")).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description")))
    relations = F.transform(
        j["relations"],
        lambda r: F.struct(
            F.coalesce(r["head"], F.lit("")).alias("head"), F.coalesce(r["relation"], F.lit("related_to")).alias("relation"), F.coalesce(r["tail"], F.lit("")).alias("tail"),
            F.coalesce(r["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"),
        ),
    )
    return F.struct(
        F.coalesce(entities, none("name:string,type:string,description:string")).alias("entities"),
        F.coalesce(relations, none("head:string,relation:string,tail:string,confidence:double")).alias("relations"),
    )


def parse_events(df: DataFrame, payload: str = "payload", now: Column | None = None) -> DataFrame:
    """df with columns event (the change event) and valid.

    Defaults: change_type modified, source_type kafka, timestamp `now`, event_id <document id>-<now in ms>. A version that is
    missing stays null, one that is JSON null counts as 0. Not valid (to be dead-lettered, never retried): a blank or missing
    path, or text that isn't JSON. Columns of df called event or valid are replaced.
    """
    now = F.current_timestamp() if now is None else now
    text = F.col(payload)
    j, v = F.from_json(text, _EVENT), F.try_parse_json(text)
    get = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    version = lambda name: F.when(get(name).isNull(), F.lit(None).cast("bigint")).when(F.is_variant_null(get(name)), F.lit(0).cast("bigint")).otherwise(F.coalesce(j[name].try_cast("bigint"), F.lit(0).cast("bigint")))
    path = j["file_path"]
    event = F.struct(
        F.coalesce(j["event_id"], F.concat(doc_identity(path), F.lit("-"), F.unix_millis(now).cast("string"))).alias("event_id"),
        path.alias("file_path"),
        F.coalesce(j["change_type"], F.lit("modified")).alias("change_type"),
        version("document_version").alias("document_version"),
        version("change_version").alias("change_version"),
        F.coalesce(F.timestamp_millis(j["timestamp"].try_cast("bigint")), now).alias("event_ts"),
        F.coalesce(j["source_type"], F.lit("kafka")).alias("source_type"),
    )
    return df.withColumn("event", event).withColumn("valid", v.isNotNull() & F.coalesce(strip_ctrl(path) != "", F.lit(False)))
