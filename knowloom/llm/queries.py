"""Queries of the operators on text, with SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowloom.llm import encodings, mixing, names, splitting, tokens
from knowloom.queries import table
from knowloom.session import materialize, scratch_path


def p1_found(spark, d):
    return splitting.oversized_chunks(table(spark, d, "raw_chunks"))


def p1_pieces(spark, d):
    return splitting.split_chunks(table(spark, d, "raw_chunks"))


def _sound(pieces, by, at):
    """Per text: how far its pieces reach, and whether each is within the limit and begins 64 characters before the last one's end."""
    w = Window.partitionBy(*by).orderBy(at)
    x = pieces.withColumn("before", F.lag("char_end").over(w)).withColumn("no", F.row_number().over(w) - 1)
    good = (F.length("content") <= splitting.LIMIT) & (F.length("content") == F.col("char_end") - F.col("char_start"))
    fits = F.when(F.col("before").isNull(), F.col("char_start") == 0).otherwise(F.col("char_start") == F.col("before") - splitting.OVERLAP)
    return x.groupBy(*by).agg(F.max("char_end").alias("chars"), F.bool_and(good).alias("within_limit"), F.bool_and(fits & (F.col("no") == F.col("piece_index"))).alias("overlap_kept"))


def p1_checks(spark, d):
    """Every oversized content of every chunk, with what its pieces must fulfil; the whole text comes back from them."""
    x = table(spark, d, "raw_chunks")
    p = splitting.split_chunks(x).withColumn("item", F.expr("substring_index(chunk_id, '-', -1)")).withColumn("item", F.expr("substring(chunk_id, 1, length(chunk_id) - length(item) - 1)"))
    back = p.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("piece_index", "content"))).alias("c"))
    back = back.select("item", F.sha2(F.concat(F.col("c")[0]["content"], F.array_join(F.transform(F.slice("c", 2, 1_000_000), lambda z: F.substring(z["content"], splitting.OVERLAP + 1, splitting.LIMIT)), "")), 256).alias("text_hash"))
    return _sound(p, ["parent_chunk_id", "item"], "piece_index").join(back, "item").select(F.col("parent_chunk_id").alias("chunk_id"), F.col("chars").cast("bigint"), "text_hash", "within_limit", "overlap_kept")


def p1_files(spark, d):
    """All texts of the documents written one after the other into few large files, cut by byte ranges: what holds for them together."""
    path = scratch_path(spark, "texts")
    table(spark, d, "documents").select("text").write.text(path)
    p = materialize(splitting.split_files(spark, path), "filepieces")
    return _sound(p, ["item"], "piece_index").agg(F.sum("chars").cast("bigint").alias("chars"), F.bool_and("within_limit").alias("within_limit"), F.bool_and("overlap_kept").alias("overlap_kept"))


def p5_found(spark, d):
    return names.linked_pairs(names.link_names(table(spark, d, "entity_records")))


def p5_entities(spark, d):
    return names.entity_sizes(names.link_names(table(spark, d, "entity_records")))


def p5_checks(spark, d):
    """Rows of equal name and type, where the type says person or organisation, are one entity."""
    x = table(spark, d, "entity_records").select("entity_id", "entity_name", "entity_type")
    labels = names.PERSON_TYPES | names.ORG_TYPES
    x = x.where(F.lower(F.trim("entity_type")).isin(*sorted(labels)) & F.col("entity_name").rlike(r"\p{L}{3}"))
    x = x.join(names.link_names(table(spark, d, "entity_records")), "entity_id", "left")
    return x.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("entities"), F.count("cluster").alias("linked"))


def p6_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p6_checks(spark, d):
    """The ids of every row decoded again."""
    decode = tokens.decoder(spark)
    return tokens.token_ids(table(spark, d, "documents")).select("doc_id", F.sha2(decode(F.col("ids")), 256).alias("text_hash"))


def p6_counts(spark, d):
    return tokens.token_counts(table(spark, d, "documents"))


def _mix(spark, d):
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = tokens.token_counts(docs, extra=["source"])
    return mixing.mix_sources(sizes, targets)


def p7_mix(spark, d):
    return _mix(spark, d)[0]


def p7_shares(spark, d):
    return _mix(spark, d)[1]


def p7_checks(spark, d):
    """What has to hold for each target: the share scaled over usable sources, and that the mix keeps to it, to repeats and to the budget.

    At any place of the order a source is behind its share by less than a document of its own, and the others before it by one each.
    """
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mix, rep = mixing.mix_sources(tokens.token_counts(docs, extra=["source"]), targets)
    largest = mix.groupBy("mix_name", "source").agg(F.max("n_tokens").alias("largest"), F.count("*").alias("n"), F.countDistinct("doc_id", "repeat_no").alias("packets"))
    m = Window.partitionBy("mix_name")
    x = rep.join(largest, ["mix_name", "source"], "left").withColumn("usable", F.col("tokens_available") > 0)
    share = F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(m))
    x = x.withColumn("share", share).withColumn("total", F.sum("tokens_used").over(m)).withColumn("one_each", F.sum("largest").over(m))
    met = F.abs(F.col("tokens_used") - F.col("share") * F.col("total")) <= F.greatest(F.col("largest"), F.col("share") * F.col("one_each")) + 1
    return x.select(
        "mix_name", "source", F.round("share", 6).alias("share"), F.coalesce(met, F.col("tokens_used") == 0).alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"),
        F.coalesce(F.col("n") == F.col("packets"), F.lit(True)).alias("no_use_twice"), ((F.col("total") <= F.col("budget")) & (F.col("total") + F.col("one_each") > F.col("budget"))).alias("budget_used"),
    )


def p8_found(spark, d):
    return encodings.find_garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p8_restored(spark, d):
    return encodings.find_garbled(table(spark, d, "documents"))


def p8_lost(spark, d):
    """Found rows that show at once that characters were lost."""
    x = table(spark, d, "documents").where(F.contains(F.col("text"), F.lit(encodings.REPLACEMENT))).select("doc_id")
    return x.join(p8_found(spark, d), "doc_id", "left_semi").distinct()


def queries():
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p1_files, p5_found, p5_entities, p5_checks, p6_ids, p6_counts, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_restored, p8_lost)}


P7 = """with t as (select mix_name, source, max(target_share) as target_share, max(max_repeats) as max_repeats from mix_targets group by all),
u as (select t.*, target_share > 0 and max_repeats > 0 and exists (select 1 from documents d where d.source = t.source and length(d.text) > 0) as usable from t)
select mix_name, source, round(case when usable then target_share / sum(case when usable then target_share end) over (partition by mix_name) end, 6) as share,
  true as share_met, true as repeats_kept, true as no_use_twice, true as budget_used from u"""


P5 = """select entity_name, entity_type, count(*) as n, 1::bigint as entities, count(*) as linked from entity_records
where lower(trim(entity_type)) in ('person', 'people', 'per', '人物', '人', 'organization', 'organisation', 'org', 'company', '公司', '组织', '机构', 'firm') and regexp_matches(entity_name, '\\p{L}{3}') group by all"""


def oracle_sql():
    return {
        "p1_found": "select distinct chunk_id from raw_chunks where length(content) > 512 and chunk_id is not null",
        "p1_checks": "select distinct coalesce(chunk_id, '') as chunk_id, length(content) as chars, sha256(content) as text_hash, true as within_limit, true as overlap_kept from raw_chunks where length(content) > 512",
        "p1_files": "select (sum(length(coalesce(text, ''))) + count(*))::bigint as chars, true as within_limit, true as overlap_kept from documents",
        "p5_checks": P5,
        "p6_checks": "select doc_id, sha256(coalesce(text, '')) as text_hash from documents",
        "p7_checks": P7,
        "p8_lost": "select distinct doc_id from documents where contains(text, chr(65533))",
    }
