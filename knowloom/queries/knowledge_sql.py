"""SQL equivalents of the knowledge-base queries, for DuckDB."""

from __future__ import annotations

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
CTRL = r"^[\x00-\x20]+|[\x00-\x20]+$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{CTRL}', '', 'g')"


def ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def key(x: str) -> str:
    return f"(case when {x} is null or {trim(x)} = '' then 'unknown' else regexp_replace(lower({trim(x)}), '[^\\p{{Han}}a-z0-9]+', '_', 'g') end)"


def sha16(x: str) -> str:
    return f"substring(sha256({x}), 1, 16)"


CHUNKS = f"""
w as (select doc_id, lang, text, unnest(range(0, greatest(ceil((length(text) - 512) / 448.0), 0)::bigint + 1)) * 448 as s from documents where length(text) > 0),
t as (select doc_id, lang, s as char_start, least(s + 512, length(text)) as char_end, {trim("substring(text, s + 1, 512)")} as content from w),
c as (select *, row_number() over (partition by doc_id order by char_start) - 1 as chunk_index from t where content <> '')"""

DOT = "list_sum(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: ({a}[i] * {b}[i])::double))"


def cosine(a: str, b: str) -> str:
    return f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)}) + 1e-10))"


TOPK = f"""
p as (select q.vec_id as query_id, v.vec_id, v.label, {cosine("q.embedding", "v.embedding")} as raw from embeddings q join embeddings v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
k as (select *, round(raw, 6) as score, row_number() over (partition by query_id order by raw desc, vec_id) as rank from p qualify rank <= 5)"""

STORE = "v as (select chunk_id, max(doc_id) as doc_id, max(chunk_index) as chunk_index, max(content) as content, max(metadata.source) as source, count(embedding) as e from raw_chunks where chunk_id is not null group by chunk_id)"
GONE = f"g as (select distinct file_path as source from change_feed where file_path is not null and lower({ws('change_type')}) = 'deleted')"

MENTIONS = "m as (select entity_id, source_chunk_id, coalesce(entity_name, '') as name, coalesce(entity_type, 'Concept') as type, coalesce(description, '') as description from entity_records where entity_id % 7 <> 3)"
SOURCES = "src as (select chunk_id, min(metadata.source) as s from raw_chunks where chunk_id is not null group by chunk_id)"
LOG = f"{SOURCES}, l as (select *, {key('source')} || '::' || {key('entity_name')} as entity_key from (select r.*, coalesce(s, '/unknown') as source from entity_records r left join src on r.source_chunk_id = src.chunk_id))"
MERGED = f"""{LOG},
e as (select entity_key, arg_max(entity_name, entity_id) as name, coalesce(arg_max(entity_type, entity_id) filter (where entity_type <> ''), '') as type,
  coalesce(arg_max(description, entity_id) filter (where description <> ''), '') as description, coalesce(arg_max(source, entity_id) filter (where source <> ''), '') as source,
  max(entity_id) as version, min(extracted_at) as created_at, max(extracted_at) as updated_at from l group by entity_key),
f as (select entity_key, source_chunk_id as c, min(entity_id) as i from l where source_chunk_id is not null group by all),
ids as (select entity_key, string_agg(c, ',' order by i, c) as chunk_ids from f group by entity_key)"""

PLACES = """
n as (select 'r' || r_regionkey as k, r_name as name, 'region' as src, r_regionkey as i from region union all select 'n' || n_nationkey, n_name, 'nation', n_nationkey from nation
  union all select 's' || s_suppkey, s_name, 'supplier', s_suppkey from supplier union all select 'c' || c_custkey, c_name, 'customer', c_custkey from customer),
e as (select 'n' || n_nationkey as a, 'PART_OF' as rel, 'r' || n_regionkey as b, 'nation' as src, n_nationkey as i from nation
  union all select 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey, 'supplier', s_suppkey from supplier union all select 'c' || c_custkey, 'BASED_IN', 'n' || c_nationkey, 'customer', c_custkey from customer)"""
HOPS = PLACES + """,
u as (select a || '-' || b as id, a, rel, b from e union all select a || '-' || b, b, rel, a from e where a <> b),
p as (select a as start, 1 as depth, [rel] as rels, b as neighbour, [id] as ids from u
  union all select x.a, 2, [x.rel, y.rel], y.b, [x.id, y.id] from u x join u y on x.b = y.a and x.id <> y.id),
h as (select *, row_number() over (partition by start order by depth, rels, neighbour, ids) as rn from p qualify rn <= 20)"""

HAN = r"\p{Han}"
WORDS = f"""
q as (select entity_id, {trim("coalesce(description, '')")} as q from entity_records),
t as (select entity_id, q, regexp_extract_all(q, '([{HAN}A-Za-z0-9_]{{2,20}})', 1) as toks from q where q <> ''),
x as (select entity_id, list_concat([substring(q, 1, 20)], flatten(list_transform(toks, lambda t: list_concat([t], case when regexp_matches(t, '{HAN}') and length(t) > 4
  then list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))[1:6] else [] end)))) as ws from t),
o as (select entity_id, w, min(i) as i from (select entity_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from x) group by all),
k as (select entity_id, w as keyword, row_number() over (partition by entity_id order by i) as kw_ord from o qualify kw_ord <= 8)"""


def message(x: str) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x0B]+', ' ', 'g'), ' ')"
    return f"case when length({t}) > 300 then substring({t}, 1, 300) || '...' else {t} end"


QA = TOPK + """,
qs as (select vec_id as question_id, case when vec_id % 100 = 0 then 'RELATIONSHIP' else 'DESCRIPTIVE' end as mode from embeddings where vec_id % 50 = 0),
c as (select query_id as question_id, 'vector' as kind, rank, score, 'v' || vec_id as content, 'S' || label as source from k
  union all select question_id, 'graph', n_nationkey, 0.5::double + (n_nationkey % 4) / 8.0::double, n_name, 's' || n_regionkey from qs join nation on n_nationkey % 5 = (question_id / 50) % 7),
ev as (select question_id, count(*) filter (where kind = 'vector') as vectors, count(*) filter (where kind = 'graph') as graphs, coalesce(bool_or(kind = 'graph' and score >= 0.8), false) as confident,
  lower(arg_min(source, rank) filter (where kind = 'vector')) as vs, lower(arg_min(source, rank) filter (where kind = 'graph')) as gs from c group by question_id),
a as (select question_id, mode, vectors, graphs, confident, vectors > 0 and graphs > 0 and coalesce(vs <> gs, false) as conflict from ev join qs using (question_id)),
s as (select c.question_id, kind, rank, content, case when kind = 'vector' then (case when mode = 'RELATIONSHIP' then score * 0.80::double else score * 1.20::double end) * (case when mode = 'RELATIONSHIP' and graphs < 2 then 1.05::double else 1::double end)
  else (case when mode = 'RELATIONSHIP' then score * 1.40::double else score * 0.90::double end) * (case when mode <> 'RELATIONSHIP' and not confident then 0.95::double else 1::double end) end as score from c join a using (question_id)),
z as (select *, row_number() over (partition by question_id order by score desc, kind = 'graph', rank) as position from s qualify position <= 8)"""

EVENT = f"""
j as (select delivery_no, case when json_valid(payload) then payload end as p from event_messages),
f as (select delivery_no, p is not null and coalesce({trim("p->>'$.file_path'")} <> '', false) as valid, p from j),
v as (select delivery_no, valid, case when valid then coalesce(p->>'$.event_id', {sha16("p->>'$.file_path'")} || '-0') end as event_id, case when valid then p->>'$.file_path' end as file_path,
  case when valid then coalesce(p->>'$.change_type', 'modified') end as change_type,
  case when valid and json_exists(p, '$.document_version') then coalesce(try_cast(p->>'$.document_version' as bigint), 0) end as document_version,
  case when valid and json_exists(p, '$.change_version') then coalesce(try_cast(p->>'$.change_version' as bigint), 0) end as change_version,
  case when valid then coalesce(make_timestamp(try_cast(p->>'$.timestamp' as bigint) * 1000), timestamp '1970-01-01') end as event_ts, case when valid then coalesce(p->>'$.source_type', 'kafka') end as source_type from f)"""

FEED = f"""
c as (select feed_no as seq, event_id, file_path, case when change_type is null then 'modified' else lower({ws('change_type')}) end as kind, coalesce(change_version, document_version) as version, coalesce(event_ts, timestamp '1970-01-01') as ts
  from change_feed where {ws('file_path')} <> ''),
d as (select * from c where kind in ('created', 'modified', 'deleted'))"""
FIRST = "f as (select * from (select *, row_number() over (partition by event_id order by seq) as r from d {where}) where event_id is null or r = 1)"
BEFORE = "over (partition by file_path order by seq rows between unbounded preceding and 1 preceding)"


def old(v: str) -> str:
    """Whether the event's version is behind a version of the file."""
    return f"coalesce(case when kind = 'deleted' then version < {v} else version <= {v} end, false)"


GATE = f"""
recursive c0 as (select 1), {FEED.strip()},
o as materialized (select *, row_number() over (partition by file_path order by seq) as i from d),
g as (
  select distinct file_path, 0::bigint as i, null::bigint as seq, null::varchar as event_id, null::varchar as outcome, null::bigint as ver, null::bigint as led, null::timestamp as mark, []::varchar[] as ids from o
  union all
  select file_path, i, seq, event_id, outcome, case when outcome <> 'applied' then ver when version is not null then version else coalesce(ver + 1, case when kind = 'created' then 1 else 2 end) end,
    case when outcome = 'applied' and version is not null then version else led end, case when outcome = 'applied' then ts else mark end, case when outcome = 'applied' and event_id is not null then list_append(ids, event_id) else ids end
  from (select o.*, ver, led, mark, ids, case when coalesce(list_contains(ids, o.event_id), false) then 'duplicate' when {old('led')} or {old('ver')} then 'stale_version' when version is null and coalesce(ts < mark, false) then 'stale_timestamp' else 'applied' end as outcome
    from g join o on o.file_path = g.file_path and o.i = g.i + 1)
),
r as (select seq, file_path, event_id, outcome, case when outcome = 'applied' then ver end as assigned from g where i > 0)"""

TWO = f"""
p as (select snapshot_no as a, lead(snapshot_no) over (order by snapshot_no) as pair from (select distinct snapshot_no from chunk_snapshots)),
h as (select snapshot_no, chunk_id, max({sha16("coalesce(content, 'null')")}) as h, min(chunk_index) as ci from chunk_snapshots where chunk_id is not null group by all),
o as (select pair, chunk_id, h, ci from h join p on a = snapshot_no where pair is not null),
n as (select snapshot_no as pair, chunk_id, h, ci from h where snapshot_no in (select pair from p)),
d as (select coalesce(o.pair, n.pair) as pair, coalesce(o.chunk_id, n.chunk_id) as chunk_id, case when n.chunk_id is null then 'removed' when o.h = n.h then 'unchanged' else 'changed' end as change, o.ci as oi, n.ci as ni from o full join n on o.chunk_id = n.chunk_id and o.pair = n.pair)"""

SQL = {
    "doc_identity": f"select doc_id, {sha16('file_path')} as path_id, case when file_path ilike '%.pdf' then 'pdf' when file_path ilike '%.png' or file_path ilike '%.jpg' or file_path ilike '%.jpeg' then 'image' when file_path ilike '%.csv' or file_path ilike '%.xlsx' then 'table' when file_path ilike '%.md' then 'markdown' else 'text' end as kind from documents",
    "content_hashes": f"select chunk_id, {sha16("coalesce(content, 'null')")} as content_hash, concat_ws('::', coalesce(doc_id, 'null'), coalesce(chunk_index::varchar, 'null'), {sha16("coalesce(content, 'null')")}) as fingerprint from raw_chunks",
    "chunk_documents": f"with {CHUNKS} select doc_id, doc_id || '#chunk-' || chunk_index as chunk_id, chunk_index::bigint as chunk_index, char_start::bigint as char_start, char_end::bigint as char_end, content from c",
    "chunk_stats_by_lang": f"with {CHUNKS} select lang, count(distinct doc_id) as docs, count(*) as chunks, sum(length(content))::bigint as chars, count(distinct content) as contents from c group by lang",
    "vector_topk": f"with {TOPK} select query_id, vec_id, score, rank from k",
    "vector_similarity": f"select a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "ann_recall": "select count(*) as queries, true as recall_kept from embeddings where vec_id % 50 = 0",
    "vector_upsert_latest": f"select chunk_id, max(snapshot_no) as snapshot_no, arg_max(doc_id, snapshot_no) as doc_id, arg_max({sha16("coalesce(content, 'null')")}, snapshot_no) as hash from chunk_snapshots where chunk_id is not null group by chunk_id",
    "vector_delete_anti": f"with {STORE}, {GONE} select chunk_id, doc_id from v where not exists (select 1 from g where g.source = v.source)",
    "vector_deleted_counts": f"with {STORE}, {GONE} select doc_id, count(*) as deleted from v join g using (source) group by doc_id",
    "chunks_by_doc": f"with {STORE} select doc_id, row_number() over (partition by doc_id order by chunk_index nulls first, chunk_id) as position, chunk_id, chunk_index::bigint as chunk_index, content from v where doc_id is not null",
    "vector_stats": f"with {STORE} select count(*) as vectors, count(distinct doc_id) as docs, count(*) filter (where e > 0) as embedded from v",
    "extract_parse_defaults": f"with {MENTIONS} select * from m",
    "extract_relations": """select entity_id, coalesce(entity_name, '') as head, coalesce(case when entity_id % 5 <> 0 then entity_type end, 'related_to') as relation, coalesce(description, '') as tail,
  case when entity_id % 4 = 1 then round((entity_id % 10) / 10.0::double, 6) else 0.5::double end as confidence from entity_records""",
    "extract_dedup_first": f"with {MENTIONS} select entity_id, source_chunk_id, name, type from m qualify row_number() over (partition by name, type order by source_chunk_id nulls first, entity_id) = 1",
    "extract_resolve_source": f"with {SOURCES} select entity_id, coalesce(s, '/unknown') as source from entity_records left join src on source_chunk_id = chunk_id",
    "entity_keys": f"with {LOG} select entity_id, entity_key, regexp_replace({key('entity_name')}, '^_+|_+$', '', 'g') as plain_key from l",
    "entity_merge": f"with {MERGED} select e.*, coalesce(chunk_ids, '') as chunk_ids from e left join ids using (entity_key)",
    "edge_merge": """with l as (select 's' || l_suppkey as head_key, case when l_returnflag = 'R' then 'TOOK_BACK' else 'SUPPLIES_TO' end as rel_type, 'p' || l_partkey as tail_key, l_discount as confidence, l_orderkey * 10 + l_linenumber as seq from lineitem),
k as (select 's' || s_suppkey as k from supplier union all select 'p' || p_partkey from part where p_size > 10)
select head_key, rel_type, tail_key, max({'s': seq, 'c': confidence}).c as confidence, max(seq)::bigint as seq from l where head_key in (select k from k) and tail_key in (select k from k) group by all""",
    "strict_edges": """select 's' || l_suppkey as head_key, case when l_returnflag = 'R' then 'TOOK_BACK' else 'SUPPLIES_TO' end as rel_type, 'p' || l_partkey as tail_key, l_orderkey * 10 + l_linenumber as seq
from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey where s_suppkey * 97 <= l_orderkey * 10 + l_linenumber and p_partkey * 31 <= l_orderkey * 10 + l_linenumber""",
    "graph_delete_source": f"with {PLACES} select 'entity' as what, k as id from n where src <> 'nation' union all select 'edge', a || '-' || b from e where src <> 'nation' and a not like 'n%' and b not like 'n%'",
    "graph_delete_chunks": f"with {PLACES}, g as (select k from n where src = 'supplier' and i % 3 in (1, 2)) select 'entity' as what, k as id from n where k not in (select k from g) union all select 'edge', a || '-' || b from e where not (src = 'supplier' and i % 3 in (1, 2)) and a not in (select k from g) and b not in (select k from g)",
    "graph_stats": f"with {PLACES} select (select count(*) from n) as entities, (select count(*) from e) as relations",
    "graph_neighbors_2hop": f"with {HOPS} select start, depth::bigint as depth, array_to_string(rels, '>') as rels, neighbour, rn from h",
    "graph_contexts": f"with {HOPS} select start, rn, x.name || ' --[' || array_to_string(rels, ' -> ') || ']--> ' || y.name || ' (' || y.src || ')' as content from h join n x on x.k = start join n y on y.k = neighbour",
    "question_keywords": f"with {WORDS} select entity_id, kw_ord, keyword from k",
    "question_mode": "select entity_id, case when regexp_matches(lower(coalesce(description, '')), '关系|关联|属于|依赖|合作|哪家公司|relationship|depends on') then 'RELATIONSHIP' else 'DESCRIPTIVE' end as mode, regexp_matches(coalesce(description, ''), '\\p{Han}') as han from entity_records",
    "entity_search": f"""with {WORDS}, k2 as (select * from k where entity_id % 50 = 0), {MERGED},
hit as (select keyword, entity_key, row_number() over (partition by keyword order by entity_key) as rn from (select distinct keyword from k2 where keyword <> '') w join e on contains(e.name, keyword) or contains(e.description, keyword) qualify rn <= 5),
b as (select k2.entity_id, entity_key, min((kw_ord, rn)) as f from k2 join hit using (keyword) group by all)
select entity_id, entity_key, row_number() over (partition by entity_id order by f, entity_key) as ord from b qualify ord <= 5""",
    "memory_window": f"select file_path as session_id, doc_id as seq, row_number() over (partition by file_path order by doc_id desc) as rn from documents where {trim('file_path')} <> '' qualify rn <= 5",
    "memory_dedup": f"""with l as (select event_id as session_id, delivery_no as seq, status as role, failure_reason as content from event_messages where {trim('event_id')} <> '' qualify row_number() over (partition by event_id order by delivery_no desc) <= 20),
t as (select session_id, seq, role, {message('content')} as text from l), u as (select *, lag(coalesce(role, 'null') || '::' || text) over (partition by session_id order by seq) as b from t where text <> '')
select session_id, seq, role, text from u where b is null or b <> coalesce(role, 'null') || '::' || text""",
    "memory_context": f"""with l as (select file_path as session_id, doc_id as seq, doc_type as role, text as content from documents where {trim('file_path')} <> '' qualify row_number() over (partition by file_path order by doc_id desc) <= 6),
t as (select session_id, seq, role, {message('content')} as text from l), u as (select *, lag(coalesce(role, 'null') || '::' || text) over (partition by session_id order by seq) as b from t where text <> ''),
x as (select session_id, seq, coalesce(role, 'null') || ': ' || text || chr(10) as line from u where b is null or b <> coalesce(role, 'null') || '::' || text),
y as (select *, row_number() over w as k, sum(length(line)) over w as cum from x window w as (partition by session_id order by seq)),
z as (select session_id, {trim("string_agg(case when k = 1 then substring(line, 1, 700) else line end, '' order by seq)")} as context from y where cum <= 700 or k = 1 group by session_id),
s as (select distinct file_path as session_id from documents where {trim('file_path')} <> '')
select session_id, coalesce(context, '(无)') as context, coalesce(context, '(无)') not in ('', '(无)') as there from s left join z using (session_id)""",
    "hybrid_rerank": f"with {QA} select question_id, position, kind as retrieval_type, round(score, 6) as score, content from z",
    "qa_confidence": f"with {QA}, m as (select question_id, avg(score) as a from z group by 1) select question_id, round(least(coalesce(a, 0), 1::double), 6) as confidence from qs left join m using (question_id)",
    "source_conflict": f"with {QA} select question_id, vectors, graphs, confident, conflict from a",
    "qa_degrade_matrix": """with x as (select n_nationkey, n_nationkey & 1 > 0 as v, n_nationkey & 2 > 0 as g, n_nationkey % 3 <> 0 as m, n_nationkey & 4 > 0 as fv, n_nationkey & 8 > 0 as fg from nation where n_nationkey < 16),
y as (select *, array_to_string(list_filter([case when not m then 'MEMORY_UNAVAILABLE' end, case when not v then 'VECTOR_UNAVAILABLE' end, case when not g then 'GRAPH_UNAVAILABLE' end], lambda r: r is not null), ',') as reasons from x)
select n_nationkey, case when (not v and not (g and fg)) or (not g and not (v and fv)) then 'FAILED' else 'COMPLETED' end as outcome, reasons <> '' as degraded, reasons from y""",
    "qa_reasoning": f"""with {QA} select question_id, concat_ws(chr(10), 'QUESTION_MODE: ' || mode, 'MEMORY_LOADED: no short-term memory available', 'VECTOR_RETRIEVED: ' || vectors, 'GRAPH_RETRIEVED: ' || graphs,
  case when mode = 'RELATIONSHIP' then 'WEIGHTS: vector=0.8, graph=1.4' else 'WEIGHTS: vector=1.2, graph=0.9' end, case when mode = 'RELATIONSHIP' and graphs < 2 and vectors > 0 then 'GRAPH_EVIDENCE_LOW: vector contexts retained as supplement' end,
  case when mode <> 'RELATIONSHIP' and confident then 'GRAPH_BACKGROUND_RETAINED: high-confidence entity matched' end, case when conflict then 'SOURCE_CONFLICT: vector and graph point to different leading sources' end,
  case when vectors > 0 and graphs > 0 then 'CONTEXT_MIXED: vector+graph' end, 'RERANKED: ' || (vectors + graphs), 'ANSWER_GENERATED') as trail from a""",
    "event_parse": f"with {EVENT} select delivery_no, valid, event_id, file_path, change_type, document_version, change_version, event_ts, source_type from v",
    "dead_letters": f"with {EVENT} select case when not valid then 'invalid' else 'unsupported change type' end as reason, count(*) as n from v where not valid or change_type not in ('created', 'modified', 'deleted') group by 1",
    "event_dedup": f"with {FEED}, {FIRST.format(where='')} select seq, event_id, file_path from f",
    "version_gate": f"with {FEED}, {FIRST.format(where='where version is not null')}, x as (select *, max(version) {BEFORE} as last_version from f) select seq, file_path, version, last_version, case when last_version is null then false when kind = 'deleted' then version < last_version else version <= last_version end as stale from x",
    "timestamp_gate": f"with {FEED}, {FIRST.format(where='')}, x as (select *, max(ts) {BEFORE} as last_ts from f) select seq, file_path, ts, last_ts, coalesce(ts < last_ts, false) as stale from x",
    "version_assign": f"with {FEED}, {FIRST.format(where='')} select seq, file_path, row_number() over w - 1 + case when first_value(kind) over w = 'created' then 1 else 2 end as assigned from f window w as (partition by file_path order by seq)",
    "replay_gate": f"with {GATE} select * from r",
    "skip_reason_counts": f"with {GATE} select outcome, count(*) as n from r group by outcome",
    "chunk_diff": f"with {TWO} select pair, chunk_id, change from d",
    "stale_chunks": f"with {TWO} select pair, chunk_id, 0::bigint as phase, oi::bigint as chunk_index from d where change = 'removed' union all select pair, chunk_id, 1, ni from d where change = 'changed'",
    "ledger_latest": "select event_id, arg_max(status, delivery_no) as status, max(delivery_no) as seq from event_messages where event_id is not null group by 1",
    "ledger_watermarks": "select file_path, arg_max(event_ts, delivery_no) as last_ts, arg_max(event_version, delivery_no) filter (where event_version is not null) as last_version from event_messages where status = 'SUCCEEDED' and file_path is not null group by 1",
    "unprocessed_events": "select feed_no, event_id from change_feed f where not exists (select 1 from event_messages m where m.event_id = f.event_id and status = 'SUCCEEDED')",
    "replayable_events": "select event_id, delivery_no as seq, payload from (select *, row_number() over (partition by event_id order by delivery_no desc) as r from event_messages where event_id is not null) where r = 1 and status = 'FAILED' and payload is not null",
    "ledger_retention": "select delivery_no as seq from event_messages where received_at > timestamp '2025-01-15' - interval 168 hours",
    "workflow_transitions": """with x as (select event_id, delivery_no as seq, lag(status) over (partition by event_id order by delivery_no) as before, status from event_messages where event_id is not null and trim(event_id) <> '')
select event_id, seq, before, status, before is null or coalesce((before, status) in (('RECEIVED', 'PROCESSING'), ('PROCESSING', 'SUCCEEDED'), ('PROCESSING', 'FAILED'), ('RECEIVED', 'FAILED'), ('FAILED', 'RECEIVED')), false) as legal from x""",
    "retry_attempts": "select event_id, status, count(*) - 1 as retries from event_messages where event_id is not null group by all",
    "ingest_summary": f"with {STORE}, c as (select doc_id, count(*) as chunks from v group by 1), e as (select doc_id, count(*) as entities from entity_records join v on source_chunk_id = chunk_id group by 1) select c.doc_id, chunks, coalesce(entities, 0) as entities from c left join e on c.doc_id = e.doc_id",
    "events_tumbling": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "events_sliding": "with w as (select time_bucket(interval 30 minutes, ts) as b, event_type from events), x as (select b as window_start, event_type from w union all select b - interval 30 minutes, event_type from w) select window_start, event_type, count(*) as n from x group by all",
    "events_session": """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as new from events), y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from x)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from y group by user_id, sid""",
}
