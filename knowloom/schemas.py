"""Schemas of the engine's tables, as DDL."""

DOCUMENT = "doc_id string, path string, doc_type string, text string"
CHUNK = "chunk_id string, doc_id string, chunk_index int, content string, doc_type string, metadata struct<source:string,char_start:int,char_end:int>, embedding array<float>"
EXTRACTION = "source_chunk_id string, entities array<struct<name:string,type:string,description:string>>, relations array<struct<head:string,relation:string,tail:string,confidence:double>>"
ENTITY = "entity_key string, name string, type string, description string, source string, version bigint, chunk_ids array<string>, created_at timestamp, updated_at timestamp"
EDGE = "head_key string, rel_type string, tail_key string, confidence double, source string, chunk_id string, version bigint, updated_at timestamp"
CHANGE_EVENT = "event_id string, file_path string, change_type string, document_version bigint, change_version bigint, event_ts timestamp, source_type string"
EVENT_STATE = "event_id string, file_path string, change_type string, version bigint, status string, event_ts timestamp, processed_at timestamp, failure_reason string, payload string, arrival bigint, seq bigint"
MESSAGE = "session_id string, seq bigint, role string, content string, ts timestamp"
CONTEXT = "question_id bigint, retrieval_type string, rank int, score double, content string, source string"
