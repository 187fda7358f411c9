"""Schemas of the persistent tables and of what passes between operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


DDL = {
    "docs": "doc_id string, app_id string, title string, source_uri string, classification short, created_at timestamp, created_by string",
    "doc_versions": "version_id string, doc_id string, version_no int, content_hash string, parser_ver string, embed_model string, created_at timestamp, created_by string",
    "chunks": "chunk_id string, doc_id string, version_id string, app_id string, classification short, chunk_index int, chunk_text string, chunk_hash string, embedding array<float>, created_at timestamp",
    "entity": "entity_id string, app_id string, name string, type string, aliases array<string>, description string, confidence string, classification short, first_occurrence timestamp, last_occurrence timestamp, occurrence_count int, is_active boolean, embedding array<float>, created_at timestamp, updated_at timestamp",
    "entity_chunk": "app_id string, entity_id string, chunk_id string, mention_count int, char_position int, extracted_context string, confidence string, classification short, created_at timestamp",
    "entity_edge": "app_id string, src_entity_id string, dst_entity_id string, edge_type string, weight decimal(5,3), confidence string, classification short, evidence_count int, evidence_chunk_ids array<string>, edge_notes string, created_at timestamp, updated_at timestamp",
    "entity_summary": "app_id string, entity_id string, summary_text string, summary_type string, anchor_chunk_ids array<string>, generation_model string, generation_prompt string, confidence string, classification short, last_updated_at timestamp",
    "graph_job": "job_id string, app_id string, job_type string, payload struct<doc_id:string,chunks:array<string>,mentions:array<struct<chunk_id:string,entity_id:string,mention_count:int>>>, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error_message string",
    "audit_mutations": "ts timestamp, actor string, action string, table_name string, row_pk string, request_id string, old_data string, new_data string",
    "audit_search": "ts timestamp, actor string, app_id string, clearance int, request_id string, query_text string, top_k int, filters string, hit_chunk_ids array<string>, hit_doc_ids array<string>, score_min float, score_max float",
    "pages": "doc_key string, page_no int, text string, tables string, figures string, png_bytes binary",
}

#: Columns that tell rows of a table apart.
KEYS = {
    "docs": ["doc_id"],
    "doc_versions": ["version_id"],
    "chunks": ["chunk_id"],
    "entity": ["entity_id"],
    "entity_chunk": ["app_id", "entity_id", "chunk_id"],
    "entity_edge": ["app_id", "src_entity_id", "dst_entity_id", "edge_type"],
    "entity_summary": ["app_id", "entity_id"],
    "graph_job": ["job_id"],
}


def schema(table: str) -> T.StructType:
    return _struct(DDL[table])
