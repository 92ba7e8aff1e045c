"""Explicit schemas of the tables that jobs read from files or parse from JSON."""

from __future__ import annotations

SECTION = "doc_id string, pos int, document_type string, section string, title string, body string, citation string, pages array<int>, part string, part_title string, parent_statute string, statute_title string, effective_date string"
SOURCE = "document_type string, section string, title string, citation string, pages array<int>, part string, part_title string, parent_statute string, statute_title string, effective_date string"
CHUNK = f"doc_id string, chunk_no int, sources array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in SOURCE.split(','))}>>, body string, subsection string, chunk_index int, total_chunks_in_section int, has_table boolean, is_definition boolean, is_merged_siblings boolean, token_count int"
CELLS = "array<struct<action:string,category:string,framework:string,determination:struct<significance:string,confidence:string,reasoning:string,mitigation:array<string>>>>"
TRUTH = "array<struct<category_name:string,significance:string,mitigation:array<string>,evidence:string>>"
REGULATIONS = "array<struct<name:string,description:string,jurisdiction:string,citation:string>>"
PROJECT = "struct<project_type:string,scale:string,location:string,actions:array<string>>"
EVENT = "ts timestamp, run_id long, event string, agent string, duration_ms long, model string, input_tokens long, output_tokens long, cost_usd double"
