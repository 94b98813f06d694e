"""Schemas of the engine's tables."""

from __future__ import annotations

METADATA = (
    "struct<file_name:string,page_number:int,page_count:int,slide_number:int,slide_count:int,table_index:int,"
    "heading_path:array<string>,section_index:int,num_rows:int,num_cols:int,columns:array<string>,content_format:string,"
    "extractor:string,element_type:string,table_html:string,coordinates:array<array<double>>,ocr_engine:string,"
    "has_caption:boolean,extra:map<string,string>>"
)
UNIT = f"document_id string, id string, source_path string, source_type string, ordinal int, locator string, content string, metadata {METADATA}, error string"
CHUNK = "id string, document_id string, source_path string, source_type string, chunk_index int, locator string, content string, num_tokens int, content_sha1 string, page_number int, slide_number int, heading_path array<string>, columns array<string>, num_rows int, element_type string, content_format string"
RANKS = "query_id bigint, item bigint, list string, rank int, score double"
EXCHANGE = "session_id string, seq int, ts timestamp, question string, answer string, sources string, retrieval_info map<string,string>"
MANIFEST = "path string, mtime timestamp, size bigint, config_hash string"

#: Fields of METADATA, in order, for readers that fill some of them.
METADATA_FIELDS = [x.split(":")[0] for x in (
    "file_name page_number page_count slide_number slide_count table_index heading_path section_index num_rows num_cols columns "
    "content_format extractor element_type table_html coordinates ocr_engine has_caption extra"
).split()]
