"""Schemas of document snapshots, layout recordings and protocol events. Absent keys are null; defaults are applied
by the readers."""

from __future__ import annotations

RECT = "struct<left:double,bottom:double,right:double,top:double>"
POINT = "struct<x:double,y:double>"
LAYOUT = f"struct<label:string,reading_order:int,bounds:{RECT},source:string,policy:string>"
CHAR = (
    "struct<unicode:string,unicode_source:string,code:bigint,visible:boolean,"
    "font:struct<resource_name:string,object_number:bigint,generation:int>,font_size:double,"
    f"baseline_origin:{POINT},box:{RECT},visual_bbox:{RECT},bbox_estimated:boolean,"
    "text_transform:struct<kind:string,degrees:double>,implicit_space_before:boolean,"
    f"layout:{LAYOUT},passthrough:struct<content_object:bigint,byte_start:bigint,byte_end:bigint,encoded:array<int>>>"
)
TOKENS = "array<struct<token:string,occurrences:int>>"
EVIDENCE = f"struct<request_sha256:string,response_sha256:string,source_token_types:int,target_token_types:int,source_tokens:{TOKENS},target_tokens:{TOKENS}>"
PARAGRAPH = f"struct<reading_order:int,bounds:{RECT},first_line_indent:double,text:struct<kind:string,chars:array<{CHAR}>>,translated_text:string,translation_conservation:{EVIDENCE},preserved:string>"
PAGE = f"struct<index:int,geometry:struct<width:double,height:double,rotate_degrees:int>,paragraphs:array<{PARAGRAPH}>>"
GLYPH = f"struct<unicode:string,baseline_origin:{POINT},ink_bounds:{RECT},font_slot:string>"
INK = f"struct<page_index:int,reading_order:int,crop_box:{RECT},admissible_container:{RECT},components:array<struct<kind:string,ownership_group:int,bounds:{RECT},glyphs:array<{GLYPH}>>>>"
DOCUMENT = f"schema_version int, pages array<{PAGE}>, publication_ink array<{INK}>"
REGION = f"struct<bounds:{RECT},reading_order:int,label:string,source:string,confidence:float>"
RECORDING = f"schema_version int, pages array<struct<page_index:int,geometry:struct<width:double,height:double,rotate_degrees:int>,regions:array<{REGION}>>>"
EVENT = "schema_version int, event string, stage string, page_index int, paragraph_index int, total_pages int, status string, id string, category string, reason string, message string, hint string, detail string, output string, pages int, warnings int, term_extraction boolean, suspicious_echoes array<string>, preserved_paragraph_count int"
