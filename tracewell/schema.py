"""The tables of the engine. Every row carries ``doc_id``: one table holds all documents."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE = "struct<image_id:string,src:string,position:int,thumbnail_base64:string>"
SPAN = "struct<description_start:int,description_end:int,quote_start:int,quote_end:int,color:string,group_id:string,description_unit:string,quote_span_text:string>"

ELEMENTS = f"doc_id bigint, position int, type string, text string, image {IMAGE}"
CITATION_GROUPS = f"doc_id bigint, citation_id string, citation_text string, source_title string, outlet string, date string, url string, images array<{IMAGE}>, position int"
SEGMENT_MATCHES = f"doc_id bigint, segment_id string, segment_text string, segment_type string, matched_citation_id string, matched_citation_text string, match_score double, matched_images array<{IMAGE}>"
QUOTE_LINKS = (
    "doc_id bigint, quote_id string, description_text string, quote_text string, citation_text string, description_position int, quote_start_position int, "
    f"quote_end_position int, citation_position int, nearest_image_id string, image_position int, claim_spans array<{SPAN}>, "
    "colorization_description_text string, colorization_description_position int"
)
PDF_PAGES = f"doc_id bigint, page_number int, text string, image {IMAGE}"
RUNS = "run_id string, created_at timestamp, source_file string, segment_count int, quote_count int, parse_duration_seconds double"
IMAGES = "doc_id bigint, image_id string, payload binary"

ELEMENT_TYPES = ("narration", "quote", "heading", "image", "citation")


def struct_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
