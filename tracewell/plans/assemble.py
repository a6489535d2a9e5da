"""The whole analysis: elements to groups, matches, links and coloured claims, and one nested row for each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.citations import build_citation_groups, match_segments
from tracewell.operators.evidence import match_pdf_pages
from tracewell.operators.providers import Provider
from tracewell.operators.quotes import link_quotes
from tracewell.operators.spans import color_claims

LEVELS = {0: "minimal", 1: "medium", 2: "maximum", 3: "dense"}


@dataclass(frozen=True)
class Analysis:
    elements: DataFrame
    groups: DataFrame
    matches: DataFrame
    links: DataFrame


def analyse(elements: DataFrame, level: str = "medium", pages: DataFrame | None = None, provider: Provider | None = None) -> Analysis:
    """Extract is done; then group, replace images by scanned pages if there are any, match, link, colour.

    Elements, groups and links are read several times by what follows, so they stay on the executors' disks from their first use on, until they are unpersisted.
    """
    elements = elements.persist(StorageLevel.DISK_ONLY)
    groups = build_citation_groups(elements)
    if pages is not None:
        groups = match_pdf_pages(groups, pages)
    groups = groups.persist(StorageLevel.DISK_ONLY)
    links = color_claims(link_quotes(elements, groups), level, provider).persist(StorageLevel.DISK_ONLY)
    return Analysis(elements, groups, match_segments(elements, groups), links)


def assemble(found: Analysis) -> DataFrame:
    """One row for each document: segments, quote_table and citation_groups as arrays in document order."""

    def rows(df: DataFrame, name: str, order) -> DataFrame:
        columns = [c for c in df.columns if c != "doc_id"]
        return df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_order"), F.struct(*columns).alias("row")))), lambda x: x["row"]).alias(name))

    number = F.regexp_extract("segment_id", r"(\d+)$", 1).cast("int")
    parts = [rows(found.matches, "segments", number), rows(found.links, "quote_table", F.col("quote_number")), rows(found.groups, "citation_groups", F.col("position"))]
    out = found.elements.select("doc_id").distinct()
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(name, F.array().cast(part.schema[name].dataType)).alias(name) for name, part in zip(("segments", "quote_table", "citation_groups"), parts)))


def to_json(assembled: DataFrame) -> DataFrame:
    return assembled.select("doc_id", F.to_json(F.struct("segments", "quote_table", "citation_groups"), {"ignoreNullFields": "false"}).alias("document"))


def submit_kind(file_name: str, expect: str | None = None) -> str:
    """html or docx by suffix; an error for anything else or for what isn't expected."""
    kind = {"html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}.get(file_name.rpartition(".")[2].lower())
    if kind is None or (expect and kind != expect):
        raise ValueError(f"unsupported file {file_name}")
    return kind
