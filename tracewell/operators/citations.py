"""Citations: the images before each of them, and the segments that they back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import is_citation_only, join_key, parse_citation, score_label, trailing_citation
from tracewell.operators.sequence import before, with_neighbours

#: A segment whose own trailing citation is found, and one that a citation follows directly.
DIRECT_SCORE, FORWARD_SCORE = 0.92, 0.72


def build_citation_groups(elements: DataFrame) -> DataFrame:
    """A row for each citation with the images since the one before it: a cumulative count of citations is their key. Images after the last citation are dropped."""
    cited = (F.col("type") == "citation") & (F.coalesce(F.col("text"), F.lit("")) != "")
    numbered = elements.withColumn("_cited", cited).withColumn("_group", F.coalesce(F.sum(F.col("_cited").cast("int")).over(before()), F.lit(0)))
    image = F.when((F.col("type") == "image") & F.col("image").isNotNull(), F.struct("position", "image"))
    groups = numbered.groupBy("doc_id", "_group").agg(
        F.max(F.when(F.col("_cited"), F.struct("position", "text"))).alias("_citation"), F.array_sort(F.collect_list(image)).alias("_images")
    )
    return groups.where("_citation is not null").select(
        "doc_id", F.concat(F.lit("citation_"), (F.col("_group") + 1).cast("string")).alias("citation_id"), F.col("_citation.text").alias("citation_text"),
        parse_citation(F.col("_citation.text")).alias("_parsed"), F.col("_images.image").alias("images"), F.col("_citation.position").alias("position"),
    ).select("doc_id", "citation_id", "citation_text", "_parsed.*", "images", "position")


def last_by_text(groups: DataFrame) -> DataFrame:
    """For each citation text of a document its last group: what a lookup by text finds."""
    picked = F.max_by(F.struct("citation_id", "citation_text", "position"), "position")
    return groups.groupBy("doc_id", join_key(F.col("citation_text")).alias("cited_key")).agg(picked.alias("by_text"))


def match_segments(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each narration, quote and heading with text, and the citation that backs it.

    First the segment's own trailing citation, looked up by text (score 0.92); else, unless it is nothing but a
    citation, the citation that follows it, or its block of quotes, directly (score 0.72). Headings are never matched.
    Documents without a citation give no rows. Images are joined last, by citation.
    """
    cited_docs = groups.select("doc_id").distinct()
    around = with_neighbours(elements)
    segments = around.where(F.col("type").isin("narration", "quote", "heading") & (F.coalesce(F.col("text"), F.lit("")) != ""))
    segments = segments.join(cited_docs, "doc_id", "left_semi").select(
        "doc_id", "position", "type", "text",
        F.when(F.col("type") != "heading", join_key(trailing_citation(F.col("text")))).alias("cited_key"),
        F.when((F.col("type") != "heading") & ~is_citation_only(F.col("text")) & (F.col("after.type") == "citation"), F.col("after.position")).alias("cited_position"),
    )
    segments = segments.withColumn("cited_key", F.nullif("cited_key", F.lit("")))
    by_position = groups.select("doc_id", F.col("position").alias("cited_position"), F.struct("citation_id", "citation_text").alias("by_position"))
    found = segments.join(last_by_text(groups), ["doc_id", "cited_key"], "left").join(by_position, ["doc_id", "cited_position"], "left")
    direct = F.col("by_text").isNotNull()
    found = found.select(
        "doc_id", "position", "text", "type", F.coalesce("by_text.citation_id", "by_position.citation_id").alias("matched_citation_id"),
        F.coalesce("by_text.citation_text", "by_position.citation_text").alias("matched_citation_text"),
        F.when(direct, F.lit(DIRECT_SCORE)).when(F.col("by_position").isNotNull(), F.lit(FORWARD_SCORE)).alias("match_score"),
    )
    images = groups.select("doc_id", F.col("citation_id").alias("matched_citation_id"), F.col("images").alias("matched_images"))
    return found.join(images, ["doc_id", "matched_citation_id"], "left").select(
        "doc_id", F.concat(F.lit("seg_"), F.col("position").cast("string")).alias("segment_id"), F.col("text").alias("segment_text"), F.col("type").alias("segment_type"),
        "matched_citation_id", "matched_citation_text", "match_score", F.coalesce("matched_images", F.array().cast(groups.schema["images"].dataType)).alias("matched_images"),
    )


def images_by_text(groups: DataFrame) -> DataFrame:
    """For each citation text of a document the images of its last group that has some."""
    held = groups.where(F.size("images") > 0)
    return held.groupBy("doc_id", join_key(F.col("citation_text")).alias("cited_key")).agg(F.max_by("images", "position").alias("images"))


def filter_matches(matches: DataFrame, label: str | None = None, quotes_only: bool = True, without_image: bool = False) -> DataFrame:
    """Matches of a confidence label (high, review, none), optionally only those whose first image has no payload."""
    out = matches.withColumn("confidence", score_label(F.coalesce("match_score", F.lit(0.0))))
    if quotes_only:
        out = out.where("segment_type = 'quote'")
    if label:
        out = out.where(F.col("confidence") == label)
    if without_image:
        out = out.where(F.get("matched_images", 0)["thumbnail_base64"].isNull())
    return out

