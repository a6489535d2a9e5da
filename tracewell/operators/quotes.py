"""Pairs of a quote block and the description that introduces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import is_citation_only, is_description, is_heading_like, join_key, normalise_edges, trailing_citation
from tracewell.operators.citations import last_by_text
from tracewell.operators.sequence import before, nearest_image, with_neighbours


def quote_parts(elements: DataFrame) -> DataFrame:
    """A row for each quote block: its bounds, the description before it (null if none), the nearest image, what follows it, and its parts in order.

    The description is the last earlier narration that introduces a quote, however far back.
    """
    intro = F.when((F.col("type") == "narration") & is_description(F.col("text")), F.struct("text", "position"))
    around = nearest_image(with_neighbours(elements)).withColumn("intro", F.last(intro, ignorenulls=True).over(before()))
    return around.where("block is not null").groupBy("doc_id", "block").agg(
        F.min("position").alias("quote_start_position"), F.max("position").alias("quote_end_position"), F.min_by("intro", "position").alias("intro"),
        F.min_by("image_near", "position").alias("image_near"), F.max_by("after", "position").alias("after"),
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"),
    )


def _read_parts(parts: Column) -> Column:
    """The texts to quote and the citation found among the parts, as a struct (texts, citation).

    Titles are left out. A part that is only a citation is taken as the citation, the last such part winning; a
    trailing citation is taken, and cut off its part, only while there is none.
    """
    facts = F.transform(parts, lambda p: F.struct(normalise_edges(F.coalesce(p["text"], F.lit(""))).alias("text")))
    facts = F.transform(facts, lambda p: F.struct(p["text"].alias("text"), is_heading_like(p["text"]).alias("title"), is_citation_only(p["text"]).alias("only"), trailing_citation(p["text"]).alias("trailing")))
    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(None).cast("string").alias("citation"))

    def step(at: Column, p: Column) -> Column:
        takes = p["trailing"].isNotNull() & at["citation"].isNull()
        cut = F.regexp_replace(F.left(p["text"], F.length(p["text"]) - F.length(p["trailing"])), r"[ \t\n\r,;:-]+\z", "")
        text = F.when(takes & (cut != ""), cut).otherwise(p["text"])
        kept = F.struct(F.array_append(at["texts"], text).alias("texts"), F.when(takes, p["trailing"]).otherwise(at["citation"]).alias("citation"))
        only = F.struct(at["texts"].alias("texts"), p["text"].alias("citation"))
        return F.when((p["text"] == "") | p["title"], at).when(p["only"], only).otherwise(kept)

    return F.aggregate(facts, start, step)


def link_quotes(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each quote block that has a description and a part to quote, in document order (quote_1, quote_2, ...).

    The citation is the one in the block, else the one that follows it directly. Its group is looked up by text,
    the last of equal texts winning, and gives position and image; without one, the group that follows does.
    """
    # exploded, so that the filter isn't pushed below what it reads, which would then be computed twice
    blocks = quote_parts(elements).where("intro is not null").withColumn("read", F.explode(F.array(_read_parts(F.col("parts"))))).drop("parts").where(F.size("read.texts") > 0)
    blocks = blocks.withColumn("after_position", F.when(F.col("after.type") == "citation", F.col("after.position")))
    following = groups.select("doc_id", F.col("position").alias("after_position"), F.struct("citation_id", "citation_text", "position").alias("next_group"))
    chosen = blocks.join(following, ["doc_id", "after_position"], "left")
    chosen = chosen.withColumn("citation_text", F.coalesce("read.citation", "next_group.citation_text")).withColumn("cited_key", F.nullif(join_key(F.col("citation_text")), F.lit("")))
    chosen = chosen.join(last_by_text(groups), ["doc_id", "cited_key"], "left")
    chosen = chosen.withColumn("cited", F.coalesce(F.col("by_text"), F.col("next_group"))).withColumn("cited_id", F.col("cited.citation_id"))
    first = groups.select("doc_id", F.col("citation_id").alias("cited_id"), F.get("images", 0).alias("cited_image"))
    chosen = chosen.join(first, ["doc_id", "cited_id"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("quote_start_position"))
    image = F.when(F.col("cited_image").isNotNull(), F.struct(F.col("cited_image.image_id").alias("image_id"), F.col("cited_image.position").alias("position"))).otherwise(F.col("image_near"))
    return chosen.select(
        "doc_id", number.alias("quote_number"), F.concat(F.lit("quote_"), number.cast("string")).alias("quote_id"), F.col("intro.text").alias("description_text"),
        F.array_join("read.texts", "\n\n").alias("quote_text"), "citation_text", F.col("intro.position").alias("description_position"), "quote_start_position",
        "quote_end_position", F.col("cited.position").alias("citation_position"), image["image_id"].alias("nearest_image_id"), image["position"].alias("image_position"),
    )
