"""Operators over the ordered elements of documents: all windows share one partitioning and order, hence one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.functions.text import SPACE, is_speaker_turn, is_terminal


def in_order() -> WindowSpec:
    """The rows of a document by position; made when used, as no session exists on import."""
    return Window.partitionBy("doc_id").orderBy("position")


def up_to() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def from_here() -> WindowSpec:
    return in_order().rowsBetween(0, Window.unboundedFollowing)


def _with_image_position(image: Column, position: Column) -> Column:
    return F.when(image.isNotNull(), image.withField("position", position))


def renumber(elements: DataFrame) -> DataFrame:
    """Positions from 0 without gaps, in order; an image's own position follows, its id stays."""
    dense = elements.withColumn("position", (F.row_number().over(in_order()) - 1).cast("int"))
    return dense.withColumn("image", _with_image_position(F.col("image"), F.col("position")))


def merge_soft_wrapped(elements: DataFrame) -> DataFrame:
    """Join paragraphs that a soft wrap broke, and renumber.

    An element joins the one before it if both are narration or both quote, both have text, the earlier one has no
    closing punctuation, and, in quotes, the later one opens no speaker turn. A joined text ends as its last piece
    does, so the condition looks at adjacent rows only: breaks are marked, islands numbered and each one put together in order.
    """
    previous_text, previous_type = F.lag("text").over(in_order()), F.lag("type").over(in_order())
    joins = (
        (previous_type == F.col("type")) & F.col("type").isin("narration", "quote")
        & (F.coalesce(previous_text, F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "")
        & ~is_terminal(previous_text) & ~((F.col("type") == "quote") & is_speaker_turn(F.col("text")))
    )
    marked = elements.withColumn("_starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_starts").over(up_to()))
    pieces = F.array_sort(F.collect_list(F.struct("position", "text")))
    trimmed = F.transform("_pieces", lambda p, i: F.regexp_replace(F.when(i > 0, F.regexp_replace(p["text"], rf"\A[{SPACE}]+", "")).otherwise(p["text"]), F.when(i < F.size("_pieces") - 1, F.lit(rf"[{SPACE}]+\z")).otherwise(F.lit(r"\z\A")), F.lit("")))
    islands = (
        marked.groupBy("doc_id", "_island")
        .agg(F.min("position").alias("position"), F.first("type").alias("type"), pieces.alias("_pieces"), F.first("image", ignorenulls=True).alias("image"))
        .withColumn("text", F.when(F.size("_pieces") > 1, F.array_join(trimmed, " ")).otherwise(F.get("_pieces", 0)["text"]))
    )
    return renumber(islands.select("doc_id", "position", "type", "text", "image"))


def quote_blocks(elements: DataFrame) -> DataFrame:
    """``elements`` with ``block`` (null outside quotes): the number of the maximal run of quotes that a row is in, from 1."""
    is_quote = F.col("type") == "quote"
    starts = is_quote & ~F.coalesce(F.lag("type").over(in_order()) == "quote", F.lit(False))
    return elements.withColumn("block", F.when(is_quote, F.sum(starts.cast("int")).over(up_to())))


def with_neighbours(elements: DataFrame) -> DataFrame:
    """``quote_blocks`` with what lies around each row: the next row's type and position, and, for a quote, those of the row after its block.

    ``after_position`` is the position of the first row at or after this one that isn't a quote, which for a quote ends its block.
    """
    blocks = quote_blocks(elements)
    outside = F.when(F.col("type") != "quote", F.struct("position", "type"))
    after_block = F.first(outside, ignorenulls=True).over(from_here())
    following = F.struct(F.lead("position").over(in_order()).alias("position"), F.lead("type").over(in_order()).alias("type"))
    return blocks.withColumn("after", F.when(F.col("type") == "quote", after_block).otherwise(following))


def nearest_image(elements: DataFrame) -> DataFrame:
    """``elements`` with ``image_near``: id and position of the nearest image on either side, the earlier of two as near; null without images."""
    here = F.when((F.col("type") == "image") & F.col("image").isNotNull(), F.struct(F.col("image.image_id").alias("image_id"), F.col("position").alias("position")))
    earlier, later = F.last(here, ignorenulls=True).over(up_to()), F.first(here, ignorenulls=True).over(from_here())
    nearer = F.when(later.isNull(), earlier).when(earlier.isNull(), later).when(F.col("position") - earlier["position"] <= later["position"] - F.col("position"), earlier).otherwise(later)
    return elements.withColumn("image_near", nearer)


def borrow_lookback(links: DataFrame) -> DataFrame:
    """Give a link without spans the description of the nearest earlier link of its document that has some.

    ``links`` has doc_id, quote_number, description_text, description_position, colorization_description_text, claim_spans;
    the result adds ``borrowed_text`` and ``borrowed_position``, null where nothing is borrowed.
    """
    order = Window.partitionBy("doc_id").orderBy("quote_number").rowsBetween(Window.unboundedPreceding, -1)
    lender = F.when(F.size("claim_spans") > 0, F.struct(
        F.coalesce("colorization_description_text", "description_text").alias("text"),
        F.coalesce("colorization_description_position", "description_position").alias("position"),
    ))
    found = F.when(F.size("claim_spans") == 0, F.last(lender, ignorenulls=True).over(order))
    return links.withColumn("borrowed_text", found["text"]).withColumn("borrowed_position", found["position"])
