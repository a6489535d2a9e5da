"""Articles made from ``documents``, line by line, for tests and benchmarks: the same rule stands in the oracles' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.claims import color_of
from tracewell.schema import IMAGE


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of one article for each document; positions have gaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ln", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    k = F.col("ln") % 8
    v = (F.col("ln") + F.when(k == 5, 1).otherwise(0)) % 16
    cite = F.concat(
        F.lit("('Report "), F.col("doc_id").cast("string"), F.lit("', "), F.col("source"), F.lit(" Journal, vol. "), v.cast("string"), F.lit(", "), (v + 1900).cast("string"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(", https://example.org/r")).otherwise(F.lit("")), F.lit(")"),
    )
    comma = F.when(F.col("doc_id") % 2 == 0, F.lit(",")).otherwise(F.lit(""))
    inline = F.when(F.col("doc_id") % 3 == 0, F.concat("line", F.lit(" "), cite)).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("[Q:] "), F.col("line"))).otherwise(F.col("line"))
    text = (
        F.when(k.isin(0, 7), F.col("line")).when(k.isin(1, 4), F.concat("line", comma)).when(k == 2, F.concat("line", F.lit(":"))).when(k == 5, inline).when(k == 6, cite)
    )
    kind = F.when(k == 0, "heading").when(k == 3, "image").when(k.isin(4, 5), "quote").when(k == 6, "citation").otherwise("narration")
    image = F.when(k == 3, F.struct(
        F.concat(F.lit("img_"), F.col("ln").cast("string")).alias("image_id"), F.concat(F.lit("i"), F.col("ln").cast("string"), F.lit(".png")).alias("src"),
        F.col("ln").alias("position"), F.lit(None).cast("string").alias("thumbnail_base64"),
    ).cast(IMAGE))
    return lines.select("doc_id", F.col("ln").alias("position"), kind.alias("type"), text.alias("text"), image.alias("image"))


def claims(links: DataFrame) -> DataFrame:
    """Six claim spans for each link, at places that its number and the lengths of its texts give, in three groups; texts of even links are in capitals."""
    loud = F.col("quote_number") % 2 == 0
    texts = links.select("doc_id", "quote_number", *(F.when(loud, F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))).otherwise(F.col(c)).alias(c) for c in ("description_text", "quote_text")))
    n = F.col("n")
    start = F.pmod(n * 13, F.greatest(F.length("quote_text"), F.lit(1)))
    placed = texts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({
        "description_start": F.lit(0), "description_end": F.least(F.length("description_text"), 40 + 30 * (n % 3)).cast("int"), "quote_start": start.cast("int"),
        "quote_end": F.least(F.length("quote_text"), start + 20 + 15 * n).cast("int"), "group_id": F.concat(F.lit("g"), (n % 3 + 1).cast("string")), "color": color_of(n % 3 + 1),
    })
    unit = F.trim(F.substr("description_text", F.lit(1), F.col("description_end")))
    text = F.trim(F.substr("quote_text", F.col("quote_start") + 1, F.col("quote_end") - F.col("quote_start")))
    return placed.withColumns({"description_unit": unit, "quote_span_text": text})


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the articles that have text, as paragraphs with classes, styles and indents that their places give."""
    held = articles(spark, sf_dir).where("text is not null")
    classes = ("", "MsoTitle", "Style1", "MsoNormal Heading2", "x heading1", "MsoHeading 9", "subtitle", "plain")
    styles = ("", "margin-left:36pt;MARGIN-RIGHT:1.0cm", "margin: 2cm", "margin-left:0.5cm; margin-right : 0.2in", "margin-left:0.2in", "margin-right:1in;margin-left:x", "margin-left:14pt;margin-right:15pt")
    named = ("Normal", "Intense Quote", "Heading 1", " Title ", "Subtitle", "quote", "Body")
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("position") + step * F.col("doc_id"), F.lit(len(values))) + 1).cast("int"))
    left = F.when(F.col("position") % 3 > 0, (F.col("position") % 5 * 5).cast("double"))
    return held.select("doc_id", "position", "text", pick(classes, 1).alias("css_class"), pick(styles, 3).alias("style"), pick(named, 2).alias("style_name"), left.alias("left"), F.lit(12.0).alias("right"))
