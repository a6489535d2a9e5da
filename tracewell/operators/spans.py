"""Colouring of claims: links are independent, so alignment is one pass in Arrow batches; borrowing is a window between two passes."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.alignment import align
from tracewell.operators.providers import FatalProviderError, Provider
from tracewell.operators.sequence import borrow_lookback
from tracewell.schema import SPAN, struct_type

_SPANS = pa.list_(pa.struct([
    ("description_start", pa.int32()), ("description_end", pa.int32()), ("quote_start", pa.int32()), ("quote_end", pa.int32()),
    ("color", pa.string()), ("group_id", pa.string()), ("description_unit", pa.string()), ("quote_span_text", pa.string()),
]))


def _align(links: DataFrame, level: str, provider: Provider) -> DataFrame:
    """``links`` with ``claim_spans`` and ``error`` for the description in ``_description``; rows stay where they are.

    A null description leaves a row's spans and error as they are.
    """
    columns = links.columns
    held = [F.col(c) for c in ("claim_spans", "error")] if "claim_spans" in columns else [F.array().cast(f"array<{SPAN}>"), F.lit(None).cast("string")]
    packed = links.select(F.struct(*(c for c in columns if c not in ("claim_spans", "error"))).alias("row"), F.col("_description"), F.col("quote_text"), held[0].alias("claim_spans"), held[1].alias("error"))

    def run(batches):
        for batch in batches:
            spans, errors = [], []
            for description, quote, old, error in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if description is None:
                    spans.append(old)
                    errors.append(error)
                    continue
                try:
                    spans.append([asdict(s) for s in align(description, quote, level, provider)])
                    errors.append(None)
                except FatalProviderError:
                    raise
                except Exception as fault:  # one link's failure leaves it without spans
                    spans.append([])
                    errors.append(repr(fault))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(errors, pa.string())], ["row", "claim_spans", "error"])

    kind = T.StructType([packed.schema["row"], *struct_type(f"claim_spans array<{SPAN}>, error string").fields])
    return packed.mapInArrow(run, kind).select("row.*", "claim_spans", "error")


def color_claims(links: DataFrame, level: str = "medium", provider: Provider | None = None) -> DataFrame:
    """``links`` with claim_spans, colorization_description_text and _position, and error.

    But for the level minimal, a link that gets no spans borrows the description of the nearest earlier link of its
    document that has some, and is aligned once more with it; it keeps the borrowed description even if it still gets none.
    All rows take one way through both passes, so that the first isn't run again for those that borrow.
    """
    provider = provider or Provider()
    base = [c for c in links.columns if c not in ("claim_spans", "colorization_description_text", "colorization_description_position", "error", "_description")]
    fresh = links.select(*base, F.lit(None).cast("string").alias("colorization_description_text"), F.lit(None).cast("int").alias("colorization_description_position"))
    first = _align(fresh.withColumn("_description", F.coalesce("description_text", F.lit(""))), level, provider).drop("_description")
    if level == "minimal":
        return first
    borrowed = {"colorization_description_text": F.col("borrowed_text"), "colorization_description_position": F.col("borrowed_position"), "_description": F.col("borrowed_text")}
    seen = borrow_lookback(first).withColumns(borrowed).drop("borrowed_text", "borrowed_position")
    return _align(seen, level, provider).drop("_description")


def explode_spans(links: DataFrame) -> DataFrame:
    """A row for each claim span."""
    return links.select("doc_id", "quote_id", F.explode("claim_spans").alias("s")).select("doc_id", "quote_id", "s.*")


def ner_links(links: DataFrame) -> DataFrame:
    """Distinct (group, unit, span) triples of each link in the order of the quote, and their distinct units in order."""
    spans = explode_spans(links)
    once = spans.groupBy("doc_id", "quote_id", "group_id", "description_unit", "quote_span_text").agg(F.min("quote_start").alias("quote_start"), F.min("color").alias("color"))
    order = Window.partitionBy("doc_id", "quote_id").orderBy("quote_start", "group_id", "description_unit", "quote_span_text")
    return once.withColumn("number", F.row_number().over(order))
