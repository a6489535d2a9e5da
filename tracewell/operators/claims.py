"""Claim spans as rows: units and windows of texts, the choice among spans and their checks, all as columns and windows.

A claim row has doc_id, quote_number, description_start, description_end, quote_start, quote_end, color, group_id,
description_unit and quote_span_text. ``operators.alignment`` makes such spans; these operators work on any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import similarity as S
from tracewell.functions.text import let, normalise
from tracewell.operators.alignment import CANDIDATES, EDGES, MARKS, PALETTE, UNITS

LINK = ("doc_id", "quote_number")
_QUOTED = "|".join(f"{before}[{opens}][^{closes}]{{2,120}}[{closes}]{after}" for before, opens, closes, after in MARKS)


def color_of(number: Column) -> Column:
    """The highlight colour of a group's number, from 1; colours repeat."""
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(number - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def group_number(group_id: Column) -> Column:
    return F.regexp_extract(group_id, r"^g(\d+)$", 1).try_cast("int")


def next_group(claims: DataFrame) -> DataFrame:
    """For each link how many groups it has and the number that a further one gets."""
    return claims.groupBy(*LINK).agg(F.count_distinct("group_id").cast("int").alias("n_groups"), (F.coalesce(F.max(group_number(F.col("group_id"))), F.lit(0)) + 1).alias("next_group"))


def quoted_phrases(text: Column) -> Column:
    """Up to seven phrases of two to seven words in quotation marks, in order, equal ones but for case once."""
    inside = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_QUOTED})"), F.lit(1)), lambda q: F.regexp_replace(normalise(F.substr(q, F.lit(2), F.length(q) - 2)), rf"^[{_class(EDGES)}]+|[{_class(EDGES)}]+$", ""))
    fit = F.filter(inside, lambda q: F.size(S.words(q)).between(2, 7))
    fresh = let(fit, lambda qs: F.filter(qs, lambda q, i: ~F.exists(F.slice(qs, F.lit(1), i), lambda p: F.lower(p) == F.lower(q))))
    return F.slice(fresh, 1, UNITS)


def _class(characters: str) -> str:
    return "".join("\\" + c for c in characters)


def ngram_windows(texts: DataFrame, text: str, keys: tuple[str, ...] = LINK) -> DataFrame:
    """Windows of two to seven words within a clause, the first 280 of a text: ``keys``, number (from 0), start, end, phrase.

    Clauses end at ``. ; ,``. Windows are numbered by their first word, then by length.
    """
    clauses = texts.select(*keys, text, F.posexplode(F.split(F.col(text), "[.;,]")).alias("clause", "body"))
    offset = F.coalesce(F.sum(F.length("body") + 1).over(Window.partitionBy(*keys).orderBy("clause").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spots = F.filter(F.transform(F.split("body", r"(?<=[\w'-])(?![\w'-])|(?<![\w'-])(?=[\w'-])"), lambda w: F.struct(w.alias("w"), w.rlike(r"^[\w'-]").alias("is"))), lambda p: p["w"] != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("found"))

    def step(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p["w"])
        return F.struct(end.alias("at"), F.when(p["is"] & p["w"].rlike(r"\w"), F.array_append(state["found"], F.struct(state["at"].alias("s"), end.alias("e")))).otherwise(state["found"]).alias("found"))

    placed = clauses.withColumn("offset", offset.cast("int")).withColumn("spots", F.aggregate(spots, start, step, lambda state: state["found"]))
    firsts = placed.where(F.size("spots") > 1).select(*keys, text, "offset", "spots", F.explode(F.sequence(F.lit(0), F.size("spots") - 2)).alias("i"))
    windows = firsts.select(*keys, text, "offset", "spots", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + 6, F.size("spots") - 1))).alias("j"))
    begins, ends = F.get("spots", F.col("i"))["s"] + F.col("offset"), F.get("spots", F.col("j"))["e"] + F.col("offset")
    found = windows.select(*keys, text, begins.alias("start"), ends.alias("end"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    return found.withColumn("number", number).where(F.col("number") < CANDIDATES).select(*keys, "number", "start", "end", F.substr(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("phrase"))


def occurrences(text: Column, phrase: Column) -> Column:
    """Where a phrase begins in a text, overlapping places too, letter for letter; an empty phrase stands nowhere.

    Pieces between places are counted through, so the text is read once for each letter that a place may begin with.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.length(phrase)))
    return F.when(F.length(phrase) > 0, F.filter(starts, lambda i: F.substr(text, i + 1, F.length(phrase)) == phrase)).otherwise(F.array().cast("array<int>"))


def scored(claims: DataFrame) -> DataFrame:
    """``claims`` with ``score``, by which one span of several is chosen."""
    return claims.withColumn("score", F.round(S.selection_score(F.col("description_unit"), F.col("quote_span_text"), F.col("quote_end") - F.col("quote_start")), 9))


def best_of_groups(claims: DataFrame) -> DataFrame:
    """One span of each group, given one description range for each: the best score, then the shortest, then the first. A row of a window, no self-join."""
    order = Window.partitionBy(*LINK, "group_id").orderBy(F.desc("score"), F.col("quote_end") - F.col("quote_start"), "quote_start")
    return scored(claims).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def is_sound(text: Column) -> Column:
    return S.enough_words(text) & S.is_substantive(text)


def validate(claims: DataFrame, description: str = "description_text", quote: str = "quote_text") -> DataFrame:
    """Spans clamped to their texts, with sound texts on both sides, renumbered in the order of group (as text) and place."""

    def clamp(column: str, text: str) -> Column:
        return F.least(F.greatest(F.col(column), F.lit(0)), F.length(text)).cast("int")

    def cut(text: str, side: str) -> Column:
        return F.trim(F.substr(F.col(text), F.col(f"{side}_start") + 1, F.col(f"{side}_end") - F.col(f"{side}_start")))

    ends = {f"{side}_{end}": clamp(f"{side}_{end}", text) for side, text in (("description", description), ("quote", quote)) for end in ("start", "end")}
    held = claims.withColumns(ends).where("description_start < description_end and quote_start < quote_end")
    held = held.withColumns({"description_unit": cut(description, "description"), "quote_span_text": cut(quote, "quote")})
    number = F.row_number().over(Window.partitionBy(*LINK).orderBy("group_id", "quote_start", "quote_end")) - 1
    return held.where(is_sound(F.col("description_unit")) & is_sound(F.col("quote_span_text"))).withColumn("number", number)
