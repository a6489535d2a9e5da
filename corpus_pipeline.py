"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Quality classifier, line dedup, near-dedup, benchmark decontamination, then encoding of what is left. All but the
last return the columns of ``documents``; the last returns, for each document kept, its id and its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, neardup, quality
from tracewell.llm.common import Scratch, read_table
from tracewell.llm.linededup import LineStore
from tracewell.llm.queries import MULTI_RANKS, PATTERN
from tracewell.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above the quantile of the labelled scores that parts good from bad."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more share, but for the largest doc_id; n_chars follows the text."""
    ship(spark)
    cut = LineStore(spark).insert(docs).dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a similarity of 0.8."""
    ship(spark)
    return neardup.keep_one(docs, width=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its error budget."""
    ship(spark)
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text again."""
    ship(spark)
    return bpe.encode_checked(docs, MULTI_RANKS, PATTERN)


STAGES = [
    ("quality classifier", quality_stage), ("line dedup", line_stage), ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage), ("byte-level BPE", token_stage),
]

#: SQL can't fit the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
