"""Articles as they arrive: each micro-batch of files is analysed as a batch, for its windows run over rows, not time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.assemble import analyse, assemble, to_json
from tracewell.sources.html import extract_html


def ingest_html(spark: SparkSession, source: str, sink: str, checkpoint: str, level: str = "medium"):
    """Start a query that appends the JSON of every new page of ``source`` (Parquet of doc_id, html) to ``sink``.

    A batch that is repeated after a failure overwrites its own folder, so each page is written once.
    """
    pages = spark.readStream.schema("doc_id bigint, html string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        documents = to_json(assemble(analyse(extract_html(batch), level)))
        documents.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
