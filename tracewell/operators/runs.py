"""Runs and their artifacts: summaries, history, the latest of each, deletion."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_DEFAULT, HISTORY_MOST = 50, 200


def summarise(matches: DataFrame) -> DataFrame:
    """Segments and quotes of each document."""
    return matches.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("segment_count"), F.count_if(F.col("segment_type") == "quote").cast("int").alias("quote_count"))


def history(runs: DataFrame, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """The newest runs, 1 to 200 of them; a top-k, not a sort of all."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(max(1, min(HISTORY_MOST, limit)))


def latest(artifacts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The newest path (path, modified) overall or for each value of ``by``."""
    return artifacts.groupBy(*(by or [])).agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def delete_run(runs: DataFrame, run_id: str) -> DataFrame:
    """``runs`` without one run; it is an error if there is no such run."""
    if runs.where(F.col("run_id") == run_id).isEmpty():
        raise LookupError(f"no run {run_id}")
    return runs.where(F.col("run_id") != run_id)


#: What the files of a run end with: its result, its annotated document, its record.
ENDS = {"json": ".json", "docx": ".docx", "meta": ".meta.json"}
RECORD = "run_id string, created_at string, source_file string, segment_count int, quote_count int, parse_duration_seconds double"


def _system(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(root, name)


def write_runs(results: DataFrame, folder: str) -> int:
    """Write ``result_{run_id}.json``, ``.docx`` and ``.meta.json`` for each row of ``results``; how many runs there were.

    ``results`` has run_id, document (JSON text) and, if wanted, content (bytes of the Word file), created_at, source_file,
    segment_count, quote_count and parse_duration_seconds. One run is in the driver at a time; a run's record is written last, so
    a run that has one is whole. Whole corpora go to ``assemble.to_json(...).write`` instead, which names no file for a document.
    """
    spark, known = results.sparkSession, set(results.columns)
    system, path = _system(spark, folder)
    written = 0

    def put(name: str, data: bytes) -> None:
        out = system.create(path(name), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    for row in results.toLocalIterator():
        if not row.run_id or "/" in row.run_id:
            raise ValueError(f"no name for a run: {row.run_id!r}")
        put(f"result_{row.run_id}.json", json.dumps(json.loads(row.document), ensure_ascii=False, indent=2).encode())
        if "content" in known and row.content is not None:
            put(f"result_{row.run_id}.docx", bytes(row.content))
        record = {c: row[c] for c in ("run_id", "created_at", "source_file", "segment_count", "quote_count", "parse_duration_seconds") if c in known}
        put(f"result_{row.run_id}.meta.json", json.dumps(record, ensure_ascii=False, default=str).encode())
        written += 1
    return written


def run_id_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"result_([^/]+?)(?:\.meta\.json|\.json|\.docx)$", 1), F.lit(""))


def scan_storage(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each result of a folder: run_id, path, modified, and the document and record files of the same run, null where they lack. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "result_*").load(folder).select("path", F.col("modificationTime").alias("modified"), run_id_of(F.col("path")).alias("run_id"))
    results = files.where(F.col("path").endswith(ENDS["json"]) & ~F.col("path").endswith(ENDS["meta"]))
    for name in ("docx", "meta"):
        results = results.join(files.where(F.col("path").endswith(ENDS[name])).select("run_id", F.col("path").alias(f"{name}_path")), "run_id", "left")
    return results


def stored_history(spark: SparkSession, folder: str, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """The newest runs of a folder, 1 to 200 of them, with what their records say; a run without record has the file's time and no counts."""
    found = scan_storage(spark, folder).orderBy(F.desc("modified"), F.desc("run_id")).limit(max(1, min(HISTORY_MOST, limit)))
    records = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "result_*.meta.json").json(folder)
    records = records.withColumn("run_id", run_id_of(F.col("_metadata.file_path")))
    stamp = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    return found.join(records, "run_id", "left").select(
        "run_id", F.coalesce("created_at", stamp).alias("created_at"), F.coalesce("source_file", F.lit("Parsed Document")).alias("source_file"), "segment_count", "quote_count",
        "parse_duration_seconds", F.lit(True).alias("json_available"), F.col("docx_path").isNotNull().alias("docx_available"), "modified",
    )


def read_results(spark: SparkSession, folder: str, schema: str, run_id: str | None = None) -> DataFrame:
    """Result files of all runs or of one, with the run, that they come from the cache, and the file's time where none is stored."""
    read = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"result_{run_id or '*'}.json").json(folder)
    read = read.where(~F.col("_metadata.file_path").endswith(ENDS["meta"]))
    read = read.withColumn("cache_key", run_id_of(F.col("_metadata.file_path"))).withColumn("from_cache", F.lit(True))
    stamp = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss")
    return read.withColumn("generated_at", F.coalesce("generated_at", stamp) if "generated_at" in read.columns else stamp)


def download_docx(spark: SparkSession, folder: str, run_id: str | None = None) -> tuple[str, bytes]:
    """A timestamped file name and the bytes of a run's document, or of the newest one. It is an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"result_{run_id or '*'}.docx").load(folder)
    newest = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise LookupError("no document" if run_id is None else f"no document of run {run_id}")
    data = files.where(F.col("path") == newest.path).first().content
    stamp = (datetime.now() if run_id is None else newest.modificationTime).strftime("%Y%m%d_%H%M%S")
    return f"evidence_{stamp}{'' if run_id is None else f'_{run_id}'}.docx", bytes(data)


def delete_files(spark: SparkSession, folder: str, run_id: str) -> int:
    """Delete a run's files; how many there were. It is an error if there were none."""
    system, path = _system(spark, folder)
    gone = sum(bool(system.delete(path(f"result_{run_id}{end}"), False)) for end in ENDS.values())
    if not gone:
        raise LookupError(f"no run {run_id}")
    return gone
