"""Sharding by rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair gets a uniform hash u in (0, 1); the record goes to the shard with the least
``-ln(u) / weight``. A pair's value depends on nothing else, so a further shard takes records only into
itself, and a removed one hands out only its own. Shard s gets records in proportion to its weight.
All of it is built-in column functions: no shuffle for the assignment, a shuffle of narrow rows for slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, text_bytes


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (0 to len(weights) - 1) that wins ``key``; weights must be positive.

    A null key is hashed as the empty string. Equal keys share a shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and at least one")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def race(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(F.lit(f"{salt}:{shard}:"), text))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
        return F.struct((-F.ln(u) / F.lit(float(weight))).alias("time"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*(race(s, w) for s, w in enumerate(weights))))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard", salt: str = "shard") -> DataFrame:
    """``df`` with all its columns and the shard of each row; a column of that name is replaced."""
    return df.withColumn(column, rendezvous(F.col(key), weights, salt))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each shard gaplessly from 0, in the order of the columns ``order``.

    Returns the columns ``shard``, ``order``, ``carry`` and ``slot`` (long). ``carry`` must depend on the other columns only.
    Equal rows are counted before any shuffle, then spread over consecutive slots, so a repeated row is one
    narrow record whatever its count. Rows are dealt by ranges of ``order``, as many as the session has shuffle
    partitions; a shard is numbered range by range and no task holds more than one range of one shard. The ranges
    are written in as many files as the cluster has cores.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "slots")
    columns = [shard, *order, *carry]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    dealt = counted.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt = scratch.save(dealt.coalesce(min(ranges, spark.sparkContext.defaultParallelism)), "ranges")
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, "_range").agg(F.sum("_copies").alias("_rows"))
        .select(shard, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(shard, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_from", F.coalesce(F.sum("_copies").over(within), F.lit(0))).join(starts, [shard, "_range"])
    first = F.col("_start") + F.col("_from")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest rows of ``docs``: size, checksum, shard, slot and the shard if there were one more.

    A null text counts as empty. Only doc_id and the number of shards decide (law ``key``). Repeated rows each get a slot of their own.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 8
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(text_bytes(F.col("text"))).alias("text_crc32"))
    narrow = assign_shards(narrow, "doc_id", [1.0] * shards)
    narrow = assign_shards(narrow, "doc_id", [1.0] * (shards + 1), "grown_shard")
    slots = number_slots(narrow, "shard", ["doc_id", "text_crc32", "size"], ["grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
