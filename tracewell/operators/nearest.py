"""Exact nearest vectors of a set of queries, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; the product of two blocks is what a task holds at once.
BLOCK = 2048


def _blocks(vectors: DataFrame) -> DataFrame:
    """(id, v) rows of a partition packed by dimension: dim, ids, data."""

    def pack(batches):
        held: dict[int, list] = {}

        def emit(dim):
            ids, rows = zip(*held.pop(dim))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "data": pa.array([np.array(rows, np.float64).tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == BLOCK:
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)

    return vectors.mapInArrow(pack, "dim int, ids binary, data binary")


def nearest(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """For each row that meets ``queries`` its ``k`` best other rows by cosine: query_id, rank (from 1), the id and cosine, rounded, ties to the smaller id.

    Rows without id and vectors that are null, empty or hold nulls take no part; a vector without length has cosine 0. Blocks of
    queries meet blocks of rows of their dimension by an equi-join, and only the best ``k`` of a pair of blocks leave it: no join of rows with rows.
    """
    sound = vectors.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()))
    rows = _blocks(sound.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    asked = _blocks(sound.where(queries).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    pairs = rows.join(asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).hint("shuffle_hash"), "dim")

    def run(batches):
        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in (batch.column(n) for n in ("dim", "ids", "data", "q_ids", "q_data")))):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                m, q = (np.frombuffer(x, np.float64).reshape(-1, dim) for x in (data, q_data))
                norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((m * m).sum(1))
                with np.errstate(all="ignore"):
                    cosines = np.round(np.where(norms > 0, q @ m.T / norms, 0.0), digits) + 0.0
                out = []
                for number, query in enumerate(q_ids.tolist()):
                    own = cosines[number]
                    others = np.flatnonzero(ids != query)
                    if len(others) > k:  # those at or above the k-th best, ties included
                        others = others[own[others] >= np.partition(own[others], -k)[-k]]
                    best = others[np.lexsort((ids[others], -own[others]))[:k]]
                    out.append((np.full(len(best), query), ids[best], own[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", id_column, "cosine"])

    found = pairs.mapInArrow(run, f"query_id bigint, {id_column} bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), id_column))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_column, "cosine")
