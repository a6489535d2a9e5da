"""Exact top-k by inner product: the threshold algorithm over sorted lists of each dimension.

Rows lie in blocks, and each block has, for every dimension, its rows sorted by that component. For a query the
lists are read in step, from the end that the sign of the query's component prefers; rows met for the first time
are scored whole. No unmet row can beat the bound, the inner product of the query with the components last read.
Reading stops when the k-th best score is above the bound (at equality an unmet row of smaller id might still win).
The best k of each block are merged. The result is exact; how far the lists are read depends on the data alone.
Where components are too large for sums that doubles hold exactly, doubles only bound the scores, and the rows that may
be among the best are scored in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch

#: Rows of a block; at most 65,536, as lists hold 16-bit positions.
BLOCK_ROWS = 8192
#: Queries of a block.
BLOCK_QUERIES = 256
#: Vectors with a component of this absolute value or more lie in blocks of their own, so that others stay exact in doubles.
LIMIT = 1 << 20
#: Doubles hold all whole numbers up to this absolute value.
EXACT = 1 << 53
#: The largest score of the result.
TOP = (1 << 63) - 1


class Block:
    """Rows of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray):
        self.ids, self.rows, self.lists = ids, rows.astype(np.float64), lists
        self.largest = float(np.abs(self.rows).max(initial=0))
        self.sorted = np.take_along_axis(self.rows.T, lists.astype(np.int64), 1)

    @staticmethod
    def sort(rows: np.ndarray) -> np.ndarray:
        """For each dimension the positions of the rows, by rising component."""
        return np.argsort(rows.T, axis=1, kind="stable").astype(np.uint16)

    def search(self, query: np.ndarray, k: int, skip: int, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k rows (ties to the smaller id) other than ``skip``, and the depth to which the lists were read."""
        if not len(query) * self.largest * float(np.abs(query).max(initial=0)) < EXACT:
            return self.scan(query, k, skip)
        n, used = len(self.ids), np.flatnonzero(query)
        weights, falling = query[used], query[used] > 0
        seen = self.ids == skip
        ids, scores = np.empty(0, np.int64), np.empty(0)
        depth, step = 0, first
        while depth < n and len(used):
            steps = np.arange(depth, min(n, depth + step))
            at = np.where(falling[:, None], n - 1 - steps, steps)
            fresh = np.zeros(n, bool)
            fresh[self.lists[used[:, None], at]] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            ids, scores = self.best(np.concatenate([ids, self.ids[new]]), np.concatenate([scores, self.rows[new] @ query]), k)
            depth, step = int(steps[-1]) + 1, step * 2
            bound = self.sorted[used, at[:, -1]] @ weights
            if len(ids) == k and scores[-1] > bound or seen.all():
                return ids, scores, depth
        if not len(used):  # every row scores 0
            return *self.best(self.ids[~seen], np.zeros((~seen).sum()), k), 0
        return ids, scores, depth

    def scan(self, query: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``search``, with scores as Python's integers: of all rows, those whose score may be among the best by the error that doubles can have."""
        with np.errstate(all="ignore"):
            about, slack = self.rows @ query, np.abs(self.rows) @ np.abs(query) * (len(query) + 2) * 2.0**-52
            low, high = about - slack, about + slack
        open_ = ~(np.isfinite(low) & np.isfinite(high))
        low[open_], high[open_] = -np.inf, np.inf
        chosen = self.ids != skip
        if chosen.sum() > k:
            chosen &= high >= np.sort(low[chosen])[-k]
        whole = [int(x) for x in query.tolist()]
        scores = [sum(int(x) * y for x, y in zip(row, whole)) for row in self.rows[chosen].tolist()]
        best = sorted(zip(scores, self.ids[chosen].tolist()), key=lambda x: (-x[0], x[1]))[:k]
        return np.array([i for _, i in best], np.int64), np.array([x for x, _ in best], object), len(self.ids)

    @staticmethod
    def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double, which holds it exactly; null for a vector that is null, empty, or holds a null or a non-finite component.

    A component that no double holds after scaling (beyond 7e305, so no float) is an error.
    """
    parts = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    huge = F.raise_error(F.lit("a component is too large to be scaled")).cast("double")

    def floor(x):  # from 2^53 on doubles are whole numbers
        return F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).when(F.abs(x) < float("inf"), x).otherwise(huge)

    return F.when(F.size(vector) > 0, F.when(sound, F.transform(parts, lambda x: floor(x * scale))))


def _blocks(vectors: DataFrame, rows: int, lists: bool) -> DataFrame:
    """Pack (id, v) rows of a partition into blocks of equal dimension, those with large components apart."""

    def pack(batches):
        task, serial = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], list[tuple[int, list[float]]]] = {}

        def emit(kind):
            nonlocal serial
            serial += 1
            dim = kind[0]
            ids, m = zip(*held.pop(kind))
            m = np.array(m, np.float64)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([task << 32 | serial], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "rows": pa.array([m.tobytes()], pa.binary()), "lists": pa.array([Block.sort(m).tobytes() if lists else b""], pa.binary()),
            })

        for batch in batches:
            for i, v in zip(*(c.to_pylist() for c in batch.columns)):
                kind = len(v), max(max(v), -min(v)) >= LIMIT
                held.setdefault(kind, []).append((i, v))
                if len(held[kind]) == rows:
                    yield emit(kind)
        for kind in list(held):
            yield emit(kind)

    return vectors.mapInArrow(pack, "block bigint, dim int, ids binary, rows binary, lists binary")


def search(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row that meets ``queries``, the k best other rows: query_id, rank (from 1), vec_id, score.

    Rows without id and unsound vectors (see ``quantise``) take no part. Rows of equal id are one record, with the
    least of their vectors. Only vectors of the query's dimension are its candidates; fewer than k give fewer rows.
    Query blocks are sent to every row block by an equi-join on the row block's number; only the best k of a pair of
    blocks for each query leave it. A score of the result that no bigint holds is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    sound = vectors.select(F.col(id_column).cast("bigint").alias("id"), quantise(F.col(vector)).alias("v")).where("id is not null and v is not null")
    sound = sound.groupBy("id").agg(F.min("v").alias("v"))
    rows = scratch.save(_blocks(sound, BLOCK_ROWS, True), "rows")
    asked = scratch.save(_blocks(sound.withColumn(id_column, F.col("id")).where(queries).select("id", "v"), BLOCK_QUERIES, False), "queries")
    parts = max(1, rows.count())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    pairs = asked.join(rows.hint("shuffle_hash"), ["part", "dim"]).select("dim", "ids", "rows", "lists", "q_ids", "q_rows")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                dim, ids, m, lists, q_ids, q = (c[at].as_py() for c in batch.columns)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                block = Block(ids, np.frombuffer(m, np.float64).reshape(-1, dim), np.frombuffer(lists, np.uint16).reshape(dim, -1))
                out = []
                for query_id, query in zip(q_ids.tolist(), np.frombuffer(q, np.float64).reshape(-1, dim)):
                    found, scores, _ = block.search(query, k, query_id)
                    beyond = np.array([(x > TOP) - (x < -TOP - 1) for x in scores.tolist()], np.int64)
                    held = np.array([min(max(int(x), -TOP - 1), TOP) for x in scores.tolist()], np.int64)
                    out.append((np.full(len(found), query_id), found, held, beyond))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score", "beyond"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, beyond bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond bigint")).cast("bigint"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
