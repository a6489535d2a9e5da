"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

``LineStore`` keeps, in the shared folder, one posting for each (line key, document). From the postings come the exact
reference counts; keys that enough documents hold are the *common* keys. For each shard of the key space a cuckoo
filter holds fingerprints of its common keys. A document whose lines all miss the filters is clean and never meets
the tables; any hit, false ones included, is settled by the exact tables. Inserting documents raises counts and
deleting documents lowers them, and the filters gain or lose just the keys that crossed the limit: cuckoo filters
support deletion, so what a document brought in goes with it.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, row_type

#: Keys of one filter, at most about.
SHARD_KEYS = 200_000
#: Filters are broadcast up to so many bytes; beyond, every line is settled by the exact tables.
BROADCAST_BYTES = 64 << 20
#: Stands for a null doc_id: one document that ranks lowest.
NULL_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    """A line as compared: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def line_digests(text: str | None, least: int) -> list[bytes | None]:
    """For each line the 128-bit digest of its key, or None if the key has fewer than ``least`` code points. A null or empty text is one empty line."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line_key(line)
        long = len(key) >= least and (key.isascii() or len(key.decode()) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; insertion, deletion and lookup of keys given as pairs of 64-bit integers."""

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.size = 1 << max(0, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85))))
        self.table = np.zeros((self.size, self.SLOTS), np.uint16) if table is None else table.reshape(-1, self.SLOTS).copy()
        self.size = len(self.table)

    def _places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.size - 1)
        print_ = (b % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = a & mask
        return print_, first.astype(np.int64), (first ^ self._shift(print_)).astype(np.int64)

    def _shift(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(self.size - 1)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each key whether it may be in: never false for one that is."""
        print_, one, two = self._places(a, b)
        return (self.table[one] == print_[:, None]).any(1) | (self.table[two] == print_[:, None]).any(1)

    def insert(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Add keys, each once; False if the filter is too full, and it must then be built anew with more room."""
        table = self.table
        for print_, one, two in zip(*(x.tolist() for x in self._places(a, b))):
            for _ in range(500):
                for at in (one, two):
                    if (free := np.flatnonzero(table[at] == 0)).size:
                        table[at, free[0]] = print_
                        break
                else:
                    slot = (print_ + one) % self.SLOTS  # the evicted one moves to its other bucket
                    print_, table[two, slot] = int(table[two, slot]), print_
                    one = two
                    two = int(two ^ int(self._shift(np.array([print_], np.uint16))[0]))
                    continue
                break
            else:
                return False
        return True

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for print_, one, two in zip(*(x.tolist() for x in self._places(a, b))):
            for at in (one, two):
                if (held := np.flatnonzero(self.table[at] == print_)).size:
                    self.table[at, held[0]] = 0
                    break

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> CuckooFilter:
        room = 2 * len(a) + 64
        while not (made := cls(room)).insert(a, b):
            room *= 2
        return made


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs[:, 0], pairs[:, 1]


class ShardedFilter:
    """A cuckoo filter for each shard; a key's shard is its first half modulo the number of shards."""

    def __init__(self, shards: int, tables: dict[int, bytes]):
        self.shards = shards
        self.filters = {s: CuckooFilter(0, np.frombuffer(t, np.uint16)) for s, t in tables.items()}

    def contains(self, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        if not keys:
            return out
        a, b = halves(keys)
        shard = (a >> np.uint64(32)) % np.uint64(self.shards)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                at = np.flatnonzero(shard == s)
                out[at] = self.filters[s].contains(a[at], b[at])
        return out


def shard_of(key: Column, shards: int) -> Column:
    """The same shard in SQL: the upper 32 bits of the key's first half, modulo the number of shards."""
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


class LineStore:
    """Postings, exact counts and filters of the lines of a corpus; every change makes a new store and leaves the old one valid."""

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.scratch = Scratch(spark, "lines")
        self.version = 0
        self.postings: DataFrame | None = None
        self.common: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1
        self.built = 0

    def _next(self, postings: DataFrame, common: DataFrame, filters: DataFrame, shards: int, built: int) -> LineStore:
        new = LineStore(self.spark, self.min_chars, self.min_docs)
        new.scratch, new.version = self.scratch, self.version + 1
        new.postings, new.common, new.filters, new.shards, new.built = postings, common, filters, shards, built
        return new

    def _read(self, docs: DataFrame) -> DataFrame:
        """A posting for each long line of ``docs``: 16-byte key and doc_id, repeats within a document once."""
        least = self.min_chars

        def run(batches):
            for batch in batches:
                keys, ids = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = set(line_digests(text.as_py(), least)) - {None}
                    keys += found
                    ids += [NULL_ID if doc_id is None else doc_id] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "key binary, doc_id bigint")

    def _count(self, postings: DataFrame) -> DataFrame:
        """The exact table of common keys: references and the largest document."""
        return postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("holder")).where(F.col("refs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with the documents added. A doc_id that is there already is the same document: its new lines join it."""
        fresh = self._read(docs)
        version = f"postings-{self.version + 1}"
        if self.postings is None:
            # rows that repeat a doc_id are counted once
            postings = self.scratch.save(fresh, version)
            ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
            if not ids.isEmpty():
                postings = self.scratch.save(postings.distinct(), f"{version}-distinct")
        else:
            postings = self.scratch.save(self.postings.unionByName(fresh).distinct(), version)
        return self._derive(postings)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store as if the documents of these ids (column doc_id) had never been inserted."""
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        return self._derive(self.scratch.save(self.postings.join(gone, "doc_id", "left_anti"), f"postings-{self.version + 1}"))

    def _derive(self, postings: DataFrame) -> LineStore:
        at = self.version + 1
        common = self.scratch.save(self._count(postings), f"common-{at}")
        keys = common.count()
        if self.filters is not None and keys <= 1.5 * self.built + 64:
            changes = (
                common.select("key", F.lit(1).alias("change")).union(self.common.select("key", F.lit(-1).alias("change")))
                .groupBy("key").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
            )
            filters = self.scratch.save(self._filter(changes, self.filters, self.shards), f"filters-{at}")
            if filters.where("table is null").isEmpty():
                return self._next(postings, common, filters, self.shards, self.built)
        shards = max(1, -(-keys // SHARD_KEYS))
        none = self.spark.createDataFrame([], "shard int, table binary")
        filters = self.scratch.save(self._filter(common.select("key", F.lit(1).alias("change")), none, shards), f"filters-{at}-anew")
        return self._next(postings, common, filters, shards, keys)

    def _filter(self, changes: DataFrame, old: DataFrame, shards: int) -> DataFrame:
        """Each shard's filter after keys came (change 1) and went (-1); a null table where an old filter had no room left."""

        def change(key, new, before):
            import pandas as pd

            gained, lost = (list(new.loc[new.change == c, "key"]) for c in (1, -1))
            if not len(before):
                made = CuckooFilter.build(*halves(gained))
            else:
                made = CuckooFilter(0, np.frombuffer(bytes(before.table.iloc[0]), np.uint16))
                if lost:
                    made.delete(*halves(lost))
                if gained and not made.insert(*halves(gained)):
                    made = None
            return pd.DataFrame({"shard": [int(key[0])], "table": [made.table.tobytes() if made else None]})

        tagged = changes.select(shard_of(F.col("key"), shards).alias("shard"), "key", "change")
        return tagged.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(change, "shard int, table binary")

    def _probe(self) -> ShardedFilter | None:
        """All filters, if they fit the bound of a broadcast."""
        size = self.filters.agg(F.sum(F.length("table"))).first()[0] or 0
        return ShardedFilter(self.shards, {r.shard: bytes(r.table) for r in self.filters.collect()}) if size <= BROADCAST_BYTES else None

    def drops(self) -> DataFrame:
        """For each document that loses lines, the keys it loses: the common ones of which it isn't the holder."""
        lost = self.postings.join(self.common.select("key", "holder"), "key").where(F.col("doc_id") < F.col("holder"))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def dedup(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """``docs`` with the store's common lines dropped from all but the largest document that holds them.

        All columns are kept; ``text`` is the lines that stay, joined by newlines (null if it was null), and
        ``n_lines`` and ``n_dropped`` are added; where ``docs`` has such a column, it stays and the added one's name gets
        underscores at its end. With ``digest`` only doc_id, the two counts and ``kept_sha256`` are returned.
        Every row of a repeated doc_id loses the document's lines; null doc_ids are one document, the lowest.
        Text is shuffled only for documents that have a line in the filters.
        """
        spark, least = self.spark, self.min_chars
        probe = self._probe()
        shared = spark.sparkContext.broadcast(probe)
        extra = [] if digest else [c for c in docs.columns if c not in ("doc_id", "text")]
        packed = docs.select(F.col("doc_id"), F.col("text"), *([F.struct(*extra).alias("_rest")] if extra else []))

        def look(batches):
            filters = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    texts = part.column(1).to_pylist()
                    digests = [line_digests(t, least) for t in texts]
                    long = [[k for k in d if k] for d in digests]
                    if filters is None:
                        hit = [bool(k) for k in long]
                    else:
                        found = filters.contains([k for d in long for k in d])
                        ends = np.cumsum([len(d) for d in long])
                        hit = [bool(found[e - len(d) : e].any()) for d, e in zip(long, ends)]
                    whole = [hashlib.sha256((t or "").encode()).hexdigest() if digest and not h else None for t, h in zip(texts, hit)]
                    texts = [None if digest and not h else t for t, h in zip(texts, hit)]
                    ids = [NULL_ID if i is None else i for i in part.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(texts, part.column(1).type), *part.columns[2:], pa.array([len(d) for d in digests], pa.int64()), pa.array(ids, pa.int64()), pa.array(whole, pa.string())],
                        [*part.schema.names, "n_lines", "_at", "_whole"],
                    )

        seen = packed.mapInArrow(look, row_type(packed, n_lines="bigint", _at="bigint", _whole="string"))
        both = seen.join(self.drops().withColumnRenamed("doc_id", "_at").hint("shuffle_hash"), "_at", "left").drop("_at")

        kept_columns = packed.columns

        def cut(batches):
            for batch in batches:
                names = batch.schema.names
                at = {n: i for i, n in enumerate(names)}
                texts, dropped, sums = [], [], []
                for text, keys, whole in zip(batch.column(at["text"]), batch.column(at["keys"]), batch.column(at["_whole"])):
                    text, keys = text.as_py(), keys.as_py()
                    n = 0
                    if keys:
                        gone = set(keys)
                        kept = [line for line, k in zip(text.split("\n"), line_digests(text, least)) if k is None or k not in gone]
                        n = text.count("\n") + 1 - len(kept)
                        text = "\n".join(kept)
                    texts.append(text)
                    dropped.append(n)
                    sums.append(whole.as_py() or hashlib.sha256((text or "").encode()).hexdigest() if digest else None)
                n_dropped = pa.array(dropped, pa.int64())
                if digest:
                    yield pa.RecordBatch.from_arrays([batch.column(at["doc_id"]), batch.column(at["n_lines"]), n_dropped, pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(at["doc_id"]), pa.array(texts, batch.column(at["text"]).type), *([batch.column(at["_rest"])] if extra else []), batch.column(at["n_lines"]), n_dropped], [*kept_columns, "n_lines", "n_dropped"])

        if digest:
            return both.mapInArrow(cut, row_type(docs, ["doc_id"], n_lines="bigint", n_dropped="bigint", kept_sha256="string"))
        done = both.mapInArrow(cut, row_type(packed, n_lines="bigint", n_dropped="bigint"))
        added = [F.col(c).alias(c + "_" * next(k for k in count() if c + "_" * k not in docs.columns)) for c in ("n_lines", "n_dropped")]
        return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns), *added)
