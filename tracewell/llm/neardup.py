"""Near-duplicate documents by SetSketch.

A document's set is its distinct word shingles. Register i of a sketch is floor(1 - log_b(x_i)), cut to 0..q+1, where
x_i is the least of exponential variables of rate a that hash i gives the shingles: exponentially spaced truncated
minima. Registers of a union are the maxima of registers, and two sets agree in a register with a probability near
their Jaccard similarity. Bands of registers give buckets of candidates. Candidate pairs whose registers (how many
are equal, larger, smaller), jointly with the known set sizes, all but exclude the threshold by likelihood are put
aside; the others are confirmed on the full sets. Documents of equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, having, row_type, without
from tracewell.llm.components import bucket_blocks, hub_blocks, resolve
from tracewell.llm.shingles import mix, shingles

#: SetSketch parameters: base, rate, and the largest register less one.
BASE, RATE, CAP = 1.001, 20.0, 65_534
#: 60 bands of 8 registers: a pair at similarity 0.8 is missed with probability 1.6e-5, one at 0.85 with 5e-9; one at 0.1 is met with 6e-7.
BANDS, BAND_REGISTERS = 60, 8
#: How much less likely the threshold must be than the best similarity for a candidate to be put aside (natural logarithm).
DOUBT = 14.0
#: Documents of a block when a hub is compared with what meets it.
BLOCK = 512
#: Shingles hashed at a time; they and their products stay in the processor's cache.
CHUNK = 1 << 16

_rng = np.random.default_rng(20_240_601)
_ODD = _rng.integers(0, 2**63, BANDS * BAND_REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, BANDS * BAND_REGISTERS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, BAND_REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each non-empty set of 64-bit hashes."""
    minima = np.full((len(sets), len(_ODD)), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        if end == at + 1 and len(flat) > CHUNK:  # one long document, by parts
            parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            starts = np.zeros(1, np.int64)
        else:
            parts = [flat]
            starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for part in parts:
            for i, (odd, flip) in enumerate(zip(_ODD, _FLIP)):
                np.minimum(minima[at:end, i], np.minimum.reduceat((part ^ flip) * odd, starts), out=minima[at:end, i])
        at = end
    u = (minima >> np.uint64(11)).astype(np.float64)
    x = -np.log1p(-(u + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, CAP + 1).astype("<u2")


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(one, two)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each sketch and band."""
    parts = sketches.reshape(len(sketches), BANDS, BAND_REGISTERS).astype(np.uint64)
    return mix((mix(parts + np.uint64(1)) * _BAND).sum(2, dtype=np.uint64) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def log_likelihood(j: np.ndarray, more: np.ndarray, fewer: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first are larger, smaller and equal, and the shares u and v of the set sizes."""

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p_more, p_fewer = p(u - v * j), p(v - u * j)
    p_equal = np.clip(1 - p_more - p_fewer, 1e-300, 1)
    return more * np.log(np.clip(p_more, 1e-300, 1)) + fewer * np.log(np.clip(p_fewer, 1e-300, 1)) + equal * np.log(p_equal)


def plausible(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """For rows of registers and set sizes, whether similarity ``threshold`` or more can't be excluded."""
    more, fewer, equal = ((f(one, two)).sum(1).astype(float) for f in (np.greater, np.less, np.equal))
    u, v = n / (n + m), m / (n + m)
    most = np.minimum(n, m) / np.maximum(n, m)
    grid = np.linspace(0, 1, 101)[:, None] * most
    values = log_likelihood(grid, more, fewer, equal, u, v)
    at_least = np.where(grid >= np.minimum(threshold, most), values, -np.inf).max(0)
    return (most >= threshold - 1e-9) & (values.max(0) - at_least <= DOUBT)


def _each(docs: DataFrame, width: int, finish, schema) -> DataFrame:
    """``finish`` of the ids and sets of some hundred rows at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield finish(part.column(0), [np.unique(shingles(t.as_py(), width)) for t in part.column(1)])

    return docs.mapInArrow(run, schema)


def node_ids(sets: list[np.ndarray], seed: int) -> list[int | None]:
    """A 63-bit id for each set; an empty one has none."""
    return [xxhash.xxh3_64_intdigest(s.tobytes(), seed) >> 1 if len(s) else None for s in sets]


def sketch(docs: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, node (id of the set), set_key (128-bit digest of it) and keys (a bucket for each band) of each row; an empty set has nulls."""

    def finish(ids, sets):
        full = [s for s in sets if len(s)]
        made = iter(bands(registers(full)).view(np.int64)) if full else iter(())
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        rows = [next(made) if len(s) else None for s in sets]
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(node_ids(sets, seed), pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_shingles", "node", "set_key", "keys"])

    return _each(docs.select("doc_id", "text"), width, finish, row_type(docs, ["doc_id"], n_shingles="bigint", node="bigint", set_key="binary", keys="array<bigint>"))


def _candidates(docs: DataFrame, nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """For each of ``nodes`` (id) its set, sorted, and the set's size and registers."""

    def finish(_, sets):
        full = [s for s in sets if len(s)]
        made = registers(full) if full else []
        columns = [pa.array(node_ids(full, seed), pa.int64()), pa.array([len(s) for s in full], pa.int64()), pa.array([s.tobytes() for s in full], pa.binary()), pa.array([r.tobytes() for r in made], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "members", "registers"])

    return _each(having(docs, nodes, "doc_id").select("doc_id", "text"), width, finish, "id bigint, n bigint, members binary, registers binary")


def components(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the
    least doc_id reachable. Documents without a word are linked with nothing. Rows of a null doc_id are linked with nothing: their
    component is null and they are kept. A repeated doc_id gets a row for each of its rows.

    Only hashes, digests and bucket keys are shuffled for all documents; sets travel for candidates alone.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seed = 0
    while True:
        sketches = scratch.save(sketch(narrow, width, seed), f"sketches-{seed}")
        whole = sketches.where("node is not null and doc_id is not null")
        classes = scratch.save(whole.groupBy("node").agg(F.min("doc_id").alias("rep"), (F.min("set_key") != F.max("set_key")).alias("clash")), f"classes-{seed}")
        if classes.where("clash").isEmpty():
            break
        seed += 1  # two sets share a node id: once in many corpora
    rows = whole.select(F.explode("keys").alias("bucket"), F.col("node").alias("id"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    shared = scratch.save(rows.join(crowded, "bucket").distinct(), "shared")
    several = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = scratch.save(shared.join(several, "bucket"), "buckets")
    wanted = scratch.save(buckets.select(F.col("id").alias("node")).distinct(), "wanted")
    # a document of each candidate node; a doc_id that repeats brings further sets, which are dropped again
    speakers = scratch.save(classes.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "speakers")
    members = scratch.save(_candidates(narrow, speakers, width, seed).join(wanted.withColumnRenamed("node", "id"), "id", "left_semi").dropDuplicates(["id"]), "members")
    threshold = percent / 100

    def check(batches):
        for batch in batches:
            links = []
            for a, b in zip(batch.column("m_a"), batch.column("m_b")):
                one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(one, two, assume_unique=True))
                links.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    def estimate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                one, two = (np.stack([np.frombuffer(r.as_py(), "<u2") for r in part.column(c)]) for c in ("r_a", "r_b"))
                n, m = (part.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield part.select(["a", "b"]).filter(pa.array(plausible(one, two, n, m, threshold)))

    def verify(pairs: DataFrame, turn: int) -> DataFrame:
        sized = pairs
        for end in ("a", "b"):
            sized = sized.join(members.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}")), end)
        sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "r_a", "r_b")
        likely = scratch.save(sized.mapInArrow(estimate, "a bigint, b bigint"), f"likely-{turn}")
        for end in ("a", "b"):
            likely = likely.join(members.select(F.col("id").alias(end), F.col("members").alias(f"m_{end}")), end)
        return likely.select("a", "b", "m_a", "m_b").mapInArrow(check, "a bigint, b bigint")

    def compare(meets: DataFrame, held: DataFrame) -> DataFrame:
        return hub_blocks(scratch, meets, held, "members", BLOCK).applyInPandas(_meet(percent), "a bigint, b bigint")

    keys = scratch.save(whole.join(wanted, "node", "left_semi").groupBy(F.col("node").alias("id")).agg(F.first("keys").alias("keys")), "keys")

    def sift(opened: DataFrame) -> DataFrame:
        """Estimates within blocks of a bucket; a pair comes out of the first band that it shares only, and only if it is plausible."""
        carried = opened.join(members.select("id", "n", "registers"), "id").join(keys, "id")
        dealt = bucket_blocks(carried, BLOCK).select("block", "own", "id", "comp", "n", "registers", "keys")
        return dealt.mapInArrow(_sift(threshold), "a bigint, b bigint")

    labels = resolve(scratch, buckets, verify, compare, sift)
    # a component's nodes are named by set; its name is the least doc_id among them
    named = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("root"))
    reached = named.join(least, "comp").select("node", "root")
    placed = sketches.select("doc_id", "n_shingles", "node").join(reached, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.cast("bigint").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _meet(percent: int):
    """For each outsider the first link to a member of the hub's block, the likeliest members being tried first."""
    import pandas as pd

    def run(outside, inside):
        if not len(outside) or not len(inside):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        two = np.stack([np.frombuffer(r, "<u2") for r in inside.registers])
        sets = [np.frombuffer(m, np.uint64) for m in inside.members]
        ids, m = inside.id.to_numpy(), inside.n.to_numpy().astype(float)
        links = []
        for x, n, own, held in zip(outside.id, outside.n, outside.registers, outside.members):
            one = np.broadcast_to(np.frombuffer(own, "<u2"), two.shape)
            likely = np.flatnonzero(plausible(one, two, np.full(len(m), float(n)), m, percent / 100))
            mine = np.frombuffer(held, np.uint64)
            for at in likely[np.argsort(-(one[likely] == two[likely]).sum(1), kind="stable")].tolist():
                both = len(np.intersect1d(mine, sets[at], assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(sets[at]) - both):
                    links.append((min(x, ids[at]), max(x, ids[at])))
                    break
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _sift(threshold: float):
    def compare(rows):
        bucket, own, ids, comps, n, registers, keys = rows
        one = np.stack([np.frombuffer(r, "<u2") for r in registers])
        bands_ = np.stack(keys)
        own, ids, comps, n = np.array(own), np.array(ids), np.array(comps), np.array(n, float)
        i, j = bucket["i"], bucket["j"]
        x, y = np.triu_indices(len(ids), 1)
        wanted = comps[x] != comps[y]
        if i != j:
            wanted &= own[x] != own[y]
        wanted &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
        x, y = x[wanted], y[wanted]
        out = []
        for at in range(0, len(x), 4096):
            p, q = x[at : at + 4096], y[at : at + 4096]
            same = bands_[p] == bands_[q]
            first = np.take_along_axis(bands_[p], same.argmax(1)[:, None], 1)[:, 0] == bucket["bucket"]
            p, q = p[first], q[first]
            likely = plausible(one[p], one[q], n[p], n[q], threshold) if len(p) else np.zeros(0, bool)
            out.append((np.minimum(ids[p], ids[q])[likely], np.maximum(ids[p], ids[q])[likely]))
        return out

    def run(batches):
        held, last = [], None

        def flush():
            if len(held) > 1:
                for a, b in compare([last, *zip(*held)]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            held.clear()

        for batch in batches:
            columns = [batch.column(k) for k in range(1, batch.num_columns)]
            blocks = batch.column(0).to_pylist()
            for at, block in enumerate(blocks):
                if block != last:
                    yield from flush()
                    last = block
                *plain, packed = (c[at] for c in columns)
                held.append((*(v.as_py() for v in plain), packed.values.to_numpy()))
        yield from flush()

    return run


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all its columns, with one document of each component: the one of least doc_id. Documents without words or id all stay; of a repeated doc_id all rows stay if one does."""
    found = components(docs, width, percent)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return without(docs, Scratch(docs.sparkSession, "gone").save(gone, "ids"), "doc_id").select(*docs.columns)
