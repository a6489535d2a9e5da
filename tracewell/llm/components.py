"""Connected components over candidate buckets, without a pair for every two members of a bucket.

Candidates come as buckets of ids. A link between two ids is costly to verify, and only links that join different
components matter. First each bucket is compared with one pivot, which settles most buckets: their members are then
in one component. In the others, the largest component is the hub: ids that meet it from outside are compared with
its members block by block, where a block of pairs is looked at in memory and only links come out. At last the ids
outside the hubs are compared with each other. So every two ids of different components that share a bucket are
compared, and no component is missed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch

#: Members that a component has at least to be a hub; smaller ones are compared pair by pair.
HUB_SIZE = 32
#: Up to so many edges are contracted in one task, whose memory that bounds; more are contracted by distributed rounds.
TASK_EDGES = 50_000


def contract(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """The least node reachable from each node of the undirected ``edges`` (u, v): columns node, root.

    Every node hooks onto its least smaller neighbour, the trees are flattened by pointer jumping, and edges between
    trees are contracted likewise until none is left. Every step is a table in the shared folder.
    """
    edges = scratch.save(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), f"{tag}-edges")
    if edges.count() <= TASK_EDGES:
        return scratch.save(edges.coalesce(1).mapInArrow(_union_find, "node bigint, root bigint"), f"{tag}-roots")
    roots = None
    turn = 0
    while not edges.isEmpty():
        # (u, v) has u < v: a node that is ever a v hooks onto its least u, the others are roots
        hooks = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        tops = edges.select(F.col("u").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("root"))
        tree = scratch.save(hooks.unionByName(tops), f"{tag}-{turn}-tree-0")
        jump = 0
        while True:
            jump += 1
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            flat = scratch.save(tree.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), f"{tag}-{turn}-tree-{jump}")
            tree, moved = flat.drop("moved"), flat.where("moved").isEmpty()
            if moved:
                break
        if roots is None:
            roots = tree
        else:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = scratch.save(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{tag}-{turn}-roots")
        for end in ("u", "v"):
            edges = edges.join(tree.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        edges = scratch.save(edges.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).where("u < v").distinct(), f"{tag}-{turn}-edges")
        turn += 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0) if roots is None else roots


def _union_find(batches):
    parent: dict[int, int] = {}

    def top(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = top(u), top(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def hub_blocks(scratch: Scratch, meets: DataFrame, held: DataFrame, payload: str, size: int):
    """Groups of about ``size`` outsiders and as many members of their hub, with the columns of the saved table ``payload`` (by id).

    What an id carries travels once for each block of the other side, not for each pair.
    """
    counts = held.groupBy("hub").agg(F.count(F.lit(1)).alias("h")).join(meets.groupBy("hub").agg(F.count(F.lit(1)).alias("o")), "hub")
    scratch.save(counts.select("hub", *((F.ceil(F.col(c) / size).cast("int")).alias(c) for c in ("h", "o"))), "hub-blocks")

    def side(rows: DataFrame, own: str, across: str):
        # both sides read the tables anew: a cogroup tells its columns apart by their origin
        carried, sizes = (scratch.read(name) for name in (payload, "hub-blocks"))
        rows = rows.join(sizes, "hub").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn(across, F.explode(F.sequence(F.lit(0), F.col(across) - 1))).join(carried, "id")
        return rows.select("hub", "h", "o", *carried.columns).groupBy("hub", "h", "o")

    return side(meets, "o", "h").cogroup(side(held, "h", "o"))


def bucket_blocks(opened: DataFrame, size: int, active: str | None = None) -> DataFrame:
    """``opened`` dealt and sorted so that rows of equal ``block`` (bucket, i, j) follow each other: at most about two blocks of ``size`` rows of a bucket, with ``own``, the row's block.

    Every two rows of a bucket are together in the group of their two blocks; given the boolean column ``active``, every two of which one is active.
    """
    blocks = lambda held: F.ceil(held / size).cast("int")
    if active is None:
        counts = opened.groupBy("bucket").agg(blocks(F.count(F.lit(1))).alias("blocks"))
        own, reach = F.pmod(F.xxhash64("id"), F.col("blocks")), F.col("blocks")
    else:
        counts = opened.groupBy("bucket").agg(blocks(F.count_if(active)).alias("blocks"), blocks(F.count_if(~F.col(active))).alias("idle")).where("blocks > 0")
        own = F.when(F.col(active), F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1)))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("id"), F.greatest("idle", F.lit(1))))
        reach = F.when(F.col(active), F.col("blocks") + F.col("idle")).otherwise(F.col("blocks"))
    rows = opened.join(counts, "bucket").withColumn("own", own.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), reach - 1)))
    block = F.struct("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.withColumn("block", block).drop("other", "blocks", "idle").repartition("block").sortWithinPartitions("block")


def resolve(
    scratch: Scratch,
    buckets: DataFrame,
    verify: Callable[[DataFrame, int], DataFrame],
    compare: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    sift: Callable[[DataFrame], DataFrame] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The component (least id) of the ids in ``buckets`` (bucket, id): columns id, comp. Ids without a link have no row.

    ``verify`` takes pairs (a, b), a < b, with the number of the round, and returns those that are links. ``compare``
    takes ids with the hubs that they meet (id, hub) and the hubs' members (id, hub); it returns links (a, b), one for
    each id and hub that are linked at least. Without it hubs are compared pair by pair. ``sift`` may make the last
    pairs out of open buckets (bucket, id, comp): at least all pairs of different components that may be links. ``known``
    are links (a, b) that need no check; they join components at the end and spare no pair its check.
    """
    spark = scratch.spark
    labels = scratch.save(spark.createDataFrame([], "id bigint, comp bigint"), "labels-0")

    def merge(links: DataFrame, turn: int) -> DataFrame:
        """Labels after the components that ``links`` join are made one."""
        edges = links
        for end, name in (("a", "u"), ("b", "v")):
            edges = edges.join(labels.select(F.col("id").alias(end), F.col("comp").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
        roots = contract(scratch, edges.select("u", "v"), f"contract-{turn}")
        moved = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        fresh = roots.select(F.col("node").alias("id"), F.col("root").alias("comp")).join(labels, "id", "left_anti")
        return scratch.save(moved.unionByName(fresh), f"labels-{turn + 1}")

    def finish() -> DataFrame:
        return labels if known is None else merge(known, 3)

    pivots = buckets.groupBy("bucket").agg(F.min("id").alias("a"))
    pairs = scratch.save(buckets.join(pivots, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs-0")
    labels = merge(scratch.save(verify(pairs, 0), "links-0"), 0)

    members = buckets.join(labels, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    members = scratch.save(members, "placed")
    bounds = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    opened = scratch.save(members.join(bounds, "bucket"), "opened")
    if opened.isEmpty():
        return finish()
    if compare is not None:
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= HUB_SIZE)
        parts = opened.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).join(sizes, "comp")
        hubs = scratch.save(parts.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("hub")), "hubs")
        opened = scratch.save(opened.join(hubs, "bucket", "left"), "opened-hubs")
        meets = scratch.save(opened.where("comp <> hub").select("id", "hub").distinct(), "meets")
        held = labels.join(meets.select(F.col("hub").alias("comp")).distinct(), "comp", "left_semi").select("id", F.col("comp").alias("hub"))
        labels = merge(scratch.save(compare(meets, held), "links-1"), 1)
        opened = opened.where("hub is null or comp <> hub").drop("comp", "hub").join(labels, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
        left = opened.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        opened = scratch.save(scratch.save(opened, "opened-left").join(left, "bucket", "left_semi"), "opened-last")

    if sift is not None:
        pairs = sift(opened)
    else:
        mine = opened.select("bucket", F.col("id").alias("x"), F.col("comp").alias("x_comp"))
        other = opened.select(F.col("bucket").alias("y_bucket"), F.col("id").alias("y"), F.col("comp").alias("y_comp"))
        met = mine.join(other, (F.col("bucket") == F.col("y_bucket")) & (F.col("x_comp") < F.col("y_comp")))
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    labels = merge(scratch.save(verify(scratch.save(pairs.distinct(), "pairs-2"), 2), "links-2"), 2)
    return finish()
