"""Scratch tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the session names none (tests on one machine) a folder of our own is used.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} names no folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found


class Scratch:
    """Tables that cut lineage: each is written once as Parquet and read back by whoever needs it.

    With ``tidy`` the shuffle files of a table go as soon as it is written, not when the driver next collects garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        if self.tidy:
            self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            if self.tidy:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = 500):
    """Record batches cut into few rows, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch[k : k + rows]


def components(scratch: Scratch, edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node of its component.

    ``edges`` has two long columns ``a`` and ``b``. Each round points every node to the neighbour
    that comes first in a hashed order and contracts the graph along these pointers, so the number
    of rounds grows with the logarithm of the longest path; the hashed order keeps chains of
    ascending ids from being the worst case. Hot nodes only meet in partial aggregates and in joins
    that adaptive execution may split. Returns ``node, component`` for nodes that have an edge.
    """
    live = scratch.table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-edges-0",
    )
    hops: list[DataFrame] = []
    for k in range(1, max_rounds + 1):
        both = live.union(live.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m")
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        hop = both.groupBy(F.col("a").alias("node")).agg(first).select("node", F.least("m", own)["id"].alias("parent"))
        hop = scratch.table(hop, f"{name}-hop-{k}")
        hops.append(hop)
        pa = hop.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = hop.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        contracted = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        contracted = contracted.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live = scratch.table(contracted, f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}")
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = hops[0].select("node", F.col("parent").alias("root"))
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = scratch.table(roots, f"{name}-roots")
    scratch.drop(*(f"{name}-hop-{k}" for k in range(1, len(hops) + 1)))
    least = scratch.table(roots.groupBy("root").agg(F.min("node").alias("component")), f"{name}-least")
    return roots.join(least, "root").select("node", "component")


def pivot_links(scratch: Scratch, members: DataFrame, confirm, name: str) -> tuple[DataFrame, DataFrame]:
    """Links of bucket members with one pivot each, and the members of buckets that these leave open.

    ``members`` has ``key, node`` (long), each combination once. ``confirm`` takes distinct pairs
    ``a, b`` with a < b and returns those that are links. Each bucket's pivot is picked by an order of its
    own, so a node of several buckets meets several pivots; this is linear in the buckets' sizes. A bucket
    of two is done with that pair, a larger one when its members lie in one component. Returns the links and
    ``key, node, root`` of the members of all other buckets, root being the component so far.
    """
    turned = F.col("node").bitwiseXOR(F.col("key"))
    sizes = members.groupBy("key").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    back = lambda c: F.col(c).bitwiseXOR(F.col("key"))
    sizes = scratch.table(sizes.select("key", back("lo").alias("pivot"), back("hi").alias("other"), "n"), f"{name}-sizes")
    live = members.join(sizes.where("n > 2").select("key", "pivot"), "key").select("key", "node", "pivot")
    live = scratch.table(live, f"{name}-live")
    pairs = live.select("pivot", "node").where("node <> pivot").union(sizes.where("n = 2").select("pivot", "other"))
    pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    found = scratch.table(confirm(scratch.table(pairs.distinct(), f"{name}-pairs")), f"{name}-found")
    groups = scratch.table(components(scratch, found, f"{name}-c1"), f"{name}-groups")
    tagged = live.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
    tagged = scratch.table(tagged, f"{name}-tagged")
    mixed = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = scratch.table(mixed, f"{name}-mixed")
    rest = scratch.table(tagged.join(mixed, "key"), f"{name}-rest")
    scratch.drop(*(f"{name}-{x}" for x in ("sizes", "live", "pairs", "groups", "tagged", "mixed")))
    return found, rest


def block_pairs(scratch: Scratch, rows: DataFrame, keys: list[str], node: str, size: int, name: str) -> DataFrame:
    """Deal the rows of each key to pairs of blocks of about ``size`` rows: adds ``block, i, j`` with i <= j.

    Any two rows of a key meet in the pair ``i, j`` of their blocks; a key that fits into a block has
    one pair. Whoever groups by key, i and j never holds more than two blocks.
    """
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    blocks = scratch.table(blocks, f"{name}-blocks")
    dealt = rows.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def map_groups(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Run ``work`` on the rows of each key, given as one Arrow record batch; a key's rows must fit into a task's memory.

    ``work`` returns a record batch or None. The rows are dealt and sorted by key and read as a stream,
    so many small keys cost no more than their rows.
    """

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            new = np.zeros(table.num_rows - 1, bool)
            for k in keys:
                column = table.column(k).combine_chunks()
                new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            whole = table.to_batches()[0]
            for first, end in zip(starts, starts[1:], strict=False):
                if (out := work(whole[first:end])) is not None:
                    yield out
            kept = whole[starts[-1] :]
        if kept is not None and (out := work(kept)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, parent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Edges that join what a matrix of links joins, at most one less than there are nodes.

    ``parent`` carries what is joined already from one part of a matrix to the next.
    """
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    out = []
    for i in np.flatnonzero(links.any(1)):
        mine = root(int(left[i]))
        for other in right[links[i]].tolist():
            if (theirs := root(other)) != mine:
                parent[theirs] = mine
                out.append((int(left[i]), other))
    return out
