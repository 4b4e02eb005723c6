"""Connected components by joins: forests in the tasks, then contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, join_counted

#: Nodes that a task holds while it looks for links that connect nothing new.
HELD = 500_000
#: Links, each connecting two trees of the task it comes from, that are few enough for one task to finish.
FEW = 200_000


class _Trees:
    """Union-find; the root of a tree is its least node."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above, top = self.above, x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether they were in different trees."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)


def _batch(rows: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names)


def forest(links: DataFrame) -> DataFrame:
    """Links (longs a, b) that connect the same nodes: each task keeps those that join two of its own trees.

    A group of g nodes with all its g² links comes out of each task with less than g.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            kept = [(a, b) for a, b in _pairs_of(batch) if trees.join(a, b)]
            if kept:
                yield _batch(kept, ["a", "b"])
            if len(trees.above) > HELD:
                trees = _Trees()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _finished(edges: DataFrame) -> DataFrame:
    """node, root of few links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            for a, b in _pairs_of(batch):
                trees.join(a, b)
        nodes = sorted({*trees.above, *trees.above.values()})
        if nodes:
            yield _batch([(x, trees.root(x)) for x in nodes], ["node", "root"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of the links (longs a, b); root is the least node it reaches.

    Links that tasks have thinned out to at most FEW are finished by one task, whose size is so bounded; more are
    contracted in rounds until they are that few.  In each round a node takes the first of its neighbours and itself, in an order drawn anew for the round, as label,
    and labels follow labels once.  Then the links are contracted: their ends become labels, links within one label go
    and equal ones become one.  A round leaves a fraction of the nodes whatever the shape, a long chain too, so the
    rounds grow with the logarithm of the input.  Every round is checkpointed; all that reaches the driver is how many
    links are left.
    """
    edges = checkpoint(forest(links))
    left = edges.count()
    if left <= FEW:
        return _finished(edges)
    groups = checkpoint(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("group", F.col("node")))
    round_ = 0
    while left > FEW:
        round_ += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c), F.col(c).alias("node"))  # noqa: B023, E731
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(rank("b")).alias("other")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("other"))["node"].alias("label"))
        first = checkpoint(first)
        above = first.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = checkpoint(first.join(above, "label").select("node", F.col("above").alias("label")))
        near = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        both = near.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        edges = checkpoint(forest(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
        left = edges.count()
        moved = labels.select(F.col("node").alias("group"), "label")
        groups = checkpoint(groups.join(moved, "group", "left").select("node", F.coalesce("label", "group").alias("group")))
    last = _finished(edges).select(F.col("node").alias("group"), F.col("root").alias("label"))
    groups = checkpoint(groups.join(last, "group", "left").select("node", F.coalesce("label", "group").alias("group")))
    least = checkpoint(groups.groupBy("group").agg(F.min("node").alias("root"), F.count("*").alias("members")))
    return join_counted(groups, least, ["group"], "members").select("node", "root")
