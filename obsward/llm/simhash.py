"""SimHash near-duplicates by pivot distance tables.

The table holds, for each fingerprint, its Hamming distance to every reference fingerprint (pivot), block of bits by
block: the distance to a pivot is the sum over the blocks.  For fingerprints a, b at most m bits apart the triangle
inequality holds in every block, so

* in the blocks where they don't differ (of m + 3 blocks at least three) all their coordinates are equal, and
* to any pivot, their distances differ by at most m.

The first makes candidates by equi-joins on the coordinates of three blocks.  Coordinates over all bits can't do that:
distances of unrelated fingerprints to a pivot lie around 32 with deviation 4, so cells that hold a difference of 4 hold
most of the table.  Pivots drawn from each bucket of candidates, and the second property, discard the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, join_counted, map_batches, portions, read, scratch, utf8
from obsward.llm.components import components
from obsward.llm.hashing import simhash_many
from obsward.llm.similar import keep_one, named_fingerprints
from obsward.llm.superkmer import U, key_table, looked_up

#: Reference fingerprints of the distance table (drawn at random; any set gives the same links).
_DRAWN = Random(16)
PIVOTS = tuple(_DRAWN.getrandbits(64) for _ in range(16))
#: Blocks of bits whose coordinates a candidate pair shares.
SHARED = 3


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; a null text has no words and so fingerprint 0."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        found = [simhash_many(texts[a:b], shingle).view(np.int64) for a, b in portions(texts, 1 << 19)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]


def distance_table(fps: DataFrame, blocks: int) -> DataFrame:
    """fp and a column for each block: the distances to the pivots in its bits, 4 bits each (blocks of at most 15 bits)."""
    columns = []
    for k, mask in enumerate(_masks(blocks)):
        packed = F.lit(0).cast("long")
        for j, p in enumerate(PIVOTS):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 4 * j))
        columns.append(packed.alias(f"c{k}"))
    return fps.select("fp", *columns)


def candidate_buckets(fps: DataFrame, most: int) -> DataFrame:
    """key, fp: fingerprints (distinct) that share their coordinates in three blocks, once for each such three.

    A bit table of the keys that several fingerprints have leaves the others where they are: only rows of shared keys, and
    some of keys that share their bit, which are alone under theirs, are written and joined later.
    """
    blocks = most + SHARED
    names = combinations([f"c{k}" for k in range(blocks)], SHARED)
    keys = F.array(*[F.xxhash64(F.lit(i), *some) for i, some in enumerate(names)])
    table = distance_table(fps, blocks)
    shared = key_table(table.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column("keys").flatten().to_numpy()
            on = np.flatnonzero(looked_up(shared.value, some.view(U)))
            of = np.repeat(np.arange(batch.num_rows), len(some) // max(batch.num_rows, 1))[on]
            yield pa.RecordBatch.from_arrays([pa.array(some[on]), batch.column("fp").take(pa.array(of))], ["key", "fp"])

    return scratch(table.select(keys.alias("keys"), "fp").mapInArrow(run, "key bigint, fp bigint"))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _linked_to(pivot: str, rows: DataFrame, most: int) -> DataFrame:
    near = rows.where((_apart("fp", pivot) <= most) & (F.col("fp") != F.col(pivot)))
    return near.select(F.least("fp", pivot).alias("a"), F.greatest("fp", pivot).alias("b"))


def linked(fps: DataFrame, most: int = 4) -> DataFrame:
    """node, root of the fingerprints (column fp, distinct) that others reach by links of at most `most` bits.

    Every fingerprint of a bucket is first compared with two pivots drawn from it, one by hash and the one farthest from
    that, so a group of g near copies is joined by about 2g comparisons.  Then fingerprints of a bucket that are still in
    different components are paired, those outside its largest component with all others, if their distances to the
    bucket's first pivot differ by at most `most` (cells of that width and their neighbours), and verified.  So no link
    between different components is missed, and links within one are not needed.
    """
    buckets = candidate_buckets(fps, most)
    first = checkpoint(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("key", "fp")).alias("one")).where("n > 1"))
    near = scratch(join_counted(buckets, first, ["key"], "n").select("key", "fp", "one", _apart("fp", "one").alias("d")))
    # buckets that lie within reach of their first pivot are one component
    second = near.groupBy("key").agg(F.count("*").alias("n"), F.max("d").alias("far"), F.max_by("fp", F.struct("d", "fp")).alias("two"))
    wide = scratch(join_counted(near, checkpoint(second.where(F.col("far") > most)), ["key"], "n").select("key", "fp", "d", "two"))
    found = scratch(components(_linked_to("one", near, most).unionByName(_linked_to("two", wide, most))))
    rooted = scratch(wide.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "d", F.coalesce("root", "fp").alias("root")))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
    open_ = checkpoint(sizes.agg(F.sum("size").alias("n"), F.count("*").alias("several"), F.max_by("root", F.struct("size", "root")).alias("main")).where("several > 1"))
    if open_.isEmpty():
        return found
    pairs = scratch(_pairs(scratch(join_counted(rooted, open_, ["key"], "n").select("key", "fp", "root", "main", "d")), most))
    if pairs.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(pairs))


def _pairs(live: DataFrame, most: int) -> DataFrame:
    """a, b: roots of different components that links within a bucket join.  live: key, fp, root, main (the largest root),
    d (to a pivot)."""
    cell = F.floor(F.col("d") / (most + 1))
    minor = live.where("root <> main").withColumn("cell", cell)
    around = live.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = F.expr(f"q.key = p.key AND q.cell = p.cell AND q.root <> p.root AND ABS(q.d - p.d) <= {most} AND BIT_COUNT(q.fp ^ p.fp) <= {most} AND (p.root = p.main OR q.fp < p.fp)")
    return minor.alias("q").join(around.alias("p"), near).select(F.least("q.root", "p.root").alias("a"), F.greatest("q.root", "p.root").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs.

    Documents link where their fingerprints differ in at most `most` bits; texts without words (null, empty) have
    fingerprint 0 and link like any other.  component_id is the smallest doc_id reachable; null only where all of a
    component's ids are null.  Documents with one fingerprint are one node, so copies are never paired.  Whole texts of
    any length count; rows that repeat stay; an empty table gives no rows; other columns are not looked at.
    """
    return grouped(fingerprints(docs, shingle), most)


def grouped(found: DataFrame, most: int = 4) -> DataFrame:
    """near_duplicates of rows doc_id, fp."""
    own = checkpoint(found)
    by_fp = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = linked(by_fp.select("fp"), most).withColumnRenamed("node", "fp")
    rooted = checkpoint(by_fp.join(roots, "fp", "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = checkpoint(join_counted(rooted, least, ["root"], "members").select("fp", "copies", "component_id"))
    return join_counted(own, named, ["fp"], "copies").select("doc_id", "fp", "component_id")


def fingerprint_links(texts: DataFrame, shingle: int, words: int = 4, most: int = 4) -> DataFrame:
    """a, b: links between the shingle sets of texts (_text), by their names, that reach what near_duplicates of the texts reach."""
    near = grouped(named_fingerprints(texts, shingle, words), most)
    return scratch(near.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the row with the smallest doc_id stays.

    Documents link as in near_duplicates, by fingerprints within 4 bits over the pivot distance tables.  As a pair at
    similarity 0.8 is seldom that near, those that are not in one component yet link by similarity as well (keep_one).
    """
    return keep_one(docs, given=fingerprint_links)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents by words in fours and four bits, the fingerprint in hex."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
