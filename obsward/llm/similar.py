"""Near-duplicates by the Jaccard similarity of word shingles: candidates from minhash bands, each verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsward.llm.common import portions, scratch, small_parts, utf8
from obsward.llm.components import components
from obsward.llm.hashing import shingle_sets, simhash_many
from obsward.llm.superkmer import U, key_table, looked_up, mixed

#: Words of a shingle and the similarity from which on documents are near-duplicates.
SHINGLE, LEAST = 5, 0.8
#: Minima that a band joins, and bands.  A pair at similarity s is no candidate with probability (1 - s^5)^30: 7 in a million at 0.8, 3e-12 at 0.9.
ROWS, BANDS = 5, 30
#: Rounds in which a document is compared with one other only, before all pairs that are still open are.
STARS = 2
#: Texts turned to bytes at once.
TEXTS_AT_ONCE = 256
#: Candidate pairs made at once.
PAIRS_AT_ONCE = 1 << 16
_DRAWN = Random(5)
_XOR = np.array([_DRAWN.getrandbits(64) for _ in range(ROWS * BANDS)], dtype=U)
_TIMES = np.array([_DRAWN.getrandbits(64) | 1 for _ in range(ROWS * BANDS)], dtype=U)


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 of the empty one."""
    with np.errstate(over="ignore"):
        sums = np.append(U(0), np.cumsum(mixed(hashes), dtype=U))
        return mixed(sums[first[1:]] - sums[first[:-1]])


def _bands(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys of each set (none is empty): equal for two sets where ROWS minima are."""
    keys = np.empty((len(first) - 1, BANDS), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(BANDS):
            key = np.full(len(first) - 1, k, dtype=U)
            for j in range(k * ROWS, (k + 1) * ROWS):
                key = mixed(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ _XOR[j]) * _TIMES[j], first[:-1]))
            keys[:, k] = key
    return keys


def _least_sizes(least: float) -> int:
    """Sets of fewer shingles are as similar as that only when they are equal."""
    n = 1
    while n / (n + 1) < least:
        n += 1
    return n


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The texts of the batch, some at a time and in its order."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        texts = utf8(batch.column("_text").slice(at, TEXTS_AT_ONCE))
        for a, b in portions(texts, 1 << 19):
            yield texts[a:b]


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for texts in _texts(batch):
        yield shingle_sets(texts, shingle)


def named_fingerprints(texts: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, fp: the name of each shingle set of texts (_text) and the fingerprints, by so many words, of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _texts(batch):
                names = _nodes(*shingle_sets(some, shingle))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (names, simhash_many(some, words))], ["doc_id", "fp"])

    return texts.select("_text").mapInArrow(run, "doc_id bigint, fp bigint").distinct()


def _sketches(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, size, bands, least (smallest _id) of each different shingle set of texts (_id, _text)."""
    small = _least_sizes(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, first in _sets(batch, shingle):
                size = np.diff(first)
                on = size >= small
                keys = np.empty((0, BANDS), dtype=U)
                if on.any():
                    keys = _bands(hashes[np.repeat(on, size)], np.append(0, np.cumsum(size[on])))
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(on * BANDS)), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, first).view(np.int64)), batch.column("_id").slice(at, len(size)), pa.array(size, pa.int32()), bands], ["node", "_id", "size", "bands"])
                at += len(size)

    each = texts.select("_id", "_text").mapInArrow(run, "node bigint, _id bigint, size int, bands array<bigint>")
    return scratch(each.groupBy("node").agg(F.min("_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")))


def _shingles(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (packed hashes) of the sets in nodes (column node, distinct) and, where bits are shared, some others."""
    wanted = key_table(nodes.select(F.col("node").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, first in _sets(batch, shingle):
                names = _nodes(hashes, first)
                _, once = np.unique(names, return_index=True)
                on = once[looked_up(wanted.value, names[once])]
                if len(on):
                    packed = [hashes[first[i] : first[i + 1]].tobytes() for i in on.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(names[on].view(np.int64)), pa.array(packed, pa.binary())], ["node", "shingles"])

    found = texts.select("_text").mapInArrow(run, "node bigint, shingles binary")
    return scratch(found.groupBy("node").agg(F.first("shingles").alias("shingles")))


def _verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sets are at least that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                on.append(shared / (len(both) - shared) >= least)
            yield batch.filter(pa.array(on, pa.bool_())).select(["a", "b"])

    sets = lambda end, name: shingles.select(F.col("node").alias(end), F.col("shingles").alias(name))
    return pairs.join(sets("a", "x"), "a").join(sets("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_pairs(live: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of a key's nodes with different roots whose sizes do not rule the similarity out.  live: key, node, size, root."""

    def pairs(node: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(size, kind="stable")
        node, size, root = node[order], size[order], root[order]
        end = np.searchsorted(size, size / least * (1 + 1e-9), side="right")
        for i in range(len(node)):
            for a in range(i + 1, int(end[i]), PAIRS_AT_ONCE):
                b = min(int(end[i]), a + PAIRS_AT_ONCE)
                other = node[a:b][root[a:b] != root[i]]
                if len(other):
                    yield np.minimum(other, node[i]), np.maximum(other, node[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        made = 0

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
            out.clear()
            return batch

        def bucket(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            _, node, size, root = np.concatenate(rows, axis=1)
            for pair in pairs(node, size, root):
                out.append(pair)
                made += len(pair[0])
                if made >= PAIRS_AT_ONCE:
                    made = 0
                    yield flushed()

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "size", "root")])
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            for part in np.split(rows, cuts, axis=1):
                if held and part.shape[1] and part[0, 0] != held[0][0, 0]:
                    yield from bucket(held)
                    held = []
                if part.shape[1]:
                    held.append(part)
        if held:
            yield from bucket(held)
        if out:
            yield flushed()

    return live.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def similar_groups(texts: DataFrame, shingle: int, least: float, given: DataFrame | None = None) -> DataFrame:
    """node, least, root of each different shingle set of texts (_id, _text): root is the smallest node that links of at least that similarity, and the given ones (a, b: nodes), reach.

    Sets that share a band's key lie in one bucket.  In the first rounds a set is compared with one other, drawn as its
    bucket's centre, so that a large group of near copies is joined by few comparisons; then all pairs of a bucket that
    are not in one component yet and were not compared before are, so that no link between candidates is missed.
    """
    own = _sketches(texts, shingle, least)
    keyed = own.select("node", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = scratch(keyed.join(shared, "key").select("key", "node", "size"))
    none = own.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    links = none if given is None else given
    roots = own.select("node", F.col("node").alias("root")).where("false") if given is None else scratch(components(given))
    if not buckets.isEmpty():
        shingles, tested = None, none
        for turn in range(STARS + 1):
            rooted = buckets.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
            several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("draw"), "node", "size", "root")).alias("centre")).where("x <> y").select("key", "centre")
            live = scratch(rooted.join(several, "key").select("key", "node", "size", "root", "centre"))
            if live.isEmpty():
                break
            if shingles is None:  # what is live later is live now
                shingles = _shingles(texts, live.select("node").distinct(), shingle)
            if turn < STARS:
                star = live.where(F.col("root") != F.col("centre.root")).where(F.least("size", "centre.size") >= F.greatest("size", "centre.size") * (least - 1e-9)).select("node", *_ordered(F.col("node"), F.col("centre.node")))
                one = star.join(tested, ["a", "b"], "left_anti").groupBy("node").agg(F.min(F.struct(F.xxhash64("a", "b"), "a", "b")).alias("p"))
                pairs = scratch(one.select("p.a", "p.b").distinct())
            else:
                pairs = scratch(_open_pairs(live.select("key", "node", "size", "root"), least).join(tested, ["a", "b"], "left_anti"))
            tested = tested.unionByName(pairs)
            links = links.unionByName(scratch(_verified(pairs, shingles, least)))
            roots = scratch(components(links).select("node", "root"))
    return own.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, given: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the row with the smallest doc_id stays.

    Documents link where the Jaccard similarity of their sets of lower-cased word shingles is at least `least`; a text
    of fewer words is one shingle, and texts without words (null, empty) are copies of each other.  Rows that tie in
    shingles and id (repeated rows, null ids) count as copies, of which one stays.  given: makes further links (a, b: names
    of shingle sets) from the texts (_id, _text) and the words of a shingle.
    """
    wide = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_parts(batches, "_text"):
            names = _nodes(*shingle_sets(utf8(part.column("_text")), shingle))
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_id"), pa.array(names.view(np.int64))], ["_row", "_id", "_node"])

    texts = wide.select("_id", "_text")
    groups = similar_groups(texts, shingle, least, None if given is None else given(texts, shingle))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("best")).select(F.col("best.node").alias("_node"), F.col("best.least").alias("_least"))
    rows = wide.mapInArrow(named, wide.select("_row", "_id").schema.add("_node", "long")).join(kept, "_node").where(F.col("_id").eqNullSafe(F.col("_least")))
    first = Window.partitionBy("_node").orderBy("_id")
    return rows.withColumn("_number", F.row_number().over(first)).where("_number = 1").select("_row.*")
