"""Nearest neighbours by cosine: robust-pruned directed graphs over shards, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from obsward.llm.common import checkpoint, read, scratch

#: Vectors of a shard, edges of a node, nodes of a query's beam (two thirds of it while building), how much nearer an edge's end must be to make another needless.
SHARD, DEGREE, BEAM, RELAXED = 32_768, 32, 96, 1.2
#: Cells that vectors are dealt over by their nearest centre, at most.
CELLS = 4096
#: A query goes to so many cells that those hold this share of the nearest of PROBED vectors drawn from the table, compared with all.
COVERED, PROBED = 0.98, 256
#: Vectors that the centres of the cells are fitted on for each cell, and rounds of that fit.
FITTED_ON, ROUNDS = 16, 6
#: Queries searched together, nodes inserted together, queries sent to a shard at once.
TOGETHER, INSERTED, BLOCK = 128, 512, 20_000


def _list_of(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


def _matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of very small or large numbers would leave the range
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query: the beam's nodes and similarities, nearest first (-1 where fewer were met), and the nodes expanded
    (padded with -1); and how many similarities were computed.

    All queries step together: each expands its nearest node not yet expanded, until its whole beam is.
    edges: neighbours of each node, padded with -1.
    """
    q, n = len(queries), len(points)
    nodes = np.full((q, beam), -1)
    near = np.full((q, beam), -np.inf, dtype=np.float32)
    nodes[:, 0], near[:, 0] = entry, queries @ points[entry]
    done = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, [entry, n]] = True  # n stands for no node
    path, met = [], q
    while True:
        open_ = np.where((nodes >= 0) & ~done, near, -np.inf)
        best = open_.argmax(axis=1)
        on = np.flatnonzero(open_[np.arange(q), best] > -np.inf)
        if not len(on):
            return nodes, near, np.stack(path, axis=1), met
        at = nodes[on, best[on]]
        done[on, best[on]] = True
        path.append(np.full(q, -1))
        path[-1][on] = at
        next_ = edges[at]
        next_ = np.where(next_ < 0, n, next_)
        fresh = ~seen[on[:, None], next_]
        seen[on[:, None], next_] = True
        met += int(fresh.sum())
        found = np.einsum("qrd,qd->qr", points[np.minimum(next_, n - 1)], queries[on])
        found[~fresh] = -np.inf
        all_near = np.concatenate([near[on], found], axis=1)
        all_nodes = np.concatenate([nodes[on], np.where(fresh, next_, -1)], axis=1)
        all_done = np.concatenate([done[on], np.zeros(found.shape, dtype=bool)], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[on], nodes[on], done[on] = (np.take_along_axis(x, order, axis=1) for x in (all_near, all_nodes, all_done))


def _prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Diverse edges of many nodes, padded with -1: the nearest candidate is kept and those that it is `relaxed` times
    nearer to than the node go, until none is left.  candidates: a row for each node, padded with -1."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == nodes[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    vectors = points[np.maximum(candidates, 0)]
    own = 2 - 2 * np.einsum("ncd,nd->nc", vectors, points[nodes])
    own[bad] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = (np.take_along_axis(x, order, axis=1) for x in (candidates, own))
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    between = relaxed * relaxed * (2 - 2 * (vectors @ vectors.transpose(0, 2, 1)))
    alive = np.isfinite(own)
    kept = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for d in range(degree):
        first = alive.argmax(axis=1)
        on = alive[rows, first]
        if not on.any():
            break
        kept[on, d] = candidates[on, first[on]]
        alive &= between[rows, first] > own
        alive[rows, first] = False
    return kept


def _add_back(points: np.ndarray, edges: np.ndarray, sources: np.ndarray, targets: np.ndarray, degree: int, relaxed: float) -> None:
    """Edges from targets to sources, pruned where a node has too many."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    cut = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
    nodes, size = targets[cut], np.diff(np.append(cut, len(targets)))
    place = np.arange(len(targets)) - np.repeat(cut, size)
    for few in np.array_split(np.argsort(size, kind="stable"), max(1, len(nodes) // INSERTED)):  # rows of like length
        more = np.full((len(few), int(size[few].max()) if len(few) else 0), -1)
        row = np.full(len(nodes), -1)
        row[few] = np.arange(len(few))
        of = np.repeat(row, size)
        more[of[of >= 0], place[of >= 0]] = sources[of >= 0]
        both = np.concatenate([edges[nodes[few]], more], axis=1)
        both = -np.sort(-both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = -np.sort(-both, axis=1)
        full = (both >= 0).sum(axis=1) > degree
        out = both[:, :degree]
        if full.any():
            out[full] = _prune(points, nodes[few][full], both[full], degree, relaxed)
        edges[nodes[few], : out.shape[1]] = out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM * 2 // 3, relaxed: float = RELAXED) -> tuple[np.ndarray, int]:
    """Edges (n by degree, padded with -1) and entry node over unit vectors.

    Nodes are inserted in batches that double: greedy searches from the entry over the graph so far propose
    neighbours, pruning keeps diverse ones, and the edges back are added and pruned alike.  A second round over all
    nodes lets early ones see late ones.
    """
    n = len(points)
    edges = np.full((n, degree), -1)
    entry = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != entry]
    for round_ in range(2):
        a = 0
        while a < len(order):
            b = min(len(order), a + (INSERTED if round_ else max(1, min(a, INSERTED))))
            batch = order[a:b]
            nodes, _, path, _ = beam_search(points, edges, entry, points[batch], beam)
            kept = _prune(points, batch, np.concatenate([nodes, path, edges[batch]], axis=1), degree, relaxed)
            edges[batch] = kept
            some = kept >= 0
            _add_back(points, edges, np.repeat(batch, some.sum(axis=1)), kept[some], degree, relaxed)
            a = b
    return edges, entry


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), dim, e1, e2 of the vectors that take part: not null, zero or holding null or non-finite components."""
    wide = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = wide.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where("FORALL(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND ABS(x) < DOUBLE('Infinity')) AND EXISTS(embedding, x -> x <> 0)")
    return fit.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("e1"), F.xxhash64(F.lit(1), "embedding").alias("e2"))


@dataclass
class Index:
    """shards: dim, cell, part, node, entry, embedding, members, edges; parts: dim, cell, parts (shards of the cell);
    centres: unit vectors of the cells of the dimensions that have several; probes: to how many of them a query goes."""

    shards: DataFrame
    parts: DataFrame
    centres: dict[int, np.ndarray]
    probes: dict[int, int]


def _fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of so many cells by a few rounds of spherical k-means."""
    centres = sample[np.random.default_rng(cells).permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        some = np.abs(total).max(axis=1) > 0
        centres[some] = _unit(total[some])
    return centres


def _probes(celled: DataFrame, centres: np.ndarray, k: int) -> int:
    """Cells that a query must go to.  celled: embedding, cell, e2 of all vectors of the dimension.

    PROBED of them, drawn by hash, are compared with all others in one pass; each task passes on its k nearest of each.
    """
    drawn = _unit(_matrix(celled.orderBy("e2").limit(PROBED).select("embedding").toArrow().column("embedding")))
    asked = celled.sparkSession.sparkContext.broadcast(drawn)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked.value), k + 1), -np.inf, dtype=np.float32)
        cell = np.zeros(best.shape, dtype=np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                near = asked.value @ _unit(_matrix(pa.chunked_array([part.column("embedding")]))).T
                both = np.concatenate([best, near], axis=1)
                cells = np.concatenate([cell, np.broadcast_to(part.column("cell").to_numpy(), near.shape)], axis=1)
                order = np.argpartition(-both, k, axis=1)[:, : k + 1]
                best, cell = np.take_along_axis(both, order, axis=1), np.take_along_axis(cells, order, axis=1)
        of = np.repeat(np.arange(len(best), dtype=np.int32), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(best.ravel()), pa.array(cell.ravel())], ["drawn", "near", "cell"])

    first = Window.partitionBy("drawn").orderBy(F.desc("near"))
    found = celled.select("embedding", "cell").mapInArrow(nearest, "drawn int, near float, cell int").where("near > -2")
    rows = found.withColumn("n", F.row_number().over(first)).where((F.col("n") > 1) & (F.col("n") <= k + 1)).collect()  # the first is itself
    place = np.argsort(np.argsort(-(drawn @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort([place[r.drawn, r.cell] for r in rows])
    return int(places[min(len(places) - 1, int(np.ceil(COVERED * len(places))))]) + 1 if len(places) else 1


def _to_cells(rows: DataFrame, centres: Broadcast, most: dict[int, int]) -> DataFrame:
    """rows (dim, embedding and others) with cells: as many cells with the nearest centres as `most` says for the dimension (one without), nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells: list[list[int]] = [[0]] * batch.num_rows
            for dim in set(dims.tolist()) & set(centres.value):
                on = np.flatnonzero(dims == dim)
                for k in range(0, len(on), 4096):
                    some = on[k : k + 4096]
                    near = _unit(_matrix(pa.chunked_array([batch.column("embedding").take(pa.array(some))]))) @ centres.value[dim].T
                    for i, x in zip(some.tolist(), np.argsort(-near, axis=1, kind="stable")[:, : most.get(dim, 1)].tolist(), strict=True):
                        cells[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))


def build_index(vectors: DataFrame, members: int, shard: int = SHARD) -> Index:
    """Every different vector (as usable() gives them), with its smallest `members` different ids, in graphs of about `shard` nodes.

    Equal vectors are one node; no result of less than `members` rows can need more ids of it, or more rows of an id.
    Where a dimension has more vectors than a shard takes, they are dealt over cells by their nearest centre (at most
    CELLS in all; the centres are fitted on FITTED_ON vectors for each cell, drawn by hash), and a cell that has more than
    a shard takes is split into parts by hash.  How many cells a query must go to is measured.  An empty table gives an empty
    index.
    """
    again = Window.partitionBy("e1", "e2", "vec_id").orderBy("vec_id")
    same = Window.partitionBy("e1", "e2").orderBy("vec_id")
    once = vectors.withColumn("number", F.row_number().over(again)).where(F.col("number") <= members)
    some = once.withColumn("number", F.dense_rank().over(same)).where(F.col("number") <= members)
    nodes = checkpoint(some.groupBy("e1", "e2", "dim").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    large = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard).orderBy(F.desc("n")).limit(CELLS // 2).collect()}
    centres = {}
    for dim, n in large.items():
        cells = min(-(-n // shard), max(2, CELLS * n // sum(large.values())))
        sample = nodes.where(F.col("dim") == dim).orderBy("e1", "e2").limit(FITTED_ON * cells).select("embedding").toArrow()
        centres[dim] = _fit_centres(_unit(_matrix(sample.column("embedding"))), cells)
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    celled = checkpoint(_to_cells(nodes, shared, {}).withColumn("cell", F.element_at("cells", 1)).drop("cells"))
    probes = {dim: _probes(celled.where(F.col("dim") == dim), own, members - 1) for dim, own in centres.items()}
    parts = checkpoint(celled.groupBy("dim", "cell").agg(F.expr(f"CAST(CEIL(COUNT(*) / {shard}) AS INT)").alias("parts")))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("e1", "ascending"), ("e2", "ascending")])
        edges, entry = build_graph(_unit(_matrix(group.column("embedding"))))
        n = group.num_rows
        return pa.table({
            "dim": group.column("dim"), "cell": group.column("cell"), "part": group.column("part"), "node": pa.array(np.arange(n), pa.int32()), "entry": pa.array(np.full(n, entry), pa.int32()),
            "embedding": group.column("embedding").cast(_list_of(pa.float64())), "members": group.column("members").cast(_list_of(pa.int64())), "edges": pa.array(edges.tolist(), _list_of(pa.int32())),
        })

    # a row for each cell, of which there are no more than CELLS besides one for each small dimension
    placed = celled.join(parts, ["dim", "cell"]).withColumn("part", F.expr("CAST(pmod(e1, parts) AS INT)"))
    shards = placed.groupBy("dim", "cell", "part").applyInArrow(build, "dim int, cell int, part int, node int, entry int, embedding array<double>, members array<bigint>, edges array<int>")
    return Index(scratch(shards), parts, centres, probes)


def _cosines(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision, summed from left to right."""
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    return total(points * queries) / (np.sqrt(total(points * points)) * np.sqrt(total(queries * queries)))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row of queries (as usable() gives them).

    Different query vectors go to the cells with the nearest centres, as many as the index found to be needed, to all
    shards of each, in blocks; a shard's
    graph is searched with a beam and answers with the k + 1 best, by exact cosines.  Ties: the smaller vec_id first.
    A query is no candidate of its own: rows with its id aren't.  Queries whose dimension the index lacks find nothing.
    """
    asked = queries.groupBy("e1", "e2", "dim").agg(F.first("embedding").alias("embedding"))
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    sent = scratch(_to_cells(asked, shared, index.probes).select("dim", F.explode("cells").alias("cell"), "e1", "e2", F.col("embedding").alias("query")))
    loads = sent.groupBy("dim", "cell").agg(F.expr(f"CAST(CEIL(COUNT(*) / {BLOCK}) AS INT)").alias("blocks"))
    load = scratch(index.parts.join(loads, ["dim", "cell"]))
    sent = sent.join(load.toDF("dim", "cell", "parts", "blocks"), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.withColumn("block", F.expr("CAST(pmod(e2, blocks) AS INT)"))
    turns = load.select("dim", "cell", (F.col("blocks") - 1).alias("last"))
    held = index.shards.join(turns, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
    names = ["e1", "e2", "score", "members"]

    def look(points: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if points.num_rows and asked.num_rows:
            points = points.sort_by("node")
            exact, wanted = _matrix(points.column("embedding")), _matrix(asked.column("query"))
            unit, ask = _unit(exact), _unit(wanted)
            edges = _matrix(points.column("edges"), np.int64)
            members = points.column("members").combine_chunks()
            for a in range(0, len(ask), TOGETHER):
                nodes, *_ = beam_search(unit, edges, points.column("entry")[0].as_py(), ask[a : a + TOGETHER], BEAM)
                of, place = np.nonzero(nodes >= 0)
                node = nodes[of, place]
                score = _cosines(exact[node], wanted[a + of])
                least = np.array([m[0].as_py() for m in members])[node]
                order = np.lexsort((least, -score, of))
                first = np.searchsorted(of[order], of[order])
                keep = order[np.arange(len(order)) - first <= k]
                rows = asked.slice(a, TOGETHER).take(pa.array(of[keep]))
                found.append(pa.table({"e1": rows.column("e1"), "e2": rows.column("e2"), "score": pa.array(score[keep]), "members": members.take(pa.array(node[keep]))}))
        empty = pa.table({"e1": pa.array([], pa.int64()), "e2": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "members": pa.array([], _list_of(pa.int64()))})
        return pa.concat_tables([t.cast(empty.schema) for t in found]).select(names) if found else empty

    keys = ["dim", "cell", "part", "block"]
    got = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(look, "e1 bigint, e2 bigint, score double, members array<bigint>")
    best = Window.partitionBy("e1", "e2").orderBy(F.desc("score"), F.element_at("members", 1))
    near = got.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("e1", "e2", "score", F.explode("members").alias("vec_id"))
    own = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    rows = queries.select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("copy"), "e1", "e2").join(near, ["e1", "e2"]).where("vec_id <> query_id")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_graph_search(spark: SparkSession, sf_dir: str, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every vector of embeddings whose vec_id is divisible by `every`, found in the index of all."""
    vectors = usable(read(spark, sf_dir, "embeddings"))
    return search(build_index(vectors, k + 1), vectors.where(F.col("vec_id") % every == 0), k)


#: The same by brute force; sums run from left to right as above.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.e, q.e) / (c.norm * q.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
