"""The graph search where many rows have one id, and where a query goes to some of many shards."""

import numpy as np

from obsward.llm import ann


def test_equal_vectors_under_repeated_ids(spark):
    vector = [1.0, 2.0, 3.0]
    rows = [(0, vector)] * 7 + [(i, vector) for i in (3, 4, 5)] + [(10 + i, [float(i), 1.0, -1.0]) for i in range(4)]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(ann.build_index(vectors, 6), vectors.where("vec_id = 0").limit(1), 5).orderBy("rank").collect()
    assert [x.vec_id for x in got][:3] == [3, 4, 5] and len(got) == 5


def test_recall_over_routed_shards(spark):
    """Vectors around many centres, in cells of which a query sees a part, one too large for a shard; against brute force."""
    r = np.random.default_rng(12)
    centres = r.normal(size=(60, 16))
    own = r.integers(0, 60, 4000)
    own[:900] = 0
    points = centres[own] + 0.25 * r.normal(size=(4000, 16))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    index = ann.build_index(vectors, 6, shard=400)
    cells = len(index.centres[16])
    assert cells == 10 and 1 <= index.probes[16] < cells
    assert {(x.cell, x.parts) for x in index.parts.collect()} and index.parts.where("parts > 1").count() >= 1
    assert index.shards.count() == 4000
    found = {}
    for x in ann.search(index, vectors.where("vec_id % 20 = 0"), 5).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = [len(found[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) / 5 for q in range(0, 4000, 20)]
    assert np.mean(hits) >= 0.95
