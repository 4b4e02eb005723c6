"""The corpus pipeline: what each stage keeps is right for its own input, and the whole against a plain version."""

import hashlib
import random

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_kernels import plain_simhash
from test_operators import TEXTS, ordered, plain_lines
from test_similar import mutated, shingles

from obsward.llm import bpe, mixing, quality, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def similar_kept(rows):
    """Ids of the rows of which one of each similar group stays: the smallest id, nulls last."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) / len(x | y) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    groups = {}
    for (i, _), k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append((i is None, i or 0))
    return sorted(min(g) for g in groups.values())


def stages(spark, docs, folder, sf):
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{folder}/{k}")
        tables.append(spark.read.parquet(f"{folder}/{k}"))
        if k < 4:
            assert tables[-1].columns == docs.columns
    return tables


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))


def check(spark, tables, labels):
    docs, good, lines, single, mixture, tokens = tables
    judged = quality.judged(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).where(quality.KEPT).select("_row.doc_id", "_row.text")
    assert by_id(pairs(good)) == by_id(pairs(judged))
    assert by_id(pairs(lines)) == by_id(plain_lines(ordered(spark, pairs(good)), 5))
    assert sorted((i is None, i or 0) for i, _ in pairs(single)) == similar_kept(pairs(lines)) and set(pairs(single)) <= set(pairs(lines))
    assert by_id(pairs(mixture)) == by_id(pairs(mixing.sample(single)))
    library = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=bpe.codec(bpe.vocabulary()).ranks, special_tokens={})
    expected = [(i, library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in pairs(mixture)]
    got = [(r.doc_id, [int.from_bytes(r.token_ids[k : k + 4], "little") for k in range(0, len(r.token_ids), 4)], r.decoded_sha256, r.intact) for r in tokens.collect()]
    assert by_id(got) == by_id(expected)


def test_stages(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    tables = stages(spark, docs, tmp_path, SF)
    judged = tables[1].join(labels, "doc_id")
    assert judged.where("quality = 0").count() == 0 < judged.count()
    check(spark, tables, labels)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in tables[-1].collect()}


@pytest.mark.parametrize("n", [len(TEXTS), 0])
def test_awkward_and_empty_tables(spark, tmp_path, n):
    """Nulls in every column, empty and long texts, ties, repeated rows; and no rows, no labels."""
    rows = [(k if k % 6 else None, t, ["en", None, "de"][k % 3], None if k % 5 == 0 else f"src{k % 3}", None) for k, t in enumerate(TEXTS[:n])]
    spark.createDataFrame(rows + rows[3:9], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, int(k % 4 > 0), None if k == 7 else 0) for k in range(n)] + [(None, 1, 0)] * (n > 0)
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    tables = stages(spark, docs, f"{tmp_path}/out", str(tmp_path))
    check(spark, tables, labels)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == tables[-1].count() and (n > 0 or tables[-1].count() == 0)


def test_near_copies_are_grouped_by_fingerprints_and_by_similarity(spark, monkeypatch):
    """Pairs that only the fingerprints link, only the similarity, or both, and chains of these, against brute force."""
    r = random.Random(4)
    texts = [None, "", "one", "One"]
    for k in range(4):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(mutated(base, n, r)) for n in (0, *(1 + x % (8 + 4 * k) for x in range(14)))]
    r.shuffle(texts)
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    sets, fps = [shingles(t) for t in texts], [plain_simhash((t or "").encode(), 4) for t in texts]
    root, by_fp, by_set = list(range(len(rows))), 0, 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            near, alike = (fps[i] ^ fps[j]).bit_count() <= 4, x == y or len(x & y) / len(x | y) >= 0.8
            by_fp += near and not alike
            by_set += alike and not near
            if near or alike:
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    groups = {}
    for (i, _), k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append((i is None, i or 0))
    assert by_fp and by_set
    used, linked = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda fps, most: used.append(fps.count()) or linked(fps, most))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted((i is None, i or 0) for i, _ in pairs(kept)) == sorted(min(g) for g in groups.values())
    assert used == [len(set(fps))]
