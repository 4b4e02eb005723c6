"""The registered queries on the smallest tables: against their SQL, or against brute force where they have none."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_kernels import plain_simhash
from test_operators import grouped, plain_feature, plain_repeats

from obsward.llm import bpe, media, quality, registry
from obsward.llm.common import remove_scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return db


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = tables.sql(registry.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and sorted(got, key=str) == sorted(expected.select(*columns).fetchall(), key=str)


def test_op1(spark, texts):
    fps = [plain_simhash(t, 4) for _, t in texts]
    root = grouped(fps, 4)
    least = {k: min(i for (i, _), x in zip(texts, root, strict=True) if x == k) for k in set(root)}
    expected = [(i, f"{f:016x}", least[k]) for (i, _), f, k in zip(texts, fps, root, strict=True)]
    assert Counter(tuple(r) for r in rows(spark, "op1_simhash")) == Counter(expected)


def test_op2(spark, texts):
    expected = []
    for (i, t), gone in zip(texts, plain_repeats([t for _, t in texts], 200), strict=True):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    assert Counter(tuple(r) for r in rows(spark, "op2_suffix_dedup")) == Counter(expected)


def test_op3(spark, texts):
    got = rows(spark, "op3_byte_shards")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in texts)
    total, before = sum(len(t) + 8 for _, t in texts), 0
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(i for i, _ in texts) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    for r in order:
        assert r.shard == min(23, (2 * before + r.size) * 24 // (2 * total))
        before += r.size
    assert all([r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in got))) for s in range(24))


def test_op6(spark, texts):
    got = rows(spark, "op6_chunked_media")
    expected = Counter()
    for i, t in texts:
        p = media.padded(t)
        expected[i, len(t), len(p), sha(p), zlib.crc32(p[-64:]), plain_feature(p)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature.split(":", 1)[1]) for r in got) == expected
    forms = {r.payload_sha256 + str(r.n_bytes): (r.media_bytes, r.media_sha256, r.feature) for r in got}
    assert all(forms[r.payload_sha256 + str(r.n_bytes)] == (r.media_bytes, r.media_sha256, r.feature) for r in got)


def test_op7(spark, texts):
    ranks = bpe.codec(bpe.vocabulary()).ranks
    library = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    ids = [(i, t, library.encode_ordinary(t.decode())) for i, t in texts]
    expected = Counter((i, len(x), sha(np.array(x, dtype="<u4").tobytes()), sha(t)) for i, t, x in ids)
    assert Counter(tuple(r) for r in rows(spark, "op7_byte_bpe")) == expected


def test_op10(spark, texts):
    """Rows as the operator judges them (whose plain version is in test_operators), and no good labelled document lost."""
    got = rows(spark, "op10_quality")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judged(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).select("_row.doc_id", "p_quality", "p_toxic").collect()
    assert sorted((r.doc_id, round(r.p_quality, 4), round(r.p_toxic, 4)) for r in got) == sorted((r.doc_id, round(r.p_quality, 4), round(r.p_toxic, 4)) for r in judged)
    assert {r.doc_id for r in got} == {i for i, _ in texts} and all(r.keep == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in got)


def test_scratch_tables_are_removed(spark):
    assert rows(spark, "op6_chunked_media") and remove_scratch(spark) > 0 and remove_scratch(spark) == 0
