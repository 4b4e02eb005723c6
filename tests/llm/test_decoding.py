"""The last stage of the pipeline decodes what it encodes."""

import hashlib

import corpus_pipeline
import pyarrow as pa
import pytest

from obsward.llm.common import small_parts


def test_pipeline_decodes_its_ids(spark):
    texts = ["one two", "", None, "é漢字 🙂\n"]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {x.doc_id: (x.decoded_sha256, x.intact) for x in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: (hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in enumerate(texts)}


def test_encoding_and_decoding_share_a_worker(spark):
    """Two Python steps in a row would hold two workers with a codec and a batch each for every task."""
    docs = spark.createDataFrame([(1, "one two", "s", "en")], "doc_id long, text string, source string, lang string")
    plan = corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_string()])
def test_small_parts_hold_every_row_once_and_few_bytes(kind):
    texts = [None, "", "a" * 1000, *["é" * (k % 300) for k in range(3000)], "b" * 50_000, None, "c"]
    whole = [pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.string()).cast(kind)], ["id", "text"]) for x in (texts, [], texts[5:900])]
    parts = list(small_parts(iter(whole), "text", 10_000))
    assert pa.Table.from_batches(parts, whole[0].schema).to_pydict() == pa.Table.from_batches(whole).to_pydict()
    sizes = [[len((x if isinstance(x, bytes) else x.encode()) if x else b"") for x in p.column("text").to_pylist()] for p in parts]
    assert all(0 < len(x) <= 157 and (sum(x) <= 10_000 or len(x) == 1) for x in sizes)
