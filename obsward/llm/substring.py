"""Substring dedup over words: windows counted in super-k-mer buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from obsward.llm.common import map_batches, read, utf8
from obsward.llm.repeats import WordSequences, covered, with_spans

#: Words of the grams whose least is a window's minimiser, against windows of 35.
GRAM = 10


def count_windows(strings: list[bytes], weights: list[int], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sort the windows of the strings: those that stand twice or more, weights counted, and the first place of each."""
    windows: list[tuple[bytes, int, int]] = []
    out = []
    for k, s in enumerate(strings):
        ends = [*np.flatnonzero(np.frombuffer(s, dtype=np.uint8) == 0x20).tolist(), len(s)]
        begins = [0, *(e + 1 for e in ends[:-1])]
        n = len(ends) - window + 1
        out.append((np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)))
        windows += [(s[begins[i] : ends[i + window - 1]], k, i) for i in range(n)]
    windows.sort()
    a = 0
    while a < len(windows):
        same, k, i = windows[a]
        b = a + 1
        while b < len(windows) and windows[b][0] == same:
            b += 1
        out[k][1][i] = True
        if b - a > 1 or weights[k] > 1:
            for _, k, i in windows[a:b]:
                out[k][0][i] = True
        a = b
    return out


def remove_repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank) of every row of docs.

    A word goes if a window of so many consecutive words that covers it also starts anywhere else, in the same document
    too; all copies go.  Windows are judged on the input.  A null text has no words; texts shorter than a window keep
    theirs.  Rows that repeat, null ids too, count as documents of their own.  Texts of any length are worked on whole; an
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, spans, whole in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            words = text.split()
            gone = covered(spans, whole, len(words), window)
            if gone is not None:
                rest = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(with_spans(docs, WordSequences, window, GRAM, count_windows), each, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeated_windows of documents at 35 words, with the hash of what stays."""
    return remove_repeated_windows(read(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


#: Windows counted by their text.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + 34), ' '))) AS n FROM l),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM c WHERE n > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
a AS (SELECT u.doc_id, count(g.k) AS n_removed, string_agg(CASE WHEN g.k IS NULL THEN word END, ' ' ORDER BY u.k) AS kept
  FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id),
r AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, '') AS kept FROM d LEFT JOIN a ON d.doc_id = a.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM r
"""
