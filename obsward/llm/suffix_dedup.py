"""Removal of repeated byte strings, judged by suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from obsward.llm.common import map_batches, read, utf8
from obsward.llm.gsaca import suffix_array
from obsward.llm.repeats import Bytes, covered, with_spans
from obsward.llm.superkmer import runs

#: Bytes of the grams whose least is a window's minimiser, against windows of 200.
GRAM = 50
_COMPARED_AT_ONCE = 1 << 15


def _in_suffix_order(strings: list[bytes], weights: list[int], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each string: windows that stand twice or more, weights counted, and the places that come first in suffix order
    among those of their window."""
    parts = [np.append(np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 2, 1) for s in strings]
    symbols = np.concatenate([*parts, [0]])
    valid = np.concatenate([*(np.arange(len(p)) < len(p) - window for p in parts), [False]])
    weight = np.repeat(weights, [len(p) for p in parts])
    order = np.array(suffix_array(symbols))
    order = order[valid[order]]
    first = np.ones(len(order), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int16), window)
    for k in range(1, len(order), _COMPARED_AT_ONCE):
        x, y = order[k - 1 : k - 1 + _COMPARED_AT_ONCE], order[k : k + _COMPARED_AT_ONCE]
        first[k : k + _COMPARED_AT_ONCE] = (views[x[: len(y)]] != views[y]).any(axis=1)
    group = np.cumsum(first) - 1
    flags, picked = np.zeros(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
    flags[order] = (np.bincount(group, weight[order]) > 1)[group]
    picked[order[first]] = True
    ends = np.cumsum([len(p) for p in parts])
    return [(flags[e - len(p) : e - window], picked[e - len(p) : e - window]) for p, e in zip(parts, ends.tolist(), strict=True)]


def judge_by_suffixes(strings: list[bytes], weights: list[int], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A suffix array decides which windows repeat.

    Windows whose hash no other place shares cannot, equal ones having equal hashes, and are cut off first: sorting
    every candidate's suffixes would take three times as long as all the rest of the operator.
    """
    size = [len(s) - window + 1 for s in strings]
    out = [(np.full(n, w > 1), np.ones(n, dtype=bool)) for n, w in zip(size, weights, strict=True)]
    if not strings:
        return out
    _, own, hashed = Bytes.window_hashes(strings, window)
    _, group, count = np.unique(hashed, return_inverse=True, return_counts=True)
    maybe = count[group] > 1
    bounds = np.append(np.flatnonzero(own == 0), len(own))
    pieces, of, where = [], [], []
    for k in range(len(strings)):
        for a, b in zip(*runs(maybe[bounds[k] : bounds[k + 1]]), strict=True):
            pieces.append(strings[k][a : b + window - 1])
            of.append(weights[k])
            where.append((k, a))
    if pieces:
        for (k, a), found in zip(where, _in_suffix_order(pieces, of, window), strict=True):
            for mine, x in zip(out[k], found, strict=True):
                mine[a : a + len(x)] = x
    return out


def remove_repeated_bytes(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row of docs.

    A byte goes if a string of so many bytes that covers it also starts anywhere else, in the same document too; all
    copies go, and strings are judged on the input.  A null text counts as empty.  n_spans: maximal runs removed.
    Texts of any length are worked on whole; rows that repeat, null ids too, count as documents of their own, so they
    lose all that a window fits in.  An empty table gives no rows; columns other than doc_id and text are not looked at.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans, whole in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            rest, k = text, 0
            gone = covered(spans, whole, len(text), window)
            if gone is not None:
                k = len(runs(gone)[0])
                rest = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(rest))
            n_spans.append(k)
            kept.append(rest)
        counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(with_spans(docs, Bytes, window, GRAM, judge_by_suffixes), each, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeated_bytes of documents at 200 bytes, with the hash of what stays."""
    return remove_repeated_bytes(read(spark, sf_dir, "documents")).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
