"""A corpus from raw documents to token ids: quality, lines, near-duplicates, mixture, encoding.

Every stage takes all rows that the one before it kept.  Null texts count as empty (null stays null), texts of any length
are worked on whole, rows that repeat are copies, an empty table passes through, and columns beside those of documents are
carried along by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.llm import bpe, line_dedup, mixing, quality, simhash
from obsward.llm.common import read, scratch


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null sources and languages are a site of their own; without labels nothing is rejected; equal rows stay or go together.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; no row goes.

    Documents come in the order of doc_id, null last; of rows equal in id and text one is the first.
    """
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id (null last).

    Groups are those of op1's fingerprints, joined with what five-word shingles show to be similar by 0.8 beyond them.
    Texts without words, null or empty, are copies of each other; of tied and repeated rows one stays.
    """
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that tokens meet the target weights.

    Rows equal in id are drawn alike; documents without tokens stay.  What other sources and languages hold keeps its share.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids of every document; decoded_sha256 of the bytes that the ids decode to,
    intact: these are the text's.  A null or empty text has no ids."""
    decoded = bpe.encode_and_decode(docs.select("doc_id", "text", "source", "lang"), bpe.vocabulary())
    text = F.coalesce("text", F.lit("")).cast("binary")
    found = [F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("intact")]
    return decoded.select("doc_id", "source", "lang", "n_tokens", "token_ids", *found)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_bad),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, fingerprints, minhash bands and the encoder have no SQL form.
ORACLE_SQL: str | None = None
