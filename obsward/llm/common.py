"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rules of the operators name it: blank and 0x09 to 0x0D (what bytes.split() splits at).
SPACE = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the one that spark.checkpoint.dir names.  Where that is unset, a
    local session (one machine, as in tests) gets a new one; on a cluster that is an error, as executors share no disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text: rows with equal texts, and only these, share both."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(0x5EED), text, F.length(text)).alias("h2")]


def join_counted(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, parts: int = 1000) -> DataFrame:
    """Inner join of rows to classes (one row for each key; `count`: how many of rows have it) without a hot task.

    Keys that hold over a thousandth of all that is counted are fewer than a thousand whatever the input: their classes
    are broadcast, so their rows stay where they are.  The rest is shuffled.  Both should be checkpointed: they are read
    twice.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * parts > total
    few = F.broadcast(classes.where(heavy))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(classes.where(~heavy), keys))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Arrow batches of df through a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def scratch(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared checkpoint folder: for intermediate rows with long strings, which a
    checkpoint would store as they are."""
    context = df.sparkSession.sparkContext
    checkpoint_dir(df.sparkSession)
    path = f"{context.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scratch tables that this driver has written and not yet removed.
_SCRATCH: list[str] = []


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables written so far, once the results that read them are written; how many there were.

    Checkpoints are Spark's own: it deletes them with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    hadoop, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_SCRATCH)
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def portions(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    begin = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def give_back() -> None:
    """What the worker has freed goes back to the system: Spark keeps idle workers, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def small_parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches, cut where texts (or bytes) of the column have about so many bytes together, a row counting as 64 more:
    what a worker makes of a part, several times its size, then is not held for a whole batch of Spark's (10,000 rows).
    A longer text is a part of its own.  After the last part, freed memory is given back."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        end = np.cumsum(size)
        begin = 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(end, end[begin] - size[begin] + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
    give_back()
