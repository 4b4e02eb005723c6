"""Contiguous shards of near equal bytes from global prefix sums; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, read


def contiguous_shards(rows: DataFrame, size: str, order: list[str], n_shards: int) -> DataFrame:
    """All columns of rows, `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in its shard).

    Rows are ranged by `order`; each range's total and count give the bytes and rows before it, a running sum in the
    range gives the bytes before a row, and the row goes to the shard that holds its middle byte when the whole is cut
    at equal targets.  So a shard's bytes miss the target by at most one row's size.

    rows should carry keys rather than texts: they are checkpointed, so that drawing the ranges' bounds reads no text, and
    shuffled twice.  Rows that tie in `order` are spread over
    ranges at random and are interchangeable.  Sizes must be positive; null counts as 0 and stays in place.  Empty
    input gives no rows.  Existing columns named shard or slot are replaced.

    What is broadcast: one row per range (as many as shuffle partitions) and one per shard.
    """
    out = [c for c in rows.columns if c not in ("shard", "slot")]
    keys: list[Column] = [F.col(f"_row.`{c}`") for c in order]
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in out]).alias("_row"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("_size"), F.rand(42).alias("_tie"))
    ranged = checkpoint(checkpoint(wide).repartitionByRange(*keys, "_tie").withColumn("_range", F.spark_partition_id()))

    by_range = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = (
        ranged.groupBy("_range")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_bytes").over(by_range), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_rows").over(by_range), F.lit(0)).alias("_rows_before"), F.sum("_bytes").over(whole).alias("_total"))
    )
    in_range = Window.partitionBy("_range").orderBy(*keys, "_tie")
    placed = (
        ranged.withColumns({"_number": F.row_number().over(in_range), "_to": F.sum("_size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))})
        .join(F.broadcast(totals), "_range")
        .withColumns({"_at": F.col("_rows_before") + F.col("_number") - 1, "_twice_middle": 2 * (F.col("_bytes_before") + F.col("_to")) - F.col("_size")})
        .withColumn("_shard", F.expr(f"CAST(LEAST({n_shards - 1}L, IF(_total > 0, (_twice_middle * {n_shards}L) DIV (2L * _total), 0L)) AS INT)"))
        .select("_row", "_at", "_shard")
    )
    first = placed.groupBy("_shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").select("_row.*", F.col("_shard").alias("shard"), (F.col("_at") - F.col("_first")).alias("slot"))


def op3_byte_shards(spark: SparkSession, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """documents in shards by the law `bytes`, in the order of doc_id; a null text has no bytes and counts 8."""
    text = F.encode(F.col("text"), "UTF-8")
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    shards = contiguous_shards(rows, "size", ["doc_id", "size", "text_crc32"], n_shards)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
