"""Exact duplicates by content sort, in DataFrame operations only.

Splitters sampled from the rows range-partition the texts; each partition is sorted (on disk where memory ends), equal texts become
neighbours, and the window compares neighbours in full. The splitters hold a bounded prefix and a hash of each text, so that
sampled long texts never reach the driver; both follow from the text, so equal texts still meet.

A text with more than its share of all rows would fill one partition. Such texts are found first by digests combined before the
shuffle; there are at most four times as many as partitions. Their rows carry a salt as the last range key, and their totals
come from the digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions

PREFIX_CHARS = 32
HOT_ROWS = 32


def exact_groups(
    docs: DataFrame, normalise: Callable[[Column], Column] | None = None, keep: str = "smallest", parts: int | None = None
) -> DataFrame:
    """Every row of ``docs`` with its group: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the doc_id that stays: ``smallest`` or ``largest``. Null counts as the empty text, so null and empty texts are one group. Rows
    that repeat a doc_id and its text each count in group_size and are kept or dropped alike. A null doc_id stays only where its group has no other.
    Empty table: no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    n = parts or partitions(spark)
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (normalise(text) if normalise else text).alias("_text")).withColumn("text_sha256", F.sha2("_text", 256))
    share = max(HOT_ROWS, docs.count() // (4 * n) + 1)
    hot = (
        base.groupBy(F.col("text_sha256").alias("_sha"))
        .agg(F.count(F.lit(1)).alias("_size"), best("doc_id").alias("_best"))
        .where(F.col("_size") >= share)
        .withColumn("_slices", F.ceil(F.col("_size") / share))
        .collect()  # at most 4 * n rows, whatever the table holds
    )
    hot = spark.createDataFrame(hot, "_sha string, _size long, _best long, _slices long")
    keyed = base.join(F.broadcast(hot), F.col("text_sha256") == F.col("_sha"), "left").select(
        "doc_id",
        "_text",
        "text_sha256",
        "_size",
        "_best",
        F.substring("_text", 1, PREFIX_CHARS).alias("_prefix"),
        F.xxhash64("_text").alias("_hash"),
        F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("_slices")), F.lit(0)).alias("_salt"),
    )
    same = W.partitionBy("_prefix", "_hash", "_salt", "_text")  # lies within one range: no further shuffle
    ranged = keyed.repartitionByRange(n, "_prefix", "_hash", "_salt")
    grouped = ranged.select(
        "doc_id",
        "text_sha256",
        F.when(F.col("_size").isNull(), best("doc_id").over(same)).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce(F.col("_size"), F.count(F.lit(1)).over(same)).alias("group_size"),
    )
    return grouped.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
