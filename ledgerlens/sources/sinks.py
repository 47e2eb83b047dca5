"""Written results: CSV, ordered export, step tables, partition overwrite and checks after writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import allow_charset

# Partition column and date pattern per time grain.
GRAINS = {
    "minute": ("pt_i", "yyyyMMddHHmm"),
    "hour": ("pt_h", "yyyyMMddHH"),
    "day": ("pt_d", "yyyyMMdd"),
    "week": ("pt_w", "yyyyMMdd"),
    "month": ("pt_m", "yyyyMM"),
}


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """CSV with a header; a quote inside a quoted cell is doubled, nulls and empty cells stay apart from text."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", allow_charset(df.sparkSession, encoding))
        .csv(path)
    )
    return path


def export_ordered(df: DataFrame, key: str, path: str, files: int | None = None) -> str:
    """Files that follow each other in key order: one range shuffle, sorted inside each file."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").option("header", True).csv(path)
    return path


def materialise(df: DataFrame, path: str, buckets: tuple[str, int] | None = None, table: str | None = None) -> DataFrame:
    """Write a step and read it back; with ``table`` it becomes a catalog table, bucketed for later joins."""
    if table:
        writer = df.write.mode("overwrite").format("parquet").option("path", path)
        if buckets:
            writer = writer.bucketBy(buckets[1], buckets[0]).sortBy(buckets[0])
        writer.saveAsTable(table)
        return df.sparkSession.table(table)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def grain_column(ts: Column, grain: str) -> Column:
    """Text value of the partition column for a time grain; weeks start on Monday."""
    name, pattern = GRAINS[grain]
    moment = F.date_trunc("week", ts) if grain == "week" else ts
    return F.date_format(moment, pattern).alias(name)


def overwrite_partitions(df: DataFrame, ts: str, grain: str, path: str) -> str:
    """Replace only the partitions present in ``df``. The rebalance hint splits a partition that holds most rows."""
    name, _ = GRAINS[grain]
    out = df.withColumn(name, grain_column(F.col(ts), grain)).hint("rebalance", name)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return path


def written_counts(spark, path: str, partition: str) -> DataFrame:
    """Rows per partition of a written table."""
    return (
        spark.read.parquet(path)
        .groupBy(F.col(partition).cast("string").alias(partition))
        .agg(F.count(F.lit(1)).alias("rows_written"))
    )


def check_written(df: DataFrame, ts: str, grain: str, path: str) -> DataFrame:
    """Rows expected and written per partition, and whether they agree."""
    name, _ = GRAINS[grain]
    expected = df.groupBy(grain_column(F.col(ts), grain)).agg(F.count(F.lit(1)).alias("rows_expected"))
    return (
        expected.join(written_counts(df.sparkSession, path, name), name, "full")
        .na.fill(0, ["rows_expected", "rows_written"])
        .withColumn("passed", F.col("rows_expected") == F.col("rows_written"))
    )


def chart_series(df: DataFrame, series: Column, label: Column, value: Column) -> DataFrame:
    """Chart input: one summed value per series and label."""
    return df.groupBy(series.alias("series"), label.alias("label")).agg(F.sum(value).alias("value"))
