"""Schema inspection, previews and declared constraints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PREVIEW = 20
MAX_PREVIEW = 1000


def inspect_schema(tables: Mapping[str, DataFrame], allow: Iterable[str] | None = None) -> DataFrame:
    """Rows (table_name, column_name, data_type, nullable, comment, row_count) of the allowed tables."""
    names = [n for n in tables if allow is None or n in set(allow)]
    if not names:
        raise ValueError("no allowed table to inspect")
    spark = tables[names[0]].sparkSession
    rows = [
        (n, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment", ""))
        for n in names
        for f in tables[n].schema.fields
    ]
    columns = spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, nullable boolean, comment string"
    )
    counts = [
        tables[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names
    ]
    return columns.join(reduce(DataFrame.unionByName, counts), "table_name")


def preview_size(requested: int | None, policy_max: int = MAX_PREVIEW) -> int:
    """The smallest of request (default 20), hard maximum and policy."""
    return max(1, min(requested or DEFAULT_PREVIEW, MAX_PREVIEW, policy_max))


def preview(df: DataFrame, order_by: list[str], n: int | None = None, policy_max: int = MAX_PREVIEW) -> DataFrame:
    """First rows in key order, so that two previews agree."""
    return df.orderBy(*order_by).limit(preview_size(n, policy_max))


def check_foreign_keys(tables: Mapping[str, DataFrame], declared: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Declared keys (child, column, parent, column, comment) with the child rows that miss their parent.

    Child keys are counted before the anti join, so a hot key travels as one row.
    """
    parts = []
    for child, child_col, parent, parent_col, comment in declared:
        keys = tables[child].groupBy(F.col(child_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null")
        known = tables[parent].select(F.col(parent_col).alias("k")).distinct()
        missing = keys.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"))
        parts.append(
            missing.select(
                F.lit(f"{child}.{child_col}").alias("child"),
                F.lit(f"{parent}.{parent_col}").alias("parent"),
                F.lit(comment).alias("comment"),
                "orphan_rows",
            )
        )
    return reduce(DataFrame.unionByName, parts)
