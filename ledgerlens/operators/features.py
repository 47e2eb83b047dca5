"""Feature tables: cleaning report, wide table, list expansion, casts and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import present

MISSING_PCT_MAX = 50.0
NUMERIC_TEXT_SHARE = 0.95
COMMA_SHARE = 0.5
TOP_TERMS = 50


def cleaning_report(profile: DataFrame, protect: list[str]) -> DataFrame:
    """KEEP or DROP per column of a cleaning profile: protected and list columns stay; then missing above 50 %, constants."""
    listed = F.coalesce(F.contains("sample_values", F.lit("#")) | F.contains("sample_values", F.lit("^")), F.lit(False))
    kept = F.col("column_name").isin(*protect)
    rule = (
        F.when(kept | listed, "KEEP")
        .when(F.col("missing_pct") > MISSING_PCT_MAX, "DROP")
        .when(F.col("n_unique") <= 1, "DROP")
        .otherwise("KEEP")
    )
    return profile.select(
        F.col("column_name").alias("feature"), "missing_pct", "n_unique", kept.alias("is_protected"), listed.alias("is_list"), rule.alias("recommendation")
    )


def merge_one_to_one(base: DataFrame, key: str, others: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-merge tables with a unique key onto the user base; added columns carry the table name as prefix."""
    out = base
    for name, (df, other_key) in others.items():
        side = df.select(F.col(other_key).alias(f"_k_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != other_key])
        out = out.join(side, F.col(key) == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
    return out


def merge_gate(base: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Rows before and after a merge and whether the key stayed unique."""
    per_key = merged.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    after = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_after"), F.coalesce(F.max("n"), F.lit(1)).alias("most"))
    before = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    return after.select(
        before.alias("rows_before"), "rows_after", ((before == F.col("rows_after")) & (F.col("most") == 1)).alias("passed")
    )


def aggregate_behaviour(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """Count, sum, mean, max, min and sample deviation of a 1:N table per key."""
    v = F.col(value)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(v).alias(f"{prefix}_count"),
        F.sum(v).alias(f"{prefix}_sum"),
        F.avg(v).alias(f"{prefix}_mean"),
        F.max(v).alias(f"{prefix}_max"),
        F.min(v).alias(f"{prefix}_min"),
        F.stddev_samp(v).alias(f"{prefix}_std"),
    )


def join_behaviour(base: DataFrame, key: str, aggregates: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left join of tables already reduced to one row per key."""
    out = base
    for name, (df, other_key) in aggregates.items():
        side = df.withColumnRenamed(other_key, f"_k_{name}")
        out = out.join(side, F.col(key) == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
    return out


def attach_scalar_row(df: DataFrame, one_row: DataFrame, prefix: str) -> DataFrame:
    """Put the columns of a one-row frame on every row, as a scalar subquery; more than one row fails."""
    packed = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.select("*", *[packed.getField(c).alias(f"{prefix}_{c}") for c in one_row.columns])


def active_days(df: DataFrame, key: str, ts: str, at_least: int) -> DataFrame:
    """Keys active on at least so many distinct days; (key, day) pairs are made distinct first."""
    days = df.select(key, F.to_date(ts).alias("d")).distinct()
    return days.groupBy(key).agg(F.count(F.lit(1)).alias("active_days")).where(F.col("active_days") >= at_least)


def sum_label(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Summed value per key, with the binary label ``sum >= threshold``."""
    return df.groupBy(key).agg(F.sum(value).alias("label_value")).withColumn("label", (F.col("label_value") >= threshold).cast("int"))


def high_activity(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """Keys whose row count reaches the given quantile of all row counts."""
    from ledgerlens.operators.ordering import global_quantiles

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("activity"))
    (limit,) = global_quantiles(counts, "activity", [share])
    return counts.where(F.col("activity") >= limit)


def _terms(column: Column, delimiter: str) -> Column:
    return F.filter(F.split(column, rf"\Q{delimiter}\E"), lambda x: F.trim(x) != "")


def top_terms(df: DataFrame, column: str, delimiter: str, top: int = TOP_TERMS) -> DataFrame:
    """The ``top`` most frequent terms of a list column, however many it has."""
    terms = df.select(F.explode(_terms(F.col(column), delimiter)).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    head = counts.orderBy(F.col("freq").desc(), "term").limit(top)
    return head.withColumn("rank", F.row_number().over(W.orderBy(F.col("freq").desc(), "term")))


def is_identifier_list(terms: DataFrame) -> DataFrame:
    """Whether the three most frequent terms look like identifiers (ten digits or more, or C and digits)."""
    head = terms.where("rank <= 3")
    return head.agg(F.coalesce(F.bool_or(F.col("term").rlike(r"^\d{10,}$|^C\d+")), F.lit(False)).alias("identifier_list"))


def expand_list(df: DataFrame, column: str, delimiter: str, terms: list[str] | None = None, top: int = TOP_TERMS) -> DataFrame:
    """Replace a list column by 0/1 term columns, its length and an empty flag; identifier lists keep the last two only."""
    if terms is None:
        head = top_terms(df, column, delimiter, top)
        rows = head.crossJoin(F.broadcast(is_identifier_list(head))).collect()
        terms = [] if any(r.identifier_list for r in rows) else [r.term for r in sorted(rows, key=lambda r: r["rank"])]
    parts = _terms(F.col(column), delimiter)
    flags = [F.coalesce(F.array_contains(parts, x), F.lit(False)).cast("int").alias(f"{column}_{x}") for x in terms]
    empty = ~F.coalesce(present(F.col(column)), F.lit(False))
    length = F.when(empty, 0).otherwise(F.size(parts))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *flags, length.alias(f"{column}_list_length"), empty.cast("int").alias(f"{column}_is_empty"))


def text_cast_plan(df: DataFrame, columns: list[str]) -> DataFrame:
    """numeric, comma_list or category per text column, over all filled rows."""
    long = df.select(*columns).unpivot([], columns, "column_name", "value").where(present(F.col("value")))
    numeric = F.trim("value").rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$")
    agg = long.groupBy("column_name").agg(
        F.avg(numeric.cast("int")).alias("numeric_share"), F.avg(F.contains("value", F.lit(",")).cast("int")).alias("comma_share")
    )
    rule = F.when(F.col("numeric_share") >= NUMERIC_TEXT_SHARE, "numeric").when(F.col("comma_share") >= COMMA_SHARE, "comma_list").otherwise("category")
    return agg.withColumn("rule", rule)


def cast_texts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Apply a cast plan: numbers stay null when empty, comma lists become length and empty flag, categories stay text."""
    out = []
    for c in df.columns:
        rule = rules.get(c)
        if rule == "numeric":
            out.append(F.expr(f"try_cast(nullif(trim(`{c}`), '') AS double)").alias(c))
        elif rule == "comma_list":
            filled = F.coalesce(present(F.col(c)), F.lit(False))
            out += [F.when(filled, F.size(F.split(c, ","))).otherwise(0).alias(f"{c}_list_length"), (~filled).cast("int").alias(f"{c}_is_empty")]
        else:
            out.append(F.col(c))
    return df.select(*out)


# Suffixes and texts of the place rule.
CITY_SUFFIXES = ("市",)
COUNTY_SUFFIXES = ("自治县", "县")
UNKNOWN_TEXTS = ("未知", "未知市")
UNKNOWN_TIER, UNMAPPED_TIER = "未知", "三线及以下"


def tier_by_lookup(df: DataFrame, column: str, tiers: DataFrame) -> DataFrame:
    """Tier of a place: blanks out, city suffix cut, counties and places without an entry take the lowest tier, null stays.

    ``tiers(name, tier)`` has one row per name.
    """
    compact = F.regexp_replace(F.col(column), r"[\s　]+", "")
    bare = F.regexp_replace(compact, f"({'|'.join(CITY_SUFFIXES)})$", "")
    j = df.withColumn("_bare", bare).join(tiers.select(F.col("name").alias("_bare"), F.col("tier").alias("_tier")), "_bare", "left")
    tier = (
        F.when(~F.coalesce(present(F.col(column)), F.lit(False)), F.lit(None))
        .when(compact.rlike(f"({'|'.join(COUNTY_SUFFIXES)})$"), UNMAPPED_TIER)
        .when(compact.isin(*UNKNOWN_TEXTS), UNKNOWN_TIER)
        .otherwise(F.coalesce(F.col("_tier"), F.lit(UNMAPPED_TIER)))
    )
    return j.withColumn(f"{column}_tier", tier).drop("_bare", "_tier", column)


def gate(name: str, observed: DataFrame, expected: Column | int | float, compare: str = "=") -> DataFrame:
    """One gate row from a one-value frame."""
    value = observed.select(F.col(observed.columns[0]).cast("double").alias("observed"))
    want = F.lit(expected).cast("double") if not isinstance(expected, Column) else expected.cast("double")
    row = value.select(F.lit(name).alias("gate"), "observed", want.alias("expected"))
    passed = F.col("observed") <= F.col("expected") if compare == "<=" else F.col("observed") == F.col("expected")
    return row.withColumn("passed", F.coalesce(passed, F.lit(False)))


def wide_gates(before: DataFrame, wide: DataFrame, key: str, forbidden: list[str], expected_columns: list[str]) -> DataFrame:
    """Gates of a wide table: rows unchanged, key unique, no raw list or place column, the columns as agreed."""
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    repeated = wide.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spark = wide.sparkSession
    raw = len([c for c in wide.columns if c in set(forbidden)])
    off = len(set(wide.columns) ^ set(expected_columns))
    fixed = spark.createDataFrame([(raw, off)], "raw int, off int")
    gates = [
        gate("rows_unchanged", rows(wide), rows(before).scalar()),
        gate("key_unique", rows(repeated), 0),
        gate("no_raw_columns", fixed.select("raw"), 0),
        gate("columns_agree", fixed.select("off"), 0),
    ]
    return reduce(DataFrame.unionByName, gates)


def assert_gates(gates: DataFrame) -> None:
    """Raise when a gate failed; gates are a handful of rows."""
    failed = [r.gate for r in gates.where("not passed").collect()]
    if failed:
        raise AssertionError(f"gates failed: {', '.join(failed)}")
