"""Warehouse building blocks: latest rows, islands, lags, sequences, periods, encodings and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import hash_fold, present
from ledgerlens.operators.ordering import global_quantiles


def drop_reported(df: DataFrame, report: DataFrame) -> DataFrame:
    """Drop the columns a cleaning report marks DROP; names the frame lacks are ignored. The report has a row per column."""
    marked = {r.feature for r in report.where("recommendation = 'DROP'").select("feature").collect()}
    return df.drop(*[c for c in df.columns if c in marked])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every named column is present."""
    out = df
    for c in columns:
        out = out.where(present(F.col(c)))
    return out


def in_scope(df: DataFrame, column: str, scope: DataFrame, scope_column: str) -> DataFrame:
    """Rows whose key lies in the scope table."""
    keys = scope.select(F.col(scope_column).alias("_k")).distinct()
    return df.join(keys, F.col(column) == F.col("_k"), "left_semi")


def null_policy(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Filter rows without keys, fill additive measures with 0, leave every other column as it is."""
    return require(df, keys).fillna(0, subset=measures)


def one_per_key(df: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """One row per key, the greatest by ``tie`` and then by all columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*tie, *[c for c in rest if c not in tie])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; ranks are cut per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def islands(df: DataFrame, key: str, day: Column) -> DataFrame:
    """Runs of consecutive days per key. Days are made distinct first, so a key has at most one row per day."""
    days = df.select(key, day.cast("date").alias("day")).where("day is not null").distinct()
    number = F.row_number().over(W.partitionBy(key).orderBy(F.col("day").desc()))
    runs = days.withColumn("_anchor", F.date_add("day", number))
    return runs.groupBy(key, "_anchor").agg(
        F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count(F.lit(1)).alias("days")
    ).drop("_anchor")


def lags(series: DataFrame, keys: list[str], order: str, value: str, steps: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Earlier values of a series that has one row per key and step of time."""
    w = W.partitionBy(*keys).orderBy(order)
    return series.select("*", *[F.lag(value, s).over(w).alias(f"{value}_lag_{s}") for s in steps])


def rolling(series: DataFrame, keys: list[str], order: str, value: str, widths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Mean and sample deviation over the last rows of such a series, from the first row on."""
    out = series
    for n in widths:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"{value}_mean_{n}", F.avg(value).over(w)).withColumn(f"{value}_std_{n}", F.stddev_samp(value).over(w))
    return out


def latest_sequence(df: DataFrame, key: str, order: list[str], item: str, n: int, separator: str = ",") -> DataFrame:
    """The latest ``n`` items per key as text, newest first. Ranking comes before collecting, so no list exceeds ``n``."""
    ranked = top_n(df.where(present(F.col(item))), [key], [F.col(c).desc() for c in order], n)
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("x")))).alias("l"))
    return rows.select(key, F.concat_ws(separator, F.transform("l", lambda s: s.getField("x"))).alias("sequence"))


def period_over_period(df: DataFrame, by: list[str], ts: str, value: str, current_start: str, days: int = 7) -> DataFrame:
    """Count and sum of the current and the previous span of days, and the relative change; one pass."""
    start = F.lit(current_start).cast("timestamp_ntz")
    span = F.expr(f"INTERVAL {days} DAYS")
    now = (F.col(ts) >= start) & (F.col(ts) < start + span)
    before = (F.col(ts) >= start - span) & (F.col(ts) < start)
    out = df.where(now | before).groupBy(*by).agg(
        F.count_if(now).alias("current_rows"),
        F.count_if(before).alias("previous_rows"),
        F.coalesce(F.sum(F.when(now, F.col(value))), F.lit(0.0)).alias("current_value"),
        F.coalesce(F.sum(F.when(before, F.col(value))), F.lit(0.0)).alias("previous_value"),
    )
    change = (F.col("current_value") - F.col("previous_value")) / F.col("previous_value")
    return out.withColumn("change", F.when(F.col("previous_value") != 0, change))


def growing_windows(df: DataFrame, key: str, day: Column, anchor: str, widths: list[int], value: str) -> DataFrame:
    """Rows and sums over windows of growing length by one conditional aggregation; every key of the widest stays."""
    end = F.lit(anchor).cast("date")
    inside = lambda n: (day > F.date_sub(end, n)) & (day <= end)
    aggs = []
    for n in widths:
        aggs += [F.count_if(inside(n)).alias(f"rows_{n}d"), F.coalesce(F.sum(F.when(inside(n), F.col(value))), F.lit(0.0)).alias(f"{value}_{n}d")]
    return df.where(inside(max(widths))).groupBy(key).agg(*aggs)


def with_dimension(fact: DataFrame, dimension: DataFrame, key: str, dim_key: str, newest: list[str], take: list[str]) -> DataFrame:
    """Left join of a fact to a dimension reduced to its newest row per key; fact rows never multiply or vanish."""
    snapshot = one_per_key(dimension.select(dim_key, *newest, *[c for c in take if c not in newest]), [dim_key], newest)
    return fact.join(snapshot.select(F.col(dim_key).alias("_d"), *take), F.col(key) == F.col("_d"), "left").drop("_d")


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Year, month, weekday (Monday 0), hour and weekend flag."""
    day = F.weekday(ts)
    return df.select(
        "*", F.year(ts).alias("year"), F.month(ts).alias("month"), day.alias("weekday"), F.hour(ts).alias("hour"), (day >= 5).cast("int").alias("is_weekend")
    )


def outlier_treatment(df: DataFrame, column: str) -> DataFrame:
    """log1p, values clipped to [p1, p99], the interquartile outlier flag and the advice its rate leads to."""
    p1, q1, q3, p99 = global_quantiles(df, column, [0.01, 0.25, 0.75, 0.99])
    c = F.col(column)
    reach = 1.5 * (q3 - q1)
    flag = (c < q1 - reach) | (c > q3 + reach)
    return df.select("*", F.log1p(c).alias(f"{column}_log"), F.when(c.isNotNull(), F.least(F.greatest(c, p1), p99)).alias(f"{column}_clip"), flag.alias("is_outlier"))


def outlier_rate(df: DataFrame, column: str) -> DataFrame:
    """Outlier rate and the treatment it suggests: drop below 1 %, winsorize up to 5 %, bin above."""
    out = outlier_treatment(df, column).agg(F.avg(F.col("is_outlier").cast("int")).alias("outlier_rate"))
    advice = F.when(F.col("outlier_rate") < 0.01, "drop").when(F.col("outlier_rate") <= 0.05, "winsorize").otherwise("bin")
    return out.withColumn("advice", advice)


def scaled(df: DataFrame, column: str) -> DataFrame:
    """Standard (population deviation), robust (median and quartile range) and min-max scaling."""
    q1, q2, q3 = global_quantiles(df, column, [0.25, 0.5, 0.75])
    c = F.col(column).cast("double")
    facts = df.agg(
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias("f")
    ).scalar()
    f = facts.getField
    unit = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return df.select(
        "*",
        ((c - f("m")) / unit(f("s"))).alias(f"{column}_standard"),
        ((c - q2) / unit(q3 - q1)).alias(f"{column}_robust"),
        ((c - f("lo")) / unit(f("hi") - f("lo"))).alias(f"{column}_minmax"),
    )


def one_hot(df: DataFrame, column: str, drop_first: bool = True, most: int = 10) -> DataFrame:
    """0/1 columns of a low-cardinality column; the first value in order is the base. Wider columns are refused."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values; use frequency or target encoding")
    chosen = values[1:] if drop_first else values
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in chosen])


def frequency_encoding(df: DataFrame, column: str) -> DataFrame:
    """Share of the rows that hold the value."""
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    share = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(share, column, "left").withColumn(f"{column}_freq", F.col("_n") / total).drop("_n")


def target_encoding(df: DataFrame, column: str, target: str, key: str, folds: int = 5) -> DataFrame:
    """Mean target of the value over the other folds; the overall mean where those hold no row."""
    base = df.withColumn("_fold", hash_fold(F.col(key), folds))
    cells = base.groupBy(column, "_fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = W.partitionBy(column)
    others = cells.select(
        column, "_fold", (F.sum("_s").over(whole) - F.col("_s")).alias("_os"), (F.sum("_n").over(whole) - F.col("_n")).alias("_on")
    )
    overall = df.agg(F.avg(target).alias("m")).scalar()
    enc = F.when(F.col("_on") > 0, F.col("_os") / F.col("_on")).otherwise(overall)
    return base.join(others, [column, "_fold"], "left").withColumn(f"{column}_target", enc).drop("_fold", "_os", "_on")


def ordinal_encoding(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Position of the value in a given order."""
    code = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(order)])
    return df.withColumn(f"{column}_ord", code)


def merge_rare(df: DataFrame, column: str, minimum: float = 0.01) -> DataFrame:
    """Values below the minimum share become 'Other'."""
    out = frequency_encoding(df, column)
    return out.withColumn(f"{column}_merged", F.when(F.col(f"{column}_freq") < minimum, "Other").otherwise(F.col(column))).drop(f"{column}_freq")


def product_features(df: DataFrame, features: list[str], target: str, gain: float = 1.1) -> DataFrame:
    """Products of feature pairs and whether they correlate with the target more than 10 % better; one aggregation."""
    t = F.col(target).cast("double")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    single = {f: F.abs(F.corr(F.col(f).cast("double"), t)) for f in features}
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("feature_a"),
                    F.lit(b).alias("feature_b"),
                    F.greatest(single[a], single[b]).alias("baseline"),
                    F.abs(F.corr(F.col(a).cast("double") * F.col(b).cast("double"), t)).alias("product_corr"),
                )
                for a, b in pairs
            ]
        ).alias("p")
    )
    out = row.select(F.explode("p").alias("r")).select("r.*")
    return out.withColumn("kept", F.col("product_corr") > F.col("baseline") * gain)


def cross_text(df: DataFrame, a: str, b: str) -> DataFrame:
    """Text cross of two low-cardinality columns."""
    return df.withColumn(f"{a}_x_{b}", F.concat_ws("|", a, b))
