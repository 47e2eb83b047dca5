"""Business diagnosis: growth review, low-profit flags, reconciliation, robustness, counterfactuals, contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import global_quantiles


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def period_review(orders: DataFrame, period: Column) -> DataFrame:
    """Orders, value, net margin rate and refund rate per period; facts gmv, discount, cost, refund."""
    agg = orders.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("orders"), *[F.sum(c).alias(c) for c in ("gmv", "discount", "cost", "refund")]
    )
    net = F.col("gmv") - F.col("discount") - F.col("cost") - F.col("refund")
    return agg.select("period", "orders", "gmv", ratio(net, F.col("gmv")).alias("net_margin_rate"), ratio(F.col("refund"), F.col("gmv")).alias("refund_rate"))


def channel_review(orders: DataFrame, spend: DataFrame, targets: DataFrame) -> DataFrame:
    """Value, spend, clicks, return on spend and target attainment per day and channel.

    Each fact is reduced to (day, channel) before it is joined, so several campaigns never multiply orders; days with spend
    and no orders stay.
    """
    o = orders.groupBy("day", "channel").agg(F.count(F.lit(1)).alias("orders"), F.sum("gmv").alias("gmv"))
    s = spend.groupBy("day", "channel").agg(F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"))
    j = o.join(s, ["day", "channel"], "full").na.fill(0, ["orders", "gmv", "spend", "clicks"])
    per_day = o.groupBy("day").agg(F.sum("gmv").alias("day_gmv"))
    out = j.join(per_day, "day", "left").join(targets, "day", "left")
    return out.select(
        "day", "channel", "orders", "gmv", "spend", "clicks", ratio(F.col("gmv"), F.col("spend")).alias("return_on_spend"),
        ratio(F.coalesce("day_gmv", F.lit(0.0)), F.col("target_gmv")).alias("attainment"),
    )


def low_profit(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Flags per order: negative margin, and the worst share of margin rates over positive revenue."""
    rates = df.withColumn("margin_rate", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue")))
    (cut,) = global_quantiles(rates.where("margin_rate is not null"), "margin_rate", [share])
    return rates.select("*", (F.col("profit") < 0).alias("is_negative"), F.coalesce(F.col("margin_rate") <= cut, F.lit(False)).alias("is_bottom"))


def reconcile_formulas(df: DataFrame, formulas: dict[str, tuple[Column, Column]], eps: float) -> DataFrame:
    """Rows that break a stated formula, per formula: checked, mismatching, largest gap, missing; one pass."""
    aggs = []
    for name, (stated, derived) in formulas.items():
        gap = F.abs(stated - derived)
        aggs.append(
            F.struct(
                F.lit(name).alias("formula"), F.count(gap).alias("checked"), F.count_if(gap > eps).alias("mismatches"),
                F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_gap"), (F.count(F.lit(1)) - F.count(gap)).alias("missing"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def robustness(df: DataFrame, by: str, trim: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Profit rate per group in three views side by side: all rows, positive revenue only, margin rate trimmed."""
    rates = df.withColumn("margin_rate", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue")))
    lo, hi = global_quantiles(rates.where("margin_rate is not null"), "margin_rate", list(trim))
    flagged = rates.withColumn("_pos", F.col("revenue") > 0).withColumn("_trim", F.coalesce(F.col("margin_rate").between(lo, hi), F.lit(False)))
    pick = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)))
    out = flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("_pos").alias("n_positive"), F.count_if("_trim").alias("n_trimmed"),
        ratio(F.sum("profit"), F.sum("revenue")).alias("rate_raw"), ratio(pick("_pos", "profit"), pick("_pos", "revenue")).alias("rate_positive"),
        ratio(pick("_trim", "profit"), pick("_trim", "revenue")).alias("rate_trimmed"),
    )
    return out


def counterfactuals(df: DataFrame, by: str, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Static what-ifs: factors on revenue, goods, freight or discount. Per scenario and group: gain, new rate, orders turned positive.

    All scenarios come out of one grouping; rows are not copied per scenario.
    """
    parts = ["revenue", "goods", "freight", "discount"]
    base = F.col("revenue") - F.col("goods") - F.col("freight") - F.col("discount")
    aggs = []
    for name, factors in scenarios.items():
        scaled = {p: F.col(p) * factors.get(p, 1.0) for p in parts}
        new = scaled["revenue"] - scaled["goods"] - scaled["freight"] - scaled["discount"]
        aggs.append(
            F.struct(
                F.lit(name).alias("scenario"), F.count(F.lit(1)).alias("n"), F.sum(new - base).alias("gain"), ratio(F.sum(new), F.sum(scaled["revenue"])).alias("new_rate"),
                F.count_if((base < 0) & (new >= 0)).alias("turned_positive"), F.count_if(F.abs(new - base) > 1e-9).alias("covered"),
            )
        )
    return df.groupBy(by).agg(F.array(*aggs).alias("a")).select(by, F.explode("a").alias("r")).select(by, "r.*")


def gain_concentration(scenario_rows: DataFrame, by: str) -> DataFrame:
    """Share of each group in a scenario's whole gain."""
    total = scenario_rows.groupBy("scenario").agg(F.sum("gain").alias("_t"))
    return scenario_rows.join(total, "scenario").select("scenario", by, ratio(F.col("gain"), F.col("_t")).alias("gain_share"))


def cube_profile(df: DataFrame, dims: list[str]) -> DataFrame:
    """Every combination and subtotal of the dimensions with its size; ``level`` tells which dimensions are summed over."""
    cube = df.cube(*dims).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.count_if(F.col("profit") < 0).alias("n_negative")
    )
    return cube.withColumn("margin_rate", ratio(F.col("profit"), F.col("revenue")))


def within_groups(df: DataFrame, outer: str, inner: str, minimum: int) -> DataFrame:
    """Margin rate of the inner groups inside each outer group against the outer group's rate; small cells left out."""
    cells = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"), F.sum("profit").alias("p"))
    whole = cells.groupBy(outer).agg(F.sum("r").alias("_r"), F.sum("p").alias("_p"))
    j = cells.join(whole, outer).where(F.col("n") >= minimum)
    rate = ratio(F.col("p"), F.col("r"))
    return j.select(
        F.lit(f"{inner} in {outer}").alias("comparison"), F.col(outer).cast("string").alias("outer"), F.col(inner).cast("string").alias("inner"), "n",
        rate.alias("margin_rate"), (rate - ratio(F.col("_p"), F.col("_r"))).alias("gap"),
    )


def contributions(df: DataFrame, segment: str, parts: list[str]) -> DataFrame:
    """Amount of each revenue and cost part per segment, its share of the segment's revenue and of the part's total."""
    agg = df.groupBy(segment).agg(*[F.sum(p).alias(p) for p in parts])
    long = agg.unpivot([segment, parts[0]], parts, "part", "amount").withColumnRenamed(parts[0], "_base")
    total = long.groupBy("part").agg(F.sum("amount").alias("_t"))
    return long.join(total, "part").select(
        segment, "part", "amount", ratio(F.col("amount"), F.col("_base")).alias("share_of_revenue"), ratio(F.col("amount"), F.col("_t")).alias("share_of_part")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Business keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def anomaly_classes(df: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Rows and profit per class: non-positive revenue, extreme margin rate, repeated key, none of these."""
    copies = duplicate_keys(df, keys).select(*keys, F.lit(True).alias("_dup"))
    j = df.join(copies, keys, "left")
    rate = F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue"))
    label = (
        F.when(F.col("revenue") <= 0, "non_positive_revenue").when(F.abs(rate) > limit, "extreme_rate")
        .when(F.coalesce(F.col("_dup"), F.lit(False)), "repeated_key").otherwise("regular")
    )
    return j.groupBy(label.alias("anomaly")).agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("profit"))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Frames of one schema as one."""
    return reduce(DataFrame.unionByName, frames)
