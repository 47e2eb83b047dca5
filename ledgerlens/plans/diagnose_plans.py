"""Business diagnosis over order lines: revenue, goods at list price, freight from the tax rate, discount, returns."""

from pyspark.sql import functions as F

from ledgerlens.operators import diagnose as g
from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query, stored
from ledgerlens.plans.runlog_plans import rnd



def sales(t):
    """The sales mart, written once; its real size then guides the quantile operators."""
    return stored(t, "sales", d.sales)


S = f"s AS ({d.SALES_SQL})"
PERIOD = "CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01' THEN 'latest' WHEN o_orderdate >= TIMESTAMP '1998-04-01' AND o_orderdate < TIMESTAMP '1998-07-01' THEN 'previous' END"


@query(
    "B01_growth_review",
    f"""WITH {S}, o AS (SELECT CAST(o_orderdate::DATE AS VARCHAR) AS day, channel, count(*) AS orders, sum(revenue) AS gmv FROM s GROUP BY 1, 2),
        sp AS (SELECT CAST(l_shipdate::DATE AS VARCHAR) AS day, CASE l_linestatus WHEN 'F' THEN '1-URGENT' ELSE '5-LOW' END AS channel, sum(l_tax * 100) AS spend, count(*) AS clicks FROM lineitem GROUP BY 1, 2),
        dd AS (SELECT day, sum(gmv) AS day_gmv FROM o GROUP BY 1), tg AS (SELECT CAST(o_orderdate::DATE AS VARCHAR) AS day, sum(o_totalprice) / 4 AS target_gmv FROM orders GROUP BY 1),
        j AS (SELECT coalesce(o.day, sp.day) AS day, coalesce(o.channel, sp.channel) AS channel, coalesce(orders, 0) AS orders, coalesce(gmv, 0) AS gmv, coalesce(spend, 0) AS spend, coalesce(clicks, 0) AS clicks
              FROM o FULL JOIN sp ON o.day = sp.day AND o.channel = sp.channel)
        SELECT day, channel, orders, round(gmv, 2) AS gmv, round(spend, 2) + 0.0 AS spend, clicks, round(CASE WHEN spend > 0.001 THEN gmv / spend END, 8) AS return_on_spend, round(coalesce(day_gmv, 0) / target_gmv, 6) AS attainment,
               NULL::DOUBLE AS net_margin_rate, NULL::DOUBLE AS refund_rate FROM j LEFT JOIN dd USING (day) LEFT JOIN tg USING (day)
        UNION ALL SELECT period, 'all', count(*), round(sum(revenue), 2), NULL, NULL, NULL, NULL, round((sum(revenue) - sum(discount) - sum(goods) - sum(refund)) / sum(revenue), 6), round(sum(refund) / sum(revenue), 6)
        FROM (SELECT *, {PERIOD} AS period, CASE WHEN refunded THEN revenue ELSE 0 END AS refund FROM s) WHERE period IS NOT NULL GROUP BY 1""",
)
def b01(t):
    lines = sales(t)
    day = lambda c: F.to_date(c).cast("string").alias("day")
    orders = lines.select(day("o_orderdate"), "channel", F.col("revenue").alias("gmv"))
    spend = t.lineitem.select(
        day("l_shipdate"), F.when(F.col("l_linestatus") == "F", "1-URGENT").otherwise("5-LOW").alias("channel"), F.round(F.col("l_tax") * 100, 6).alias("spend"), F.lit(1).alias("clicks")
    )
    targets = t.orders.groupBy(day("o_orderdate")).agg((F.sum("o_totalprice") / 4).alias("target_gmv"))
    none = F.lit(None).cast("double")
    daily = g.channel_review(orders, spend, targets).select("*", none.alias("net_margin_rate"), none.alias("refund_rate"))
    facts = lines.select("o_orderdate", F.col("revenue").alias("gmv"), "discount", F.col("goods").alias("cost"), F.when(F.col("refunded"), F.col("revenue")).otherwise(0.0).alias("refund"))
    moment = F.col("o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    period = F.when((moment >= at("1998-07-01")) & (moment < at("1998-10-01")), "latest").otherwise("previous")
    spans = g.period_review(facts.where((moment >= at("1998-04-01")) & (moment < at("1998-10-01"))), period).select(
        F.col("period").alias("day"), F.lit("all").alias("channel"), "orders", "gmv", none.alias("spend"), F.lit(None).cast("bigint").alias("clicks"),
        none.alias("return_on_spend"), none.alias("attainment"), "net_margin_rate", "refund_rate",
    )
    return rnd(daily.unionByName(spans), {"gmv": 2, "spend": 2, "return_on_spend": 8, "attainment": 6, "net_margin_rate": 6, "refund_rate": 6})


@query(
    "B02_low_profit",
    f"""WITH {S}, r AS (SELECT *, CASE WHEN revenue > 0 THEN profit / revenue END AS mr FROM s), q AS (SELECT quantile_cont(mr, 0.1) AS c FROM r)
        SELECT product, count(*) AS n, count(*) FILTER (WHERE profit < 0) AS negative, count(*) FILTER (WHERE mr <= c) AS bottom, count(*) FILTER (WHERE profit < 0 AND mr <= c) AS both FROM r, q GROUP BY 1""",
)
def b02(t):
    flagged = g.low_profit(sales(t).select("product", "revenue", "profit"))
    return flagged.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_negative").alias("negative"), F.count_if("is_bottom").alias("bottom"), F.count_if(F.col("is_negative") & F.col("is_bottom")).alias("both")
    )


@query(
    "B03_formula_reconciliation",
    f"""WITH {S} SELECT 'profit' AS formula, count(*) AS checked, 0::BIGINT AS mismatches, 0.0::DOUBLE AS largest_gap, 0::BIGINT AS missing FROM s
        UNION ALL SELECT 'list_price', count(*), count(*) FILTER (WHERE abs(revenue - goods) > 0.01), round(max(abs(revenue - goods)), 4), 0 FROM s""",
)
def b03(t):
    c = F.col
    formulas = {"profit": (c("profit"), c("revenue") - c("goods") - c("freight") - c("discount")), "list_price": (c("revenue"), c("goods"))}
    return rnd(g.reconcile_formulas(sales(t), formulas, 0.01), {"largest_gap": 4})


@query(
    "B04_robustness",
    f"""WITH {S}, r AS (SELECT *, CASE WHEN revenue > 0 THEN profit / revenue END AS mr FROM s), q AS (SELECT quantile_cont(mr, 0.01) AS lo, quantile_cont(mr, 0.99) AS hi FROM r)
        SELECT region, count(*) AS n_raw, count(*) FILTER (WHERE revenue > 0) AS n_positive, count(*) FILTER (WHERE mr BETWEEN lo AND hi) AS n_trimmed, round(sum(profit) / sum(revenue), 6) AS rate_raw,
          round(sum(profit) FILTER (WHERE revenue > 0) / sum(revenue) FILTER (WHERE revenue > 0), 6) AS rate_positive, round(sum(profit) FILTER (WHERE mr BETWEEN lo AND hi) / sum(revenue) FILTER (WHERE mr BETWEEN lo AND hi), 6) AS rate_trimmed
        FROM r, q GROUP BY 1""",
)
def b04(t):
    return rnd(g.robustness(sales(t).select("region", "revenue", "profit"), "region"), {c: 6 for c in ("rate_raw", "rate_positive", "rate_trimmed")})


SCENARIOS = {
    "freight -5%": {"freight": 0.95},
    "freight -10%": {"freight": 0.9},
    "goods -10%": {"goods": 0.9},
    "discount -20%": {"discount": 0.8},
    "price +3%": {"revenue": 1.03},
}


def _cf(name, f):
    new = " ".join(f"{sign} {p} * {f.get(p, 1.0)}" for sign, p in (("", "revenue"), ("-", "goods"), ("-", "freight"), ("-", "discount")))
    return f"""SELECT '{name}' AS scenario, segment, count(*) AS n, sum(nw - bs) AS gain, sum(nw) / sum(revenue * {f.get("revenue", 1.0)}) AS new_rate, count(*) FILTER (WHERE bs < 0 AND nw >= 0) AS turned_positive,
        count(*) FILTER (WHERE abs(nw - bs) > 1e-9) AS covered FROM (SELECT *, revenue - goods - freight - discount AS bs, {new} AS nw FROM s) GROUP BY 2"""


@query(
    "B05_counterfactuals",
    f"""WITH {S}, c AS ({" UNION ALL ".join(_cf(n, f) for n, f in SCENARIOS.items())})
        SELECT scenario, segment, n, round(gain, 2) AS gain, round(new_rate, 6) AS new_rate, turned_positive, covered, round(gain / sum(gain) OVER (PARTITION BY scenario), 6) AS gain_share FROM c""",
)
def b05(t):
    rows = g.counterfactuals(sales(t), "segment", SCENARIOS)
    out = rows.join(g.gain_concentration(rows, "segment"), ["scenario", "segment"])
    return rnd(out, {"gain": 2, "new_rate": 6, "gain_share": 6})


@query(
    "A28_cube_profile",
    f"""WITH {S} SELECT product, region, segment, grouping_id(product, region, segment) AS level, count(*) AS n, round(sum(revenue), 2) AS revenue, round(sum(profit), 0) AS profit,
          count(*) FILTER (WHERE profit < 0) AS n_negative, round(sum(profit) / sum(revenue), 6) AS margin_rate FROM s GROUP BY CUBE (product, region, segment)""",
)
def a28(t):
    return rnd(g.cube_profile(sales(t), ["product", "region", "segment"]), {"revenue": 2, "profit": 0, "margin_rate": 6})


def _within(outer, inner):
    return f"""SELECT '{inner} in {outer}' AS comparison, {outer}::VARCHAR AS "outer", {inner}::VARCHAR AS "inner", n, round(p / r, 6) AS margin_rate, round(p / r - pp / rr, 6) + 0.0 AS gap FROM (
        SELECT *, sum(p) OVER (PARTITION BY {outer}) AS pp, sum(r) OVER (PARTITION BY {outer}) AS rr FROM (SELECT {outer}, {inner}, count(*) AS n, sum(profit) AS p, sum(revenue) AS r FROM s GROUP BY 1, 2)) WHERE n >= 300"""


@query("B06_within_groups", f"WITH {S} {_within('product', 'region')} UNION ALL {_within('region', 'product')}")
def b06(t):
    lines = sales(t)
    both = g.stacked([g.within_groups(lines, "product", "region", 300), g.within_groups(lines, "region", "product", 300)])
    return rnd(both, {"margin_rate": 6, "gap": 6})


@query(
    "B07_contributions",
    f"""WITH {S}, a AS (SELECT segment, sum(revenue) AS revenue, sum(goods) AS goods, sum(freight) AS freight, sum(discount) AS discount, sum(profit) AS profit FROM s GROUP BY 1),
        l AS ({" UNION ALL ".join(f"SELECT segment, revenue AS base, '{p}' AS part, {p} AS amount FROM a" for p in ("revenue", "goods", "freight", "discount", "profit"))})
        SELECT segment, part, round(amount, 4) AS amount, round(amount / base, 6) AS share_of_revenue, round(amount / sum(amount) OVER (PARTITION BY part), 6) AS share_of_part FROM l""",
)
def b07(t):
    out = g.contributions(sales(t), "segment", ["revenue", "goods", "freight", "discount", "profit"])
    return rnd(out, {"amount": 4, "share_of_revenue": 6, "share_of_part": 6})


@query(
    "B08_duplicates_and_anomalies",
    f"""WITH {S}, k AS (SELECT l_orderkey, l_linenumber FROM s GROUP BY 1, 2 HAVING count(*) > 1),
        c AS (SELECT *, CASE WHEN revenue <= 0 THEN 'non_positive_revenue' WHEN abs(profit / revenue) > 0.5 THEN 'extreme_rate' WHEN (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM k) THEN 'repeated_key' ELSE 'regular' END AS anomaly FROM s)
        SELECT anomaly, count(*) AS n, round(sum(profit), 4) AS profit, (SELECT count(*) FROM k) AS repeated_keys FROM c GROUP BY 1""",
)
def b08(t):
    lines = sales(t).select("l_orderkey", "l_linenumber", "revenue", "profit")
    keys = ["l_orderkey", "l_linenumber"]
    n = g.duplicate_keys(lines, keys).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rnd(g.anomaly_classes(lines, keys, 0.5), {"profit": 4}).withColumn("repeated_keys", n)
