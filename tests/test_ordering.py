"""Order statistics against brute force, also with a value that fills a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ordering as o


def skewed(spark):
    rng = np.random.default_rng(7)
    values = [("hot", 5.0)] * 300 + [("hot", float(x)) for x in rng.normal(5, 2, 400).round(3)] + [("cold", float(x)) for x in rng.exponential(3, 200).round(2)]
    return values, spark.createDataFrame([*values, ("cold", None)], "g string, x double").repartition(5)


def test_exact_quantiles(spark):
    values, df = skewed(spark)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.quantile for r in o.exact_quantiles(df, ["g"], "x", probs).collect()}
    for g in ("hot", "cold"):
        xs = [x for k, x in values if k == g]
        for p in probs:
            assert abs(got[g, p] - np.quantile(xs, p)) < 1e-9, (g, p)
    whole = {r.prob: r.quantile for r in o.exact_quantiles(df, [], "x", [0.25]).collect()}
    assert abs(whole[0.25] - np.quantile([x for _, x in values], 0.25)) < 1e-9


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, descending):
    _, df = skewed(spark)
    cells = df.where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.x): r.cum_n for r in o.running_totals(cells, ["g"], "x", ["n"], descending).collect()}
    rows = cells.collect()
    for r in rows:
        want = sum(s.n for s in rows if s.g == r.g and (s.x >= r.x if descending else s.x <= r.x))
        assert got[r.g, r.x] == want


def test_no_window_over_a_whole_group(spark):
    _, df = skewed(spark)
    cells = df.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    plan = o.running_totals(cells, [], "x", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "LogicalRDD" in plan


def test_a_group_over_many_slices(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    cells = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # slices of a few rows are joined otherwise
    try:
        out = o.running_totals(cells, ["g"], "x", ["n"])
        assert out.where("cum_n <> x + 1").count() == 0 and out.count() == 20_000
    finally:
        spark.conf.set(key, "true")


def test_hash_rank_select(spark):
    import hashlib

    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id bigint, c int")
    picked = o.hash_rank_select(df, ["c"], "id", F.floor(F.col("_size") * 0.3))
    for c in range(3):
        ids = sorted((i for i in range(500) if i % 3 == c), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert {r.id for r in picked.where(F.col("c") == c).collect()} == set(ids[: int(len(ids) * 0.3)])
    assert o.hash_rank_select(df, [], "id", F.lit(7)).count() == 7
    assert o.hash_rank_select(df, [], "id", F.lit(0)).count() == 0
    assert o.hash_rank_select(df, [], "id", F.lit(9999)).count() == 500


def test_quantiles_gather_no_group(spark):
    """The only join of quantiles is by slice; a join by group would send all values of a group to one task."""
    _, df = skewed(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = o.exact_quantiles(df, ["g"], "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1, plan


def test_marked_rows_are_the_selected_ones(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 500 > 0 THEN id END AS id", "CASE WHEN id % 7 > 0 THEN id % 3 END AS c", "repeat('x', 20) AS wide")
    keep = F.floor(F.col("_size") * 0.3)
    marked = o.hash_rank_mark(df, ["c"], "id", keep, "kept", 1)
    assert marked.count() == 3000 and marked.where("kept IS NULL").count() == 0
    want = {r.id for r in o.hash_rank_select(df, ["c"], "id", keep, 1).collect()} - {None}
    assert {r.id for r in marked.where("kept").collect()} == want
    # whole rows meet small written tables and are not shuffled
    assert "hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()


def test_filter_of_quantile_cells_does_not_grow_with_levels(spark):
    """A filter that repeats the cell's columns for each level is too long to be compiled and runs several times slower."""
    df = spark.range(50).selectExpr("id % 2 AS g", "cast(id AS double) AS x")
    plans = [o.exact_quantiles(df, ["g"], "x", [i / n for i in range(n + 1)])._jdf.queryExecution().optimizedPlan().toString() for n in (2, 100)]
    assert plans[0].count("_size") == plans[1].count("_size")
