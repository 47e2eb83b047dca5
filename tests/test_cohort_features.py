from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import cohort as c
from ledgerlens.operators import features as ft
from ledgerlens.operators import warehouse as w


def visits(spark):
    data = []
    for u in range(60):
        for day in range(1, 29):
            if (u + day) % 4 == 0:
                data.append((u, datetime(2024, 1, day, 12), "play", 1.0))
        if u % 3 == 0:
            data.append((u, datetime(2024, 1, 17, 9), "pay", 5.0))
        if u % 15 == 0:
            data.append((u, datetime(2024, 1, 3, 9), "pay", 5.0))
    return spark.createDataFrame(data, "user_id bigint, ts timestamp_ntz, kind string, value double")


def plan():
    return c.SamplingPlan("user_id", "ts", "2024-01-15", 7, 14, F.col("kind") == "pay")


def test_pool_and_positives(spark):
    v = visits(spark)
    assert {r.user_key for r in c.positives(v, plan()).collect()} == set(range(0, 60, 3))
    assert {r.user_key for r in c.candidate_pool(v, plan()).collect()} == {u for u in range(60) if u % 15}
    probe = c.probe_positives(v, plan(), regular_min=20).first()
    assert (probe.positive_users, probe.mode) == (20, "regular")


def test_window_edges(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 15)), (2, datetime(2024, 1, 15, 0, 0, 1)), (3, datetime(2024, 1, 22)), (4, datetime(2024, 1, 22, 0, 0, 1)), (5, datetime(2024, 1, 1))], "user_id bigint, ts timestamp_ntz")
    p = c.SamplingPlan("user_id", "ts", "2024-01-15", 7, 14, F.lit(True))
    keys = lambda cond: {r.user_id for r in df.where(cond).collect()}
    assert keys(p.label_window) == {2, 3} and keys(p.lookback) == {1} and keys(p.through_t0) == {1, 5}


def test_training_set_keeps_ratio_with_overlapping_pools(spark):
    v = visits(spark)
    users = v.select(F.col("user_id").alias("user_key")).distinct()
    pools = c.negative_pools(v, users, plan(), F.col("kind") == "play", F.col("kind") == "pay", mismatch=F.col("user_key") > 30)
    drawn = c.draw_training_set(c.positives(v, plan()), pools, 25)
    counts = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert counts == {1: 5, 0: 20} and drawn.select("user_key").distinct().count() == 25
    assert c.sample_statistics(drawn).first().ratio_ok
    assert rows(drawn) == rows(c.draw_training_set(c.positives(v, plan()), pools, 25))


def test_conversion_needs_order(spark):
    e = spark.createDataFrame([(1, "x", datetime(2024, 1, 16)), (2, "x", datetime(2024, 1, 18)), (3, "y", datetime(2024, 1, 16))], "u bigint, item string, ts timestamp_ntz")
    d = spark.createDataFrame([(1, "x", datetime(2024, 1, 17)), (2, "x", datetime(2024, 1, 17)), (3, "x", datetime(2024, 1, 17))], "u bigint, item string, ts timestamp_ntz")
    assert rows(c.exposure_conversion(e, d, "u", "item", "ts", F.lit(True), F.lit(True))) == [(1,)]


def test_projection_and_gate(spark):
    v, sample = visits(spark), spark.createDataFrame([(0, 1), (1, 0)], "user_key bigint, label int")
    kept = c.project(v, sample, "user_keyed", "user_id")
    assert {r.user_id for r in kept.collect()} == {0, 1}
    one = c.project(v, sample, "user_table", "user_id", tie=["ts"])
    assert one.count() == 2 and "label" in one.columns
    assert c.projection_gate(v, kept, sample, "user_id", "v").first().passed
    assert not c.projection_gate(v, v, sample, "user_id", "v").first().passed


def test_split(spark):
    df = spark.createDataFrame([(i, int(i < 37)) for i in range(100)], "id bigint, label int")
    out = c.stratified_split(df, "id", "label")
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(1, "train"): 29, (1, "valid"): 8, (0, "train"): 50, (0, "valid"): 13}


def test_list_expansion(spark):
    df = spark.createDataFrame([(1, "a#b"), (2, "a"), (3, ""), (4, None)], "id int, tags string")
    out = ft.expand_list(df, "tags", "#")
    assert out.columns == ["id", "tags_a", "tags_b", "tags_list_length", "tags_is_empty"]
    assert rows(out) == [(1, 1, 1, 2, 0), (2, 1, 0, 1, 0), (3, 0, 0, 0, 1), (4, 0, 0, 0, 1)]
    ids = spark.createDataFrame([(1, "5064085579445075210#5064085579445075211")], "id int, tags string")
    assert ft.expand_list(ids, "tags", "#").columns == ["id", "tags_list_length", "tags_is_empty"]
    wide = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "id int, tags string")
    assert ft.top_terms(wide, "tags", "#").count() == 50


def test_number_of_top_terms_is_fixed(spark):
    for n in (60, 150):
        df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "id int, tags string")
        assert ft.top_terms(df, "tags", "#").count() == 50 and ft.top_terms(df, "tags", "#", 10).count() == 10


def test_tiers(spark):
    tiers = spark.createDataFrame([("北京", "一线"), ("昆明", "新一线")], "name string, tier string")
    df = spark.createDataFrame([("北京市",), ("北京 市",), ("昆明",), ("某县",), ("未知",), ("别处",), ("",), (None,)], "city string")
    got = [r[0] for r in ft.tier_by_lookup(df, "city", tiers).select("city_tier").collect()]
    assert sorted(map(str, got)) == sorted(map(str, ["一线", "一线", "新一线", "三线及以下", "未知", "三线及以下", None, None]))


def test_text_casts(spark):
    df = spark.createDataFrame([(" 1.5", "a,b", "v1"), ("2", "c", "v2"), (None, "d,e", "v3"), ("", "", "v,4")], "n string, l string, v string")
    rules = {r.column_name: r.rule for r in ft.text_cast_plan(df, ["n", "l", "v"]).collect()}
    assert rules == {"n": "numeric", "l": "comma_list", "v": "category"}
    assert rows(ft.cast_texts(df, rules).select("n", "l_list_length", "l_is_empty")) == [(1.5, 2, 0), (2.0, 1, 0), (None, 0, 1), (None, 2, 0)]


def test_gates_raise(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    doubled = base.unionAll(base)
    gates = ft.wide_gates(base, doubled, "id", [], ["id"])
    with pytest.raises(AssertionError, match="rows_unchanged, key_unique|key_unique, rows_unchanged"):
        ft.assert_gates(gates)
    ft.assert_gates(ft.wide_gates(base, base, "id", [], ["id"]))


def test_scalar_row_must_be_one(spark):
    df, many = spark.range(3), spark.range(2)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        ft.attach_scalar_row(df, many, "x").collect()


def test_nulls_survive_clipping(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    got = w.outlier_treatment(df, "x").where("x is null").first()
    assert got.x_clip is None and got.x_log is None


def test_null_policy(spark):
    df = spark.createDataFrame([("a", 1, None), ("", 2, "c"), (None, 3, "c"), ("b", None, None)], "k string, m int, cat string")
    assert rows(w.null_policy(df, ["k"], ["m"])) == [("a", 1, None), ("b", 0, None)]


def test_target_encoding_leaves_own_fold_out(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(20)], "id bigint, c string, y double")
    out = w.target_encoding(df, "c", "y", "id", 4)
    from ledgerlens.functions.predicates import hash_fold

    folds = {r.id: r.f for r in df.select("id", hash_fold(F.col("id"), 4).alias("f")).collect()}
    for r in out.collect():
        others = [float(i) for i in range(20) if folds[i] != folds[r.id]]
        assert abs(r.c_target - sum(others) / len(others)) < 1e-9


def test_islands_and_rare(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-02"), (1, "2024-01-05")], "k int, d string")
    assert rows(w.islands(df, "k", F.col("d").cast("date")).select("days")) == [(1,), (2,)]
    rare = spark.createDataFrame([("a",)] * 199 + [("b",)], "x string")
    assert {r.x_merged for r in w.merge_rare(rare, "x").collect()} == {"a", "Other"}
    with pytest.raises(ValueError):
        w.one_hot(spark.range(30).select(F.col("id").cast("string").alias("x")), "x")
