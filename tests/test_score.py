import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import score as s
from ledgerlens.operators import screen as c


def frame(spark, labels, scores):
    return spark.createDataFrame([(i, int(y), float(x)) for i, (y, x) in enumerate(zip(labels, scores))], "user_id bigint, label int, score double")


def test_metrics_of_known_rows(spark):
    got = s.ranking_metrics(frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), "score", "label").first()
    assert (got.auc, got.ks) == (0.75, 0.5)
    back = s.ranking_metrics(frame(spark, [1, 0, 1, 0], [-0.9, -0.8, -0.7, -0.1]), "score", "label").first()
    assert back.auc == 0.25
    one = s.ranking_metrics(frame(spark, [1, 1], [0.2, 0.3]), "score", "label").first()
    assert one.auc is None and one.ks is None


def test_metrics_by_brute_force(spark):
    rng = np.random.default_rng(3)
    y, x = rng.integers(0, 2, 120), rng.integers(0, 15, 120) / 10
    got = s.ranking_metrics(frame(spark, y, x), "score", "label").first()
    pos, neg = x[y == 1], x[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ks = max(abs(np.mean(pos >= t) - np.mean(neg >= t)) for t in x)
    assert abs(got.auc - auc) < 1e-9 and abs(got.ks - ks) < 1e-9


def test_ties(spark):
    got = s.tie_aware_top_k(frame(spark, [1, 0, 1, 0], [0.5] * 4), "score", "label", [0.5]).first()
    assert (got.hits, got.precision, got.lift, got.tied, got.slots) == (1.0, 0.5, 1.0, 4, 2)
    three = frame(spark, [1, 0, 1], [3, 2, 1])
    assert s.tie_aware_top_k(three, "score", "label", [0.5]).first().selected == 2
    assert s.tie_aware_top_k(three, "score", "label", [0.5], floor=True).first().selected == 1


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 15.0), (4.0, 1.0)], "a double, b double")
    ra, rb = [1, 2.5, 2.5, 4], [2, 4, 3, 1]
    assert abs(s.spearman(df, "a", "b").first().spearman - np.corrcoef(ra, rb)[0, 1]) < 1e-9
    assert s.spearman(df.withColumn("b", F.lit(1.0)), "a", "b").first().spearman == 0.0


def features(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(400):
        x = float(rng.normal())
        y = int(x + rng.normal() > 0)
        data.append((i, y, x, "ab"[int(x > 0)], 1, None if i % 10 < 6 else x, "train" if i % 7 else "valid"))
    return spark.createDataFrame(data, "user_id bigint, label int, f_num double, f_cat string, f_const int, f_null double, split string")


def test_screening_report(spark):
    df = features(spark)
    got = {r.feature: r for r in c.screening_report(df, ["f_num", "f_const", "f_null"], ["f_cat"], "label", "split").collect()}
    assert got["f_const"].recommendation == "DROP" and got["f_null"].recommendation == "DROP"
    assert got["f_null"].reason == "missing_rate" and got["f_const"].reason == "constant"
    assert got["f_num"].iv > 0.1 and got["f_cat"].iv > 0.1 and all(r.iv >= 0 for r in got.values())
    kept = c.keep_features(df, spark.createDataFrame([tuple(r)[:1] + (r.recommendation,) for r in got.values()], "feature string, recommendation string"), ["user_id", "label"])
    assert "f_const" not in kept.columns and "f_num" in kept.columns


def test_stability_of_equal_halves_is_zero(spark):
    df = features(spark)
    both = df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("valid")))
    for r in c.population_stability(both, ["f_num"], ["f_cat"], "label", "split").collect():
        assert abs(r.psi) < 1e-12


def test_text_of_many_values_is_screened(spark):
    data = [(i, int(i % 3 == 0), f"v{i % 150}", float(i), "train" if i % 7 else "valid") for i in range(1200)]
    df = spark.createDataFrame(data, "user_id bigint, label int, f_text string, f_num double, split string")
    cell = lambda part, label: np.array([sum(r[2] == f"v{k}" and r[4] in part and r[1] in label for r in data) for k in range(150)])
    pos, neg = cell(["train"], [1]), cell(["train"], [0])
    both = (pos > 0) & (neg > 0)
    p, n = pos / pos.sum(), neg / neg.sum()
    iv = max(((p - n)[both] * np.log(p[both] / n[both])).sum(), 0.0)
    t, v = cell(["train"], [0, 1]), cell(["valid"], [0, 1])
    a, b = np.where(t == 0, 0.001, t / t.sum()), np.where(v == 0, 0.001, v / v.sum())
    psi = ((b - a) * np.log(b / a)).sum()
    got = {r.feature: r for r in c.screening_report(df, ["f_num"], ["f_text"], "label", "split").collect()}
    assert got["f_text"].iv is not None and abs(got["f_text"].iv - iv) < 1e-9 and abs(got["f_text"].psi - psi) < 1e-9
    assert abs({r.feature: r.psi for r in c.population_stability(df, ["f_num"], ["f_text"], "label", "split").collect()}["f_text"] - psi) < 1e-9
    assert c.population_stability(df, [], ["f_text"], "label", "split", limit=100).first().psi is None
    assert c.categorical_screening(df, ["f_text"], "label").count() == 150 and c.categorical_screening(df, ["f_text"], "label", 100).count() == 0


def test_null_is_one_row(spark):
    df = spark.createDataFrame([(1, None), (0, None), (1, "a"), (0, "b")], "label int, f string")
    got = {r.value: (r["count"], r.count_pos) for r in c.categorical_screening(df, ["f"], "label").collect()}
    assert got == {"NULL": (2, 1), "a": (1, 1), "b": (1, 0)}


def test_scorecard_rows_match_one_rule(spark):
    df = features(spark)
    rules = s.build_scorecard(df, ["f_num", "f_cat", "f_const", "f_null", "x5"], ["f_cat"], "label")
    rule_rows = rules.collect()
    assert {r.feature for r in rule_rows} == {"f_num"} and all(-30 <= r.raw_score <= 30 for r in rule_rows)
    scored = s.apply_scorecard(df, rules).collect()
    for r in scored:
        mine = [x.weighted_score for x in rule_rows if (x.lo is None or r.f_num >= x.lo) and (x.hi is None or r.f_num < x.hi)]
        assert len(mine) == 1 and abs(mine[0] - r.card_score) < 1e-9
    assert "Exchange" not in s.apply_scorecard(df, rules)._jdf.queryExecution().executedPlan().toString()


def test_a_card_of_any_size(spark, monkeypatch):
    """Two hundred thousand rules by joins, and the same card in both forms."""
    df = spark.range(3000).selectExpr("id as user_id", "if(id % 10 = 0, null, cast(id * 0.37 % 1000 as double)) as x", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('v', id % 500))) as t", "id % 5 as n", "'kept' as feature")
    bins = spark.range(150000).selectExpr("'x' as feature", "cast(null as string) as value", "if(id = 0, null, id / 100D) as lo", "if(id % 11 = 5, (id + 0.5D) / 100D, (id + 1) / 100D) as hi", "cast(id % 17 as double) as weighted_score")
    texts = spark.range(60000).selectExpr("'t' as feature", "if(id = 0, 'hot', if(id = 1, '__MISSING__', concat('v', id))) as value", "cast(null as double) as lo", "cast(null as double) as hi", "cast(id % 13 as double) + 0.5D as weighted_score")
    rules = bins.unionByName(texts)
    assert rules.count() > 200_000
    got = {r.user_id: r for r in s.apply_scorecard(df, rules).collect()}
    assert len(got) == 3000 and got[1].feature == "kept"
    for r in df.collect():
        want = 0.0
        if r.x is not None:
            k = min(int(r.x * 100 + 1e-9), 149999)
            k = next(j for j in (k + 1, k, k - 1) if (j == 0 or r.x >= j / 100))
            want += k % 17 if r.x < ((k + 0.5) / 100 if k % 11 == 5 else (k + 1) / 100) else 0
        if r.t == "hot":
            want += 0.5
        elif r.t is None:
            want += 1.5
        elif int(r.t[1:]) > 1:
            want += int(r.t[1:]) % 13 + 0.5
        assert abs(got[r.user_id].card_score - want) < 1e-9, r
    small = rules.where("(feature = 'x' and lo < 3) or (feature = 't' and weighted_score < 2 and length(value) < 4)").limit(1500)
    small = spark.createDataFrame(small.collect(), small.schema)
    a, b = s.apply_scorecard(df, small), s.join_scorecard(df, small)
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.user_id, round(r.card_score, 9)) for r in a.collect()) == sorted((r.user_id, round(r.card_score, 9)) for r in b.collect())


def test_tier_weights():
    got = s.card_features([f"f{i}" for i in range(40)])
    assert [w for _, _, w in got] == [1.0, 1.0, 0.8, 0.8, 0.6, 0.6, 0.4, 0.4]


def test_tree_rules(spark):
    rules = [s.TreeRule("1", 0.1, (("x", "<=", 1.0),)), s.TreeRule("2", 0.9, (("x", ">", 1.0), ("x", "<=", 5.0))), s.TreeRule("3", 0.9, (("x", ">", 4.0),))]
    df = spark.createDataFrame([(0.0, 0.1), (2.0, 0.9), (4.5, 0.9), (9.0, 0.5)], "x double, want double")
    scored = s.apply_tree(df, rules)
    assert rows(scored.select("x", "matched_rules")) == [(0.0, 1), (2.0, 1), (4.5, 2), (9.0, 1)]
    check = s.check_tree(scored, "want").first()
    assert (check.unmatched, check.multiple, check.mismatches, check.passed) == (0, 1, 1, False)


def test_bootstrap_and_strategy(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        data.append((i, y, round(y + rng.normal() * 0.2, 3), round(float(rng.normal()), 3)))
    df = spark.createDataFrame(data, "user_id bigint, label int, good double, noise double")
    got = s.bootstrap_difference(df, "user_id", "label", "good", "noise", rounds=60).first()
    assert got.ci_lower > 0.2 and got.rounds == 60
    again = s.bootstrap_difference(df, "user_id", "label", "good", "noise", rounds=60).first()
    assert got == again
    same = s.bootstrap_difference(df.withColumn("twin", F.col("good")), "user_id", "label", "good", "twin", rounds=20).first()
    assert same.difference == 0.0
    assert s.choose_strategy(df, "user_id", "label", "good", "noise", rounds=40)["strategy"] == "decision_tree"
    assert s.choose_strategy(df, "user_id", "label", "noise", "good", rounds=40)["strategy"] == "scorecard"


def test_strategy_takes_the_mix(spark):
    """Two scores with independent noise: neither wins clearly, their mean beats both."""
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.3).astype(int)
    data = [(i, int(v), round(float(v + rng.normal()), 2), round(float(v + rng.normal()), 2)) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "user_id bigint, label int, one double, two double")
    (got,) = s.strategy_report(df, "user_id", "label", [("one", "two")], rounds=60).collect()
    assert (got.strategy, got.reason, got.fusion_attempted) == ("fusion", "fusion_beats_both", True)
    assert 0.3 <= got.weight <= 0.7 and got.fusion_precision > max(got.tree_precision, got.card_precision) and min(got.over_tree_lower, got.over_card_lower) > 0


@pytest.mark.parametrize("n", [1, 7, 16, 40, 1000, 10**9])
def test_poisson_draws(spark, n):
    """Mean, variance and, where the count is small, each probability of a Poisson count of mean ``n``."""
    draws = spark.range(20000).select(s.drawn(F.lit(n).cast("long"), F.lit(42), F.col("id"), F.lit(3)).alias("w")).cache()
    w = draws.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - n) < 4 * math.sqrt(n / 20000) + 0.01 and abs(w[1] / n - 1) < 0.06
    if n <= 40:
        got = {r.w: r["count"] / 20000 for r in draws.groupBy("w").count().collect()}
        for k in range(3 * n):
            assert abs(got.get(k, 0.0) - math.exp(k * math.log(n) - n - math.lgamma(k + 1))) < 0.015


def test_bootstrap_by_brute_force(spark):
    """Each round by ranking all drawn rows; slices of the order change nothing."""
    rng = np.random.default_rng(12)
    data = [(i, int(rng.random() < 0.3), float(rng.integers(0, 40)), float(rng.integers(0, 6))) for i in range(500)]
    df = spark.createDataFrame(data, "user_id bigint, label int, a double, b double")
    cells = df.groupBy("a", "b", "label").agg(F.count("*").alias("n"), F.min("user_id").alias("name"))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("round")).withColumn("w", s.drawn(F.col("n"), F.lit(42), F.col("name"), F.col("round"))).toPandas()
    differences = []
    for _, part in drawn.groupby("round"):
        k, top = max(1, math.ceil(part["w"].sum() * 0.1)), []
        for score in ("a", "b"):
            left, hits = k, 0.0
            for _, tie in sorted(part.groupby(score), key=lambda x: -x[0]):
                n, pos = tie["w"].sum(), (tie["w"] * tie["label"]).sum()
                hits += pos * min(1, left / n) if n else 0
                left -= min(left, n)
            top.append(hits / k)
        differences.append(top[0] - top[1])
    got = s.bootstrap_difference(df, "user_id", "label", "a", "b", rounds=30).first()
    want = (np.mean(differences), *np.percentile(differences, [2.5, 97.5]))
    assert got.rounds == 30 and np.allclose((got.difference, got.ci_lower, got.ci_upper), want)


def test_aligned_scores(spark):
    a = frame(spark, [1, 0], [0.1, 0.2])
    b = frame(spark, [1, 1], [0.3, 0.4])
    _, gates = s.aligned_scores({"x": (a, "score"), "y": (b, "score")}, "user_id", "label")
    assert [r.labels_agree for r in gates.collect()] == [False, False] and all(r.same_users for r in gates.collect())


def test_models_and_surrogate(spark):
    df = features(spark)
    models, scored, auc = s.train_models(df, ["f_num"], ["f_cat"], "label", "split", max_iter=3)
    assert set(models) == {"boosted_trees", "logistic"} and all(r.auc > 0.6 for r in auc.collect())
    rules = s.surrogate_rules(scored, ["f_num"], "score", leaf_rows=20)
    applied = s.apply_tree(scored, rules)
    assert applied.where("matched_rules <> 1").count() == 0 and len({r.rule_id for r in rules}) == len(rules) <= 64


def test_doubtful_features():
    ranks = {f: i for i, f in enumerate("abcdefghij", 1)}
    assert s.doubtful_features(ranks, ["h", "i", "j"]) == []  # low as a group
    assert s.doubtful_features(ranks, ["b", "f", "g"]) == ["b"]  # those of the upper half
    assert s.doubtful_features(ranks, ["f", "g"]) == ["f", "g"]  # in the middle: all
    assert s.doubtful_features(ranks, []) == []


def test_feature_ab(spark):
    """A doubtful feature that carries the label wins over the kept one; a useless one does not."""
    rng = np.random.default_rng(9)
    y = (rng.random(600) < 0.4).astype(int)
    data = [(i, int(v), float(v * 0.3 + rng.normal()), float(v * 3 + rng.normal()), float(rng.normal()), "train" if i % 4 else "valid") for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "user_id bigint, label int, weak double, strong double, noise double, split string")

    def run(advice):
        report = spark.createDataFrame(advice, "feature string, recommendation string")
        return {(r.experiment, r.model): r for r in s.feature_ab(df, report, [], "label", "split", max_iter=3).collect()}

    got = run([("weak", "KEEP"), ("strong", "CONSIDER_DROP"), ("noise", "DROP")])
    assert got["B", "boosted_trees"].selected and not got["A", "boosted_trees"].selected and got["B", "boosted_trees"].features == ["strong", "weak"]
    assert got["B", "boosted_trees"].auc >= got["A", "boosted_trees"].auc + s.FEATURE_GAIN and got["B", "logistic"].auc > 0.9
    got = run([("strong", "KEEP"), ("noise", "CONSIDER_DROP")])
    assert got["A", "boosted_trees"].selected and got["A", "boosted_trees"].features == got["B", "boosted_trees"].features == ["strong"]
    with pytest.raises(ValueError):
        run([("noise", "DROP")])


def test_mutual_information(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2), float(i)) for i in range(200)], "label int, same double, other double")
    got = {r.feature: r.mutual_information for r in c.mutual_information(df, ["same", "other"], "label").collect()}
    assert abs(got["same"] - math.log(2)) < 1e-9 and got["other"] < 0.01


@pytest.mark.parametrize("bins", [3, 10])
def test_quantile_bins(spark, bins):
    xs = [float(x) for x in np.random.default_rng(2).integers(0, 40, 200)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    edges = sorted(set(np.percentile(xs, np.linspace(0, 100, bins + 1))))
    for r in c.quantile_bins(df, ["x"], bins).collect():
        want = -1 if r.x is None else np.searchsorted(edges[1:-1], r.x, side="right")
        assert r.x_bin == want


def test_cells_are_not_gathered_by_feature(spark):
    """Facts of a feature go to its cells: a shuffle by feature alone would put all values of a feature in one task."""
    df = spark.range(400).selectExpr("cast(id as double) AS f_num", "cast(id % 7 = 0 as int) AS label")
    cells = c.feature_cells(df, ["f_num"], "label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (c._numeric(cells, *c.class_totals(df, "label"), 10, 100), c._categorical(cells, *c.class_totals(df, "label"), 100)):
            assert "SortMergeJoin [feature#" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
