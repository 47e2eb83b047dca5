"""Ranking metrics, scorecards, rule sets, fusion and batch scoring.

Metrics work on one row per distinct score, with running totals from ``ordering.running_totals``; no window runs over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import stable_half
from ledgerlens.operators.ordering import join_nullsafe, running_totals
from ledgerlens.operators.screen import bin_of, feature_cells, quantile_edges
from ledgerlens.operators.sequences import carried
from ledgerlens.session import cut_lineage

TOP_SHARES = [0.01, 0.05, 0.10, 0.20, 0.30, 0.50]
PRIMARY_SHARE = 0.10
ROUNDS = 500
CONFIDENCE = 0.95
MIN_UPLIFT = 0.02
#: AUC that a larger feature set must gain; doubtful features ranking lower than this share of all, as a group, are not tried.
FEATURE_GAIN, LOW_PLACES = 0.001, 0.7
WEIGHTS = [round(0.05 * i, 2) for i in range(1, 20)]
CARD_SHARE = 0.20
CARD_SCALE, CARD_LIMIT, CARD_BINS = 10.0, 30.0, 5
MISSING = "__MISSING__"
#: Rules that a plan holds as literals; a larger card is joined.
PLAN_RULES = 2_000
SCORE_TOLERANCE = 0.001

# Weight of a feature by its place in the importance order.
TIERS = [(0.05, 1.0), (0.10, 0.8), (0.15, 0.6), (0.20, 0.4)]


def score_cells(df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Rows and positives per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))


def _descending(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with totals of their group and running sums from the greatest score down."""
    ranked = running_totals(cells, by, "score", ["n", "pos"], descending=True)
    totals = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))
    if by:
        return join_nullsafe(ranked, totals, by)
    t = totals.select(F.struct("total", "total_pos").alias("t")).scalar()
    return ranked.select("*", t.getField("total").alias("total"), t.getField("total_pos").alias("total_pos"))


def ranking_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """AUC by average ranks, area under precision and recall (trapezoid, from precision 1) and the KS distance."""
    by = by or []
    c = _descending(score_cells(df, by, score, label), by)
    neg, total_neg = F.col("n") - F.col("pos"), F.col("total") - F.col("total_pos")
    # rows ranked below a cell, plus half the cell, give the average rank of its rows
    below = F.col("total") - F.col("cum_n")
    rank_sum = F.sum(F.col("pos") * (below + (F.col("n") + 1) / 2))
    before_pos, before_n = F.col("cum_pos") - F.col("pos"), F.col("cum_n") - F.col("n")
    precision = F.col("cum_pos") / F.col("cum_n")
    earlier = F.when(before_n > 0, before_pos / F.nullif(before_n, F.lit(0))).otherwise(1.0)
    area = F.sum(F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * (precision + earlier) / 2)
    gap = F.max(
        F.abs(F.col("cum_pos") / F.nullif(F.col("total_pos"), F.lit(0)) - (F.col("cum_n") - F.col("cum_pos")) / F.nullif(total_neg, F.lit(0)))
    )
    agg = c.groupBy(*by).agg(
        F.first("total").alias("n_rows"), F.first("total_pos").alias("n_positive"), rank_sum.alias("_ranks"), area.alias("pr_auc"), gap.alias("ks"), F.sum(neg).alias("_neg")
    )
    pairs = F.col("n_positive") * F.col("_neg")
    auc = (F.col("_ranks") - F.col("n_positive") * (F.col("n_positive") + 1) / 2) / F.nullif(pairs, F.lit(0))
    return agg.select(*by, "n_rows", "n_positive", auc.alias("auc"), "pr_auc", "ks")


def tie_aware_top_k(
    df: DataFrame, score: str, label: str, shares: list[float], by: list[str] | None = None, weight: str | None = None, floor: bool = False
) -> DataFrame:
    """Precision, recall, lift and hits among the best share of rows; a tie at the cut counts with its average hit rate."""
    by = by or []
    c = _descending(score_cells(df, by, score, label, weight), by)
    levels = c.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    k = F.floor(F.col("total") * F.col("share")) if floor else F.ceil(F.col("total") * F.col("share"))
    levels = levels.withColumn("k", F.greatest(F.lit(1), k))
    # exactly one cell holds the k-th row
    edge = levels.where((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
    slots = F.col("k") - (F.col("cum_n") - F.col("n"))
    hits = (F.col("cum_pos") - F.col("pos")) + slots * F.col("pos") / F.col("n")
    out = edge.select(
        *by, "share", F.col("k").cast("bigint").alias("selected"), F.col("score").alias("threshold"), F.col("n").cast("bigint").alias("tied"),
        slots.cast("bigint").alias("slots"), hits.alias("hits"), "total", "total_pos",
    )
    recall = F.col("hits") / F.nullif(F.col("total_pos"), F.lit(0))
    precision = F.col("hits") / F.col("selected")
    return out.select(
        *by, "share", "selected", "threshold", "tied", "slots", "hits", precision.alias("precision"), recall.alias("recall"),
        (precision / F.nullif(F.col("total_pos") / F.col("total"), F.lit(0.0))).alias("lift"), (F.col("selected") / F.col("total")).alias("coverage"),
    )


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, rank): the average rank of every distinct value."""
    cells = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, [], "value", ["n"])
    return ranked.select("value", "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rank correlation with average ranks; 0 when a column is constant."""
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c, out: running_totals(pairs.groupBy(c).agg(F.sum("n").alias("m")), [], c, ["m"]).select(
        c, (F.col("cum_m") - (F.col("m") - 1) / 2).alias(out)
    )
    j = pairs.join(rank("l", "lr"), "l").join(rank("r", "rr"), "r")
    middle = pairs.agg(((F.sum("n") + 1) / 2).alias("m")).scalar()
    a, b = F.col("lr") - middle, F.col("rr") - middle
    sums = j.agg(F.sum(F.col("n") * a * b).alias("ab"), F.sum(F.col("n") * a * a).alias("aa"), F.sum(F.col("n") * b * b).alias("bb"), F.sum("n").alias("n_rows"))
    return sums.select("n_rows", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).otherwise(0.0).alias("spearman"))


def score_profile(df: DataFrame, score: str) -> DataFrame:
    """Distinct scores and the largest tie."""
    cells = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    out = cells.agg(F.count(F.lit(1)).alias("score_unique"), F.max("n").alias("largest_tie"), F.sum("n").alias("n_rows"))
    return out.withColumn("largest_tie_rate", F.col("largest_tie") / F.col("n_rows"))


def risk_flags(profile: DataFrame, teacher_spearman: Column, auc_gap: Column, rules: int, spearman_min: float = 0.8) -> DataFrame:
    """Comma-joined warnings about a candidate score."""
    flags = F.concat_ws(
        ",",
        F.when(teacher_spearman < spearman_min, "low_teacher_spearman"),
        F.when(F.abs(auc_gap) > 0.05, "large_auc_gap"),
        F.when(F.lit(rules) > 5000, "high_rule_count"),
        F.when(F.col("largest_tie_rate") > 0.5, "high_score_tie_rate"),
    )
    return profile.withColumn("risk_flags", flags)


def aligned_scores(frames: dict[str, tuple[DataFrame, str]], user: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Score files of the same users joined one to one, and the gates: equal row counts, unique users, equal labels."""
    joined, gates = None, []
    for name, (df, score) in frames.items():
        side = df.select(F.col(user).cast("string").alias("user_id"), F.col(label).alias(f"label_{name}"), F.col(score).cast("double").alias(name))
        per_user = side.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        facts = per_user.agg(F.sum("n").alias("n_rows"), F.count("user_id").alias("n_users"), F.max("n").alias("most"))
        gates.append(facts.select(F.lit(name).alias("source"), "n_rows", "n_users", (F.col("most") == 1).alias("unique_users")))
        joined = side if joined is None else joined.join(side, "user_id", "inner")
    labels = [f"label_{n}" for n in frames]
    same = reduce(lambda a, b: a & b, [F.col(labels[0]) == F.col(x) for x in labels[1:]], F.lit(True))
    n = joined.agg(F.struct(F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("same")).alias("s")).scalar()
    checked = reduce(DataFrame.unionByName, gates).select(
        "*", n.getField("n").alias("aligned_rows"), n.getField("same").alias("labels_agree"), (F.col("n_rows") == n.getField("n")).alias("same_users")
    )
    out = joined.select("user_id", F.col(labels[0]).cast("int").alias("label"), *frames)
    return out, checked


def scored_list(df: DataFrame, user: str, score: str) -> DataFrame:
    """Users with score and rank (rows with a greater score plus one), sorted over the whole population."""
    cells = df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, [], "score", ["n"], descending=True).select("score", (F.col("cum_n") - F.col("n") + 1).alias("score_rank"))
    out = df.select(F.col(user), F.col(score).alias("score")).join(ranked, "score")
    return out.select(user, "score", "score_rank").orderBy(F.col("score").desc(), F.col(user))


def card_features(importance: list[str]) -> list[tuple[str, int, float]]:
    """(feature, rank, weight) of the top fifth of an importance order."""
    total = len(importance)
    out = []
    for rank, feature in enumerate(importance[: math.ceil(total * CARD_SHARE)], 1):
        weight = next(w for share, w in TIERS if rank <= math.ceil(total * share))
        out.append((feature, rank, weight))
    return out


def build_scorecard(df: DataFrame, importance: list[str], text: list[str], label: str) -> DataFrame:
    """Rules of the top features: quantile bins with real edges for numbers, values for text.

    A rule scores ``10 * ln(rate / base rate)`` between -30 and 30, times the weight of its feature. ``lo`` is inclusive,
    ``hi`` exclusive; the outer bins are open.
    """
    chosen = card_features(importance)
    features = [f for f, _, _ in chosen]
    numeric = [f for f in features if f not in text]
    cells = feature_cells(df, features, label)
    spark = df.sparkSession
    weights = spark.createDataFrame(chosen, "feature string, rank int, weight double")
    base = df.agg(F.avg(F.col(label)).alias("b")).scalar()
    words = cells.where(~F.col("feature").isin(*numeric, "")).select(
        "feature", F.coalesce("value", F.lit(MISSING)).alias("value"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "n", "pos", "neg"
    )
    numbers = cells.where(F.col("feature").isin(*numeric, "") & F.col("value").isNotNull())
    edges = quantile_edges(numbers, CARD_BINS)
    j = numbers.join(edges, "feature").withColumn("x", F.expr("try_cast(value as double)"))
    b = bin_of(F.col("x"), F.col("edges"))
    last = F.size("edges") - 2
    lo = F.when(F.col("bin") > 0, F.try_element_at("edges", F.col("bin") + 1))
    hi = F.when(F.col("bin") < last, F.try_element_at("edges", F.col("bin") + 2))
    binned = j.withColumn("bin", b).select("feature", F.lit(None).cast("string").alias("value"), lo.alias("lo"), hi.alias("hi"), "n", "pos", "neg")
    groups = binned.groupBy("feature", "value", "lo", "hi").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).unionByName(words)
    rate = F.col("pos") / F.col("n")
    raw = (
        F.when(rate >= 1, CARD_LIMIT)
        .when((rate > 0) & (base > 0), F.greatest(F.lit(-CARD_LIMIT), F.least(F.lit(CARD_LIMIT), F.log(rate / base) * CARD_SCALE)))
        .otherwise(-CARD_LIMIT)
    )
    rules = groups.join(weights, "feature").withColumn("raw_score", F.round(raw, 4))
    return rules.select(
        "feature", "rank", "value", "lo", "hi", "raw_score", "weight", F.round(F.col("raw_score") * F.col("weight"), 4).alias("weighted_score"),
        F.round(rate, 6).alias("pos_rate"), F.col("n").alias("sample_count"), F.col("pos").alias("pos_count"), F.col("neg").alias("neg_count"),
    )


def apply_scorecard(df: DataFrame, rules: DataFrame, out: str = "card_score") -> DataFrame:
    """Add the summed score of the matching rules. Bins of a feature must not overlap.

    A card of at most ``PLAN_RULES`` rules becomes lookups of the plan, row by row and without a shuffle. A larger one is joined, with the same result: see ``join_scorecard``.
    """
    rows = rules.select("feature", "value", "lo", "hi", "weighted_score").limit(PLAN_RULES + 1).collect()
    if len(rows) > PLAN_RULES:
        return join_scorecard(df, rules, out)
    parts = []
    for feature in sorted({r.feature for r in rows}):
        mine = [r for r in rows if r.feature == feature]
        texts = [r for r in mine if r.value is not None]
        bins = sorted((r for r in mine if r.value is None), key=lambda r: -math.inf if r.lo is None else r.lo)
        if texts:
            lookup = F.create_map(*[F.lit(x) for r in texts for x in (r.value, float(r.weighted_score))])
            parts.append(F.coalesce(F.try_element_at(lookup, F.coalesce(F.col(feature).cast("string"), F.lit(MISSING))), F.lit(0.0)))
        if bins:
            x = F.col(feature).cast("double")
            # rows are matched by interval, so a bin that held no training row scores 0
            score = F.coalesce(
                *[
                    F.when(
                        (F.lit(True) if r.lo is None else x >= F.lit(float(r.lo))) & (F.lit(True) if r.hi is None else x < F.lit(float(r.hi))),
                        F.lit(float(r.weighted_score)),
                    )
                    for r in bins
                ],
                F.lit(0.0),
            )
            parts.append(F.when(x.isNotNull(), score).otherwise(0.0))
    total = F.aggregate(F.array(*parts), F.lit(0.0), lambda a, b: a + b) if parts else F.lit(0.0)
    return df.withColumn(out, total)


def join_scorecard(df: DataFrame, rules: DataFrame, out: str = "card_score") -> DataFrame:
    """The same by joins, for a card of any size: nothing of it reaches the driver but the names of its features.

    Values are unpivoted per distinct (feature, value) and counted rules are looked up once for each of them. Bins: values and lower bounds stand in one order, and the last bound
    at or before a value gives its bin (``carried``), no pair of value and bin is made. Texts: an equi-join on distinct values, so a text that many rows hold is joined once. The scores go
    back to the rows on (feature, value), salted by row.
    """
    named = [r.feature for r in rules.select("feature").distinct().collect()]  # columns of the table
    features = [c for c in df.columns if c in named]
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("text"), F.expr(f"try_cast(`{c}` AS double)").alias("x")) for c in features])).alias("v"))
    long = long.select("_row", "v.*").withColumn("salt", F.pmod("_row", F.lit(salts)))
    seen = cut_lineage(long.groupBy("feature", "text", "x", "salt").agg(F.count(F.lit(1)).alias("_n")))
    values = seen.select("feature", "text", "x").distinct()

    score = F.col("weighted_score").cast("double")
    bins = rules.where("value IS NULL").select("feature", F.coalesce(F.col("lo").cast("double"), F.lit(-math.inf)).alias("at"), F.lit(0).alias("side"), F.struct(F.col("hi").cast("double").alias("hi"), score.alias("score")).alias("bin"))
    points = values.where("x IS NOT NULL").select("feature", F.col("x").alias("at"), F.lit(1).alias("side")).distinct().withColumn("bin", F.lit(None).cast(bins.schema["bin"].dataType))
    met = carried(bins.unionByName(points), ["feature"], ["at", "side"], {"found": ("last", "bin")}).where("side = 1")
    met = met.select("feature", F.col("at").alias("x"), F.when(F.col("found.hi").isNull() | (F.col("at") < F.col("found.hi")), F.col("found.score")).alias("by_bin"))
    texts = rules.where("value IS NOT NULL").groupBy("feature", "value").agg(F.max_by(score, score).alias("by_text"))
    scored = join_nullsafe(values, met, ["feature", "x"], "left")
    scored = scored.withColumn("value", F.coalesce("text", F.lit(MISSING))).join(texts, ["feature", "value"], "left")
    scored = scored.select("feature", "text", "x", (F.coalesce("by_bin", F.lit(0.0)) + F.coalesce("by_text", F.lit(0.0))).alias("score")).where("score <> 0")
    spread = join_nullsafe(seen.select("feature", "text", "x", "salt"), scored, ["feature", "text", "x"])
    total = join_nullsafe(long, spread, ["feature", "text", "x", "salt"]).groupBy("_row").agg(F.sum("score").alias("_total"))
    done = rows.join(total, "_row", "left")
    return done.select(*df.columns, F.coalesce("_total", F.lit(0.0)).alias(out))


@dataclass(frozen=True)
class TreeRule:
    """One leaf: a score and the conditions (feature, '<=' or '>', threshold) that lead to it."""

    rule_id: str
    score: float
    atoms: tuple[tuple[str, str, float], ...]


def _holds(rule: TreeRule) -> Column:
    tests = [(F.col(f) <= t) if op == "<=" else (F.col(f) > t) for f, op, t in rule.atoms]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def apply_tree(df: DataFrame, rules: list[TreeRule], out: str = "tree_score") -> DataFrame:
    """Add the leaf score and the number of rules that match; row by row. Missing features must be coded before."""
    distinct = list({(r.atoms, r.score): r for r in rules}.values())
    matches = F.aggregate(F.array(*[_holds(r).cast("int") for r in distinct]), F.lit(0), lambda a, b: a + b)
    score = F.coalesce(*[F.when(_holds(r), F.lit(r.score)) for r in distinct])
    return df.select("*", score.alias(out), matches.alias("matched_rules"))


def check_tree(scored: DataFrame, exported: str, out: str = "tree_score", tolerance: float = SCORE_TOLERANCE) -> DataFrame:
    """Rows without a rule, with several, and rows whose score differs from the exported one."""
    off = F.abs(F.coalesce(F.col(out), F.lit(0.0)) - F.col(exported))
    agg = scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("matched_rules") == 0).alias("unmatched"),
        F.count_if(F.col("matched_rules") > 1).alias("multiple"),
        F.count_if(off > tolerance).alias("mismatches"),
        F.max(off).alias("max_difference"),
    )
    return agg.withColumn("passed", (F.col("unmatched") == 0) & (F.col("multiple") == 0) & (F.col("mismatches") == 0))


# Cumulative probabilities of a Poisson count with mean 1, up to the point where doubles reach 1.
POISSON_ONE = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(16)]


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an md5: the same in every run and every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _poisson_one(u: Column) -> Column:
    count = F.when(u < POISSON_ONE[0], 0)
    for k, p in enumerate(POISSON_ONE[1:], 1):
        count = count.when(u < p, k)
    return count.otherwise(len(POISSON_ONE))


def drawn(n: Column, *key: Column) -> Column:
    """Poisson count of mean ``n``: how often ``n`` equal rows are drawn together in a resample.

    The remainder of ``n`` by 16 is a sum of single draws. The rest is one normal draw with the skew of a Poisson count (its distribution is off by
    0.001 at most), so that a cell of any size costs at most 17 numbers.
    """
    # each number is bound once, however many branches look at it
    numbers = F.transform(F.when(n % 16 > 0, F.sequence(F.lit(1), (n % 16).cast("int"))).otherwise(F.array().cast("array<int>")), lambda j: _uniform(*key, j))
    few = F.aggregate(numbers, F.lit(0), lambda total, u: total + _poisson_one(u))
    mean = n - n % 16
    normal = F.sqrt(-2 * F.log(_uniform(*key, F.lit("a")))) * F.cos(2 * math.pi * _uniform(*key, F.lit("b")))
    many = F.transform(F.array(normal), lambda z: F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1) / 6 + 0.5)))[0]
    return F.when(n >= 16, few + many).otherwise(few).cast("long")


def bootstrap_difference(
    df: DataFrame, user: str, label: str, first: str, second: str, rounds: int = ROUNDS, share: float = PRIMARY_SHARE, seed: int = 42
) -> DataFrame:
    """Difference of precision at the top share between two scores: mean and interval over resampled rounds.

    Rows with the same scores and label are one cell, and a round draws for each cell how often its rows are taken, hashed from (cell, round): the distributed form of drawing with
    replacement, so both scores see the same sample. Rounds with one class only are left out.

    Rows are never copied for a round. A first pass sums the draws of slices of each score's order, where they are made; from these each round knows the slice that its top
    share ends in, and a second pass draws again for the cells of that slice alone.
    """
    cells = df.groupBy(F.col(first).cast("double").alias("x0"), F.col(second).cast("double").alias("x1"), F.col(label).cast("long").alias("y"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.min(user).alias("name"))
    slices = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in (0, 1):  # the slice of a score's order that a cell lies in
        cells = cut_lineage(cells.repartitionByRange(slices, F.col(f"x{k}").desc_nulls_last()).withColumn(f"slice{k}", F.spark_partition_id()))
    draw = drawn(F.col("n"), F.lit(seed), F.col("name"), F.col("round"))
    places = F.array(*[F.struct(F.lit(k).alias("which"), F.col(f"slice{k}").alias("slice"), F.col(f"x{k}").alias("score")) for k in (0, 1)])

    every = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", draw)
    sums = every.select("round", "w", "y", F.explode(places).alias("p")).groupBy("round", "p.which", "p.slice")
    sums = sums.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    upto = W.partitionBy("round", "which").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("round", "which")
    sums = sums.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in ("n", "pos")], *[F.sum(c).over(whole).alias(f"total_{c}") for c in ("n", "pos")])
    k = F.greatest(F.lit(1), F.ceil(F.col("total_n") * share))
    ends = sums.where("total_pos > 0 and total_pos < total_n").withColumn("k", k).where("cum_n >= k and cum_n - n < k")
    # what the slices before took of the round's top share
    ends = cut_lineage(ends.select("round", "which", "slice", "k", (F.col("cum_n") - F.col("n")).alias("before"), (F.col("cum_pos") - F.col("pos")).alias("hits")))

    near = cells.select("n", "name", "y", F.explode(places).alias("p")).select("n", "name", "y", "p.*").join(ends, ["which", "slice"])
    near = near.withColumn("w", draw).groupBy("round", "which", "score", "k", "before", "hits").agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    upto = W.partitionBy("round", "which").orderBy(F.col("score").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    near = near.select("*", (F.col("before") + F.sum("c").over(upto)).alias("cum_n"), (F.col("hits") + F.sum("pos").over(upto)).alias("cum_pos"))
    edge = near.where("cum_n >= k and cum_n - c < k")
    taken = (F.col("cum_pos") - F.col("pos")) + (F.col("k") - F.col("cum_n") + F.col("c")) * F.col("pos") / F.col("c")
    per_round = edge.groupBy("round").agg(F.sum(F.when(F.col("which") == 0, taken / F.col("k")).otherwise(-taken / F.col("k"))).alias("d"))
    tail = (1 - CONFIDENCE) / 2
    return per_round.agg(
        F.avg("d").alias("difference"), F.percentile("d", tail).alias("ci_lower"), F.percentile("d", 1 - tail).alias("ci_upper"), F.count(F.lit(1)).alias("rounds")
    )


def fusion_grid(df: DataFrame, user: str, label: str, tree: str, card: str, share: float = PRIMARY_SHARE) -> DataFrame:
    """Precision of z-score mixes of two scores for 19 weights, on the half they are fitted on and on the other half.

    ``selected`` marks the best fitted weight; among equals the smallest.
    """
    halves = df.select(user, label, tree, card, stable_half(F.col(user)).alias("half"))
    fit = halves.where("half = 0")
    f = fit.agg(
        F.struct(F.avg(tree).alias("tm"), F.stddev_pop(tree).alias("ts"), F.avg(card).alias("cm"), F.stddev_pop(card).alias("cs")).alias("f")
    ).scalar().getField
    unit = lambda s: F.when(s > 0, s).otherwise(1.0)
    tz, cz = (F.col(tree) - f("tm")) / unit(f("ts")), (F.col(card) - f("cm")) / unit(f("cs"))
    # both scores have few distinct values together, so rows are combined before the weights multiply them
    cells = halves.groupBy("half", tree, card).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    cells = cells.select("half", tz.alias("tz"), cz.alias("cz"), "n", "p")
    mixed = cells.select("half", "tz", "cz", "n", "p", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])).alias("tree_weight"))
    fused = mixed.withColumn("score", F.round(F.col("tree_weight") * F.col("tz") + (1 - F.col("tree_weight")) * F.col("cz"), 9))
    grouped = fused.groupBy("half", "tree_weight", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("pos"))
    c = _descending(grouped, ["half", "tree_weight"])
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * share))
    edge = c.withColumn("k", k).where((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
    hits = (F.col("cum_pos") - F.col("pos")) + (F.col("k") - F.col("cum_n") + F.col("n")) * F.col("pos") / F.col("n")
    p = edge.select("half", "tree_weight", (hits / F.col("k")).alias("p"))
    grid = p.groupBy("tree_weight").agg(
        F.max(F.when(F.col("half") == 0, F.col("p"))).alias("fit_precision"), F.max(F.when(F.col("half") == 1, F.col("p"))).alias("eval_precision")
    )
    best = grid.agg(F.max_by("tree_weight", F.struct("fit_precision", -F.col("tree_weight"))).alias("b")).scalar()
    return grid.withColumn("selected", F.col("tree_weight") == best)


def choose_strategy(df: DataFrame, user: str, label: str, tree: str, card: str, rounds: int = ROUNDS, share: float = PRIMARY_SHARE) -> dict:
    """Tree, scorecard or their mix: a clear winner of the paired comparison, else the mix when it beats both on unseen rows.

    The mix is only tried when neither score wins clearly. Evidence that was not needed is None.
    """

    def precision(frame: DataFrame, s: str) -> float:
        return float(tie_aware_top_k(frame, s, label, [share]).first().precision)

    def uplift(new: float, old: float) -> float:
        return (new - old) / max(abs(old), 1e-12)

    compared = bootstrap_difference(df, user, label, tree, card, rounds, share).first()
    tp, cp = precision(df, tree), precision(df, card)
    evidence = {
        "tree_precision": tp, "card_precision": cp, "ci_lower": compared.ci_lower, "ci_upper": compared.ci_upper,
        "fusion_attempted": False, "fusion_precision": None, "over_tree_lower": None, "over_card_lower": None,
    }
    if compared.ci_lower > 0 and uplift(tp, cp) >= MIN_UPLIFT:
        return {"strategy": "decision_tree", "reason": "one_strategy_significantly_better", "weight": 1.0} | evidence
    if compared.ci_upper < 0 and uplift(cp, tp) >= MIN_UPLIFT:
        return {"strategy": "scorecard", "reason": "one_strategy_significantly_better", "weight": 0.0} | evidence
    weight = fusion_grid(df, user, label, tree, card, share).where("selected").first().tree_weight
    halves = df.withColumn("half", stable_half(F.col(user)))
    f = halves.where("half = 0").agg(F.avg(tree).alias("tm"), F.stddev_pop(tree).alias("ts"), F.avg(card).alias("cm"), F.stddev_pop(card).alias("cs")).first()
    tz, cz = (F.col(tree) - f.tm) / (f.ts or 1.0), (F.col(card) - f.cm) / (f.cs or 1.0)
    judged = halves.where("half = 1").withColumn("fused", F.round(weight * tz + (1 - weight) * cz, 9))
    over_tree = bootstrap_difference(judged, user, label, "fused", tree, rounds, share, seed=43).first()
    over_card = bootstrap_difference(judged, user, label, "fused", card, rounds, share, seed=44).first()
    fp, etp, ecp = precision(judged, "fused"), precision(judged, tree), precision(judged, card)
    evidence |= {"fusion_attempted": True, "fusion_precision": fp, "over_tree_lower": over_tree.ci_lower, "over_card_lower": over_card.ci_lower}
    if over_tree.ci_lower > 0 and over_card.ci_lower > 0 and uplift(fp, etp) >= MIN_UPLIFT and uplift(fp, ecp) >= MIN_UPLIFT:
        return {"strategy": "fusion", "reason": "fusion_beats_both", "weight": weight} | evidence
    return {"strategy": "decision_tree" if tp >= cp else "scorecard", "reason": "no_significant_difference", "weight": 1.0 if tp >= cp else 0.0} | evidence


def strategy_report(df: DataFrame, user: str, label: str, pairs: Sequence[tuple[str, str]], rounds: int = ROUNDS, share: float = PRIMARY_SHARE) -> DataFrame:
    """One row per pair of scores (tree, card): the chosen strategy, why, the tree's weight and the evidence."""
    schema = """tree string, card string, strategy string, reason string, weight double, tree_precision double, card_precision double, ci_lower double, ci_upper double,
        fusion_attempted boolean, fusion_precision double, over_tree_lower double, over_card_lower double"""
    rows = [{"tree": a, "card": b} | choose_strategy(df, user, label, a, b, rounds, share) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, schema)


MODELS = ("boosted_trees", "logistic")


def train_models(df: DataFrame, numeric: list[str], text: list[str], label: str, split: str, max_iter: int = 20, wanted: Sequence[str] = MODELS):
    """Boosted trees and a logistic baseline (or one of them) with class weights, fitted on train rows; returns models, scored rows, AUC rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train = df.where(F.col(split) == "train")
    balance = train.agg(F.struct(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).alias("c")).first().c
    weight = balance.n / max(balance.p, 1)
    filled = lambda f: f.fillna(-1.0, subset=numeric).fillna("missing", subset=text).withColumn(
        "_w", F.when(F.col(label) == 1, weight).otherwise(1.0)
    )
    coded = [f"{c}_code" for c in text]
    prepare = [StringIndexer(inputCols=text, outputCols=coded, handleInvalid="keep")] if text else []
    prepare.append(VectorAssembler(inputCols=numeric + coded, outputCol="_features"))
    kinds = {
        "boosted_trees": GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_w", maxIter=max_iter, maxDepth=4, maxBins=64, seed=42),
        "logistic": LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w", maxIter=50, standardization=True),
    }
    models, rows = {}, []
    scored = filled(df)
    for name, estimator in ((k, kinds[k]) for k in wanted):
        model = Pipeline(stages=[*prepare, estimator]).fit(filled(train))
        models[name] = model
        out = model.transform(filled(df)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
        rows.append(ranking_metrics(out.where(F.col(split) == "valid"), "score", label).select(F.lit(name).alias("model"), "n_rows", "n_positive", "auc", "pr_auc", "ks"))
        if name == "boosted_trees":
            scored = out.select(*df.columns, "score")
    return models, scored, reduce(DataFrame.unionByName, rows)


def importance_ranks(model, numeric: list[str], text: list[str]) -> dict[str, int]:
    """Place of each feature by its share of the boosted trees' gain; equal shares by name."""
    gains = dict(zip([*numeric, *text], model.stages[-1].featureImportances.toArray(), strict=True))
    return {f: i for i, f in enumerate(sorted(gains, key=lambda f: (-gains[f], f)), 1)}


def doubtful_features(ranks: dict[str, int], doubtful: list[str]) -> list[str]:
    """Features the screening doubts that are worth a try: none when they rank low as a group, else those of the upper half, else all."""
    places = sorted(ranks[f] for f in doubtful)
    if not places or median(places) > LOW_PLACES * len(ranks):
        return []
    upper = [f for f in doubtful if ranks[f] <= 0.5 * len(ranks)]
    return upper or list(doubtful)


def feature_ab(
    df: DataFrame, report: DataFrame, text: list[str], label: str, split: str, least_gain: float = FEATURE_GAIN, max_iter: int = 20
) -> DataFrame:
    """Boosted trees on the features that the screening keeps (A) against those and the doubtful ones of use (B), and a logistic baseline on the set that wins.

    A model on all features not dropped ranks them; :func:`doubtful_features` picks. B wins when its AUC on the validation rows is at least ``least_gain`` above
    A's, or when no feature is kept. Rows (experiment, model, n_features, features, auc, selected). Equal sets are fitted once.
    """
    advice = {r.feature: r.recommendation for r in report.select("feature", "recommendation").collect()}
    kept, doubtful = (sorted(f for f, r in advice.items() if r == kind) for kind in ("KEEP", "CONSIDER_DROP"))
    if not kept and not doubtful:
        raise ValueError("the screening dropped every feature")
    fitted: dict[tuple[str, ...], tuple[dict[str, int], float]] = {}

    def parts(features: list[str]) -> tuple[list[str], list[str]]:
        return [f for f in features if f not in text], [f for f in features if f in text]

    def fit(features: list[str]) -> tuple[dict[str, int], float]:
        key = tuple(sorted(features))
        if key not in fitted:
            models, _, metrics = train_models(df, *parts(key), label, split, max_iter, MODELS[:1])
            fitted[key] = importance_ranks(models["boosted_trees"], *parts(key)), metrics.first().auc
        return fitted[key]

    chosen = doubtful_features(fit(kept + doubtful)[0], doubtful) if doubtful else []
    sets = {"A": kept, "B": sorted(kept + chosen) or doubtful}
    auc = {k: fit(v)[1] if v else None for k, v in sets.items()}
    winner = "B" if auc["A"] is None or auc["B"] >= auc["A"] + least_gain else "A"
    rows = [(k, "boosted_trees", len(sets[k]), sets[k], auc[k], k == winner) for k in ("A", "B")]
    baseline = train_models(df, *parts(sets[winner]), label, split, max_iter, MODELS[1:])[2].first().auc
    rows.append((winner, "logistic", len(sets[winner]), sets[winner], baseline, False))
    return df.sparkSession.createDataFrame(rows, "experiment string, model string, n_features int, features array<string>, auc double, selected boolean")


def surrogate_rules(scored: DataFrame, features: list[str], score: str, depth: int = 6, leaf_rows: int = 50) -> list[TreeRule]:
    """A shallow regression tree on the score, as leaf rules; every leaf once. A tree of depth 6 has at most 64 leaves."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    data = VectorAssembler(inputCols=features, outputCol="_features").transform(scored.fillna(-1.0, subset=features))
    model = DecisionTreeRegressor(featuresCol="_features", labelCol=score, maxDepth=depth, minInstancesPerNode=leaf_rows, seed=42).fit(data)
    rules: list[TreeRule] = []

    def walk(node, atoms):
        if node.numDescendants() == 0:
            rules.append(TreeRule(f"R{len(rules) + 1}", round(float(node.prediction()), 3), tuple(atoms)))
            return
        name, cut = features[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), [*atoms, (name, "<=", cut)])
        walk(node.rightChild(), [*atoms, (name, ">", cut)])

    walk(model._java_obj.rootNode() if hasattr(model, "_java_obj") else model._call_java("rootNode"), [])
    return rules
