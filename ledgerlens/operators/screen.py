"""Univariate screening: one unpivot of all features, one grouping, and everything else on the small result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import exact_quantiles
from ledgerlens.session import cut_lineage

CATEGORY_LIMIT = 100
BINS = 10
EDGE_GAP = 1e-8
EMPTY_SHARE = 0.001
MISSING_MAX, IV_MIN, PSI_MAX = 0.5, 0.02, 0.2


def feature_cells(df: DataFrame, features: list[str], label: str, split: str | None = None) -> DataFrame:
    """Counts per (feature, value): n, pos, neg. Null is a value of its own.

    With ``split`` those three count the train rows, beside n_train, n_valid and n_all.
    """
    base = [F.col(label).alias("_y")] + ([F.col(split).alias("_s")] if split else [])
    ids = ["_y"] + (["_s"] if split else [])
    long = df.select(*base, *[F.col(f).cast("string").alias(f) for f in features]).unpivot(ids, features, "feature", "value")
    counted = F.col("_s") == "train" if split else F.lit(True)
    aggs = [
        F.count_if(counted).alias("n"),
        F.count_if(counted & (F.col("_y") == 1)).alias("pos"),
        F.count_if(counted & (F.col("_y") == 0)).alias("neg"),
    ]
    if split:
        aggs += [F.count_if(counted).alias("n_train"), F.count_if(F.col("_s") == "valid").alias("n_valid"), F.count(F.lit(1)).alias("n_all")]
    return long.groupBy("feature", "value").agg(*aggs)


def feature_facts(cells: DataFrame) -> DataFrame:
    """Distinct values and missing rate (a fraction) per feature."""
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return cells.groupBy("feature").agg(F.count("value").alias("n_unique"), (missing / F.sum("n")).alias("missing_rate"))


def per_feature(facts: DataFrame) -> DataFrame:
    """Facts of one row a feature, to join with cells: they go to the cells, which stay dealt by (feature, value) and never gather by feature."""
    return F.broadcast(facts)


def class_totals(df: DataFrame, label: str) -> tuple[Column, Column]:
    """Positive and negative rows as scalar expressions."""
    row = df.agg(F.struct(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).alias("t")).scalar()
    return row.getField("p"), row.getField("n")


def group_statistics(cells: DataFrame, total_pos: Column, total_neg: Column) -> DataFrame:
    """Coverage of both classes, their ratio, positive rate, weight of evidence and its share of the information value."""
    pc = F.when(total_pos > 0, F.col("pos") / total_pos).otherwise(0.0)
    nc = F.when(total_neg > 0, F.col("neg") / total_neg).otherwise(0.0)
    out = cells.select(
        "feature", "value", F.col("n").alias("count"), F.col("pos").alias("count_pos"), F.col("neg").alias("count_neg"),
        pc.alias("pos_coverage"), nc.alias("neg_coverage"),
    )
    both = (F.col("pos_coverage") > 0) & (F.col("neg_coverage") > 0)
    woe = F.when(both, F.log(F.col("pos_coverage") / F.col("neg_coverage")))
    return (
        out.withColumn("ratio", F.when(F.col("neg_coverage") > 0, F.col("pos_coverage") / F.col("neg_coverage")))
        .withColumn("positive_rate", F.col("count_pos") / F.col("count"))
        .withColumn("woe", woe)
        .withColumn("iv_part", F.coalesce((F.col("pos_coverage") - F.col("neg_coverage")) * F.col("woe"), F.lit(0.0)))
    )


def categorical_screening(df: DataFrame, features: list[str], label: str, limit: int | None = None) -> DataFrame:
    """Group statistics per value of every feature; missing values are one row. With ``limit``, features of more values are left out."""
    return _categorical(feature_cells(df, features, label), *class_totals(df, label), limit)


def _categorical(cells: DataFrame, total_pos: Column, total_neg: Column, limit: int | None) -> DataFrame:
    if limit is not None:
        narrow = feature_facts(cells).where(F.col("n_unique") <= limit).select("feature")
        cells = cells.join(per_feature(narrow), "feature", "left_semi")
    stats = group_statistics(cells, total_pos, total_neg)
    return stats.withColumn("value", F.coalesce("value", F.lit("NULL")))


def quantile_edges(cells: DataFrame, bins: int = BINS, weight: str = "n") -> DataFrame:
    """Edges of equal-frequency bins per feature (linear percentiles), edges closer than 1e-8 merged."""
    numbers = cells.select("feature", F.expr("try_cast(value as double)").alias("x"), F.col(weight).alias("w")).where("x is not null and w > 0")
    q = exact_quantiles(numbers, ["feature"], "x", [i / bins for i in range(bins + 1)], "w")
    listed = q.groupBy("feature").agg(F.array_sort(F.collect_list("quantile")).alias("raw"))
    merged = F.aggregate(
        F.slice("raw", 2, bins + 1),
        F.slice("raw", 1, 1),
        lambda acc, e: F.when(e - F.element_at(acc, -1) > EDGE_GAP, F.concat(acc, F.array(e))).otherwise(acc),
    )
    edges = F.when(F.size(merged) == 1, F.concat(merged, F.slice("raw", -1, 1))).otherwise(merged)
    return listed.select("feature", edges.alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of inner edges at or below ``x``; null stays null."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e <= x)))


def binned_cells(cells: DataFrame, edges: DataFrame, sums: list[str]) -> DataFrame:
    """Cells of numeric features summed per bin; edges are one row per feature."""
    j = cells.join(per_feature(edges), "feature").withColumn("x", F.expr("try_cast(value as double)")).where("x is not null")
    return j.groupBy("feature", bin_of(F.col("x"), F.col("edges")).alias("bin")).agg(*[F.sum(s).alias(s) for s in sums])


def numeric_screening(df: DataFrame, features: list[str], label: str, bins: int = BINS, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Group statistics per quantile bin of every numeric feature with more than ``limit`` values."""
    return _numeric(cut_lineage(feature_cells(df, features, label)), *class_totals(df, label), bins, limit)


def _numeric(cells: DataFrame, total_pos: Column, total_neg: Column, bins: int, limit: int) -> DataFrame:
    wide = feature_facts(cells).where(F.col("n_unique") > limit).select("feature")
    kept = cells.join(per_feature(wide), "feature", "left_semi")
    binned = binned_cells(kept, quantile_edges(kept, bins), ["n", "pos", "neg"])
    named = binned.withColumn("value", F.concat(F.lit("bin_"), F.col("bin").cast("string")))
    return group_statistics(named, total_pos, total_neg)


def information_value(stats: DataFrame) -> DataFrame:
    """Information value per feature, never negative."""
    return stats.groupBy("feature").agg(F.greatest(F.sum("iv_part"), F.lit(0.0)).alias("iv"))


def population_stability(
    df: DataFrame, numeric: list[str], text: list[str], label: str, split: str, bins: int = BINS, limit: int | None = None
) -> DataFrame:
    """PSI between train and validation: shared quantile bins for numbers, values for text. With ``limit``, null for text of more values."""
    return _stability(feature_cells(df, numeric + text, label, split), numeric, text, bins, limit)


def _stability(all_cells: DataFrame, numeric: list[str], text: list[str], bins: int, limit: int | None = None) -> DataFrame:
    cells = all_cells.where("value is not null")
    numbers = cells.where(F.col("feature").isin(*numeric)) if numeric else cells.limit(0)
    words = cells.where(F.col("feature").isin(*text)) if text else cells.limit(0)
    binned = binned_cells(numbers, quantile_edges(numbers, bins, "n_all"), ["n_train", "n_valid"])
    groups = binned.select("feature", F.col("bin").cast("string").alias("value"), "n_train", "n_valid").unionByName(
        words.select("feature", "value", "n_train", "n_valid")
    )
    totals = groups.groupBy("feature").agg(F.sum("n_train").alias("_t"), F.sum("n_valid").alias("_v"), F.count(F.lit(1)).alias("_k"))
    j = groups.join(per_feature(totals), "feature")
    share = lambda n, total: F.when(F.col(n) == 0, EMPTY_SHARE).otherwise(F.col(n) / F.nullif(F.col(total), F.lit(0)))
    t, v = share("n_train", "_t"), share("n_valid", "_v")
    usable = (F.col("_t") > 0) & (F.col("_v") > 0)
    if limit is not None:
        usable &= (F.col("_k") <= limit) | ~F.col("feature").isin(*text, "")
    part = F.when(usable, (v - t) * F.log(v / t))
    return j.groupBy("feature").agg(F.sum(part).alias("psi"))


def recommend(facts: DataFrame) -> DataFrame:
    """DROP (missing above half, constant), CONSIDER_DROP (weak or unstable) or KEEP, with the reason."""
    rule = (
        F.when(F.col("missing_rate") > MISSING_MAX, "DROP")
        .when(F.col("n_unique") == 1, "DROP")
        .when(F.col("iv") < IV_MIN, "CONSIDER_DROP")
        .when(F.col("psi") > PSI_MAX, "CONSIDER_DROP")
        .otherwise("KEEP")
    )
    why = (
        F.when(F.col("missing_rate") > MISSING_MAX, "missing_rate")
        .when(F.col("n_unique") == 1, "constant")
        .when(F.col("iv") < IV_MIN, "weak")
        .when(F.col("psi") > PSI_MAX, "unstable")
        .otherwise("")
    )
    return facts.withColumn("recommendation", rule).withColumn("reason", why)


def screening_report(df: DataFrame, numeric: list[str], text: list[str], label: str, split: str) -> DataFrame:
    """Facts, information value, stability and advice per feature; statistics come from the train rows.

    Numbers of more than 100 values are judged by quantile bins, all other features by their values, however many.
    The rows are read once: all of it derives from one written table of counts per value.
    """
    cells = cut_lineage(feature_cells(df, numeric + text, label, split))
    train = cells.where("n > 0")
    total_pos, total_neg = class_totals(df.where(F.col(split) == "train"), label)
    facts = feature_facts(train)
    numbers, words = train.where(F.col("feature").isin(*numeric)), train.where(~F.col("feature").isin(*numeric))
    iv = information_value(
        _categorical(numbers, total_pos, total_neg, CATEGORY_LIMIT)
        .unionByName(_categorical(words, total_pos, total_neg, None))
        .unionByName(_numeric(numbers, total_pos, total_neg, BINS, CATEGORY_LIMIT))
    )
    psi = _stability(cells, numeric, text, BINS)
    return recommend(facts.join(iv, "feature", "left").join(psi, "feature", "left"))


def keep_features(df: DataFrame, report: DataFrame, always: list[str]) -> DataFrame:
    """The frame without the features marked DROP; the report has one row per feature."""
    dropped = {r.feature for r in report.where("recommendation = 'DROP'").select("feature").collect()}
    return df.select(*[c for c in df.columns if c in always or c not in dropped])


def quantile_bins(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """Every numeric feature as ``<name>_bin``: quantile bin, -1 for missing; features with 10 values or less stay numbers."""
    cells = feature_cells(df.withColumn("_label", F.lit(0)), features, "_label")
    filled = cells.where("value is not null").groupBy("feature").agg(F.sum("n").alias("filled"))
    rows = quantile_edges(cells, bins).join(filled, "feature").collect()
    out = []
    for r in rows:
        x = F.col(r.feature).cast("double")
        if r.filled <= 10:
            out.append(F.coalesce(x, F.lit(-1.0)).alias(f"{r.feature}_bin"))
        else:
            edges = F.array(*[F.lit(float(e)) for e in r.edges])
            out.append(F.coalesce(bin_of(x, edges).cast("double"), F.lit(-1.0)).alias(f"{r.feature}_bin"))
    return df.select("*", *out)


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = BINS) -> DataFrame:
    """Mutual information (nats) between each binned feature and the label, missing counted as 0."""
    filled = df.select(F.col(label), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    cells = feature_cells(filled, features, label)
    binned = binned_cells(cells, quantile_edges(cells, bins), ["pos", "neg"])
    joint = binned.unpivot(["feature", "bin"], ["pos", "neg"], "y", "n")
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = by_y.groupBy("feature").agg(F.sum("ny").alias("t"))
    j = joint.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature").where("n > 0")
    p = F.col("n") / F.col("t")
    return j.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mutual_information"))


def variance_ranking(df: DataFrame, features: list[str]) -> DataFrame:
    """Sample variance per feature, one pass."""
    return df.agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features]).unpivot([], features, "feature", "variance")


def leakage_check(df: DataFrame, feature_time: str, label_time: str) -> DataFrame:
    """Rows whose feature time lies after the label time."""
    late = F.col(feature_time) > F.col(label_time)
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(late).alias("leaking_rows"))
    return out.withColumn("passed", F.col("leaking_rows") == 0)
