"""Evaluation of query results: comparison, votes, run overlays and accuracy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_DIGITS = 6

# Categories a retry may select, in the order they are tested.
RETRY_CATEGORIES = ("deferred", "agent_error", "incorrect")


def _normal(df: DataFrame) -> list[Column]:
    """Columns by position, numbers with a fraction rounded; names do not matter for equality."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), FLOAT_DIGITS) + 0.0
        out.append(c.alias(f"_{i}"))
    return out


def compare_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset and set equality of two results in one grouping: floats count to 6 digits, row order does not.

    Rows are counted per side before they meet, so repeated rows travel once.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError("the results have different numbers of columns")
    a = left.select(*_normal(left), F.lit(1).alias("_side"))
    b = right.select(*_normal(right), F.lit(-1).alias("_side"))
    cols = [c for c in a.columns if c != "_side"]
    seen = a.unionAll(b).groupBy(*cols).agg(F.count_if(F.col("_side") == 1).alias("l"), F.count_if(F.col("_side") == -1).alias("r"))
    surplus = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    out = seen.agg(
        surplus("l", "r").alias("only_left"), surplus("r", "l").alias("only_right"),
        F.count_if((F.col("l") > 0) != (F.col("r") > 0)).alias("distinct_off"),
    )
    return out.select(
        "only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("multiset_equal"), (F.col("distinct_off") == 0).alias("set_equal")
    )


def result_fingerprints(rows: DataFrame, candidate: str, columns: list[str]) -> DataFrame:
    """One fingerprint per candidate for its set of result rows, without gathering the rows: hashes of distinct rows combined."""
    distinct = rows.select(candidate, *columns).distinct()
    packed = F.struct(*columns)
    return distinct.groupBy(candidate).agg(
        F.concat_ws(
            "-", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(F.xxhash64(packed, F.lit(1)))), F.hex(F.bit_xor(F.xxhash64(packed, F.lit(2))))
        ).alias("fingerprint")
    )


def vote(candidates: DataFrame, fingerprints: DataFrame, candidate: str, sql: str, group: list[str]) -> DataFrame:
    """Per group the result most candidates agree on; of its candidates the one with the shortest statement, then the first id.

    Ties between results go to the first id.
    """
    j = candidates.join(fingerprints, candidate)
    per_result = j.groupBy(*group, "fingerprint").agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct(F.length(sql).alias("size"), F.col(candidate).alias("winner"))).alias("b"), F.min(candidate).alias("_first")
    )
    best = per_result.groupBy(*group).agg(F.max_by(F.struct("votes", "b"), F.struct("votes", -F.col("_first"))).alias("w"))
    return best.select(*group, F.col("w.votes").alias("votes"), F.col("w.b.winner").alias("winner"))


def reconcile_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables that share a unique key, side by side: their types, how many rows and values each side has, and on how many keys they differ.

    One full join on the key and one aggregate over it. Status: in one table only, other type, other values, or the same. Values are compared as text, null like a value; rows
    whose key is on one side only count in ``left_keys`` and ``right_keys``. Rows without a key are left out.
    """
    types = {side: {f.name: f.dataType.simpleString() for f in df.schema.fields} for side, df in (("left", left), ("right", right))}
    names = sorted(types["left"].keys() | types["right"].keys())
    packed = lambda df, side: df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), F.struct(*[(F.col(c).cast("string") if c in types[side] else F.lit(None).cast("string")).alias(c) for c in names]).alias(side)
    )
    both = packed(left, "left").join(packed(right, "right"), "_key", "full")
    facts = [F.count_if(F.col("left").isNotNull() & F.col("right").isNull()).alias("left_keys"), F.count_if(F.col("left").isNull() & F.col("right").isNotNull()).alias("right_keys")]
    for c in names:
        l, r = F.col(f"left.`{c}`"), F.col(f"right.`{c}`")  # noqa: E741
        met = F.col("left").isNotNull() & F.col("right").isNotNull()
        facts.append(F.struct(F.count(l).alias("left_values"), F.count(r).alias("right_values"), F.count_if(met & ~l.eqNullSafe(r)).alias("differing")).alias(f"_{c}"))
    each = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types["left"].get(c)).cast("string").alias("left_type"), F.lit(types["right"].get(c)).cast("string").alias("right_type"), F.col(f"`_{c}`").alias("f"))
        for c in names
    ])
    out = both.agg(*facts).select("left_keys", "right_keys", F.explode(each).alias("c")).select("c.column_name", "c.left_type", "c.right_type", "c.f.*", "left_keys", "right_keys")
    shared = F.col("left_type").isNotNull() & F.col("right_type").isNotNull()
    status = (
        F.when(F.col("left_type").isNull(), "right_only").when(F.col("right_type").isNull(), "left_only").when(F.col("left_type") != F.col("right_type"), "type_differs")
        .when(F.col("differing") > 0, "values_differ").otherwise("same")
    )
    return out.withColumn("differing", F.when(shared, F.col("differing"))).withColumn("status", status)


def accuracy_table(rows: DataFrame) -> DataFrame:
    """Accuracy over scored rows and averages over all rows, per mode and per mode and difficulty, from one expansion."""
    both = rows.withColumn("level", F.explode(F.array(F.lit("overall"), F.coalesce(F.nullif(F.trim("difficulty"), F.lit("")), F.lit("unknown")))))
    out = both.groupBy("mode", "level").agg(
        F.count(F.lit(1)).alias("questions"), F.count("correct").alias("scored"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"),
        F.avg("tool_calls").alias("avg_tools"), F.avg("tokens").alias("avg_tokens"), F.avg("duration_ms").alias("avg_ms"),
    )
    return out.withColumn("accuracy", F.when(F.col("scored") > 0, F.col("correct") / F.col("scored")).otherwise(0.0))


def relative_change(table: DataFrame, first: str, second: str, measures: list[str]) -> DataFrame:
    """Percentage change of each measure of mode ``first`` against ``second``, level by level."""
    pick = lambda mode, m: F.max(F.when(F.col("mode") == mode, F.col(m)))
    wide = table.groupBy("level").agg(*[pick(first, m).alias(f"{m}_{first}") for m in measures], *[pick(second, m).alias(f"{m}_{second}") for m in measures])
    changes = [
        F.when(F.col(f"{m}_{second}") != 0, (F.col(f"{m}_{first}") - F.col(f"{m}_{second}")) / F.col(f"{m}_{second}") * 100).alias(f"{m}_change_pct") for m in measures
    ]
    return wide.select("*", *changes)


def result_summary(rows: DataFrame, by: list[str], selected: DataFrame | None = None) -> DataFrame:
    """Selected, completed, predicted, correct, errors, deferred and failed; selected is the denominator of accuracy."""
    deferred = F.coalesce(F.col("deferred"), F.lit(False))
    right = F.coalesce(F.col("correct"), F.lit(False))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.coalesce(F.col("predicted_sql") != "", F.lit(False))).alias("predicted"),
        F.count_if(right).alias("correct"),
        F.count_if(F.coalesce(F.col("error") != "", F.lit(False)) & ~deferred).alias("agent_error"),
        F.count_if(deferred).alias("deferred"),
        F.count_if(~right).alias("failed"),
    )
    if selected is not None:
        out = out.join(selected, by)
    else:
        out = out.withColumn("selected", F.col("completed"))
    return out.withColumn("accuracy", F.when(F.col("selected") > 0, F.col("correct") / F.col("selected")).otherwise(0.0))


def retry_selection(rows: DataFrame, categories: tuple[str, ...] = ("deferred", "agent_error")) -> DataFrame:
    """Rows to run again, by category; incorrect answers only when asked for."""
    unknown = set(categories) - set(RETRY_CATEGORIES)
    if unknown:
        raise ValueError(f"unknown retry categories: {sorted(unknown)}")
    category = (
        F.when(F.coalesce(F.col("deferred"), F.lit(False)), "deferred")
        .when(F.coalesce(F.col("error") != "", F.lit(False)), "agent_error")
        .when(~F.coalesce(F.col("correct"), F.lit(False)), "incorrect")
    )
    return rows.withColumn("category", category).where(F.col("category").isin(*categories))


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs side by side by case: improved, regressed, same, or in one run only."""
    a = left.select(*keys, F.col("correct").alias("left_correct"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("correct").alias("right_correct"), F.lit(True).alias("_r"))
    j = a.join(b, keys, "full")
    was, now = F.coalesce("left_correct", F.lit(False)), F.coalesce("right_correct", F.lit(False))
    change = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
        .when(~was & now, "improved").when(was & ~now, "regressed").otherwise("same")
    )
    return j.select(*keys, "left_correct", "right_correct", change.alias("change"))


def overlay_retry(initial: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """The retried row replaces the first one even when it is worse; ``effective_attempt`` tells which one counts."""
    values = [c for c in initial.columns if c not in keys]
    again = retry.select(*keys, F.struct(*values).alias("_retry"))
    j = initial.select(*keys, F.struct(*values).alias("_first")).join(again, keys, "left")
    use = F.when(F.col("_retry").isNotNull(), F.col("_retry")).otherwise(F.col("_first"))
    return j.select(*keys, *[use.getField(c).alias(c) for c in values], F.when(F.col("_retry").isNotNull(), 2).otherwise(1).alias("effective_attempt"))


def chained_votes(frames: dict[str, DataFrame]) -> DataFrame:
    """Candidate results of different statements stacked with their candidate id."""
    return reduce(DataFrame.unionByName, [df.withColumn("candidate", F.lit(n)) for n, df in frames.items()])
