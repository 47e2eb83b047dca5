"""Cohorts and training sets over event tables: T0 windows, pools, labels, hash-ordered samples and projections."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import in_label_window, in_lookback, present, through
from ledgerlens.operators.ordering import hash_rank_mark, hash_rank_select
from ledgerlens.session import cut_lineage

REGULAR_MIN = 500
NEGATIVES_PER_POSITIVE = 4
POSITIVE_SHARE = (0.2, 0.3)
SHRINK_MAX = 0.5


@dataclass(frozen=True)
class SamplingPlan:
    """What one sampling run needs to know about an event table."""

    user: str
    ts: str
    t0: str
    label_days: int
    lookback_days: int
    positive: Column
    scope: Column = field(default_factory=lambda: F.lit(True))

    def users(self, events: DataFrame, *conditions: Column) -> DataFrame:
        """Distinct users with a valid key whose rows meet every condition."""
        rule = reduce(lambda a, b: a & b, conditions, present(F.col(self.user)))
        return events.where(rule).select(F.col(self.user).alias("user_key")).distinct()

    @property
    def label_window(self) -> Column:
        return in_label_window(F.col(self.ts), self.t0, self.label_days)

    @property
    def lookback(self) -> Column:
        return in_lookback(F.col(self.ts), self.t0, self.lookback_days)

    @property
    def through_t0(self) -> Column:
        return through(F.col(self.ts), self.t0)


def probe_positives(events: DataFrame, plan: SamplingPlan, regular_min: int = REGULAR_MIN) -> DataFrame:
    """Positive users in the label window, all users of the scope in it as a check, and the mode they allow."""
    rows = events.where(present(F.col(plan.user)) & plan.label_window & plan.scope)
    per_user = rows.groupBy(plan.user).agg(F.max(plan.positive.cast("int")).alias("p"))
    out = per_user.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positive_users"), F.count(F.lit(1)).alias("loose_users"))
    return out.withColumn("mode", F.when(F.col("positive_users") >= regular_min, "regular").otherwise("cold_start"))


def positives(events: DataFrame, plan: SamplingPlan) -> DataFrame:
    """Users that convert inside the label window."""
    return plan.users(events, plan.scope, plan.positive, plan.label_window)


def candidate_pool(events: DataFrame, plan: SamplingPlan) -> DataFrame:
    """Users active in the lookback who had not converted by T0."""
    active = plan.users(events, plan.lookback)
    converted = plan.users(events, plan.scope, plan.positive, plan.through_t0)
    return active.join(converted, "user_key", "left_anti")


def label(
    events: DataFrame, plan: SamplingPlan, how: str = "any", value: str | None = None, threshold: float = 1, after: Column | None = None
) -> DataFrame:
    """Labels of one family: ``any`` row (install, pay, booking, click, browse), ``days`` or ``sum`` at a threshold, or the
    ``amount`` itself (regression)."""
    rows = events.where(present(F.col(plan.user)) & plan.scope & plan.positive & plan.label_window)
    if after is not None:
        rows = rows.where(after)
    key = F.col(plan.user).alias("user_key")
    if how == "any":
        return rows.select(key).distinct().withColumn("label_value", F.lit(1.0))
    if how == "days":
        days = rows.select(key, F.to_date(plan.ts).alias("d")).distinct().groupBy("user_key").agg(F.count(F.lit(1)).cast("double").alias("label_value"))
        return days.where(F.col("label_value") >= threshold)
    total = rows.groupBy(key).agg(F.sum(value).alias("label_value"))
    return total if how == "amount" else total.where(F.col("label_value") >= threshold)


def exposure_conversion(
    exposures: DataFrame, downstream: DataFrame, user: str, item: str, ts: str, in_window: Column, converted: Column
) -> DataFrame:
    """Users with a downstream row after an exposure to the same item, both inside the window.

    A pair exists exactly when the first exposure precedes the last conversion, so both sides shrink to one row per user and
    item before they meet.
    """
    first = exposures.where(in_window & present(F.col(user))).groupBy(user, item).agg(F.min(ts).alias("_first"))
    last = downstream.where(in_window & converted & present(F.col(user))).groupBy(user, item).agg(F.max(ts).alias("_last"))
    return first.join(last, [user, item]).where("_last > _first").select(F.col(user).alias("user_key")).distinct()


def negative_pools(
    events: DataFrame, users: DataFrame, plan: SamplingPlan, exposed: Column, pay: Column, mismatch: Column | None = None, which: tuple[str, ...] = ("N1", "N2", "N3", "N4", "N5", "N6")
) -> DataFrame:
    """Negative populations, tagged: N1 candidates, N2 exposed, N3 most active, N4 payers, N5 everyone, N6 other interests.

    Positive users are in none of them. ``users`` holds ``user_key`` and the attributes ``mismatch`` reads.
    """
    from ledgerlens.operators.features import high_activity

    pos = positives(events, plan)
    pools = {}
    if "N1" in which:
        pools["N1"] = candidate_pool(events, plan)
    if "N2" in which:
        pools["N2"] = plan.users(events, plan.label_window, exposed)
    if "N3" in which:
        busy = high_activity(events.where(plan.lookback & present(F.col(plan.user))), plan.user).select(F.col(plan.user).alias("user_key"))
        touched = plan.users(events, plan.scope, plan.label_window)
        pools["N3"] = busy.join(touched, "user_key", "left_anti")
    if "N4" in which:
        pools["N4"] = plan.users(events, pay)
    if "N5" in which:
        pools["N5"] = users.where(present(F.col("user_key"))).select("user_key").distinct()
    if "N6" in which and mismatch is not None:
        pools["N6"] = users.where(present(F.col("user_key")) & mismatch).select("user_key").distinct()
    tagged = [df.join(pos, "user_key", "left_anti").select(F.lit(name).alias("population"), "user_key") for name, df in pools.items()]
    return reduce(DataFrame.unionByName, tagged)


def _hash_first(df: DataFrame, keep: Column) -> DataFrame:
    return hash_rank_select(df, [], "user_key", keep)


def draw_training_set(pos: DataFrame, negatives: DataFrame, sample_size: int) -> DataFrame:
    """(user_key, label): at most a fifth positives, four negatives each, in hash order; a positive always wins.

    Negative users are distinct before the draw, so overlapping pools keep the ratio.
    """
    # both user lists are read several times below; writing them once is cheaper than deriving them again
    pos = cut_lineage(pos.select("user_key").distinct())
    chosen = _hash_first(pos, F.lit(sample_size // (NEGATIVES_PER_POSITIVE + 1)))
    wanted = chosen.agg((F.count(F.lit(1)) * NEGATIVES_PER_POSITIVE).alias("n")).scalar()
    pool = cut_lineage(negatives.select("user_key").distinct().join(pos, "user_key", "left_anti"))
    drawn = _hash_first(pool, wanted)
    both = chosen.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
    return resolve_labels(both)


def resolve_labels(df: DataFrame) -> DataFrame:
    """One row per user; the greatest label wins."""
    return df.groupBy("user_key").agg(F.max("label").alias("label"))


def draw_prelabelled(users: DataFrame, key: str, label_column: str, sample_size: int) -> DataFrame:
    """Training set from a label column holding 1 and 0."""
    keyed = users.where(present(F.col(key))).select(F.col(key).alias("user_key"), F.col(label_column).cast("string").alias("l"))
    return draw_training_set(keyed.where("l = '1'"), keyed.where("l = '0'"), sample_size)


def project(table: DataFrame, sample: DataFrame, kind: str, key: str | None = None, item: tuple[str, str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """One source table cut down to a sample.

    ``user_table``: one row per sampled user with its label; ``user_keyed``: all rows of sampled users; ``item_keyed``: rows of
    one item; ``catalog``: copied whole.
    """
    from ledgerlens.operators.warehouse import one_per_key

    if kind == "catalog":
        return table
    if kind == "item_keyed":
        column, value = item
        return table.where(F.col(column) == value)
    valid = table.where(present(F.col(key)))
    text = F.col(key).cast("string")
    if kind == "user_keyed":
        return valid.join(sample.select(F.col("user_key").cast("string").alias("_u")), text == F.col("_u"), "left_semi")
    labelled = valid.join(sample.select(F.col("user_key").cast("string").alias("_u"), "label"), text == F.col("_u"), "inner").drop("_u")
    return one_per_key(labelled, [key], tie or [c for c in table.columns if c != key])


def projection_gate(source: DataFrame, projected: DataFrame, sample: DataFrame, key: str, name: str) -> DataFrame:
    """Users and rows before and after a projection, and the rules: no user outside the sample, rows at most half."""
    facts = lambda df: df.agg(F.countDistinct(F.col(key).cast("string")).alias("u"), F.count(F.lit(1)).alias("n"))
    src = facts(source)
    n_src = src.select("n").scalar()
    n_sample = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    outside = (
        projected.select(F.col(key).cast("string").alias("_u")).distinct()
        .join(sample.select(F.col("user_key").cast("string").alias("_u")), "_u", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    out = facts(projected).select(
        F.lit(name).alias("table_name"), n_sample.alias("sampled_users"), F.col("u").alias("users_out"), outside.alias("users_outside"),
        n_src.alias("source_rows"), F.col("n").alias("rows_out"),
    )
    shrink = F.when(F.col("source_rows") > 0, F.col("rows_out") / F.col("source_rows")).otherwise(0.0)
    return out.withColumn("shrink", shrink).withColumn(
        "passed", (F.col("users_outside") == 0) & (F.col("users_out") <= F.col("sampled_users")) & (F.col("shrink") <= SHRINK_MAX)
    )


def sample_statistics(sample: DataFrame) -> DataFrame:
    """Users, classes and whether the positive to negative ratio lies in the agreed band."""
    out = sample.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.countDistinct("user_key").alias("n_unique"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"),
    )
    ratio = F.when(F.col("n_negative") > 0, F.col("n_positive") / F.col("n_negative"))
    return out.withColumn("ratio", ratio).withColumn("ratio_ok", F.coalesce(ratio.between(*POSITIVE_SHARE), F.lit(False)))


def stratified_split(df: DataFrame, key: str, label_column: str, share: float = 0.8) -> DataFrame:
    """Add ``split`` train or valid: per class the first ``int(share * n)`` keys in hash order are train."""
    marked = hash_rank_mark(df, [label_column], key, F.floor(F.col("_size") * share), "_train")
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("valid")).drop("_train")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found in both frames; must be none for train and validation."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("shared_keys"))


def similar_items(items: DataFrame, key: str, attribute: str, target: str) -> DataFrame:
    """Items that share the target's attribute, the target left out. The target side is one item's attributes."""
    wanted = items.where(F.col(key) == target).select(F.col(attribute).alias("_a")).distinct()
    return items.where(F.col(key) != target).join(wanted, F.col(attribute) == F.col("_a"), "left_semi")
