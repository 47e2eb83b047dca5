"""Exact order statistics without pulling a whole group into one task.

Rows are first combined per distinct value, range-partitioned on (group, value) and written to the shared folder; per-slice
totals give each slice its offset, and windows run inside a slice only. Inputs of every size take this one form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage, written


def running_totals(cells: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False, whole: bool = False) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum) per group in the order of ``order``; with ``whole`` also ``all_<s>``, the group's total.

    ``cells`` holds one row per (by, order).
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    sliced = cut_lineage(
        cells.repartitionByRange(*[F.col(b) for b in by], direction).withColumn("_slice", F.spark_partition_id())
    )
    # one row per group and slice: bounded by groups + slices, whatever the data size
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    offsets = totals.select(
        *by, "_slice", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *([F.sum(f"_t_{s}").over(group).alias(f"all_{s}") for s in sums] if whole else []),
    )
    inside = W.partitionBy(*by, "_slice").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(s).over(inside).alias(f"_l_{s}") for s in sums])
    joined = join_nullsafe(local, offsets, [*by, "_slice"])
    return joined.select(*cells.columns, *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums], *([f"all_{s}" for s in sums] if whole else []))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles: rows (by…, prob, quantile); nulls are left out."""
    rows = df.where(F.col(value).isNotNull())
    levels = F.array(*[F.lit(float(p)) for p in probs])
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    cells = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(amount.alias("_n"))
    # the size comes with the slices' offsets: no join gathers a group's values in one task
    joined = running_totals(cells, by, "_v", ["_n"], whole=True).withColumnRenamed("all__n", "_size")
    # each wanted rank falls into one cell; keep the cells [cum - n, cum) that hold the whole rank below or above it
    def near(prob: Column) -> Column:
        rank = (F.col("_size") - 1) * prob
        return (F.col("cum__n") > rank) & (F.col("cum__n") - F.col("_n") - 1 < rank)

    # cells that hold no wanted rank leave before the levels multiply rows; one lambda, as code for all levels would be too long to be compiled
    few = joined.where(F.exists(levels, near))
    wanted = few.select(*by, "_v", "_n", "cum__n", "_size", F.explode(levels).alias("prob"))
    place = (F.col("_size") - 1) * F.col("prob")
    lower = F.floor(place)
    return (
        wanted.where(near(F.col("prob")))
        .groupBy(*by, "prob")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first(place - lower).alias("_f"))
        .select(*by, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
    )


def global_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[Column]:
    """Quantiles of the whole column as scalar expressions, usable in any other frame's plan."""
    q = exact_quantiles(df, [], value, probs)
    return [q.where(F.col("prob") == float(p)).select("quantile").scalar() for p in probs]


def hash_rank_select(df: DataFrame, by: list[str], key: str, keep: Column, small_width: int = 3) -> DataFrame:
    """Keep the first ``keep`` rows per group in md5 order of a unique key, without a window over the group.

    Rows fall into buckets by the leading hex digits of the hash (16**3 even buckets). Bucket counts give the bucket in
    which the cut lies; only that bucket is ranked. ``keep`` may use ``by`` columns and ``_size``, the rows of the group.
    """
    h = _hashed(df, key, small_width)
    joined = join_nullsafe(h, _kept_buckets(h, by, keep), [*by, "_b"])
    full = joined.where("_need >= _bn").select(*df.columns)
    rank = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    cut = joined.where("_need < _bn").withColumn("_rank", rank).where("_rank <= _need").select(*df.columns)
    return full.unionByName(cut)


def _hashed(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, width))


def _kept_buckets(h: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Buckets of which something is kept: their rows (``_bn``) and how many are still wanted (``_need``)."""
    counts = h.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    order = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    edges = counts.select(*by, "_b", "_bn", F.sum("_bn").over(order).alias("_bc"), F.sum("_bn").over(whole).alias("_size"))
    edges = edges.withColumn("_keep", keep).withColumn("_need", F.col("_keep") - (F.col("_bc") - F.col("_bn")))
    return edges.where("_need > 0").select(*by, "_b", "_bn", "_need")


def hash_rank_mark(df: DataFrame, by: list[str], key: str, keep: Column, out: str, small_width: int = 3) -> DataFrame:
    """All rows, with whether :func:`hash_rank_select` would keep them in ``out``; never for a key that is null.

    The buckets, and the kept keys of those in which a cut lies, are small written tables, so that whole rows meet them where they lie. ``df`` is read three
    times, twice for its keys only.
    """
    keys = _hashed(df.select(*dict.fromkeys([*by, key])), key, small_width)
    edges = written(_kept_buckets(keys, by, keep), "kept-buckets")
    rank = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    cut = join_nullsafe(keys, edges.where("_need < _bn"), [*by, "_b"]).withColumn("_rank", rank).where("_rank <= _need")
    cut = written(cut.select(F.col(key).alias("_cut")), "kept-keys")
    marked = join_nullsafe(_hashed(df, key, small_width), edges.where("_need >= _bn"), [*by, "_b"], "left").join(cut, F.col(key) == F.col("_cut"), "left")
    return marked.select(*df.columns, (F.col(key).isNotNull() & (F.col("_need").isNotNull() | F.col("_cut").isNotNull())).alias(out))
