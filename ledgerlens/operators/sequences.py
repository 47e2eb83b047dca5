"""Ordered computations per key that also hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import join_nullsafe
from ledgerlens.session import cut_lineage


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(ts.cast("timestamp"))


def carried(df: DataFrame, keys: list[str], order: list[str], running: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Add running columns ``{out: (kind, column)}`` over the rows of each key in ``order``.

    Kinds: ``sum``, ``count`` (non-null rows), ``max``, ``last`` (latest non-null value); ``inclusive=False`` leaves the row itself out of these.
    ``previous`` and ``next`` are the nearest non-null values before and after the row. Null keys are a key.

    A prefix scan in two passes: rows are range-partitioned on (keys, order) and written, windows run inside a slice of a key, and each slice hands one row of state to the others of its
    key. A key that holds any share of the rows spreads over as many tasks as its rows fill.
    """
    sliced = cut_lineage(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_slice", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    slices = W.partitionBy(*keys).orderBy("_slice")
    upto = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before, after = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(1, W.unboundedFollowing)
    earlier, later = slices.rowsBetween(W.unboundedPreceding, -1), slices.rowsBetween(1, W.unboundedFollowing)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    nothing = lambda now, carry: F.coalesce(now, F.lit(0)) + F.coalesce(carry, F.lit(0))
    # of each kind: inside the slice, the state of a slice, the state carried to it, and both as one
    kinds = {
        "sum": (lambda c: F.sum(c).over(upto), lambda c: F.sum(c), lambda c: F.sum(c).over(earlier), nothing),
        "count": (lambda c: F.count(c).over(upto), lambda c: F.count(c), lambda c: F.sum(c).over(earlier), nothing),
        "max": (lambda c: F.max(c).over(upto), lambda c: F.max(c), lambda c: F.max(c).over(earlier), F.greatest),
        "last": (lambda c: F.last(c, True).over(upto), lambda c: F.max_by(c, known(c)), lambda c: F.last(c, True).over(earlier), F.coalesce),
        "previous": (lambda c: F.last(c, True).over(before), lambda c: F.max_by(c, known(c)), lambda c: F.last(c, True).over(earlier), F.coalesce),
        "next": (lambda c: F.first(c, True).over(after), lambda c: F.min_by(c, known(c)), lambda c: F.first(c, True).over(later), F.coalesce),
    }
    summary = sliced.groupBy(*keys, "_slice").agg(*[kinds[k][1](c).alias(f"_f_{o}") for o, (k, c) in running.items()])
    state = summary.select(*keys, "_slice", *[kinds[k][2](f"_f_{o}").alias(f"_c_{o}") for o, (k, _) in running.items()])
    rows = sliced.select("*", *[kinds[k][0](c).alias(f"_w_{o}") for o, (k, c) in running.items()])
    joined = join_nullsafe(rows, state, [*keys, "_slice"])
    return joined.select(*df.columns, *[kinds[k][3](F.col(f"_w_{o}"), F.col(f"_c_{o}")).alias(o) for o, (k, _) in running.items()])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key: an aggregate, so rows of a hot key combine before the shuffle."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns if c not in keys])


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, take: list[str]
) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time (ties: greatest ``take``).

    Both sides are stacked and the latest right row is carried forward; there is no pairwise join.
    """
    l_cols = [c for c in left.columns if c not in keys]
    # rows of the right side first at equal time, in the order of their values
    payload = F.struct(F.col(right_ts).alias("_rts"), *take)
    r = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), payload.alias("_hit"), F.lit(None).cast(_struct_type(left, l_cols)).alias("_row")
    )
    l = left.select(  # noqa: E741
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"), F.struct(*l_cols).alias("_row")
    )
    both = r.unionByName(l).withColumn("_tie", F.col("_hit"))
    filled = carried(both, keys, ["_ts", "_side", "_tie"], {"_found": ("last", "_hit")})
    return filled.where("_side = 1").select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in l_cols], F.col("_found._rts").alias(f"matched_{right_ts}"), *[F.col(f"_found.{c}").alias(f"matched_{c}") for c in take]
    )


def _struct_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType
