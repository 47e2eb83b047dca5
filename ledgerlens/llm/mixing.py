"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document gets an expected number of copies: in proportion to the square root of its size within its source, no more than
``cap``, so that the expected words of a source are its target. The whole part is taken for certain. The rest is an inclusion
probability p: documents are ranked by the odds of a hashed random number over the odds of p, and the smallest are taken until
the source's remaining words are reached; the document that crosses the line is taken if that comes nearer.

No source is ranked in one task: rank numbers fall into ``BUCKETS`` buckets whose sums are combined before the shuffle, and only the
bucket in which a source's line falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import hash_share, n_words, written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all sizes: 150 %
CAP = 2
BUCKETS = 1 << 16
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """Target of each source: ``source, source_size, target``.

    ``sizes`` has one row for each source. Sources in the order of their code points, null last, get the weights in turn. A target
    stops at ``cap`` times the source; what is over goes to the others by weight. Sources saturate in the order of
    size by weight, so one running sum finds the level. The windows run over one row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    )
    by_room = W.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    num, den = share
    level = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
    ).withColumn("open_size", F.lit(num) * F.col("all_size") - F.lit(den * cap) * F.col("full_size"))
    # the first source, in that order, that stays below its cap; all before it are full
    fits = F.col("open_size") * F.col("weight") <= F.lit(den * cap) * F.col("source_size") * F.col("open_weight")
    first = F.min(F.when(fits, F.col("place"))).over(everything)
    placed = level.withColumn("place", F.row_number().over(by_room)).withColumn("first", first)
    at_first = lambda name: F.max(F.when(F.col("place") == F.col("first"), F.col(name))).over(everything)
    return placed.select(
        "source",
        "source_size",
        "weight",
        F.when(
            F.col("place") >= F.col("first"),
            (at_first("open_size") * F.col("weight")).cast("double") / (F.lit(den) * at_first("open_weight")).cast("double"),
        )
        .otherwise((F.lit(cap) * F.col("source_size")).cast("double"))
        .alias("target"),
    )


def _expected(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Rows with the certain copies, the probability of one more, and the rank number."""
    plan = plan.withColumnRenamed("source", "_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.sqrt("size"), F.lit(float(cap))))
    )
    rows = rows.withColumn("expected", copies).withColumn("certain", F.floor("expected"))
    p = F.col("expected") - F.col("certain")
    odds = (F.col("share") / (1 - F.col("share"))) / (p / (1 - p))
    return rows.withColumn("rank", F.when(p > 0, odds)).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))


def mixing_plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: size, target, the level of expected copies and the place of its line.

    ``rows`` is a written table of ``doc_id, source, size, share``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    # the level: expected copies are level * sqrt(size), the largest documents stop at the cap
    cells = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    larger = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    own_on = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    cells = cells.select(
        F.col("source").alias("_source"),
        "size",
        F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0)).alias("full"),
        F.sum(F.col("n") * F.col("size") * F.sqrt("size")).over(own_on).alias("open"),
    )
    solved = targets.join(cells, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn(
        "try", (F.col("target") - F.lit(cap) * F.col("full")) / F.col("open")
    )
    levels = solved.groupBy("source", "source_size", "weight", "target").agg(
        F.max_by("try", F.when(F.col("try") * F.sqrt("size") <= cap, F.col("size"))).alias("level")
    )
    levels = written(levels, "mix-levels")
    ranked = _expected(rows, levels.select("source", "target", "level"), cap)
    parts = ranked.groupBy("source", "bucket").agg(
        F.sum(F.col("certain") * F.col("size")).alias("sure"), F.sum("size").alias("words"), F.max("target").alias("target")
    )
    by_bucket = W.partitionBy("source").orderBy(F.col("bucket").asc_nulls_first())
    parts = parts.select(
        "*",
        (F.col("target") - F.sum("sure").over(W.partitionBy("source"))).alias("room"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("words")).otherwise(0)).over(by_bucket).alias("reached"),
    )
    lines = parts.groupBy(F.col("source").alias("_source")).agg(
        F.max("room").alias("room"),
        F.min(F.when(F.col("reached") >= F.col("room"), F.col("bucket"))).alias("cut"),
        F.min(F.when(F.col("reached") >= F.col("room"), F.struct("bucket", (F.col("reached") - F.col("words")).alias("words"))))["words"].alias(
            "below"
        ),
    )
    lines = written(lines, "mix-lines")
    cut_rows = ranked.drop("target").join(
        lines, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("cut"))
    )
    upto = W.partitionBy("source").orderBy(F.struct("rank", "doc_id")).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("source", "rank", "doc_id")
    cut_rows = cut_rows.withColumn("upto", F.col("below") + F.sum("size").over(upto)).withColumn("before", F.col("upto") - F.sum("size").over(same))
    inside = (F.col("upto") <= F.col("room")) | (
        (F.col("before") < F.col("room")) & (F.col("upto") - F.col("room") <= F.col("room") - F.col("before"))
    )
    last = cut_rows.where(inside).groupBy(F.col("source").alias("_last_source")).agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    plan = (
        levels.join(lines, F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("_last_source")), "left")
        .select("source", "source_size", "weight", "target", "level", "cut", "last")
    )
    return written(plan, "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows (``doc_id, source, size, share`` and others) with ``source_size, target, copies``: no row is shuffled for it."""
    ranked = _expected(rows, plan, cap)
    extra = F.col("rank").isNotNull() & (
        F.col("cut").isNull()
        | (F.col("bucket") < F.col("cut"))
        | ((F.col("bucket") == F.col("cut")) & F.coalesce(F.struct("rank", "doc_id") <= F.col("last"), F.lit(False)))
    )
    keep = [c for c in rows.columns] + ["source_size", "target"]
    return ranked.select(*keep, (F.col("certain") + F.when(extra, 1).otherwise(0)).cast("int").alias("copies"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), hash_share(F.col("doc_id"), seed).alias("share")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs``.

    Null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, the last one. Repeated rows of
    one doc_id in one source are ranked together: all of them are taken once more or none is. Empty table: no rows. Columns
    other than doc_id, text and source are not looked at.
    """
    rows = written(sized(docs, seed), "mix-rows")
    done = with_copies(rows, mixing_plan(rows, weights, share, cap), cap)
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as it is taken, with their own columns."""
    rows = written(sized(docs, seed), "mix-rows")
    plan = mixing_plan(rows, weights, share, cap)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = named.select(
        "_row",
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.source").alias("source"),
        n_words(F.col("_row.text")).alias("size"),
        hash_share(F.col("_row.doc_id"), seed).alias("share"),
    )
    done = with_copies(keyed, plan, cap).where("copies > 0")
    return done.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
