"""What five document filters remove, alone and in each order, by the potential of their removal game.

The filters are players; a coalition's worth is the number of documents that fail at least one of its filters. Documents are read once and
counted by the set of filters that they fail, so that a part is 32 counts, however many documents it holds. From these come the worths of the 32 coalitions,
and from the worths the Hart-Mas-Colell potential: P(none) = 0 and |S| P(S) = worth(S) + the potentials of S without one of its filters, in
ascending order of coalitions. A filter's Shapley value is P(all) - P(all but it). The steps of an order are differences of worths.

Whole numbers throughout: 60 P(S) is whole, since P(S) is a sum of whole numbers over the sizes 1 to 5.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: The copy filter's bit.
COPY = 1 << FILTERS.index("E")
#: Least common multiple of the coalition sizes.
WHOLE = 60


def failed_alone(text: Column) -> Column:
    """The filters that a text (not null) fails by itself, as bits: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    failing = (
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and the set of filters that they fail: ``part, failed, n, good, toxic``; at most 32 rows a part.

    Texts are equal by their SHA-256. Rows are combined by (text, part, labels) before texts meet, so that copies, however many, are a few rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = written(rows.select("id", "part", failed_alone(F.col("text")).alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")

    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    marked = rows.where("id IS NOT NULL").join(marks, F.col("id") == F.col("_id"), "left")
    kind = ["digest", "failed", "part", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic")]
    each = marked.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))  # rows that repeat a doc_id
    groups = each.groupBy("digest", "failed", "part", "good", "toxic").agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("n"))
    # one row a text, part and label: the text's first document fails no copy filter
    groups = groups.withColumn("first", F.min("least.id").over(W.partitionBy("digest")))
    groups = groups.withColumn("own", F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0)))
    cells = groups.select(
        "part",
        "good",
        "toxic",
        F.explode(F.array(F.struct("failed", F.col("own").alias("n")), F.struct((F.col("failed") + COPY).alias("failed"), (F.col("n") - F.col("own")).alias("n")))).alias("c"),
    ).select("part", "c.failed", "c.n", "good", "toxic")
    nameless = rows.where("id IS NULL").groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.unionByName(nameless.withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    return cells.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))).alias("toxic"),
    )


def _worths(cells: str, of: str) -> Column:
    """Worth of each coalition, by its number: what its filters remove together."""

    def worth(coalition: Column) -> Column:
        hit = F.filter(cells, lambda c: c["failed"].bitwiseAND(coalition) != 0)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda total, c: total + c[of])

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), worth)


def _potentials(worths: str) -> Column:
    """``WHOLE`` times the potential of each coalition, by its number; coalitions ascend, so that smaller ones are known."""

    def grown(known: Column, coalition: Column) -> Column:
        total = WHOLE * F.element_at(worths, coalition + 1)
        size = F.lit(0)
        for k in range(len(FILTERS)):
            there = coalition.bitwiseAND(F.lit(1 << k)) != 0
            total = total + F.when(there, F.get(known, coalition - (1 << k))).otherwise(F.lit(0))
            size = size + there.cast("int")
        return F.concat(known, F.array(F.call_function("div", total, size).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), grown)


def _coalition(letters: Column) -> Column:
    bits = [F.when(letters.contains(name), 1 << k).otherwise(0) for k, name in enumerate(FILTERS)]
    return bits[0] + bits[1] + bits[2] + bits[3] + bits[4]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part (``lang``; null counts as empty), order of the five filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``shapley`` is 120 Shapley values: the filter's removals summed over all orders. A null text is empty: it fails A, and E where a smaller doc_id has
    an empty text too. A null doc_id has no smaller one and is none: such a row never fails E and has no labels. Rows that repeat a doc_id count each; of a text's
    smallest doc_id all rows stay. A document with several label rows is good or toxic when one of them says so; null labels say nothing. Empty table: no
    rows. Only doc_id, text and lang are read, and doc_id, quality and toxic of the labels.
    """
    cell = F.struct("failed", "n", "good", "toxic")
    parts = failure_counts(docs, labels).groupBy("part").agg(F.collect_list(cell).alias("cells"))  # at most 32
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + c["n"])
    parts = parts.select("part", total.alias("total"), *(_worths("cells", w).alias(w) for w in ("n", "good", "toxic")))
    parts = parts.withColumn("potentials", _potentials("n"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = _coalition(F.expr("substring(filter_order, 1, step - 1)"))
    own = _coalition(F.expr("substring(filter_order, step, 1)"))
    steps = steps.withColumns({"_before": before, "_own": own})

    def at(values: str, coalition: Column) -> Column:
        return F.element_at(values, coalition + 1)

    before, own = F.col("_before"), F.col("_own")
    removed = at("n", before + own) - at("n", before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("n", before + own)).alias("kept"),
        removed.alias("removed"),
        (at("n", own) - removed).alias("redundant"),
        (at("n", F.lit(ALL)) - at("n", ALL - own)).alias("unique_fails"),
        (at("good", before + own) - at("good", before)).alias("good_lost"),
        (at("toxic", before + own) - at("toxic", before)).alias("toxic_lost"),
        (120 // WHOLE * (at("potentials", F.lit(ALL)) - at("potentials", ALL - own))).alias("shapley"),
    )
