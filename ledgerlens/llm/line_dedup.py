"""Repeated passages of lines by winnowing, in DataFrame operations only.

Lines with anything but white space are hashed. A window starts at each such line and ends where it holds ``least`` characters, after ``run`` lines at the
latest, so that a single long line is a window, and so is a document's whole sequence of lines when that is shorter. The smallest hash in a window is its
fingerprint, so any passage that holds a window and stands in two places gives both the same fingerprint. Fingerprints are counted with
combining before the shuffle; only windows whose fingerprint stands in several places go on. Around these the match is
extended both ways as far as it holds: each window of the run is compared by the digest of its lines with the first place
of the same lines. A line goes when a window over it stands at an earlier place (by doc_id, then position) too.
No two places are ever paired: each place meets only the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

RUN = 3
#: Characters other than white space from which fewer lines than a run are a window of their own.
LEAST = 12
SPACES = " \t\n\x0b\x0c\r"
BLANK = r"[^\x20\x09-\x0D]"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _counted(lines: Column) -> Column:
    """Places of the lines that have anything but white space."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.filter(places, lambda i: F.element_at(lines, i + 1).rlike(BLANK))


def _windows(docs: DataFrame) -> DataFrame:
    """``doc_id, _h, _line`` for each document with counted lines: their hashes, digests and sizes."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), _lines().alias("_lines"))
    rows = rows.withColumn("_counted", F.filter("_lines", lambda x: x.rlike(BLANK))).where(F.size("_counted") > 0)
    size = lambda x: F.length(F.translate(x, SPACES, ""))
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.unhex(F.md5(x)).alias("d"), size(x).alias("c"))
    return rows.select("doc_id", "_h", F.transform("_counted", line).alias("_line"))


def _length(i: Column, run: int, least: int | None) -> Column:
    """Lines of the window that starts at ``i``; null where the document ends before the window does."""
    if least is None:
        return F.when(i + run <= F.size("_line"), run)
    out, held = F.when(F.lit(False), 0), F.lit(0)
    for k in range(run - 1):
        held = held + F.coalesce(F.get("_line", i + k)["c"], F.lit(0))
        out = out.when(held >= least, k + 1)
    return out.when(i + run <= F.size("_line"), run).when(i == 0, F.size("_line"))


def repeated_windows(docs: DataFrame, run: int = RUN, least: int | None = LEAST) -> DataFrame:
    """``doc_id, _h, spans``: in each document the start (among counted lines) and length of windows that stand at an earlier place too."""
    places = F.sequence(F.lit(0), F.size("_line") - 1)
    found = F.filter(F.transform(places, lambda i: F.struct(i.alias("start"), _length(i, run, least).alias("length"))), lambda w: w["length"].isNotNull())
    rows = _windows(docs).select("doc_id", "_h", "_line", F.explode(F.array(found)).alias("_found"))
    # selected places: the last smallest hash of each window
    least_of = lambda w: F.array_min(
        F.transform(F.sequence(w["start"] + 1, w["start"] + w["length"]), lambda j: F.struct(F.element_at("_line", j)["h"].alias("h"), (-j).alias("j")))
    )
    selected = rows.select(F.explode(F.array_distinct(F.transform("_found", least_of))).alias("_s"))
    common = selected.groupBy(F.col("_s.h").alias("_print")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_print")

    def window(w: Column) -> Column:
        digests = [F.when(w["length"] > k, F.get("_line", w["start"] + k)["d"]).otherwise(F.lit(b"")) for k in range(run)]
        return F.struct(
            w["start"].alias("start"),
            w["length"].alias("length"),
            F.array_min(F.transform(F.slice("_line", w["start"] + 1, w["length"]), lambda x: x["h"])).alias("print"),
            F.unhex(F.md5(F.concat(*digests))).alias("digest"),
        )

    windows = rows.select("doc_id", "_h", F.explode(F.transform("_found", window)).alias("_w"))
    windows = windows.select("doc_id", "_h", "_w.start", "_w.length", F.col("_w.print").alias("_print"), "_w.digest")
    likely = written(windows.join(common, "_print", "left_semi").drop("_print"), "line-windows")
    place = F.struct("doc_id", "_h", "start")
    first = likely.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = likely.join(first, "digest").where(place > F.col("first"))
    return later.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def dedup_lines(docs: DataFrame, run: int = RUN, least: int | None = LEAST) -> DataFrame:
    """The rows of ``docs`` with ``text`` freed of later repeated passages, and ``n_lines, n_removed`` (counted lines).

    A passage is ``run`` lines, or fewer that hold ``least`` characters other than white space, or all lines of a document that has less; without ``least`` only
    runs count. Lines end at a line feed. Lines of white space alone take no part and stay. A null text stays null. Rows that repeat a doc_id and its text are one place; rows that share only the doc_id are ordered by the hash of their text.
    A null doc_id comes first. Other columns pass through, but for two of the names that are added. Empty table: no rows.
    """
    spans = repeated_windows(docs, run, least).select(F.col("doc_id").alias("_doc"), F.col("_h").alias("_hash"), F.col("spans").alias("_spans"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col("_row.text").alias("text"), F.col("_row.doc_id").alias("_id"), F.xxhash64("_row.text").alias("_h")
    )
    rows = own.join(spans, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_hash")), "left")
    # lines are split once a row: a generator keeps the optimizer from putting the expressions into one another
    rows = rows.select("_row", "_spans", F.explode(F.array(_lines())).alias("_lines"))
    rows = rows.select("_row", "_spans", "_lines", F.explode(F.array(_counted(F.col("_lines")))).alias("_counted"))
    gone = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    gone = F.coalesce(F.transform(gone, lambda k: F.element_at("_counted", k + 1)), F.array().cast("array<int>"))
    rows = rows.select("_row", "_spans", "_lines", F.size("_counted").cast("long").alias("n_lines"), F.explode(F.array(gone)).alias("_gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")
    new = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(rest)
    rows = rows.select("_row", "n_lines", F.size("_gone").cast("long").alias("n_removed"), F.explode(F.array(new)).alias("_new"))
    columns = [F.col("_new").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*columns, "n_lines", "n_removed")
