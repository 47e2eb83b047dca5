"""A corpus pipeline over ``documents``: quality, repeated lines, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage to the shared folder as Parquet and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup, mixing, ngram_join, packing, quality
from ledgerlens.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents that lose all their lines go.

    Null texts stay null. A column of the documents that is named like one of the operator's own counts is kept under a free name meanwhile.
    """
    free = {c: next(n for n in (f"_own_{k}_{c}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("n_lines", "n_removed") if c in docs.columns}
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(free)).where("n_removed = 0 OR n_removed < n_lines").drop("n_lines", "n_removed")
    done = done.withColumnsRenamed({new: old for old, new in free.items()})
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, each document as often as it is taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the mixture's documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fitting, connected components and packing are beyond SQL; tests compare near duplicates with a brute-force version, and the operators that the stages call with theirs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
