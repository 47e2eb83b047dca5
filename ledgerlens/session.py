"""Session settings and the durable scratch space the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings results depend on (UTC, adaptive execution)."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# The charsets Spark accepts without further settings.
_PLAIN_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def allow_charset(spark: SparkSession, encoding: str) -> str:
    """Let the CSV reader and writer use any JDK charset, such as GBK."""
    if encoding.lower() not in _PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return encoding


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    known = os.environ.get("LEDGERLENS_LOCAL_DIR")
    if not known:
        known = tempfile.mkdtemp(prefix="ledgerlens-")
        os.environ["LEDGERLENS_LOCAL_DIR"] = known
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerlens/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back: later reads take only the columns they need, and Spark knows its size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor never forces a different recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
