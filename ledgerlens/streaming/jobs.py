"""Structured Streaming jobs over append-only event files.

State is keyed, bounded by watermarks and kept in the query's checkpoint, so a lost executor or a restarted driver resumes
where the last committed batch ended.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("RUN_FINISHED", "RUN_ERROR")
#: Held results that a task has in hand at once.
PIECE = 2000

# the processor travels to the workers as it is, so that a worker needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 8) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(writer, checkpoint: str) -> None:
    """Process everything that has arrived and stop; the same checkpoint goes on from there."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drop_repeated_results(events: DataFrame, ts: str, call: str, late: str = "1 day") -> DataFrame:
    """Each tool result once per call id. Other events pass; state is dropped as the watermark moves on.

    ``ts`` must be a timestamp with time zone.
    """
    marked = events.withColumn("_key", F.coalesce(F.col(call), F.concat(F.lit("event:"), F.col("event_id").cast("string"))))
    return marked.withWatermark(ts, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND" or "UNABLE_TO_INFER_SCHEMA" in str(error.getCondition()):
            return None
        raise


def deliver_once(events: DataFrame, sink: str, key: str, checkpoint: str) -> None:
    """Append events to a sink exactly once, also when a batch runs again after a crash or all acknowledgements are lost.

    Rows are kept under the query (its checkpoint) and the batch that delivered them, in the order of their keys. A replayed batch overwrites its own
    rows, and an event that some other batch delivered is left out. For that a batch is compared with its own range of keys: where keys grow with time, Parquet skips
    the deliveries outside it; where they do not, only the key column of the sink is read.
    """
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        mine = f"{owner}-{batch_id}"
        fresh = batch.dropDuplicates([key])
        known = existing(batch.sparkSession, sink)
        if known is not None:
            low, high = batch.agg(F.min(key), F.max(key)).first()
            delivered = known.where((F.col("delivery") != mine) & F.col(key).between(F.lit(low), F.lit(high))).select(F.col(key).alias("_known"))
            fresh = fresh.join(delivered, F.col(key) == F.col("_known"), "left_anti")
        out = fresh.withColumn("delivery", F.lit(mine)).sortWithinPartitions("delivery", key)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(sink)

    run_to_end(events.writeStream.foreachBatch(write), checkpoint)


def run_parts(events: DataFrame) -> DataFrame:
    """Mergeable counters of one batch for each run that it touches."""
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "RUN_ERROR").alias("errors"), F.count_if(F.col("kind") == "RESULT").alias("results"),
        F.max("seq").alias("last_seq"),
    )


def merged_runs(parts: DataFrame) -> DataFrame:
    """Counters of several batches as one row a run."""
    return parts.groupBy("run_id").agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.sum("results").alias("results"), F.max("last_seq").alias("last_seq"))


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: rows on the executor's disk and in the checkpoint, not in the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class FlushOnEnd(StatefulProcessor):
    """Holds a run's results until an end of the run that is later than they, or until the run has been silent.

    Held results are rows of a list state. What an end leaves over goes to the other one of two lists, so that no more than ``PIECE`` results are in hand. A run's state ends with
    its timer, which stays where it is while the run goes on and is set anew when it rings too early: calls of the state cost more than rows, so a batch
    reads and writes a run's row once and touches its lists only when something is held.
    """

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "end_ms bigint, end_id bigint, seen bigint, side int, held bigint, due bigint")
        self.lists = [handle.getListState(f"held{k}", "ms bigint, event_id bigint") for k in (0, 1)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.run.get()
        end_ms, end_id, seen, side, held, due = before or (-1, -1, 0, 0, 0, -1)
        known = end = (end_ms, end_id)
        for pdf in rows:
            places = list(zip(pdf["ms"].tolist(), pdf["event_id"].tolist()))
            kinds = pdf["kind"].tolist()
            seen = max(seen, max(ms for ms, _ in places))
            end = max([end, *(x for x, kind in zip(places, kinds) if kind in TERMINAL)])
            results = [x for x, kind in zip(places, kinds) if kind == "RESULT"]
            yield from self.out(key, [x for x in results if x < end], "ended")
            held += self.hold(side, [x for x in results if x >= end])
        if end > known and held:
            held = 0
            for piece in self.pieces(side):
                yield from self.out(key, [x for x in piece if x < end], "ended")
                held += self.hold(1 - side, [x for x in piece if x >= end])
            self.lists[side].clear()
            side = 1 - side
        due = max(due, seen + self.silent_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if before is None:
            self.handle.registerTimer(due)
        self.run.update((*end, seen, side, held, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *_, side, held, due = self.run.get()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        if held:
            for piece in self.pieces(side):
                yield from self.out(key, piece, "timeout")
            self.lists[side].clear()
        self.run.clear()

    def hold(self, side: int, places: list[tuple[int, int]]) -> int:
        if places:
            self.lists[side].appendList(places)
        return len(places)

    def close(self) -> None:
        pass

    def pieces(self, side: int) -> Iterator[list[tuple[int, int]]]:
        piece: list[tuple[int, int]] = []
        for row in self.lists[side].get():
            piece.append((row[0], row[1]))
            if len(piece) == PIECE:
                yield piece
                piece = []
        if piece:
            yield piece

    @staticmethod
    def out(key, places: list[tuple[int, int]], reason: str) -> Iterator[pd.DataFrame]:
        if places:
            yield pd.DataFrame({"run_id": key[0], "event_id": [i for _, i in places], "reason": reason})


def flush_on_end(events: DataFrame, ts: str, silent: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Results held back per run and delivered when its terminal event arrives, or once the run has been silent too long.

    ``events(run_id, kind, event_id, ts)``. Time is event time, so a replay gives the same result: a result goes with an end of its run that is not
    earlier (by time, then event id), in whichever order they arrive within ``late``. State per run holds times and event ids only and is removed once
    the run is silent. The query must be started under ``state_on_disk``. An event without a time is left out.
    """
    silent_ms = int(pd.Timedelta(silent).total_seconds() * 1000)
    timed = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select("run_id", "kind", "event_id", F.unix_millis(ts).alias("ms"), ts)
    return timed.groupBy("run_id").transformWithStateInPandas(FlushOnEnd(silent_ms), "run_id bigint, event_id bigint, reason string", "append", "EventTime")


def profile_parts(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mergeable statistics of one batch: count, sum, sum of squares, bounds, and a distinct-count sketch."""
    v = F.col(value).cast("double")
    return df.groupBy(by).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.hll_sketch_agg(F.round(v * 100).cast("bigint")).alias("sketch")
    )


def merge_parts(parts: DataFrame, by: str) -> DataFrame:
    """Statistics of several batches as one."""
    return parts.groupBy(by).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.hll_union_agg("sketch").alias("sketch")
    )


def finished_profile(parts: DataFrame, by: str) -> DataFrame:
    """Readable profile: count, mean, sample deviation, bounds, estimated distinct values."""
    m = merge_parts(parts, by)
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0))
    return m.select(
        by, "n", mean.alias("mean"), F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)).alias("std"), "lo", "hi", F.hll_sketch_estimate("sketch").alias("distinct_estimate")
    )


def keep_parts(events: DataFrame, parts: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> None:
    """Keep one small row of mergeable statistics per batch and group; reading merges them. A replayed batch replaces its own rows, and the query itself holds no state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = parts(batch).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(store)

    run_to_end(events.writeStream.foreachBatch(write), checkpoint)


def refresh_profiles(events: DataFrame, by: str, value: str, store: str, checkpoint: str) -> None:
    """Statistics of all events so far, kept as parts."""
    keep_parts(events, lambda batch: profile_parts(batch, by, value), store, checkpoint)


def minute_rollup(audit: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Runs, refused and failed statements per window of time; windows close when the watermark passes them."""
    return audit.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("elapsed_ms").alias("max_ms"),
    )


def append_files(events: DataFrame, path: str, checkpoint: str) -> None:
    """Write an append-mode stream to parquet files."""
    run_to_end(events.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def apply_batches(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps applied one after the other, the same on a batch and on a stream."""
    return reduce(lambda d, step: step(d), steps, df)


def with_zone(ts: str) -> Column:
    """A wall-clock column as an instant, as watermarks need it."""
    return F.col(ts).cast("timestamp")
