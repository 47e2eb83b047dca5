"""Streaming jobs: events are written as files of a source folder, a query runs to the end, and its result is read back."""

import math

from pyspark.sql import functions as F

from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query
from ledgerlens.plans.runlog_plans import rnd
from ledgerlens.session import scratch_path
from ledgerlens.streaming import jobs as z


ARRIVALS = 5


def source(t, df, label):
    """Event files that arrive in time order, one span of the data's own time after the other, and the stream over them.

    Events without a time arrive last.
    """
    path = scratch_path(t.spark, label)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = df.agg(F.min(at), F.max(at)).first()
    first, last = first or 0, last or 0
    span = F.coalesce(F.floor((at - first) * ARRIVALS / (last - first + 1)), F.lit(ARRIVALS - 1))
    for k in range(ARRIVALS):
        df.where(F.least(span, F.lit(ARRIVALS - 1)) == k).write.mode("append").parquet(path)
    return path, arrived(t, path, df, 2)


def arrived(t, path, df, least):
    """The stream over the files: about as many batches as arrivals, however many files an arrival has, and ``least`` files in a batch."""
    files = len(t.spark.read.schema(df.schema).parquet(path).inputFiles())
    return z.event_stream(t.spark, path, df.schema, max(least, math.ceil(files / ARRIVALS)))


def last_arrival(df, path, after, **fixed):
    """One more event, long after all others, moves the watermark past everything that waits for it."""
    given = {"ts": F.col("ts") + F.expr(f"INTERVAL {after}"), **{k: F.lit(v) for k, v in fixed.items()}}
    last = df.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(path)


# Run events: purchases and clicks carry results of tool calls, errors end a run badly, signups end it well.
KIND = "CASE event_type WHEN 'error' THEN 'RUN_ERROR' WHEN 'signup' THEN 'RUN_FINISHED' WHEN 'view' THEN 'STEP' ELSE 'RESULT' END"
RUN_SQL = f"""SELECT event_id, user_id AS run_id, ts, {KIND} AS kind, CASE WHEN event_type IN ('click', 'purchase') THEN 'call-' || user_id || '-' || json_extract_string(props, '$.k') END AS call_id, value FROM events"""


def run_events(t):
    call = F.when(
        F.col("event_type").isin("click", "purchase"), F.concat(F.lit("call-"), F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k"))
    )
    return t.events.select("event_id", F.col("user_id").alias("run_id"), z.with_zone("ts").alias("ts"), F.expr(KIND).alias("kind"), call.alias("call_id"), "value", F.col("event_id").alias("seq"))


@query("Z01_repeated_results", f"WITH r AS ({RUN_SQL}) SELECT coalesce(call_id, 'event:' || event_id) AS delivery, kind IN ('RESULT') AS is_result FROM r GROUP BY ALL")
def z01(t):
    _, stream = source(t, run_events(t), "z01")
    out, state = scratch_path(t.spark, "z01-out"), scratch_path(t.spark, "z01-state")
    with z.state_on_disk(t.spark):
        z.append_files(z.drop_repeated_results(stream, "ts", "call_id", "60 days"), out, state)
    back = t.spark.read.parquet(out)
    delivery = F.coalesce("call_id", F.concat(F.lit("event:"), F.col("event_id").cast("string")))
    return back.select(delivery.alias("delivery"), (F.col("kind") == "RESULT").alias("is_result"))


@query("Z02_replay_delivery", f"WITH r AS ({RUN_SQL}) SELECT event_id, kind FROM r")
def z02(t):
    df = run_events(t)
    path, stream = source(t, df, "z02")
    sink, state = scratch_path(t.spark, "z02-out"), scratch_path(t.spark, "z02-state")
    z.deliver_once(stream, sink, "event_id", state)
    # the acknowledgements are lost: a second run with a new checkpoint meets every event again
    z.deliver_once(arrived(t, path, df, 3), sink, "event_id", scratch_path(t.spark, "z02-again"))
    return t.spark.read.parquet(sink).select("event_id", "kind")


@query(
    "Z03_run_projection",
    f"""WITH r AS ({RUN_SQL}) SELECT run_id, count(*) AS events, count(*) FILTER (WHERE kind = 'RUN_ERROR') AS errors, count(*) FILTER (WHERE kind = 'RESULT') AS results, max(event_id) AS last_seq FROM r GROUP BY 1""",
)
def z03(t):
    _, stream = source(t, run_events(t), "z03")
    store = scratch_path(t.spark, "z03-store")
    z.keep_parts(stream, z.run_parts, store, scratch_path(t.spark, "z03-state"))
    return z.merged_runs(t.spark.read.parquet(store))


@query(
    "Z04_flush_on_end",
    f"""WITH r AS ({RUN_SQL}), b AS (SELECT *, max(event_id) FILTER (WHERE kind LIKE 'RUN_%') OVER (PARTITION BY run_id) AS last FROM r)
        SELECT run_id, event_id, CASE WHEN event_id < last THEN 'ended' ELSE 'timeout' END AS reason FROM b WHERE kind = 'RESULT'""",
)
def z04(t):
    """All results of all runs, those that only the timeout flushes too."""
    df = run_events(t)
    path, stream = source(t, df, "z04")
    last_arrival(df, path, "68 DAYS", event_id=-1, run_id=-1, seq=-1, kind="STEP")
    out, state = scratch_path(t.spark, "z04-out"), scratch_path(t.spark, "z04-state")
    with z.state_on_disk(t.spark):
        z.append_files(z.flush_on_end(stream, "ts", "60 days", "7 days"), out, state)
    return t.spark.read.parquet(out)


@query(
    "Z05_profile_refresh",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS lo, max(value) AS hi, true AS distinct_near FROM events GROUP BY 1""",
)
def z05(t):
    df = t.events.select("event_id", "ts", "event_type", "value")
    _, stream = source(t, df, "z05")
    store = scratch_path(t.spark, "z05-store")
    z.refresh_profiles(stream, "event_type", "value", store, scratch_path(t.spark, "z05-state"))
    exact = t.events.select("event_type", "value").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("d"))
    out = z.finished_profile(t.spark.read.parquet(store), "event_type").join(exact, "event_type")
    near = F.abs(F.col("distinct_estimate") - F.col("d")) <= F.col("d") * 0.1
    return rnd(out.select("event_type", "n", "mean", "std", "lo", "hi", near.alias("distinct_near")), {"mean": 6, "std": 4})


@query(
    "Z06_minute_rollup",
    f"""WITH a AS ({d.AUDIT_SQL}), g AS (SELECT epoch_us(ts) // 60000000 * 60000000 AS window_us, count(*) AS runs, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'failed') AS failed,
          round(max(elapsed_ms), 4) AS max_ms FROM a GROUP BY 1) SELECT * FROM g""",
)
def z06(t):
    audit = d.audit(t).select(z.with_zone("ts").alias("ts"), "status", "elapsed_ms")
    path, stream = source(t, audit, "z06")
    last_arrival(audit, path, "1 DAY", status="marker")
    out, state = scratch_path(t.spark, "z06-out"), scratch_path(t.spark, "z06-state")
    with z.state_on_disk(t.spark):
        z.append_files(z.minute_rollup(stream, "ts"), out, state)
    back = t.spark.read.parquet(out)
    return back.select(F.unix_micros("w.start").alias("window_us"), "runs", "blocked", "failed", F.round("max_ms", 4).alias("max_ms"))
