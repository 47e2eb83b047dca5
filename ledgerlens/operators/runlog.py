"""Analytics over run logs: intervals, turns, tokens, anomalies and log lines.

Events carry run_id, kind (model, tool, hook, node), name, start_us, end_us (microseconds), elapsed_ms, success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import exact_quantiles, global_quantiles, join_nullsafe
from ledgerlens.operators.sequences import as_of, carried

TOKENS = ["input_tokens", "output_tokens", "total_tokens"]

# A log line as written by the logger, with an optional process field.
LOG_LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \| (DEBUG|INFO|SUCCESS|WARNING|ERROR|CRITICAL|TRACE)\s*"
    r"\| (?:([^|]+?)\s*\| )?(.+?):(.+?):(\d+) \| (.+)$"
)


def _elapsed() -> Column:
    return F.greatest(F.coalesce(F.col("elapsed_ms"), F.lit(0.0)), F.lit(0.0))


def _failures() -> Column:
    return F.count_if(F.coalesce(~F.col("success"), F.lit(False)))


def event_aggregates(events: DataFrame, by: list[str]) -> DataFrame:
    """Count, total, average, percentiles, bounds, failures and error percentage per group."""
    e = events.withColumn("_ms", _elapsed())
    agg = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum("_ms").alias("total_ms"), F.avg("_ms").alias("avg_ms"), F.min("_ms").alias("min_ms"),
        F.max("_ms").alias("max_ms"), _failures().alias("failures"),
    )
    levels = {0.5: "p50_ms", 0.9: "p90_ms", 0.95: "p95_ms", 0.99: "p99_ms"}
    q = exact_quantiles(e, by, "_ms", list(levels))
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in levels.items()])
    return agg.join(wide, by, "left").withColumn("error_pct", F.col("failures") / F.col("count") * 100)


def kind_shares(components: DataFrame) -> DataFrame:
    """Share of a component in the total of its kind, in percent."""
    totals = components.groupBy("kind").agg(F.sum("total_ms").alias("_k"))
    share = F.when(F.col("_k") > 0, F.col("total_ms") / F.col("_k") * 100).otherwise(0.0)
    return components.join(totals, "kind").withColumn("kind_share", share).drop("_k")


def interval_metrics(events: DataFrame, by: list[str]) -> DataFrame:
    """Wall, active, idle and work time, parallelism and peak concurrency per group; ends count before starts.

    One pass over starts and ends in time order: how many intervals are open after each of them, and when the next one comes.
    """
    good = events.where("start_us is not null and end_us is not null and end_us >= start_us")
    points = good.select(*by, F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(1).alias("delta")), F.struct(F.col("end_us").alias("us"), F.lit(-1).alias("delta")))).alias("p"))
    points = points.select(*by, "p.us", "p.delta")
    open_now = carried(points, by, ["us", "delta"], {"running": ("sum", "delta"), "until": ("next", "us")})
    spans = open_now.groupBy(*by).agg(
        ((F.max("us") - F.min("us")) / 1000.0).alias("wall_ms"),
        (F.sum(F.when(F.col("running") > 0, F.coalesce("until", "us") - F.col("us")).otherwise(F.lit(0))) / 1000.0).alias("active_ms"),
        F.greatest(F.max("running"), F.lit(0)).alias("peak_concurrency"),
    )
    work = events.groupBy(*by).agg(F.sum(_elapsed()).alias("work_ms"))
    out = join_nullsafe(work, spans, by, "left").na.fill(0, ["wall_ms", "active_ms", "peak_concurrency"])
    return out.withColumn("idle_ms", F.greatest(F.col("wall_ms") - F.col("active_ms"), F.lit(0.0))).withColumn(
        "parallelism", F.when(F.col("active_ms") > 0, F.col("work_ms") / F.col("active_ms")).otherwise(0.0)
    )


def assign_tools(events: DataFrame) -> DataFrame:
    """Tool events with the model call whose turn they start in: at or after its end, before the next model call."""
    cols = ["run_id", "event_id", "name", "start_us", "end_us", "elapsed_ms"]
    tools = events.where("kind = 'tool' and start_us is not null").select(*cols)
    models = events.where("kind = 'model' and start_us is not null").select("run_id", F.col("start_us").alias("at"), F.col("event_id").alias("model_id"), F.col("end_us").alias("model_end"))
    ts = lambda c: F.timestamp_micros(c)
    hit = as_of(
        tools.withColumn("_t", ts("start_us")), models.withColumn("_m", ts("at")), ["run_id"], "_t", "_m", ["model_id", "model_end"]
    )
    return hit.where("matched_model_id is not null and start_us >= matched_model_end").select(
        *cols, F.col("matched_model_id").alias("model_id"), F.col("matched_model_end").alias("model_end")
    )


def model_turns(events: DataFrame) -> DataFrame:
    """Per model call: its turn, tools, tool wall and work time, blocking tool, critical path and overhead."""
    models = events.where("kind = 'model' and start_us is not null").select("run_id", "event_id", "name", "start_us", "end_us", "elapsed_ms")
    numbered = carried(models, ["run_id"], ["start_us", "event_id"], {"turn": ("count", "event_id"), "next_start": ("next", "start_us")})
    run_end = events.groupBy("run_id").agg(F.max("end_us").alias("run_end"))
    m = numbered.join(run_end, "run_id").withColumn("next_start", F.coalesce("next_start", "run_end"))
    tools = assign_tools(events)
    walls = interval_metrics(tools, ["run_id", "model_id"]).select("run_id", "model_id", F.col("active_ms").alias("tool_wall_ms"), F.col("work_ms").alias("tool_work_ms"))
    facts = tools.groupBy("run_id", "model_id").agg(
        F.count(F.lit(1)).alias("tool_count"),
        F.max("end_us").alias("_last_end"),
        F.max_by("name", F.when(F.col("end_us").isNotNull(), F.struct("end_us", -F.col("event_id")))).alias("blocking_tool"),
    )
    side = facts.join(walls, ["run_id", "model_id"]).withColumnRenamed("model_id", "event_id")
    j = m.join(side, ["run_id", "event_id"], "left")
    batch = F.coalesce((F.col("_last_end") - F.col("end_us")) / 1000.0, F.lit(0.0))
    turn_wall = F.greatest(F.coalesce((F.col("next_start") - F.col("start_us")) / 1000.0, F.lit(0.0)), F.lit(0.0))
    critical = F.coalesce(F.col("elapsed_ms"), F.lit(0.0)) + F.greatest(batch, F.lit(0.0))
    return j.select(
        "run_id", "turn", F.col("event_id").alias("model_id"), "name", F.coalesce("elapsed_ms", F.lit(0.0)).alias("model_ms"),
        F.coalesce("tool_count", F.lit(0)).alias("tool_count"), F.coalesce("tool_wall_ms", F.lit(0.0)).alias("tool_wall_ms"),
        F.coalesce("tool_work_ms", F.lit(0.0)).alias("tool_work_ms"), turn_wall.alias("turn_wall_ms"), critical.alias("critical_path_ms"),
        F.greatest(turn_wall - critical, F.lit(0.0)).alias("overhead_ms"), F.coalesce("blocking_tool", F.lit("")).alias("blocking_tool"),
    )


def token_turns(calls: DataFrame) -> DataFrame:
    """Turn per run, growth of the input against the previous turn, and tokens so far in the whole session."""
    per_run = carried(calls, ["session_id", "run_id"], ["start_us", "event_id"], {"turn": ("count", "event_id"), "_before": ("previous", "input_tokens")})
    summed = carried(per_run, ["session_id"], ["start_us", "event_id"], {"cumulative_tokens": ("sum", "total_tokens")})
    return summed.withColumn("input_delta", F.col("input_tokens") - F.coalesce("_before", F.lit(0))).drop("_before")


def timeline(events: DataFrame, by: list[str]) -> DataFrame:
    """Visible events with their start relative to the first event of the group; bars are at least 0.05 ms long."""
    origin = events.where("start_us is not null").groupBy(*by).agg(F.min("start_us").alias("_first"))
    visible = F.col("kind").isin("model", "tool") | ((F.col("kind") == "hook") & (F.col("name") == "pruner") & (F.col("elapsed_ms") >= 1000))
    shown = events.where(visible & F.col("start_us").isNotNull()).join(origin, by)
    return shown.select(
        *by, "event_id", "kind", "name", ((F.col("start_us") - F.col("_first")) / 1000.0).alias("start_ms"), F.greatest(F.coalesce("elapsed_ms", F.lit(0.0)), F.lit(0.05)).alias("bar_ms"), "success"
    )


def sequence_numbers(events: DataFrame, run: str, ts_us: str, tie: str) -> DataFrame:
    """Running number of each event in its run."""
    return carried(events, [run], [ts_us, tie], {"seq": ("count", tie)})


def slowest(events: DataFrame, n: int = 25) -> DataFrame:
    """The slowest hook, model and tool events; every task sends on its own ``n``."""
    return events.where(F.col("kind").isin("hook", "model", "tool")).orderBy(F.col("elapsed_ms").desc_nulls_last(), "event_id").limit(n)


def token_aggregates(calls: DataFrame, dimensions: list[str]) -> DataFrame:
    """Sums, per-call averages, ratios and throughput per value of each dimension, from one expansion of the rows."""
    long = calls.select(
        *TOKENS, "elapsed_ms", "tokens_per_sec", "tool_calls", "invalid_tool_calls", "success", *[F.col(d).cast("string").alias(d) for d in dimensions]
    ).unpivot([*TOKENS, "elapsed_ms", "tokens_per_sec", "tool_calls", "invalid_tool_calls", "success"], dimensions, "dimension", "key")
    by = ["dimension", "key"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    agg = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), *[total(c).alias(c) for c in TOKENS], F.sum(_elapsed()).alias("_ms"), total("tool_calls").alias("tool_calls"),
        total("invalid_tool_calls").alias("invalid_tool_calls"), _failures().alias("failures"),
    )
    q = exact_quantiles(long, by, "tokens_per_sec", [0.5, 0.95])
    wide = q.groupBy(*by).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median_tps"), F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95_tps")
    )
    out = agg.join(wide, by, "left").na.fill(0.0, ["median_tps", "p95_tps"])
    return out.select(
        *by, "calls", *TOKENS, (F.col("total_tokens") / F.col("calls")).alias("tokens_per_call"),
        F.when(F.col("output_tokens") > 0, F.col("input_tokens") / F.col("output_tokens")).alias("input_output_ratio"),
        F.when(F.col("_ms") > 0, F.col("output_tokens") / (F.col("_ms") / 1000.0)).otherwise(0.0).alias("weighted_tps"),
        "median_tps", "p95_tps", "tool_calls", "invalid_tool_calls", "failures", (F.col("failures") / F.col("calls") * 100).alias("error_pct"),
    )


def reconcile(calls: DataFrame, footers: DataFrame, file: str) -> DataFrame:
    """Token totals of all events, of events in finished files, of the footers and of the state, metric by metric."""
    done = footers.select(F.col(file)).distinct().withColumn("_done", F.lit(True))
    flagged = calls.join(done, file, "left")
    sums = lambda df, name, cond=None, prefix="": df.agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(prefix + c)) if cond is not None else F.col(prefix + c)), F.lit(0)).alias(c) for c in TOKENS]
    ).unpivot([], TOKENS, "metric", name)
    j = (
        sums(flagged, "all_events")
        .join(sums(flagged, "complete_events", F.col("_done")), "metric")
        .join(sums(footers, "footer"), "metric")
        .join(sums(footers, "state", prefix="state_"), "metric")
    )
    return j.withColumn("footer_match", F.col("complete_events") == F.col("footer")).withColumn("state_match", F.col("complete_events") == F.col("state"))


def log_quality(spark, path: str, schema: str, finished: DataFrame, file: str) -> DataFrame:
    """Counters of a folder of JSON lines: malformed lines, missing times, negative intervals, files without a footer."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).select("*")
    broken = F.col("_corrupt_record").isNotNull()
    rows = raw.withColumn("_bad", broken)
    per_file = rows.groupBy(file).agg(
        F.count_if(F.col("_bad")).alias("bad"),
        F.count_if(~F.col("_bad")).alias("n"),
        F.count_if(~F.col("_bad") & (F.col("start_us").isNull() | F.col("end_us").isNull())).alias("gaps"),
        F.count_if(~F.col("_bad") & (F.col("end_us") < F.col("start_us"))).alias("neg"),
    )
    j = per_file.join(finished.select(F.col(file)).distinct().withColumn("_done", F.lit(True)), file, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(
        F.count(file).alias("file_count"), total("n").alias("event_count"), total("bad").alias("malformed_count"), total("gaps").alias("missing_timestamp_count"),
        total("neg").alias("negative_interval_count"), F.count_if(F.col(file).isNotNull() & F.col("_done").isNull()).alias("incomplete_files"),
    )


def tool_statistics(actions: DataFrame) -> DataFrame:
    """Calls, failures and success percentage per tool."""
    agg = actions.groupBy(F.coalesce("name", F.lit("unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"), _failures().alias("failures"))
    return agg.withColumn("success_pct", (1 - F.col("failures") / F.col("calls")) * 100)


def anomalies(calls: DataFrame) -> DataFrame:
    """One row per finding of a model call; thresholds are quantiles over all calls."""
    (high,) = global_quantiles(calls, "input_tokens", [0.9])
    rated = calls.where("tokens_per_sec > 0")
    (low,) = global_quantiles(rated, "tokens_per_sec", [0.1])
    inp, out, tot = (F.coalesce(F.col(c), F.lit(0)) for c in TOKENS)
    tps = F.coalesce(F.col("tokens_per_sec"), F.lit(0.0))
    codes = F.array_compact(
        F.array(
            F.when((inp == 0) & (out == 0) & (tot == 0), "missing_usage"),
            F.when((tot != 0) & (tot != inp + out), "token_mismatch"),
            F.when((inp >= high) & (high > 0) & (out < F.greatest(F.lit(50.0), inp * 0.01)), "high_input_low_output"),
            F.when((tps > 0) & (low > 0) & (tps <= low), "slow_generation"),
            F.when(F.coalesce(F.col("invalid_tool_calls"), F.lit(0)) > 0, "invalid_tool_call"),
        )
    )
    return calls.select("run_id", "event_id", "name", *TOKENS, F.explode(codes).alias("code"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of matching log lines; other lines are left out."""
    part = lambda i: F.regexp_extract(column, LOG_LINE, i)
    out = lines.where(F.col(column).rlike(LOG_LINE))
    rest = [c for c in lines.columns if c != column]
    return out.select(
        *rest, part(1).alias("time"), part(2).alias("level"), F.nullif(F.trim(part(3)), F.lit("")).alias("process"), part(4).alias("name"),
        part(5).alias("function"), part(6).cast("int").alias("line_no"), F.trim(part(7)).alias("message"),
    )


def problem_lines(parsed: DataFrame, start: Column, end: Column, head: int | None = None) -> DataFrame:
    """ERROR and WARNING lines in a time window, one per (time, level, message or its first ``head`` characters), the smallest file name kept."""
    at = F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    hits = parsed.where(F.col("level").isin("ERROR", "WARNING") & at.between(start, end))
    key = F.col("message") if head is None else F.substring("message", 1, head)
    return hits.groupBy("time", "level", key.alias("head")).agg(
        F.min_by("message", F.struct("file", "message")).alias("message"), F.min("file").alias("file"), F.count(F.lit(1)).alias("copies")
    )


def log_rollup(parsed: DataFrame) -> DataFrame:
    """Lines per level and file with the time they span in seconds."""
    at = F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    agg = parsed.groupBy("level", "file").agg(F.count(F.lit(1)).alias("lines"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    span = (F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1e6
    return agg.select("level", "file", "lines", F.round(span, 1).alias("seconds"))


def failed_actions(actions: DataFrame, output: str = "output", head: int | None = None) -> DataFrame:
    """Failed actions with their output, or its first ``head`` characters for reports."""
    shown = F.col(output) if head is None else F.substring(output, 1, head)
    return actions.where(F.coalesce(~F.col("success"), F.lit(False))).select("run_id", "event_id", "name", shown.alias("output"))


def session_bounds(events: DataFrame, by: list[str], margin_s: int = 60) -> DataFrame:
    """First start and last end per session and the window around them."""
    agg = events.groupBy(*by).agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    return agg.select("*", (F.col("first_us") - margin_s * 1_000_000).alias("window_start_us"), (F.col("last_us") + margin_s * 1_000_000).alias("window_end_us"))


def cell_range(result: DataFrame, order: list[str], rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Rows and columns of a stored result, counted from 0, both ends included, in either order."""
    r0, r1 = sorted(rows)
    c0, c1 = sorted(columns)
    return result.orderBy(*order).offset(r0).limit(r1 - r0 + 1).select(*result.columns[c0 : c1 + 1])
