"""Run-log analytics over events read as runs of model, tool and hook calls."""

from pyspark.sql import functions as F

from ledgerlens.operators import runlog as r
from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query, stored
from ledgerlens.session import scratch_path

L = f"e AS ({d.RUNLOG_SQL})"


def log(t):
    return stored(t, "runlog", d.runlog)


def models(t):
    return log(t).where("kind = 'model'")


def rnd(df, digits):
    return df.select(*[(F.round(c, digits[c]) + 0.0).alias(c) if c in digits else F.col(c) for c in df.columns])


AGG = """count(*) AS count, sum(elapsed_ms) AS total_ms, round(avg(elapsed_ms), 4) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms, count(*) FILTER (WHERE NOT success) AS failures,
  round(quantile_cont(elapsed_ms, 0.5), 4) AS p50_ms, round(quantile_cont(elapsed_ms, 0.9), 4) AS p90_ms, round(quantile_cont(elapsed_ms, 0.95), 4) AS p95_ms,
  round(quantile_cont(elapsed_ms, 0.99), 4) AS p99_ms, round(count(*) FILTER (WHERE NOT success) / count(*) * 100, 4) AS error_pct"""
_AGG = {c: 4 for c in ("avg_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "error_pct")}


@query("A17_event_aggregates", f"WITH {L} SELECT kind, name, {AGG} FROM e GROUP BY 1, 2")
def a17(t):
    return rnd(r.event_aggregates(log(t), ["kind", "name"]), _AGG)


@query("W14_kind_share", f"WITH {L} SELECT kind, name, sum(elapsed_ms) AS total_ms, round(sum(elapsed_ms) / sum(sum(elapsed_ms)) OVER (PARTITION BY kind) * 100, 6) AS kind_share FROM e GROUP BY 1, 2")
def w14(t):
    parts = log(t).groupBy("kind", "name").agg(F.sum("elapsed_ms").alias("total_ms"))
    return rnd(r.kind_shares(parts), {"kind_share": 6})


_DIMS = ["run_id", "name", "caller", "call_mode"]


@query(
    "A18_token_aggregates",
    f"WITH {L}, m AS (SELECT * FROM e WHERE kind = 'model'), x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS key, * FROM m" for c in _DIMS)
    + """) SELECT dimension, key, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens,
      round(sum(total_tokens) / count(*), 6) AS tokens_per_call, round(CASE WHEN sum(output_tokens) > 0 THEN sum(input_tokens) / sum(output_tokens) END, 6) AS input_output_ratio,
      round(CASE WHEN sum(elapsed_ms) > 0 THEN sum(output_tokens) / (sum(elapsed_ms) / 1000) ELSE 0 END, 6) AS weighted_tps, round(coalesce(quantile_cont(tokens_per_sec, 0.5), 0), 6) AS median_tps,
      round(coalesce(quantile_cont(tokens_per_sec, 0.95), 0), 6) AS p95_tps, sum(tool_calls)::BIGINT AS tool_calls, sum(invalid_tool_calls)::BIGINT AS invalid_tool_calls,
      count(*) FILTER (WHERE NOT success) AS failures, round(count(*) FILTER (WHERE NOT success) / count(*) * 100, 6) AS error_pct FROM x GROUP BY 1, 2""",
)
def a18(t):
    out = r.token_aggregates(models(t), _DIMS)
    return rnd(out, {c: 6 for c in ("tokens_per_call", "input_output_ratio", "weighted_tps", "median_tps", "p95_tps", "error_pct")})


FOOT = """foot AS (SELECT file, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(total_tokens) AS total_tokens,
  sum(input_tokens) FILTER (WHERE success) AS si, sum(output_tokens) AS so, sum(total_tokens) FILTER (WHERE success) AS st FROM e WHERE kind = 'model' AND run_id % 3 > 0 GROUP BY 1)"""


def footers(t):
    """Footers of the finished files: token sums, and the sums the run state kept."""
    done = models(t).where("run_id % 3 > 0")
    ok = lambda c: F.sum(F.when(F.col("success"), F.col(c)))
    return done.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in r.TOKENS], ok("input_tokens").alias("state_input_tokens"), F.sum("output_tokens").alias("state_output_tokens"), ok("total_tokens").alias("state_total_tokens")
    )


@query(
    "A19_reconciliation",
    f"WITH {L}, {FOOT} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, a::BIGINT AS all_events, c::BIGINT AS complete_events, f::BIGINT AS footer, s::BIGINT AS state, c = f AS footer_match, c = s AS state_match FROM (
          SELECT (SELECT sum({c}) FROM e WHERE kind = 'model') AS a, (SELECT sum({c}) FROM e WHERE kind = 'model' AND run_id % 3 > 0) AS c, (SELECT sum({c}) FROM foot) AS f, (SELECT sum({x}) FROM foot) AS s)"""
        for c, x in (("input_tokens", "si"), ("output_tokens", "so"), ("total_tokens", "st"))
    ),
)
def a19(t):
    return r.reconcile(models(t), footers(t), "file")


@query(
    "A20_log_quality",
    f"""WITH {L}, x AS (SELECT *, elapsed_ms > 100000 AND elapsed_ms < 110000 AS bad FROM e) SELECT count(DISTINCT file) FILTER (WHERE NOT bad) AS file_count, count(*) FILTER (WHERE NOT bad) AS event_count,
          count(*) FILTER (WHERE bad) AS malformed_count, count(*) FILTER (WHERE NOT bad AND end_us IS NULL) AS missing_timestamp_count,
          count(*) FILTER (WHERE NOT bad AND end_us < start_us) AS negative_interval_count, count(DISTINCT file) FILTER (WHERE NOT bad AND run_id % 3 = 0) AS incomplete_files FROM x""",
)
def a20(t):
    path = scratch_path(t.spark, "jsonl")
    line = F.to_json(F.struct("event_id", "file", "start_us", "end_us"))
    bad = (F.col("elapsed_ms") > 100000) & (F.col("elapsed_ms") < 110000)
    log(t).select(F.when(bad, F.replace(line, F.lit("}"), F.lit(""))).otherwise(line).alias("value")).write.text(path)
    return r.log_quality(t.spark, path, "event_id bigint, file string, start_us bigint, end_us bigint", footers(t), "file")


@query("A24_tool_statistics", f"WITH {L} SELECT name AS tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS failures, round((1 - count(*) FILTER (WHERE NOT success) / count(*)) * 100, 4) AS success_pct FROM e WHERE kind = 'tool' GROUP BY 1")
def a24(t):
    return rnd(r.tool_statistics(log(t).where("kind = 'tool'")), {"success_pct": 4})


LOGS = """lg AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS time,
   CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, CASE WHEN event_type = 'click' THEN 'worker-1' END AS process,
   'app.' || event_type AS name, 'handle' AS function, (user_id + 1)::INTEGER AS line_no, 'value ' || CASE WHEN value < 50 THEN 'low' ELSE 'high' END || ' props ' || props AS message, 'run-' || (user_id // 30) || '.log' AS file FROM events)"""


def log_lines(t):
    """Log files written from events, and read back as text."""

    def build(t):
        level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
        process = F.when(F.col("event_type") == "click", " worker-1 |").otherwise("")
        where = F.concat(F.lit("app."), "event_type", F.lit(":handle:"), (F.col("user_id") + 1).cast("string"))
        message = F.concat(F.lit("value "), F.when(F.col("value") < 50, "low").otherwise("high"), F.lit(" props "), "props")
        line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" | "), F.rpad(level, 8, " "), F.lit(" |"), process, F.lit(" "), where, F.lit(" | "), message)
        good = t.events.select(F.concat(F.lit("run-"), F.expr("user_id div 30").cast("string"), F.lit(".log")).alias("file"), line.alias("value"))
        noise = t.events.where("value > 100").select(F.lit("run-0.log").alias("file"), F.concat(F.lit("  at line "), F.col("event_id").cast("string")).alias("value"))
        return good.unionByName(noise)

    return stored(t, "loglines", build)


@query("C24_log_parse", f"WITH {LOGS} SELECT time, level, process, name, function, line_no, message, file FROM lg")
def c24(t):
    return r.parse_log(log_lines(t))


@query(
    "A25_log_rollup",
    f"WITH {LOGS} SELECT level, file, count(*) AS lines, round((epoch_us(max(time::TIMESTAMP)) - epoch_us(min(time::TIMESTAMP))) / 1e6, 1) AS seconds FROM lg GROUP BY 1, 2",
)
def a25(t):
    return r.log_rollup(r.parse_log(log_lines(t)))


@query(
    "L02_problem_lines",
    f"""WITH {LOGS} SELECT time, level, message AS head, arg_min(message, (file, message)) AS message, min(file) AS file, count(*) AS copies FROM lg
        WHERE level IN ('ERROR', 'WARNING') AND time::TIMESTAMP BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3""",
)
def l02(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return r.problem_lines(r.parse_log(log_lines(t)), at("2024-01-05"), at("2024-01-20"))


@query("C21_json_property", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def c21(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


INTERVALS = """g AS (SELECT * FROM e WHERE end_us >= start_us),
  p AS (SELECT run_id, start_us, end_us, max(end_us) OVER (PARTITION BY run_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM g),
  sp AS (SELECT run_id, (max(end_us) - min(start_us)) / 1000.0 AS wall_ms, sum(greatest(0, end_us - greatest(start_us, coalesce(u, start_us)))) / 1000.0 AS active_ms FROM p GROUP BY 1),
  wk AS (SELECT run_id, sum(elapsed_ms) AS work_ms FROM e GROUP BY 1),
  pt AS (SELECT run_id, start_us AS us, 1 AS delta FROM g UNION ALL SELECT run_id, end_us, -1 FROM g),
  pk AS (SELECT run_id, max(n) AS peak FROM (SELECT run_id, sum(delta) OVER (PARTITION BY run_id ORDER BY us, delta ROWS UNBOUNDED PRECEDING) AS n FROM pt) GROUP BY 1)"""


@query(
    "W06_interval_union",
    f"""WITH {L}, {INTERVALS} SELECT run_id, round(wall_ms::DOUBLE, 3) AS wall_ms, round(active_ms::DOUBLE, 3) AS active_ms, work_ms, round((wall_ms - active_ms)::DOUBLE, 3) + 0.0 AS idle_ms,
          round(work_ms / active_ms, 6) AS parallelism FROM wk JOIN sp USING (run_id)""",
)
def w06(t):
    out = r.interval_metrics(log(t), ["run_id"]).drop("peak_concurrency")
    return rnd(out, {"wall_ms": 3, "active_ms": 3, "idle_ms": 3, "parallelism": 6})


@query("W07_peak_concurrency", f"WITH {L}, {INTERVALS} SELECT run_id, greatest(peak, 0)::BIGINT AS peak_concurrency FROM pk")
def w07(t):
    return r.interval_metrics(log(t), ["run_id"]).select("run_id", "peak_concurrency")


ASSIGN = """md AS (SELECT * FROM e WHERE kind = 'model'),
  nx AS (SELECT *, row_number() OVER w AS turn, lead(start_us) OVER w AS nstart FROM md WINDOW w AS (PARTITION BY run_id ORDER BY start_us, event_id)),
  tl AS (SELECT t.*, m.event_id AS model_id, m.end_us AS model_end FROM (SELECT * FROM e WHERE kind = 'tool') t JOIN nx m ON t.run_id = m.run_id AND t.start_us >= m.start_us
         AND (m.nstart IS NULL OR t.start_us < m.nstart) AND t.start_us >= m.end_us)"""


@query("J10_assign_tools", f"WITH {L}, {ASSIGN} SELECT run_id, event_id, name, model_id FROM tl")
def j10(t):
    return r.assign_tools(log(t)).select("run_id", "event_id", "name", "model_id")


@query(
    "W08_model_turns",
    f"""WITH {L}, {ASSIGN}, re AS (SELECT run_id, max(end_us) AS run_end FROM e GROUP BY 1),
        gp AS (SELECT *, max(end_us) OVER (PARTITION BY run_id, model_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM tl WHERE end_us >= start_us),
        ac AS (SELECT run_id, model_id, sum(greatest(0, end_us - greatest(start_us, coalesce(u, start_us)))) / 1000.0 AS active FROM gp GROUP BY 1, 2),
        fc AS (SELECT run_id, model_id, count(*) AS n, sum(elapsed_ms) AS wk, max(end_us) AS le, arg_max(name, (end_us, -event_id)) FILTER (WHERE end_us IS NOT NULL) AS bt FROM tl GROUP BY 1, 2),
        z AS (SELECT nx.run_id, turn, event_id AS model_id, name, elapsed_ms AS model_ms, coalesce(n, 0) AS tool_count, coalesce(active, 0)::DOUBLE AS tool_wall_ms, coalesce(wk, 0)::DOUBLE AS tool_work_ms,
                greatest(coalesce((coalesce(nstart, run_end) - start_us) / 1000.0, 0), 0)::DOUBLE AS turn_wall_ms, elapsed_ms + greatest(coalesce((le - end_us) / 1000.0, 0), 0)::DOUBLE AS critical_path_ms, coalesce(bt, '') AS blocking_tool
              FROM nx JOIN re USING (run_id) LEFT JOIN fc ON fc.run_id = nx.run_id AND fc.model_id = nx.event_id LEFT JOIN ac ON ac.run_id = nx.run_id AND ac.model_id = nx.event_id)
        SELECT run_id, turn, model_id, name, model_ms, tool_count, round(tool_wall_ms, 3) AS tool_wall_ms, tool_work_ms, round(turn_wall_ms, 3) AS turn_wall_ms, round(critical_path_ms, 3) AS critical_path_ms,
               round(greatest(turn_wall_ms - critical_path_ms, 0), 3) + 0.0 AS overhead_ms, blocking_tool FROM z""",
)
def w08(t):
    return rnd(r.model_turns(log(t)), {c: 3 for c in ("tool_wall_ms", "turn_wall_ms", "critical_path_ms", "overhead_ms")})


@query(
    "W05_token_turns",
    f"""WITH {L} SELECT run_id, event_id, row_number() OVER w AS turn, input_tokens - coalesce(lag(input_tokens) OVER w, 0) AS input_delta,
          sum(total_tokens) OVER (PARTITION BY session_id ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative_tokens
        FROM e WHERE kind = 'model' WINDOW w AS (PARTITION BY run_id ORDER BY start_us, event_id)""",
)
def w05(t):
    return r.token_turns(models(t)).select("run_id", "event_id", "turn", "input_delta", "cumulative_tokens")


@query(
    "W09_timeline",
    f"""WITH {L}, f AS (SELECT run_id, min(start_us) AS f FROM e GROUP BY 1) SELECT run_id, event_id, kind, name, round((start_us - f) / 1000.0, 3)::DOUBLE AS start_ms, greatest(elapsed_ms, 0.05) AS bar_ms, success
        FROM e JOIN f USING (run_id) WHERE kind IN ('model', 'tool') OR (kind = 'hook' AND name = 'pruner' AND elapsed_ms >= 1000)""",
)
def w09(t):
    return rnd(r.timeline(log(t), ["run_id"]), {"start_ms": 3})


@query("W11_sequence_numbers", f"WITH {L} SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY start_us, event_id) AS seq FROM e")
def w11(t):
    return r.sequence_numbers(log(t).select("event_id", "run_id", "start_us"), "run_id", "start_us", "event_id").drop("start_us")


@query("K02_slowest_events", f"WITH {L} SELECT event_id, kind, name, elapsed_ms FROM e WHERE kind IN ('hook', 'model', 'tool') ORDER BY elapsed_ms DESC, event_id LIMIT 25")
def k02(t):
    return r.slowest(log(t)).select("event_id", "kind", "name", "elapsed_ms")


@query("K08_cell_range", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 31 OFFSET 10")
def k08(t):
    return r.cell_range(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], (40, 10), (3, 1))


@query(
    "L01_anomalies",
    f"""WITH {L}, m AS (SELECT * FROM e WHERE kind = 'model'), q AS (SELECT quantile_cont(input_tokens, 0.9) AS hi, quantile_cont(tokens_per_sec, 0.1) FILTER (WHERE tokens_per_sec > 0) AS lo FROM m),
        x AS (SELECT run_id, event_id, name, input_tokens, output_tokens, total_tokens, unnest(list_filter([CASE WHEN input_tokens = 0 AND output_tokens = 0 AND total_tokens = 0 THEN 'missing_usage' END,
          CASE WHEN total_tokens <> 0 AND total_tokens <> input_tokens + output_tokens THEN 'token_mismatch' END, CASE WHEN input_tokens >= hi AND hi > 0 AND output_tokens < greatest(50, input_tokens * 0.01) THEN 'high_input_low_output' END,
          CASE WHEN tokens_per_sec > 0 AND lo > 0 AND tokens_per_sec <= lo THEN 'slow_generation' END, CASE WHEN invalid_tool_calls > 0 THEN 'invalid_tool_call' END], lambda c: c IS NOT NULL)) AS code FROM m, q)
        SELECT * FROM x""",
)
def l01(t):
    return r.anomalies(models(t))


@query("L03_failed_actions", f"WITH {L} SELECT run_id, event_id, name, output FROM e WHERE NOT success AND kind = 'tool'")
def l03(t):
    return r.failed_actions(log(t).where("kind = 'tool'"))


@query(
    "L04_session_bounds",
    f"WITH {L} SELECT session_id, min(start_us) AS first_us, max(end_us) AS last_us, min(start_us) - 60000000 AS window_start_us, max(end_us) + 60000000 AS window_end_us FROM e GROUP BY 1",
)
def l04(t):
    return r.session_bounds(log(t), ["session_id"])
