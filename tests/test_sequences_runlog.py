import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import runlog as r
from ledgerlens.operators import sequences as q

S = 1_000_000
DAY = 86_400 * S


def events(spark):
    """model 1 s, tool 0.5 s, failed tool 0.3 s beside it, model 2 s, and the agent that holds them all."""
    rows_ = [
        (1, 7, "model", "m", 0, 1 * S, 1000.0, True),
        (2, 7, "tool", "search", 1 * S, int(1.5 * S), 500.0, True),
        (3, 7, "tool", "bash", int(1.3 * S), int(1.6 * S), 300.0, False),
        (4, 7, "model", "m", int(2.5 * S), int(4.5 * S), 2000.0, True),
    ]
    return spark.createDataFrame(rows_, "event_id bigint, run_id bigint, kind string, name string, start_us bigint, end_us bigint, elapsed_ms double, success boolean")


def test_turns(spark):
    first, second = r.model_turns(events(spark)).orderBy("turn").collect()
    assert (first.tool_count, first.tool_wall_ms, first.tool_work_ms, first.blocking_tool) == (2, 600.0, 800.0, "bash")
    assert (first.critical_path_ms, first.turn_wall_ms, first.overhead_ms) == (1600.0, 2500.0, 900.0)
    assert (second.tool_count, second.blocking_tool, second.turn_wall_ms) == (0, "", 2000.0)


def test_intervals(spark):
    got = r.interval_metrics(events(spark), ["run_id"]).first()
    assert (got.wall_ms, got.work_ms, got.peak_concurrency, got.active_ms) == (4500.0, 3800.0, 2, 3600.0)
    twice = spark.createDataFrame([(1, 0, S, 1000.0), (1, 0, S, 1000.0)], "run_id int, start_us bigint, end_us bigint, elapsed_ms double")
    same = r.interval_metrics(twice, ["run_id"]).first()
    assert (same.active_ms, same.work_ms, same.peak_concurrency, same.parallelism) == (1000.0, 2000.0, 2, 2.0)
    touching = spark.createDataFrame([(1, 0, S, 1.0), (1, S, 2 * S, 1.0)], "run_id int, start_us bigint, end_us bigint, elapsed_ms double")
    assert r.interval_metrics(touching, ["run_id"]).first().peak_concurrency == 1


def test_intervals_by_brute_force(spark):
    rng = random.Random(4)
    data = []
    for run in (1, 2):
        for _ in range(80):
            a = rng.randrange(0, 6 * DAY, 1000)
            data.append((run, a, a + rng.randrange(0, 2 * DAY, 1000), 5.0))
    df = spark.createDataFrame(data, "run_id int, start_us bigint, end_us bigint, elapsed_ms double")
    got = {x.run_id: x for x in r.interval_metrics(df, ["run_id"]).collect()}
    for run in (1, 2):
        mine = sorted((a, b) for k, a, b, _ in data if k == run)
        active, until = 0, None
        for a, b in mine:
            start = a if until is None else max(a, until)
            active += max(0, b - start)
            until = b if until is None else max(until, b)
        peak = max(sum(1 for x, y in mine if x <= a < y or x == a) for a, _ in mine)
        assert abs(got[run].active_ms - active / 1000) < 1e-6
        assert abs(got[run].peak_concurrency - peak) <= 1


def test_carried_by_brute_force(spark):
    rng = random.Random(9)
    data = [(rng.choice(["a", "b", None]), i * 7 % 200, i, rng.choice([None, rng.randrange(50)])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int")
    running = {"s": ("sum", "v"), "c": ("count", "v"), "m": ("max", "v"), "l": ("last", "v"), "p": ("previous", "v"), "n": ("next", "v")}
    for inclusive in (True, False):
        got = {x.id: x for x in q.carried(df, ["k"], ["t", "id"], running, inclusive).collect()}
        assert len(got) == 200
        for k in ("a", "b", None):
            own = sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2]))
            for at, (_, _, i, _) in enumerate(own):
                full = [x[3] for x in own[: at + inclusive] if x[3] is not None]
                before, after = ([x[3] for x in part if x[3] is not None] for part in (own[:at], own[at + 1 :]))
                assert (got[i].s, got[i].c) == (sum(full), len(full))
                assert got[i].m == (max(full) if full else None) and got[i].l == (full[-1] if full else None)
                assert got[i].p == (before[-1] if before else None) and got[i].n == (after[0] if after else None)


def test_a_hot_run_spreads_over_tasks(spark, monkeypatch):
    """A third of all rows in one run and one second: many slices, none with much more than its share."""
    seen = []
    monkeypatch.setattr(q, "cut_lineage", lambda df: seen.append(df.persist()) or seen[-1])
    df = spark.range(30000).selectExpr("if(id % 3 = 0, -1, id) as run_id", "id * 7919 % 1000000 as us", "id")
    out = q.carried(df, ["run_id"], ["us", "id"], {"seq": ("count", "id"), "after": ("next", "id")})
    assert out.where("run_id = -1").agg(F.count("*"), F.max("seq"), F.count_distinct("seq"), F.count_if(F.col("after").isNull())).first() == (10000, 10000, 10000, 1)
    sizes = [r["count"] for r in seen[0].where("run_id = -1").groupBy("_slice").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 30000 / 8 * 1.6
    seen[0].unpersist()


def test_as_of(spark):
    left = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', 'a'), (1, timestamp'2024-01-03 00:00:00', 'b'), (2, timestamp'2024-01-01 00:00:00', 'c') t(k, ts, x)")
    right = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', 5), (1, timestamp'2024-01-02 00:00:00', 6), (1, timestamp'2024-01-04 00:00:00', 7), (3, timestamp'2023-01-01 00:00:00', 9) t(k, at, y)")
    got = q.as_of(left, right, ["k"], "ts", "at", ["y"]).select("x", "matched_y")
    assert rows(got) == [("a", 5), ("b", 6), ("c", None)]


def test_token_turns_run_over_the_session(spark):
    calls = spark.createDataFrame([(1, "s", 1, 0, 10, 12), (2, "s", 2, 5, 20, 25), (3, "s", 1, 9, 30, 33)], "event_id bigint, session_id string, run_id bigint, start_us bigint, input_tokens bigint, total_tokens bigint")
    got = [(x.event_id, x.turn, x.input_delta, x.cumulative_tokens) for x in r.token_turns(calls).orderBy("event_id").collect()]
    assert got == [(1, 1, 10, 12), (2, 1, 20, 37), (3, 2, 20, 70)]


def test_log_lines(spark):
    lines = [
        ("a.log", "2026-06-01 17:45:41.187 | ERROR    | app.main:run:12 | it broke: twice"),
        ("b.log", "2026-06-01 17:45:41.187 | ERROR    | app.main:run:12 | it broke: twice"),
        ("a.log", "2026-06-01 17:45:42.000 | WARNING  | 4242 | app:go:3 | careful"),
        ("a.log", "Traceback (most recent call last):"),
        ("a.log", "2026-06-01 17:45:43.000 | INFO     | app:go:4 | fine"),
    ]
    parsed = r.parse_log(spark.createDataFrame(lines, "file string, value string"))
    got = parsed.orderBy("time", "file").collect()
    assert len(got) == 4 and (got[0].level, got[0].name, got[0].function, got[0].line_no, got[0].message) == ("ERROR", "app.main", "run", 12, "it broke: twice")
    assert got[2].process == "4242" and got[0].process is None
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    problems = r.problem_lines(parsed, at("2026-06-01 00:00:00"), at("2026-06-02 00:00:00")).collect()
    assert sorted((x.level, x.copies, x.file) for x in problems) == [("ERROR", 2, "a.log"), ("WARNING", 1, "a.log")]


def test_shares_and_anomalies(spark):
    parts = spark.createDataFrame([("tool", "a", 500.0), ("tool", "b", 300.0)], "kind string, name string, total_ms double")
    assert sorted(x.kind_share for x in r.kind_shares(parts).collect()) == [37.5, 62.5]
    calls = spark.createDataFrame([(1, i, "m", 100 * i, 5, 100 * i + 5 + (i == 3), float(i + 1), int(i == 4)) for i in range(10)] + [(1, 99, "m", 0, 0, 0, 0.0, 0)],
        "run_id int, event_id int, name string, input_tokens bigint, output_tokens bigint, total_tokens bigint, tokens_per_sec double, invalid_tool_calls int")
    found = {(x.event_id, x.code) for x in r.anomalies(calls).collect()}
    assert {(99, "missing_usage"), (3, "token_mismatch"), (4, "invalid_tool_call"), (9, "high_input_low_output"), (0, "slow_generation")} <= found


@pytest.mark.parametrize("range_", [((1, 2), (0, 1)), ((2, 1), (1, 0))])
def test_cell_range(spark, range_):
    df = spark.createDataFrame([(i, i * 10, "x") for i in range(5)], "a int, b int, c string")
    assert rows(r.cell_range(df, ["a"], *range_)) == [(1, 10), (2, 20)]
