import math
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import evalset as e
from ledgerlens.operators import retrieve as r
from ledgerlens.operators import vectors as v
from ledgerlens.sources import readers, schema, sinks
from ledgerlens.streaming import jobs as z


def test_chunks(spark):
    long = "x" * 3500
    df = spark.createDataFrame([(1, long), (2, "a\n\nb"), (3, ("p" * 900 + "\n\n") * 3), (4, "  \n\n ")], "id int, t string")
    got = r.chunk_documents(df, "id", "t").collect()
    assert [len(x.content) for x in got if x.doc_id == 1] == [1600, 1600, 700]
    assert [x.content for x in got if x.doc_id == 2] == ["a\n\nb"]
    assert [len(x.content) for x in got if x.doc_id == 3] == [900, 900, 900]
    assert not [x for x in got if x.doc_id == 4]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, 0, "red fox jumps"), (2, 0, "red dog"), (3, 0, "blue cat sits here"), (4, 0, "fox fox")], "doc_id int, chunk_index int, content string")
    got = r.bm25(r.text_index(chunks), spark.createDataFrame([(9, "Fox x")], "query_id int, query string"), 5).orderBy("rank").collect()
    n, df_, avg = 4, 2, (3 + 2 + 4 + 2) / 4
    idf = max(math.log((n - df_ + 0.5) / (df_ + 0.5)), 1e-6)
    score = lambda tf, length: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert [x.doc_id for x in got] == [4, 1]
    assert abs(got[0].relevance - score(2, 2)) < 1e-8 and abs(got[1].relevance - score(1, 3)) < 1e-8


def test_value_lookup(spark):
    vals = spark.createDataFrame([("t", "city", "Shanghai"), ("t", "city", "Beijing"), ("u", "flag", "NO"), ("u", "flag", "Y")], "table_name string, column_name string, value string")
    index = r.value_index(vals)
    hits = {x.literal: [] for x in spark.createDataFrame([("shang",), ("shanghi",), ("no",), ("zz",)], "literal string").collect()}
    lits = spark.createDataFrame([(x,) for x in hits], "literal string")
    for x in r.lookup_values(index, lits).collect():
        hits[x.literal].append((x.sample, x.match))
    assert hits == {"shang": [("Shanghai", "exact")], "shanghi": [("Shanghai", "near")], "no": [("NO", "exact")], "zz": []}


def test_lookup_against_brute_force(spark):
    words = ["red ring", "ring", "in", "Engine", "on", "a1", "abc", "xabcx", "ab", "b"]
    vals = spark.createDataFrame([("t", f"c{i % 3}", w) for i, w in enumerate(words)], "table_name string, column_name string, value string")
    lits = ["ring", "in", "engine on", "ab", "abcd", "q"]
    got = {(x.literal, x.sample) for x in r.lookup_values(r.value_index(vals), spark.createDataFrame([(x,) for x in lits], "literal string")).where("match = 'exact'").collect()}
    want = {(q, w) for q in lits if len(q) >= 2 for w in words if len(w) >= 2 and (q in w.lower() or w.lower() in q)}
    assert got == want


def test_hits_are_not_cut(spark):
    chunks = spark.createDataFrame([(i, 0, f"fox word{i}") for i in range(30)] + [(99 + i, 0, "dog") for i in range(90)], "doc_id int, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "fox")], "query_id int, query string")
    found = r.text_index(chunks, 16)
    assert r.above(r.bm25(found, asked, None), 0.01).count() == 30 and r.bm25(found, asked, 25).count() == 25
    vals = spark.createDataFrame([("t", f"c{i}", f"shanghai{i}") for i in range(12)], "table_name string, column_name string, value string")
    lits = spark.createDataFrame([("shanghi",)], "literal string")
    index = r.value_index(vals)
    assert r.lookup_values(index, lits).count() == 12 and r.lookup_values(index, lits, 8).count() == 8
    spans = r.mention_spans(spark.createDataFrame([(1, " ".join(f"name{i}" for i in range(12)))], "id int, q string"), "id", "q")
    assert spans.count() == 12
    assert r.mention_spans(spark.createDataFrame([(1, " ".join(f"name{i}" for i in range(12)))], "id int, q string"), "id", "q", 8).count() == 8


def test_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m[5] = 0
    m[20] = m[10] * 2 + 0.01
    vecs = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "vec_id bigint, embedding array<double>")
    unit = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = unit @ unit.T
    for block in (7, 4096):
        got = {(x.a, x.b): x.similarity for x in v.similar_pairs(vecs, 0.5, block).collect()}
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.5}
        assert set(got) == want and (10, 20) in got
    q = spark.createDataFrame([("q", [float(x) for x in m[3]])], "query_id string, embedding array<double>")
    top = [x.vec_id for x in v.top_k(vecs.repartition(4), q, 5).orderBy("rank").collect()]
    assert top == list(np.argsort(-sims[3], kind="stable")[:5])
    with pytest.raises(Exception, match="length"):
        v.top_k(vecs, q.withColumn("embedding", F.slice("embedding", 1, 3)), 2).collect()


def test_compare_results(spark):
    a = spark.createDataFrame([(1, 0.1234561), (1, 0.1234561), (2, None)], "x int, y double")
    b = spark.createDataFrame([(2, None), (1, 0.1234564), (1, 0.1234559)], "p int, q double")
    same = e.compare_results(a, b).first()
    assert same.multiset_equal and same.set_equal
    less = e.compare_results(a, b.distinct().where("q is null or q > 0.123456")).first()
    assert not less.multiset_equal and less.set_equal and less.only_left == 1
    assert e.compare_results(a, a).first().multiset_equal


def test_vote(spark):
    rows_ = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a")], "cid int, x string")
    cand = spark.createDataFrame([(1, "g", "SELECT long"), (2, "g", "SELECT"), (3, "g", "S")], "cid int, task string, sql string")
    got = e.vote(cand, e.result_fingerprints(rows_, "cid", ["x"]), "cid", "sql", ["task"]).first()
    assert (got.votes, got.winner) == (2, 2)


def test_retry_and_overlay(spark):
    base = spark.createDataFrame([(1, True, None, False), (2, False, "boom", False), (3, None, None, True), (4, False, None, False)], "q int, correct boolean, error string, deferred boolean")
    assert rows(e.retry_selection(base).select("q", "category")) == [(2, "agent_error"), (3, "deferred")]
    with pytest.raises(ValueError):
        e.retry_selection(base, ("other",))
    first = spark.createDataFrame([(1, True), (2, False)], "q int, correct boolean")
    again = spark.createDataFrame([(1, None)], "q int, correct boolean")
    assert rows(e.overlay_retry(first, again, ["q"])) == [(1, None, 2), (2, False, 1)]


def test_reconciled_columns(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0), (None, "z", 9.0)], "id int, t string, x double")
    right = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (4, "d", 9)], "id int, t string, y int")
    got = {r.column_name: (r.left_values, r.right_values, r.differing, r.left_keys, r.right_keys, r.status) for r in e.reconcile_columns(left, right, "id").collect()}
    assert got == {"id": (3, 3, 0, 1, 1, "same"), "t": (2, 3, 1, 1, 1, "values_differ"), "x": (3, 0, None, 1, 1, "left_only"), "y": (0, 3, None, 1, 1, "right_only")}
    assert {r.status for r in e.reconcile_columns(left, left.withColumn("x", F.col("x").cast("string")), "id").collect()} == {"same", "type_differs"}


def test_page_ranking(spark):
    pages = spark.createDataFrame([("1", "table", "orders", "", "ok"), ("2", "metric", "gmv", "sum of orders", "pending"), ("3", "table", "x", "preorders", "ok")], "id string, type string, title string, body string, status string")
    assert rows(r.rank_pages(pages, ["orders"])) == [("1", "table", 12 + 40 + 5), ("2", "metric", 12 + 8 - 2)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all\nof you'), (2, ""), (3, None)], "id int, t string")
    back = readers.read_csv(spark, sinks.write_csv(df, str(tmp_path / "x")))
    assert rows(back.where("id = 1")) == [(1.0, 'say "hi", all\nof you')]
    late = spark.createDataFrame([(str(i),) for i in range(200)] + [("end",)], "v string")
    assert readers.read_csv(spark, sinks.write_csv(late, str(tmp_path / "y"))).schema["v"].dataType.simpleString() == "string"


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.sql("select id, timestamp_ntz'2024-01-31 10:00:00' + make_dt_interval(cast(id as int)) ts from range(3)")
    sinks.overwrite_partitions(df, "ts", "month", path)
    sinks.overwrite_partitions(df.where("id = 1"), "ts", "month", path)
    assert rows(sinks.written_counts(spark, path, "pt_m")) == [("202401", 1), ("202402", 1)]
    assert [x.passed for x in sinks.check_written(df, "ts", "month", path).orderBy("pt_m").collect()] == [True, False]


def test_sources(spark, tmp_path):
    assert readers.jdbc_options("mysql", "h", "d", "t", split=("id", 0, 9, 4))["numPartitions"] == "4"
    assert readers.jdbc_options("postgresql", "h", "d", "t")["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        readers.jdbc_options("abacus", "h", "d", "t")
    assert (schema.preview_size(None), schema.preview_size(50), schema.preview_size(9999), schema.preview_size(50, 10)) == (20, 50, 1000, 10)
    (tmp_path / "docs.json").write_text('{"a": 1, "n": {"x": [1, 2]}}\n{"a": 2, "n": null}\n')
    docs = readers.read_documents(spark, str(tmp_path / "docs.json"))
    assert rows(docs) == [(1, '{"x": [1, 2]}'), (2, None)]


STREAM = "run_id bigint, kind string, event_id bigint, ts timestamp"


def arrive(spark, path, data):
    spark.createDataFrame(data, "run_id bigint, kind string, event_id bigint, ts string").selectExpr("run_id", "kind", "event_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)


def test_flush_on_end_and_timeout(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def go():
        with z.state_on_disk(spark):
            z.append_files(z.flush_on_end(z.event_stream(spark, src, STREAM, 1), "ts", "1 hour", "1 minute"), out, state)

    arrive(spark, src, [(1, "RESULT", 10, "2024-01-01 00:00:00"), (2, "RESULT", 20, "2024-01-01 00:00:00")])
    go()
    assert spark.read.schema("run_id bigint, event_id bigint, reason string").parquet(out).count() == 0
    arrive(spark, src, [(1, "RESULT", 11, "2024-01-01 00:01:00"), (1, "RUN_FINISHED", 12, "2024-01-01 00:02:00")])
    go()
    assert rows(spark.read.parquet(out)) == [(1, 10, "ended"), (1, 11, "ended")]
    arrive(spark, src, [(3, "STEP", 30, "2024-01-01 05:00:00")])
    go()
    assert (2, 20, "timeout") in rows(spark.read.parquet(out))


def test_results_after_an_end_wait_for_the_timeout(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    arrive(spark, src, [(1, "RESULT", 12, "2024-01-01 00:02:00"), (1, "RUN_ERROR", 11, "2024-01-01 00:01:00"), (1, "RESULT", 10, "2024-01-01 00:00:00"), (2, "RESULT", 20, "2024-01-01 00:00:00")])
    arrive(spark, src, [(1, "RESULT", 9, "2024-01-01 00:00:30"), (3, "STEP", 30, "2024-01-01 05:00:00")])
    with z.state_on_disk(spark):
        z.append_files(z.flush_on_end(z.event_stream(spark, src, STREAM, 1), "ts", "1 hour", "5 minutes"), out, state)
    assert sorted(rows(spark.read.parquet(out))) == [(1, 9, "ended"), (1, 10, "ended"), (1, 12, "timeout"), (2, 20, "timeout")]


def test_one_run_holds_most_results(spark, tmp_path, monkeypatch):
    """Results of one run beyond what is in hand at once: an end flushes the earlier ones, the timeout the others."""
    monkeypatch.setattr(z, "PIECE", 7)
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    at = lambda k: f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"
    arrive(spark, src, [(1, "RESULT", k, at(k)) for k in range(120)])
    arrive(spark, src, [(1, "RUN_FINISHED", 1000, at(79)), (1, "RESULT", 500, at(20)), (2, "RESULT", 600, at(1))])
    arrive(spark, src, [(1, "RESULT", 501, at(130)), (1, "RESULT", 502, None), (1, "RUN_ERROR", 1001, at(99))])
    arrive(spark, src, [(3, "STEP", 30, "2024-01-02 05:00:00")])
    with z.state_on_disk(spark):
        z.append_files(z.flush_on_end(z.event_stream(spark, src, STREAM, 1), "ts", "1 hour", "1 hour"), out, state)
    want = [(1, k, "ended") for k in [*range(100), 500]] + [(1, k, "timeout") for k in [*range(100, 120), 501]] + [(2, 600, "timeout")]
    assert sorted(rows(spark.read.parquet(out))) == sorted(want)


def test_run_parts_merge(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    arrive(spark, src, [(1, "RESULT", 1, "2024-01-01 00:00:00"), (2, "RUN_ERROR", 2, "2024-01-01 00:00:00")])
    arrive(spark, src, [(1, "RESULT", 3, "2024-01-02 00:00:00")])
    events = z.event_stream(spark, src, STREAM, 1).withColumn("seq", F.col("event_id"))
    for _ in range(2):
        z.keep_parts(events, z.run_parts, store, str(tmp_path / "state"))
    assert rows(z.merged_runs(spark.read.parquet(store))) == [(1, 2, 0, 2, 3), (2, 1, 1, 0, 2)]


def test_delivery_survives_lost_checkpoint(spark, tmp_path):
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    arrive(spark, src, [(1, "A", i, "2024-01-01 00:00:00") for i in range(10)])
    arrive(spark, src, [(1, "A", i, "2024-01-02 00:00:00") for i in range(8, 20)])
    for state in ("one", "one", "two"):
        z.deliver_once(z.event_stream(spark, src, STREAM, 1), sink, "event_id", str(tmp_path / state))
    assert sorted(x.event_id for x in spark.read.parquet(sink).collect()) == list(range(20))


def test_merged_profile_equals_whole(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "cast(id as double) as x")
    parts = z.profile_parts(df.where("x < 30"), "g", "x").unionByName(z.profile_parts(df.where("x >= 30"), "g", "x"))
    want = {x.g: x for x in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    for x in z.finished_profile(parts, "g").collect():
        assert (x.n, round(x.mean, 9), round(x.std, 9)) == (want[x.g].n, round(want[x.g].m, 9), round(want[x.g].s, 9))


@pytest.mark.parametrize("encoding", ["UTF-8", "GBK"])
def test_csv_reads_in_splits_unless_breaks_are_quoted(spark, tmp_path, encoding):
    plain = [(1.0, 'say "hi", 客户'), (2.0, ""), (3.0, "a,b")]
    broken = [*plain, (4.0, 'first "line"\nsecond')]
    for name, data, breaks in (("plain", plain, False), ("broken", broken, True)):
        df = spark.createDataFrame(data, "id double, note string")
        path = sinks.write_csv(df, str(tmp_path / f"{name}-{encoding}"), encoding=encoding)
        assert readers.has_quoted_breaks(spark, path, encoding) is breaks
        back = readers.read_csv(spark, path, encoding)
        assert {(r.id, r.note or "") for r in back.collect()} == set(data)


def test_directory_lists_tables_of_many_files(spark, tmp_path):
    for name in ("a b", "c"):
        spark.range(40).repartition(8).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    got = readers.read_directory(spark, str(tmp_path))
    assert {n: df.count() for n, df in got.items()} == {"a b": 40, "c": 40}


def test_pages_are_searched_once(spark):
    bodies = ["the heat", "them heath", "a_the the_", "(the)", "the", "x the\n", "preheat heat", "", None, "The", "thethe the1", "2.5 a+b", "a+bc"]
    pages = spark.createDataFrame([(i, "table", "src7" if i == 4 else "t", b, "done") for i, b in enumerate(bodies)], "id int, type string, title string, body string, status string")
    terms = ["the", "heat", "a+b", "src7"]
    found = r.rank_pages(pages, terms)
    want = {}
    for i, body in enumerate(bodies):
        at = lambda w, text: bool(re.search(rf"(^|[^a-z0-9_]){re.escape(w)}([^a-z0-9_]|$)", text))
        m = sum((12 if len(w) >= 4 else 8) for w in terms if at(w, (body or "").lower()) or at(w, "src7" if i == 4 else "t"))
        if m:
            want[i] = m + 5 + (40 if i == 4 else 0)
    assert {x.id: x.score for x in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(body") == 1


def test_set_equality_deals_pairs_by_rows(spark, monkeypatch):
    """The tasks of the comparison grow with the table, not the rows of a task."""
    from ledgerlens.plans import evalset_plans as plans
    from ledgerlens.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    want = plans.x04(t).collect()
    monkeypatch.setattr(plans, "PAIRS_OF_A_TASK", 1000)
    found = plans.x04(t)
    n = 1 + t.lineitem.count() // 1000
    assert n > 5 and found._jdf.queryExecution().optimizedPlan().toString().count(f"], {n}") == 2
    assert found.collect() == want


def test_batches_do_not_grow_with_files(spark, tmp_path):
    """An arrival of many files is one batch: each batch reads and writes the state of all runs that it touches."""
    import os
    from types import SimpleNamespace

    from ledgerlens.plans import stream_plans as sp

    df = spark.range(400).selectExpr("id", "timestamp_millis(1704067200000 + id * 1000) AS ts").repartition(8)
    path, stream = sp.source(SimpleNamespace(spark=spark), df, "many-files")
    assert len(spark.read.parquet(path).inputFiles()) == 8 * sp.ARRIVALS
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    z.append_files(stream, out, state)
    assert spark.read.parquet(out).count() == 400 and len([x for x in os.listdir(f"{state}/offsets") if x.isdigit()]) == sp.ARRIVALS


def test_a_run_that_goes_on_is_not_silent(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def go(*data):
        for part in data:
            arrive(spark, src, part)
        with z.state_on_disk(spark):
            z.append_files(z.flush_on_end(z.event_stream(spark, src, STREAM, 1), "ts", "1 hour", "1 minute"), out, state)
        return sorted(rows(spark.read.schema("run_id bigint, event_id bigint, reason string").parquet(out)))

    assert go([(1, "RESULT", 10, "2024-01-01 00:00:00")], [(1, "STEP", 11, "2024-01-01 00:50:00")]) == []
    assert go([(9, "STEP", 90, "2024-01-01 01:30:00")]) == []  # an hour after the result, not after the run's last event
    assert go([(9, "STEP", 91, "2024-01-01 01:55:00")]) == [(1, 10, "timeout")]
    assert go([(1, "RESULT", 12, "2024-01-01 02:00:00")], [(9, "STEP", 92, "2024-01-01 04:00:00")]) == [(1, 10, "timeout"), (1, 12, "timeout")]


def test_mentions_of_many_questions_stay_where_they_are(spark):
    """Values lie in the session's slices, not in few by their bytes, and spans meet their small table of links without a shuffle."""
    words = ["Asia", "large ring", "ECONOMY", "Customer#000000001", "in"]
    index = r.value_index(spark.createDataFrame([("t", f"c{i % 2}", w) for i, w in enumerate(words)], "table_name string, column_name string, value string"))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.rdd.getNumPartitions() == slices
    asked = spark.createDataFrame([(i, f'show large in "{w}"') for i, w in enumerate(["Asia", "economy", "nothing"])], "id int, q string")
    out = r.link_mentions(r.mention_spans(asked, "id", "q"), "id", index)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x.id, x["span"], x["sample"]) for x in out.where("match = 'exact'").collect()}
    found = {(0, "Asia", "Asia"), (1, "economy", "ECONOMY"), (2, "nothing", "in")}
    assert got == found | {(i, "large", "large ring") for i in range(3)} | {(i, "in", w) for i in range(3) for w in ("in", "large ring")}
