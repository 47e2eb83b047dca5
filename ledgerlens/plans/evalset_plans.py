"""Evaluation of query results over labelled documents and of results over the star schema."""

from pyspark.sql import functions as F

from ledgerlens.operators import evalset as e
from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query
from ledgerlens.plans.runlog_plans import rnd

EV = f"ev AS ({d.EVAL_SQL})"


@query(
    "A21_accuracy_table",
    f"""WITH {EV}, x AS (SELECT *, 'overall' AS level FROM ev UNION ALL SELECT *, difficulty FROM ev)
        SELECT mode, level, count(*) AS questions, count(correct) AS scored, count(*) FILTER (WHERE correct) AS correct, round(avg(tool_calls), 6) AS avg_tools,
               round(avg(tokens), 6) AS avg_tokens, round(avg(duration_ms), 6) AS avg_ms, round(CASE WHEN count(correct) > 0 THEN count(*) FILTER (WHERE correct) / count(correct) ELSE 0 END, 6) AS accuracy
        FROM x GROUP BY 1, 2""",
)
def a21(t):
    return rnd(e.accuracy_table(d.evaluation(t)), {c: 6 for c in ("avg_tools", "avg_tokens", "avg_ms", "accuracy")})


@query(
    "A22_relative_change",
    f"""WITH {EV}, x AS (SELECT *, 'overall' AS level FROM ev UNION ALL SELECT *, difficulty FROM ev),
        g AS (SELECT level, avg(tool_calls) FILTER (WHERE mode = 'with') AS a, avg(tool_calls) FILTER (WHERE mode = 'without') AS b, avg(tokens) FILTER (WHERE mode = 'with') AS c, avg(tokens) FILTER (WHERE mode = 'without') AS d FROM x GROUP BY 1)
        SELECT level, round(a, 4) AS avg_tools_with, round(b, 4) AS avg_tools_without, round(c, 4) AS avg_tokens_with, round(d, 4) AS avg_tokens_without,
               round((a - b) / b * 100, 4) AS avg_tools_change_pct, round((c - d) / d * 100, 4) AS avg_tokens_change_pct FROM g""",
)
def a22(t):
    out = e.relative_change(e.accuracy_table(d.evaluation(t)), "with", "without", ["avg_tools", "avg_tokens"])
    return rnd(out, {c: 4 for c in out.columns if c != "level"})


@query(
    "A23_result_summary",
    f"""WITH {EV} SELECT db_id, mode, count(*) AS completed, count(*) FILTER (WHERE predicted_sql <> '') AS predicted, count(*) FILTER (WHERE correct) AS correct,
          count(*) FILTER (WHERE error <> '' AND NOT deferred) AS agent_error, count(*) FILTER (WHERE deferred) AS deferred, count(*) FILTER (WHERE correct IS NOT TRUE) AS failed,
          count(*) + 2 AS selected, round(count(*) FILTER (WHERE correct) / (count(*) + 2), 6) AS accuracy FROM ev GROUP BY 1, 2""",
)
def a23(t):
    rows = d.evaluation(t)
    selected = rows.groupBy("db_id", "mode").agg((F.count(F.lit(1)) + 2).alias("selected"))
    return rnd(e.result_summary(rows, ["db_id", "mode"], selected), {"accuracy": 6})


@query(
    "L05_retry_selection",
    f"""WITH {EV}, c AS (SELECT question_id, mode, CASE WHEN deferred THEN 'deferred' WHEN error <> '' THEN 'agent_error' WHEN correct IS NOT TRUE THEN 'incorrect' END AS category FROM ev)
        SELECT * FROM c WHERE category IN ('deferred', 'agent_error')""",
)
def l05(t):
    return e.retry_selection(d.evaluation(t)).select("question_id", "mode", "category")


@query(
    "J13_compare_runs",
    f"""WITH {EV}, a AS (SELECT question_id, correct FROM ev WHERE mode = 'without' AND db_id <> 'src1'), b AS (SELECT question_id, correct FROM ev WHERE mode = 'with' AND db_id <> 'src2')
        SELECT coalesce(a.question_id, b.question_id) AS question_id, a.correct AS left_correct, b.correct AS right_correct, CASE WHEN b.question_id IS NULL THEN 'left_only' WHEN a.question_id IS NULL THEN 'right_only'
          WHEN a.correct IS NOT TRUE AND b.correct IS TRUE THEN 'improved' WHEN a.correct IS TRUE AND b.correct IS NOT TRUE THEN 'regressed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.question_id = b.question_id""",
)
def j13(t):
    rows = d.evaluation(t)
    return e.compare_runs(rows.where("mode = 'without' and db_id <> 'src1'"), rows.where("mode = 'with' and db_id <> 'src2'"), ["question_id"])


@query(
    "J14_overlay_retry",
    f"""WITH {EV}, a AS (SELECT question_id, correct, tokens FROM ev WHERE mode = 'without'), b AS (SELECT question_id, correct, tokens FROM ev WHERE mode = 'with' AND error <> '')
        SELECT a.question_id, CASE WHEN b.question_id IS NULL THEN a.correct ELSE b.correct END AS correct, CASE WHEN b.question_id IS NULL THEN a.tokens ELSE b.tokens END AS tokens,
          CASE WHEN b.question_id IS NULL THEN 1 ELSE 2 END AS effective_attempt FROM a LEFT JOIN b ON a.question_id = b.question_id""",
)
def j14(t):
    rows = d.evaluation(t).select("question_id", "mode", "correct", "tokens", "error")
    keep = ["question_id", "correct", "tokens"]
    return e.overlay_retry(rows.where("mode = 'without'").select(*keep), rows.where("mode = 'with' and error <> ''").select(*keep), ["question_id"])


@query(
    "X03_multiset_equality",
    """SELECT 'reordered' AS what, 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS multiset_equal, true AS set_equal WHERE (SELECT count(*) FROM lineitem) > 0
       UNION ALL SELECT 'rounded', 0, 0, true, true
       UNION ALL SELECT 'repeated', 0, (SELECT count(*) FROM lineitem WHERE l_quantity > 49), false, true""",
)
def x03(t):
    base = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    noisy = base.select("l_orderkey", "l_quantity", F.col("l_extendedprice") + 0.0000001)
    twice = base.unionByName(base.where("l_quantity > 49"))
    rows = {"reordered": base.repartition("l_quantity"), "rounded": noisy, "repeated": twice}
    parts = [e.compare_results(base, other).select(F.lit(n).alias("what"), "*") for n, other in rows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PAIRS_OF_A_TASK = 500_000


@query(
    "X04_set_equality",
    """WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A')
       SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right,
              NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS set_equal""",
)
def x04(t):
    # tasks hold so many rows however large the table is: pairs hardly repeat, so they are dealt out before they are made distinct
    tasks = 1 + t.lineitem.count() // PAIRS_OF_A_TASK
    dealt = lambda flag: t.lineitem.where(F.col("l_returnflag") != flag).select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey")
    pairs = lambda flag: dealt(flag).distinct()
    return e.compare_results(pairs("R"), pairs("A")).select("only_left", "only_right", "set_equal")


_CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"


@query(
    "X05_result_vote",
    f"""WITH r AS (SELECT user_id, event_type, string_agg(DISTINCT day, ',' ORDER BY day) AS res, (user_id // 30) AS task FROM (SELECT user_id, event_type, isodow(ts)::VARCHAR AS day FROM events) GROUP BY 1, 2),
         c AS (SELECT task, res, user_id * 10 + {_CODE} AS candidate, 'SELECT ' || event_type AS sql FROM r),
         v AS (SELECT task, res, count(*) AS votes, min((length(sql), candidate)) AS b, min(candidate) AS f FROM c GROUP BY 1, 2)
       SELECT task, votes, b[2] AS winner FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY votes DESC, f) AS rn FROM v) WHERE rn = 1""".replace(
        "min((length(sql), candidate)) AS b", "min([length(sql), candidate]) AS b"
    ),
)
def x05(t):
    rows = t.events.select(F.expr(f"user_id * 10 + {_CODE}").alias("candidate"), "user_id", "event_type", F.weekday("ts").alias("day"))
    candidates = rows.select("candidate", F.expr("user_id div 30").alias("task"), F.concat(F.lit("SELECT "), "event_type").alias("sql")).distinct()
    prints = e.result_fingerprints(rows, "candidate", ["day"])
    return e.vote(candidates, prints, "candidate", "sql", ["task"])


_LEFT = "SELECT doc_id, lang, n_chars, source FROM documents WHERE n_chars % 10 > 0"
_RIGHT = "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS lang, n_chars::VARCHAR AS n_chars, quality FROM documents JOIN labels USING (doc_id)"


@query(
    "X06_column_reconciliation",
    f"""WITH l AS ({_LEFT}), r AS ({_RIGHT}),
        k AS (SELECT (SELECT count(*) FROM l ANTI JOIN r USING (doc_id)) AS left_keys, (SELECT count(*) FROM r ANTI JOIN l USING (doc_id)) AS right_keys),
        c AS (SELECT 'doc_id' AS column_name, 'bigint' AS left_type, 'bigint' AS right_type, (SELECT count(doc_id) FROM l) AS left_values, (SELECT count(doc_id) FROM r) AS right_values, 0 AS differing
          UNION ALL SELECT 'lang', 'string', 'string', (SELECT count(lang) FROM l), (SELECT count(lang) FROM r), (SELECT count(*) FROM l JOIN r USING (doc_id) WHERE l.lang IS DISTINCT FROM r.lang)
          UNION ALL SELECT 'n_chars', 'bigint', 'string', (SELECT count(n_chars) FROM l), (SELECT count(n_chars) FROM r), (SELECT count(*) FROM l JOIN r USING (doc_id) WHERE l.n_chars::VARCHAR IS DISTINCT FROM r.n_chars)
          UNION ALL SELECT 'quality', NULL, 'int', 0, (SELECT count(quality) FROM r), NULL
          UNION ALL SELECT 'source', 'string', NULL, (SELECT count(source) FROM l), 0, NULL)
        SELECT c.*, left_keys, right_keys, CASE WHEN left_type IS NULL THEN 'right_only' WHEN right_type IS NULL THEN 'left_only' WHEN left_type <> right_type THEN 'type_differs'
          WHEN differing > 0 THEN 'values_differ' ELSE 'same' END AS status FROM c, k""",
)
def x06(t):
    left = t.documents.where("n_chars % 10 > 0").select("doc_id", "lang", "n_chars", "source")
    right = t.documents.join(t.labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("lang")).alias("lang"), F.col("n_chars").cast("string").alias("n_chars"), "quality")
    return e.reconcile_columns(left, right, "doc_id")
