import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import governed as g

CASES = [
    ("SELECT 1", None),
    ("  select a from t ;; ", None),
    ("-- note\nSELECT 1", None),
    ("/* drop table x */ WITH a AS (SELECT 1) SELECT * FROM a", None),
    ("SELECT ';' AS a, 'DROP' AS b, \"set\" FROM t", None),
    ("SELECT 'it''s; -- fine' FROM t", None),
    ("SELECT a FROM t -- it's over", None),
    ("", g.REASON_EMPTY),
    ("   -- only a comment", g.REASON_EMPTY),
    ("SELECT 1; DROP TABLE t", g.REASON_MULTIPLE),
    ("SELECT 1; SELECT 2", g.REASON_MULTIPLE),
    ("CREATE TABLE x AS SELECT 1", g.REASON_KIND),
    ("PRAGMA table_info(t)", g.REASON_KIND),
    ("SELECT * FROM t WHERE DELETE = 1", "Dangerous keyword blocked: DELETE."),
    ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "Dangerous keyword blocked: INSERT."),
    ("SELECT created_at, reset_count FROM t", None),
]


def test_statement_review(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, sql_text string")
    got = {r.i: (r.allowed, r.reason) for r in g.review_statements(df).collect()}
    for i, (sql, reason) in enumerate(CASES):
        assert got[i] == (reason is None, reason), sql


def test_gateway(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, secret string")
    u = spark.createDataFrame([(1,)], "id int")
    policy = g.Policy(mask_fields=("SECRET",), allow_tables=("t",), max_rows=2)
    gate = g.ReadOnlyGateway({"t": t, "u": u}, policy, str(tmp_path / "audit"))
    got = gate.run("SELECT id, secret FROM t ORDER BY id LIMIT 50", 10)
    assert [tuple(r) for r in got.collect()] == [(1, "[MASKED]"), (2, None)]
    with pytest.raises(g.TableNotAllowed):
        gate.run("SELECT * FROM u")
    with pytest.raises(g.TableNotAllowed):
        gate.run(f"SELECT * FROM parquet.`{tmp_path}`")
    with pytest.raises(PermissionError):
        gate.run("DROP TABLE t")
    assert gate.cached("SELECT id  FROM t") is gate.cached("SELECT id FROM t")
    for sql in ("SELECT id FROM t", "DROP TABLE t", "SELECT nope FROM t", "SELECT * FROM u"):
        gate.audited(sql)
    log = {r.sql_text: (r.status, r.row_count) for r in gate.audit_log().collect()}
    assert log == {
        "SELECT id FROM t": ("succeeded", 2), "DROP TABLE t": ("blocked", 0), "SELECT nope FROM t": ("failed", 0), "SELECT * FROM u": ("blocked", 0)
    }
    gate.release()


def test_gateway_is_closed(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, secret string")
    spark.range(3).createOrReplaceGlobalTempView("pay")
    gate = g.ReadOnlyGateway({"t": t}, g.Policy(mask_fields=("secret",), allow_tables=("t",)))
    refused = [
        "SELECT * FROM global_temp.pay", "WITH t2 AS (SELECT * FROM global_temp.pay) SELECT * FROM t2", "SELECT id, (SELECT max(id) FROM global_temp.pay) AS m FROM t",
        "SELECT * FROM IDENTIFIER('global_temp.' || 'pay')", "SELECT id FROM t WHERE id IN (SELECT id FROM global_temp.pay)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x FROM t",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS x",
    ]
    for sql in refused:
        with pytest.raises((g.TableNotAllowed, PermissionError)):
            gate.run(sql)
    shown = {
        "SELECT secret AS b FROM t WHERE id = 1", "SELECT upper(secret) AS b FROM t WHERE id = 1", "SELECT max(secret) AS b FROM t",
        "WITH c AS (SELECT secret AS b, id FROM t) SELECT b FROM c WHERE id = 1", "SELECT (SELECT max(secret) FROM t) AS b",
        "SELECT b FROM (SELECT 'x' AS b WHERE false UNION ALL SELECT secret FROM t WHERE id = 1)", "SELECT explode(split(secret, ',')) AS b FROM t",
        "SELECT first_value(secret) OVER (ORDER BY id) AS b FROM t LIMIT 1",
    }
    for sql in shown:
        assert [r.b for r in gate.run(sql).collect()] == [g.MASK], sql
    assert [r.n for r in gate.run("WITH c AS (SELECT id + 1 AS n FROM t) SELECT n FROM c ORDER BY n").collect()] == [2, 3]
    gate.release()
    spark.catalog.dropGlobalTempView("pay")


COMPARED = [
    "SELECT id FROM t WHERE ssn LIKE '1%'", "SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE ssn = '111-22')", "SELECT id FROM t WHERE '111-22' IN (SELECT ssn FROM t)",
    "SELECT id FROM t x WHERE EXISTS (SELECT 1 FROM t y WHERE y.ssn LIKE '1%' AND y.id = x.id)", "SELECT id FROM t ORDER BY ssn", "SELECT count(*) AS n FROM t GROUP BY ssn",
    "SELECT a.id FROM t a JOIN t b ON a.ssn = b.ssn", "SELECT DISTINCT ssn FROM t", "SELECT ssn FROM t INTERSECT SELECT '111-22'", "SELECT row_number() OVER (ORDER BY ssn) AS r, id FROM t",
    "WITH c AS (SELECT upper(ssn) AS b, id FROM t) SELECT id FROM c WHERE b = 'X'", "SELECT id, count(*) AS n FROM t GROUP BY id HAVING max(ssn) > '2'",
    "SELECT id FROM t WHERE (SELECT max(ssn) FROM t) = '222-33'",
]
FAILING = [
    "SELECT cast(ssn AS int) AS b FROM t", "SELECT raise_error(ssn) AS b FROM t", "SELECT assert_true(ssn = 'x', ssn) AS b FROM t", "SELECT CASE WHEN ssn = '111-22' THEN 1 / 0 ELSE 1 END AS b FROM t",
    "SELECT id FROM t WHERE id IN (SELECT cast(substr(ssn, 1, 1) AS int) FROM t)", "SELECT to_date(ssn) AS b FROM t", "SELECT sum(ssn) AS b FROM t", "SELECT element_at(split(ssn, '-'), 9) AS b FROM t",
]


def test_masked_values_do_not_leave_by_other_ways(spark, tmp_path):
    t = spark.createDataFrame([(1, "111-22"), (2, "222-33"), (3, None)], "id int, ssn string")
    gate = g.ReadOnlyGateway({"t": t}, g.Policy(mask_fields=("ssn",), allow_tables=("t",)), str(tmp_path / "audit"))
    for sql in [*COMPARED, *FAILING]:
        rows, entry = gate.audited(sql)
        assert (rows, entry["status"]) == ([], "blocked"), sql
    for sql in ("SELECT cast(ssn AS string) AS b FROM t WHERE id = 1", "SELECT CASE WHEN ssn LIKE '1%' THEN 'a' ELSE 'b' END AS b FROM t WHERE id = 1", "SELECT concat(ssn, 'x') AS b FROM t WHERE id < 2"):
        assert [r.b for r in gate.run(sql).collect()] == [g.MASK], sql
    # what fails on open columns keeps its values out of the audit too
    _, entry = gate.audited("SELECT cast(concat('secret', id) AS int) AS n FROM t")
    assert entry["status"] == "failed" and "secret" not in entry["blocked_reason"]
    text = " ".join(str(r.blocked_reason) for r in gate.audit_log().collect())
    assert not any(v in text for v in ("111-22", "222-33", "secret1"))
    gate.release()


def test_a_policy_may_allow_comparisons(spark):
    t = spark.createDataFrame([(1, "111-22"), (2, "222-33")], "id int, ssn string")
    gate = g.ReadOnlyGateway({"t": t}, g.Policy(mask_fields=("ssn",), allow_tables=("t",), compare_masked=True))
    assert [tuple(r) for r in gate.run("SELECT id, ssn FROM t WHERE ssn LIKE '1%'").collect()] == [(1, g.MASK)]
    assert gate.run("SELECT count(*) AS n FROM t GROUP BY ssn").count() == 2
    with pytest.raises(PermissionError):
        gate.run("SELECT id FROM t WHERE cast(ssn AS int) = 1")
    gate.release()


def test_policy_caps():
    p = g.Policy()
    assert (p.cap(None), p.cap(5), p.cap(99999), p.cap(0)) == (100, 5, 1000, 100)


def test_mask_credentials(spark):
    df = spark.createDataFrame([("postgresql://u:p@host/db",), ("http://host/x",), (None,)], "u string")
    assert [r[0] for r in df.select(g.mask_credentials(F.col("u"))).collect()] == ["postgresql://***@host/db", "http://host/x", None]
