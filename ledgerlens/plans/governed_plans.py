"""Governed read-only queries."""

from pyspark.sql import functions as F

from ledgerlens.operators import governed as g
from ledgerlens.plans import derived
from ledgerlens.plans.registry import query
from ledgerlens.session import scratch_path

REVIEW = """
WITH line AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice * l_discount) AS discount,
         sum(l_extendedprice) AS gross
  FROM lineitem GROUP BY l_orderkey)
SELECT c.c_mktsegment AS segment, c.c_mktsegment AS c_name,
       CASE WHEN o.o_orderdate >= TIMESTAMP_NTZ '1998-01-01' THEN 'current' ELSE 'previous' END AS period,
       count(*) AS n_orders, round(sum(l.net), 2) AS net_revenue,
       round(CASE WHEN sum(l.gross) > 0 THEN sum(l.discount) / sum(l.gross) ELSE 0 END, 6) AS discount_rate
FROM orders o JOIN line l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o.o_orderdate < TIMESTAMP_NTZ '1999-01-01'
GROUP BY 1, 2, 3 ORDER BY 1, 3"""

POLICY = g.Policy(mask_fields=("C_NAME",), allow_tables=("orders", "lineitem", "customer"))


def gateway(t, policy=POLICY, audit_path=None):
    names = ("orders", "lineitem", "customer", "supplier", "events")
    return g.ReadOnlyGateway({n: getattr(t, n) for n in names}, policy, audit_path)


@query(
    "G01_run_readonly",
    REVIEW.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("c.c_mktsegment AS c_name", "'[MASKED]' AS c_name"),
)
def g01(t):
    gate = gateway(t)
    return gate.run(REVIEW)


@query("G02_row_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def g02(t):
    return gateway(t, g.Policy()).run("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50000", 5000)


@query(
    "G03_mask_fields",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE '[MASKED]' END AS quality, toxic
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def g03(t):
    joined = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")
    return g.masked(joined, ("QUALITY",))


@query(
    "G04_table_allowlist",
    "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def g04(t):
    gate = gateway(t)
    try:
        gate.run("SELECT count(*) AS n FROM supplier")
    except g.TableNotAllowed:
        return gate.run("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
    raise AssertionError("a table outside the allowlist was readable")


@query(
    "G05_statement_review",
    f"""SELECT event_id, sql_text LIKE 'SELECT user%' OR sql_text LIKE '-- by%' OR sql_text LIKE 'SELECT "load%' AS allowed,
          CASE WHEN sql_text LIKE 'CREATE%' THEN 'Only SELECT/WITH statements are allowed.'
               WHEN sql_text LIKE 'SELECT 1;%' THEN 'Multiple SQL statements are not allowed.'
               WHEN sql_text LIKE 'select%' THEN 'Dangerous keyword blocked: PRAGMA.'
               WHEN sql_text LIKE ' --%' THEN 'SQL is empty.'
               WHEN sql_text LIKE 'WITH x%' THEN 'Dangerous keyword blocked: DELETE.' END AS reason
        FROM ({derived.STATEMENTS_SQL})""",
)
def g05(t):
    return g.review_statements(derived.statements(t)).select("event_id", "allowed", "reason")


#: Statements of the audit with the column that each picks.
AUDITED = [
    ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", "o_orderstatus"),
    ("DROP TABLE orders", ""),
    ("SELECT nothing_like_it FROM orders", "nothing_like_it"),
]


@query(
    "G06_audit_log",
    f"""WITH st(sql_text, picked) AS (VALUES {", ".join(f"('{sql}', '{column}')" for sql, column in AUDITED)}),
        k AS (SELECT *, regexp_matches(sql_text, '^ *(select|with) ', 'i') AS reads, picked IN (SELECT column_name FROM (DESCRIBE SELECT * FROM orders)) AS known FROM st),
        n AS (SELECT 'o_orderstatus' AS picked, count(DISTINCT o_orderstatus) AS groups FROM orders)
        SELECT sql_text, CASE WHEN NOT reads THEN 'blocked' WHEN NOT known THEN 'failed' ELSE 'succeeded' END AS status,
          CASE WHEN reads AND known THEN groups ELSE 0 END AS row_count, NOT (reads AND known) AS has_reason FROM k LEFT JOIN n USING (picked)""",
)
def g06(t):
    gate = gateway(t, audit_path=scratch_path(t.spark, "audit"))
    for sql, _ in AUDITED:
        gate.audited(sql)
    return gate.audit_log().select("sql_text", "status", "row_count", F.col("blocked_reason").isNotNull().alias("has_reason"))


@query(
    "G07_audit_rollup",
    f"""SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE status = 'blocked') AS blocked,
               count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(elapsed_ms), 4) AS avg_ms,
               round(quantile_cont(elapsed_ms, 0.5), 4) AS p50_ms, round(quantile_cont(elapsed_ms, 0.95), 4) AS p95_ms,
               round(count(*) FILTER (WHERE status = 'blocked') / count(*), 6) AS blocked_share
        FROM ({derived.AUDIT_SQL}) GROUP BY 1""",
)
def g07(t):
    out = g.audit_rollup(derived.audit(t), "user_id")
    return out.select(
        "user_id",
        "runs",
        "blocked",
        "failed",
        *[F.round(c, 4).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")],
        F.round("blocked_share", 6).alias("blocked_share"),
    )


@query(
    "G08_query_history",
    f"""WITH a AS ({derived.AUDIT_SQL})
        SELECT user_id, count(*) AS statements, count(*) FILTER (WHERE favorite) AS favorites,
               arg_max(event_id, (ts, event_id)) AS event_id, arg_max(sql_text, (ts, event_id)) AS sql_text
        FROM a GROUP BY 1""",
)
def g08(t):
    return g.latest_history(derived.audit(t), "user_id", "ts", "event_id", ["event_id", "sql_text"])


@query("G09_result_cache", "SELECT o_orderpriority, count(*) AS n, 2::INTEGER AS served FROM orders GROUP BY 1")
def g09(t):
    gate = gateway(t)
    first = gate.cached("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
    second = gate.cached("SELECT o_orderpriority,  count(*) AS n\nFROM orders GROUP BY 1")
    return second.withColumn("served", F.lit(2 if first is second else 1))


@query(
    "G10_mask_credentials",
    r"""SELECT page_id, regexp_replace(replace(url, '://', '://reader:pw' || page_id || '@'), '://[^@/]+@', '://***@') AS url
        FROM pages""",
)
def g10(t):
    url = F.replace("url", F.lit("://"), F.concat(F.lit("://reader:pw"), "page_id", F.lit("@")))
    return t.pages.select("page_id", g.mask_credentials(url).alias("url"))
