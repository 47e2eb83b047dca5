"""Frames derived from the given tables, each with the SQL text that builds the same rows."""

from pyspark.sql import functions as F

from ledgerlens.plans.registry import stored
from ledgerlens.session import written

# Statement log: one SQL text per event.
STATEMENTS_SQL = """
  SELECT event_id, user_id, ts, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type
           WHEN 'click' THEN 'SELECT user_id, value FROM events WHERE value > ' || json_extract_string(props, '$.k') || ' ; '
           WHEN 'view' THEN '-- by day' || chr(10) || 'WITH d AS (SELECT 1 AS x /* drop */) SELECT count(*) FROM d WHERE note = ''a; drop'''
           WHEN 'signup' THEN 'CREATE TABLE t' || json_extract_string(props, '$.k') || ' AS SELECT 1'
           WHEN 'purchase' THEN 'SELECT 1; SELECT ' || json_extract_string(props, '$.k')
           ELSE CASE WHEN value < 10 THEN 'select * from t where pragma = 1'
                     WHEN value < 20 THEN ' -- nothing here'
                     WHEN value < 40 THEN 'SELECT "load" FROM t WHERE a = ''it''''s; set'''
                     ELSE 'WITH x AS (SELECT 1) DELETE FROM t' END
         END AS sql_text
  FROM events"""


def statements(t):
    """Statement log: one SQL text per event."""
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        "value",
        k.cast("bigint").alias("k"),
        F.when(
            F.col("event_type") == "click", F.concat(F.lit("SELECT user_id, value FROM events WHERE value > "), k, F.lit(" ; "))
        )
        .when(
            F.col("event_type") == "view",
            F.lit("-- by day\nWITH d AS (SELECT 1 AS x /* drop */) SELECT count(*) FROM d WHERE note = 'a; drop'"),
        )
        .when(F.col("event_type") == "signup", F.concat(F.lit("CREATE TABLE t"), k, F.lit(" AS SELECT 1")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("SELECT 1; SELECT "), k))
        .otherwise(
            F.when(F.col("value") < 10, "select * from t where pragma = 1")
            .when(F.col("value") < 20, " -- nothing here")
            .when(F.col("value") < 40, "SELECT \"load\" FROM t WHERE a = 'it''s; set'")
            .otherwise("WITH x AS (SELECT 1) DELETE FROM t")
        )
        .alias("sql_text"),
    )


# Audit log: the outcome of each statement.
AUDIT_SQL = f"""
  SELECT event_id, user_id, ts, k, sql_text, value * 10 AS elapsed_ms, k % 7 = 0 AS favorite,
         CASE WHEN sql_text LIKE 'CREATE%' OR sql_text LIKE 'SELECT 1;%' THEN 'blocked'
              WHEN value > 150 THEN 'failed' ELSE 'succeeded' END AS status
  FROM ({STATEMENTS_SQL})"""


def audit(t):
    """Audit log: the outcome of each statement."""
    s = statements(t)
    return s.select(
        "event_id",
        "user_id",
        "ts",
        "k",
        "sql_text",
        (F.col("value") * 10).alias("elapsed_ms"),
        (F.col("k") % 7 == 0).alias("favorite"),
        F.when(F.col("sql_text").startswith("CREATE") | F.col("sql_text").startswith("SELECT 1;"), "blocked")
        .when(F.col("value") > 150, "failed")
        .otherwise("succeeded")
        .alias("status"),
    )


# Graph of the star schema: places, segments, brands, customers, suppliers and parts.
NODES_SQL = """
  SELECT 'region:' || r_regionkey AS id, 'entity' AS type, r_name AS name, 'region' AS table_name, 'place' AS semantic_type, 'part of the world' AS comment FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'concept', n_name, 'nation', 'place', 'country of a region' FROM nation
  UNION ALL SELECT DISTINCT 'segment:' || c_mktsegment, 'entity', c_mktsegment, 'segment', 'group', 'market segment' FROM customer
  UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'table', p_brand, 'brand', '', 'brand of parts' FROM part
  UNION ALL SELECT 'customer:' || c_custkey, 'column', c_name, 'customer', 'buyer', 'buys in ' || lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'column', s_name, 'supplier', 'seller', '' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'column', p_name, 'part', lower(p_type), 'sold as ' || p_brand FROM part"""

EDGES_SQL = """
  SELECT 'e1:' || c_custkey AS id, 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'represents' AS type,
         0.5 + (c_custkey % 50) / 100.0::DOUBLE AS confidence FROM customer
  UNION ALL SELECT 'e2:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'represents', 0.9 FROM supplier
  UNION ALL SELECT 'e3:' || n_nationkey, 'region:' || n_regionkey, 'nation:' || n_nationkey, 'has_concept', 0.8 FROM nation
  UNION ALL SELECT 'e4:' || c_custkey, 'customer:' || c_custkey, 'segment:' || c_mktsegment, 'foreign_key', 0.7 FROM customer
  UNION ALL SELECT 'e5:' || c_mktsegment || ':' || n_regionkey, 'segment:' || c_mktsegment, 'region:' || n_regionkey, 'joinable', round(count(*) / any_value(total), 4)
    FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer) JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment, n_regionkey
  UNION ALL SELECT 'e6:' || c_mktsegment || ':' || c_nationkey, 'segment:' || c_mktsegment, 'nation:' || c_nationkey, 'joinable', round(count(*) / any_value(total) * 10, 4)
    FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer) GROUP BY c_mktsegment, c_nationkey
  UNION ALL SELECT 'e7:' || p_partkey, 'brand:' || p_brand, 'part:' || p_partkey, 'contains', 1.0 FROM part
  UNION ALL SELECT 'e8:' || l_partkey || ':' || l_suppkey, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'joinable', round(avg(l_discount) * 10, 4)
    FROM lineitem GROUP BY l_partkey, l_suppkey"""


def nodes(t):
    """Graph nodes of the star schema, as a stored table."""
    return stored(t, "nodes", _nodes)


def edges(t):
    """Graph edges of the star schema, as a stored table."""
    return stored(t, "edges", _edges)


def _nodes(t):
    key = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))

    def row(df, node_id, kind, name, table, meaning, comment):
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(
            node_id.alias("id"),
            F.lit(kind).alias("type"),
            F.col(name).alias("name"),
            F.lit(table).alias("table_name"),
            lit(meaning).alias("semantic_type"),
            lit(comment).alias("comment"),
        )

    parts = [
        row(t.region, key("region", "r_regionkey"), "entity", "r_name", "region", "place", "part of the world"),
        row(t.nation, key("nation", "n_nationkey"), "concept", "n_name", "nation", "place", "country of a region"),
        row(t.customer, key("segment", "c_mktsegment"), "entity", "c_mktsegment", "segment", "group", "market segment").distinct(),
        row(t.part, key("brand", "p_brand"), "table", "p_brand", "brand", "", "brand of parts").distinct(),
        row(t.customer, key("customer", "c_custkey"), "column", "c_name", "customer", "buyer", F.concat(F.lit("buys in "), F.lower("c_mktsegment"))),
        row(t.supplier, key("supplier", "s_suppkey"), "column", "s_name", "supplier", "seller", ""),
        row(t.part, key("part", "p_partkey"), "column", "p_name", "part", F.lower("p_type"), F.concat(F.lit("sold as "), "p_brand")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _edges(t):
    key = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))

    def row(df, edge_id, source, target, kind, confidence):
        c = F.lit(confidence) if isinstance(confidence, float) else confidence
        return df.select(
            edge_id.alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), c.cast("double").alias("confidence")
        )

    total = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"))
    by_nation = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    by_region = (
        by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(F.sum("n").alias("n"))
    )
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("d"))
    two = lambda p, a, b: F.concat(F.lit(p + ":"), F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))
    parts = [
        row(t.customer, key("e1", "c_custkey"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "represents", 0.5 + (F.col("c_custkey") % 50) / 100.0),
        row(t.supplier, key("e2", "s_suppkey"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "represents", 0.9),
        row(t.nation, key("e3", "n_nationkey"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "has_concept", 0.8),
        row(t.customer, key("e4", "c_custkey"), key("customer", "c_custkey"), key("segment", "c_mktsegment"), "foreign_key", 0.7),
        row(
            by_region.join(total, "c_mktsegment"), two("e5", "c_mktsegment", "n_regionkey"), key("segment", "c_mktsegment"), key("region", "n_regionkey"),
            "joinable", F.round(F.col("n") / F.col("total"), 4),
        ),
        row(
            by_nation.join(total, "c_mktsegment"), two("e6", "c_mktsegment", "c_nationkey"), key("segment", "c_mktsegment"), key("nation", "c_nationkey"),
            "joinable", F.round(F.col("n") / F.col("total") * 10, 4),
        ),
        row(t.part, key("e7", "p_partkey"), key("brand", "p_brand"), key("part", "p_partkey"), "contains", 1.0),
        row(pairs, two("e8", "l_partkey", "l_suppkey"), key("part", "l_partkey"), key("supplier", "l_suppkey"), "joinable", F.round(F.col("d") * 10, 4)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Edges from orders that no node exists for yet.
ORDER_EDGES_SQL = """
  SELECT 'o:' || o_orderkey AS id, 'order:' || o_orderkey AS source_id, 'customer:' || o_custkey AS target_id, 'foreign_key' AS type,
         (o_orderkey % 10) / 10.0::DOUBLE AS confidence FROM orders"""


def order_edges(t):
    """Edges from orders that no node exists for yet."""
    return t.orders.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target_id"),
        F.lit("foreign_key").alias("type"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"),
    )


# Order features with a label: an order is positive when two or more of its lines were returned.
FEATURES_SQL = """
  SELECT o_orderkey AS user_id, coalesce(l.returned >= 2, false)::INTEGER AS label, o_totalprice AS f_price, o_orderpriority AS f_priority, o_orderstatus AS f_status,
         c_mktsegment AS f_segment, c_nationkey AS f_nation, c_acctbal AS f_balance, l.lines AS f_lines, l.qty AS f_qty, round(l.disc, 8) AS f_discount, 1 AS f_const,
         CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS f_sparse, o_orderdate, l.shipped
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (
    SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty, avg(l_discount) AS disc, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_shipdate) AS shipped
    FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
SPLIT_SQL = f"""SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(user_id::VARCHAR), user_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ({FEATURES_SQL}))"""
NUMERIC = ["f_price", "f_nation", "f_balance", "f_lines", "f_qty", "f_discount", "f_const", "f_sparse"]
TEXT = ["f_priority", "f_status", "f_segment"]


def features(t):
    """Order features with a label, as a stored table."""
    return stored(t, "features", _features)


def _features(t):
    from ledgerlens.operators.cohort import stratified_split

    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("f_lines"),
        F.sum("l_quantity").alias("f_qty"),
        F.round(F.avg("l_discount"), 8).alias("f_discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.max("l_shipdate").alias("shipped"),
    )
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    wide = j.select(
        F.col("o_orderkey").alias("user_id"),
        F.coalesce(F.col("returned") >= 2, F.lit(False)).cast("int").alias("label"),
        F.col("o_totalprice").alias("f_price"),
        F.col("o_orderpriority").alias("f_priority"),
        F.col("o_orderstatus").alias("f_status"),
        F.col("c_mktsegment").alias("f_segment"),
        F.col("c_nationkey").alias("f_nation"),
        F.col("c_acctbal").alias("f_balance"),
        "f_lines",
        "f_qty",
        "f_discount",
        F.lit(1).alias("f_const"),
        F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("f_sparse"),
        "o_orderdate",
        "shipped",
    )
    return stratified_split(written(wide, "wide"), "user_id", "label")


# Three scores per order: a smooth one, a tree-like one and a sum of points.
SCORES_SQL = f"""SELECT user_id, label,
    round(1 / (1 + exp(-(0.4 * coalesce(f_lines, 0) - 2.5 + coalesce(f_qty, 0) / 200.0))), 6) AS teacher_score,
    CASE WHEN f_lines IS NULL THEN 0.05 WHEN f_lines <= 3 THEN 0.1 WHEN f_lines <= 5 THEN CASE WHEN f_qty <= 120 THEN 0.4 ELSE 0.45 END ELSE 0.8 END::DOUBLE AS tree_score,
    round(coalesce(f_lines, 0) * 1.5 + CASE f_status WHEN 'F' THEN 0.5 WHEN 'O' THEN -0.5 ELSE 0 END + CASE WHEN f_discount > 0.05 THEN 0.25 ELSE 0 END, 2)::DOUBLE AS card_score
  FROM ({FEATURES_SQL})"""


def scores(t):
    """Three scores per order: a smooth one, a tree-like one and a sum of points."""
    lines, qty = F.coalesce(F.col("f_lines"), F.lit(0)), F.coalesce(F.col("f_qty"), F.lit(0.0))
    teacher = F.round(1 / (1 + F.exp(-(0.4 * lines - 2.5 + qty / 200.0))), 6)
    tree = (
        F.when(F.col("f_lines").isNull(), 0.05)
        .when(F.col("f_lines") <= 3, 0.1)
        .when(F.col("f_lines") <= 5, F.when(F.col("f_qty") <= 120, 0.4).otherwise(0.45))
        .otherwise(0.8)
    )
    points = F.when(F.col("f_status") == "F", 0.5).when(F.col("f_status") == "O", -0.5).otherwise(0.0)
    card = F.round(lines * 1.5 + points + F.when(F.col("f_discount") > 0.05, 0.25).otherwise(0.0), 2)
    return features(t).select("user_id", "label", teacher.alias("teacher_score"), tree.alias("tree_score"), card.alias("card_score"))


# Run log: one event per row of ``events``; times in microseconds.
RUNLOG_SQL = """
  SELECT event_id, user_id AS run_id, user_id // 10 AS session_id, CASE event_type WHEN 'signup' THEN 'model' WHEN 'error' THEN 'model' WHEN 'purchase' THEN 'hook' ELSE 'tool' END AS kind,
    CASE WHEN event_type IN ('signup', 'error') THEN 'm' || (k % 3) WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'pruner' ELSE 'saver' END ELSE 't' || (k % 5) END AS name,
    us AS start_us, CASE WHEN value < 0.2 THEN NULL WHEN value < 0.3 THEN us - 1000000 ELSE us + CAST(round(value * 600) AS BIGINT) * 1000000 END AS end_us,
    round(value * 600) * 1000 AS elapsed_ms, event_type <> 'error' AND NOT (event_type = 'click' AND k < 5) AS success,
    CASE WHEN k < 3 THEN 0 ELSE k * 37 END AS input_tokens, CASE WHEN k < 3 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS output_tokens,
    CASE WHEN k < 3 THEN 0 ELSE k * 37 + CAST(floor(value) AS BIGINT) + CASE WHEN value < 5 THEN 1 ELSE 0 END END AS total_tokens,
    CASE WHEN value >= 2 THEN round(100 / value, 4) END AS tokens_per_sec, k % 4 AS tool_calls, CASE WHEN k % 40 = 7 THEN 1 ELSE 0 END AS invalid_tool_calls,
    'c' || (k % 4) AS caller, CASE WHEN k % 2 = 0 THEN 'stream' ELSE 'batch' END AS call_mode, 'perf-' || user_id || '.jsonl' AS file, props AS output
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"""


def runlog(t):
    """Run log: one event per row of ``events``; times in microseconds."""
    from ledgerlens.operators.sequences import micros

    k = F.col("k")
    e = t.events.select("*", F.get_json_object("props", "$.k").cast("bigint").alias("k"), micros(F.col("ts")).alias("us"))
    model = F.col("event_type").isin("signup", "error")
    whole = F.round(F.col("value") * 600).cast("bigint")
    used = lambda c: F.when(k < 3, F.lit(0)).otherwise(c)
    out_tokens = F.floor("value").cast("bigint")
    return e.select(
        "event_id",
        F.col("user_id").alias("run_id"),
        F.expr("user_id div 10").alias("session_id"),
        F.when(model, "model").when(F.col("event_type") == "purchase", "hook").otherwise("tool").alias("kind"),
        F.when(model, F.concat(F.lit("m"), (k % 3).cast("string")))
        .when(F.col("event_type") == "purchase", F.when(k < 50, "pruner").otherwise("saver"))
        .otherwise(F.concat(F.lit("t"), (k % 5).cast("string")))
        .alias("name"),
        F.col("us").alias("start_us"),
        F.when(F.col("value") < 0.2, F.lit(None)).when(F.col("value") < 0.3, F.col("us") - 1000000).otherwise(F.col("us") + whole * 1000000).alias("end_us"),
        (F.round(F.col("value") * 600) * 1000).alias("elapsed_ms"),
        ((F.col("event_type") != "error") & ~((F.col("event_type") == "click") & (k < 5))).alias("success"),
        used(k * 37).alias("input_tokens"),
        used(out_tokens).alias("output_tokens"),
        used(k * 37 + out_tokens + F.when(F.col("value") < 5, 1).otherwise(0)).alias("total_tokens"),
        F.when(F.col("value") >= 2, F.round(100 / F.col("value"), 4)).alias("tokens_per_sec"),
        (k % 4).alias("tool_calls"),
        F.when(k % 40 == 7, 1).otherwise(0).alias("invalid_tool_calls"),
        F.concat(F.lit("c"), (k % 4).cast("string")).alias("caller"),
        F.when(k % 2 == 0, "stream").otherwise("batch").alias("call_mode"),
        F.concat(F.lit("perf-"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"),
        F.col("props").alias("output"),
    )


# Evaluation rows: two modes over the labelled documents.
EVAL_SQL = """
  SELECT d.doc_id AS question_id, d.source AS db_id, m.mode, CASE WHEN n_chars < 500 THEN 'simple' WHEN n_chars < 3000 THEN 'moderate' ELSE 'challenging' END AS difficulty,
    CASE WHEN n_chars < 60 THEN NULL WHEN m.mode = 'with' THEN quality = 1 ELSE quality = 1 AND n_chars % 3 > 0 END AS correct,
    n_chars % 11 + CASE m.mode WHEN 'with' THEN 2 ELSE 5 END AS tool_calls, n_chars * CASE m.mode WHEN 'with' THEN 3 ELSE 4 END AS tokens, n_chars * 7 AS duration_ms,
    CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'SELECT ' || n_chars END AS predicted_sql, CASE WHEN toxic = 1 THEN 'timeout' END AS error, n_chars % 17 = 0 AS deferred
  FROM documents d JOIN labels l USING (doc_id), (VALUES ('with'), ('without')) m(mode)"""


def evaluation(t):
    """Evaluation rows: two modes over the labelled documents."""
    n = F.col("n_chars")
    j = t.documents.join(t.labels, "doc_id").withColumn("mode", F.explode(F.array(F.lit("with"), F.lit("without"))))
    with_mode = F.col("mode") == "with"
    good = F.col("quality") == 1
    return j.select(
        F.col("doc_id").alias("question_id"),
        F.col("source").alias("db_id"),
        "mode",
        F.when(n < 500, "simple").when(n < 3000, "moderate").otherwise("challenging").alias("difficulty"),
        F.when(n < 60, F.lit(None)).when(with_mode, good).otherwise(good & (n % 3 > 0)).alias("correct"),
        (n % 11 + F.when(with_mode, 2).otherwise(5)).alias("tool_calls"),
        (n * F.when(with_mode, 3).otherwise(4)).alias("tokens"),
        (n * 7).alias("duration_ms"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("SELECT "), n.cast("string"))).alias("predicted_sql"),
        F.when(F.col("toxic") == 1, "timeout").alias("error"),
        (n % 17 == 0).alias("deferred"),
    )


# Sales: one row per order line with revenue and cost parts.
SALES_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey, c_mktsegment AS segment, p_type AS product, n_regionkey AS region, o_orderstatus AS status, o_orderpriority AS channel, o_orderdate,
    l_extendedprice AS revenue, l_quantity * p_retailprice AS goods, l_extendedprice * l_tax AS freight, l_extendedprice * l_discount + 0.0 AS discount,
    l_extendedprice - l_quantity * p_retailprice - l_extendedprice * l_tax - l_extendedprice * l_discount AS profit, l_returnflag = 'R' AS refunded
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""


def sales(t):
    """Sales: one row per order line with revenue and cost parts."""
    goods = F.col("l_quantity") * F.col("p_retailprice")
    freight, discount = F.col("l_extendedprice") * F.col("l_tax"), F.col("l_extendedprice") * F.col("l_discount")
    orders = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "c_mktsegment", "n_regionkey")
    )
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("c_mktsegment").alias("segment"),
        F.col("p_type").alias("product"),
        F.col("n_regionkey").alias("region"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("channel"),
        "o_orderdate",
        F.col("l_extendedprice").alias("revenue"),
        goods.alias("goods"),
        freight.alias("freight"),
        (discount + 0.0).alias("discount"),
        (F.col("l_extendedprice") - goods - freight - discount).alias("profit"),
        (F.col("l_returnflag") == "R").alias("refunded"),
    )
