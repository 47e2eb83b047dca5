"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from ledgerlens.plans.registry import query
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers, schema, sinks


@query(
    "S01_csv_scan",
    "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
def s01(t):
    path = sinks.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), scratch_path(t.spark, "s01"))
    return readers.read_csv(t.spark, path)


@query(
    "S02_directory_scan",
    "SELECT 'region' AS table_name, count(*) AS n_rows FROM region UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{n}', count(*) FROM {n}"
        for n in (
            "nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
        ).split()
    ),
)
def s02(t):
    tables = readers.read_directory(t.spark, t.dir)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("S03_gbk_csv", "SELECT c_custkey::DOUBLE AS c_custkey, c_name, '客户' || c_mktsegment AS segment FROM customer")
def s03(t):
    df = t.customer.select("c_custkey", "c_name", F.concat(F.lit("客户"), "c_mktsegment").alias("segment"))
    path = sinks.write_csv(df, scratch_path(t.spark, "s03"), encoding="GBK")
    return readers.read_csv(t.spark, path, encoding="GBK")


@query(
    "S04_document_scan",
    """SELECT event_id, user_id, event_type, value, replace(props, ' ', '') AS props,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
       FROM events""",
)
def s04(t):
    path = scratch_path(t.spark, "s04")
    (
        t.events.withColumn("props", F.from_json("props", "k bigint"))
        .select("event_id", "user_id", "event_type", "value", "props")
        .write.json(path)
    )
    docs = readers.read_documents(t.spark, path)
    return docs.select(
        "event_id", "user_id", "event_type", "value", "props", F.from_json("props", "k bigint").getField("k").alias("k")
    )


@query(
    "S10_inspect_schema",
    """WITH n AS (SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL
                  SELECT 'orders', count(*) FROM orders UNION ALL
                  SELECT 'lineitem', count(*) FROM lineitem)
       SELECT c.table_name, c.column_name,
              CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                   WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE c.data_type END AS data_type,
              true AS nullable, '' AS comment, n.row_count
       FROM information_schema.columns c JOIN n ON n.table_name = c.table_name""",
)
def s10(t):
    tables = {n: getattr(t, n) for n in ("customer", "orders", "lineitem", "part")}
    return schema.inspect_schema(tables, allow=["customer", "orders", "lineitem"])


@query("S11_preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def s11(t):
    return schema.preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 50)


@query(
    "S12_hash_sample",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 1000",
)
def s12(t):
    return readers.hash_sample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000)


# The declared keys of the star schema.
KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey", "nation lies in region"),
    ("customer", "c_nationkey", "nation", "n_nationkey", "customer lives in nation"),
    ("supplier", "s_nationkey", "nation", "n_nationkey", "supplier sits in nation"),
    ("orders", "o_custkey", "customer", "c_custkey", "order placed by customer"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "line belongs to order"),
    ("lineitem", "l_partkey", "part", "p_partkey", "line sells part"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "line shipped by supplier"),
]


@query(
    "S13_declared_keys",
    " UNION ALL ".join(
        f"""SELECT '{c}.{cc}' AS child, '{p}.{pc}' AS parent, '{m}' AS comment,
                   (SELECT count(*) FROM {c} a WHERE a.{cc} IS NOT NULL
                     AND NOT EXISTS (SELECT 1 FROM {p} b WHERE b.{pc} = a.{cc})) AS orphan_rows"""
        for c, cc, p, pc, m in KEYS
    ),
)
def s13(t):
    names = {n for k in KEYS for n in (k[0], k[2])}
    return schema.check_foreign_keys({n: getattr(t, n) for n in names}, KEYS)


@query("S14_csv_sink", "SELECT doc_id::DOUBLE AS doc_id, lang, length(text) AS n_chars, md5(text) AS digest FROM documents")
def s14(t):
    path = sinks.write_csv(t.documents.select("doc_id", "lang", "text"), scratch_path(t.spark, "s14"))
    back = readers.read_csv(t.spark, path)
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("S15_ordered_export", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders")
def s15(t):
    path = sinks.export_ordered(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", scratch_path(t.spark, "s15"))
    return readers.read_csv(t.spark, path, multiline=False)


@query(
    "S16_step_table",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
       FROM orders GROUP BY 1""",
)
def s16(t):
    step = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )
    return sinks.materialise(step, scratch_path(t.spark, "s16"))


@query(
    "S17_partition_overwrite",
    """SELECT strftime(o_orderdate, '%Y%m') AS pt_m,
              count(*) FILTER (WHERE year(o_orderdate) <> 1997 OR o_orderstatus = 'F') AS rows_written
       FROM orders GROUP BY 1 HAVING rows_written > 0""",
)
def s17(t):
    path = scratch_path(t.spark, "s17")
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    sinks.overwrite_partitions(base, "o_orderdate", "month", path)
    sinks.overwrite_partitions(base.where("year(o_orderdate) = 1997 and o_orderstatus = 'F'"), "o_orderdate", "month", path)
    return sinks.written_counts(t.spark, path, "pt_m")


@query(
    "S18_written_check",
    """SELECT strftime(date_trunc('week', ts), '%Y%m%d') AS pt_w, count(*) AS rows_expected, count(*) AS rows_written,
              true AS passed
       FROM events GROUP BY 1""",
)
def s18(t):
    path = scratch_path(t.spark, "s18")
    sinks.overwrite_partitions(t.events.select("event_id", "ts"), "ts", "week", path)
    return sinks.check_written(t.events, "ts", "week", path)


@query(
    "S19_chart_series",
    """SELECT o_orderstatus AS series, strftime(o_orderdate, '%Y') AS label, round(sum(o_totalprice), 2) AS value
       FROM orders GROUP BY 1, 2""",
)
def s19(t):
    series = sinks.chart_series(
        t.orders, F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy"), F.col("o_totalprice")
    )
    return series.withColumn("value", F.round("value", 2))
