"""Column and table profiles."""

from pyspark.sql import functions as F

from ledgerlens.operators import profile as p
from ledgerlens.plans.registry import query

COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "labels": ["doc_id", "quality", "toxic"],
}


def values_sql(columns):
    """Distinct values with counts, as SQL."""
    return " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {tb} GROUP BY {c}"
        for tb, cs in columns.items()
        for c in cs
    )


def values(t, columns=COLUMNS):
    return p.long_values({n: getattr(t, n) for n in columns}, columns)


def types(t, columns=COLUMNS):
    return p.column_types({n: getattr(t, n).select(*cs) for n, cs in columns.items()})


V = f"WITH v AS ({values_sql(COLUMNS)})"
#: All scalar columns of these tables, whole texts among them.
WIDE = {
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
TEXTS = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"],
    "pages": ["url", "html"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "conversations": ["role", "text"],
}
VT = f"WITH v AS ({values_sql(TEXTS)})"


def facts(t, columns):
    return p.table_stats({n: getattr(t, n) for n in columns}, columns)


STATS = """, s AS (SELECT table_name, column_name, sum(cnt)::BIGINT AS n_rows,
              coalesce(sum(cnt) FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS filled, count(value) AS n_distinct,
              min(value) AS lo, max(value) AS hi, count(TRY_CAST(value AS DOUBLE)) AS nums,
              min(TRY_CAST(value AS DOUBLE)) AS lon, max(TRY_CAST(value AS DOUBLE)) AS hin FROM v GROUP BY 1, 2)
       SELECT table_name, column_name, n_rows, filled, n_distinct,
              CASE WHEN nums <> n_distinct THEN lo END AS min_text, CASE WHEN nums <> n_distinct THEN hi END AS max_text,
              CASE WHEN nums = n_distinct THEN lon END AS min_number, CASE WHEN nums = n_distinct THEN hin END AS max_number,
              round((n_rows - filled) / n_rows, 6) AS null_rate FROM s"""


@query("A01_column_stats", V + STATS)
def a01(t):
    return p.column_stats(values(t)).withColumn("null_rate", F.round("null_rate", 6))


@query("A01_column_stats_of_texts", f"WITH v AS ({values_sql(WIDE)})" + STATS)
def a01_texts(t):
    """The same for tables with long texts, which stay where they are read."""
    return facts(t, WIDE).drop("min_length", "max_length", "avg_length").withColumn("null_rate", F.round("null_rate", 6))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "A02_numeric_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min({c})::DOUBLE + 0.0 AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 6) AS mean_value,
            round(stddev_samp({c}), 6) AS std_value, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median_value FROM lineitem"""
        for c in NUMBERS
    ),
)
def a02(t):
    out = p.numeric_stats(t.lineitem, NUMBERS)
    return out.select(
        "column_name",
        (F.col("min_value") + 0.0).alias("min_value"),
        "max_value",
        *[F.round(c, 6).alias(c) for c in ("mean_value", "std_value", "median_value")],
    )


@query(
    "A03_text_stats",
    VT
    + """ SELECT table_name, column_name, min(length(value))::INTEGER AS min_length, max(length(value))::INTEGER AS max_length,
           round(sum(length(value) * cnt) / sum(cnt), 6) AS avg_length FROM v WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def a03(t):
    return facts(t, TEXTS).select("table_name", "column_name", "min_length", "max_length", F.round("avg_length", 6).alias("avg_length"))


@query(
    "A04_top_values",
    V
    + """ SELECT table_name, column_name, rank::INTEGER AS rank, value, cnt, round(cnt / filled, 6) AS fraction FROM (
            SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS rank,
                   sum(cnt) OVER (PARTITION BY table_name, column_name) AS filled FROM v WHERE value IS NOT NULL)
          WHERE rank <= 10""",
)
def a04(t):
    return p.top_values(values(t)).withColumn("fraction", F.round("fraction", 6))


@query(
    "A05_histogram",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS cnt
            FROM (SELECT least(floor(({c} - lo) / w), 9)::INTEGER AS bin, lo, w FROM lineitem,
                  (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 10 AS w FROM lineitem)) GROUP BY bin, lo, w"""
        for c in ["l_quantity", "l_extendedprice", "l_tax"]
    ),
)
def a05(t):
    out = p.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("column_name", "bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "cnt")


@query(
    "A06_value_census",
    VT
    + """ SELECT table_name, column_name, trim(value) AS value, sum(cnt)::BIGINT AS cnt,
            round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY table_name, column_name), 8) AS share
          FROM v WHERE trim(value) <> '' GROUP BY 1, 2, 3""",
)
def a06(t):
    return p.value_census(values(t, TEXTS)).withColumn("share", F.round("share", 8))


@query(
    "A07_list_census",
    """SELECT 'part' AS table_name, 'tags' AS column_name, value, count(*) AS cnt FROM (
         SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 3
       UNION ALL SELECT 'part', 'p_brand', p_brand, count(*) FROM part GROUP BY 3""",
)
def a07(t):
    tags = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    part = t.part.select(tags.alias("tags"), "p_brand")
    return p.list_census(p.long_values({"part": part}))


CLASS_KEYS = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id", "lineitem": "l_orderkey", "nation": None, "part": None}


@query(
    "A08_table_class",
    "SELECT *, CASE WHEN unique_keys IS NULL THEN 'dimension' WHEN unique_keys = total_rows THEN 'one_to_one' ELSE 'one_to_many' END"
    " AS classification FROM ("
    + " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, count(*) AS total_rows, {f'count(DISTINCT {k})' if k else 'NULL::BIGINT'} AS unique_keys FROM {tb}"
        for tb, k in CLASS_KEYS.items()
    )
    + ")",
)
def a08(t):
    return p.table_class({n: getattr(t, n) for n in CLASS_KEYS}, CLASS_KEYS)


@query(
    "A09_cleaning_profile",
    V
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rn FROM v WHERE value <> '')
       SELECT s.*, sample_values FROM (
         SELECT table_name, column_name, round(sum(CASE WHEN value IS NULL OR value = '' THEN cnt ELSE 0 END) * 100.0 / sum(cnt), 6) AS missing_pct,
                count(*) FILTER (WHERE value <> '') AS n_unique FROM v GROUP BY 1, 2) s
       LEFT JOIN (SELECT table_name, column_name, string_agg(value, ',' ORDER BY value) AS sample_values FROM r WHERE rn <= 5 GROUP BY 1, 2) x
         USING (table_name, column_name)""",
)
def a09(t):
    return p.cleaning_profile(values(t)).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "A10_key_validation",
    """WITH k AS (SELECT quality AS k, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
       SELECT sum(n)::BIGINT AS n_rows, count(k) AS n_keys, round(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) / sum(n), 6) AS null_rate,
              max(n) FILTER (WHERE k IS NOT NULL) AS max_duplication, max(n) FILTER (WHERE k IS NOT NULL) = 1 AS is_unique FROM k""",
)
def a10(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return p.key_validation(joined, "quality").withColumn("null_rate", F.round("null_rate", 6))


@query(
    "A11_label_gate",
    """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_users, count(*) FILTER (WHERE label IS NULL OR label = '') AS n_label_missing,
              count(*) FILTER (WHERE label NOT IN ('0', '1') AND label <> '') AS n_label_invalid,
              count(*) FILTER (WHERE label = '0') AS n_negative, count(*) FILTER (WHERE label = '1') AS n_positive
       FROM (SELECT d.doc_id, CASE WHEN d.n_chars > 10000 THEN 'long' WHEN d.n_chars < 20 THEN '' ELSE CAST(l.quality AS VARCHAR) END AS label
             FROM documents d LEFT JOIN labels l USING (doc_id))""",
)
def a11(t):
    label = F.when(F.col("n_chars") > 10000, "long").when(F.col("n_chars") < 20, "").otherwise(F.col("quality").cast("string"))
    return p.label_gate(t.documents.join(t.labels, "doc_id", "left").select("doc_id", label.alias("label")), "doc_id", "label")


@query(
    "A26_char_entropy",
    f"""WITH v AS ({values_sql({**TEXTS, "documents": ["text"]})}),
        c AS (SELECT table_name, column_name, ch, count(*) AS n FROM (
                SELECT table_name, column_name, unnest(string_split(value, '')) AS ch FROM v WHERE value <> '') GROUP BY 1, 2, 3),
        s AS (SELECT *, sum(n) OVER (PARTITION BY table_name, column_name) AS total FROM c)
        SELECT table_name, column_name, round(-sum(n / total * log2(n / total)), 5) AS entropy FROM s GROUP BY 1, 2""",
)
def a26(t):
    out = p.char_entropy(values(t, {**TEXTS, "documents": ["text"]}))
    return out.withColumn("entropy", F.round("entropy", 5))


@query(
    "A29_approx_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, true AS within_tenth WHERE (SELECT count(*) FROM lineitem) > 0" for c in ["l_orderkey", "l_partkey", "l_suppkey"]
    ),
)
def a29(t):
    cols = ["l_orderkey", "l_partkey", "l_suppkey"]
    exact = p.column_stats(p.long_values({"lineitem": t.lineitem}, {"lineitem": cols})).select("column_name", "n_distinct")
    near = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= F.col("n_distinct") * 0.1
    return p.approx_distinct(t.lineitem, cols).join(exact, "column_name").select("column_name", near.alias("within_tenth"))


# DuckDB spells the same patterns; only the ones with a quote differ in writing.
def _rx(pattern):
    return pattern.replace("'", "''")


FORMS = """forms AS (SELECT 'orders' AS table_name, 'day' AS column_name, strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS cnt FROM orders GROUP BY 3
  UNION ALL SELECT 'customer', 'contact', lower(replace(c_name, '#', '.')) || '@example.com', count(*) FROM customer GROUP BY 3
  UNION ALL SELECT 'customer', 'zip', CAST(10000 + c_custkey AS VARCHAR), count(*) FROM customer GROUP BY 3
  UNION ALL SELECT 'pages', 'url', url, count(*) FROM pages GROUP BY 3
  UNION ALL SELECT 'events', 'ts', strftime(ts, '%Y-%m-%d %H:%M:%S'), count(*) FROM events GROUP BY 3
  UNION ALL SELECT 'events', 'props', props, count(*) FROM events GROUP BY 3)"""


def forms(t):
    """Text columns of several forms, derived from whole tables."""
    tables = {
        "orders": t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")),
        "customer": t.customer.select(
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("contact"),
            (F.col("c_custkey") + 10000).cast("string").alias("zip"),
        ),
        "pages": t.pages.select("url"),
        "events": t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "props"),
    }
    return tables


@query(
    "C01_value_patterns",
    f"WITH {FORMS} "
    + " UNION ALL ".join(
        f"""SELECT table_name, column_name, '{n}' AS pattern, round(sum(CASE WHEN regexp_matches(value, '{_rx(rx)}') THEN cnt ELSE 0 END) / sum(cnt), 6) AS share,
            sum(CASE WHEN regexp_matches(value, '{_rx(rx)}') THEN cnt ELSE 0 END) / sum(cnt) > 0.8 AS found FROM forms GROUP BY 1, 2"""
        for n, rx, _ in p.VALUE_PATTERNS
    ),
)
def c01(t):
    return p.pattern_shares(p.long_values(forms(t))).withColumn("share", F.round("share", 6))


@query(
    "C02_semantic_types",
    """SELECT * FROM (VALUES
      ('orders', 'day', 'datetime', 'date'), ('customer', 'contact', 'string', 'email_address'), ('customer', 'zip', 'integer', 'postal_code'),
      ('pages', 'url', 'string', 'url'), ('events', 'ts', 'datetime', 'datetime'), ('events', 'props', 'string', 'unknown'),
      ('part', 'p_name', 'string', 'person_name'), ('part', 'p_type', 'string', 'type_enum'), ('part', 'p_partkey', 'integer', 'identifier'),
      ('part', 'p_size', 'integer', 'unknown'), ('labels', 'doc_id', 'integer', 'identifier'), ('labels', 'quality', 'integer_boolean', 'boolean_flag')
    ) x(table_name, column_name, dtype, semantic_type)
    WHERE (SELECT count(*) FROM part) > 0""",
)
def c02(t):
    tables = {
        **forms(t),
        "part": t.part.select("p_name", "p_type", "p_partkey", "p_size"),
        "labels": t.labels.select("doc_id", "quality"),
    }
    v = p.long_values(tables)
    dtypes = p.inferred_types(v, p.column_types(tables))
    return p.semantic_types(p.column_stats(v), p.pattern_shares(v), dtypes)


@query(
    "C03_inferred_types",
    f"""WITH v AS ({values_sql({k: COLUMNS[k] for k in ("customer", "labels")})}
          UNION ALL SELECT 'events', 'k', json_extract_string(props, '$.k'), count(*) FROM events GROUP BY 3
          UNION ALL SELECT 'events', 'amount', CAST(value AS VARCHAR), count(*) FROM events GROUP BY 3
          UNION ALL SELECT 'events', 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 3
          UNION ALL SELECT 'events', 'is_error', CASE WHEN event_type = 'error' THEN '1' ELSE '0' END, count(*) FROM events GROUP BY 3),
        f AS (SELECT table_name, column_name, sum(cnt) FILTER (WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL) / sum(cnt) AS num,
                sum(cnt) FILTER (WHERE TRY_CAST(value AS TIMESTAMP) IS NOT NULL) / sum(cnt) AS dt,
                bool_and(TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE))) AS whole,
                bool_and(TRY_CAST(value AS DOUBLE) IN (0, 1)) AS bin FROM v GROUP BY 1, 2)
        SELECT table_name, column_name, CASE WHEN column_name IN ('c_custkey', 'doc_id') THEN 'bigint'
             WHEN column_name IN ('c_nationkey', 'quality', 'toxic') THEN 'int' WHEN column_name = 'c_acctbal' THEN 'double' ELSE 'string' END AS data_type,
             CASE WHEN num > 0.9 AND bin THEN 'integer_boolean' WHEN num > 0.9 AND whole THEN 'integer' WHEN num > 0.9 THEN 'float'
                  WHEN dt > 0.9 THEN 'datetime' ELSE 'string' END AS dtype FROM f""",
)
def c03(t):
    tables = {
        "customer": t.customer,
        "labels": t.labels,
        "events": t.events.select(
            F.get_json_object("props", "$.k").alias("k"),
            F.col("value").cast("string").alias("amount"),
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            F.when(F.col("event_type") == "error", "1").otherwise("0").alias("is_error"),
        ),
    }
    return p.inferred_types(p.long_values(tables), p.column_types(tables))


@query(
    "C04_column_lanes",
    """SELECT table_name, column_name, data_type, opaque_share::DOUBLE AS opaque_share, lane
       FROM (VALUES ('customer', 'c_custkey', 'bigint', 0.0, 'range'), ('customer', 'c_mktsegment', 'string', 0.0, 'domain'),
        ('customer', 'token', 'string', 1.0, 'range'), ('customer', 'cipher', 'string', 0.0, 'skip'), ('orders', 'o_orderdate', 'timestamp_ntz', 0.0, 'range'),
        ('orders', 'o_orderstatus', 'string', 0.0, 'domain'), ('events', 'user_id', 'bigint', 0.0, 'domain')) x(table_name, column_name, data_type, opaque_share, lane)
       WHERE (SELECT count(*) FROM customer) > 0""",
)
def c04(t):
    cipher = F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("c_name"), 256))), "=", "+")
    tables = {
        "customer": t.customer.select("c_custkey", "c_mktsegment", F.md5("c_name").alias("token"), cipher.alias("cipher")),
        "orders": t.orders.select("o_orderdate", "o_orderstatus"),
        "events": t.events.select("user_id"),
    }
    v = p.long_values(tables)
    out = p.column_lanes(v, p.column_stats(v), p.column_types(tables), [("customer", "c_custkey")])
    return out.withColumn("opaque_share", F.round("opaque_share", 6))


@query(
    "C05_value_forms",
    f"""WITH v AS ({values_sql({"customer": ["c_custkey", "c_name", "c_mktsegment"], "part": ["p_brand", "p_size"]})}
           UNION ALL SELECT 'documents', 'text', text, count(*) FROM documents WHERE length(trim(text)) > 0 GROUP BY 3),
        f AS (SELECT table_name, column_name, bool_and(regexp_matches(trim(value), '^[0-9]+$')) AS dg,
                bool_or(regexp_matches(trim(value), '[一-鿿]')) AS cjk, bool_and(regexp_matches(trim(value), '^[\\x00-\\x7f]+$')) AS ascii,
                min(trim(value)) AS lo, max(trim(value)) AS hi, count(*) AS n,
                count(*) FILTER (WHERE regexp_matches(trim(value), '{p.SENTINEL}')) AS n_sentinels FROM v WHERE trim(value) <> '' GROUP BY 1, 2)
        SELECT table_name, column_name, CASE WHEN dg THEN 'digit' WHEN cjk THEN 'cjk' WHEN ascii THEN 'ascii' ELSE 'mixed' END AS charset,
          CASE WHEN n >= 2 AND plen >= 2 THEN substr(lo, 1, plen::INTEGER) END AS prefix, n_sentinels FROM (
            SELECT *, coalesce((SELECT min(i) - 1 FROM range(1, length(lo) + 1) r(i) WHERE substr(lo, 1, i::INTEGER) <> substr(hi, 1, i::INTEGER)), length(lo)) AS plen
            FROM f)""",
)
def c05(t):
    tables = {
        "customer": t.customer.select("c_custkey", "c_name", "c_mktsegment"),
        "part": t.part.select("p_brand", "p_size"),
        "documents": t.documents.select("text"),
    }
    return p.value_forms(p.long_values(tables))


@query(
    "C06_closed_domains",
    """WITH s AS (SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS n FROM orders
         UNION ALL SELECT 'orders', 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
         UNION ALL SELECT 'part', 'p_type', count(DISTINCT p_type) FROM part
         UNION ALL SELECT 'part', 'p_name', count(DISTINCT p_name) FROM part
         UNION ALL SELECT 'labels', 'toxic', count(DISTINCT toxic) FROM labels
         UNION ALL SELECT 'lineitem', 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem)
       SELECT table_name, column_name, column_name NOT IN ('o_orderpriority', 'p_name') AND n <= 32 AS closed_dictionary,
              column_name NOT IN ('o_orderpriority', 'p_name') AND n BETWEEN 2 AND 32 AS closed_codes FROM s""",
)
def c06(t):
    tables = {
        "orders": t.orders.select("o_orderstatus", "o_orderpriority"),
        "part": t.part.select("p_type", "p_name"),
        "labels": t.labels.select("toxic"),
        "lineitem": t.lineitem.select("l_linestatus"),
    }
    v = p.long_values(tables)
    stats = p.column_stats(v)
    return p.closed_domains(v, p.column_lanes(v, stats, p.column_types(tables)), stats)


@query(
    "C07_comment_codes",
    """SELECT p_partkey, p_brand AS code, p_type AS label FROM part WHERE p_brand <> p_type
       UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR), 'size' FROM part""",
)
def c07(t):
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    text = F.concat(brand, F.lit("="), "p_type", F.lit(", "), F.col("p_size").cast("string"), F.lit(" - size; x=x"))
    rows = p.comment_codes(t.part.select("p_partkey", text.alias("comment")), "p_partkey", "comment")
    return rows.withColumn("code", F.replace("code", F.lit("_"), F.lit("#")))


@query(
    "C13_list_delimiter",
    """SELECT 'part' AS table_name, 'hashes' AS column_name, CASE WHEN bool_or(contains(p_name, ' ')) THEN '#' END AS delimiter FROM part
       UNION ALL SELECT 'part', 'carets', CASE WHEN bool_or(contains(p_name, ' ')) THEN '^' END FROM part
       UNION ALL SELECT 'part', 'p_type', CASE WHEN bool_or(contains(p_type, '#')) THEN '#' WHEN bool_or(contains(p_type, '^')) THEN '^' END FROM part""",
)
def c13(t):
    part = t.part.select(
        F.replace("p_name", F.lit(" "), F.lit("#")).alias("hashes"), F.replace("p_name", F.lit(" "), F.lit("^")).alias("carets"), "p_type"
    )
    return p.list_delimiter(p.long_values({"part": part}))
