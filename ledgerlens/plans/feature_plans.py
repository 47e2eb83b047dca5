"""Feature tables."""

from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import profile as p
from ledgerlens.operators.warehouse import drop_reported, require
from ledgerlens.plans.registry import query


@query(
    "A12_behaviour_aggregates",
    """SELECT user_id, count(value) AS v_count, round(sum(value), 4) AS v_sum, round(avg(value), 6) AS v_mean, max(value) AS v_max, min(value) AS v_min,
              round(stddev_samp(value), 6) AS v_std FROM events GROUP BY 1""",
)
def a12(t):
    out = ft.aggregate_behaviour(t.events, "user_id", "value", "v")
    return out.select(
        "user_id", "v_count", F.round("v_sum", 4).alias("v_sum"), F.round("v_mean", 6).alias("v_mean"), "v_max", "v_min", F.round("v_std", 6).alias("v_std")
    )


@query("A13_active_days", "SELECT user_id, count(DISTINCT ts::DATE) AS active_days FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) >= 27")
def a13(t):
    return ft.active_days(t.events, "user_id", "ts", 27)


@query(
    "A14_sum_label",
    "SELECT user_id, round(sum(value), 4) AS label_value, (sum(value) >= 3300)::INTEGER AS label FROM events GROUP BY 1",
)
def a14(t):
    return ft.sum_label(t.events, "user_id", "value", 3300).withColumn("label_value", F.round("label_value", 4))


@query(
    "A15_high_activity",
    "WITH a AS (SELECT user_id, count(*) AS activity FROM events GROUP BY 1) SELECT * FROM a WHERE activity >= (SELECT quantile_cont(activity, 0.9) FROM a)",
)
def a15(t):
    return ft.high_activity(t.events, "user_id")


def tags(t):
    """Part names as '#' lists, some of them empty."""
    text = F.when(F.col("p_size") > 45, F.lit("")).when(F.col("p_size") > 40, F.lit(None)).otherwise(F.replace("p_name", F.lit(" "), F.lit("#")))
    return t.part.select("p_partkey", text.alias("tags"))


TAGS = "tg AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN '' WHEN p_size > 40 THEN NULL ELSE replace(p_name, ' ', '#') END AS tags FROM part)"
TERMS = f"""{TAGS}, tm AS (SELECT term, count(*) AS freq FROM (SELECT unnest(string_split(tags, '#')) AS term FROM tg) WHERE trim(term) <> '' GROUP BY 1),
  top AS (SELECT *, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM tm)"""


@query("K07_top_terms", f"WITH {TERMS} SELECT term, freq, rank::INTEGER AS rank FROM top WHERE rank <= 10")
def k07(t):
    return ft.top_terms(tags(t), "tags", "#", 10)


@query(
    "C11_list_expansion",
    f"""WITH {TAGS} SELECT p_partkey, coalesce(list_contains(string_split(tags, '#'), 'red'), false)::INTEGER AS tags_red,
          coalesce(list_contains(string_split(tags, '#'), 'ring'), false)::INTEGER AS tags_ring, coalesce(list_contains(string_split(tags, '#'), 'small'), false)::INTEGER AS tags_small,
          CASE WHEN tags IS NULL OR tags = '' THEN 0 ELSE len(string_split(tags, '#')) END::INTEGER AS tags_list_length, (tags IS NULL OR tags = '')::INTEGER AS tags_is_empty FROM tg""",
)
def c11(t):
    return ft.expand_list(tags(t), "tags", "#", ["red", "ring", "small"])


@query(
    "C12_identifier_list",
    f"""WITH {TERMS}, ct AS (SELECT unnest(['C' || (o_orderkey + 10000), 'C' || (o_custkey + 10000)]) AS term FROM orders),
        cr AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS rank FROM ct GROUP BY 1),
        bt AS (SELECT 'codes' AS field, term, rank FROM cr UNION ALL SELECT 'tags', term, rank FROM top),
        fl AS (SELECT field, bool_or(regexp_matches(term, '^\\d{{10,}}$|^C\\d+') AND rank <= 3) AS identifier_list, count(*) AS n FROM bt GROUP BY 1)
        SELECT field, identifier_list, (CASE WHEN identifier_list THEN 2 ELSE 2 + least(n, 10) END)::INTEGER AS columns FROM fl""",
)
def c12(t):
    codes = t.orders.select("o_orderkey", F.concat(F.lit("C"), (F.col("o_orderkey") + 10000).cast("string"), F.lit("#C"), (F.col("o_custkey") + 10000).cast("string")).alias("codes"))
    rows = []
    for df, col in ((codes, "codes"), (tags(t), "tags")):
        wide = ft.expand_list(df, col, "#", top=10)
        flag = ft.is_identifier_list(ft.top_terms(df, col, "#"))
        rows.append(flag.select(F.lit(col).alias("field"), "identifier_list", F.lit(len(wide.columns) - 1).alias("columns")))
    return rows[0].unionByName(rows[1])


def texts(t):
    """Text columns of three kinds."""
    return t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "xx", "n/a").otherwise(F.concat(F.lit(" "), F.col("n_chars").cast("string"))).alias("size_text"),
        F.when(F.col("n_chars") < 100, "").otherwise(F.concat_ws(",", "lang", "source")).alias("origin"),
        F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".0")).alias("version"),
    )


@query(
    "C09_text_casts",
    """SELECT doc_id, n_chars::DOUBLE AS size_text, CASE WHEN n_chars < 100 THEN 0 ELSE 2 END AS origin_list_length, (n_chars < 100)::INTEGER AS origin_is_empty,
              'v' || doc_id || '.0' AS version FROM documents""",
)
def c09(t):
    df = texts(t)
    rules = {r.column_name: r.rule for r in ft.text_cast_plan(df, ["size_text", "origin", "version"]).collect()}
    return ft.cast_texts(df, rules)


@query(
    "C10_tier_lookup",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '三线及以下' WHEN c_custkey % 11 = 2 THEN '未知'
              WHEN n_regionkey = 0 THEN '一线' WHEN n_regionkey = 1 THEN '二线' ELSE '三线及以下' END AS city_tier FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def c10(t):
    kind = F.col("c_custkey") % 11
    name = F.concat(F.lit("N "), F.col("c_nationkey").cast("string"))
    city = (
        F.when(kind == 0, "").when(kind == 1, F.concat(name, F.lit("县"))).when(kind == 2, "未知").when(kind == 3, F.concat(name, F.lit("市"))).otherwise(name)
    )
    tiers = t.nation.where("n_regionkey < 2").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_regionkey") == 0, "一线").otherwise("二线").alias("tier")
    )
    return ft.tier_by_lookup(t.customer.select("c_custkey", city.alias("city")), "city", tiers)


def user_base(t):
    """One row per customer: segment, a list column, a constant, a mostly missing column, label from orders."""
    tag = F.when(F.col("c_acctbal") > 9000, F.lit(None)).otherwise(F.concat_ws("#", F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    return t.customer.select(
        "c_custkey", "c_mktsegment", "c_acctbal", tag.alias("tags"), F.lit("x").alias("constant"), F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal")).alias("sparse")
    )


@query(
    "M01_cleaning_report",
    """SELECT * FROM (VALUES ('c_custkey', true, false, 'KEEP'), ('c_mktsegment', false, false, 'KEEP'), ('c_acctbal', false, false, 'KEEP'), ('tags', false, true, 'KEEP'),
         ('constant', false, false, 'DROP'), ('sparse', false, false, 'DROP')) x(feature, is_protected, is_list, recommendation)
       JOIN (SELECT 'c_custkey' AS feature, 0.0::DOUBLE AS missing_pct, count(*) AS n_unique FROM customer
         UNION ALL SELECT 'c_mktsegment', 0.0, count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', 0.0, count(DISTINCT c_acctbal) FROM customer
         UNION ALL SELECT 'constant', 0.0, 1 FROM customer GROUP BY ALL
         UNION ALL SELECT 'tags', round(count(*) FILTER (WHERE c_acctbal > 9000) * 100.0 / count(*), 6), count(DISTINCT CASE WHEN c_acctbal <= 9000 THEN c_mktsegment || c_nationkey END) FROM customer
         UNION ALL SELECT 'sparse', round(count(*) FILTER (WHERE c_acctbal <= 8000) * 100.0 / count(*), 6), count(DISTINCT CASE WHEN c_acctbal > 8000 THEN c_acctbal END) FROM customer) y USING (feature)""".replace(
        "1 FROM customer GROUP BY ALL", "1 WHERE (SELECT count(*) FROM customer) > 0"
    ),
)
def m01(t):
    values = p.long_values({"users": user_base(t)})
    return ft.cleaning_report(p.cleaning_profile(values), ["c_custkey"]).withColumn("missing_pct", F.round("missing_pct", 6))


WIDE_SQL = """SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, (c_acctbal <= 9000 AND c_mktsegment = 'BUILDING')::INTEGER AS tags_building,
    (c_acctbal <= 9000 AND c_mktsegment = 'MACHINERY')::INTEGER AS tags_machinery, (CASE WHEN c_acctbal > 9000 THEN 0 ELSE 2 END)::INTEGER AS tags_list_length,
    (c_acctbal > 9000)::INTEGER AS tags_is_empty, n.n_regionkey AS nation_n_regionkey, o.orders_count, round(o.orders_sum, 2) AS orders_sum, round(o.orders_mean, 6) AS orders_mean,
    o.orders_max, o.orders_min, round(o.orders_std, 4) AS orders_std, i.p_partkey AS item_p_partkey
  FROM customer c LEFT JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(o_totalprice) AS orders_count, sum(o_totalprice) AS orders_sum, avg(o_totalprice) AS orders_mean,
    max(o_totalprice) AS orders_max, min(o_totalprice) AS orders_min, stddev_samp(o_totalprice) AS orders_std FROM orders GROUP BY 1) o ON o_custkey = c_custkey,
    (SELECT max(p_partkey) AS p_partkey FROM part) i"""


def wide(t):
    """Users plus 1:1 attributes, order aggregates, expanded list and one item row; raw and useless columns gone."""
    base = user_base(t).join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    merged = ft.merge_one_to_one(base, "c_nationkey", {"nation": (t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey")}).drop("c_nationkey")
    values = p.long_values({"users": user_base(t)})
    cleaned = drop_reported(merged, ft.cleaning_report(p.cleaning_profile(values), ["c_custkey"]))
    orders = ft.aggregate_behaviour(t.orders, "o_custkey", "o_totalprice", "orders")
    joined = ft.join_behaviour(cleaned, "c_custkey", {"orders": (orders, "o_custkey")})
    expanded = ft.expand_list(joined, "tags", "#", ["building", "machinery"])
    return ft.attach_scalar_row(expanded, t.part.agg(F.max("p_partkey").alias("p_partkey")), "item")


@query("M02_wide_table", WIDE_SQL)
def m02(t):
    w = wide(t)
    digits = {"orders_sum": 2, "orders_mean": 6, "orders_std": 4}
    return w.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in w.columns])


@query(
    "M03_wide_gates",
    f"""WITH w AS ({WIDE_SQL}), names AS (SELECT column_name FROM (DESCRIBE {WIDE_SQL})), g AS (
         SELECT 'rows_unchanged' AS gate, (SELECT count(*) FROM w) AS observed, (SELECT count(*) FROM customer) AS expected
         UNION ALL SELECT 'key_unique', (SELECT count(*) FROM (SELECT c_custkey FROM w GROUP BY 1 HAVING count(*) > 1)), 0
         UNION ALL SELECT 'no_raw_columns', (SELECT count(*) FROM names WHERE column_name IN ('tags', 'city')), 0
         UNION ALL SELECT 'columns_agree', (SELECT count(*) FROM names WHERE column_name = 'orders_std'), 0)
       SELECT gate, observed::DOUBLE AS observed, expected::DOUBLE AS expected, observed = expected AS passed FROM g""",
)
def m03(t):
    w = wide(t)
    return ft.wide_gates(t.customer, w, "c_custkey", ["tags", "city"], [c for c in w.columns if c != "orders_std"])
