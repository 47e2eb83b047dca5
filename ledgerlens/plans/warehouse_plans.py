"""Warehouse building blocks."""

from pyspark.sql import functions as F

from ledgerlens.functions import predicates as pr
from ledgerlens.operators import sequences as sq
from ledgerlens.operators import warehouse as w
from ledgerlens.plans.registry import query

T0 = "2024-01-15"


@query("F01_drop_reported", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def f01(t):
    from ledgerlens.operators import features, profile

    df = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "quality", F.when(F.col("toxic") == 1, 1).alias("mostly_missing"), F.lit(7).alias("constant")
    )
    values = profile.long_values({"docs": df})
    report = features.cleaning_report(profile.cleaning_profile(values), protect=["doc_id", "quality"])
    return w.drop_reported(df, report)


@query("F02_required_attributes", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE trim(lang) <> ''")
def f02(t):
    return w.require(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang"]).select("doc_id", "quality")


@query(
    "F03_time_windows",
    """SELECT user_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-22') AS label_rows,
              count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15') AS lookback_rows,
              count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS through_rows FROM events GROUP BY 1""",
)
def f03(t):
    ts = F.col("ts")
    return t.events.groupBy("user_id").agg(
        F.count_if(pr.in_label_window(ts, T0, 7)).alias("label_rows"),
        F.count_if(pr.in_lookback(ts, T0, 7)).alias("lookback_rows"),
        F.count_if(pr.through(ts, T0)).alias("through_rows"),
    )


@query("F04_valid_key", "SELECT event_id, CASE WHEN value < 5 THEN '' ELSE 'u' || user_id END AS k FROM events WHERE value >= 5 AND event_type <> 'error'")
def f04(t):
    key = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("value") < 5, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    df = t.events.select("event_id", key.alias("k"))
    return df.where(pr.present(F.col("k")))


@query("F05_text_key_join", "SELECT d.doc_id, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def f05(t):
    texts = t.labels.select(F.col("doc_id").cast("string").alias("key"), "toxic")
    return t.documents.join(texts, pr.same_key(F.col("doc_id"), F.col("key"))).select("doc_id", "toxic")


@query(
    "F06_scope_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#3')",
)
def f06(t):
    scope = t.part.where("p_type = 'PROMO'").unionByName(t.part.where("p_brand = 'Brand#3'"))
    return w.in_scope(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", scope, "p_partkey")


@query(
    "F07_recent_days",
    """SELECT event_type, count(*) FILTER (WHERE ts::DATE > DATE '2024-01-08' AND ts::DATE <= DATE '2024-01-15') AS with_anchor,
              count(*) FILTER (WHERE ts::DATE >= DATE '2024-01-08' AND ts::DATE < DATE '2024-01-15') AS without_anchor FROM events GROUP BY 1""",
)
def f07(t):
    day = F.to_date("ts")
    return t.events.groupBy("event_type").agg(
        F.count_if(pr.recent_days(day, T0, 7)).alias("with_anchor"), F.count_if(pr.recent_days(day, T0, 7, False)).alias("without_anchor")
    )


@query(
    "F08_null_policy",
    """SELECT doc_id, CASE WHEN n_chars > 5000 THEN NULL ELSE source END AS category, coalesce(toxic, 0) AS toxic
       FROM documents LEFT JOIN labels USING (doc_id) WHERE trim(lang) <> ''""",
)
def f08(t):
    df = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", F.when(F.col("n_chars") <= 5000, F.col("source")).alias("category"), "toxic"
    )
    return w.null_policy(df, ["lang"], ["toxic"]).drop("lang")


@query(
    "F09_safe_ratio",
    """SELECT l_orderkey, CAST(CAST(CASE WHEN sum(l_extendedprice * l_tax) > 0 THEN sum(l_extendedprice) / sum(l_extendedprice * l_tax) ELSE 0 END AS DECIMAL(26,2)) AS DOUBLE) AS ratio
       FROM lineitem GROUP BY 1""",
)
def f09(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("d"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("x"))
    return g.select("l_orderkey", pr.safe_ratio(F.col("d"), F.col("x")).cast("double").alias("ratio"))


@query("F10_fallback", "SELECT doc_id, CASE WHEN quality = 1 THEN 'q' || quality ELSE 's:' || source END AS tag FROM documents LEFT JOIN labels USING (doc_id)")
def f10(t):
    df = t.documents.join(t.labels, "doc_id", "left")
    tag = pr.fallback(F.concat(F.lit("q"), F.col("quality").cast("string")), F.col("quality") == 1, F.concat(F.lit("s:"), "source"))
    return df.select("doc_id", tag.alias("tag"))


@query(
    "F11_one_per_key",
    "SELECT l_partkey, l_suppkey, max((l_quantity, l_extendedprice)).l_quantity AS l_quantity, max((l_quantity, l_extendedprice)).l_extendedprice AS l_extendedprice FROM lineitem GROUP BY 1, 2".replace(
        "max((l_quantity, l_extendedprice))", "max({'l_quantity': l_quantity, 'l_extendedprice': l_extendedprice})"
    ),
)
def f11(t):
    return w.one_per_key(t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["l_partkey", "l_suppkey"], ["l_quantity"])


@query(
    "J09_as_of",
    """SELECT e.event_id, e.user_id, e.value, p.event_id AS matched_event_id, p.value AS matched_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
       LEFT JOIN LATERAL (SELECT event_id, value FROM events q WHERE q.event_type = 'purchase' AND q.user_id = e.user_id AND q.ts <= e.ts
                          ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) p ON true""",
)
def j09(t):
    left = t.events.where("event_type <> 'purchase'").select("user_id", "event_id", "ts", "value")
    right = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    return sq.as_of(left, right, ["user_id"], "ts", "ts", ["event_id", "value"]).select("event_id", "user_id", "value", "matched_event_id", "matched_value")


@query(
    "J16_growing_windows",
    "SELECT user_id, "
    + ", ".join(
        f"""count(*) FILTER (WHERE ts::DATE > DATE '2024-01-20' - {n} AND ts::DATE <= DATE '2024-01-20') AS rows_{n}d,
            round(coalesce(sum(value) FILTER (WHERE ts::DATE > DATE '2024-01-20' - {n} AND ts::DATE <= DATE '2024-01-20'), 0), 4) AS value_{n}d"""
        for n in (1, 7, 14)
    )
    + " FROM events WHERE ts::DATE > DATE '2024-01-20' - 14 AND ts::DATE <= DATE '2024-01-20' GROUP BY 1",
)
def j16(t):
    out = w.growing_windows(t.events, "user_id", F.to_date("ts"), "2024-01-20", [1, 7, 14], "value")
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("value") else F.col(c) for c in out.columns])


@query(
    "J17_fact_dimension",
    """SELECT event_id, user_id, o_orderpriority, o_orderkey FROM events LEFT JOIN (
         SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
         FROM orders GROUP BY 1) ON o_custkey = user_id""",
)
def j17(t):
    fact = t.events.select("event_id", "user_id")
    return w.with_dimension(fact, t.orders, "user_id", "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_orderkey"])


@query(
    "W01_top_n_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
       WHERE rank <= 3""",
)
def w01(t):
    return w.top_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query(
    "W02_islands",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS a FROM d)
       SELECT user_id, CAST(min(day) AS VARCHAR) AS start_day, CAST(max(day) AS VARCHAR) AS end_day, count(*) AS days FROM r GROUP BY user_id, a""",
)
def w02(t):
    out = w.islands(t.events, "user_id", F.col("ts"))
    return out.select("user_id", F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"), "days")


DAILY = "d AS (SELECT o_orderstatus, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2)"


def daily(t):
    return t.orders.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(
    "W03_lags",
    f"""WITH {DAILY} SELECT o_orderstatus, CAST(day AS VARCHAR) AS day, revenue, """
    + ", ".join(f"lag(revenue, {n}) OVER (PARTITION BY o_orderstatus ORDER BY d.day) AS revenue_lag_{n}" for n in (1, 7, 30))
    + " FROM d",
)
def w03(t):
    return w.lags(daily(t), ["o_orderstatus"], "day", "revenue").withColumn("day", F.col("day").cast("string"))


@query(
    "W04_rolling",
    f"""WITH {DAILY} SELECT o_orderstatus, CAST(day AS VARCHAR) AS day, revenue, """
    + ", ".join(
        f"""round(avg(revenue) OVER (PARTITION BY o_orderstatus ORDER BY d.day ROWS {n - 1} PRECEDING), 6) AS revenue_mean_{n},
            round(stddev_samp(revenue) OVER (PARTITION BY o_orderstatus ORDER BY d.day ROWS {n - 1} PRECEDING), 2) AS revenue_std_{n}"""
        for n in (7, 30)
    )
    + " FROM d",
)
def w04(t):
    out = w.rolling(daily(t), ["o_orderstatus"], "day", "revenue").withColumn("day", F.col("day").cast("string"))
    return out.select(*[F.round(c, 6 if "_mean_" in c else 2).alias(c) if "_mean_" in c or "_std_" in c else F.col(c) for c in out.columns])


@query(
    "W12_latest_sequence",
    """SELECT user_id, string_agg(event_type, '>' ORDER BY rn) AS sequence FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10 GROUP BY 1""",
)
def w12(t):
    return w.latest_sequence(t.events, "user_id", ["ts", "event_id"], "event_type", 10, ">")


@query(
    "W13_period_over_period",
    """SELECT event_type, c AS current_rows, p AS previous_rows, round(cv, 4) AS current_value, round(pv, 4) AS previous_value, round((cv - pv) / pv, 6) AS change FROM (
         SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS c, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS p,
                coalesce(sum(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 0) AS cv, coalesce(sum(value) FILTER (WHERE ts < TIMESTAMP '2024-01-15'), 0) AS pv
         FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1)""",
)
def w13(t):
    out = w.period_over_period(t.events, ["event_type"], "ts", "value", T0)
    return out.select(
        "event_type", "current_rows", "previous_rows", *[F.round(c, 4).alias(c) for c in ("current_value", "previous_value")], F.round("change", 6).alias("change")
    )


@query(
    "C14_date_parts",
    """SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour,
              CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events""",
)
def c14(t):
    return w.date_parts(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(
    "C15_outlier_treatment",
    """WITH q AS (SELECT quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99 FROM events),
       f AS (SELECT event_id, ln(1 + value) AS lg, least(greatest(value, p1), p99) AS cl, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS o FROM events, q)
       SELECT event_id, round(lg, 6) AS value_log, round(cl, 6) AS value_clip, o AS is_outlier, round(avg(o::INTEGER) OVER (), 6) AS outlier_rate,
              CASE WHEN avg(o::INTEGER) OVER () < 0.01 THEN 'drop' WHEN avg(o::INTEGER) OVER () <= 0.05 THEN 'winsorize' ELSE 'bin' END AS advice FROM f""",
)
def c15(t):
    rate = w.outlier_rate(t.events, "value")
    return w.outlier_treatment(t.events, "value").select(
        "event_id", F.round("value_log", 6).alias("value_log"), F.round("value_clip", 6).alias("value_clip"), "is_outlier",
        F.round(rate.select("outlier_rate").scalar(), 6).alias("outlier_rate"), rate.select("advice").scalar().alias("advice"),
    )


@query(
    "C16_scaling",
    """WITH q AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2,
                         quantile_cont(c_acctbal, 0.75) AS q3, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
       SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal_standard, round((c_acctbal - q2) / (q3 - q1), 6) AS c_acctbal_robust,
              round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal_minmax FROM customer, q""",
)
def c16(t):
    out = w.scaled(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_FOLD = "('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7))::BIGINT % 5"


@query(
    "C17_encodings",
    f"""WITH b AS (SELECT *, {_FOLD} AS fold FROM part),
        c AS (SELECT p_brand, fold, sum(p_retailprice) AS s, count(*) AS n FROM b GROUP BY 1, 2), tt AS (SELECT p_brand, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1),
        nm AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
        SELECT p_partkey, (p_type = 'LARGE')::INTEGER AS "p_type_LARGE", (p_type = 'MEDIUM')::INTEGER AS "p_type_MEDIUM", (p_type = 'PROMO')::INTEGER AS "p_type_PROMO",
          (p_type = 'SMALL')::INTEGER AS "p_type_SMALL", (p_type = 'STANDARD')::INTEGER AS "p_type_STANDARD",
          round(tt.n / (SELECT count(*) FROM part), 6) AS p_brand_freq,
          round(CASE WHEN tt.n - c.n > 0 THEN (tt.s - c.s) / (tt.n - c.n) ELSE (SELECT avg(p_retailprice) FROM part) END, 6) AS p_brand_target,
          CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS p_type_ord,
          CASE WHEN nm.n / (SELECT count(*) FROM part) < 0.015 THEN 'Other' ELSE p_name END AS p_name_merged, p_type || '|' || p_brand AS p_type_x_p_brand
        FROM b JOIN c USING (p_brand, fold) JOIN tt USING (p_brand) JOIN nm USING (p_name)""",
)
def c17(t):
    df = w.one_hot(t.part, "p_type")
    df = w.frequency_encoding(df, "p_brand")
    df = w.target_encoding(df, "p_brand", "p_retailprice", "p_partkey")
    df = w.merge_rare(w.ordinal_encoding(df, "p_type", ["SMALL", "MEDIUM", "LARGE"]), "p_name", 0.015)
    df = w.cross_text(df, "p_type", "p_brand")
    hot = [c for c in df.columns if c.startswith("p_type_") and c not in ("p_type_ord", "p_type_x_p_brand")]
    return df.select(
        "p_partkey", *hot, F.round("p_brand_freq", 6).alias("p_brand_freq"), F.round("p_brand_target", 6).alias("p_brand_target"),
        "p_type_ord", "p_name_merged", "p_type_x_p_brand",
    )


_PF = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "C18_product_features",
    "SELECT feature_a, feature_b, round(baseline, 6) AS baseline, round(product_corr, 6) AS product_corr, product_corr > baseline * 1.1 AS kept FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, greatest(abs(corr({a}, l_extendedprice)), abs(corr({b}, l_extendedprice))) AS baseline,
            abs(corr({a} * {b}, l_extendedprice)) AS product_corr FROM lineitem"""
        for i, a in enumerate(_PF)
        for b in _PF[i + 1 :]
    )
    + ")",
)
def c18(t):
    out = w.product_features(t.lineitem, _PF, "l_extendedprice")
    return out.withColumn("baseline", F.round("baseline", 6)).withColumn("product_corr", F.round("product_corr", 6))


@query("C19_stable_half", "SELECT c_custkey, ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 16, 1))::INTEGER % 2 AS half FROM customer")
def c19(t):
    return t.customer.select("c_custkey", pr.stable_half(F.col("c_custkey")).alias("half"))
