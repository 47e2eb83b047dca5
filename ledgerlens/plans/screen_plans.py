"""Univariate screening."""

from pyspark.sql import functions as F

from ledgerlens.operators import screen as s
from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query

CATS = ["f_priority", "f_status", "f_segment", "f_nation", "f_lines"]
CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM f GROUP BY {c}"
    for c in CATS
)
STATS = """SELECT feature, value, n AS count, pos AS count_pos, neg AS count_neg, round(pc, 6) AS pos_coverage, round(nc, 6) AS neg_coverage,
  round(CASE WHEN nc > 0 THEN pc / nc END, 6) AS ratio, round(pos / n, 6) AS positive_rate, round(CASE WHEN pc > 0 AND nc > 0 THEN ln(pc / nc) END, 6) + 0.0 AS woe,
  round(coalesce(CASE WHEN pc > 0 AND nc > 0 THEN (pc - nc) * ln(pc / nc) END, 0), 6) + 0.0 AS iv_part
  FROM (SELECT feature, coalesce(value, 'NULL') AS value, n, pos, neg, pos / (SELECT count(*) FROM f WHERE label = 1) AS pc, neg / (SELECT count(*) FROM f WHERE label = 0) AS nc FROM cells)"""
_R = ["pos_coverage", "neg_coverage", "ratio", "positive_rate", "woe", "iv_part"]


def rounded(df):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in _R else F.col(c) for c in df.columns if c != "bin"])


@query("M04_categorical_screening", f"WITH f AS ({d.FEATURES_SQL}), cells AS ({CELLS}) {STATS}")
def m04(t):
    return rounded(s.categorical_screening(d.features(t), CATS, "label"))


def edges_sql(columns, bins=10, where="true"):
    """Quantile edges per column as a list."""
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{probs}]))) AS edges FROM f WHERE {where}" for c in columns
    )


WIDE = ["f_price", "f_balance", "f_qty", "f_discount"]


def long_sql(columns, extra="label"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, {extra} FROM f" for c in columns)


BIN = "len(list_filter(edges[2:-2], lambda e: e <= x))"


@query(
    "M05_numeric_screening",
    f"""WITH f AS ({d.FEATURES_SQL}), ed AS ({edges_sql(WIDE)}), lg AS ({long_sql(WIDE)}),
        cells AS (SELECT feature, 'bin_' || {BIN} AS value, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
                  FROM lg JOIN ed USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2) {STATS}""",
)
def m05(t):
    return rounded(s.numeric_screening(d.features(t), WIDE + ["f_nation"], "label"))


NUM = ["f_price", "f_balance", "f_qty", "f_discount", "f_lines", "f_const", "f_sparse"]
PSI = f"""ed AS ({edges_sql(NUM)}), lg AS ({long_sql(NUM, "split")}),
   g AS (SELECT feature, CAST({BIN} AS VARCHAR) AS value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'valid') AS b
         FROM lg JOIN ed USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2
         UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', {c}, count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'valid') FROM f WHERE {c} IS NOT NULL GROUP BY {c}" for c in d.TEXT
) + """), sh AS (SELECT feature, CASE WHEN a = 0 THEN 0.001 ELSE a / sum(a) OVER (PARTITION BY feature) END AS t, CASE WHEN b = 0 THEN 0.001 ELSE b / sum(b) OVER (PARTITION BY feature) END AS v FROM g),
   psi AS (SELECT feature, sum((v - t) * ln(v / t)) AS psi FROM sh GROUP BY 1)"""


@query("M06_stability", f"WITH f AS ({d.SPLIT_SQL}), {PSI} SELECT feature, round(psi::DOUBLE, 8) + 0.0 AS psi FROM psi")
def m06(t):
    out = s.population_stability(d.features(t), NUM, d.TEXT, "label", "split")
    return out.withColumn("psi", F.round("psi", 8) + 0.0)


_TR = "WHERE split = 'train'"
REPORT = f"""WITH f AS ({d.SPLIT_SQL}), {PSI},
  tr AS (SELECT * FROM f {_TR}),
  facts AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_rate FROM tr" for c in NUM + d.TEXT)}),
  ed2 AS ({edges_sql(NUM).replace("FROM f", "FROM tr")}), lg2 AS ({long_sql(NUM).replace("FROM f", "FROM tr")}),
  cells AS (SELECT feature, CASE WHEN n_unique > 100 THEN CAST({BIN} AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS value, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
            FROM lg2 JOIN ed2 USING (feature) JOIN facts USING (feature) WHERE n_unique <= 100 OR x IS NOT NULL GROUP BY 1, 2
            UNION ALL {" UNION ALL ".join(f"SELECT '{c}', {c}, count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0) FROM tr GROUP BY {c}" for c in d.TEXT)}),
  cov AS (SELECT feature, pos / (SELECT count(*) FROM tr WHERE label = 1) AS pc, neg / (SELECT count(*) FROM tr WHERE label = 0) AS nc FROM cells),
  iv AS (SELECT feature, greatest(sum(CASE WHEN pc > 0 AND nc > 0 THEN (pc - nc) * ln(pc / nc) ELSE 0 END), 0) AS iv FROM cov GROUP BY 1),
  rep AS (SELECT *, CASE WHEN missing_rate > 0.5 OR n_unique = 1 THEN 'DROP' WHEN iv < 0.02 OR psi > 0.2 THEN 'CONSIDER_DROP' ELSE 'KEEP' END AS recommendation,
      CASE WHEN missing_rate > 0.5 THEN 'missing_rate' WHEN n_unique = 1 THEN 'constant' WHEN iv < 0.02 THEN 'weak' WHEN psi > 0.2 THEN 'unstable' ELSE '' END AS reason
    FROM facts JOIN iv USING (feature) JOIN psi USING (feature))"""


def report(t):
    return s.screening_report(d.features(t), NUM, d.TEXT, "label", "split")


@query(
    "M07_recommendation",
    REPORT + " SELECT feature, n_unique, round(missing_rate, 6) AS missing_rate, round(iv::DOUBLE, 6) + 0.0 AS iv, round(psi::DOUBLE, 6) + 0.0 AS psi, recommendation, reason FROM rep",
)
def m07(t):
    out = report(t)
    return out.select(
        "feature", "n_unique", F.round("missing_rate", 6).alias("missing_rate"), (F.round("iv", 6) + 0.0).alias("iv"), (F.round("psi", 6) + 0.0).alias("psi"),
        "recommendation", "reason",
    )


@query(
    "M08_feature_filter",
    f"SELECT user_id, label, split, f_price, f_nation, f_balance, f_lines, f_qty, f_discount, f_priority, f_status, f_segment FROM ({d.SPLIT_SQL})",
)
def m08(t):
    df = d.features(t).drop("o_orderdate", "shipped")
    return s.keep_features(df, report(t), ["user_id", "label", "split"])


@query(
    "A16_group_statistics",
    """WITH f AS (SELECT c_mktsegment AS value, (c_acctbal > 5000)::INTEGER AS label FROM customer),
       cells AS (SELECT 'segment' AS feature, value, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM f GROUP BY 2) """
    + STATS,
)
def a16(t):
    df = t.customer.select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 5000).cast("int").alias("label"))
    return rounded(s.group_statistics(s.feature_cells(df, ["segment"], "label"), *s.class_totals(df, "label")))


@query(
    "C23_quantile_bins",
    f"""WITH f AS ({d.FEATURES_SQL}) SELECT user_id, """
    + ", ".join(
        f"CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter((SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) FROM f)[2:-2], lambda e: e <= {c})) END::DOUBLE AS {c}_bin"
        for c in ["f_price", "f_qty", "f_sparse"]
    )
    + " FROM f",
)
def c23(t):
    out = s.quantile_bins(d.features(t), ["f_price", "f_qty", "f_sparse"], 5)
    return out.select("user_id", "f_price_bin", "f_qty_bin", "f_sparse_bin")


MI = ["f_price", "f_balance", "f_qty", "f_discount", "f_lines"]


@query(
    "M20_mutual_information",
    f"""WITH f AS (SELECT label, {", ".join(f"coalesce({c}::DOUBLE, 0) AS {c}" for c in MI)} FROM ({d.FEATURES_SQL})), ed AS ({edges_sql(MI)}), lg AS ({long_sql(MI)}),
        j AS (SELECT feature, {BIN} AS bin, label, count(*) AS n FROM lg JOIN ed USING (feature) GROUP BY 1, 2, 3),
        m AS (SELECT feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) + 0.0 AS mutual_information FROM (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb,
              sum(n) OVER (PARTITION BY feature, label) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM j) GROUP BY 1)
        SELECT feature, mutual_information, round(sqrt(variance), 4) AS deviation FROM m JOIN ({" UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM f" for c in MI)}) USING (feature)""",
)
def m20(t):
    df = d.features(t).select("label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MI])
    out = s.mutual_information(df, MI, "label").join(s.variance_ranking(df, MI), "feature")
    return out.select("feature", (F.round("mutual_information", 6) + 0.0).alias("mutual_information"), F.round(F.sqrt("variance"), 4).alias("deviation"))


@query(
    "M21_leakage_check",
    f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE shipped > o_orderdate) AS leaking_rows, count(*) FILTER (WHERE shipped > o_orderdate) = 0 AS passed FROM ({d.FEATURES_SQL})",
)
def m21(t):
    return s.leakage_check(d.features(t), "shipped", "o_orderdate")
