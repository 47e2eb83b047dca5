"""Cohorts and training sets. Users are the visitors of ``events``; T0 is 2024-01-15, a purchase converts."""

from pyspark.sql import functions as F

from ledgerlens.operators import cohort as c
from ledgerlens.operators import features as ft
from ledgerlens.plans.registry import query, stored
from ledgerlens.sources.readers import hash_sample

T0 = "2024-01-15"


def plan(kind="purchase", min_value=80.0):
    """Purchases of some size convert; every visitor of the scope counts."""
    return c.SamplingPlan("user_id", "ts", T0, 7, 7, (F.col("event_type") == kind) & (F.col("value") >= min_value))


WINDOWS = """w AS (SELECT *, ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-22' AS lab, ts > TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15' AS look,
    ts <= TIMESTAMP '2024-01-15' AS thru, event_type = 'purchase' AND value >= 80 AS pos FROM events),
  posu AS (SELECT DISTINCT user_id AS user_key FROM w WHERE lab AND pos),
  pool AS (SELECT DISTINCT user_id AS user_key FROM w WHERE look AND user_id NOT IN (SELECT user_id FROM w WHERE pos AND thru)),
  usr AS (SELECT DISTINCT user_id AS user_key FROM events),
  act AS (SELECT user_id, count(*) AS n FROM w WHERE look GROUP BY 1),
  pools AS (SELECT 'N1' AS population, user_key FROM pool WHERE user_key NOT IN (SELECT user_key FROM posu)
    UNION ALL SELECT DISTINCT 'N2', user_id FROM w WHERE lab AND event_type = 'view' AND user_id NOT IN (SELECT user_key FROM posu)
    UNION ALL SELECT 'N3', user_id FROM act WHERE n >= (SELECT quantile_cont(n, 0.9) FROM act) AND user_id NOT IN (SELECT user_id FROM w WHERE lab AND value > 180)
       AND user_id NOT IN (SELECT user_key FROM posu)
    UNION ALL SELECT DISTINCT 'N4', user_id FROM w WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_key FROM posu)
    UNION ALL SELECT 'N5', user_key FROM usr WHERE user_key NOT IN (SELECT user_key FROM posu))"""
DRAW = f"""{WINDOWS}, chosen AS (SELECT user_key FROM posu ORDER BY md5(user_key::VARCHAR), user_key LIMIT 20),
  neg AS (SELECT user_key FROM (SELECT DISTINCT user_key FROM pools) ORDER BY md5(user_key::VARCHAR), user_key LIMIT (SELECT count(*) * 4 FROM chosen)),
  sample AS (SELECT user_key, 1 AS label FROM chosen UNION ALL SELECT user_key, 0 FROM neg)"""


def pools(t):
    p = plan()
    scoped = c.SamplingPlan(p.user, p.ts, p.t0, p.label_days, p.lookback_days, p.positive)
    users = t.events.select(F.col("user_id").alias("user_key")).distinct()
    exposed, pay = F.col("event_type") == "view", F.col("event_type") == "purchase"
    plain = c.negative_pools(t.events, users, scoped, exposed, pay, which=("N1", "N2", "N4", "N5"))
    # the busiest visitors must not touch the scope, here rows of great value
    touching = c.SamplingPlan(p.user, p.ts, p.t0, p.label_days, p.lookback_days, p.positive, F.col("value") > 180)
    busy = c.negative_pools(t.events, users, touching, exposed, pay, which=("N3",))
    return plain.unionByName(busy.join(c.positives(t.events, p), "user_key", "left_anti"))


def sample(t):
    """The sampled users, written once: every later step of a run reads them."""
    return stored(t, "sampled-users", draw)


def draw(t):
    return c.draw_training_set(c.positives(t.events, plan()), pools(t), 100)


@query(
    "U01_positive_probe",
    f"WITH {WINDOWS} SELECT (SELECT count(*) FROM posu) AS positive_users, (SELECT count(DISTINCT user_id) FROM w WHERE lab) AS loose_users, "
    "CASE WHEN (SELECT count(*) FROM posu) >= 500 THEN 'regular' ELSE 'cold_start' END AS mode",
)
def u01(t):
    return c.probe_positives(t.events, plan())


@query("U02_candidate_pool", f"WITH {WINDOWS} SELECT user_key FROM pool")
def u02(t):
    return c.candidate_pool(t.events, plan())


@query(
    "U03_label_families",
    f"""WITH {WINDOWS} SELECT 'pay' AS family, user_key, 1.0::DOUBLE AS label_value FROM posu
        UNION ALL SELECT 'click', user_id, 1.0 FROM w WHERE lab AND event_type = 'click' GROUP BY user_id
        UNION ALL SELECT 'retention', user_id, count(DISTINCT ts::DATE)::DOUBLE FROM w WHERE lab GROUP BY user_id HAVING count(DISTINCT ts::DATE) >= 6
        UNION ALL SELECT 'duration', user_id, round(sum(value), 4) FROM w WHERE lab GROUP BY user_id HAVING sum(value) >= 500
        UNION ALL SELECT 'revenue', user_id, round(sum(value), 4) FROM w WHERE lab AND event_type = 'purchase' GROUP BY user_id
        UNION ALL SELECT DISTINCT 'conversion', e.user_id, 1.0 FROM w e JOIN w d ON e.user_id = d.user_id AND d.ts > e.ts
          AND json_extract_string(e.props, '$.k')::INTEGER // 10 = json_extract_string(d.props, '$.k')::INTEGER // 10
          WHERE e.lab AND d.lab AND e.event_type = 'view' AND d.event_type = 'purchase'""",
)
def u03(t):
    base = lambda cond: c.SamplingPlan("user_id", "ts", T0, 7, 7, cond)
    kind = lambda k: F.col("event_type") == k
    items = t.events.withColumn("item", F.floor(F.get_json_object("props", "$.k").cast("int") / 10))
    window = base(F.lit(True)).label_window
    families = {
        "pay": c.label(t.events, plan()),
        "click": c.label(t.events, base(kind("click"))),
        "retention": c.label(t.events, base(F.lit(True)), "days", threshold=6),
        "duration": c.label(t.events, base(F.lit(True)), "sum", "value", 500),
        "revenue": c.label(t.events, base(kind("purchase")), "amount", "value"),
        "conversion": c.exposure_conversion(items.where(kind("view")), items.where(kind("purchase")), "user_id", "item", "ts", window, F.lit(True)).withColumn(
            "label_value", F.lit(1.0)
        ),
    }
    parts = [df.select(F.lit(n).alias("family"), "user_key", F.round("label_value", 4).alias("label_value")) for n, df in families.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "U04_other_interests",
    f"""WITH {WINDOWS}, i AS (SELECT user_id AS user_key, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(*) AS n FROM events GROUP BY 1)
        SELECT 'N6' AS population, user_key FROM i WHERE bought * 5 < n AND user_key NOT IN (SELECT user_key FROM posu)""",
)
def u04_other(t):
    """Population N6: visitors whose interest lies elsewhere, here less than a fifth of their events are purchases."""
    p = plan()
    users = t.events.groupBy(F.col("user_id").alias("user_key")).agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count(F.lit(1)).alias("n"))
    return c.negative_pools(t.events, users, p, F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("bought") * 5 < F.col("n"), ("N6",))


@query("U04_negative_pools", f"WITH {WINDOWS} SELECT population, user_key FROM pools")
def u04(t):
    return pools(t)


@query("U05_training_set", f"WITH {DRAW} SELECT user_key, max(label) AS label FROM sample GROUP BY 1")
def u05(t):
    return draw(t)


@query(
    "U06_prelabelled_set",
    """WITH p AS (SELECT doc_id AS user_key FROM labels WHERE toxic = 1 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 40),
         n AS (SELECT doc_id AS user_key FROM labels WHERE toxic = 0 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT (SELECT count(*) * 4 FROM p))
       SELECT user_key, 1 AS label FROM p UNION ALL SELECT user_key, 0 FROM n""",
)
def u06(t):
    return c.draw_prelabelled(t.labels, "doc_id", "toxic", 200)


@query(
    "U07_projections",
    f"""WITH {DRAW} SELECT 'events' AS table_name, event_id AS row_id, NULL::INTEGER AS label FROM events WHERE user_id IN (SELECT user_key FROM sample)
        UNION ALL SELECT 'customer', c_custkey, label FROM customer JOIN sample ON c_custkey = user_key
        UNION ALL SELECT 'part', p_partkey, NULL FROM part WHERE p_brand = 'Brand#4'
        UNION ALL SELECT 'nation', n_nationkey, NULL FROM nation""",
)
def u07(t):
    s = sample(t)
    none = F.lit(None).cast("int")
    row = lambda n, df, key, lab=none: df.select(F.lit(n).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), lab.alias("label"))
    return (
        row("events", c.project(t.events, s, "user_keyed", "user_id"), "event_id")
        .unionByName(row("customer", c.project(t.customer, s, "user_table", "c_custkey"), "c_custkey", F.col("label")))
        .unionByName(row("part", c.project(t.part, s, "item_keyed", item=("p_brand", "Brand#4")), "p_partkey"))
        .unionByName(row("nation", c.project(t.nation, s, "catalog"), "n_nationkey"))
    )


@query(
    "U08_projection_gate",
    f"""WITH {DRAW}, f AS (SELECT (SELECT count(*) FROM sample) AS s, (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT user_key FROM sample)) AS u,
          (SELECT count(*) FROM events) AS src, (SELECT count(*) FROM events WHERE user_id IN (SELECT user_key FROM sample)) AS n)
        SELECT 'events' AS table_name, s AS sampled_users, u AS users_out, 0::BIGINT AS users_outside, src AS source_rows, n AS rows_out, round(n / src, 6) AS shrink,
               u <= s AND n / src <= 0.5 AS passed FROM f""",
)
def u08(t):
    s = sample(t)
    out = c.projection_gate(t.events, c.project(t.events, s, "user_keyed", "user_id"), s, "user_id", "events")
    return out.withColumn("shrink", F.round("shrink", 6))


@query(
    "U09_sample_statistics",
    f"""WITH {DRAW} SELECT count(*) AS n_users, count(DISTINCT user_key) AS n_unique, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative,
          round(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0), 6) AS ratio,
          count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0) BETWEEN 0.2 AND 0.3 AS ratio_ok FROM sample""",
)
def u09(t):
    return c.sample_statistics(sample(t)).withColumn("ratio", F.round("ratio", 6))


SPLIT = """split AS (SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels))"""


@query("U10_stratified_split", f"WITH {SPLIT} SELECT * FROM split")
def u10(t):
    return c.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query("X07_key_overlap", f"WITH {SPLIT} SELECT count(*) AS shared_keys FROM (SELECT doc_id FROM split WHERE split = 'train' INTERSECT SELECT doc_id FROM split WHERE split = 'valid')")
def x07(t):
    s = c.stratified_split(t.labels, "doc_id", "quality")
    return c.key_overlap(s.where("split = 'train'"), s.where("split = 'valid'"), "doc_id")


@query(
    "X01_tagged_union",
    f"WITH {WINDOWS} SELECT population, count(*) AS users FROM pools GROUP BY 1",
)
def x01(t):
    return pools(t).groupBy("population").agg(F.count(F.lit(1)).alias("users"))


@query("X02_resolve_labels", "SELECT user_id AS user_key, max((event_type = 'purchase')::INTEGER) AS label FROM events GROUP BY 1")
def x02(t):
    return c.resolve_labels(t.events.select(F.col("user_id").alias("user_key"), (F.col("event_type") == "purchase").cast("int").alias("label")))


@query("K01_hash_ordered_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 300")
def k01(t):
    return hash_sample(t.customer.select("c_custkey", "c_name"), "c_custkey", 300)


@query(
    "J02_one_to_one_merge",
    """SELECT d.doc_id, lang, l.quality AS labels_quality, l.toxic AS labels_toxic, n.n AS rows_before, n.n AS rows_after, true AS passed
       FROM documents d LEFT JOIN labels l USING (doc_id), (SELECT count(*) AS n FROM documents) n""",
)
def j02(t):
    base = t.documents.select("doc_id", "lang")
    merged = ft.merge_one_to_one(base, "doc_id", {"labels": (t.labels, "doc_id")})
    g = ft.merge_gate(base, merged, "doc_id")
    packed = g.select(F.struct(*g.columns).alias("g")).scalar()
    return merged.select("*", *[packed.getField(x).alias(x) for x in g.columns])


@query(
    "J03_join_aggregates",
    """SELECT c_custkey, o.orders_count, round(o.orders_sum, 2) AS orders_sum, e.events_count FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS orders_count, sum(o_totalprice) AS orders_sum FROM orders GROUP BY 1) o ON o_custkey = c_custkey
       LEFT JOIN (SELECT user_id, count(*) AS events_count FROM events GROUP BY 1) e ON user_id = c_custkey""",
)
def j03(t):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_count"), F.round(F.sum("o_totalprice"), 2).alias("orders_sum"))
    e = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events_count"))
    return ft.join_behaviour(t.customer.select("c_custkey"), "c_custkey", {"o": (o, "o_custkey"), "e": (e, "user_id")})


@query("J04_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j04(t):
    converted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(converted, "c_custkey", "left_anti")


@query("J05_semi_join", f"WITH {DRAW} SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_key FROM sample)")
def j05(t):
    return c.project(t.events.select("event_id", "user_id", "event_type"), sample(t), "user_keyed", "user_id")


@query(
    "J06_one_row_per_user",
    f"""WITH {DRAW} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, any_value(label) AS label FROM events JOIN sample ON user_id = user_key GROUP BY 1""",
)
def j06(t):
    return c.project(t.events.select("user_id", "ts", "event_id"), sample(t), "user_table", "user_id", tie=["ts", "event_id"]).select("user_id", "event_id", "label")


@query(
    "J07_scalar_row",
    "SELECT c_custkey, p_partkey AS item_p_partkey, p_retailprice AS item_p_retailprice FROM customer, (SELECT * FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part) ORDER BY p_partkey LIMIT 1)",
)
def j07(t):
    best = t.part.agg(F.max_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", -F.col("p_partkey"))).alias("r")).select("r.*")
    return ft.attach_scalar_row(t.customer.select("c_custkey"), best, "item")


@query(
    "J08_exposure_conversion",
    """SELECT DISTINCT e.user_id AS user_key FROM events e JOIN events d ON e.user_id = d.user_id AND d.ts > e.ts
         AND json_extract_string(e.props, '$.k')::INTEGER = json_extract_string(d.props, '$.k')::INTEGER
       WHERE e.event_type = 'view' AND d.event_type = 'purchase' AND e.ts > TIMESTAMP '2024-01-15' AND e.ts <= TIMESTAMP '2024-01-29'
         AND d.ts > TIMESTAMP '2024-01-15' AND d.ts <= TIMESTAMP '2024-01-29'""",
)
def j08(t):
    items = t.events.withColumn("item", F.get_json_object("props", "$.k"))
    window = c.SamplingPlan("user_id", "ts", T0, 14, 7, F.lit(True)).label_window
    return c.exposure_conversion(
        items.where("event_type = 'view'"), items.where("event_type = 'purchase'"), "user_id", "item", "ts", window, F.lit(True)
    )


@query(
    "J11_similar_items",
    "SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 42) AND p_partkey <> 42",
)
def j11(t):
    return c.similar_items(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", 42)
