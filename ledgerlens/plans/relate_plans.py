"""Relationship discovery."""

from pyspark.sql import functions as F

from ledgerlens.functions import names
from ledgerlens.operators import profile as p
from ledgerlens.operators import relate as r
from ledgerlens.plans.profile_plans import values_sql
from ledgerlens.plans.registry import query, stored
from ledgerlens.plans.sources_plans import KEYS
from ledgerlens.session import scratch_path
from ledgerlens.sources.schema import check_foreign_keys

#: All scalar columns of all tables.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
FLOATS = ["c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"]
TIMES = ["o_orderdate", "l_shipdate", "ts"]
STRINGS = [
    "r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus",
    "event_type", "props", "text", "lang", "source", "url", "html", "role",
]
V = f"v AS ({values_sql(COLUMNS)})"
PAIRS = f"""{V}, d AS (SELECT DISTINCT table_name, column_name, trim(value) AS value FROM v WHERE trim(value) <> ''),
  card AS (SELECT table_name, column_name, count(*) AS n FROM d GROUP BY 1, 2),
  pairs AS (SELECT a.table_name AS lt, a.column_name AS ac, b.table_name AS rt, b.column_name AS bc, count(*) AS shared
            FROM d a JOIN d b ON a.value = b.value AND a.table_name <> b.table_name GROUP BY ALL),
  st AS (SELECT table_name, column_name, sum(cnt) AS n_rows, count(value) AS n_distinct,
                (sum(cnt) - coalesce(sum(cnt) FILTER (WHERE value IS NOT NULL), 0)) / sum(cnt) AS null_rate FROM v GROUP BY 1, 2),
  kw AS (SELECT *, n_distinct / greatest(n_rows, n_distinct) >= 0.98 AND null_rate <= 0.05 AND n_distinct >= 8
                   OR (table_name, column_name) IN (('region', 'r_regionkey'), ('nation', 'n_nationkey')) AS is_key FROM st),
  keys AS (SELECT *, CASE WHEN is_key THEN 1.0 WHEN n_distinct / greatest(n_rows, n_distinct) >= 0.8 AND null_rate <= 0.05 THEN 0.7 ELSE 0.35 END AS w FROM kw)"""
DECLARED = [("region", "r_regionkey"), ("nation", "n_nationkey")]


def values(t):
    # read by several branches of each plan, so it is written once
    return stored(t, "values", lambda t: r.relation_values({n: getattr(t, n) for n in COLUMNS}))


def keys(t, v):
    return r.parent_keys(p.column_stats(v), DECLARED)


@query("R01_minhash_sketch")
def r01(t):
    return r.minhash_sketch(values(t))


@query("R02_sketch_containment")
def r02(t):
    return r.sketch_containment(r.minhash_sketch(values(t)))


@query(
    "R03_exact_containment",
    f"""WITH {PAIRS} SELECT lt AS child_table, ac AS child_column, rt AS parent_table, bc AS parent_column, shared,
          n AS child_distinct, round(shared / n, 6) AS containment
        FROM pairs JOIN card ON table_name = lt AND column_name = ac""",
)
def r03(t):
    return r.containment(values(t)).withColumn("containment", F.round("containment", 6))


# Comments the relation check reads.
COMMENTS = [
    ("customer", "c_custkey", "customer number"),
    ("orders", "o_custkey", "customer who placed it, see c_custkey"),
    ("orders", "o_orderkey", "order number"),
    ("lineitem", "l_orderkey", "order of the line"),
    ("lineitem", "l_linenumber", "position, unrelated to any key"),
    ("part", "p_size", "size in units"),
    ("events", "user_id", "visitor, not linked"),
]


def _lcs(x, y):
    """Length of the longest common subsequence as SQL: table rows reduced over the places where each letter of x stands in y, as running maxima."""
    best = "CASE WHEN k = 0 THEN 0 WHEN here[k] = 1 THEN above[k] + 1 ELSE above[k + 1] END"
    row = f"list_transform(range(0, length({y}) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: {best})))"
    places = f"list_transform(string_split({x}, ''), lambda c: list_transform(string_split({y}, ''), lambda d: (c = d)::BIGINT))"
    zeros = f"list_transform(range(0, length({y}) + 1), lambda j: 0::BIGINT)"
    return f"list_reduce(list_concat([{zeros}], {places}), lambda above, here: {row})[length({y}) + 1]"


def _sim(a, b):
    """Name similarity of two columns as SQL."""
    x, y = (f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')" for c in (a, b))
    return f"""CASE WHEN {x} = {y} THEN 1.0 WHEN contains({x}, {y}) OR contains({y}, {x})
        THEN 0.5 + 0.5 * least(length({x}), length({y})) / greatest(length({x}), length({y}))
        ELSE {_lcs(x, y)} / greatest(length({x}), length({y})) END"""


_COMMENT_ROWS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in COMMENTS)


@query(
    "R04_relation_measure",
    f"""WITH {PAIRS}, cm(table_name, column_name, comment) AS (VALUES {_COMMENT_ROWS}),
        f AS (SELECT k.*, coalesce(comment, '') AS comment FROM keys k LEFT JOIN cm USING (table_name, column_name)),
        fo AS (SELECT table_name, column_name, lower(value) AS folded, count(*) AS n FROM d
               WHERE column_name NOT IN {tuple(TIMES)} AND NOT regexp_matches(column_name, '(^|_)(date|time|datetime|timestamp)s?$|(^|_)(at|on)$', 'i') GROUP BY ALL),
        fp AS (SELECT a.table_name AS lt, a.column_name AS ac, b.table_name AS rt, b.column_name AS bc, sum(a.n) AS a_shared, sum(b.n) AS b_shared
               FROM fo a JOIN fo b ON a.folded = b.folded AND a.table_name < b.table_name GROUP BY ALL),
        j AS (SELECT lt, ac, rt, bc, a.n_distinct AS an, b.n_distinct AS bn, a.is_key AS ak, b.is_key AS bk, a.comment AS acm, b.comment AS bcm,
                CASE WHEN b.w >= a.w THEN a_shared / a.n_distinct * b.w ELSE b_shared / b.n_distinct * a.w END AS overlap
              FROM fp JOIN f a ON a.table_name = lt AND a.column_name = ac JOIN f b ON b.table_name = rt AND b.column_name = bc),
        s AS (SELECT *, acm <> '' AND bcm <> '' AND contains(acm || ' ' || bcm, 'unrelated') AS contra FROM j),
        z AS (SELECT *, contra OR (an <= 32 AND bn <= 32 AND NOT ak AND NOT bk) AS veto, CASE WHEN contra THEN 0 ELSE least(1.0, overlap) END AS score FROM s)
        SELECT lt || '.' || ac AS "left", rt || '.' || bc AS "right", round(least(1.0, overlap)::DOUBLE, 6) AS overlap, round(score::DOUBLE, 6) AS score,
          round(({_sim('ac', 'bc')})::DOUBLE, 6) AS name_score,
          CASE WHEN contra OR acm = '' OR bcm = '' THEN 0 WHEN contains(acm, bc) OR contains(bcm, ac)
            OR len(list_intersect(list_filter(string_split_regex(acm, '[^a-z0-9]+'), lambda x: length(x) >= 2),
                                  list_filter(string_split_regex(bcm, '[^a-z0-9]+'), lambda x: length(x) >= 2))) > 0 THEN 1 ELSE 0 END AS comment_score,
          (CASE WHEN contra THEN 0 WHEN ak <> bk THEN 1 WHEN ak AND bk THEN 0.6 ELSE 0.2 END)::DOUBLE AS key_shape,
          (ak OR bk) AND NOT contra AS parent_is_key, veto,
          CASE WHEN veto THEN 'veto' WHEN score >= 0.95 THEN 'publish' WHEN score >= 0.8 THEN 'grey' ELSE 'drop' END AS status FROM z""",
)
def r04(t):
    v = values(t)
    comments = t.spark.createDataFrame(COMMENTS, "table_name string, column_name string, comment string")
    out = r.measure_relations(v, keys(t, v), comments, r.skipped_columns({n: getattr(t, n) for n in COLUMNS}, v))
    for c in ("overlap", "score", "name_score"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "R05_parent_keys",
    f"""WITH {PAIRS} SELECT table_name, column_name, n_distinct, n_rows::BIGINT AS n_rows, is_key, w::DOUBLE AS key_weight FROM keys""",
)
def r05(t):
    return keys(t, values(t))


_DTYPE = f"""CASE WHEN column_name IN {tuple(STRINGS)} THEN 'string' WHEN column_name IN {tuple(FLOATS)} THEN 'float' WHEN column_name IN {tuple(TIMES)} THEN 'datetime'
  WHEN column_name IN ('quality', 'toxic') THEN 'integer_boolean' ELSE 'integer' END"""


def joinable(t):
    v = values(t)
    dtypes = p.inferred_types(v, p.column_types({n: getattr(t, n).select(*cs) for n, cs in COLUMNS.items()}))
    out = r.joinable(v, dtypes.select("table_name", "column_name", "dtype"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "R06_joinable",
    f"""WITH {PAIRS}, f AS (SELECT *, {_DTYPE} AS dtype FROM card)
        SELECT lt || '.' || ac AS source_id, rt || '.' || bc AS target_id, round(shared / least(a.n, b.n), 6) AS confidence, a.dtype AS dtype_a, b.dtype AS dtype_b
        FROM pairs JOIN f a ON a.table_name = lt AND a.column_name = ac JOIN f b ON b.table_name = rt AND b.column_name = bc
        WHERE lt < rt AND a.dtype <> 'integer_boolean' AND b.dtype <> 'integer_boolean' AND (a.dtype = 'datetime') = (b.dtype = 'datetime') AND shared / least(a.n, b.n) >= 0.1""",
)
def r06(t):
    """Joinable columns of any number of values."""
    return joinable(t)


@query("R07_synonyms")
def r07(t):
    # short names, as users write them, for the columns of the given tables
    tables = {
        "customer": t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount")),
        "orders": t.orders.select(
            F.col("o_custkey").alias("client_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("state"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        ),
        "lineitem": t.lineitem.select(F.col("l_linestatus").alias("line_status"), F.col("l_extendedprice").alias("price")),
    }
    v = p.long_values(tables)
    types = p.inferred_types(v, p.column_types(tables))
    return r.synonyms(p.semantic_types(p.column_stats(v), p.pattern_shares(v), types))


NUMERIC = {
    "customer": ["c_acctbal", "c_nationkey"],
    "supplier": ["s_acctbal", "s_nationkey"],
    "part": ["p_size", "p_retailprice"],
    "orders": ["o_totalprice"],
    "lineitem": ["l_quantity", "l_extendedprice", "l_linenumber"],
}
_INT = {"c_nationkey", "s_nationkey", "p_size", "l_linenumber"}
TEXTUAL = {"orders": ["o_orderstatus"], "lineitem": ["l_linestatus", "l_returnflag"], "part": ["p_type"]}


@query(
    "R08_distribution_similarity",
    "WITH s AS ("
    + " UNION ALL ".join(
        f"""SELECT '{tb}' AS t, '{c}' AS c, '{"integer" if c in _INT else "float"}' AS d, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, avg({c})::DOUBLE AS m FROM {tb}"""
        for tb, cs in NUMERIC.items()
        for c in cs
    )
    + " UNION ALL SELECT 'orders', 'o_orderdate', 'datetime', epoch(min(o_orderdate)), epoch(max(o_orderdate)), epoch(max(o_orderdate)) FROM orders"
    + " UNION ALL SELECT 'lineitem', 'l_shipdate', 'datetime', epoch(min(l_shipdate)), epoch(max(l_shipdate)), epoch(max(l_shipdate)) FROM lineitem"
    + f"""), n AS (SELECT a.t || '.' || a.c AS source_id, b.t || '.' || b.c AS target_id,
          CASE WHEN least(a.hi, b.hi) < greatest(a.lo, b.lo) THEN 0 WHEN greatest(a.hi, b.hi) = least(a.lo, b.lo) THEN 1 ELSE
            (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) * (CASE a.d WHEN 'datetime' THEN 1 ELSE 0.6 END)
            + CASE a.d WHEN 'datetime' THEN 0 ELSE 0.4 * (1 - abs(a.m - b.m) / greatest(abs(a.m), abs(b.m))) END END AS confidence
          FROM s a JOIN s b ON a.t < b.t AND a.d = b.d),
        v AS ({values_sql(TEXTUAL)}), tv AS (SELECT * FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY table_name, column_name) AS fr,
             row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS rn FROM v WHERE value IS NOT NULL) WHERE rn <= 10),
        ma AS (SELECT table_name, column_name, sum(fr) AS mass FROM tv GROUP BY 1, 2),
        x AS (SELECT a.table_name || '.' || a.column_name AS source_id, b.table_name || '.' || b.column_name AS target_id, sum(least(a.fr, b.fr)) / ((max(p.mass) + max(q.mass)) / 2) AS confidence
              FROM tv a JOIN tv b ON a.value = b.value AND a.table_name < b.table_name
              JOIN ma p ON (p.table_name, p.column_name) = (a.table_name, a.column_name) JOIN ma q ON (q.table_name, q.column_name) = (b.table_name, b.column_name) GROUP BY 1, 2)
        SELECT source_id, target_id, round(confidence::DOUBLE, 5) AS confidence FROM (SELECT * FROM n UNION ALL SELECT * FROM x) WHERE confidence >= 0.5""",
)
def r08(t):
    parts = []
    for name, cols in NUMERIC.items():
        df = getattr(t, name)
        dtype = F.when(F.col("column_name").isin(*_INT), "integer").otherwise("float")
        parts.append(p.numeric_stats(df, cols).select(F.lit(name).alias("table_name"), "column_name", dtype.alias("dtype"), "min_value", "max_value", "mean_value"))
    for name, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        seconds = F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
        hi = F.max(seconds)
        parts.append(getattr(t, name).agg(F.min(seconds).alias("min_value"), hi.alias("max_value"), hi.alias("mean_value")).select(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit("datetime").alias("dtype"), "min_value", "max_value", "mean_value"))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part)
    top = p.top_values(p.long_values({n: getattr(t, n) for n in TEXTUAL}, TEXTUAL))
    out = r.numeric_similarity(stats).unionByName(r.categorical_similarity(top))
    return out.withColumn("confidence", F.round("confidence", 5))


@query(
    "R09_cross_table_correlation",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_a, '{y}' AS column_b, count(*) AS aligned_rows, round(corr({x}, {y}), 5) AS coefficient
            FROM lineitem JOIN part ON l_partkey = p_partkey"""
        for x in ("l_quantity", "l_extendedprice", "l_discount")
        for y in ("p_retailprice", "p_size")
    ),
)
def r09(t):
    out = r.cross_table_correlation(
        t.lineitem, "l_partkey", ["l_quantity", "l_extendedprice", "l_discount"], t.part, "p_partkey", ["p_retailprice", "p_size"], 0.0
    )
    return out.withColumn("coefficient", F.round("coefficient", 5))


STRUCTURE = ["region", "nation", "customer", "orders"]


@query(
    "R10_structural_edges",
    "SELECT e.*, n.orphan_rows FROM ("
    + " UNION ALL ".join(
        [f"SELECT 'contains:{tb}.' || column_name AS id, '{tb}' AS source_id, '{tb}.' || column_name AS target_id, 'contains' AS type, 1.0::DOUBLE AS confidence FROM (DESCRIBE {tb})" for tb in STRUCTURE]
        + [f"SELECT 'fk:{a}.{x}:{b}.{y}', '{a}.{x}', '{b}.{y}', 'foreign_key', 1.0" for a, x, b, y, _ in KEYS if a in STRUCTURE]
    )
    + ") e LEFT JOIN ("
    + " UNION ALL ".join(
        f"SELECT '{a}.{x}' AS child, count(*) AS orphan_rows FROM {a} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {b})"
        for a, x, b, y, _ in KEYS
        if a in STRUCTURE
    )
    + ") n ON e.type = 'foreign_key' AND e.source_id = n.child",
)
def r10(t):
    tables = {n: getattr(t, n) for n in STRUCTURE}
    declared = [k for k in KEYS if k[0] in STRUCTURE]
    orphans = check_foreign_keys(tables, declared).select(F.col("child").alias("source_id"), F.lit("foreign_key").alias("type"), "orphan_rows")
    return r.structural_edges(tables, declared).join(orphans, ["source_id", "type"], "left")


def bare(t):
    """Tables with their name prefixes cut, so that shared keys share a name."""
    out = {}
    for n in ("customer", "orders", "lineitem", "part"):
        df = getattr(t, n)
        out[n] = df.select(*[F.col(c).alias(c.split("_", 1)[1]) for c in df.columns if c.endswith("key")])
    return out


@query(
    "R11_join_keys",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS primary_table, '{b}' AS secondary_table, '{k}' AS key, (SELECT count(*) = count(DISTINCT {c}) FROM {b}) AS unique_in_secondary"""
        for a, b, k, c in [
            ("customer", "orders", "custkey", "o_custkey"), ("orders", "customer", "custkey", "c_custkey"),
            ("orders", "lineitem", "orderkey", "l_orderkey"), ("lineitem", "orders", "orderkey", "o_orderkey"),
            ("part", "lineitem", "partkey", "l_partkey"), ("lineitem", "part", "partkey", "p_partkey"),
        ]
    ),
)
def r11(t):
    return r.join_keys(bare(t))


@query(
    "R12_incremental_relations",
    f"""WITH {PAIRS} SELECT lt AS child_table, ac AS child_column, rt AS parent_table, bc AS parent_column, shared,
          n AS child_distinct, round(shared / n, 6) AS containment
        FROM pairs JOIN card ON table_name = lt AND column_name = ac WHERE lt = 'lineitem' OR rt = 'lineitem'""",
)
def r12(t):
    known = {n: c for n, c in COLUMNS.items() if n != "lineitem"}
    path = scratch_path(t.spark, "values")
    r.relation_values({n: getattr(t, n) for n in known}).write.parquet(path)
    new = r.relation_values({"lineitem": t.lineitem})
    both = t.spark.read.parquet(path).unionByName(new)
    return r.containment(both, touching=["lineitem"]).withColumn("containment", F.round("containment", 6))


@query(
    "J01_suffixed_join",
    """SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.lang, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id""",
)
def j01(t):
    return r.suffixed_join(t.documents.select("doc_id", "lang"), "doc_id", t.labels.select("doc_id", "quality"), "doc_id")


@query(
    "J12_exists_containment",
    "SELECT count(DISTINCT user_id) AS child_distinct, count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT doc_id FROM labels)) AS present FROM events",
)
def j12(t):
    return r.exists_containment(t.events, "user_id", t.labels, "doc_id")


_LABEL = """CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.5 + 0.5 * least(length(x), length(y)) / greatest(length(x), length(y))
  ELSE greatest(len(list_intersect(string_split(x, ''), string_split(y, ''))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))),
    (SELECT coalesce(min(i) - 1, least(length(x), length(y))) FROM range(1, least(length(x), length(y)) + 1) r(i) WHERE substr(x, 1, i::INTEGER) <> substr(y, 1, i::INTEGER))
      / greatest(length(x), length(y))) END"""


@query(
    "C08_name_similarity",
    f"""SELECT p_partkey, round(({_sim('p_name', 'p_type')})::DOUBLE, 6) AS name_score, round(({_LABEL})::DOUBLE, 6) AS label_score
        FROM (SELECT *, lower(replace(p_name, '_', '')) AS x, lower(replace(p_type, '_', '')) AS y FROM part)""",
)
def c08(t):
    a, b = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.round(names.name_similarity(a, b), 6).alias("name_score"), F.round(names.label_similarity(a, b), 6).alias("label_score")
    )
