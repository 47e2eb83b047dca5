import math
import random
from itertools import combinations

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.functions import names
from ledgerlens.operators import profile as p
from ledgerlens.operators import relate as r


def linked(spark):
    users = spark.createDataFrame([(i, f"U{i}", f"u{i}@example.com", f"2023-01-{i + 10}", 20 + i) for i in range(1, 11)], "id bigint, name string, email string, signup_date string, age bigint")
    orders = spark.createDataFrame(
        [(100 + i, 1 + i % 6, 10.5 * i, f"2024-01-{10 + i}", "completed" if i % 3 else "pending") for i in range(1, 11)],
        "order_id bigint, customer_id bigint, amount double, order_date string, status string",
    )
    tx = spark.createDataFrame([(1000 + i, 1 + i % 8, 10.5 * (i if i < 9 else i + 50)) for i in range(1, 11)], "tx_id bigint, user_id bigint, value double")
    return {"users": users, "orders": orders, "transactions": tx}


def test_profiles(spark):
    tables = linked(spark)
    v = p.long_values(tables)
    stats = {(s.table_name, s.column_name): s for s in p.column_stats(v).collect()}
    assert len(stats) == 13
    assert stats["orders", "amount"].min_number == 10.5 and stats["users", "email"].n_distinct == 10
    types = {(s.table_name, s.column_name): s.dtype for s in p.inferred_types(v, p.column_types(tables)).collect()}
    assert types["users", "id"] == "integer" and types["orders", "order_date"] == "datetime" and types["users", "name"] == "string"
    meaning = {
        (s.table_name, s.column_name): s.semantic_type
        for s in p.semantic_types(p.column_stats(v), p.pattern_shares(v), p.inferred_types(v, p.column_types(tables))).collect()
    }
    assert meaning["users", "id"] == "identifier" and meaning["users", "email"] == "email_address" and meaning["orders", "amount"] == "monetary_value"
    assert meaning["orders", "order_date"] == "date" and meaning["orders", "status"] == "status_enum"


def test_containment_and_joinable(spark):
    tables = linked(spark)
    v = p.long_values(tables)
    got = {(c.child_table, c.child_column, c.parent_table, c.parent_column): (c.shared, c.child_distinct) for c in r.containment(v).collect()}
    assert got["orders", "customer_id", "users", "id"] == (6, 6)
    assert got["transactions", "user_id", "users", "id"] == (8, 8)
    assert got["orders", "amount", "transactions", "value"] == (8, 10)
    assert ("orders", "order_id", "transactions", "tx_id") not in got
    dtypes = p.inferred_types(v, p.column_types(tables)).select("table_name", "column_name", "dtype")
    edges = {(e.source_id, e.target_id): e.confidence for e in r.joinable(v, dtypes).collect()}
    assert edges["orders.amount", "transactions.value"] == 0.8
    narrow = r.joinable(v, dtypes, max_cardinality=7)
    assert all("users.id" not in (e.source_id, e.target_id) for e in narrow.collect())


def test_wide_keys_are_joinable(spark):
    key = [(str(i),) for i in range(1000)]
    v = p.long_values({"a": spark.createDataFrame(key, "k string"), "b": spark.createDataFrame(key[:950], "k string")})
    dtypes = v.select("table_name", "column_name").distinct().withColumn("dtype", F.lit("string"))
    assert rows(r.joinable(v, dtypes).select("source_id", "target_id", "confidence")) == [("a.k", "b.k", 1.0)]
    assert r.joinable(v, dtypes, max_cardinality=900).count() == 0


def test_shared_values_against_brute_force(spark):
    data = {"a": {"x": ["1", "2", "3", None], "y": ["2", "2", "9", " "]}, "b": {"x": ["3", "2", "7", "8"]}, "c": {"z": ["1", "2", "3", "3 "]}}
    tables = {n: spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols)) for n, cols in data.items()}
    got = {(s.a_table, s.a_column, s.b_table, s.b_column): s.shared for s in r.shared_values(p.long_values(tables)).collect()}
    sets = {(n, c): {v.strip() for v in vs if v and v.strip()} for n, cols in data.items() for c, vs in cols.items()}
    want = {(*k, *m): len(s & o) for k, s in sets.items() for m, o in sets.items() if k[0] != m[0] and s & o}
    assert got == want


def test_sketch(spark):
    parent, child = [f"id-{i}" for i in range(200)], [f"id-{i}" for i in range(40)]
    tables = {
        "parent": spark.createDataFrame([(x,) for x in parent], "k string"),
        "child": spark.createDataFrame([(x,) for x in child], "k string"),
        "twin": spark.createDataFrame([(x,) for x in parent], "k string"),
        "other": spark.createDataFrame([(f"other-{i}",) for i in range(40)], "k string"),
    }
    sketches = r.minhash_sketch(p.long_values(tables))
    by = {s.table_name: s for s in sketches.collect()}
    jaccard = sum(a == b for a, b in zip(by["parent"].sketch, by["child"].sketch)) / 128
    assert abs(jaccard - 0.2) < 0.14
    assert sum(a == b for a, b in zip(by["parent"].sketch, by["other"].sketch)) == 0
    found = {(s.child_table, s.parent_table) for s in r.sketch_containment(sketches).collect()}
    assert ("parent", "twin") in found and ("other", "parent") not in found
    exact = {(c.child_table, c.parent_table): c.containment for c in r.containment(p.long_values(tables)).collect()}
    assert exact["child", "parent"] == 1.0 and ("other", "parent") not in exact


def test_edge_cases(spark):
    df = spark.createDataFrame([(i if i > 2 else None, i % 2, str(i), ["a#b", "c^d", ""][i % 3]) for i in range(10)], "n int, flag bigint, digits string, tags string")
    v = p.long_values({"t": df})
    stats = {s.column_name: s for s in p.column_stats(v).collect()}
    assert stats["n"].null_rate == 0.3 and stats["n"].n_rows == 10
    types = {s.column_name: s.dtype for s in p.inferred_types(v, p.column_types({"t": df})).collect()}
    assert types == {"n": "integer", "flag": "integer_boolean", "digits": "integer", "tags": "string"}
    assert {s.column_name: s.delimiter for s in p.list_delimiter(v).collect()}["tags"] == "#"
    hist = p.histogram(df, ["n"]).collect()
    assert sum(h.cnt for h in hist) == 7 and max(h.bin for h in hist) == 9
    constant = p.histogram(spark.createDataFrame([(5,), (5,)], "x int"), ["x"]).collect()
    assert [(h.bin, h.cnt) for h in constant] == [(5, 2)]


def test_entropy_and_lists(spark):
    df = spark.createDataFrame([("ab",), ("cd",)], "x string")
    assert abs(p.char_entropy(p.long_values({"t": df})).first().entropy - 2.0) < 1e-12
    lists = spark.createDataFrame([("['A','B']",), ("['B']",), ("plain",)], "x string")
    assert rows(p.list_census(p.long_values({"t": lists})).select("value", "cnt")) == [("A", 1), ("B", 2), ("plain", 1)]


def test_lanes_and_domains(spark):
    df = spark.createDataFrame([(i, "Y" if i % 2 else "N", f"2024-01-0{i % 9 + 1}") for i in range(20)], "id bigint, enable string, created_at string")
    v = p.long_values({"t": df})
    stats, types = p.column_stats(v), p.column_types({"t": df})
    lanes = p.column_lanes(v, stats, types, [("t", "id")])
    assert {x.column_name: x.lane for x in lanes.collect()} == {"id": "range", "enable": "domain", "created_at": "range"}
    assert {x.column_name: x.closed_dictionary for x in p.closed_domains(v, lanes, stats).collect()}["enable"]


def test_name_similarity(spark):
    pairs = [("user_id", "userId", 1.0), ("user", "user_id", 0.5 + 0.5 * 4 / 6), ("abc", "", 0.0), ("kitten", "sitting", 1 - 3 / 7)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for row in df.select("a", "b", "want", names.name_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert math.isclose(row.got, row.want), row


def test_common_subsequence(spark):
    draw = random.Random(5)
    texts = [("".join(draw.choices("abcd", k=draw.randint(0, 9))), "".join(draw.choices("abcd", k=draw.randint(0, 9)))) for _ in range(60)]

    def kept(text):
        return {"".join(c) for n in range(len(text) + 1) for c in combinations(text, n)}

    df = spark.createDataFrame(texts + [("", ""), ("abc", "")], "a string, b string")
    for row in df.select("a", "b", names.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect():
        assert row.n == max(map(len, kept(row.a) & kept(row.b))), row


def test_contradicting_comments(spark):
    v = spark.createDataFrame([("t", "id", str(i), 1) for i in range(9)] + [("u", "id", str(i), 1) for i in range(9)], "table_name string, column_name string, value string, cnt long")
    comments = spark.createDataFrame([("t", "id", "id, unrelated"), ("u", "id", "id of u")], "table_name string, column_name string, comment string")
    (row,) = r.measure_relations(v, r.parent_keys(p.column_stats(v)), comments).collect()
    assert (row.score, row.comment_score, row.key_shape, row.parent_is_key, row.status) == (0.0, 0, 0.0, False, "veto")


def test_synonyms(spark):
    rows_ = [("a", "customer_id", "identifier"), ("b", "client_id", "identifier"), ("b", "state", "unknown"), ("a", "status", "unknown"), ("a", "zzz", "unknown"), ("b", "qqq", "unknown")]
    df = spark.createDataFrame(rows_, "table_name string, column_name string, semantic_type string")
    got = {(s.source_id, s.target_id): s.confidence for s in r.synonyms(df).collect()}
    assert got["a.customer_id", "b.client_id"] == 0.95 and got["a.status", "b.state"] == 0.8
    assert ("a.zzz", "b.qqq") not in got


def test_correlation_equals_join(spark):
    a = spark.createDataFrame([(i % 5, float(i * i % 17), None if i == 3 else float(i)) for i in range(40)], "k int, x double, y double")
    b = spark.createDataFrame([(i % 5, float(3 * i % 11)) for i in range(25)], "k int, z double")
    got = {c.column_a: (c.aligned_rows, c.coefficient) for c in r.cross_table_correlation(a, "k", ["x", "y"], b, "k", ["z"], 0.0).collect()}
    joined = a.join(b, "k")
    for col in ("x", "y"):
        want = joined.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)), F.corr(col, "z")).first()
        assert got[col][0] == want[0] and abs(got[col][1] - want[1]) < 1e-9


def test_relation_veto_and_contradiction(spark):
    parent = spark.createDataFrame([(i,) for i in range(50)], "id bigint")
    child = spark.createDataFrame([(i % 30, "Y" if i % 2 else "N") for i in range(60)], "parent_id bigint, enable string")
    other = spark.createDataFrame([(i, "Y" if i % 2 else "N") for i in range(60)], "x bigint, enable string")
    tables = {"child": child, "parent": parent, "other": other}
    v = p.long_values(tables)
    comments = spark.createDataFrame([("parent", "id", "row number"), ("other", "x", "unrelated to parent")], "table_name string, column_name string, comment string")
    got = {(m.left, m.right): m for m in r.measure_relations(v, r.parent_keys(p.column_stats(v)), comments).collect()}
    assert got["child.parent_id", "parent.id"].status == "publish"
    assert got["child.enable", "other.enable"].veto
    assert got["other.x", "parent.id"].score == 0.0 and got["other.x", "parent.id"].veto


def test_relations_fold_case_and_digest_long_values(spark):
    long = "Word " * 40
    a = spark.createDataFrame([("Red",), ("RED",), ("blue",), (long,), (None,), ("  ",)], "colour string")
    b = spark.createDataFrame([("red",), ("green",), (long + " ",), (long.lower(),)], "paint string")
    v = r.relation_values({"a": a, "b": b})
    assert v.agg(F.max(F.length("value"))).first()[0] <= p.DIGEST_OVER and v.where("value is null").first().cnt == 1
    # of four spellings in a, three are in b without case; of b's values the two long ones are one spelling each after trimming
    (pair,) = r.folded_overlaps(v).collect()
    assert (pair.a_shared, pair.b_shared) == (3, 3)
    (exact,) = r.shared_values(v).where("a_table = 'a'").collect()
    assert exact.shared == 1


def test_skipped_columns(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    sealed = ["".join(rng.choice(letters, 44)) for _ in range(40)]
    rows_ = [(i, sealed[i], f"2024-01-{i % 28 + 1:02d}", f"note {i}", "$2b$10$abc" if i == 7 else "x") for i in range(40)]
    df = spark.createDataFrame(rows_, "id int, sealed string, created_at string, note string, login string")
    df = df.withColumn("day", F.to_date("created_at")).withColumn("many", F.array("id"))
    tables = {"t": df}
    skipped = r.skipped_columns(tables, r.relation_values(tables))
    assert [c for _, c in skipped] == ["created_at", "day", "login", "many", "sealed"]
    other = {"u": spark.createDataFrame([(i, f"2024-01-{i + 1:02d}") for i in range(28)], "id int, created_at string")}
    v = r.relation_values(tables | other)
    none = spark.createDataFrame([], "table_name string, column_name string, comment string")
    measured = r.measure_relations(v, r.parent_keys(p.column_stats(v)), none, [*skipped, ("u", "created_at")])
    assert [(m.left, m.right) for m in measured.collect()] == [("t.id", "u.id")]


def test_table_stats_equal_those_of_distinct_values(spark):
    long = "word " * 30
    data = [(1, "5", long, None), (2, "7", long + " ", None), (2, "x", "", None), (None, "7", None, None), (3, "-1", long, None)]
    df = spark.createDataFrame(data, "n int, mixed string, text string, empty string")
    tables = {"t": df, "none": df.where("false")}
    v = p.long_values({"t": df})
    got = {(s.table_name, s.column_name): s.asDict() for s in p.table_stats(tables).collect()}
    for s in p.column_stats(v).join(p.text_stats(v), p.KEY, "left").collect():
        lengths = {} if s.column_name != "n" else dict.fromkeys(("min_length", "max_length", "avg_length"))
        assert got["t", s.column_name] == s.asDict() | lengths, s.column_name
    assert len(got) == 8 and got["none", "text"]["n_rows"] == got["none", "text"]["n_distinct"] == 0 and got["none", "n"]["null_rate"] == 0.0


def test_values_are_shuffled_once_and_read_when_counted(spark):
    """Facts of short values are made after counting, and one shuffle of the values gives pairs and cardinalities."""
    token, secret = "a" * 40, "$2b$10$" + "x" * 70
    a = spark.createDataFrame([(1, "Red "), (2, "red"), (2, token), (None, secret), (3, "İ" * 40), (3, None)], "k int, s string")
    b = spark.createDataFrame([("2", "red"), ("3", "RED"), (" 3", secret)], "k string, s string")
    v = r.relation_values({"a": a, "b": b})
    got = {(x.column_name, x.value): (x.folded, x.chars, x.cipher, x.secret, x.cnt) for x in v.where("table_name = 'a'").collect()}
    assert got["s", "Red "] == ("red ", 3, False, False, 1) and got["s", token] == (token, 40, True, False, 1)
    assert got["s", None] == (None, None, None, None, 1) and got["k", "2"] == ("2", 1, False, False, 2)
    long = [f for (c, x), f in got.items() if c == "s" and x and x.startswith("#")]
    assert [f[1:] for f in long] == [(77, False, True, 1)]
    counted = [x.split("[", 2)[1] for x in v._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x]
    assert counted and all("value" in x and "folded" not in x for x in counted)  # grouped by the value; its facts come after
    found = r.containment(v)
    assert "cnt" not in found._jdf.queryExecution().optimizedPlan().toString()  # only column sets are left to read
    pairs = {(x.child_table, x.child_column, x.parent_column): (x.shared, x.child_distinct) for x in found.collect()}
    assert pairs == {("a", "k", "k"): (2, 3), ("b", "k", "k"): (2, 2), ("a", "s", "s"): (2, 5), ("b", "s", "s"): (2, 3)}
