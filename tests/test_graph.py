from conftest import rows

from ledgerlens.operators import graph as g

EDGE = "id string, source_id string, target_id string, type string, confidence double"
NODE = "id string, type string, name string, table_name string, semantic_type string, comment string"


def chain(spark):
    return spark.createDataFrame(
        [("ab", "a", "b", "joinable", 0.9), ("bc", "b", "c", "joinable", 0.8), ("cd", "c", "d", "joinable", 0.5), ("ac", "a", "c", "joinable", 0.6)], EDGE
    )


def test_paths(spark):
    pairs = spark.createDataFrame([("a", "c"), ("a", "d")], "source string, target string")
    got = [(r.source, r.target, r.path, r.confidence) for r in g.best_paths(chain(spark), pairs).orderBy("target", "rank").collect()]
    assert got == [("a", "c", "a > b > c", 0.72), ("a", "c", "a > c", 0.6), ("a", "d", "a > b > c > d", 0.36), ("a", "d", "a > c > d", 0.3)]
    assert g.best_paths(chain(spark), pairs, ["foreign_key"]).count() == 0
    assert g.best_paths(chain(spark), pairs, max_depth=1).count() == 1


def test_subgraph(spark):
    nodes, edges = g.subgraph(chain(spark), ["d"], 2)
    assert rows(nodes) == [("a", 2), ("b", 2), ("c", 1), ("d", 0)]
    assert rows(edges) == [("ac",), ("bc",), ("cd",)]


def test_orphans(spark):
    nodes = spark.createDataFrame(
        [("col", "column"), ("c1", "concept"), ("c2", "concept"), ("e1", "entity"), ("e2", "entity")], "id string, type string"
    )
    edges = spark.createDataFrame(
        [("1", "col", "c1", "represents", 1.0), ("2", "e1", "c1", "has_concept", 1.0), ("3", "e2", "c2", "has_concept", 1.0)], EDGE
    )
    kept, left, gone = g.clean_orphans(nodes, edges)
    assert rows(gone) == [("c2",), ("e2",)]
    assert rows(kept.select("id")) == [("c1",), ("col",), ("e1",)]
    assert rows(left.select("id")) == [("1",), ("2",)]


def test_pending(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame(
        [("1", "a", "b", "t", 0.5), ("2", "a", "x", "t", 0.9), ("3", "y", "x", "t", 0.9), ("4", "a", "b", "t", 0.2)], EDGE
    )
    got = {r.id: (r.state, r.missing) for r in g.split_edges(edges, nodes).collect()}
    assert got == {"1": ("edge", ""), "2": ("pending", "target"), "3": ("pending", "source,target")}
    done, wait = g.resolve_pending(edges.where("id in ('2','3')"), spark.createDataFrame([("a",), ("x",)], "id string"))
    assert rows(done.select("id")) == [("2",)] and rows(wait.select("id")) == [("3",)]


def test_remove_table_and_dedup(spark):
    nodes = spark.createDataFrame([("t",), ("t.a",), ("u.b",)], "id string")
    edges = spark.createDataFrame([("1", "t", "t.a", "contains", 1.0), ("2", "t.a", "u.b", "joinable", 0.5), ("3", "u.b", "u.b", "x", 1.0)], EDGE)
    kept, left, rest = g.remove_table(nodes, edges, "t", {"vectors": nodes})
    assert rows(kept) == [("u.b",)] and rows(left.select("id")) == [("3",)] and rows(rest["vectors"]) == [("u.b",)]
    twice = spark.createDataFrame([("1", "a", "b", "t", 0.5), ("2", "a", "b", "t", 0.7), ("3", "a", "b", "t", 0.7)], EDGE)
    assert rows(g.deduplicate_edges(twice).select("id", "confidence", "merged")) == [("2", 0.7, 3)]


def test_search(spark):
    nodes = spark.createDataFrame(
        [("1", "column", "amount", "t", "monetary_value", ""), ("2", "column", "total_amount", "t", "", ""), ("3", "column", "x", "t", "monetary_value", ""),
         ("4", "concept", "y", "", "", "the amount paid"), ("5", "table", "z", "", "", "")], NODE
    )
    got = {r.id: r.score for r in g.search_nodes(nodes, "amount, monetary").collect()}
    assert got == {"1": 1.0, "2": 0.8, "3": 0.7, "4": 0.5}
    similar = spark.createDataFrame([("5", 0.5), ("1", 0.9)], "id string, similarity double")
    with_vectors = {r.id: round(r.score, 6) for r in g.search_nodes(nodes, "amount", similar).collect()}
    assert with_vectors["5"] == 0.36 and with_vectors["1"] == 1.0
    alone = {r.id: round(r.score, 6) for r in g.search_nodes(nodes, "nothing", similar).collect()}
    assert alone["5"] == 0.48


def test_authority(spark):
    rec = spark.createDataFrame([("terminology", "s", "database", 1), ("terminology", "s", "document", 2), ("terminology", "u", "code", 3), ("business_rule", "s", "code", 4)], "d string, s string, k string, i int")
    assert rows(g.resolve_authority(rec, "d", "s", "k").select("i")) == [(2,), (4,)]


def test_closure(spark):
    joins = spark.createDataFrame([("a", "k", "b", "k"), ("b", "m", "c", "m"), ("c", "n", "d", "n")], "a_table string, a_column string, b_table string, b_column string")
    got = g.join_closure(joins, ["a", "d"])
    assert rows(got.select("length", "step", "join")) == [(3, 0, "a.k=b.k"), (3, 1, "b.m=c.m"), (3, 2, "c.n=d.n")]
    assert g.join_closure(joins, ["a", "d"], 2).count() == 0
