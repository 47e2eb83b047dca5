"""Knowledge-graph operators."""

from pyspark.sql import functions as F

from ledgerlens.functions.names import fingerprint
from ledgerlens.operators import graph as g
from ledgerlens.operators import relate as r
from ledgerlens.operators import vectors as vec
from ledgerlens.plans import derived
from ledgerlens.plans.registry import query
from ledgerlens.plans.relate_plans import PAIRS
from ledgerlens.plans.relate_plans import keys as relation_keys
from ledgerlens.plans.relate_plans import values as relation_values
from ledgerlens.session import scratch_path

N, E = f"n AS ({derived.NODES_SQL})", f"e AS ({derived.EDGES_SQL})"


@query(
    "N01_split_edges",
    f"""WITH {N}, {E}, a AS (SELECT * FROM e UNION ALL {derived.ORDER_EDGES_SQL})
        SELECT id, confidence, CASE WHEN s AND t THEN 'edge' ELSE 'pending' END AS state,
               CASE WHEN NOT s AND NOT t THEN 'source,target' WHEN NOT s THEN 'source' WHEN NOT t THEN 'target' ELSE '' END AS missing
        FROM (SELECT *, source_id IN (SELECT id FROM n) AS s, target_id IN (SELECT id FROM n) AS t FROM a) WHERE confidence >= 0.3""",
)
def n01(t):
    every = derived.edges(t).unionByName(derived.order_edges(t))
    return g.split_edges(every, derived.nodes(t)).select("id", "confidence", "state", "missing")


@query(
    "N02_resolve_pending",
    f"""SELECT id, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'pending' END AS state
        FROM ({derived.ORDER_EDGES_SQL}) JOIN orders ON 'o:' || o_orderkey = id""",
)
def n02(t):
    arrived = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    resolved, waiting = g.resolve_pending(derived.order_edges(t), derived.nodes(t).select("id").unionByName(arrived))
    return resolved.select("id", F.lit("resolved").alias("state")).unionByName(waiting.select("id", F.lit("pending").alias("state")))


@query(
    "N03_deduplicate_edges",
    """SELECT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'joinable' AS type, max(l_discount) AS confidence,
              arg_min('l:' || l_orderkey || ':' || l_linenumber, (-l_discount, 'l:' || l_orderkey || ':' || l_linenumber)) AS id, count(*) AS merged
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount + 0.0 AS l_discount FROM lineitem) GROUP BY l_partkey, l_suppkey""",
)
def n03(t):
    raw = t.lineitem.select(
        F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source_id"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target_id"),
        F.lit("joinable").alias("type"),
        (F.col("l_discount") + 0.0).alias("confidence"),
    )
    return g.deduplicate_edges(raw)


@query(
    "N04_remove_table",
    f"""WITH {N}, {E}, gone AS (SELECT 'brand:Brand#1' AS id UNION SELECT target_id FROM e WHERE type = 'contains' AND source_id = 'brand:Brand#1')
        SELECT 'node' AS what, id FROM n WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'edge', id FROM e WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'vector', 'part:' || vec_id FROM embeddings WHERE 'part:' || vec_id NOT IN (SELECT id FROM gone)""",
)
def n04(t):
    vectors = t.embeddings.select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("id"))
    nodes, edges, rest = g.remove_table(derived.nodes(t), derived.edges(t), "brand:Brand#1", {"vector": vectors})
    rows = lambda what, df: df.select(F.lit(what).alias("what"), "id")
    return rows("node", nodes).unionByName(rows("edge", edges)).unionByName(rows("vector", rest["vector"]))


@query(
    "N05_clean_orphans",
    f"""WITH n AS MATERIALIZED ({derived.NODES_SQL}), e AS MATERIALIZED ({derived.EDGES_SQL}),
        st AS MATERIALIZED (SELECT id AS sid FROM n WHERE type IN ('column', 'table')),
        an AS MATERIALIZED (SELECT DISTINCT target_id AS aid FROM e JOIN st ON sid = source_id WHERE type = 'represents'),
        lc AS MATERIALIZED (SELECT id AS cid FROM n LEFT JOIN an ON aid = id WHERE type = 'concept' AND aid IS NULL),
        e2 AS MATERIALIZED (SELECT source_id, target_id, type FROM e LEFT JOIN lc a ON a.cid = source_id LEFT JOIN lc b ON b.cid = target_id WHERE a.cid IS NULL AND b.cid IS NULL),
        re AS MATERIALIZED (SELECT source_id AS rid FROM e2 LEFT JOIN an ON aid = target_id LEFT JOIN st ON sid = target_id WHERE (type = 'has_concept' AND aid IS NOT NULL) OR sid IS NOT NULL GROUP BY 1),
        go AS MATERIALIZED (SELECT cid AS gid FROM lc UNION ALL SELECT id FROM n LEFT JOIN re ON rid = id WHERE type = 'entity' AND rid IS NULL)
        SELECT 'removed' AS what, gid AS id FROM go UNION ALL SELECT 'node', id FROM n LEFT JOIN go ON gid = id WHERE gid IS NULL
        UNION ALL SELECT 'edge', e.id FROM e LEFT JOIN go a ON a.gid = source_id LEFT JOIN go b ON b.gid = target_id WHERE a.gid IS NULL AND b.gid IS NULL""",
)
def n05(t):
    nodes, kept, gone = g.clean_orphans(derived.nodes(t), derived.edges(t))
    rows = lambda what, df, c: df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    return rows("removed", gone, "gone").unionByName(rows("node", nodes, "id")).unionByName(rows("edge", kept, "id"))


_TYPES = ["represents", "has_concept", "foreign_key", "joinable"]


@query(
    "N06_best_paths",
    f"""WITH RECURSIVE {E}, adj AS (SELECT source_id AS here, target_id AS there, id, confidence FROM e WHERE type <> 'contains'
            UNION ALL SELECT target_id, source_id, id, confidence FROM e WHERE type <> 'contains'),
        w AS (SELECT 'customer:' || c_custkey AS source, 'region:' || n_regionkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey),
        p AS (SELECT w.source, w.target, there AS here, [w.source, there] AS nodes, [id] AS ids, confidence FROM w JOIN adj ON here = source
              UNION ALL SELECT source, target, there, list_append(nodes, there), list_append(ids, id), p.confidence * adj.confidence
              FROM p JOIN adj ON adj.here = p.here WHERE len(ids) < 3 AND p.here <> target AND NOT list_contains(nodes, there)
                AND (len(ids) = 1 OR there = target)),
        r AS (SELECT source, target, array_to_string(nodes, ' > ') AS path, array_to_string(ids, ',') AS edge_ids, len(ids)::INTEGER AS length, round(confidence, 9) AS confidence
              FROM p WHERE here = target)
        SELECT *, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, path, edge_ids) AS rank FROM r) WHERE rank <= 3""".replace(
        "SELECT *, rank::INTEGER AS rank FROM (SELECT *, row_number()", "SELECT * REPLACE (rank::INTEGER AS rank) FROM (SELECT *, row_number()"
    ),
)
def n06(t):
    pairs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source"),
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("target"),
    )
    return g.best_paths(derived.edges(t), pairs, _TYPES)


@query(
    "N07_subgraph",
    f"""WITH {E}, adj AS (SELECT source_id AS here, target_id AS there, id FROM e UNION ALL SELECT target_id, source_id, id FROM e),
        h0 AS (SELECT 'brand:Brand#1' AS id), w1 AS (SELECT there, adj.id FROM adj JOIN h0 ON here = h0.id),
        h1 AS (SELECT DISTINCT there AS id FROM w1 WHERE there NOT IN (SELECT id FROM h0)),
        w2 AS (SELECT there, adj.id FROM adj JOIN h1 ON here = h1.id),
        h2 AS (SELECT DISTINCT there AS id FROM w2 WHERE there NOT IN (SELECT id FROM h0) AND there NOT IN (SELECT id FROM h1))
        SELECT 'node' AS what, id, 0 AS hop FROM h0 UNION ALL SELECT 'node', id, 1 FROM h1 UNION ALL SELECT 'node', id, 2 FROM h2
        UNION ALL SELECT 'edge', id, NULL FROM (SELECT id FROM w1 UNION SELECT id FROM w2)""",
)
def n07(t):
    nodes, walked = g.subgraph(derived.edges(t), ["brand:Brand#1"], 2)
    return nodes.select(F.lit("node").alias("what"), "id", "hop").unionByName(
        walked.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id"), F.lit(None).cast("int").alias("hop"))
    )


CHOSEN = ["segment:AUTOMOBILE", "segment:MACHINERY", "segment:BUILDING", "region:0", "region:1", "region:2", "nation:3"]
_CH = ", ".join(f"'{c}'" for c in CHOSEN)


@query(
    "N08_relation_map",
    f"""WITH RECURSIVE {N}, {E}, c AS (SELECT id, table_name FROM n WHERE id IN ({_CH})),
        adj AS (SELECT source_id AS here, target_id AS there, id, confidence FROM e WHERE type IN ('foreign_key', 'joinable')
                UNION ALL SELECT target_id, source_id, id, confidence FROM e WHERE type IN ('foreign_key', 'joinable')),
        w AS (SELECT a.id AS source, b.id AS target FROM c a JOIN c b ON a.id < b.id AND a.table_name <> b.table_name),
        p AS (SELECT source, target, there AS here, [source, there] AS nodes, [id] AS ids, confidence FROM w JOIN adj ON here = source
              UNION ALL SELECT source, target, there, list_append(nodes, there), list_append(ids, id), p.confidence * adj.confidence
              FROM p JOIN adj ON adj.here = p.here WHERE len(ids) < 3 AND p.here <> target AND NOT list_contains(nodes, there)),
        r AS (SELECT source, target, array_to_string(nodes, ' > ') AS path, array_to_string(ids, ',') AS edge_ids, len(ids)::INTEGER AS length, round(confidence, 9) AS confidence
              FROM p WHERE here = target),
        k AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, path, edge_ids) AS rank FROM r)
        SELECT 'indirect' AS relation, path, length, confidence FROM k WHERE rank <= 2 AND length > 1
        UNION ALL SELECT CASE WHEN type IN ('foreign_key', 'joinable') THEN 'join' ELSE 'semantic' END, source_id || ' > ' || target_id, 1, round(confidence, 9)
        FROM e WHERE source_id IN ({_CH}) AND target_id IN ({_CH})""",
)
def n08(t):
    return g.relation_map(derived.nodes(t), derived.edges(t), CHOSEN)


@query(
    "N09_join_templates",
    f"""WITH {PAIRS} SELECT least(l, r) AS "left", greatest(l, r) AS "right", max(shared) AS shared, least(l, r) || ' = ' || greatest(l, r) AS condition
        FROM (SELECT lt || '.' || ac AS l, rt || '.' || bc AS r, shared FROM pairs) GROUP BY least(l, r), greatest(l, r)""",
)
def n09(t):
    return g.join_templates(r.shared_values(relation_values(t)))


@query(
    "N10_search_nodes",
    f"""WITH {N}, q(w) AS (VALUES ('asia'), ('small'), ('economy'), ('ring'), ('building'), ('market')),
        s AS (SELECT id, type, name, max(CASE WHEN lower(name) = w THEN 1.0 WHEN contains(lower(name), w) THEN 0.8
               WHEN type = 'column' AND contains(lower(semantic_type), w) THEN 0.7 WHEN type <> 'table' AND contains(lower(comment), w) THEN 0.5 END) AS score
              FROM n CROSS JOIN q GROUP BY ALL),
        v AS (SELECT 'part:' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS sim FROM embeddings)
        SELECT id, type, name, round(score::DOUBLE, 6) AS score, CASE score WHEN 1.0 THEN 'name_exact' WHEN 0.8 THEN 'name_substring' WHEN 0.7 THEN 'semantic_type' ELSE 'comment' END AS reason
        FROM s WHERE score IS NOT NULL
        UNION ALL SELECT n.id, n.type, n.name, round(sim * 0.6 * 1.2, 6), 'vector' FROM n JOIN v ON v.id = n.id
        WHERE sim >= 0.2 AND n.id NOT IN (SELECT id FROM s WHERE score IS NOT NULL)""",
)
def n10(t):
    probe = t.embeddings.where("vec_id = 0").select(F.lit("q").alias("query_id"), "embedding")
    hits = vec.similarities(t.embeddings, probe, 0.2).select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("id"), F.col("score").alias("similarity"))
    out = g.search_nodes(derived.nodes(t), "asia small, economy ring building market", hits)
    return out.withColumn("score", F.round("score", 6))


@query(
    "N11_expand_nodes",
    f"""WITH {N}, {E}, f AS (SELECT * FROM n WHERE name IN ('ASIA', 'NATION_3', 'Brand#2', 'Supplier#000000007')),
        x AS (SELECT source_id AS here, target_id AS there, type AS et, confidence AS c FROM e UNION ALL SELECT target_id, source_id, type, confidence FROM e),
        u AS (SELECT there AS id, 0.6 * c AS score, 'concept' AS via FROM f JOIN x ON here = f.id WHERE f.type = 'concept' AND et = 'represents'
          UNION ALL SELECT there, 0.5 * c, 'entity' FROM f JOIN x ON here = f.id WHERE f.type = 'entity' AND et = 'has_concept'
          UNION ALL SELECT y.there, 0.4 * x.c * y.c, 'entity_column' FROM f JOIN x ON x.here = f.id JOIN x y ON y.here = x.there WHERE f.type = 'entity' AND x.et = 'has_concept' AND y.et = 'represents'
          UNION ALL SELECT target_id, 0.4, 'table' FROM f JOIN e ON source_id = f.id WHERE f.type = 'table' AND e.type = 'contains'
          UNION ALL SELECT there, 0.3 * c, 'column' FROM f JOIN x ON here = f.id WHERE f.type = 'column' AND et IN ('foreign_key', 'joinable', 'semantic_synonym'))
        SELECT id, round(max(score)::DOUBLE, 6) AS score, arg_max(via, (score, via)) AS via FROM u WHERE id IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM f) GROUP BY id""",
)
def n11(t):
    nodes = derived.nodes(t)
    found = nodes.where(F.col("name").isin("ASIA", "NATION_3", "Brand#2", "Supplier#000000007")).select("id")
    return g.expand_nodes(found, nodes, derived.edges(t)).withColumn("score", F.round("score", 6))


@query(
    "N12_similar_nodes",
    """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
       FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3""",
)
def n12(t):
    # the vectors given are far apart, so the merge threshold is lowered to see pairs
    return vec.similar_pairs(t.embeddings, 0.3).withColumn("similarity", F.round("similarity", 6))


_DOMAIN = "CASE event_type WHEN 'click' THEN 'terminology' WHEN 'view' THEN 'field_relation' WHEN 'signup' THEN 'business_rule' WHEN 'purchase' THEN 'enum_dictionary' ELSE 'declared_fk' END"
_KIND = "CASE WHEN value < 20 THEN 'document' WHEN value < 50 THEN 'database' WHEN value < 90 THEN 'dialogue' ELSE 'code' END"


@query(
    "N13_authority",
    f"""WITH x AS (SELECT event_id, user_id, {_DOMAIN} AS domain, {_KIND} AS kind FROM events),
        a(domain, kind, authority) AS (VALUES ('terminology', 'document', 0), ('terminology', 'database', 1), ('terminology', 'dialogue', 2), ('business_rule', 'code', 0),
          ('business_rule', 'document', 1), ('field_relation', 'code', 0), ('field_relation', 'database', 1), ('field_relation', 'document', 2), ('enum_dictionary', 'code', 0),
          ('enum_dictionary', 'document', 1), ('enum_dictionary', 'database', 2), ('declared_fk', 'database', 0))
        SELECT event_id, user_id, domain, kind, authority FROM (SELECT *, min(authority) OVER (PARTITION BY domain, user_id) AS win FROM x JOIN a USING (domain, kind)) WHERE authority = win""",
)
def n13(t):
    records = t.events.select("event_id", "user_id", F.expr(_DOMAIN).alias("domain"), F.expr(_KIND).alias("kind"))
    return g.resolve_authority(records, "domain", "user_id", "kind")


@query(
    "N14_changed_sources",
    """SELECT doc_id, substr(sha256(to_json({'lang': lang, 'text': text})), 1, 16) AS fingerprint,
              CASE WHEN source = 'src1' THEN 'new' WHEN lang = 'de' THEN 'changed' ELSE 'unchanged' END AS status FROM documents""",
)
def n14(t):
    before = t.documents.where("source <> 'src1'").withColumn("lang", F.when(F.col("lang") == "de", "xx").otherwise(F.col("lang")))
    path = scratch_path(t.spark, "fingerprints")
    before.select("doc_id", fingerprint(F.col("lang"), F.col("text")).alias("fingerprint")).write.parquet(path)
    return g.changed_sources(t.documents, t.spark.read.parquet(path), "doc_id", ["lang", "text"])


@query(
    "N15_trace_graph",
    """WITH m AS (SELECT conv_id, turn, role = 'user' AS u, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations),
       r AS (SELECT *, 'run:' || conv_id || ':' || run AS rn, CASE WHEN u THEN 'message:' ELSE 'event:' END || conv_id || ':' || turn AS node FROM m WHERE run > 0),
       l AS (SELECT *, lag(CASE WHEN u THEN rn ELSE node END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM r)
       SELECT 'node' AS what, node AS a, NULL AS b, 'user-turn' AS kind FROM r WHERE u UNION ALL SELECT 'node', rn, NULL, 'run-start' FROM r WHERE u
       UNION ALL SELECT 'node', node, NULL, 'event' FROM r WHERE NOT u UNION ALL SELECT 'edge', node, rn, 'starts_run' FROM r WHERE u
       UNION ALL SELECT 'edge', prev, node, 'emits' FROM l WHERE NOT u UNION ALL SELECT 'edge', prev, node, 'continues_to' FROM l WHERE u AND prev IS NOT NULL""",
)
def n15(t):
    nodes, edges = g.trace_graph(t.conversations, "conv_id", "turn", "role")
    return nodes.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "kind").unionByName(
        edges.select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), "kind")
    )


@query(
    "N16_join_closure",
    f"""WITH RECURSIVE {PAIRS}, j AS (SELECT lt, ac, rt, bc FROM pairs JOIN keys k ON k.table_name = rt AND k.column_name = bc JOIN card c ON c.table_name = lt AND c.column_name = ac
            WHERE k.is_key AND shared / c.n >= 0.95 AND right(ac, 7) = right(bc, 7)),
        s AS (SELECT DISTINCT lt, rt, lt || '.' || ac || '=' || rt || '.' || bc AS edge FROM (SELECT * FROM j UNION ALL SELECT rt, bc, lt, ac FROM j)),
        p AS (SELECT lt AS start, rt AS "end", [lt, rt] AS seen, [edge] AS edges FROM s WHERE lt IN ('part', 'region', 'customer')
              UNION ALL SELECT start, s.rt, list_append(seen, s.rt), list_append(edges, s.edge) FROM p JOIN s ON s.lt = p."end" WHERE len(edges) < 5 AND NOT list_contains(seen, s.rt)),
        q AS (SELECT *, min(len(edges)) OVER (PARTITION BY start, "end") AS n FROM p WHERE "end" IN ('part', 'region', 'customer') AND start < "end")
        SELECT DISTINCT start, "end", len(edges)::INTEGER AS length, (i - 1)::INTEGER AS step, edges[i] AS "join" FROM q, range(1, 6) x(i) WHERE len(edges) = n AND i <= len(edges)""",
)
def n16(t):
    v = relation_values(t)
    parents = relation_keys(t, v).where("is_key").select(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"))
    found = r.containment(v).where("containment >= 0.95").join(parents, ["parent_table", "parent_column"])
    found = found.where("right(child_column, 7) = right(parent_column, 7)")
    joins = found.select(
        F.col("child_table").alias("a_table"), F.col("child_column").alias("a_column"), F.col("parent_table").alias("b_table"), F.col("parent_column").alias("b_column")
    )
    return g.join_closure(joins, ["part", "region", "customer"])


@query(
    "A27_graph_counts",
    f"""WITH {N}, {E} SELECT 'node' AS what, type, count(*) AS cnt FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2""",
)
def a27(t):
    return g.graph_counts(derived.nodes(t), derived.edges(t))


@query("C20_fingerprint", "SELECT doc_id, substr(sha256(to_json({'doc_id': doc_id, 'lang': lang, 'text': text})), 1, 16) AS fingerprint FROM documents")
def c20(t):
    return t.documents.select("doc_id", fingerprint(F.col("doc_id"), F.col("lang"), F.col("text")).alias("fingerprint"))
