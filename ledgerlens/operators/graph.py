"""Operators over nodes(id, type, name, semantic_type, comment) and edges(id, source_id, target_id, type, confidence)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.names import fingerprint
from ledgerlens.operators.sequences import carried
from ledgerlens.session import cut_lineage

MIN_CONFIDENCE = 0.3
MAX_DEPTH = 3
BEST_PATHS = 3

# Search and expansion weights.
SCORE_EXACT, SCORE_SUBSTRING, SCORE_SEMANTIC, SCORE_COMMENT = 1.0, 0.8, 0.7, 0.5
VECTOR_WITH_TEXT, VECTOR_ALONE = 0.6, 0.8
VECTOR_STRUCTURAL, VECTOR_CONCEPTUAL = 1.2, 0.7
EXPAND_CONCEPT, EXPAND_ENTITY, EXPAND_ENTITY_COLUMN, EXPAND_TABLE, EXPAND_COLUMN = 0.6, 0.5, 0.4, 0.4, 0.3

# Source kinds that may settle a domain, highest authority first.
AUTHORITY = {
    "physical_identity": ["database"],
    "declared_fk": ["database"],
    "terminology": ["document", "database", "dialogue"],
    "business_rule": ["code", "document"],
    "field_relation": ["code", "database", "document"],
    "enum_dictionary": ["code", "document", "database"],
    "term_bridge": ["code"],
    "query_pattern": ["dialogue"],
}


def split_edges(edges: DataFrame, nodes: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Drop weak edges; add ``state`` edge or pending with the list of missing endpoints."""
    ids = nodes.select("id").distinct()
    src = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s"))
    tgt = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t"))
    j = edges.where(F.col("confidence") >= minimum).join(src, "source_id", "left").join(tgt, "target_id", "left")
    missing = F.concat_ws(",", F.when(F.col("_s").isNull(), "source"), F.when(F.col("_t").isNull(), "target"))
    return j.select(*edges.columns, F.when(missing == "", "edge").otherwise("pending").alias("state"), missing.alias("missing"))


def resolve_pending(pending: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending edges whose endpoints now both exist, and the ones that still wait."""
    ids = nodes.select(F.col("id")).distinct()
    both = pending.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )
    return both, pending.join(both.select("id"), "id", "left_anti")


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type): the most confident, then the smallest id."""
    best = edges.groupBy("source_id", "target_id", "type").agg(
        F.max("confidence").alias("confidence"), F.min_by("id", F.struct(-F.col("confidence"), "id")).alias("id"), F.count(F.lit(1)).alias("merged")
    )
    return best


def remove_table(nodes: DataFrame, edges: DataFrame, table_id: str, side_tables: dict[str, DataFrame] | None = None):
    """Remove a table node, the columns it contains, and every edge, profile or vector of theirs."""
    gone = (
        edges.where((F.col("type") == "contains") & (F.col("source_id") == table_id))
        .select(F.col("target_id").alias("gone"))
        .unionByName(nodes.where(F.col("id") == table_id).select(F.col("id").alias("gone")))
        .distinct()
    )
    kept_nodes = nodes.join(gone, nodes["id"] == gone["gone"], "left_anti")
    kept_edges = _without(edges, gone)
    rest = {n: df.join(gone, df["id"] == gone["gone"], "left_anti") for n, df in (side_tables or {}).items()}
    return kept_nodes, kept_edges, rest


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, edges["source_id"] == gone["gone"], "left_anti").join(
        gone.withColumnRenamed("gone", "gone_t"), F.col("target_id") == F.col("gone_t"), "left_anti"
    )


def clean_orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove concepts no column or table represents, then entities that reach neither a kept concept nor a column or table.

    Returns kept nodes, kept edges and the removed ids.
    """
    structural = nodes.where(F.col("type").isin("column", "table")).select(F.col("id").alias("sid"))
    anchored = (
        edges.where(F.col("type") == "represents")
        .join(structural, F.col("source_id") == F.col("sid"), "left_semi")
        .select(F.col("target_id").alias("cid"))
        .distinct()
    )
    concepts = nodes.where(F.col("type") == "concept")
    lost_concepts = concepts.join(anchored, F.col("id") == F.col("cid"), "left_anti").select(F.col("id").alias("gone"))
    kept_concepts = concepts.join(anchored, F.col("id") == F.col("cid"), "left_semi").select(F.col("id").alias("tid"))
    left = _without(edges, lost_concepts)
    reach = (
        left.where(F.col("type") == "has_concept")
        .join(kept_concepts, F.col("target_id") == F.col("tid"), "left_semi")
        .select(F.col("source_id").alias("eid"))
        .unionByName(
            left.join(structural, F.col("target_id") == F.col("sid"), "left_semi").select(F.col("source_id").alias("eid"))
        )
        .distinct()
    )
    lost_entities = (
        nodes.where(F.col("type") == "entity").join(reach, F.col("id") == F.col("eid"), "left_anti").select(F.col("id").alias("gone"))
    )
    gone = cut_lineage(lost_concepts.unionByName(lost_entities))
    return nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), _without(edges, gone), gone


def adjacency(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Both directions of every edge: (here, there, edge_id, confidence)."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    cols = ["id", "confidence"]
    there = e.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), *cols)
    back = e.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), *cols)
    return there.unionByName(back).where("here <> there").withColumnRenamed("id", "edge_id")


def best_paths(
    edges: DataFrame, pairs: DataFrame, types: list[str] | None = None, max_depth: int = MAX_DEPTH, best: int = BEST_PATHS
) -> DataFrame:
    """The ``best`` most confident acyclic paths of at most ``max_depth`` (1 to 3) edges for every (source, target) pair.

    Paths grow from both ends and meet on an edge, so the work is the product of the two end degrees of a pair, not the
    size of a three-step neighbourhood.
    """
    adj = adjacency(edges, types)
    wanted = pairs.select("source", "target").distinct()
    step = lambda prefix: adj.select(*[F.col(c).alias(f"{prefix}_{c}") for c in adj.columns])
    a, b, m = step("a"), step("b"), step("m")
    found = [
        wanted.join(a, (F.col("source") == F.col("a_here")) & (F.col("target") == F.col("a_there"))).select(
            "source", "target", F.array("source", "target").alias("nodes"), F.array("a_edge_id").alias("edge_ids"), F.col("a_confidence").alias("confidence")
        )
    ]
    from_source = wanted.join(a, F.col("source") == F.col("a_here")).where("a_there <> target")
    if max_depth >= 2:
        found.append(
            from_source.join(b, (F.col("a_there") == F.col("b_there")) & (F.col("target") == F.col("b_here"))).select(
                "source", "target", F.array("source", "a_there", "target").alias("nodes"), F.array("a_edge_id", "b_edge_id").alias("edge_ids"),
                (F.col("a_confidence") * F.col("b_confidence")).alias("confidence"),
            )
        )
    if max_depth >= 3:
        both = from_source.join(b, F.col("target") == F.col("b_here")).where("b_there <> source and a_there <> b_there")
        found.append(
            both.join(m, (F.col("a_there") == F.col("m_here")) & (F.col("b_there") == F.col("m_there"))).select(
                "source", "target", F.array("source", "a_there", "b_there", "target").alias("nodes"),
                F.array("a_edge_id", "m_edge_id", "b_edge_id").alias("edge_ids"),
                (F.col("a_confidence") * F.col("m_confidence") * F.col("b_confidence")).alias("confidence"),
            )
        )
    every = reduce(DataFrame.unionByName, found)
    scored = every.select(
        "source", "target", F.concat_ws(" > ", "nodes").alias("path"), F.concat_ws(",", "edge_ids").alias("edge_ids"),
        F.size("edge_ids").alias("length"), F.round("confidence", 9).alias("confidence"),
    )
    return _top(scored, ["source", "target"], [F.col("confidence").desc(), F.col("path"), F.col("edge_ids")], best)


def _top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    from pyspark.sql import Window as W

    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def subgraph(edges: DataFrame, seeds: list[str] | DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within ``hops`` of the seeds and the edges walked over."""
    adj = adjacency(edges)
    spark = edges.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "id string") if isinstance(seeds, list) else seeds.select("id").distinct()
    visited = start.withColumn("hop", F.lit(0))
    frontier, walked = visited, None
    for hop in range(1, hops + 1):
        touched = adj.join(frontier.select(F.col("id").alias("here")), "here")
        walked = touched.select("edge_id") if walked is None else walked.unionByName(touched.select("edge_id"))
        fresh = touched.select(F.col("there").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        frontier = cut_lineage(fresh.withColumn("hop", F.lit(hop)))
        visited = visited.unionByName(frontier)
    return visited, walked.distinct()


def relation_map(nodes: DataFrame, edges: DataFrame, chosen: list[str], max_depth: int = MAX_DEPTH, per_pair: int = 2) -> DataFrame:
    """Direct edges among the nodes a user chose, and indirect join paths between chosen nodes of different tables."""
    spark = nodes.sparkSession
    picked = nodes.where(F.col("id").isin(*chosen)).select("id", "name", F.col("table_name"))
    s = picked.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    t = picked.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    kind = (
        F.when(F.col("type").isin("foreign_key", "joinable"), "join")
        .when(F.col("type").isin("represents", "has_concept", "semantic_synonym"), "semantic")
        .otherwise("statistical")
    )
    direct = (
        edges.join(s, "source_id")
        .join(t, "target_id")
        .select(kind.alias("relation"), F.concat_ws(" > ", "source_id", "target_id").alias("path"), F.lit(1).alias("length"), F.round("confidence", 9).alias("confidence"))
    )
    # the list comes from one user request, so its pairs are few
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(chosen), 2)), "source string, target string")
    tables = picked.select("id", "table_name")
    crossing = (
        pairs.join(tables.select(F.col("id").alias("source"), F.col("table_name").alias("_a")), "source")
        .join(tables.select(F.col("id").alias("target"), F.col("table_name").alias("_b")), "target")
        .where("_a <> _b")
    )
    indirect = best_paths(edges, crossing, ["foreign_key", "joinable"], max_depth, per_pair).where("length > 1")
    return direct.unionByName(indirect.select(F.lit("indirect").alias("relation"), "path", "length", "confidence"))


def join_templates(pairs: DataFrame) -> DataFrame:
    """One join condition per unordered column pair, the two directions merged; the stronger direction counts."""
    left, right = F.concat_ws(".", "a_table", "a_column"), F.concat_ws(".", "b_table", "b_column")
    keyed = pairs.select(F.least(left, right).alias("left"), F.greatest(left, right).alias("right"), "shared")
    merged = keyed.groupBy("left", "right").agg(F.max("shared").alias("shared"))
    return merged.withColumn("condition", F.concat(F.col("left"), F.lit(" = "), F.col("right")))


def search_nodes(nodes: DataFrame, question: str, similar: DataFrame | None = None) -> DataFrame:
    """Best score per node for the words of a question; ``similar(id, similarity)`` adds nodes found by vector only."""
    terms = [w.lower() for w in question.replace(",", " ").split()]
    if not terms:
        raise ValueError("an empty question finds nothing")
    name, sem, note = F.lower("name"), F.lower(F.coalesce("semantic_type", F.lit(""))), F.lower(F.coalesce("comment", F.lit("")))
    scores = []
    for term in terms:
        by_meaning = F.when((F.col("type") == "column") & F.contains(sem, F.lit(term)), SCORE_SEMANTIC)
        by_comment = F.when((F.col("type") != "table") & F.contains(note, F.lit(term)), SCORE_COMMENT)
        scores.append(
            F.when(name == term, SCORE_EXACT).when(F.contains(name, F.lit(term)), SCORE_SUBSTRING).otherwise(F.coalesce(by_meaning, by_comment))
        )
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    text = nodes.select("id", "type", "name", best.alias("score")).where("score is not null")
    reason = (
        F.when(F.col("score") == SCORE_EXACT, "name_exact")
        .when(F.col("score") == SCORE_SUBSTRING, "name_substring")
        .when(F.col("score") == SCORE_SEMANTIC, "semantic_type")
        .otherwise("comment")
    )
    out = text.withColumn("reason", reason)
    if similar is None:
        return out
    has_text = text.agg((F.count(F.lit(1)) > 0).alias("t")).scalar()
    by_type = F.when(F.col("type").isin("column", "table"), VECTOR_STRUCTURAL).otherwise(VECTOR_CONCEPTUAL)
    weight = F.when(has_text, VECTOR_WITH_TEXT).otherwise(VECTOR_ALONE) * by_type
    extra = nodes.join(similar, "id").join(text.select("id"), "id", "left_anti")
    return out.unionByName(extra.select("id", "type", "name", (F.col("similarity") * weight).alias("score"), F.lit("vector").alias("reason")))


def expand_nodes(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reached from found ones along weighted edges, best score each, found nodes left out."""
    start = found.join(nodes.select("id", "type"), "id").select("id", "type")
    adj = edges.select("source_id", "target_id", F.col("type").alias("etype"), "confidence")
    both = adj.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "etype", "confidence").unionByName(
        adj.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "etype", "confidence")
    )
    at = both.join(start.select(F.col("id").alias("here"), "type"), "here")
    represents, has_concept = F.col("etype") == "represents", F.col("etype") == "has_concept"
    concept = at.where((F.col("type") == "concept") & represents).select(
        F.col("there").alias("id"), (EXPAND_CONCEPT * F.col("confidence")).alias("score"), F.lit("concept").alias("via")
    )
    entity = at.where((F.col("type") == "entity") & has_concept).select("there", "confidence")
    entity_concept = entity.select(F.col("there").alias("id"), (EXPAND_ENTITY * F.col("confidence")).alias("score"), F.lit("entity").alias("via"))
    onward = both.where(represents).select(F.col("here").alias("there"), F.col("there").alias("id"), F.col("confidence").alias("c2"))
    entity_column = entity.join(onward, "there").select(
        "id", (EXPAND_ENTITY_COLUMN * F.col("confidence") * F.col("c2")).alias("score"), F.lit("entity_column").alias("via")
    )
    contains = edges.where(F.col("type") == "contains").select(F.col("source_id").alias("here"), F.col("target_id").alias("id"))
    table = contains.join(start.where(F.col("type") == "table").select(F.col("id").alias("here")), "here").select(
        "id", F.lit(EXPAND_TABLE).alias("score"), F.lit("table").alias("via")
    )
    column = at.where((F.col("type") == "column") & F.col("etype").isin("foreign_key", "joinable", "semantic_synonym")).select(
        F.col("there").alias("id"), (EXPAND_COLUMN * F.col("confidence")).alias("score"), F.lit("column").alias("via")
    )
    every = reduce(DataFrame.unionByName, [concept, entity_concept, entity_column, table, column])
    known = every.join(nodes.select("id"), "id", "left_semi").join(start.select("id"), "id", "left_anti")
    return known.groupBy("id").agg(F.max("score").alias("score"), F.max_by("via", F.struct("score", "via")).alias("via"))


def resolve_authority(records: DataFrame, domain: str, subject: str, kind: str) -> DataFrame:
    """Per domain and subject, the records of the highest-ranked source kind present; kinds without a rank never win."""
    rank = F.coalesce(
        *[F.when((F.col(domain) == d) & (F.col(kind) == k), F.lit(i)) for d, ks in AUTHORITY.items() for i, k in enumerate(ks)]
    )
    ranked = records.withColumn("authority", rank).where("authority is not null")
    winner = ranked.groupBy(domain, subject).agg(F.min("authority").alias("_win"))
    return ranked.join(winner, [domain, subject]).where("authority = _win").drop("_win")


def changed_sources(current: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new, changed or unchanged per source, by the fingerprint kept from the last run."""
    now = current.select(key, fingerprint(*[F.col(c) for c in columns]).alias("fingerprint"))
    j = now.join(previous.select(key, F.col("fingerprint").alias("_old")), key, "left")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return j.select(key, "fingerprint", status.alias("status"))


def trace_graph(messages: DataFrame, session: str, position: str, role: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges of a session: each user message starts a run, every later message is an event of it.

    Edges: starts_run (message to run), emits (run or event to the next event), continues_to (end of a run to the next turn).
    """
    user = (F.col(role) == "user").cast("int")
    numbered = carried(messages.select(session, position, role).withColumn("_u", user), [session], [position], {"run": ("sum", "_u")})
    sid, pos = F.col(session).cast("string"), F.col(position).cast("string")
    run_node = F.concat(F.lit("run:"), sid, F.lit(":"), F.col("run").cast("string"))
    own = F.concat(F.when(F.col("_u") == 1, "message:").otherwise("event:"), sid, F.lit(":"), pos)
    rows = numbered.where("run > 0").select(session, position, "run", "_u", run_node.alias("run_node"), own.alias("node"))
    turns = rows.where("_u = 1").select("node", F.lit("user-turn").alias("kind"))
    runs = rows.where("_u = 1").select(F.col("run_node").alias("node"), F.lit("run-start").alias("kind"))
    events = rows.where("_u = 0").select("node", F.lit("event").alias("kind"))
    starts = rows.where("_u = 1").select(F.col("node").alias("source"), F.col("run_node").alias("target"), F.lit("starts_run").alias("kind"))
    # what a later row follows: the run node after a user message, else the event itself
    follow = rows.withColumn("_as_source", F.when(F.col("_u") == 1, F.col("run_node")).otherwise(F.col("node")))
    linked = carried(follow, [session], [position], {"_prev": ("previous", "_as_source")})
    emits = linked.where("_u = 0").select(F.col("_prev").alias("source"), F.col("node").alias("target"), F.lit("emits").alias("kind"))
    goes_on = linked.where("_u = 1 and _prev is not null").select(
        F.col("_prev").alias("source"), F.col("node").alias("target"), F.lit("continues_to").alias("kind")
    )
    nodes = reduce(DataFrame.unionByName, [turns, runs, events])
    return nodes, reduce(DataFrame.unionByName, [starts, emits, goes_on])


def join_closure(joins: DataFrame, chosen: list[str], max_edges: int = 5) -> DataFrame:
    """Joins on the shortest paths (up to ``max_edges`` joins) between chosen tables.

    ``joins(a_table, a_column, b_table, b_column)`` is schema sized. Bridge columns are the columns of the returned joins.
    """
    both = joins.select("a_table", "a_column", "b_table", "b_column").unionByName(
        joins.select(F.col("b_table").alias("a_table"), F.col("b_column").alias("a_column"), F.col("a_table").alias("b_table"), F.col("a_column").alias("b_column"))
    ).distinct()
    edge = F.concat_ws("=", F.concat_ws(".", "a_table", "a_column"), F.concat_ws(".", "b_table", "b_column"))
    steps = both.select("a_table", "b_table", edge.alias("edge"))
    paths = steps.where(F.col("a_table").isin(*chosen)).select(
        F.col("a_table").alias("start"), F.col("b_table").alias("end"), F.array("a_table", "b_table").alias("seen"), F.array("edge").alias("edges")
    ).where("start <> end")
    done = [paths]
    for _ in range(max_edges - 1):
        longer = paths.join(steps, F.col("end") == F.col("a_table")).where(~F.array_contains("seen", F.col("b_table")))
        paths = cut_lineage(longer.select("start", F.col("b_table").alias("end"), F.concat("seen", F.array("b_table")).alias("seen"), F.concat("edges", F.array("edge")).alias("edges")))
        done.append(paths)
    every = reduce(DataFrame.unionByName, done).where(F.col("end").isin(*chosen) & (F.col("start") < F.col("end")))
    shortest = every.groupBy("start", "end").agg(F.min(F.size("edges")).alias("n"))
    kept = every.join(shortest, ["start", "end"]).where("size(edges) = n")
    return kept.select("start", "end", F.size("edges").alias("length"), F.posexplode("edges").alias("step", "join")).distinct()


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges per type."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("node").alias("what"), "type", "cnt")
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("edge").alias("what"), "type", "cnt")
    return n.unionByName(e)
