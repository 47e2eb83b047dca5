"""Text and vector retrieval over whole documents, embeddings and values."""

from pyspark.sql import functions as F

from ledgerlens.functions import names, vectors
from ledgerlens.operators import profile as p
from ledgerlens.operators import retrieve as r
from ledgerlens.operators import vectors as vec
from ledgerlens.plans.profile_plans import values_sql
from ledgerlens.plans.registry import query, stored

# Documents carry no blank lines, so sentence ends followed by a line break stand in as paragraph breaks.
CHUNKS = r"""pars AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pi, p FROM (
    SELECT doc_id, i, regexp_replace(list_extract(ps, i), '^\s+|\s+$', '', 'g') AS p FROM (
      SELECT doc_id, string_split_regex(regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g'), '\n\s*\n') AS ps FROM documents), range(1, 100000) x(i) WHERE i <= len(ps)) WHERE length(p) > 0),
  fold AS (SELECT doc_id, pi, p AS cur, 0 AS grp FROM pars WHERE pi = 1
    UNION ALL SELECT f.doc_id, q.pi, CASE WHEN length(f.cur) + length(q.p) + 2 > 1600 THEN q.p ELSE f.cur || chr(10) || chr(10) || q.p END,
      CASE WHEN length(f.cur) + length(q.p) + 2 > 1600 THEN f.grp + 1 ELSE f.grp END FROM fold f JOIN pars q ON q.doc_id = f.doc_id AND q.pi = f.pi + 1),
  grp AS (SELECT doc_id, grp, arg_max(cur, pi) AS c FROM fold GROUP BY 1, 2),
  sl AS (SELECT doc_id, grp, s, CASE WHEN length(c) <= 1600 THEN c ELSE substr(c, s + 1, 1600) END AS content FROM grp, range(0, 1000000, 1400) x(s)
         WHERE s = 0 OR (length(c) > 1600 AND s < length(c))),
  ch AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, s) - 1)::INTEGER AS chunk_index, content FROM sl)"""


def chunked(t):
    docs = t.documents.select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    return r.chunk_documents(docs, "doc_id", "text")


def chunks(t):
    return stored(t, "chunks", chunked)


@query("T01_chunking", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, length(content)::INTEGER AS size, md5(content) AS digest FROM ch")
def t01(t):
    return chunks(t).select("doc_id", "chunk_index", F.length("content").alias("size"), F.md5("content").alias("digest"))


BM25 = rf"""WITH RECURSIVE {CHUNKS},
  wd AS (SELECT doc_id, chunk_index, list_filter(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}_-]+'), lambda w: length(w) > 0) AS w FROM ch),
  st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM wd),
  q AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_-]+'), lambda w: length(w) > 1), lambda w: lower(w)))) AS term FROM benchmark),
  po AS (SELECT term, doc_id, chunk_index, len(any_value(w)) AS length, count(*) AS tf FROM (SELECT doc_id, chunk_index, w, unnest(w) AS term FROM wd) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
  hit AS (SELECT query_id, doc_id, chunk_index, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / av))), 9) AS relevance
          FROM q JOIN df USING (term) JOIN po USING (term), st GROUP BY 1, 2, 3),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id, chunk_index) AS rank FROM hit)"""


def text_index(t):
    """The stored index over all chunks; their texts are not written a second time."""
    counted = stored(t, "counted-chunks", lambda t: r.counted_chunks(chunked(t)))
    return r.TextIndex(r.chunk_lists(counted), r.posting_blocks(counted))


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "T02_bm25",
    BM25 + " SELECT query_id, rank::INTEGER AS rank, doc_id, chunk_index, round(relevance, 6) AS relevance, round(1 / (1 + abs(relevance)), 6) AS score FROM rk WHERE rank <= 5",
)
def t02(t):
    hits = r.bm25(text_index(t), questions(t), 5)
    return hits.select("query_id", "rank", "doc_id", "chunk_index", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query("T03_score_threshold", BM25 + " SELECT query_id, doc_id, chunk_index FROM hit WHERE 1 / (1 + abs(relevance)) >= 0.08")
def t03(t):
    """All chunks at or above the threshold."""
    return r.above(r.bm25(text_index(t), questions(t), None), 0.08).select("query_id", "doc_id", "chunk_index")


@query("T03_score_threshold_top", BM25 + " SELECT query_id, doc_id, chunk_index FROM rk WHERE rank <= 20 AND 1 / (1 + abs(relevance)) >= 0.08")
def t03_top(t):
    """A report: of the best 20 of a query those at or above the threshold."""
    return r.above(r.bm25(text_index(t), questions(t), 20), 0.08).select("query_id", "doc_id", "chunk_index")


CENTROIDS = """cen AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
  cs AS (SELECT c.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, cen c),
  rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM cs)"""


def centroids(t):
    """Mean vector per label: one query each, as many as there are labels."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.getField("m")).alias("embedding")
    )


@query("K05_vector_top_k", f"WITH {CENTROIDS} SELECT label::VARCHAR AS query_id, vec_id, rank::INTEGER AS rank, round(s, 6) AS score FROM rk WHERE rank <= 10")
def k05(t):
    return vec.top_k(t.embeddings, centroids(t), 10).withColumn("score", F.round("score", 6))


@query(
    "T04_mode_choice",
    BM25
    + f""", {CENTROIDS.replace("rk AS", "vk AS")} SELECT 'vector' AS mode, label::VARCHAR AS query_id, vec_id::VARCHAR AS item, rank::INTEGER AS rank FROM vk WHERE rank <= 3
        UNION ALL SELECT 'text', query_id::VARCHAR, doc_id || ':' || chunk_index, rank::INTEGER FROM rk WHERE rank <= 3""",
)
def t04(t):
    by_vector = r.search(text_index(t), centroids(t), t.embeddings, 3).select(F.lit("vector").alias("mode"), "query_id", "item", "rank")
    by_text = r.search(text_index(t), questions(t), None, 3).select(F.lit("text").alias("mode"), "query_id", "item", "rank")
    return by_vector.unionByName(by_text)


@query(
    "T08_similar_above",
    f"WITH {CENTROIDS} SELECT label::VARCHAR AS query_id, vec_id, round(s, 6) AS score FROM cs WHERE round(s, 9) >= 0.35",
)
def t08(t):
    return vec.similarities(t.embeddings, centroids(t), vec.SEARCH_MIN).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "T08_similar_of_type",
    f"""WITH {CENTROIDS} SELECT cs.label::VARCHAR AS query_id, vec_id, round(s, 6) AS score FROM cs JOIN (SELECT vec_id, label AS own FROM embeddings) USING (vec_id)
        WHERE round(s, 9) >= 0.2 AND own IN (1, 3, 5)""",
)
def t08_type(t):
    """The same search among the vectors of some types only."""
    typed = t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("type"))
    return vec.similarities(typed, centroids(t), 0.2, types=["1", "3", "5"]).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "C22_cosine",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS similarity FROM embeddings""",
)
def c22(t):
    first = t.embeddings.where("vec_id = 0").select("embedding").scalar()
    both = t.embeddings.select("vec_id", "embedding", first.alias("probe"))
    return both.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("probe")), 6).alias("similarity"))


@query(
    "C25_text_normalisation",
    r"""SELECT conv_id, turn, md5(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS digest,
          len(list_filter(string_split_regex(lower(text), '[^a-z0-9一-鿿]+'), lambda w: length(w) >= 2))::INTEGER AS n_tokens FROM conversations""",
)
def c25(t):
    return t.conversations.select("conv_id", "turn", F.md5(names.normal_text(F.col("text"))).alias("digest"), F.size(names.word_tokens(F.col("text"))).alias("n_tokens"))


VALUE_COLUMNS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "part": ["p_name", "p_type", "p_brand"],
    "customer": ["c_mktsegment", "c_name"],
    "orders": ["o_orderpriority", "o_orderstatus"],
    "documents": ["lang", "source"],
}
VI = rf"""vi AS (SELECT DISTINCT table_name, column_name, value, regexp_replace(lower(trim(value)), '\s+', ' ', 'g') AS normal FROM ({values_sql(VALUE_COLUMNS)}) WHERE length(trim(value)) >= 2)"""


def index(t):
    return stored(t, "value-index", lambda t: r.value_index(p.long_values({n: getattr(t, n) for n in VALUE_COLUMNS}, VALUE_COLUMNS)))


LOOKUP = """sh AS (SELECT literal, lit, table_name, column_name, value, normal, len(list_intersect(list_distinct(ls), list_distinct(vs))) AS shared FROM (
    SELECT *, CASE WHEN length(lit) < 3 THEN [lit] ELSE list_transform(range(1, length(lit) - 1), lambda i: substr(lit, i, 3)) END AS ls,
              CASE WHEN length(normal) < 3 THEN [normal] ELSE list_transform(range(1, length(normal) - 1), lambda i: substr(normal, i, 3)) END AS vs FROM lits, vi)),
  ex AS (SELECT * FROM sh WHERE contains(normal, lit) OR contains(lit, normal)),
  nr AS (SELECT literal, table_name, column_name, sum(shared)::BIGINT AS shared, max(value) AS sample FROM sh WHERE shared > 0 AND literal NOT IN (SELECT literal FROM ex) GROUP BY 1, 2, 3 HAVING sum(shared) >= 2),
  hits AS (SELECT literal, table_name, column_name, value AS sample, 'exact' AS match, NULL::BIGINT AS shared FROM ex
    UNION ALL SELECT literal, table_name, column_name, sample, 'near', shared FROM (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY shared DESC, table_name, column_name) AS rn FROM nr) WHERE rn <= 8)"""
LOOKUP_ALL = LOOKUP.replace("SELECT *, row_number() OVER (PARTITION BY literal ORDER BY shared DESC, table_name, column_name) AS rn FROM nr) WHERE rn <= 8)", "SELECT * FROM nr))")
NEAR_COLUMNS = 8
LITERALS = ["Asia", "eu", "AUTOMOBIL", "buildng", "red ring now", "5-low", "zzz", "econmy", "src1", "1-URGENT ", "machinry"]
_LITS = ", ".join(f"('{x}')" for x in LITERALS)


_T05 = rf"WITH {VI}, lits AS (SELECT literal, regexp_replace(lower(trim(literal)), '\s+', ' ', 'g') AS lit FROM (VALUES {_LITS}) x(literal)), {LOOKUP} SELECT * FROM hits"


def literals(t):
    return t.spark.createDataFrame([(x,) for x in LITERALS], "literal string")


@query("T05_value_lookup", _T05.replace(LOOKUP, LOOKUP_ALL))
def t05(t):
    """Values behind literals with all near columns."""
    return r.lookup_values(index(t), literals(t))


@query("T05_value_lookup_top", _T05)
def t05_top(t):
    """A report: values behind literals, the eight nearest columns of a literal."""
    return r.lookup_values(index(t), literals(t), NEAR_COLUMNS)


ASKED = "SELECT p_partkey AS q_id, 'show ' || p_name || ' of type \"' || p_type || '\" in Asia' AS question FROM part"


_T06 = rf"""WITH {VI}, qs AS ({ASKED}),
        raw AS (SELECT q_id, list_distinct(list_concat(regexp_extract_all(question, '["“'']([^"”'']{{2,40}})["”'']', 1), regexp_extract_all(question, '([A-Za-z][A-Za-z0-9_./:-]{{1,40}})', 1))) AS a FROM qs),
        sp AS (SELECT DISTINCT q_id, unnest(a) AS span FROM raw),
        lits AS (SELECT DISTINCT span AS literal, lower(span) AS lit FROM sp), {LOOKUP},
        pc AS (SELECT literal, table_name, column_name, match, min(sample) AS sample FROM hits GROUP BY 1, 2, 3, 4), ct AS (SELECT literal, count(DISTINCT (table_name, column_name)) AS n FROM pc GROUP BY 1)
        SELECT q_id, span, table_name, column_name, sample, match, CASE WHEN n <= 2 THEN 'linked' ELSE 'ambiguous' END AS status FROM sp JOIN pc ON pc.literal = span JOIN ct ON ct.literal = span"""


def mentions(t):
    asked = t.part.select(
        F.col("p_partkey").alias("q_id"), F.concat(F.lit("show "), "p_name", F.lit(' of type "'), "p_type", F.lit('" in Asia')).alias("question")
    )
    return r.mention_spans(asked, "q_id", "question")


@query("T06_mention_linking", _T06.replace(LOOKUP, LOOKUP_ALL))
def t06(t):
    """All mentions of a question with all near columns."""
    return r.link_mentions(mentions(t), "q_id", index(t))


@query("T06_mention_linking_top", _T06)
def t06_top(t):
    """A report: all mentions of a question, the eight nearest columns of a mention."""
    return r.link_mentions(mentions(t), "q_id", index(t), most=NEAR_COLUMNS)


_TYPES = "CASE WHEN lang = 'en' THEN 'table' WHEN lang = 'fr' THEN 'metric' WHEN lang = 'de' THEN 'relation' ELSE 'other' END"
_TERMS = ["the", "heat", "und", "src7"]


@query(
    "T07_page_ranking",
    "WITH x AS (SELECT doc_id, "
    + _TYPES
    + " AS type, lower(source) AS title, lower(text) AS body, n_chars % 4 = 0 AS pending FROM documents), s AS (SELECT *, "
    + " + ".join(
        rf"CASE WHEN title = '{w}' OR regexp_matches(title, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)') OR regexp_matches(body, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)') THEN {12 if len(w) >= 4 else 8} ELSE 0 END"
        for w in _TERMS
    )
    + """ AS m FROM x) SELECT doc_id AS id, type, (m + CASE WHEN type = 'table' AND title = 'src7' THEN 40 ELSE 0 END + CASE type WHEN 'table' THEN 5 WHEN 'metric' THEN 8 WHEN 'relation' THEN 4 ELSE 0 END
       - CASE WHEN pending THEN 2 ELSE 0 END)::INTEGER AS score FROM s WHERE m > 0""",
)
def t07(t):
    pages = t.documents.select(
        F.col("doc_id").alias("id"), F.expr(_TYPES).alias("type"), F.col("source").alias("title"), F.col("text").alias("body"), F.when(F.col("n_chars") % 4 == 0, "pending").otherwise("done").alias("status")
    )
    return r.rank_pages(pages, _TERMS)


@query(
    "T09_conversation_view",
    """WITH m AS (SELECT conv_id, role, text, min(turn) AS turn, count(*) AS copies FROM conversations GROUP BY 1, 2, 3)
       SELECT conv_id, turn, role, md5(text) AS digest, copies, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS shown_at FROM m""",
)
def t09(t):
    out = r.conversation_view(t.conversations, "conv_id", "turn", "role", "text")
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "copies", "shown_at")
