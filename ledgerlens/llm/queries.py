"""The registered queries over the test tables, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import chat, exact_dedup, filter_audit, fingerprints, line_dedup, minhash, mixing, ngram_join, packing, quality, substring, token_blocks, vector_codes
from ledgerlens.llm.common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 words."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op3_ngram_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree to 80 in 100."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of good quality for all documents: host is the source, path the language."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_token_blocks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = token_blocks.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_document_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS share
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM w),
v AS (
    SELECT *, 3 * (sum(source_size) OVER ())::BIGINT - 4 * coalesce(sum(source_size) OVER before, 0)::BIGINT AS open_size,
           (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS open_weight
    FROM r WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS place FROM v WHERE open_size * weight <= 4 * source_size * open_weight),
t AS (
    SELECT v.source, v.source_size,
           CASE WHEN v.place >= f.place THEN (l.open_size * v.weight)::DOUBLE / (2 * l.open_weight)::DOUBLE ELSE (2 * v.source_size)::DOUBLE END AS target
    FROM v LEFT JOIN f ON true LEFT JOIN v AS l ON l.place = f.place),
c AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
k AS (
    SELECT source, size, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
           sum(n * size * sqrt(size)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
    FROM c),
y AS (
    SELECT t.source, any_value(t.source_size) AS source_size, any_value(t.target) AS target,
           max_by((t.target - 2 * filled) / opened, CASE WHEN (t.target - 2 * filled) / opened * sqrt(size) <= 2 THEN size END) AS level
    FROM t LEFT JOIN k ON t.source IS NOT DISTINCT FROM k.source GROUP BY t.source),
e AS (
    SELECT d.*, y.source_size, y.target,
           CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE, coalesce(y.level * sqrt(size), 2.0::DOUBLE)) END AS expected
    FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source),
g AS (
    SELECT *, floor(expected) AS certain,
           CASE WHEN expected > floor(expected) THEN (share / (1 - share)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rank
    FROM e),
h AS (
    SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS room,
           sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id) AS upto
    FROM g)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN rank IS NOT NULL AND (upto <= room OR (upto - size < room AND upto - room <= room - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h
"""


@query("op7_pareto_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)),
l AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS gone FROM w JOIN l USING (k) WHERE least < doc_id GROUP BY doc_id),
x AS (
    SELECT d.doc_id, u.word, u.place
    FROM d, LATERAL (SELECT unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place) AS u
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS place FROM g) AS q WHERE q.doc_id = d.doc_id AND q.place = u.place)),
r AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(r.n, 0))::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


@query("op8_substring_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a smaller doc_id has too, over all documents."""
    return substring.dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\x20\x09-\x0D]')) AS counted FROM d),
l AS (
    SELECT doc_id, s, n, x1, x2, x3, length(regexp_replace(x1, '[\x20\x09-\x0D]', '', 'g')) AS c1, c1 + length(regexp_replace(x2, '[\x20\x09-\x0D]', '', 'g')) AS c2
    FROM (SELECT doc_id, s, len(counted) AS n, lines[counted[s]] AS x1, lines[counted[s + 1]] AS x2, lines[counted[s + 2]] AS x3
          FROM (SELECT doc_id, lines, counted, unnest(range(1, len(counted) + 1)) AS s FROM c))),
w AS (
    SELECT doc_id, s, CASE WHEN c1 >= 12 THEN [x1] WHEN c2 >= 12 THEN [x1, x2] WHEN s + 2 <= n THEN [x1, x2, x3] WHEN s = 1 AND n = 1 THEN [x1] WHEN s = 1 THEN [x1, x2] END AS run
    FROM l),
p AS (SELECT doc_id, s, len(run) AS size, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM w WHERE run IS NOT NULL),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + size)))) AS gone FROM p WHERE k > 1 GROUP BY doc_id),
j AS (SELECT c.*, coalesce(list_transform(gone, lambda x: counted[x]), []) AS gone FROM c LEFT JOIN g USING (doc_id))
SELECT doc_id, len(counted)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10))) AS kept_sha256
FROM j
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of lines over all documents: three lines, or fewer with twelve characters, or a whole short document."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(24 + length(role) + len(regexp_extract_all(role, '[\\|\n]')) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op10_chat_formatting", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(written(chat.format_conversations(turns), "chat"))


@query("op11_minhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree to 85 in 100; the smallest doc_id of each is kept."""
    return minhash.near_copies(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
    FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, failed, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT unnest(string_split('ABCDE', '')) AS f),
o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, filter_order, unnest(range(1, 6)) AS step FROM (SELECT DISTINCT part FROM t), o),
p AS (SELECT *, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM s),
r AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN translate(failed, before || own, '') = failed THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') <> failed THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN good AND contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN toxic AND contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM p JOIN c USING (part) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


@query("op12_filter_interaction_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other; distances as |a|^2 - 2ab + |b|^2, exact in doubles of this size."""
    head = """
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
    SELECT vec_id, label, p, w[p * len(w) // 4 + 1:(p + 1) * len(w) // 4] AS a, list_inner_product(a, a) AS aa
    FROM v, (SELECT unnest(range(0, 4)) AS p)),
b0 AS MATERIALIZED (
    SELECT p, e, a AS c, aa AS cc FROM (SELECT p, a, aa, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < 256)"""
    near = "SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, label, x.p, e, aa - 2 * list_inner_product(a, c) + cc AS d FROM x JOIN {book} AS b ON x.p = b.p) GROUP BY ALL"
    near = near.replace("GROUP BY ALL", "GROUP BY vec_id, label, p")
    for k in range(rounds):
        head += f""",
n{k} AS MATERIALIZED ({near.format(book=f"b{k}")}),
m{k} AS (
    SELECT p, e, list(s ORDER BY i) AS c
    FROM (SELECT n.p, n.e, u.i, floor(sum(u.s) / count(*)) AS s
          FROM n{k} AS n JOIN x ON n.vec_id = x.vec_id AND n.p = x.p, LATERAL (SELECT unnest(x.a) AS s, unnest(range(0, len(x.a))) AS i) AS u
          GROUP BY n.p, n.e, u.i)
    GROUP BY p, e),
b{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c, list_inner_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) AS cc
    FROM b{k} AS b LEFT JOIN m{k} AS m ON b.p = m.p AND b.e = m.e)"""
    return (
        head
        + f""",
z AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM ({near.format(book=f"b{rounds}")}) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM z
"""
    )


@query("op13_vector_codes", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bytes for each vector of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), "label")
    return vector_codes.encode(vectors).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
