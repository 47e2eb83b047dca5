"""Text retrieval: chunks, BM25, value lookup, mention linking and page ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import text as tx
from ledgerlens.functions.names import normal_text
from ledgerlens.operators import vectors as vec
from ledgerlens.operators.sequences import carried
from ledgerlens.session import cut_lineage, written

TOP_DEFAULT = 5
#: Chunks of a shard of the text index.
SHARD_CHUNKS = 1024
#: Hash slots of asked terms: so many numbers at most go to all tasks.
TERM_SLOTS = 1 << 18
K1, B = 1.2, 0.75
LINK_COLUMNS = 2

# Weight of a page by its type.
PAGE_WEIGHTS = {
    "metric": 8,
    "concept": 7,
    "contradiction": 6,
    "query-pattern": 6,
    "table": 5,
    "relation": 4,
    "value-domain": 3,
    "dictionary": 4,
}


def chunk_documents(documents: DataFrame, key: str, text: str, size: int = tx.CHUNK_SIZE, overlap: int = tx.CHUNK_OVERLAP) -> DataFrame:
    """Rows (doc_id, chunk_index, content) covering the whole of every document."""
    return documents.select(F.col(key).alias("doc_id"), F.posexplode(tx.chunks(F.col(text), size, overlap)).alias("chunk_index", "content"))


@dataclass(frozen=True)
class TextIndex:
    """Chunks with their lengths, and postings in blocks; both parts of one written table, see :func:`counted_chunks`."""

    #: shard, chunks (array of doc_id, chunk_index, length)
    counted: DataFrame
    #: shard, term, n, max_tf, min_length, postings (array of places among the shard's chunks), tf (array)
    blocks: DataFrame


def counted_chunks(chunks: DataFrame, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """Chunks with their words counted inside the chunk, shard by shard; written as a table it is the whole text index.

    A shard is the next ``shard_chunks`` chunks that a task reads. Its words are counted and put in the order of the terms where they are read, so that no text, word or count is
    shuffled, nor written before it is a posting. Rows: shard, term, n, max_tf, min_length, postings, tf, chunks. A row for each term of a shard holds the places of the chunks
    with that term and its counts there; a row without a term lists the chunks of the shard. The numbers of shards are those of one run: write the rows before they are read twice.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def blocks_of(shard: int, pieces: list[pa.RecordBatch]):
        part = pa.Table.from_batches(pieces).combine_chunks()
        words = part.column("words").combine_chunks()
        length = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        code = at[coded.indices.to_numpy(zero_copy_only=False)]
        cells, tf = np.unique(code * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
        place, tf = (cells % len(length)).astype(np.int32), tf.astype(np.int32)
        begin = np.searchsorted(cells, np.arange(len(order) + 1) * len(length)).astype(np.int32)
        some = len(order) > 0
        each = [
            pa.array(np.diff(begin).astype(np.int64)),
            pa.array(np.maximum.reduceat(tf, begin[:-1]) if some else tf),
            pa.array(np.minimum.reduceat(length[place], begin[:-1]) if some else tf),
            *(pa.ListArray.from_arrays(pa.array(begin), pa.array(x)) for x in (place, tf)),
        ]
        held = pa.StructArray.from_arrays([part.column("doc_id").combine_chunks(), part.column("chunk_index").combine_chunks(), pa.array(length)], names=["doc_id", "chunk_index", "length"])
        held = pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), held)
        names = ["shard", "term", "n", "max_tf", "min_length", "postings", "tf", "chunks"]
        number = pa.array([shard], pa.int64())
        yield pa.RecordBatch.from_arrays([number, pa.nulls(1, coded.dictionary.type), *(pa.nulls(1, x.type) for x in each), held], names=names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.repeat(number[0], len(order)), coded.dictionary.take(pa.array(order)), *each, pa.nulls(len(order), held.type)], names=names)

    def run(batches):
        shard, pieces, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                pieces.append(batch.slice(0, shard_chunks - n))
                n, batch = n + pieces[-1].num_rows, batch.slice(shard_chunks - n)
                if n == shard_chunks:
                    yield from blocks_of(shard, pieces)
                    shard, pieces, n = shard + 1, [], 0
        if pieces:
            yield from blocks_of(shard, pieces)

    words = chunks.select("doc_id", "chunk_index", F.coalesce(tx.index_words(F.col("content")), F.array().cast("array<string>")).alias("words"))
    held = f"array<struct<doc_id: {kind}, chunk_index: int, length: int>>"
    return words.mapInArrow(run, f"shard bigint, term string, n bigint, max_tf int, min_length int, postings array<int>, tf array<int>, chunks {held}")


def chunk_lists(counted: DataFrame) -> DataFrame:
    """The chunks of each shard in the order that postings count them."""
    return counted.where("term IS NULL").select("shard", "chunks")


def posting_blocks(counted: DataFrame) -> DataFrame:
    """Postings in blocks: one block for each term of a shard.

    A term that all chunks hold has as many blocks as there are shards, none longer than a shard. A block knows its greatest count and its shortest chunk, which bound
    the weight of all its postings.
    """
    return counted.where("term IS NOT NULL").select("shard", "term", "n", "max_tf", "min_length", "postings", "tf")


def text_index(chunks: DataFrame, shard_chunks: int = SHARD_CHUNKS) -> TextIndex:
    """An index of chunks in the shared folder."""
    counted = written(counted_chunks(chunks, shard_chunks), "text-index")
    return TextIndex(chunk_lists(counted), posting_blocks(counted))


def _shard_scores(top: int | None):
    """Relevance of the chunks of one shard for all queries; with ``top`` the best of each query in the order of :func:`bm25`."""

    def in_order(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The different ids in order, and the place of each id among them."""
        coded = ids.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]

    def score(rows: pa.Table) -> pa.Table:
        listed = rows.filter(rows.column("chunks").is_valid())
        chunks = listed.column("chunks").combine_chunks().flatten()
        chunks = pa.table([chunks.field(c) for c in ("doc_id", "chunk_index", "length")], names=["doc_id", "chunk_index", "length"])
        # chunks in the order of doc_id, chunk_index
        order = pc.sort_indices(chunks, sort_keys=[("doc_id", "ascending"), ("chunk_index", "ascending")], null_placement="at_start").to_numpy()
        chunk_at = np.empty(len(order), np.int64)
        chunk_at[order] = np.arange(len(order))
        blocks = rows.filter(rows.column("postings").is_valid())
        each, found, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        place, tf = (blocks.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("postings", "tf"))
        lists = [blocks.column(c).combine_chunks() for c in ("postings", "asked")]
        ends, stops = (np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)) for x in lists)
        length = chunks.column("length").to_numpy()[place]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (listed.column("avg")[0].as_py() or 1.0)))
        place = chunk_at[place]
        asked, query_at = in_order(lists[1].flatten())
        idf = blocks.column("idf").to_numpy()
        block_of = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
        by_query = np.argsort(query_at, kind="stable")
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cell = np.zeros(len(order))
        for run in np.split(by_query, np.flatnonzero(np.diff(query_at[by_query])) + 1) if len(by_query) else []:
            cell[:] = 0
            for i in block_of[run]:
                span = slice(begin[i], ends[i])
                # a chunk stands in a block once
                cell[place[span]] += idf[i] * weight[span]
            held = np.flatnonzero(cell)
            relevance = np.rint(cell[held] * 1e9)
            if top is not None and len(held) > top:
                able = np.flatnonzero(relevance >= np.partition(relevance, -top)[-top])
                able = able[np.argsort(-relevance[able], kind="stable")[:top]]
                held, relevance = held[able], relevance[able]
            each.append(np.full(len(held), query_at[run[0]]))
            found.append(held)
            sums.append(relevance / 1e9)
        hit = chunks.take(pa.array(order[np.concatenate(found)]))
        return pa.table(
            [asked.take(pa.array(np.concatenate(each))), hit.column("doc_id"), hit.column("chunk_index"), pa.array(np.concatenate(sums))],
            names=["query_id", "doc_id", "chunk_index", "relevance"],
        )

    return score


def _may_be_asked(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of all asked terms, and of some others that share a hash slot with one: the rest is left out before a join by term could shuffle it."""
    slot = F.pmod(F.xxhash64("term"), F.lit(TERM_SLOTS)).alias("slot")
    # at most TERM_SLOTS numbers, however many terms are asked for
    return blocks.select("*", slot).join(F.broadcast(asked.select(slot).distinct()), "slot", "left_semi").drop("slot")


def bm25(index: TextIndex, queries: DataFrame, top: int | None = TOP_DEFAULT) -> DataFrame:
    """The best ``top`` chunks per query for any of its terms: score ``1 / (1 + bm25)`` of the index, as users see it.

    ``queries(query_id, query)``; all terms of a query count. A term's blocks get the queries that ask for it, blocks meet by shard with the shard's chunks, and a shard of
    1,024 chunks sums its postings for one query after the other: postings of asked terms are sent once, however many queries ask for them, each as a place and a count, and no
    row is made for a query and a posting. With ``top`` a shard hands on the best of each query only; they are ranked among all shards.
    With ``top=None`` all chunks that hold a term come back and no rank is given, so that no query's hits are sorted in one task.
    Rows: query_id, rank (with ``top``), doc_id, chunk_index, relevance, score.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.query_terms(F.col("query")))).alias("term"))
    words = F.aggregate(F.col("chunks.length"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    size = index.counted.agg(F.struct(F.sum(F.size("chunks")).alias("n"), (F.sum(words) / F.sum(F.size("chunks"))).alias("avg")).alias("s")).scalar()
    spread = _may_be_asked(index.blocks.select("term", "n"), asked).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    n, avg = size.getField("n"), size.getField("avg")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    # nulls are ids too: collect_list would leave them out
    ids = F.transform(F.array_sort(F.collect_list(F.struct("query_id"))), lambda q: q.getField("query_id"))
    each = asked.groupBy("term").agg(ids.alias("asked")).join(spread, "term").select("term", idf.alias("idf"), "asked")
    # a written table: Spark knows its size, so that it goes to the blocks while it is small
    askers = written(each, "askers")

    top = None if top is None else max(1, top)
    blocks = _may_be_asked(index.blocks.select("shard", "term", "postings", "tf"), asked).join(askers, "term").drop("term")
    rows = blocks.unionByName(index.counted.withColumn("avg", avg), allowMissingColumns=True)
    kinds = {"query_id": asked.schema["query_id"].dataType, "doc_id": index.counted.schema["chunks"].dataType.elementType["doc_id"].dataType}
    given = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items())
    hits = rows.groupBy("shard").applyInArrow(_shard_scores(top), f"{given}, chunk_index int, relevance double").withColumn("score", 1 / (1 + F.abs("relevance")))
    if top is None:
        return hits
    order = W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id", "chunk_index")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def above(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits at or above a score threshold; no threshold keeps all."""
    return hits if threshold is None else hits.where(F.col("score") >= threshold)


def search(index: TextIndex, queries: DataFrame, vectors: DataFrame | None, top: int = TOP_DEFAULT, threshold: float | None = None) -> DataFrame:
    """Vector search when an index and query vectors exist, else text search; rows query_id, item, rank, score.

    The best ``top`` of a query, of them those at or above the threshold; ``above`` over ``bm25`` or ``similarities`` without ``top`` gives all.
    """
    if vectors is not None and "embedding" in queries.columns:
        hits = vec.top_k(vectors, queries, max(1, top)).select("query_id", F.col("vec_id").cast("string").alias("item"), "rank", "score")
    else:
        found = bm25(index, queries, top)
        hits = found.select(F.col("query_id").cast("string").alias("query_id"), F.concat_ws(":", "doc_id", "chunk_index").alias("item"), "rank", "score")
    return above(hits, threshold)


def value_index(values: DataFrame) -> DataFrame:
    """Distinct values with their normal forms of two characters or more.

    They stay in as many slices as the session shuffles into: a value is short, but its pieces are many, so slices joined by their bytes would leave the lookups to few tasks.
    """
    norm = values.where("value is not null").select("table_name", "column_name", "value", normal_text(F.col("value")).alias("normal"))
    slices = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return norm.where(F.length("normal") >= 2).repartition(slices, *norm.columns).distinct()


def _pieces(text: str, n: int) -> Column:
    """The different pieces of ``n`` characters of a text; a shorter text is its own piece."""
    return F.array_distinct(tx.shingles(F.col(text), n))


def _rarest(holders: DataFrame, text: str, others: DataFrame) -> DataFrame:
    """Each different text of ``holders`` with the piece of it that fewest of the ``others`` hold (``piece, df``); texts with a piece that none of them holds fall out."""
    each = holders.select(text).distinct()
    # the first and the last piece rule most texts out before all pieces of a text are made
    for end in (F.substring(text, 1, 3), F.substring(text, -3, 3)):
        each = each.withColumn("_end", end).join(others.select(F.col("piece").alias("_end")), "_end", "left_semi").drop("_end")
    each = each.withColumn("pieces", _pieces(text, 3))
    each = each.select(text, F.size("pieces").alias("size"), F.explode("pieces").alias("piece"))
    kept = each.join(others, "piece").groupBy(text).agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"), F.count(F.lit(1)).alias("found"), F.first("size").alias("size"))
    return kept.where("found = size").select(text, "piece")


def lookup_values(index: DataFrame, literals: DataFrame, most: int | None = None) -> DataFrame:
    """Values behind literals: equal or one inside the other; when there is none, columns sharing two shingles or more,
    all of them or the ``most`` that share the most. Rows: literal, table_name, column_name, sample, match, shared.

    A text inside another shares all its shingles with it, so it meets only the texts that hold its rarest one, and those are compared in full; frequent shingles
    make no candidates. Texts of two characters are compared with the pieces of two characters. The shingles that a literal shares with a column's
    values are summed from the column's counts of each shingle, so that no literal meets single values for it.
    """
    lits = literals.select(F.col("literal"), normal_text(F.col("literal")).alias("lit")).where(F.length("lit") >= 2).distinct()
    lits = written(lits, "literals")
    held = index.select("table_name", "column_name", "value", "normal", F.explode(_pieces("normal", 3)).alias("piece"))
    asked = lits.select("literal", "lit", F.explode(_pieces("lit", 3)).alias("piece"))
    counts = cut_lineage(held.groupBy("table_name", "column_name", "piece").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("sample")))

    columns = ["literal", "lit", "table_name", "column_name", "value", "normal"]
    # literal inside value
    rare = _rarest(lits.where(F.length("lit") >= 3), "lit", counts.groupBy("piece").agg(F.sum("n").alias("df")))
    inside = rare.join(held, "piece").where(F.contains("normal", F.col("lit"))).join(lits, "lit").select(columns)
    # value inside literal
    rare = _rarest(index.where(F.length("normal") >= 3), "normal", asked.groupBy("piece").agg(F.count(F.lit(1)).alias("df")))
    around = rare.join(asked, "piece").where(F.contains("lit", F.col("normal"))).join(index, "normal").select(columns)
    # two characters on either side
    two = lits.where(F.length("lit") == 2)
    in_value = two.join(index.select("*", F.explode(_pieces("normal", 2)).alias("piece")), F.col("lit") == F.col("piece")).select(columns)
    in_lit = lits.withColumn("piece", F.explode(_pieces("lit", 2))).join(index.where(F.length("normal") == 2), F.col("piece") == F.col("normal")).select(columns)
    found = inside.unionByName(around).unionByName(in_value).unionByName(in_lit).distinct()
    exact = found.select("literal", "table_name", "column_name", F.col("value").alias("sample"), F.lit("exact").alias("match"), F.lit(None).cast("bigint").alias("shared"))
    exact = cut_lineage(exact)

    left = asked.join(exact.select("literal").distinct(), "literal", "left_anti")
    near = left.join(counts, "piece").groupBy("literal", "table_name", "column_name").agg(F.sum("n").alias("shared"), F.max("sample").alias("sample")).where("shared >= 2")
    if most is not None:
        order = W.partitionBy("literal").orderBy(F.col("shared").desc(), "table_name", "column_name")
        near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return exact.unionByName(near.select("literal", "table_name", "column_name", "sample", F.lit("near").alias("match"), "shared"))


def mention_spans(questions: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Quoted texts, Latin words and runs of ideographs of a question that may name a value; with ``most`` no more than so many, short ones first."""
    pick = lambda rx, g: F.regexp_extract_all(text, F.lit(rx), F.lit(g))
    every = F.concat(pick(r"[\"“']([^\"”']{2,40})[\"”']", 1), pick(r"([A-Za-z][A-Za-z0-9_./:-]{1,40})", 1), pick(r"([一-鿿]{2,6})", 1))
    spans = F.array_distinct(F.filter(F.transform(every, lambda s: F.trim(s)), lambda s: F.length(s) >= 2))
    rows = questions.select(key, F.posexplode(spans).alias("pos", "span"))
    if most is None:
        return rows.select(key, "span")
    size = F.length("span")
    group = F.when(size <= 4, 0).when(size <= 8, 1).otherwise(2)
    order = W.partitionBy(key).orderBy(group, size.desc(), "pos")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(key, "span")


def link_mentions(spans: DataFrame, key: str, index: DataFrame, columns: int = LINK_COLUMNS, most: int | None = None) -> DataFrame:
    """Spans with the columns they may mean: linked when there are at most two, else ambiguous. ``most``: near columns of a span."""
    spans = written(spans, "spans")  # texts are searched once
    literals = spans.select(F.col("span").alias("literal")).distinct()
    hits = lookup_values(index, literals, most)
    per_column = hits.groupBy("literal", "table_name", "column_name", "match").agg(F.min("sample").alias("sample"))
    counted = per_column.groupBy("literal").agg(F.count_distinct("table_name", "column_name").alias("n"))
    # a written table: Spark knows its size, so that spans of all questions stay where they are while it is small
    links = written(per_column.join(counted, "literal").withColumnRenamed("literal", "span"), "links")
    return spans.join(links, "span").select(key, "span", "table_name", "column_name", "sample", "match", F.when(F.col("n") <= columns, "linked").otherwise("ambiguous").alias("status"))


def _bounded(text: Column, term: str) -> Column:
    """Whether the term stands in the text with no letter, digit or underscore beside it.

    The pattern begins with the term, so that a search only stops where the term stands, and is only tried where it does.
    """
    return F.contains(text, F.lit(term)) & F.regexp_like(text, F.lit(rf"\Q{term}\E(?<![a-z0-9_]\Q{term}\E)(?![a-z0-9_])"))


def rank_pages(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Score of pages (id, type, title, body, status) for the words of one question; pages without a match are left out."""

    def points_of(page: Column) -> Column:
        title, body = page.getField("title"), page.getField("body")
        scores, whole_title = [], F.lit(False)
        for term in [w.lower() for w in terms]:
            ideographs = any("一" <= ch <= "鿿" for ch in term)
            points = 12 if len(term) >= 4 or ideographs else 8
            hit = (title == term) | _bounded(title, term) | _bounded(body, term)
            loose = F.contains(title, F.lit(term)) | F.contains(body, F.lit(term)) if ideographs else F.lit(False)
            scores.append(F.when(hit, points).when(loose, 4).otherwise(0))
            whole_title = whole_title | (title == term)
        return F.struct(sum(scores[1:], scores[0]).alias("m"), whole_title.alias("whole"))

    # each page is lowered and searched once: a generator is not copied into the filter on its result
    lowered = F.array(F.struct(F.lower("title").alias("title"), F.lower("body").alias("body")))
    scored = pages.select("id", "type", "status", F.explode(F.transform(lowered, points_of)).alias("_p")).where("_p.m > 0")
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in PAGE_WEIGHTS.items()], F.lit(0))
    bonus = F.when((F.col("type") == "table") & F.col("_p.whole"), 40).otherwise(0)
    return scored.select("id", "type", (F.col("_p.m") + bonus + weight - F.when(F.col("status") == "pending", 2).otherwise(0)).alias("score"))


def conversation_view(messages: DataFrame, conversation: str, position: str, role: str, text: str) -> DataFrame:
    """Messages in order, repeated texts of a conversation shown once at their first place."""
    digest = F.sha2(F.concat_ws("|", role, text), 256)
    first = messages.groupBy(conversation, digest.alias("digest")).agg(
        F.min_by(F.struct(position, role, text), F.col(position)).alias("m"), F.count(F.lit(1)).alias("copies")
    )
    rows = first.select(conversation, "m.*", "copies")
    return carried(rows, [conversation], [position], {"shown_at": ("count", position)})
