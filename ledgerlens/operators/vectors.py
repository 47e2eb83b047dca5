"""Vector search and similar pairs: Spark spreads vectors, numpy multiplies them inside a task."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

MAX_QUERY_BYTES = 64 * 1024 * 1024
#: Vectors at home in one task, and visitors (a share of all vectors) that one task sees.
BLOCK_ROWS, VISITORS = 4096, 1 << 20
#: Pivots: so many at least where there are vectors, so many at most; those of them that every cell's distance range is kept for.
LEAST_PIVOTS, MOST_PIVOTS, REFERENCES = 16, 1024, 16
#: Rows of one batch of visitors.
VISIT_ROWS = 4096

# functions of this module travel to the workers as they are, so that a worker needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SEARCH_MIN = 0.35
MERGE_MIN = 0.75


def _matrix(column) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def similarities(vectors: DataFrame, queries: DataFrame, threshold: float | None = None, k: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Vectors at or above a threshold per query, all of them unless ``k`` bounds those of a batch: rows (query_id, vec_id, score).

    ``vectors(vec_id, embedding)`` are read once and never shuffled: each batch is multiplied with the query matrix and only hits leave it. With ``types`` only vectors
    whose column ``type`` is one of them are read. The query side must fit its size bound; larger query sets go through in several calls.
    """
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    size = rows.agg(F.sum(F.size("e")).alias("n")).first().n or 0
    if size * 8 > MAX_QUERY_BYTES:
        raise ValueError("query vectors exceed the size bound of one call; split them by query id")
    asked = rows.toPandas()
    ids, wanted = asked["query_id"].to_numpy(), _unit(_matrix(asked["e"]))
    low = -np.inf if threshold is None else threshold

    def score(batches):
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["embedding"])
            if m.shape[1] != wanted.shape[1]:
                raise ValueError("vectors differ in length")
            known = batch["vec_id"].to_numpy()
            sims = np.round(_unit(m) @ wanted.T, 9)
            row, query = np.nonzero(sims >= low)
            if k is not None:  # the first k of each query in this batch
                order = np.lexsort((known[row], -sims[row, query], query))
                row, query = row[order], query[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                row, query = row[place < k], query[place < k]
            yield pd.DataFrame({"query_id": ids[query], "vec_id": known[row], "score": sims[row, query]})

    read = vectors if types is None else vectors.where(F.col("type").isin(*types))
    return read.select("vec_id", "embedding").mapInPandas(score, "query_id string, vec_id bigint, score double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` most similar vectors per query: rows (query_id, rank, vec_id, score); a batch sends on at most ``k`` rows per query."""
    partial = similarities(vectors, queries, threshold, k)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit_batch(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    width = len(lists[0]) if len(lists) else 0
    if len(lists.flatten()) != width * len(lists):
        raise ValueError("vectors differ in length")
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * points @ pivots.T))


@dataclass(frozen=True)
class Cells:
    """Unit vectors dealt to their nearest pivot, with what bounds the distance of a vector to all vectors of a cell."""

    pivots: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    #: Least and greatest distance of each cell's vectors to the first ``REFERENCES`` pivots.
    low: np.ndarray
    high: np.ndarray

    def visits(self, points: np.ndarray, home: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Which points may have a vector within ``reach`` in which other cells. Of two cells the smaller one's vectors visit the larger."""
        far = _distances(points, self.pivots)
        own = far[np.arange(len(points)), home]
        bound = far - self.radius
        # vectors of a cell are no nearer to another pivot than to their own: the distance to the plane between the two
        between = _distances(self.pivots, self.pivots)[home]
        plane = np.divide(far**2 - own[:, None] ** 2, 2 * between, out=np.zeros_like(far), where=between > 0)
        np.maximum(bound, plane, out=bound)
        for q in range(self.low.shape[1]):
            np.maximum(bound, np.maximum(far[:, q, None] - self.high[:, q], self.low[:, q] - far[:, q, None]), out=bound)
        rank = np.empty(len(self.size), np.int64)
        rank[np.lexsort((np.arange(len(self.size)), self.size))] = np.arange(len(self.size))
        return np.nonzero((bound <= reach + 1e-6) & (rank[home][:, None] < rank[None, :]) & (self.size > 0))


def _dealt(found: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, Cells]:
    references = pivots[:REFERENCES]

    def assign(batches):
        for batch in batches:
            x = _unit_batch(batch, "embedding")
            far = _distances(x, pivots)
            home = far.argmin(axis=1)
            names, columns = ["vec_id", "embedding", "cell", "own"], [*batch.columns, pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(x)), home])]
            for q in range(len(references)):
                names.append(f"r{q}")
                columns.append(pa.array(far[:, q]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(["vec_id bigint, embedding array<double>, cell int, own double", *[f"r{q} double" for q in range(len(references))]])
    dealt = cut_lineage(found.mapInArrow(assign, fields))
    ranges = [f(f"r{q}").alias(f"{name}{q}") for q in range(len(references)) for f, name in ((F.min, "low"), (F.max, "high"))]
    seen = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("radius"), *ranges).collect()  # a row a pivot
    k = len(pivots)
    size, radius = np.zeros(k, np.int64), np.zeros(k)
    low, high = np.zeros((k, len(references))), np.zeros((k, len(references)))
    for r in seen:
        size[r.cell], radius[r.cell] = r.n, r.radius
        for q in range(len(references)):
            low[r.cell, q], high[r.cell, q] = r[f"low{q}"], r[f"high{q}"]
    return dealt.select("vec_id", "embedding", "cell"), Cells(pivots, size, radius, low, high)


def _visiting(cells: Cells, reach: float, block_rows: int, parts: int):
    """A row for each block that a vector is needed in: at home (side 0), or as a visitor of another cell or of a later block of its own."""
    blocks = np.maximum(1, -(-cells.size // block_rows))

    def run(batches):
        for batch in batches:
            x, ids = _unit_batch(batch, "embedding"), batch.column("vec_id").to_numpy()
            home = batch.column("cell").to_numpy().astype(np.int64)
            spread = (ids * -7046029254386353131).view(np.uint64) >> np.uint64(33)  # an odd factor, wrapped
            block = (spread % blocks[home].astype(np.uint64)).astype(np.int64)
            part = (spread // np.uint64(64) % np.uint64(parts)).astype(np.int64)
            i, j = cells.visits(x, home, reach)
            every = np.arange(len(x))
            # at home in all parts, as a visitor in one
            rows = [(np.repeat(every, parts), np.repeat(home, parts), np.repeat(block, parts), np.tile(np.arange(parts), len(x)), np.zeros(len(x) * parts, np.int64))]
            n = blocks[j]
            rows.append((np.repeat(i, n), np.repeat(j, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(part[i], n), np.ones(n.sum(), np.int64)))
            n = blocks[home] - block - 1  # later blocks of the own cell
            rows.append((np.repeat(every, n), np.repeat(home, n), np.repeat(block, n) + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(part, n), np.ones(n.sum(), np.int64)))
            who, *where = (np.concatenate(c) for c in zip(*rows, strict=True))
            for at in range(0, len(who), VISIT_ROWS):
                piece = slice(at, at + VISIT_ROWS)
                columns = [*(pa.array(c[piece], pa.int32()) for c in where), batch.column("vec_id").take(pa.array(who[piece])), batch.column("embedding").take(pa.array(who[piece]))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "block", "part", "side", "vec_id", "embedding"])

    return run


def _meet(minimum: float):
    """Rows sorted by cell, block, part and side: the vectors at home are held, visitors stream past them; only pairs at or above the minimum leave."""

    def out(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(s)], names=["a", "b", "similarity"])

    def run(batches):
        key, ids, held, within = None, [], [], False

        def hits(rows: np.ndarray, who: np.ndarray, same: bool):
            home, home_ids = np.concatenate(held), np.concatenate(ids)
            for at in range(0, len(rows), 512):
                sims = rows[at : at + 512] @ home.T
                i, j = np.nonzero(sims >= minimum)
                x, y, s = who[at + i], home_ids[j], sims[i, j]
                keep = x < y if same else x != y
                yield out(x[keep], y[keep], s[keep])

        for batch in batches:
            x, who = _unit_batch(batch, "embedding"), batch.column("vec_id").to_numpy()
            place = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "block", "part", "side")])
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)])) if len(place) else np.zeros(0, np.int64)
            for a, b in zip(starts, [*starts[1:], len(place)], strict=True):
                group, side = tuple(place[a][:3]), place[a][3]
                if group != key:
                    if within:
                        yield from hits(np.concatenate(held), np.concatenate(ids), True)
                    key, ids, held, within = group, [], [], False
                if side == 0:
                    held.append(x[a:b])
                    ids.append(who[a:b])
                    within = group[2] == 0  # pairs at home once, in the first part
                elif held:
                    yield from hits(x[a:b], who[a:b], False)
        if within:
            yield from hits(np.concatenate(held), np.concatenate(ids), True)

    return run


def similar_pairs(vectors: DataFrame, minimum: float = MERGE_MIN, block_rows: int = BLOCK_ROWS, visitors: int = VISITORS) -> DataFrame:
    """All pairs (a < b) with cosine similarity of at least ``minimum`` (above 0), exactly: rows (a, b, similarity).

    On unit vectors similarity is Euclidean distance, so pivots bound it. Each vector lives in the cell of its nearest pivot. It is sent to
    another cell only when no bound rules a partner out there: the cell's radius, the plane between the two pivots, and the least and greatest distances of the cell's
    vectors to reference pivots. Of two cells only the smaller one's vectors travel. A task holds ``block_rows`` vectors of a cell
    and streams the visitors past them, ``visitors`` of all vectors' share at most a part. Equal vectors are one vector until pairs are known, so that a common vector
    fills no cell. Null vectors and those without length have no partner. Vectors of different lengths are refused.
    """
    if not 0 < minimum <= 1:
        raise ValueError("the minimum lies above 0 and at most at 1")
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    known = cut_lineage(rows.withColumn("rep", F.xxhash64("embedding")))
    # equal by value; the hash only deals them
    reps = cut_lineage(known.groupBy("rep", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")))
    n = reps.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint, similarity double")
    wanted = min(MOST_PIVOTS, max(min(n, LEAST_PIVOTS), math.ceil(n / block_rows)))
    chosen = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").collect()  # at most MOST_PIVOTS rows
    dealt, cells = _dealt(reps.select("vec_id", "embedding"), _unit(np.array([r.embedding for r in chosen])))
    reach, parts = math.sqrt(max(0.0, 2.0 - 2.0 * minimum)), max(1, math.ceil(n / visitors))
    sent = dealt.mapInArrow(_visiting(cells, reach, block_rows, parts), "cell int, block int, part int, side int, vec_id bigint, embedding array<double>")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(tasks, "cell", "block", "part").sortWithinPartitions("cell", "block", "part", "side")
    pairs = sent.mapInArrow(_meet(minimum), "a bigint, b bigint, similarity double")
    if reps.where("n > 1").isEmpty():
        return pairs
    return _with_copies(cut_lineage(pairs), known, reps)


def _with_copies(pairs: DataFrame, known: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of single vectors from pairs of different ones: each with all its equal ones, and the equal ones with each other."""
    several = reps.where("n > 1").select("rep", "embedding", F.col("vec_id").alias("_first"))
    member = known.join(several, ["rep", "embedding"]).select("_first", F.col("vec_id").alias("_own"))
    member = cut_lineage(member)

    def spread(df: DataFrame, side: str) -> DataFrame:
        own = df.join(member, F.col(side) == F.col("_first"), "left")
        return own.withColumn(side, F.coalesce("_own", side)).drop("_first", "_own")

    apart = spread(spread(pairs, "a"), "b")
    same = member.join(member.withColumnRenamed("_own", "_other"), "_first").where("_own < _other")
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return apart.unionByName(same.select(F.col("_own").alias("a"), F.col("_other").alias("b"), F.lit(1.0).alias("similarity")))
