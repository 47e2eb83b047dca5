"""Short codes of vectors: each vector is cut into parts, and each part gets the number of its nearest codebook entry.

Vectors become whole numbers once, so that every distance is exact. Codebooks start from the smallest ids and are moved by rounds of assignment and
mean, each one Spark job: tasks keep the sums of their own entries, which are combined by entry; only codebooks reach the driver.

The nearest entry is found by LAESA: the distances of each part to a few fixed pivots are computed once and written with it. In a round the distances of
the pivots to all entries are computed, and the largest difference of two distances to a pivot is a lower bound of part to entry. The entries with
the smallest bounds are evaluated first; of the others only those whose bound does not exceed the best distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean, partitions, python_tasks, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Pivots of a part position, and entries that are evaluated before the bounds decide.
PIVOTS, FIRST = 8, 8
#: Whole numbers beyond this are set to it, so that sums of squares stay within 64 bits up to 4096 components a part.
LARGEST = 1 << 22
#: Parts that are looked at together.
CHUNK = 1024


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; where the width is no multiple, they differ by one."""
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, one by one."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def far_apart(entries: np.ndarray, most: int) -> np.ndarray:
    """Pivots: the first entry, then each time the entry that is farthest from those taken (the first of equals)."""
    taken = entries[:1]
    near = squared(entries, np.broadcast_to(taken[0], entries.shape))
    while len(taken) < most and near.max() > 0:
        new = entries[int(near.argmax())]
        taken = np.concatenate([taken, new[None]])
        near = np.minimum(near, squared(entries, np.broadcast_to(new, entries.shape)))
    return taken


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(squared(points, np.broadcast_to(p, points.shape)).astype(np.float64)) for p in pivots])


def nearest(points: np.ndarray, far: np.ndarray, entries: np.ndarray, entry_far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each point's nearest entry (ties: the lowest number), and how many distances were evaluated.

    ``far`` and ``entry_far`` are the distances of points and entries to the pivots.
    """
    which, best, evaluated = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), 0
    first = min(FIRST, len(entries))
    slack = 1e-6 + 1e-9 * max(far.max(initial=0.0), entry_far.max(initial=0.0))  # of rounding, above what bounds can be off
    for k in range(0, len(points), CHUNK):
        x, own = points[k : k + CHUNK], far[k : k + CHUNK]
        bound = np.zeros((len(x), len(entries)))
        for p in range(far.shape[1]):
            np.maximum(bound, np.abs(own[:, p, None] - entry_far[None, :, p]), out=bound)
        found = np.full(bound.shape, np.iinfo(np.int64).max)
        rows = np.arange(len(x))
        early = np.argpartition(bound, first - 1, axis=1)[:, :first]
        for c in range(first):
            found[rows, early[:, c]] = squared(x, entries[early[:, c]])
        least = np.sqrt(found.min(axis=1).astype(np.float64))
        open_ = bound <= least[:, None] + slack
        open_[rows[:, None], early] = False
        i, j = np.nonzero(open_)
        found[i, j] = squared(x[i], entries[j])
        evaluated += first * len(x) + len(i)
        which[k : k + CHUNK] = found.argmin(axis=1)
        best[k : k + CHUNK] = found[rows, which[k : k + CHUNK]]
    return which, best, evaluated


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


_PREPARED = "id long, label {label}, parts array<int>, far array<double>"


def _prepare(pivots: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("parts"), np.int64, width)
            far = np.column_stack([distances(x[:, a:b], p) for (a, b), p in zip(cuts(width, len(pivots)), pivots, strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "label", "parts", "far"])

    return run


def _assigned(batch: pa.RecordBatch, codebooks: list[np.ndarray], entry_far: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    x = _matrix(batch.column("parts"), np.int64, width)
    far = _matrix(batch.column("far"), np.float64, sum(e.shape[1] for e in entry_far))
    at = 0
    for k, (a, b) in enumerate(cuts(width, len(codebooks))):
        n = entry_far[k].shape[1]
        which, best, _ = nearest(x[:, a:b], far[:, at : at + n], codebooks[k], entry_far[k])
        at += n
        yield k, x[:, a:b], which, best


_SUMS = "part int, entry int, n long, sums array<long>"


def _sum_up(codebooks: list[np.ndarray], pivots: list[np.ndarray], width: int):
    """One row for each entry that a task's parts are nearest to: how many, and their sums."""
    entry_far = [distances(c, p) for c, p in zip(codebooks, pivots, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, np.int64) for c in codebooks]
        for batch in batches:
            for k, x, which, _ in _assigned(batch, codebooks, entry_far, width):
                counts[k] += np.bincount(which, minlength=len(counts[k]))
                np.add.at(sums[k], which, x)
        for k in range(len(codebooks)):
            used = np.flatnonzero(counts[k])
            wide = sums[k].shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * wide, pa.int32()), pa.array(sums[k][used].ravel()))
            columns = [pa.array(np.full(len(used), k, np.int32)), pa.array(used, pa.int32()), pa.array(counts[k][used]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return run


def _code(codebooks: list[np.ndarray], pivots: list[np.ndarray], width: int):
    entry_far = [distances(c, p) for c, p in zip(codebooks, pivots, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = np.zeros((batch.num_rows, len(codebooks)), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for k, _, which, best in _assigned(batch, codebooks, entry_far, width):
                digits[:, k] = which
                error += best
            codes = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def moved(prepared: DataFrame, codebooks: list[np.ndarray], pivots: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the mean, rounded down, of the parts nearest to it; unused entries stay."""
    each = prepared.mapInArrow(lean(_sum_up(codebooks, pivots, width)), _SUMS).select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    total = each.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n"))
    new = [c.copy() for c in codebooks]
    for r in total.toLocalIterator():  # one row a component of a codebook
        new[r.part][r.entry, r.place] = int(r.value) // r.n
    return new


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all whole numbers of the codebooks, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray], int] | None:
    """Prepared vectors (written), codebooks, pivots and the width, from ``id, vector, label``; None where no vector is kept. See ``encode``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code digit holds 1 to 256 entries")
    spark = vectors.sparkSession
    python_tasks(spark)
    finite = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(SCALE * x.cast("double")))).cast("int"))
    kept = vectors.where(finite).select("id", "label", whole.alias("parts"))
    head = kept.orderBy(F.col("id").asc_nulls_last(), "parts").limit(1).collect()
    if not head:
        return None
    width = len(head[0].parts)
    kept = kept.where(F.size("parts") == width)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).collect()  # at most 256 rows
    start = np.array([r.parts for r in seeds], np.int64).reshape(len(seeds), width)
    codebooks = [start[:, a:b] for a, b in cuts(width, parts)]
    pivots = [far_apart(c, PIVOTS) for c in codebooks]
    schema = _PREPARED.format(label=kept.schema["label"].dataType.simpleString())
    prepared = written(kept.mapInArrow(lean(_prepare(pivots, width)), schema), "vector-parts")
    for _ in range(rounds):
        codebooks = moved(prepared, codebooks, pivots, width)
    return prepared, codebooks, pivots, width


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` of the vectors (``id, vector, label``; other columns are not read).

    Vectors that are null or hold null, NaN or infinite components are left out, and so are those of another length than the vector of the smallest
    id. An id that repeats counts each time; among equal ids the smaller vector comes first, a null id comes last. With fewer vectors than entries the
    codebooks are as short. An empty vector has parts without components: code zero, error zero. ``label_error`` sums the errors of equal labels, null
    being one of them. Components beyond ±4096 count as that. Empty table, or no vector kept: no rows.
    """
    label = vectors.schema["label"].dataType.simpleString()
    done = fit(vectors, parts, entries, rounds)
    if done is None:
        return vectors.sparkSession.createDataFrame([], f"id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    prepared, codebooks, pivots, width = done
    coded = prepared.select("id", "label", "parts", "far").mapInArrow(lean(_code(codebooks, pivots, width)), f"id long, label {label}, code string, error long")
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(partitions(vectors.sparkSession))).cast("int")  # a label may be all rows
    coded = written(coded.withColumn("salt", salt), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label"), F.col("salt").alias("_salt")).agg(F.sum("error").alias("sum"))
    sums = sums.select("_label", "_salt", F.sum("sum").over(W.partitionBy("_label")).alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return out.select("id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
