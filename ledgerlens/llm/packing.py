"""Best-fit packing of documents into sequences, with conflicts.

Two documents conflict when they come from one source or belong to one cluster of duplicates. Documents are dealt at random
over shards of about ``SHARD_ROWS`` rows, so a source or cluster with a third of all rows fills no shard alone, and each shard
is packed by itself: documents in descending size, bins in the order of the room they have left, each with a bitmap of its
sources and one of its clusters. The search starts at the smallest room that is enough and goes on to the next bin until one
has no conflict: the tightest compatible bin. Where there is none, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import n_words, python_tasks

CAPACITY = 2048
SHARD_ROWS = 2048

PLACED = "shard long, bin long, slot int, doc_id long, piece long, start long, length long, bin_start long, source string, cluster string"


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int) -> Iterator[tuple[int, int, int]]:
    """Bin, slot and place in the bin for each (size, source, cluster), in the given order; sources and clusters are small numbers."""
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    slots: list[int] = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & s or clusters[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            slots.append(0)
        sources[number] |= s
        clusters[number] |= c
        slots[number] += 1
        insort(rooms, (room - size, number))
        yield number, slots[number] - 1, capacity - room


def _pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["rest", "size", "doc_id", "cluster"], ascending=[False, False, True, True], kind="stable", na_position="first")
    numbers = [pd.factorize(rows[c], use_na_sentinel=False)[0].tolist() for c in ("source", "cluster")]
    out, used = [], 0
    shard = int(rows["shard"].iloc[0]) if len(rows) else 0
    packed = [k for k, rest in enumerate(rows["rest"].tolist()) if rest]
    sizes = rows["rest"].tolist()
    places = best_fit(((sizes[k], numbers[0][k], numbers[1][k]) for k in packed), capacity)
    own = list(zip(*(rows[c].tolist() for c in ("doc_id", "size", "source", "cluster")), strict=True))
    for k, (number, slot, at) in zip(packed, places, strict=True):
        doc_id, size, source, cluster = own[k]
        used = max(used, number + 1)
        out.append((shard, number, slot, doc_id, size // capacity, size - sizes[k], sizes[k], at, source, cluster))
    for doc_id, size, source, cluster in own:
        for piece in range(int(size) // capacity):  # full pieces of long texts: a bin each
            out.append((shard, used, 0, doc_id, piece, piece * capacity, capacity, 0, source, cluster))
            used += 1
        if not size:
            out.append((shard, None, None, doc_id, 0, 0, 0, None, source, cluster))
    out = pd.DataFrame(out, columns=["shard", "bin", "slot", "doc_id", "piece", "start", "length", "bin_start", "source", "cluster"])
    return out.astype({c: "Int64" for c in ("bin", "slot", "doc_id", "bin_start")})


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Places of all rows of ``doc_id, size, source, cluster``: shard, bin (within the shard), slot, piece, start and length in the text, place in the bin.

    A text longer than ``capacity`` gives full pieces with a bin each, and its rest is packed. Size 0 (null or empty text) has no bin: one row with null
    bin. A null source or cluster is a source or cluster like any other. Repeated rows are packed as rows of one cluster, in bins apart.
    Empty table: no rows.
    """
    python_tasks(rows.sparkSession)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.select(
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("size").cast("long").alias("size"),
        (F.col("size") % capacity).cast("long").alias("rest"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("string").alias("cluster"),
    )
    return rows.groupBy("shard").applyInPandas(lambda one: _pack_shard(one, capacity), PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pack`` over documents: sizes in words; the cluster is the digest of the text in lower case with white space made even."""
    even = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select("doc_id", n_words(F.col("text")).alias("size"), "source", F.md5(even).alias("cluster"))
    return pack(rows, capacity, shard_rows)
