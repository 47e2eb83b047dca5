"""Passages that repeat across documents, by prefix-partitioned suffix trees.

The suffixes at question are all windows of ``WIDTH`` words. Among the ``GRAM``-word spans inside a window the one with the smallest hash is
the window's key: equal windows have equal keys. Keys that stand in one document only are counted out first, combined
before the shuffle; what is left is a small part of the corpus. Suffixes are dealt by their keys into groups, and a task
takes as many groups as fit its memory and builds their suffix tree, cut at depth ``WIDTH``, level by level: the nodes at depth
2k are the sorted pairs of nodes at depth k, so equal words, never hashes of longer spans, decide. The internal nodes at full
depth are the repeats; the smallest document below a node keeps the passage.

A key with ``HOT`` places and more would be a group beyond memory. Its prefix is lengthened to the whole window: the windows themselves, as 126-bit hashes,
are combined before the shuffle to the smallest document of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Powers, partitions, python_tasks, running, slices, spans, split_words, string_buffers, word_spans, written

WIDTH = 50
GRAM = 12
HOT = 20_000
TREE_WORDS = 300_000

_SECOND = Powers(0xA24BAED4963EE407)
NO_ID = -(2**63)  # stands for a null doc_id: smaller than all


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each window."""
    at, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = at[:-size], at[size:]
        at, size = np.where(values[b] < values[a], b, a), 2 * size
    if size < width:
        a, b = at[: size - width], at[width - size :]
        at = np.where(values[b] < values[a], b, a)
    return at


def keyed_windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, their keys and their texts."""
    gram = min(GRAM, width)
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none
    grams = word_spans(hashes, gram)
    at = _smallest(grams, width - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: len(at)] == text[width - 1 :])
    return starts, grams[at[starts]], text[starts]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of runs in which no column changes and starts (the first column) go up by one."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.diff(columns[0]) != 1
    for c in columns[1:]:
        new |= c[1:] != c[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first, np.concatenate([first[1:], [len(columns[0])]]) - 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch.column("text"))
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _places(width: int):
    """A row for each run of windows with one key: the key and the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch):
                _, _, hashes, first = split_words(data, offsets)
                starts, keys, text = keyed_windows(hashes, first, width)
                at, _ = _runs(starts, keys, text)
                ids = batch.column("id").to_numpy()[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(ids[text[at]])], names=["key", "id"])

    return run


def _wanted(batch: pa.RecordBatch, a: int, b: int, keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which windows have a key that is listed for their text."""
    lists = batch.column("keys").slice(a, b - a)
    listed = lists.flatten().to_numpy().view(np.uint64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros(len(keys), bool)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.searchsorted(text, np.arange(b - a + 1))
    for k in range(b - a):
        if sizes[k] and edges[k] < edges[k + 1]:
            out[edges[k] : edges[k + 1]] = np.isin(keys[edges[k] : edges[k + 1]], listed[bounds[k] : bounds[k + 1]])
    return out


def _segments(width: int):
    """The words of each run of windows with one listed key: a node's suffixes, beside one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch):
                begins, ends, hashes, first = split_words(data, offsets)
                starts, keys, text = keyed_windows(hashes, first, width)
                keep = _wanted(batch, a, b, keys, text)
                starts, keys, text = starts[keep], keys[keep], text[keep]
                at, last = _runs(starts, keys, text)
                raw = data.tobytes()
                words = [b" ".join(raw[x:y].split()) for x, y in zip(begins[starts[at]].tolist(), ends[starts[last] + width - 1].tolist(), strict=True)]
                columns = [batch.column(c).to_numpy()[a:b][text[at]] for c in ("id", "hash")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), *map(pa.array, columns), pa.array(starts[at] - first[text[at]], pa.int64()), pa.array(words, pa.binary())],
                    names=["key", "id", "hash", "start", "words"],
                )

    return run


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-keeping numbers of pairs of such numbers."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


def tree_nodes(words: np.ndarray, width: int) -> np.ndarray:
    """The node at depth ``width`` of the suffix from each word on (as far as one stands there), level by level."""
    nodes, depth = np.unique(words, return_inverse=True)[1], 1
    while 2 * depth <= width:
        nodes, depth = _named(nodes[:-depth], nodes[depth:]), 2 * depth
    return nodes if depth == width else _named(nodes[: depth - width], nodes[width - depth :])


def earlier(rows: dict[str, list], width: int) -> list[tuple[int, int, int, int]]:
    """(id, hash, first word, word after the last) of passages whose words also stand in a document with a smaller id."""
    joined = pa.array(rows["words"], pa.binary()).cast(pa.string())
    data, offsets = string_buffers(joined)
    _, _, hashes, first = split_words(data, offsets)
    if len(hashes) < width:
        return []
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    nodes = tree_nodes(hashes, width)
    inside = np.flatnonzero(segment[: len(nodes)] == segment[width - 1 :])
    ids = np.array(rows["id"], np.int64)[segment[inside]]
    least = np.full(int(nodes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, nodes[inside], ids)
    later = inside[least[nodes[inside]] < ids]
    at, last = _runs(later, segment[later])
    out = []
    for x, y in zip(later[at].tolist(), later[last].tolist(), strict=True):
        k = segment[x]
        begin = rows["start"][k] + x - first[k]
        out.append((rows["id"][k], rows["hash"][k], int(begin), int(begin + y - x + width)))
    return out


_RANGES = "id long, hash long, begin long, end long"


def _range_batch(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "hash", "begin", "end"])


def _trees(width: int):
    """Whole groups, sorted by key, until they hold ``TREE_WORDS``: one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "hash", "start", "words"]
        held: dict[str, list] = {c: [] for c in names}
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held["key"] and held["key"][-1] != row[0] and size > TREE_WORDS:
                    yield _range_batch(earlier(held, width))
                    held, size = {c: [] for c in names}, 0
                for c, x in zip(names, row, strict=True):
                    held[c].append(x)
                size += row[-1].count(b" ") + 1
        if held["key"]:
            yield _range_batch(earlier(held, width))

    return run


def _hot_windows(width: int):
    """A row for each run of equal windows with a hot key: hashes of the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch):
                _, _, hashes, first = split_words(data, offsets)
                starts, keys, text = keyed_windows(hashes, first, width)
                keep = _wanted(batch, a, b, keys, text)
                starts, text = starts[keep], text[keep]
                one = word_spans(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
                two = spans(running(hashes, _SECOND), starts, starts + width, _SECOND) if len(starts) else one
                at, last = _runs(starts, one, text)
                columns = [batch.column(c).to_numpy()[a:b][text[at]] for c in ("id", "hash")]
                begin = starts[at] - first[text[at]]
                arrays = [one[at].view(np.int64), two[at].view(np.int64), *columns, begin, begin + last - at + width]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["one", "two", "id", "hash", "begin", "end"])

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """``id, hash, ranges``: word ranges [begin, end) of each text that a document with a smaller id has too.

    ``docs`` has ``id, hash, text`` without nulls in the first two.
    """
    spark = docs.sparkSession
    places = written(docs.select("id", "text").mapInArrow(_places(width), "key long, id long"), "substring-places")
    common = places.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    common = common.select("key", (F.col("n") >= hot).alias("hot"))
    listed = places.join(common, "key")
    per_doc = listed.groupBy(F.col("id").alias("_id")).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("cold_keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys")
    )
    per_doc = written(per_doc, "substring-keys")  # keys of a document's own windows
    likely = docs.join(per_doc, F.col("id") == F.col("_id"))
    cold = likely.where(F.size("cold_keys") > 0).select("id", "hash", "text", F.col("cold_keys").alias("keys"))
    segments = cold.mapInArrow(_segments(width), "key long, id long, hash long, start long, words binary")
    groups = segments.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = groups.mapInArrow(_trees(width), _RANGES)
    warm = likely.where(F.size("hot_keys") > 0).select("id", "hash", "text", F.col("hot_keys").alias("keys"))
    windows = written(warm.mapInArrow(_hot_windows(width), "one long, two long, id long, hash long, begin long, end long"), "substring-hot")
    least = windows.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    later = windows.join(least, ["one", "two"]).where("least < id").select("id", "hash", "begin", "end")
    ranges = found.unionByName(later).groupBy("id", "hash").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    return ranges


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, gone = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            words = text.encode().split()
            total.append(len(words))
            if ranges:
                keep = np.ones(len(words), bool)
                for r in ranges:
                    keep[r["begin"] : r["end"]] = False
                words = [words[k] for k in np.flatnonzero(keep).tolist()]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def dedup_passages(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` freed of passages that a smaller doc_id has too: ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (kept words joined by one space).

    Null counts as the empty text; texts of fewer than ``width`` words lose nothing. A null doc_id is the smallest. Rows with one doc_id are
    one document: they take nothing from each other. Windows are judged on the input. Empty table: no rows. Only doc_id and text are read.
    """
    python_tasks(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )
    ranges = repeated_ranges(rows.select("id", "hash", "text"), width, hot).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "ranges")
    joined = rows.join(ranges, (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
