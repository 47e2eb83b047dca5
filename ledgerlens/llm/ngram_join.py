"""Near duplicates by a blocked sparse product of documents and n-grams.

The incidence matrix has a row for each different set of shingles (equal sets are one row) and a column for each shingle. Two rows link when
their overlap reaches the threshold of their union. Only pairs that can reach it are looked at: by size, a row of n shingles meets rows of
``least(n)`` shingles and more; and two linked rows must share one of their rarest n - least(n) + 1 shingles, in an order that
puts frequent shingles last. These short rows are exploded and dealt by column.

Overlap counts come from a product in blocks. In each column each row is multiplied with the head of its size class
first. That gives a few pairs a row, never all pairs of a column, and joins copies of a group into one component. Rows of
a column that are still in different components are multiplied block by block (``BLOCK`` rows a side), so that no link is lost. In a block the
overlaps are accumulated over whole shingle sets and only linked pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import SMALL_SLICE, lean, mixed, partitions, python_tasks, slices, split_words, string_buffers, written

WORDS = 5
SIMILARITY = (80, 100)
BLOCK = 512
#: Rows of a column from which on parities are compared before pairs are made.
CROWD = 16
#: Turns in which crowded columns are joined by stars.
TURNS = 3
#: Shingles that stand last in the order of rarity: so many at most, the most frequent ones found.
FREQUENT = 1 << 17
#: Shingles of a task whose counts are kept while it counts.
COUNTERS = 1 << 18
#: Shingles that wait in a task to be counted together.
WAITING = 1 << 18
#: Pairs that a task multiplies at least.
PAIRS = 2_000
#: Parts that a frequent column is dealt over, logarithm of a size class's width, and keys of a task that are remembered.
SALTS, CLASS, SEEN = 64, np.log(1.25), 1_000_000

_WORD_KEYS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_size(n: np.ndarray) -> np.ndarray:
    """Smallest size of a set that can link with one of n: also the least overlap of the two."""
    return -(-n * SIMILARITY[0] // SIMILARITY[1])


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SIMILARITY[1] * both >= SIMILARITY[0] * (a + b - both)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of each text's different shingles, text after text, and where each text's begin."""
    _, _, hashes, first = split_words(_lower(data), offsets)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    every = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        every += mixed(hashes[k : k + len(every)] + np.uint64(k)) * _WORD_KEYS[k]
    every = mixed(every)
    inside = text[: len(every)] == text[words - 1 :] if len(every) else np.zeros(0, bool)
    values, owner = every[inside], text[: len(every)][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))  # the whole text is one shingle
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            extra[has] += mixed(hashes[first[:-1][short][has] + k] + np.uint64(k)) * _WORD_KEYS[k]
        values = np.concatenate([values, mixed(extra + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, sizes included: sums of its mixed members."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(0x5851F42D4C957F2D)))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(0x14057B7EF767814F)))])
    n = np.diff(bounds).astype(np.uint64)
    a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in (sums, other))
    return mixed(mixed(a + n) ^ b)


def parity_bits(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Parities of each set, as many as the power of two from its size on: a bit that differs between two sets stands for a member that only one of them has."""
    n = np.diff(bounds)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(width)])
    bit = (mixed(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(np.repeat(at[:-1], n) + bit, minlength=at[-1]) & 1).astype(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd))])


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities (64-bit numbers) folded to fewer: the parities that a narrower table of the same members has."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def near_enough(bits: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (places in the lists) differ in so few parities that they may link; no linked pair is lost."""
    widths = np.array([len(x) // 8 for x in bits], np.int64)
    tables = {w: np.frombuffer(b"".join(x for x in bits if len(x) == 8 * w), np.uint64).reshape(-1, w) for w in set(widths.tolist())}
    place = np.zeros(len(bits), np.int64)
    for w in tables:
        place[widths == w] = np.arange(np.count_nonzero(widths == w))
    part, whole = SIMILARITY
    out = np.zeros(len(a), bool)
    for x in tables:
        for y in tables:
            own = np.flatnonzero((widths[a] == x) & (widths[b] == y))
            w = min(x, y)
            left, right = fold(tables[x], w), fold(tables[y], w)
            for k in range(0, len(own), max(1, (1 << 20) // w)):
                o = own[k : k + max(1, (1 << 20) // w)]
                apart = np.bitwise_count(left[place[a[o]]] ^ right[place[b[o]]]).sum(axis=1, dtype=np.int64)
                out[o] = apart * (whole + part) <= (n[a[o]] + n[b[o]]) * (whole - part)
    return out


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch.column("text"))
    for a, b in slices(offsets, SMALL_SLICE):
        values, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, values, bounds


_FIRST = "kind int, id long, value long, n long, bits binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: id, key, size and parities of each document's set. Kind 1: the task's frequent shingles, with counts too low by what was taken off all counters at once."""
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out(kind: int, ids: pa.Array, values: np.ndarray, n: np.ndarray, bits: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(values), kind, np.int32)), ids, pa.array(values.view(np.int64)), pa.array(n, pa.int64()), bits]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "value", "n", "bits"])

    def count() -> None:
        nonlocal known, counts
        new, n = np.unique(np.concatenate(waiting), return_counts=True)
        new, n = new[n > 1], n[n > 1]  # a shingle that is frequent stands in several of the texts that wait
        known, back = np.unique(np.concatenate([known, new]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64) if len(known) else counts
        if len(known) > COUNTERS:
            counts = counts - np.partition(counts, len(counts) - COUNTERS)[len(counts) - COUNTERS]
            known, counts = known[counts > 0], counts[counts > 0]
        waiting.clear()

    waiting: list[np.ndarray] = []
    for batch in batches:
        for a, b, values, bounds in _sets(batch):
            yield out(0, batch.column("id").slice(a, b - a), set_keys(values, bounds), np.diff(bounds), parity_bits(values, bounds))
            waiting.append(values)
            if sum(map(len, waiting)) >= WAITING:
                count()
    if waiting:
        count()
    yield out(1, pa.nulls(len(known), pa.int64()), known, counts, pa.nulls(len(known), pa.binary()))


_RARE = "shingle long, salt int, row long, n int, rank int"
_RARE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def _rare_parts(frequent: np.ndarray):
    """A row for each column that a set must share one of with a linked set: shingle, salt (frequent ones only), row, size and place in the order of rarity."""
    order = np.argsort(frequent)
    ranked = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # equal sets of one task are given once
        for batch in batches:
            for _, _, values, bounds in _sets(batch):
                sizes = np.diff(bounds)
                keys = set_keys(values, bounds)
                length = np.where(sizes > 0, sizes - least_size(sizes) + 1, 0)
                for k, key in enumerate(keys.tolist()):
                    if key in done:
                        length[k] = 0
                    done.add(key)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.zeros(len(values), np.int64)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
                    place = np.where(ranked[at] == values, order[at] + 1, 0)
                few = np.lexsort((values, place, owner))
                rank = np.arange(len(values)) - bounds[:-1][owner]
                few, rank = few[rank < length[owner]], rank[rank < length[owner]]
                row, n = keys[owner[few]], sizes[owner[few]]
                salt = np.where(place[few] > 0, (mixed(row) % np.uint64(SALTS)).astype(np.int64), -1)
                columns = [values[few].view(np.int64), salt, row.view(np.int64), n, rank]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _RARE_TYPES, strict=True)], names=["shingle", "salt", "row", "n", "rank"])
                if len(done) > SEEN:
                    done = set()

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, values, bounds in _sets(batch):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, bounds).view(np.int64)), lists], names=["row", "members"])


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by head and block, the head's own row first: overlaps of the block's rows with the head; linked pairs leave."""
    head, own = None, None
    for batch in batches:
        a, b = [], []
        heads, rows, blocks = (batch.column(c).to_numpy() for c in ("head", "row", "block"))
        lists = batch.column("members")
        values, bounds = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        for k in range(len(rows)):
            members = values[bounds[k] : bounds[k + 1]]
            if rows[k] == heads[k]:
                head, own = (heads[k], blocks[k]), members.copy()
                continue
            if head != (heads[k], blocks[k]):
                raise ValueError("a block came without its head")
            at = np.minimum(np.searchsorted(own, members), len(own) - 1)
            if linked(int(np.count_nonzero(own[at] == members)), len(own), len(members)):
                a.append(heads[k])
                b.append(rows[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = batch.num_rows
        bits = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()
        n = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
        keep = near_enough(bits, n, np.arange(m), np.arange(m, 2 * m))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (``a, b``) whose sizes and parities allow a link; no linked pair is lost."""
    of = sets.select(F.col("row").alias("_row"), "n", "bits")
    both = pairs.join(of.withColumnsRenamed({"n": "n_a", "bits": "bits_a"}), F.col("a") == F.col("_row")).drop("_row")
    both = both.join(of.withColumnsRenamed({"n": "n_b", "bits": "bits_b"}), F.col("b") == F.col("_row")).drop("_row")
    part, whole = SIMILARITY
    both = both.where(whole * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b"))
    return written(both.mapInArrow(lean(_possible), "a long, b long"), "ngram-possible")


def linked_pairs(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (``a, b``, different) whose overlap is enough: a block holds a head and at most about ``BLOCK`` of its rows.

    Whole sets are made again for the rows of the pairs alone, from one text each.
    """
    spark = pairs.sparkSession
    pairs = possible(pairs, known)
    n = pairs.count()
    if not n:
        return pairs
    rows = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()
    ids = written(rows.join(known, F.col("_row") == F.col("row")).select(F.col("id").alias("_id")), "ngram-ids")
    whole = texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = whole.mapInArrow(lean(_whole_sets), "row long, members array<long>").dropDuplicates(["row"])
    sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = pairs.join(sizes, F.col("a") == F.col("_a")).select(F.col("a").alias("head"), F.col("b").alias("want"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    heads = rows.select("head", F.col("head").alias("want"), "block").distinct()
    wanted = rows.unionByName(heads).join(sets, F.col("want") == F.col("row")).drop("want")
    dealt = wanted.repartition(min(partitions(spark), 1 + n // PAIRS), "head", "block").sortWithinPartitions("head", "block", F.col("row") != F.col("head"))
    return written(dealt.select("head", "block", "row", "members").mapInArrow(lean(_product), "a long, b long"), "ngram-links")


def _open(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars: with two smaller neighbours, or with a smaller one and a larger one."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("w"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of the edges (``a, b``) is joined with, by alternating large and small stars until only stars are left."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    edges = written(edges.distinct(), "ngram-edges")
    while _open(edges):
        # large star: an edge goes on to the smallest neighbour of its smaller end
        least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = written(edges.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")), "ngram-large")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "ngram-small")
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "ngram-roots")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links (``a, b``): known ones go in as stars."""
    if links.isEmpty():
        return roots
    return components(links.unionByName(roots.where("node > root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block pairs of a column (sorted by column and block pair): pairs of rows in different components whose sizes, ranks and parities (where given) allow a link."""
    names = ["shingle", "i", "j", "side", "row", "n", "rank", "root", "bits"]
    held: list[tuple] = []
    part, whole = SIMILARITY

    def pairs() -> np.ndarray:
        side, row, n, rank, root = (np.array([x[k] for x in held], np.int64) for k in range(3, 8))
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if held[0][1] != held[0][2] else (np.arange(len(held)),) * 2
        # the first column that two linked rows share leaves room for their overlap after it
        need = -(-part * (n[left][:, None] + n[right][None, :]) // (part + whole))
        room = np.minimum((n - rank)[left][:, None], (n - rank)[right][None, :])
        may = (root[left][:, None] != root[right][None, :]) & (need <= room)
        if held[0][1] == held[0][2]:  # one block with itself: each pair once
            may &= row[left][:, None] < row[right][None, :]
        x, y = np.nonzero(may)
        x, y = left[x], right[y]
        if held[0][8] is not None and len(x):
            keep = near_enough([r[8] for r in held], n, x, y)
            x, y = x[keep], y[keep]
        return np.column_stack([np.minimum(row[x], row[y]), np.maximum(row[x], row[y])])

    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and held[-1][:3] != row[:3]:
                found.append(pairs())
                held = []
            held.append(row)
        found = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
    if held:
        found = np.unique(pairs(), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of each column with the roots of their components."""
    placed = rows.join(roots, F.col("row") == F.col("node"), "left")
    return written(placed.select("shingle", "class", "row", "n", "rank", F.coalesce("root", "row").alias("root")), "ngram-placed")


def star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """In each crowded column and size class: rows with two heads of other components, others in each turn. A few pairs a row, however many there are."""
    head = F.struct(F.xxhash64("row", F.lit(turn)).alias("k"), F.col("row").alias("head"), F.col("root").alias("other"), F.col("n").alias("m"), (F.col("n") - F.col("rank")).alias("left"))
    heads = placed.groupBy(F.col("shingle").alias("_s"), F.col("class").alias("_c")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(head).alias("x"),
        F.max(head).alias("y"),
    )
    heads = heads.where(F.col("rows") > CROWD).select("_s", "_c", F.explode(F.array("x", "y")).alias("h")).select("_s", "_c", "h.head", "h.other", "h.m", "h.left")
    part, whole = SIMILARITY
    room = part * (F.col("n") + F.col("m")) <= (part + whole) * F.least(F.col("n") - F.col("rank"), F.col("left"))
    both = placed.join(heads, (F.col("shingle") == F.col("_s")) & (F.col("class") == F.col("_c")) & (F.col("root") != F.col("other")) & room)
    return both.select(F.least("head", "row").alias("a"), F.greatest("head", "row").alias("b")).distinct()


def cross_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of rows that share a column, may link and are in different components, each once; ``BLOCK`` rows a side at a time."""
    spark = placed.sparkSession
    several = placed.groupBy(F.col("shingle").alias("_s")).agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("x"), F.max("root").alias("y"))
    several = several.where("x < y").select("_s", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(several, F.col("shingle") == F.col("_s")).withColumn("k", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    of = sets.select(F.col("row").alias("_row"), "bits")
    rows = rows.where(F.col("rows") <= CROWD).withColumn("bits", F.lit(None).cast("binary")).unionByName(
        rows.where(F.col("rows") > CROWD).join(of, F.col("row") == F.col("_row")).drop("_row")
    )
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"), (F.col("k") > o).cast("int").alias("side")))
    dealt = rows.withColumn("o", F.explode(others)).select("shingle", "o.i", "o.j", "o.side", "row", "n", "rank", "root", "bits")
    dealt = dealt.repartition(partitions(spark), "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return dealt.mapInArrow(lean(_cross), "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its component: ``doc_id, n_shingles, component_id``.

    Words are runs of anything but ASCII white space, A to Z lowered; a text of fewer than five words has one shingle; null, empty and blank texts have none and are
    alone. Rows that repeat a doc_id count as one document with several sets. A null doc_id takes the component of its copies; where it has none, null. Empty table: no rows.
    Only doc_id and text are read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    first = written(texts.mapInArrow(lean(_survey), _FIRST), "ngram-survey")
    known = first.where("kind = 0").select("id", F.col("value").alias("row"), "n")
    # a row of the matrix: its size, its parities and one document that has it
    sets = first.where("kind = 0 AND n > 0").select("id", F.col("value").alias("row"), "n", "bits")
    sets = written(sets.groupBy("row").agg(F.min_by(F.struct("id", "n", "bits"), F.coalesce("id", F.lit(0))).alias("s")).select("row", "s.*"), "ngram-sets")
    top = first.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).where("n > 8")
    top = top.orderBy(F.col("n").desc(), "value").limit(FREQUENT).collect()  # at most FREQUENT rows
    frequent = np.array([r["value"] for r in reversed(top)], np.int64).view(np.uint64)

    columns = texts.select("text").mapInArrow(lean(_rare_parts(frequent)), _RARE).withColumn("class", F.floor(F.log("n") / float(CLASS)))
    dealt = W.partitionBy("shingle", "salt")
    columns = columns.select("*", F.min("row").over(dealt).alias("least"), F.max("row").over(dealt).alias("most"), F.min("row").over(W.partitionBy("shingle", "salt", "class")).alias("head"))
    shared = written(columns.where("least < most OR salt >= 0").drop("least", "most"), "ngram-shared")

    stars = shared.where("head != row").select(F.col("head").alias("a"), F.col("row").alias("b"))
    hot = shared.where("salt >= 0").select("shingle", "class", "head").distinct()
    tops = hot.groupBy(F.col("shingle").alias("_s"), F.col("class").alias("_c")).agg(F.min("head").alias("a"))
    hot = hot.join(tops, (F.col("shingle") == F.col("_s")) & (F.col("class") == F.col("_c"))).where("a != head").select("a", F.col("head").alias("b"))
    pairs = written(stars.unionByName(hot).distinct(), "ngram-pairs")

    rows = written(shared.select("shingle", "class", "row", "n", "rank").distinct(), "ngram-rows")  # each row of a column once
    roots = components(linked_pairs(pairs, sets, texts))
    placed = _placed(rows, roots)
    for turn in range(1, TURNS + 1):  # large groups grow together; what is left apart is compared in full below
        pairs = written(star_pairs(placed, turn), "ngram-pairs")
        if pairs.isEmpty():
            break
        links = linked_pairs(pairs, sets, texts)
        if not links.isEmpty():
            roots = joined(roots, links)
            placed = _placed(rows, roots)
    more = linked_pairs(cross_pairs(placed, sets), sets, texts)
    same = known.where("id IS NOT NULL").groupBy("id").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("a", "b")  # one doc_id, several sets
    roots = joined(roots, more.unionByName(same))
    labelled = known.join(roots, (F.col("row") == F.col("node")) & (F.col("n") > 0), "left")
    labelled = written(labelled.select("id", "n", "row", F.when(F.col("n") > 0, F.coalesce("root", "row")).alias("root")), "ngram-labels")
    names = labelled.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("name"))
    done = labelled.join(names, F.col("root") == F.col("_root"), "left")
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with their own columns, whatever their names; all rows of such a doc_id stay.

    A row whose doc_id is null stays, and so does one whose text is null, empty or blank. Empty table: no rows.
    """
    gone = near_groups(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
