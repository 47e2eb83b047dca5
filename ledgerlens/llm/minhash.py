"""Near duplicates by one-permutation MinHash.

A row is a different set of shingles (equal sets are one row). One hash of each shingle deals the set over ``BINS`` bins and keeps the least of each.
A bin without a shingle takes the value of a bin that has one, found by a walk of its own over the bins (optimal densification), so that two sets agree in a bin about as
often as they agree in their members. ``BANDS`` bands of ``BAND`` bins make the buckets: sets that agree to 0.85 meet in none with a chance of 1e-8.

In a bucket every row is compared with a few heads, a star each: ``HEADS`` pairs a row, however large the bucket. The heads of the first turn are the rows that share
most buckets with others, which stand in the middle of a group of copies. Each candidate is confirmed on both whole sets. Rows that
are still in different components meet other heads, and those that remain are compared block by block in their bucket; a pair leaves a task once, from the first
bucket that it shares, and only where its sizes and parities allow a link. So stars bound the pairs that groups of copies give, and none that shares a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SMALL_SLICE, lean, mixed, partitions, python_tasks, slices, string_buffers, written
from ledgerlens.llm.ngram_join import components, fold, parity_bits, shingle_sets

#: Links: this many parts of a hundred of the union.
SIMILARITY = (85, 100)
BANDS, BAND = 32, 5
BINS = BANDS * BAND
#: Turns of stars before blocks, heads of a bucket in a turn, and rows of a head, or of a side, that a task holds together.
TURNS, HEADS, BLOCK = 2, 4, 512

_U = np.uint64
#: The walk of each bin: all bins in an order of its own.
_WALKS = np.random.default_rng(11).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
_BAND_KEYS = np.random.default_rng(12).integers(1, 2**63, BAND, dtype=np.uint64) * _U(2) + _U(1)
_EMPTY = _U(2**64 - 1)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least hash of each bin, empty bins filled, of each set; rows of empty sets are of no use."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    hashes = mixed(values ^ _U(0x9E6C63D0876A3F35))
    bins = ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    out = np.full((len(n), BINS), _EMPTY)
    np.minimum.at(out.reshape(-1), owner * BINS + bins, hashes)
    full = out != _EMPTY
    rows, holes = np.nonzero(~full & (n > 0)[:, None])
    step = 0
    while len(rows):
        source = _WALKS[holes, step]
        found = full[rows, source]
        out[rows[found], holes[found]] = out[rows[found], source[found]]
        rows, holes, step = rows[~found], holes[~found], step + 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A bucket for each band of each signature; buckets of different bands differ."""
    parts = mixed(signature).reshape(len(signature), BANDS, BAND) * _BAND_KEYS
    return mixed(parts.sum(axis=2, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64)))


def identities(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that together know a set."""
    n = np.diff(bounds).astype(np.uint64)
    out = []
    for seed in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(mixed(values + _U(seed)) ^ _U(seed)))])
        out.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n * _U(seed | 1)))
    return out[0], out[1]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch.column("text"))
    for a, b in slices(offsets, SMALL_SLICE):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


_SURVEY = "id long, k1 long, k2 long, n long, bits binary, bands array<long>"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, values, bounds in _sets(batch):
            k1, k2 = identities(values, bounds)
            keys = band_keys(signatures(values, bounds))
            columns = [batch.column("id").slice(a, b - a), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(bounds), pa.int64())]
            columns += [parity_bits(values, bounds), _lists(keys.reshape(-1), np.arange(len(keys) + 1) * BANDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "n", "bits", "bands"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, values, bounds in _sets(batch):
            k1, k2 = identities(values, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _lists(values, bounds)], names=["k1", "k2", "members"])


def may_link(bits: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs (places in the lists) may link by their parities: a parity that differs stands for a member of one set alone, so no linked pair is lost."""
    part, whole = similarity
    words = np.array([len(x) // 8 for x in bits], np.int64)
    place, tables = np.zeros(len(bits), np.int64), {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        place[own] = np.arange(len(own))
        tables[w] = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(-1, w)
    out = np.zeros(len(a), bool)
    for x, y in np.unique(np.column_stack([words[a], words[b]]), axis=0).tolist():
        pairs = np.flatnonzero((words[a] == x) & (words[b] == y))
        left, right = fold(tables[x], min(x, y)), fold(tables[y], min(x, y))
        for at in range(0, len(pairs), 1 << 15):
            p = pairs[at : at + (1 << 15)]
            apart = np.bitwise_count(left[place[a[p]]] ^ right[place[b[p]]]).sum(axis=1, dtype=np.int64)
            out[p] = apart * (whole + part) <= (n[a[p]] + n[b[p]]) * (whole - part)
    return out


def _possible(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
            keep = may_link(batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist(), n, np.arange(m), np.arange(m, 2 * m), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _confirm(similarity: tuple[int, int]):
    """Rows sorted by head and block, the head's own set first: pairs of the head and a row whose whole sets agree enough."""
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            a, b = [], []
            heads, rows, blocks = (batch.column(c).to_numpy() for c in ("head", "row", "block"))
            lists = batch.column("members")
            values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            values = values.view(np.uint64)
            for k in range(len(rows)):
                members = values[ends[k] : ends[k + 1]]
                if rows[k] == heads[k]:
                    head, own = (heads[k], blocks[k]), members.copy()
                    continue
                if head != (heads[k], blocks[k]):
                    raise ValueError("a block came without its head")
                at = np.minimum(np.searchsorted(own, members), len(own) - 1)
                both = int(np.count_nonzero(own[at] == members))
                if whole * both >= part * (len(own) + len(members) - both):
                    a.append(heads[k])
                    b.append(rows[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the written pairs (``a`` the head, ``b``) that link; a block is a head's set and about ``BLOCK`` sets that it is compared with."""
    sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = pairs.join(sizes, F.col("a") == F.col("_a")).select(F.col("a").alias("head"), F.col("b").alias("want"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    heads = rows.select("head", F.col("head").alias("want"), "block").distinct()
    wanted = rows.unionByName(heads).join(members, F.col("want") == F.col("row")).drop("want")
    dealt = wanted.repartition(partitions(pairs.sparkSession), "head", "block").sortWithinPartitions("head", "block", F.col("row") != F.col("head"))
    return written(dealt.select("head", "block", "row", "members").mapInArrow(lean(_confirm(similarity)), "a long, b long"), "minhash-links")


def _apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of each bucket with their components, without the buckets of one component."""
    roots = components(links).withColumnRenamed("root", "joined")
    placed = shared.drop("root").join(roots, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("joined", "row"))
    placed = written(placed.select(*shared.columns), "minhash-placed")
    several = placed.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("_key")
    return placed.join(several, F.col("key") == F.col("_key"), "left_semi")


def star_pairs(placed: DataFrame, turn: int, similarity: tuple[int, int]) -> DataFrame:
    """Each row with the heads of its buckets, unless they are in one component or their sizes rule a link out; the head first. Rows of many shared buckets are heads at first, others in later turns."""
    order = F.struct((-F.col("degree") if turn == 0 else F.xxhash64("row", F.lit(turn))).alias("x"), F.col("row").alias("y"))
    placed = placed.withColumn("order", order)
    heads = placed.groupBy(F.col("key").alias("_key"), F.pmod(F.xxhash64("row", F.lit(-1 - turn)), F.lit(HEADS))).agg(F.min(F.struct("order", "root", "n")).alias("h"))
    sizes = similarity[1] * F.least(F.col("n"), F.col("h.n")) >= similarity[0] * F.greatest(F.col("n"), F.col("h.n"))
    both = placed.join(heads.select("_key", "h"), (F.col("key") == F.col("_key")) & (F.col("root") != F.col("h.root")) & sizes)
    return both.select(F.least("order", "h.order")["y"].alias("a"), F.greatest("order", "h.order")["y"].alias("b")).distinct()


def possible(pairs: DataFrame, wanted: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (``a, b``) whose parities allow a link, written."""
    of = wanted.select(F.col("row").alias("_row"), "n", "bits")
    both = pairs.join(of.withColumnsRenamed({"n": "n_a", "bits": "bits_a"}), F.col("a") == F.col("_row")).drop("_row")
    both = both.join(of.withColumnsRenamed({"n": "n_b", "bits": "bits_b"}), F.col("b") == F.col("_row")).drop("_row")
    return written(both.mapInArrow(lean(_possible(similarity)), "a long, b long"), "minhash-pairs")


def _cross(similarity: tuple[int, int]):
    """Rows sorted by bucket and block pair: pairs in different components that may link and share no bucket before this one."""
    part, whole = similarity
    names = ["key", "i", "j", "side", "row", "n", "root", "bits", "bands"]

    def pairs(held: list[tuple]) -> np.ndarray:
        side, row, n, root = (np.array([x[k] for x in held], np.int64) for k in range(3, 7))
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if held[0][1] != held[0][2] else (np.arange(len(held)),) * 2
        may = root[left][:, None] != root[right][None, :]
        may &= whole * np.minimum(n[left][:, None], n[right][None, :]) >= part * np.maximum(n[left][:, None], n[right][None, :])
        if held[0][1] == held[0][2]:  # a block with itself
            may &= row[left][:, None] < row[right][None, :]
        x, y = np.nonzero(may)
        x, y = left[x], right[y]
        if len(x):
            keep = may_link([r[7] for r in held], n, x, y, similarity)
            x, y = x[keep], y[keep]
        bands = np.array([r[8] for r in held], np.int64)
        for at in range(0, len(x), 1 << 15):
            own = slice(at, at + (1 << 15))
            first = (bands[x[own]] == bands[y[own]]).argmax(axis=1)
            x[own] = np.where(bands[x[own], first] == held[0][0], x[own], -1)
        x, y = x[x >= 0], y[x >= 0]
        return np.column_stack([np.minimum(row[x], row[y]), np.maximum(row[x], row[y])])

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and held[-1][:3] != row[:3]:
                    found.append(pairs(held))
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out([pairs(held)])

    return run


def block_pairs(placed: DataFrame, wanted: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs of a bucket that are in different components and may link, each once, written; ``BLOCK`` rows a side at a time."""
    sizes = placed.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    of = wanted.select(F.col("row").alias("_row"), "bits", "bands")
    rows = placed.join(sizes, F.col("key") == F.col("_key")).join(of, F.col("row") == F.col("_row"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"), (F.col("k") > o).cast("int").alias("side")))
    dealt = rows.withColumn("o", F.explode(others)).select("key", "o.i", "o.j", "o.side", "row", "n", "root", "bits", "bands")
    dealt = dealt.repartition(partitions(placed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(dealt.mapInArrow(lean(_cross(similarity)), "a long, b long"), "minhash-pairs")


def near_copies(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` with its component: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A to Z lowered; a text of fewer than five words has one shingle; null, empty and blank texts have none,
    are alone and kept. Rows that repeat a doc_id are one document with several sets: all are kept, or none. A null doc_id takes the component of its
    copies and is kept only where no copy has a doc_id. Empty table: no rows. Only doc_id and text are read. ``similarity``: parts of a whole, 0.8 or more.
    """
    if 100 * similarity[0] < 80 * similarity[1]:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    spark = docs.sparkSession
    python_tasks(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    survey = written(texts.mapInArrow(lean(_survey), _SURVEY), "minhash-survey")
    sets = survey.where("n > 0").groupBy("k1", "k2").agg(F.min_by(F.struct("id", "n", "bits", "bands"), F.struct(F.col("id").isNull(), "id")).alias("s"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("row"), "k1", "k2", "s.*"), "minhash-sets")

    each = sets.select("row", F.explode("bands").alias("key"))
    several = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "minhash-several")
    shared = written(each.join(several.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select("key", "row", "rows"), "minhash-shared")
    degrees = shared.groupBy(F.col("row").alias("_row")).agg(F.sum("rows").alias("degree"))
    wanted = written(sets.join(degrees, F.col("row") == F.col("_row")).drop("_row"), "minhash-wanted")
    of = wanted.select(F.col("row").alias("_row"), "n", "degree")
    shared = written(shared.join(of, F.col("row") == F.col("_row")).select("key", "row", "n", "degree", F.col("row").alias("root")), "minhash-buckets")
    # whole sets of the rows that share a bucket, made again from one text each
    ids = written(wanted.select(F.col("id").alias("_id")).distinct(), "minhash-ids")
    again = texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(lean(_whole), "k1 long, k2 long, members array<long>")
    of = wanted.select("row", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    members = again.join(of, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("row", "members").dropDuplicates(["row"])
    members = written(members, "minhash-members")

    placed, links = shared, None
    for turn in range(TURNS):
        found = confirmed(possible(star_pairs(placed, turn, similarity), wanted, similarity), members, similarity)
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        placed = _apart(shared, links)
    links = links.unionByName(confirmed(block_pairs(placed, wanted, similarity), members, similarity))

    known = survey.select("id", "n", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    known = written(known.join(sets.select("row", "k1", "k2"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") > 0), "left").select("id", "n", "row"), "minhash-known")
    one = known.where("id IS NOT NULL AND row IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("_id", "a")
    same = known.join(one, F.col("id") == F.col("_id")).where("row > a").select("a", F.col("row").alias("b"))  # one doc_id, several sets
    roots = components(links.unionByName(same))
    labelled = known.join(roots, F.col("row") == F.col("node"), "left")
    labelled = written(labelled.select("id", "n", F.coalesce("root", "row").alias("root")), "minhash-labels")
    names = labelled.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("name"))
    done = labelled.join(names, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("name"))
    return done.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
