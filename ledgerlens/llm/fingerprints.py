"""Document fingerprints from prefix polynomial hashes.

Each text gets arrays of its prefixes' polynomial hashes modulo two primes. A span's hash is a difference of two prefixes, scaled by
an inverse power, so any two spans, of one text or of two, compare in constant time, and binary search over lengths finds
their longest common extension. The fingerprint holds the length, the hash of the whole text and the smallest hashes of its
spans of ``SPAN`` code points: a bottom sketch, from which the share of spans in common is read.

"The next document" follows the order of doc_id: texts are range-partitioned and sorted once; only the last text of a partition looks
for the first of the following one, through a table of one row a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import mixed, partitions, python_tasks

#: The largest prime below 2**31 and the next one, and a base for each.
MODULI = ((2147483647, 1315423911), (2147483629, 1812433253))
SPAN = 16
SKETCH = 64
SLICE_CHARS = 1 << 20

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_edited long, common_next long"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class _Table:
    """Powers of a base modulo a prime, and of its inverse."""

    def __init__(self, modulus: int, base: int):
        self.modulus, self.base = modulus, base % modulus
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        m = np.uint64(self.modulus)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.modulus)) % m])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.base, -k, self.modulus)) % m])


_TABLES = [_Table(*x) for x in MODULI]


class Prefixes:
    """Prefix hashes of several texts, one after the other."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for t in _TABLES:
            t.reach(len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * t.up[: len(codes)] % np.uint64(t.modulus), out=sums[1:])
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans, the same wherever they stand: 62 bits from two moduli."""
        first, second = (
            (sums[ends] - sums[starts]) % np.uint64(t.modulus) * t.down[starts] % np.uint64(t.modulus) for t, sums in zip(_TABLES, self.sums, strict=True)
        )
        return first << np.uint64(31) | second

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width."""
        a, b = ((s[width:] - s[:-width]) % np.uint64(t.modulus) * t.down[: len(s) - width] % np.uint64(t.modulus) for t, s in zip(_TABLES, self.sums, strict=True))
        return a << np.uint64(31) | b


def common_extension(a: Prefixes, at_a: np.ndarray, b: Prefixes, at_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the texts agree from the given places on, up to ``most``: binary search, all places at once."""
    low, high = np.zeros(len(at_a), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.spans(at_a, at_a + middle) == b.spans(at_b, at_b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sketches(texts: Prefixes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The whole hash of each text and its smallest span hashes (32 bits; of the whole text where it is shorter than a span)."""
    whole = mixed(texts.spans(texts.starts[:-1], texts.starts[1:]) + texts.lengths.astype(np.uint64))
    every = mixed(texts.windows(SPAN)) if texts.starts[-1] >= SPAN else np.zeros(0, np.uint64)
    out = []
    for k, (a, n) in enumerate(zip(texts.starts[:-1].tolist(), texts.lengths.tolist(), strict=True)):
        own = every[a : a + n - SPAN + 1] if n >= SPAN else whole[k : k + 1]
        few = own
        size = 2 * SKETCH
        while True:  # repeated spans count once: take more until enough differ
            few = np.unique(np.partition(own, size - 1)[:size] if size < len(own) else own)
            if len(few) >= SKETCH or size >= len(own):
                break
            size *= 4
        out.append(np.unique(few >> np.uint64(32))[:SKETCH])
    return whole, out


def render(length: int, whole: int, sketch: np.ndarray) -> str:
    return f"{length:x}-{whole:016x}-" + sketch.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of spans in common (twice the common ones over all of both), estimated from two fingerprints; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u4") for f in (a, b))
    union = np.union1d(x, y)[:SKETCH] if len(x) >= SKETCH or len(y) >= SKETCH else np.union1d(x, y)
    both = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
    share = float(both.mean())
    return 2 * share / (1 + share)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points from the start of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(ids: list, texts: list[str], following: str) -> list[tuple]:
    """Results for texts that follow one another; ``following`` comes after the last."""
    after = [*texts[1:], following]
    changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    own, new = Prefixes([*texts, following]), Prefixes(changed)
    prints = [[render(n, w, s) for n, w, s in zip(p.lengths.tolist(), *(x if isinstance(x, list) else x.tolist() for x in sketches(p)), strict=True)] for p in (own, new)]
    m = len(texts)
    at, nxt = own.starts[:m], own.starts[1 : m + 1]
    with_edited = common_extension(own, at, new, new.starts[:m], np.minimum(own.lengths[:m], new.lengths))
    with_next = common_extension(own, at, own, nxt, np.minimum(own.lengths[:m], own.lengths[1:]))
    return [
        (
            ids[k],
            len(texts[k]),
            hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(),
            prints[0][k],
            prints[1][k],
            likeness(prints[0][k], prints[1][k]),
            likeness(prints[0][k], prints[0][k + 1]),
            int(with_edited[k]),
            int(with_next[k]),
        )
        for k in range(m)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the last text of a sorted partition."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and size > SLICE_CHARS:
                yield _batch(_rows(ids, texts, text or ""))
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
    if len(texts) > 1:
        yield _batch(_rows(ids[:-1], texts[:-1], texts[-1]))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last text of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            row = batch.slice(batch.num_rows - 1).to_pylist()[0]
            first = first or batch.slice(0, 1).to_pylist()[0]
            last = row
    if first:
        own = {"slice": TaskContext.get().partitionId(), "first": first["text"] or "", "doc_id": last["doc_id"], "text": last["text"] or ""}
        yield pa.RecordBatch.from_pylist([own], schema=pa.schema([("slice", pa.int32()), ("first", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())]))


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _batch(_rows([row["doc_id"]], [row["text"]], row["following"]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, with the likeness of each to its edited text and to the next document.

    Null counts as the empty text; a null doc_id comes first; rows that share a doc_id follow one another by text. The last document is followed by the first
    (itself, where it is the only one). Two empty texts are alike 1. Empty table: no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    borders = ranged.mapInArrow(_borders, "slice int, first string, doc_id long, text string")  # one row a partition
    order = W.orderBy("slice")
    after = F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    lasts = borders.select("doc_id", "text", after.alias("following")).mapInArrow(_last, SCHEMA)
    return ranged.mapInArrow(_inside, SCHEMA).unionByName(lasts)
