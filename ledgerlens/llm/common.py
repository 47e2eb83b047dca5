"""What the training-data operators share: words, written step tables, Arrow batches as byte buffers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import configure, scratch_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch: whole texts travel in it, so it is smaller than Spark's own default.
BATCH_ROWS = 1000

#: Bytes of one Arrow batch, more only where a single row is longer.
BATCH_BYTES = 1 << 24

#: Bytes of text that the numpy code looks at in one go; a longer text is looked at alone.
SLICE_BYTES = 1 << 21
#: The same where texts are looked at one by one, so that smaller slices only save memory.
SMALL_SLICE = 1 << 18


_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame as a table in the shared folder: read by any executor, not computed again when one is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_tasks(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small; workers find this package where they share the driver's files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, _HOME) if x)


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: a worker stays alive between tasks, while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over the batches of a task, its memory given back at the end."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_share(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5: the same in every run and every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold ``most`` bytes together, or one longer text."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_BYTE_KEYS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result hangs on each bit of the input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def running(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of the values times the powers of their positions; one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.reach(len(values))[0], out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of spans, wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers.reach(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, their 64-bit hashes, and the first word of each text (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    hashes = spans(running(_BYTE_KEYS[data], _BYTE_POWERS), starts, ends, _BYTE_POWERS)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def word_spans(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on (texts are not told apart)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(hashes) - width + 1)
    return spans(running(hashes, _WORD_POWERS), starts, starts + width, _WORD_POWERS)
