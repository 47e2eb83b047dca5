"""Token ids in compressed binary blocks: a static range asymmetric numeral system.

Texts are tokenized once. The tokens of the whole corpus are counted, and one shared table gives each id its share of ``1 << SCALE`` slots.
Documents, range-partitioned and sorted by doc_id, fill blocks. A block's ids are dealt over ``LANES`` interleaved coder states that numpy
moves on together; each block is coded by itself and carries the states and the place in its words at every
``CHECKPOINT``-th step, so that parts of a block can be decoded in parallel, and checksums of its words and of its ids.

The file format: a folder with ``table`` (one row: vocabulary size, scale, frequencies as little-endian 32-bit numbers) and ``blocks`` (a row for
each block: ``slice, block, start`` (ids of the slice before it), ``doc_ids, lengths, n_tokens, words`` (little-endian 32-bit), ``words_crc32``,
``states`` (little-endian 64-bit: the decoder's first states, then those of each checkpoint), ``offsets`` (words read at each checkpoint), ``ids_crc32``). Both are Parquet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions, python_tasks, slices, string_buffers, written
from ledgerlens.session import scratch_path

END_ID = 1
SCALE = 20
LANES = 1024
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 18
#: Words a worker keeps the ids of; beyond that it starts anew.
CACHE_WORDS = 1_000_000

_LOW = 1 << 31  # a state is in [2**31, 2**63)
_U = np.uint64


#: Marks that the tokenizer splits from letters before them, as one run.
_MARKS = ".,;:!?|#$%&*"


_IS_MARK, _IS_SPACE, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(_MARKS.encode())] = True
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_IS_LETTER[97:123] = True


def _apart(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a space between letters and the marks that end a word: the ids stay the same, fewer words differ."""
    mark = np.zeros(len(data) + 2, bool)
    mark[1:-1] = _IS_MARK[data]
    first, after = np.flatnonzero(mark[1:] & ~mark[:-1])[: len(data)], np.flatnonzero(mark[:-1] & ~mark[1:])
    padded = np.concatenate([np.zeros(2, np.uint8), data, np.full(1, 32, np.uint8)])
    before, two_before = padded[first + 1], padded[first]
    letter = _IS_LETTER[before] | ((two_before == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))  # a to z, or of Latin-1
    at = first[letter & _IS_SPACE[padded[after + 2]]]
    at = at[~np.isin(at, offsets, assume_unique=False)]
    moved = at + np.arange(len(at))
    out, old = np.empty(len(data) + len(at), np.uint8), np.ones(len(data) + len(at), bool)
    old[moved] = False
    out[old], out[moved] = data, 32
    return out.tobytes(), offsets + np.searchsorted(at, offsets)


def _plain(word: str) -> bool:
    """Whether the tokenizer takes a word as one run: letters, or marks."""
    return "\u0130" not in word and (word.isalpha() or not word.strip(_MARKS))  # that letter's small form has a mark of its own


#: Bytes of text whose words are looked up together.
TOKEN_SLICE = 3 << 20


class Tokens:
    """Ids of texts by a tokenizer that lowers letters and never joins across ASCII white space: each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab()
        #: Ids that end a run of letters or marks; without such a suffix all words count as not plain.
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[k for w, k in words.items() if suffix and w.endswith(suffix)]] = True
        self.plain = bool(suffix)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        """Encode many plain words as one text, in which each is a run with a closing token; the others each by itself."""
        texts = [w.decode() for w in words]
        plain = [x for x in zip(words, texts, strict=True) if self.plain and _plain(x[1])]
        for a in range(0, len(plain), 5_000):
            part = plain[a : a + 5_000]
            coded = self.tokenizer.encode_batch_fast([" ".join(t for _, t in part)], add_special_tokens=False)[0]
            ids = np.array(coded.ids, np.uint32)
            last = np.flatnonzero(self.closes[ids]) + 1
            if len(last) != len(part) or last[-1] != len(ids):
                raise ValueError("the tokenizer does not split words as expected")
            self.keep([w for w, _ in part], ids, np.diff(last, prepend=0))
        other = [x for x in zip(words, texts, strict=True) if not (self.plain and _plain(x[1]))]
        for a in range(0, len(other), 5_000):
            part = other[a : a + 5_000]
            coded = [x.ids for x in self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)]
            self.keep([w for w, _ in part], np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))

    def keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        known = len(self.numbers)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[known : known + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[known : known + len(words)] = lengths
        self.numbers.update(zip(words, range(known, known + len(words)), strict=True))
        self.used += len(ids)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text with the end id after it, and the ids of each text."""
        raw = data.tobytes()
        if self.plain and b"<|" not in raw:  # else lowering could make one of the tokenizer's special strings
            raw, offsets = _apart(np.frombuffer(raw.lower(), np.uint8), offsets)
        number, first = self.numbered(np.frombuffer(raw, np.uint8), offsets)
        lengths = self.lengths[number]
        after = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.starts[number] - after[:-1], lengths) + np.arange(after[-1])]
        bounds = after[first]
        out = np.full(len(flat) + len(offsets) - 1, END_ID, np.uint32)
        own = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)) + np.arange(len(flat))
        out[own] = flat
        return out, np.diff(bounds) + 1

    def numbered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and the first word of each text (one more at the end). A word that repeats is looked up once."""
        inside = ~_IS_SPACE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        starts[edges] = inside[edges]
        starts = np.flatnonzero(starts)
        body = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)]).astype(np.int32)  # bytes of words before each byte
        ends = np.append(body[starts], body[-1]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        number = self.look_up(distinct)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            if len(self.numbers) + len(missing) > CACHE_WORDS:
                self.clear()
                missing = np.arange(len(distinct))
            self.learn(sorted(distinct[k] for k in missing.tolist()))
            number = self.look_up(distinct)
        return number[words.indices.to_numpy()], np.searchsorted(starts, offsets)


_TOKENS: dict[str, Tokens] = {}


def _tokenizer(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to a slice: the more text is looked at together, the more of its words repeat."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= TOKEN_SLICE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_TOKENIZED = "doc_id long, ids binary, counts binary"


def _tokenize(path: str):
    """The ids of each document; at the end of a task one row without ids that holds its counts of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = _tokenizer(path), np.zeros(0, np.int64)
        for batch in _gathered(batches):
            data, offsets = string_buffers(batch.column("text"))
            for a, b in slices(offsets, TOKEN_SLICE):
                ids, lengths = tokens.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = ids.astype(tokens.width)
                own = np.bincount(ids, minlength=len(total))
                own[: len(total)] += total
                total = own
                bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * ids.itemsize
                coded = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), coded, pa.nulls(b - a, pa.binary())], names=["doc_id", "ids", "counts"])
        counts = pa.array([total.astype("<i8").tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), counts], names=["doc_id", "ids", "counts"])

    return run


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, counts``: ids (little-endian, 16-bit where the vocabulary allows) with the end id for every row; null text is empty. Rows without ids hold a task's counts of ids."""
    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer), _TOKENIZED)


def _width(tokenizer: str) -> str:
    return _tokenizer(tokenizer).width


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            total = np.frombuffer(counts, "<i8")
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def shared_table(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Slots of each id, ``1 << scale`` together: in proportion to the counts, at least one for an id that occurs."""
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    slots = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * (1 << scale))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = (1 << scale) - int(slots.sum())
    if rest >= 0:
        slots[order[0]] += rest
    for k in order:  # too many ids at the least of one slot: the frequent ones give some
        if rest >= 0:
            break
        less = min(-rest, int(slots[k]) // 2)
        slots[k] -= less
        rest += less
    return slots.astype(np.uint32)


class Coder:
    """Codes ids by a shared table; ``LANES`` states move on together."""

    def __init__(self, slots: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = slots.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(slots)]).astype(np.uint64)[:-1]
        self.symbol = None

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, states (the decoder's first, then one set for each checkpoint) and the words read at each checkpoint."""
        steps = -(-len(ids) // LANES)
        grid = np.zeros(steps * LANES, np.int64)
        grid[: len(ids)] = ids
        freq, start = self.freq[grid].reshape(steps, LANES), self.start[grid].reshape(steps, LANES)
        most = freq << _U(63 - self.scale)
        last = len(ids) - (steps - 1) * LANES
        state = np.full(LANES, _LOW, np.uint64)
        words, states, marks, used = [], [], [], 0
        scale = _U(self.scale)
        for t in range(steps - 1, -1, -1):
            n = last if t == steps - 1 else LANES
            x, f = state[:n], freq[t, :n]
            full = x >= most[t, :n]
            if full.any():
                out = (x[full] & _U(0xFFFFFFFF)).astype(np.uint32)
                words.append(out)
                used += len(out)
                x = np.where(full, x >> _U(32), x)
            q = x // f
            state[:n] = (q << scale) + (x - q * f) + start[t, :n]
            if t and t % CHECKPOINT == 0:
                states.append(state.copy())
                marks.append(used)
        words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        states = np.concatenate([state, *states[::-1]])
        return words, states, np.array([used - m for m in marks[::-1]], np.int64)

    def decode(self, words: np.ndarray, states: np.ndarray, offsets: np.ndarray, n: int, part: int | None = None) -> np.ndarray:
        """The ids of a block, or of the part after its ``part``-th checkpoint (0: its start)."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        steps = -(-n // LANES)
        first, end = (0, steps) if part is None else (part * CHECKPOINT, min(steps, (part + 1) * CHECKPOINT))
        k = part or 0
        state = states[k * LANES : (k + 1) * LANES].copy()
        at = int(offsets[k - 1]) if k else 0
        out = np.empty((end - first) * LANES, np.uint32)
        mask, scale = _U((1 << self.scale) - 1), _U(self.scale)
        for t in range(first, end):
            m = min(LANES, n - t * LANES)
            x = state[:m]
            slot = x & mask
            ids = self.symbol[slot]
            out[(t - first) * LANES : (t - first) * LANES + m] = ids
            x = self.freq[ids] * (x >> scale) + slot - self.start[ids]
            low = x < _U(_LOW)
            few = int(np.count_nonzero(low))
            if few:
                x[low] = x[low] << _U(32) | words[at : at + few].astype(np.uint64)
                at += few
            state[:m] = x
        return out[: min(n, end * LANES) - first * LANES]


BLOCK_SCHEMA = (
    "slice int, block int, start long, doc_ids array<long>, lengths array<long>, n_tokens long, words binary, words_crc32 long, states binary, offsets array<long>, ids_crc32 long"
)


def _encode_blocks(slots: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, block, start = Coder(slots), TaskContext.get().partitionId(), 0, 0
        ids, parts, size, each = [], [], 0, np.dtype(width).itemsize

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(parts), width).astype(np.int64)
            words, states, offsets = coder.encode(flat)
            raw = words.astype("<u4").tobytes()
            row = {
                "slice": number, "block": block, "start": start, "doc_ids": list(ids), "lengths": [len(x) // each for x in parts], "n_tokens": len(flat), "words": raw,
                "words_crc32": zlib.crc32(raw), "states": states.astype("<u8").tobytes(), "offsets": offsets.tolist(), "ids_crc32": zlib.crc32(flat.astype("<u4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if parts and size + len(coded) // each > BLOCK_TOKENS:
                    yield close()
                    start, block, ids, parts, size = start + size, block + 1, [], [], 0
                ids.append(doc_id)
                parts.append(coded)
                size += len(coded) // each
        if parts:
            yield close()

    return run


_BLOCK = pa.schema(
    [("slice", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
     ("words", pa.binary()), ("words_crc32", pa.int64()), ("states", pa.binary()), ("offsets", pa.list_(pa.int64())), ("ids_crc32", pa.int64())]
)


def write_blocks(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Tokenize the texts, each followed by id 1, and write them in ascending doc_id order (null first, equal ones by their ids) in the format above.

    Null counts as the empty text: one end id. A text longer than a block has a block of its own. Empty table: an empty table and no blocks. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    width = _width(tokenizer)
    tokens = written(tokenized(docs, tokenizer), "tokens", compression="zstd")
    counted = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    counts = np.zeros(max([r["id"] for r in counted], default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    slots = shared_table(counts)
    spark.createDataFrame([(len(slots), SCALE, bytearray(slots.astype("<u4").tobytes()))], "n_ids long, scale int, slots binary").coalesce(1).write.parquet(f"{path}/table")
    ranged = tokens.where("counts IS NULL").select("doc_id", "ids").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(_encode_blocks(slots, width), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def _decode_blocks(slots: np.ndarray, scale: int, with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(slots, scale)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"block {row['slice']}/{row['block']}: words are damaged")
                words, states = np.frombuffer(row["words"], "<u4"), np.frombuffer(row["states"], "<u8")
                offsets = np.array(row["offsets"], np.int64)
                flat = np.concatenate([coder.decode(words, states, offsets, row["n_tokens"], k) for k in range(len(offsets) + 1)])
                raw = flat.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"block {row['slice']}/{row['block']}: ids are damaged")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                texts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"] + row["before"], pa.int64()), pa.array(row["lengths"], pa.int64())]
                columns += [pa.array([zlib.crc32(x) for x in texts], pa.int64())] + [pa.array(texts, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_blocks(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` of all documents, decoded from the files; checksums are compared."""
    python_tasks(spark)
    one = spark.read.parquet(f"{path}/table").collect()[0]
    slots = np.frombuffer(bytes(one["slots"]), "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.groupBy(F.col("slice").alias("_slice")).agg(F.sum("n_tokens").alias("n"))  # a row for each slice: as many as range partitions
    before = F.coalesce(F.sum("n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(sums.select("_slice", before.alias("before"))), F.col("slice") == F.col("_slice")).drop("_slice")
    return placed.mapInArrow(
        _decode_blocks(slots, one["scale"], with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents to the shared folder and read them back: digests of the ids."""
    path = scratch_path(docs.sparkSession, "token-blocks")
    write_blocks(docs, path, tokenizer)
    return read_blocks(docs.sparkSession, path, with_ids=False)
