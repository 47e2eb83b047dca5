"""Chat formatting by columnar byte assembly.

Turns are range-partitioned and sorted by conversation and turn. In each Arrow batch the lengths of all segments (marks, roles, texts)
are summed to offsets, and numpy copies every column in one scatter into one buffer, which becomes the Arrow column of formatted
texts. A conversation that runs over several batches or partitions is written in several pieces, in order; no task holds a whole one.

A turn is ``<|im_start|>role LF text<|im_end|>LF``. In texts each ``<`` with backslashes and ``|`` after it gets one more backslash, so that no
control string is left; in roles backslash, line feed and ``|`` are escaped. Both are undone in reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions, string_buffers, python_tasks

#: The marks of the template.
OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LOSS_ROLE = "assistant"

FORMATTED = "conv_id long, slice int, piece int, n_turns int, text string, loss_start array<long>, loss_bytes array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"<(\\*)\|", r"<\1\\|")


def escape_roles(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.fill_null(roles, ""), "\\", "\\\\")
    return pc.replace_substring(pc.replace_substring(roles, "\n", "\\n"), "|", "\\p")


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy each row's bytes to its place in ``out``."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of formatted turns, the offsets of its turns, and start and bytes of each text in it."""
    (roles, role_offsets), (texts, text_offsets) = (string_buffers(f(batch.column(c))) for f, c in ((escape_roles, "role"), (escape_texts, "text")))
    role_bytes, text_bytes = np.diff(role_offsets), np.diff(text_offsets)
    ends = np.cumsum(len(OPEN) + role_bytes + len(MIDDLE) + text_bytes + len(CLOSE))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    role_at = offsets[:-1] + len(OPEN)
    text_at = role_at + role_bytes + len(MIDDLE)
    out = np.empty(offsets[-1], np.uint8)
    for mark, at in ((OPEN, offsets[:-1]), (MIDDLE, role_at + role_bytes), (CLOSE, text_at + text_bytes)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_at, roles, role_offsets)
    _scatter(out, text_at, texts, text_offsets)
    return out, offsets, text_at, text_bytes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    piece = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        out, offsets, text_at, text_bytes = assemble(batch)
        ids = batch.column("conv_id")
        plain, missing = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (plain[1:] != plain[:-1]) | (missing[1:] != missing[:-1])]))
        after = np.concatenate([first[1:], [batch.num_rows]])
        bounds = np.concatenate([offsets[first], offsets[-1:]])
        lossy = np.flatnonzero(pc.fill_null(pc.equal(batch.column("role"), LOSS_ROLE), False).to_numpy(zero_copy_only=False))
        spans = np.searchsorted(lossy, np.concatenate([first, [batch.num_rows]])).astype(np.int32)
        inside = text_at[lossy] - np.repeat(bounds[:-1], np.diff(spans))
        lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x, pa.int64())) for x in (inside, text_bytes[lossy])]
        texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(first)).cast(pa.int64()),
                pa.array(np.full(len(first), number, np.int32)),
                pa.array(np.arange(piece, piece + len(first), dtype=np.int32)),
                pa.array((after - first).astype(np.int32)),
                texts,
                *lists,
            ],
            names=["conv_id", "slice", "piece", "n_turns", "text", "loss_start", "loss_bytes"],
        )
        piece += len(first)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: text, and where in its UTF-8 bytes the loss counts (texts of assistant turns).

    A conversation is its pieces in the order of slice and piece. Turns stand in the order of turn (null first), then role, then text; rows that
    repeat stay. Null text or role is empty; rows with null conv_id are one conversation. Empty table: no rows. Other columns are left out.
    """
    python_tasks(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", "turn", "role", F.substring("text", 1, 64))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_pieces, FORMATTED)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape_role(m[1]), unescape_text(m[2])) for m in _TURN.finditer(text)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    open_id, state = None, None

    def close() -> None:
        if state:
            done.append((open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv_id, text, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_bytes")), strict=True):
            if state is None or conv_id != open_id:
                close()
                open_id, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            raw = text.encode()
            for start, length in zip(starts, lengths, strict=True):
                said = unescape_text(raw[start : start + length].decode())
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from formatted pieces; each conversation streams through one task."""
    python_tasks(pieces.sparkSession)
    rows = pieces.select("conv_id", "slice", "piece", "text", "loss_start", "loss_bytes").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "slice", "piece").select("conv_id", "text", "loss_start", "loss_bytes").mapInArrow(_digests, DIGESTS)
