"""Chunking and shingles as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1600, 200


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty paragraphs: parts between blank lines."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) > 0)


def grouped_paragraphs(parts: Column, size: int) -> Column:
    """Neighbouring paragraphs joined by a blank line while they fit into ``size``.

    The fold carries only closed groups and the open one; a closed group is never copied into.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        done, current = acc.getField("done"), acc.getField("open")
        full = (current != "") & (F.length(current) + F.length(p) + 2 > size)
        return F.struct(
            F.when(full, F.concat(done, F.array(current))).otherwise(done).alias("done"),
            F.when(full | (current == ""), p).otherwise(F.concat(current, F.lit("\n\n"), p)).alias("open"),
        )

    def finish(acc: Column) -> Column:
        last = acc.getField("open")
        return F.when(last != "", F.concat(acc.getField("done"), F.array(last))).otherwise(acc.getField("done"))

    return F.aggregate(parts, start, step, finish)


def sliced(chunk: Column, size: int, overlap: int) -> Column:
    """The chunk itself, or overlapping slices when it is too long."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(chunk) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(chunk) <= size, F.array(chunk)).otherwise(F.transform(starts, lambda s: F.substring(chunk, s + 1, F.lit(size))))


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """All chunks of a text in order."""
    size = max(200, size)
    overlap = min(max(0, overlap), size - 1)
    return F.flatten(F.transform(grouped_paragraphs(paragraphs(text), size), lambda c: sliced(c, size, overlap)))


def query_terms(text: Column, most: int | None = None) -> Column:
    """Search terms of a question: words of letters, digits, _ and -, two characters or more; with ``most`` only the first of them."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 1)
    return F.transform(words if most is None else F.slice(words, 1, most), F.lower)


def index_words(text: Column) -> Column:
    """Lower-case words of a text as the index sees them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 0)


def shingles(value: Column, size: int = 3) -> Column:
    """Overlapping pieces of ``size`` characters; a shorter value is its own piece."""
    places = F.sequence(F.lit(1), F.greatest(F.length(value) - (size - 1), F.lit(1)))
    return F.when(F.length(value) < size, F.array(value)).otherwise(F.transform(places, lambda i: F.substring(value, i, F.lit(size))))
