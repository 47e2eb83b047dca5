"""Filters, windows and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Neither null nor empty text."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def same_key(a: Column, b: Column) -> Column:
    """Keys of different types compared as text."""
    return a.cast("string") == b.cast("string")


def in_label_window(ts: Column, t0: str, days: int) -> Column:
    """(T0, T0 + days]."""
    start = F.lit(t0).cast("timestamp_ntz")
    return (ts > start) & (ts <= start + F.expr(f"INTERVAL {days} DAYS"))


def in_lookback(ts: Column, t0: str, days: int) -> Column:
    """(T0 - days, T0]."""
    end = F.lit(t0).cast("timestamp_ntz")
    return (ts > end - F.expr(f"INTERVAL {days} DAYS")) & (ts <= end)


def through(ts: Column, t0: str) -> Column:
    """Up to and including T0."""
    return ts <= F.lit(t0).cast("timestamp_ntz")


def recent_days(day: Column, anchor: str, n: int, include_anchor: bool = True) -> Column:
    """The last ``n`` days, with or without the anchor day itself."""
    end = F.lit(anchor).cast("date")
    if include_anchor:
        return (day > F.date_sub(end, n)) & (day <= end)
    return (day >= F.date_sub(end, n)) & (day < end)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DECIMAL(26,2), 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(0).cast("decimal(26,2)")


def fallback(primary: Column, usable: Column, backup: Column) -> Column:
    """The primary value where it is usable, else what the backup gives."""
    return F.coalesce(F.when(usable, primary), backup)


def hash_fold(key: Column, folds: int) -> Column:
    """Stable fold of a key from the leading hex digits of its md5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint") % folds).cast("int")


def stable_half(key: Column) -> Column:
    """0 or 1: parity of the eighth byte of the key's sha256."""
    digit = F.substring(F.sha2(key.cast("string"), 256), 16, 1)
    return (F.conv(digit, 16, 10).cast("int") % 2).cast("int")
