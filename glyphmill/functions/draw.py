"""Random draws as pure functions of (seed, key, role).

A draw never depends on partitioning, row order or retries, so a lost task
recomputes the same rows, and any engine with md5 reproduces them.  One md5
yields four independent 28-bit windows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_DIGITS = 7
WINDOW_SIZE = 16**WINDOW_DIGITS


def digest(seed: int | Column, key: Column, role: str | None = None) -> Column:
    parts = [F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string"), key.cast("string")]
    if role is not None:
        parts.append(F.lit(role))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def window(hex_digest: Column, slot: int = 0) -> Column:
    """The ``slot``-th 28-bit integer (0..3) of an md5 hex digest."""
    start = 1 + WINDOW_DIGITS * slot
    return F.conv(F.substring(hex_digest, start, WINDOW_DIGITS), 16, 10).cast("bigint")


def pick(hex_digest: Column, n: Column | int, slot: int = 0) -> Column:
    """An index in ``0 .. n-1``."""
    size = F.lit(n) if isinstance(n, int) else n
    return window(hex_digest, slot) % size


def threshold(share: float) -> int:
    return int(share * WINDOW_SIZE)


def below(hex_digest: Column, share: float, slot: int = 0) -> Column:
    """True for about ``share`` of all keys."""
    return window(hex_digest, slot) < F.lit(threshold(share))
