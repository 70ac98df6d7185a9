"""Words of a batch of texts as flat arrays: no Python object per word.

A batch's UTF-8 bytes lie in one buffer.  Word limits come from a byte table,
word hashes from prefix sums of a 64-bit polynomial over that buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_SLICE_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible map)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text begins (one more entry than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def slices(texts: pa.Array, size: int = _SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes at most (at least one text each), with their first index."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield a, texts.slice(a, i - a)
            a, held = i, 0
        held += int(n) + 1
    if a < len(sizes):
        yield a, texts.slice(a)


def word_limits(
    data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more entry than texts).

    ``solid`` marks the bytes that words are made of; by default all but white space.
    """
    solid = ~_SPACE[data] if solid is None else solid
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, solid
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = solid, False
    before[offsets] = False  # a text's first byte follows nothing
    after[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash per word; with ``lower``, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(lower)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = backs = np.ones(1, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        part = data[starts[i] : ends[j - 1]]
        if len(powers) < len(part):
            powers, backs = _powers(_BASE, len(part)), _powers(inverse, len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = (sums[b] - sums[a]) * backs[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)
