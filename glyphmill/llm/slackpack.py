"""Packing by minimum bin slack.

Documents become token ids closed by an end mark and are cut every ``capacity``
ids; what is left of each is a piece shorter than a sequence.  Only the
histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus)
reaches the driver.  There each window takes the longest piece left, and a
bitset subset-sum over the remaining lengths finds the multiset that fills the
rest closest; backtracking gives its counts, and the window is repeated as
often as the counts allow.  Pieces then find their place by their rank among
the pieces of their length.

* A null or empty text is the end mark alone.
* Repeated rows are packed as often as they occur.
* A null ``doc_id`` is packed like any other.
* An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import modest_batches
from glyphmill.llm.wordbpe import of_worker
from glyphmill.session import written

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
RANK_BUCKETS = 256
# Arrays of a run take some 30 times its bytes while its words are looked up.
_SLICE_BYTES = 1 << 20
_BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Params:
    tokenizer: str
    capacity: int = 2048
    end_id: int = 1


@dataclass(frozen=True)
class Window:
    """``repeat`` equal sequences, each with ``counts[length]`` pieces of a length."""

    repeat: int
    counts: dict[int, int]


def pieces(docs: DataFrame, p: Params) -> DataFrame:
    """The pieces of every document, in one narrow pass over the texts."""

    def cut(batches):
        bpe = of_worker(p.tokenizer)
        end = np.array([p.end_id], "<u4").tobytes()
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            for a, b in _slices(texts):
                ids, begins = bpe.encode(texts.slice(a, b - a))
                ids = ids.astype("<u4")
                rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for i in range(b - a):
                    own = ids[begins[i] : begins[i + 1]]
                    total = len(own) + 1
                    for start in range(0, total, p.capacity):
                        length = min(p.capacity, total - start)
                        crc = zlib.crc32(own[start : start + length].tobytes())
                        if start + length == total:
                            crc = zlib.crc32(end, crc)
                        for out, v in zip(rows, (a + i, start, length, crc, total)):
                            out.append(v)
                at = pa.array(rows[0], pa.int64())
                arrays = [names.take(at).cast(pa.int64()), *[pa.array(r, pa.int64()) for r in rows[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def _slices(texts: pa.Array):
    """Runs of texts of bounded size, so that a batch of long texts is not held in ids at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > _SLICE_BYTES:
            yield a, i
            a, held = i, 0
        held += int(n) + 1
    if a < len(sizes):
        yield a, len(sizes)


def padding(filled: int, capacity: int) -> int:
    """Ids added to a sequence; one whose length is a power of two needs none."""
    return 0 if filled & (filled - 1) == 0 else capacity - filled


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """One window: the longest piece, and the others that bring it closest to capacity."""
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        bundle = 1
        while left > 0 and not reach >> room & 1:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    target, least = 0, capacity + 1
    sums = reach
    while sums:
        s = sums.bit_length() - 1
        if padding(first + s, capacity) < least:
            target, least = s, padding(first + s, capacity)
        if least == 0:
            break
        sums ^= 1 << s
    chosen = Counter({first: 1})
    for before, length, take in reversed(steps):
        if not before >> target & 1:
            chosen[length] += take
            target -= length * take
    return dict(chosen)


def plan(histogram: dict[int, int], capacity: int) -> list[Window]:
    """Windows that use up the histogram; their number depends on its lengths, not on its counts."""
    left = {n: c for n, c in histogram.items() if c}
    windows = []
    while left:
        counts = fill(left, capacity)
        repeat = min(left[n] // c for n, c in counts.items())
        windows.append(Window(repeat, counts))
        for n, c in counts.items():
            left[n] -= repeat * c
            if not left[n]:
                del left[n]
    return windows


def _places(windows: list[Window]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in rank order: first rank, pieces per window, offset, first sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for w in windows:
        offset = 0
        for n, c in sorted(w.counts.items(), reverse=True):
            rows.setdefault(n, []).append((used[n], c, offset, sequence))
            used[n] += w.repeat * c
            offset += n * c
        sequence += w.repeat
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def ranked(cut: DataFrame) -> DataFrame:
    """A rank among the pieces of equal length: a short count per hash bucket, then bucket totals.

    A length that a third of all pieces share is spread over the buckets.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS))
    cut = cut.withColumn("bucket", bucket)
    before = W.partitionBy("n").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        cut.groupBy(F.col("length").alias("n"), F.col("bucket").alias("b"))
        .count()
        .select("n", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    local = cut.withColumn("local", F.row_number().over(own) - 1)
    joined = local.join(totals, (F.col("length") == F.col("n")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("rank", F.col("before") + F.col("local")).drop("n", "b", "before", "local", "bucket")


def pack(docs: DataFrame, p: Params) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    modest_batches(docs.sparkSession, _BATCH_BYTES)
    cut = written(pieces(docs, p), "pieces")
    # At most ``capacity`` rows: one per piece length.
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = _places(plan(histogram, p.capacity))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                base, per, begin, first = places[int(n)]
                k = np.searchsorted(base, rank[mine], "right") - 1
                nth = rank[mine] - base[k]
                sequence[mine] = first[k] + nth // per[k]
                offset[mine] = begin[k] + nth % per[k] * n
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return ranked(cut).mapInArrow(place, PIECE + ", sequence_id bigint, offset bigint")
