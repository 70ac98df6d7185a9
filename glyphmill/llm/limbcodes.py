"""Compression codes of vectors: one small codebook per part, exact in integers.

Components become integers ``floor(scale * x)``; vectors are cut into equal
consecutive parts, and each part position learns a codebook by rounds of
assignment and componentwise floored means.  Dot products of integers come from
float64 matrix products: integers are split into limbs so short that no sum of
limb products reaches 2**53, and the products are put together again in int64.
The nearest entry is the first smallest of ``c.c - 2 x.c``.

A round is one pass of Spark tasks over the vectors and a sum per (part, entry,
position).  Only the codebooks, ``entries x dimensions`` integers whatever the
table, travel between driver and tasks.

* Vectors that are null, or hold a null or non-finite component, are dropped.
* Components outside 64 bits count as the nearest number inside; where
  distances could leave 64 bits, they are taken with Python's integers, and an
  error beyond 64 bits is returned as the largest number inside.
* Vectors shorter than the longest, or than a multiple of ``parts``, are filled
  up with zeros; an empty vector is all zeros.
* A codebook starts from the smallest ids (null ids last, then by vector); rows
  sharing an id are rows of their own.  Fewer rows than entries give a shorter
  codebook.
* Rows with a null label form one label; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphmill.llm.common import lookup
from glyphmill.session import written

BLOCK = 4096
MOST = 2**63 - 1


@dataclass(frozen=True)
class Params:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs, lowest first: sum of ``limb[i] << (bits * i)``; the last one keeps the sign."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    out = []
    for _ in range((max(most, 1).bit_length() - 1) // bits):
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def exact_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, in int64; exact where the result fits."""
    bits = (52 - max(x.shape[1], 1).bit_length()) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row, and its squared distance."""
    most = max(max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (x, book))
    if 4 * most * most * max(x.shape[1], 1) > MOST:
        x, book = x.astype(object), book.astype(object)
        gap = np.array([[int((d * d).sum()) for d in row - book] for row in x], object).reshape(len(x), len(book))
        entry = np.array([int(g.argmin()) for g in gap], np.int64)
        return entry, np.array([min(g[e], MOST) for g, e in zip(gap, entry)], np.int64)
    gap = (book * book).sum(axis=1)[None, :] - 2 * exact_product(x, book)
    entry = gap.argmin(axis=1)
    return entry, gap[np.arange(len(x)), entry] + (x * x).sum(axis=1)


def integers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``id, label, v``: the usable rows with integer components."""
    v = F.col(f"`{vector_column}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    usable = vectors.filter(v.isNotNull() & ~bad)
    return usable.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label"), whole.alias("v")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of lists as one matrix, filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy()
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def first_books(rows: DataFrame, width: int, p: Params) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids."""
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(p.entries).select("v").toArrow()
    x = matrix(start.column("v").combine_chunks(), width) if len(start) else np.zeros((0, width), np.int64)
    return [np.ascontiguousarray(b) for b in np.split(x, p.parts, axis=1)]


def assigned(batch: pa.RecordBatch, books: list[np.ndarray]):
    """Blocks of a batch: first row, and per part its vectors, entries and squared distances."""
    width = sum(b.shape[1] for b in books)
    for at in range(0, batch.num_rows, BLOCK):
        block = batch.slice(at, BLOCK)
        # A slice keeps its parent's lists, so they are cut out first.
        x = matrix(pa.concat_arrays([block.column("v")]), width)
        parts = np.split(x, len(books), axis=1)
        yield at, [(part, *nearest(np.ascontiguousarray(part), b)) for part, b in zip(parts, books)]


SUMS = "part int, entry int, pos int, n bigint, high bigint, low bigint"


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The books after one round; entries without parts stay.

    Sums travel as two halves, so that they hold for any 64-bit components.
    """
    shape = books[0].shape

    def sums(batches):
        n = np.zeros((len(books), shape[0]), np.int64)
        high = np.zeros((len(books), *shape), np.int64)
        low = np.zeros_like(high)
        for batch in batches:
            for _, found in assigned(batch, books):
                for k, (x, entry, _) in enumerate(found):
                    order = np.argsort(entry, kind="stable")
                    used, first, count = np.unique(entry[order], return_index=True, return_counts=True)
                    n[k, used] += count
                    high[k, used] += np.add.reduceat(x[order] >> 32, first, axis=0)
                    low[k, used] += np.add.reduceat(x[order] & 0xFFFFFFFF, first, axis=0)
        part, entry = (np.repeat(a, shape[1]) for a in np.nonzero(n))
        pos = np.tile(np.arange(shape[1]), int((n > 0).sum()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(pos.astype(np.int32)),
                pa.array(n[part, entry]),
                pa.array(high[part, entry, pos]),
                pa.array(low[part, entry, pos]),
            ],
            names=["part", "entry", "pos", "n", "high", "low"],
        )

    totals = rows.select("v").mapInArrow(sums, SUMS).groupBy("part", "entry", "pos")
    out = [b.copy() for b in books]
    for part, entry, pos, n, high, low in totals.agg(F.sum("n"), F.sum("high"), F.sum("low")).collect():
        out[part][entry, pos] = ((high << 32) + low) // n
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def learn(rows: DataFrame, p: Params = Params()) -> list[np.ndarray]:
    """One codebook per part (``entries x width`` integers) from ``id, label, v`` rows."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    books = first_books(rows, -(-longest // p.parts) * p.parts, p)
    if len(books[0]) and books[0].shape[1]:
        for _ in range(p.rounds):
            books = moved(rows, books)
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` of ``id, label, v`` rows."""
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    schema = StructType([*rows.select("id", "label").schema, StructField("code", StringType()), StructField("error", LongType())])

    def codes(batches):
        for batch in batches:
            for at, found in assigned(batch, books):
                entries = np.stack([entry for _, entry, _ in found], axis=1)
                errors = [min(sum(e), MOST) for e in zip(*(gap.tolist() for _, _, gap in found))]
                code = ["".join(f"{e:0{digits}x}" for e in row) for row in entries.tolist()]
                same = batch.slice(at, BLOCK).select(["id", "label"])
                columns = [*same.columns, pa.array(code), pa.array(errors, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(codes, schema)


def compress(
    vectors: DataFrame,
    params: Params = Params(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    rows = written(integers(vectors, id_column, vector_column, label_column, params.scale), "integers")
    books = learn(rows, params)
    found = written(coded(rows, books), "codes")
    by_label = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = F.least("total", F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    return lookup(found, by_label, ["label"]).select(
        F.col("id").alias(id_column),
        "code",
        "error",
        total.alias("label_error"),
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
