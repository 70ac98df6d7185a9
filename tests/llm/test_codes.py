"""Vector codes against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import limbcodes
from glyphmill.llm.limbcodes import Params

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, p):
    kept = [
        (i, [max(-(2**63), min(2**63 - 1, math.floor(p.scale * x))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // p.parts)
    kept = [(i, v + [0] * (p.parts * width - len(v)), label) for i, v, label in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[: p.entries]
    cut = lambda v: [v[k * width : (k + 1) * width] for k in range(p.parts)]
    books = [[cut(v)[k] for _, v, _ in start] for k in range(p.parts)]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    pick = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(p.rounds):
        for k, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                held.setdefault(pick(cut(v)[k], book), []).append(cut(v)[k])
            for e, parts in held.items():
                book[e] = [sum(c) // len(parts) for c in zip(*parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        chosen = [pick(x, b) for x, b in zip(cut(v), books)]
        error = sum(gap(x, b[e]) for x, b, e in zip(cut(v), books, chosen))
        coded.append((i, "".join(f"{e:02x}" for e in chosen), min(error, 2**63 - 1), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((i, c, e, min(total[lab], 2**63 - 1), digest) for i, c, e, lab in coded), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, dim, size=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, size) for _ in range(dim)], rng.choice([0, 1, None])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(1, 120, 8),
        vectors(2, 5, 8),
        vectors(3, 40, 8, 1e6),
        vectors(4, 30, 8, 1e16),
        vectors(5, 30, 4) * 2,
        [(1, [0.5] * 7, 1), (2, [0.5], 1), (3, [], None), (None, [1.0] * 8, 2), (4, None, 1), (5, [1.0, None], 1)]
        + [(6, [float("nan")] * 8, 1), (7, [float("inf")] * 8, 1), (8, [-0.0001] * 8, 1)],
    ],
)
def test_codes_match_plain_arithmetic(spark, rows):
    p = Params(entries=16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(limbcodes.compress(df, p)) == brute(rows, p)


def test_ties_unused_entries_and_clashing_columns(spark):
    rows = [(i, [float(i % 2)] * 4, 0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "code", "error", "part"):
        df = df.withColumn(name, F.lit("x"))
    assert result(limbcodes.compress(df, Params(entries=6))) == brute(rows, Params(entries=6))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert limbcodes.compress(df).collect() == []
    assert limbcodes.compress(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [2**10, 2**25, 2**29])
def test_products_are_exact_beyond_doubles(size):
    rng = np.random.default_rng(size)
    x, y = rng.integers(-size, size, (50, 16)), rng.integers(-size, size, (40, 16))
    exact = x.astype(object) @ y.astype(object).T
    assert (limbcodes.exact_product(x, y).astype(object) == exact).all()
    for m, bits in ((x, 7), (y, 24)):
        back = sum(limb.astype(np.int64) << (bits * i) for i, limb in enumerate(limbcodes.limbs(m, bits)))
        assert (back == m).all()
