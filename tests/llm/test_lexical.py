"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import treap

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for item, words in asked.items():
        scores = []
        for (doc, counts), n in zip(found, sizes):
            score = 0
            for t in words & counts.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (10**9 * counts[t] // (1000 * counts[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


AWKWARD = [None, "", "...", "a", "A", "é É", "x_y x-y", "日本 日本語", "a1 1a", "a b a b a b", "ſ K", "b" * 3000]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(words[int(rng.random() ** 2 * len(words))] for _ in range(n))
    docs = list(enumerate(AWKWARD + [prose(rng.randint(1, 120)) for _ in range(250)]))
    docs += [(1000 + i, docs[20][1]) for i in range(15)]  # ties
    items = [(i, prose(rng.randint(1, 25))) for i in range(40)] + [(100, None), (101, "zzzzzz"), (102, docs[20][1]), (103, "é 日本")]
    return docs, items


@pytest.mark.parametrize("p", [treap.Params(), treap.Params(postings=300, items=7, beam=3), treap.Params(k=1, beam=1)])
def test_search_matches_brute_force(spark, corpus, p):
    assert rows(treap.top_k(*frames(spark, *corpus), p)) == brute(*corpus, p.k)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    docs = [(None, "a b"), (1, "a b"), (2, "a c"), (2, "b c c"), (3, "a b")]
    items = [(None, "a"), (7, "a"), (7, "b"), (8, "c")]
    d, i = frames(spark, docs, items)
    found = treap.top_k(d.withColumn("term", F.lit("b")).withColumn("n", F.lit(5)), i.withColumn("weight", F.lit(0)))
    assert rows(found) == brute(docs, items)


def test_equal_rows_are_ranked_once(spark):
    docs, items = frames(spark, [(1, "a b"), (1, "a b"), (2, "c")], [(0, "a")])
    assert [(r[1], r[2]) for r in rows(treap.top_k(docs, items))] == [(1, 1)]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a")], [(0, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("false"), items.filter("false"))):
        assert treap.top_k(d, i).collect() == []


def test_cells_hold_the_maxima_below_them():
    rng = np.random.default_rng(4)
    grid = np.where(rng.random((13, 40)) < 0.2, rng.integers(1, 100, (13, 40)), 0)
    row, column = np.nonzero(grid)
    tree = treap.Treap(row, column, grid[row, column])
    side = 1 << tree.depth
    full = np.zeros((side, side), np.int64)
    full[:13, :40] = grid
    assert tree.most[0] == grid.max()
    todo = [(0, 0, 0, tree.depth)]
    for node, r, c, level in todo:
        if level == 0:
            assert tree.most[node] == full[r, c] > 0
            continue
        half = 1 << (level - 1)
        for quadrant in range(4):
            child = int(tree.children(np.array([node]), np.array([quadrant]))[0])
            a, b = r + half * (quadrant >> 1), c + half * (quadrant & 1)
            part = full[a : a + half, b : b + half]
            assert (child >= 0) == bool(part.any())
            if child >= 0:
                assert tree.most[child] == part.max()
                todo.append((child, a, b, level - 1))
    assert len(todo) == len(tree.mask)


def test_a_beam_of_one_visits_few_ranges():
    rng = np.random.default_rng(5)
    n = 4096
    value = rng.integers(1, 1000, n)
    value[1234] = 10**6
    tree = treap.Treap(np.zeros(n, int), np.arange(n), value)
    seen = []
    real = treap.Treap.children
    counted = type("Counted", (treap.Treap,), {"children": lambda t, node, q: seen.append(node.size) or real(t, node, q)})
    tree.__class__ = counted
    found, scores = treap.best(tree, np.array([0]), np.arange(n), treap.Params(k=1, beam=1))
    assert (found.tolist(), scores.tolist()) == ([1234], [10**6])
    assert sum(seen) <= 4 * tree.depth
