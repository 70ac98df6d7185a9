"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import popcounts, queries
from glyphmill.sources.tables import table

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = max(len(words) - 3, 0)
    shingles = [" ".join(words[i : i + 4]) for i in range(n)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """doc_id to the smallest doc_id reachable, from (doc_id, fingerprint) rows."""
    ids = [i for i, _ in rows]
    fps = np.array([f for _, f in rows], np.uint64)
    label = {f: min(i for i, g in rows if g == f) for f in {f for _, f in rows}} if len(rows) < 50 else None
    if label is None:
        label = {}
        for i, f in rows:
            label[f] = min(i, label.get(f, i))
    distinct = np.array(sorted(label), np.uint64)
    links = []
    for k in range(len(distinct) - 1):
        near = np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ distinct[k]) <= distance) + k + 1
        links += [(int(distinct[k]), int(distinct[j])) for j in near]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return dict(zip(ids, (label[int(f)] for f in fps)))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def result(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def expected(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    components = brute_components(fps)
    return {i: (f"{f:016x}", components[i]) for i, f in fps}


AWKWARD = [None, "", " \t\n", "one", "ONE", "one two three", "one  two\nthree", "É é", "a b c d", "a b c d a b c d", "A\x0bB\x0cc d"]


def test_small_texts_match_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    texts = list(AWKWARD)
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += texts[:20]
    assert result(popcounts.near_duplicates(frame(spark, texts))) == expected(list(enumerate(texts)))


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert result(queries.QUERIES["op12_segment_popcounts"](spark, sf_dir)) == expected(rows)


def planted(seed, n, size, flips):
    """Fingerprints: random ones, and clouds around some of them."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(size):
        x = out[rng.randrange(8)]
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize(
    "p", [popcounts.Params(), popcounts.Params(turns=1, run=3, block=5), popcounts.Params(segment=4), popcounts.Params(distance=6)]
)
def test_links_of_crowded_fingerprints_match_brute_force(spark, monkeypatch, p):
    fps = planted(7, 300, 700, 6)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    made = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    monkeypatch.setattr(popcounts, "fingerprints", lambda docs, p: made)
    got = {r["doc_id"]: r["component_id"] for r in popcounts.near_duplicates(made, p).collect()}
    assert got == brute_components(list(enumerate(fps)), p.distance)


def test_counts_bound_the_hamming_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 2000), np.int64).view(np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64))
    for segment in (1, 2, 4, 8):
        gap = np.abs(popcounts.segment_counts(a, segment) - popcounts.segment_counts(b, segment)).sum(axis=1)
        assert (gap <= np.bitwise_count(a ^ b)).all()


def test_pieces_of_a_long_text_give_the_same_hashes(monkeypatch):
    rng = random.Random(2)
    text = " ".join("w" * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(3000))
    whole = popcounts.fingerprint(text.encode())
    assert whole == brute_fingerprint(text)
    monkeypatch.setattr(popcounts, "_PIECE", 50)
    assert popcounts.fingerprint(text.encode()) == whole
    assert popcounts.fingerprint(("x" * 5000).encode()) == brute_fingerprint("x" * 5000)


def test_null_ids_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")], "doc_id bigint, text string")
    rows = popcounts.near_duplicates(docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows) == [(False, 4), (False, 4), (True, None)]
    assert popcounts.near_duplicates(docs.limit(0)).collect() == []
