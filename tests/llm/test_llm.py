"""The training-data operators on small fixtures: nulls, ties, repeated rows, and brute-force twins."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as driver
from glyphmill.llm import (
    balltree,
    divergence,
    flattext,
    jaccard,
    linededup,
    mixing,
    neighbours,
    pii,
    queries,
    slackpack,
    urllists,
    warc,
    wordbpe,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, langs=None, extra=None):
    """Documents 0.. with the given texts; ``extra`` adds a column of that name."""
    rows = [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn(extra, F.lit("kept as it is")) if extra else df


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_operators_are_registered():
    ids = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert ids == list(range(1, 14))
    assert set(queries.QUERIES) <= set(driver.queries())
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    same, n, m, _, _, detail, plan = compare(spark, con, sf_dir, name, queries.QUERIES[name], queries.ORACLES[name])
    assert same, f"{name}: {n} rows against {m}; {detail}"
    assert n > 0
    assert "CartesianProduct" not in plan


# -- 1: distribution divergence ---------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


AWKWARD = [
    None,
    "",
    " \n\t ",
    "one",
    "a b a b a b",
    "a a a a",
    "x\n\nx\n y\x0bz\x0cw\r\n",
    "É€😀 # | $ %",
    "w w   w",
    "the end. " * 40,
    "a b c d a b c e a b c\n" * 3,
]


def test_divergence_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = AWKWARD + [prose(rng, vocabulary(2, 6), n) for n in (3, 10, 200)]
    rows = {r["doc_id"]: r for r in divergence.features(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(t), repr(t)
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_divergence_keeps_plain_texts_and_drops_far_ones(spark):
    rng = random.Random(3)
    words = vocabulary(4) + ["the", "of", "and", "to", "in"] * 40
    texts = [prose(rng, words, 120) + "." for _ in range(40)] + [
        " ".join(w.upper() + "!!" for w in prose(rng, words, 120).split()),
        " ".join(w + "$$$" for w in prose(rng, words, 120).split()),
    ]
    df = documents(spark, texts, langs={0: None, 1: "xx"})
    feats = divergence.features(df).cache()
    rows = {r["doc_id"]: r for r in divergence.verdicts(feats, divergence.references(feats)).collect()}
    assert all(rows[i]["kept"] for i in range(40))
    assert not rows[40]["kept"] and not rows[41]["kept"]
    assert rows[0]["class_distance"] is None and rows[1]["class_distance"] is None


def test_jensen_shannon_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(divergence.distance(F.col("p"), F.col("q"))).collect()]
    assert got == [0.0, 1.0]


# -- 2: line dedup ----------------------------------------------------------------


def brute_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return lowered if len(lowered) >= min_chars else None

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(spark):
    shared, accented = "  This Line is Shared by many\t", "Éine Zeile, die sich wiederholt Ä"
    rows = [
        (0, f"alpha\n{shared}\nomega"),
        (1, f"{shared.upper()}\n{shared}"),
        (2, f"x\n\n{shared.strip()}\n"),
        (3, accented + "\nshort"),
        (4, accented.replace("Z", "z")),
        (5, accented.replace("Ä", "ä")),
        (6, "short\nshort"),
        (7, None),
        (8, ""),
        (None, f"{shared}\nmine"),
        (9, "this line is only in two documents"),
        (10, "this line is only in two documents"),
        (10, "this line is only in two documents"),
        (11, shared * 1 + "\n" + "x" * 30_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("drop", F.lit(1)).withColumn("n", F.lit(2))
    got = linededup.drop_shared_lines(df)
    assert got.columns == ["doc_id", "text", "drop", "n", "n_lines", "n_dropped", "kept_text"]
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(brute_lines(rows), key=str)


def test_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert linededup.drop_shared_lines(empty).count() == 0
    feats = divergence.features(empty)
    assert divergence.verdicts(feats, divergence.references(feats)).count() == 0
    assert mixing.draw(empty).count() == 0
    assert pii.find(empty, pii.fit(empty)).count() == 0
    assert slackpack.pack(empty, slackpack.Params(TOKENIZER)).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert neighbours.score_documents(empty, labels).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_bundles(warc.archive(pages)).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert balltree.top_k(vectors, F.col("id") % 100 == 0).count() == 0


# -- 3: mixing --------------------------------------------------------------------


def test_raking_meets_the_marginals_of_brute_force(spark):
    rng = np.random.default_rng(0)
    cells = {
        (s, la, t): int(rng.integers(1, 2000))
        for s in ("a", "b", None) for la in ("en", "de") for t in ("general", "legal") if rng.random() < 0.95
    }
    table = spark.createDataFrame(
        [(*k, v, 1) for k, v in cells.items()], "source string, lang string, topic string, tokens bigint, docs bigint"
    )
    params = mixing.Params(targets={"source": {"a": 0.2, "b": 0.5, "absent": 3.0}}, tolerance=1e-9)
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(table, params).collect()}
    total = sum(cells.values())
    shares = [{} for _ in range(3)]
    for k, v in cells.items():
        for d in range(3):
            shares[d][k[d]] = shares[d].get(k[d], 0) + v / total
    wish = [
        {v: {"a": 0.2, "b": 0.5}.get(v, s) for v, s in shares[0].items()},
        {v: s**0.7 for v, s in shares[1].items()},
        {v: s**0.7 for v, s in shares[2].items()},
    ]
    weight = dict.fromkeys(cells, 0.0) | {k: float(v) for k, v in cells.items()}
    for _ in range(500):
        for d in range(3):
            for value, w in wish[d].items():
                now = sum(x for k, x in weight.items() if k[d] == value)
                goal = w / sum(wish[d].values()) * total
                weight = {k: x * goal / now if k[d] == value else x for k, x in weight.items()}
    assert got.keys() == weight.keys()
    for k, w in weight.items():
        assert got[k] == pytest.approx(w, rel=1e-4)


def test_probabilities_meet_the_budget(spark):
    table = spark.createDataFrame(
        [("a", "en", "g", 1000, 9, 300.0), ("b", "en", "g", 100, 3, 700.0), ("c", "en", "g", 0, 1, 0.0)],
        "source string, lang string, topic string, tokens bigint, docs bigint, weight double",
    )
    rows = mixing.probabilities(table, mixing.Params(keep_share=0.5)).collect()
    got = {r["source"]: r["probability"] for r in rows}
    assert got["b"] == 1.0
    assert got["a"] == pytest.approx(0.45)
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(550)


def test_draws_follow_the_probabilities_and_repeat(spark):
    rng = random.Random(5)
    words = vocabulary(6)
    df = documents(spark, [prose(rng, words, 20) for _ in range(600)] + [None, ""], extra="topic")
    df = df.unionByName(df.limit(5))
    got = mixing.draw(df).collect()
    assert len(got) == 607 and {r["topic"] for r in got} == {"general"}
    kept = sum(r["n_tokens"] for r in got if r["drawn"])
    assert kept / sum(r["n_tokens"] for r in got) == pytest.approx(0.75, abs=0.06)
    fate = {}
    for r in got:
        assert fate.setdefault(r["doc_id"], r["drawn"]) == r["drawn"]


# -- 4: personal data -------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


PERSONAL = AWKWARD + [
    "mail a.b@c.de, x@y.z_q@r.st @ a@b and é@x.org +49 (123) 456-789 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41111111111111111111111 000.0001.2.255",
    "😀😀 +1 (168) 555-5254 é 10.0.0.1 +1 2 3 +12345678901234567 ++12 3456 7890",
    "a@b.c@d.e a@-.-.x 1.2.3 4.5.6.7 99999999999999999999.1.1.1 +1((((((",
    "@" * 50 + "a" * 5000 + "@" + "1." * 3000,
    "9" * 20_000 + " " + "1 2-" * 3000,
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(7)
    alphabet = "0123456789" * 3 + ".+@-() ab_%é"
    texts = PERSONAL + ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 400))) for _ in range(150)]
    df = documents(spark, texts, extra="base_")
    rows = {r["doc_id"]: r for r in pii.find(df, pii.Model()).collect()}
    for i, t in enumerate(texts):
        got = [(s["start"], s["rank"], s["kind"], s["end"]) for s in rows[i]["base"]]
        assert got == brute_spans(t), repr(t[:80] if t else t)
        assert rows[i]["added"] == [] and rows[i]["base_"] == "kept as it is"


def test_many_matches_keep_their_places(spark):
    text = "x 10.0.0.1 " * 2500
    row = pii.find(documents(spark, [text]), pii.Model()).first()
    assert [(s["start"], s["end"]) for s in row["base"]] == [(m.start(), m.end()) for m in re.finditer(r"10\.0\.0\.1", text)]


def test_trees_add_secrets_and_leave_clean_texts_alone(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    model = pii.fit(df)
    assert model.trees
    probe = documents(spark, ['my token = "0401e44b4045d5b7fc925af2d5b1396433e9ee50" ok', "chapter 12, page 3: version 2.0"])
    rows = {r["doc_id"]: r for r in pii.find(probe, model).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[0]["added"]] == [("secret", 12, 52)]
    assert rows[1]["added"] == [] and rows[1]["base"] == []
    done = {r["doc_id"]: r["redacted"] for r in pii.redact(probe, model).collect()}
    assert done == {0: 'my token = "[secret]" ok', 1: "chapter 12, page 3: version 2.0"}


# -- 5: packing -------------------------------------------------------------------


def test_word_bpe_equals_the_library():
    library = Tokenizer.from_file(TOKENIZER)
    texts = AWKWARD + PERSONAL[-6:] + ["don't I'll <|endoftext|>x ΣΑΣ İ ½ ²", "a\x1cb 日本 語$$$ THE!!", "É" * 90, "áé"]
    ids, begin = wordbpe.WordBpe(TOKENIZER).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_fill_is_closest_to_capacity():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.randint(5, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        got = slackpack.fill(counts, capacity)
        first = max(counts)
        sums = {first}
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                sums |= {s + n for s in sums if s + n <= capacity}
        assert all(got[n] <= counts[n] for n in got) and got[first] >= 1
        filled = sum(n * c for n, c in got.items())
        assert slackpack.padding(filled, capacity) == min(slackpack.padding(s, capacity) for s in sums)


def test_pieces_hold_every_id_once(spark):
    rng = random.Random(9)
    words = vocabulary(10)
    texts = AWKWARD + [prose(rng, words, rng.choice([1, 5, 50, 400])) for _ in range(60)] + [prose(rng, words, 3000)]
    df = documents(spark, texts, extra="start")
    df = df.unionByName(df.filter("doc_id < 3"))
    p = slackpack.Params(TOKENIZER, capacity=256)
    rows = slackpack.pack(df, p).collect()
    library = Tokenizer.from_file(TOKENIZER)
    pieces, spaces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        spaces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[i]})
        assert len(pieces[i]) == len(mine) * (2 if i < 3 else 1)
        at = 0
        for start, length, crc, total in mine:
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for used in spaces.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(spaces) == list(range(len(spaces)))
    lost = sum(slackpack.padding(sum(n for _, n in used), 256) for used in spaces.values())
    bins = []  # first fit decreasing
    for r in sorted(rows, key=lambda r: -r["length"]):
        room = next((b for b in bins if sum(b) + r["length"] <= 256), None)
        bins.append([r["length"]]) if room is None else room.append(r["length"])
    assert lost <= sum(slackpack.padding(sum(b), 256) for b in bins)


# -- 6: Jaccard join --------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    names = sorted(sets)
    label = {i: i for i in names}
    for a in names:
        for b in names:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in names}


def near_rows(seed):
    rng = random.Random(seed)
    words = vocabulary(12)
    license_ = prose(rng, words, 60)
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    for _ in range(12):
        base = prose(rng, words, rng.choice([6, 30, 80, 700])).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 16])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rows += [(len(rows) + k, license_ + " " + prose(rng, words, rng.randint(4, 20))) for k in range(25)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("x"))
    df = df.unionByName(df.filter("doc_id % 9 = 0"))
    got = jaccard.near_duplicates(df).collect()
    assert len(got) == df.count()
    want = brute_components(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r


def test_tiles_find_every_link_without_the_near_links(spark, monkeypatch):
    rows = near_rows(3)
    monkeypatch.setattr(
        jaccard, "near_pairs", lambda c, turn: c.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    )
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows)
    for p in (jaccard.Params(), jaccard.Params(tile=4)):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, p).collect()} == want


def test_null_ids_take_no_part(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(4, text), (None, text), (9, text)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {(4, 3, 4), (9, 3, 4), (None, 3, None)}
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(df).collect()) == ["4", "None"]


def test_word_hashes_do_not_depend_on_place():
    rng = random.Random(13)
    words = vocabulary(14, 3000)
    texts = [prose(rng, words, 3000) for _ in range(90)]
    data, offsets = flattext.flat(pa.array(texts))
    starts, ends, first = flattext.word_limits(data, offsets)
    seen = {}
    for a, b, h in zip(starts, ends, flattext.word_hashes(data, starts, ends, lower=False).tolist()):
        assert seen.setdefault(bytes(data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.diff(first).tolist() == [3000] * 90


# -- 7: WARC ----------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>" if i % 3 else "x" * (i * 997)) for i in range(40)]
    rows += [(40, None, None), (41, "http://a\r\nb/", ""), (42, "http://é/", "😀"), (None, "u", "<p>1</p>"), (5, "again", "<p>1</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    params = warc.Params(frame_bytes=2000, bundle_bytes=4000)
    index = warc.archive(df, params)
    got = sorted((tuple(r) for r in warc.read_bundles(index).collect()), key=str)
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", -1), i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = i == last[html or ""]
        want.append((i, len(body), digest, "response" if own else "revisit", None if own else last[html or ""]))
    assert got == sorted(want, key=str)
    some = spark.createDataFrame([(7,), (41,), (99,)], "page_id bigint")
    assert sorted(r["page_id"] for r in warc.fetch(index, some).collect()) == [7, 41]
    large = {r["page_id"] for r in warc.read_bundles(warc.archive(df, warc.Params(min_revisit_bytes=10))).collect() if r["record_type"] == "revisit"}
    assert large == set()


# -- 8: URL lists -----------------------------------------------------------------


def test_entries_hold_from_their_date_to_the_next(spark):
    def at(day, second=0.0):
        whole, part = divmod(second, 1)
        return f"2024-01-{day:02d} 00:00:{int(whole):02d}{f'{part:.3f}'[1:]}"

    entries = spark.createDataFrame(
        [
            ("bad", "block", "Example.com", "add", at(2)),
            ("bad", "block", "example.com", "remove", at(5)),
            ("bad", "block", "example.com", "add", at(20)),
            ("ok", "allow", "good.example.com", "add", at(3)),
            ("deep", "block", "other.org/private", "add", at(1)),
            ("tie", "block", "tie.net", "add", at(4)),
            ("tie", "block", "tie.net", "remove", at(4)),
            ("part", "block", "part.net", "add", at(4, 0.5)),
            ("none", "block", None, "add", at(1)),
        ],
        "list_name string, kind string, pattern string, action string, at string",
    ).withColumn("at", F.to_timestamp("at"))
    cases = [
        ("http://example.com/a", at(1, 59), False, ""),
        ("http://example.com/a", at(2), True, "bad"),
        ("http://u:p@A.EXAMPLE.com.:80/a", at(4), True, "bad"),
        ("http://good.example.com/", at(4), False, "bad,ok"),
        ("http://example.com", at(5), False, ""),
        ("http://example.com", at(31), True, "bad"),
        ("http://notexample.com", at(31), False, ""),
        ("https://x.other.org/private/y", at(9), True, "deep"),
        ("https://x.other.org/public", at(9), False, ""),
        ("http://tie.net/", at(9), True, "tie"),
        ("http://part.net/", at(4, 0.2), True, "part"),
        (None, at(9), False, ""),
        ("no url", at(9), False, ""),
        ("http://example.com", None, False, ""),
        ("http://example.com/a", at(2), True, "bad"),
        ("http://" + "a" * 400 + ".com/", at(9), False, ""),
    ]
    df = spark.createDataFrame(
        [(i, u, t, "x") for i, (u, t, _, _) in enumerate(cases)], "k int, url string, fetch_time string, pattern string"
    ).withColumn("fetch_time", F.to_timestamp("fetch_time"))
    for days in (1, 7):
        got = {r["k"]: (r["blocked"], r["lists"]) for r in urllists.judge(df, entries, slice_days=days).collect()}
        assert got == {i: (b, names) for i, (_, _, b, names) in enumerate(cases)}
    assert urllists.judge(df, entries.limit(0)).filter("blocked").count() == 0
    assert urllists.judge(df.limit(0), entries).count() == 0


# -- 9: top-k ---------------------------------------------------------------------


def brute_top(rows, k=10):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(1024 * x) for x in v]
        best[i] = min(best.get(i, whole), whole)
    out = set()
    for q, v in best.items():
        if q % 100 == 0:
            score = {i: sum(a * b for a, b in zip(v, w)) for i, w in best.items() if i != q and len(w) == len(v) and v}
            found = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for i, s in score.items())
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_top_k_matches_brute_force(spark, shard_rows):
    rng = np.random.default_rng(15)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 930)]  # ties
    rows += [(930, None), (931, [1.0, None]), (932, [float("nan")] * 8), (933, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(1000, [0.0] * 8), (1100, [2.0, 1.0]), (1101, [1.0, 1.0]), (1200, []), (1201, []), (200, rows[7][1]), (300, rows[300][1])]
    rows += [(1300, [1e12] * 8), (1301, [-1e12] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    p = balltree.Params(shard_rows=shard_rows, query_block=4, leaf=16)
    got = {tuple(r) for r in balltree.top_k(df, F.col("id") % 100 == 0, p).collect()}
    assert got == brute_top(rows)


# -- 10: quality classifier -------------------------------------------------------


def test_votes_on_held_out_documents(spark, sf_dir):
    folder = f"{sf_dir}/../sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = neighbours.score_documents(docs.withColumn("score", F.lit("old")), labels)
    rows = scored.join(labels, "doc_id").filter(neighbours.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_votes_equal_brute_force(spark):
    rng = random.Random(16)
    words = vocabulary(17)
    good = [prose(rng, words, 40) for _ in range(60)]
    texts = [t if i % 2 else " ".join(w + "$$$" for w in t.split()) for i, t in enumerate(good)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(60, None, 0), (1, 0, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, texts)
    model = neighbours.fit(docs, labels)
    assert len(model.vectors) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60) if i != 1)
    got = {r["doc_id"]: r["score"] for r in neighbours.score_documents(docs, labels).collect()}
    p = neighbours.Params()
    hist = neighbours.histograms(pa.array(texts, pa.string())) * model.weights
    z = hist @ model.axes
    for i, v in enumerate(z):
        norm = float(np.linalg.norm(v))
        cosine = model.vectors @ (v / norm if norm else v)
        near = np.argsort(-cosine)[: p.neighbours]
        w = cosine[near].astype(float).clip(0) ** p.sharpness
        want = ((w * model.labels[near]).sum() + p.prior_weight * model.prior) / (w.sum() + p.prior_weight)
        assert got[i] == pytest.approx(want, abs=1e-3)
    assert got[60] == got[61] == pytest.approx(model.prior)


def test_one_label_or_none_scores_every_document_alike(spark):
    docs = documents(spark, ["some text", None])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in neighbours.score_documents(docs, none).collect()} == {1.0}
    one = spark.createDataFrame([(0, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in neighbours.score_documents(docs, one).collect()} == {0}


# -- the pipeline -----------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline

    folder = f"{sf_dir}/../sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        assert docs.filter("n_chars <> length(text)").count() == 0
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == counts[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_seek_table_is_the_public_format(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "a.warc.zst")
    files, at = fs.FileSystem.from_uri(path)
    writer = warc.BundleWriter(files, at, path, warc.Params(frame_bytes=10))
    for i in range(3):
        writer.add(i, b"record %d" % i * 5)
    writer.close()
    raw = open(path, "rb").read()
    count, flags, magic = int.from_bytes(raw[-9:-5], "little"), raw[-5], int.from_bytes(raw[-4:], "little")
    assert (count, flags, magic) == (3, 0, 0x8F92EAB1)
    reader = warc.BundleReader(path)
    assert [reader.frame(i) for i in (2, 0, 1)] == [b"record %d" % i * 5 for i in (2, 0, 1)]
    reader.close()
    assert json.dumps(writer.index[1][2:]) == "[1, 0, 40]"
