"""Queries on the vocabulary of full size, which SQL cannot repeat."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from test_bpe import library
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__ as driver
from glyphmill.functions import bytelevel as bl
from glyphmill.operators import bpe as bp
from glyphmill.operators import instruct, pairs
from glyphmill.plans import inputs
from glyphmill.plans.registry import DECLARED_VOCABULARY, FULL


def one_by_one(freq, wanted):
    """All pairs are counted anew before each merge."""
    first = [bl.FIRST_BYTE + o for o in bl.byte_offsets()]
    words = [([first[b] for b in w.encode()], n) for w, n in freq]
    merges = []
    while len(merges) < wanted:
        counts = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:]):
                counts[p] += n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        new = bl.FIRST_MERGE + len(merges)
        merges.append(best)
        for k, (ids, n) in enumerate(words):
            out = []
            for x in ids:
                if out and (out[-1], x) == best:
                    out[-1] = new
                else:
                    out.append(x)
            words[k] = (out, n)
    return tuple(merges)


@pytest.mark.parametrize("seed", [1, 2])
def test_training_by_rounds_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    words = {"aaaaaaa", "aaaa", "abababa", "x", "Ġé", "漢字漢字"}
    words |= {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)}
    freq = [(w, rng.randint(1, 4)) for w in sorted(words)]
    df = spark.createDataFrame(freq, "pretoken string, n bigint")
    want = one_by_one(freq, 10_000)
    assert bp.train_bpe(df, bl.FIRST_MERGE + 10_000).merges == want
    assert bp.train_bpe(df, bl.FIRST_MERGE + 10_000, pairs=40, most_runs=30).merges == want
    assert bp.train_bpe(df, bl.FIRST_MERGE + 30, pairs=2).merges == want[:30]


def test_full_vocabulary_is_that_of_the_library_over_the_mixed_corpus(spark, sf_dir):
    kit = pairs.build_kit(inputs.lexicon_words(spark, sf_dir), inputs.grammar(spark))
    made = pairs.generate_pairs(inputs.order_ids(spark, sf_dir), kit)
    mixed = pairs.mixed_corpus(pairs.tokenizer_lines(kit.pool, made), inputs.documents(spark, sf_dir))
    lib = library([r["text"] for r in mixed.select("text").collect()], bp.VOCAB_SIZE).get_vocab()
    rows = driver.queries()["vocab_tables"](spark, sf_dir).collect()
    assert {r["token"]: r["id"] for r in rows} == lib
    rules = driver.queries()["bpe_train"](spark, sf_dir).orderBy("rank").collect()
    assert [r["rank"] for r in rules] == list(range(len(lib) - bl.FIRST_MERGE))
    assert all(r["merged"] == r["left_token"] + r["right_token"] and r["merged"] in lib for r in rules)


def test_queries_use_the_vocabulary_of_the_library(spark, sf_dir):
    bpe = inputs.vocabulary(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in inputs.documents(spark, sf_dir).collect()}
    lib = Tokenizer(models.BPE.from_file(*library_files(bpe)))
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    ids = {r["doc_id"]: r["ids"] for r in inputs.token_table(spark, sf_dir).collect()}
    assert ids == {k: lib.encode(t).ids + [bl.EOT] for k, t in texts.items()}
    row = driver.queries()["vocab_bounds_check"](spark, sf_dir).first()
    assert row["tokenizer_size"] <= DECLARED_VOCABULARY and row["verdict"] != "error"

    costs = lambda words: {w: len(lib.encode(" " + w).ids) for w in words}
    words = {r["word"] for r in inputs.document_words(spark, sf_dir).collect()}
    kept = {r["word"] for r in driver.queries()["lexicon_token_cost_filter"](spark, sf_dir).collect()}
    assert kept == {w for w, n in costs(words).items() if n <= 2} and kept != words

    fit = {(r["kind"], r["cost"]): r["n_words"] for r in driver.queries()["cheap_costly_words"](spark, sf_dir).collect()}
    listed = [(r["kind"], r["word"]) for r in inputs.lexicon_words(spark, sf_dir).collect()] + [("corpus", w) for w in words]
    cost = costs({w for _, w in listed})
    assert fit == Counter((k, cost[w]) for k, w in listed)
    cheap = sorted((k, w) for k, w in listed if cost[w] <= 2)
    want = [f"{cheap[k][1]} {cheap[-1 - k][1]}" for k in range(min(6, len(cheap) // 2))]
    pairs_ = driver.queries()["cheap_word_pairs"](spark, sf_dir).orderBy("k").collect()
    assert [(r["label"], r["cost"]) for r in pairs_] == [(w, len(lib.encode(" " + w).ids)) for w in want]
    report = {r["grp"]: (r["n_probes"], r["max_cost"]) for r in driver.queries()["token_cost_report"](spark, sf_dir).collect()}
    assert report["corpus"] == (len(words), max(costs(words).values()))


def library_files(bpe):
    """The rules in the library's own file format."""
    import json
    import tempfile

    tokens = bpe.tokens()
    folder = tempfile.mkdtemp()
    with open(f"{folder}/vocab.json", "w") as f:
        json.dump({t: k for k, t in enumerate(tokens)}, f)
    with open(f"{folder}/merges.txt", "w") as f:
        f.write("\n".join(f"{tokens[a]} {tokens[b]}" for a, b in bpe.merges))
    return f"{folder}/vocab.json", f"{folder}/merges.txt"


def plain_examples(spark, sf_dir):
    examples = instruct.encode_pairs(inputs.distinct(spark, sf_dir), inputs.vocabulary(spark, sf_dir))
    return {r["pair_id"]: r for r in examples.select("pair_id", "n", "y").collect()}


def test_padding_and_scored_shares_match_plain_sums(spark, sf_dir):
    rows = plain_examples(spark, sf_dir)
    order = sorted(rows, key=lambda k: (hashlib.md5(f"7|{k}|batch".encode()).hexdigest(), k))
    batches = [[rows[k]["n"] for k in order[a : a + 32]] for a in range(0, len(order), 32)]
    got = driver.queries()["padding_waste_report"](spark, sf_dir).first()
    assert got["n_batches"] == len(batches)
    assert got["used_cells"] == sum(map(sum, batches))
    assert got["dynamic_cells"] == sum(len(b) * max(b) for b in batches)
    share = driver.queries()["scored_token_share"](spark, sf_dir).first()
    assert share["n_targets"] == sum(r["n"] for r in rows.values())
    assert share["n_scored"] == sum(sum(t >= 0 for t in r["y"]) for r in rows.values())


def test_full_kit_takes_cheap_words_and_fragments_of_the_vocabulary(spark, sf_dir):
    with inputs.full_size():
        kit, bpe = inputs.kit(spark, sf_dir), inputs.vocabulary(spark, sf_dir)
    shown = (t.replace("Ġ", "") for t in bpe.tokens()[bl.FIRST_BYTE :])
    assert set(kit.fragments) == {t.lower() for t in shown if t.isalpha() and 2 <= len(t) <= 9}
    assert kit.fragments != inputs.kit(spark, sf_dir).fragments
    words = inputs.lexicon_words(spark, sf_dir)
    cheap = {r["word"] for r in bp.filter_by_cost(words, bpe).collect()}
    values = {r["value"] for r in driver.queries()["full_label_pools"](spark, sf_dir).collect()}
    assert {w for v in values for w in v.split(" ")} == cheap
    assert {r["value"] for r in kit.pool.select("value").collect()} == values
    # A costly word leaves the pools.
    costly = words.limit(0).union(spark.createDataFrame([("object", "Xqzjvwkqxz"), ("object", "Cup")], words.schema))
    assert {r["word"] for r in bp.filter_by_cost(costly, bpe).collect()} <= {"Cup"}
    spans = driver.queries()["full_novel_spans"](spark, sf_dir).collect()
    assert spans and spans != driver.queries()["novel_spans"](spark, sf_dir).collect()
    made = driver.queries()["full_generate_pairs"](spark, sf_dir)
    assert made.filter("novel").count() > 0
