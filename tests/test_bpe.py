"""Training, encoding and decoding against the tokenizers library (tests only)."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

from glyphmill.functions import bytelevel as bl
from glyphmill.operators import bpe as bp
from glyphmill.operators import training
from glyphmill.session import work_path
from glyphmill.sources import stores

N_MERGES = 120


def library(texts, size):
    tok = Tokenizer(models.BPE(unk_token="<|unk|>"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=size,
        special_tokens=list(bl.SPECIAL_TOKENS),
        initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        show_progress=False,
    )
    tok.train_from_iterator(texts, trainer=trainer)
    return tok


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def trained(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    freq = bp.pretoken_frequencies(docs).cache()
    return bp.train_bpe(freq, bl.FIRST_MERGE + N_MERGES), library(texts, bl.FIRST_MERGE + N_MERGES), freq


def ids_of(spark, bpe, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(3)
    return [r["ids"] for r in df.select("i", bp.encode(F.col("text"), bpe).alias("ids")).orderBy("i").collect()]


ODD_TEXTS = [
    "",
    " ",
    "\n   \n\t x",
    "graph TD\n    A[Wash Cup] --> B{Door Open}\n",
    "it's we'll I'VE 'tis 12345 6,7",
    "naïve façade Straße 漢字 🙂🙂 é  b c  ",
    "aaaaaaa aaa aa a",
    "the the  the   the",
]


def test_vocabulary_equals_library(trained):
    bpe, lib, _ = trained
    vocab = lib.get_vocab()
    assert bpe.tokens() == [t for t, _ in sorted(vocab.items(), key=lambda kv: kv[1])]


def test_one_by_one_training_gives_the_same_merges(trained):
    bpe, _, freq = trained
    assert bp.train_bpe(freq, bl.FIRST_MERGE + 30, pairs=1).merges == bpe.merges[:30]
    assert bp.train_bpe(freq, bl.FIRST_MERGE + 60, pairs=500, most_runs=20).merges == bpe.merges[:60]


def test_training_with_ties_and_repeats(spark):
    words = ["aaaa", "aaab", "abab", "baba", "cdcd", "dcdc", "abcabc", "xyz", "zyx", "xyxyxy"]
    rng = random.Random(3)
    corpus = [w for w in words for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame([(w, corpus.count(w)) for w in set(corpus)], "pretoken string, n long")
    for size in (5, 12, 40):
        bpe = bp.train_bpe(df, bl.FIRST_MERGE + size)
        lib = library(corpus, bl.FIRST_MERGE + size)
        assert bpe.tokens() == [t for t, _ in sorted(lib.get_vocab().items(), key=lambda kv: kv[1])]


def test_encoding_equals_library(spark, trained, texts):
    bpe, lib, _ = trained
    sample = texts + ODD_TEXTS
    assert ids_of(spark, bpe, sample) == [lib.encode(t).ids for t in sample]


def test_null_text_stays_null(spark, trained):
    assert ids_of(spark, trained[0], ["ab", None, "", None])[1::2] == [None, None]


def test_decode_returns_the_text(spark, trained):
    bpe = trained[0]
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string")
    back = df.select("text", bp.decode(bp.encode(F.col("text"), bpe), bpe).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)


def test_decode_drops_or_shows_specials(spark, trained):
    bpe = trained[0]
    ids = [bl.DIAGRAM] + trained[1].encode("the cat").ids + [bl.EOT]
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    row = df.select(
        bp.decode(F.col("ids"), bpe).alias("a"), bp.decode(F.col("ids"), bpe, skip_special=False).alias("b")
    ).first()
    assert row["a"] == "the cat"
    assert row["b"] == "<|mermaid|>the cat<|endoftext|>"


def test_cut_inside_a_character_decodes_to_a_replacement(spark):
    df = spark.createDataFrame([("é",)], "text string")
    bpe = bp.Bpe(())
    cut = df.select(bp.decode(F.slice(bp.encode(F.col("text"), bpe), 1, 1), bpe).alias("t")).first()
    assert cut["t"] == "�"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=30))
def test_round_trip_of_any_text(spark, trained, texts):
    clean = [t.encode("utf-8", "ignore").decode() for t in texts]
    bpe, lib, _ = trained
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "i long, text string")
    ids = bp.encode(F.col("text"), bpe)
    rows = df.select("i", ids.alias("ids"), bp.decode(ids, bpe).alias("back")).orderBy("i").collect()
    assert [r["back"] for r in rows] == clean
    assert [r["ids"] for r in rows] == [lib.encode(t).ids for t in clean]


def test_saved_vocabulary_reads_back(spark, trained):
    bpe = trained[0]
    path = work_path(spark, "vocab")
    stores.write_vocab(*bp.vocab_tables(spark, bpe), path)
    assert bp.bpe_from_tables(*stores.read_vocab(spark, path)) == bpe


def test_token_strings(spark, trained):
    bpe, lib, _ = trained
    df = spark.createDataFrame([("the other é",)], "text string")
    shown = df.select(bp.token_strings(bp.encode(F.col("text"), bpe), bpe).alias("t")).first()["t"]
    assert shown == lib.encode("the other é").tokens


def test_independent_prefix_stops_at_the_first_conflict():
    assert training.independent_prefix([(1, 2), (3, 4), (2, 5), (6, 7)], 9) == [(1, 2), (3, 4)]
    assert training.independent_prefix([(1, 2), (3, 1)], 9) == [(1, 2)]
    assert training.independent_prefix([(1, 2), (1, 3), (4, 2)], 2) == [(1, 2), (1, 3)]
    assert training.independent_prefix([(1, 1), (1, 2)], 9) == [(1, 1)]


def test_check_vocab(spark):
    blocks = spark.createDataFrame([([1, 2, 300],)], "tokens array<int>")
    verdict = lambda size, declared: bp.check_vocab(blocks, size, declared).first()["verdict"]
    assert verdict(400, 8192) == "unused_rows"
    assert verdict(8192, 8192) == "ok"
    assert verdict(400, 350) == "error"
    assert verdict(250, 300) == "error"


def test_prefix_audit_sees_the_blank_that_moves(spark, trained):
    df = spark.createDataFrame([("x ", "x and"), ("x", "x and")], "prefix string, full string")
    got = {r["prefix"]: r["agrees"] for r in bp.prefix_audit(df, trained[0]).collect()}
    assert got == {"x ": False, "x": True}


def test_cheap_pairs_needs_four_words(spark, trained):
    few = spark.createDataFrame([("k", w) for w in "abc"], "kind string, word string")
    assert bp.cheap_pairs(bp.vocab_fit(few, trained[0]), trained[0]).count() == 0
    five = spark.createDataFrame([("k", w) for w in "abcde"], "kind string, word string")
    rows = bp.cheap_pairs(bp.vocab_fit(five, trained[0]), trained[0]).orderBy("k").collect()
    assert [(r["k"], r["label"]) for r in rows] == [(1, "a e"), (2, "b d")]


def test_word_report_names_every_word_and_what_all_come_to(spark, trained):
    words = [("a", "the"), ("a", "Xqzjvwkqxz"), ("b", "the"), ("b", "Zzyqx"), ("b", "e"), ("c", "Qqqqqq")]
    fit = bp.vocab_fit(spark.createDataFrame(words, "kind string, word string"), trained[0])
    cost = {(r["kind"], r["word"]): r["cost"] for r in fit.collect()}
    rows = bp.vocab_fit_report(fit).collect()
    assert {(r["kind"], r["word"]): (r["cost"], r["cheap"]) for r in rows} == {k: (n, n <= 2) for k, n in cost.items()}
    costly = {k for k, n in cost.items() if n > 2}
    assert len(rows) == len(words) and 0 < len(costly) < len(words)
    for r in rows:
        own = [n for (kind, _), n in cost.items() if kind == r["kind"]]
        assert r["n_words"] == own.count(r["cost"])
        assert r["cheap_share"] == round(sum(n <= 2 for n in own) / len(own), 6)
        assert r["all_at_cost"] == list(cost.values()).count(r["cost"])
        assert (r["all_cheap"], r["all_costly"]) == (len(words) - len(costly), len(costly))
        assert r["all_cheap_share"] == round(1 - len(costly) / len(words), 6)
    assert bp.vocab_fit_report(fit.limit(0)).collect() == []


def plain_merge(ids, ranks):
    """One merge at a time: the lowest-ranked pair, leftmost first."""
    while True:
        found = min(((ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
        if found is None:
            return ids
        rank, i = found
        ids = ids[:i] + [bl.FIRST_MERGE + rank] + ids[i + 2 :]


@given(st.lists(st.integers(7, 10), max_size=40), st.integers(0, 2**31))
@settings(max_examples=200, deadline=None)
def test_heap_merges_like_one_at_a_time(ids, seed):
    rng = random.Random(seed)
    symbols, ranks = [7, 8, 9, 10], {}
    for rank in range(12):
        ranks.setdefault((rng.choice(symbols), rng.choice(symbols)), len(ranks))
        symbols.append(bl.FIRST_MERGE + len(ranks) - 1)
    assert bp._merge_word(list(ids), ranks) == plain_merge(list(ids), ranks)


def test_a_long_pretoken_takes_no_time():
    import time

    rng = random.Random(3)
    symbols, ranks = list(range(7, 40)), {}
    while len(ranks) < 3000:
        ranks.setdefault((rng.choice(symbols), rng.choice(symbols)), len(ranks))
        symbols.append(bl.FIRST_MERGE + len(ranks) - 1)
    begun = time.process_time()
    bp._merge_word([rng.randrange(7, 40) for _ in range(100_000)], ranks)
    assert time.process_time() - begun < 3


def test_vocabulary_tables_are_read_whole_or_not_at_all(spark):
    rules = bp.Bpe(((7, 8), (9, 10), (11, 12)))
    vocab, merges = bp.vocab_tables(spark, rules)
    assert bp.bpe_from_tables(vocab, merges) == rules
    with pytest.raises(ValueError, match="ceiling"):
        bp.bpe_from_tables(vocab, merges, ceiling=3)
    with pytest.raises(ValueError, match="ranks"):
        bp.bpe_from_tables(vocab, merges.filter("rank <> 1"))


def test_an_unfinished_shard_folder_is_written_again(spark):
    path = work_path(spark, "shards")
    blocks = spark.createDataFrame([(0, [1, 2], "train")], "block_id long, tokens array<int>, split string")
    blocks.filter("block_id < 0").write.partitionBy("split").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(path)
    stores.write_blocks(blocks, path)
    assert stores.read_blocks(spark, path).count() == 1
    stores.write_blocks(blocks.limit(0), path)
    assert stores.read_blocks(spark, path).count() == 1


def test_pair_totals_equal_a_count_of_symbols(spark, sf_dir):
    freq = bp.pretoken_frequencies(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40))
    whole = {(r["left"], r["right"]): r["n"] for r in bp.pair_counts(bp.symbol_table(freq)).collect()}
    found = {training._pair(r["pair"]): r["n"] for r in training.pair_totals(training.coded(freq)).collect()}
    assert found == whole


def rows_of(df):
    return sorted((np.frombuffer(r["ids"], np.int32).tolist(), r["n"]) for r in df.collect())


def table_of(spark, rows):
    coded = [(np.array(ids, np.int32).tobytes(), n) for ids, n in rows]
    return spark.createDataFrame(coded, "ids binary, n bigint").repartition(2)


def test_runs_are_the_longest_stretches_of_taken_pairs(spark):
    table = table_of(spark, [([1, 2, 3, 9, 1, 2], 5), ([9, 9], 1), ([2, 3, 1], 2), ([1, 2], 4)])
    taken = [(1 << 32) | 2, (2 << 32) | 3]
    assert rows_of(training.runs_of(table, taken)) == [([1, 2], 9), ([1, 2, 3], 5), ([2, 3], 2)]


def test_a_rewrite_merges_leftmost_first_and_drops_single_symbols(spark):
    table = table_of(spark, [([5, 5, 5, 5, 5], 1), ([5, 5], 2), ([6, 5, 5, 6], 3), ([7, 8], 4)])
    merged = training.merged(table, [(5, 5), (300, 300)], 300)
    assert rows_of(merged) == [([6, 300, 6], 3), ([7, 8], 4), ([301, 5], 1)]


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=2, max_size=9), st.integers(1, 5)), min_size=1, max_size=25), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_runs_decide_the_next_merges_like_whole_words(words, taken):
    """The replay over runs of the top pairs equals that over whole words, down to the best pair left out."""
    counts = Counter(p for ids, n in words for p in zip(ids, ids[1:]) for _ in range(n))
    ranked = sorted(counts, key=lambda p: (-counts[p], p))
    above = counts[ranked[taken]] if len(ranked) > taken else 0
    kept = {p for p in ranked if counts[p] > above}
    runs = Counter()
    for ids, n in words:
        run = ids[:1]
        for a, b in zip(ids, ids[1:]):
            if (a, b) in kept:
                run.append(b)
            else:
                runs[tuple(run)] += n
                run = [b]
        runs[tuple(run)] += n
    found = training.replay(list(runs.items()), 99, 100, above)
    assert found == training.replay(words, len(found), 100)
    assert found or not kept


def test_special_tokens_inside_a_text_are_one_id_each(spark, trained):
    bpe, lib, _ = trained
    names = bl.SPECIAL_TOKENS
    texts = ["".join(names), " ".join(names), "a" + "b  ".join(names) + " c", "x!!<|endoftext|>!!", "<|end|> <|endoftext| <|pad|>>", "<<|pad|>|>"]
    assert ids_of(spark, bpe, texts) == [lib.encode(t).ids for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = bp.encode(F.col("text"), bpe, specials=False)
    rows = df.select("text", plain.alias("ids"), bp.decode(plain, bpe).alias("back")).collect()
    assert all(r["back"] == r["text"] and min(r["ids"]) >= bl.FIRST_BYTE for r in rows)
    shown = df.select("text", bp.decode(bp.encode(F.col("text"), bpe), bpe, skip_special=False).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in shown)
