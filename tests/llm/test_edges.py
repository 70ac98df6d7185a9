"""Mixing under its bound, and pipeline stages on awkward tables."""

from __future__ import annotations

import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import TOKENIZER, documents, prose, vocabulary
from tokenizers import Tokenizer

import corpus_pipeline
from glyphmill.llm import jaccard, mixing, wordbpe


def cell_table(spark, rows):
    schema = "source string, lang string, topic string, tokens bigint, docs bigint"
    return spark.createDataFrame([(*r, 1) for r in rows], schema)


def fitted(table, params):
    return mixing.bounded(mixing.probabilities(mixing.rake(table, params), params), params)


def test_the_expected_sample_meets_reachable_targets(spark):
    rng = random.Random(4)
    rows = [(s, la, "g", rng.randint(3000, 9000)) for s in ("b", "c", None) for la in ("en", "de")]
    rows += [("hot", "en", "g", 40_000), ("hot", "de", "g", 30_000)]
    params = mixing.Params(keep_share=0.5)
    cells = fitted(cell_table(spark, rows), params)
    assert cells.filter("probability > 1 or probability < 0").count() == 0
    total = sum(r[3] for r in rows)
    kept = cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert kept == pytest.approx(0.5 * total, rel=0.01)
    shares = mixing.marginals(cells, params).collect()
    assert {r["dimension"] for r in shares} == set(mixing.DIMENSIONS)
    for r in shares:
        assert r["expected"] == pytest.approx(r["reachable"], rel=0.01), r


def test_one_task_and_joins_give_the_same_probabilities(spark):
    rng = random.Random(5)
    rows = [(s, la, t, rng.randint(0, 900)) for s in ("b", "c", None) for la in ("en", "de") for t in ("g", "t")]
    rated = cell_table(spark, rows).withColumn("probability", F.lit(0.5))
    params = mixing.Params(targets={"source": {"b": 0.6, None: 0.2}, "lang": {"en": 0.4}}, bounded_sweeps=3)
    by_task, by_joins = (
        {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing.bounded(rated, q).collect()}
        for q in (params, replace(params, cells_in_task=0))
    )
    assert by_task.keys() == by_joins.keys()
    for k, p in by_task.items():
        assert p == pytest.approx(by_joins[k], rel=1e-9), k


def test_one_task_and_joins_give_the_same_weights(spark):
    rng = random.Random(6)
    rows = [(s, la, t, rng.randint(0, 900)) for s in ("b", "c", None) for la in ("en", "de") for t in ("g", "t")]
    rows.append(("empty", "en", "g", 0))
    cells = cell_table(spark, rows)
    params = mixing.Params(targets={"source": {"b": 0.6, None: 0.2}, "lang": {"en": 0.4}}, max_sweeps=4)
    by_task, by_joins = (
        {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(cells, q).collect()}
        for q in (params, replace(params, cells_in_task=0))
    )
    assert by_task.keys() == by_joins.keys()
    for k, w in by_task.items():
        assert w == pytest.approx(by_joins[k], rel=1e-9), k


def test_counted_cells_are_raked_without_a_job_for_every_sum(spark):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("one two @ "), F.col("id").cast("string")).alias("text"),
        F.concat(F.lit("l"), F.col("id") % 3).alias("lang"),
        F.concat(F.lit("s"), F.col("id") % 5).alias("source"),
    )
    spark.sparkContext.setJobGroup("raking", "")
    assert mixing.draw(docs).count() == 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("raking")) < 40


def test_a_rare_value_gives_all_it_has_and_its_gap_is_told(spark):
    rows = [("big", "en", "g", 9000), ("rare", "en", "g", 100)]
    params = mixing.Params(targets={"source": {"big": 0.5, "rare": 0.5}}, keep_share=0.5)
    cells = fitted(cell_table(spark, rows), params)
    got = {r["source"]: r["probability"] for r in cells.collect()}
    assert got["rare"] == pytest.approx(1.0)
    assert got["big"] * 9000 + 100 == pytest.approx(0.5 * 9100, rel=0.01)
    rare = next(r for r in mixing.marginals(cells, params).collect() if r["value"] == "rare")
    assert rare["target"] == pytest.approx(0.5) and rare["reachable"] == pytest.approx(100 / 4550, rel=0.01)


def test_exact_targets_are_met_where_they_can_be(spark):
    rows = [("a", "en", "g", 6000), ("b", "en", "g", 4000), ("a", "de", "g", 3000), ("b", "de", "g", 5000)]
    params = mixing.Params(targets={"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "de": 0.5}}, keep_share=0.5)
    for r in mixing.marginals(fitted(cell_table(spark, rows), params), params).collect():
        assert r["expected"] == pytest.approx(r["target"], rel=0.01)


def test_a_draw_is_what_its_probabilities_say(spark):
    rng = random.Random(8)
    words = vocabulary(9)
    docs = documents(spark, [prose(rng, words, 20) for _ in range(300)] + [None, "", " "])
    params = mixing.Params(targets={"source": {"src0": 0.6, "src1": 0.2, "src2": 0.2}})
    rows = mixing.draw(docs, params).collect()
    chance = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing.chances(docs, params).collect()}
    assert len(rows) == 303
    for r in rows:
        assert r["probability"] == pytest.approx(chance[r["source"], r["lang"], r["topic"]], rel=1e-6)
    share = sum(r["n_tokens"] for r in rows if r["drawn"] and r["source"] == "src0") / sum(r["n_tokens"] for r in rows if r["drawn"])
    assert share == pytest.approx(100 / 225, abs=0.06)


CLASHING = ("topic", "probability", "drawn", "n_tokens", "n_lines", "n_dropped", "kept_text", "row", "score", "key", "set_key")


@pytest.mark.parametrize("stage", range(1, 4))
def test_stages_keep_clashing_columns_nulls_and_repeated_rows(spark, sf_dir, stage):
    line = "a line that many documents share, word for word"
    texts = [None, "", f"{line}\none own line of the first", f"{line}\nanother own line here", line, "x " * 3000]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, sf_dir)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)
    if run is not corpus_pipeline.keep_one_of_each:  # its empty table is a test of the operator
        assert run(spark, docs.limit(0), sf_dir).count() == 0


def test_one_row_of_each_component_stays(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, long), (2, long), (2, "quite another text of seven words here"), (3, ""), (3, ""), (3, None), (None, long)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([(1, long), (2, "quite another text of seven words here"), (3, ""), (0, long)])


def test_the_store_of_words_begins_anew_when_full(monkeypatch):
    rng = random.Random(1)
    words = vocabulary(2, 300) + ["it's", "x9!", "É", "a|b", "..."]
    texts = [prose(rng, words, 60) for _ in range(40)]
    library = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(wordbpe, "_KEPT_WORDS", 100)
    bpe = wordbpe.WordBpe(TOKENIZER)
    for a in range(0, 40, 5):
        ids, begin = bpe.encode(pa.array(texts[a : a + 5] + [None]))
        for k, t in enumerate(texts[a : a + 5]):
            assert ids[begin[k] : begin[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        assert begin[-1] == begin[-2] == len(ids)
