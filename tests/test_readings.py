"""What lets prompts be read cheaply changes no reading, no match and no warning."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import bpe as bp
from glyphmill.operators import lexicon, pairs
from glyphmill.operators import synthesize as sy
from glyphmill.plans import inputs, registry
from glyphmill.sources.grammar import grammar

PIECES = ["A", "Bc", "É", "éa", "a", "if", " ", " ", " ", ".", "?", "!", "-", "'", ",", "\n", "1", "aB", "  "]


def prompts(spark, pieces, n=1500, seed=5):
    rng = random.Random(seed)
    texts = ["", " ", None, "A", "a", " A b", "A B. C d", "A# B c."] + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "key long, prompt string")


def test_every_reading_has_the_form_of_its_prompt(spark):
    df = prompts(spark, PIECES).filter(~F.contains("prompt", F.lit("#")))
    read = sy.candidates(df, 4, 3)
    assert read.filter(F.size("vals") > 0).count() > 500
    masked = F.trim(F.regexp_replace("skeleton", sy._RUNS, sy.HOLE))
    assert read.filter(masked != sy.run_form(F.col("prompt"))).collect() == []


def plain_synthesis(made, kit, shapes):
    """Keys that some reading matches, without any filter on forms."""
    table = sy.skeleton_table(kit.phrases, shapes)
    found = sy.candidates(made, *sy.grammar_bounds(table)).join(table, "skeleton").filter(F.size("holes") == F.size("vals"))
    named = F.arrays_zip(F.col("holes").alias("k"), F.col("vals").alias("v"))
    one = F.size(F.array_distinct(named)) == F.size(F.array_distinct("holes"))
    return {r["key"] for r in found.filter(one).select("key").distinct().collect()}


def test_forms_lose_no_match(spark, kit):
    shapes = grammar(spark)["shapes"]
    drawn = pairs.generate_pairs(spark.range(300).withColumnRenamed("id", "pair_id"), kit)
    whole = drawn.select(F.col("pair_id").alias("key"), "prompt")
    odd = whole.select(
        F.inline(
            F.array(
                F.struct("key", "prompt"),
                F.struct((F.col("key") + 1000).alias("key"), F.concat(F.lit(" "), "prompt", F.lit(" ")).alias("prompt")),
                F.struct((F.col("key") + 2000).alias("key"), F.lower("prompt").alias("prompt")),
                F.struct((F.col("key") + 3000).alias("key"), F.concat("prompt", F.lit(" #")).alias("prompt")),
                F.struct((F.col("key") + 4000).alias("key"), F.initcap("prompt").alias("prompt")),
            )
        )
    )
    found = {r["key"] for r in sy.synthesize(odd, kit.phrases, shapes, "key").collect()}
    assert found == plain_synthesis(odd, kit, shapes)
    assert {r["key"] for r in whole.collect()} <= found


def slow_warning(prompt):
    """The warning word by word."""
    words = F.transform(F.split(tx.strip(prompt), r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[.,:;!?]+|[.,:;!?]+$", ""))
    content = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{L}+$"))
    return (F.size(content) > 0) & (F.size(F.filter(content, lambda w: w.rlike(r"^\p{Lu}"))) < 2)


def test_warnings_are_those_of_single_words(spark):
    df = prompts(spark, [*PIECES, " A", " Bc", " ", " ", "\t", ":", ";"], 4000, 6)
    rows = df.select("prompt", tx.casing_warning(F.col("prompt")).alias("a"), slow_warning(F.col("prompt")).alias("b")).collect()
    assert [r for r in rows if r["a"] != r["b"]] == []
    assert {r["a"] for r in rows} == {True, False, None}


def test_each_pair_is_drawn_once_for_all_its_prompts(spark, sf_dir, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    drawn = inputs.drawn
    monkeypatch.setattr(inputs, "drawn", lambda *a: drawn(*a).withColumn("prompt", counted("prompt")))
    n = inputs.order_ids(spark, sf_dir).count()
    for name in ("unmatched_prompts", "nearest_phrasings"):
        calls.value = 0
        registry.QUERIES[name](spark, sf_dir).count()
        assert calls.value == n, name


def test_leads_leave_out_no_reading_that_matches(spark, kit):
    table = sy.skeleton_table(kit.phrases, grammar(spark)["shapes"])
    leads, bounds = sy.known_leads(table), sy.grammar_bounds(table)
    assert "" in leads and len(leads) > 2
    drawn = pairs.generate_pairs(spark.range(300).withColumnRenamed("id", "pair_id"), kit).select("pair_id", "prompt")
    some, every = sy.candidates(drawn, *bounds, leads=leads), sy.candidates(drawn, *bounds)
    known = lambda df: sorted(map(str, df.join(table.select("skeleton").distinct(), "skeleton").collect()))
    assert known(some) == known(every) and 0 < some.count() < every.count()


def test_words_are_judged_once_distinct(spark):
    rows = spark.range(3000).select(F.lit("object").alias("kind"), F.element_at(F.array(*map(F.lit, ["Cup", "b{d", "Xqz"])), (F.col("id") % 3 + 1).cast("int")).alias("word"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(word):
        calls.add(1)
        return word

    words = lexicon.merge_words(rows)
    assert sorted(r["word"] for r in words.collect()) == ["Cup", "Xqz"]
    assert words.withColumn("again", counted("word")).filter("again = 'Cup'").count() == 1
    assert calls.value == 2
    # No vocabulary: a word costs its bytes and the blank.
    kept = bp.filter_by_cost(rows.distinct(), bp.Bpe(()), 4)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate")
    assert sorted(r["word"] for r in kept.collect()) == ["Cup", "Xqz", "b{d"]
    assert bp.filter_by_cost(rows.distinct(), bp.Bpe(()), 3).count() == 0
