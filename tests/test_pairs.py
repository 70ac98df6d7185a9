"""Lexicon, grammar and pair generation."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import draw
from glyphmill.functions import text as tx
from glyphmill.operators import lexicon, pairs, paraphrase
from glyphmill.session import work_path
from glyphmill.sources import grammar as g
from glyphmill.sources import stores
from glyphmill.streaming import jobs


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(3000).withColumnRenamed("id", "pair_id")


def test_expansion_of_a_small_grammar(spark):
    frames = spark.createDataFrame(
        [("s", 0, "{UP} {act_1}{END}."), ("s", 1, "only {act_1}."), ("t", 0, "{UP}  x{END} .")], g.FRAMES
    )
    options = spark.createDataFrame(
        [("s", "UP", "Go"), ("s", "UP", "Run"), ("s", "END", ""), ("s", "END", ","), ("t", "UP", "No"), ("t", "END", "")],
        g.CONNECTIVES,
    )
    got = {(r["shape"], r["paraphrase"]) for r in paraphrase.expand(frames, options).collect()}
    assert got == {("s", "Go {act_1}."), ("s", "Run {act_1}."), ("s", "only {act_1}."), ("t", "No x.")}


def test_expansion_has_one_form_per_choice_of_options(spark):
    tables = g.grammar(spark)
    found = {r["shape"]: r["count"] for r in paraphrase.expand(tables["frames"], tables["connectives"]).groupBy("shape").count().collect()}
    for shape, frames in g.packaged("frames").items():
        options = g.packaged("connectives")[shape]
        forms = [math.prod(len(o) for k, o in options.items() if "{" + k + "}" in f) for f in frames]
        assert found[shape] == sum(forms)


def test_a_key_used_twice_takes_one_option(spark):
    frames = spark.createDataFrame([("s", 0, "{A} x {A} {B}")], g.FRAMES)
    options = spark.createDataFrame([("s", "A", "1"), ("s", "A", "2"), ("s", "B", ",")], g.CONNECTIVES)
    got = sorted(r["paraphrase"] for r in paraphrase.expand(frames, options).collect())
    assert got == ["1 x 1,", "2 x 2,"]


def test_no_skeleton_belongs_to_two_shapes(kit):
    assert paraphrase.ambiguity(kit.phrases).count() == 0


def test_ambiguity_is_reported(spark):
    df = spark.createDataFrame([("a", "Do {act_1}."), ("b", "Do {act_2}."), ("b", "On {act_1}.")], "shape string, paraphrase string")
    assert [r["skeleton"] for r in paraphrase.ambiguity(df).collect()] == ["Do #."]


@pytest.mark.parametrize("n", [1, 2, 6, 7, 13, 100])
def test_split_shares_are_exact(spark, n):
    pool = spark.createDataFrame([("act", f"v{i}") for i in range(n)], "category string, value string")
    rows = lexicon.split_pools(pool).collect()
    val = sorted(r["idx"] for r in rows if r["split"] == "val")
    train = sorted(r["idx"] for r in rows if r["split"] == "train")
    assert val == list(range(max(1, int(n * 0.15))))
    assert train == list(range(n - len(val)))


def test_closed_categories_are_shared(kit):
    sides = kit.pool.filter("category = 'label'").groupBy("split").agg(F.sort_array(F.collect_set("value")).alias("v"))
    values = [r["v"] for r in sides.collect()]
    assert len(values) == 2 and values[0] == values[1]


def test_lexicon_bounds(spark):
    few = spark.createDataFrame([("action", "Add")], g.WORDS)
    with pytest.raises(ValueError, match="too few"):
        lexicon.require_words(few)
    words = g.grammar(spark)["words"]


def test_slot_values_of_a_sample_differ(kit, ids):
    drawn = pairs.draw_pairs(pairs.split_keys(ids), kit).filter(~F.col("novel"))
    open_values = F.filter(F.map_entries("slots"), lambda e: ~e["key"].startswith("label"))
    twice = drawn.filter(F.size(open_values) != F.size(F.array_distinct(F.transform(open_values, lambda e: e["value"]))))
    assert twice.count() == 0


def test_values_come_from_the_wanted_side(kit, ids):
    drawn = pairs.draw_pairs(pairs.split_keys(ids), kit).filter(~F.col("novel"))
    slots = drawn.select("split", F.explode("slots").alias("slot", "value")).withColumn(
        "category", tx.slot_category(F.col("slot"))
    )
    assert slots.join(kit.pool, ["category", "split", "value"], "left_anti").count() == 0


@pytest.fixture(scope="module")
def large_kit(spark):
    """A pool of well over 100,000 values."""
    tables = g.grammar(spark)
    letters = F.split(F.lit("b,c,d,f,g,h,j,k,l,m"), ",")
    word = F.concat(*[F.element_at(letters, (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int")) for k in range(3)])
    words = spark.range(450).select(
        F.element_at(F.split(F.lit("action,object,condition"), ","), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        F.initcap(F.concat(word, F.lit("a"))).alias("word"),
    )
    labels = spark.createDataFrame([("label", w) for w in "Alpha Beta Gamma Delta Omega Sigma Kappa Theta".split()], g.WORDS)
    words = words.unionByName(labels).unionByName(words.withColumn("word", F.concat("word", F.lit("o"))))
    kit = pairs.build_kit(words, tables)
    assert sum(kit.pool_sizes.values()) > 100_000
    return kit


def test_a_large_pool_serves_batch_and_repeated_keys(spark, large_kit, ids):
    keys = pairs.split_keys(ids)
    once = pairs.draw_pairs(keys, large_kit).select("pair_id", "prompt", "diagram").cache()
    assert once.count() == 3000 and once.filter(F.col("diagram").contains("{act")).count() == 0
    twice = pairs.draw_pairs(keys.unionByName(keys), large_kit).select("pair_id", "prompt", "diagram")
    assert twice.count() == 6000 and twice.distinct().exceptAll(once).count() == 0


def test_a_large_pool_serves_a_stream(spark, large_kit):
    path = work_path(spark, "keys")
    spark.range(500).withColumnRenamed("id", "pair_id").write.parquet(path)
    stream = spark.readStream.schema("pair_id bigint").parquet(path)
    made = pairs.draw_pairs(pairs.split_keys(stream), large_kit).select("pair_id", "prompt")
    query = made.writeStream.format("memory").queryName("large_pool").trigger(availableNow=True).start()
    query.awaitTermination()
    want = pairs.draw_pairs(pairs.split_keys(spark.read.parquet(path)), large_kit).select("pair_id", "prompt")
    assert spark.table("large_pool").count() == 500 and want.exceptAll(spark.table("large_pool")).count() == 0


def test_partitioning_does_not_change_a_pair(kit, ids):
    a = pairs.generate_pairs(ids.repartition(1), kit).drop("slots")
    b = pairs.generate_pairs(ids.repartition(17), kit).drop("slots")
    assert a.exceptAll(b).count() == 0


def test_copies_are_dropped_and_the_first_kept(spark, kit, ids):
    drawn = pairs.draw_pairs(pairs.split_keys(ids.limit(50)), kit)
    # One pair holds a third of all rows.
    one = drawn.orderBy("pair_id").limit(1)
    copies = one.drop("pair_id").join(spark.range(1000, 1500).withColumnRenamed("id", "pair_id"))
    both = drawn.unionByName(copies)
    got = pairs.distinct_pairs(both)
    assert got.count() == drawn.select("split", "prompt", "diagram").distinct().count()
    assert got.filter("pair_id >= 1000").count() == 0


def test_novel_shares(kit, spark):
    keys = pairs.split_keys(spark.range(20_000).withColumnRenamed("id", "pair_id"))
    shares = {r["split"]: r["s"] for r in keys.groupBy("split").agg(F.avg(F.col("novel").cast("int")).alias("s")).collect()}
    assert shares["train"] == 0 and 0.45 < shares["val"] < 0.55


def test_novel_spans_have_the_right_form(kit, ids):
    spans = ids.select(pairs.novel_value(F.col("pair_id"), F.lit("act_1"), kit.fragments).alias("v"))
    values = [r["v"] for r in spans.collect()]
    assert all(re.fullmatch(r"[A-Z][a-z]{1,13}( [A-Z][a-z]{1,13})?", v) for v in values)
    two = sum(" " in v for v in values) / len(values)
    assert 0.62 < two < 0.71


def test_novel_pairs_keep_closed_labels(kit, ids):
    keys = pairs.split_keys(ids).withColumn("novel", F.lit(True))
    labels = pairs.draw_pairs(keys, kit).filter("shape = 'goto_labels'").select(F.explode("slots").alias("slot", "value"))
    used = {r["value"] for r in labels.filter(F.col("slot").startswith("label")).distinct().collect()}
    assert used <= {"A", "B", "C", "D", "E", "Yes", "No"}


def test_phrases_need_not_be_held_out(kit, ids):
    spoken = pairs.draw_phrase(
        pairs.draw_shape(pairs.split_keys(ids, hold_out_phrases=False).filter("split = 'val'"), kit), kit
    )
    sides = spoken.join(kit.phrases.select("shape", "paraphrase", F.col("split").alias("side")), ["shape", "paraphrase"])
    counts = {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()}
    assert counts["train"] > counts["val"] > 0


def test_axis_sets_hold_out_one_thing_at_a_time(kit, ids):
    sets = pairs.axis_sets(ids, kit, n=200)
    assert {r["axis"]: r["count"] for r in sets.groupBy("axis").count().collect()} == dict.fromkeys(pairs.AXES, 200)
    slots = sets.select("axis", F.explode("slots").alias("slot", "value")).withColumn(
        "category", tx.slot_category(F.col("slot"))
    )
    seen = slots.filter("category <> 'label'").join(kit.pool, ["category", "value"])
    sides = {(r["axis"], r["split"]) for r in seen.select("axis", "split").distinct().collect()}
    assert sides == {("control", "train"), ("values", "val"), ("phrasing", "train"), ("both", "val")}


def test_pairs_survive_json(spark, kit, ids):
    path = work_path(spark, "pairs")
    made = pairs.generate_pairs(ids.limit(100), kit)
    stores.write_pairs(made, path)
    back = stores.read_pairs(spark, path)
    assert back.schema["slots"].dataType == made.schema["slots"].dataType
    flat = ["pair_id", "split", "shape", "prompt", "diagram", "novel"]
    assert back.select(flat).exceptAll(made.select(flat)).count() == 0


def test_json_array_files_are_read(spark, tmp_path):
    (tmp_path / "pairs.json").write_text(
        '[{"pair_id": 1, "prompt": "p", "slots": {"act_1": "Go Up"}, "novel": true},\n {"pair_id": 2}]'
    )
    rows = stores.read_pairs(spark, str(tmp_path), array_file=True).orderBy("pair_id").collect()
    assert rows[0]["slots"] == {"act_1": "Go Up"} and rows[1]["novel"] is None


def test_blocks_are_kept_unless_forced(spark):
    path = work_path(spark, "blocks")
    one = spark.createDataFrame([("train", 0, [1])], "split string, block_id long, tokens array<int>")
    two = spark.createDataFrame([("val", 5, [2])], "split string, block_id long, tokens array<int>")
    stores.write_blocks(one, path)
    stores.write_blocks(two, path)
    assert [r["split"] for r in stores.read_blocks(spark, path).collect()] == ["train"]
    stores.write_blocks(two, path, force=True)
    assert [r["split"] for r in stores.read_blocks(spark, path).collect()] == ["val"]


def test_draw_shares(spark):
    keys = spark.range(50_000)
    share = keys.filter(draw.below(draw.digest(1, F.col("id"), "x"), 0.15)).count() / 50_000
    assert 0.14 < share < 0.16
    spread = keys.groupBy(draw.pick(draw.digest(1, F.col("id"), "y"), 10).alias("p")).count().collect()
    assert len(spread) == 10 and all(4600 < r["count"] < 5400 for r in spread)


def test_distinct_pairs_are_drawn_once(kit, ids):
    twice = ids.unionByName(ids)
    made = pairs.generate_pairs(twice, kit)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # The result reads the drawn table and takes the few losing keys out of it.
    assert "LeftAnti" in plan and "Aggregate(keys=[split" not in plan
    want = pairs.distinct_pairs(pairs.draw_pairs(pairs.split_keys(ids), kit))
    columns = ["pair_id", "split", "shape", "prompt", "diagram", "novel"]
    assert made.count() == want.count()
    assert made.select(columns).exceptAll(want.select(columns)).count() == 0


def test_words_that_break_no_label_stay_and_the_rest_is_counted(spark):
    words = ["Cup", "T-shirt", "3D", "Mp3", "a b", "x]", "{y}", "O'Neil", "", None, "é1", "p|q", "r>s"]
    df = spark.createDataFrame([("object", w) for w in words + words], "kind string, word string")
    kept = {r["word"] for r in lexicon.merge_words(df, df.limit(2)).collect()}
    assert kept == {"Cup", "T-shirt", "Mp3", "O'Neil", "é1"}
    assert {r["word"] for r in lexicon.dropped_words(df).collect()} == {"3D", "a b", "x]", "{y}", "", "p|q", "r>s"}


def test_stream_state_holds_digests_and_survives_a_restart(spark, kit, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("source", "sink", "state"))
    keys = spark.range(120).select(F.col("id").alias("pair_id"), F.current_timestamp().alias("arrived"))

    def run(sink=sink, state=state):
        stream = spark.readStream.schema("pair_id bigint, arrived timestamp").parquet(source)
        made = jobs.stream_pairs(stream, kit)
        jobs.append_parquet(made.select("pair_id", "prompt", "diagram"), sink, state).awaitTermination()

    keys.filter("pair_id < 80").write.parquet(source)
    run()
    keys.filter("pair_id >= 40").write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(sink)
    assert rows.count() == rows.select("prompt", "diagram").distinct().count()
    run(f"{sink}-alone", f"{state}-alone")
    alone = spark.read.parquet(f"{sink}-alone")
    texts = lambda df: sorted(tuple(r) for r in df.select("prompt", "diagram").collect())
    assert texts(rows) == texts(alone)
    # A state row is two 64-bit numbers and a time, not the texts.
    key = spark.read.format("statestore").load(state).select("key.*")
    assert [t for _, t in key.dtypes] == ["bigint", "bigint"]
