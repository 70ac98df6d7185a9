"""Work that must grow no faster than its input, and use every core."""

from __future__ import annotations

import glob

from glyphmill.operators import nearest, pairs
from glyphmill.plans import inputs
from glyphmill.sources.grammar import grammar


def _parts(tables, name):
    return len(glob.glob(f"{tables[name].inputFiles()[0].rsplit('/', 1)[0].removeprefix('file://')}/part-*"))


def _kept(monkeypatch, module):
    """The tables a module writes, by name."""
    tables, real = {}, module.written

    def written(df, name, *partition_by):
        tables[name] = real(df, name, *partition_by)
        return tables[name]

    monkeypatch.setattr(module, "written", written)
    return tables


def test_pairs_are_drawn_on_every_core(spark, kit, monkeypatch):
    tables = _kept(monkeypatch, pairs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        made = pairs.generate_pairs(spark.range(2000).withColumnRenamed("id", "pair_id"), kit)
        assert made.count() <= 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert _parts(tables, "drawn-pairs") >= 32


def test_readings_beyond_reach_are_not_compared(spark, kit, monkeypatch):
    tables = _kept(monkeypatch, nearest)
    made = pairs.generate_pairs(spark.range(40).withColumnRenamed("id", "pair_id"), kit).select("pair_id", "prompt")
    lost = made.selectExpr("pair_id + 1000 as pair_id", "concat('Qqq rrr sss, ', lower(prompt)) as prompt")
    found = nearest.nearest_phrasings(made.unionByName(lost), kit.phrases, grammar(spark)["shapes"])
    assert {r["pair_id"] for r in found.collect()} == {r["pair_id"] for r in made.collect()}
    # Three unknown words are more than two edits: no remainder of these prompts is ever hashed.
    assert tables["readings"].filter("pair_id >= 1000").count() == 0


def test_tokenizer_lines_draw_the_training_side_only(spark, kit, monkeypatch):
    tables = _kept(monkeypatch, pairs)
    monkeypatch.setattr(inputs, "candidate_kit", lambda *_: kit)
    monkeypatch.setattr(inputs, "documents", lambda *_: spark.sql("select 1L doc_id, 'a' text"))
    ids = spark.range(500).withColumnRenamed("id", "pair_id")
    monkeypatch.setattr(inputs, "order_ids", lambda *_: ids)
    lines = inputs.tokenizer_input(spark, "").filter("origin = 'pairs'").select("line", "text")
    assert {r["split"] for r in tables["drawn-pairs"].select("split").distinct().collect()} == {"train"}
    want = pairs.tokenizer_lines(kit.pool, pairs.generate_pairs(ids, kit)).filter("origin = 'pairs'").select("line", "text")
    assert sorted(lines.collect()) == sorted(want.collect())
