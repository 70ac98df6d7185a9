"""The nearest known phrasing against brute force over all paraphrases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from glyphmill.operators import nearest, pairs
from glyphmill.operators import synthesize as sy
from glyphmill.sources.grammar import grammar


def words(text):
    return re.findall(r"#|[^\W_]+(?:'[^\W_]+)*|'", text.lower())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_phrasing_equals_brute_force(spark, kit):
    shapes = grammar(spark)["shapes"]
    made = pairs.generate_pairs(spark.range(60).withColumnRenamed("id", "pair_id"), kit).select("pair_id", "prompt").collect()
    rng = random.Random(6)
    prompts = []
    for r in made:
        ws = r["prompt"].split(" ")
        for _ in range(r["pair_id"] % 5):
            at = rng.randrange(len(ws))
            if not ws[at][0].isupper():
                ws[at : at + 1] = rng.choice([[], ["zzz"], [ws[at], "really"]])
        prompts.append((r["pair_id"], " ".join(ws)))
    prompts += [(1000, ""), (1001, "nothing known here"), (1002, "One. Two. Three. Four. Five. Six. Seven."), (1003, None), (1004, "x " * 400)]
    df = spark.createDataFrame(prompts, "pair_id long, prompt string")
    got = {r["pair_id"]: (r["distance"], r["nearest"], r["shape"]) for r in nearest.nearest_phrasings(df, kit.phrases, shapes).collect()}

    table = sorted({(r["skeleton"], r["shape"]) for r in sy.skeleton_table(kit.phrases, shapes).collect()})
    bounds = sy.grammar_bounds(sy.skeleton_table(kit.phrases, shapes))
    readings = sy.candidates(df, *bounds).select("pair_id", "skeleton").collect()
    want = {}
    for r in readings:
        asked = words(r["skeleton"])
        for skeleton, shape in table:
            known = words(skeleton)
            if abs(len(known) - len(asked)) <= 2 and (d := edits(asked, known)) <= 2:
                found = (d, skeleton, shape)
                want[r["pair_id"]] = min(want.get(r["pair_id"], found), found)
    assert got == want
    assert {d for d, _, _ in got.values()} == {0, 1, 2} and len(got) < len(prompts)


def test_prompts_the_grammar_knows_are_at_distance_zero(spark, kit):
    made = pairs.generate_pairs(spark.range(100, 140).withColumnRenamed("id", "pair_id"), kit)
    found = nearest.nearest_phrasings(made, kit.phrases, grammar(spark)["shapes"])
    assert found.filter(F.col("distance") > 0).count() == 0 and found.count() == made.count()
