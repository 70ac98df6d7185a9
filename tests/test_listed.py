"""Small pools are read from constant lists, large ones joined; both draw the same slots."""

import dataclasses

from pyspark.sql import functions as F

from glyphmill.operators import pairs


def test_listed_and_joined_pools_draw_the_same(spark, kit):
    keys = pairs.split_keys(spark.range(3000).withColumnRenamed("id", "pair_id"))
    shaped = pairs.draw_shape(keys, kit)
    joined = dataclasses.replace(kit, listed=None)
    flat = [F.map_entries("slots").alias("slots")]
    rows = [
        sorted(map(str, pairs.sample_slots(shaped, k).select("pair_id", "novel", *flat).collect())) for k in (kit, joined)
    ]
    assert kit.listed and rows[0] == rows[1] and len(rows[0]) == 3000
    plan = pairs.sample_slots(shaped, kit)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the shapes
