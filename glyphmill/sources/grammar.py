"""The packaged grammar and lexicon as tables.

The JSON files ship with the package and are read where the driver runs, so no
executor needs them on its disk; every table here is small and fixed in size.
"""

from __future__ import annotations

import json
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.tables import local_table

SHAPES = "shape string, pattern string"
FRAMES = "shape string, frame_id int, frame string"
CONNECTIVES = "shape string, key string, option string"
WORDS = "kind string, word string"
FRAGMENTS = "idx int, fragment string"


@lru_cache(maxsize=None)
def packaged(name: str):
    return json.loads(resources.files("glyphmill").joinpath(f"data/{name}.json").read_text("utf-8"))


def shape_rows() -> list[tuple]:
    return [(s["shape"], s["pattern"]) for s in packaged("shapes")]


def frame_rows() -> list[tuple]:
    return [(s, i, f) for s, frames in packaged("frames").items() for i, f in enumerate(frames)]


def connective_rows() -> list[tuple]:
    return [
        (s, key, option)
        for s, keys in packaged("connectives").items()
        for key, options in keys.items()
        for option in options
    ]


def word_rows() -> list[tuple]:
    return [(kind, w) for kind, words in packaged("words").items() for w in words]


def fragment_rows() -> list[tuple]:
    return list(enumerate(packaged("fragments")))


def grammar(spark: SparkSession) -> dict[str, DataFrame]:
    """shapes, frames, connectives, words and fragments as DataFrames."""
    return {
        "shapes": local_table(spark, shape_rows(), SHAPES),
        "frames": local_table(spark, frame_rows(), FRAMES),
        "connectives": local_table(spark, connective_rows(), CONNECTIVES),
        "words": local_table(spark, word_rows(), WORDS),
        "fragments": local_table(spark, fragment_rows(), FRAGMENTS),
    }
