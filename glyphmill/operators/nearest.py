"""The nearest known phrasing of a prompt that no paraphrase explains.

Two word sequences within ``within`` edits agree in what is left after taking
at most that many words out of each.  So every masked paraphrase, and every
distinct reading of a prompt, is joined on the hashes of all its remainders, and
only pairs that share one are compared, exactly: words become single characters,
so that the built-in edit distance counts words.  A word the grammar lacks is in
no common remainder, so it is always among those taken out, and readings with
more such words than edits are near nothing.

* Only words count: case and punctuation do not, a masked label is one word.
* A prompt's readings are those of ``synthesize``; the nearest of them counts.
  A prompt with more sentences than any paraphrase, or too long or too short to
  be within reach, has no nearest phrasing.
* Ties go to the alphabetically first phrasing, then shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import synthesize as sy
from glyphmill.plans.sizing import dealt, fits, small_side
from glyphmill.session import written

WITHIN = 2
MAX_VOCABULARY = 50_000
# The first of as many characters as a grammar has words, outside any script in use.
_FIRST_CHARACTER = 0x20000
_UNKNOWN = "?"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{sy.HOLE}|[\p{{L}}\p{{N}}']+"), F.lit(0))


def remainders(signs: Column, within: int) -> Column:
    """128-bit hashes of all sequences left after taking out at most ``within`` signs."""
    left = F.array(F.regexp_extract_all(signs, F.lit("(?s)."), F.lit(0)))
    for _ in range(within):
        shorter = F.flatten(
            F.transform(
                left,
                lambda ws: F.transform(
                    F.sequence(F.lit(0), F.size(ws)), lambda i: F.filter(ws, lambda w, k: k != i)
                ),
            )
        )
        left = F.array_distinct(shorter)
    return F.transform(
        left, lambda ws: F.struct(F.xxhash64(ws).alias("h1"), F.xxhash64(F.lit("second"), ws).alias("h2"))
    )


def _asked_remainders(asked: Column, within: int) -> Column:
    """As ``remainders``, of a reading: its unknown words are always among those taken out."""
    known = F.replace(asked, F.lit(_UNKNOWN), F.lit(""))
    n_unknown = F.length(asked) - F.length(known)
    out = None
    for n in range(within + 1):
        some = remainders(known, within - n)
        out = F.when(n_unknown == n, some) if out is None else out.when(n_unknown == n, some)
    return out


def _vocabulary(skeletons: DataFrame) -> list[str]:
    words = skeletons.select(F.explode("words").alias("w")).distinct()
    if not fits(words, MAX_VOCABULARY):
        raise ValueError(f"the grammar has over {MAX_VOCABULARY} words")
    return sorted(r["w"] for r in words.collect())


def _characters(words: Column, vocabulary: list[str]) -> Column:
    """One character per word; words the grammar does not have are all alike, and like none it has."""
    names = pa.array(vocabulary, pa.string())
    signs = pa.array([chr(_FIRST_CHARACTER + k) for k in range(len(vocabulary))], pa.string())

    @F.arrow_udf("string")
    def signs_of(lists: pa.Array) -> pa.Array:
        found = pc.fill_null(signs.take(pc.index_in(lists.flatten(), value_set=names)), _UNKNOWN)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), "")

    return signs_of(words)


def nearest_phrasings(
    prompts: DataFrame, paraphrases: DataFrame, shapes: DataFrame, key: str = "pair_id", within: int = WITHIN
) -> DataFrame:
    """``key, nearest, shape, distance`` of every prompt within ``within`` words of a paraphrase."""
    table = sy.skeleton_table(paraphrases, shapes).select("skeleton", "shape").distinct()
    table = written(table.withColumn("words", words_of(F.col("skeleton"))), "skeleton-words")
    bounds = table.agg(F.min(F.size("words")).alias("low"), F.max(F.size("words")).alias("high")).first()
    if bounds["low"] is None:
        return prompts.select(key).limit(0).selectExpr(
            key, "cast(null as string) nearest", "cast(null as string) shape", "cast(null as int) distance"
        )
    vocabulary = _vocabulary(table)
    known = table.withColumn("signs", _characters(F.col("words"), vocabulary))
    # Phrasings of the same words are equally near: the first of them stands for all.
    known = known.groupBy("signs").agg(F.min(F.struct("skeleton", "shape")).alias("first"))
    known = written(known, "skeleton-signs")
    rests = known.select("signs", F.explode(remainders(F.col("signs"), within)).alias("r"))
    rests = written(rests.select("signs", "r.*"), "skeleton-remainders")

    max_sentences, max_lead = sy.grammar_bounds(table)
    readings = sy.candidates(prompts.select(key, "prompt"), max_sentences, max_lead)
    # Filtered inside an array: a filter on a column would be pushed down and its input computed twice.
    near_enough = F.filter(
        F.array(words_of(F.col("skeleton"))), lambda ws: F.size(ws).between(bounds["low"] - within, bounds["high"] + within)
    )
    readings = readings.select(key, F.explode(near_enough).alias("words"))
    readings = readings.select(key, _characters(F.col("words"), vocabulary).alias("asked"))
    # An unknown word costs an edit, so a reading with too many of them is near nothing.
    known_enough = F.filter(
        F.array("asked"), lambda a: F.length(a) - F.length(F.replace(a, F.lit(_UNKNOWN), F.lit(""))) <= within
    )
    readings = written(readings.select(key, F.explode(known_enough).alias("asked")), "readings")

    asked = dealt(readings.select("asked"), "asked").distinct()
    asked = asked.select("asked", F.explode(_asked_remainders(F.col("asked"), within)).alias("r")).select("asked", "r.*")
    met = asked.join(small_side(rests), ["h1", "h2"]).select("asked", "signs").distinct()
    near = met.withColumn("distance", F.levenshtein("asked", "signs", within)).filter("distance >= 0")
    near = near.join(small_side(known), "signs").groupBy("asked").agg(
        F.min(F.struct("distance", "first.skeleton", "first.shape")).alias("b")
    )
    near = written(near, "nearest")
    best = readings.join(small_side(near), "asked").groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.skeleton").alias("nearest"), "b.shape", "b.distance")
