"""Sentence -> diagram, as an equi-join against the expanded grammar.

A prompt's Title-Case runs are masked, the masked sentence is joined with the
masked paraphrases, and the runs become the slot values.  At a sentence start a
run may begin with capitalised frame words, so a sentence has one candidate
reading per number of leading words kept as text.  The grammar says how many
such words and how many sentences can occur, which bounds the readings exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators.paraphrase import sentence_skeleton
from glyphmill.plans.sizing import small_side

HOLE = "#"
_WORD = r"\p{Lu}\p{L}*"
_RUN = rf"{_WORD}(?: {_WORD})*"
# A run inside a sentence; a capital inside a word does not start one.
_INNER = rf"(?<!\p{{L}}){_RUN}"
_SENTENCE = r"[^.?!]*[.?!]+\s*|[^.?!]+$"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))


def skeleton_table(paraphrases: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(skeleton, shape, pattern, holes)``: holes are slot names in text order."""
    holes = F.regexp_extract_all("paraphrase", F.lit(tx.SLOT_HOLE), F.lit(1))
    return (
        paraphrases.select(
            "shape", sentence_skeleton(F.col("paraphrase"), HOLE).alias("skeleton"), holes.alias("holes")
        )
        .distinct()
        .join(F.broadcast(shapes.select("shape", "pattern")), "shape")
    )


def grammar_bounds(skeletons: DataFrame) -> tuple[int, int]:
    """Most sentences of a skeleton, and most capitalised words before a hole."""
    lead = F.regexp_extract(F.col("s"), rf"^({_WORD}(?: {_WORD})*)(?: {HOLE})?", 1)
    words = F.when(lead == "", 0).otherwise(F.size(F.split(lead, " ")))
    row = (
        skeletons.select(sentences(F.col("skeleton")).alias("ss"))
        .select(F.size("ss").alias("n"), F.explode("ss").alias("s"))
        .agg(F.max("n").alias("n"), F.max(words).alias("lead"))
        .first()
    )
    return row["n"], row["lead"]


def _choices(parts: Column, max_lead: int, leads: Sequence[str] | None = None) -> Column:
    """Per sentence, its candidate readings ``(skeleton, vals, kept)``; with ``leads``, only those that keep one of them.

    Step by step over arrays: what a lambda names twice is computed twice, so
    each step hands on what the next one needs more than once.
    """
    none = F.array().cast("array<string>")
    led = F.transform(parts, lambda s: F.struct(s.alias("s"), F.regexp_extract(s, rf"^({_RUN})", 1).alias("lead")))
    rests = F.transform(
        led,
        lambda x: F.struct(
            F.when(x["lead"] == "", none).otherwise(F.split(x["lead"], " ")).alias("words"),
            F.substring(x["s"], F.length(x["lead"]) + 1, F.length(x["s"])).alias("rest"),
        ),
    )
    masked = F.transform(
        rests,
        lambda x: F.struct(
            x["words"].alias("words"),
            F.regexp_replace(x["rest"], _INNER, HOLE).alias("masked"),
            F.regexp_extract_all(x["rest"], F.lit(f"({_INNER})"), F.lit(1)).alias("inner"),
        ),
    )

    def reading(x: Column, kept: Column) -> Column:
        n = F.size(x["words"])
        some = n > kept
        head = F.slice(x["words"], F.lit(1), kept)
        text = F.concat_ws(" ", head, F.when(some, F.array(F.lit(HOLE))).otherwise(none))
        value = F.array_join(F.slice(x["words"], kept + 1, F.greatest(n - kept, F.lit(0))), " ")
        values = F.when(some, F.concat(F.array(value), x["inner"])).otherwise(x["inner"])
        return F.struct(F.concat(text, x["masked"]).alias("skeleton"), values.alias("vals"), kept.alias("kept"))

    def kepts(x: Column) -> Column:
        every = F.sequence(F.lit(0), F.least(F.size(x["words"]), F.lit(max_lead)))
        if leads is None:
            return every
        return F.filter(every, lambda kept: F.array_join(F.slice(x["words"], F.lit(1), kept), " ").isin(*leads))

    return F.transform(masked, lambda x: F.transform(kepts(x), lambda kept: reading(x, kept)))


def candidates(
    prompts: DataFrame, max_sentences: int, max_lead: int, prompt: str = "prompt", leads: Sequence[str] | None = None
) -> DataFrame:
    """One row per reading of each prompt that the grammar could contain.

    ``leads`` are the capitalised words that begin sentences of the grammar, none
    included: a reading that keeps others is no skeleton's.

    Prompts with more sentences than any paraphrase cannot match and have no
    readings; the others have at most ``(max_lead + 1) ** max_sentences``.
    """
    empty = F.array(
        F.struct(
            F.lit("").alias("skeleton"), F.array().cast("array<string>").alias("vals"), F.lit(0).alias("kept")
        )
    )
    parts = sentences(F.col(prompt))

    def extend(acc: Column, readings: Column) -> Column:
        return F.flatten(
            F.transform(
                acc,
                lambda a: F.transform(
                    readings,
                    lambda r: F.struct(
                        F.concat(a["skeleton"], r["skeleton"]).alias("skeleton"),
                        F.concat(a["vals"], r["vals"]).alias("vals"),
                        (a["kept"] + r["kept"]).alias("kept"),
                    ),
                ),
            )
        )

    # Without capitals nothing is a value: the sentences, one after the other, are the prompt.
    as_it_is = F.transform(empty, lambda a: F.struct(F.col(prompt).alias("skeleton"), a["vals"].alias("vals"), a["kept"].alias("kept")))
    read = F.aggregate(_choices(F.col("_parts"), max_lead, leads), empty, extend)
    return (
        prompts.withColumn("_parts", parts)
        .filter(F.size("_parts").between(1, max_sentences))
        .withColumn("_reading", F.explode(F.when(~F.col(prompt).rlike(r"\p{Lu}"), as_it_is).otherwise(read)))
        .select(*prompts.columns, F.trim("_reading.skeleton").alias("skeleton"), "_reading.vals", "_reading.kept")
    )


# Up to this many leads of a grammar are listed to leave out readings.
LISTED_LEADS = 1000


def known_leads(skeletons: DataFrame) -> list[str] | None:
    """The capitalised words that begin a sentence of any skeleton, and none; None if they are too many to list."""
    said = skeletons.select(F.explode(sentences(F.col("skeleton"))).alias("s"))
    rows = said.select(F.regexp_extract("s", rf"^({_RUN})", 1).alias("lead")).distinct().limit(LISTED_LEADS + 1).collect()
    return sorted({"", *(r["lead"] for r in rows)}) if len(rows) <= LISTED_LEADS else None


# Runs and holes, as many as stand side by side.
_RUNS = rf"(?<!\p{{L}})(?:{_WORD}|{HOLE})(?: (?:{_WORD}|{HOLE}))*"


def run_form(text: Column) -> Column:
    """A text with all its runs and holes masked: every reading of a prompt has the form of the prompt.

    A reading masks runs or their last words, and what it leaves of a run stands
    beside the hole.  A prompt that itself has the sign of a hole gets that sign.
    """
    return F.when(F.contains(text, F.lit(HOLE)), F.lit(HOLE)).otherwise(F.trim(F.regexp_replace(text, _RUNS, HOLE)))


def _known_forms(table: DataFrame) -> DataFrame:
    """The forms of all skeletons, and that of prompts to be read whatever their form."""
    forms = table.select(F.trim(F.regexp_replace("skeleton", _RUNS, HOLE)).alias("_form"))
    return forms.unionByName(table.select(F.lit(HOLE).alias("_form"))).distinct()


def synthesize(
    prompts: DataFrame, paraphrases: DataFrame, shapes: DataFrame, key: str = "pair_id"
) -> DataFrame:
    """``(key, shape, slots, generated)`` of every prompt the grammar knows.

    A slot mentioned twice must have the same value at both places; of several
    readings the one that keeps the fewest leading words wins.
    """
    table = skeleton_table(paraphrases, shapes).cache()
    max_sentences, max_lead = grammar_bounds(table)
    # Only prompts of a known form are read: the others match nothing.
    formed = prompts.select(key, "prompt").withColumn("_form", run_form(F.col("prompt")))
    likely = formed.join(small_side(_known_forms(table)), "_form", "left_semi").select(key, "prompt")
    found = candidates(likely, max_sentences, max_lead, leads=known_leads(table))
    matched = found.join(small_side(table), "skeleton").filter(F.size("holes") == F.size("vals"))
    named = F.arrays_zip(F.col("holes").alias("k"), F.col("vals").alias("v"))
    distinct = F.array_distinct(named)
    consistent = matched.filter(F.size(distinct) == F.size(F.array_distinct("holes"))).withColumn(
        "slots", F.map_from_entries(F.transform(distinct, lambda e: F.struct(e["k"], e["v"])))
    )
    best = consistent.groupBy(key).agg(
        F.min_by(F.struct("shape", "pattern", "slots"), F.struct("kept", "shape", "skeleton")).alias("b")
    )
    return best.select(
        key, "b.shape", "b.slots", tx.fill_holes(F.col("b.pattern"), F.col("b.slots")).alias("generated")
    )


def unmatched(prompts: DataFrame, matched: DataFrame, key: str = "pair_id") -> DataFrame:
    """Prompts no paraphrase explains, with a reason, instead of invented labels.

    An outer join with a null test: an anti join would be pushed below a union
    of prompt sources, and the match recomputed for each of them.
    """
    reason = F.when(tx.casing_warning(F.col("prompt")), "no_title_case").otherwise("no_known_shape")
    return (
        prompts.join(matched.select(key, F.lit(True).alias("_found")), key, "left")
        .filter(F.col("_found").isNull())
        .drop("_found")
        .withColumn("reason", reason)
    )
