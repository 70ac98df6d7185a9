"""Mixing sources to target weights by iterative proportional fitting.

Token counts of every (source, language, topic) cell are raked until their
marginals meet the targets; a cell's ratio of raked to present tokens, scaled
to the token budget and capped at one, is the probability with which its
documents are first drawn.  A cell at the cap cannot give all it should, so the
probabilities are raked again under that bound, towards the marginals within
reach: a value's share of the budget, but no more tokens than it has, the rest
spread over the other values.  Cells are a table; up to ``cells_in_task`` counted
ones are swept in one task, more of them by joins and sums, so the number of
sources is not bounded by any one task.
``marginals`` tells target, reachable and expected share of every value.

* Null sources and languages are values of their own.
* A target value that no document has is ignored; a value without a target
  keeps its present share; shares are rescaled to one.
* A null or empty text has no tokens; a cell without tokens is drawn with the
  probability of an unweighted cell.
* Draws depend on the seed and ``doc_id`` only (on the text where the id is
  null), so repeated rows share their fate.
* An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphmill.llm.common import body, boxed, lookup, unboxed, words
from glyphmill.plans.sizing import fits
from glyphmill.session import written

DIMENSIONS = ("source", "lang", "topic")

# The first topic with a cue in the text is the text's topic.
TOPIC_CUES = {
    "legal": ("License", "Copyright", "license", "copyright"),
    "contact": ("@", "+1 ("),
    "tabular": (" | ", "\t"),
}
OTHER_TOPIC = "general"


@dataclass(frozen=True)
class Params:
    # Share of each dimension's value in the mix; where none is given, the
    # present token share to this power, rescaled.
    targets: Mapping[str, Mapping[str | None, float]] = field(default_factory=dict)
    flatten: Mapping[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7})
    keep_share: float = 0.75
    tolerance: float = 1e-3
    max_sweeps: int = 50
    # Largest relative gap to a reachable marginal at which the bounded sweeps stop.
    close_enough: float = 5e-3
    bounded_sweeps: int = 12
    cells_in_task: int = 100_000
    seed: int = 11


def topic(text: Column) -> Column:
    found = F.lit(OTHER_TOPIC)
    for name, cues in reversed(TOPIC_CUES.items()):
        has = F.lit(False)
        for cue in cues:
            has = has | F.contains(text, F.lit(cue))
        found = F.when(has, F.lit(name)).otherwise(found)
    return found


def cells(docs: DataFrame) -> DataFrame:
    """Tokens and documents of every cell; sums are combined map-side, so a hot source is one row a task."""
    rows = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        topic(body("text")).alias("topic"),
        F.size(words(body("text"))).cast("bigint").alias("n"),
    )
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


def goals(table: DataFrame, dimension: str, params: Params) -> DataFrame:
    """``dimension, goal``: the tokens each value should have; goals sum to the table's tokens."""
    present = table.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("now")).filter(F.col("now") > 0)
    total = present.agg(F.sum("now")).first()[0] or 1.0
    share = F.col("now") / total
    given = params.targets.get(dimension)
    if given is None:
        wish = F.pow(share, F.lit(params.flatten.get(dimension, 1.0)))
    else:
        wish = share
        for value, weight in given.items():
            wish = F.when(F.col(dimension).eqNullSafe(F.lit(value)), F.lit(float(weight))).otherwise(wish)
    wished = present.withColumn("wish", wish)
    wishes = wished.agg(F.sum("wish")).first()[0] or 1.0
    return wished.select(dimension, (F.col("wish") / wishes * total).alias("goal"))


def _in_one_task(cells: DataFrame, schema: StructType, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``work`` over all of ``cells``, of which there are at most ``cells_in_task``, in one task."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = list(batches)
        if held:
            yield from work(pa.Table.from_batches(held)).cast(arrow).to_batches()

    return cells.coalesce(1).mapInArrow(run, schema)


def _wishes(names: pa.Array, now: np.ndarray, dimension: str, params: Params) -> np.ndarray:
    """The wish of every value with tokens, as ``goals`` has it before rescaling; zero for the others."""
    share = now / (now.sum() or 1.0)
    given = params.targets.get(dimension)
    if given is None:
        wish = share ** params.flatten.get(dimension, 1.0)
    else:
        wish = np.array([given.get(v, s) for v, s in zip(names.to_pylist(), share)], np.float64)
    return np.where(now > 0, wish, 0.0)


def raked_cells(cells: pa.Table, params: Params) -> pa.Table:
    """What ``rake`` does, over cells that fit one task."""
    tokens = cells.column("tokens").to_numpy().astype(np.float64)
    at, goal = {}, {}
    for d in DIMENSIONS:
        names = cells.column(d).combine_chunks().dictionary_encode("encode")
        at[d] = names.indices.to_numpy()
        now = np.bincount(at[d], tokens, len(names.dictionary))
        wish = _wishes(names.dictionary, now, d, params)
        goal[d] = np.where(now > 0, wish / (wish.sum() or 1.0) * (now.sum() or 1.0), np.nan)
    weight = tokens.copy()
    for _ in range(params.max_sweeps):
        change = np.zeros(len(weight))
        for d in DIMENSIONS:
            now = np.bincount(at[d], weight, len(goal[d]))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where((now == 0) | np.isnan(goal[d]), 1.0, goal[d] / now)[at[d]]
            weight = weight * factor
            change = np.maximum(change, np.abs(factor - 1))
        if change[weight > 0].max(initial=0.0) < params.tolerance:
            break
    return cells.append_column("weight", pa.array(weight))


def rake(table: DataFrame, params: Params = Params()) -> DataFrame:
    """``table`` with ``weight``: its tokens fitted to all marginals."""
    if fits(table, params.cells_in_task):
        schema = StructType([*table.schema, StructField("weight", DoubleType())])
        return _in_one_task(table, schema, lambda cells: raked_cells(cells, params))
    targets = {d: written(goals(table, d, params), f"goal-{d}") for d in DIMENSIONS}
    fitted = table.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(params.max_sweeps):
        change = F.lit(0.0)
        for d in DIMENSIONS:
            now = fitted.groupBy(d).agg(F.sum("weight").alias("now"))
            factor = now.join(targets[d].withColumnRenamed(d, "value"), F.col(d).eqNullSafe(F.col("value")), "left")
            factor = factor.select(d, F.coalesce(F.col("goal") / F.nullif("now", F.lit(0.0)), F.lit(1.0)).alias(f"f_{d}"))
            fitted = lookup(fitted.drop(f"f_{d}"), factor, [d])
            fitted = fitted.withColumn("weight", F.col("weight") * F.col(f"f_{d}"))
            change = F.greatest(change, F.abs(F.col(f"f_{d}") - 1))
        fitted = written(fitted, "raked")
        worst = fitted.filter(F.col("weight") > 0).agg(F.max(change)).first()[0]
        if worst is None or worst < params.tolerance:
            break
    return fitted.select(*table.columns, "weight")


def probabilities(raked: DataFrame, params: Params = Params()) -> DataFrame:
    """``raked`` with ``probability``: proportional to weight per token, at most one, meeting the token budget.

    Cells that would pass one are set to one and the rest share what is left;
    each round adds such cells, so a few rounds settle it.
    """
    rated = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))
    budget = params.keep_share * (rated.agg(F.sum("tokens")).first()[0] or 0)
    scale, full = 0.0, -1
    while True:
        capped = F.col("ratio") * scale >= 1
        sums = rated.agg(
            F.sum(F.when(capped, F.col("tokens"))).alias("sure"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count_if(capped).alias("full"),
        ).first()
        if not sums["open"] or sums["full"] == full:
            break
        full, scale = sums["full"], max(scale, (budget - (sums["sure"] or 0)) / sums["open"])
    if budget == 0:
        scale = params.keep_share
    return rated.withColumn("probability", F.least(F.col("ratio") * scale, F.lit(1.0)))


def reachable(table: DataFrame, dimension: str, params: Params, budget: float) -> DataFrame:
    """``dimension, target, goal``: the tokens each value should have of the budget, and those it can have."""
    now = table.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("now"))
    wished = lookup(goals(table, dimension, params), now, [dimension])
    wished = written(wished.withColumnRenamed("goal", "wish"), f"wish-{dimension}")
    wishes = wished.agg(F.sum("wish")).first()[0] or 1.0
    scale, full = budget / wishes, -1
    while True:
        short = F.col("wish") * scale >= F.col("now")
        sums = wished.agg(
            F.sum(F.when(short, F.col("now"))).alias("sure"),
            F.sum(F.when(~short, F.col("wish"))).alias("open"),
            F.count_if(short).alias("full"),
        ).first()
        if not sums["open"] or sums["full"] == full:
            break
        full, scale = sums["full"], max(scale, (budget - (sums["sure"] or 0)) / sums["open"])
    goal = F.least(F.col("now"), F.col("wish") * scale)
    return wished.select(dimension, (F.col("wish") * (budget / wishes)).alias("target"), goal.alias("goal"))


def _filled(wish: np.ndarray, now: np.ndarray, budget: float) -> np.ndarray:
    """``wish`` scaled to the budget, no value above what it has."""
    scale, full = budget / (wish.sum() or 1.0), -1
    while True:
        short = wish * scale >= now
        if short.all() or int(short.sum()) == full:
            return np.minimum(now, wish * scale)
        full, scale = int(short.sum()), max(scale, (budget - now[short].sum()) / wish[~short].sum())


def bounded_cells(cells: pa.Table, params: Params) -> pa.Table:
    """What ``bounded`` does, over cells that fit one task."""
    tokens, chance = (cells.column(c).to_numpy().astype(np.float64) for c in ("tokens", "probability"))
    budget = float((tokens * chance).sum())
    at, goal = {}, {}
    for d in DIMENSIONS:
        names = cells.column(d).combine_chunks().dictionary_encode("encode")
        at[d] = names.indices.to_numpy()
        now = np.bincount(at[d], tokens, len(names.dictionary))
        goal[d] = _filled(_wishes(names.dictionary, now, d, params), now, budget)
    before = float("inf")
    for _ in range(params.bounded_sweeps if budget else 0):
        widest = 0.0
        for d in DIMENSIONS:
            n = len(goal[d])
            now = np.bincount(at[d], tokens * chance, n)
            free = np.bincount(at[d], np.where(chance < 1, tokens * chance, 0.0), n)
            with np.errstate(divide="ignore", invalid="ignore"):
                down = np.where(now > 0, np.minimum(goal[d] / now, 1.0), 1.0)
                up = np.where(free > 0, np.maximum((goal[d] - now + free) / free, 1.0), 1.0)
                gap = np.where(now > 0, np.abs(goal[d] / now - 1), 0.0)
            widest = max(widest, float(gap.max(initial=0.0)))
            raised = np.where(chance < 1, np.minimum(chance * up[at[d]], 1.0), chance)
            chance = np.where(down[at[d]] < 1, chance * down[at[d]], raised)
        if widest < params.close_enough or widest > 0.95 * before:
            break
        before = widest
    return cells.set_column(cells.column_names.index("probability"), "probability", pa.array(chance))


def bounded(rated: DataFrame, params: Params = Params()) -> DataFrame:
    """``rated`` (cells with ``tokens`` and ``probability``) raked to the reachable marginals, no probability above one.

    A value with too many tokens lowers all its cells, one with too few raises
    those below one.  Sweeps end when every marginal is close enough, or, where
    the marginals contradict each other, when a sweep hardly narrows the largest
    gap any more; the gaps that remain are what ``marginals`` shows.
    """
    if fits(rated, params.cells_in_task):
        return _in_one_task(rated, rated.schema, lambda cells: bounded_cells(cells, params))
    given = F.col("tokens") * F.col("probability")
    budget = rated.agg(F.sum(given)).first()[0] or 0.0
    if not budget:
        return rated
    targets = {d: written(reachable(rated, d, params, budget), f"reachable-{d}") for d in DIMENSIONS}
    fitted, before = rated, float("inf")
    for _ in range(params.bounded_sweeps):
        gap = F.lit(0.0)
        for d in DIMENSIONS:
            now = fitted.groupBy(d).agg(F.sum(given).alias("now"), F.sum(F.when(F.col("probability") < 1, given)).alias("open"))
            goal = targets[d].select(F.col(d).alias("value"), "goal")
            now = now.join(goal, F.col(d).eqNullSafe(F.col("value"))).filter("now > 0")
            up = (F.col("goal") - F.col("now") + F.col("open")) / F.nullif("open", F.lit(0.0))
            change = now.select(
                d,
                F.least(F.col("goal") / F.col("now"), F.lit(1.0)).alias("down"),
                F.greatest(F.coalesce(up, F.lit(1.0)), F.lit(1.0)).alias("up"),
                F.abs(F.col("goal") / F.col("now") - 1).alias(f"gap_{d}"),
            )
            fitted = lookup(fitted.drop(f"gap_{d}"), change, [d])
            raised = F.when(F.col("probability") < 1, F.col("probability") * F.coalesce("up", F.lit(1.0)))
            raised = F.least(F.coalesce(raised, F.col("probability")), F.lit(1.0))
            lowered = F.col("probability") * F.coalesce("down", F.lit(1.0))
            fitted = fitted.withColumn("probability", F.when(F.col("down") < 1, lowered).otherwise(raised)).drop("up", "down")
            gap = F.greatest(gap, F.coalesce(f"gap_{d}", F.lit(0.0)))
        fitted = written(fitted, "bounded")
        widest = fitted.agg(F.max(gap)).first()[0] or 0.0
        if widest < params.close_enough or widest > 0.95 * before:
            break
        before = widest
    return fitted.select(*rated.columns)


def marginals(fitted: DataFrame, params: Params = Params()) -> DataFrame:
    """``dimension, value, target, reachable, expected``: shares of the expected sample, one row per value."""
    given = F.col("tokens") * F.col("probability")
    budget = fitted.agg(F.sum(given)).first()[0] or 1.0
    out = None
    for d in DIMENSIONS:
        now = fitted.groupBy(d).agg(F.sum(given).alias("now"))
        rows = lookup(reachable(fitted, d, params, budget), now, [d]).select(
            F.lit(d).alias("dimension"),
            F.col(d).alias("value"),
            *[(F.col(c) / budget).alias(n) for c, n in (("target", "target"), ("goal", "reachable"), ("now", "expected"))],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def chances(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Cells with the ``probability`` of their documents."""
    table = written(cells(docs), "cells")
    return bounded(written(probabilities(rake(table, params), params), "rated"), params)


def draw(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``probability`` and ``drawn``."""
    drawn_with = chances(docs, params).select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "probability")
    rows = boxed(docs).select(
        "row",
        F.col("row.source").cast("string").alias("cell_source"),
        F.col("row.lang").cast("string").alias("cell_lang"),
        topic(body("row.text")).alias("cell_topic"),
    )
    joined = lookup(rows, written(drawn_with, "chances"), [f"cell_{d}" for d in DIMENSIONS])
    nameless = F.when(F.col("row.doc_id").isNull(), F.col("row.text"))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(params.seed), F.col("row.doc_id"), nameless), 11)
    return unboxed(
        joined,
        docs.columns,
        topic=F.col("cell_topic"),
        n_tokens=F.size(words(body("row.text"))).cast("bigint"),
        probability=F.col("probability"),
        drawn=bits / F.lit(float(1 << 53)) < F.col("probability"),
    )
