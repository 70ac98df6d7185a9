"""Scoring generated diagrams: per slot, per sample, per axis, per shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import draw
from glyphmill.functions import text as tx
from glyphmill.operators.paraphrase import shape_slots

# Fixed values.
CORRUPT_SEED = 7
FAULTS = (
    "none",
    "none",
    "swap_label",
    "swap_branches",
    "drop_first_node",
    "mismatched_bracket",
    "blank_lines",
    "foreign_line",
)
# Faults that change no meaning: scored like the others, but not expected to fail.
HARMLESS = ("blank_lines",)
_MARK = "\u0001"


def needles(shapes: DataFrame) -> DataFrame:
    """``(shape, slot, left, right)``: characters around each slot's first hole."""
    hole = F.concat(F.lit("{"), "slot", F.lit("}"))
    at = F.instr("pattern", hole)
    end = at + F.length(hole)
    return (
        shapes.select("shape", "pattern")
        .join(F.broadcast(shape_slots(shapes).drop("category")), "shape")
        .select(
            "shape",
            "slot",
            F.when(at > 1, F.substring("pattern", at - 1, F.lit(1))).otherwise("").alias("left"),
            F.when(end <= F.length("pattern"), F.substring("pattern", end, F.lit(1))).otherwise("").alias("right"),
        )
    )


def needle_maps(shapes: DataFrame) -> DataFrame:
    """``(shape, around map<slot, struct<left, right>>)``; one row per shape."""
    return needles(shapes).groupBy("shape").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("left", "right")))).alias("around")
    )


def _hit(generated: Column, slot: Column, value: Column) -> Column:
    """The value appears between its structural neighbours.

    Without a known pattern the value alone is looked for.
    """
    around = F.element_at(F.col("around"), slot)
    left = F.coalesce(around["left"], F.lit(""))
    right = F.coalesce(around["right"], F.lit(""))
    return F.contains(generated, F.concat(left, value, right))


def with_hits(samples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Add ``hits array<struct<slot, value, hit>>`` in slot order.

    ``samples`` holds ``shape, slots, generated``.  A sample's slots are scored
    inside its row, so only the needle table (one row per shape) is joined.
    """
    joined = samples.join(F.broadcast(needle_maps(shapes)), "shape", "left")
    entries = F.array_sort(F.map_entries("slots"))
    hits = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("slot"),
            e["value"].alias("value"),
            _hit(F.col("generated"), e["key"], e["value"]).alias("hit"),
        ),
    )
    return joined.withColumn("hits", hits).drop("around")


def slot_outcomes(samples: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per (sample, slot): value, and hit or miss."""
    return with_hits(samples, shapes).select("pair_id", F.explode("hits").alias("h")).select(
        "pair_id", "h.slot", "h.value", "h.hit"
    )


def scored(samples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Add ``n_slots, n_hits, all_hit, exact`` to each sample."""
    exact = tx.normalize(F.col("generated")) == tx.normalize(F.col("diagram"))
    return (
        with_hits(samples, shapes)
        .withColumn("n_slots", F.size("hits").cast("bigint"))
        .withColumn("n_hits", F.size(F.filter("hits", lambda h: h["hit"])).cast("bigint"))
        .withColumn("all_hit", F.col("n_hits") == F.col("n_slots"))
        .withColumn("exact", exact)
    )


def join_predictions(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach ``generated`` to its pair; both sides are keyed by ``pair_id``."""
    return pairs.join(predictions.select("pair_id", "generated"), "pair_id")


def _one(flag: str | Column) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).cast("bigint")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part, F.lit(0)) / F.greatest(F.lit(1), whole), 6)


def _metric_columns() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("n"),
        _share(F.sum("n_hits"), F.coalesce(F.sum("n_slots"), F.lit(0))).alias("slot_acc"),
        _share(F.sum(_one("all_hit")), n).alias("sample_acc"),
        _share(F.sum(_one("exact")), n).alias("exact_match"),
    ]


def slot_metrics(scores: DataFrame, *by: str) -> DataFrame:
    """slot_acc, sample_acc and exact_match, overall or per group."""
    grouped = scores.groupBy(*by) if by else scores.groupBy()
    return grouped.agg(*_metric_columns())


def pool_novel_gap(scores: DataFrame) -> DataFrame:
    """sample_acc on pool values, on novel values, and the gap; null if empty."""
    pool = F.avg(F.when(~F.col("novel"), F.col("all_hit").cast("double")))
    novel = F.avg(F.when(F.col("novel"), F.col("all_hit").cast("double")))
    return scores.agg(
        F.round(pool, 6).alias("sample_acc_pool"),
        F.round(novel, 6).alias("sample_acc_novel"),
        F.round(pool - novel, 6).alias("gap"),
    )


def axis_costs(scores: DataFrame) -> DataFrame:
    """sample_acc per axis, and what unseen values and phrasings cost."""

    def acc(axis: str) -> Column:
        return F.avg(F.when(F.col("axis") == axis, F.col("all_hit").cast("double")))

    control, values, phrasing, both = (acc(a) for a in ("control", "values", "phrasing", "both"))
    return scores.agg(
        F.round(control, 6).alias("control"),
        F.round(values, 6).alias("values_acc"),
        F.round(phrasing, 6).alias("phrasing"),
        F.round(both, 6).alias("both_acc"),
        F.round(control - values, 6).alias("cost_values"),
        F.round(control - phrasing, 6).alias("cost_phrasing"),
    )


def shape_accuracy(scores: DataFrame) -> DataFrame:
    """All-slots accuracy per shape, worst first."""
    return (
        scores.groupBy("shape")
        .agg(
            F.count("*").alias("n"),
            F.sum(_one("all_hit")).alias("n_ok"),
            F.round(F.avg(F.col("all_hit").cast("double")), 6).alias("accuracy"),
        )
        .orderBy("accuracy", "shape")
    )


def shape_match(samples: DataFrame) -> DataFrame:
    """Share of outputs with the right structure, labels ignored."""
    values = F.transform(F.array_sort(F.map_entries("slots")), lambda e: e["value"])
    same = tx.skeleton(F.col("diagram"), values) == tx.skeleton(F.col("generated"), values)
    n = F.count("*")
    return samples.agg(n.alias("n"), _share(F.sum(same.cast("bigint")), n).alias("shape_match"))


def miss_examples(scores: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` samples by id: prompt, target, output, missing slots."""
    missing = F.transform(F.filter("hits", lambda h: ~h["hit"]), lambda h: h["value"])
    first = scores.orderBy("pair_id").limit(n)
    return first.select(
        "pair_id",
        "prompt",
        tx.normalize(F.col("diagram")).alias("target"),
        tx.normalize(F.col("generated")).alias("output"),
        F.when(F.size(missing) == 0, "none").otherwise(F.array_join(missing, ", ")).alias("missing"),
    )


def corrupt(pairs: DataFrame, seed: int = CORRUPT_SEED) -> DataFrame:
    """Deterministic faulty outputs: adds ``fault`` and ``generated``."""
    d = F.col("diagram")
    h = draw.digest(seed, F.col("pair_id"), "fault")
    names = F.split(F.lit(",".join(FAULTS)), ",")
    fault = F.element_at(names, (draw.pick(h, len(FAULTS)) + 1).cast("int"))
    first = F.element_at("slots", "act_1")
    other = F.coalesce(F.element_at("slots", "act_2"), F.element_at("slots", "label_1"))
    mark = F.lit(_MARK)

    def exchange(text: Column, a: Column, b: Column) -> Column:
        return F.replace(F.replace(F.replace(text, a, mark), b, a), mark, b)

    def arrow(label: Column | str) -> Column:
        return F.concat(F.lit("-- "), F.lit(label) if isinstance(label, str) else label, F.lit(" -->"))

    # Without labelled branches there is no arrow to swap, and two labels change places.
    cases = [F.element_at("slots", f"cond_{k}") for k in (1, 2)]
    swapped = (
        F.when(F.contains(d, arrow("Yes")), exchange(d, arrow("Yes"), arrow("No")))
        .when(cases[1].isNotNull(), exchange(d, arrow(cases[0]), arrow(cases[1])))
        .otherwise(exchange(d, first, other))
    )
    node = F.instr(d, "\n    A")
    bracket = F.instr(d, "]")
    size = F.length(d)
    generated = (
        F.when(F.col("fault") == "swap_label", exchange(d, first, other))
        .when(F.col("fault") == "swap_branches", swapped)
        .when(
            F.col("fault") == "drop_first_node",
            F.concat(F.substring(d, F.lit(1), node + 4), F.substring(d, node + 6, size)),
        )
        .when(
            F.col("fault") == "mismatched_bracket",
            F.concat(F.substring(d, F.lit(1), bracket - 1), F.lit("}"), F.substring(d, bracket + 1, size)),
        )
        .when(F.col("fault") == "blank_lines", F.replace(d, F.lit("\n"), F.lit("\n\n")))
        .when(F.col("fault") == "foreign_line", F.concat(d, F.lit("\n    [*] --> Done")))
        .otherwise(d)
    )
    return pairs.withColumn("fault", fault).withColumn("generated", generated)


def self_check(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Targets scored against themselves, and faulty outputs beside them, by fault.

    ``naive_acc`` is the share of samples whose values appear anywhere in the
    output, the rule that lets swapped branches and stray values pass.
    """
    kind = F.when(F.col("fault").isin(*HARMLESS), "harmless").otherwise("known_bad")
    bad = corrupt(pairs).filter(F.col("fault") != "none").withColumn("kind", kind)
    good = pairs.withColumn("fault", F.lit("none")).withColumn("generated", F.col("diagram")).withColumn(
        "kind", F.lit("target")
    )
    both = scored(good.unionByName(bad, allowMissingColumns=True), shapes)
    naive = F.forall("hits", lambda h: F.contains(F.col("generated"), h["value"]))
    n = F.count("*")
    return both.withColumn("naive", naive).groupBy("kind", "fault").agg(
        *_metric_columns(), _share(F.sum(_one("naive")), n).alias("naive_acc")
    )


def stages(samples: DataFrame, header: Column) -> DataFrame:
    """Add ``reassembled`` and ``sanitised`` text of each output.

    The same two functions serve production and this audit.
    """
    return samples.withColumn("reassembled", tx.reassemble(F.col("generated"), header)).withColumn(
        "sanitised", tx.sanitize(F.col("reassembled"), header)
    )


def stage_audit(samples: DataFrame, header: Column) -> DataFrame:
    """In which stage did an output's first node letter vanish?"""
    has = r"^\s*graph T[DB]\s+[A-Z][\[\{]"
    staged = stages(samples, header)
    verdict = (
        F.when(~F.col("generated").rlike(has), "model")
        .when(~F.col("reassembled").rlike(has), "reassembly")
        .when(~F.col("sanitised").rlike(has), "sanitiser")
        .otherwise("kept")
    )
    return staged.withColumn("verdict", verdict)
