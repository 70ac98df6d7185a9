"""Text clean-up, scoring, run logs, synthesis and streams on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import evaluate as ev
from glyphmill.operators import pairs, runs, synthesize
from glyphmill.operators.bpe import Bpe
from glyphmill.session import work_path
from glyphmill.sources import grammar as g
from glyphmill.streaming import jobs


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "code, header, want",
    [
        ("A[Wash Cup} --> B[Dry Cup", "graph TD", "A[Wash Cup] --> B[Dry Cup"),
        ("A[Wash Cup", "graph TD", "A[Wash Cup]"),
        ("A{Door Open] --> B[X]", "graph TD", "A{Door Open} --> B[X]"),
        ("A{Door Open", "graph TD", "A{Door Open}"),
        ("graph TD\n\n  A[X]] --> B{Y}}\n", "graph TD", "graph TD\n    A[X] --> B{Y}"),
        ("graph TD\n[*] --> Idle\nA --> B: go\nA ->> B\nA[X]", "graph TD", "graph TD\n    A[X]"),
        ("graph TD\n[*] --> Idle", None, "graph TD\n    [*] --> Idle"),
        ("stateDiagram-v2\nsubgraph x\nB[Y]\n[*] --> Idle", "stateDiagram-v2", "stateDiagram-v2\n    [*] --> Idle"),
        ("A[one A[two] --> B[three]", "graph TD", "A[two] --> B[three]"),
        ("", "graph TD", ""),
    ],
)
def test_sanitize(spark, code, header, want):
    assert one(spark, tx.sanitize(F.col("c"), F.col("h")), c=code, h=header) == want


@pytest.mark.parametrize(
    "text, header, want",
    [
        (" graph TD\n    A[X] <|endoftext|>", "graph TD", "graph TD\n    A[X]"),
        ("well: graph TD\n    A[graph]", None, "graph TD\n    A[graph]"),
        ("Wash Cup]", None, "graph TD\n    A[Wash Cup]"),
    ],
)
def test_reassemble(spark, text, header, want):
    assert one(spark, tx.reassemble(F.col("t"), F.col("h")), t=text, h=header) == want


@pytest.mark.parametrize(
    "prompt, want",
    [
        ("wash the cup then dry it", True),
        ("First Wash Cup, then Dry Cup.", False),
        ("First Wash the cup", True),
        ("Wash", False),
        ("first 12 34", False),
        ("go Étage Öffnen", False),
    ],
)
def test_casing_warning(spark, prompt, want):
    assert one(spark, tx.casing_warning(F.col("p")), p=prompt) is want


def test_small_text_functions(spark):
    assert one(spark, tx.normalize(F.col("c")), c="graph TD\n    A[X] ") == "graph TD A[X]"
    assert [one(spark, tx.slot_category(F.col("c")), c=c) for c in ("act_1", "label_2", "x")] == ["act", "label", "x"]
    assert one(spark, tx.header_of(F.col("c")), c="graph TD\n    A") == "graph TD"
    filled = tx.fill_holes(F.col("t"), F.col("s"))
    assert one(spark, filled, t="{a_1} {{b_1}} {c_1}", s={"a_1": "X", "b_1": "Y"}) == "X {Y} {c_1}"


def test_skeleton_masks_in_slot_order(spark):
    df = spark.createDataFrame([("A[Red Cup] --> B[Cup]", ["Cup", "Red Cup"])], "c string, v array<string>")
    assert df.select(tx.skeleton(F.col("c"), F.col("v")).alias("o")).first()["o"] == "A[Red X] --> B[X]"


# -- scoring ---------------------------------------------------------------------------

SAMPLE = "pair_id long, shape string, diagram string, generated string, slots map<string,string>, novel boolean"
FORK = "graph TD\n    A[Go Up] --> B[Go In]\n    A --> C[Go On]"
FORK_SLOTS = {"act_1": "Go Up", "act_2": "Go In", "act_3": "Go On"}


def scores(spark, *rows):
    return ev.scored(spark.createDataFrame(list(rows), SAMPLE), g.grammar(spark)["shapes"])


def test_swapped_branches_pass_the_slots_and_fail_the_match(spark):
    swapped = FORK.replace("Go In", "?").replace("Go On", "Go In").replace("?", "Go On")
    row = scores(spark, (1, "fork", FORK, swapped, FORK_SLOTS, False)).first()
    assert row["all_hit"] and not row["exact"]


def test_a_label_equal_to_a_node_letter_needs_its_brackets(spark):
    slots = {"act_1": "Go Up", "cond_1": "Hot", "label_1": "B", "label_2": "D"}
    code = "graph TD\n    A[Go Up] --> B{Hot}\n    B -- Yes --> C[X]\n    B -- No --> D[D]"
    row = scores(spark, (1, "goto_labels", code, code, slots, False)).first()
    assert [h["slot"] for h in row["hits"] if not h["hit"]] == ["label_1"]
    assert (row["n_slots"], row["n_hits"]) == (4, 3)


def test_unknown_shape_falls_back_to_the_value_alone(spark):
    row = scores(spark, (1, "other", "x", "a B c", {"label_1": "B"}, False)).first()
    assert row["all_hit"]


def test_metrics_of_nothing_are_zero(spark):
    row = ev.slot_metrics(scores(spark, (1, "fork", FORK, FORK, FORK_SLOTS, False)).limit(0)).first()
    assert tuple(row) == (0, 0.0, 0.0, 0.0)
    gap = ev.pool_novel_gap(scores(spark, (1, "fork", FORK, FORK, FORK_SLOTS, False))).first()
    assert tuple(gap) == (1.0, None, None)


def test_shape_match_ignores_labels(spark):
    other = FORK.replace("Go On", "Go Off")
    rows = [(1, "fork", FORK, FORK, FORK_SLOTS, False), (2, "fork", FORK, other, FORK_SLOTS, False)]
    assert ev.shape_match(spark.createDataFrame(rows, SAMPLE)).first()["shape_match"] == 0.5


def test_targets_score_one_and_faults_do_not(spark, kit):
    ids = spark.range(800).withColumnRenamed("id", "pair_id")
    checks = {r["fault"]: r for r in ev.self_check(pairs.generate_pairs(ids, kit), g.grammar(spark)["shapes"]).collect()}
    good, bad = checks["none"], checks["drop_first_node"]
    assert (good["slot_acc"], good["sample_acc"], good["exact_match"]) == (1.0, 1.0, 1.0)
    assert bad["exact_match"] == 0 and checks["mismatched_bracket"]["sample_acc"] < checks["mismatched_bracket"]["naive_acc"]


def test_every_bad_fault_fails_the_exact_match(spark, kit):
    ids = spark.range(3000).withColumnRenamed("id", "pair_id")
    rows = {r["fault"]: r for r in ev.self_check(pairs.generate_pairs(ids, kit), g.grammar(spark)["shapes"]).collect()}
    assert set(rows) == set(ev.FAULTS)
    for fault, r in rows.items():
        good = fault == "none" or fault in ev.HARMLESS
        assert r["exact_match"] == (1.0 if good else 0.0), fault
        assert r["kind"] == ("target" if fault == "none" else "harmless" if good else "known_bad")


def test_epochs_without_val_loss_keep_their_accuracy(spark):
    rows = [(1, 1, 0.0, None, 0.9), (1, 2, 0.0, 0.4, 0.1), (1, 3, 0.0, 0.3, 0.2)]
    df = spark.createDataFrame(rows, "run long, epoch long, train_loss double, val_loss double, sample_acc double")
    r = runs.best_epoch(df).first()
    assert (r["best_epoch"], r["lowest_loss_epoch"], r["lowest_loss"]) == (1, 3, 0.3)


def test_predictions_join_their_pairs(spark):
    pairs_ = spark.createDataFrame([(1, "d"), (2, "e")], "pair_id long, diagram string")
    predictions = spark.createDataFrame([(2, "x")], "pair_id long, generated string")
    assert [tuple(r) for r in ev.join_predictions(predictions, pairs_).collect()] == [(2, "e", "x")]


# -- run logs -----------------------------------------------------------------------------


def log(spark, accuracies):
    rows = [(1, i + 1, 0.0, 1.0 / (i + 1), a) for i, a in enumerate(accuracies)]
    return spark.createDataFrame(rows, "run long, epoch long, train_loss double, val_loss double, sample_acc double")


@pytest.mark.parametrize(
    "accuracies, stop",
    [([0.1, 0.3, 0.2, 0.3, 0.3], 5), ([0.1, 0.2, 0.3], None), ([0.5, 0.4, 0.4, 0.4, 0.9], 4), ([0.0], None)],
)
def test_early_stop(spark, accuracies, stop):
    assert runs.early_stop(log(spark, accuracies)).first()["stop_epoch"] == stop


def test_best_epoch_is_the_first_best_not_the_lowest_loss(spark):
    row = runs.best_epoch(log(spark, [0.1, 0.3, 0.2, 0.3])).first()
    assert (row["best_epoch"], row["lowest_loss_epoch"]) == (2, 4)


# -- prompt to diagram ----------------------------------------------------------------------

PROMPTS = {
    "Number the nodes: one Rinse Plum, two Peel Plum.": "graph TD\n    A[Rinse Plum] --> B[Peel Plum]",
    "A switch marked Lamp Lit guards Fold Map; shut, it yields Light Lamp as drawn.": (
        "graph TD\n    A{Lamp Lit} -- Yes --> B[Fold Map]\n    A -- No --> C[Light Lamp]"
    ),
    "A back arrow returns to Pump Tyre from every failed Tyre Firm; a passed one frees Ride Home.": (
        "graph TD\n    A[Pump Tyre] --> B{Tyre Firm}\n    B -- No --> A\n    B -- Yes --> C[Ride Home]"
    ),
    "Bake Tart has two parents: Knead Dough and Stew Apple.": (
        "graph TD\n    A[Knead Dough] --> C[Bake Tart]\n    B[Stew Apple] --> C"
    ),
}
MISSES = {
    "rinse the plum and peel it": "no_title_case",
    "Number the nodes: one Rinse Plum, five Peel Plum.": "no_known_shape",
    "Please make One Diagram of Every Thing.": "no_known_shape",
    "One. Two. Three. Four. Five. Rinse Plum.": "no_known_shape",
}


def test_prompts_become_diagrams_or_are_reported(spark, kit):
    texts = list(PROMPTS) + list(MISSES)
    df = spark.createDataFrame(list(enumerate(texts)), "pair_id long, prompt string")
    found = synthesize.synthesize(df, kit.phrases, g.grammar(spark)["shapes"])
    assert {texts[r["pair_id"]]: r["generated"] for r in found.collect()} == PROMPTS
    rest = synthesize.unmatched(df, found)
    assert {r["prompt"]: r["reason"] for r in rest.collect()} == MISSES


def test_novel_labels_are_copied(spark, kit):
    ids = spark.range(1500).withColumnRenamed("id", "pair_id")
    drawn = pairs.draw_pairs(pairs.split_keys(ids).withColumn("novel", F.lit(True)), kit)
    found = synthesize.synthesize(drawn, kit.phrases, g.grammar(spark)["shapes"])
    same = drawn.join(found.select("pair_id", "generated"), "pair_id").filter("diagram = generated")
    assert same.count() == 1500


# -- streams -----------------------------------------------------------------------------------


def test_endless_pairs_are_distinct(spark, kit):
    out, state = work_path(spark, "pairs"), work_path(spark, "state")
    keys = jobs.stream_keys(spark, rows_per_second=200)
    query = jobs.append_parquet(jobs.stream_pairs(keys, kit), out, state, available_now=False)
    try:
        for _ in range(120):
            if query.awaitTermination(1) or spark.read.schema("prompt string, diagram string").parquet(out).count() > 100:
                break
    except Exception:
        pass
    query.stop()
    got = spark.read.schema("prompt string, diagram string").parquet(out)
    assert got.count() > 0 and got.count() == got.distinct().count()


def test_copies_in_a_stream_are_dropped(spark, kit):
    source, out, state = (work_path(spark, n) for n in ("keys", "out", "state"))
    spark.range(300).select((F.col("id") % 100).alias("pair_id")).write.parquet(source)
    keys = spark.readStream.schema("pair_id long").parquet(source).withColumn("arrived", F.current_timestamp())
    jobs.append_parquet(jobs.stream_pairs(keys, kit), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 100


def test_tokenizing_resumes_without_loss_or_repeat(spark):
    source, out, state = (work_path(spark, n) for n in ("docs", "out", "state"))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], schema)
    docs.filter("doc_id < 25").write.mode("append").parquet(source)
    for extra in (None, docs.filter("doc_id >= 25"), None):
        if extra is not None:
            extra.write.mode("append").parquet(source)
        jobs.stream_tokenize(spark.readStream.schema(schema).parquet(source), Bpe(()), out, state).awaitTermination()
    got = spark.read.parquet(out)
    want = jobs.tokenized(docs, Bpe(()))
    assert got.count() == 40 and got.exceptAll(want.select(got.columns)).count() == 0


def plain_mend(line):
    """The same by walking over the characters."""
    if line.count("A[") > 1:
        line = line[line.rindex("A[") :]
    out, opened = "", set()
    for c in line:
        if c in "]}":
            c = "}" if "{" in opened else "]" if "[" in opened else c
            opened = set()
            if out.endswith(c):
                continue
        elif c in "[{":
            opened.add(c)
        out += c
    for opening, closing in ("[]", "{}"):
        out += closing if opening in out and closing not in out else ""
    return out


def test_mend_equals_a_walk_over_the_characters(spark):
    import random

    rng = random.Random(12)
    lines = ["".join(rng.choice("A[]{}xA[ ") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    lines += ["A[Wash Cup} --> B[Dry Cup", "A[x]] --> B{y}}", "A[a A[b] --> C{d]", "", "no label"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = {r["k"]: r["m"] for r in df.select("k", tx.mend(F.col("line")).alias("m")).collect()}
    assert [got[k] for k in range(len(lines))] == [plain_mend(x) for x in lines]
