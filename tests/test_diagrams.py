"""Diagrams as graphs: reading, writing, tables of shapes, structural comparison."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import graphs as gr
from glyphmill.operators import diagrams, evaluate, pairs
from glyphmill.sources.grammar import grammar


def parsed(spark, *codes):
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    rows = df.select("k", gr.parse_diagram(F.col("code")).alias("g"), "code").orderBy("k")
    return [r["g"] for r in rows.collect()]


def test_reading_small_diagrams(spark):
    g, chain, odd, empty, none, single = parsed(
        spark,
        "graph TD\n    A{Is It On} -- Yes --> B[Go]\n    A -- No --> C[Stop]\n    B --> A",
        "A --> B --> C[x]\n\n  C[y] -- a b --> A",
        "graph TD\n [x] --> B[y]\n A[x} --> B[y]\n [*] --> Done\n A[x] --> B[y]",
        "",
        None,
        "flowchart LR\nA[Alone]\nB",
    )
    assert [tuple(n) for n in g.nodes] == [("A", "diamond", "Is It On"), ("B", "box", "Go"), ("C", "box", "Stop")]
    assert [tuple(e) for e in g.edges] == [(0, "A", "B", "Yes"), (1, "A", "C", "No"), (2, "B", "A", None)]
    assert g.header == "graph TD" and g.unread == []
    assert chain.header is None
    assert [tuple(n) for n in chain.nodes] == [("A", "bare", None), ("B", "bare", None), ("C", "box", "y")]
    assert [tuple(e)[1:] for e in chain.edges] == [("A", "B", None), ("B", "C", None), ("C", "A", "a b")]
    assert odd.unread == ["[x] --> B[y]", "A[x} --> B[y]", "[*] --> Done"] and len(odd.edges) == 1
    assert (empty.nodes, empty.edges, empty.unread) == ([], [], [])
    assert none is None
    assert [tuple(n) for n in single.nodes] == [("A", "box", "Alone"), ("B", "bare", None)] and single.edges == []


def test_every_pair_survives_the_round_trip(spark, kit):
    made = diagrams.with_graph(pairs.generate_pairs(spark.range(3000).withColumnRenamed("id", "pair_id"), kit))
    shapes = grammar(spark)["shapes"]
    made = diagrams.render_from_tables(made, diagrams.shape_nodes(shapes), diagrams.shape_edges(shapes))
    lost = made.filter(
        (gr.render_graph(F.col("graph")) != F.col("diagram")) | (F.col("drawn") != F.col("diagram")) | F.col("drawn").isNull()
    )
    assert lost.count() == 0


def test_shape_tables(spark):
    shapes = grammar(spark)["shapes"]
    nodes = {tuple(r) for r in diagrams.shape_nodes(shapes).filter("shape = 'loop'").collect()}
    edges = {tuple(r) for r in diagrams.shape_edges(shapes).filter("shape in ('loop', 'three_way')").collect()}
    assert nodes == {("loop", "A", "box", "act_1"), ("loop", "B", "diamond", "cond_1"), ("loop", "C", "box", "act_2")}
    assert ("loop", 1, "B", "A", "No", None) in edges
    assert ("three_way", 2, "A", "D", None, "cond_3") in edges


def digests(spark, codes, labels):
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    graph = gr.parse_diagram(F.col("code"))
    return [r[0] for r in df.select("k", graph.alias("g")).orderBy("k").select(gr.graph_digest(F.col("g"), labels)).collect()]


def drawn(nodes, edges, names):
    """A text of a graph; ``nodes``: (kind, label), ``edges``: (src, dst, label)."""
    shown = [f"{names[i]}[{label}]" if kind == "box" else f"{names[i]}{{{label}}}" for i, (kind, label) in enumerate(nodes)]
    links = [f"{names[a]} {'-- ' + label + ' ' if label else ''}--> {names[b]}" for a, b, label in edges]
    return "\n".join(["graph TD", *shown, *links])


def equal_up_to_names(one, other, labels):
    (n, e), (m, f) = one, other
    if len(n) != len(m):
        return False
    view = (lambda x: x) if labels else (lambda x: x[0])
    return any(
        all(view(n[i]) == view(m[o[i]]) for i in range(len(n)))
        and sorted((o[a], o[b], t or "") for a, b, t in e) == sorted((a, b, t or "") for a, b, t in f)
        for o in itertools.permutations(range(len(n)))
    )


@pytest.mark.parametrize("labels", [False, True])
def test_digest_equals_trying_all_namings(spark, labels):
    rng = random.Random(9)
    graphs = []
    for _ in range(40):
        n = rng.randint(1, 4)
        nodes = [(rng.choice(["box", "box", "diamond"]), rng.choice("xyz")) for _ in range(n)]
        # Acyclic links: here colours settle every case.
        edges = [(a, b, rng.choice([None, "Yes", "No"])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        graphs.append((nodes, edges))
        order = rng.sample(range(n), n)
        moved = [None] * n
        for i, o in enumerate(order):
            moved[o] = nodes[i]
        graphs.append((moved, rng.sample([(order[a], order[b], t) for a, b, t in edges], len(edges))))
    found = digests(spark, [drawn(*g, rng.sample("ABCDEFGH", len(g[0]))) for g in graphs], labels)
    for (g, x), (h, y) in itertools.combinations(zip(graphs, found), 2):
        assert (x == y) == equal_up_to_names(g, h, labels), (g, h)


def test_unread_lines_have_no_digest_and_two_empty_graphs_are_equal(spark):
    a, b, c = digests(spark, ["graph TD\n[x] --> B[y]", "", "graph TD"], True)
    assert a is None and b == c


def test_every_known_bad_fault_changes_the_graph(spark, kit):
    made = pairs.generate_pairs(spark.range(4000).withColumnRenamed("id", "pair_id"), kit)
    scored = diagrams.structure_scores(evaluate.corrupt(made))
    bad = ~F.col("fault").isin("none", *evaluate.HARMLESS)
    # The two first steps of a merge, or two branches to equal labels, may change places:
    # that is the same graph under other names.
    twins = F.coalesce(F.col("slots")["label_1"] == F.col("slots")["label_2"], F.lit(False))
    renamed = ((F.col("shape") == "merge") | twins) & F.col("fault").isin("swap_label", "swap_branches")
    changed = bad & ~renamed & (F.col("generated") != F.col("diagram"))
    wrong = scored.filter(F.col("same_graph") == changed)
    assert wrong.count() == 0
    relabelled = scored.filter(F.col("fault") == "swap_label")
    assert relabelled.filter(~F.col("same_structure")).count() == 0
    assert scored.filter(~F.col("readable") & (F.col("fault") == "mismatched_bracket")).count() > 0


def test_a_value_inside_another_does_not_mislead(spark):
    rows = [
        (1, "graph TD\n    A[Mix] --> B[Mix Dough]", "graph TD\n    Q[Mix] --> R[Mix Dough]", {"act_1": "Mix", "act_2": "Mix Dough"}),
        (2, "graph TD\n    A[Mix] --> B[Mix Dough]", "graph TD\n    A[Mix Dough] --> B[Mix]", {"act_1": "Mix", "act_2": "Mix Dough"}),
    ]
    df = spark.createDataFrame(rows, "pair_id int, diagram string, generated string, slots map<string,string>")
    got = {r["pair_id"]: (r["same_structure"], r["same_graph"]) for r in diagrams.structure_scores(df).collect()}
    assert got == {1: (True, True), 2: (True, False)}


def test_null_outputs_score_as_misses(spark):
    rows = [(1, "graph TD\n    A[x] --> B[y]", None, {"act_1": "x"})]
    df = spark.createDataFrame(rows, "pair_id int, diagram string, generated string, slots map<string,string>")
    r = diagrams.structure_report(diagrams.structure_scores(df)).first()
    assert (r["n"], r["n_readable"], r["structure_match"], r["graph_match"]) == (1, 0, 0.0, 0.0)
