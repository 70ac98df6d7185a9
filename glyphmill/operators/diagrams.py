"""Diagrams as node and edge tables, and scoring by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import graphs as gr
from glyphmill.functions import text as tx


def with_graph(df: DataFrame, code: str = "diagram", name: str = "graph") -> DataFrame:
    """Add the graph of a text column."""
    return df.withColumn(name, gr.parse_diagram(F.col(code)))


def graph_nodes(df: DataFrame, *keys: str, graph: str = "graph") -> DataFrame:
    """One row per node: keys, ``node, kind, label``."""
    return df.select(*keys, F.explode(F.col(graph)["nodes"]).alias("_n")).select(*keys, "_n.*")


def graph_edges(df: DataFrame, *keys: str, graph: str = "graph") -> DataFrame:
    """One row per edge: keys, ``pos, src, dst, label``."""
    return df.select(*keys, F.explode(F.col(graph)["edges"]).alias("_e")).select(*keys, "_e.*")


def _hole(label: Column) -> Column:
    """The slot a label stands for, null for a fixed label."""
    name = F.regexp_extract(F.coalesce(label, F.lit("")), f"^{tx.SLOT_HOLE}$|^([a-z]+_[0-9]+)$", 0)
    return F.when(name != "", F.translate(name, "{}", ""))


def shape_nodes(shapes: DataFrame) -> DataFrame:
    """``shape, node_id, kind, slot`` of every pattern."""
    found = graph_nodes(with_graph(shapes, "pattern"), "shape")
    return found.select("shape", F.col("node").alias("node_id"), "kind", _hole(F.col("label")).alias("slot"))


def shape_edges(shapes: DataFrame) -> DataFrame:
    """``shape, pos, src, dst, label, slot`` of every pattern; a label that is a hole gives its slot instead."""
    found = graph_edges(with_graph(shapes, "pattern"), "shape").withColumn("slot", _hole(F.col("label")))
    return found.withColumn("label", F.when(F.col("slot").isNull(), F.col("label")))


def pattern_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``shape, graph`` from node and edge tables, holes in place of slots; one row per shape."""
    hole = F.concat(F.lit("{"), "slot", F.lit("}"))
    # Nodes are listed in the order of their first edge, as a parsed text has them.
    ends = edges.select("shape", F.explode(F.array(
        F.struct((F.col("pos") * 2).alias("at"), F.col("src").alias("node_id")),
        F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("dst").alias("node_id")),
    )).alias("e")).groupBy("shape", "e.node_id").agg(F.min("e.at").alias("at"))
    node = F.struct("at", F.col("node_id").alias("node"), "kind", hole.alias("label"))
    listed = nodes.join(ends, ["shape", "node_id"], "left").groupBy("shape").agg(F.array_sort(F.collect_list(node)).alias("ns"))
    edge = F.struct("pos", "src", "dst", F.coalesce(hole, "label").alias("label"))
    linked = edges.groupBy("shape").agg(F.array_sort(F.collect_list(edge)).alias("es"))
    plain = F.transform("ns", lambda n: F.struct(n["node"].alias("node"), n["kind"].alias("kind"), n["label"].alias("label")))
    return listed.join(linked, "shape").select(
        "shape",
        F.struct(
            F.lit(tx.DEFAULT_HEADER).alias("header"),
            plain.alias("nodes"),
            F.col("es").alias("edges"),
            F.array().cast("array<string>").alias("unread"),
        ).alias("graph"),
    )


def render_from_tables(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``drawn``: each pair's diagram from the node and edge tables of its shape and its slots.

    The tables hold one row per node or edge of a shape, so their graphs (one
    row per shape) are broadcast.
    """
    patterns = pattern_graphs(nodes, edges).select("shape", gr.render_graph(F.col("graph")).alias("_pattern"))
    drawn = pairs.join(F.broadcast(patterns), "shape", "left")
    return drawn.withColumn("drawn", tx.fill_holes(F.col("_pattern"), F.col("slots"))).drop("_pattern")


def structure_scores(samples: DataFrame) -> DataFrame:
    """Add ``readable``, ``same_structure`` and ``same_graph`` to samples with ``diagram, generated, slots``.

    ``same_structure``: equal kinds, links and fixed branch labels whatever the
    names and labels; ``same_graph``: equal labels too.  Unlike masking values
    in the text, neither is misled by a value inside another one.
    """
    values = F.map_values("slots")
    both = with_graph(with_graph(samples, "diagram", "_target"), "generated", "_output")

    def same(labels: bool, masked: Column | None) -> Column:
        a, b = (gr.graph_digest(F.col(c), labels, masked) for c in ("_target", "_output"))
        return F.coalesce(a == b, F.lit(False))

    return (
        both.withColumn("readable", F.size(F.col("_output")["unread"]) == 0)
        .withColumn("same_structure", same(False, values))
        .withColumn("same_graph", same(True, None))
        .drop("_target", "_output")
    )


def structure_report(scores: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of readable outputs, right structures and right graphs."""
    n = F.count("*")

    def share(flag: str) -> Column:
        return F.round(F.count_if(flag) / F.greatest(F.lit(1), n), 6)

    return scores.groupBy(*by).agg(
        n.alias("n"),
        F.count_if("readable").alias("n_readable"),
        share("same_structure").alias("structure_match"),
        share("same_graph").alias("graph_match"),
    )
