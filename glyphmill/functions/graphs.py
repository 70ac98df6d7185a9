"""Diagrams as graphs: node and edge arrays of a text, the text again, and digests of a graph.

All of it is column expressions, so a diagram is read, compared and written
where its row lies.  A graph is

    struct<header string,
           nodes array<struct<node string, kind string, label string>>,
           edges array<struct<pos int, src string, dst string, label string>>,
           unread array<string>>

Nodes come in the order of their first mention and edges in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import text as tx

BOX, DIAMOND, BARE = "box", "diamond", "bare"

_HEADER = r"^(graph|flowchart)\s+\w+$"
# A link with or without a label, between blanks.
_LINK = r"\s+--(?:\s+(\S.*?)\s+--)?>\s+"
_NODE = r"^(\w+)(?:\[(.*)\]|\{(.*)\})?$"
# Between parts of a read line; texts that hold it are not diagrams.
_MARK = "\u0001"

NODE = "struct<node:string,kind:string,label:string>"
EDGE = "struct<pos:int,src:string,dst:string,label:string>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside loops over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mention(text: Column) -> Column:
    """One end of a link: name, and kind and label where it has brackets."""
    kind = F.when(text.endswith("]"), BOX).when(text.endswith("}"), DIAMOND)
    label = F.when(kind == BOX, F.regexp_extract(text, _NODE, 2)).when(kind == DIAMOND, F.regexp_extract(text, _NODE, 3))
    return F.struct(
        F.regexp_extract(text, _NODE, 1).alias("node"), kind.alias("kind"), label.alias("label")
    )


def _read_line(line: Column) -> Column:
    """A body line as its ends, the labels between them, and whether all of it could be read."""
    ends = F.split(F.regexp_replace(line, _LINK, _MARK), _MARK)
    return F.struct(
        F.transform(ends, _mention).alias("ends"),
        F.regexp_extract_all(line, F.lit(_LINK), F.lit(1)).alias("labels"),
        (F.forall(ends, lambda e: e.rlike(_NODE)) & ~F.contains(line, F.lit(_MARK))).alias("clear"),
        line.alias("line"),
    )


def parse_diagram(code: Column) -> Column:
    """The graph of a diagram text; null stays null.

    Chained links and lines with a single node are read.  A node mentioned with
    brackets more than once keeps the last kind and label; one without any is
    bare.  A line that cannot be read as a whole lands in ``unread`` and adds
    nothing; a missing header is null.  Empty text is a graph of nothing.
    """
    lines = F.filter(F.transform(F.split(code, "\n"), tx.strip), lambda x: x != "")

    def graph(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        headed = F.coalesce(first.rlike(_HEADER), F.lit(False))
        body = F.when(headed, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        return _let(F.transform(body, _read_line), lambda read: _graph(F.when(headed, first), read))

    return F.when(code.isNotNull(), _let(lines, graph))


def _graph(header: Column, read: Column) -> Column:
    clear = F.filter(read, lambda r: r["clear"])
    mentions = F.flatten(F.transform(clear, lambda r: r["ends"]))
    links = F.flatten(
        F.transform(
            clear,
            lambda r: F.transform(
                r["labels"],
                lambda label, k: F.struct(
                    F.get(r["ends"], k)["node"].alias("src"),
                    F.get(r["ends"], k + 1)["node"].alias("dst"),
                    F.when(label != "", label).alias("label"),
                ),
            ),
        )
    )

    def node(name: Column, mentions: Column) -> Column:
        drawn = F.filter(mentions, lambda m: (m["node"] == name) & m["kind"].isNotNull())
        last = F.get(drawn, F.size(drawn) - 1)
        return F.struct(
            name.alias("node"), F.coalesce(last["kind"], F.lit(BARE)).alias("kind"), last["label"].alias("label")
        )

    def nodes(mentions: Column) -> Column:
        names = F.array_distinct(F.transform(mentions, lambda m: m["node"]))
        return F.transform(names, lambda n: node(n, mentions)).cast(f"array<{NODE}>")

    edges = F.transform(
        links, lambda e, k: F.struct(k.alias("pos"), e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"))
    )
    return F.struct(
        header.alias("header"),
        _let(mentions, nodes).alias("nodes"),
        edges.cast(f"array<{EDGE}>").alias("edges"),
        F.transform(F.filter(read, lambda r: ~r["clear"]), lambda r: r["line"]).alias("unread"),
    )


def render_graph(graph: Column) -> Column:
    """The text of a graph, one line per edge, then one per node without edges.

    A node is drawn with its brackets where it is first mentioned.  Unread
    lines are not part of the graph and are not written.
    """
    edges, nodes = graph["edges"], graph["nodes"]
    ends = F.flatten(F.transform(edges, lambda e: F.array(e["src"], e["dst"])))

    def shown(name: Column, at: Column, ends: Column) -> Column:
        n = F.get(F.filter(nodes, lambda n: n["node"] == name), F.lit(0))
        full = (
            F.when(n["kind"] == BOX, F.concat(name, F.lit("["), n["label"], F.lit("]")))
            .when(n["kind"] == DIAMOND, F.concat(name, F.lit("{"), n["label"], F.lit("}")))
            .otherwise(name)
        )
        return F.when(F.array_position(ends, name) == at + 1, full).otherwise(name)

    def lines(ends: Column) -> Column:
        linked = F.transform(
            edges,
            lambda e, k: F.concat(
                shown(e["src"], k * 2, ends),
                F.when(e["label"].isNull(), F.lit(" --> ")).otherwise(F.concat(F.lit(" -- "), e["label"], F.lit(" --> "))),
                shown(e["dst"], k * 2 + 1, ends),
            ),
        )
        alone = F.filter(nodes, lambda n: ~F.array_contains(ends, n["node"]))
        singles = F.transform(alone, lambda n: shown(n["node"], F.lit(0), F.array(n["node"])))
        return F.concat(F.when(graph["header"].isNull(), F.array().cast("array<string>")).otherwise(F.array(graph["header"])), linked, singles)

    return F.when(graph.isNotNull(), F.array_join(_let(ends, lines), tx.LINE_BREAK))


def graph_digest(graph: Column, labels: bool, masked: Column | None = None) -> Column:
    """A digest that ignores the names of nodes, the order of lines and the header.

    Colour refinement: a node starts with its kind (and its label if ``labels``)
    and takes up the colours around it, along and against its edges, until as
    many rounds as there are nodes have passed; the digest is over the sorted
    colours of all nodes.  Graphs that differ only in node names get the same
    digest.  Graphs told apart by kinds, labels, degrees or anything their walks
    meet get different ones, which covers every graph whose nodes differ in
    label; without labels, some regular graphs (such as one ring of six and two
    rings of three) share a digest.

    Edge labels count, except those in ``masked`` (an array of slot values),
    which all count as one.  A graph with unread lines is no whole graph: its
    digest is null.
    """
    nodes, edges = graph["nodes"], graph["edges"]
    names = F.transform(nodes, lambda n: n["node"])

    def edge_label(label: Column) -> Column:
        shown = F.coalesce(F.concat(F.lit("="), label), F.lit("-"))
        if masked is None:
            return shown
        return F.when(F.coalesce(F.array_contains(masked, label), F.lit(False)), F.lit("X")).otherwise(shown)

    def links(names: Column) -> Column:
        return F.transform(
            edges,
            lambda e: F.struct(
                F.array_position(names, e["src"]).alias("src"),
                F.array_position(names, e["dst"]).alias("dst"),
                F.md5(edge_label(e["label"]).cast("binary")).alias("label"),
            ),
        )

    def own(n: Column) -> Column:
        text = F.concat_ws("|", n["kind"], F.coalesce(n["label"], F.lit(""))) if labels else n["kind"]
        return F.md5(text.cast("binary"))

    def around(colours: Column, links: Column, at: Column, here: str, there: str) -> Column:
        met = F.transform(
            F.filter(links, lambda e: e[here] == at + 1),
            lambda e: F.concat(e["label"], F.element_at(colours, e[there].cast("int"))),
        )
        return F.array_join(F.array_sort(met), ",")

    def refine(colours: Column, links: Column) -> Column:
        return F.transform(
            colours,
            lambda c, at: F.md5(
                F.concat_ws(
                    "|", c, around(colours, links, at, "src", "dst"), around(colours, links, at, "dst", "src")
                ).cast("binary")
            ),
        )

    def digest(links: Column) -> Column:
        rounds = F.slice(F.sequence(F.lit(0), F.size(nodes)), F.lit(2), F.size(nodes))
        colours = F.aggregate(rounds, F.transform(nodes, own), lambda c, _: refine(c, links))
        return F.md5(F.array_join(F.array_sort(colours), ",").cast("binary"))

    return F.when(F.size(graph["unread"]) == 0, _let(_let(names, links), digest))


def listed_nodes(graph: Column) -> Column:
    """Nodes as ``A:box:Label`` lines."""
    return F.array_join(
        F.transform(graph["nodes"], lambda n: F.concat_ws(":", n["node"], n["kind"], F.coalesce(n["label"], F.lit("")))), "\n"
    )


def listed_edges(graph: Column) -> Column:
    """Edges as ``A>B:label`` lines."""
    return F.array_join(
        F.transform(graph["edges"], lambda e: F.concat(e["src"], F.lit(">"), e["dst"], F.lit(":"), F.coalesce(e["label"], F.lit("")))),
        "\n",
    )
