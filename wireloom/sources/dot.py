"""Graphviz text of graphs, and the printable listing."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..model import Graphs
from ..operators import validate
from .json_graphs import edge_lists

ORIENTATIONS = ("LR", "TB")


def to_dot(graphs: Graphs, orientation: str = "LR", highlighted_nodes: Iterable[int] = (), highlighted_edges: Iterable[int] = (), node_colours: DataFrame | None = None, edge_colours: DataFrame | None = None) -> DataFrame:
    """(graph_id, dot). Nodes are circles, edges boxes, arrows carry the port; inputs and outputs are points.

    node_colours (graph_id, node_id, colour) and edge_colours (graph_id, edge_id, colour) fill the shapes. Lines: first the
    nodes, then the edges, arrows by edge, role and port, the interface. A graph must fit in a row.
    """
    if orientation not in ORIENTATIONS:
        raise ValueError(f"Orientation must be one of {', '.join(ORIENTATIONS)}")
    nodes = graphs.nodes.join(node_colours, ["graph_id", "node_id"], "left") if node_colours is not None else graphs.nodes.withColumn("colour", F.lit(None).cast("long"))
    edges = edge_lists(graphs)
    edges = edges.join(edge_colours, ["graph_id", "edge_id"], "left") if edge_colours is not None else edges.withColumn("colour", F.lit(None).cast("long"))
    text = lambda x: x.cast("string")
    line = lambda df, block, a, b, c, *parts: df.select("graph_id", F.struct(F.lit(block).alias("block"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), F.concat(*parts).alias("line")).alias("x"))
    zero = F.lit(0)
    i, e = F.col("node_id"), F.col("edge_id")
    signature = labels.edge_signature(e, F.col("source_nodes"), F.col("target_nodes"))
    lines = [
        line(nodes, 0, i, zero, zero, F.lit("  n"), text(i), F.lit(' [shape=circle, label="'), labels.node_text(F.col("label"), i), F.lit('", color="'), labels.style(i, list(highlighted_nodes), F.col("colour"), "set19"), F.lit('"];')),
        line(edges, 1, e, zero, zero, F.lit("  e"), text(e), F.lit(' [shape=box, label="'), labels.edge_text(F.col("label"), e, signature), F.lit('", color="'), labels.style(e, list(highlighted_edges), F.col("colour"), "paired12"), F.lit('"];')),
        line(graphs.incidence, 2, e, F.when(F.col("role") == "S", 0).otherwise(1), F.col("port"), F.when(F.col("role") == "S", F.concat(F.lit("  n"), text(i), F.lit(" -> e"), text(e))).otherwise(F.concat(F.lit("  e"), text(e), F.lit(" -> n"), text(i))), F.lit(' [label="'), text(F.col("port")), F.lit('"];')),
        line(graphs.interface, 3, F.when(F.col("kind") == "I", 0).otherwise(1), F.col("pos"), zero, F.when(F.col("kind") == "I", F.concat(F.lit("  i"), text(F.col("pos")), F.lit(" -> n"), text(i))).otherwise(F.concat(F.lit("  n"), text(i), F.lit(" -> o"), text(F.col("pos")))), F.lit(";")),
    ]
    every = lines[0]
    for x in lines[1:]:
        every = every.unionAll(x)
    body = every.groupBy("graph_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return body.select("graph_id", F.concat(F.lit(f"digraph {{\n  rankdir={orientation};\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("dot"))


def draw(graphs: Graphs, path: str | None = None, verbose: bool = False, **options) -> DataFrame:
    """DOT text of valid graphs, written as text files under path if given; an invalid graph raises."""
    bad = validate.validity(graphs).where("NOT is_valid")
    if not bad.isEmpty():
        raise ValueError("Hypergraph is not valid")
    dots = to_dot(graphs, **options)
    if path:
        dots.select("dot").write.text(path)
        if verbose:
            logging.getLogger(__name__).info("Diagram text saved under %s", path)
    return dots


def listing(graphs: Graphs) -> DataFrame:
    """(graph_id, part, number, text): nodes, edges with their lists, inputs, outputs, in print order."""
    show = lambda df, part, n, value: df.select("graph_id", F.lit(part).alias("part"), n.cast("long").alias("number"), value.alias("text"))
    lists = edge_lists(graphs)
    rows = [
        show(graphs.nodes, 0, F.col("node_id"), labels.display_label(F.col("label"), F.col("node_id"))),
        show(lists, 1, F.col("edge_id"), F.concat_ws(" ", F.col("label"), labels.list_text(F.col("source_nodes")), F.lit("->"), labels.list_text(F.col("target_nodes")))),
        show(graphs.interface, 2, F.when(F.col("kind") == "I", F.col("pos")).otherwise(F.col("pos") + (1 << 32)), F.concat_ws(" ", "kind", F.col("node_id").cast("string"))),
    ]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])
