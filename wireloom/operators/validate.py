"""Checks of graphs: validity, references, monogamy, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graphs
from . import derive


def graph_ids(graphs: Graphs) -> DataFrame:
    return graphs.nodes.select("graph_id").union(graphs.edges.select("graph_id")).union(graphs.interface.select("graph_id")).distinct()


def validity(graphs: Graphs) -> DataFrame:
    """(graph_id, n_nodes, n_edges, is_valid): valid is at least one node and one edge."""
    one, no = F.lit(1), F.lit(0)
    rows = graphs.nodes.select("graph_id", one.alias("n"), no.alias("m")).unionAll(graphs.edges.select("graph_id", no, one)).unionAll(graphs.interface.select("graph_id", no, no))
    counts = rows.groupBy("graph_id").agg(F.sum("n").alias("n_nodes"), F.sum("m").alias("n_edges"))
    return counts.withColumn("is_valid", (F.col("n_nodes") > 0) & (F.col("n_edges") > 0))


def dangling(graphs: Graphs) -> DataFrame:
    """(graph_id, element, element_id, node_id): edge endpoints and interface entries that name no node."""
    named = graphs.incidence.select("graph_id", F.lit("edge").alias("element"), F.col("edge_id").alias("element_id"), "node_id")
    outer = graphs.interface.select("graph_id", F.when(F.col("kind") == "I", "input").otherwise("output").alias("element"), F.col("pos").cast("long").alias("element_id"), "node_id")
    return named.unionAll(outer).join(graphs.nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").select("graph_id", "element", "element_id", "node_id")


def require_references(graphs: Graphs) -> Graphs:
    """The graphs, if every endpoint names a node; else an error that names an edge's label."""
    bad = dangling(graphs)
    row = bad.where("element = 'edge'").withColumnRenamed("element_id", "edge_id").join(graphs.edges, ["graph_id", "edge_id"]).select("label").first()
    if row:
        raise ValueError(f"Edge {row.label} has nodes not in hypergraph nodes")
    if not bad.isEmpty():
        raise ValueError("The interface has nodes not in hypergraph nodes")
    return graphs


def monogamy(graphs: Graphs) -> DataFrame:
    """(graph_id, is_monogamous): no node has two next or two previous half-edges."""
    branching = (F.max(F.greatest("n_next", "n_prev")) <= 1).alias("is_monogamous")
    return derive.node_facts(graphs).groupBy("graph_id").agg(branching)


def consistency(graphs: Graphs) -> DataFrame:
    """(graph_id, side, by_nodes, by_edges): half-edges of each role counted by node and by edge, where they differ."""
    def counted(facts: DataFrame, s: str, t: str, name: str) -> DataFrame:
        totals = facts.groupBy("graph_id").agg(F.sum(s).alias("S"), F.sum(t).alias("T"))
        return totals.select("graph_id", F.expr("stack(2, 'S', S, 'T', T)").alias("side", name))

    both = counted(derive.node_facts(graphs), "n_next", "n_prev", "by_nodes").join(counted(derive.edge_facts(graphs), "n_src", "n_tgt", "by_edges"), ["graph_id", "side"], "full")
    return both.where("NOT coalesce(by_nodes, 0) <=> coalesce(by_edges, 0)")
