"""Columns derived from the tables: degrees, arities, interface tags, half-edges, compressed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graphs

NODE, EDGE = ["graph_id", "node_id"], ["graph_id", "edge_id"]


def node_facts(graphs: Graphs) -> DataFrame:
    """(graph_id, node_id, label, io_tag, n_next, n_prev): io_tag is 0, 1 (input), 2 (output) or 3 (both).

    Nodes, endpoints and interface entries are counted in one shuffle.
    """
    no = F.lit(0)
    parts = [
        graphs.nodes.select(*NODE, "label", no.alias("s"), no.alias("t"), no.alias("i"), no.alias("o"), F.lit(1).alias("here")),
        graphs.incidence.select(*NODE, F.lit(None).cast("string"), (F.col("role") == "S").cast("int"), (F.col("role") == "T").cast("int"), no, no, no),
        graphs.interface.select(*NODE, F.lit(None).cast("string"), no, no, (F.col("kind") == "I").cast("int"), (F.col("kind") == "O").cast("int"), no),
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    facts = rows.groupBy(*NODE).agg(F.max("label").alias("label"), (F.max("i") + 2 * F.max("o")).alias("io_tag"), F.sum("s").alias("n_next"), F.sum("t").alias("n_prev"), F.max("here").alias("here"))
    return facts.where("here = 1").drop("here")


def edge_facts(graphs: Graphs) -> DataFrame:
    """(graph_id, edge_id, label, n_src, n_tgt, n_tot)."""
    no = F.lit(0)
    rows = graphs.edges.select(*EDGE, "label", no.alias("s"), no.alias("t"), F.lit(1).alias("here")).unionAll(
        graphs.incidence.select(*EDGE, F.lit(None).cast("string"), (F.col("role") == "S").cast("int"), (F.col("role") == "T").cast("int"), no)
    )
    facts = rows.groupBy(*EDGE).agg(F.max("label").alias("label"), F.sum("s").alias("n_src"), F.sum("t").alias("n_tgt"), F.max("here").alias("here"))
    return facts.where("here = 1").drop("here").withColumn("n_tot", F.col("n_src") + F.col("n_tgt"))


def half_edges(graphs: Graphs) -> DataFrame:
    """Incidence with the edge's label and arities: next half-edges are S rows, previous ones T rows."""
    return graphs.incidence.join(edge_facts(graphs), EDGE)


def first_half_edges(graphs: Graphs) -> DataFrame:
    """(graph_id, node_id, next, prev): each node's first half-edge by edge and port, as a struct; null where none."""
    ends = graphs.incidence.join(graphs.edges, EDGE)
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("edge_id", "port", "label")))
    return graphs.nodes.select(*NODE).join(ends.groupBy(*NODE).agg(first("S").alias("next"), first("T").alias("prev")), NODE, "left")


def node_keys(graphs: Graphs) -> DataFrame:
    """(graph_id, node_id, key): label and port of the first next and first previous half-edge."""
    part = lambda c: F.coalesce(F.concat(F.col(f"{c}.label"), F.col(f"{c}.port").cast("string")), F.lit("___"))
    return first_half_edges(graphs).select(*NODE, F.concat(F.lit("i:"), part("next"), F.lit("_o:"), part("prev")).alias("key"))


def max_arity(graphs: Graphs) -> DataFrame:
    """(graph_id, max_arity): the most nodes on one side of an edge."""
    return edge_facts(graphs).groupBy("graph_id").agg(F.max(F.greatest("n_src", "n_tgt")).alias("max_arity"))


#: Prefix sums run inside ranges of so many ids, and over the sums of the ranges.
RANGE = 1 << 16


def _prefix(name: str, by: list[str], order: str) -> Column:
    """Exclusive prefix sum."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(frame), F.lit(0))


def csr_offsets(graphs: Graphs) -> DataFrame:
    """(graph_id, node_id, n_next, n_prev, next_offset, prev_offset)."""
    part = F.floor(F.col("node_id") / RANGE).alias("part")
    facts = node_facts(graphs).select(*NODE, "n_next", "n_prev", part)
    sums = facts.groupBy("graph_id", "part").agg(F.sum("n_next").alias("a"), F.sum("n_prev").alias("b"))
    before = sums.select("graph_id", "part", _prefix("a", ["graph_id"], "part").alias("a"), _prefix("b", ["graph_id"], "part").alias("b"))
    offset = lambda base, name: F.col(base) + _prefix(name, ["graph_id", "part"], "node_id")
    return facts.join(before, ["graph_id", "part"]).select(*NODE, "n_next", "n_prev", offset("a", "n_next").alias("next_offset"), offset("b", "n_prev").alias("prev_offset"))


def csr(graphs: Graphs) -> DataFrame:
    """(graph_id, edge_sources, edge_targets, node_next, node_prev): packed lists of one graph a row, for export.

    Edges' nodes stand in edge and port order, nodes' edges in node, edge and port order.
    """
    def packed(rows: DataFrame, role: str, order: list[str], value: str, out: str) -> DataFrame:
        keyed = rows.where(F.col("role") == role).select("graph_id", F.struct(*order, F.col(value).alias("value")).alias("x"))
        return keyed.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda s: s["value"]).alias(out))

    out = graphs.nodes.select("graph_id").union(graphs.edges.select("graph_id")).distinct()
    for role, order, value, name in (("S", ["edge_id", "port"], "node_id", "edge_sources"), ("T", ["edge_id", "port"], "node_id", "edge_targets"), ("S", ["node_id", "edge_id", "port"], "edge_id", "node_next"), ("T", ["node_id", "edge_id", "port"], "edge_id", "node_prev")):
        out = out.join(packed(graphs.incidence, role, order, value, name), "graph_id", "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<bigint>)")))
    return out


def label_dictionary(elements: DataFrame, key: str) -> DataFrame:
    """(graph_id, label, code): labels numbered in order of first appearance. Not comparable between graphs."""
    first = elements.groupBy("graph_id", "label").agg(F.min(key).alias("first"))
    return first.select("graph_id", "label", (F.row_number().over(Window.partitionBy("graph_id").orderBy("first")) - 1).alias("code"))


def sorted_edges(graphs: Graphs) -> DataFrame:
    """(graph_id, edge_id, position): place of each edge by (sources, targets, total, label), ties by edge_id."""
    by = ["n_src", "n_tgt", "n_tot", "label"]
    part = F.floor(F.col("edge_id") / RANGE).alias("part")
    facts = edge_facts(graphs).select(*EDGE, *by, part)
    # Groups of a signature and a range of ids are counted first: a graph's window meets these, not its edges.
    counts = facts.groupBy("graph_id", *by, "part").agg(F.count("*").alias("n"))
    frame = Window.partitionBy("graph_id").orderBy(*by, "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("graph_id", *[F.col(c).alias(f"s_{c}") for c in [*by, "part"]], F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("before")).withColumnRenamed("graph_id", "g")
    same = F.col("graph_id") == F.col("g")
    for c in [*by, "part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    inside = F.row_number().over(Window.partitionBy("graph_id", *by, "part").orderBy("edge_id"))
    return facts.join(first, same).select(*EDGE, (F.col("before") + inside - 1).alias("position"))
