"""Counts and histograms, and comparing them between graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graphs, pair_tables
from . import derive

NODE_SIGNATURE = ["label", "io_tag", "n_next", "n_prev"]
EDGE_SIGNATURE = ["n_src", "n_tgt", "n_tot", "label"]


def summary(graphs: Graphs) -> DataFrame:
    """(graph_id, n_nodes, n_edges, n_inputs, n_outputs, n_node_labels, n_edge_labels)."""
    what = lambda df, w, label="label": df.select("graph_id", F.lit(w).alias("w"), F.col(label).alias("label"))
    rows = what(graphs.nodes, "n").unionAll(what(graphs.edges, "e")).unionAll(graphs.interface.select("graph_id", "kind", F.lit(None).cast("string")))
    # Counts by label first: one row for each graph, part and label meets in the second step.
    each = rows.groupBy("graph_id", "w", "label").agg(F.count("*").alias("c"))
    total = lambda w, name: F.coalesce(F.sum(F.when(F.col("w") == w, F.col("c"))), F.lit(0)).alias(name)
    kinds = lambda w, name: F.count(F.when((F.col("w") == w) & F.col("label").isNotNull(), 1)).alias(name)
    return each.groupBy("graph_id").agg(total("n", "n_nodes"), total("e", "n_edges"), total("I", "n_inputs"), total("O", "n_outputs"), kinds("n", "n_node_labels"), kinds("e", "n_edge_labels"))


def histogram(facts: DataFrame, by: list[str], keys: list[str] | None = None) -> DataFrame:
    return facts.groupBy(*(keys if keys is not None else ["graph_id"]), *by).agg(F.count("*").alias("n"))


def edge_signatures(graphs: Graphs) -> DataFrame:
    return histogram(derive.edge_facts(graphs), EDGE_SIGNATURE)


def node_signatures(graphs: Graphs) -> DataFrame:
    return histogram(derive.node_facts(graphs), NODE_SIGNATURE)


def all_histograms(graphs: Graphs, keys: list[str] | None = None) -> DataFrame:
    """(keys, histogram, bin, n): edges by sources, targets and total, nodes by tag, previous, next and total."""
    keys = ["graph_id"] if keys is None else keys
    edges = derive.edge_facts(graphs).select(*keys, F.expr("stack(3, 'edge_sources', n_src, 'edge_targets', n_tgt, 'edge_total', n_tot)").alias("histogram", "bin"))
    nodes = derive.node_facts(graphs).select(*keys, F.expr("stack(4, 'node_io_tag', cast(io_tag as bigint), 'node_prev', n_prev, 'node_next', n_next, 'node_total', n_prev + n_next)").alias("histogram", "bin"))
    return edges.unionAll(nodes).groupBy(*keys, "histogram", "bin").agg(F.count("*").alias("n"))


def neighbour_map(graphs: Graphs) -> DataFrame:
    """(graph_id, key, n): nodes by their key of first half-edges."""
    return histogram(derive.node_keys(graphs), ["key"])


def rarest_keys(graphs: Graphs) -> DataFrame:
    """(graph_id, key, n): each graph's key of fewest nodes, ties by key."""
    return neighbour_map(graphs).groupBy("graph_id").agg(F.min(F.struct("n", "key")).alias("x")).select("graph_id", "x.key", "x.n")


def endpoint_key(graphs: Graphs, columns: list[str]) -> DataFrame:
    """Incidence with a hash of the node's columns of node_facts, and its halves for sums that can't overflow."""
    key = F.xxhash64(*columns)
    keyed = derive.node_facts(graphs).select("graph_id", "node_id", key.alias("h"))
    return graphs.incidence.join(keyed, ["graph_id", "node_id"]).select("graph_id", "edge_id", "role", (F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.shiftrightunsigned("h", 32).alias("hi"))


def edge_neighbourhoods(graphs: Graphs) -> DataFrame:
    """(graph_id, edge_id, source_hash, target_hash): of the multisets of the endpoints' signatures, ports apart.

    Multisets are hashed by sums, which combine before the shuffle; hashes hold within one run only.
    """
    ends = endpoint_key(graphs, NODE_SIGNATURE)
    part = lambda role: F.xxhash64(*[F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0)) for c in ("lo", "hi")], F.count(F.when(F.col("role") == role, 1)))
    return ends.groupBy("graph_id", "edge_id").agg(part("S").alias("source_hash"), part("T").alias("target_hash"))


def difference(histograms: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(pair_id, by, n1, n2): bins whose counts differ between the graphs of a pair; none means equal."""
    side = lambda k: histograms.join(pairs.select("pair_id", F.col(f"g{k}").alias("graph_id")), "graph_id").select("pair_id", *by, F.when(F.lit(k) == 1, F.col("n")).otherwise(0).alias("n1"), F.when(F.lit(k) == 2, F.col("n")).otherwise(0).alias("n2"))
    both = side(1).unionAll(side(2)).groupBy("pair_id", *by).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    return both.where("n1 != n2")


def basic_tests(graphs: Graphs, pairs: DataFrame) -> DataFrame:
    """(pair_id, same_nodes, same_edges, same_inputs, same_outputs, same_node_labels, same_edge_labels)."""
    facts = summary(graphs)
    side = lambda k: pairs.select("pair_id", F.col(f"g{k}").alias("graph_id")).join(facts, "graph_id", "left").na.fill(0).select("pair_id", *[F.col(c).alias(f"{c}{k}") for c in facts.columns[1:]])
    both = side(1).join(side(2), "pair_id")
    return both.select("pair_id", *[(F.col(f"{c}1") == F.col(f"{c}2")).alias(c.replace("n_", "same_", 1)) for c in facts.columns[1:]])


def same_sizes(graphs: Graphs, pairs: DataFrame) -> DataFrame:
    """(pair_id, sizes_equal): nodes, edges, inputs and outputs."""
    return basic_tests(graphs, pairs).select("pair_id", F.expr("same_nodes AND same_edges AND same_inputs AND same_outputs").alias("sizes_equal"))


def pair_graphs(graphs: Graphs, pairs: DataFrame) -> tuple[Graphs, Graphs]:
    return pair_tables(graphs, pairs, 1), pair_tables(graphs, pairs, 2)
