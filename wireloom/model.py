"""The data model: open hypergraphs as long relational tables, all keyed by graph_id.

``node_id`` and ``edge_id`` are positions in the graph's own lists. ``incidence`` has a row for each endpoint of an
edge, with role S (source) or T (target) and its port; ``interface`` a row for each entry of the ordered inputs (I) and
outputs (O). A node's next edges are its S rows, its previous edges its T rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.lineage import cut_all

SCHEMAS = {
    "nodes": "graph_id long, node_id long, label string",
    "edges": "graph_id long, edge_id long, label string",
    "incidence": "graph_id long, edge_id long, node_id long, role string, port int",
    "interface": "graph_id long, node_id long, kind string, pos int",
}
PAIRS = "pair_id long, g1 long, g2 long"


@dataclass(frozen=True)
class Graphs:
    nodes: DataFrame
    edges: DataFrame
    incidence: DataFrame
    interface: DataFrame

    def map(self, change) -> Graphs:
        """The tables after change(DataFrame)."""
        return Graphs(*[change(getattr(self, f.name)) for f in fields(self)])

    def written(self) -> Graphs:
        """The tables after ``cut``."""
        return Graphs(*cut_all(*[getattr(self, f.name) for f in fields(self)]))

    def union(self, other: Graphs) -> Graphs:
        return Graphs(*[getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)])

    def only(self, ids: DataFrame) -> Graphs:
        """The graphs whose graph_id is in ids."""
        return self.map(lambda t: t.join(ids.select("graph_id"), "graph_id", "left_semi"))

    def renumber(self, graph_id) -> Graphs:
        return self.map(lambda t: t.withColumn("graph_id", graph_id))


def from_rows(spark: SparkSession, graphs: dict[int, dict]) -> Graphs:
    """Graphs given as dicts of nodes (labels), edges (label, sources, targets), inputs and outputs."""
    rows: dict[str, list] = {name: [] for name in SCHEMAS}
    for g, x in graphs.items():
        rows["nodes"] += [(g, i, label) for i, label in enumerate(x.get("nodes", []))]
        for e, (label, sources, targets) in enumerate(x.get("edges", [])):
            rows["edges"].append((g, e, label))
            rows["incidence"] += [(g, e, n, role, p) for role, ns in (("S", sources), ("T", targets)) for p, n in enumerate(ns)]
        rows["interface"] += [(g, n, kind, p) for kind, ns in (("I", x.get("inputs", [])), ("O", x.get("outputs", []))) for p, n in enumerate(ns)]
    return Graphs(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})


def pair_tables(graphs: Graphs, pairs: DataFrame, side: int) -> Graphs:
    """The graphs of one side of the pairs, with pair_id as their graph_id."""
    ids = pairs.select(F.col("pair_id"), F.col(f"g{side}").alias("graph_id"))
    return graphs.map(lambda t: t.join(ids, "graph_id").withColumn("graph_id", F.col("pair_id")).drop("pair_id"))
