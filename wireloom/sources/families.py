"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graphs
from ..plans.lineage import cut


#: Line numbers repeat, so edges are numbered in the order of all other columns.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _interface(df: DataFrame, kind: str, node, pos=0) -> DataFrame:
    return df.select("graph_id", node.cast("long").alias("node_id"), F.lit(kind).alias("kind"), (pos if not isinstance(pos, int) else F.lit(pos)).cast("int").alias("pos"))


def event_chains(spark: SparkSession, sf_dir: str) -> Graphs:
    """A chain for each user and day: the k-th event by time is edge k from node k to node k + 1."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    events = events.select((F.col("user_id") * 100_000 + day).alias("graph_id"), "ts", "event_id", F.col("event_type").alias("label"))
    k = F.row_number().over(Window.partitionBy("graph_id").orderBy("ts", "event_id")) - 1
    steps = events.withColumn("edge_id", k.cast("long")).select("graph_id", "edge_id", "label")
    ends = F.explode(F.array(F.struct(F.col("edge_id").alias("node_id"), F.lit("S").alias("role")), F.struct((F.col("edge_id") + 1).alias("node_id"), F.lit("T").alias("role"))))
    lengths = steps.groupBy("graph_id").agg((F.max("edge_id") + 1).alias("n"))
    nodes = lengths.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("node_id"), F.lit("state").alias("label"))
    incidence = steps.select("graph_id", "edge_id", ends.alias("x")).select("graph_id", "edge_id", "x.node_id", "x.role", F.lit(0).alias("port"))
    interface = _interface(lengths, "I", F.lit(0)).unionByName(_interface(lengths, "O", F.col("n")))
    return Graphs(nodes, steps, incidence, interface)


def order_boxes(spark: SparkSession, sf_dir: str, keep: bool = False) -> Graphs:
    """A graph for each order that has lines: parts and suppliers flow by line into the order.

    Nodes: parts ascending (label: the part's type), suppliers ascending (label supplier), the order (label: its priority).
    Edges: lines in the order of all their columns. Inputs: the parts; output: the order. With ``keep`` the lines' ends
    are written once, for plans that read several of the tables.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    lines = lines.withColumn("edge_id", number.cast("long"))
    lines = lines.select(F.col("l_orderkey").alias("graph_id"), "edge_id", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label"))
    ends = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(role).alias("role"), F.lit(port).alias("port")) for kind, key, role, port in ((0, "l_partkey", "S", 0), (1, "l_suppkey", "S", 1), (2, "graph_id", "T", 0))]))
    # A node's number is its key's place among the graph's, and its first row stands for it: all in the shuffle that brings an order's lines together.
    order = Window.partitionBy("graph_id").orderBy("kind", "key")
    own = F.struct("kind", "key")
    ends = lines.select("graph_id", "edge_id", "label", ends.alias("x")).select("graph_id", "edge_id", F.when(F.col("x.kind") == 2, F.col("label")).alias("label"), "x.*")
    ends = ends.withColumns({"node_id": (F.dense_rank().over(order) - 1).cast("long"), "first": ~own.eqNullSafe(F.lag(own).over(order))})
    ends = cut(ends) if keep else ends
    keys = ends.where("first").select("graph_id", "node_id", "kind", "key")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("plabel"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderpriority").alias("olabel"))
    parts = keys.where("kind = 0").join(part, "key", "left").select("graph_id", "node_id", F.coalesce("plabel", F.lit("")).alias("label"))
    suppliers = keys.where("kind = 1").select("graph_id", "node_id", F.lit("supplier").alias("label"))
    whole = keys.where("kind = 2").join(orders, "graph_id", "left").select("graph_id", "node_id", F.coalesce("olabel", F.lit("")).alias("label"))
    incidence = ends.where("key IS NOT NULL").select("graph_id", "edge_id", "node_id", "role", "port")
    interface = _interface(keys.where("kind = 0"), "I", F.col("node_id"), F.col("node_id")).unionByName(_interface(keys.where("kind = 2"), "O", F.col("node_id")))
    edges = ends.where("kind = 2") if keep else lines
    return Graphs(parts.unionAll(suppliers).unionAll(whole), edges.select("graph_id", "edge_id", "label"), incidence, interface)


def supply_network(spark: SparkSession, sf_dir: str) -> Graphs:
    """One graph: an edge for each order that has lines, from its parts to its customer.

    Part p is node 2p, customer c node 2c + 1.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), "o_custkey", F.col("o_orderpriority").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), "l_partkey")
    sources = orders.join(lines, "edge_id").select("edge_id", (F.col("l_partkey") * 2).alias("node_id")).distinct()
    port = (F.row_number().over(Window.partitionBy("edge_id").orderBy("node_id")) - 1).cast("int")
    s = sources.select("edge_id", "node_id", F.lit("S").alias("role"), port.alias("port"))
    with_parts = orders.join(sources.select("edge_id").distinct(), "edge_id", "left_semi")
    t = with_parts.select("edge_id", (F.col("o_custkey") * 2 + 1).alias("node_id"), F.lit("T").alias("role"), F.lit(0).alias("port"))
    incidence = s.unionByName(t).select(F.lit(0).cast("long").alias("graph_id"), "*")
    kind = F.when(F.col("node_id") % 2 == 0, "part").otherwise("customer")
    nodes = incidence.select("graph_id", "node_id").distinct().withColumn("label", kind)
    edges = with_parts.select(F.lit(0).cast("long").alias("graph_id"), "edge_id", "label")
    return Graphs(nodes, edges, incidence, spark.createDataFrame([], "graph_id long, node_id long, kind string, pos int"))
