"""Command line: python -m wireloom match|draw|generate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wireloom")
    do = top.add_subparsers(dest="do", required=True)
    m = do.add_parser("match", help="are two JSON graphs equal up to renumbering?")
    m.add_argument("--graph1", required=True)
    m.add_argument("--graph2", required=True)
    m.add_argument("--output1", help="folder for the first graph's DOT text")
    m.add_argument("--output2", help="folder for the second graph's DOT text")
    m.add_argument("-v", "--verbose", action="store_true", help="show the mappings")
    d = do.add_parser("draw", help="DOT text of JSON graphs")
    d.add_argument("graph_file")
    d.add_argument("--highlighted_nodes", type=_numbers, default=[])
    d.add_argument("--highlighted_edges", type=_numbers, default=[])
    d.add_argument("--output", help="folder; printed without it")
    g = do.add_parser("generate", help="random graphs as JSON lines")
    for name, default in (("num_graphs", 1), ("num_nodes", 100), ("num_edges", 20), ("num_inputs", 30), ("num_outputs", 40), ("seed", 42)):
        g.add_argument(f"--{name}", type=int, default=default)
    g.add_argument("--output_dir", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .operators import match
    from .sources import dot, generate, json_graphs

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wireloom").getOrCreate()
    if args.do == "generate":
        graphs = generate.random_hypergraphs(spark, args.num_graphs, args.num_nodes, args.num_edges, args.num_inputs, args.num_outputs, args.seed)
        json_graphs.write_json(graphs, args.output_dir)
        return 0
    if args.do == "draw":
        graphs = json_graphs.read_json(spark, args.graph_file)
        drawn = dot.draw(graphs, args.output, highlighted_nodes=args.highlighted_nodes, highlighted_edges=args.highlighted_edges)
        if not args.output:
            print(*[r.dot for r in drawn.collect()], sep="\n")
        return 0
    first, second = (json_graphs.read_json(spark, p).renumber(F.lit(k).cast("long")) for k, p in ((1, args.graph1), (2, args.graph2)))
    found = match.match(first.union(second), spark.createDataFrame([(0, 1, 2)], "pair_id long, g1 long, g2 long"))
    row = found.verdict.first()
    print("isomorphic" if row.isomorphic else f"not isomorphic: {row.reason}")
    if args.verbose and row.isomorphic:
        maps = found.permutations().first()
        print("nodes", maps.p_nodes)
        print("edges", maps.p_edges)
    for graphs, out in ((first, args.output1), (second, args.output2)):
        if out:
            dot.draw(graphs, out)
    return 0 if row.isomorphic else 1


if __name__ == "__main__":
    sys.exit(main())
