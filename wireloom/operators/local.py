"""Colour refinement of graphs that fit a task: each is gathered once and refined there, many in one pass.

A round of ``refine`` is some joins over all graphs, so many small graphs pay for a shuffle a round. Here the rows of a graph
meet in one task by a single shuffle, and numpy refines a batch of graphs at a time. Graphs of more than LIMIT rows, and those that
are not well formed (nulls, repeated ids, dangling references), are named for the distributed way and not read here. Rows are
shuffled in slices of about SLICE rows, so the disk in use at a time doesn't grow with the number of graphs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graphs
from ..plans.lineage import cut

#: Rows (nodes, edges, endpoints, interface entries) of a graph that one task takes, of a batch, and of a slice.
LIMIT, BATCH, SLICE = 1 << 15, 1 << 18, 1 << 25
NODE, EDGE, END, OUTER = range(4)
ROLES, KINDS = ("S", "T"), ("I", "O")


def _rows(graphs: Graphs) -> DataFrame:
    """(graph_id, tag, a, b, p, s): every row of the four tables."""
    none, zero = F.lit(0).cast("long").alias("b"), F.lit(0).alias("p")
    tag = lambda t: F.lit(t).cast("tinyint").alias("tag")
    nodes = graphs.nodes.select("graph_id", tag(NODE), F.col("node_id").alias("a"), none, zero, F.col("label").alias("s"))
    edges = graphs.edges.select("graph_id", tag(EDGE), F.col("edge_id").alias("a"), none, zero, F.col("label").alias("s"))
    ends = graphs.incidence.select("graph_id", tag(END), F.col("edge_id").alias("a"), F.col("node_id").alias("b"), F.col("port").cast("int").alias("p"), F.col("role").alias("s"))
    outer = graphs.interface.select("graph_id", tag(OUTER), F.col("node_id").alias("a"), none, F.col("pos").cast("int").alias("p"), F.col("kind").alias("s"))
    return nodes.unionAll(edges).unionAll(ends).unionAll(outer)


def run(graphs: Graphs, work: Callable[[Batch], pa.Table], schema: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(work's rows, graph ids left to the distributed way or None). ``schema`` begins with graph_id; its last column says
    whether a row only names a graph that is left. sizes: (graph_id, n) of every graph, n at least the number of its rows, where that is
    cheaper than to count them."""
    rows = _rows(graphs)
    sizes = rows.groupBy("graph_id").agg(F.count("*").alias("n")) if sizes is None else sizes
    total, most, unnamed = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n"), F.count(F.when(F.col("graph_id").isNull(), 1))).first()
    if unnamed:
        return graphs.nodes.sparkSession.createDataFrame([], schema), cut(graphs.nodes.select("graph_id").unionAll(graphs.edges.select("graph_id")).distinct())
    left = []
    if most and most > LIMIT:
        left.append(cut(sizes.where(F.col("n") > LIMIT).select("graph_id")))
        rows = rows.join(left[0], "graph_id", "left_anti")
    slices = -(-total // SLICE) or 1
    out = None
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64(F.lit("slice"), "graph_id"), F.lit(slices)) == k) if slices > 1 else rows
        met = part.repartition("graph_id").sortWithinPartitions("graph_id")
        done = cut(met.mapInArrow(_task(work, schema), schema))
        out = done if out is None else out.unionByName(done)
    last = out.columns[-1]
    odd = out.where(last).select("graph_id")
    if not odd.isEmpty():
        left.append(odd)
    rest = None if not left else left[0] if len(left) == 1 else left[0].unionAll(left[1])
    return out.where(~F.col(last)).drop(last), rest


def _task(work: Callable[[Batch], pa.Table], schema: str) -> Callable:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
    shape = pa.schema(list(zip(names, types, strict=True)))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch, odd = decode(table)
        if len(odd):
            blank = [pa.array(odd, pa.int64()), *[pa.nulls(len(odd), t) for t in types[1:-1]], pa.array([True] * len(odd))]
            yield from pa.table(blank, schema=shape).to_batches()
        if len(batch.ids):
            found = work(batch)
            yield from pa.table([*found, pa.array(np.zeros(len(found[0]), bool))], schema=shape).to_batches(max_chunksize=1 << 16)

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in stream:
            held.append(b)
            n += b.num_rows
            if n < BATCH:
                continue
            table = pa.Table.from_batches(held)
            ids = table["graph_id"].to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last graph may go on
            if whole:
                yield from done(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield from done(pa.Table.from_batches(held))

    return task


class Batch:
    """Well-formed graphs: their ids; nodes (ng, nid, nlabel), edges (eg, eid, elabel), endpoints (te, tn, role, port), interface
    (on, kind, pos). ng and eg are places in ids, te and tn places among edges and nodes; labels are codes whose
    order is that of the strings, 0 for null, which ``labels`` lists from code 1."""


def _find(g: np.ndarray, ids: np.ndarray, in_g: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of asked among (g, ids), whether they are there, mask of repeated (g, ids))."""
    values = np.unique(ids)
    key = g * len(values) + np.searchsorted(values, ids)
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = np.zeros(len(g), bool)
    again[order[1:]] = key[1:] == key[:-1]
    if not len(values):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool), again
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    there = values[at] == asked
    wanted = in_g * len(values) + at
    place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return order[place], there & (key[place] == wanted), again


def decode(table: pa.Table) -> tuple[Batch, np.ndarray]:
    """(the well-formed graphs, ids of the others)."""
    ids = table["graph_id"].to_numpy()
    g = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])])
    graph_ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])]
    tag = table["tag"].to_numpy()
    bad = np.zeros(len(graph_ids), bool)
    column = lambda name: pc.fill_null(table[name], 0).to_numpy().astype(np.int64)
    for name in "abp":
        if table[name].null_count:
            bad[g[pc.is_null(table[name]).to_numpy()]] = True
    a, b, p = column("a"), column("b"), column("p")
    coded = table["s"].combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    strings = coded.dictionary.to_pylist()
    order = sorted(range(len(strings)), key=lambda i: strings[i].encode())
    code = np.zeros(len(strings) + 1, np.int64)
    code[np.array(order, np.int64)] = np.arange(1, len(strings) + 1)
    s = code[pc.fill_null(coded.indices, len(strings)).to_numpy()]
    labels = [strings[i] for i in order]
    number = {x: i + 1 for i, x in enumerate(labels)}
    isn, ise, ist, iso = (tag == t for t in range(4))
    two = lambda where, names: [s[where] == number.get(x, -1) for x in names]
    roles, kinds = two(ist, ROLES), two(iso, KINDS)
    bad[g[ist][~(roles[0] | roles[1])]] = True
    bad[g[iso][~(kinds[0] | kinds[1])]] = True
    ng, nid, eg, eid = g[isn], a[isn], g[ise], a[ise]
    te, found, again = _find(eg, eid, g[ist], a[ist])
    bad[g[ist][~found]] = True
    bad[eg[again]] = True
    near, outer = g[ist], g[iso]
    at, found, again = _find(ng, nid, np.concatenate([near, outer]), np.concatenate([b[ist], a[iso]]))
    bad[np.concatenate([near, outer])[~found]] = True
    bad[ng[again]] = True
    if bad.any():
        good = table.filter(pa.array(~bad[g]))
        return (decode(good)[0] if good.num_rows else _none()), graph_ids[bad]
    out = Batch()
    out.ids, out.labels = graph_ids, labels
    out.ng, out.nid, out.nlabel, out.eg, out.eid, out.elabel = ng, nid, s[isn], eg, eid, s[ise]
    out.te, out.tn, out.role, out.port = te, at[: len(near)], roles[1].astype(np.int64), p[ist]
    out.on, out.kind, out.pos = at[len(near) :], kinds[1].astype(np.int64), p[iso]
    return out, graph_ids[:0]


def _none() -> Batch:
    out = Batch()
    out.ids = np.zeros(0, np.int64)
    return out


# Ranks.


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Start of the run that each place of sorted keys lies in."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _ranked(g: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Members of the same graph with a smaller value."""
    order = np.lexsort((value, g))
    out = np.empty(len(g), np.int64)
    out[order] = _runs(g[order], value[order]) - _runs(g[order])
    return out


def _classes(g: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by graph and colour, start of its class at each place of the order)."""
    order = np.lexsort((colour, g))
    return order, _runs(g[order], colour[order])


def _many(g: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, int]:
    """(members of classes of several, number of classes)."""
    order, start = _classes(g, colour)
    size = np.bincount(start, minlength=len(g))
    out = np.empty(len(g), bool)
    out[order] = size[start] > 1
    return np.flatnonzero(out), int((size > 0).sum())


def _split(g: np.ndarray, colour: np.ndarray, owner: np.ndarray, side: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Colours split by two lists of tokens (at least 1), that of side 0 first, each by place and token. No row: before any list."""
    many, _ = _many(g, colour)
    if not len(many):
        return colour
    compact = np.full(len(g), -1, np.int64)
    compact[many] = np.arange(len(many))
    take = compact[owner] >= 0
    owner, side, place, token = compact[owner[take]], side[take], place[take], token[take]
    order = np.lexsort((token, place, side, owner))
    owner, side, token = owner[order], side[order], token[order]
    # A sequence for each member: side 0, 0, side 1, 0; only -1 where it has no row. None is the beginning of another.
    count = np.bincount(owner, minlength=len(many))
    length = np.where(count > 0, count + 2, 1)
    first = np.cumsum(length) - length
    sequence = np.zeros(int(length.sum()), np.int64)
    sequence[first[count == 0]] = -1
    sequence[first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner] + side] = token
    order, start = _classes(g[many], colour[many])
    begin = np.empty(len(many), np.int64)
    begin[order] = start
    code, live, j = begin.copy(), np.arange(len(many)), 0
    while len(live):
        t = sequence[first[live] + j]
        order = np.lexsort((t, code[live]))
        live, t = live[order], t[order]
        old = code[live]
        run = _runs(old, t)
        code[live] = old + run - _runs(old)
        j += 1
        live = live[(np.bincount(run, minlength=len(live))[run] > 1) & (length[live] > j)]
    out = colour.copy()
    out[many] += code - begin
    return out


def _break(g: np.ndarray, ids: np.ndarray, colour: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The member of the largest id leaves its graph's first repeated class upwards, in the graphs of the mask. Graphs without one stay."""
    many, _ = _many(g, colour)
    many = many[where[g[many]]]
    if not len(many):
        return colour
    order = many[np.lexsort((ids[many], colour[many], g[many]))]
    start = _runs(g[order], colour[order])
    size = np.bincount(start, minlength=len(order))
    graph = _runs(g[order])
    at = np.unique(graph)  # each graph's first class begins where the graph begins
    last = order[at + size[at] - 1]
    out = colour.copy()
    out[last] += size[at] - 1
    return out


def ranks(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Colours of nodes and edges as ``refine.canonical_colouring`` has them."""
    far = np.int64(1) << 40
    value = far + b.nlabel
    np.minimum.at(value, b.on, (b.kind << 33) + b.pos)
    n, e = _ranked(b.ng, value), _ranked(b.eg, b.elabel)
    ports, port = np.unique(b.port, return_inverse=True)
    zero = np.zeros(len(b.te), np.int64)

    def stable(n: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = -1
        while True:
            now = _many(b.ng, n)[1] + _many(b.eg, e)[1]
            if now == count or now == len(n) + len(e):
                return n, e
            count = now
            n = _split(b.ng, n, b.tn, 1 - b.role, zero, e[b.te] * len(ports) + port + 1)
            e = _split(b.eg, e, b.te, b.role, port, n[b.tn] + 1)

    while True:
        n, e = stable(n, e)
        of_nodes, of_edges = _many(b.ng, n)[0], _many(b.eg, e)[0]
        if not len(of_nodes) and not len(of_edges):
            return n, e
        open_ = np.zeros(len(b.ids), bool)
        open_[b.ng[of_nodes]] = True
        n, e = _break(b.ng, b.nid, n, open_), _break(b.eg, b.eid, e, ~open_)


def _rank_rows(b: Batch) -> list[pa.Array]:
    n, e = ranks(b)
    both = lambda x, y: pa.array(np.concatenate([x, y]))
    what = both(np.zeros(len(n), np.int32), np.ones(len(e), np.int32))
    return [both(b.ids[b.ng], b.ids[b.eg]), what, both(b.nid, b.eid), both(n, e)]


def canonical_colouring(graphs: Graphs) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(node colours, edge colours, ids of the graphs that are left)."""
    out, rest = run(graphs, _rank_rows, "graph_id long, what int, id long, colour long, is_left boolean")
    part = lambda k, key: out.where(f"what = {k}").select("graph_id", F.col("id").alias(key), "colour")
    return part(0, "node_id"), part(1, "edge_id"), rest


# Hashes.


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finisher."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sum(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, value)
    return out


def hashes(b: Batch, ports: bool) -> np.ndarray:
    """A certificate for each graph, as ``refine.certificates`` has them but by hashes of its own.

    A graph's rounds end when one splits none of its nodes' classes, or all are single, which equal graphs reach in the same round.
    """
    text = np.array([0, *[int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in b.labels]], np.uint64)
    n_nodes, n_edges, n = len(b.ng), len(b.eg), len(b.ids)
    place = _mix(_mix(b.port if ports else np.zeros(len(b.port), np.int64), 1) + b.role.astype(np.uint64), 2)
    colour = _mix(_mix(text[b.nlabel], 3) + _sum(b.on, _mix(_mix(b.pos, 4) + b.kind.astype(np.uint64), 5), n_nodes), 6)
    box = _mix(text[b.elabel], 7)
    nodes_of = np.bincount(b.ng, minlength=n)

    def classes(colour: np.ndarray) -> np.ndarray:
        order, start = _classes(b.ng, colour)
        return np.bincount(b.ng[order[np.unique(start)]], minlength=n)

    out, open_, count, rounds = np.zeros(n, np.uint64), np.ones(n, bool), classes(colour), 0
    while open_.any():
        edge = _mix(box + _sum(b.te, _mix(colour[b.tn] ^ place, 8), n_edges), 9)
        colour = _mix(_mix(colour, 10) + _sum(b.tn, _mix(edge[b.te] ^ place, 11), n_nodes), 12)
        rounds += 1
        now = classes(colour)
        ends = open_ & ((now == count) | (now == nodes_of))
        if ends.any():
            total = _sum(b.ng, _mix(colour, 13), n) + _mix(_sum(b.eg, _mix(edge, 14), n), 15)
            sized = _mix(_mix(nodes_of, 16) + np.bincount(b.eg, minlength=n).astype(np.uint64), 17)
            out[ends] = _mix(_mix(total + sized, 18) + np.uint64(rounds), 19)[ends]
        open_ &= ~ends
        count = now
    return out.view(np.int64)


def certificates(graphs: Graphs, ports: dict[str, bool]) -> tuple[DataFrame, DataFrame | None]:
    """((graph_id, a certificate for each name of ``ports``), ids of the graphs that are left)."""
    work = lambda b: [pa.array(b.ids), *[pa.array(hashes(b, p)) for p in ports.values()]]
    return run(graphs, work, ", ".join(["graph_id long", *[f"{name} long" for name in ports], "is_left boolean"]))


# Pairs.

EQUAL, SIZES, REFINEMENT, LEFT = range(4)


def _hash_long(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of longs after ``seed``, the hash of the columns before."""
    one, two, three, four, five = (np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.broadcast_to(np.asarray(seed).astype(np.int64).view(np.uint64), x.shape) + (five + np.uint64(8))
    h = turn(h ^ (turn(x.view(np.uint64) * two, 31) * one), 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _renumbered(g: np.ndarray, ids: np.ndarray, graph_ids: np.ndarray, begin: int) -> np.ndarray:
    """New numbers as ``generate.shuffled`` gives them; begin: the hash of its seed and key."""
    order = np.lexsort((ids, _hash_long(ids, _hash_long(graph_ids[g], begin)), g))
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - _runs(g[order]) if len(g) else 0
    return out


def copied(b: Batch, begin: tuple[int, int]) -> Batch:
    """The graphs, and after them in the same order their copies of ``generate.permute``, whose rows are in the order of the new numbers."""
    n = len(b.ids)
    nodes, edges = _renumbered(b.ng, b.nid, b.ids, begin[0]), _renumbered(b.eg, b.eid, b.ids, begin[1])
    by_node, by_edge = np.lexsort((nodes, b.ng)), np.lexsort((edges, b.eg))
    node_at, edge_at = np.empty(len(nodes), np.int64), np.empty(len(edges), np.int64)
    node_at[by_node], edge_at[by_edge] = np.arange(len(nodes)), np.arange(len(edges))
    te, tn, on = edge_at[b.te], node_at[b.tn], node_at[b.on]
    by_end, by_outer = np.argsort(te, kind="stable"), np.argsort(on, kind="stable")
    both = lambda x, y: np.concatenate([x, y])
    out = Batch()
    out.ids, out.labels = both(b.ids, -b.ids - 1), b.labels
    out.ng, out.nid, out.nlabel = both(b.ng, b.ng[by_node] + n), both(b.nid, nodes[by_node]), both(b.nlabel, b.nlabel[by_node])
    out.eg, out.eid, out.elabel = both(b.eg, b.eg[by_edge] + n), both(b.eid, edges[by_edge]), both(b.elabel, b.elabel[by_edge])
    out.te, out.tn = both(b.te, te[by_end] + len(edges)), both(b.tn, tn[by_end] + len(nodes))
    out.role, out.port = both(b.role, b.role[by_end]), both(b.port, b.port[by_end])
    out.on, out.kind, out.pos = both(b.on, on[by_outer] + len(nodes)), both(b.kind, b.kind[by_outer]), both(b.pos, b.pos[by_outer])
    return out


class _Pairs:
    """Rows of some pairs, n in all: pn and sn are a node's pair and side, pe and se an edge's; te, tn and on are places among the rows here."""

    def only(self, pairs: np.ndarray) -> tuple[_Pairs, np.ndarray, np.ndarray]:
        """(the rows of the pairs of the mask, masks of the nodes and edges that stay)."""
        nodes, edges = pairs[self.pn], pairs[self.pe]
        ends, outer = edges[self.te], nodes[self.on]
        out = _Pairs()
        out.n = self.n
        out.pn, out.sn, out.nid, out.nlabel = (x[nodes] for x in (self.pn, self.sn, self.nid, self.nlabel))
        out.pe, out.se, out.eid, out.elabel, out.box = (x[edges] for x in (self.pe, self.se, self.eid, self.elabel, self.box))
        out.te, out.tn = (np.cumsum(edges) - 1)[self.te[ends]], (np.cumsum(nodes) - 1)[self.tn[ends]]
        out.what, out.place = self.what[ends], self.place[ends]
        out.on, out.outer = (np.cumsum(nodes) - 1)[self.on[outer]], self.outer[outer]
        return out, nodes, edges


def _sides(pair: np.ndarray, side: np.ndarray, colour: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by pair and colour, place in it where each class begins, members of either side in each class)."""
    order = np.lexsort((colour, pair))
    p, c = pair[order], colour[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    right = np.bincount(of, weights=side[order], minlength=len(first)).astype(np.int64)
    return order, first, np.bincount(of, minlength=len(first)) - right, right


def _refined(x: _Pairs, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node colours, edge colours, mask of the pairs whose sides differ in them), as ``refine.refine`` but by hashes of its own.

    A pair's rounds end when one splits none of its nodes' classes, or its sides differ, as they then do in every later round.
    """
    n, nodes, edges = x.n, colour.copy(), np.zeros(len(x.pe), np.uint64)
    at_node, at_edge, live = np.arange(len(x.pn)), np.arange(len(x.pe)), x
    apart, open_ = np.zeros(n, bool), np.zeros(n, bool)
    open_[x.pn] = open_[x.pe] = True

    def classes(pair: np.ndarray, side: np.ndarray, colour: np.ndarray) -> np.ndarray:
        order, first, left, right = _sides(pair, side, colour, n)
        of = pair[order[first]]
        apart[of[left != right]] = True
        return np.bincount(of, minlength=n)

    count = classes(x.pn, x.sn, colour)
    while open_.any():
        edge = _mix(live.box + _sum(live.te, _mix(colour[live.tn] ^ live.place, 8), len(live.pe)), 9)
        colour = _mix(_mix(colour, 10) + _sum(live.tn, _mix(edge[live.te] ^ live.place, 11), len(colour)), 12)
        nodes[at_node], edges[at_edge] = colour, edge
        now = classes(live.pn, live.sn, colour)
        open_ &= (now > count) & ~apart
        count = now
        if 2 * np.count_nonzero(open_[live.pn]) < len(live.pn):
            live, stay, stay_edges = live.only(open_)
            at_node, at_edge, colour = at_node[stay], at_edge[stay_edges], colour[stay]
    classes(x.pe, x.se, edges)
    return nodes, edges, apart


def _same(pair: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], wrong: np.ndarray) -> None:
    """Marks the pairs whose rows differ between left and right as multisets; rows that are sorted by their first keys are so by pair, too."""
    odd = np.bincount(pair[0], minlength=len(wrong)) != np.bincount(pair[1], minlength=len(wrong))
    wrong |= odd
    sides = []
    for p, rows in zip(pair, (left, right), strict=True):
        rows = [p, *rows]
        if odd.any():
            rows = [r[~odd[p]] for r in rows]
        order = np.lexsort(rows[::-1])
        sides.append([r[order] for r in rows])
    differ = np.zeros(len(sides[0][0]), bool)
    for a, b in zip(*sides, strict=True):
        differ |= a != b
    for rows in sides:
        wrong[rows[0][differ]] = True


def _verified(x: _Pairs, nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mask of the pairs whose mapping breaks the definition. Each node colour has one node of either side, and the members of an
    edge colour, as many on either side, meet in the order of their ids: so both mappings are bijections."""
    wrong = np.zeros(x.n, bool)
    to = []
    for pair, side, ids, label, colour in ((x.pn, x.sn, x.nid, x.nlabel, nodes), (x.pe, x.se, x.eid, x.elabel, edges)):
        order = np.lexsort((ids, colour, pair))
        left, right = order[side[order] == 0], order[side[order] == 1]
        wrong[pair[left][(pair[left] != pair[right]) | (label[left] != label[right])]] = True
        image = np.arange(len(pair))
        image[left] = right
        to.append(image)
    first, second = x.se[x.te] == 0, x.se[x.te] == 1
    pair = x.pe[x.te]
    _same((pair[first], pair[second]), (to[1][x.te[first]], to[0][x.tn[first]], x.what[first]), (x.te[second], x.tn[second], x.what[second]), wrong)
    first, second = x.sn[x.on] == 0, x.sn[x.on] == 1
    pair = x.pn[x.on]
    _same((pair[first], pair[second]), (to[0][x.on[first]], x.outer[first]), (x.on[second], x.outer[second]), wrong)
    return wrong


def verdicts(b: Batch, n: int) -> np.ndarray:
    """Of graph i and graph n + i for each i < n: EQUAL, SIZES or REFINEMENT as ``match.match`` has them, or LEFT to it.

    Pairs are refined jointly. What that leaves symmetric is individualised, the member of the least id on either side, and refined
    again until all colours are single. EQUAL is said only of a mapping that meets the definition, and an individualised pair
    whose sides come to differ is left, as another image may do.
    """
    x, out = _Pairs(), np.full(n, -1)
    kinds = b.ng[b.on]
    for g in (b.ng, b.eg, kinds[b.kind == 0], kinds[b.kind == 1]):
        count = np.bincount(g, minlength=2 * n)
        out[count[:n] != count[n:]] = SIZES
    text = np.array([0, *[int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for s in b.labels]], np.uint64)
    x.n, x.pn, x.sn, x.nid, x.nlabel = n, b.ng % n, b.ng // n, b.nid, b.nlabel
    x.pe, x.se, x.eid, x.elabel, x.box = b.eg % n, b.eg // n, b.eid, b.elabel, _mix(text[b.elabel], 7)
    x.te, x.tn, x.what = b.te, b.tn, (b.port << 1) + b.role
    x.place = _mix(_mix(b.port, 1) + b.role.astype(np.uint64), 2)
    x.on, x.outer = b.on, (b.pos << 1) + b.kind
    colour = _mix(_mix(text[b.nlabel], 3) + _sum(b.on, _mix(_mix(b.pos, 4) + b.kind.astype(np.uint64), 5), len(b.ng)), 6)
    here, why, count = out < 0, REFINEMENT, np.zeros(n, np.int64)
    while here.any():
        x, stay, _ = x.only(here)
        colour = colour[stay]
        if why == LEFT:
            # Of each pair's classes of several the smallest, of those the first.
            order, first, left, _ = _sides(x.pn, x.sn, colour, n)
            of = x.pn[order[first]]
            many = np.flatnonzero(left > 1)
            many = many[np.lexsort((colour[order[first[many]]], left[many], of[many]))]
            chosen = many[np.unique(of[many], return_index=True)[1]]
            k = 2 * left[chosen]
            members = order[np.repeat(first[chosen] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            members = members[np.lexsort((x.nid[members], x.sn[members], x.pn[members]))]
            at = np.unique(2 * x.pn[members] + x.sn[members], return_index=True)[1]
            colour[members[at]] = _mix(colour[members[at]], 20)
        nodes, edges, apart = _refined(x, colour)
        out[here & apart] = why
        here &= ~apart
        order, first, left, _ = _sides(x.pn, x.sn, nodes, n)
        of = x.pn[order[first]]
        symmetric = np.zeros(n, bool)
        symmetric[of[left > 1]] = True
        # Only where hashes collide doesn't a new colour make more classes.
        now = np.bincount(of, minlength=n)
        stuck = here & symmetric & (now <= count)
        out[stuck] = LEFT
        here, count = here & ~stuck, now
        single, keep, keep_edges = x.only(here & ~symmetric)
        wrong = _verified(single, nodes[keep], edges[keep_edges])
        done = here & ~symmetric
        out[done] = np.where(wrong[done], LEFT, EQUAL)
        here, colour, why = here & symmetric, nodes, LEFT
    return out


def match_copies(graphs: Graphs, seed: int, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((graph_id, isomorphic) of each graph and its copy of ``generate.permute``, ids of the graphs that are left). sizes: as in ``run``."""
    spark = graphs.nodes.sparkSession
    begin = tuple(spark.range(1).select(*[F.xxhash64(F.lit(seed), F.lit(key)) for key in ("node_id", "edge_id")]).first())

    def work(b: Batch) -> list[pa.Array]:
        found = verdicts(copied(b, begin), len(b.ids))
        return [pa.array(b.ids), pa.array(found.astype(np.int32))]

    out, rest = run(graphs, work, "graph_id long, verdict int, is_left boolean", sizes)
    unsure = out.where(F.col("verdict") == LEFT).select("graph_id")
    if not unsure.isEmpty():
        rest = unsure if rest is None else rest.unionAll(unsure)
    return out.where(F.col("verdict") != LEFT).select("graph_id", (F.col("verdict") == EQUAL).alias("isomorphic")), rest
