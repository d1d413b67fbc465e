"""Small graphs of the kinds that matter, built here."""

RING = {"nodes": ["x"] * 4, "edges": [("E", [i], [(i + 1) % 4]) for i in range(4)]}
CLIQUE = {"nodes": ["x"] * 4, "edges": [("E", [i], [j]) for i in range(4) for j in range(4) if i != j]}
HEXAGON = {"nodes": ["x"] * 6, "edges": [("E", [i], [(i + 1) % 6]) for i in range(6)]}
TRIANGLES = {"nodes": ["x"] * 6, "edges": [("E", [i], [3 * (i // 3) + (i + 1) % 3]) for i in range(6)]}
#: A monogamous chain of three boxes: a fork, a join that also takes the third input, and a box with nothing on the left.
SMALL = {
    "nodes": ["wire", "pipe", "pipe", "rod", "wire", "rod", "pipe", "wire"],
    "edges": [("SPLIT", [0], [1, 2]), ("JOIN", [2, 3, 1], [4, 5]), ("SOURCE", [], [6])],
    "inputs": [3, 0, 7],
    "outputs": [6, 5, 4, 7],
}
SWAPPED_LABEL = SMALL | {"edges": [SMALL["edges"][0], ("MERGE", [2, 3, 1], [4, 5]), SMALL["edges"][2]]}
SWAPPED_PORTS = SMALL | {"edges": [SMALL["edges"][0], ("JOIN", [1, 3, 2], [4, 5]), SMALL["edges"][2]]}
SWAPPED_NODES = SMALL | {"nodes": ["pipe", "wire", *SMALL["nodes"][2:]]}
SWAPPED_INTERFACE = SMALL | {"outputs": [5, 6, 4, 7]}
FEWER = SMALL | {"nodes": SMALL["nodes"][:7], "inputs": [3, 0], "outputs": [6, 5, 4]}
CYCLE = {"nodes": ["p", "q", "r", "p", "s"], "edges": [("F", [0, 2], [1, 4]), ("G", [1], [2, 3])], "inputs": [0], "outputs": [3, 4]}
NO_INPUT = {"nodes": ["u", "v", "v", "u", "t"], "edges": [("NEW", [], [0, 1, 2]), ("SWAP", [2, 0], [3]), ("DUP", [1], [4])], "outputs": [4, 3]}
NO_OUTPUT = {"nodes": ["u", "u", "v", "t"], "edges": [("PAIR", [1, 2], [3]), ("DROP", [3], []), ("DROP", [0], [])], "inputs": [2, 0, 1]}
UNIT = {"nodes": ["a"], "inputs": [0], "outputs": [0]}
OTHER_UNIT = {"nodes": ["b"], "inputs": [0], "outputs": [0]}
EMPTY: dict = {}
#: Two parts: one at the interface, one closed; and the same with the closed part's ports swapped.
PARTS = {"nodes": ["a", "b", "c", "c", "d"], "edges": [("F", [0], [1]), ("G", [2, 3], [4]), ("H", [4], [3, 2])], "inputs": [0], "outputs": [1]}
PARTS_SWAPPED = PARTS | {"edges": [("F", [0], [1]), ("G", [2, 3], [4]), ("H", [4], [2, 3])]}
#: A part that touches the interface differs while the closed parts agree.
PARTS_OUTER = PARTS | {"edges": [("K", [0], [1]), ("G", [2, 3], [4]), ("H", [4], [3, 2])]}
NULLARY = {"nodes": ["a"], "edges": [("N", [], []), ("M", [], [])], "inputs": [0], "outputs": [0]}
NULLARY_OTHER = NULLARY | {"edges": [("N", [], []), ("N", [], [])]}
BRANCHING = {"nodes": ["a", "b", "b", "c"], "edges": [("F", [0], [1]), ("F", [0], [2]), ("G", [1, 2], [3])], "inputs": [0], "outputs": [3]}
WIDE = {"nodes": ["w"] * 12, "edges": [("W", list(range(10)), [10, 11])], "inputs": list(range(10)), "outputs": [11, 10]}
TWICE = {"nodes": ["a", "b"], "edges": [("F", [0], [1])], "inputs": [0, 0], "outputs": [1, 0]}
TWICE_OTHER = TWICE | {"inputs": [0, 1], "outputs": [1, 0]}


def undirected(n, links):
    """n equal nodes, an edge either way for each link."""
    return {"nodes": ["x"] * n, "edges": [("E", [a], [b]) for i, j in links for a, b in ((i, j), (j, i))]}


def beside(*graphs):
    """Graphs without interfaces side by side."""
    nodes, edges = [], []
    for g in graphs:
        k = len(nodes)
        nodes += g["nodes"]
        edges += [(label, [k + i for i in s], [k + i for i in t]) for label, s, t in g["edges"]]
    return {"nodes": nodes, "edges": edges}


def complete(n):
    return undirected(n, [(i, j) for i in range(n) for j in range(i)])


#: Two connected graphs of six nodes of degree three that refinement can't tell apart.
K33 = undirected(6, [(i, j) for i in range(3) for j in range(3, 6)])
PRISM = undirected(6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)])
#: A hub with interchangeable leaves, some of which are outputs.
STAR = {"nodes": ["hub"] + ["leaf"] * 8, "edges": [("ARM", [0], [i]) for i in range(1, 9)], "inputs": [0], "outputs": [7, 8]}
STAR_OTHER = STAR | {"edges": STAR["edges"][:-1] + [("ARM", [0], [1])]}
