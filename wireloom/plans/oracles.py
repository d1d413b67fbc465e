"""The catalogue's SQL for DuckDB, written from the definitions over the same tables."""

from __future__ import annotations

CHAINS = """
ev AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS graph_id, ts, event_id, event_type AS label
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
edges AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY ts, event_id) - 1 AS edge_id, label FROM ev),
len AS (SELECT graph_id, count(*) AS n FROM edges GROUP BY graph_id),
nodes AS (SELECT graph_id, unnest(range(0, n + 1)) AS node_id, 'state' AS label FROM len),
inc AS (SELECT graph_id, edge_id, edge_id AS node_id, 'S' AS role, 0 AS port FROM edges UNION ALL SELECT graph_id, edge_id, edge_id + 1, 'T', 0 FROM edges),
iface AS (SELECT graph_id, 0 AS node_id, 'I' AS kind, 0 AS pos FROM len UNION ALL SELECT graph_id, n, 'O', 0 FROM len)
"""

BOXES = """
li AS (SELECT l_orderkey AS graph_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS edge_id,
  l_partkey, l_suppkey, l_returnflag || l_linestatus AS label FROM lineitem),
ks AS (SELECT graph_id, 0 AS kind, l_partkey AS key FROM li UNION SELECT graph_id, 1, l_suppkey FROM li UNION SELECT graph_id, 2, graph_id FROM li),
kn AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY kind, key) - 1 AS node_id FROM ks),
nodes AS (SELECT kn.graph_id, node_id, coalesce(CASE kind WHEN 0 THEN p_type WHEN 1 THEN 'supplier' ELSE o_orderpriority END, '') AS label
  FROM kn LEFT JOIN part ON kind = 0 AND p_partkey = key LEFT JOIN orders ON kind = 2 AND o_orderkey = key),
edges AS (SELECT graph_id, edge_id, label FROM li),
inc AS (SELECT li.graph_id, edge_id, node_id, 'S' AS role, 0 AS port FROM li JOIN kn ON li.graph_id = kn.graph_id AND kind = 0 AND key = l_partkey
  UNION ALL SELECT li.graph_id, edge_id, node_id, 'S', 1 FROM li JOIN kn ON li.graph_id = kn.graph_id AND kind = 1 AND key = l_suppkey
  UNION ALL SELECT li.graph_id, edge_id, node_id, 'T', 0 FROM li JOIN kn ON li.graph_id = kn.graph_id AND kind = 2),
iface AS (SELECT graph_id, node_id, 'I' AS kind, node_id AS pos FROM kn WHERE kind = 0 UNION ALL SELECT graph_id, node_id, 'O', 0 FROM kn WHERE kind = 2)
"""

#: The faulty graphs of the catalogue, added to a family.
FAULTS = """
nodes2 AS (SELECT * FROM nodes UNION ALL SELECT * FROM (VALUES (-1, 0, 'lonely'), (-2, 0, 'a'), (-3, 0, 'a'), (-3, 1, 'b'))),
edges2 AS (SELECT * FROM edges UNION ALL SELECT * FROM (VALUES (-2, 0, 'F'), (-3, 0, 'F'), (-3, 1, 'G'))),
inc2 AS (SELECT * FROM inc UNION ALL SELECT * FROM (VALUES (-2, 0, 0, 'S', 0), (-2, 0, 7, 'S', 1), (-2, 0, -3, 'T', 0), (-3, 0, 0, 'S', 0), (-3, 0, 1, 'T', 0), (-3, 1, 0, 'S', 0), (-3, 1, 1, 'T', 0))),
iface2 AS (SELECT * FROM iface UNION ALL SELECT * FROM (VALUES (-2, 5, 'I', 0), (-2, 0, 'O', 0), (-3, 0, 'I', 0), (-3, 1, 'O', 0)))
"""

FACTS = """
ef AS (SELECT e.graph_id, e.edge_id, any_value(e.label) AS label, count(*) FILTER (role = 'S') AS n_src, count(*) FILTER (role = 'T') AS n_tgt, count(role) AS n_tot
  FROM edges e LEFT JOIN inc i ON e.graph_id = i.graph_id AND e.edge_id = i.edge_id GROUP BY e.graph_id, e.edge_id),
deg AS (SELECT graph_id, node_id, count(*) FILTER (role = 'S') AS n_next, count(*) FILTER (role = 'T') AS n_prev FROM inc GROUP BY graph_id, node_id),
tag AS (SELECT graph_id, node_id, max(CASE kind WHEN 'I' THEN 1 ELSE 0 END) + 2 * max(CASE kind WHEN 'O' THEN 1 ELSE 0 END) AS io_tag FROM iface GROUP BY graph_id, node_id),
nf AS (SELECT n.graph_id, n.node_id, n.label, coalesce(io_tag, 0) AS io_tag, coalesce(n_next, 0) AS n_next, coalesce(n_prev, 0) AS n_prev
  FROM nodes n LEFT JOIN deg USING (graph_id, node_id) LEFT JOIN tag USING (graph_id, node_id))
"""

_SUMMARY = """
SELECT ids.graph_id,
  (SELECT count(*) FROM nodes n WHERE n.graph_id = ids.graph_id) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.graph_id = ids.graph_id) AS n_edges,
  (SELECT count(*) FROM iface i WHERE i.graph_id = ids.graph_id AND kind = 'I') AS n_inputs, (SELECT count(*) FROM iface i WHERE i.graph_id = ids.graph_id AND kind = 'O') AS n_outputs,
  (SELECT count(DISTINCT label) FROM nodes n WHERE n.graph_id = ids.graph_id) AS n_node_labels, (SELECT count(DISTINCT label) FROM edges e WHERE e.graph_id = ids.graph_id) AS n_edge_labels
FROM (SELECT DISTINCT graph_id FROM nodes) ids"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def _bins(table: str, bins: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS histogram, CAST({x} AS BIGINT) AS bin, count(*) AS n FROM {table} GROUP BY {x}" for name, x in bins.items())


_LISTS = """
ls AS (SELECT graph_id, edge_id, label,
  coalesce((SELECT string_agg(CAST(node_id AS VARCHAR), ', ' ORDER BY port) FROM inc WHERE inc.graph_id = e.graph_id AND inc.edge_id = e.edge_id AND role = 'S'), '') AS src,
  coalesce((SELECT string_agg(CAST(node_id AS VARCHAR), ', ' ORDER BY port) FROM inc WHERE inc.graph_id = e.graph_id AND inc.edge_id = e.edge_id AND role = 'T'), '') AS tgt FROM edges e),
sg AS (SELECT *, CAST(edge_id AS VARCHAR) || ':[' || src || ']->[' || tgt || ']' AS sig_text FROM ls),
sn AS (SELECT graph_id, edge_id, label, src, tgt, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(sig_text) + 1), lambda i: CAST(ascii(sig_text[i]) AS BIGINT))), lambda a, b: (a * 256 + b) % 100000000) AS BIGINT) AS signature FROM sg)
"""

_KEYS = """
half AS (SELECT i.graph_id, i.node_id, i.role, row_number() OVER (PARTITION BY i.graph_id, i.node_id, i.role ORDER BY i.edge_id, i.port) AS k, e.label || CAST(i.port AS VARCHAR) AS what
  FROM inc i JOIN edges e ON i.graph_id = e.graph_id AND i.edge_id = e.edge_id),
keys AS (SELECT n.graph_id, n.node_id, 'i:' || coalesce(s.what, '___') || '_o:' || coalesce(t.what, '___') AS key FROM nodes n
  LEFT JOIN half s ON s.graph_id = n.graph_id AND s.node_id = n.node_id AND s.role = 'S' AND s.k = 1
  LEFT JOIN half t ON t.graph_id = n.graph_id AND t.node_id = n.node_id AND t.role = 'T' AND t.k = 1)
"""

_NEIGHBOURS = """
pr AS (SELECT graph_id AS pair_id, graph_id AS g1, lead(graph_id) OVER (PARTITION BY graph_id // 100000 ORDER BY graph_id) AS g2 FROM (SELECT DISTINCT graph_id FROM nodes) QUALIFY g2 IS NOT NULL),
sz AS (SELECT l.graph_id, n, (SELECT count(DISTINCT label) FROM edges e WHERE e.graph_id = l.graph_id) AS kinds FROM len l)
"""

_ROTATE = """
rot AS (SELECT graph_id AS pair_id, graph_id, n FROM len)
"""

_COLOURS = """
fst AS (SELECT graph_id, node_id, min(CASE kind WHEN 'O' THEN 1000000000 ELSE 0 END + pos) AS first FROM iface GROUP BY graph_id, node_id),
n0 AS (SELECT n.graph_id, n.node_id, rank() OVER (PARTITION BY n.graph_id ORDER BY CASE WHEN first IS NULL THEN 1 ELSE 0 END, first, CASE WHEN first IS NULL THEN label END) - 1 AS colour
  FROM nodes n LEFT JOIN fst ON n.graph_id = fst.graph_id AND n.node_id = fst.node_id),
e0 AS (SELECT graph_id, edge_id, rank() OVER (PARTITION BY graph_id ORDER BY label) - 1 AS colour FROM edges)
"""

_ROUND = """
nk AS (SELECT i.graph_id, i.node_id, coalesce(list(colour * 1000 + port ORDER BY colour, port) FILTER (role = 'T'), []) AS t, coalesce(list(colour * 1000 + port ORDER BY colour, port) FILTER (role = 'S'), []) AS s
  FROM inc i JOIN e0 ON i.graph_id = e0.graph_id AND i.edge_id = e0.edge_id GROUP BY i.graph_id, i.node_id),
n1 AS (SELECT n0.graph_id, n0.node_id, colour + rank() OVER (PARTITION BY n0.graph_id, colour ORDER BY coalesce(t, []), coalesce(s, [])) - 1 AS colour FROM n0 LEFT JOIN nk ON n0.graph_id = nk.graph_id AND n0.node_id = nk.node_id),
ek AS (SELECT i.graph_id, i.edge_id, coalesce(list(colour ORDER BY port) FILTER (role = 'S'), []) AS s, coalesce(list(colour ORDER BY port) FILTER (role = 'T'), []) AS t
  FROM inc i JOIN n1 ON i.graph_id = n1.graph_id AND i.node_id = n1.node_id GROUP BY i.graph_id, i.edge_id),
e1 AS (SELECT e0.graph_id, e0.edge_id, colour + rank() OVER (PARTITION BY e0.graph_id, colour ORDER BY coalesce(s, []), coalesce(t, [])) - 1 AS colour FROM e0 LEFT JOIN ek ON e0.graph_id = ek.graph_id AND e0.edge_id = ek.edge_id)
"""

_NETWORK = """
o AS (SELECT o_orderkey AS edge_id, o_custkey * 2 + 1 AS customer FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
m AS (SELECT edge_id, customer AS node FROM o UNION SELECT edge_id, l_partkey * 2 FROM o JOIN lineitem ON l_orderkey = edge_id),
comp(node_id, component) USING KEY (node_id) AS (
  SELECT DISTINCT node, node FROM m
  UNION SELECT b.node, min(c.component) FROM comp c JOIN m a ON a.node = c.node_id JOIN m b ON b.edge_id = a.edge_id JOIN recurring.comp r ON r.node_id = b.node
  WHERE c.component < r.component GROUP BY b.node)
"""


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"


ORACLE_SQL = {
    "chain_equality_classes": _with(CHAINS) + "SELECT min(graph_id) AS class_graph, count(*) AS n_graphs FROM (SELECT graph_id, string_agg(label, '|' ORDER BY edge_id) AS word FROM edges GROUP BY graph_id) GROUP BY word",
    "graph_summary": _with(BOXES) + _SUMMARY,
    "edge_arity_histogram": _with(BOXES, FACTS) + _bins("ef", {"edge_sources": "n_src", "edge_targets": "n_tgt", "edge_total": "n_tot"}),
    "node_degree_histogram": _with(BOXES, FACTS) + _bins("nf", {"node_prev": "n_prev", "node_next": "n_next", "node_total": "n_prev + n_next"}),
    "io_tag_histogram": _with(BOXES, FACTS) + _bins("nf", {"node_io_tag": "io_tag"}),
    "csr_offsets": _with(BOXES, FACTS) + """SELECT graph_id, node_id, n_next, n_prev,
  CAST(coalesce(sum(n_next) OVER w, 0) AS BIGINT) AS next_offset, CAST(coalesce(sum(n_prev) OVER w, 0) AS BIGINT) AS prev_offset
FROM nf WINDOW w AS (PARTITION BY graph_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "csr_export": _with(BOXES) + """SELECT graph_id,
  coalesce(string_agg(CAST(node_id AS VARCHAR), ' ' ORDER BY edge_id, port) FILTER (role = 'S'), '') AS edge_sources,
  coalesce(string_agg(CAST(node_id AS VARCHAR), ' ' ORDER BY edge_id, port) FILTER (role = 'T'), '') AS edge_targets,
  coalesce(string_agg(CAST(edge_id AS VARCHAR), ' ' ORDER BY node_id, edge_id, port) FILTER (role = 'S'), '') AS node_next,
  coalesce(string_agg(CAST(edge_id AS VARCHAR), ' ' ORDER BY node_id, edge_id, port) FILTER (role = 'T'), '') AS node_prev
FROM inc GROUP BY graph_id""",
    "edge_display": _with(CHAINS) + "SELECT graph_id, edge_id, label || ', ' || CAST(edge_id AS VARCHAR) AS display_label FROM edges",
    "node_display": _with(BOXES) + "SELECT graph_id, node_id, label || ', ' || CAST(node_id AS VARCHAR) AS display_label FROM nodes",
    "edge_signature_mod": _with(BOXES, _LISTS) + "SELECT graph_id, edge_id, signature FROM sn",
    "label_dictionary": _with(BOXES) + "SELECT graph_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS code FROM (SELECT graph_id, label, min(edge_id) AS first FROM edges GROUP BY graph_id, label)",
    "sorted_edges": _with(BOXES, FACTS) + "SELECT graph_id, edge_id, row_number() OVER (PARTITION BY graph_id ORDER BY n_src, n_tgt, n_tot, label, edge_id) - 1 AS position FROM ef",
    "max_arity": _with(BOXES, FACTS) + "SELECT graph_id, max(greatest(n_src, n_tgt)) AS max_arity FROM ef GROUP BY graph_id",
    "validity_report": _with(CHAINS, FAULTS) + """SELECT graph_id, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(m) AS BIGINT) AS n_edges, sum(n) > 0 AND sum(m) > 0 AS is_valid
FROM (SELECT graph_id, 1 AS n, 0 AS m FROM nodes2 UNION ALL SELECT graph_id, 0, 1 FROM edges2 UNION ALL SELECT graph_id, 0, 0 FROM iface2) GROUP BY graph_id""",
    "dangling_endpoints": _with(BOXES, FAULTS) + """SELECT graph_id, element, element_id, node_id FROM (
  SELECT graph_id, 'edge' AS element, edge_id AS element_id, node_id FROM inc2 UNION ALL SELECT graph_id, CASE kind WHEN 'I' THEN 'input' ELSE 'output' END, pos, node_id FROM iface2) x
WHERE NOT EXISTS (SELECT 1 FROM nodes2 n WHERE n.graph_id = x.graph_id AND n.node_id = x.node_id)""",
    "monogamy_check": _with(BOXES, FAULTS) + """SELECT n.graph_id, max(greatest(coalesce(s, 0), coalesce(t, 0))) <= 1 AS is_monogamous FROM nodes2 n
LEFT JOIN (SELECT graph_id, node_id, count(*) FILTER (role = 'S') AS s, count(*) FILTER (role = 'T') AS t FROM inc2 GROUP BY graph_id, node_id) d ON d.graph_id = n.graph_id AND d.node_id = n.node_id GROUP BY n.graph_id""",
    "consistency_check": _with(BOXES, FAULTS) + """SELECT graph_id, side, CAST(sum(a) AS BIGINT) AS by_nodes, CAST(sum(b) AS BIGINT) AS by_edges FROM (
  SELECT i.graph_id, role AS side, CASE WHEN n.node_id IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN e.edge_id IS NULL THEN 0 ELSE 1 END AS b FROM inc2 i
  LEFT JOIN nodes2 n ON n.graph_id = i.graph_id AND n.node_id = i.node_id LEFT JOIN edges2 e ON e.graph_id = i.graph_id AND e.edge_id = i.edge_id)
GROUP BY graph_id, side HAVING sum(a) <> sum(b)""",
    "node_key_histogram": _with(CHAINS, _KEYS) + "SELECT graph_id, key, count(*) AS n FROM keys GROUP BY graph_id, key",
    "rarest_node_key": _with(CHAINS, _KEYS) + "SELECT graph_id, key, n FROM (SELECT graph_id, key, count(*) AS n FROM keys GROUP BY graph_id, key) QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n, key) = 1",
    "edge_signature_histogram": _with(BOXES, FACTS) + "SELECT graph_id, n_src, n_tgt, n_tot, label, count(*) AS n FROM ef GROUP BY ALL",
    "node_signature_histogram": _with(BOXES, FACTS) + "SELECT graph_id, label, CAST(io_tag AS BIGINT) AS io_tag, n_next, n_prev, count(*) AS n FROM nf GROUP BY ALL",
    "histogram_diff": _with(BOXES, FACTS) + """, cnt AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY graph_id),
changed AS (SELECT e.graph_id, n_src, n_tgt, n_tot, label AS old, CASE WHEN (edge_id + 1 + graph_id % m) % m = 0 THEN 'changed' ELSE label END AS new FROM ef e JOIN cnt USING (graph_id)),
both_sides AS (SELECT graph_id AS pair_id, n_src, n_tgt, n_tot, old AS label, 1 AS a, 0 AS b FROM changed UNION ALL SELECT graph_id, n_src, n_tgt, n_tot, new, 0, 1 FROM changed)
SELECT pair_id, n_src, n_tgt, n_tot, label, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2 FROM both_sides GROUP BY pair_id, n_src, n_tgt, n_tot, label HAVING sum(a) <> sum(b)""",
    "size_prefilter": _with(CHAINS, _NEIGHBOURS) + "SELECT pair_id, a.n = b.n AS sizes_equal FROM pr JOIN sz a ON a.graph_id = g1 JOIN sz b ON b.graph_id = g2",
    "basic_tests": _with(CHAINS, _NEIGHBOURS) + "SELECT pair_id, a.n = b.n AS same_nodes, a.n = b.n AS same_edges, true AS same_inputs, true AS same_outputs, true AS same_node_labels, a.kinds = b.kinds AS same_edge_labels FROM pr JOIN sz a ON a.graph_id = g1 JOIN sz b ON b.graph_id = g2",
    "edge_neighbourhood_classes": _with(BOXES, FACTS) + """SELECT class_size, count(*) AS n_classes FROM (SELECT s, t, count(*) AS class_size FROM (
  SELECT i.graph_id, i.edge_id, list(concat_ws('|', label, io_tag, n_next, n_prev) ORDER BY concat_ws('|', label, io_tag, n_next, n_prev)) FILTER (role = 'S') AS s,
    list(concat_ws('|', label, io_tag, n_next, n_prev) ORDER BY concat_ws('|', label, io_tag, n_next, n_prev)) FILTER (role = 'T') AS t
  FROM inc i JOIN nf ON nf.graph_id = i.graph_id AND nf.node_id = i.node_id GROUP BY i.graph_id, i.edge_id) GROUP BY s, t) GROUP BY class_size""",
    "mc_match": _with(CHAINS) + "SELECT graph_id AS pair_id, true AS isomorphic, CAST(NULL AS VARCHAR) AS reason FROM len",
    "mc_node_mapping": _with(CHAINS) + "SELECT n.graph_id AS pair_id, node_id AS n1, (node_id + 1 + n.graph_id % (n + 1)) % (n + 1) AS n2 FROM nodes n JOIN len USING (graph_id)",
    "mc_edge_mapping": _with(CHAINS) + "SELECT e.graph_id AS pair_id, edge_id AS e1, (edge_id + 1 + e.graph_id % n) % n AS e2 FROM edges e JOIN len USING (graph_id)",
    "match_negative": _with(CHAINS) + "SELECT graph_id AS pair_id, false AS isomorphic FROM len",
    "connected_components": _recursive(_NETWORK) + "SELECT node_id, component FROM comp",
    "component_sizes": _recursive(_NETWORK) + """SELECT component, count(*) AS n_nodes, max(m) AS n_edges FROM comp
JOIN (SELECT component, count(DISTINCT edge_id) AS m FROM m JOIN comp ON node_id = node GROUP BY component) USING (component) GROUP BY component""",
    "regular_match": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), false), (1, false), (2, true), (3, true), (4, false), (5, true)) t(pair_id, isomorphic)",
    "regular_forms": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), false), (1, false), (2, true), (3, true), (4, false), (5, true)) t(pair_id, isomorphic)",
    "canonical_form_classes": _with(CHAINS) + "SELECT min(graph_id) AS class_graph, 2 * count(*) AS n_graphs FROM (SELECT graph_id, string_agg(label, '|' ORDER BY edge_id) AS word FROM edges GROUP BY graph_id) GROUP BY word",
    "disconnected_match": _with(CHAINS) + """, words AS (SELECT graph_id, string_agg(label, '|' ORDER BY edge_id) AS word FROM edges GROUP BY graph_id),
months AS (SELECT (graph_id // 100000) * 100000 + (graph_id % 100000) // 30 AS month, string_agg(word, ' ' ORDER BY word) AS words FROM words GROUP BY 1)
SELECT month AS pair_id, words = lead(words) OVER w AS isomorphic FROM months WINDOW w AS (PARTITION BY month // 100000 ORDER BY month) QUALIFY lead(month) OVER w IS NOT NULL""",
    "interface_match": _with(CHAINS) + """, words AS (SELECT graph_id, string_agg(label, '|' ORDER BY edge_id) AS word FROM edges GROUP BY graph_id),
runs AS (SELECT (graph_id // 100000) * 100000 + (graph_id % 100000) // 3 AS run, string_agg(word, ' ' ORDER BY graph_id) AS words FROM words GROUP BY 1)
SELECT run AS pair_id, words = lead(words) OVER w AS isomorphic FROM runs WINDOW w AS (PARTITION BY run // 100000 ORDER BY run) QUALIFY lead(run) OVER w IS NOT NULL""",
    "edge_neighbourhood_diff": _with(BOXES, FACTS) + """, hood AS (SELECT i.graph_id, i.edge_id, list(concat_ws('|', label, io_tag, n_next, n_prev) ORDER BY concat_ws('|', label, io_tag, n_next, n_prev)) FILTER (role = 'S') AS s,
    list(concat_ws('|', label, io_tag, n_next, n_prev) ORDER BY concat_ws('|', label, io_tag, n_next, n_prev)) FILTER (role = 'T') AS t
  FROM inc i JOIN nf ON nf.graph_id = i.graph_id AND nf.node_id = i.node_id GROUP BY i.graph_id, i.edge_id),
c AS (SELECT graph_id, s, t, count(*) AS n FROM hood GROUP BY graph_id, s, t),
pr AS (SELECT DISTINCT graph_id AS pair_id FROM nodes WHERE graph_id + 1 IN (SELECT graph_id FROM nodes)),
d AS (SELECT pair_id, s, t, sum(n1) AS n1, sum(n2) AS n2 FROM (SELECT pair_id, s, t, n AS n1, 0 AS n2 FROM pr JOIN c ON c.graph_id = pair_id UNION ALL SELECT pair_id, s, t, 0, n FROM pr JOIN c ON c.graph_id = pair_id + 1) GROUP BY pair_id, s, t)
SELECT pair_id, CAST(sum(greatest(n1 - n2, 0)) AS BIGINT) AS only_first, CAST(sum(greatest(n2 - n1, 0)) AS BIGINT) AS only_second FROM d WHERE n1 <> n2 GROUP BY pair_id""",
    "port_sensitivity": _with(BOXES) + "SELECT DISTINCT graph_id, false AS equal_with_ports, true AS equal_without_ports FROM li",
    "colouring_steps": _with(BOXES, _COLOURS, _ROUND) + """SELECT graph_id, CAST(0 AS BIGINT) AS iteration, 'node' AS element, node_id AS id, colour FROM n0 UNION ALL SELECT graph_id, 0, 'edge', edge_id, colour FROM e0
UNION ALL SELECT graph_id, 1, 'node', node_id, colour FROM n1 UNION ALL SELECT graph_id, 1, 'edge', edge_id, colour FROM e1""",
    "json_files": _with(BOXES) + "SELECT 'graph_' || graph_id AS graph_name, * EXCLUDE (graph_id) FROM (" + _SUMMARY + ") UNION ALL SELECT 'unreadable', NULL, NULL, NULL, NULL, NULL, NULL",
    "dot_styles": _with(CHAINS, _LISTS) + r""", lines AS (
  SELECT graph_id, 0 AS block, node_id AS a, 0 AS b, '  n' || node_id || ' [shape=circle, label="' || label || ';' || node_id || '", color="' || CASE WHEN node_id = 0 THEN 'red' WHEN node_id % 2 = 0 THEN '/set19/' || (node_id % 5 + 1) ELSE 'black' END || '"];' AS line FROM nodes
  UNION ALL SELECT graph_id, 1, edge_id, 0, '  e' || edge_id || ' [shape=box, label="' || label || ',' || edge_id || '\n\n' || signature || '", color="' || CASE WHEN edge_id = 1 THEN 'red' WHEN edge_id % 2 = 0 THEN '/paired12/' || (edge_id % 5 + 1) ELSE 'black' END || '"];' FROM sn
  UNION ALL SELECT graph_id, 2, edge_id, CASE role WHEN 'S' THEN 0 ELSE 1 END, CASE role WHEN 'S' THEN '  n' || node_id || ' -> e' || edge_id ELSE '  e' || edge_id || ' -> n' || node_id END || ' [label="' || port || '"];' FROM inc
  UNION ALL SELECT graph_id, 3, CASE kind WHEN 'I' THEN 0 ELSE 1 END, pos, CASE kind WHEN 'I' THEN '  i' || pos || ' -> n' || node_id ELSE '  n' || node_id || ' -> o' || pos END || ';' FROM iface)
SELECT graph_id, 'digraph {' || chr(10) || '  rankdir=TB;' || chr(10) || string_agg(line, chr(10) ORDER BY block, a, b) || chr(10) || '}' AS dot FROM lines GROUP BY graph_id""",
    "initial_colouring": _with(BOXES, _COLOURS) + "SELECT graph_id, 'node' AS element, node_id AS id, colour FROM n0 UNION ALL SELECT graph_id, 'edge', edge_id, colour FROM e0",
    "refine_round": _with(BOXES, _COLOURS, _ROUND) + "SELECT graph_id, 'node' AS element, node_id AS id, colour FROM n1 UNION ALL SELECT graph_id, 'edge', edge_id, colour FROM e1",
    "canonical_colouring_unique": _with(BOXES) + "SELECT graph_id, n AS n_nodes, n AS n_nodes_colours, m AS n_edges, m AS n_edges_colours FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY graph_id) JOIN (SELECT graph_id, count(*) AS m FROM edges GROUP BY graph_id) USING (graph_id)",
    "permute_roundtrip": _with(CHAINS) + "SELECT graph_id AS pair_id, true AS isomorphic FROM len",
    "nonmonogamous_match": _with(BOXES) + "SELECT DISTINCT graph_id AS pair_id, true AS isomorphic FROM li",
    "random_graph": "SELECT i AS graph_id, CAST(100 AS BIGINT) AS n_nodes, CAST(20 AS BIGINT) AS n_edges, CAST(30 AS BIGINT) AS n_inputs, CAST(40 AS BIGINT) AS n_outputs, true AS is_monogamous FROM range(1000) t(i)",
    "dot_export": _with(CHAINS, _LISTS) + r""", lines AS (
  SELECT graph_id, 0 AS block, node_id AS a, 0 AS b, '  n' || node_id || ' [shape=circle, label="' || label || ';' || node_id || '", color="black"];' AS line FROM nodes
  UNION ALL SELECT graph_id, 1, edge_id, 0, '  e' || edge_id || ' [shape=box, label="' || label || ',' || edge_id || '\n\n' || signature || '", color="black"];' FROM sn
  UNION ALL SELECT graph_id, 2, edge_id, CASE role WHEN 'S' THEN 0 ELSE 1 END, CASE role WHEN 'S' THEN '  n' || node_id || ' -> e' || edge_id ELSE '  e' || edge_id || ' -> n' || node_id END || ' [label="' || port || '"];' FROM inc
  UNION ALL SELECT graph_id, 3, CASE kind WHEN 'I' THEN 0 ELSE 1 END, pos, CASE kind WHEN 'I' THEN '  i' || pos || ' -> n' || node_id ELSE '  n' || node_id || ' -> o' || pos END || ';' FROM iface)
SELECT graph_id, 'digraph {' || chr(10) || '  rankdir=LR;' || chr(10) || string_agg(line, chr(10) ORDER BY block, a, b) || chr(10) || '}' AS dot FROM lines GROUP BY graph_id""",
    "json_export": _with(CHAINS) + """SELECT e.graph_id, '{"graph_name":"graph_' || e.graph_id || '","comment":"","nodes":[' || any_value(ns) || '],"hyperedges":[' ||
  string_agg('{"type_label":"' || label || '","source_nodes":[' || edge_id || '],"target_nodes":[' || (edge_id + 1) || ']}', ',' ORDER BY edge_id) || '],"Inputs":[0],"Outputs":[' || any_value(n) || ']}' AS document
FROM edges e JOIN (SELECT graph_id, n, string_agg('{"type_label":"state"}', ',') AS ns FROM nodes JOIN len USING (graph_id) GROUP BY graph_id, n) USING (graph_id) GROUP BY e.graph_id""",
    "json_roundtrip": _with(BOXES) + _SUMMARY,
    "graph_listing": _with(CHAINS) + """SELECT graph_id, CAST(0 AS INT) AS part, node_id AS number, 'state, ' || node_id AS text FROM nodes
UNION ALL SELECT graph_id, 1, edge_id, label || ' [' || edge_id || '] -> [' || (edge_id + 1) || ']' FROM edges
UNION ALL SELECT graph_id, 2, CASE kind WHEN 'I' THEN pos ELSE pos + 4294967296 END, kind || ' ' || node_id FROM iface""",
}
