"""Graph queries: statistics, reachability, ranking, components, biconnectivity, betweenness."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed
from ..operators import (
    betweenness as btw, biconnected as bic, components as comp, graph_stats as gs, imports as imp,
    inventory as inv, rank_flow as pr, traversal as tr,
)
from ..plans import repository
from ..session import durable
from ..sources import sinks
from .bindings import FOREST, PRS, SUCCESSOR, TRADE
from .imports import COVER_SQL, GRAPH, covered_files, module_graph
from .inventory import boosted
from .registry import query

TW, FW, SW = "WITH RECURSIVE " + TRADE, "WITH RECURSIVE " + FOREST, "WITH RECURSIVE " + SUCCESSOR


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def forest_nodes(t):
    return gs.union_nodes(t.forest_edges())


def successor_nodes(t):
    return gs.union_nodes(t.successor_edges())


FOREST_NODES = "forest_nodes AS (SELECT repo_id, src AS path FROM forest UNION SELECT repo_id, dst FROM forest)"
SUCC_NODES = "succ_nodes AS (SELECT repo_id, src AS path FROM successor UNION SELECT repo_id, dst FROM successor)"


# --- one-pass statistics on the module graph ---------------------------------------

FAN = "fan AS (SELECT repo_id, dst AS path, count(*) AS fan_in FROM edges GROUP BY 1, 2)"
MG = f"{GRAPH}, {FAN}"


@query("A1_fan_in", MG + " SELECT * FROM fan")
def a1(t):
    return gs.fan_in(module_graph(t)[1])


STAB = """deg AS (SELECT repo_id, path, CAST(sum(o) AS BIGINT) AS efferent, CAST(sum(i) AS BIGINT) AS afferent FROM (
  SELECT repo_id, src AS path, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo_id, dst, 0, 1 FROM edges UNION ALL SELECT repo_id, path, 0, 0 FROM nodes) GROUP BY 1, 2),
stab AS (SELECT repo_id, path, afferent, efferent, instability, CASE WHEN instability < 0.3 THEN 'stable' WHEN instability > 0.7 THEN 'unstable' ELSE 'balanced' END AS label,
  CASE WHEN instability < 0.3 AND efferent > 3 THEN 'pain' WHEN instability > 0.7 AND afferent = 0 THEN 'uselessness' WHEN instability BETWEEN 0.3 AND 0.7 THEN 'main-sequence' ELSE 'balanced' END AS zone
  FROM (SELECT *, CASE WHEN efferent + afferent = 0 THEN 0.5::DOUBLE ELSE CAST(efferent AS DOUBLE) / (efferent + afferent) END AS instability FROM deg))"""
MS = f"{MG}, {STAB}"


@query("A2_stability", MS + " SELECT * REPLACE (round(instability, 6) AS instability) FROM stab")
def a2(t):
    return rnd(gs.stability(*module_graph(t)), "instability")


@query("A2_stability_summary", MS + " SELECT repo_id, round(avg(instability), 6) AS avg_instability, count(*) AS files FROM stab GROUP BY 1")
def a2b(t):
    return rnd(gs.stability_summary(gs.stability(*module_graph(t))), "avg_instability")


@query("A2_stability_extremes", MS + """ SELECT repo_id, side, CAST(rank AS INTEGER) AS rank, path, round(instability, 6) AS instability FROM (
  SELECT repo_id, 'most_unstable' AS side, row_number() OVER (PARTITION BY repo_id ORDER BY instability DESC, path) AS rank, path, instability FROM stab
  UNION ALL SELECT repo_id, 'most_stable', row_number() OVER (PARTITION BY repo_id ORDER BY instability, path DESC), path, instability FROM stab) WHERE rank <= 10""")
def a2c(t):
    return rnd(gs.stability_extremes(gs.stability(*module_graph(t))), "instability")


@query("A3_stability_zone_counts", MS + """ SELECT repo_id, count(*) FILTER (WHERE zone = 'pain') AS pain, count(*) FILTER (WHERE zone = 'uselessness') AS uselessness,
  count(*) FILTER (WHERE instability > 0.7) AS unstable FROM stab GROUP BY 1""")
def a3(t):
    return gs.stability_zone_counts(gs.stability(*module_graph(t)))


M_ENTRIES = f"""entries AS (SELECT repo_id, path FROM ({boosted('module_files')}) WHERE role = 'entry')"""


def module_entries(t):
    return inv.entry_points(inv.boost_entry_points(inv.classify_and_score(t.module_files())))


@query("A3_stability_plot", MS + f", {M_ENTRIES}" + """ SELECT repo_id, path, round(instability, 6) AS instability,
  round(CAST(afferent AS DOUBLE) / greatest(max(afferent) OVER (PARTITION BY repo_id), 1), 6) AS ca_scaled,
  CASE WHEN zone = 'pain' THEN 'pain' WHEN zone = 'uselessness' THEN 'uselessness' WHEN instability > 0.5 THEN 'unstable' ELSE 'healthy' END AS plot_class,
  CASE WHEN e.path IS NULL THEN zone END AS zone_tag FROM stab LEFT JOIN entries e USING (repo_id, path)""")
def a3b(t):
    return rnd(gs.stability_plot(gs.stability(*module_graph(t)), module_entries(t)), "instability", "ca_scaled")


GRADE = "CASE " + " ".join(f"WHEN score >= {g[0]} THEN '{{}}'" for g in fixed.GRADES) + " END"


def graded(pos):
    return GRADE.format(*[g[pos] for g in fixed.GRADES])


HEALTH = f"""health AS (SELECT *, {graded(1)} AS grade, {graded(2)} AS status, {graded(3)} AS color FROM (
  SELECT repo_id, total_files, large_files, coalesce(max_fan_in, 0) AS max_fan_in, {{cycles}} AS cycle_count, CAST(greatest(0, least(100, floor(100 - {{cycles}} * 15
    - CASE WHEN coalesce(max_fan_in, 0) > 10 THEN least(30, (max_fan_in - 10) * 2) ELSE 0 END - CAST(large_files AS DOUBLE) / greatest(1, total_files) * 40 + 0.5))) AS INTEGER) AS score
  FROM (SELECT repo_id, count(*) AS total_files, count(*) FILTER (WHERE size > 15000) AS large_files FROM module_files GROUP BY 1)
  LEFT JOIN (SELECT repo_id, max(fan_in) AS max_fan_in FROM fan GROUP BY 1) USING (repo_id)))"""


@query("A4_health_grade", MG + ", " + HEALTH.replace("{cycles}", "CAST(0 AS INTEGER)") + " SELECT * FROM health")
def a4(t):
    return gs.health_grade(t.module_files(), gs.fan_in(module_graph(t)[1]))


@query("A5_repo_meta", MG + """ SELECT repo_id, n AS nodes, coalesce(e, 0) AS edges FROM (SELECT repo_id, count(*) n FROM nodes GROUP BY 1)
  LEFT JOIN (SELECT repo_id, count(*) e FROM edges GROUP BY 1) USING (repo_id)""")
def a5(t):
    return gs.repo_meta(*module_graph(t))


QUALITY = """t AS (SELECT repo_id, path, path IN (SELECT src FROM {e} UNION SELECT dst FROM {e}) AS touched FROM {n}),
q AS (SELECT repo_id, total_nodes, connected, total_nodes - connected AS orphan_count, CAST(connected AS DOUBLE) / total_nodes AS c, coalesce(edge_count, 0) AS edge_count
  FROM (SELECT n.repo_id, count(*) AS total_nodes, count(d.path) AS connected FROM {n} n LEFT JOIN (SELECT repo_id, src AS path FROM {e} UNION SELECT repo_id, dst FROM {e}) d USING (repo_id, path) GROUP BY 1)
  LEFT JOIN (SELECT repo_id, count(*) AS edge_count FROM {e} GROUP BY 1) USING (repo_id))
SELECT repo_id, round(c, 6) AS connectedness, edge_count >= 2 AND c >= 0.2 AS is_useful,
  CASE WHEN edge_count = 0 THEN 'No import relationships found between files. This repo may not use ES module imports.'
    WHEN c < 0.2 THEN orphan_count || ' of ' || total_nodes || ' files are isolated (no imports/importers). The graph is too sparse to be useful.'
    WHEN c < 0.4 THEN 'Graph is partially connected — ' || connected || ' of ' || total_nodes || ' files have dependencies. Some areas may appear sparse.'
    ELSE 'Graph looks healthy — ' || connected || ' connected nodes, ' || edge_count || ' edges.' END AS diagnosis,
  orphan_count, total_nodes, edge_count FROM q"""


@query("F11_graph_quality", MG + ", " + QUALITY.format(e="edges", n="nodes").split("),\n", 1)[1])
def f11(t):
    return rnd(gs.graph_quality(*module_graph(t)), "connectedness")


@query("U1_union_nodes", SW + " SELECT repo_id, src AS path FROM successor UNION SELECT repo_id, dst FROM successor")
def u1(t):
    return gs.union_nodes(t.successor_edges())


@query("U2_difference", MG + " SELECT repo_id, path FROM nodes EXCEPT SELECT repo_id, dst FROM edges")
def u2(t):
    nodes, edges = module_graph(t)
    return gs.difference(nodes, edges.select("repo_id", F.col("dst").alias("path")))


@query("U3_orphans", MG + " SELECT repo_id, path FROM nodes EXCEPT (SELECT repo_id, src FROM edges UNION SELECT repo_id, dst FROM edges)")
def u3(t):
    return gs.orphans(*module_graph(t))


@query("U4_edges_within", MG + """, m AS (SELECT repo_id, path FROM fan WHERE fan_in > 3)
  SELECT repo_id, src, dst FROM edges e WHERE EXISTS (SELECT 1 FROM m WHERE m.repo_id = e.repo_id AND m.path = src) AND EXISTS (SELECT 1 FROM m WHERE m.repo_id = e.repo_id AND m.path = dst)""")
def u4(t):
    edges = module_graph(t)[1]
    return gs.edges_within(edges, gs.fan_in(edges).filter("fan_in > 3")).select("repo_id", "src", "dst")


@query("W3_blast_targets", MG + """ SELECT repo_id, CAST(rank AS INTEGER) AS rank, path, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path) AS rank FROM fan) WHERE rank <= 3""")
def w3(t):
    return gs.blast_targets(gs.fan_in(module_graph(t)[1]))


@query("W9_hub_nodes", MG + """, d AS (SELECT repo_id, path, count(*) AS degree FROM (SELECT repo_id, src AS path FROM edges UNION ALL SELECT repo_id, dst FROM edges) GROUP BY 1, 2)
  SELECT repo_id, path, degree, degree > max(degree) OVER (PARTITION BY repo_id) * 0.5::DOUBLE AS is_hub FROM d""")
def w9(t):
    return gs.hub_nodes(module_graph(t)[1])


# --- reachability ---------------------------------------------------------------------

SEEDS = "seeds AS (SELECT repo_id, path FROM forest_nodes)"
BLAST = f"{FW}, {FOREST_NODES}, {SEEDS}" + """, reach(repo_id, seed, affected) AS (
  SELECT s.repo_id, s.path, f.src FROM seeds s JOIN forest f ON f.repo_id = s.repo_id AND f.dst = s.path
  UNION SELECT r.repo_id, r.seed, f.src FROM reach r JOIN forest f ON f.repo_id = r.repo_id AND f.dst = r.affected)"""


@query("G1_blast_radius", BLAST + " SELECT * FROM reach")
def g1(t):
    return tr.blast_radius(t.forest_edges(), forest_nodes(t))


RISK = "CASE WHEN n > 20 THEN 'CRITICAL' WHEN n > 10 THEN 'HIGH' WHEN n > 3 THEN 'MEDIUM' ELSE 'LOW' END"


@query("G1_blast_risk", BLAST + f" SELECT repo_id, seed, n, {RISK} AS risk FROM (SELECT s.repo_id, s.path AS seed, count(affected) AS n FROM seeds s LEFT JOIN reach r ON r.repo_id = s.repo_id AND r.seed = s.path GROUP BY 1, 2)")
def g1b(t):
    seeds = forest_nodes(t)
    return tr.blast_risk(tr.blast_radius(t.forest_edges(), seeds), seeds)


# as G1_blast_risk, with counts up to 20, and 21 for all above, which takes no list of what each file affects
@query("G1_blast_levels", BLAST + f" SELECT repo_id, seed, least(n, 21) AS n, {RISK} AS risk FROM (SELECT s.repo_id, s.path AS seed, count(affected) AS n FROM seeds s LEFT JOIN reach r ON r.repo_id = s.repo_id AND r.seed = s.path GROUP BY 1, 2)")
def g1l(t):
    return tr.blast_levels(t.forest_edges(), forest_nodes(t))


CYC = f"{SW}, {SUCC_NODES}" + """, reach(repo_id, seed, affected) AS (
  SELECT repo_id, dst, src FROM successor UNION SELECT r.repo_id, r.seed, f.src FROM reach r JOIN successor f ON f.repo_id = r.repo_id AND f.dst = r.affected)"""


@query("G1_blast_radius_cyclic", f"{TW}" + """, reach(repo_id, seed, affected) AS (
  SELECT repo_id, dst, src FROM trade UNION SELECT r.repo_id, r.seed, f.src FROM reach r JOIN trade f ON f.repo_id = r.repo_id AND f.dst = r.affected) SELECT * FROM reach""")
def g1c(t):
    return tr.blast_radius(t.trade_edges(), t.trade_nodes())


@query("G1_node_blast_edges", f"{TW}" + """, reach(repo_id, seed, node) AS (
  SELECT repo_id, path, path FROM trade_nodes UNION SELECT r.repo_id, r.seed, f.src FROM reach r JOIN trade f ON f.repo_id = r.repo_id AND f.dst = r.node)
  SELECT f.repo_id, r.seed, f.src, f.dst FROM trade f JOIN reach r ON f.repo_id = r.repo_id AND f.dst = r.node""")
def g1d(t):
    return tr.node_blast(t.trade_edges(), t.trade_nodes())[1]


PR_SQL = f"WITH RECURSIVE {SUCCESSOR}, {SUCC_NODES}, {PRS}"


@query("G2_pr_blast", PR_SQL + " SELECT * FROM classes")
def g2(t):
    return tr.pr_blast(t.successor_edges(), gs.union_nodes(t.successor_edges()), t.supplier_prs())


@query("G2_pr_edge_classes", PR_SQL + """ SELECT e.repo_id, a.pr_number, e.src, e.dst, CASE WHEN a.class = 'modified' AND b.class = 'modified' THEN 'modified' ELSE 'hot' END AS class
  FROM successor e JOIN classes a ON a.repo_id = e.repo_id AND a.path = e.src JOIN classes b ON b.repo_id = e.repo_id AND b.path = e.dst AND b.pr_number = a.pr_number""")
def g2b(t):
    edges = durable(t.successor_edges())
    return tr.pr_edge_classes(edges, tr.pr_blast(edges, gs.union_nodes(t.successor_edges()), t.supplier_prs()))


@query("G2_pr_counts", PR_SQL + """ SELECT c.repo_id, pr_number, count(*) FILTER (WHERE class = 'modified') AS modified, count(*) FILTER (WHERE class = 'blast') AS blast, max(total) - count(n.path) AS unaffected
  FROM classes c LEFT JOIN succ_nodes n USING (repo_id, path) JOIN (SELECT repo_id, count(*) AS total FROM succ_nodes GROUP BY 1) USING (repo_id) GROUP BY 1, 2""")
def g2c(t):
    nodes = gs.union_nodes(t.successor_edges())
    return tr.pr_unaffected_counts(nodes, tr.pr_blast(t.successor_edges(), nodes, t.supplier_prs()))


DEPTH = MG + f", {M_ENTRIES}" + """, present AS (SELECT e.repo_id, e.path FROM entries e JOIN nodes USING (repo_id, path)),
start AS (SELECT * FROM present UNION SELECT repo_id, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path) rn FROM fan) WHERE rn <= 5 AND repo_id NOT IN (SELECT repo_id FROM present)),
depths(repo_id, path, depth) USING KEY (repo_id, path) AS (SELECT repo_id, path, 0 FROM start UNION SELECT w.repo_id, e.dst, w.depth + 1 FROM depths w JOIN edges e ON e.repo_id = w.repo_id AND e.src = w.path
  WHERE w.depth < {max} AND NOT EXISTS (SELECT 1 FROM recurring.depths r WHERE r.repo_id = e.repo_id AND r.path = e.dst))"""
DEPTH_ALL = DEPTH.replace("w.depth < {max} AND ", "")


@query("G3_bfs_depth", DEPTH_ALL + " SELECT * FROM depths")
def g3(t):
    nodes, edges = module_graph(t)
    return tr.bfs_depth(edges, nodes, module_entries(t))


@query("G3_layer_sizes", DEPTH_ALL + " SELECT repo_id, depth, count(*) AS files FROM depths WHERE depth >= 1 GROUP BY 1, 2")
def g3b(t):
    nodes, edges = module_graph(t)
    return tr.layer_sizes(tr.bfs_depth(edges, nodes, module_entries(t)))


FILL = f""", ranked AS (SELECT repo_id, CAST(CASE WHEN is_entry THEN rn ELSE rn + entries END AS INTEGER) AS position, path FROM (
    SELECT *, count(*) FILTER (WHERE is_entry AND rn <= 8) OVER (PARTITION BY repo_id) AS entries FROM (
      SELECT *, role = 'entry' AS is_entry, row_number() OVER (PARTITION BY repo_id, role = 'entry' ORDER BY score DESC, path) rn FROM ({boosted('module_files')}) WHERE role <> 'test' AND path NOT LIKE '%.md'))
  WHERE CASE WHEN is_entry THEN rn <= 8 ELSE rn <= 60 - entries END),
have AS (SELECT repo_id, count(*) AS have FROM depths GROUP BY 1),
filled AS (SELECT * FROM depths UNION ALL SELECT repo_id, path, 4 FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY position, path) AS rn FROM ranked ANTI JOIN depths USING (repo_id, path)) LEFT JOIN have USING (repo_id) WHERE rn <= 60 - coalesce(have, 0))"""


@query("G3_files_by_depth", DEPTH_ALL + " SELECT * FROM depths")
def g3c(t):
    nodes, edges = module_graph(t)
    return tr.files_by_depth(edges, nodes, module_entries(t))


@query("G3_files_by_depth_first_60", DEPTH.replace("{max}", "3") + FILL + """ SELECT repo_id, path, depth FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY depth, path) rn FROM filled) WHERE rn <= 60""")
def g3d(t):
    nodes, edges = module_graph(t)
    ranked = inv.top_files(inv.boost_entry_points(inv.classify_and_score(t.module_files())), 60)
    return tr.files_by_depth(edges, nodes, module_entries(t), max_depth=3, max_nodes=60, fallback=ranked)


@query("U5_fallback_fill", DEPTH.replace("{max}", "3") + FILL + " SELECT * FROM filled")
def u5(t):
    nodes, edges = module_graph(t)
    ranked = inv.top_files(inv.boost_entry_points(inv.classify_and_score(t.module_files())), 60)
    return tr.fallback_fill(tr.bfs_depth(edges, nodes, module_entries(t), max_depth=3), ranked, 60, 4)


@query("J7_entry_seeds", DEPTH_ALL + " SELECT * FROM start")
def j7(t):
    nodes, edges = module_graph(t)
    return tr.entry_seeds(nodes, module_entries(t), edges)


ALIVE = MG + f", {M_ENTRIES}" + """, alive(repo_id, path) AS (SELECT repo_id, path FROM entries UNION SELECT a.repo_id, e.dst FROM alive a JOIN edges e ON e.repo_id = a.repo_id AND e.src = a.path)"""


@query("G4_reachability", ALIVE + " SELECT n.repo_id, n.path, a.path IS NOT NULL AS reachable FROM nodes n LEFT JOIN alive a USING (repo_id, path)")
def g4(t):
    nodes, edges = module_graph(t)
    return tr.reachability(nodes, edges, module_entries(t))


@query("G4_dead_code_score", ALIVE + """ SELECT repo_id, keys, coalesce(reached, 0) AS reached, round(coalesce(reached, 0) / CAST(keys AS DOUBLE) * 100, 6) AS score
  FROM (SELECT repo_id, count(*) AS keys FROM nodes GROUP BY 1) LEFT JOIN (SELECT repo_id, count(*) AS reached FROM alive GROUP BY 1) USING (repo_id)""")
def g4b(t):
    nodes, edges = module_graph(t)
    return rnd(tr.dead_code_score(nodes, edges, module_entries(t)), "score")


@query("A10_dead_code_by_directory", ALIVE + """ SELECT repo_id, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '(root)' END AS dir, count(*) AS n, min(path) AS first_path, max(path) AS last_path
  FROM nodes ANTI JOIN alive USING (repo_id, path) GROUP BY 1, 2""")
def a10(t):
    nodes, edges = module_graph(t)
    return gs.dead_code_by_directory(tr.reachability(nodes, edges, module_entries(t)).filter("NOT reachable"))


# --- ranking ---------------------------------------------------------------------------

def pagerank_sql(e: str, n: str, rounds: int, weighted=False, dangling=True, one=False) -> str:
    w = "weight" if weighted else "1.0::DOUBLE"
    parts = [f"""pm AS (SELECT repo_id, path, count(*) OVER (PARTITION BY repo_id) AS n FROM (SELECT repo_id, path FROM {n} UNION SELECT repo_id, dst FROM {e})),
po AS (SELECT repo_id, src, sum({w}) AS ow FROM {e} GROUP BY 1, 2),
pl AS (SELECT e.repo_id, e.src, e.dst, {w} / ow AS share FROM {e} e JOIN po USING (repo_id, src)),
pb AS (SELECT pm.repo_id, pm.path, n, po.src IS NULL AS dangling FROM pm LEFT JOIN po ON po.repo_id = pm.repo_id AND po.src = pm.path),
p0 AS MATERIALIZED (SELECT repo_id, path, {'1.0::DOUBLE' if one else '1.0::DOUBLE / n'} AS rank FROM pb)"""]
    for i in range(rounds):
        mass = f"+ 0.85::DOUBLE * m.mass / b.n" if dangling else ""
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT b.repo_id, b.path, {'(1 - 0.85::DOUBLE)' if one else '(1 - 0.85::DOUBLE) / b.n'} + 0.85::DOUBLE * coalesce(i.x, 0) {mass} AS rank FROM pb b
  LEFT JOIN (SELECT l.repo_id, l.dst, sum(rank * share) AS x FROM p{i} p JOIN pl l ON l.repo_id = p.repo_id AND l.src = p.path GROUP BY 1, 2) i ON i.repo_id = b.repo_id AND i.dst = b.path
  JOIN (SELECT repo_id, sum(CASE WHEN dangling THEN rank ELSE 0 END) AS mass FROM p{i} JOIN pb USING (repo_id, path) GROUP BY 1) m ON m.repo_id = b.repo_id)""")
    return ", ".join(parts)


MINMAX = """SELECT repo_id, path, round(rank, 6) AS rank, CAST(floor((rank - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100 + 0.5) AS INTEGER) AS score
  FROM (SELECT *, max(rank) OVER (PARTITION BY repo_id) AS hi, min(rank) OVER (PARTITION BY repo_id) AS lo FROM p20)"""


@query("G5_pagerank", f"{SW}, {SUCC_NODES}, {pagerank_sql('successor', 'succ_nodes', 20)} {MINMAX}")
def g5(t):
    return rnd(pr.pagerank_default(successor_nodes(t), t.successor_edges()), "rank")


@query("G5_pagerank_weighted", f"{SW}, {SUCC_NODES}, {pagerank_sql('successor', 'succ_nodes', 25, weighted=True)} " + """, c AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, sum(abs(b.rank - a.rank)) AS delta FROM p{i - 1} a JOIN p{i} b USING (repo_id, path)" for i in range(1, 26)) + """),
  stop AS (SELECT coalesce(min(i) FILTER (WHERE delta < 1e-6), 25) AS i FROM c), final AS (""" + " UNION ALL ".join(
    f"SELECT * FROM p{i} WHERE (SELECT i FROM stop) = {i}" for i in range(1, 26)) + """)
  SELECT repo_id, path, round(rank, 6) AS rank, round(rank / max(rank) OVER (PARTITION BY repo_id), 6) AS score FROM final""")
def g5b(t):
    return rnd(pr.pagerank_weighted(successor_nodes(t), t.successor_edges()), "rank", "score")


@query("G5_pagerank_simple", f"{FW}, {FOREST_NODES}, {pagerank_sql('forest', 'forest_nodes', 20, dangling=False, one=True)}" + """
  SELECT repo_id, path, round(rank, 6) AS rank, CAST(floor(rank / greatest(max(rank) OVER (PARTITION BY repo_id), 1) * 100 + 0.5) AS INTEGER) AS score FROM p20""")
def g5c(t):
    return rnd(pr.pagerank_simple(forest_nodes(t), t.forest_edges()), "rank")


RANKS = f"{SW}, {SUCC_NODES}, {pagerank_sql('successor', 'succ_nodes', 20)}, ranks AS ({MINMAX})"
TIER = "CASE WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 2 WHEN score >= 15 THEN 1 ELSE 0 END"


@query("W5_pagerank_top", RANKS + f" SELECT repo_id, CAST(rn AS INTEGER) AS rank_no, path, score, {TIER} AS tier FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) rn FROM ranks) WHERE rn <= 20")
def w5(t):
    return gs.pagerank_top(pr.pagerank_default(successor_nodes(t), t.successor_edges()))


@query("W5_hot_edges", RANKS + f""", h AS (SELECT repo_id, path FROM ranks WHERE {TIER} >= 2)
  SELECT repo_id, src, dst, src IN (SELECT path FROM h) OR dst IN (SELECT path FROM h) AS is_hot FROM successor""")
def w5b(t):
    return gs.hot_edges(t.successor_edges(), pr.pagerank_default(successor_nodes(t), t.successor_edges()))


@query("A9_coverage_gaps", COVER_SQL + GRAPH[GRAPH.index(", es AS (SELECT"):] + f", {FAN}, " + pagerank_sql("edges", "nodes", 20) + f""", ranks AS ({MINMAX}),
  cover AS (SELECT repo_id, path, count(test_path) > 0 AS is_tested FROM sources LEFT JOIN tests USING (repo_id, path) GROUP BY 1, 2),
  gaps AS (SELECT repo_id, path, fan_in, coalesce(is_tested, false) AS is_tested, CAST(coalesce(score, 0) AS DOUBLE) AS page_rank_score,
    CASE WHEN coalesce(is_tested, false) THEN 0 ELSE CAST(floor(coalesce(score, 0) * 0.7::DOUBLE + fan_in * 0.3::DOUBLE + 0.5) AS BIGINT) END AS risk_score
    FROM fan LEFT JOIN cover USING (repo_id, path) LEFT JOIN ranks USING (repo_id, path))
  SELECT repo_id, path, fan_in, is_tested, page_rank_score, risk_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, path) AS rank FROM gaps WHERE risk_score > 0) WHERE rank <= 10""")
def a9(t):
    nodes, edges = module_graph(t)
    return gs.coverage_gaps(gs.fan_in(edges), imp.test_coverage_map(covered_files(t)), pr.pagerank_default(nodes, edges))


# --- components -----------------------------------------------------------------------

@query("G10_connected_components", FW + f", {FOREST_NODES}" + """, bw AS (SELECT repo_id, src a, dst b FROM forest UNION SELECT repo_id, dst, src FROM forest),
  w(repo_id, path, o) AS (SELECT repo_id, path, path FROM forest_nodes WHERE path LIKE 'r:%' OR path LIKE 'n:%' UNION SELECT w.repo_id, b.b, w.o FROM w JOIN bw b ON b.repo_id = w.repo_id AND b.a = w.path),
  l AS (SELECT w.repo_id, w.path, min(x.path) AS component FROM w JOIN w x ON x.repo_id = w.repo_id AND x.o = w.o WHERE w.o LIKE 'r:%' GROUP BY 1, 2)
  SELECT repo_id, path, component, count(*) OVER (PARTITION BY repo_id, component) AS size FROM l""".replace("WHERE path LIKE 'r:%' OR path LIKE 'n:%'", "WHERE path LIKE 'r:%'")
       .replace("l AS (SELECT w.repo_id, w.path, min(x.path) AS component FROM w JOIN w x ON x.repo_id = w.repo_id AND x.o = w.o WHERE w.o LIKE 'r:%' GROUP BY 1, 2)",
                "l AS (SELECT repo_id, path, min(path) OVER (PARTITION BY repo_id, o) AS component FROM w)"))
def g10(t):
    return comp.connected_components(forest_nodes(t), t.forest_edges())


SCC = f"{CYC}" + """, mutual AS (SELECT a.repo_id, a.seed AS x, a.affected AS y FROM reach a JOIN reach b ON a.repo_id = b.repo_id AND a.seed = b.affected AND a.affected = b.seed),
  scc AS (SELECT n.repo_id, n.path, coalesce(greatest(max(y), n.path), n.path) AS scc_id FROM succ_nodes n LEFT JOIN mutual m ON m.repo_id = n.repo_id AND m.x = n.path GROUP BY 1, 2),
  scc2 AS (SELECT repo_id, path, scc_id, count(*) OVER (PARTITION BY repo_id, scc_id) AS size FROM scc),
  comps AS (SELECT repo_id, path, scc_id, size, size > 1 AS is_cyclic FROM scc2)"""


@query("G6_strongly_connected", SCC + " SELECT * FROM comps")
def g6(t):
    return comp.strongly_connected(successor_nodes(t), t.successor_edges())


SCC_T = SCC.replace(CYC, TW + """, reach(repo_id, seed, affected) AS (SELECT repo_id, dst, src FROM trade UNION SELECT r.repo_id, r.seed, f.src FROM reach r JOIN trade f ON f.repo_id = r.repo_id AND f.dst = r.affected)""").replace(
    "succ_nodes", "trade_nodes").replace("size > 1 AS is_cyclic", "size > 1 OR path IN (SELECT src FROM trade WHERE src = dst) AS is_cyclic")


@query("G6_cycle_summary", SCC_T + " SELECT repo_id, count(DISTINCT scc_id) AS cycle_count, count(*) AS cycle_nodes FROM comps WHERE is_cyclic GROUP BY 1")
def g6b(t):
    return comp.cycle_summary(comp.strongly_connected(t.trade_nodes(), t.trade_edges()))


@query("G6_cycle_edges", SCC_T + """ SELECT e.repo_id, e.src, e.dst FROM trade e JOIN comps a ON a.repo_id = e.repo_id AND a.path = e.src JOIN comps b ON b.repo_id = e.repo_id AND b.path = e.dst
  WHERE a.is_cyclic AND b.is_cyclic AND a.scc_id = b.scc_id""")
def g6c(t):
    return comp.cycle_edges(comp.strongly_connected(t.trade_nodes(), t.trade_edges()), t.trade_edges())


@query("A4_health_grade_with_cycles", SCC_T.replace("SELECT", "SELECT", 1) + ", " + FOREST.replace("forest AS", "unused AS") + """,
  sizes AS (SELECT 'trade' AS repo_id, 'n' || n_nationkey AS path, CAST(count(c_custkey) AS BIGINT) * 300 AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
  module_files AS (SELECT * FROM sizes), fan AS (SELECT repo_id, dst AS path, count(*) AS fan_in FROM trade GROUP BY 1, 2), """
       + HEALTH.replace("{cycles}", "(SELECT count(DISTINCT scc_id) FROM comps WHERE is_cyclic)") + " SELECT * FROM health")
def a4b(t):
    per = t.raw("customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("path")).agg((F.count(F.lit(1)) * 300).alias("size"))
    files = t.trade_nodes().join(per, "path", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    cycles = comp.cycle_summary(comp.strongly_connected(t.trade_nodes(), t.trade_edges()))
    return gs.health_grade(files, gs.fan_in(t.trade_edges()), cycles)


# removal of every node (or edge) in turn, then reachability over what is left
# the most frequent successor only: trees hanging on cycles, with bridges and articulation points
LEAD_SQL = SW + """, lead_edges AS (SELECT repo_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, CAST(substr(dst, 2) AS BIGINT)) rn FROM successor) WHERE rn = 1),
lead_nodes AS (SELECT repo_id, src AS path FROM lead_edges UNION SELECT repo_id, dst FROM lead_edges)"""


def lead_edges(t):
    best = Window.partitionBy("src").orderBy(F.desc("weight"), F.substring("dst", 2, 20).cast("bigint"))
    return t.successor_edges().withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("repo_id", "src", "dst")


def lead_graph(t):
    edges = durable(lead_edges(t))
    return gs.union_nodes(edges), edges


UND = "und AS (SELECT repo_id, src AS a, dst AS b FROM lead_edges WHERE src <> dst UNION SELECT repo_id, dst, src FROM lead_edges WHERE src <> dst)"
CUT = f"{LEAD_SQL}, {UND}" + """, w(x, s, p) AS (SELECT x.path, s.path, s.path FROM lead_nodes x, lead_nodes s WHERE x.path <> s.path UNION SELECT w.x, w.s, u.b FROM w JOIN und u ON u.a = w.p WHERE u.b <> w.x),
  near AS (SELECT DISTINCT u.a AS x, u.b AS s FROM und u),
  pieces AS (SELECT n.x, count(DISTINCT c.comp) AS comps, max(c.size) AS largest FROM near n JOIN (SELECT x, s, min(p) AS comp, count(*) AS size FROM w GROUP BY 1, 2) c ON c.x = n.x AND c.s = n.s GROUP BY 1),
  ap AS (SELECT 'next' AS repo_id, x AS path, largest AS fragment_size FROM pieces WHERE comps >= 2)"""


@query("G7_articulation_points", CUT + " SELECT * FROM ap")
def g7(t):
    return bic.biconnected(*lead_graph(t)).articulation_points


@query("G7_articulation_points_forest", FW + f", {FOREST_NODES}" + """, tree AS (SELECT repo_id, src, dst FROM forest), sub(repo_id, x, p) AS (SELECT repo_id, path, path FROM forest_nodes UNION SELECT s.repo_id, s.x, f.src FROM sub s JOIN tree f ON f.repo_id = s.repo_id AND f.dst = s.p),
  nd AS (SELECT repo_id, x, count(*) AS nd FROM sub GROUP BY 1, 2), tot AS (SELECT repo_id, count(*) AS n FROM forest_nodes GROUP BY 1),
  pieces AS (SELECT f.repo_id, f.dst AS x, nd.nd AS size FROM tree f JOIN nd ON nd.repo_id = f.repo_id AND nd.x = f.src UNION ALL SELECT f.repo_id, f.src, n - nd.nd FROM tree f JOIN nd ON nd.repo_id = f.repo_id AND nd.x = f.src JOIN tot ON tot.repo_id = f.repo_id)
  SELECT repo_id, x AS path, max(size) AS fragment_size FROM pieces GROUP BY 1, 2 HAVING count(*) >= 2""")
def g7b(t):
    return bic.biconnected(forest_nodes(t), t.forest_edges()).articulation_points


BRIDGES = f"{LEAD_SQL}, " + """pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT src) AS k FROM lead_edges WHERE src <> dst GROUP BY 1, 2),
  w(a, b, p) AS (SELECT a, b, a FROM pairs WHERE k = 1 UNION SELECT w.a, w.b, CASE WHEN q.a = w.p THEN q.b ELSE q.a END FROM w JOIN pairs q ON (q.a = w.p OR q.b = w.p) AND NOT (q.a = w.a AND q.b = w.b)),
  bridges AS (SELECT a, b FROM pairs WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.a = pairs.a AND w.b = pairs.b AND w.p = pairs.b))"""


@query("G7_bridges", BRIDGES + " SELECT DISTINCT repo_id, src, dst FROM lead_edges JOIN bridges ON least(src, dst) = a AND greatest(src, dst) = b")
def g7c(t):
    return bic.biconnected(*lead_graph(t)).bridges


@query("G7_bridges_forest", FW + " SELECT repo_id, src, dst FROM forest")
def g7d(t):
    return bic.biconnected(forest_nodes(t), t.forest_edges()).bridges


@query("W4_rank_articulation", CUT + """ SELECT repo_id, path, fragment_size, CASE rn WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END AS severity, CAST(floor(CAST(fragment_size AS DOUBLE) / peak * 100 + 0.5) AS INTEGER) AS pct
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fragment_size DESC, path) AS rn, max(fragment_size) OVER (PARTITION BY repo_id) AS peak FROM ap)""")
def w4(t):
    return gs.rank_articulation(bic.biconnected(*lead_graph(t)).articulation_points)


BTW = f"{SW}, {SUCC_NODES}" + """, e AS (SELECT DISTINCT src, dst FROM successor WHERE src <> dst),
  dist(s, v, dist) USING KEY (s, v) AS (SELECT path, path, 0 FROM succ_nodes UNION SELECT d.s, e.dst, d.dist + 1 FROM dist d JOIN e ON e.src = d.v WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.s = d.s AND r.v = e.dst)),
  {sigmas}
  sig AS MATERIALIZED ({union}),
  pairs AS (SELECT a.v AS path, sum(CAST(a.sigma AS DOUBLE) * b.sigma / st.sigma) AS x FROM sig a JOIN sig b ON b.s = a.v JOIN sig st ON st.s = a.s AND st.v = b.v
    WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.dist + b.dist = st.dist GROUP BY 1),
  scores AS (SELECT n.repo_id, n.path, coalesce(x, 0) / ((t.n - 1) * (t.n - 2)) AS score FROM succ_nodes n JOIN (SELECT repo_id, count(*) AS n FROM succ_nodes GROUP BY 1) t USING (repo_id) LEFT JOIN pairs USING (path))"""
_LV = 12
BTW = BTW.replace("{sigmas}", "s0 AS MATERIALIZED (SELECT s, v, 1.0::DOUBLE AS sigma, 0 AS dist FROM dist WHERE dist = 0), " + " ".join(
    f"s{i} AS MATERIALIZED (SELECT p.s, e.dst AS v, sum(p.sigma) AS sigma, {i} AS dist FROM s{i - 1} p JOIN e ON e.src = p.v JOIN dist d ON d.s = p.s AND d.v = e.dst AND d.dist = {i} GROUP BY 1, 2)," for i in range(1, _LV)))
BTW = BTW.replace("{union}", " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(_LV)))


@query("G8_betweenness", BTW + " SELECT repo_id, path, round(score, 6) AS score FROM scores")
def g8(t):
    return rnd(btw.betweenness(successor_nodes(t), t.successor_edges(), batches=2), "score")


@query("W6_betweenness_severity", BTW + " SELECT repo_id, path, CASE WHEN round(score, 9) >= 0.15 THEN 'critical' WHEN round(score, 9) >= 0.07 THEN 'high' WHEN round(score, 9) >= 0.01 THEN 'medium' ELSE 'low' END AS severity FROM scores")
def w6(t):
    scores = btw.betweenness(successor_nodes(t), t.successor_edges())
    return scores.select("repo_id", "path", gs.betweenness_severity(F.round("score", 9)).alias("severity"))


# --- exports and the flagship ------------------------------------------------------------

CLEAN = "regexp_replace({}, '[^a-zA-Z0-9_]', '_', 'g')"


@query("S10_edge_list_export", MG + f", {M_ENTRIES}" + f""", guess AS (SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) rn FROM nodes LEFT JOIN fan USING (repo_id, path)
    WHERE repo_id NOT IN (SELECT repo_id FROM entries) AND (regexp_matches(path, 'index\\.|main\\.|page\\.|app\\.') OR fan_in > 2)) WHERE rn <= 3),
  start AS (SELECT repo_id, path FROM entries UNION SELECT repo_id, path FROM guess),
  met(repo_id, node, depth) USING KEY (repo_id, node) AS (SELECT repo_id, path, 0 FROM start UNION SELECT w.repo_id, e.dst, w.depth + 1 FROM met w JOIN edges e ON e.repo_id = w.repo_id AND e.src = w.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.met r WHERE r.repo_id = e.repo_id AND r.node = e.dst))
  SELECT DISTINCT repo_id, 0 AS part, 0 AS depth, '' AS node, '' AS dep, 'graph TD' AS line FROM nodes
  UNION ALL SELECT DISTINCT repo_id, 1, 0, '', '', 'subgraph Entry' FROM start UNION ALL SELECT DISTINCT repo_id, 3, 0, '', '', 'end' FROM start
  UNION ALL SELECT repo_id, 2, 0, path, '', '  ' || {CLEAN.format('path')} || '["' || regexp_extract(path, '[^/]*$') || '"]' FROM start
  UNION ALL SELECT m.repo_id, 4, depth, node, dst, '  ' || {CLEAN.format('node')} || ' --> ' || {CLEAN.format('dst')} FROM met m JOIN (SELECT DISTINCT repo_id, src, dst FROM edges) e ON e.repo_id = m.repo_id AND e.src = m.node""")
def s10(t):
    nodes, edges = module_graph(t)
    return sinks.edge_list_export(edges, nodes, module_entries(t))


REPORT = (
    MS + f", {M_ENTRIES}, " + DEPTH_ALL.split(f"{M_ENTRIES}, ", 1)[1] + ", "
    + pagerank_sql("edges", "nodes", 20) + f", ranks AS ({MINMAX}), " + HEALTH.replace("{cycles}", "0"))


@query("Q1_architecture_report", REPORT + f""" SELECT s.repo_id, s.path, afferent, efferent, round(instability, 6) AS instability, zone, coalesce(r.score, 0) AS page_rank, {TIER.replace('score', 'coalesce(r.score, 0)')} AS tier,
    coalesce(d.depth, -1) AS entry_depth, d.depth IS NOT NULL AS reachable, h.score AS health_score, grade
  FROM stab s LEFT JOIN ranks r USING (repo_id, path) LEFT JOIN depths d USING (repo_id, path) LEFT JOIN health h USING (repo_id)""")
def q1(t):
    nodes, edges = module_graph(t)
    report = repository.architecture_report(t.module_files(), nodes, edges, module_entries(t))
    return report.withColumn("entry_depth", F.coalesce("entry_depth", F.lit(-1)))


M_REACH = """reach(repo_id, seed, affected) AS (SELECT repo_id, src, dst FROM edges UNION SELECT r.repo_id, r.seed, e.dst FROM reach r JOIN edges e ON e.repo_id = r.repo_id AND e.src = r.affected)"""
Q1_CYCLES = M_REACH + """, mutual AS (SELECT a.repo_id, a.seed AS x, greatest(max(a.affected), a.seed) AS scc FROM reach a JOIN reach b ON a.repo_id = b.repo_id AND a.seed = b.affected AND a.affected = b.seed GROUP BY 1, 2),
  cycles AS (SELECT repo_id, count(DISTINCT scc) AS cycle_count FROM mutual GROUP BY 1)"""
Q1_PARTS = ", ".join([
    Q1_CYCLES, ALIVE.split(f"{M_ENTRIES}, ", 1)[1], HEALTH.replace("FROM (SELECT repo_id, count(*) AS total_files", "FROM (SELECT * FROM (SELECT repo_id, count(*) AS total_files").replace(
        "module_files GROUP BY 1)", "module_files GROUP BY 1) LEFT JOIN cycles USING (repo_id))", 1).replace("{cycles}", "coalesce(cycle_count, 0)")])


@query("Q1_repository_summary", MS + f", {M_ENTRIES}, {Q1_PARTS}" + """, meta AS (SELECT repo_id, n AS nodes, coalesce(e, 0) AS edges FROM (SELECT repo_id, count(*) n FROM nodes GROUP BY 1) LEFT JOIN (SELECT repo_id, count(*) e FROM edges GROUP BY 1) USING (repo_id)),
  linked AS (SELECT n.repo_id, count(d.path) AS connected FROM nodes n LEFT JOIN (SELECT repo_id, src AS path FROM edges UNION SELECT repo_id, dst FROM edges) d USING (repo_id, path) GROUP BY 1),
  zones AS (SELECT repo_id, round(avg(instability), 6) AS avg_instability, count(*) FILTER (WHERE zone = 'pain') AS pain, count(*) FILTER (WHERE zone = 'uselessness') AS uselessness FROM stab GROUP BY 1),
  got AS (SELECT repo_id, count(*) AS reached FROM alive GROUP BY 1)
  SELECT repo_id, m.nodes, m.edges, round(CAST(connected AS DOUBLE) / m.nodes, 6) AS connectedness, m.edges >= 2 AND CAST(connected AS DOUBLE) / m.nodes >= 0.2 AS is_useful, m.nodes - connected AS orphan_count,
    avg_instability, pain, uselessness, h.cycle_count, h.max_fan_in, h.score AS health_score, grade, coalesce(reached, 0) AS reached, round(coalesce(reached, 0) / CAST(m.nodes AS DOUBLE) * 100, 6) AS reached_percent
  FROM meta m JOIN linked USING (repo_id) JOIN zones USING (repo_id) JOIN health h USING (repo_id) LEFT JOIN got USING (repo_id)""")
def q1b(t):
    nodes, edges = module_graph(t)
    summary = repository.repository_summary(t.module_files(), nodes, edges, module_entries(t))
    return rnd(summary.drop("language", "is_graphable", "total_files"), "connectedness", "avg_instability", "reached_percent")
