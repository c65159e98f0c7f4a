"""Laid-out graphs: hubs in parts, ids in order, and what loops over them give."""
import random
import re

import pytest
from conftest import graph, rows

from repolumen.operators import graph_stats as gs, layout, rank_flow as pr, traversal as tr


def reach(edges, seeds, reverse=False):
    out = set()
    for s in seeds:
        todo, seen = [s], {s: 0}
        while todo:
            x = todo.pop(0)
            for a, b in edges:
                a, b = (b, a) if reverse else (a, b)
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    todo.append(b)
        out |= {(s, x, d) for x, d in seen.items()}
    return out


def made(seed, n=25, m=60):
    rng = random.Random(seed)
    names = [f"f{i:02d}" for i in range(n)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(m)}
    return sorted(edges | {("f00", x) for x in names[:15]} | {(x, "f01") for x in names[5:]})


@pytest.mark.parametrize("part", [None, 3])
def test_walks_equal_brute_force(spark, part):
    edges = made(1)
    _, e = graph(spark, edges)
    flow = layout.lay_out(e.union(e), part=part)
    assert flow.hubs == (part is not None) and flow.arcs.count() == len(edges)
    ids = [r["path"] for r in flow.names.orderBy("id").collect()]
    assert ids == sorted({x for p in edges for x in p})
    starts = ["f00", "f07", "gone"]
    seeds = spark.createDataFrame([("r", s, s) for s in starts], "repo_id string, seed string, node string")
    got = set(rows(tr.expand(seeds, flow, ["repo_id", "seed"]), "seed", "node", "depth"))
    assert got == reach(edges, starts)
    flow.drop()


def test_edges_stay_in_a_loop(spark):
    _, e = graph(spark, made(2))
    flow = layout.lay_out(e)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flow.follow(flow.names.select(flow.names.id.alias("node"), "parts"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the one exchange is that of the state
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange" not in plan.rsplit("+- Sort", 1)[1]
    flow.drop()


@pytest.mark.parametrize("part", [layout.PART, 4])
def test_blast_levels_equal_counts(spark, monkeypatch, part):
    monkeypatch.setattr(layout, "PART", part)
    rng = random.Random(4)
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(26)]  # counts from 0 to 26
    edges = chain + [(a + "x", b + "x") for a, b in made(3, 12, 9)] + [("lone", "lone")]
    rng.shuffle(edges)
    nodes, e = graph(spark, edges, nodes=["apart"])
    want = {r["seed"]: (min(r["n"], 21), r["risk"]) for r in tr.blast_risk(tr.blast_radius(e, nodes), nodes).collect()}
    got = {r["seed"]: (r["n"], r["risk"]) for r in tr.blast_levels(e, nodes).collect()}
    assert got == want and {n for n, _ in got.values()} > {0, 1, 3, 4, 10, 11, 20, 21}


@pytest.mark.parametrize("kind", ["default", "weighted", "simple"])
def test_ranks_equal_plain_iteration(spark, monkeypatch, kind):
    monkeypatch.setattr(layout, "PART", 4)
    rng = random.Random(6)
    edges = made(5)
    weight = {e: float(rng.randint(1, 5)) for e in edges}
    nodes, _ = graph(spark, edges, nodes=["apart"])
    e = spark.createDataFrame([("r", a, b, weight[a, b]) for a, b in edges], "repo_id string, src string, dst string, weight double")
    names = [r["path"] for r in nodes.collect()]
    w = weight if kind == "weighted" else dict.fromkeys(edges, 1.0)
    out = {x: sum(w[p] for p in edges if p[0] == x) for x in names}
    n, one, d = len(names), kind == "simple", 0.85
    rank = {x: 1.0 if one else 1 / n for x in names}
    for _ in range(25 if kind == "weighted" else 20):
        mass = 0 if one else sum(r for x, r in rank.items() if not out[x])
        new = {x: (1 - d) / (1 if one else n) + d * mass / n for x in names}
        for a, b in edges:
            new[b] += d * rank[a] * w[a, b] / out[a]
        moved, rank = sum(abs(new[x] - rank[x]) for x in names), new
        if kind == "weighted" and moved < 1e-6:
            break
    got = dict(rows({"default": pr.pagerank_default, "weighted": pr.pagerank_weighted, "simple": pr.pagerank_simple}[kind](nodes, e), "path", "rank"))
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-12 for x in names)


def test_layout_leaves_no_copies_of_the_edges(spark):
    """Edges are written as columns while numbers are given, not as checkpoints, and are gone afterwards."""
    import os

    from repolumen.session import shared_dir
    _, edges = graph(spark, [(f"a{i}", f"b{i % 7}") for i in range(50)])
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    laid = layout.lay_out(edges)
    new = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    cuts = [name for name in set(os.listdir(folder)) - before if name.startswith("rdd-")]
    assert new <= {"rdd", "arcs"} and len(cuts) <= 2  # names, and the nodes in several parts
    assert laid.arcs.count() == 50 and laid.names.count() == 57
    laid.drop()


def shuffles_by_repository(df):
    """How many exchanges of a plan put each repository into one task."""
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    return sum(k.startswith("repo_id#") and k.count("#") == 1 for k in keys)


def test_stability_plot_keeps_large_repositories_in_many_tasks(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "b"), ("b", "d")], ["alone"])
    entries = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "gone")], "repo_id string, path string")
    got = gs.stability_plot(gs.stability(nodes, edges), entries)
    assert shuffles_by_repository(got) == 0
    assert rows(got, "path", "ca_scaled", "plot_class", "zone_tag") == [
        ("a", 0.0, "uselessness", None), ("alone", 0.0, "healthy", "main-sequence"), ("b", 1.0, "healthy", "main-sequence"),
        ("c", 0.0, "uselessness", "uselessness"), ("d", 0.5, "healthy", "balanced")]


def test_hub_nodes_keep_large_repositories_in_many_tasks(spark):
    _, edges = graph(spark, [("a", "b"), ("c", "b"), ("b", "d"), ("e", "e")])
    got = gs.hub_nodes(edges)
    assert shuffles_by_repository(got) == 0
    assert rows(got, "path", "degree", "is_hub") == [
        ("a", 1, False), ("b", 3, True), ("c", 1, False), ("d", 1, False), ("e", 2, True)]


def test_ranks_keep_large_repositories_in_many_tasks(spark):
    # many files import one, which imports another: only the two are ever met by the walk
    edges = [(f"m{i:02d}", "hub") for i in range(30)] + [("hub", "leaf"), ("gone", "")]
    nodes, e = graph(spark, edges)
    nodes = nodes.filter("path <> 'gone'")
    got = pr.pagerank_default(nodes, e.selectExpr("repo_id", "src", "nullif(dst, '') AS dst"))
    assert shuffles_by_repository(got) == 0
    n, links = 32, edges[:-1]
    rank = {p: 1 / n for p in {x for a in links for x in a}}
    for _ in range(20):
        new = {p: 0.15 / n + 0.85 * rank["leaf"] / n for p in rank}
        for a, b in links:
            new[b] += 0.85 * rank[a]
        rank = new
    assert dict(rows(got, "path", "rank")) == pytest.approx(rank)
