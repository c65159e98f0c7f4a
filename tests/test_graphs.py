import random
from collections import defaultdict, deque

import pytest

from conftest import graph, rows
from repolumen.operators import betweenness as btw, biconnected as bic, components as comp, graph_stats as gs, rank_flow as pr, traversal as tr

CLASSIC = [(a, b) for x in (("1", "2"), ("2", "3"), ("2", "5"), ("4", "5"), ("5", "6")) for a, b in (x, x[::-1])]
CASES = {
    "empty": ([], [], {}, []),
    "single": ([], ["a"], {}, []),
    "self_loop": ([("a", "a")], [], {}, []),
    "duplicate": ([("a", "b"), ("a", "b")], [], {}, [("a", "b")]),
    "chain": ([("a", "b"), ("b", "c")], [], {"b": 1}, [("a", "b"), ("b", "c")]),
    "empty_target": ([("a", ""), ("a", "b"), ("a", "")], [], {}, [("a", "b")]),
    "triangle": ([("a", "b"), ("b", "c"), ("c", "a")], [], {}, []),
    "classic6": (CLASSIC, [], {"2": 3, "5": 3}, []),
    "mutual": ([("a", "b"), ("b", "a")], [], {}, []),
    "islands": ([("a", "b"), ("b", "c"), ("d", "e")], [], {"b": 1}, [("a", "b"), ("b", "c"), ("d", "e")]),
    "star": ([("hub", f"l{i}") for i in range(1, 5)], [], {"hub": 1}, [("hub", f"l{i}") for i in range(1, 5)]),
    "chain4": ([("a", "b"), ("b", "c"), ("c", "d")], [], {"b": 2, "c": 2}, [("a", "b"), ("b", "c"), ("c", "d")]),
}


def many(spark, named):
    """All graphs as repositories of one table."""
    edges = [(name, a, b) for name, (e, *_) in named.items() for a, b in e]
    nodes = {(name, x) for name, (e, n, *_) in named.items() for x in list(n) + [y for p in e for y in p if y]}
    return (spark.createDataFrame(sorted(nodes), "repo_id string, path string"),
            spark.createDataFrame(edges, "repo_id string, src string, dst string"))


def by_repo(df, *cols):
    out = defaultdict(list)
    for r in df.collect():
        out[r["repo_id"]].append(tuple(r[c] for c in cols))
    return out


def test_articulation_points_and_bridges(spark):
    out = bic.biconnected(*many(spark, CASES))
    points, bridges = by_repo(out.articulation_points, "path", "fragment_size"), by_repo(out.bridges, "src", "dst")
    for name, (_, _, want, want_bridges) in CASES.items():
        assert dict(points.get(name, [])) == want, name
        assert sorted(bridges.get(name, [])) == sorted(want_bridges), name


def random_graphs(seed, count=12, n=9):
    rnd = random.Random(seed)
    out = {}
    for i in range(count):
        names = [f"v{k}" for k in range(n)]
        m = rnd.randint(3, 14)
        out[f"g{i}"] = (sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(m)}), names)
    return out


def pieces(nodes, edges, gone=None, cut=None):
    near = defaultdict(set)
    for a, b in edges:
        if a != b and gone not in (a, b) and {a, b} != cut:
            near[a].add(b)
            near[b].add(a)
    left, out = set(nodes) - {gone}, []
    while left:
        queue, seen = [left.pop()], set()
        while queue:
            x = queue.pop()
            seen.add(x)
            for y in near[x]:
                if y in left:
                    left.discard(y)
                    queue.append(y)
        out.append(seen)
    return out


def test_biconnected_equals_removal(spark):
    named = random_graphs(1)
    out = bic.biconnected(*many(spark, named))
    points, bridges = by_repo(out.articulation_points, "path", "fragment_size"), by_repo(out.bridges, "src", "dst")
    for name, (edges, nodes) in named.items():
        whole = pieces(nodes, edges)
        want = {}
        for v in nodes:
            rest = [p for p in pieces(nodes, edges, gone=v) if p <= next(w for w in whole if v in w)]
            if len(rest) > 1:
                want[v] = max(map(len, rest))
        assert dict(points.get(name, [])) == want, name
        simple = {(a, b) for a, b in edges if a != b}
        want_bridges = [(a, b) for a, b in simple if (b, a) not in simple and len(pieces(nodes, edges, cut={a, b})) > len(whole)]
        assert sorted(bridges.get(name, [])) == sorted(want_bridges), name


def test_biconnected_needs_no_round_per_level(spark):
    n, loop = 3000, 700
    chain = [(f"f{i:05d}", f"f{i + 1:05d}") for i in range(n - 1)] + [(f"f{loop:05d}", "f00000")]
    nodes, edges = graph(spark, chain)
    out = bic.biconnected(nodes, edges)
    assert dict(rows(out.articulation_points, "path", "fragment_size")) == {
        f"f{i:05d}": max(i, n - 1 - i) for i in range(loop, n - 1)}
    assert rows(out.bridges, "src", "dst") == sorted(chain[loop:-1])
    sizes = out.blocks.groupBy("block").count()
    assert sorted(r["count"] for r in sizes.collect()) == [1] * (n - 1 - loop) + [loop + 1]


def test_ranges_are_folded_by_blocks(spark):
    rnd = random.Random(5)
    size = 400
    low, high = [rnd.randrange(1000) for _ in range(size)], [rnd.randrange(1000) for _ in range(size)]
    held = [p for p in range(size) if rnd.random() < 0.6]
    asked = {k: sorted((rnd.choice(held), rnd.randrange(size))) for k in range(200)}
    cells = spark.createDataFrame([(7, p, low[p], high[p]) for p in held], "root long, pos long, low long, high long")
    wanted = spark.createDataFrame([(k, 7, a, b) for k, (a, b) in asked.items()], "node long, root long, lo long, hi long")
    got = {r["node"]: (r["low"], r["high"]) for r in bic.fold_ranges(cells, wanted, size=4).collect()}
    assert got == {k: (min(low[p] for p in held if a <= p <= b), max(high[p] for p in held if a <= p <= b)) for k, (a, b) in asked.items()}


def test_hub_neighbours_in_groups_make_one_tour(spark, monkeypatch):
    monkeypatch.setattr(bic, "NEIGHBOURS_PER_GROUP", 3)
    leaves = [f"l{i}" for i in range(20)]
    nodes, edges = graph(spark, [("hub", x) for x in leaves] + [("l0", "l1"), ("l2", "deep")])
    out = bic.biconnected(nodes, edges)
    assert dict(rows(out.articulation_points, "path", "fragment_size")) == {"hub": 2, "l2": 20}
    assert rows(out.bridges, "src", "dst") == sorted([("hub", x) for x in leaves[2:]] + [("l2", "deep")])


def reach(edges, start):
    out, queue = set(), [start]
    while queue:
        x = queue.pop()
        for a, b in edges:
            if a == x and b not in out:
                out.add(b)
                queue.append(b)
    return out


def test_components_equal_brute_force(spark):
    named = random_graphs(2)
    nodes, edges = many(spark, named)
    cc, scc = by_repo(comp.connected_components(nodes, edges), "path", "component", "size"), by_repo(
        comp.strongly_connected(nodes, edges), "path", "scc_id", "size", "is_cyclic")
    for name, (e, names) in named.items():
        for part in pieces(names, e):
            assert {r for r in cc[name] if r[0] in part} == {(x, min(part), len(part)) for x in part}
        for path, scc_id, size, cyclic in scc[name]:
            mine = {y for y in names if y in reach(e, path) and path in reach(e, y)} | {path}
            assert (scc_id, size, cyclic) == (max(mine), len(mine), path in reach(e, path)), (name, path)


def brandes(names, edges):
    adj = defaultdict(list)
    for a, b in set(edges):
        if a != b:
            adj[a].append(b)
    score = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, order, preds, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list), deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(names)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness(spark):
    named = random_graphs(4, count=6)
    named["chain4"] = ([("a", "b"), ("b", "c"), ("c", "d")], [])
    named["under3"] = ([("a", "b")], [])
    named["tail"] = ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], [])
    got = by_repo(btw.betweenness(*many(spark, named), batches=3), "path", "score")
    assert "under3" not in got
    assert dict(got["chain4"]) == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0})
    assert dict(got["tail"]) == pytest.approx({"a": 0, "b": 1 / 12, "c": 1 / 12, "d": 3 / 12, "e": 0})
    for name in [n for n in named if n.startswith("g")]:
        edges, names = named[name]
        assert dict(got[name]) == pytest.approx(brandes(names, edges))


def test_betweenness_over_parts(spark):
    """More nodes than a part and more sources than a block; the state is rows of blocks, not of pairs."""
    random.seed(8)
    names = [f"v{i}" for i in range(1300)]
    edges = sorted({(a, b) for a in names[:1250] for b in random.sample(names[:1250], 4) if a != b})
    named = {"wide": (edges, names), "line": ([(f"w{i}", f"w{i + 1}") for i in range(12)], [])}
    n, e = many(spark, named)
    got = by_repo(btw.betweenness(n, e, batches=2), "path", "score")
    assert dict(got["wide"]) == pytest.approx(brandes(names, edges))
    assert dict(got["line"])["w6"] == pytest.approx(6 * 6 / (12 * 11))
    start = n.filter("repo_id = 'line'").select("repo_id", "path").filter("path = 'w0'")
    some = by_repo(btw.betweenness(n, e, normalize=False, sources=start), "path", "score")
    assert dict(some["line"])["w1"] == 11 and not any(dict(some["wide"]).values())
    ids = spark.range(700).select("id")
    arcs = spark.range(700 * 700).selectExpr("id div 700 AS a", "id % 700 AS b").filter("a <> b")
    blocks = btw._arc_blocks(arcs)
    assert blocks.count() == 4
    assert btw._accumulate(ids, blocks).filter("score <> 0").count() == 0


def test_betweenness_of_held_graphs(spark, monkeypatch):
    """A graph that a task holds takes no rounds; of a larger repository the components are held that fit, and both agree."""
    random.seed(9)
    names = [f"v{i}" for i in range(400)]
    loose = sorted({(a, b) for a in names[:300] for b in random.sample(names[:300], 3) if a != b})
    dense = sorted({(a, b) for a in names[300:] for b in random.sample(names[300:], 60) if a != b})
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c5", "d0"), ("d0", "c7")]
    named = {"two": (loose + dense, names), "chain": (chain, []), **random_graphs(11, count=3)}
    n, e = many(spark, named)
    rounds = []
    monkeypatch.setattr(btw, "_accumulate", lambda *x, f=btw._accumulate: (rounds.append(1), f(*x))[1])
    monkeypatch.setattr(btw, "STEPS", 1 << 14)  # several shares of the sources
    for arcs, ran in ((btw.ARCS, 0), (1000, 1), (0, 1)):
        monkeypatch.setattr(btw, "ARCS", arcs)
        rounds.clear()
        got = by_repo(btw.betweenness(n, e), "path", "score")
        assert len(rounds) == ran
        for name, (edges, some) in named.items():
            assert dict(got[name]) == pytest.approx(brandes(sorted({*some, *sum(edges, ())}), edges))


def power(names, edges, rounds, dangling=True):
    out = {v: [b for a, b in edges if a == v] for v in names}
    n = len(names)
    rank = {v: 1 / n for v in names}
    for _ in range(rounds):
        lost = sum(rank[v] for v in names if not out[v]) if dangling else 0
        new = {v: 0.15 / n + 0.85 * lost / n for v in names}
        for v in names:
            for w in out[v]:
                new[w] += 0.85 * rank[v] / len(out[v])
        rank = new
    return rank


def test_pagerank(spark):
    named = random_graphs(5, count=4)
    nodes, edges = many(spark, named)
    got = by_repo(pr.pagerank_default(nodes, edges), "path", "rank", "score")
    for name, (e, names) in named.items():
        want = power(names, e, 20)
        assert {p: r for p, r, _ in got[name]} == pytest.approx(want)
        assert {s for _, _, s in got[name]} <= set(range(101)) and max(s for _, _, s in got[name]) == 100


def test_weighted_pagerank_stops_per_repository(spark):
    nodes, _ = many(spark, {"pair": ([("a", "b"), ("b", "a")], []), "chain": ([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], [])})
    edges = spark.createDataFrame([("pair", "a", "b", 1.0), ("pair", "b", "a", 5.0), ("chain", "a", "b", 1.0), ("chain", "b", "c", 2.0),
                                   ("chain", "c", "a", 1.0), ("chain", "a", "c", 3.0)], "repo_id string, src string, dst string, weight double")
    got = by_repo(pr.pagerank_weighted(nodes, edges), "path", "score")
    assert dict(got["pair"]) == pytest.approx({"a": 1.0, "b": 1.0})
    rank = {v: 1 / 3 for v in "abc"}
    for _ in range(25):
        new = {"a": 0.05 + 0.85 * rank["c"], "b": 0.05 + 0.85 * rank["a"] / 4, "c": 0.05 + 0.85 * (rank["b"] + rank["a"] * 3 / 4)}
        stop = sum(abs(new[v] - rank[v]) for v in rank) < 1e-6
        rank = new
        if stop:
            break
    assert dict(got["chain"]) == pytest.approx({v: r / max(rank.values()) for v, r in rank.items()})


TREE = [("page", "Nav"), ("page", "utils"), ("Nav", "constants"), ("utils", "helpers")]


def test_files_by_depth(spark):
    nodes, edges = graph(spark, TREE, ["orphan"])
    entry = spark.createDataFrame([("r", "page"), ("r", "absent")], "repo_id string, path string")
    want = {"page": 0, "Nav": 1, "utils": 1, "constants": 2, "helpers": 2}
    assert dict(rows(tr.bfs_depth(edges, nodes, entry), "path", "depth")) == want
    assert set(dict(rows(tr.bfs_depth(edges, nodes, entry, max_depth=1), "path", "depth"))) == {"page", "Nav", "utils"}
    ranked = spark.createDataFrame([("r", 1, "orphan"), ("r", 2, "page")], "repo_id string, position int, path string")
    assert dict(rows(tr.files_by_depth(edges, nodes, entry, max_depth=3, max_nodes=60, fallback=ranked), "path", "depth")) == {**want, "orphan": 4}
    assert dict(rows(tr.files_by_depth(edges, nodes, entry), "path", "depth")) == want
    assert tr.files_by_depth(edges, nodes, entry, max_nodes=2).count() == 2
    none = entry.filter("path = 'x'")
    assert dict(rows(tr.bfs_depth(edges, nodes, none, max_depth=0), "path", "depth")) == {"Nav": 0, "constants": 0, "helpers": 0, "utils": 0}


def test_long_chain_passes_compaction(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)]
    nodes, e = graph(spark, edges)
    entry = spark.createDataFrame([("r", "n000")], "repo_id string, path string")
    assert dict(rows(tr.bfs_depth(e, nodes, entry, max_depth=None), "path", "depth")) == {f"n{i:03}": i for i in range(31)}
    assert dict(rows(bic.biconnected(nodes, e).articulation_points, "path", "fragment_size")) == {
        f"n{i:03}": max(i, 30 - i) for i in range(1, 30)}


def test_blast_radius(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])
    seeds = nodes.filter("path in ('a', 'd')")
    affected = tr.blast_radius(edges, seeds)
    assert rows(affected, "seed", "affected") == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")]
    assert rows(tr.blast_risk(affected, seeds), "seed", "n", "risk") == [("a", 4, "MEDIUM"), ("d", 0, "LOW")]


def test_dead_code(spark):
    nodes, edges = graph(spark, TREE, ["orphan"])
    entry = spark.createDataFrame([("r", "Nav"), ("r", "ghost")], "repo_id string, path string")
    assert rows(tr.reachability(nodes, edges, entry).filter("reachable"), "path") == [("Nav",), ("constants",)]
    assert tr.dead_code_score(nodes, edges, entry).first()["score"] == pytest.approx(50.0)
    assert tr.dead_code_score(nodes, edges, entry.limit(0)).first()["score"] == 0


def test_crash_traversal(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("z", "a"), ("b", "a")])
    crash = spark.createDataFrame([("r", "t", "a")], "repo_id string, trace_id string, path string")
    out = tr.by_trace(crash, tr.site_traversal(crash, edges, gs.fan_in(edges)))
    assert rows(out, "file", "relationship", "distance") == [
        ("a", "crash_site", 0), ("b", "downstream", 1), ("b", "upstream", 1), ("c", "downstream", 2), ("d", "downstream", 3), ("z", "upstream", 1)]
    assert tr.site_traversal(crash, edges, gs.fan_in(edges), max_nodes=2).count() == 2


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.10,), (0.20,)], "s double")
    assert [r[0] for r in df.select(gs.betweenness_severity(df.s)).collect()] == ["low", "medium", "high", "critical"]


def test_change_sets_over_components(spark, monkeypatch):
    rnd = random.Random(11)
    arcs, changes = [], []
    for g in range(6):
        size = 150 if g == 0 else 9  # several blocks of 64 in the first
        arcs += [(f"g{g}", f"n{rnd.randrange(size)}", f"n{rnd.randrange(size)}") for _ in range(int(size * rnd.choice((0.8, 1.3, 2))))]
        changes += [(f"g{g}", pr, f"n{rnd.randrange(size + 3)}") for pr in range(4) for _ in range(rnd.randrange(1, 5))]
    edges = spark.createDataFrame(arcs, "repo_id string, src string, dst string")
    files = spark.createDataFrame(changes + changes[:3], "repo_id string, pr_number long, path string")
    want = set()
    for repo, pr in {c[:2] for c in changes}:
        own = {p for r, n, p in changes if (r, n) == (repo, pr)}
        met, todo = set(own), list(own)
        while todo:
            at = todo.pop()
            new = {a for r, a, b in arcs if r == repo and b == at} - met
            met |= new
            todo += new
        want |= {(repo, pr, p, "modified" if p in own else "blast") for p in met}
    got = tr.pr_blast(edges, gs.union_nodes(edges), files)
    assert rows(got, *got.columns) == sorted(want)
    kind = {w[:3]: w[3] for w in want}
    lines = [(r, n, a, b, "modified" if kind[r, n, a] == kind[r, n, b] == "modified" else "hot")
             for r, n in {w[:2] for w in want} for q, a, b in arcs if q == r and (r, n, b) in kind]
    classes = tr.pr_edge_classes(edges, got)
    assert rows(classes, *classes.columns) == sorted(lines)

    # files that all reach each other are found without a walk
    monkeypatch.setattr(tr, "expand", None)
    ring = spark.createDataFrame([("r", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)], "repo_id string, src string, dst string")
    one = spark.createDataFrame([("r", 1, "n2")], "repo_id string, pr_number long, path string")
    assert rows(tr.pr_blast(ring, gs.union_nodes(ring), one), "path", "class") == [
        (f"n{i}", "modified" if i == 2 else "blast") for i in range(5)]
