import pytest
from pyspark.sql import functions as F

from conftest import rows
from repolumen.operators import cochange, imports as imp, inventory as inv
from repolumen.sources import landed

SKIPPED = [
    "node_modules/lodash/index.js", ".next/server/app/page.js", "dist/index.js", "public/vendor.min.js", "public/app.bundle.js",
    "types/global.d.ts", "lib/schema.generated.ts", "public/main.js.map", "lib/api.mock.ts", "components/Button.fixture.tsx",
    "lib/__mocks__/supabase.ts", "components/Button.stories.tsx",
]
KEPT = ["lib/utils.ts", "components/Button.tsx", "app/api/analyze/route.ts", "lib/utils.test.ts"]


def files(spark, rows_):
    return spark.createDataFrame([("r", p, s) for p, s in rows_], "repo_id string, path string, size bigint")


def test_skip_rules(spark):
    df = files(spark, [(p, 10) for p in SKIPPED + KEPT] + [("lib/big.ts", 100_000), ("lib/small.ts", 1_000)])
    kept = {p for (p,) in rows(inv.filter_files(df, max_bytes=50_000), "path")}
    assert kept == set(KEPT) | {"lib/small.ts"}


def test_roles_and_scores(spark):
    df = inv.classify_and_score(files(spark, [(p, 1) for p in (
        "index.ts", "src/app.ts", "package.json", "src/app.test.ts", "examples/main.js", "a/b/c/d/e.ts", "cmd/main.go")]))
    assert dict((r["path"], (r["score"], r["role"])) for r in df.collect()) == {
        "index.ts": (13, "entry"), "src/app.ts": (12, "entry"), "package.json": (9, "config"), "src/app.test.ts": (-2, "test"),
        "examples/main.js": (5, "other"), "a/b/c/d/e.ts": (-2, "other"), "cmd/main.go": (10, "entry")}


def test_top_files_fills_with_others(spark):
    df = inv.classify_and_score(files(spark, [(f"p{i}/index.ts", 1) for i in range(12)] + [(f"x{i}.ts", 1) for i in range(40)]))
    top = inv.top_files(df, limit=20).collect()
    assert sum(r["role"] == "entry" for r in top) == 8 and len(top) == 20
    assert sorted(r["position"] for r in top) == list(range(1, 21))


def test_repo_type_of_an_empty_repository(spark):
    repos = spark.createDataFrame([("r",), ("none",)], "repo_id string")
    out = {r["repo_id"]: r for r in inv.detect_repo_type(files(spark, [("a.py", 1), ("b.py", 1)]), repos).collect()}
    assert out["none"]["language"] == "unknown" and out["none"]["reason"] == "No files found in repository."
    assert out["r"]["language"] == "python" and not out["r"]["is_graphable"]


@pytest.mark.parametrize("n", [1, 2, 9, 100, 257])
def test_nearest_rank_equals_sorting(spark, n):
    sizes = [(i * 7919) % (n * 300) for i in range(n)] + ([2**40 + n, 0] if n > 50 else [])
    got = inv.nearest_rank(files(spark, [(f"f{i}", s) for i, s in enumerate(sizes)]), ["repo_id"], "size", {"p66": 0.66, "p90": 0.9}).first()
    s = sorted(sizes)
    assert (got["p66"], got["p90"]) == (s[int(len(s) * 0.66)], s[int(len(s) * 0.9)])


def contents(spark, pairs, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in pairs], "repo_id string, path string, content string")


def test_graph_from_sources(spark):
    df = contents(spark, [
        ("tsconfig.json", '{ // c\n "compilerOptions": {"paths": {"@/*": ["./src/*"], "~/*": ["lib/*"]}} }'),
        ("src/a.ts", "import b from './b'\nimport { c } from '@/c'\nexport * from '~/d'\nimport x from 'react'\nimport('./no')"),
        ("src/b/index.tsx", "const a = require('../a'); const z = require('left-pad/x')"),
        ("src/c.js", ""), ("lib/d.mjs", "import k from 'c'"), ("index.html", '<script src="src/a.ts"></script><link rel=s href="http://x/y.css">'),
        ("app/x/page.tsx", ""), ("app/x/layout.tsx", ""), ("app/x/error.ts", ""), ("page.tsx", ""), ("layout.tsx", "")])
    nodes, edges = imp.build_dependency_graph(df, df)
    assert rows(edges, "src", "dst") == [
        ("app/x/page.tsx", "app/x/error.ts"), ("app/x/page.tsx", "app/x/layout.tsx"), ("index.html", "src/a.ts"),
        ("src/a.ts", "lib/d.mjs"), ("src/a.ts", "src/b/index.tsx"), ("src/a.ts", "src/c.js"), ("src/b/index.tsx", "src/a.ts")]
    assert nodes.count() == 11
    sane_nodes, _ = imp.sanitize_graph(nodes, edges)
    assert "tsconfig.json" not in {p for (p,) in rows(sane_nodes, "path")}


def test_coverage_map_takes_one_shuffle(spark):
    paths = ["src/a.ts", "src/a.test.ts", "src/__tests__/a.ts", "src/b.ts", "lib/c.spec.js", "lib/c.js", "gone.test.ts"]
    df = spark.createDataFrame([("r", p) for p in paths] + [("s", "src/b.test.ts"), (None, "x.ts"), (None, "x.test.ts")], "repo_id string, path string")
    covered = imp.test_coverage_map(df)
    assert covered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["repo_id"], r["path"]): (r["is_tested"], r["n_tests"]) for r in covered.collect()}
    assert got == {("r", "src/a.ts"): (True, 2), ("r", "src/b.ts"): (False, 0), ("r", "lib/c.js"): (True, 1), (None, "x.ts"): (False, 0)}


def test_names_are_resolved_once_for_all_files(spark):
    """References are shuffled to make edges distinct, and for nothing else where their names are few."""
    df = contents(spark, [("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}'), ("src/hub.ts", ""), ("hub.ts", "")] + [
        (f"src/x{i}/f.ts", "import a from '../hub'\nimport b from '@/hub'\nexport * from 'src/hub'") for i in range(30)])
    nodes, edges = imp.build_dependency_graph(df, df)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan  # one for the edges, one for the pages
    assert rows(edges, "src", "dst") == sorted((f"src/x{i}/f.ts", "src/hub.ts") for i in range(30)) and nodes.count() == 33


def test_resolution_order_equals_trying_every_candidate(spark):
    import random

    rnd = random.Random(3)
    exts = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".css", ".html"]
    stems = ["a", "a/b", "src/a", "src/a/b", "src/c", "c"]
    pool = [s for s in stems] + [s + e for s in stems for e in exts] + [s + "/index" + e for s in stems for e in exts]
    have = rnd.sample(pool, 40)
    targets = stems + ["src/src/a", "zz", "a/index"] + rnd.sample(pool, 10)

    def brute(t):
        for base in (t, "src/" + t):
            for c in [base] + [base + e for e in exts] + [base + "/index" + e for e in exts]:
                if c in have:
                    return c
        return None

    raw = spark.createDataFrame([("r", "s", t) for t in sorted(set(targets))], "repo_id string, src string, target string")
    inventory = spark.createDataFrame([("r", p) for p in have], "repo_id string, path string")
    got = dict(rows(imp.resolve_to_file(raw, inventory), "target", "dst"))
    assert got == {t: brute(t) for t in set(targets) if brute(t)}


def test_inherited_aliases(spark):
    chain = [("tsconfig.json", '{"extends": "./p1.json", "compilerOptions": {"paths": {"#own": ["own.ts"]}}}')]
    chain += [(f"p{i}.json", f'{{"extends": "./p{i + 1}.json", "compilerOptions": {{"paths": {{"k{i}/*": ["t{i}/*"]}}}}}}') for i in range(1, 6)]
    df = contents(spark, chain + [("next.config.mjs", "")])
    first = {"#own": "own.ts", "k1/": "t1/", "k2/": "t2/", "k3/": "t3/", "@/": "src/"}
    assert dict(rows(imp.build_path_aliases(df, levels=3), "prefix", "target")) == first
    assert dict(rows(imp.build_path_aliases(df), "prefix", "target")) == {**first, "k4/": "t4/", "k5/": "t5/"}
    raw = spark.createDataFrame([("r", "s", 0, s, "es", True, s) for s in ("@/x", "#own", "zz")],
                                "repo_id string, src string, ord int, spec string, kind string, is_alias boolean, target string")
    assert dict(rows(imp.resolve_alias(raw, imp.build_path_aliases(df)), "spec", "target")) == {"@/x": "src/x", "#own": "own.ts", "zz": "zz"}


def test_longest_prefix_wins(spark):
    df = contents(spark, [("jsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/lib/*": ["./l/*"], "e/*": []}}}'), ("tsconfig.json", "not json")])
    aliases = imp.build_path_aliases(df)
    assert dict(rows(aliases, "prefix", "target")) == {"@/": "src/", "@/lib/": "l/"}
    raw = spark.createDataFrame([("r", "s", 0, "@/lib/x", "es", True, "")], "repo_id string, src string, ord int, spec string, kind string, is_alias boolean, target string")
    assert imp.resolve_alias(raw, aliases).first()["target"] == "l/x"


def test_commit_scan(spark):
    big = [("r", "big", f"f{i}", "modified") for i in range(300)]
    small = [("r", "ok", "a", "modified"), ("r", "ok", "b", "renamed"), ("r", "ok", "c", "removed"), ("r", "one", "a", "modified"), ("r", "one", "b", "removed")]
    df = spark.createDataFrame(big + small, "repo_id string, sha string, path string, status string").withColumns(
        {"committed_at": F.lit("2024-01-01").cast("timestamp"), "author": F.lit("x")})
    assert rows(landed.scan_commits(df, max_files=300), "sha", "path") == [("ok", "a"), ("ok", "b")]
    assert landed.scan_commits(df).count() == 302
    # the pairs of a mass commit are made in shares, each once
    pairs = cochange.commit_pairs(landed.scan_commits(df).withColumn("repo_id", F.lit("r")))
    assert pairs.count() == pairs.distinct().count() == 300 * 299 // 2 + 1


def test_repo_urls(spark):
    urls = ["a/b", "a/b.git", "https://h.org/o/r.git", "https://h.org/o/r/tree/x?q=1", "https://h.org/only", "single"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", landed.parse_repo_url(F.col("u")).alias("r"))
    assert {r["u"]: (r["r"]["owner"], r["r"]["repo"]) for r in df.collect()} == {
        "a/b": ("a", "b"), "a/b.git": ("a", "b"), "https://h.org/o/r.git": ("o", "r"), "https://h.org/o/r/tree/x?q=1": ("o", "r"),
        "https://h.org/only": (None, None), "single": (None, None)}


def test_formats_and_broken_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"repo_id":"r","type":"blob","path":"p","size":3}\n{broken\n{"repo_id":"r","type":"tree","path":"d"}\n')
    df = landed.read_landed(spark, str(tmp_path / "a.json"), "repo_id string, type string, path string, size bigint", "json")
    assert sum(r["_corrupt_record"] is not None for r in df.collect()) == 1
    assert rows(landed.scan_file_tree(df), "path", "size") == [("p", 3)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.ts").write_text("a\nb")
    tree = landed.read_source_tree(spark, f"{tmp_path}/src/*", f"{tmp_path}/src", "r")
    assert rows(tree, "path", "content") == [("x.ts", "a\nb")]
