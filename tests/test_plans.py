from pyspark.sql import functions as F

from conftest import graph, rows
from repolumen.operators import traces as tc, traversal as tr
from repolumen.plans import diagnosis, pull_request, repository
from repolumen.sources import sinks

SOURCES = [
    ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'),
    ("src/index.ts", "import a from './a'\nimport b from '@/b'"), ("src/a.ts", "import b from './b'"), ("src/b.ts", "export const b = 1\n// note\nthrow 1"),
    ("src/lonely.ts", ""), ("node_modules/x/index.js", "import '../../src/a'"), ("README.md", "text"),
]


def sources(spark):
    contents = spark.createDataFrame([("r", p, c) for p, c in SOURCES], "repo_id string, path string, content string")
    return contents.select("repo_id", "path", F.length("content").cast("bigint").alias("size")), contents


def test_repository_report(spark):
    files, contents = sources(spark)
    g = repository.repository_graph(files, contents)
    assert rows(g.edges, "src", "dst") == [("src/a.ts", "src/b.ts"), ("src/index.ts", "src/a.ts"), ("src/index.ts", "src/b.ts")]
    assert rows(g.entries, "path") == [("src/index.ts",)]
    report = repository.architecture_report(g.files, g.nodes, g.edges, g.entries)
    assert rows(report, "path", "afferent", "efferent", "entry_depth", "reachable", "grade") == [
        ("src/a.ts", 1, 1, 1, True, "A"), ("src/b.ts", 2, 0, 1, True, "A"), ("src/index.ts", 0, 2, 0, True, "A"), ("src/lonely.ts", 0, 0, None, False, "A")]


def test_diagram_lines(spark):
    nodes, edges = graph(spark, [("main.ts", f"d/x{i}.ts") for i in range(7)] + [("d/x0.ts", "d/y.ts"), ("d/x6.ts", "d/z.ts")])
    entry = spark.createDataFrame([("r", "main.ts")], "repo_id string, path string")
    want = ["graph TD", "subgraph Entry", '  main_ts["main.ts"]', "end"] + [f"  main_ts --> d_x{i}_ts" for i in range(5)] + ["  d_x0_ts --> d_y_ts"]
    for entries in (entry, entry.filter("false")):  # without entries the file that looks like one is taken
        made = sinks.edge_list_export(edges, nodes, entries, max_nodes=30, max_deps=5)
        assert [r["line"] for r in made.orderBy("repo_id", "part", "depth", "node", "dep").collect()] == want
    few = sinks.edge_list_export(edges, nodes, entry, max_nodes=1, max_deps=5)
    assert few.filter("line like '%-->%'").count() == 5
    assert sinks.edge_list_export(edges, nodes, entry).filter("part = 4").count() == 9


def test_diagnosis(spark):
    files, contents = sources(spark)
    g = repository.repository_graph(files, contents)
    text = "TypeError: timeout\n    at f (node_modules/x/i.js:1:1)\n    at g (/srv/src/b.ts:3:1)"
    traces = spark.createDataFrame([("t1", "r", text), ("t2", "r", text), ("t3", "r", "odd")], "trace_id string, repo_id string, trace string")
    context, summary = diagnosis.diagnose(traces, g.files, g.edges)
    got = {r["trace_id"]: (r["error_type"], r["path"], r["line"], r["confidence"], r["needs_runtime_check"]) for r in summary.collect()}
    assert got["t1"] == got["t2"] == ("TypeError", "src/b.ts", 3, "medium", True)
    assert got["t3"] == ("UnknownError", None, None, "low", False)
    # both are one import upstream (+2): a.ts 2·(1 + ln 2) + 2 = 5.39, index.ts 2·1 + 2 + 1 = 5
    assert [r["file"] for r in context.filter("trace_id = 't1'").orderBy("rn").collect()] == ["src/b.ts", "src/a.ts", "src/index.ts"]
    snippets = {(r["trace_id"], r["path"]): r["snippet"] for r in diagnosis.context_snippets(context, contents, summary).collect()}
    assert snippets["t1", "src/b.ts"].split("\n")[2] == ">>>    3 | throw 1"
    assert snippets["t2", "src/a.ts"] == "import b from './b'"
    # texts are met last and by file alone: no row is shuffled with one
    plan = diagnosis.context_snippets(context, contents)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert "BroadcastHashJoin" in joins[0] and "path" in joins[0] and "trace_id" not in joins[0] and "Union" not in plan.split(joins[0])[0]
    assert {(r["trace_id"], r["path"]): r["snippet"] for r in diagnosis.context_snippets(context.drop("line"), contents, summary).collect()} == snippets


def test_snippets_of_a_file_share_a_range(spark):
    """Columnar files store a text that repeats once if few others are beside it; in the order of traces all are."""
    context = spark.range(0, 400, 1, 2).selectExpr(
        "'r' AS repo_id", "concat('t', id) AS trace_id", "concat('f', id % 5, '.ts') AS file", "'upstream' AS relationship", "1 AS distance",
        "IF(id % 5 = 0, 1, NULL) AS line")
    contents = spark.createDataFrame([("r", f"f{i}.ts", f"x{i}\n\ny{i}") for i in range(4)], "repo_id string, path string, content string")
    made = diagnosis.context_snippets(context, contents).withColumn("part", F.spark_partition_id()).collect()
    assert len(made) == 400 and len({r["part"] for r in made}) > 1
    assert len({(r["part"], r["path"]) for r in made}) <= 5 + len({r["part"] for r in made}) - 1
    assert {(r["path"], r["snippet"]) for r in made} == {
        ("f0.ts", ">>>    1 | x0\n       2 | \n       3 | y0"), *((f"f{i}.ts", f"x{i}\ny{i}") for i in (1, 2, 3)), ("f4.ts", "")}


def test_frames_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    frames = spark.createDataFrame([(f"t{i}", "r", i % 2, f"src/f{i % 3}.ts", 1, 2, None) for i in range(30)],
                                   "trace_id string, repo_id string, frame_no int, file string, line int, col int, func string")
    frames = frames.withColumn("file", F.udf(count)("file"))
    files = spark.createDataFrame([("r", f"src/f{i}.ts") for i in range(2)], "repo_id string, path string")
    assert tc.locate_crash(frames, files).count() == 20
    assert seen.value == 30


def test_pull_request_impact(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "a"), ("d", "c"), ("e", "d"), ("f", "e")])
    secret = "pass" + "word = '" + "x" * 24 + "'"
    prs = spark.createDataFrame([("r", 1, "b", "modified", "+ ok"), ("r", 2, "f", "modified", secret)],
                                "repo_id string, pr_number bigint, path string, status string, patch string")
    summary, classes = pull_request.pr_impact(prs, nodes, edges)
    assert rows(summary, "pr_number", "modified", "blast", "risk_level", "alerts") == [(1, 1, 5, "medium", 0), (2, 1, 0, "high", 1)]
    assert rows(tr.pr_edge_classes(edges, classes).filter("pr_number = 1"), "src", "class")[0] == ("a", "hot")
    assert tr.pr_unaffected_counts(nodes, classes).filter("pr_number = 2").first()["unaffected"] == 5
    start = spark.createDataFrame([("r", "a")], "repo_id string, path string")
    near, walked = tr.node_blast(edges, start)
    assert rows(near, "node") == [("a",), ("c",), ("d",), ("e",), ("f",)] and rows(walked, "src", "dst")[0] == ("c", "a")
    commits = spark.createDataFrame([("r", f"s{i}", "b", "ann" if i % 3 else "bob", i) for i in range(12)], "repo_id string, sha string, path string, author string, t int").withColumn(
        "committed_at", F.timestamp_seconds("t"))
    assert rows(pull_request.reviewers(prs, commits), "path", "label") == [
        ("b", "ann (7 recent commits)"), ("b", "bob (3 recent commits)"), ("f", "Unknown/New File")]


def test_module_texts_are_written_after_the_shuffle(spark, tmp_path):
    from repolumen.catalog.bindings import Tables

    lines = [(1, 1, 7, 3, 5.0), (1, 1, 7, 3, 4.0), (1, 0, 8, 2, 1.0), (22, 2, 7, 4, 2.0), (5, 3, 8, 9, 3.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (5,), (22,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7,), (8,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    modules = Tables(spark, str(tmp_path))._module_sources()
    got = {r["path"]: r["content"] for r in modules.collect()}
    # lines in order of number; equal keys by text
    assert got["src/orders/o1.ts"] == "\n".join([
        "import a from '../sup/s8';\nasync function g2(x) {\n  const v = await load(x);\n  return v;\n}",
        "import { b, c } from '@/sup/s7';\n// line 3\nconst k3 = (x) => {\n  if (x) {\n    return x;\n  }\n  return 0;\n};",
        "import { b, c } from '@/sup/s7';\nfunction f3(x) {\n  return x;\n  log(x);\n}"])
    assert got["public/o22.html"] == '<script src="src/sup/s7.ts"></script>\n<link rel="x" href="http://x/s7.css">'
    assert got["src/app/o5/page.tsx"].startswith("export * from 'sup/s8';\nfunction w9() {")
    # below the first exchange of the lines there are numbers only
    plan = modules._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].split("Union")[0]
    assert "await load" not in below.split("Relation")[0]
