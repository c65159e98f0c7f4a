import random

from pyspark.sql import functions as F

from conftest import rows
from repolumen import fixed
from repolumen.operators import cochange as cc, content as ct, reporting as rp, traces as tc


def contents(spark, text, path="a.ts"):
    return spark.createDataFrame([("r", path, text)], "repo_id string, path string, content string")


def lint(spark, text):
    return rows(ct.lint_code_lines(contents(spark, text)), "type", "function_name", "line", "severity")


def test_lint_rules(spark):
    assert lint(spark, "function f() {\n  return 1;\n  g();\n}") == [("unreachable_code", "f", 3, "error")]
    assert lint(spark, "function f() {\n  const x = 1;\n  return x;\n}") == []
    assert lint(spark, "async function f() {\n  const x = await g();\n  return x;\n}") == [("missing_error_handling", "f", 1, "warning")]
    assert lint(spark, "async function f() {\n  try {\n    await g();\n  } catch (e) {\n    h();\n  }\n}") == []
    assert lint(spark, "function f() {\n  while (true) {\n    if (done) break;\n  }\n}") == [("infinite_loop_candidate", "f", 2, "warning")]
    assert lint(spark, "function f() {\n  for (;;) {\n    return;\n  }\n}") == []
    assert lint(spark, "while (true) {\n}\n") == []
    # the same without semicolons
    assert lint(spark, "function f() {\n  return x\n  g()\n}") == [("unreachable_code", "f", 3, "error")]
    assert lint(spark, "const f = () => {\n  throw new Error('x')\n  g()\n}") == [("unreachable_code", None, 3, "error")]
    assert lint(spark, "function f() {\n  return {\n    a: 1\n  }\n}") == []
    assert lint(spark, "function f() {\n  return a +\n    b\n}") == []
    assert lint(spark, "function f() {\n  while (true) {\n    g()\n") == [("infinite_loop_candidate", "f", 2, "warning")]


def test_lint_top_files_and_summary(spark):
    df = contents(spark, "function f() {\n  return 1;\n  g();\n}").union(contents(spark, "function f() {\n  return 1;\n  g();\n}", "b.css"))
    ranks = spark.createDataFrame([("r", "a.ts", 3)], "repo_id string, path string, score int")
    found = ct.lint_top_files(df, ranks)
    assert rows(ct.findings_summary(found), "line", "text") == [
        (0, "[a.ts]"), (3, "  ERROR L3: Unreachable statement after ReturnStatement at line 2")]


def test_summary_reads_findings_that_are_written_once(spark):
    found = spark.createDataFrame([("r", "a.ts", 3, "error", "x"), ("r", "a.ts", 5, "warning", "y"), ("r", "b.ts", 3, "error", "x")],
                                  "repo_id string, path string, line int, severity string, description string")
    got = ct.findings_summary(found)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "path", "line", "text") == [
        ("a.ts", 0, "[a.ts]"), ("a.ts", 3, "  ERROR L3: x"), ("a.ts", 5, "  WARN L5: y"), ("b.ts", 0, "[b.ts]"), ("b.ts", 3, "  ERROR L3: x")]


def chunks_by_hand(text, limit):
    out, cur = [], ""
    for line in text.split("\n"):
        if len(cur) + len(line) > limit:
            out.append(cur)
            cur = line + "\n"
        else:
            cur += line + "\n"
    return out + ([cur] if cur.strip() else [])


def test_chunks(spark):
    rnd = random.Random(7)
    for _ in range(5):
        text = "\n".join("x" * rnd.choice([0, 3, 10, 25, 60]) for _ in range(rnd.randint(1, 30)))
        got = [c for _, c in rows(ct.chunk_text(contents(spark, text), 40), "chunk_no", "content")]
        assert got == chunks_by_hand(text, 40)


def test_secrets(spark):
    key = "AKI" + "A" + "B" * 16
    texts = {"aws": f"k={key}", "generic": "pass" + "word: '" + "a1" * 12 + "'", "pem": "-----BEGIN EC PRIV" + "ATE KEY-----", "none": "token = short", "null": None}
    df = spark.createDataFrame([("r", 1, n, t) for n, t in texts.items()], "repo_id string, pr_number bigint, path string, patch string")
    got = dict(rows(ct.scan_secrets_pr(df), "path", "alert"))
    names = [n for n, _ in fixed.SECRET_RULES]
    assert got == {p: f"CRITICAL ALERT in {p}: {names[i]}" for i, p in enumerate(("aws", "generic", "pem"))}
    assert ct.scan_secrets_pr(df, max_files=1).count() == 1
    tokens = ["gh" + "p_" + "a" * 36, "gs" + "k_" + "b" * 32, "s" + "k-" + "c" * 40, "xox" + "b-" + "d" * 12, "AI" + "za" + "e" * 35, key]
    diffs = spark.createDataFrame([(f"+ {t} +",) for t in tokens] + [("gh" + "p_short",)], "d string")
    assert [r[0] for r in diffs.select(ct.has_diff_tokens(F.col("d"))).collect()] == [True] * 6 + [False]


def match_by_hand(frame, files):
    if frame in files:
        return frame
    for root in fixed.FRAME_ROOTS:
        at = frame.find(root)
        if at != -1 and frame[at + 1:] in files:
            return frame[at + 1:]
    segs = frame.split("/")
    if len(segs) >= 2:
        hits = sorted(f for f in files if f.endswith("/".join(segs[-2:])))
        if hits:
            return min(hits, key=lambda f: (-sum(s in f.split("/") for s in segs), f))
    if segs[-1]:
        hits = [f for f in files if f.endswith(segs[-1])]
        if len(hits) == 1:
            return hits[0]
    return None


def test_frame_matching(spark):
    files = ["src/a/x.ts", "src/ba/x.ts", "lib/a/x.ts", "app/page.tsx", "only.ts", "deep/my-only2.ts", "index.ts", "q/a/index.ts"]
    frames = ["src/a/x.ts", "/srv/app/page.tsx", "/w/src/a/x.ts", "w/a/x.ts", "w/lib/a/x.ts", "/only.ts", "nly.ts", "zz/only2.ts", "x.ts", "index.ts",
              "/x/index.ts", "dir/", "none/at/all.ts", "a/index.ts"]
    inv = spark.createDataFrame([("r", f) for f in files], "repo_id string, path string")
    fr = spark.createDataFrame([("r", f) for f in frames], "repo_id string, file string")
    got = dict(rows(tc.match_frame_paths(fr, inv), "file", "path"))
    assert got == {f: match_by_hand(f, files) for f in frames if match_by_hand(f, files)}


def test_trace_parsing(spark):
    text = ("Uncaught TypeError: x is not a function\n    at Object.<anonymous> (node_modules/a.js:1:1)\n    at async run (/srv/src/a.ts:10:5)\n"
            "    at /srv/src/b.ts:3:4\n    nothing here\n")
    df = spark.createDataFrame([("t", "r", text), ("u", "r", "")], "trace_id string, repo_id string, trace string")
    assert rows(tc.extract_error_info(df), "trace_id", "error_type", "error_message") == [
        ("t", "TypeError", "x is not a function"), ("u", "UnknownError", "No error message provided")]
    assert rows(tc.parse_frames(df), "frame_no", "file", "line", "col") == [(2, "/srv/src/a.ts", 10, 5), (3, "/srv/src/b.ts", 3, 4)]


def test_line_context(spark):
    df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(1, 31)), 2)], "content string, line int")
    r = tc.line_context(df, 3).first()
    assert (r["start"], r["end"]) == (1, 5)
    assert r["snippet"].split("\n")[1] == ">>>    2 | l2" and r["snippet"].split("\n")[0] == "       1 | l1"


def test_coupling_equals_counting(spark):
    rnd = random.Random(5)
    commits = [sorted(rnd.sample("abcdefg", rnd.randint(2, 5))) for _ in range(60)]
    df = spark.createDataFrame([("r", f"s{i}", p) for i, c in enumerate(commits) for p in c] + [("r", "s0", commits[0][0])], "repo_id string, sha string, path string")
    edges = spark.createDataFrame([("r", "b", "a")], "repo_id string, src string, dst string")
    got = {(r["file_a"], r["file_b"]): (r["co_change_count"], round(r["jaccard"], 9)) for r in cc.implicit_coupling(df, edges).collect()}
    want = {}
    for a in "abcdefg":
        for b in "abcdefg":
            if a < b and (a, b) != ("a", "b"):
                ca, cb = sum(a in c for c in commits), sum(b in c for c in commits)
                co = sum(a in c and b in c for c in commits)
                if co >= 3 and max(co / ca, co / cb) >= 0.1 and co / (ca + cb - co) >= 0.1:
                    want[(a, b) if co / ca >= co / cb else (b, a)] = (co, round(co / (ca + cb - co), 9))
    assert got == want
    assert cc.implicit_coupling(df, edges, max_results=3).count() == 3


def test_sliding_window_equals_counting(spark):
    rnd = random.Random(9)
    times = [rnd.randint(0, 20_000) for _ in range(300)]
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", t) for i, t in enumerate(times)], "id int, k string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["n_in_window"] for r in rp.sliding_window_quota(df, "k", 5, 3600).collect()}
    key = ["hot" if i % 3 else "cold" for i in range(300)]
    assert got == {i: sum(key[j] == key[i] and times[i] - 3600 <= times[j] <= times[i] for j in range(300)) for i in range(300)}


def test_subscription_map(spark):
    cases = [("subscription.activated", "x", ("pro", "active")), ("subscription.updated", "active", ("pro", "active")), ("subscription.updated", "expired", ("free", "expired")),
             ("subscription.updated", "paused", None), ("subscription.cancelled", "active", ("free", "cancelled")), ("subscription.completed", "", ("free", "completed")), ("payment.failed", "", None)]
    df = spark.createDataFrame([(str(i), "u", e, s) for i, (e, s, _) in enumerate(cases)], "event_id string, user_id string, event string, status string")
    got = {r["event_id"]: (r["plan_tier"], r["subscription_status"]) for r in rp.profile_update(df).collect()}
    assert got == {str(i): w for i, (_, _, w) in enumerate(cases) if w}
