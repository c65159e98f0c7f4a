import json
import random

from pyspark.sql import functions as F

from conftest import rows
from repolumen.operators import reporting as rp
from repolumen.session import durable, measured
from repolumen.sources import sinks
from repolumen.streaming import jobs

SUB = "event_id string, user_id string, event string, status string, ts timestamp"


def write(path, name, events):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(e) for e in events))


def sub(i, user, event, ts, status=""):
    return {"event_id": i, "user_id": user, "event": event, "status": status, "ts": ts}


def test_subscription_stream_drops_duplicates_across_runs(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    write(source, "1.json", [sub("a", "u", "subscription.activated", "2024-01-01T00:00:00Z"), sub("a", "u", "subscription.activated", "2024-01-01T00:00:01Z"),
                             sub("b", "v", "subscription.halted", "2024-01-01T00:10:00Z")])

    def run():
        stream = spark.readStream.schema(SUB).json(str(source))
        return jobs.run_to_table(jobs.subscription_updates(stream), table)

    assert rows(run(), "event_id") == [("a",), ("b",)]
    write(source, "2.json", [sub("a", "u", "subscription.cancelled", "2024-01-01T00:05:00Z"), sub("c", "u", "subscription.cancelled", "2024-01-01T00:20:00Z")])
    out = run()
    assert rows(out, "event_id") == [("a",), ("b",), ("c",)]
    assert rows(rp.profile_state(out), "user_id", "plan_tier", "subscription_status") == [("u", "free", "cancelled"), ("v", "free", "halted")]


def test_gate_writes_two_tables_and_repeats_batches(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")

    def event(i, route):
        return {"id": i, "route": route}

    def run():
        tables = jobs.run_gate(spark.readStream.schema("id long, route string").json(str(source)), path)
        return {route: rows(table, "id") for route, table in tables.items()}

    source.mkdir()
    assert run() == {"blocked": [], "review": []}
    write(source, "1.json", [event(1, "blocked"), event(2, "review"), event(2, "review")])
    first = {"blocked": [(1,)], "review": [(2,), (2,)]}
    assert run() == first == run()
    write(source, "2.json", [event(3, "review")])
    both = {"blocked": [(1,)], "review": [(2,), (2,), (3,)]}
    assert run() == both
    # the second batch again, as after a failure before its commit
    again = spark.createDataFrame([(3, "review")], "id long, route string")
    jobs.write_route(again, 1, path)
    assert run() == both


def test_usage_stream_drops_late_rows(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")

    def use(ts):
        return {"user_id": "u", "kind": "repo", "ts": ts}

    write(source, "1.json", [use("2024-01-01T10:00:00Z"), use("2024-01-01T11:00:00Z"), use("2024-01-03T00:00:00Z")])

    def run():
        stream = spark.readStream.schema("user_id string, kind string, ts timestamp").json(str(source))
        return jobs.run_to_table(jobs.usage_counters(stream), table)

    assert [(str(d), n) for d, n in rows(run(), "day", "n")] == [("2024-01-01", 2)]
    write(source, "2.json", [use("2024-01-01T12:00:00Z"), use("2024-01-05T00:00:00Z")])
    assert [(str(d), n) for d, n in rows(run(), "day", "n")] == [("2024-01-01", 2), ("2024-01-03", 1)]


def test_counters_are_complete_at_any_time(spark, tmp_path):
    source = tmp_path / "in"

    def use(ts):
        return {"user_id": "u", "kind": "repo", "ts": ts}

    def run():
        stream = spark.readStream.schema("user_id string, kind string, ts timestamp").json(str(source))
        days = jobs.keep_updates(jobs.usage_counters(stream), str(tmp_path / "days"), ["user_id", "day", "kind"])
        hours = jobs.keep_updates(jobs.hourly_counts(stream), str(tmp_path / "hours"), ["user_id", "hour"])
        return [(str(d), n) for d, n in rows(days, "day", "n")], jobs.sliding_quota(hours, 2)

    write(source, "1.json", [use("2024-01-01T10:00:00Z"), use("2024-01-01T11:00:00Z"), use("2024-01-01T11:30:00Z")])
    days, windows = run()
    assert days == [("2024-01-01", 3)] and windows.count() == 25 and windows.filter("exceeded").count() == 23
    write(source, "2.json", [use("2024-01-01T11:25:00Z"), use("2024-01-03T00:00:00Z")])
    assert run()[0] == [("2024-01-01", 4), ("2024-01-03", 1)]


def test_profile_state_is_upserted(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(SUB).json(str(source))
        return rows(jobs.keep_profile_state(jobs.subscription_updates(stream), state), "user_id", "plan_tier", "event_id")

    write(source, "1.json", [sub("a", "u", "subscription.activated", "2024-01-01T00:00:00Z"), sub("b", "v", "subscription.activated", "2024-01-01T00:10:00Z")])
    assert run() == [("u", "pro", "a"), ("v", "pro", "b")]
    for i, user in ((2, "u"), (3, "w"), (4, "v")):
        write(source, f"{i}.json", [sub(f"c{i}", user, "subscription.cancelled", f"2024-01-01T00:2{i}:00Z")])
        last = run()
    assert last == [("u", "free", "c2"), ("v", "free", "c4"), ("w", "free", "c3")]
    assert len(list((tmp_path / "state").glob("version=*"))) == 2


def test_pr_gate_routes(spark, tmp_path):
    source = tmp_path / "in"
    token = "gh" + "p_" + "a" * 36
    write(source, "1.json", [{"event": "pull_request", "action": "opened", "diff": "+ ok"}, {"event": "pull_request", "action": "synchronize", "diff": token},
                             {"event": "pull_request", "action": "closed", "diff": token}, {"event": "push", "action": "opened", "diff": ""}])
    stream = spark.readStream.schema("event string, action string, diff string").json(str(source))
    out = jobs.run_to_table(jobs.pr_event_gate(stream), str(tmp_path / "out"))
    assert rows(out, "action", "route") == [("opened", "review"), ("synchronize", "blocked")]


def test_append_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "analyses")
    for version in (1, 2):
        data = spark.createDataFrame([(version * 10 + i, "Own", f"R{i}", f"url{i}", "u") for i in range(3)], "id int, owner string, repo string, repo_url string, user_id string")
        sinks.append_analysis(data, path, version)
    table = spark.read.parquet(path)
    assert table.count() == 6 and table.first()["repo_name"].startswith("own/")
    keys = spark.createDataFrame([("url1", "u"), ("gone", "u")], "repo_url string, user_id string")
    remaining, deleted = rp.invalidate_cache(table, keys, ["repo_url", "user_id"])
    assert rows(deleted, "repo_url", "deleted") == [("gone", 0), ("url1", 2)]
    before = {f.name for f in (tmp_path / "analyses" / "analysis_version=2").iterdir()}
    one = spark.createDataFrame([(10,)], "id int")
    rp.rewrite_without(spark, path, one, ["id"])
    assert {f.name for f in (tmp_path / "analyses" / "analysis_version=2").iterdir()} == before  # not written anew
    assert rows(spark.read.parquet(path), "id") == [(11,), (12,), (20,), (21,), (22,)]
    rp.rewrite_without(spark, path, spark.createDataFrame([(11,), (12,), (21,), (99,)], "id int"), ["id"])
    assert rows(spark.read.parquet(path), "id", "analysis_version") == [(20, 2), (22, 2)]  # a whole partition is gone


def test_first_row_of_each_unseen_event(spark):
    e = spark.createDataFrame([("a", "u2", 5), ("a", "u1", 5), ("a", "u9", 7), ("b", "x", 1), ("c", "y", 2)], "event_id string, user_id string, ts int")
    seen = spark.createDataFrame([("c",)], "event_id string")
    assert rows(rp.unseen_events(e, seen), "event_id", "user_id", "ts") == [("a", "u1", 5), ("b", "x", 1)]


def test_sliding_windows_of_any_span(spark):
    rng = random.Random(8)
    for span in (7, 10, 61):
        at = sorted(rng.choice([0, 5, -5]) + rng.randint(0, 40) * span * 1_000_000 // rng.choice([1, 2, 60, 61]) for _ in range(150))
        df = spark.createDataFrame([(i, "k" if i % 5 else "j", t) for i, t in enumerate(at)], "id int, user string, us bigint").withColumn("ts", F.timestamp_micros("us"))
        got = {r["id"]: r["n_in_window"] for r in rp.sliding_window_quota(df, "user", 3, span).collect()}
        for i, t in enumerate(at):
            assert got[i] == sum(bool(j % 5) == bool(i % 5) and t - span * 1_000_000 <= x <= t for j, x in enumerate(at)), (span, i)


def test_cache_of_anonymous_users(spark):
    t = "2024-01-02 00:00:00"
    a = spark.createDataFrame([(1, "u", None, "s1", 2, "2024-01-01 12:00:00"), (2, "v", "x", "s1", 2, "2023-12-01 00:00:00"), (3, "w", "x", "s1", 2, "2024-01-01 12:00:00")],
                              "id int, repo_url string, user_id string, commit_sha string, analysis_version int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    heads = spark.createDataFrame([("u", "s1"), ("w", "s2")], "repo_url string, live_sha string")
    out = rp.cache_status(a, heads, a.select("repo_url", "user_id"), F.lit(t).cast("timestamp"), 2)
    assert rows(out, "repo_url", "hit", "stale") == [("u", True, False), ("v", False, False), ("w", False, True)]


def test_cuts_measure_their_size(spark):
    cut = measured(spark.range(100).withColumn("s", F.lit("abc")))
    assert cut.rows == 100 and cut.bytes > 300
    assert "broadcast" in cut.for_join()._jdf.queryExecution().logical().toString().lower() or cut.for_join().count() == 100
    assert durable(spark.range(3)).count() == 3


def test_result_documents(spark):
    ok = {"owner": "o", "repo": "r", "description": "", "stars": 1, "language": "ts", "totalFiles": 2, "entryPoints": [], "mermaidDiagram": "", "fileMetrics": [],
          "analysis": {"architecture_pattern": "", "what_it_does": "", "execution_flow": [], "tech_stack": [], "key_modules": [], "onboarding_guide": [], "blast_radius": []}}
    bad_grade = json.loads(json.dumps(ok))
    bad_grade["analysis"]["health_status"] = {"grade": "E", "score": 1, "status": "", "refactor_plan": []}
    wrong_type = dict(ok, stars="many")
    docs = [ok, bad_grade, wrong_type, {k: v for k, v in ok.items() if k != "owner"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, result_json string")
    assert rows(rp.analysis_schema_check(df), "id", "valid") == [(0, True), (1, False), (2, False), (3, False)]


def test_a_stream_reads_tables_of_one_file_and_of_parts(spark, tmp_path):
    folder = tmp_path / "data"
    spark.range(0, 5, 1, 3).write.parquet(str(folder / "many.parquet"))
    spark.range(0, 4, 1, 1).write.parquet(str(folder / "other"))
    (folder / "one.parquet").write_bytes(next((folder / "other").glob("part-*.parquet")).read_bytes())
    for name, n in (("many", 5), ("one", 4)):
        stream = jobs.stream_table(spark, str(folder), f"{name}.parquet", "id long")
        assert rows(jobs.run_to_table(stream, str(tmp_path / f"out-{name}")), "id") == [(i,) for i in range(n)]
