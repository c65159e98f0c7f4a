"""Operations reporting and streaming queries."""
from pyspark.sql import functions as F

from .. import fixed
from ..operators import graph_stats as gs, reporting as rp
from ..session import shared_path
from ..sources import sinks
from ..streaming import jobs
from .bindings import ANALYSES, SUB_EVENTS, USAGE
from .registry import query
from .texts import DIFF_SQL, TOKENS, diff_column

AW, UW, SW = ("WITH " + x for x in (ANALYSES, USAGE, SUB_EVENTS))

@query("A11_group_by_repo", AW + """ SELECT repo_url, arg_min(repo_name, (created_at, id)) AS repo_name, arg_max(commit_sha, (created_at, id)) AS latest_commit_sha, max(created_at) AS latest_created_at,
  min(created_at) AS oldest_created_at, count(*) AS analysis_count FROM analyses GROUP BY 1""")
def a11(t):
    return rp.sorted_groups(rp.group_by_repo(t.analyses()), "count-desc")


@query("A12_feedback_rate", "SELECT CAST(floor(count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE) * 100 + 0.5) AS INTEGER) AS success_rate, count(*) AS total_scans FROM labels")
def a12(t):
    return rp.feedback_rate(t.raw("labels").select(F.col("doc_id").alias("debug_id"), (F.col("quality") == 1).alias("is_helpful")))


@query("A13_daily_usage", UW + " SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN kind IN ('repo', 'pr') THEN 'scan' ELSE kind END AS kind, count(*) AS n FROM usage GROUP BY 1, 2, 3")
def a13(t):
    return rp.daily_usage(t.usage()).withColumn("day", F.col("day").cast("string"))


@query("A14_quota_check", UW + """, lim AS (SELECT 'scan' AS kind, 5 AS free, 100 AS pro UNION ALL SELECT 'debug', 3, 999999 UNION ALL SELECT 'ai', 3, 3),
  u AS (SELECT user_id, CASE WHEN kind IN ('repo', 'pr') THEN 'scan' ELSE kind END AS kind, count(*) AS used FROM usage WHERE kind = 'ai' OR ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2),
  x AS (SELECT p.user_id, l.kind, is_admin, CASE WHEN is_admin THEN 0 ELSE coalesce(used, 0) END AS used, CAST(CASE WHEN plan_tier = 'pro' OR (is_admin AND l.kind = 'debug') THEN pro ELSE free END AS BIGINT) AS lim
    FROM profiles p CROSS JOIN lim l LEFT JOIN u ON u.user_id = p.user_id AND u.kind = l.kind)
  SELECT user_id, kind, is_admin OR used < lim AS allowed, used, lim AS "limit", greatest(0, lim - used) AS remaining FROM x""")
def a14(t):
    return rp.quota_check(t.usage(), t.profiles(), F.lit("2024-01-20 15:00:00").cast("timestamp"))


@query("J9_plan_limits", UW + """ SELECT user_id, plan_tier, CASE WHEN plan_tier = 'pro' THEN 100 ELSE 5 END AS scan_limit, count(u.kind) AS used FROM profiles LEFT JOIN usage u USING (user_id) GROUP BY 1, 2""")
def j9(t):
    return rp.plan_limits(t.usage(), t.profiles())


@query("W1_latest_per_key", AW + """ SELECT repo_url, id, commit_sha, analysis_version, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY analysis_version DESC, created_at DESC, id DESC) rn FROM analyses) WHERE rn = 1""")
def w1(t):
    rows = t.analyses().select("repo_url", "id", "commit_sha", "analysis_version", "created_at")
    return rp.latest_per_key(rows, ["repo_url"], ["analysis_version", "created_at", "id"])


CACHE = AW + """, req AS (SELECT DISTINCT repo_url, user_id FROM analyses), heads AS (SELECT DISTINCT repo_url, CASE WHEN length(repo_name) % 2 = 0 THEN 'sha' || (length(repo_name) % 5) END AS live_sha FROM analyses),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, user_id ORDER BY created_at DESC, id DESC) rn FROM analyses WHERE analysis_version = 2 AND created_at >= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 8760 HOUR) WHERE rn = 1)
  SELECT r.repo_url, r.user_id, f.id IS NOT NULL AND NOT coalesce(live_sha <> commit_sha, false) AS hit, f.id IS NOT NULL AND coalesce(live_sha <> commit_sha, false) AS stale,
    commit_sha AS stored_sha, CASE WHEN f.id IS NOT NULL THEN live_sha END AS live_sha, created_at AS cached_at
  FROM req r LEFT JOIN fresh f ON f.repo_url = r.repo_url AND f.user_id IS NOT DISTINCT FROM r.user_id LEFT JOIN heads h ON h.repo_url = r.repo_url"""


@query("W2_cache_status", CACHE)
def w2(t):
    a = t.analyses()
    n = F.length("repo_name")
    heads = a.select("repo_url", F.when(n % 2 == 0, F.concat(F.lit("sha"), n % 5)).alias("live_sha")).distinct()
    return rp.cache_status(a, heads, a.select("repo_url", "user_id").distinct(), F.lit("1998-01-01 00:00:00").cast("timestamp"), version=2, ttl_hours=8760)


@query("W7_history_timeline", AW + """ SELECT 'repo-' || id AS id, 'repo' AS type, repo_name AS title, 'Full Codebase Scan' AS subtitle, created_at FROM analyses
  UNION ALL SELECT 'pr-' || l_orderkey || '-' || l_linenumber, 'pr', 'p' || l_partkey || ' #' || l_linenumber, l_returnflag, l_shipdate FROM lineitem""")
def w7(t):
    prs = t.raw("lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("repo_name"),
        F.col("l_linenumber").alias("pr_number"), F.col("l_returnflag").alias("title"), F.col("l_shipdate").alias("created_at"))
    return rp.history_timeline(t.analyses(), prs)


@query("W7_recent_history", AW + """, x AS (SELECT *, epoch(TIMESTAMP '2001-01-01 00:00:00') - CAST(floor(epoch(created_at)) AS BIGINT) AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) rn FROM analyses))
  SELECT user_id, id, repo_url, repo_name, created_at, CAST(rn AS INTEGER) AS rn, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN CAST(floor(age / 60) AS BIGINT) || 'm ago'
    WHEN age < 86400 THEN CAST(floor(age / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(age / 86400) AS BIGINT) || 'd ago' END AS age FROM x WHERE contains(lower(repo_name), 'org3')""")
def w7b(t):
    return rp.recent_history(t.analyses(), F.lit("2001-01-01 00:00:00").cast("timestamp"), search="ORG3")


SLIDE = "SELECT event_id, user_id, ts, n AS n_in_window, n > {n} AS exceeded FROM (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} PRECEDING AND CURRENT ROW) AS n FROM events)"


@query("W8_sliding_window_quota", SLIDE.format(n=3, s="24 HOUR"))
def w8(t):
    n, span = fixed.RATE_WINDOWS["free"]
    return rp.sliding_window_quota(t.raw("events").select("event_id", "user_id", "ts"), "user_id", n, span)


@query("W8_sliding_window_hour", SLIDE.format(n=30, s="1 HOUR"))
def w8b(t):
    n, span = fixed.RATE_WINDOWS["api_key"]
    return rp.sliding_window_quota(t.raw("events").select("event_id", "user_id", "ts"), "user_id", n, span)


GONE = ", gone AS (SELECT DISTINCT repo_url FROM analyses WHERE repo_name LIKE 'Org1/%')"


@query("U6_invalidate_cache", AW + GONE + " SELECT id, repo_url, user_id FROM analyses ANTI JOIN gone USING (repo_url)")
def u6(t):
    a = t.analyses()
    return rp.invalidate_cache(a, a.filter("repo_name LIKE 'Org1/%'"), ["repo_url"])[0].select("id", "repo_url", "user_id")


@query("U6_rewrite", AW + ", " + GONE[2:] + " SELECT id, repo_url, user_id, analysis_version FROM analyses ANTI JOIN gone USING (repo_url) WHERE analysis_version <> 2")
def u6c(t):
    """A whole partition and some rows of the others are deleted from a table on disk, which is then read back."""
    path = shared_path(t.spark, "analyses")
    t.analyses().write.partitionBy("analysis_version").parquet(path)
    gone = t.spark.read.parquet(path).filter("analysis_version = 2 OR repo_name LIKE 'Org1/%'").select("id")
    rp.rewrite_without(t.spark, path, gone, ["id"])
    return t.spark.read.schema(t.analyses().schema).parquet(path).select("id", "repo_url", "user_id", "analysis_version")


@query("W8_sliding_window_odd_span", SLIDE.format(n=2, s="100003 SECOND"))
def w8c(t):
    return rp.sliding_window_quota(t.raw("events").select("event_id", "user_id", "ts"), "user_id", 2, 100_003)


@query("U6_invalidate_count", AW + """, k AS (SELECT DISTINCT repo_url, user_id FROM analyses WHERE user_id IN ('u1', 'u2') UNION SELECT 'none', 'u1') SELECT repo_url, user_id, count(id) AS deleted FROM k LEFT JOIN analyses USING (repo_url, user_id) GROUP BY 1, 2""")
def u6b(t):
    a = t.analyses()
    keys = a.filter("user_id IN ('u1', 'u2')").select("repo_url", "user_id").union(
        t.raw("region").select(F.lit("none"), F.lit("u1")).distinct())
    return rp.invalidate_cache(a, keys, ["repo_url", "user_id"])[1]


@query("J8_unseen_events", SW + """ SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id, event, status) AS rn FROM sub_events) WHERE rn = 1 AND event_id NOT IN (SELECT 'e' || event_id FROM events WHERE event_type = 'click')""")
def j8(t):
    seen = t.raw("events").filter("event_type = 'click'").select(F.concat(F.lit("e"), "event_id").alias("event_id"))
    return rp.unseen_events(t.sub_events(), seen)


@query("J2_fan_in_with_defaults", "SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j2(t):
    per = t.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return gs.with_defaults(t.raw("customer").select("c_custkey"), per, ["c_custkey"], {"orders": 0, "total": 0.0})


@query("S8_append_analysis", "SELECT id, lower('Owner' || (c % 7) || '/Repo' || (c % 50)) AS repo_name, 3 AS analysis_version FROM (SELECT o_orderkey AS id, o_custkey AS c FROM orders)")
def s8(t):
    c = F.col("o_custkey")
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Owner"), c % 7).alias("owner"), F.concat(F.lit("Repo"), c % 50).alias("repo"))
    path = shared_path(t.spark, "analyses")
    sinks.append_analysis(rows, path, 3)
    return t.spark.read.schema("id bigint, repo_name string, analysis_version int").parquet(path)


REPORT_SQL = """WITH m AS (SELECT r_regionkey, r_name FROM region), n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1),
 h(section, title) AS (VALUES (2, '## Execution Flow'), (3, '## Key Modules'), (4, '## Blast Radius (Critical Files)'), (5, '## Developer Onboarding Guide')),
 i AS (SELECT n_regionkey, unnest(names) AS x, unnest(generate_series(1, len(names))) AS k FROM n)
SELECT 'r' || r_regionkey AS repo_id, 0 AS section, 0 AS ord, '# Report: own/' || r_name AS text FROM m
UNION ALL SELECT 'r' || r_regionkey, 1, 0, '## System Purpose' FROM m UNION ALL SELECT 'r' || r_regionkey, 1, 1, 'Covers ' || r_name FROM m
UNION ALL SELECT 'r' || r_regionkey, section, 0, title FROM m CROSS JOIN h
UNION ALL SELECT 'r' || n_regionkey, 2, CAST(k AS INTEGER), k || '. ' || x FROM i
UNION ALL SELECT 'r' || n_regionkey, 3, CAST(k AS INTEGER), '- **`' || x || '.ts`** (core): why ' || x FROM i
UNION ALL SELECT 'r' || n_regionkey, 4, CAST(k AS INTEGER), '- **`' || x || '.ts`** (' || length(x) || ' dependents): careful' FROM i
UNION ALL SELECT 'r' || n_regionkey, 5, CAST(k AS INTEGER), '- read ' || x FROM i"""


@query("S9_report_export", REPORT_SQL)
def s9(t):
    names = t.raw("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    reports = t.raw("region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.concat(F.lit("r"), "r_regionkey").alias("repo_id"), F.lit("own").alias("owner"), F.col("r_name").alias("repo"),
        F.struct(
            F.concat(F.lit("Covers "), "r_name").alias("what_it_does"), F.col("names").alias("execution_flow"),
            F.transform("names", lambda x: F.struct(F.concat(F.lit("src/"), x, F.lit(".ts")).alias("file"), F.lit("core").alias("role"), F.concat(F.lit("why "), x).alias("why_it_exists"))).alias("key_modules"),
            F.transform("names", lambda x: F.struct(F.concat(F.lit("src/"), x, F.lit(".ts")).alias("file"), F.length(x).cast("double").alias("dependents"), F.lit("careful").alias("warning"))).alias("blast_radius"),
            F.transform("names", lambda x: F.concat(F.lit("read "), x)).alias("onboarding_guide")).alias("analysis"))
    return sinks.report_export(reports)


COLOR = "CASE grade " + " ".join(f"WHEN '{g[1]}' THEN '{g[4]}'" for g in fixed.GRADES) + " ELSE '#64748b' END"


@query("S12_badge_lookup", AW + f""", req AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/' ELSE '' END || 'Org' || (c_custkey % 9) || '/repo' || (c_custkey % 50) || CASE WHEN c_custkey % 2 = 0 THEN '.git' ELSE '' END AS repo FROM customer),
  l AS (SELECT repo_url, arg_max(result_json, (created_at, id)) AS j FROM analyses GROUP BY 1),
  x AS (SELECT repo, json_extract_string(j, '$.healthMetrics.grade') AS grade, json_extract_string(j, '$.healthMetrics.score') AS score, json_extract_string(j, '$.healthMetrics.status') AS status, json_extract(j, '$.healthMetrics') IS NOT NULL AS known
    FROM req LEFT JOIN l ON repo_url = 'https://github.com/' || replace(replace(repo, 'https://github.com/', ''), '.git', ''))
  SELECT repo, CASE WHEN known THEN grade ELSE '-' END AS grade, CASE WHEN known THEN score ELSE '0' END AS score, CASE WHEN known THEN coalesce(nullif(status, ''), 'Analyzed') ELSE 'Unscanned' END AS status,
    CASE WHEN known THEN {COLOR} ELSE '#64748b' END AS color FROM x""")
def s12(t):
    c = F.col("c_custkey")
    repos = t.raw("customer").select(F.concat(
        F.when(c % 3 == 0, "https://github.com/").otherwise(""), F.lit("Org"), c % 9, F.lit("/repo"), c % 50, F.when(c % 2 == 0, ".git").otherwise("")).alias("repo"))
    return sinks.badge_lookup(repos, t.analyses())


DOC_SQL = """'{"owner":"o","repo":"r","description":"","stars":' || (o_orderkey % 9) || ',"language":"ts","totalFiles":3,"entryPoints":["a"],"mermaidDiagram":"",'
  || CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE '"fileMetrics":[{"path":"a","size":1' || CASE WHEN o_orderkey % 5 = 2 THEN '}]' ELSE '},{"path":"b","size":2}]' END || ',' END
  || '"analysis":{"architecture_pattern":"x","what_it_does":"y","execution_flow":[],"tech_stack":[{"name":"n"' || CASE WHEN o_orderkey % 7 = 3 THEN '' ELSE ',"purpose":"p"' END || '}],"key_modules":[],"onboarding_guide":[],"blast_radius":[],'
  || '"health_status":{"grade":"' || substr(o_orderpriority, 1, 1) || '","score":1,"status":"s","refactor_plan":[]}}}'"""


@query("T18_analysis_schema_check", f"""SELECT id, reason IS NULL AS valid, reason FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'not a document of the expected types'
  WHEN o_orderkey % 5 = 1 THEN 'missing fileMetrics' WHEN o_orderkey % 7 = 3 THEN 'incomplete tech_stack' WHEN substr(o_orderpriority, 1, 1) <> '1' THEN 'grade is not one of A, B, C, D, F' END AS reason FROM orders)""")
def t18(t):
    o = F.col("o_orderkey")
    grade = F.translate(F.substring("o_orderpriority", 1, 1), "1", "A")
    doc = F.concat(
        F.lit('{"owner":"o","repo":"r","description":"","stars":'), o % 9, F.lit(',"language":"ts","totalFiles":3,"entryPoints":["a"],"mermaidDiagram":"",'),
        F.when(o % 5 == 1, "").otherwise('"fileMetrics":[{"path":"a","size":1},{"path":"b","size":2}],'),
        F.lit('"analysis":{"architecture_pattern":"x","what_it_does":"y","execution_flow":[],"tech_stack":[{"name":"n"'),
        F.when(o % 7 == 3, "").otherwise(',"purpose":"p"'),
        F.lit('}],"key_modules":[],"onboarding_guide":[],"blast_radius":[],"health_status":{"grade":"'), grade,
        F.lit('","score":1,"status":"s","refactor_plan":[]}}}'))
    return rp.analysis_schema_check(t.raw("orders").select(
        o.alias("id"), F.when(o % 11 == 0, F.concat(F.lit("broken "), o)).otherwise(doc).alias("result_json")))


@query("T20_conversation_assemble", "SELECT conv_id, turn, CASE role WHEN 'ai' THEN 'assistant' ELSE 'user' END AS role, text AS content FROM conversations")
def t20(t):
    return rp.conversation_assemble(t.raw("conversations"))


# --- subscriptions ---------------------------------------------------------------------

UPD = """upd AS (SELECT event_id, user_id, status2 AS subscription_status, CASE WHEN status2 = 'active' THEN 'pro' ELSE 'free' END AS plan_tier, ts FROM (
  SELECT *, CASE WHEN event = 'subscription.activated' THEN 'active' WHEN event = 'subscription.updated' AND status = 'active' THEN 'active'
    WHEN event = 'subscription.updated' AND status IN ('halted','cancelled','expired','completed') THEN status WHEN event = 'subscription.cancelled' THEN 'cancelled' WHEN event = 'subscription.halted' THEN 'halted' END AS status2
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) rn FROM sub_events) WHERE rn = 1)) WHERE status2 IS NOT NULL)"""


@query("ST2_profile_update", SW.replace("status, ts FROM events", "status, ts FROM events") + """, x AS (SELECT *, CASE WHEN event = 'subscription.activated' THEN 'active' WHEN event = 'subscription.updated' AND status IN ('active','expired') THEN status
  WHEN event = 'subscription.cancelled' THEN 'cancelled' WHEN event = 'subscription.halted' THEN 'halted' END AS s FROM sub_events)
  SELECT event_id, user_id, ts, s AS subscription_status, CASE WHEN s = 'active' THEN 'pro' ELSE 'free' END AS plan_tier FROM x WHERE s IS NOT NULL""")
def st2a(t):
    return rp.profile_update(t.sub_events()).select("event_id", "user_id", "ts", "subscription_status", "plan_tier")


@query("ST2_profile_update_simple", """SELECT event_id, 'u' || user_id AS user_id, CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'past_due' END ELSE 'cancelled' END AS subscription_status,
  CASE WHEN event_type = 'signup' OR (event_type = 'purchase' AND event_id % 2 = 0) THEN 'pro' ELSE 'free' END AS plan_tier FROM events WHERE event_type IN ('signup', 'purchase', 'view')""")
def st2b(t):
    e = F.col("event_type")
    rows = t.raw("events").select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.when(e == "signup", "subscription_created").when(e == "purchase", "subscription_updated").when(e == "view", "subscription_cancelled").otherwise("order_created").alias("event"),
        F.when(F.col("event_id") % 2 == 0, "active").otherwise("past_due").alias("status"))
    return rp.profile_update_simple(rows).select("event_id", "user_id", "subscription_status", "plan_tier")


@query("ST3_live_subscription", """WITH s AS (SELECT 'u' || user_id AS user_id, event_id AS subscription_id, CASE event_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'active' WHEN 2 THEN 'halted' WHEN 3 THEN 'pending' WHEN 4 THEN 'cancelled' ELSE 'expired' END AS status, ts AS created_at FROM events)
  SELECT user_id, subscription_id, status, created_at, status = 'created' AND created_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AS is_abandoned FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) rn FROM s WHERE status IN ('created','active','halted','pending')) WHERE rn = 1""")
def st3(t):
    e = F.col("event_id") % 6
    subs = t.raw("events").select(
        F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("event_id").alias("subscription_id"),
        F.when(e == 0, "created").when(e == 1, "active").when(e == 2, "halted").when(e == 3, "pending").when(e == 4, "cancelled").otherwise("expired").alias("status"),
        F.col("ts").alias("created_at"))
    return rp.live_subscription(subs, F.lit("2024-01-31 00:00:00").cast("timestamp"))


# --- streams over the event and document files -------------------------------------------

def stream(t, name):
    """The file as a stream; event time must be a zoned timestamp."""
    rows = jobs.stream_table(t.spark, t.folder, f"{name}.parquet", t.raw(name).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("ST1_pr_event_gate", f"""SELECT doc_id, CASE WHEN {TOKENS} THEN 'blocked' ELSE 'review' END AS route FROM (SELECT doc_id, {DIFF_SQL} AS d FROM documents WHERE doc_id % 4 IN (0, 1, 3) AND doc_id % 7 <> 0)""")
def st1(t):
    return jobs.run_to_table(jobs.pr_event_gate(gate_events(t)).select("doc_id", "route"), shared_path(t.spark, "pr-gate"))


def gate_events(t):
    d = F.col("doc_id")
    return stream(t, "documents").select(
        "doc_id", F.when(d % 7 == 0, "push").otherwise("pull_request").alias("event"),
        F.when(d % 4 == 0, "opened").when(d % 4 == 2, "closed").otherwise("synchronize").alias("action"), diff_column().alias("diff"))


@query("ST1_gate_tables", f"""SELECT doc_id, CASE WHEN {TOKENS} THEN 'blocked' ELSE 'review' END AS sink FROM (SELECT doc_id, {DIFF_SQL} AS d FROM documents WHERE doc_id % 4 IN (0, 1, 3) AND doc_id % 7 <> 0)""")
def st1_tables(t):
    tables = jobs.run_gate(jobs.pr_event_gate(gate_events(t)).select("doc_id", "route"), shared_path(t.spark, "pr-gate"))
    blocked, review = [tables[r].withColumn("sink", F.lit(r)) for r in jobs.GATE_ROUTES]
    return blocked.unionByName(review)


def sub_stream(t):
    e, k = F.col("event_id"), F.col("event_type")
    event = (F.when(k == "signup", "subscription.activated").when(k == "purchase", "subscription.updated")
             .when(k == "error", "subscription.halted").when(k == "view", "subscription.cancelled").otherwise("payment.failed"))
    return stream(t, "events").select(
        F.concat(F.lit("e"), F.when(e % 10 == 9, e - 1).otherwise(e)).alias("event_id"), F.concat(F.lit("u"), "user_id").alias("user_id"),
        event.alias("event"), F.when(e % 3 == 0, "active").when(e % 3 == 1, "expired").otherwise("paused").alias("status"), "ts")


@query("ST2_subscription_state", f"{SW}, {UPD} SELECT user_id, plan_tier, subscription_status, ts AS changed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM upd) WHERE rn = 1")
def st2(t):
    state = jobs.keep_profile_state(jobs.subscription_updates(sub_stream(t)), shared_path(t.spark, "subscriptions"))
    return state.select("user_id", "plan_tier", "subscription_status", F.col("ts").cast("timestamp_ntz").alias("changed_at"))


@query("ST4_sliding_quota_stream", """WITH w AS (SELECT user_id, to_timestamp(3600 * unnest(generate_series(CAST(floor(epoch(ts) / 3600) AS BIGINT) - 23, CAST(floor(epoch(ts) / 3600) AS BIGINT))))::TIMESTAMP AS window_start FROM events)
  SELECT user_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS n_in_window, count(*) > 3 AS exceeded FROM w GROUP BY 1, 2""")
def st4(t):
    hours = jobs.keep_updates(jobs.hourly_counts(stream(t, "events").select("user_id", "ts")), shared_path(t.spark, "hours"), ["user_id", "hour"])
    return jobs.sliding_quota(hours, 3).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("ST5_usage_counters_stream", UW + f", x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN kind IN ('repo', 'pr') THEN 'scan' ELSE kind END AS kind, count(*) AS n FROM usage GROUP BY 1, 2, 3) SELECT user_id, day, kind, n FROM x")
def st5(t):
    k = F.col("event_type")
    kind = F.when(k == "purchase", "repo").when(k == "click", "pr").when(k == "error", "debug").when(k == "signup", "ai")
    usage = stream(t, "events").select(F.concat(F.lit("u"), "user_id").alias("user_id"), kind.alias("kind"), "ts").filter(F.col("kind").isNotNull())
    return jobs.keep_updates(jobs.usage_counters(usage), shared_path(t.spark, "usage"), ["user_id", "day", "kind"]).withColumn("day", F.col("day").cast("string"))
