"""Text, secret-scan, code-check and crash-triage queries."""
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import any_literal, any_pattern
from ..operators import content as ct, graph_stats as gs, traces as tc, traversal as tr
from ..plans import diagnosis, pull_request
from .bindings import DOC_FILES, MODULES, PR_FILES, PRS, SUCCESSOR, TRACES
from .imports import GRAPH, module_graph
from .registry import q, query

DW, MW, TW, PW = ("WITH RECURSIVE " + x for x in (DOC_FILES, MODULES, TRACES, PR_FILES))
TRIM = "regexp_replace({}, '^\\s+|\\s+\\z', '', 'g')"
LINE1 = TRIM.format("split_part(trace, chr(10), 1)")
ERR = q(fixed.ERROR_LINE)
INFO = f"""info AS (SELECT trace_id, repo_id, CASE WHEN regexp_extract(l, {ERR}, 1) <> '' THEN regexp_extract(l, {ERR}, 1) ELSE 'UnknownError' END AS error_type,
  CASE WHEN regexp_extract(l, {ERR}, 1) <> '' THEN regexp_extract(l, {ERR}, 2) WHEN l <> '' THEN l ELSE 'No error message provided' END AS error_message
  FROM (SELECT trace_id, repo_id, {LINE1} AS l FROM traces))"""


@query("T1_extract_error_info", f"{TW}, {INFO} SELECT * FROM info")
def t1(t):
    return tc.extract_error_info(t.traces())


FR = q(fixed.FRAME)
FRAMES = f"""frames AS (SELECT * FROM (SELECT trace_id, repo_id, frame_no, regexp_extract(x, {FR}, 2) AS file, CAST(regexp_extract(x, {FR}, 3) AS INTEGER) AS line,
    CAST(regexp_extract(x, {FR}, 4) AS INTEGER) AS col, nullif({TRIM.format(f'regexp_extract(x, {FR}, 1)')}, '') AS func
  FROM (SELECT trace_id, repo_id, unnest(ls) AS x, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS frame_no FROM (SELECT *, string_split(trace, chr(10)) AS ls FROM traces))
  WHERE contains(x, 'at ') AND regexp_matches(x, {FR})) WHERE NOT regexp_matches(file, {q(any_literal(fixed.FRAME_NOISE))}))"""


@query("T2_parse_frames", f"{TW}, {FRAMES} SELECT * FROM frames")
def t2(t):
    return tc.parse_frames(t.traces())


ROOTS = " UNION ALL ".join(
    f"SELECT repo_id, file, 2 AS stage, {i} AS pos, substr(file, instr(file, '{r}') + 1) AS path FROM fp WHERE instr(file, '{r}') > 0" for i, r in enumerate(fixed.FRAME_ROOTS))
LOCATE = f"""fp AS (SELECT DISTINCT repo_id, file FROM frames), inv AS (SELECT DISTINCT repo_id, path FROM modules),
s12 AS (SELECT repo_id, file, arg_min(path, stage * 100 + pos) AS path, min(stage) AS stage FROM (SELECT repo_id, file, 1 AS stage, 0 AS pos, file AS path FROM fp UNION ALL {ROOTS}) JOIN inv USING (repo_id, path) GROUP BY 1, 2),
r3 AS (SELECT repo_id, file, array_to_string(list_slice(string_split(file, '/'), -2, -1), '/') AS tail FROM fp ANTI JOIN s12 USING (repo_id, file) WHERE contains(file, '/')),
s3 AS (SELECT repo_id, file, arg_min(path, (-score, path)) AS path, 3 AS stage FROM (SELECT r3.repo_id, file, path, len(list_filter(string_split(file, '/'), lambda s: list_contains(string_split(path, '/'), s))) AS score
  FROM r3 JOIN inv ON inv.repo_id = r3.repo_id AND ends_with(path, tail)) GROUP BY 1, 2),
r4 AS (SELECT repo_id, file, split_part(file, '/', -1) AS tail FROM fp ANTI JOIN s12 USING (repo_id, file) ANTI JOIN s3 USING (repo_id, file)),
s4 AS (SELECT r4.repo_id, file, min(path) AS path, 4 AS stage FROM r4 JOIN inv ON inv.repo_id = r4.repo_id AND ends_with(path, tail) WHERE tail <> '' GROUP BY 1, 2 HAVING count(*) = 1),
matched AS (SELECT * FROM s12 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"""
CRASH = f"""located AS (SELECT trace_id, repo_id, path, line, col, func, stage FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, repo_id ORDER BY frame_no) rn FROM frames JOIN matched USING (repo_id, file)) WHERE rn = 1)"""
LW = "WITH RECURSIVE " + MODULES + ", " + ", ".join([TRACES, FRAMES, LOCATE, CRASH])


@query("J6_match_frame_paths", LW + " SELECT * FROM matched")
def j6(t):
    return tc.match_frame_paths(tc.parse_frames(t.traces()), t.modules())


@query("T3_locate_crash", LW + " SELECT * FROM located")
def t3(t):
    return tc.locate_crash(tc.parse_frames(t.traces()), t.modules())


# files around the distinct crash sites, three steps both ways
WALK = """sfan AS MATERIALIZED (SELECT repo_id, dst AS file, count(*) AS fan_in FROM edges GROUP BY 1, 2), sites AS MATERIALIZED (SELECT DISTINCT repo_id, path AS site FROM located), ed AS MATERIALIZED (SELECT * FROM edges),
down(repo_id, site, file, distance) AS (SELECT repo_id, site, site, 0 FROM sites UNION SELECT d.repo_id, site, e.dst, distance + 1 FROM down d JOIN ed e ON e.repo_id = d.repo_id AND e.src = d.file WHERE distance < 3),
up(repo_id, site, file, distance) AS (SELECT repo_id, site, site, 0 FROM sites UNION SELECT d.repo_id, site, e.src, distance + 1 FROM up d JOIN ed e ON e.repo_id = d.repo_id AND e.dst = d.file WHERE distance < 3),
around AS (SELECT repo_id, site, file, distance, coalesce(fan_in, 0) AS fan_in, relationship, CASE WHEN relationship = 'crash_site' THEN 1000.0::DOUBLE ELSE (3 - distance) * (1.0::DOUBLE + ln(coalesce(fan_in, 0) + 1.0::DOUBLE)) END AS relevance_score
  FROM (SELECT repo_id, site, site AS file, 0 AS distance, 'crash_site' AS relationship FROM sites
    UNION ALL SELECT * FROM (SELECT repo_id, site, file, min(distance) AS distance, 'downstream' FROM down GROUP BY 1, 2, 3) WHERE distance > 0
    UNION ALL SELECT * FROM (SELECT repo_id, site, file, min(distance) AS distance, 'upstream' FROM up GROUP BY 1, 2, 3) WHERE distance > 0) LEFT JOIN sfan USING (repo_id, file)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repo_id, site ORDER BY round(relevance_score, 9) DESC, distance, relationship, file) rn FROM around),
best AS MATERIALIZED (SELECT l.repo_id, l.trace_id, a.* EXCLUDE (repo_id, site) FROM ranked a JOIN located l ON l.repo_id = a.repo_id AND l.path = a.site WHERE rn <= 10)"""
GW = GRAPH + ", " + ", ".join([TRACES, FRAMES, LOCATE, CRASH, WALK])


def around(t):
    edges = module_graph(t)[1]
    crashes = tc.locate_crash(tc.parse_frames(t.traces()), t.modules())
    return crashes, tr.site_traversal(crashes, edges, gs.fan_in(edges))


@query("G9_crash_traversal", GW + " SELECT * REPLACE (round(relevance_score, 6) AS relevance_score) FROM around")
def g9(t):
    return around(t)[1].withColumn("relevance_score", F.round("relevance_score", 6))


BONUS = """scored AS (SELECT b.* EXCLUDE (relevance_score), error_type, relevance_score
  + CASE WHEN relationship = 'upstream' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(file, '(?i)config|setup|init|bootstrap|env') THEN 1.5 ELSE 0 END
  + CASE WHEN contains(file, 'index.') OR contains(file, 'main.') THEN 1 ELSE 0 END
  + CASE WHEN error_type IN ('TypeError', 'ReferenceError') AND (contains(file, 'api/') OR contains(file, 'service') OR contains(file, 'db') OR contains(file, 'database')) THEN 1.5 ELSE 0 END
  + CASE WHEN contains(lower(error_type), 'auth') AND (contains(file, 'auth') OR contains(file, 'login') OR contains(file, 'session')) THEN 2 ELSE 0 END
  + CASE WHEN contains(file, 'middleware') OR contains(file, 'route') OR contains(file, 'handler') THEN 1 ELSE 0 END AS relevance_score FROM best b JOIN info USING (repo_id, trace_id))"""
HW = f"{GW}, {INFO}, {BONUS}"


@query("T4_debug_heuristics", f"{GW}, {INFO}, pairs AS (SELECT a.*, error_type FROM around a JOIN (SELECT DISTINCT repo_id, path AS site, error_type FROM located JOIN info USING (repo_id, trace_id)) USING (repo_id, site)), "
       + BONUS.replace(" JOIN info USING (repo_id, trace_id)", "").replace("EXCLUDE (relevance_score), error_type,", "EXCLUDE (relevance_score),").replace("FROM best b", "FROM pairs b")
       + " SELECT repo_id, site, error_type, file, relationship, round(relevance_score, 6) AS relevance_score FROM scored")
def t4(t):
    crashes, near = around(t)
    kinds = crashes.join(tc.extract_error_info(t.traces()), ["repo_id", "trace_id"]).select(
        "repo_id", F.col("path").alias("site"), "error_type").distinct()
    return tc.debug_heuristics(near.join(kinds, ["repo_id", "site"])).select(
        "repo_id", "site", "error_type", "file", "relationship", F.round("relevance_score", 6).alias("relevance_score"))


CONF = """conf AS (SELECT l.repo_id, trace_id, confidence FROM located l JOIN (SELECT repo_id, site, CASE WHEN n <= 1 THEN 'low' WHEN CAST(up AS DOUBLE) / n >= 0.3 AND CAST(busy AS DOUBLE) / n >= 0.2 THEN 'high' WHEN up >= 1 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT repo_id, site, count(*) AS n, count(*) FILTER (WHERE relationship = 'upstream') AS up, count(*) FILTER (WHERE fan_in > 5) AS busy FROM around GROUP BY 1, 2)) c ON c.repo_id = l.repo_id AND c.site = l.path)"""


@query("T5_confidence", f"{GW}, {CONF} SELECT * FROM conf")
def t5(t):
    crashes, near = around(t)
    return tr.by_trace(crashes, tc.confidence(near))


RUNTIME = f"regexp_matches(error_type || ' ' || error_message, {q('(?i)' + any_pattern(fixed.RUNTIME_WORDS_ANY_CASE))}) OR regexp_matches(error_type || ' ' || error_message, {q(any_literal(fixed.RUNTIME_WORDS))})"


@query("T6_requires_runtime_check", f"{TW}, {INFO} SELECT trace_id, {RUNTIME} AS needs_runtime_check FROM info")
def t6(t):
    return tc.extract_error_info(t.traces()).select(
        "trace_id", tc.requires_runtime_check(F.col("error_type"), F.col("error_message")).alias("needs_runtime_check"))


BUDGET = """budget AS (SELECT repo_id, trace_id, file, relationship, CAST(rn AS INTEGER) AS rn, round(relevance_score, 6) AS relevance_score FROM scored WHERE rn <= CASE error_type WHEN 'TypeError' THEN 5 WHEN 'ReferenceError' THEN 5 WHEN 'SyntaxError' THEN 3 WHEN 'RangeError' THEN 4 ELSE 10 END)"""


@query("T7_context_budget", f"{HW}, {BUDGET} SELECT * FROM budget")
def t7(t):
    crashes, near = around(t)
    return tc.context_budget(near, crashes, tc.extract_error_info(t.traces())).select(
        "repo_id", "trace_id", "file", "relationship", "rn", F.round("relevance_score", 6).alias("relevance_score"))


SNIP = """array_to_string(list_transform(list_slice(ls, s0 + 1, greatest(e, 0)), lambda x, i: CASE WHEN s0 + i = line THEN '>>> ' ELSE '    ' END
  || CASE WHEN length(CAST(s0 + i AS VARCHAR)) >= 4 THEN CAST(s0 + i AS VARCHAR) ELSE lpad(CAST(s0 + i AS VARCHAR), 4, ' ') END || ' | ' || x), chr(10))"""


@query("T8_line_context", f"""SELECT doc_id, line, CAST(s0 + 1 AS INTEGER) AS start, CAST(e AS INTEGER) AS end, CASE WHEN e > s0 THEN {SNIP} ELSE '' END AS snippet FROM (
  SELECT doc_id, line, ls, greatest(0, line - 10) AS s0, least(len(ls), line + 10) AS e FROM (SELECT doc_id, CAST(doc_id % 40 + 1 AS INTEGER) AS line, string_split(text, chr(10)) AS ls FROM documents))""")
def t8(t):
    rows = t.raw("documents").select("doc_id", (F.col("doc_id") % 40 + 1).cast("int").alias("line"), F.col("text").alias("content"))
    return tc.line_context(rows).select("doc_id", "line", "start", "end", "snippet")


@query("T9_strip_comment_lines", MW + f""" SELECT repo_id, path, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: {TRIM.format('l')}),
  lambda l: l <> '' AND NOT starts_with(l, '//') AND NOT starts_with(l, '/*') AND NOT starts_with(l, '*')), chr(10)) AS stripped FROM modules""")
def t9(t):
    return t.modules().select("repo_id", "path", ct.strip_comment_lines(F.col("content")).alias("stripped"))


@query("T10_compact_source", DW + f""" SELECT repo_id, path, '=== ' || path || ' ===' || chr(10) || {TRIM.format("regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n\\r]*', '', 'g'), '\\s+', ' ', 'g')")} AS context FROM file_contents""")
def t10(t):
    return ct.compact_source(t.file_contents())


@query("T11_chunk_text", """WITH RECURSIVE ls AS MATERIALIZED (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
walk(doc_id, i, n, size, chunk) AS (SELECT doc_id, 0, len(string_split(text, chr(10))), CAST(0 AS BIGINT), CAST(0 AS INTEGER) FROM documents
  UNION ALL SELECT w.doc_id, w.i + 1, w.n, CASE WHEN w.size + length(l.line) > 1000 THEN length(l.line) + 1 ELSE w.size + length(l.line) + 1 END,
    CASE WHEN w.size + length(l.line) > 1000 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN ls l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
body AS (SELECT w.doc_id, chunk, string_agg(line || chr(10), '' ORDER BY w.i) AS content FROM walk w JOIN ls l USING (doc_id, i) GROUP BY 1, 2),
allc AS (SELECT doc_id, unnest(generate_series(0, m)) AS chunk, m FROM (SELECT doc_id, max(chunk) AS m FROM walk GROUP BY 1))
SELECT a.doc_id, CAST(a.chunk AS INTEGER) AS chunk_no, coalesce(content, '') AS content FROM allc a LEFT JOIN body b USING (doc_id, chunk) WHERE a.chunk < a.m OR regexp_matches(coalesce(content, ''), '\\S')""")
def t11(t):
    docs = t.raw("documents").select("lang", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")).withColumnRenamed("lang", "repo_id")
    return ct.chunk_text(docs).select(F.col("path").cast("bigint").alias("doc_id"), "chunk_no", "content")


RULES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(p, {q(r)}) THEN {q(n)} END" for n, r in fixed.SECRET_RULES) + "], lambda x: x IS NOT NULL)"
ALERTS = f"""alerts AS (SELECT repo_id, pr_number, path, 'CRITICAL ALERT in ' || path || ': ' || array_to_string(f, ', ') AS alert FROM (
  SELECT repo_id, pr_number, path, {RULES} AS f FROM (SELECT *, coalesce(patch, 'Binary/large file.') AS p FROM pr_files)) WHERE len(f) > 0)"""


@query("T12_scan_secrets_pr", f"{PW}, {ALERTS} SELECT * FROM alerts")
def t12(t):
    return ct.scan_secrets_pr(t.pr_files())


TOKENS = " OR ".join(f"regexp_matches(d, {q(p)})" for p in fixed.DIFF_TOKEN_PATTERNS)
# a token is put together from parts of the text's own key, so that the positive case occurs
DIFF_SQL = "CASE WHEN doc_id % 50 = 7 THEN 'g' || 'hp_' || substr(md5(text) || md5(text), 1, 36) ELSE text END"


def diff_column():
    return F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("g"), F.lit("hp_"), F.substring(F.concat(F.md5("text"), F.md5("text")), 1, 36))).otherwise(F.col("text"))


@query("T13_scan_secrets_diff", f"SELECT doc_id, {TOKENS} AS has_token FROM (SELECT doc_id, {DIFF_SQL} AS d FROM documents)")
def t13(t):
    return t.raw("documents").select("doc_id", ct.has_diff_tokens(diff_column()).alias("has_token"))


@query("T14_risk_override", f"""{PW}, {ALERTS}, risk AS (SELECT repo_id, pr_number, CASE WHEN sum(changes) > 1000 THEN 'medium' ELSE 'low' END AS risk_level FROM pr_files GROUP BY 1, 2)
  SELECT repo_id, pr_number, CASE WHEN EXISTS (SELECT 1 FROM alerts a WHERE a.repo_id = r.repo_id AND a.pr_number = r.pr_number) THEN 'high' ELSE risk_level END AS risk_level FROM risk r""")
def t14(t):
    prs = t.pr_files()
    risk = prs.groupBy("repo_id", "pr_number").agg(F.when(F.sum("changes") > 1000, "medium").otherwise("low").alias("risk_level"))
    return ct.risk_override(risk, ct.scan_secrets_pr(prs))


@query("T14_impact_rows", f"""{PW}, {ALERTS} SELECT repo_id, pr_number, 0 AS is_impact, path AS alert_path, 0 AS ord, 'SECURITY BREACH' AS file, alert AS impact FROM alerts
  UNION ALL SELECT repo_id, pr_number, 1, NULL, changes, path, status FROM pr_files""")
def t14b(t):
    prs = t.pr_files()
    impacts = prs.select("repo_id", "pr_number", F.col("changes").alias("ord"), F.col("path").alias("file"), F.col("status").alias("impact"))
    return ct.impact_rows(impacts, ct.scan_secrets_pr(prs))


FO, TE, LO = q(ct.FUNCTION_OPENER), q(ct.TERMINATOR), q(ct.LOOP_OPENER)
NAMEX = "nullif(regexp_extract({}, '\\bfunction\\b\\s*\\*?\\s*([A-Za-z_$][\\w$]*)', 1), '')"
# one row per line; the block of a line is found by looking for the last opener one level up
LINT = f"""raw_lines AS (SELECT repo_id, path, unnest(l) AS r, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l FROM modules)),
cl AS MATERIALIZED (SELECT repo_id, path, line, t, net, lead_close, sum(net) OVER (PARTITION BY repo_id, path ORDER BY line) - net - lead_close AS lvl, net + lead_close > 0 AS opens
  FROM (SELECT repo_id, path, line, t, length(t) - length(replace(t, '{{', '')) - (length(t) - length(replace(t, '}}', ''))) AS net, length(regexp_extract(t, '^(\\}}+)', 1)) AS lead_close
    FROM (SELECT repo_id, path, line, {TRIM.format('r')} AS t FROM raw_lines) WHERE t <> '' AND NOT regexp_matches(t, '^(//|/\\*|\\*)'))),
op AS MATERIALIZED (SELECT o.repo_id, o.path, o.line, o.t, o.lvl, (SELECT min(c.line) FROM cl c WHERE c.repo_id = o.repo_id AND c.path = o.path AND c.lvl <= o.lvl AND c.line > o.line) AS until FROM cl o WHERE opens),
st AS MATERIALIZED (SELECT c.repo_id, c.path, c.line, c.t, c.lvl, o.line AS bl, o.t AS bt FROM cl c JOIN op o ON o.repo_id = c.repo_id AND o.path = c.path AND o.lvl = c.lvl - 1 AND c.line > o.line AND (o.until IS NULL OR c.line < o.until) WHERE NOT starts_with(c.t, '}}')),
nx AS (SELECT *, lead(line) OVER (PARTITION BY repo_id, path, bl ORDER BY line) AS nl FROM st),
fn AS (SELECT * FROM nx WHERE regexp_matches(bt, {FO})),
un AS (SELECT repo_id, path, 'unreachable_code' AS type, {NAMEX.format('bt')} AS function_name, nl AS line, 'Unreachable statement after ' || CASE regexp_extract(t, '^(\\w+)', 1) WHEN 'return' THEN 'ReturnStatement' WHEN 'throw' THEN 'ThrowStatement'
    WHEN 'break' THEN 'BreakStatement' ELSE 'ContinueStatement' END || ' at line ' || line AS description, 'error' AS severity
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, bl ORDER BY line) rn FROM fn WHERE regexp_matches(t, {TE}) AND nl IS NOT NULL) WHERE rn = 1),
asy AS (SELECT o.* FROM op o WHERE regexp_matches(t, '\\basync\\b') AND regexp_matches(t, {FO}) AND until IS NOT NULL
  AND EXISTS (SELECT 1 FROM cl c WHERE c.repo_id = o.repo_id AND c.path = o.path AND c.line > o.line AND c.line <= o.until AND regexp_matches(c.t, '\\bawait\\b'))
  AND NOT EXISTS (SELECT 1 FROM fn WHERE fn.repo_id = o.repo_id AND fn.path = o.path AND fn.bl = o.line AND regexp_matches(fn.t, '^try\\b'))),
mi AS (SELECT repo_id, path, 'missing_error_handling', {NAMEX.format('t')}, line, 'Async function ''' || coalesce({NAMEX.format('t')}, '(anonymous)') || ''' uses await without try/catch', 'warning' FROM asy),
lo AS (SELECT repo_id, path, 'infinite_loop_candidate', {NAMEX.format('bt')}, line, CASE WHEN starts_with(t, 'while') THEN 'while(true)' ELSE 'for(;;)' END || ' loop without break/return — potential infinite loop', 'warning' FROM fn
  WHERE regexp_matches(t, {LO}) AND NOT EXISTS (SELECT 1 FROM st WHERE st.repo_id = fn.repo_id AND st.path = fn.path AND st.bl = fn.line AND regexp_matches(st.t, '^(break|return)\\b'))),
findings AS (SELECT * FROM un UNION ALL SELECT * FROM mi UNION ALL SELECT * FROM lo)"""


def code(t):
    return t.modules()


@query("T15_lint_code_lines", f"{MW}, {LINT} SELECT * FROM findings")
def t15(t):
    return ct.lint_code_lines(code(t))


@query("A16_findings_summary", f"""{MW}, {LINT} SELECT DISTINCT repo_id, path, 0 AS line, '[' || path || ']' AS text FROM findings
  UNION ALL SELECT repo_id, path, line, '  ' || CASE severity WHEN 'error' THEN 'ERROR' ELSE 'WARN' END || ' L' || line || ': ' || description FROM findings""")
def a16(t):
    return ct.findings_summary(ct.lint_code_lines(code(t)))


@query("T16_lint_top_files", f"""{MW}, {LINT}, best AS (SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY length(content) DESC, path) rn FROM modules
  WHERE regexp_extract(path, '(\\.[^.]*)$', 1) IN ('.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs')) WHERE rn <= 5) SELECT f.* FROM findings f JOIN best USING (repo_id, path)""")
def t16(t):
    ranks = t.modules().select("repo_id", "path", F.length("content").alias("score"))
    return ct.lint_top_files(t.modules(), ranks)


@query("T17_trace_hash", f"{TW} SELECT trace_id, substr(sha256(trace), 1, 16) AS trace_hash FROM traces")
def t17(t):
    return t.traces().select("trace_id", tc.trace_hash(F.col("trace")).alias("trace_hash"))


@query("Q2_crash_diagnosis", f"""{HW}, {CONF} SELECT i.repo_id, i.trace_id, substr(sha256(trace), 1, 16) AS trace_hash, error_type, error_message, path, coalesce(line, 0) AS line, coalesce(confidence, 'low') AS confidence,
    {RUNTIME} AS needs_runtime_check FROM info i JOIN traces USING (repo_id, trace_id) LEFT JOIN located USING (repo_id, trace_id) LEFT JOIN conf USING (repo_id, trace_id)""")
def q2(t):
    edges = module_graph(t)[1]
    return diagnosis.diagnose(t.traces(), t.modules(), edges)[1].withColumn("line", F.coalesce("line", F.lit(0)))


PR_SQL = f"WITH RECURSIVE {SUCCESSOR}, {PRS}" + """, pr_files AS (SELECT repo_id, pr_number, path, CASE WHEN pr_number % 3 = 0 THEN 'pass' || 'word = "' || md5(path) || '"' ELSE 'x' END AS patch FROM prs)"""


@query("Q3_pr_impact", f"""{PR_SQL}, {ALERTS}, c AS (SELECT w.repo_id, w.pr_number, count(p.path) AS modified, count(*) - count(p.path) AS blast FROM walk w LEFT JOIN prs p USING (repo_id, pr_number, path) GROUP BY 1, 2),
  n AS (SELECT repo_id, pr_number, count(*) AS alerts FROM alerts GROUP BY 1, 2)
  SELECT repo_id, pr_number, modified, blast, CASE WHEN alerts > 0 THEN 'high' WHEN blast > 20 THEN 'critical' WHEN blast > 10 THEN 'high' WHEN blast > 3 THEN 'medium' ELSE 'low' END AS risk_level, coalesce(alerts, 0) AS alerts FROM c LEFT JOIN n USING (repo_id, pr_number)""")
def q3(t):
    patch = F.when(F.col("pr_number") % 3 == 0, F.concat(F.lit("pass"), F.lit('word = "'), F.md5("path"), F.lit('"'))).otherwise("x")
    return pull_request.pr_impact(
        t.supplier_prs().withColumn("patch", patch), gs.union_nodes(t.successor_edges()), t.successor_edges())[0]


# as Q3_pr_impact, with the list behind each summary: alerts first, then the touched files
@query("Q3_pr_report", f"""{PR_SQL}, {ALERTS}, c AS (SELECT w.repo_id, w.pr_number, count(*) - count(p.path) AS blast FROM walk w LEFT JOIN prs p USING (repo_id, pr_number, path) GROUP BY 1, 2),
  n AS (SELECT repo_id, pr_number, count(*) AS alerts FROM alerts GROUP BY 1, 2),
  s AS (SELECT repo_id, pr_number, CASE WHEN alerts > 0 THEN 'high' WHEN blast > 20 THEN 'critical' WHEN blast > 10 THEN 'high' WHEN blast > 3 THEN 'medium' ELSE 'low' END AS risk_level FROM c LEFT JOIN n USING (repo_id, pr_number)),
  l AS (SELECT repo_id, pr_number, 0 AS is_impact, 'SECURITY BREACH' AS file, alert AS impact FROM alerts UNION ALL SELECT repo_id, pr_number, 1, path, class FROM classes)
  SELECT repo_id, pr_number, risk_level, is_impact, file, impact FROM l JOIN s USING (repo_id, pr_number)""")
def q3b(t):
    patch = F.when(F.col("pr_number") % 3 == 0, F.concat(F.lit("pass"), F.lit('word = "'), F.md5("path"), F.lit('"'))).otherwise("x")
    edges = t.successor_edges()
    report = pull_request.pr_report(t.supplier_prs().withColumn("patch", patch), gs.union_nodes(edges), edges)
    return report.select("repo_id", "pr_number", "risk_level", "is_impact", "file", "impact")


STRIPPED = f"""array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: {TRIM.format('l')}),
  lambda l: l <> '' AND NOT starts_with(l, '//') AND NOT starts_with(l, '/*') AND NOT starts_with(l, '*')), chr(10))"""


@query("Q2_crash_context", f"""{HW}, {BUDGET}, x AS (SELECT b.repo_id, b.trace_id, b.file AS path, b.relationship, coalesce(content, '// Content not available') AS content, l.line FROM budget b LEFT JOIN modules m ON m.repo_id = b.repo_id AND m.path = b.file
    LEFT JOIN located l ON l.repo_id = b.repo_id AND l.trace_id = b.trace_id AND l.path = b.file),
  y AS (SELECT *, string_split(content, chr(10)) AS ls, greatest(0, line - 10) AS s0, least(len(string_split(content, chr(10))), line + 10) AS e FROM x)
  SELECT repo_id, trace_id, path, relationship, CASE WHEN line IS NULL THEN {STRIPPED} WHEN e > s0 THEN {SNIP} ELSE '' END AS snippet FROM y""")
def q2b(t):
    context, summary = diagnosis.diagnose(t.traces(), t.modules(), module_graph(t)[1])
    return diagnosis.context_snippets(context, t.modules(), summary).drop("distance")
