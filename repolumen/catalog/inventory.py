"""File inventory queries."""
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import any_literal, any_pattern, basename, dirname
from ..operators import inventory as inv
from ..sources import landed
from .bindings import DOC_FILES
from .registry import q, qlist, query

NAME = "regexp_extract(path, '([^/]*)\\z', 1)"
EXT = "lower(regexp_extract(path, '(\\.[^./]*)\\z', 1))"
DEPTH = "len(string_split(path, '/'))"
SKIP = f"""(list_has_any(list_slice(string_split(path, '/'), 1, -2), {qlist(fixed.SKIP_DIRECTORIES)})
  OR regexp_matches(path, {q(any_pattern(fixed.SKIP_DIRECTORY_PATTERNS))})
  OR len(list_filter({qlist(fixed.SKIP_EXTENSIONS)}, lambda e: ends_with({NAME}, e))) > 0
  OR regexp_matches(path, {q('(?i)' + any_pattern(fixed.SKIP_NAME_PATTERNS))}))"""
IGNORED = f"""(len(list_filter({qlist(fixed.IGNORED_SUBSTRINGS)}, lambda e: contains(path, e))) > 0
  OR len(list_filter({qlist(fixed.IGNORED_EXTENSIONS)}, lambda e: ends_with(path, e))) > 0)"""
STRENGTH = f"""CASE WHEN list_contains({qlist(fixed.STRONG_NODE_EXTENSIONS)}, {EXT}) THEN 'strong'
  WHEN list_contains({qlist(fixed.WEAK_NODE_EXTENSIONS)}, {EXT}) THEN 'weak' ELSE 'none' END"""
TEST = f"(regexp_matches(path, {q(fixed.TEST_FILE_PATTERN)}) OR regexp_matches(path, {q(fixed.TEST_DIRECTORY_PATTERN)}))"
IS_ENTRY = f"list_contains({qlist(fixed.ENTRY_NAMES)}, {NAME})"
IS_CONFIG = f"(len(list_filter({qlist(fixed.CONFIG_NAMES)}, lambda e: starts_with({NAME}, e) OR ends_with(path, e))) > 0)"
IS_TEST = f"(len(list_filter({qlist(fixed.TEST_WORDS)}, lambda e: contains(path, e))) > 0)"
IS_SAMPLE = "(path LIKE 'examples/%' OR path LIKE 'demo/%' OR path LIKE 'sample/%')"


def classified(source: str) -> str:
    return f"""SELECT *, CAST(CASE WHEN e THEN 10 ELSE 0 END + CASE WHEN c THEN 6 ELSE 0 END - CASE WHEN t THEN 4 ELSE 0 END
      + CASE WHEN depth = 1 THEN 3 ELSE 0 END + CASE WHEN path LIKE 'src/%' OR path LIKE 'lib/%' THEN 2 ELSE 0 END
      - CASE WHEN depth > 4 THEN 2 ELSE 0 END - CASE WHEN s THEN 5 ELSE 0 END AS INTEGER) AS score,
      CASE WHEN t THEN 'test' WHEN c THEN 'config' WHEN e AND NOT s THEN 'entry' ELSE 'other' END AS role
    FROM (SELECT *, {IS_ENTRY} e, {IS_CONFIG} c, {IS_TEST} t, {IS_SAMPLE} s, {DEPTH} depth FROM {source})"""


def boosted(source: str) -> str:
    return f"""SELECT repo_id, path, size, score + CASE WHEN path LIKE '%.html' THEN 500 ELSE 0 END AS score,
      CASE WHEN path LIKE '%.html' THEN 'entry' ELSE role END AS role FROM ({classified(source)})"""


WITH = "WITH " + DOC_FILES + " "


@query("F1_should_skip_file", WITH + f"SELECT repo_id, path, {SKIP} AS skipped FROM files")
def f1(t):
    return t.files().select("repo_id", "path", inv.should_skip_file(F.col("path"), F.col("size")).alias("skipped"))


@query("F2_is_ignored_path", WITH + f"SELECT repo_id, path, {IGNORED} AS ignored FROM files")
def f2(t):
    return t.files().select("repo_id", "path", inv.is_ignored_path(F.col("path")).alias("ignored"))


@query("F3_graph_node_strength", WITH + f"SELECT repo_id, path, {STRENGTH} AS strength FROM files")
def f3(t):
    return t.files().select("repo_id", "path", inv.graph_node_strength(F.col("path")).alias("strength"))


@query("F4_filter_files", WITH + f"SELECT repo_id, path, size FROM files WHERE NOT {SKIP}")
def f4(t):
    return inv.filter_files(t.files())


@query("F4_filter_graph_files", WITH + f"SELECT repo_id, path, size FROM files WHERE NOT {SKIP} AND {STRENGTH} <> 'none'")
def f4b(t):
    return inv.filter_graph_files(t.files())


@query("F5_classify_and_score", WITH + f"SELECT repo_id, path, size, score, role FROM ({classified('files')})")
def f5(t):
    return inv.classify_and_score(t.files())


@query("F6_boost_entry_points", WITH + boosted("files"))
def f6(t):
    return inv.boost_entry_points(inv.classify_and_score(t.files()))


TOP = f"""top_files AS (SELECT repo_id, CAST(CASE WHEN is_entry THEN rn ELSE rn + entries END AS INTEGER) AS position, path, score, role FROM (
    SELECT *, count(*) FILTER (WHERE is_entry AND rn <= 8) OVER (PARTITION BY repo_id) AS entries FROM (
      SELECT *, role = 'entry' AS is_entry, row_number() OVER (PARTITION BY repo_id, role = 'entry' ORDER BY score DESC, path) rn
      FROM ({boosted('files')}) WHERE role <> 'test' AND path NOT LIKE '%.md'))
  WHERE CASE WHEN is_entry THEN rn <= 8 ELSE rn <= 30 - entries END)"""


@query("F7_top_files", WITH + ", " + TOP + " SELECT * FROM top_files")
def f7(t):
    return inv.top_files(inv.boost_entry_points(inv.classify_and_score(t.files())))


@query("F8_entry_points", WITH + f"""SELECT repo_id, path FROM ({boosted('files')}) WHERE role = 'entry'""")
def f8(t):
    return inv.entry_points(inv.boost_entry_points(inv.classify_and_score(t.files())))


@query("F9_test_and_config_files", WITH + f"SELECT repo_id, path, {TEST} AS is_test, regexp_matches(path, {q(fixed.CONFIG_FILE_PATTERN)}) AS is_config FROM files")
def f9(t):
    p = F.col("path")
    return t.files().select("repo_id", "path", inv.is_test_file(p).alias("is_test"), inv.is_config_file(p).alias("is_config"))


LANG = "CASE " + " ".join(f"WHEN list_contains({qlist(e)}, ext) THEN {q(n)}" for n, e in fixed.LANGUAGE_EXTENSIONS.items()) + " END"


@query("F10_detect_repo_type", WITH + f"""
, f AS (SELECT repo_id, ext, {LANG} AS lang FROM (SELECT repo_id, path, {EXT} AS ext FROM files
    WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {qlist(fixed.SKIP_DIRECTORIES)})) WHERE ext <> ''),
c AS (SELECT repo_id, lang, count(*) n FROM f WHERE lang IS NOT NULL GROUP BY 1, 2),
top AS (SELECT repo_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, lang) rn FROM c) WHERE rn = 1),
a AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE list_contains({qlist(fixed.STRONG_NODE_EXTENSIONS)}, ext)) AS js,
    count(*) FILTER (WHERE lang IN ('typescript', 'javascript')) AS fam FROM f GROUP BY 1),
b AS (SELECT a.*, coalesce(lang, 'unknown') AS language, CAST(fam AS DOUBLE) / total AS r, js >= 3 AND CAST(fam AS DOUBLE) / total >= 0.05 AS g FROM a LEFT JOIN top USING (repo_id))
SELECT repo_id, language, round(r, 6) AS js_ratio, g AS is_graphable,
  CASE WHEN NOT g AND js = 0 THEN 'This appears to be a ' || language || ' repository with no JavaScript/TypeScript files. Dependency graph requires JS/TS imports.'
    WHEN NOT g AND js < 3 THEN 'Only ' || js || ' JS/TS file(s) found — not enough to build a meaningful dependency graph.'
    WHEN NOT g THEN 'JS/TS files make up only ' || CAST(floor(r * 100 + 0.5) AS BIGINT) || '% of this repo. The dependency graph would be mostly disconnected.'
    WHEN language NOT IN ('typescript', 'javascript') THEN 'Mixed repo (dominant: ' || language || '). Only JS/TS files will appear in the dependency graph — ' || js || ' of ' || total || ' files.' END AS reason,
  total AS total_files, js AS js_node_count FROM b""")
def f10(t):
    return inv.detect_repo_type(t.files()).withColumn("js_ratio", F.round("js_ratio", 6))


@query("F13_size_heat_bucket", WITH + """
, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM files),
p AS (SELECT repo_id, max(size) FILTER (WHERE i = floor(n * 0.66::DOUBLE)) AS p66, max(size) FILTER (WHERE i = floor(n * 0.9::DOUBLE)) AS p90 FROM r GROUP BY 1)
SELECT repo_id, path, size, CASE WHEN size >= p90 THEN 'red' WHEN size >= p66 THEN 'yellow' ELSE 'green' END AS bucket FROM files JOIN p USING (repo_id)""")
def f13(t):
    return inv.size_heat_bucket(t.files())


@query("F14_weight_by_folder", WITH + """
, t AS (SELECT repo_id, sum(size) AS ts, CAST(sum(greatest(1, CAST(floor(size / 30.0::DOUBLE + 0.5) AS BIGINT))) AS BIGINT) AS total_loc FROM files GROUP BY 1)
SELECT repo_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS size,
  CAST(sum(greatest(1, CAST(floor(size / 30.0::DOUBLE + 0.5) AS BIGINT))) AS BIGINT) AS loc, total_loc
FROM files JOIN t USING (repo_id) WHERE size > ts * 0.0005::DOUBLE GROUP BY 1, 2, 6""")
def f14(t):
    return inv.weight_by_folder(t.files())


TREE = """, tree AS (SELECT repo_id, node, regexp_extract(node, '([^/]*)$', 1) AS name,
  CASE WHEN contains(node, '/') THEN regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent, bool_or(is_folder) AS is_folder
  FROM (SELECT repo_id, array_to_string(list_slice(parts, 1, i), '/') AS node, i < len(parts) AS is_folder
    FROM (SELECT repo_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT repo_id, string_split('root/' || path, '/') AS parts FROM files)))
  GROUP BY 1, 2)"""


@query("F15_directory_tree", WITH + TREE + " SELECT * FROM tree")
def f15(t):
    return inv.directory_tree(t.files())


@query("F15_tree_links", WITH + TREE + " SELECT repo_id, parent AS source, node AS target FROM tree WHERE parent IS NOT NULL")
def f15b(t):
    return inv.tree_links(inv.directory_tree(t.files()))


@query("F15_tree_highlight", WITH + TREE + """ SELECT repo_id, node,
  node = 'root/lib/web' OR starts_with('root/lib/web', node || '/') OR starts_with(node, 'root/lib/web/') AS is_active FROM tree""")
def f15c(t):
    return inv.tree_highlight(inv.directory_tree(t.files()), F.lit("root/lib/web")).select("repo_id", "node", "is_active")


@query("F16_file_and_dir_name", WITH + """SELECT repo_id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
  CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM files""")
def f16(t):
    p = F.col("path")
    return t.files().select("repo_id", "path", basename(p).alias("name"), dirname(p).alias("dir"))


# --- sources ------------------------------------------------------------------------

@query("S1_scan_file_tree", """SELECT lang AS repo_id, source || '/' || doc_id AS path, coalesce(CASE WHEN doc_id % 4 <> 1 THEN n_chars END, 0) AS size
  FROM documents WHERE doc_id % 5 <> 0""")
def s1(t):
    d = F.col("doc_id")
    tree = t.raw("documents").select(
        F.col("lang").alias("repo_id"), F.when(d % 5 == 0, "tree").otherwise("blob").alias("type"),
        F.concat("source", F.lit("/"), d).alias("path"), F.when(d % 4 != 1, F.col("n_chars")).alias("size"))
    return landed.scan_file_tree(tree)


@query("S2_scan_sources", "SELECT lang AS repo_id, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents")
def s2(t):
    d = t.raw("documents")
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    encoded = d.select(F.col("lang").alias("repo_id"), F.col("doc_id").cast("string").alias("path"),
                       F.when(F.col("doc_id") % 2 == 0, coded).otherwise(F.col("text")).alias("content"),
                       F.when(F.col("doc_id") % 2 == 0, "base64").otherwise("utf-8").alias("encoding"))
    return landed.scan_sources(encoded)


@query("S2_truncate_lines", """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10))
  || CASE WHEN len(string_split(text, chr(10))) > 5 THEN chr(10) ELSE '' END AS content FROM documents""")
def s2b(t):
    return t.raw("documents").select("doc_id", landed.truncate_lines(F.col("text"), 5).alias("content"))


@query("S3_normalize_uploaded", """SELECT lang AS repo_id, regexp_replace(regexp_replace(p, '\\.\\.[/\\\\]', '', 'g'), '^[/\\\\]+', '') AS path, text AS content FROM (
  SELECT *, CASE doc_id % 5 WHEN 0 THEN '../a/../' || doc_id WHEN 1 THEN '//' || doc_id WHEN 2 THEN NULL WHEN 3 THEN '/' ELSE 'x/' || doc_id END AS p FROM documents)
  WHERE p IS NOT NULL AND p <> '/'""")
def s3(t):
    d = F.col("doc_id")
    path = (F.when(d % 5 == 0, F.concat(F.lit("../a/../"), d)).when(d % 5 == 1, F.concat(F.lit("//"), d))
            .when(d % 5 == 2, F.lit(None)).when(d % 5 == 3, "/").otherwise(F.concat(F.lit("x/"), d)))
    return landed.normalize_uploaded(t.raw("documents").select(
        F.col("lang").alias("repo_id"), path.alias("path"), F.col("text").alias("content")))


@query("S4_upload_prioritize", WITH + f"""SELECT repo_id, path, CAST(d AS INTEGER) AS path_depth FROM (
    SELECT repo_id, path, {DEPTH} AS d FROM file_contents
    WHERE NOT regexp_matches(path, {q(any_literal(fixed.UPLOAD_BLOCKED_DIRECTORIES))})
      AND NOT regexp_matches(lower(path), {q(any_literal(fixed.UPLOAD_BLOCKED_EXTENSIONS) + chr(92) + 'z')}) AND regexp_matches(content, '\\S'))""")
def s4(t):
    return inv.upload_prioritize(t.file_contents())


@query("S6_scan_pr_files", """SELECT 'org' || (o_custkey % 9) || '/r' || (o_custkey % 4) AS repo_id, o_orderkey AS pr_number, 'f' || l_suppkey AS path,
    CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'modified' END AS status, CAST(l_quantity AS INTEGER) AS additions, CAST(l_linenumber AS INTEGER) AS changes,
    CAST(l_partkey AS VARCHAR) AS patch FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 6 <> 0""")
def s6(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.concat(F.lit("https://github.com/org"), c % 9, F.lit("/r"), c % 4, F.when(o % 6 == 0, "/issues/").otherwise("/pull/"), o)
    files = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(
        F.concat(F.lit("f"), "l_suppkey").alias("filename"), F.when(F.col("l_returnflag") == "R", "removed").otherwise("modified").alias("status"),
        F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").alias("changes"),
        F.col("l_partkey").cast("string").alias("patch"))).alias("files"))
    return landed.scan_pr_files(t.raw("orders").join(files, "o_orderkey").select(url.alias("url"), "files"))


@query("S7_parse_repo_url", """SELECT page_id, u AS url, CASE WHEN len(p) >= 2 THEN p[1] END AS owner, CASE WHEN len(p) >= 2 THEN regexp_replace(p[2], '\\.git$', '') END AS repo
  FROM (SELECT page_id, u, string_split(CASE WHEN starts_with(u, 'http') THEN regexp_replace(regexp_extract(u, '^https?://[^/?#]+(/[^?#]*)', 1), '^/|/$', '', 'g') ELSE u END, '/') AS p
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'own' || page_id || '/rep' || page_id || '.git' WHEN 2 THEN 'https://github.com/o' || page_id || '/r.git/' ELSE 'https://x.org/only' END AS u FROM pages))""")
def s7(t):
    p = F.col("page_id")
    u = (F.when(p % 4 == 0, F.col("url")).when(p % 4 == 1, F.concat(F.lit("own"), p, F.lit("/rep"), p, F.lit(".git")))
         .when(p % 4 == 2, F.concat(F.lit("https://github.com/o"), p, F.lit("/r.git/"))).otherwise("https://x.org/only"))
    return t.raw("pages").select("page_id", u.alias("url")).select("page_id", "url", landed.parse_repo_url(F.col("url")).alias("r")).select(
        "page_id", "url", "r.owner", "r.repo")
