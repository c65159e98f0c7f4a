"""Import extraction and resolution queries over the module sources."""
from pyspark.sql import functions as F

from .. import fixed
from ..operators import imports as imp
from .bindings import MODULES
from .registry import q, qlist, query

WITH = "WITH RECURSIVE " + MODULES

# fold . and .. over the joined path with a reducer on lists
FOLD = """array_to_string(list_reduce(list_transform(string_split(CASE WHEN dir = '' THEN spec ELSE dir || '/' || spec END, '/'), lambda x: [x]),
  lambda a, x: CASE WHEN x[1] = '..' THEN list_slice(a, 1, greatest(len(a) - 1, 0)) WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END, []::VARCHAR[]), '/')"""
DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"


def matches(pattern: str, kind: str, where: str) -> str:
    return f"""SELECT repo_id, path AS src, CAST(unnest(generate_series(0, len(m) - 1)) AS INTEGER) AS ord, unnest(m) AS spec, '{kind}' AS kind, {DIR} AS dir
      FROM (SELECT repo_id, path, regexp_extract_all(content, {q(pattern)}, 1) AS m FROM modules WHERE {where})"""


CODE = "NOT (path LIKE '%.html' OR path LIKE '%.htm')"
TARGET = f"CASE WHEN starts_with(spec, '.') THEN {FOLD} ELSE spec END"
ES = f"es AS (SELECT repo_id, src, ord, spec, kind, regexp_matches(spec, '^[@~]/') AS is_alias, {TARGET} AS target FROM ({matches(fixed.ES_IMPORT, 'es', CODE)}) WHERE starts_with(spec, '.') OR contains(spec, '/'))"
CJS = f"cjs AS (SELECT repo_id, src, ord, spec, kind, regexp_matches(spec, '^[@~]/') AS is_alias, {TARGET} AS target FROM ({matches(fixed.CJS_REQUIRE, 'cjs', CODE)}) WHERE regexp_matches(spec, '^(\\.|[@~]/)'))"
HTML = f"""html AS (SELECT repo_id, src, ord, spec, kind, false AS is_alias, spec AS target FROM (
  {matches(fixed.HTML_SCRIPT, 'script', 'NOT ' + CODE)} UNION ALL {matches(fixed.HTML_LINK, 'link', 'NOT ' + CODE)})
  WHERE NOT regexp_matches(spec, {q(fixed.HTML_EXTERNAL)}))"""
ALIASES = """aliases AS (SELECT repo_id, CAST(i - 1 AS INTEGER) AS ord, replace(k, '/*', '') AS prefix, replace(json_extract_string(p, '$."' || k || '"[0]'), '/*', '') AS target
  FROM (SELECT repo_id, p, unnest(json_keys(p)) AS k, unnest(generate_series(1, len(json_keys(p)))) AS i FROM (
    SELECT repo_id, json_extract(regexp_replace(content, '(?s)/\\*.*?\\*/|//[^\\n\\r]*', '', 'g')::JSON, '$.compilerOptions.paths') AS p
    FROM modules WHERE path = 'tsconfig.json')))"""
RAW = """raw AS (SELECT r.repo_id, src, r.ord, spec, kind, is_alias, coalesce(regexp_replace(hit, '^\\./', ''), target) AS target FROM (
    SELECT * FROM es UNION ALL SELECT * FROM cjs) r
  LEFT JOIN (SELECT repo_id, spec, arg_min(target || substr(spec, length(prefix) + 1), ord) AS hit FROM (SELECT DISTINCT repo_id, spec FROM (SELECT * FROM es UNION ALL SELECT * FROM cjs) WHERE is_alias)
    JOIN aliases USING (repo_id) WHERE starts_with(spec, prefix) GROUP BY 1, 2) h USING (repo_id, spec)
  UNION ALL SELECT * FROM html)"""
EXTS = fixed.RESOLVE_EXTENSIONS
CANDIDATES = "list_concat([''], " + qlist(EXTS) + ", " + qlist(["/index" + e for e in EXTS]) + ")"
RESOLVED = f"""resolved AS (SELECT repo_id, src, target, arg_min(path, pos) AS dst FROM (
    SELECT repo_id, src, target, base || c AS path, base_no * 100 + i AS pos FROM (
      SELECT *, unnest({CANDIDATES}) AS c, unnest(generate_series(1, 17)) AS i FROM (
        SELECT repo_id, src, target, unnest([target, 'src/' || target]) AS base, unnest([0, 1]) AS base_no FROM (SELECT DISTINCT repo_id, src, target FROM raw))))
  JOIN (SELECT DISTINCT repo_id, path FROM modules) USING (repo_id, path) GROUP BY 1, 2, 3)"""
LAYOUT = """layout_edges AS (SELECT repo_id, page AS src, unnest([layout, loading, error]) AS dst FROM (
    SELECT repo_id, """ + DIR + """ AS dir, """ + ", ".join(
    f"min(path) FILTER (WHERE regexp_matches(path, '/{k}\\.(tsx|ts|jsx|js)$')) AS {k}" for k in ("page", "layout", "loading", "error")) + """
    FROM modules GROUP BY 1, 2) WHERE page IS NOT NULL),
graph_edges AS (SELECT repo_id, src, dst FROM resolved UNION SELECT repo_id, src, dst FROM layout_edges WHERE dst IS NOT NULL),
graph_nodes AS (SELECT repo_id, path FROM modules UNION SELECT repo_id, src FROM graph_edges)"""
IS_CFG = f"regexp_matches({{}}, {q(fixed.CONFIG_FILE_PATTERN)})"
SANE = f"""edges AS (SELECT * FROM graph_edges WHERE NOT {IS_CFG.format('src')} AND NOT {IS_CFG.format('dst')}),
nodes AS (SELECT repo_id, path FROM graph_nodes WHERE NOT {IS_CFG.format('path')} UNION SELECT repo_id, dst FROM edges)"""
GRAPH = ", ".join([WITH, ES, CJS, HTML, ALIASES, RAW, RESOLVED, LAYOUT, SANE])


def code(t):
    return t.modules().filter(~imp.is_html(F.col("path")))


@query("E1_extract_es_imports", f"{WITH}, {ES} SELECT * FROM es")
def e1(t):
    return imp.extract_es_imports(code(t))


@query("E2_extract_cjs_requires", f"{WITH}, {CJS} SELECT * FROM cjs")
def e2(t):
    return imp.extract_cjs_requires(code(t))


@query("E3_extract_html_refs", f"{WITH}, {HTML} SELECT * FROM html")
def e3(t):
    return imp.extract_html_refs(t.modules().filter(imp.is_html(F.col("path"))))


@query("E3_extract_html_refs_pages", f"""SELECT page_id, spec, kind FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {q(fixed.HTML_SCRIPT)}, 1)) AS spec, 'script' AS kind FROM pages
  UNION ALL SELECT page_id, unnest(regexp_extract_all(html, {q(fixed.HTML_LINK)}, 1)), 'link' FROM pages) WHERE NOT regexp_matches(spec, {q(fixed.HTML_EXTERNAL)})""")
def e3b(t):
    pages = t.raw("pages").select(F.lit("web").alias("repo_id"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return imp.extract_html_refs(pages).select(F.col("src").cast("bigint").alias("page_id"), "spec", "kind")


@query("E4_normalize_relative", f"""SELECT l_orderkey, l_linenumber, spec, dir, {FOLD} AS target FROM (SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN './a' WHEN 1 THEN '../b' WHEN 2 THEN '../../../c/./d' ELSE './x/../y' END || l_suppkey AS spec,
  CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'src' ELSE 'src/p' || l_partkey END AS dir FROM lineitem)""")
def e4(t):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    spec = F.concat(F.when(n % 4 == 0, "./a").when(n % 4 == 1, "../b").when(n % 4 == 2, "../../../c/./d").otherwise("./x/../y"), "l_suppkey")
    folder = F.when(p % 3 == 0, "").when(p % 3 == 1, "src").otherwise(F.concat(F.lit("src/p"), p))
    return t.raw("lineitem").select("l_orderkey", n, spec.alias("spec"), folder.alias("dir")).withColumn(
        "target", imp.normalize_relative(F.col("spec"), F.col("dir")))


@query("E5_parse_aliases", f"{WITH}, {ALIASES} SELECT * FROM aliases")
def e5(t):
    return imp.parse_aliases(t.modules())


@query("E6_resolve_alias", f"{WITH}, {ES}, {CJS}, {HTML}, {ALIASES}, {RAW} SELECT * FROM raw")
def e6(t):
    return imp.raw_imports(t.modules())


# the chain of the configurations written out: root → base{k%3} → deep; base2 does not exist
E7_SQL = """WITH c AS (SELECT s_suppkey AS k, 'cfg' || s_suppkey AS repo_id FROM supplier),
a AS (SELECT repo_id, '@/' AS prefix, CASE WHEN k % 3 < 2 THEN 'code/app' ELSE 'app' END || (k % 5) || '/' AS target FROM c
  UNION ALL SELECT repo_id, '#u', CASE WHEN k % 3 < 2 THEN 'code/util' ELSE 'util' END FROM c
  UNION ALL SELECT repo_id, '@/lib/', 'lib' || (k % 7) || '/' FROM c WHERE k % 3 < 2
  UNION ALL SELECT repo_id, 'd' || k || '/', 'code/deep/' FROM c WHERE k % 3 < 2)"""


@query("E7_build_path_aliases", E7_SQL + " SELECT repo_id, CAST(-length(prefix) AS INTEGER) AS ord, prefix, target FROM a")
def e7(t):
    return imp.build_path_aliases(t.alias_configs())


SPECS = ["@/pages/one", "@/lib/two", "#u", "react", "./near"]


@query("E7_resolve_full_alias", E7_SQL + f""", raw AS (SELECT repo_id, unnest({SPECS}) AS spec FROM c UNION ALL SELECT repo_id, 'd' || k || '/three' FROM c),
  hits AS (SELECT r.repo_id, r.spec, target || substr(spec, length(prefix) + 1) AS target, row_number() OVER (PARTITION BY r.repo_id, spec ORDER BY length(prefix) DESC) AS rn FROM raw r JOIN a ON a.repo_id = r.repo_id AND starts_with(spec, prefix))
  SELECT r.repo_id, r.spec, h.target IS NOT NULL AS is_alias, coalesce(h.target, '') AS target FROM raw r LEFT JOIN hits h ON h.repo_id = r.repo_id AND h.spec = r.spec AND rn = 1""")
def e7b(t):
    repo = F.concat(F.lit("cfg"), "s_suppkey").alias("repo_id")
    specs = F.array(*[F.lit(x) for x in SPECS], F.concat(F.lit("d"), "s_suppkey", F.lit("/three")))
    raw = t.raw("supplier").select(repo, F.posexplode(specs).alias("ord", "spec")).select(
        "repo_id", F.lit("s").alias("src"), "ord", "spec", F.lit("es").alias("kind"), F.lit(True).alias("is_alias"), F.lit("").alias("target"))
    return imp.resolve_alias(raw, imp.build_path_aliases(t.alias_configs())).select("repo_id", "spec", (F.col("target") != "").alias("is_alias"), "target")


@query("E8_resolve_to_file", f"{WITH}, {ES}, {CJS}, {HTML}, {ALIASES}, {RAW}, {RESOLVED} SELECT * FROM resolved")
def e8(t):
    return imp.resolve_to_file(imp.raw_imports(t.modules()), t.modules())


@query("E9_inject_layout_edges", f"""{WITH}, {LAYOUT.split(',' + chr(10) + 'graph_edges')[0]} SELECT * FROM layout_edges WHERE dst IS NOT NULL""")
def e9(t):
    none = t.successor_edges().filter(F.lit(False)).select("repo_id", "src", "dst")
    return imp.inject_layout_edges(none, t.module_files())


@query("E10_build_dependency_graph", GRAPH + " SELECT * FROM graph_edges")
def e10(t):
    return imp.build_dependency_graph(t.modules(), t.module_files())[1]


@query("E10_graph_nodes", GRAPH + " SELECT * FROM graph_nodes")
def e10b(t):
    return imp.build_dependency_graph(t.modules(), t.module_files())[0]


@query("F12_sanitize_graph", GRAPH + " SELECT repo_id, src, dst FROM edges UNION ALL SELECT repo_id, path, NULL FROM nodes")
def f12(t):
    nodes, edges = module_graph(t)
    return edges.unionByName(nodes.select("repo_id", F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")))


def module_graph(t):
    """The sanitised graph, landed once per application: the tables all graph queries share."""
    def build():
        return imp.build_dependency_graph(t.modules(), t.module_files())

    edges = t.landed("module-edges", lambda: imp.sanitize_graph(*build())[1])
    # the nodes are read from the landed edges, whose references are then not resolved again
    nodes = t.landed("module-nodes", lambda: imp.sanitize_graph(imp.graph_nodes(t.modules(), t.module_files()), edges)[0])
    return nodes, edges


COVER = """tests AS (SELECT repo_id, path AS test_path, regexp_replace(regexp_replace(path, '(?i)\\.(?:test|spec)(\\.[jt]sx?)$', '\\1'), '(?i)__(tests|mocks)__/', '') AS path
  FROM modules WHERE regexp_matches(path, '(?i)\\.(test|spec)\\.[jt]sx?$') OR regexp_matches(path, '(?i)__(tests|mocks)__/')),
sources AS (SELECT repo_id, path FROM modules WHERE NOT (regexp_matches(path, '(?i)\\.(test|spec)\\.[jt]sx?$') OR regexp_matches(path, '(?i)__(tests|mocks)__/'))),
extra AS (SELECT repo_id, path FROM modules UNION ALL SELECT repo_id, replace(path, '.ts', '.test.ts') FROM modules WHERE path LIKE 'src/sup/%.ts'
  UNION ALL SELECT repo_id, '__tests__/' || path FROM modules WHERE path LIKE 'lib/%')"""
COVER_EXTRA = COVER.replace("FROM modules WHERE regexp", "FROM extra WHERE regexp").replace("FROM modules WHERE NOT", "FROM extra WHERE NOT")


def covered_files(t):
    m = t.module_files()
    return (
        m.select("repo_id", "path")
        .union(m.filter(F.col("path").like("src/sup/%.ts")).select("repo_id", F.replace("path", F.lit(".ts"), F.lit(".test.ts"))))
        .union(m.filter(F.col("path").like("lib/%")).select("repo_id", F.concat(F.lit("__tests__/"), "path")))
    )


# the parts in the order SQL needs them
_T, _S, _E = COVER_EXTRA.split(",\nsources")[0], "sources" + COVER_EXTRA.split(",\nsources")[1].split(",\nextra")[0], "extra" + COVER_EXTRA.split(",\nextra")[1]
COVER_SQL = f"{WITH}, {_E}, {_T}, {_S}"


@query("J3_test_coverage_map", COVER_SQL + """ SELECT repo_id, path, count(test_path) > 0 AS is_tested, count(test_path) AS n_tests
  FROM sources LEFT JOIN tests USING (repo_id, path) GROUP BY 1, 2""")
def j3(t):
    return imp.test_coverage_map(covered_files(t))


@query("J3_test_coverage_pairs", COVER_SQL + " SELECT repo_id, path, test_path FROM sources JOIN tests USING (repo_id, path)")
def j3b(t):
    return imp.test_coverage_pairs(covered_files(t))
