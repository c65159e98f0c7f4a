"""Import edges from source text: extraction, alias handling, resolution to files.

Resolution is an equi-join. Instead of trying every candidate path per import, every file
publishes the keys under which an import may name it (itself, without its extension, its
directory when it is an index file); the best file per key is settled before the join, so the
inventory side is unique and an import contributes two keys only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import dirname
from ..session import durable, land, measured

ALIAS_CONFIG = "compilerOptions struct<paths:map<string,array<string>>>"
FULL_CONFIG = (
    "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>, _corrupt string"
)


def normalize_relative(spec: Column, directory: Column) -> Column:
    """Fold ``.`` and ``..`` over ``directory/spec``; ``..`` above the root is dropped."""
    joined = F.when(directory == "", spec).otherwise(F.concat(directory, F.lit("/"), spec))
    folded = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(folded, "/")


def is_html(path: Column) -> Column:
    return path.endswith(".html") | path.endswith(".htm")


def _found(pattern: str, kind: str) -> Column:
    """All matches of a pattern in ``content`` as an array of (kind, ord, spec)."""
    return F.transform(
        F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(1)),
        lambda spec, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), spec.alias("spec")),
    )


def _references(contents: DataFrame, found: Column) -> DataFrame:
    """References worth keeping, with relative ones folded against the directory of their file."""
    spec, kind = F.col("spec"), F.col("kind")
    relative, aliased = spec.startswith("."), spec.rlike("^[@~]/")
    kept = (
        F.when(kind == "es", relative | spec.contains("/"))
        .when(kind == "cjs", relative | aliased)
        .otherwise(~spec.rlike(fixed.HTML_EXTERNAL))
    )
    script = kind.isin("es", "cjs")
    return (
        contents.select("repo_id", F.col("path").alias("src"), F.inline(found))
        .filter(kept)
        .select("repo_id", "src", "ord", "spec", "kind", (script & aliased).alias("is_alias"),
                F.when(script & relative, normalize_relative(spec, dirname(F.col("src")))).otherwise(spec).alias("target"))
    )


def extract_es_imports(contents: DataFrame) -> DataFrame:
    """``import`` and ``export … from`` specifiers; bare package names are dropped."""
    return _references(contents, _found(fixed.ES_IMPORT, "es"))


def extract_cjs_requires(contents: DataFrame) -> DataFrame:
    """``require(...)`` specifiers, relative and aliased ones only."""
    return _references(contents, _found(fixed.CJS_REQUIRE, "cjs"))


def extract_html_refs(contents: DataFrame) -> DataFrame:
    """Local script and stylesheet references, kept as written."""
    return _references(contents, F.concat(_found(fixed.HTML_SCRIPT, "script"), _found(fixed.HTML_LINK, "link")))


def extract_references(contents: DataFrame) -> DataFrame:
    """All references of all files in one pass over the text, by the kind of file."""
    html = F.concat(_found(fixed.HTML_SCRIPT, "script"), _found(fixed.HTML_LINK, "link"))
    code = F.concat(_found(fixed.ES_IMPORT, "es"), _found(fixed.CJS_REQUIRE, "cjs"))
    return _references(contents, F.when(is_html(F.col("path")), html).otherwise(code))


# --- aliases ------------------------------------------------------------------

def parse_aliases(contents: DataFrame) -> DataFrame:
    """Declared path aliases of the root ``tsconfig.json``, in order; unreadable text gives none."""
    clean = F.regexp_replace("content", r"(?s)/\*.*?\*/|//[^\n\r]*", "")
    paths = F.from_json(clean, ALIAS_CONFIG)["compilerOptions"]["paths"]
    return (
        contents.filter(F.col("path") == "tsconfig.json")
        .select("repo_id", F.posexplode(F.map_entries(paths)).alias("ord", "e"))
        .select(
            "repo_id", "ord",
            F.regexp_replace(F.col("e.key"), r"^(.*?)/\*", "$1").alias("prefix"),
            F.regexp_replace(F.get("e.value", F.lit(0)), r"^(.*?)/\*", "$1").alias("target"),
        )
    )


def resolve_alias(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rewrite aliased specifiers: the first declared prefix that fits, or the longest one.

    ``aliases`` is declared order (``parse_aliases``) or longest-first (``build_path_aliases``);
    both number their rows in ``ord``. A distinct specifier asks for its beginnings of just the lengths that some
    prefix has, so the join is on repository and prefix, and a large repository is not one key of it.
    """
    lengths = aliases.agg(F.sort_array(F.collect_set(F.length("prefix")))).scalar()
    asked = (
        raw.filter(F.col("is_alias") & F.col("spec").isNotNull()).select("repo_id", "spec").distinct()
        .withColumn("lengths", lengths)
        .select("repo_id", "spec", F.explode(F.filter("lengths", lambda n: n <= F.length("spec"))).alias("n"))
        .withColumn("prefix", F.expr("substring(spec, 1, n)"))
    )
    hits = (
        asked.join(aliases.select("repo_id", "prefix", "ord", F.col("target").alias("to")), ["repo_id", "prefix"])
        .groupBy("repo_id", "spec").agg(F.min(F.struct("ord", "prefix", "to")).alias("hit"))
        .withColumn("is_alias", F.lit(True))
    )
    swapped = F.concat("hit.to", F.expr("substring(spec, length(hit.prefix) + 1)"))
    return (
        raw.join(hits, ["repo_id", "spec", "is_alias"], "left")
        .withColumn("target", F.when(
            F.col("hit").isNotNull(), F.regexp_replace(swapped, r"^\./", "")).otherwise(F.col("target")))
        .select(*raw.columns)
    )


def build_path_aliases(contents: DataFrame, levels: int | None = None) -> DataFrame:
    """Aliases with inherited configuration: the ``extends`` chain, ``baseUrl``, the implicit ``@/`` of a framework
    configuration file; ``ord`` puts the longest prefix first.

    The chain is followed to its end, or where it would come back; with ``levels``, no further than so many steps up.
    """
    no_lines = F.regexp_replace("content", r"//[^\n]*", "")
    parsed = F.from_json(
        F.regexp_replace(no_lines, r"(?s)/\*.*?\*/", ""), FULL_CONFIG,
        {"columnNameOfCorruptRecord": "_corrupt"},
    )
    configs = (
        contents.filter(F.col("path").endswith("config.json") | F.col("content").contains('"compilerOptions"'))
        .select("repo_id", "path", parsed.alias("c"))
        .filter(F.col("c").isNotNull() & F.col("c._corrupt").isNull())
        .select(
            "repo_id", "path",
            F.when(
                F.col("c.extends").rlike(r"^[./]"),
                F.regexp_replace(F.regexp_replace("c.extends", r"^\./", ""), "^/", ""),
            ).alias("parent"),
            F.col("c.compilerOptions.baseUrl").alias("base_url"),
            F.coalesce(F.map_entries("c.compilerOptions.paths"),
                       F.array().cast("array<struct<key:string,value:array<string>>>")).alias("paths"),
        )
    )
    configs = durable(configs)
    chain = configs.filter(F.col("path").isin("tsconfig.json", "jsconfig.json")).withColumn("seen", F.array("path"))
    step = 0
    while (levels is None or step < levels) and not chain.filter(F.col("parent").isNotNull()).isEmpty():
        step += 1
        up = configs.select(
            "repo_id", F.col("path").alias("parent"), F.col("parent").alias("next_parent"),
            F.col("base_url").alias("up_base"), F.col("paths").alias("up_paths"),
        )
        inherited = F.filter(
            F.coalesce("up_paths", F.array().cast("array<struct<key:string,value:array<string>>>")),
            lambda e: ~F.exists("paths", lambda own: own["key"] == e["key"]),
        )
        chain = durable(chain.join(up, ["repo_id", "parent"], "left").select(
            "repo_id", "path", F.when(~F.array_contains(F.array_append("seen", "parent"), F.col("next_parent")), F.col("next_parent")).alias("parent"),
            F.coalesce("base_url", "up_base").alias("base_url"),
            F.concat("paths", inherited).alias("paths"), F.array_append("seen", "parent").alias("seen"),
        ))
    # tsconfig wins over jsconfig where both can be read
    root = chain.groupBy("repo_id").agg(
        F.max_by(F.struct("base_url", "paths"), "path").alias("c")
    )
    base = F.regexp_replace(F.regexp_replace(F.coalesce("c.base_url", F.lit("")), r"/\z", ""), r"^\./", "")
    bare = F.regexp_replace(F.get("e.value", F.lit(0)), r"\*\z", "")
    target = (
        F.when(bare.rlike(r"^(\./|/|\.\./)"), F.regexp_replace(bare, r"^\./", ""))
        .when(F.col("base") != "", F.regexp_replace(F.concat("base", F.lit("/"), bare), r"^\./", ""))
        .otherwise(bare)
    )
    declared = (
        root.select("repo_id", base.alias("base"), F.posexplode("c.paths").alias("pos", "e"))
        .filter(F.size("e.value") > 0)
        .select("repo_id", "pos", F.regexp_replace("e.key", r"\*\z", "").alias("prefix"), target.alias("target"))
        .groupBy("repo_id", "prefix").agg(F.max_by("target", "pos").alias("target"))
    )
    implicit = (
        contents.filter(F.col("path").isin(fixed.NEXT_CONFIG_FILES)).select("repo_id").distinct()
        .select("repo_id", F.lit("@/").alias("prefix"), F.lit("src/").alias("target"))
        .join(declared.select("repo_id", "prefix"), ["repo_id", "prefix"], "left_anti")
    )
    return declared.unionByName(implicit).select(
        "repo_id", (-F.length("prefix")).alias("ord"), "prefix", "target"
    )


# --- resolution ------------------------------------------------------------------

def _named_files(files: DataFrame) -> DataFrame:
    """(repo_id, key, pos, path): every name an import may use for a file, and how good it is."""
    exts = fixed.RESOLVE_EXTENSIONS
    n = len(exts)
    path = F.col("path")
    last = F.concat(F.lit("."), F.substring_index(path, ".", -1))
    ext = F.when(last.isin(exts) & path.endswith(last), last).otherwise("")
    stem = F.expr("substring(path, 1, length(path) - length(ext))")
    ext_rank = F.array_position(F.array(*[F.lit(e) for e in exts]), F.col("ext")).cast("int")
    keyed = files.select("repo_id", "path").withColumn("ext", ext).withColumn(
        "keys",
        F.array_compact(F.array(
            F.struct(path.alias("key"), F.lit(0).alias("pos")),
            F.when(F.col("ext") != "", F.struct(stem.alias("key"), ext_rank.alias("pos"))),
            F.when((F.col("ext") != "") & F.endswith(stem, F.lit("/index")), F.struct(
                F.expr("substring(path, 1, length(path) - length(ext) - 6)").alias("key"),
                (ext_rank + n).alias("pos"))),
        )),
    )
    return keyed.select("repo_id", "path", F.inline("keys"))


def file_keys(files: DataFrame) -> DataFrame:
    """The best file for every name an import may use: (repo_id, key) → (pos, path)."""
    return (
        _named_files(files)
        .groupBy("repo_id", "key").agg(F.min(F.struct("pos", "path")).alias("best"))
        .select("repo_id", "key", F.col("best.pos").alias("pos"), F.col("best.path").alias("dst"))
    )


def resolve_to_file(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Targets to existing files: the name itself first, then below ``src/``; misses are dropped."""
    wanted = raw.select("repo_id", "src", "target").distinct().select(
        "repo_id", "src", "target",
        F.posexplode(F.array(F.col("target"), F.concat(F.lit("src/"), F.col("target")))).alias("base", "key"),
    )
    return (
        wanted.join(file_keys(files), ["repo_id", "key"])
        .groupBy("repo_id", "src", "target")
        .agg(F.min(F.struct("base", "pos", "dst")).alias("best"))
        .select("repo_id", "src", "target", F.col("best.dst").alias("dst"))
    )


def _resolved_names(references: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(repo_id, is_alias, target) → dst: every distinct name that references use, resolved once.

    An aliased reference has its specifier as target until the alias is applied, so the two columns tell the file.
    """
    names = references.select("repo_id", F.col("target").alias("spec"), "is_alias", "target").distinct()
    wanted = measured(resolve_alias(names, aliases).select(
        "repo_id", "is_alias", "spec",
        F.posexplode(F.array(F.col("target"), F.concat(F.lit("src/"), F.col("target")))).alias("base", "key")))
    found = (
        _named_files(files).join(wanted.for_join(), ["repo_id", "key"])
        .groupBy("repo_id", "is_alias", "spec").agg(F.min(F.struct("base", "pos", "path")).alias("best"))
        .select("repo_id", "is_alias", F.col("spec").alias("target"), F.col("best.path").alias("dst"))
    )
    return measured(found).for_join()


def _layout_edges(files: DataFrame) -> DataFrame:
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("path").rlike(rf"/{kind}\.(tsx|ts|jsx|js)\z"), F.col("path"))).alias(kind)

    per_dir = (
        files.filter(F.col("path").rlike(r"/(page|layout|loading|error)\.(tsx|ts|jsx|js)\z"))
        .groupBy("repo_id", dirname(F.col("path")).alias("dir"))
        .agg(first("page"), *[first(k) for k in fixed.LAYOUT_KINDS])
    )
    return (
        per_dir.filter(F.col("page").isNotNull())
        .select("repo_id", F.col("page").alias("src"),
                F.explode(F.array_compact(F.array(*fixed.LAYOUT_KINDS))).alias("dst"))
    )


def inject_layout_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Per directory, the page file depends on its layout, loading and error files."""
    return edges.select("repo_id", "src", "dst").unionByName(_layout_edges(files)).distinct()


def raw_imports(contents: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All references of all files with aliases applied."""
    aliases = parse_aliases(contents) if aliases is None else aliases
    return resolve_alias(extract_references(contents), aliases)


def build_dependency_graph(
    contents: DataFrame, files: DataFrame, aliases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every scanned file is a node, every resolved reference an edge.

    Many files use the same names, so distinct names are resolved, and references meet the result: they are shuffled at
    most for this join and to make edges distinct. References leave scanned files; only pages may be further nodes.
    """
    aliases = parse_aliases(contents) if aliases is None else aliases
    found = extract_references(contents).select("repo_id", "src", "is_alias", "target")
    # names and edges are read from written references, so texts are searched once
    references = found.sparkSession.read.schema(found.schema).parquet(land(found, "references"))
    resolved = references.join(_resolved_names(references, files, aliases), ["repo_id", "is_alias", "target"])
    edges = inject_layout_edges(resolved, files)
    return graph_nodes(contents, files), edges


def graph_nodes(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path) of every scanned file, and of pages with a layout."""
    return contents.select("repo_id", "path").union(_layout_edges(files).select("repo_id", "src")).distinct()


def sanitize_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop configuration files as sources and targets; remaining targets become nodes."""
    from .inventory import is_config_file

    kept = edges.filter(~is_config_file(F.col("src")) & ~is_config_file(F.col("dst")))
    all_nodes = (
        nodes.filter(~is_config_file(F.col("path"))).select("repo_id", "path")
        .union(kept.select("repo_id", "dst")).distinct()
    )
    return all_nodes, kept


def _presumed(path: Column) -> Column:
    """The path that a test file presumably covers."""
    return F.regexp_replace(
        F.regexp_replace(path, r"(?i)\.(?:test|spec)(\.[jt]sx?)\z", "$1"),
        r"(?i)^(.*?)__(?:tests|mocks)__/", "$1",
    )


def test_coverage_pairs(files: DataFrame) -> DataFrame:
    """(source, test) pairs: the path a test file presumably covers, where that file exists."""
    from .inventory import is_test_file

    path = F.col("path")
    tests = files.filter(is_test_file(path)).select("repo_id", _presumed(path).alias("path"), path.alias("test_path"))
    sources = files.filter(~is_test_file(path)).select("repo_id", "path")
    return tests.join(sources, ["repo_id", "path"]).select("repo_id", "path", "test_path")


def test_coverage_map(files: DataFrame) -> DataFrame:
    """Every non-test file with the number of tests that cover it, counted in one grouping by the path covered."""
    from .inventory import is_test_file

    is_test = is_test_file(F.col("path"))
    pairs = F.when(F.col("repo_id").isNotNull(), F.col("tests") * F.col("sources")).otherwise(0)
    return (
        files.select("repo_id", F.when(is_test, _presumed(F.col("path"))).otherwise(F.col("path")).alias("path"), is_test.alias("is_test"))
        .groupBy("repo_id", "path")
        .agg(F.count_if(F.col("is_test")).alias("tests"), F.count_if(~F.col("is_test")).alias("sources"))
        .filter(F.col("sources") > 0)
        .select("repo_id", "path", (pairs > 0).alias("is_tested"), pairs.alias("n_tests"))
    )
