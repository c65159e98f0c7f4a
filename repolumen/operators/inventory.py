"""File inventory: skip rules, classification, ranking, repository type and size views.

Row-wise rules are column expressions, so they fuse into the scan stage. Per-repository
results use partial aggregation; ranked lists are ``row_number() <= k``, which Spark limits
per task before the shuffle, so one repository holding most rows does not pile up in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import (
    any_literal, any_pattern, basename, depth, extension, round_half_up,
)


def should_skip_file(path: Column, size: Column, max_bytes: int | None = None) -> Column:
    """By name; by size only where a limit is given."""
    too_large = F.lit(False) if max_bytes is None else F.coalesce(size > max_bytes, F.lit(False))
    return (
        path.rlike("(?:^|/)" + any_literal(fixed.SKIP_DIRECTORIES) + "/")
        | path.rlike(any_pattern(fixed.SKIP_DIRECTORY_PATTERNS))
        | path.rlike(any_literal(fixed.SKIP_EXTENSIONS) + r"\z")
        | path.rlike("(?i)" + any_pattern(fixed.SKIP_NAME_PATTERNS))
        | too_large
    )


def is_ignored_path(path: Column) -> Column:
    return path.rlike(any_literal(fixed.IGNORED_SUBSTRINGS)) | path.rlike(
        any_literal(fixed.IGNORED_EXTENSIONS) + r"\z"
    )


def graph_node_strength(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(fixed.STRONG_NODE_EXTENSIONS), "strong")
        .when(ext.isin(fixed.WEAK_NODE_EXTENSIONS), "weak")
        .otherwise("none")
    )


def is_test_file(path: Column) -> Column:
    return path.rlike(fixed.TEST_FILE_PATTERN) | path.rlike(fixed.TEST_DIRECTORY_PATTERN)


def is_config_file(path: Column) -> Column:
    return path.rlike(fixed.CONFIG_FILE_PATTERN)


def filter_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return files.filter(~should_skip_file(F.col("path"), F.col("size"), max_bytes))


def filter_graph_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return filter_files(files, max_bytes).filter(graph_node_strength(F.col("path")) != "none")


def classify_and_score(files: DataFrame) -> DataFrame:
    """Add ``score`` and ``role``; for the role the later rule wins (test, config, entry)."""
    path = F.col("path")
    entry = basename(path).isin(fixed.ENTRY_NAMES)
    config_words = any_literal(fixed.CONFIG_NAMES)
    config = path.rlike(r"(?:^|/)" + config_words + r"[^/]*\z") | path.rlike(config_words + r"\z")
    test = path.rlike(any_literal(fixed.TEST_WORDS))
    sample = path.rlike("^(?:examples|demo|sample)/")
    levels = depth(path)

    def points(rule: Column, n: int) -> Column:
        return F.when(rule, n).otherwise(0)

    score = (
        points(entry, 10) + points(config, 6) + points(test, -4) + points(levels == 1, 3)
        + points(path.rlike("^(?:src|lib)/"), 2) + points(levels > 4, -2) + points(sample, -5)
    )
    role = (
        F.when(test, "test").when(config, "config").when(entry & ~sample, "entry").otherwise("other")
    )
    return files.withColumns({"score": score.cast("int"), "role": role})


def boost_entry_points(scored: DataFrame) -> DataFrame:
    html = F.col("path").endswith(".html")
    return scored.withColumns({
        "score": F.when(html, F.col("score") + 500).otherwise(F.col("score")),
        "role": F.when(html, "entry").otherwise(F.col("role")),
    })


def top_files(scored: DataFrame, limit: int = 30, max_entries: int = 8) -> DataFrame:
    """Best files per repository: up to ``max_entries`` entries, the rest by score.

    The first window keeps at most ``limit`` rows per (repository, kind), so the window that
    fits both kinds together sees a bounded number of rows.
    """
    best = Window.partitionBy("repo_id", "is_entry").orderBy(F.desc("score"), "path")
    ranked = (
        scored.filter((F.col("role") != "test") & ~F.col("path").endswith(".md"))
        .withColumn("is_entry", F.col("role") == "entry")
        .withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= max(limit, max_entries))
        .filter(~F.col("is_entry") | (F.col("rn") <= max_entries))
    )
    entries = F.sum(F.col("is_entry").cast("int")).over(Window.partitionBy("repo_id"))
    position = F.when(F.col("is_entry"), F.col("rn")).otherwise(F.col("rn") + F.col("entries"))
    return (
        ranked.withColumn("entries", entries)
        .withColumn("position", position.cast("int"))
        .filter(F.col("is_entry") | (F.col("rn") <= limit - F.col("entries")))
        .select("repo_id", "position", "path", "score", "role")
    )


def entry_points(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Every entry file; with ``k`` the first by path of each repository."""
    entries = scored.filter(F.col("role") == "entry")
    if k is None:
        return entries.select("repo_id", "path")
    first = Window.partitionBy("repo_id").orderBy("path")
    return entries.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k).select("repo_id", "path")


def upload_prioritize(contents: DataFrame, k: int | None = None) -> DataFrame:
    """Archive intake: drop blocked and blank files; with ``k`` keep the shallowest of each repository."""
    path = F.col("path")
    blocked = path.rlike(any_literal(fixed.UPLOAD_BLOCKED_DIRECTORIES)) | F.lower(path).rlike(
        any_literal(fixed.UPLOAD_BLOCKED_EXTENSIONS) + r"\z"
    )
    shallow = Window.partitionBy("repo_id").orderBy("path_depth", "path")
    kept = contents.filter(~blocked & F.col("content").rlike(r"\S")).select(
        "repo_id", "path", depth(path).cast("int").alias("path_depth"))
    return kept if k is None else kept.withColumn("rn", F.row_number().over(shallow)).filter(F.col("rn") <= k).drop("rn")


# --- repository type ---------------------------------------------------------

def detect_repo_type(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per repository: dominant language, JS share and whether a graph makes sense."""
    path = F.col("path")
    ext = extension(path)
    counted = (ext != "") & ~path.rlike("(?:^|/)" + any_literal(fixed.SKIP_DIRECTORIES) + "/")
    counts = files.filter(counted).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ext.isin(fixed.STRONG_NODE_EXTENSIONS)).alias("js_node_count"),
        *[F.count_if(ext.isin(exts)).alias(lang) for lang, exts in fixed.LANGUAGE_EXTENSIONS.items()],
    )
    languages = list(fixed.LANGUAGE_EXTENSIONS)
    if repos is not None:
        counts = repos.select("repo_id").distinct().join(counts, "repo_id", "left").fillna(0)
    # smallest (-count, name) = most files, ties by name
    lead = F.array_min(F.array(*[
        F.struct((-F.col(lang)).alias("neg"), F.lit(lang).alias("name")) for lang in languages
    ]))
    total, js = F.col("total_files"), F.col("js_node_count")
    typed = (
        counts.withColumn("language", F.when(lead["neg"] < 0, lead["name"]).otherwise("unknown"))
        .withColumn("js_ratio", F.when(total == 0, F.lit(0.0)).otherwise(
            (F.col("typescript") + F.col("javascript")) / total))
        .withColumn("is_graphable", (js >= 3) & (F.col("js_ratio") >= 0.05))
    )
    lang, ratio = F.col("language"), F.col("js_ratio")
    reason = (
        F.when(total == 0, "No files found in repository.")
        .when(~F.col("is_graphable") & (js == 0), F.concat(
            F.lit("This appears to be a "), lang,
            F.lit(" repository with no JavaScript/TypeScript files. Dependency graph requires JS/TS imports.")))
        .when(~F.col("is_graphable") & (js < 3), F.concat(
            F.lit("Only "), js, F.lit(" JS/TS file(s) found — not enough to build a meaningful dependency graph.")))
        .when(~F.col("is_graphable"), F.concat(
            F.lit("JS/TS files make up only "), round_half_up(ratio * 100),
            F.lit("% of this repo. The dependency graph would be mostly disconnected.")))
        .when(~lang.isin("typescript", "javascript"), F.concat(
            F.lit("Mixed repo (dominant: "), lang,
            F.lit("). Only JS/TS files will appear in the dependency graph — "), js, F.lit(" of "), total,
            F.lit(" files.")))
    )
    return typed.withColumn("reason", reason).select(
        "repo_id", "language", "js_ratio", "is_graphable", "reason", "total_files", "js_node_count"
    )


# --- size views ----------------------------------------------------------------

def nearest_rank(values: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group the value at zero-based rank ``floor(fraction * n)`` of the ascending order.

    Two counting steps in place of one sort per group: first over coarse buckets (the leading
    ten bits of the value, so a group has at most some thousands), then over the values of the
    few buckets that hold a wanted rank.
    """
    v = F.col(value).cast("bigint")
    low_bits = F.greatest(F.length(F.bin(F.col("v"))) - 10, F.lit(0))
    step = F.pow(F.lit(2.0), low_bits)
    bucketed = values.select(*keys, v.alias("v")).withColumn("bucket", F.floor(F.col("v") / step) * step)
    counts = bucketed.groupBy(*keys, "bucket", "v").agg(F.count(F.lit(1)).alias("n"))
    coarse = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    marks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.floor(F.col("total") * F.lit(f)).alias("rank"))
        for name, f in fractions.items()
    ])
    wanted = (
        coarse.withColumn("upto", F.sum("n").over(order))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("mark", F.explode(marks))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter((F.col("mark.rank") >= F.col("before")) & (F.col("mark.rank") < F.col("upto")))
        .select(*keys, "bucket", F.col("mark.name").alias("name"), (F.col("mark.rank") - F.col("before")).alias("rank"))
    )
    inside = Window.partitionBy(*keys, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(wanted, [*keys, "bucket"])
        .withColumn("upto", F.sum("n").over(inside))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    )
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions
    ])


def size_heat_bucket(files: DataFrame) -> DataFrame:
    cuts = nearest_rank(files, ["repo_id"], "size", {"p66": 0.66, "p90": 0.9})
    size = F.col("size")
    return files.join(cuts, "repo_id").select(
        "repo_id", "path", "size",
        F.when(size >= F.col("p90"), "red").when(size >= F.col("p66"), "yellow").otherwise("green").alias("bucket"),
    )


def loc_estimate(size: Column) -> Column:
    return F.greatest(F.lit(1), round_half_up(size / 30)).cast("bigint")


def weight_by_folder(files: DataFrame) -> DataFrame:
    """Files, bytes and estimated lines per top folder; dust (at most 0.05 % of all bytes) is left out."""
    totals = files.groupBy("repo_id").agg(
        F.sum("size").alias("total_size"), F.sum(loc_estimate(F.col("size"))).alias("total_loc")
    )
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("root")
    return (
        files.join(totals, "repo_id")
        .filter(F.col("size") > F.col("total_size") * F.lit(0.0005))
        .groupBy("repo_id", folder.alias("folder"), "total_loc")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"),
             F.sum(loc_estimate(F.col("size"))).alias("loc"))
        .select("repo_id", "folder", "files", "size", "loc", "total_loc")
    )


def directory_tree(files: DataFrame) -> DataFrame:
    """Every prefix of every path as a tree node with its parent (the root has none)."""
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.struct(
            F.concat_ws("/", F.lit("root"), F.slice(parts, 1, i)).alias("node"),
            (i < F.size(parts)).alias("is_folder"),
        ),
    )
    nodes = (
        files.select("repo_id", F.explode(prefixes).alias("p"))
        .groupBy("repo_id", F.col("p.node").alias("node"))
        .agg(F.max("p.is_folder").alias("is_folder"))
    )
    parent = F.when(F.instr("node", "/") > 0, F.regexp_extract("node", r"^(.*)/[^/]*\z", 1))
    return nodes.select("repo_id", "node", basename(F.col("node")).alias("name"), parent.alias("parent"), "is_folder")


def tree_links(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("parent").isNotNull()).select(
        "repo_id", F.col("parent").alias("source"), F.col("node").alias("target")
    )


def tree_highlight(tree: DataFrame, selected: Column) -> DataFrame:
    """Mark the selected node, its ancestors and its subtree."""
    node = F.col("node")
    active = (
        (node == selected)
        | F.startswith(selected, F.concat(node, F.lit("/")))
        | F.startswith(node, F.concat(selected, F.lit("/")))
    )
    return tree.withColumn("is_active", active)
