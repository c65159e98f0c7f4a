"""Writers and export views."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..operators.graph_stats import fan_in
from ..operators.traversal import expand


def append_analysis(results: DataFrame, path: str, version: int) -> DataFrame:
    """Append result rows (with owner and repo columns) to the versioned analysis table; returns what was written."""
    rows = analysis_rows(results, version)
    rows.write.mode("append").partitionBy("analysis_version").parquet(path)
    return rows


def analysis_rows(results: DataFrame, version: int) -> DataFrame:
    return results.withColumns({
        "repo_name": F.lower(F.concat_ws("/", "owner", "repo")), "analysis_version": F.lit(version)})


def report_export(reports: DataFrame) -> DataFrame:
    """(repo_id, section, ord, text): the lines of a Markdown report in order of section and ord.

    ``reports(repo_id, owner, repo, analysis)`` holds one nested result document per repository.
    """
    def base(path):
        return F.substring_index(path, "/", -1)

    def block(section: int, title: str, column: str, line) -> DataFrame:
        items = reports.select("repo_id", F.posexplode(f"analysis.{column}").alias("pos", "x"))
        body = items.select("repo_id", F.lit(section).alias("section"), (F.col("pos") + 1).alias("ord"), line.alias("text"))
        head = reports.filter(F.size(f"analysis.{column}") > 0) if column == "blast_radius" else reports
        return head.select("repo_id", F.lit(section).alias("section"), F.lit(0).alias("ord"),
                           F.lit(f"## {title}").alias("text")).unionByName(body)

    x = F.col("x")
    title = reports.select("repo_id", F.lit(0).alias("section"), F.lit(0).alias("ord"),
                           F.concat(F.lit("# Report: "), "owner", F.lit("/"), "repo").alias("text"))
    purpose = reports.select("repo_id", F.lit(1).alias("section"), F.posexplode(
        F.array(F.lit("## System Purpose"), F.col("analysis.what_it_does"))).alias("ord", "text"))
    return (
        title.unionByName(purpose)
        .unionByName(block(2, "Execution Flow", "execution_flow", F.concat(F.col("pos") + 1, F.lit(". "), x)))
        .unionByName(block(3, "Key Modules", "key_modules", F.concat(
            F.lit("- **`"), base(x["file"]), F.lit("`** ("), x["role"], F.lit("): "), x["why_it_exists"])))
        .unionByName(block(4, "Blast Radius (Critical Files)", "blast_radius", F.concat(
            F.lit("- **`"), base(x["file"]), F.lit("`** ("), x["dependents"].cast("bigint"), F.lit(" dependents): "), x["warning"])))
        .unionByName(block(5, "Developer Onboarding Guide", "onboarding_guide", F.concat(F.lit("- "), x)))
    )


def edge_list_export(
    edges: DataFrame, nodes: DataFrame, entries: DataFrame, max_nodes: int | None = None, max_deps: int | None = None,
) -> DataFrame:
    """(repo_id, part, depth, node, dep, line): the lines of a diagram, to be read in the order of these columns.

    Every file met from the entry points shows its dependencies, nearest files first; with ``max_nodes`` and
    ``max_deps`` only the first of each. Repositories without entry points start from files that look like one or have
    a fan-in above two, the first three by path. Part 0 is the head, 1 to 3 the entries, 4 the arrows.
    """
    shown = edges.select("repo_id", "src", "dst").distinct()
    if max_deps is not None:
        deps_order = Window.partitionBy("repo_id", "src").orderBy("dst")
        shown = shown.withColumn("rn", F.row_number().over(deps_order)).filter(F.col("rn") <= max_deps).drop("rn")
    has_entry = entries.select("repo_id").distinct()
    looks = F.col("path").rlike(r"index\.|main\.|page\.|app\.")
    first = Window.partitionBy("repo_id").orderBy("path")
    guessed = (
        nodes.join(has_entry, "repo_id", "left_anti").join(fan_in(edges), ["repo_id", "path"], "left")
        .filter(looks | (F.col("fan_in") > 2))
        .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= 3).select("repo_id", "path")
    )
    seeds = entries.select("repo_id", "path").unionByName(guessed).distinct()
    met = expand(seeds.withColumnRenamed("path", "node"), shown, ["repo_id"], max_depth=max_nodes)
    if max_nodes is not None:
        order = Window.partitionBy("repo_id").orderBy("depth", "node")
        met = met.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max_nodes).drop("rn")

    def clean(name):
        return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")

    def row(part: int, line, depth=None, node=None, dep=None):
        return ["repo_id", F.lit(part).alias("part"), (F.lit(0) if depth is None else depth).alias("depth"),
                (F.lit("") if node is None else node).alias("node"), (F.lit("") if dep is None else dep).alias("dep"), line.alias("line")]

    arrows = met.join(shown.withColumnRenamed("src", "node"), ["repo_id", "node"]).select(*row(
        4, F.concat(F.lit("  "), clean(F.col("node")), F.lit(" --> "), clean(F.col("dst"))), F.col("depth"), F.col("node"), F.col("dst")))
    labels = seeds.select(*row(
        2, F.concat(F.lit("  "), clean(F.col("path")), F.lit('["'), F.substring_index("path", "/", -1), F.lit('"]')), node=F.col("path")))
    head = nodes.select("repo_id").distinct().select(*row(0, F.lit("graph TD")))
    framed = seeds.select("repo_id").distinct()
    return (head.unionByName(framed.select(*row(1, F.lit("subgraph Entry")))).unionByName(labels)
            .unionByName(framed.select(*row(3, F.lit("end")))).unionByName(arrows))


def badge_lookup(repos: DataFrame, analyses: DataFrame) -> DataFrame:
    """Grade, score, status and colour of the latest analysis per repository address."""
    latest = analyses.groupBy("repo_url").agg(
        F.max_by("result_json", F.struct("created_at", "id")).alias("result_json"))
    plain = F.regexp_replace(F.regexp_replace("repo", r"^(.*?)https://github\.com/", "$1"), r"^(.*?)\.git", "$1")
    health = "$.healthMetrics"
    grade = F.get_json_object("result_json", f"{health}.grade")
    known = F.get_json_object("result_json", health).isNotNull()
    color = F.lit(fixed.UNSCANNED[2])
    for row in fixed.GRADES:
        color = F.when(grade == row[1], row[4]).otherwise(color)
    return (
        repos.select("repo").distinct().withColumn("repo_url", F.concat(F.lit("https://github.com/"), plain))
        .join(latest, "repo_url", "left")
        .select(
            "repo", F.when(known, grade).otherwise(fixed.UNSCANNED[0]).alias("grade"),
            F.when(known, F.get_json_object("result_json", f"{health}.score")).otherwise(fixed.UNSCANNED[1]).alias("score"),
            F.when(known, F.coalesce(F.nullif(F.get_json_object("result_json", f"{health}.status"), F.lit("")),
                                     F.lit("Analyzed"))).otherwise(fixed.UNSCANNED[3]).alias("status"),
            F.when(known, color).otherwise(fixed.UNSCANNED[2]).alias("color"))
    )
