"""One-pass statistics over nodes and edges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import dirname, round_half_up
from ..session import with_repo_values, written


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))


def _ends(edges: DataFrame) -> DataFrame:
    """Both endpoints of every edge as (repo_id, path, efferent, afferent) rows of ones and zeros."""
    ends = F.array(
        F.struct(F.col("src").alias("path"), F.lit(1).alias("efferent"), F.lit(0).alias("afferent")),
        F.struct(F.col("dst").alias("path"), F.lit(0).alias("efferent"), F.lit(1).alias("afferent")),
    )
    return edges.select("repo_id", F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every endpoint from one shuffle of the doubled edge list."""
    return _ends(edges).groupBy("repo_id", "path").agg(
        F.sum("efferent").alias("efferent"), F.sum("afferent").alias("afferent"))


def union_nodes(edges: DataFrame) -> DataFrame:
    """Keys and targets of the edge list; empty targets are ignored."""
    return (
        edges.select("repo_id", F.explode(F.array("src", "dst")).alias("path"))
        .filter(F.col("path") != "").distinct()
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["repo_id", "path"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return difference(nodes, edges.select("repo_id", F.explode(F.array("src", "dst")).alias("path")))


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both endpoints in the node set."""
    return edges.join(
        members.select("repo_id", F.col("path").alias("src")), ["repo_id", "src"], "left_semi"
    ).join(members.select("repo_id", F.col("path").alias("dst")), ["repo_id", "dst"], "left_semi")


def stability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ca, Ce, instability, label and zone per file; targets that are no keys count as files."""
    ca, ce, i = F.col("afferent"), F.col("efferent"), F.col("instability")
    zeros = nodes.select("repo_id", "path", F.lit(0).alias("efferent"), F.lit(0).alias("afferent"))
    return (
        _ends(edges).unionByName(zeros).groupBy("repo_id", "path")
        .agg(F.sum("afferent").alias("afferent"), F.sum("efferent").alias("efferent"))
        .withColumn("instability", F.when(ca + ce == 0, F.lit(0.5)).otherwise(ce / (ca + ce)))
        .withColumn("label", F.when(i < 0.3, "stable").when(i > 0.7, "unstable").otherwise("balanced"))
        .withColumn(
            "zone",
            F.when((i < 0.3) & (ce > 3), "pain").when((i > 0.7) & (ca == 0), "uselessness")
            .when((i >= 0.3) & (i <= 0.7), "main-sequence").otherwise("balanced"),
        )
    )


def stability_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.avg("instability").alias("avg_instability"),
                                        F.count(F.lit(1)).alias("files"))


def stability_extremes(files: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most unstable and the ``k`` most stable files of every repository."""
    def ranked(order: list, name: str) -> DataFrame:
        return (
            files.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
            .filter(F.col("rank") <= k)
            .select("repo_id", F.lit(name).alias("side"), "rank", "path", "instability")
        )

    # the stable side is the tail of the unstable order read backwards
    return ranked([F.desc("instability"), "path"], "most_unstable").unionByName(
        ranked([F.asc("instability"), F.desc("path")], "most_stable")
    )


def stability_zone_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.count_if(F.col("zone") == "pain").alias("pain"),
        F.count_if(F.col("zone") == "uselessness").alias("uselessness"),
        F.count_if(F.col("instability") > 0.7).alias("unstable"),
    )


def stability_plot(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Plot class, Ca scaled by the repository's maximum (at least 1) and the zone tag,
    which entry points do not carry."""
    is_entry = entries.select("repo_id", "path").distinct().withColumn("is_entry", F.lit(True))
    # the statistics are grouped by file once; the peak and the rows are read from what is written
    marked = written(files.join(is_entry, ["repo_id", "path"], "left").select(
        "repo_id", "path", "afferent", "instability", "zone", "is_entry"), "marked")
    peak = marked.groupBy("repo_id").agg(F.greatest(F.max("afferent"), F.lit(1)).alias("max_ca"))
    return (
        with_repo_values(marked, peak)
        .select(
            "repo_id", "path", "instability",
            (F.col("afferent") / F.col("max_ca")).alias("ca_scaled"),
            F.when(F.col("zone") == "pain", "pain").when(F.col("zone") == "uselessness", "uselessness")
            .when(F.col("instability") > 0.5, "unstable").otherwise("healthy").alias("plot_class"),
            F.when(F.col("is_entry").isNull(), F.col("zone")).alias("zone_tag"),
        )
    )


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Is the graph of a repository worth drawing?"""
    marks = _ends(edges).select("repo_id", "path", F.lit(0).alias("is_node"), F.lit(1).alias("touched")).union(
        nodes.select("repo_id", "path", F.lit(1), F.lit(0)))
    per_repo = (
        marks.groupBy("repo_id", "path").agg(F.max("is_node").alias("is_node"), F.max("touched").alias("touched"))
        .filter("is_node = 1").groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("total_nodes"), F.sum("touched").alias("connected"))
    )
    n_edges = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
    orphan, share = F.col("orphan_count"), F.col("connectedness")
    return (
        per_repo.join(n_edges, "repo_id", "left")
        .withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
        .withColumn("orphan_count", F.col("total_nodes") - F.col("connected"))
        .withColumn("connectedness", F.col("connected") / F.col("total_nodes"))
        .withColumn("is_useful", (F.col("edge_count") >= 2) & (share >= 0.2))
        .withColumn(
            "diagnosis",
            F.when(F.col("edge_count") == 0, "No import relationships found between files. "
                   "This repo may not use ES module imports.")
            .when(share < 0.2, F.concat(orphan, F.lit(" of "), "total_nodes", F.lit(
                " files are isolated (no imports/importers). The graph is too sparse to be useful.")))
            .when(share < 0.4, F.concat(F.lit("Graph is partially connected — "), "connected", F.lit(" of "),
                                        "total_nodes", F.lit(" files have dependencies. Some areas may appear sparse.")))
            .otherwise(F.concat(F.lit("Graph looks healthy — "), "connected", F.lit(" connected nodes, "),
                                "edge_count", F.lit(" edges."))),
        )
        .select("repo_id", "connectedness", "is_useful", "diagnosis", "orphan_count", "total_nodes", "edge_count")
    )


def repo_meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tagged = nodes.select("repo_id", F.lit(1).alias("n"), F.lit(0).alias("e")).union(
        edges.select("repo_id", F.lit(0), F.lit(1))
    )
    return tagged.groupBy("repo_id").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def health_grade(files: DataFrame, fan_in_rows: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Score 0–100 and grade per repository; ``cycles(repo_id, cycle_count)`` defaults to none."""
    base = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("size") > fixed.LARGE_FILE_BYTES).alias("large_files"),
    )
    peak = fan_in_rows.groupBy("repo_id").agg(F.max("fan_in").alias("max_fan_in"))
    joined = base.join(peak, "repo_id", "left").withColumn("max_fan_in", F.coalesce("max_fan_in", F.lit(0)))
    if cycles is None:
        joined = joined.withColumn("cycle_count", F.lit(0))
    else:
        joined = joined.join(cycles.select("repo_id", "cycle_count"), "repo_id", "left").withColumn(
            "cycle_count", F.coalesce("cycle_count", F.lit(0)))
    penalty = F.when(F.col("max_fan_in") > 10, F.least(F.lit(30), (F.col("max_fan_in") - 10) * 2)).otherwise(0)
    raw = (
        F.lit(100) - F.col("cycle_count") * 15 - penalty
        - F.col("large_files") / F.greatest(F.lit(1), F.col("total_files")) * 40
    )
    scored = joined.withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(raw))).cast("int"))
    return scored.select(
        "repo_id", "total_files", "large_files", "max_fan_in", "cycle_count", "score",
        *[_by_grade(pos).alias(name) for name, pos in (("grade", 1), ("status", 2), ("color", 3))],
    )


def _by_grade(pos: int) -> Column:
    out = None
    for row in fixed.GRADES[:-1]:
        rule = F.col("score") >= row[0]
        out = F.when(rule, row[pos]) if out is None else out.when(rule, row[pos])
    return out.otherwise(fixed.GRADES[-1][pos])


def with_defaults(rows: DataFrame, values: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every row with its values, or the defaults where there are none."""
    return rows.join(values.select(*on, *defaults), on, "left").fillna(defaults)


def coverage_gaps(fan_in_rows: DataFrame, coverage: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """Untested files weighted by PageRank (70 %) and fan-in (30 %), top ``k`` per repository."""
    tested = F.coalesce("is_tested", F.lit(False))
    score = F.coalesce("score", F.lit(0)).cast("double")
    risk = F.when(tested, F.lit(0)).otherwise(
        round_half_up(score * F.lit(0.7) + F.col("fan_in") * F.lit(0.3)))
    top = Window.partitionBy("repo_id").orderBy(F.desc("risk_score"), "path")
    on = ["repo_id", "path"]
    known = with_defaults(with_defaults(fan_in_rows, coverage, on, {"is_tested": False}), ranks, on, {"score": 0})
    return (
        known.select("repo_id", "path", "fan_in", tested.alias("is_tested"), score.alias("page_rank_score"),
                risk.cast("bigint").alias("risk_score"))
        .filter(F.col("risk_score") > 0)
        .withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    )


def dead_code_by_directory(unreachable: DataFrame) -> DataFrame:
    """Number of unreachable files per directory; the files themselves stay rows of the input."""
    return unreachable.groupBy("repo_id", dirname(F.col("path"), "(root)").alias("dir")).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def hub_nodes(edges: DataFrame) -> DataFrame:
    """Total degree per node; a hub has more than half of the repository's maximum."""
    per_node = written(degrees(edges).select(
        "repo_id", "path", (F.col("efferent") + F.col("afferent")).alias("degree")), "degrees")
    peak = per_node.groupBy("repo_id").agg(F.max("degree").alias("max_degree"))
    return with_repo_values(per_node, peak).select(
        "repo_id", "path", "degree", (F.col("degree") > F.col("max_degree") * F.lit(0.5)).alias("is_hub")
    )


def blast_targets(fan_in_rows: DataFrame, k: int = 3) -> DataFrame:
    top = Window.partitionBy("repo_id").orderBy(F.desc("fan_in"), "path")
    return (
        fan_in_rows.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        .select("repo_id", "rank", "path", "fan_in")
    )


def rank_articulation(points: DataFrame) -> DataFrame:
    """Severity by rank (first critical, second high, rest medium) and percent of the largest fragment.

    Only the two leading ranks matter, so they are taken as a limited top-2 and joined back;
    order the result by ``fragment_size`` descending and ``path`` for the ranked list.
    """
    order = Window.partitionBy("repo_id").orderBy(F.desc("fragment_size"), "path")
    lead = (
        points.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
        .select("repo_id", "path", "rank")
    )
    peak = points.groupBy("repo_id").agg(F.max("fragment_size").alias("peak"))
    rank = F.col("rank")
    return with_repo_values(points, peak).join(lead, ["repo_id", "path"], "left").select(
        "repo_id", "path", "fragment_size",
        F.when(rank == 1, "critical").when(rank == 2, "high").otherwise("medium").alias("severity"),
        round_half_up(F.col("fragment_size") / F.col("peak") * 100).cast("int").alias("pct"),
    )


def pagerank_tier(score: Column) -> Column:
    return F.when(score >= 70, 3).when(score >= 40, 2).when(score >= 15, 1).otherwise(0)


def pagerank_top(ranks: DataFrame, k: int = 20) -> DataFrame:
    top = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    return (
        ranks.withColumn("rank_no", F.row_number().over(top)).filter(F.col("rank_no") <= k)
        .select("repo_id", "rank_no", "path", "score", pagerank_tier(F.col("score")).alias("tier"))
    )


def hot_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges with a flag: hot when either endpoint is in tier 2 or 3."""
    high = ranks.filter(pagerank_tier(F.col("score")) >= 2).select("repo_id", "path")
    src = high.select("repo_id", F.col("path").alias("src"), F.lit(True).alias("s"))
    dst = high.select("repo_id", F.col("path").alias("dst"), F.lit(True).alias("d"))
    return (
        edges.join(src, ["repo_id", "src"], "left").join(dst, ["repo_id", "dst"], "left")
        .select("repo_id", "src", "dst", (F.col("s").isNotNull() | F.col("d").isNotNull()).alias("is_hot"))
    )


def betweenness_severity(score: Column) -> Column:
    return F.when(score >= 0.15, "critical").when(score >= 0.07, "high").when(score >= 0.01, "medium").otherwise("low")
