"""Pull-request impact: secrets, authors, blast radius and the resulting risk."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cochange, content, traversal
from ..session import measured


def pr_impact(pr_files: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, classes): one row per pull request, and one per touched file."""
    classes = traversal.pr_blast(edges, nodes, pr_files)
    counts = classes.groupBy("repo_id", "pr_number").agg(
        F.count_if(F.col("class") == "modified").alias("modified"), F.count_if(F.col("class") == "blast").alias("blast"))
    alerts = content.scan_secrets_pr(pr_files)
    n_alerts = alerts.groupBy("repo_id", "pr_number").agg(F.count(F.lit(1)).alias("alerts"))
    risk = counts.select("repo_id", "pr_number", "modified", "blast",
                         F.lower(traversal.risk_level(F.col("blast"))).alias("risk_level"))
    summary = content.risk_override(risk, alerts).join(n_alerts, ["repo_id", "pr_number"], "left").withColumn(
        "alerts", F.coalesce("alerts", F.lit(0)))
    return summary, classes


def pr_report(pr_files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The impact list of every pull request, alerts in front, each row with the request's risk."""
    summary, classes = pr_impact(pr_files, nodes, edges)
    impacts = classes.select("repo_id", "pr_number", F.lit(0).alias("ord"), F.col("path").alias("file"), F.col("class").alias("impact"))
    listed = content.impact_rows(impacts, content.scan_secrets_pr(pr_files))
    risk = measured(summary.select("repo_id", "pr_number", "risk_level"))
    return listed.join(risk.for_join(), ["repo_id", "pr_number"])


def reviewers(pr_files: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Frequent recent authors of every changed file; files without history say so."""
    top = cochange.top_contributors(commit_files)
    return pr_files.select("repo_id", "pr_number", "path", "status").join(
        top.select("repo_id", "path", "rank", "label"), ["repo_id", "path"], "left"
    ).withColumn("label", F.coalesce("label", F.lit("Unknown/New File")))
