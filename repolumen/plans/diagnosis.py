"""Diagnose crashes: traces to located files, surrounding files, budgets and confidence."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph_stats, traces as t, traversal
from ..session import broadcast_limit, durable, measured, written


def diagnose(traces: DataFrame, files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, summary): the files to look at per trace, and one row per trace."""
    info = t.extract_error_info(traces)
    crashes = t.locate_crash(t.parse_frames(traces), files)
    around = durable(traversal.site_traversal(crashes, edges, graph_stats.fan_in(edges)))
    context = t.context_budget(around, crashes, info)
    sure = traversal.by_trace(crashes, t.confidence(around))
    summary = (
        info.join(traces.select("repo_id", "trace_id", t.trace_hash(F.col("trace")).alias("trace_hash")), ["repo_id", "trace_id"])
        .join(crashes.select("repo_id", "trace_id", "path", "line"), ["repo_id", "trace_id"], "left")
        .join(sure, ["repo_id", "trace_id"], "left")
        .select("repo_id", "trace_id", "trace_hash", "error_type", "error_message", "path", "line",
                F.coalesce("confidence", F.lit("low")).alias("confidence"),
                t.requires_runtime_check(F.col("error_type"), F.col("error_message")).alias("needs_runtime_check"))
    )
    return context, summary


def context_snippets(context: DataFrame, contents: DataFrame, crashes: DataFrame | None = None, around: int = 10) -> DataFrame:
    """Numbered lines around the crash for the crash file, cleaned text for the others.

    ``line`` comes with the context, or from ``crashes(repo_id, trace_id, path, line)`` for one without. Texts are cleaned
    once a file, however many traces ask for it, and met last, so that no row is shuffled with a text. Rows of a file
    share a range, and a file of many traces has several: so a range has few texts, and columnar files store each once,
    which they cannot with the texts of all files in the order of traces.
    """
    from ..operators.content import strip_comment_lines

    rows = context.withColumnRenamed("file", "path")
    if "line" not in rows.columns:
        rows = rows.join(crashes.select("repo_id", "trace_id", "path", "line"), ["repo_id", "trace_id", "path"], "left")
    # without texts, read for the files asked for, for the ranges and for the result
    rows = written(rows, "context")
    asked = measured(rows.groupBy("repo_id", "path").agg(F.max(F.col("line").isNotNull()).alias("whole")))
    missing = F.lit("// Content not available")
    texts = measured(
        contents.select("repo_id", "path", "content").join(asked.for_join(), ["repo_id", "path"])
        .select("repo_id", "path", F.when(F.col("whole"), F.coalesce("content", missing)).alias("content"),
                strip_comment_lines(F.coalesce("content", missing)).alias("cleaned")))
    if texts.bytes <= broadcast_limit(rows.sparkSession):  # else the join itself puts the rows of a file together
        # rows are small before they meet their texts: a fixed number of ranges, which are not merged
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, "repo_id", "path", "trace_id")
    met = rows.join(texts.for_join(), ["repo_id", "path"], "left").withColumn("content", F.coalesce("content", missing))
    snippet = F.when(F.col("line").isNotNull(), F.col("snippet")).otherwise(
        F.coalesce("cleaned", strip_comment_lines(missing)))
    return t.line_context(met, around).select("repo_id", "trace_id", "path", "relationship", "distance", snippet.alias("snippet"))
