"""Readers for landed listings, contents, histories and pull requests, with explicit schemas."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def read_landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Parquet, ORC, JSON or CSV with a given schema; broken JSON rows land in ``_corrupt_record``."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE")
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def read_source_tree(spark: SparkSession, glob: str, root: str, repo_id: str) -> DataFrame:
    """Whole text files below ``root`` as (repo_id, path, content)."""
    # file addresses are percent-encoded; a plus sign stands for itself
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(address, r"^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return spark.read.text(glob, wholetext=True).select(
        F.lit(repo_id).alias("repo_id"), name.alias("path"), F.col("value").alias("content"))


def scan_file_tree(tree: DataFrame) -> DataFrame:
    """Files of a tree listing; a missing size counts as zero."""
    return tree.filter(F.col("type") == "blob").select(
        "repo_id", "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def decode_content(content: Column, encoding: Column) -> Column:
    return F.when(encoding == "base64", F.decode(F.unbase64(F.regexp_replace(content, "\n", "")), "UTF-8")).otherwise(content)


def truncate_lines(text: Column, max_lines: int) -> Column:
    """The first ``max_lines`` lines with their line breaks."""
    head = F.substring_index(text, "\n", max_lines)
    return F.when(F.length(head) < F.length(text), F.concat(head, F.lit("\n"))).otherwise(text)


def scan_sources(encoded: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Decoded contents; whole by default."""
    text = decode_content(F.col("content"), F.col("encoding"))
    out = encoded.select("repo_id", "path", text.alias("content"))
    return out if max_lines is None else out.withColumn("content", truncate_lines(F.col("content"), max_lines))


def normalize_uploaded(rows: DataFrame) -> DataFrame:
    """Uploaded files with safe relative paths; rows without path or content are dropped."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\.\.[/\\]", ""), r"^[/\\]+", "")
    return (
        rows.filter(F.col("path").isNotNull() & F.col("content").isNotNull())
        .select("repo_id", clean.alias("path"), "content").filter(F.col("path") != "")
    )


def explode_commits(commits: DataFrame) -> DataFrame:
    """Nested commit documents to one row per listed file."""
    return commits.select("repo_id", "sha", "committed_at", "author", F.inline("files")).select(
        "repo_id", "sha", "committed_at", "author", F.col("filename").alias("path"), "status")


def scan_commits(commit_files: DataFrame, max_commits: int | None = None, max_files: int | None = None) -> DataFrame:
    """Commits fit for co-change mining: removed files left out, at least two files remaining.

    Optionally only the newest ``max_commits`` per repository, and only commits that list fewer than ``max_files``
    files, for sources that truncate longer lists.
    """
    kept = F.col("status") != "removed"
    fit = (
        commit_files.groupBy("repo_id", "sha", "committed_at")
        .agg(F.count(F.lit(1)).alias("listed"), F.count_if(kept).alias("left"))
        .filter(F.col("left") >= 2)
    )
    if max_files is not None:
        fit = fit.filter(F.col("listed") < max_files)
    if max_commits is not None:
        newest = Window.partitionBy("repo_id").orderBy(F.desc("committed_at"), F.desc("sha"))
        fit = fit.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= max_commits)
    return (
        commit_files.filter(kept).join(fit.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
        .select("repo_id", "sha", "committed_at", "author", "path", "status")
    )


def parse_pr_url(url: Column) -> Column:
    pattern = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"
    parts = [F.nullif(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2, 3)]
    return F.struct(parts[0].alias("owner"), parts[1].alias("repo"), parts[2].cast("bigint").alias("pr_number"))


def scan_pr_files(pulls: DataFrame) -> DataFrame:
    """Changed files of landed pull requests; rows whose URL is no pull request are dropped."""
    return (
        pulls.withColumn("u", parse_pr_url(F.col("url"))).filter(F.col("u.pr_number").isNotNull())
        .select(F.concat_ws("/", "u.owner", "u.repo").alias("repo_id"), F.col("u.pr_number").alias("pr_number"), F.inline("files"))
        .select("repo_id", "pr_number", F.col("filename").alias("path"), "status", "additions", "changes", "patch")
    )


def parse_repo_url(url: Column) -> Column:
    """``owner/repo`` or a full URL to (owner, repo); both are null when it is neither."""
    full = url.startswith("http")
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1), r"^/|/\z", "")
    parts = F.split(F.when(full, path).otherwise(url), "/")
    fits = F.size(parts) >= 2
    return F.struct(
        F.when(fits, parts[0]).alias("owner"),
        F.when(fits, F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git\z", "")).alias("repo"),
    )
