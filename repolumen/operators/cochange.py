"""Co-change mining over commit histories."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_half_up


#: Files of one commit that are paired with the others in one task.
FILES_PER_SHARE = 256


def commit_pairs(commit_files: DataFrame) -> DataFrame:
    """Unordered file pairs of each commit.

    The many commits of a hub file spread over the hash of (repo_id, sha). A mass commit is dealt in shares: each of
    its files stands on the left in one share and on the right in all, so its pairs are made by many tasks.
    """
    files = commit_files.select("repo_id", "sha", "path").distinct()
    shares = files.groupBy("repo_id", "sha").agg(F.ceil(F.count(F.lit(1)) / FILES_PER_SHARE).cast("int").alias("shares"))
    dealt = files.join(shares, ["repo_id", "sha"])
    left = dealt.select("repo_id", "sha", F.col("path").alias("a"), F.pmod(F.xxhash64("path"), "shares").cast("int").alias("share"))
    right = dealt.select("repo_id", "sha", F.col("path").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return left.join(right, ["repo_id", "sha", "share"]).filter(F.col("a") < F.col("b")).select("repo_id", "sha", "a", "b")


def pair_counts(commit_files: DataFrame, min_count: int = 1) -> DataFrame:
    return commit_pairs(commit_files).groupBy("repo_id", "a", "b").agg(
        F.count(F.lit(1)).alias("co_change_count")).filter(F.col("co_change_count") >= min_count)


def without_import_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) minus those joined by an import in either direction."""
    explicit = edges.select("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(explicit, ["repo_id", "a", "b"], "left_anti")


def implicit_coupling(
    commit_files: DataFrame, edges: DataFrame, min_co_change_count: int = 3, min_jaccard: float = 0.1,
    min_confidence: float = 0.1, max_results: int = 0,
) -> DataFrame:
    """Files that change together without importing one another, strongest direction first.

    Files seen in fewer than ``min_co_change_count`` commits cannot form a pair and leave before
    the self-join. ``max_results`` > 0 keeps the best pairs per repository.
    """
    files = commit_files.select("repo_id", "sha", "path").distinct()
    counts = files.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("c"))
    frequent = counts.filter(F.col("c") >= min_co_change_count)
    totals = files.groupBy("repo_id").agg(F.countDistinct("sha").alias("commits"))
    pairs = pair_counts(files.join(frequent, ["repo_id", "path"], "left_semi"), min_co_change_count)
    co, ca, cb = F.col("co_change_count"), F.col("ca"), F.col("cb")
    a_first = co / ca >= co / cb
    scored = (
        without_import_pairs(pairs, edges)
        .join(frequent.select("repo_id", F.col("path").alias("a"), F.col("c").alias("ca")), ["repo_id", "a"])
        .join(frequent.select("repo_id", F.col("path").alias("b"), F.col("c").alias("cb")), ["repo_id", "b"])
        .join(totals, "repo_id")
        .select(
            "repo_id",
            F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("file_a"),
            F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("file_b"),
            F.greatest(co / ca, co / cb).alias("confidence"),
            F.least(co / ca, co / cb).alias("reverse_confidence"),
            "co_change_count",
            (co / (ca + cb - co)).alias("jaccard"),
            (co / F.col("commits")).alias("support"),
        )
        .filter((F.col("confidence") >= min_confidence) & (F.col("jaccard") >= min_jaccard))
    )
    if max_results <= 0:
        return scored
    best = Window.partitionBy("repo_id").orderBy(F.desc("jaccard"), F.desc("co_change_count"), "file_a", "file_b")
    return scored.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= max_results).drop("rn")


def ghost_edges(coupling: DataFrame) -> DataFrame:
    """Edge rows for drawing coupling next to the import graph."""
    separator = F.char(F.lit(0))
    return coupling.select(
        "repo_id",
        F.concat(F.lit("ghost::"), F.least("file_a", "file_b"), separator, F.greatest("file_a", "file_b")).alias("id"),
        F.col("file_a").alias("source"), F.col("file_b").alias("target"), F.col("jaccard").alias("weight"),
        F.concat(round_half_up(F.col("confidence") * 100), F.lit("% co-change · "),
                 F.col("co_change_count"), F.lit("×")).alias("label"),
    )


def top_contributors(commit_files: DataFrame, recent: int = 10, k: int = 3) -> DataFrame:
    """Most frequent authors among the last ``recent`` commits touching each path."""
    last = Window.partitionBy("repo_id", "path").orderBy(F.desc("committed_at"), F.desc("sha"))
    best = Window.partitionBy("repo_id", "path").orderBy(F.desc("n"), "login")
    return (
        commit_files.select("repo_id", "path", "sha", "author", "committed_at").distinct()
        .withColumn("rn", F.row_number().over(last)).filter(F.col("rn") <= recent)
        .filter(F.col("author").isNotNull())
        .groupBy("repo_id", "path", F.col("author").alias("login")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .withColumn("label", F.concat("login", F.lit(" ("), "n", F.lit(" recent commits)")))
    )
