"""Commit history and pull-request queries."""
from pyspark.sql import functions as F

from ..operators import cochange as cc
from ..plans import history, pull_request
from ..sources import landed
from .bindings import COMMITS
from .registry import query

WITH = "WITH RECURSIVE " + COMMITS


def ok(t):
    return landed.scan_commits(t.commit_rows())


@query("S5_scan_commits", WITH + " SELECT * FROM commit_ok")
def s5(t):
    return ok(t)


@query("S5_scan_commits_newest", WITH + """, newest AS (SELECT repo_id, sha FROM (SELECT repo_id, sha, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha DESC) rn
  FROM (SELECT DISTINCT repo_id, sha, committed_at FROM commit_ok)) WHERE rn <= 200) SELECT c.* FROM commit_ok c JOIN newest USING (repo_id, sha)""")
def s5b(t):
    return landed.scan_commits(t.commit_rows(), max_commits=200)


PAIRS = """, pairs AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS co FROM commit_ok x JOIN commit_ok y ON x.repo_id = y.repo_id AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3)"""


@query("J5_pair_counts", WITH + PAIRS + " SELECT repo_id, a, b, co AS co_change_count FROM pairs")
def j5(t):
    return cc.pair_counts(ok(t))


FREE = ", free AS (SELECT p.* FROM pairs p ANTI JOIN (SELECT repo_id, least(src, dst) AS a, greatest(src, dst) AS b FROM history_edges) e USING (repo_id, a, b))"


@query("J4_without_import_pairs", WITH + PAIRS + FREE + " SELECT repo_id, a, b, co AS co_change_count FROM free")
def j4(t):
    return cc.without_import_pairs(cc.pair_counts(ok(t)), t.history_edges())


COUPLING = WITH + PAIRS + FREE + """, c AS (SELECT repo_id, path, count(*) AS c FROM commit_ok GROUP BY 1, 2), m AS (SELECT repo_id, count(DISTINCT sha) AS m FROM commit_ok GROUP BY 1),
coupling AS (SELECT repo_id, CASE WHEN ab >= ba THEN a ELSE b END AS file_a, CASE WHEN ab >= ba THEN b ELSE a END AS file_b, greatest(ab, ba) AS confidence, least(ab, ba) AS reverse_confidence,
    co AS co_change_count, jaccard, support FROM (SELECT f.repo_id, a, b, co, CAST(co AS DOUBLE) / x.c AS ab, CAST(co AS DOUBLE) / y.c AS ba, CAST(co AS DOUBLE) / (x.c + y.c - co) AS jaccard, CAST(co AS DOUBLE) / m AS support
    FROM free f JOIN c x ON x.repo_id = f.repo_id AND x.path = a JOIN c y ON y.repo_id = f.repo_id AND y.path = b JOIN m ON m.repo_id = f.repo_id)
  WHERE co >= 3 AND greatest(ab, ba) >= 0.03 AND jaccard >= 0.02)"""
LOW = {"min_jaccard": 0.02, "min_confidence": 0.03}  # the test histories are spread thin


@query("A6_implicit_coupling", COUPLING + """ SELECT repo_id, file_a, file_b, round(confidence, 6) AS confidence, round(reverse_confidence, 6) AS reverse_confidence, co_change_count,
  round(jaccard, 6) AS jaccard, round(support, 6) AS support FROM coupling""")
def a6(t):
    out = cc.implicit_coupling(ok(t), t.history_edges(), **LOW)
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "reverse_confidence", "jaccard", "support")})


@query("A7_ghost_edges", COUPLING + """ SELECT repo_id, 'ghost::' || least(file_a, file_b) || '|' || greatest(file_a, file_b) AS id, file_a AS source, file_b AS target, round(jaccard, 6) AS weight,
  CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% co-change · ' || co_change_count || '×' AS label FROM coupling""")
def a7(t):
    ghosts = history.coupling_report(t.commit_rows(), t.history_edges(), **LOW)[1]
    return ghosts.withColumns({"id": F.replace("id", F.char(F.lit(0)), F.lit("|")), "weight": F.round("weight", 6)})


CONTRIB = """, last10 AS (SELECT * FROM (SELECT repo_id, path, sha, author, row_number() OVER (PARTITION BY repo_id, path ORDER BY committed_at DESC, sha DESC) rn FROM commit_rows) WHERE rn <= 10),
contrib AS (SELECT repo_id, path, login, n, CAST(rank AS INTEGER) AS rank, login || ' (' || n || ' recent commits)' AS label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY n DESC, login) AS rank
  FROM (SELECT repo_id, path, author AS login, count(*) AS n FROM last10 GROUP BY 1, 2, 3)) WHERE rank <= 3)"""


@query("A8_top_contributors", WITH + CONTRIB + " SELECT * FROM contrib")
def a8(t):
    return cc.top_contributors(t.commit_rows())


@query("Q3_reviewers", WITH + CONTRIB + """, pr AS (SELECT DISTINCT 'repo' || (o_custkey % 4) AS repo_id, o_orderkey AS pr_number, 'f' || (l_suppkey + l_linenumber) AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT repo_id, pr_number, path, coalesce(rank, 0) AS rank, coalesce(label, 'Unknown/New File') AS label FROM pr LEFT JOIN contrib USING (repo_id, path)""")
def q3b(t):
    prs = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber").join(
        t.raw("orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat(F.lit("repo"), F.col("o_custkey") % 4).alias("repo_id"), F.col("o_orderkey").alias("pr_number"),
        F.concat(F.lit("f"), F.col("l_suppkey") + F.col("l_linenumber")).alias("path"), F.lit("modified").alias("status")).distinct()
    return pull_request.reviewers(prs, t.commit_rows()).select(
        "repo_id", "pr_number", "path", F.coalesce("rank", F.lit(0)).alias("rank"), "label")
