import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from repolumen.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = get_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


def graph(spark, edges, nodes=(), repo="r"):
    """(nodes, edges) DataFrames of one repository from literal pairs."""
    e = spark.createDataFrame([(repo, a, b) for a, b in edges], "repo_id string, src string, dst string")
    names = sorted(set(nodes) | {a for a, _ in edges} | {b for _, b in edges if b})
    n = spark.createDataFrame([(repo, x) for x in names], "repo_id string, path string")
    return n, e


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
