"""Mine commit histories for files that change together without importing one another."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import cochange
from ..sources.landed import scan_commits


def coupling_report(commit_files: DataFrame, edges: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(coupling, ghost edges) from raw commit rows."""
    coupling = cochange.implicit_coupling(scan_commits(commit_files), edges, **options)
    return coupling, cochange.ghost_edges(coupling)
