"""Session settings and durable cuts of long lineages."""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; cluster defaults win where unset here."""
    builder = (
        SparkSession.builder.appName("repolumen")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for written tables and stream state."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no replay of the loop."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@dataclass(frozen=True)
class Cut:
    """A durable table with its measured size."""

    df: DataFrame
    rows: int
    bytes: int
    seen: dict | None = None

    def for_join(self) -> DataFrame:
        """Hinted for broadcast when the measured size is below the session's own threshold.

        Beyond it the table is left to a shuffled join.
        """
        return F.broadcast(self.df) if self.bytes <= broadcast_limit(self.df.sparkSession) else self.df


def together(cuts: list[Cut]) -> Cut:
    """Several cuts as one table; their sizes add up."""
    table = reduce(DataFrame.unionByName, [c.df for c in cuts])
    return Cut(table, sum(c.rows for c in cuts), sum(c.bytes for c in cuts))


def broadcast_limit(spark: SparkSession) -> int:
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if text and text[-1] in units:
        return int(text[:-1]) * units[text[-1]]
    return int(text)


def measured(df: DataFrame, *more: Column) -> Cut:
    """``durable`` that also measures rows and bytes, and ``more`` aggregates by their names, in the same job."""
    seen = Observation(uuid.uuid4().hex)
    width = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        else:
            width = width + 16
    cut = durable(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"), *more))
    got = seen.get
    return Cut(cut, int(got["n"]), int(got["b"] or 0), got)


def is_landed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end at the path and is still there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(mark) and any(
        s.getPath().getName().startswith("part-") for s in system.listStatus(files))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a landed table, wherever the shared folder is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def land(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder and return its path: columnar, prunable, of exact size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str, spent: list[str] | None = None) -> DataFrame:
    """``df`` as a columnar table in the shared folder: names repeat, which a checkpoint writes out each time.

    Its path is added to ``spent``, for tables that are removed once nothing reads them any more.
    """
    path = land(df, name)
    if spent is not None:
        spent.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_repo_values(rows: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the ``values`` of their repository, one row each.

    The values are measured first and go to the rows as far as broadcasts may: few large repositories would put all
    rows into as many tasks.
    """
    return rows.join(measured(values).for_join(), "repo_id", how)
