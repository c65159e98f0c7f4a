"""A graph laid out once for the rounds of a loop.

Nodes get long ids in the order of repository and path, from a table that stays for the way back, and arcs become a
table of ids bucketed by the end from which they are followed. A loop then shuffles its state to the arcs and never the
arcs themselves.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, land, remove, shared_path

#: A node with more arcs than this is followed in several parts, so that no bucket holds all arcs of a hub.
PART = 1 << 17


@dataclass(frozen=True)
class Layout:
    names: DataFrame  # repo_id, path, id, parts
    arcs: DataFrame   # node, part, next, next_parts, and columns that were kept
    hubs: bool        # whether any node has several parts
    table: str
    path: str

    def follow(self, state: DataFrame) -> DataFrame:
        """``state`` (node, parts, …) joined with its arcs; a hub's row goes to each of its parts."""
        if not self.hubs:
            return state.drop("parts").join(self.arcs, "node")
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return state.withColumn("part", part).drop("parts").join(self.arcs, ["node", "part"])

    def ids(self, rows: DataFrame, column: str = "path") -> DataFrame:
        """``rows`` (repo_id, column, …) with ``node`` and ``parts`` of what is named there; null if it is no node."""
        known = self.names.withColumnsRenamed({"path": column, "id": "node"})
        return rows.join(known, ["repo_id", column], "left")

    def named(self, rows: DataFrame, column: str = "path") -> DataFrame:
        """``rows`` (node, …) with repo_id and path."""
        return rows.join(self.names.select("repo_id", F.col("path").alias(column), F.col("id").alias("node")), "node").drop("node")

    def drop(self) -> None:
        """Forget the arcs, once nothing reads them any more; names stay."""
        spark = self.names.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(spark, self.path)


def lay_out(edges: DataFrame, nodes: DataFrame | None = None, reverse: bool = False, keep: tuple[str, ...] = (), part: int | None = None) -> Layout:
    """Lay out ``edges`` (repo_id, src, dst, …), followed from src to dst or in ``reverse``.

    Nodes are the ends of edges, and ``nodes`` (repo_id, path). Equal edges are one, unless they differ in a column to
    ``keep``; edges without an end are none.
    """
    spark, spent = edges.sparkSession, []

    def written(df: DataFrame, name: str) -> DataFrame:
        """``df`` as a columnar table until the arcs are laid out: names repeat, which a checkpoint writes out each time."""
        spent.append(land(df, name))
        return spark.read.schema(df.schema).parquet(spent[-1])

    ends = written(edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("repo_id", "src", "dst", *keep).distinct(), "ends")
    used = ends.select("repo_id", F.explode(F.array("src", "dst")).alias("path"))
    if nodes is not None:
        used = used.union(nodes.select("repo_id", "path"))
    order = ["repo_id", "path"]
    used = written(used.distinct(), "used")  # a range partitioning reads its input twice
    names = durable(used.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    key = names.select("repo_id", F.col("path").alias(a), F.col("id").alias("node"))
    other = names.select("repo_id", F.col("path").alias(b), F.col("id").alias("next"))
    arcs = written(ends.join(key, ["repo_id", a]).join(other, ["repo_id", b]).select("node", "next", *keep), "numbered")
    laid = bucketed(names, arcs, keep, part)
    for path in spent:
        remove(spark, path)
    return laid


def bucketed(names: DataFrame, arcs: DataFrame, keep: tuple[str, ...] = (), part: int | None = None) -> Layout:
    """The layout of arcs (node, next, …) between nodes that have ids."""
    spark = arcs.sparkSession
    many = durable(arcs.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (part or PART)).cast("int").alias("parts")).filter("parts > 1"))
    hubs = not many.isEmpty()
    parts = F.coalesce("parts", F.lit(1))
    names = names.drop("parts").join(many.withColumnRenamed("node", "id"), "id", "left").withColumn("parts", parts) if hubs else names.drop(
        "parts").withColumn("parts", F.lit(1))
    whole = [F.lit(0).alias("part"), F.lit(1).alias("next_parts")]
    if hubs:
        arcs = arcs.join(many, "node", "left").withColumn("part", F.pmod(F.xxhash64("next"), parts).cast("int")).drop("parts")
        arcs = arcs.join(many.withColumnRenamed("node", "next"), "next", "left").withColumn("next_parts", parts)
        whole = ["part", "next_parts"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = shared_path(spark, "arcs"), f"arcs_{uuid.uuid4().hex}"
    arcs, key = arcs.select("node", "next", *keep, *whole), ["node", "part"] if hubs else ["node"]
    arcs.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return Layout(names.select("repo_id", "path", "id", "parts"), spark.table(table), hubs, table, path)
