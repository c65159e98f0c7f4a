"""Approximate nearest neighbours by cross-polytope hashing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tables, and the signed axes that a query looks up in each. Over random 64-component vectors, where neighbours are
#: hardest to tell apart, these find 0.98 of the true five.
TABLES, PROBES = 8, 12
#: What one task compares at a time: about so many stored vectors with so many queries.
STORED, ASKED = 4096, 1024
#: Cosines of a matrix product this near are compared by their exact sums; so many pairs are summed at a time.
MARGIN, SCORED = 1e-9, 1 << 15
FILED = "entry bigint, vector array<double>, dim int, bucket int"


def _usable(vector: Column) -> Column:
    """Not null, zero, or with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5,
           tables: int = TABLES, probes: int = PROBES, seed: int = 0) -> DataFrame:
    """(query_id, rank from 1, key, score): the ``k`` nearest rows found for each query, by exact cosine.

    ``queries`` picks the rows that ask; every usable row but the query's own is a candidate. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do null keys; rows equal in key and vector are one,
    and vectors of different length never meet. Ties go to the smaller key. A query for which the tables find fewer
    than ``k`` rows is compared with all rows, by blocks.

    Equal vectors are one entry with its ``k + 1`` smallest keys, so copies are neither stored nor compared again. Each
    table turns vectors by its own pseudo-rotation (signs and a Hadamard transform, three times) and files an entry
    under its nearest signed axis; a query looks up the ``probes`` nearest axes. A crowded axis is compared by blocks
    of entries and of queries, each in one task, which returns the best ``k + 1`` entries of each query.
    """
    used = rows.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
    used = written(used.filter(_usable(F.col("vector"))).groupBy("id", "vector").agg(F.max("asks").alias("asks")), "vectors")
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = used.select("id", "vector").withColumn("n", first).filter(F.col("n") <= k + 1)
    entries = entries.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.col("ids")[0]), "entries")
    asking = written(used.filter("asks").join(entries, "vector").select("id", "entry"), "asking")
    asked = written(entries.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "vector"), "asked")

    filed = written(_filed(entries.select("entry", "vector"), tables, 1, seed), "filed")
    found = written(_best(filed, _filed(asked, tables, probes, seed), k), "found")
    sizes = entries.select(F.col("entry").alias("candidate"), "ids")
    enough = found.join(sizes, "candidate").groupBy("entry").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > k)
    few = written(asked.join(enough, "entry", "left_anti"), "few")
    if not few.isEmpty():
        one = [F.size("vector").alias("dim"), F.lit(0).alias("bucket")]
        found = found.unionByName(_best(entries.select("entry", "vector", *one), few.select("entry", "vector", *one), k)).distinct()

    pairs = found.join(sizes, "candidate").join(asking, "entry").select(
        F.col("id").alias("query_id"), F.explode("ids").alias(key), "score").filter(F.col("query_id") != F.col(key))
    pairs = pairs.groupBy("query_id", key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _filed(entries: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """A row for each table and for each of the nearest axes: entry, vector, dim, bucket."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                part = batch.take(pa.array(at))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                buckets = [_axes(x, seed, t, probes) + t * 2 * _width(dim) for t in range(tables)]
                row = np.repeat(np.arange(len(at)), tables * probes)
                bucket = np.stack(buckets, axis=1).reshape(-1).astype(np.int32)
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(row), dim, np.int32)), pa.array(bucket)],
                    names=["entry", "vector", "dim", "bucket"])

    return entries.select("entry", "vector").mapInArrow(run, FILED)


def _width(dim: int) -> int:
    return 1 << max(0, int(dim) - 1).bit_length()


def _axes(x, seed: int, table: int, probes: int):
    """The nearest signed axes of each row after the table's rotation, as numbers below twice the width."""
    import numpy as np

    width = _width(x.shape[1])
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    turned = np.zeros((len(x), width))
    turned[:, :x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)
    for s in signs:
        turned = turned * s
        half = 1
        while half < width:  # fast Hadamard transform; its scale does not matter
            pairs = turned.reshape(len(x), -1, 2, half)
            turned = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
    order = np.argsort(-np.concatenate([turned, -turned], axis=1), axis=1, kind="stable")
    return order[:, :probes] if order.shape[1] >= probes else np.pad(order, ((0, 0), (0, probes - order.shape[1])), "edge")


def _best(filed: DataFrame, looked: DataFrame, k: int) -> DataFrame:
    """(entry, candidate, score): of each query the best ``k + 1`` entries among those in its buckets."""
    looked = written(looked.dropDuplicates(["entry", "dim", "bucket"]), "looked")
    group = ["dim", "bucket"]
    # how many blocks a bucket needs on either side: a row per bucket
    blocks = filed.groupBy(*group).count().withColumnRenamed("count", "stored").join(
        looked.groupBy(*group).count().withColumnRenamed("count", "asked"), group)
    blocks = written(blocks.select(
        *group, F.ceil(F.col("stored") / STORED).cast("int").alias("stored"),
        F.ceil(F.col("asked") / ASKED).cast("int").alias("asked")), "blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("entry"), F.col(own)).cast("int")
        each = rows.join(blocks, group).withColumn(f"{own}_at", mine)
        return each.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            "entry", "vector", *group, "stored_at", "asked_at")

    at = [*group, "stored_at", "asked_at"]

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            dim = t.column("dim")[0].as_py()
            flat = t.column("vector").combine_chunks()
            flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            return t.column("entry").to_numpy(), x, np.sqrt((x * x).sum(axis=1))

        if not left.num_rows or not right.num_rows:
            return pa.table({"entry": pa.array([], pa.int64()), "candidate": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, x, norms), (asked, q, q_norms) = matrix(left), matrix(right)
        near = (q / q_norms[:, None]) @ (x / norms[:, None]).T
        least = np.partition(near, -min(len(ids), k + 1), axis=1)[:, -min(len(ids), k + 1)]
        # whatever rounding may have put below the last place, so that no tie is lost
        row, col = np.nonzero(near >= least[:, None] - MARGIN)
        # the same sum for each pair, so that equal vectors have equal scores wherever they are compared
        score = np.concatenate([
            (q[row[i:i + SCORED]] * x[col[i:i + SCORED]]).sum(axis=1) for i in range(0, len(row), SCORED)])
        score /= q_norms[row] * norms[col]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        return pa.table({"entry": asked[row[kept]], "candidate": ids[col[kept]], "score": score[kept]})

    found = dealt(filed, "stored", "asked").groupBy(*at).cogroup(dealt(looked, "asked", "stored").groupBy(*at)).applyInArrow(
        run, "entry bigint, candidate bigint, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "candidate"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k + 1).drop("rank")
