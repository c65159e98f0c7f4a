"""Hard negatives of anchors by bounds along a spanning tree of the anchors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that a task holds at a time: candidates, and anchors of one tree.
STORED, ANCHORS = 4096, 256
#: What a bound is wider by, as a share of the largest score possible, so that rounding cannot cut.
SLACK = 1e-9


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score), keys under the names ``…_id``.

    Vectors hold whole numbers, and a score is an inner product. An anchor's positives are the ``positives`` best rows
    of its label but itself. For each of them, rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's are negatives, of which the best ``negatives`` are returned, rank from 1. Higher scores come first, ties
    go to the smaller key. Rows with a null key, label or vector, or a null or non-finite component, take no part;
    vectors of different length never meet, rows equal in key, label and vector are one, and rows that share only
    the key are rows of their own, which never meet as anchor and partner. Scores are exact while they fit 64 bits.
    Extra columns are ignored; empty tables give no rows.

    Anchors that lie near each other in their label and length are blocks, each with a minimum spanning tree. Every
    block meets every block of candidates in one task, twice: for positives, then for negatives, whose windows are
    known by then. There the tree's root is scored with all candidates, and a child's score lies within its parent's
    bounds, plus or minus the length of their edge times the candidate's norm. Only candidates whose bounds reach
    the window, or the best found so far, are scored again; for the children of this anchor their bounds are exact.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    used = rows.filter(ok).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                                  F.col(vector).cast("array<double>").alias("vector"), anchors.alias("asks"))
    used = used.groupBy("id", "label", "vector").agg(F.max("asks").alias("asks"))
    used = written(used.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    stored = used.drop("asks").withColumn("part", F.xxhash64("row"))
    # near ones together: by label, then along a fixed direction
    spread = F.aggregate(F.transform("vector", lambda x, i: x * F.sin(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    asked = used.filter("asks").select("row", "id", "label", "vector", "dim", spread.alias("spread"))
    asked = written(_blocks(asked), "anchors")
    parts = used.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / STORED).cast("int").alias("parts"))
    parts = written(parts, "parts")

    def met(asked: DataFrame, windows: bool):
        left = asked.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = written(asked.select("dim", "block").distinct(), "blocks")
        right = stored.join(parts, "dim").withColumn("part", F.pmod("part", F.col("parts")).cast("int")).join(blocks, "dim")
        left = left.select("dim", "block", "part", "row", "id", "label", "vector", *["windows"] * windows)
        right = right.select("dim", "block", "part", "row", "id", "label", "vector")
        by = ["dim", "block", "part"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
            _task(windows, positives, negatives, low, high), "anchor bigint, turn bigint, partner bigint, score bigint")
        return written(found, "found")

    def best(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), "id", "partner"))
        named = found.join(used.select(F.col("row").alias("partner"), "id"), "partner")
        return named.withColumn("rank", rank).filter(F.col("rank") <= k)

    pos = written(best(met(asked, False), positives), "positives")
    windows = pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("windows"))
    windows = windows.select(F.col("anchor").alias("row"), F.col("windows.score").alias("windows"))
    neg = best(met(asked.join(windows, "row"), True), negatives)
    pos = pos.select("anchor", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(pos, ["anchor", "turn"]).join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _blocks(asked: DataFrame) -> DataFrame:
    """Anchors with ``block``: their place in the order of length, label and direction, by ANCHORS."""
    order = ["dim", "label", "spread", "row"]
    dealt = written(asked.repartitionByRange(*order).withColumn("deal", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("deal").count().withColumn("before", F.sum("count").over(Window.orderBy("deal")) - F.col("count"))
    turn = F.row_number().over(Window.partitionBy("deal").orderBy(*order)) - 1 + F.col("before")
    return dealt.join(before, "deal").withColumn("block", F.floor(turn / ANCHORS)).drop("deal", "spread", "before", "count")


def spanning_tree(x):
    """(order, parent, edge) of a minimum spanning tree of the rows by distance, from the first: Prim's way."""
    import numpy as np

    n = len(x)
    order, parent, edge = [0], np.zeros(n, np.int64), np.zeros(n)
    near, free = np.sqrt(((x - x[0]) ** 2).sum(axis=1)), np.ones(n, bool)
    free[0] = False
    for _ in range(n - 1):
        i = int(np.argmin(np.where(free, near, np.inf)))
        free[i] = False
        order.append(i)
        edge[i] = near[i]
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        closer = free & (d < near)
        near[closer], parent[closer] = d[closer], i
    return order, parent, edge


def _task(windows: bool, positives: int, negatives: int, low: int, high: int):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        def side(t):
            flat = pa.concat_arrays([c.flatten() for c in t.column("vector").chunks]).to_numpy(zero_copy_only=False)
            return (t.column("row").to_numpy(), t.column("id").to_numpy(), np.array(t.column("label").to_pylist(), object),
                    flat.reshape(t.num_rows, -1))

        out = {n: [] for n in ("anchor", "turn", "partner", "score")}
        if left.num_rows and right.num_rows:
            rows, ids, labels, q = side(left)
            to, to_ids, to_labels, x = side(right)
            wanted = left.column("windows").to_pylist() if windows else [None] * len(rows)
            norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            largest = float(norm.max() * own.max()) if x.shape[1] else 0.0
            exact = (lambda v, m: (m @ v).astype(np.int64)) if largest < 2.0 ** 52 else (  # whole in double precision
                lambda v, m: np.array([sum(int(a) * int(b) for a, b in zip(v, r, strict=True)) for r in m], np.int64))
            order, parent, edge = spanning_tree(q)
            least, most = np.empty((len(q), len(x))), np.empty((len(q), len(x)))
            for c in order:
                if c == order[0]:
                    least[c] = most[c] = exact(q[c], x)
                else:
                    reach = edge[c] * norm * (1 + SLACK) + SLACK * largest
                    least[c], most[c] = least[parent[c]] - reach, most[parent[c]] + reach
                alike = to_labels == labels[c]
                if not windows:
                    fits = alike & (to_ids != ids[c])
                    bar = np.partition(least[c][fits], -positives)[-positives] if fits.sum() > positives else -np.inf
                    at = np.nonzero(fits & (most[c] >= bar))[0]
                else:
                    open_ = np.zeros(len(x), bool)
                    for s in wanted[c]:
                        open_ |= (100 * most[c] >= low * s) & (100 * least[c] <= high * s)
                    at = np.nonzero(~alike & (to_ids != ids[c]) & open_)[0]
                if not len(at):
                    continue
                score = exact(q[c], x[at])
                if largest < 2.0 ** 52:
                    least[c][at] = most[c][at] = score
                for turn, s in enumerate(wanted[c] if windows else [0], 1):
                    if windows:
                        inside = (100.0 * score >= low * float(s) * (1 - np.sign(s) * SLACK)) & (100.0 * score <= high * float(s) * (1 + np.sign(s) * SLACK))
                        pick = [i for i in np.nonzero(inside)[0] if low * s <= 100 * int(score[i]) <= high * s]
                        pick = np.array(pick, np.int64)
                    else:
                        pick = np.arange(len(at))
                    pick = pick[np.lexsort((to[at[pick]], to_ids[at[pick]], -score[pick]))[:negatives if windows else positives]]
                    out["anchor"] += [int(rows[c])] * len(pick)
                    out["turn"] += [turn if windows else 0] * len(pick)
                    out["partner"] += to[at[pick]].tolist()
                    out["score"] += score[pick].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run
