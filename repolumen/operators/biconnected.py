"""Articulation points, bridges and fragment sizes by Tarjan–Vishkin biconnectivity over joins.

The steps are a spanning forest from the edges by which components hook on to each other, its Euler tour, the tour's
positions by list ranking, low/high numbers as extremes over ranges of positions, an auxiliary graph on the tree edges
whose components are the biconnected blocks, and sums over the blocks. The number of jobs follows the logarithm of the
number of nodes, whatever the depth of the graph.
"""
from __future__ import annotations

import uuid
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import durable, remove, shared_path

NEIGHBOURS_PER_GROUP = 50_000
#: Positions of a tour that are held as one array.
RANGE = 128


#: The tables that the call under way has written.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@dataclass(frozen=True)
class Biconnected:
    articulation_points: DataFrame  # repo_id, path, fragment_size
    bridges: DataFrame              # repo_id, src, dst
    blocks: DataFrame               # repo_id, a, b, block


def biconnected(nodes: DataFrame, edges: DataFrame) -> Biconnected:
    """Separating nodes and edges of the undirected graphs of all repositories.

    Edges without an end and self-loops are none, equal edges are one. Nodes without edges separate nothing, so
    ``nodes`` adds no row. The tables between the steps are removed at the end.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        return _biconnected(edges)
    finally:
        _made.reset(token)
        for path in made:
            remove(edges.sparkSession, path)


def _measured(df: DataFrame, *more: Column) -> tuple[DataFrame, dict]:
    """The table written to the shared folder and read back, with its rows ``n`` and the aggregates ``more``.

    Its size is known there. A checkpoint would keep the estimate of the plan that it cuts, and joins of a table with
    itself square that in every round, until the optimizer cannot work with the number.
    """
    seen = Observation(uuid.uuid4().hex)
    path = shared_path(df.sparkSession, "tree")
    if _made.get() is not None:
        _made.get().append(path)
    df.observe(seen, F.count(F.lit(1)).alias("n"), *more).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _stored(df: DataFrame) -> DataFrame:
    return _measured(df)[0]


def _biconnected(edges: DataFrame) -> Biconnected:
    arcs = _stored(
        edges.filter((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst")))
        .select("repo_id", "src", "dst").distinct()
    )
    names, pairs = _with_ids(arcs)
    labels, tree_pairs = spanning_forest(pairs)
    tree = _stored(numbered_tree(tree_pairs, labels))
    blocks = _stored(block_labels(tree, _non_tree(pairs, tree)))
    pair_blocks = _stored(block_of_pairs(tree, pairs, blocks))

    def named(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.withColumnRenamed(c, "id").join(names.select("id", "repo_id", F.col("path").alias(c)), "id").drop("id")
            if c != columns[-1]:
                rows = rows.drop("repo_id")
        return rows

    return Biconnected(
        durable(named(articulation(tree, blocks), "path").select("repo_id", "path", "fragment_size")),
        durable(bridge_edges(arcs, named(single_pairs(pair_blocks), "a", "b"))),
        durable(named(pair_blocks.select("a", "b", "block"), "a", "b", "block").select("repo_id", "a", "b", "block")),
    )


def _with_ids(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, path, id) in the order of repository and path, and unordered pairs (a, b, k) of ids; ``k`` is 2 when
    both directions exist."""
    order = ["repo_id", "path"]
    used = _stored(arcs.select("repo_id", F.explode(F.array("src", "dst")).alias("path")).distinct())
    names = _stored(used.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    for c in ("src", "dst"):
        arcs = arcs.join(names.select("repo_id", F.col("path").alias(c), F.col("id").alias(f"{c}_id")), ["repo_id", c])
    ends = [F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")]
    return names, _stored(arcs.groupBy(*ends).agg(F.count(F.lit(1)).alias("k")))


def spanning_forest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component (node, root) of every end of ``pairs`` (a, b), named by its smallest node, and the tree pairs (a, b).

    In a round every component chooses the least of the pairs that leave it, in one fixed random order of all pairs, so
    that choices close no circle but the two of one pair. The chosen pairs are tree pairs, what they hold together is
    one component of the next round, and there are at most half as many of these.
    """
    order = F.struct(F.xxhash64("a", "b").alias("w"), "a", "b")
    live, seen = _measured(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), order.alias("pair")))
    into, chosen = [], []
    while seen["n"]:
        ends = live.union(live.select("y", "x", "pair"))
        best = ends.groupBy(F.col("x").alias("node")).agg(F.min(F.struct("pair", "y")).alias("m"))
        best = _stored(best.select("node", F.col("m.y").alias("up"), F.col("m.pair").alias("pair")))
        chosen.append(best.select("pair.a", "pair.b").distinct())
        back = best.select(F.col("node").alias("up"), F.col("up").alias("back"))
        first = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
        tops = _tops(best.select("node", "up").join(back, "up").select("node", F.when(first, F.col("node")).otherwise(F.col("up")).alias("up")))
        into.append(tops)
        moved = live
        for c in ("x", "y"):
            moved = moved.join(tops.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")), c)
        ends = [F.least("x_up", "y_up").alias("x"), F.greatest("x_up", "y_up").alias("y")]
        live, seen = _measured(moved.filter(F.col("x_up") != F.col("y_up")).groupBy(*ends).agg(F.min("pair").alias("pair")))
    if not into:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("root")), pairs.select("a", "b")
    # from the last round, which has the fewest components, back to the nodes
    labels = into.pop()
    while into:
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        labels = _stored(into.pop().join(later, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
    least = labels.groupBy("up").agg(F.min("node").alias("root"))
    return _stored(labels.join(least, "up").select("node", "root")), _stored(reduce(DataFrame.unionByName, chosen))


def _tops(hooks: DataFrame) -> DataFrame:
    """(node, up) with ``up`` followed to its end, where a node points to itself; fourfold per job."""
    up = _stored(hooks)
    while True:
        two = _followed(up, up)
        four = _followed(two.select("node", F.col("top").alias("up")), two.select("node", F.col("top").alias("up")))
        four, seen = _measured(four, F.sum((F.col("up") != F.col("top")).cast("int")).alias("moved"))
        up = four.select("node", F.col("top").alias("up"))
        if not seen["moved"]:
            return up


def _followed(rows: DataFrame, steps: DataFrame) -> DataFrame:
    return rows.join(steps.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "up", "top")


def euler_tour(tree_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The arcs (u, v) of each tree with the arc (nu, nv) after them; null after the last one, which ends at the root.

    After an arc into a node comes the arc to the next of its neighbours, in a circle. Any fixed order serves, so the
    neighbours of a hub are split into hashed groups, ordered by group and then by number.
    """
    near = tree_pairs.select(F.col("a").alias("node"), F.col("b").alias("other"))
    near = near.union(near.select("other", "node"))
    groups = (F.floor(F.count(F.lit(1)) / NEIGHBOURS_PER_GROUP) + 1).alias("groups")
    near = near.join(near.groupBy("node").agg(groups), "node").select(
        "node", "other", F.pmod(F.xxhash64("other"), "groups").alias("grp"))
    circle = Window.partitionBy("node").orderBy("grp")
    firsts = near.groupBy("node", "grp").agg(F.min("other").alias("first")).select(
        "node", "grp", F.lead("first").over(circle).alias("later"),
        F.first("first").over(circle.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    inside = F.lead("other").over(Window.partitionBy("node", "grp").orderBy("other"))
    roots = labels.filter(F.col("node") == F.col("root")).select("node", F.lit(True).alias("is_root"))
    after = F.coalesce("inside", "later")
    after = F.when(after.isNotNull(), after).when(F.col("is_root").isNull(), F.col("start"))
    return (
        near.withColumn("inside", inside).join(firsts, ["node", "grp"]).join(roots, "node", "left")
        .select(F.col("other").alias("u"), F.col("node").alias("v"), F.when(after.isNotNull(), F.col("node")).alias("nu"), after.alias("nv"))
    )


def list_ranks(tour: DataFrame) -> DataFrame:
    """(u, v, d): how many arcs come after each arc of its tour. A job makes the known distance fourfold."""
    ranks, seen = _measured(tour.withColumn("d", F.when(F.col("nu").isNull(), 0).otherwise(1).cast("long")), F.count("nu").alias("open"))
    while seen["open"]:
        steps = ranks.select(*[F.col(c).alias(f"then_{c}") for c in ("u", "v", "nu", "nv", "d")])
        rows = ranks.filter(F.col("nu").isNotNull())
        for _ in range(3):
            # an arc that is done meets none, by keys that differ
            here = (F.coalesce("nu", -1 - F.col("u")) == F.col("then_u")) & (F.coalesce("nv", "v") == F.col("then_v"))
            rows = rows.join(steps, here, "left").select(
                "u", "v", F.col("then_nu").alias("nu"), F.col("then_nv").alias("nv"),
                (F.col("d") + F.coalesce("then_d", F.lit(0))).alias("d"))
        ranks, seen = _measured(ranks.filter(F.col("nu").isNull()).unionByName(rows), F.count("nu").alias("open"))
    return ranks.select("u", "v", "d")


def numbered_tree(tree_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, parent, root, enter, leave, nd) of every node: the range of its subtree in the tour read from its end, where
    the numbers of nodes inside lie, and the subtree's size."""
    ranks = list_ranks(euler_tour(tree_pairs, labels))
    down = F.col("u") < F.col("v")
    ends = ranks.groupBy(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).agg(
        F.max(F.when(down, F.col("d"))).alias("up_to"), F.max(F.when(~down, F.col("d"))).alias("back"))
    # the arc to the child comes before the arc back
    low_first = F.col("up_to") > F.col("back")
    inner = ends.select(
        F.when(low_first, F.col("high")).otherwise(F.col("low")).alias("node"),
        F.when(low_first, F.col("low")).otherwise(F.col("high")).alias("parent"),
        (F.least("up_to", "back") + 1).alias("enter"), (F.greatest("up_to", "back") + 1).alias("leave"),
    ).join(labels, "node")
    roots = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("enter"),
        (2 * F.col("n") - 1).alias("leave"), "root")
    nd = F.shiftright(F.col("leave") - F.col("enter") + 1, 1)
    return inner.unionByName(roots).select("node", "parent", "root", "enter", "leave", nd.alias("nd"))


def fold_ranges(cells: DataFrame, asked: DataFrame, size: int = RANGE) -> DataFrame:
    """(node, low, high): the extremes of ``cells`` (root, pos, low, high) from ``lo`` to ``hi`` of each of ``asked``
    (node, root, lo, hi).

    A range is the parts of its first and last block of ``size`` positions and the whole blocks between, which are
    a range of the next, so much shorter table of blocks.
    """
    found = []
    blocks = cells
    asked, seen = _measured(asked)
    while seen["n"]:
        at = F.floor(F.col("pos") / size)
        blocks = _stored(blocks.groupBy("root", at.alias("blk")).agg(
            F.collect_list(F.struct("pos", "low", "high")).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high")))
        ends = asked.withColumns({"from": F.floor(F.col("lo") / size), "to": F.floor(F.col("hi") / size)})
        parts = ends.select("node", "root", "lo", "hi", F.explode(F.array_distinct(F.array("from", "to"))).alias("blk"))
        met = F.filter("cells", lambda c: (c["pos"] >= F.col("lo")) & (c["pos"] <= F.col("hi")))
        parts = parts.join(blocks.select("root", "blk", "cells"), ["root", "blk"]).select("node", met.alias("met"))
        found.append(_stored(parts.select("node", F.array_min("met.low").alias("low"), F.array_max("met.high").alias("high"))))
        asked, seen = _measured(ends.filter(F.col("to") - F.col("from") > 1).select(
            "node", "root", (F.col("from") + 1).alias("lo"), (F.col("to") - 1).alias("hi")))
        blocks = blocks.select("root", F.col("blk").alias("pos"), "low", "high")
    if not found:
        return cells.select(F.col("root").alias("node"), "low", "high").limit(0)
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _non_tree(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    tree_pairs = tree.filter(F.col("parent").isNotNull()).select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    return pairs.join(tree_pairs, ["a", "b"], "left_anti")


def block_labels(tree: DataFrame, non_tree: DataFrame) -> DataFrame:
    """(node, block): the block of the tree edge above each non-root node."""
    ends = tree.select("node", "enter", "leave")
    placed = _stored(
        non_tree.select("a", "b").join(ends.withColumnsRenamed({"node": "a", "enter": "ea", "leave": "la"}), "a")
        .join(ends.withColumnsRenamed({"node": "b", "enter": "eb", "leave": "lb"}), "b"))
    seen = placed.select(F.col("a").alias("node"), F.col("eb").alias("other")).union(placed.select("b", "ea")).groupBy(
        "node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    cells = tree.join(seen, "node", "left").select(
        "root", F.col("enter").alias("pos"), F.least("enter", "lo").alias("low"), F.greatest("enter", "hi").alias("high"))
    inner = tree.filter(F.col("parent").isNotNull())
    extremes = fold_ranges(_stored(cells), inner.select("node", "root", F.col("enter").alias("lo"), F.col("leave").alias("hi")))
    upper = inner.select(F.col("node").alias("parent"), F.col("enter").alias("from"), F.col("leave").alias("to"))
    through = inner.select("node", "parent").join(extremes, "node").join(upper, "parent").filter(
        (F.col("low") < F.col("from")) | (F.col("high") > F.col("to"))).select("node", "parent")
    cross = placed.filter((F.col("la") < F.col("eb")) | (F.col("lb") < F.col("ea"))).select("a", "b")
    links = _stored(cross.union(through).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = spanning_forest(links)[0]
    return inner.select("node").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("block"))


def block_of_pairs(tree: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pair with its block: that of its deeper (later numbered) end."""
    number = tree.select("node", "enter")
    return (
        pairs.join(number.withColumnsRenamed({"node": "a", "enter": "ea"}), "a")
        .join(number.withColumnsRenamed({"node": "b", "enter": "eb"}), "b")
        .withColumn("node", F.when(F.col("ea") > F.col("eb"), F.col("a")).otherwise(F.col("b")))
        .join(blocks, "node").select("a", "b", "k", "block")
    )


def single_pairs(pair_blocks: DataFrame) -> DataFrame:
    """The pairs (a, b) that are the only edge of their block."""
    return (
        pair_blocks.groupBy("block").agg(F.sum("k").alias("k"), F.min("a").alias("a"), F.min("b").alias("b"))
        .filter(F.col("k") == 1).select("a", "b")
    )


def bridge_edges(arcs: DataFrame, single: DataFrame) -> DataFrame:
    """A bridge is the only edge of its block; it is reported in import direction."""
    ends = single.select("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (
        arcs.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
        .join(ends, ["repo_id", "a", "b"], "left_semi").select("repo_id", "src", "dst")
    )


def articulation(tree: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes that separate their component, with the largest fragment left after removal."""
    labelled = tree.join(blocks, "node", "left").select("root", "node", "parent", "nd", "block")
    up = labelled.select(F.col("node").alias("parent"), F.col("block").alias("up_block"))
    fragments = (
        labelled.filter(F.col("parent").isNotNull()).join(up, "parent")
        .filter(F.col("up_block").isNull() | (F.col("block") != F.col("up_block")))
        .groupBy("root", "parent", "up_block", "block").agg(F.sum("nd").alias("nd"))
        .groupBy("root", "parent", "up_block")
        .agg(F.count(F.lit(1)).alias("groups"), F.max("nd").alias("largest"), F.sum("nd").alias("below"))
    )
    totals = tree.filter(F.col("parent").isNull()).select("root", F.col("nd").alias("total"))
    is_root = F.col("up_block").isNull()
    return (
        fragments.filter((F.col("groups") >= 2) | ~is_root).join(totals, "root")
        .select(F.col("parent").alias("path"),
                F.when(is_root, F.col("largest"))
                .otherwise(F.greatest("largest", F.col("total") - 1 - F.col("below"))).alias("fragment_size"))
    )
