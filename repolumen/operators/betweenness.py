"""Betweenness centrality: Brandes' accumulation, exact, in one of two ways.

A repository within a fixed bound of nodes and arcs, or a connected component of a larger one, is searched in tasks that
each hold its arcs, packed, and take a share of its sources. A search follows an arc only between two levels, from the
end of the two that has fewer, and stops once nothing is left that an arc leads to.

Beyond the bound, a round of block products is one distance level. Nodes are numbered by connected component, and the
numbers are cut into parts of 512. A row of the state holds what a block of 128 sources knows of one part, and a row of
arcs is the block of arcs from one part to another, so a round is a join of the two on the part, a product of two small
matrices per row, and a sum per block and part that Spark groups. Only pairs that are reached are kept. All searches of
a batch of sources advance together; ``batches`` splits the sources by their blocks and adds the partial sums, which
bounds the state.
"""
from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cut, broadcast_limit, durable, measured, remove, written
from .components import connected_components
from .graph_stats import union_nodes

#: Bits of a number that tell the source in its block, and the node in its part.
SOURCE, NODE = 7, 9
SOURCES, NODES = 1 << SOURCE, 1 << NODE
STATE = "block long, part long, cells binary, vals binary"
COMPACT_EVERY = 8

#: What a task holds at most of one graph: nodes, told by so many bits, and arcs, of four bytes and some copies.
HELD, ARCS = 17, 1 << 25
#: Bits of a number that tell the node within a row of packed arcs.
SLICE = 10
#: Tasks among which the sources of one graph are shared at most, and steps that are worth one.
SHARES, STEPS = 32, 1 << 27

# what runs in tasks travels with them, so executors need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def betweenness(
    nodes: DataFrame, edges: DataFrame, normalize: bool = True, sources: DataFrame | None = None, batches: int = 1,
) -> DataFrame:
    """(repo_id, path, score) of directed, unweighted shortest paths; repositories under three nodes give none.

    ``sources(repo_id, path)`` restricts the searches for an estimate; the default is exact.
    """
    spent: list[str] = []
    arcs = written(edges.filter(F.col("src") != F.col("dst")).select("repo_id", "src", "dst").distinct(), "arcs", spent)
    members = durable(nodes.select("repo_id", "path").union(union_nodes(edges)).distinct())
    sizes = members.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3)
    start = arcs.select("repo_id", F.col("src").alias("path")).distinct()
    if sources is not None:
        start = start.join(sources.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    placed, held, beyond = _placed(members, arcs)
    sums = _held(placed, held, arcs, start, spent)
    if beyond:
        rest = placed.join(held.df, ["repo_id", "component"], "left_anti")
        sums = sums.unionByName(_by_rounds(rest, arcs, start, batches))
    sums = durable(sums)
    for path in spent:
        remove(edges.sparkSession, path)
    scale = (F.col("n") - 1) * (F.col("n") - 2) if normalize else F.lit(1)
    return members.join(sizes, "repo_id").join(sums, ["repo_id", "path"], "left").select(
        "repo_id", "path", (F.coalesce("score", F.lit(0.0)) / scale).alias("score"))


def _placed(members: DataFrame, arcs: DataFrame) -> tuple[DataFrame, Cut, bool]:
    """The graph that each node belongs to, (repo_id, path, component); the graphs that a task holds, with their numbers
    of nodes and arcs and a number of their own; and whether there are others.

    A repository is one graph, without a component, unless it is too large to be held.
    """
    def sized(placed: DataFrame) -> Cut:
        known = placed.select("repo_id", "path", "component")
        m = arcs.join(known.withColumnRenamed("path", "src"), ["repo_id", "src"]).groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("m"))
        n = known.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n"))
        return measured(n.join(m, ["repo_id", "component"]).withColumn("fits", (F.col("n") <= 1 << HELD) & (F.col("m") <= ARCS)),
                        F.count_if(~F.col("fits")).alias("beyond"))

    placed = members.withColumn("component", F.lit(""))
    graphs = sized(placed)
    if graphs.seen["beyond"]:
        large = graphs.df.filter("NOT fits").select("repo_id")
        apart = connected_components(members.join(large, "repo_id", "left_semi"), arcs.join(large, "repo_id", "left_semi"))
        placed = durable(placed.join(large, "repo_id", "left_anti").unionByName(apart.select("repo_id", "path", "component")))
        graphs = sized(placed)
    held = measured(graphs.df.filter("fits").select("repo_id", "component", "n", "m", F.monotonically_increasing_id().alias("graph")))
    return placed, held, graphs.seen["beyond"] > 0


def _held(placed: DataFrame, held: Cut, arcs: DataFrame, start: DataFrame, spent: list[str]) -> DataFrame:
    """(repo_id, path, score) of all nodes of the graphs that a task holds."""
    spark = placed.sparkSession
    within = Window.partitionBy("graph").orderBy("path")
    nodes = durable(placed.join(held.for_join(), ["repo_id", "component"]).select(
        "repo_id", "path", "graph", "n", F.least(F.lit(SHARES), F.ceil(F.col("n") * F.col("m") / STEPS)).cast("long").alias("shares"),
        (F.row_number().over(within) - 1).alias("at")))
    a = nodes.select("repo_id", F.col("path").alias("src"), "graph", "shares", F.col("at").alias("a"))
    b = nodes.select("repo_id", F.col("path").alias("dst"), F.col("at").alias("b"))
    code = F.shiftleft(F.col("a").bitwiseAND(F.lit((1 << SLICE) - 1)), HELD).bitwiseOR(F.col("b"))

    def pack(key, table):
        graph, shares, row = (x.as_py() for x in key)
        codes = np.sort(table["code"].to_numpy().astype("<i4"))
        return pa.table({"graph": [graph], "shares": [shares], "slice": [row], "arcs": [codes.tobytes()]})

    packed = written(
        arcs.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"])
        .select("graph", "shares", F.shiftright("a", SLICE).cast("long").alias("slice"), code.alias("code"))
        .groupBy("graph", "shares", "slice").applyInArrow(pack, "graph long, shares long, slice long, arcs binary"), "packed", spent)
    sought = nodes.join(start, ["repo_id", "path"], "left_semi").groupBy("graph", F.pmod("at", "shares").alias("share")).agg(
        F.max("n").alias("n"), F.collect_list("at").alias("sources"))
    every = packed.select("graph", "slice", "arcs", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    # few rows are much work: a fixed number of tasks, which are not merged for being small
    tasks = every.unionByName(sought, allowMissingColumns=True).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "graph", "share")
    found = tasks.groupBy("graph", "share").applyInArrow(_searched, "graph long, at int, score double")
    return nodes.join(found.groupBy("graph", "at").agg(F.sum("score").alias("score")), ["graph", "at"]).select("repo_id", "path", "score")


def _followed(first: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other ends of the arcs of the nodes ``of``, and how many each has."""
    start, stop = first[of], first[of + 1]
    many = stop - start
    total = int(many.sum())
    if total > 16 * len(of):
        return np.concatenate([ends[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)]), many
    return ends[np.arange(total) + np.repeat(start - (np.cumsum(many) - many), many)], many


def _searched(key, table):
    """Dependencies of a share of the sources of a graph on each of its nodes; the rows are its arcs, and the sources."""
    asked = table.filter(table["arcs"].is_null())
    if not len(asked):
        return pa.table({"graph": pa.repeat(key[0], 0), "at": np.zeros(0, "i4"), "score": np.zeros(0)})
    n, arcs = asked["n"][0].as_py(), table.filter(table["arcs"].is_valid()).select(["slice", "arcs"]).sort_by("slice")
    codes = [(i.as_py(), np.frombuffer(x.as_buffer(), "<i4")) for i, x in zip(arcs["slice"], arcs["arcs"], strict=True)]
    heads = np.concatenate([(code >> HELD) + (i << SLICE) for i, code in codes])
    out = np.concatenate([code & ((1 << HELD) - 1) for _, code in codes])
    del codes, arcs
    back = (out.astype(np.int64) << 32) | heads
    back.sort()
    into = (back & 0xFFFFFFFF).astype(np.int32)
    del back
    outs, ins = np.bincount(heads, minlength=n), np.bincount(out, minlength=n)
    first_out, first_in = np.concatenate([[0], np.cumsum(outs)]), np.concatenate([[0], np.cumsum(ins)])
    del heads

    def met(frontier, sigma, known, rest):
        """The next level, whose path counts are set; ``rest`` arcs lead to nodes that are not known."""
        if outs[frontier].sum() <= rest:
            ends, many = _followed(first_out, out, frontier)
            got = np.bincount(ends, np.repeat(sigma[frontier], many), n)
            new = np.flatnonzero((got > 0) & ~known)
            sigma[new] = got[new]
            return new
        here = np.zeros(n)
        here[frontier] = sigma[frontier]
        open_ = np.flatnonzero(~known & (ins > 0))
        ends, many = _followed(first_in, into, open_)
        got = np.add.reduceat(here[ends], np.cumsum(many) - many)
        new = open_[got > 0]
        sigma[new] = got[got > 0]
        return new

    def returned(upper, lower, share):
        """What the arcs between two levels bring back to each node of the upper one; ``share`` is zero off the lower."""
        if outs[upper].sum() <= ins[lower].sum():
            sums, some = np.zeros(len(upper)), outs[upper] > 0
            if some.any():
                ends, many = _followed(first_out, out, upper[some])
                sums[some] = np.add.reduceat(share[ends], np.cumsum(many) - many)
            return sums
        ends, many = _followed(first_in, into, lower)
        return np.bincount(ends, np.repeat(share[lower], many), n)[upper]

    total = np.zeros(n)
    for source in asked["sources"][0].as_py():
        sigma, known = np.zeros(n), np.zeros(n, bool)
        sigma[source], known[source] = 1.0, True
        levels, rest = [np.array([source])], len(out) - ins[source]
        while rest and len(levels[-1]):
            levels.append(met(levels[-1], sigma, known, rest))
            known[levels[-1]] = True
            rest -= ins[levels[-1]].sum()
        delta = np.zeros(n)
        for upper, lower in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
            share = np.zeros(n)
            share[lower] = (1.0 + delta[lower]) / sigma[lower]
            delta[upper] = sigma[upper] * returned(upper, lower, share)
        total += delta
    at = np.flatnonzero(total).astype(np.int32)
    return pa.table({"graph": pa.repeat(key[0], len(at)), "at": at, "score": total[at]})


def _by_rounds(placed: DataFrame, arcs: DataFrame, start: DataFrame, batches: int) -> DataFrame:
    """(repo_id, path, score) of the nodes ``placed(repo_id, path, component)``, by rounds of block products."""
    order = ["repo_id", "component", "path"]
    placed = durable(placed.select(*order))
    ids = durable(placed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "repo_id", "path", F.monotonically_increasing_id().alias("id")))
    numbered = durable(
        arcs.join(ids.withColumnsRenamed({"path": "src", "id": "a"}), ["repo_id", "src"])
        .join(ids.withColumnsRenamed({"path": "dst", "id": "b"}), ["repo_id", "dst"]).select("a", "b"))
    blocks = _arc_blocks(numbered)
    start = durable(ids.join(start, ["repo_id", "path"], "left_semi").select("id"))
    partial = [
        _accumulate(start.filter(F.pmod(F.xxhash64(F.shiftright("id", SOURCE)), F.lit(batches)) == i) if batches > 1 else start, blocks)
        for i in range(batches)
    ]
    sums = reduce(DataFrame.unionByName, partial).groupBy("id").agg(F.sum("score").alias("score"))
    return ids.join(sums, "id").drop("id")


def _arc_blocks(arcs: DataFrame) -> DataFrame:
    """(part, to, arcs): the arcs (a, b) from one part to another as numbers, at most 512 times 512."""
    def pack(key, table):
        return pa.table({"part": [key[0].as_py()], "to": [key[1].as_py()], "arcs": [table["code"].to_numpy().astype("<i4").tobytes()]})

    last = F.lit(NODES - 1)
    code = F.shiftleft(F.col("a").bitwiseAND(last), NODE).bitwiseOR(F.col("b").bitwiseAND(last)).cast("int")
    packed = measured(
        arcs.select(F.shiftright("a", NODE).alias("part"), F.shiftright("b", NODE).alias("to"), code.alias("code"))
        .groupBy("part", "to").applyInArrow(pack, "part long, to long, arcs binary"), F.sum(F.octet_length("arcs")).alias("size"))
    small = (packed.seen["size"] or 0) <= broadcast_limit(arcs.sparkSession)
    return F.broadcast(packed.df) if small else packed.df


def _dense(cells: bytes, vals: bytes) -> np.ndarray:
    out = np.zeros(SOURCES * NODES)
    out[np.frombuffer(cells, "<i4")] = np.frombuffer(vals, "<f8")
    return out


def _packed(dense: np.ndarray) -> tuple[bytes, bytes]:
    cells = np.flatnonzero(dense)
    return cells.astype("<i4").tobytes(), dense[cells].astype("<f8").tobytes()


def _push(state: DataFrame, blocks: DataFrame, back: bool = False) -> DataFrame:
    """What each block of sources hands along the arcs of its parts, or against them, not yet summed per part."""
    def product(cells, vals, arcs):
        codes = np.frombuffer(arcs, "<i4")
        matrix = np.zeros((NODES, NODES))
        matrix[codes >> NODE, codes & (NODES - 1)] = 1.0
        return _packed((_dense(cells, vals).reshape(SOURCES, NODES) @ (matrix.T if back else matrix)).ravel())

    run = F.udf(product, "cells binary, vals binary", useArrow=False)
    way = blocks.select(F.col("to").alias("part"), F.col("part").alias("to"), "arcs") if back else blocks
    sent = state.join(way, "part").select("block", F.col("to").alias("part"), run("cells", "vals", "arcs").alias("x"))
    return sent.select("block", "part", "x.cells", "x.vals")


def _row(key, cells: bytes, vals: bytes):
    return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "cells": [cells], "vals": [vals]})


def _tagged(sent: DataFrame, known: DataFrame):
    return sent.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True))).groupBy("block", "part")


def _rows(table):
    return zip(table["known"].to_pylist(), table["cells"].to_pylist(), table["vals"].to_pylist(), strict=True)


def _first_met(key, table):
    """What arrives at pairs that were not met before."""
    total, met = np.zeros(SOURCES * NODES), []
    for known, cells, vals in _rows(table):
        if known:
            met.append(np.frombuffer(cells, "<i4"))
        else:
            total += _dense(cells, vals)
    for cells in met:
        total[cells] = 0.0
    cells, vals = _packed(total)
    return _row(key, cells, vals).slice(0, 1 if cells else 0)


def _joined(key, table):
    cells, vals = b"".join(table["cells"].to_pylist()), b"".join(table["vals"].to_pylist())
    return _row(key, cells, vals)


def _shares(key, table):
    """Dependencies of a level: its path counts times what comes back; with what it hands back and the sums of its nodes."""
    total, sigma = np.zeros(SOURCES * NODES), None
    for known, cells, vals in _rows(table):
        if known:
            sigma = _dense(cells, vals)
        else:
            total += _dense(cells, vals)
    met = sigma is not None
    sigma = sigma if met else np.zeros_like(total)
    delta = sigma * total
    cells, vals = _packed(np.divide(1.0 + delta, sigma, out=np.zeros_like(sigma), where=sigma != 0))
    return _row(key, cells, vals).append_column("scores", pa.array([delta.reshape(SOURCES, NODES).sum(axis=0)], pa.list_(pa.float64()))).slice(
        0, 1 if met else 0)


def _accumulate(start: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, score): the dependencies of all sources ``start(id)`` on each node."""
    def own(key, table):
        number = table["id"].to_numpy()
        dense = np.zeros((SOURCES, NODES))
        dense[number & (SOURCES - 1), number & (NODES - 1)] = 1.0
        cells, vals = _packed(dense.ravel())
        return _row(key, cells, vals)

    # a block of sources lies in one part
    first = measured(start.select("id", F.shiftright("id", SOURCE).alias("block"), F.shiftright("id", NODE).alias("part"))
                     .groupBy("block", "part").applyInArrow(own, STATE))
    levels: list[Cut] = [first]
    seen = first.df
    while levels[-1].rows:
        levels.append(measured(_tagged(_push(levels[-1].df, blocks), seen).applyInArrow(_first_met, STATE)))
        seen = seen.union(levels[-1].df)
        if len(levels) % COMPACT_EVERY == 0:
            seen = durable(seen.groupBy("block", "part").applyInArrow(_joined, STATE))
    levels.pop()
    sums = [first.df.sparkSession.createDataFrame([], "id long, score double")]
    below: DataFrame | None = None
    for level in reversed(levels[1:]):
        sent = level.df.limit(0) if below is None else _push(below.select("block", "part", "cells", "vals"), blocks, back=True)
        below = durable(_tagged(sent, level.df).applyInArrow(_shares, STATE + ", scores array<double>"))
        each = below.select("part", F.posexplode("scores").alias("at", "score")).filter("score <> 0")
        sums.append(each.groupBy("part", "at").agg(F.sum("score").alias("score")).select(
            (F.col("part") * NODES + F.col("at")).alias("id"), "score"))
    return reduce(DataFrame.unionByName, sums)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
