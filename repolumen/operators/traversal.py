"""Breadth-first work as rounds of joins.

One loop serves every reachability operator: a frontier keyed by a search (seed, trace, pull
request or the repository itself) is joined with the edges, what was seen before is removed by
an anti-join, and the rest is the next frontier. Each round is one job that also measures the
frontier; a measured-small frontier is broadcast, a larger one shuffles to the edges, which are
laid out once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cut, durable, measured, together
from .components import strongly_connected
from .graph_stats import fan_in
from .layout import Layout, lay_out

COMPACT_EVERY = 8


def expand(
    seeds: DataFrame,
    edges: DataFrame | Layout,
    keys: list[str],
    reverse: bool = False,
    max_depth: int | None = None,
    mark_seeds: bool = True,
) -> DataFrame:
    """All nodes reached from ``seeds(keys…, node)``: (keys…, node, depth), depth of the first visit.

    ``keys`` contains ``repo_id``. With ``mark_seeds=False`` the seeds are not taken as visited:
    they appear only when a path leads back to them. ``edges`` may be laid out already, in the direction of the walk;
    seeds that it does not name reach themselves only. Searches and nodes are numbers in the loop, and only these
    numbers are shuffled.
    """
    given = edges if isinstance(edges, Layout) else None
    walk = given or lay_out(edges, reverse=reverse)
    start = walk.ids(seeds.select(*keys, "node").distinct().withColumnRenamed("node", "seed_node"), "seed_node")
    search = keys != ["repo_id"]
    if search:  # ids are numbers over all repositories, so a search by repository needs no key of its own
        searches = durable(seeds.select(*keys).distinct().withColumn("search", F.monotonically_increasing_id()))
        start = start.join(searches, keys)
    start = durable(start)
    by = ["search", "node"] if search else ["node"]
    first = measured(start.filter(F.col("node").isNotNull()).select(*by, "parts", F.lit(0).alias("depth")))
    seen: list[Cut] = [first] if mark_seeds else []
    frontier, level = first, 0
    while frontier.rows and (max_depth is None or level < max_depth):
        level += 1
        found = walk.follow(frontier.for_join().select(*by, "parts")).select(
            *by[:-1], F.col("next").alias("node"), F.col("next_parts").alias("parts")).distinct()
        if seen:
            found = found.join(together(seen).for_join().select(*by), by, "left_anti")
        frontier = measured(found.withColumn("depth", F.lit(level)))
        if frontier.rows:
            seen.append(frontier)
        if len(seen) >= COMPACT_EVERY:
            seen = [measured(together(seen).df)]
    reached = together(seen).df if seen else first.df.limit(0)
    reached = walk.named(reached, "reached").drop("parts")
    if search:
        reached = reached.drop("repo_id").join(searches, "search").drop("search")
    out = reached.select(*keys, F.col("reached").alias("node"), "depth")
    if mark_seeds:
        out = out.union(start.filter(F.col("node").isNull()).select(*keys, "seed_node", F.lit(0)))
    if given is None:
        walk.drop()
    return out


def risk_level(n):
    return F.when(n > 20, "CRITICAL").when(n > 10, "HIGH").when(n > 3, "MEDIUM").otherwise("LOW")


def blast_radius(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_id, seed, affected): every transitive importer of each modified file.

    A seed affects itself only through a cycle.
    """
    start = seeds.select("repo_id", F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
    reached = expand(start, edges, ["repo_id", "seed"], reverse=True, mark_seeds=False)
    return reached.select("repo_id", "seed", F.col("node").alias("affected"))


def blast_risk(affected: DataFrame, seeds: DataFrame) -> DataFrame:
    counts = affected.groupBy("repo_id", "seed").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return (
        seeds.select("repo_id", F.col("path").alias("seed")).distinct()
        .join(counts, ["repo_id", "seed"], "left")
        .select("repo_id", "seed", n.alias("n"), risk_level(n).alias("risk"))
    )


def blast_levels(edges: DataFrame, seeds: DataFrame, most: int = 20) -> DataFrame:
    """(repo_id, seed, n, risk) as ``blast_risk`` has it, without listing what is affected; n is ``most + 1`` for all above.

    A node keeps the ``most + 1`` smallest ids of the files that reach it, which suffice to tell every count up to
    ``most`` and thereby the risk. Ids are handed against the imports until nothing changes: of what arrives at a node,
    only ids that enter its list go on. So the state has at most ``most + 1`` rows a node, however many files a seed
    affects, and a hub's list is cut in each task before it is shuffled. ``most`` is 20 at least.
    """
    walk = lay_out(edges, seeds)  # an importer's id goes to what it imports
    kept = max(most, 20) + 1
    smallest = Window.partitionBy("node").orderBy("id")
    hand = ["node", "parts", "id"]

    def lists(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(smallest)).filter(F.col("rn") <= kept).drop("rn")

    first = walk.arcs.select(F.col("next").alias("node"), F.col("next_parts").alias("parts"), F.col("node").alias("id")).distinct()
    state = measured(lists(first).withColumn("new", F.lit(True)))
    entered = state.rows
    while entered:
        sent = walk.follow(state.df.filter("new").select(*hand)).select(
            F.col("next").alias("node"), F.col("next_parts").alias("parts"), "id").distinct()
        known = state.df.select(*hand, F.lit(False).alias("new"))
        # one row of an id that a node had and gets again, which is not new
        both = known.unionByName(sent.withColumn("new", F.lit(True))).groupBy(*hand).agg(F.min("new").alias("new"))
        state = measured(lists(both), F.count_if("new").alias("entered"))
        entered = state.seen["entered"]
    counts = walk.named(state.df.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "seed")
    n = F.coalesce("n", F.lit(0))
    out = seeds.select("repo_id", F.col("path").alias("seed")).distinct().join(counts, ["repo_id", "seed"], "left").select(
        "repo_id", "seed", F.least(n, F.lit(most + 1)).alias("n"), risk_level(n).alias("risk"))
    walk.drop()
    return out


def node_blast(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The variant that includes the start node, with the edges walked: (nodes, edges)."""
    start = seeds.select("repo_id", F.col("path").alias("seed"), F.col("path").alias("node"))
    nodes = durable(expand(start, edges, ["repo_id", "seed"], reverse=True).select("repo_id", "seed", "node"))
    walked = edges.join(nodes.withColumnRenamed("node", "dst"), ["repo_id", "dst"]).select(
        "repo_id", "seed", "src", "dst")
    return nodes, walked


def _numbered(rows: DataFrame, *order: str) -> Cut:
    """``rows`` with a ``block`` of up to 64 neighbours in this order, and the ``bit`` of each in it."""
    rows = durable(rows)  # a range partitioning reads its input twice
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    return measured(ranged.select("*", F.shiftright("id", 6).alias("block"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bit")).drop("id"))


def pr_blast(edges: DataFrame, nodes: DataFrame, pr_files: DataFrame) -> DataFrame:
    """(repo_id, pr_number, path, class): modified files of a change set and what they reach upstream.

    Nodes of the repository that are absent are unaffected (``pr_unaffected`` lists them). Files that reach each other
    are reached together, so the walk runs over the strongly connected components and what lies between these. Which
    files of a block of 64 a change set modifies is one number; the files themselves are listed last, and nothing but
    blocks is shuffled or written.
    """
    keys = ["repo_id", "pr_number"]
    arcs = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("repo_id", "src", "dst")
    joined = strongly_connected(arcs.select("repo_id", F.col("src").alias("path")), arcs)
    members = _numbered(joined.select("repo_id", "path", F.col("scc_id").alias("group")), "repo_id", "group", "path")
    group = members.for_join().select("repo_id", "path", "group")
    between = measured(
        arcs.join(group.withColumnsRenamed({"path": "src", "group": "a"}), ["repo_id", "src"])
        .join(group.withColumnsRenamed({"path": "dst", "group": "b"}), ["repo_id", "dst"])
        .filter(F.col("a") != F.col("b")).select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    known = pr_files.filter(F.col("repo_id").isNotNull() & F.col("pr_number").isNotNull()).select(*keys, "path").join(
        members.for_join(), ["repo_id", "path"], "left")
    # a file that no edge names reaches itself only, and keeps its name
    stray = F.when(F.col("block").isNull(), F.struct("path"))
    touched = durable(known.groupBy(*keys, "group", "block", stray.alias("stray")).agg(F.bit_or("bit").alias("modified")))
    start = touched.filter(F.col("group").isNotNull()).select(*keys, F.col("group").alias("node")).distinct()
    if between.rows:
        start = expand(start, between.df, keys, reverse=True)
    blocks = members.df.select("repo_id", "group", "block").distinct()
    words = touched.filter(F.col("group").isNotNull()).select(*keys, "group", "block", "modified")
    reached = durable(
        start.select(*keys, F.col("node").alias("group")).join(blocks, ["repo_id", "group"])
        .join(words, [*keys, "group", "block"], "left")
        .select(*keys, "group", "block", F.coalesce("modified", F.lit(0)).alias("modified")))
    met = reached.join(members.for_join(), ["repo_id", "group", "block"]).select(
        *keys, "path", F.when(F.col("modified").bitwiseAND(F.col("bit")) != 0, "modified").otherwise("blast").alias("class"))
    return met.union(touched.filter(F.col("stray").isNotNull()).select(*keys, "stray.path", F.lit("modified")))


def pr_edge_classes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between touched nodes: ``modified`` when both ends are in the change set, else ``hot``.

    ``classes`` is what ``pr_blast`` gives over the same edges: whoever imports a touched file is touched too. So an
    edge counts wherever the file it leads to does, and only edges to a modified file ask whether the other end is
    modified, by blocks of 64.
    """
    keys = ["repo_id", "pr_number"]
    ends = durable(edges.select("repo_id", "src", "dst"))
    target = classes.withColumnRenamed("path", "dst")
    # few rows become very many: a fixed number of tasks, which are not merged for being small before the join
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = target.filter(F.col("class") != "modified").repartition(n, "repo_id", "dst").join(ends, ["repo_id", "dst"]).select(
        *keys, "src", "dst", F.lit("hot").alias("class"))
    importers = _numbered(ends.select("repo_id", "src").distinct(), "repo_id", "src")
    arcs = durable(ends.join(importers.for_join(), ["repo_id", "src"]))
    changed = durable(target.filter(F.col("class") == "modified").select(*keys, "dst"))
    words = changed.withColumnRenamed("dst", "src").join(importers.for_join(), ["repo_id", "src"]).groupBy(*keys, "block").agg(
        F.bit_or("bit").alias("modified"))
    asked = changed.join(arcs.select("repo_id", "dst", "block").distinct(), ["repo_id", "dst"]).join(words, [*keys, "block"], "left").repartition(n, "repo_id", "dst", "block")
    both = F.coalesce(F.col("modified").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return hot.union(asked.join(arcs, ["repo_id", "dst", "block"]).select(
        *keys, "src", "dst", F.when(both, "modified").otherwise("hot")))


def pr_unaffected_counts(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Per pull request how many nodes are modified, in the blast, and unaffected."""
    total = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    known = classes.join(nodes.withColumn("is_node", F.lit(1)), ["repo_id", "path"], "left")
    return (
        known.groupBy("repo_id", "pr_number").agg(
            F.count_if(F.col("class") == "modified").alias("modified"),
            F.count_if(F.col("class") == "blast").alias("blast"),
            F.count("is_node").alias("touched_nodes"))
        .join(total, "repo_id")
        .select("repo_id", "pr_number", "modified", "blast",
                (F.col("total") - F.col("touched_nodes")).alias("unaffected"))
    )


def entry_seeds(nodes: DataFrame, entries: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Entry points that are graph keys; repositories without any start from the top-k fan-in files."""
    present = entries.select("repo_id", "path").distinct().join(nodes, ["repo_id", "path"], "left_semi")
    top = Window.partitionBy("repo_id").orderBy(F.desc("fan_in"), "path")
    busiest = (
        fan_in(edges).withColumn("rn", F.row_number().over(top)).filter(F.col("rn") <= k)
        .select("repo_id", "path")
        .join(present.select("repo_id").distinct(), "repo_id", "left_anti")
    )
    return present.unionByName(busiest)


def bfs_depth(edges: DataFrame, nodes: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(repo_id, path, depth) of everything that the entry points import, within ``max_depth`` steps if given."""
    seeds = entry_seeds(nodes, entries, edges).withColumnRenamed("path", "node")
    return expand(seeds, edges, ["repo_id"], max_depth=max_depth).select(
        "repo_id", F.col("node").alias("path"), "depth")


def layer_sizes(depths: DataFrame) -> DataFrame:
    return depths.filter(F.col("depth") >= 1).groupBy("repo_id", "depth").agg(F.count(F.lit(1)).alias("files"))


def fallback_fill(chosen: DataFrame, ranked: DataFrame, quota: int, depth: int) -> DataFrame:
    """Top up ``chosen(repo_id, path, depth)`` from ``ranked(repo_id, position, path)`` to the quota."""
    counts = chosen.groupBy("repo_id").agg(F.count(F.lit(1)).alias("have"))
    order = Window.partitionBy("repo_id").orderBy("position", "path")
    extra = (
        ranked.join(chosen, ["repo_id", "path"], "left_anti")
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= quota)
        .join(counts, "repo_id", "left")
        .filter(F.col("rn") <= quota - F.coalesce("have", F.lit(0)))
        .select("repo_id", "path", F.lit(depth).alias("depth"))
    )
    return chosen.select("repo_id", "path", "depth").unionByName(extra)


def files_by_depth(
    edges: DataFrame, nodes: DataFrame, entries: DataFrame,
    max_depth: int | None = None, max_nodes: int | None = None, fallback: DataFrame | None = None,
) -> DataFrame:
    """File selection by import depth; with ``max_nodes`` filled from a ranking, or cut, to so many per repository.

    Files from the ranking count as one step beyond ``max_depth``, which a fallback therefore needs.
    """
    chosen = bfs_depth(edges, nodes, entries, max_depth)
    if max_nodes is None:
        return chosen
    if fallback is not None:
        chosen = fallback_fill(chosen, fallback, max_nodes, max_depth + 1)
    order = Window.partitionBy("repo_id").orderBy("depth", "path")
    return chosen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max_nodes).drop("rn")


def reachability(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Every graph key with whether an entry point leads to it."""
    seeds = entries.select("repo_id", F.col("path").alias("node"))
    reached = expand(seeds, edges, ["repo_id"]).select("repo_id", F.col("node").alias("path"), F.lit(1).alias("hit"))
    return nodes.join(reached, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.col("hit").isNotNull().alias("reachable"))


def dead_code_score(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Percent of the keys that are reached; may pass 100 when entries or targets are no keys."""
    seeds = entries.select("repo_id", F.col("path").alias("node"))
    reached = expand(seeds, edges, ["repo_id"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("reached"))
    return (
        nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("keys")).join(reached, "repo_id", "left")
        .select("repo_id", "keys", F.coalesce("reached", F.lit(0)).alias("reached"),
                (F.coalesce("reached", F.lit(0)) / F.col("keys") * 100).alias("score"))
    )


def site_traversal(
    crashes: DataFrame, edges: DataFrame, fan_in_rows: DataFrame, reach: int = 3, max_nodes: int | None = None,
) -> DataFrame:
    """(repo_id, site, file, …): files around each distinct crash site in both directions.

    Relevance falls with the distance, to nothing at ``reach`` steps, where the walk ends, and grows with the fan-in.
    The walk depends on the site only, so it runs once however many traces end there; all that follows from it alone
    (ranks, shares) is computed per site too and joined to the traces last.
    """
    keys = ["repo_id", "site"]
    start = durable(crashes.select("repo_id", F.col("path").alias("site")).distinct()).withColumn("node", F.col("site"))

    # both directions in one walk: each node stands for two, one that is left along its imports and one against them
    ways = ("downstream", "upstream")
    arcs = edges.select("repo_id", "src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    sided = [arcs.select("repo_id", F.concat(F.lit(w[0]), a).alias("src"), F.concat(F.lit(w[0]), b).alias("dst"))
             for w, a, b in zip(ways, ("src", "dst"), ("dst", "src"), strict=True)]
    seeds = start.select(*keys, F.explode(F.array(*[F.concat(F.lit(w[0]), "node") for w in ways])).alias("node"))
    met = expand(seeds, sided[0].union(sided[1]), keys, max_depth=reach).filter(F.col("depth") > 0)
    sides = met.select(*keys, F.substring("node", F.lit(2), F.length("node")).alias("file"), F.col("depth").alias("distance"),
                       F.when(F.substring("node", 1, 1) == ways[0][0], ways[0]).otherwise(ways[1]).alias("relationship"))
    site = start.select(*keys, F.col("node").alias("file"), F.lit(0).alias("distance"),
                        F.lit("crash_site").alias("relationship"))
    fan = F.coalesce("fan_in", F.lit(0))
    relevance = F.when(F.col("relationship") == "crash_site", F.lit(1000.0)).otherwise(
        (F.lit(reach) - F.col("distance")) * (F.lit(1.0) + F.log(fan + 1.0)))
    around = (
        site.unionByName(sides)
        .join(fan_in_rows.withColumnRenamed("path", "file"), ["repo_id", "file"], "left")
        .select(*keys, "file", "distance", fan.alias("fan_in"), "relationship", relevance.alias("relevance_score"))
    )
    return around if max_nodes is None else most_relevant(around, max_nodes).drop("rn")


def most_relevant(around: DataFrame, n: int) -> DataFrame:
    """The ``n`` most relevant files of each site with their rank ``rn``."""
    order = Window.partitionBy("repo_id", "site").orderBy(
        F.desc(F.round("relevance_score", 9)), "distance", "relationship", "file")
    return around.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def by_trace(crashes: DataFrame, per_site: DataFrame) -> DataFrame:
    """What is known of each site for every trace that ends there."""
    return crashes.select("repo_id", "trace_id", F.col("path").alias("site")).join(per_site, ["repo_id", "site"]).drop("site")
