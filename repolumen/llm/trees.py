"""Links of a Jaccard join by prefix trees over groups of sets that share a value."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest_reachable, written

#: What one tree holds at most, unless a single set is larger: sets, and n-grams of all sets together.
HELD, GRAMS = 512, 1 << 20
#: An edge's n-grams that are counted between two looks at the bounds.
CHUNK = 64


def tree_links(stored, sizes, names, probes, probe_sizes, probe_names, num: int, den: int, label: dict) -> list[tuple[int, int]]:
    """Links between stored sets and probes, enough of them to join all that are similar and had different labels.

    A set is its ascending ranks in the global order, and its size, which may count n-grams that no other set has.
    Stored sets are sorted, so that equal beginnings are neighbours: this is the tree, with each edge a stretch of
    ranks that all sets below it share. The tree is walked once for all probes together: an edge's n-grams are
    counted for the probes that are still in question, however many sets lie below. A probe leaves a subtree once its
    overlap and the longest rest below cannot reach what the smallest set below would need, or sizes are too
    different. ``label`` (name: component) is updated as links are found.
    """
    import numpy as np

    order = sorted(range(len(stored)), key=lambda i: stored[i].astype(">u4").tobytes())
    rows, n = [stored[i] for i in order], np.array([sizes[i] for i in order], np.int64)
    names = [names[i] for i in order]
    length = np.array([len(r) for r in rows], np.int64)
    shared = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        m = min(length[i - 1], length[i])
        differ = np.nonzero(rows[i - 1][:m] != rows[i][:m])[0]
        shared[i] = differ[0] if len(differ) else m
    probe_n = np.array(probe_sizes, np.int64)
    # who holds each rank, among the probes
    ranks = np.concatenate(probes) if probes else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    by_rank = np.argsort(ranks, kind="stable")
    ranks, owner = ranks[by_rank], owner[by_rank]
    component = np.array([label[x] for x in probe_names], np.int64)
    links = []

    def bounded(active, overlap, lo, hi, depth):
        most, least, size = int((length[lo:hi]).max()) - depth, int(n[lo:hi].min()), probe_n[active]
        keep = ((num + den) * (overlap + most) >= num * (size + least)) & (den * size >= num * least) & (
            den * int(n[lo:hi].max()) >= num * size)
        if hi - lo == 1:
            keep &= component[active] != label[names[lo]]
        return active[keep], overlap[keep]

    everyone = np.arange(len(probes))
    todo = [(0, len(rows), 0, everyone, np.zeros(len(probes), np.int64))] if rows and probes else []
    while todo:
        lo, hi, depth, active, overlap = todo.pop()
        end = int(length[lo]) if hi - lo == 1 else int(min(shared[lo + 1:hi].min(), length[lo]))
        active, overlap = bounded(active, overlap, lo, hi, depth)
        while depth < end and len(active):
            some = rows[lo][depth:min(end, depth + CHUNK)]
            left, right = np.searchsorted(ranks, some, "left"), np.searchsorted(ranks, some, "right")
            held = np.concatenate([owner[a:b] for a, b in zip(left, right, strict=True)])
            overlap = overlap + np.bincount(held, minlength=len(probes))[active]
            depth += len(some)
            active, overlap = bounded(active, overlap, lo, hi, depth)
        if not len(active):
            continue
        at = lo
        while at < hi and length[at] == depth:  # sets that end here
            mine, common = active, overlap
            near = mine[((num + den) * common >= num * (probe_n[mine] + n[at]))]
            for y in near:
                a, b = label[names[at]], label[probe_names[y]]
                if a != b:
                    links.append((names[at], probe_names[y]))
                    old, new = max(a, b), min(a, b)
                    for k, v in label.items():
                        if v == old:
                            label[k] = new
                    component[component == old] = new
            at += 1
        cuts = [at, *(i for i in range(at + 1, hi) if shared[i] == depth), hi]
        todo += [(a, b, depth, active, overlap) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return links


ROWS = "a bigint, b bigint"


def _compared(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links within each (lead, part) of (lead, part, id, n, grams, often, stored, asks, label).

    Spark deals the groups to tasks and sorts them; a task holds one group at a time.
    """
    fields = ["lead", "part", "id", "n", "grams", "often", "stored", "asks", "label"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solved(parts):
            got, sets = {f: [] for f in fields[2:]}, []
            for part in parts:
                for f in ("id", "n", "stored", "asks", "label"):
                    got[f] += part.column(f).to_pylist()
                grams, often = part.column("grams"), part.column("often")
                flat = grams.flatten().to_numpy(zero_copy_only=False)
                freq = often.flatten().to_numpy(zero_copy_only=False) if often.null_count == 0 else np.zeros(len(flat), np.int64)
                at = np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))])
                sets += [(flat[i:j], freq[i:j]) for i, j in zip(at, at[1:], strict=False)]
            seen, first, back = np.unique(np.concatenate([s for s, _ in sets]), return_index=True, return_inverse=True)
            freq = np.concatenate([f for _, f in sets])[first]
            rank = np.empty(len(seen), np.int64)
            rank[np.lexsort((seen, freq))] = np.arange(len(seen))
            ranks, at, ordered = rank[back], 0, []
            for s, _ in sets:
                ordered.append(np.sort(ranks[at:at + len(s)]))
                at += len(s)
            label = dict(zip(got["id"], got["label"], strict=True))
            store = [i for i, x in enumerate(got["stored"]) if x]
            ask = [i for i, x in enumerate(got["asks"]) if x]
            pick = lambda at: ([ordered[i] for i in at], [got["n"][i] for i in at], [got["id"][i] for i in at])
            return tree_links(*pick(store), *pick(ask), num, den, label)

        def groups():
            held, key = [], None
            for batch in batches:
                lead, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "part"))
                turns = np.nonzero((lead[1:] != lead[:-1]) | (part[1:] != part[:-1]))[0] + 1
                cuts = [0, *turns.tolist(), batch.num_rows]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if i == j:
                        continue
                    if held and key != (lead[i], part[i]):
                        yield held
                        held = []
                    key = (lead[i], part[i])
                    held.append(batch.slice(i, j - i))
            if held:
                yield held

        for group in groups():
            links = solved(group)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.select(*fields).repartition("lead", "part").sortWithinPartitions("lead", "part")
    return dealt.mapInArrow(run, ROWS)


def links_of(filed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links of ``100 * num / den`` percent or more, enough to join all sets that share a value and are linked.

    ``filed`` (value, id): what each set can be found by. ``sets`` (id, n, grams, often), written: size, n-grams of 64
    bits, and how often each is held if that is to order them (null: by value). All sets of a value form a group with
    that of the first of them in a fixed random order, the lead; groups of the same lead are one, so sets that share
    many values, as copies do, meet once and not in every value. A group too large for one tree is divided in blocks:
    each is compared within, together with the lead; then only sets that are not yet joined with the lead, by any
    links so far, are held against every block. Nothing is left out, and no more links than sets come from a tree.
    """
    first = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"]
    leads = written(filed.groupBy("value").agg(first.alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "leads")
    members = written(filed.join(leads, "value").select("lead", "id").distinct(), "members")
    load = members.join(sets.select("id", F.size("grams").alias("g")), "id").groupBy("lead").agg(
        F.count(F.lit(1)).alias("c"), F.sum("g").alias("g"))
    blocks = F.greatest(F.ceil(F.col("c") / HELD), F.ceil(F.col("g") / GRAMS)).cast("int")
    load = written(load.filter("c > 1").select("lead", blocks.alias("blocks")), "loads")

    def laid(rows: DataFrame) -> DataFrame:
        return rows.join(sets, "id")

    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    own = members.join(load, "lead").withColumn("part", part)
    crowds = written(load.filter("blocks > 1"), "crowds")
    crowded = not crowds.isEmpty()
    both = [F.lit(True).alias("stored"), F.lit(True).alias("asks"), F.col("id").alias("label")]
    inside = own.select("lead", "part", "id")
    if crowded:
        every = crowds.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("lead").alias("id"))
        inside = inside.union(every).distinct()
    links = written(_compared(laid(inside).select("*", *both), num, den), "links")
    if not crowded:
        return links

    up = smallest_reachable(links)
    named = members.join(crowds, "lead").join(up.select(F.col("u").alias("id"), "v"), "id", "left").select(
        "lead", "id", "blocks", F.coalesce("v", "id").alias("label"))
    chief = crowds.select("lead").join(up.select(F.col("u").alias("lead"), "v"), "lead", "left").select(
        "lead", F.coalesce("v", "lead").alias("chief"))
    named = written(named.join(chief, "lead"), "named")
    outer = named.filter("label != chief")
    asked = written(outer.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("turns")), "turns")
    stored = named.join(asked, "lead").select(
        "lead", part.alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "blocks", "id", "label",
        F.lit(True).alias("stored"), F.lit(False).alias("asks"))
    asking = outer.join(asked, "lead").select(
        "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("turns")).cast("int").alias("turn"),
        "blocks", "id", "label", F.lit(False).alias("stored"), F.lit(True).alias("asks"))
    rows = stored.unionByName(asking).groupBy("lead", (F.col("turn") * F.col("blocks") + F.col("block")).alias("part"), "id", "label").agg(
        F.max("stored").alias("stored"), F.max("asks").alias("asks"))
    return links.union(written(_compared(laid(rows), num, den), "links"))
