"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import divided, fresh, written

#: Slices of a source's key order, so that one large source is summed by many tasks. Results do not depend on it.
SLICES = 1024


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(divided(text), "")), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A document's weight: the share of its characters that are letters or white space, 0.05 at least."""
    other = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - other / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, total: float | None = None) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn, again and again, and share ``total`` (all sizes
    by default). A target stops at ``most`` times its source's size; the excess is shared again by weight among the
    others until none is above. The table has a row per source; every round is one small grouping of it.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = written(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("deal", F.spark_partition_id()), "sources")
    before = dealt.groupBy("deal").count().withColumn("before", F.coalesce(F.sum("count").over(
        Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = (F.row_number().over(Window.partitionBy("deal").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before"))
    placed = dealt.join(before, "deal").select("source", "source_size", (turn % len(weights)).alias("turn"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn").cast("int") + 1)
    state = written(placed.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "targets")
    whole = total
    while True:
        free = state.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(F.col("full"), most * F.col("source_size"))).alias("given"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        if whole is None:
            whole = float(free["all"] or 0)
        rest, share = whole - float(free["given"] or 0), float(free["weight"] or 0.0)
        each = F.lit(max(0.0, rest)) * F.col("weight") / share if share else F.lit(0.0)
        above = ~F.col("full") & (each > most * F.col("source_size"))
        if share == 0 or state.filter(above).isEmpty():
            return state.select("source", "source_size", F.when(
                F.col("full"), most * F.col("source_size").cast("double")).otherwise(each).alias("target"))
        state = written(state.withColumn("full", F.col("full") | above), "targets")


def mix(docs: DataFrame, size: Column, quality: Column, key: str = "doc_id", source: str = "source", text: str = "text",
        into: str = "mix", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 0, keep_text: bool = True) -> DataFrame:
    """The table with a struct ``into``: size, source_size, target, copies (how often the mix takes the document).

    A document's key is ``-ln(u) / quality``, with ``u`` in (0, 1) from a hash of its id, so that the order within a
    source is a weighted sample without replacement, and reruns agree. A source whose target is ``k`` times its size
    and a part gives every document ``k`` times; the part is filled in key order, up to the document that comes
    nearest to it. So the words taken differ from the target by at most half of one document, and none is taken
    more than ``most`` times. Ties go by id, then text; rows equal in both are taken together. Null ids draw by
    their text. Documents without words are taken with their neighbours. Empty tables give no rows.

    Per source, sizes are summed by slices of the key order, and only the slice that holds the end of the part is
    looked at row by row; so a large source is no single task, and texts are neither copied nor shuffled: keys and
    sizes are written without them, and computed again for a result that has them (unless ``keep_text`` is false).
    """
    kept, a = [c for c in docs.columns if c != into and (keep_text or c != text)], fresh(docs, "mix")
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(text), F.lit(""))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)
    rows = docs.select(*kept, F.struct(
        size.alias("size"), (-F.log(u) / quality).alias("key"), F.col(key).isNull().alias("none"), F.col(key).alias("id"),
        F.xxhash64(text).alias("hash")).alias(a))
    rows = rows if keep_text else written(rows, "drawn")
    drawn = rows.select(F.col(source).alias("source"), f"{a}.*")
    drawn = written(drawn, "drawn") if keep_text else drawn
    ends = written(_ends(drawn, written(source_targets(drawn, weights, most), "targets")), "ends")
    b = fresh(docs, "end")
    ends = ends.select(F.struct("*").alias(b))
    joined = rows.join(ends, F.col(source).eqNullSafe(F.col(f"{b}.source")))
    inside = F.coalesce(F.struct(*[F.col(f"{a}.{c}") for c in ORDER]) <= F.col(f"{b}.end"), F.lit(False))
    return joined.select(*[F.col(c) for c in kept], F.struct(
        f"{a}.size", f"{b}.source_size", f"{b}.target",
        (F.col(f"{b}.epochs") + inside.cast("int")).cast("int").alias("copies")).alias(into))


#: What orders the documents of a source.
ORDER = ("key", "none", "id", "hash")


def _ends(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, end): whole epochs, and the last place of the part; null if it is empty."""
    slice_of = F.least(F.lit(SLICES - 1), F.floor(F.lit(SLICES) * (1 - F.exp(-F.col("key")))).cast("int"))
    places = drawn.withColumn("slice", slice_of)
    sums = places.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", epochs.cast("int")).withColumn(
        "part", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("slice")
    # the slice in which the part ends, and the sum of those before it
    last = sums.withColumn("before", F.sum("size").over(up_to) - F.col("size")).join(
        plan.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
    last = last.filter((F.col("part") > 0) & (F.col("before") < F.col("part"))).groupBy("s").agg(
        F.max(F.struct("slice", "before", "part")).alias("last")).select("s", "last.*")
    near = places.join(
        last.withColumnRenamed("slice", "last"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("last")))
    units = near.groupBy("s", "part", "before", *ORDER).agg(F.sum("size").alias("size"))
    order = Window.partitionBy("s").orderBy(*ORDER)
    units = units.withColumn("sum", F.col("before") + F.sum("size").over(order))
    # taken are those that bring the sum nearer to the part
    taken = units.filter(2 * F.col("sum") - F.col("size") < 2 * F.col("part"))
    ends = taken.groupBy("s").agg(F.max(F.struct(*ORDER)).alias("end"))
    # if the first of the slice does not come nearer, the part ends with the slice before
    earlier = places.join(last.withColumnRenamed("slice", "last"),
                          F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") < F.col("last")))
    earlier = earlier.groupBy("s").agg(F.max(F.struct(*ORDER)).alias("earlier"))
    both = plan.join(ends, F.col("source").eqNullSafe(ends["s"]), "left").drop("s")
    both = both.join(earlier, F.col("source").eqNullSafe(earlier["s"]), "left").drop("s")
    return both.select("source", "source_size", "target", "epochs", F.coalesce("end", "earlier").alias("end"))
