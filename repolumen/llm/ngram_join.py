"""Jaccard joins of word n-gram sets by prefix trees."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen, each_text, numbered, smallest_reachable, written
from .similar import word_runs
from .trees import links_of

#: N-grams that a piece of a set holds at least if the set is to be found by it.
PIECE = 3


def least_common(n: Column, num: int, den: int) -> Column:
    """How many n-grams a set of n has in common with any set that it links to, at least."""
    return F.ceil((num * n) / F.lit(den) - 1e-9).cast("int")


def _signs(runs, num: int, den: int):
    """Numbers of which any two sets that link, but are not equal, have one in common at least; few others do.

    ``runs`` are the distinct hashes of a set in order. Two linked sets differ in no more than ``most`` n-grams, of
    either. Hashes are divided by value into pieces, as many for all sets of a range of sizes; a difference spoils one
    piece, so among the first ``most + 1`` that hold ``PIECE`` n-grams or more in either set, one is the same in both.
    A piece's number is the sum of its hashes. A set with fewer such pieces has them all, and its least hashes
    besides, among which two such sets meet. Near the end of a range, a set is divided as the next range is, too.
    """
    import numpy as np

    n = len(runs)
    most = n * (den - num) // num
    if not most:
        return runs[:0]
    after = lambda end: max(-(-3 * end // 2), -(-den * end // num))
    end = 2
    while end <= n:
        end = after(end)
    signs = []
    for limit in [end, after(end)] if den * n >= num * end else [end]:
        least = (limit - 1) * (den - num) // num + 1
        piece = ((runs >> np.uint64(32)) * np.uint64(least + least // 4 + 1)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1])
        held = np.diff(np.append(starts, n)) >= PIECE
        signs.append(np.add.reduceat(runs, starts)[held][:most + 1])
        if len(signs[-1]) <= most:
            signs.append(runs[:n - (num * n + den - 1) // den + 1])
    return np.unique(np.concatenate(signs))


def _signed(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(key, mark, n, fingerprint, signs) from (key, mark, text)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            sizes, prints, signs = [], [], []
            for text in each_text(batch.column(2)):
                runs = word_runs(text, size)
                sizes.append(len(runs))
                prints.append(xxh64_intdigest(runs.tobytes(), 42))
                signs.append(_signs(runs, num, den).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(signs, pa.list_(pa.int64()))], names=["key", "mark", "n", "fingerprint", "signs"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "mark")}
    return rows.select("key", "mark", "text").mapInArrow(
        run, f"key {kinds['key']}, mark {kinds['mark']}, n bigint, fingerprint bigint, signs array<bigint>")


def _grams(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, grams) of texts, the only column; id is the fingerprint."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                runs = [word_runs(t, size) for t in each_text(batch.column(0).slice(at, 256))]
                prints = np.array([xxh64_intdigest(r.tobytes(), 42) for r in runs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints), pa.array([len(r) for r in runs], pa.int64()), pa.array([r.view(np.int64) for r in runs], pa.list_(pa.int64()))],
                    names=["id", "n", "grams"])

    return rows.mapInArrow(run, "id bigint, n bigint, grams array<bigint>")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(key, n, component): the size of each row's n-gram set, and the smallest key that links lead to, its own included.

    A set holds the distinct runs of ``size`` words, lower-cased in A-Z and divided by ASCII white space; a shorter
    text is one run. Two sets link if ``den`` times their intersection is ``num`` times their union or more, with
    ``2 * num >= den``. Null, empty and blank texts have n = 0 and link with nothing. Null keys count as none: a
    component of null keys has none. Rows with equal sets are one class, so copies cost no more than one document.
    Extra columns are ignored; an empty table gives no rows. N-grams and whole sets are told apart by 64-bit hashes.

    First, sets meet in pieces of their hashes (``_signs``), which sets that only share words or passages seldom do: a
    set that no other set meets is linked with nothing, and only the rest is read again in full. Two linked sets have
    at least ``least_common`` n-grams in common. Under any order that all sets share, they therefore meet among the
    first ``n - least_common + 1`` of each. The order is that of how many of the sets read hold an n-gram, the rarest
    first: this prefix is what a set is found by. An n-gram that no other of them has counts in the size only.
    """
    kept, mark = numbered(docs)
    columns = kept.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(text).alias("text"))
    seen = written(_signed(columns, size, num, den), "sets")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    classes = written(seen.filter("n > 0").groupBy("fingerprint").agg(
        F.min(order).alias("first")), "classes")

    signs = chosen(seen, "mark", classes.select("first.mark")).select("fingerprint", F.explode("signs").alias("sign"))
    met = written(signs.groupBy("sign").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sign"), "met")
    live = written(signs.join(met, "sign", "left_semi").select("fingerprint").distinct(), "live")
    marks = classes.join(live, "fingerprint", "left_semi").select("first.mark")
    read = written(_grams(chosen(columns.select("mark", "text"), "mark", marks).select("text"), size), "grams")

    held = read.select("id", "n", F.explode("grams").alias("gram"))
    often = written(held.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("often")).filter("often > 1"), "often")
    sets = held.join(often, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("g"))
    sets = written(sets.filter(F.size("g") >= least_common(F.col("n"), num, den)).select(
        "id", "n", F.col("g.gram").alias("grams"), F.col("g.often").alias("often")), "ordered")
    prefix = F.slice("grams", 1, F.size("grams") - least_common(F.col("n"), num, den) + 1)
    links = links_of(sets.select(F.explode(prefix).alias("value"), "id"), sets, num, den)

    up = smallest_reachable(links)
    roots = classes.join(up.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("v", "fingerprint").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").select("fingerprint", F.lit(True).alias("some"), F.col("least.key").alias("least"))
    some = F.coalesce("some", F.lit(False)) & (F.col("n") > 0)
    return seen.join(named, "fingerprint", "left").select(
        F.col("key").alias(key), "n", F.when(some, F.col("least")).otherwise(F.col("key")).alias("component"))
