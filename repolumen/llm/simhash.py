"""Near duplicates by SimHash fingerprints and multi-index hashing."""
from __future__ import annotations

from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, each_text, numbered, smallest_reachable, written

#: A segment value that more fingerprints than this share is divided by the segments of the other half.
CROWDED = 128
#: Shingles hashed at once, so that a long text needs no more memory than this many.
CHUNK = 1 << 15


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """The table with its text replaced by a 64-bit SimHash (long) under ``name``.

    Words are lower-cased in A-Z and divided by ASCII white space. Every run of ``shingle`` words counts, repeats
    included; a shorter text is one shingle. A bit is set if it is set in over half the XXH64 hashes (seed 42).
    Null, empty and blank texts get zero. Other columns pass through.
    """
    kept = docs.drop(name) if name != text else docs
    schema = T.StructType([f for f in kept.schema.fields if f.name != text] + [T.StructField(name, T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = np.fromiter((_fingerprint(t, shingle) for t in each_text(batch.column(text))), np.uint64, batch.num_rows)
            rest = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(out.view(np.int64))], names=[*rest, name])

    return kept.mapInArrow(run, schema)


def _fingerprint(text: bytes, shingle: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at:at + CHUNK + shingle - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def _radii(distance: int) -> list[int]:
    """What each of two segments may differ by, so that every pair within the distance agrees in one of them."""
    return [distance // 2, (distance - 1) // 2] if distance else [0]


def _masks(bits: int, radius: int) -> list[int]:
    """The flips of a Hamming ball, nearest first."""
    return [sum(1 << i for i in c) for d in range(radius + 1) for c in combinations(range(bits), d)]


def _apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def near_pairs(prints: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b): every two different fingerprints that differ in at most ``distance`` bits, once.

    ``prints`` has one row per distinct fingerprint in its only column. Each half is a segment with its own table.
    A pair within the distance differs by at most ``r0`` bits in the upper half or ``r1`` in the lower one, with
    ``r0 + r1 = distance - 1``; so the balls of these radii around each segment are looked up, and what is found
    is verified in full. A pair found by the lower half counts only if the upper half could not find it. A segment
    value shared by over ``crowded`` fingerprints is divided again: its look-ups go on, by the same rule, in tables
    of the two quarters of the other half, so that crowds cost no comparison of all with all.
    """
    fp = prints.columns[0]
    a = prints.select(F.col(fp).alias("a"))
    radii = _radii(distance)
    if distance < 1:
        return a.limit(0).select("a", F.col("a").alias("b"))
    upper, lower = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: c.bitwiseAND(0xFFFFFFFF))

    def flip(segment: int, key: Column) -> Column:
        # of a flip and its reverse, which find the same pair, the one that sets the lowest bit
        flips = F.array([F.lit(m).cast("long") for m in _masks(32, radii[segment])])
        wanted = F.filter(flips, lambda m: key.bitwiseAND(m.bitwiseAND(-m)) == 0)
        return F.transform(wanted, lambda m: F.struct(
            F.lit(segment).alias("seg"), key.bitwiseXOR(m).alias("key"), F.bit_count(m).alias("d")))

    found = [flip(0, upper(F.col("a")))]
    entries = [F.struct(F.lit(0).alias("seg"), upper(F.col("b")).alias("key")),
               F.struct(F.lit(1).alias("seg"), lower(F.col("b")).alias("key"))]
    if len(radii) > 1 and radii[1] >= 0:
        found.append(flip(1, lower(F.col("a"))))
    probes = a.select("a", F.inline(F.concat(*found)))
    table = prints.select(F.col(fp).alias("b")).select("b", F.inline(F.array(*entries[:len(found)])))

    A, B = F.col("a"), F.col("b")
    verified = (
        (_apart(A, B) <= distance)
        & ((F.col("d") > 0) | (A < B))
        & ((F.col("seg") == 0) | (_apart(upper(A), upper(B)) > radii[0]))
    )
    crowds = written(table.groupBy("seg", "key").count().filter(F.col("count") > crowded).select("seg", "key"), "crowds")
    if crowds.isEmpty():
        return probes.join(table, ["seg", "key"]).filter(verified).select("a", "b")

    plain = probes.join(crowds, ["seg", "key"], "left_anti").join(
        table.join(crowds, ["seg", "key"], "left_anti"), ["seg", "key"]).filter(verified).select("a", "b")

    other = lambda c: F.when(F.col("seg") == 0, lower(c)).otherwise(upper(c))
    quarter = [lambda c: F.shiftrightunsigned(other(c), 16), lambda c: other(c).bitwiseAND(0xFFFF)]

    def inner_flips(sub: int, radius: int) -> Column:
        flips = F.array([F.lit(m).cast("long") for m in _masks(16, radius)])
        return F.transform(flips, lambda m: F.struct(
            F.lit(sub).alias("sub"), quarter[sub](A).bitwiseXOR(m).alias("rest")))

    look, late = [], F.lit(True)
    for d in range(radii[0] + 1):
        inner = _radii(distance - d)
        for sub, r in enumerate(inner):
            none = F.array().cast("array<struct<sub:int,rest:bigint>>")
            look.append(F.when(F.col("d") == d, inner_flips(sub, r)).otherwise(none))
        if len(inner) > 1:
            late = late & ((F.col("d") != d) | (F.col("sub") == 0) | (_apart(quarter[0](A), quarter[0](B)) > inner[0]))
    deep_probes = probes.join(crowds, ["seg", "key"], "left_semi").select("*", F.inline(F.concat(*look)))
    deep_table = table.join(crowds, ["seg", "key"], "left_semi").select("*", F.inline(F.array(*[
        F.struct(F.lit(s).alias("sub"), quarter[s](B).alias("rest")) for s in (0, 1)])))
    deep = deep_probes.join(deep_table, ["seg", "key", "sub", "rest"]).filter(verified & late).select("a", "b")
    return plain.union(deep)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(key, fingerprint long, component): one row per row of ``docs``.

    ``component`` is the smallest key whose fingerprint can be reached over links of at most ``distance`` bits, the
    row's own included; a null key counts as none, so a component of null keys has none. Equal fingerprints are one
    node, so a large group of copies costs no more than one document. Extra columns are ignored; an empty table
    gives no rows.
    """
    seen = written(fingerprints(docs.select(key, text), text, shingle), "fingerprints")
    return seen.join(_labels(seen, key, distance), "fingerprint").select(key, "fingerprint", "component")


def _labels(seen: DataFrame, key: str, distance: int) -> DataFrame:
    """(fingerprint, component) of fingerprinted rows."""
    classes = written(seen.groupBy("fingerprint").agg(F.min(key).alias("first")), "classes")
    roots = _roots(classes, distance)
    least = roots.groupBy("root").agg(F.min("first").alias("component"))
    return roots.join(least, "root").select("fingerprint", "component")


def _roots(classes: DataFrame, distance: int) -> DataFrame:
    """The classes with the smallest fingerprint they can reach as ``root``."""
    return _rooted(classes, near_pairs(classes.select("fingerprint"), distance))


def _rooted(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    up = smallest_reachable(pairs)
    return classes.join(up.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("v", "fingerprint").alias("root"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The table without near copies: of each component, one row stays, that of the smallest key.

    Rows with null keys come last; among rows with the same key, one stays. All columns are returned unchanged.
    """
    kept, mark = numbered(docs)
    columns = kept.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(mark).alias("mark"))
    seen = written(fingerprints(columns, shingle=shingle), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    classes = written(seen.groupBy("fingerprint").agg(F.min(order).alias("first")), "classes")
    return first_of_groups(kept, mark, classes, near_pairs(classes.select("fingerprint"), distance))


def first_of_groups(kept: DataFrame, mark: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``kept`` that come first among the classes which ``pairs`` link; ``mark`` numbers them and goes."""
    stay = _rooted(classes, pairs).groupBy("root").agg(F.min("first").alias("first"))
    return chosen(kept, mark, stay.select("first.mark")).drop(mark)
