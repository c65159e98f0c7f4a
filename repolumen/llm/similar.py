"""Near duplicates by the Jaccard similarity of their word runs.

SimHash fingerprints within two bits, found by multi-index hashing, and MinHash bands propose pairs; whole sets confirm them.
"""
from __future__ import annotations

from itertools import islice, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, each_text, numbered, written
from .simhash import _fingerprint, _roots, first_of_groups
from .trees import links_of

#: A pair of similarity 0.8 has all values of a band in common with probability 0.8 ** 5, so 20 bands find 0.9996 of them.
BANDS, VALUES = 20, 5
#: Runs mixed at once.
CHUNK = 1 << 12


def word_runs(text: bytes, size: int = 5):
    """The distinct XXH64 hashes (seed 42) of every ``size`` words, in order; a shorter text is one run, a blank one none.

    Words are lower-cased in A-Z and divided by ASCII white space.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    runs = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64))


def _bands(runs, salts, factors) -> list[int]:
    """A hash for each band of the smallest values of the runs under each mixing."""
    import numpy as np
    from xxhash import xxh64_intdigest

    least = np.full(len(salts), np.iinfo(np.uint64).max)
    for at in range(0, len(runs), CHUNK):
        np.minimum(least, ((runs[at:at + CHUNK, None] ^ salts) * factors).min(axis=0), out=least)
    return [xxh64_intdigest(least[i:i + VALUES].tobytes(), i) for i in range(0, len(least), VALUES)] if len(runs) else []


def _signed(rows: DataFrame, size: int) -> DataFrame:
    """(key, mark, fingerprint of the set of runs, bands, SimHash of three-word shingles) from (key, mark, text).

    A blank text has zero and no bands.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(7)
        salts, factors = (rng.integers(0, 1 << 64, BANDS * VALUES, np.uint64) for _ in range(2))
        factors |= np.uint64(1)
        for batch in batches:
            sets, bands, near = [], [], []
            for text in each_text(batch.column(2)):
                runs = word_runs(text, size)
                sets.append(xxh64_intdigest(runs.tobytes(), 42) if len(runs) else 0)
                bands.append(np.array(_bands(runs, salts, factors), np.uint64).view(np.int64))
                near.append(_fingerprint(text, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(np.array(near, np.uint64).view(np.int64))],
                names=["key", "mark", "fingerprint", "bands", "simhash"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "mark")}
    return rows.select("key", "mark", "text").mapInArrow(
        run, f"key {kinds['key']}, mark {kinds['mark']}, fingerprint bigint, bands array<bigint>, simhash bigint")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(fingerprint, runs) of texts, the only column."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                runs = [word_runs(t, size) for t in each_text(batch.column(0).slice(at, 256))]
                prints = np.array([xxh64_intdigest(r.tobytes(), 42) for r in runs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints), pa.array([r.view(np.int64) for r in runs], pa.list_(pa.int64()))], names=["fingerprint", "runs"])

    return rows.mapInArrow(run, "fingerprint bigint, runs array<bigint>")


def similar_pairs(classes: DataFrame, columns: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b): pairs of sets of at least this similarity, enough of them to link all that share a bucket and are similar.

    ``classes`` has fingerprint, mark, bands and simhash, one row per distinct set, ``columns`` the texts by mark. A
    bucket is a value of a band, or all that SimHash links within two bits, directly or over others. Only texts of
    sets that share a bucket are read again; prefix trees compare these and return no more links than sets.
    """
    prints = written(classes.filter(F.size("bands") > 0).groupBy(F.col("simhash").alias("fingerprint")).agg(F.min("mark").alias("first")), "prints")
    near = _roots(prints, 2).select(F.col("fingerprint").alias("simhash"), F.xxhash64(F.lit("simhash"), "root").alias("value"))
    linked = classes.filter(F.size("bands") > 0).join(near, "simhash").select("fingerprint", "value")
    filed = classes.select("fingerprint", F.explode("bands").alias("value")).union(linked)
    counted = filed.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("value")
    shared = written(filed.join(written(counted, "buckets"), "value").select("value", F.col("fingerprint").alias("id")), "shared")
    members = classes.join(shared.select(F.col("id").alias("fingerprint")).distinct(), "fingerprint", "left_semi").select("mark")
    sets = _sets(chosen(columns, "mark", members).select("text"), size).select(F.col("fingerprint").alias("id"), F.size("runs").cast("bigint").alias("n"), F.col("runs").alias("grams"),
                                     F.lit(None).cast("array<int>").alias("often"))
    return links_of(shared, written(sets, "sets"), round(similarity * 1000), 1000)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The table without near copies: of each group that links of at least ``similarity`` join, the smallest key stays.

    The similarity of two texts is the Jaccard similarity of their sets of ``size`` words in a row. Equal sets are one
    node, and blank texts are copies of each other. Rows with null keys come last; among rows with the same key, one
    stays. All columns are returned unchanged.
    """
    kept, mark = numbered(docs)
    columns = kept.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(mark).alias("mark"))
    seen = written(_signed(columns, size), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    classes = written(seen.groupBy("fingerprint").agg(F.min(order).alias("first"), F.first("bands").alias("bands"), F.min("simhash").alias("simhash")), "classes")
    pairs = similar_pairs(classes.select("fingerprint", "first.mark", "bands", "simhash"), columns, similarity, size)
    return first_of_groups(kept, mark, classes.select("fingerprint", "first"), pairs)
