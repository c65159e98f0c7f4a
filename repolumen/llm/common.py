"""What several operators of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land

#: What separates words, and what a word is.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    Its lineage ends there, and its size is known: Spark broadcasts it in a join only below the session's threshold.
    """
    return df.sparkSession.read.schema(df.schema).parquet(land(df, name))


#: What keeps the rows of a table of files as they are, one for one.
PLAIN = {"Project", "Filter", "SubqueryAlias", "LocalLimit", "LogicalRelation"}


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column that tells its rows apart, the same in every read, and that column's name.

    It holds a hash of the file and the row's number there, so the table is not copied; only one that is not read
    from Parquet files, or is made from these by more than choosing rows and columns, is written first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in PLAIN and node.children().size() == 1:
        node = node.children().head()
    of_files = node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"
    rows = docs if of_files and node.relation().fileFormat().toString() == "Parquet" else written(docs, "rows")
    mark = fresh(docs, "row")
    return rows.withColumn(mark, F.struct(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))), mark


#: Bits of a bitmap that Spark aggregates.
BITS = 32768


def chosen(rows: DataFrame, mark: str, marks: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose ``mark``, as ``numbered`` gives it, is among ``marks`` (its only column), or those where it is not.

    Marks become bitmaps, a bit for each row of a file, so the table of them has an eighth of a byte per row of the
    input however many are chosen. Spark broadcasts it up to the session's threshold, and texts need no shuffle.
    """
    name, file, at, bits = marks.columns[0], fresh(rows, "file"), fresh(rows, "at"), fresh(rows, "bits")
    number = F.col(f"{name}.row")
    found = marks.filter(F.col(name).isNotNull()).groupBy(F.col(f"{name}.file").alias(file), F.floor(number / BITS).alias(at)).agg(
        F.bitmap_construct_agg(number % BITS).alias(bits))
    found = written(found, "bits")
    place = (F.col(f"{mark}.row") % BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, place.bitwiseAND(7)) > 0, F.lit(False))
    joined = rows.join(found, (F.col(f"{mark}.file") == F.col(file)) & (F.floor(F.col(f"{mark}.row") / BITS) == F.col(at)), "inner" if keep else "left")
    return joined.filter(hit if keep else ~hit).select(*[F.col(c) for c in rows.columns])


def divided(text: Column) -> Column:
    """Split at white space; with no other white space than blanks and line ends, without a pattern."""
    other = text.contains("\t") | text.contains("\v") | text.contains("\f") | text.contains("\r")
    return F.when(other, F.split(text, SPACES)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))


def fresh(df: DataFrame, stem: str = "c") -> str:
    """A column name that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name += "_"
    return name


def listed(texts) -> list[bytes]:
    """The values of an Arrow text column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def each_text(texts, step: int = 256):
    """The values of an Arrow text column as bytes, of which only some are held at a time."""
    for at in range(0, len(texts), step):
        yield from listed(texts.slice(at, step))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the remainder of the key's checksum names it; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(u, v): every linked number but the smallest of its component, with that smallest number.

    ``links`` has two long columns. Stars are contracted in turn towards larger and smaller numbers; each round
    is a few joins on the linked numbers alone, written to the shared folder, and the number of rounds grows
    with the logarithm of the longest chain.
    """
    a, b = links.columns
    pairs = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = written(pairs, "links"), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        pairs = both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(least, "u").select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        pairs = written(pairs, "links")
        stamp = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stamp) == before:
            return pairs
        before = tuple(stamp)
