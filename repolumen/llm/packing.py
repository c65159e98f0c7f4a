"""Best-fit packing of token sequences by exact-complement hashing."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, listed, written

#: Words whose ids a worker remembers, and the longest such word in bytes; other words are encoded each time.
REMEMBERED, LONGEST = 1 << 19, 64
#: Shares of each length that are numbered by separate tasks.
SHARES = 256


def tokenized(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = 2048, end: int = 0,
              into: str = "tokens", with_ids: bool = False) -> DataFrame:
    """The table with its text replaced by a struct ``into``, a row per piece of at most ``capacity`` tokens.

    ``piece`` (from 0), ``start`` (tokens of the document before it), ``length``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers) and, if asked for, ``ids``. A document is the ids of its whole text, without
    special tokens added, then ``end``; null and empty texts are ``end`` alone. ``vocabulary`` is the path of a file
    of the tokenizers library, to be found on every executor.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, into)]
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([*kept, T.StructField(into, T.StructType([T.StructField(*f) for f in fields]))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from zlib import crc32

        encode = _encoder(vocabulary)
        for batch in batches:
            rest = batch.select([f.name for f in kept])
            # a few texts at a time, so that a batch of long ones needs no more memory than these
            column = batch.column(text)
            for lo in range(0, batch.num_rows, 256):
                rows, parts, pieces = [], {n: [] for n, _ in fields}, 0
                for i, ids in enumerate(encode(listed(column.slice(lo, 256)), end), lo):
                    size = 4 * capacity
                    for k, at in enumerate(range(0, len(ids), size)):
                        part = ids[at:at + size]
                        rows.append(i)
                        parts["piece"].append(k)
                        parts["start"].append(at // 4)
                        parts["length"].append(len(part) // 4)
                        parts["ids_crc32"].append(crc32(part))
                        if with_ids:
                            parts["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                if rows:
                    types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
                    arrays = [pa.array(v, types.get(n, pa.int64())) for n, v in parts.items()]
                    made = pa.StructArray.from_arrays(arrays, names=list(parts))
                    taken = rest.take(pa.array(rows)) if rest.num_columns else rest
                    yield pa.RecordBatch.from_arrays([*taken.columns, made], names=[*rest.schema.names, into])

    return docs.mapInArrow(run, schema)


def _encoder(vocabulary: str):
    """A function from texts to their ids as bytes.

    A vocabulary that ``_splits_words`` finds to drop white space and fold case between pieces that never span words
    is used word by word: words are encoded once and remembered, whatever their case and closing comma or full stop.
    Words of letters alone, of which each ends in the one id that has the mark of a word's end, are encoded many at a
    time. With any other vocabulary, whole texts are encoded.
    """
    import os
    import struct
    import sys

    import numpy as np

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    store = sys.__dict__.setdefault("_repolumen_llm", {})
    if ("tokens", vocabulary) not in store:
        tokenizer = Tokenizer.from_file(vocabulary)
        mark = _splits_words(tokenizer)
        closes = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        if mark:
            closes[[i for w, i in tokenizer.get_vocab().items() if w.endswith(mark)]] = True
        store["tokens", vocabulary] = (tokenizer, mark, closes, {})
    tokenizer, mark, closes, known = store["tokens", vocabulary]

    def each(words: list[bytes]) -> list[bytes]:
        found = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def plain(words: list[bytes]) -> list[bytes]:
        """Of words of letters."""
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.nonzero(closes[ids])[0] + 1)).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return each(words)
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(texts: list[bytes], end: int) -> Iterator[bytes]:
        last = struct.pack("<I", end)
        if not mark:
            for t in texts:
                yield each([t])[0] + last
            return
        # a mark of a special token must stand as it is
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        got = [list(map(known.get, words)) for words in split]
        missing = {w for words, ids in zip(split, got, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        parts = {w: (w[:-1], w[-1:]) if w[-1:] in (b",", b".") and w[-2:-1].isalpha() else (w,) for w in missing}
        wanted = {p for ps in parts.values() for p in ps if p not in known}
        letters = [w for w in wanted if w.isalpha() or w.decode().isalpha() and w.decode().lower().isalpha()]
        other = list(wanted.difference(letters))
        made = {}
        for some, way in ((letters, plain), (other, each)):
            for at in range(0, len(some), 1024):
                made.update(zip(some[at:at + 1024], way(some[at:at + 1024]), strict=True))
        rare = {}
        for w, ps in parts.items():
            ids = b"".join([made[p] if p in made else known[p] for p in ps])
            (known if len(w) <= LONGEST and len(known) < REMEMBERED else rare)[w] = ids
        for w in made:
            if w not in parts and len(w) <= LONGEST and len(known) < REMEMBERED:
                known[w] = made[w]
        for words, ids in zip(split, got, strict=True):
            if None in ids:
                ids = [x if x is not None else rare[w] if w in rare else known[w] for w, x in zip(words, ids, strict=True)]
            yield b"".join(ids) + last

    return encode


def _splits_words(tokenizer) -> str:
    """The mark of a word's end, if the vocabulary lower-cases, drops white space and ends every piece by the mark; or ''."""
    import json

    made = json.loads(tokenizer.to_str())

    def listed_(step, name):
        return [] if step is None else step[name] if step["type"] == "Sequence" else [step]

    normal = [n["type"] for n in listed_(made["normalizer"], "normalizers")]
    steps = listed_(made["pre_tokenizer"], "pretokenizers")
    dropped = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not any(
        s.get("add_prefix_space") for s in steps)
    words = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: pieces of letters, of one digit, of what else is no white space
    splits = dropped and str(steps[0]["pattern"].get("Regex", "")).endswith(words)
    same = set(normal) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in normal and made["model"]["type"] == "BPE"
    return made["model"].get("end_of_word_suffix") or "" if splits and same and not made["model"].get("ignore_merges") else ""


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences are filled so), using every piece once.

    Longest lengths first. The gap that a length leaves is looked up among the sums of one, two and three of the
    lengths still available, and combinations that fill it exactly are used as often as the counts allow. What finds
    no exact complement is packed best-fit, longest first. The work depends on the number of lengths, not of pieces.
    """
    import numpy as np

    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    made: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        made.append((lengths, times))

    if left[capacity]:
        use((capacity,))
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # one is in use while its complement is looked up
            rest = _complement(left, capacity - length)
            left[length] += 1
            if rest is None:
                break
            use((length, *rest))
    made += _best_fit(left, capacity)
    return made


def _complement(left, gap: int) -> tuple[int, ...] | None:
    """At most three available lengths with this sum: the fewest, and of these the ones with the longest first."""
    import numpy as np

    if left[gap]:
        return (gap,)
    two = _pair(left, gap)
    if two:
        return two
    for first in np.nonzero(left[:gap])[0][::-1]:
        if 3 * first < gap:
            break
        left[first] -= 1
        two = _pair(left, gap - int(first), int(first))
        left[first] += 1
        if two:
            return (int(first), *two)
    return None


def _pair(left, gap: int, most: int | None = None) -> tuple[int, int] | None:
    """Two available lengths with this sum, neither above ``most``."""
    import numpy as np

    high = min(gap - 1, most if most is not None else gap)
    low = (gap + 1) // 2
    if high < low:
        return None
    longer = np.arange(high, low - 1, -1)
    fits = (left[longer] > 0) & (left[gap - longer] > 0)
    if gap % 2 == 0 and low == gap // 2 and left[low] < 2:
        fits[-1] = False
    at = np.argmax(fits)
    return (int(longer[at]), gap - int(longer[at])) if fits[at] else None


def _best_fit(left, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    import bisect

    open_: dict[int, list[list]] = {}  # gap: [lengths, times]
    gaps: list[int] = []
    done = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap == 0:
            done.append((lengths, times))
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append([lengths, times])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length
                full, some = divmod(n, fit)
                if full:
                    put(capacity - fit * length, (length,) * fit, full)
                if some:
                    put(capacity - some * length, (length,) * some, 1)
                break
            gap = gaps[at]
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            fit = gap // length
            full = min(times, n // fit)
            if full:
                put(gap - fit * length, lengths + (length,) * fit, full)
                n -= full * fit
                times -= full
            if times and n and n < fit:
                put(gap - n * length, lengths + (length,) * n, 1)
                times, n = times - 1, 0
            if times:
                put(gap, lengths, times)
        left[length] = 0
    return done + [(lengths, times) for rows in open_.values() for lengths, times in rows]


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = 2048) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: their sequence of at most ``capacity`` tokens and place in it.

    ``pieces`` must be a written table; rows that agree in ``order`` must be alike. Only the number of pieces of each
    length, at most ``capacity`` rows, goes through the driver, where sequences are planned. Pieces are then numbered
    within their length, by shares so that a frequent length is no single task, and look up the place that the plan
    has for their number. Places are a table of a row per length in each kind of sequence.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    spark, rows, first = pieces.sparkSession, [], 0
    seen: Counter = Counter()
    for lengths, times in plan(counts, capacity):
        at = 0
        for x in lengths:
            rows.append((x, seen[x], seen[x] + times, first - seen[x], at))
            seen[x] += times
            at += x
        first += times
    taken = ("_length", "_from", "_to", "_shift", "_offset")
    places = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in taken]))

    share, number, before = (fresh(pieces, x) for x in ("share", "number", "before"))
    dealt = pieces.withColumn(share, F.pmod(F.xxhash64(*order), F.lit(SHARES)))
    sums = dealt.groupBy(length, share).count().withColumn(before, F.sum("count").over(
        Window.partitionBy(length).orderBy(share)) - F.col("count")).drop("count")
    within = Window.partitionBy(length, share).orderBy(*order)
    numbered = dealt.withColumn(number, F.row_number().over(within) - 1).join(sums, [length, share])
    numbered = numbered.withColumn(number, F.col(number) + F.col(before))
    at = (F.col(length) == F.col("_length")) & (F.col(number) >= F.col("_from")) & (F.col(number) < F.col("_to"))
    return numbered.join(F.broadcast(places), at).select(
        *pieces.columns, (F.col(number) + F.col("_shift")).alias("sequence_id"), F.col("_offset").alias("offset"))
