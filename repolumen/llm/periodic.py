"""Periodic runs of words: suffix classes united by falling common prefix, adjacent positions seed runs."""
from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import listed

#: Texts whose suffixes are sorted together, in bytes; a longer text is alone.
TOGETHER = 1 << 20


def find_runs(docs: DataFrame, text: str = "text", least: int = 12, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The table with its text replaced by ``runs``, an array of (start, length, period), and ``collapsed``, a text.

    Words are divided by ASCII white space and numbered from 0. A run is a stretch of words with smallest period p, of
    at least ``2 * p`` and ``least`` words, that no neighbouring word extends. Runs are in order of start, then period,
    and may overlap. ``collapsed`` holds the words, joined by single blanks, that are in no run or in the first period
    of every run that contains them. Null, empty and blank texts have no runs and an empty text. Other columns pass
    through, but for ones named as the new columns; every row is treated alone, so repeats give equal results, and an
    empty table none.

    A text's suffixes are sorted and the common prefix of neighbours is counted. By falling common prefix, classes of
    suffixes are united, the smaller into the larger, each with its positions in order. Two positions that become
    neighbours in a class, at a distance p not above the prefix they share, begin a repetition; if the word before
    does not extend it and they are still neighbours when the class is complete, it is a run with smallest period p.
    A run shares at least ``least / 2`` words with itself, so suffixes whose first so many words occur once are left
    out of the sort: they can join no class in time. One text is held by one task.
    """
    gone = {c.lower() for c in (text, runs, collapsed)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*kept, T.StructField(runs, run_type), T.StructField(collapsed, T.StringType())])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            rest, column = batch.select([f.name for f in kept]), batch.column(text)
            for at, texts in _portions(column):
                words = [t.split() for t in texts]
                found = _runs(words, least)
                made = [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], kind),
                        pa.array([_collapsed(w, rs).decode() for w, rs in zip(words, found, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(texts)).columns, *made], names=[*rest.schema.names, runs, collapsed])

    wanted = [f.name for f in kept]
    return docs.select(*wanted, text).mapInArrow(run, schema)


def _portions(column):
    """(first row, texts as bytes) of some texts at a time."""
    at, held, size = 0, [], 0
    for lo in range(0, len(column), 64):
        for t in listed(column.slice(lo, 64)):
            if held and size + len(t) > TOGETHER:
                yield at, held
                at, held, size = at + len(held), [], 0
            held.append(t)
            size += len(t)
    if held:
        yield at, held


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        drop = bytearray(len(words))
        for start, length, period in runs:
            drop[start + period:start + length] = b"\1" * (length - period)
        words = [w for w, d in zip(words, drop, strict=True) if not d]
    return b" ".join(words)


def _runs(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    import numpy as np
    import pandas as pd

    width = max(1, (least + 1) // 2)
    sizes = np.array([len(w) for w in texts], np.int64)
    found: list[list] = [[] for _ in texts]
    if not sizes.sum():
        return found
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in texts for w in ws]
    codes = pd.factorize(flat)[0].astype(np.int64)
    # every text ends with a gap that equals no word
    first = np.concatenate([[0], np.cumsum(sizes + width)])
    where = np.arange(len(codes)) + np.repeat(np.arange(len(texts)) * width, sizes)
    word = np.full(int(first[-1]) + width, -1, np.int64)
    word[where] = codes
    owner = np.repeat(np.arange(len(texts)), sizes)

    # positions whose first words occur twice in their text, as far as hashes tell
    with np.errstate(over="ignore"):
        h = owner.astype(np.uint64)
        for k in range(width):
            h = (h ^ word[where + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    if not often.any():
        return found
    text_of = np.full(len(word), len(texts), np.int64)
    text_of[where] = owner
    starts, prefix = _neighbours(word, text_of, where[often], width)
    for start, length, period in _kruskal(word, starts, prefix, least):
        found[text_of[start]].append((int(start - first[text_of[start]]), int(length), int(period)))
    return [sorted(rs, key=lambda r: (r[0], r[2])) for rs in found]


def _neighbours(word, text_of, places, width: int):
    """The places in the order of their suffixes, and how many words each shares with the one before (0: other text)."""
    import numpy as np

    ranked = np.unique(np.concatenate([places, places + width]))  # where a repeat of the first words ends matters too
    index = np.full(len(word) + 1, -1, np.int64)
    index[ranked] = np.arange(len(ranked))

    def ranks(*keys):
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), np.int64)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    last = len(word) - 1
    levels = [ranks(text_of[np.minimum(ranked, last)], *[word[np.minimum(ranked + k, last)] for k in range(width)])]
    span = width
    while levels[-1].max() + 1 < len(ranked):
        rank = levels[-1]
        tied = np.bincount(rank)[rank] > 1
        after = index[np.minimum(ranked + span, len(word))]
        following = np.where(tied & (after >= 0), rank[after] + 1, 0)
        again = ranks(rank, following)
        if again.max() == rank.max():
            break
        levels.append(again)
        span *= 2
    mine = index[places]
    starts = places[np.argsort(levels[-1][mine], kind="stable")]
    a, b = starts[:-1].copy(), starts[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = index[np.minimum(a + shared, len(word))], index[np.minimum(b + shared, len(word))]
        equal = (i >= 0) & (j >= 0) & (levels[k][i] == levels[k][j])
        shared += equal * (width << k)
    alive = shared > 0
    for _ in range(width):
        x, y = word[np.minimum(a + shared, last)], word[np.minimum(b + shared, last)]
        alive &= (x == y) & (x >= 0)
        shared += alive
    return starts, np.concatenate([[0], shared])


def _kruskal(word, starts, shared, least: int):
    """(start, length, period) of every run: unite neighbours of the sorted suffixes by falling shared length."""
    import numpy as np

    at = np.nonzero(shared >= (least + 1) // 2)[0]
    at = at[np.argsort(-shared[at], kind="stable")]
    edges = zip(shared[at].tolist(), starts[at - 1].tolist(), starts[at].tolist(), strict=True)
    group: dict[int, list[int]] = {}
    made, seeds, level = [], [], 0

    def settle():
        for i, j in seeds:
            held = group[i]
            # of the last class of this level; a position between would mean a smaller period
            if held[bisect_left(held, i) + 1] == j and j - i + level >= max(least, 2 * (j - i)) and (i == 0 or word[i - 1] != word[j - 1] or word[i - 1] < 0):
                made.append((i, j - i + level, j - i))

    for common, x, y in edges:
        if common != level:
            settle()
            seeds, level = [], common
        big, small = group.get(x), group.get(y)
        big, small = [x] if big is None else big, [y] if small is None else small
        if len(big) < len(small):
            big, small = small, big
        before = -1  # two of the smaller class have met before
        for p in small:
            k = bisect_left(big, p)
            if k and big[k - 1] != before and p - big[k - 1] <= common:
                seeds.append((big[k - 1], p))
            if k < len(big) and big[k] - p <= common:
                seeds.append((p, big[k]))
            big.insert(k, p)
            group[p], before = big, p
        group[x] = group[y] = big
    settle()
    return made
