"""Language-model scores by Brown classes: exchange clustering, class transitions and word emissions."""
from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, written

#: Fixed sizes of the model, whatever the input: words that tasks hold and that are clustered, and classes.
CLASSES = 64
KNOWN = CLUSTERED = 1 << 16
#: Groups of words that tasks look for the best classes of.
SHARES = 256
#: Bytes of the longest word that tasks hold, and classes by length of the words that are not clustered.
LONGEST, SHAPES = 64, 8
#: Weight of the classes' own shares in a transition, and rounds of the exchange.
PRIOR, ROUNDS = 10.0, 4
#: Distinct words, and pairs of tokens, that a task gathers before it hands them on.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 1 << 22
#: Documents scored before their results are handed on.
DOCUMENTS_AT_ONCE = 256


@dataclass(frozen=True)
class ClassModel:
    """What tasks need to score words; ``counts`` is the whole table of (word, n)."""

    counts: DataFrame
    tokens: int  # training tokens, ends included
    words: int  # distinct ones
    ends: int
    known: dict  # word: place, most frequent first
    frequency: object  # by place
    unit: object  # clustered word or shape, by place
    group: object  # class by unit; the last unit is the boundary
    transition: object  # log10 probabilities, class by class
    emission: object  # log10 of 1 / (tokens + words + 1), by class

    def light(self) -> SimpleNamespace:
        """All but the table, as plain values, which executors without this library can read."""
        return SimpleNamespace(**{f: getattr(self, f) for f in self.__dataclass_fields__ if f != "counts"})


def _codes(words: list[bytes], known: dict) -> list[int]:
    """The place of each word, or below zero its shape."""
    get = known.get
    return [get(w, -1 - min(len(w) >> 2, SHAPES - 1)) for w in words]


def _units(words: list[bytes], model):
    """The unit of each word between two boundaries."""
    import numpy as np

    known, unit = model
    code = np.array(_codes(words, known), np.int64)
    inner = np.where(code < 0, CLUSTERED - 1 - code, unit[np.maximum(code, 0)]) if len(unit) else CLUSTERED - 1 - code
    edge = CLUSTERED + SHAPES
    return np.concatenate([[edge], inner, [edge]])


def _word_counts(batches):
    from collections import Counter

    import pyarrow as pa

    def handed(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for t in each_text(batch.column(0)):
            held.update(t.lower().split())
            if len(held) >= WORDS_AT_ONCE:
                yield handed(held)
                held = Counter()
    if held:
        yield handed(held)


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> ClassModel:
    """The model of all texts of ``docs``; null texts are empty.

    Words are counted by Spark in full. Of size, the driver holds the KNOWN most frequent words of at most LONGEST
    bytes and the tables of classes; all other words keep their counts in a distributed table. Pairs of neighbouring
    units (these words, and classes by length for all others) are counted by Spark too. Each round of the exchange
    sums, for every second known word, the classes before and after it; tasks then find the class that would raise the
    likelihood most. The classes of the likeliest round are taken. An empty table gives a model that knows no word.
    """
    import numpy as np

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(texts.mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = texts.count()
    whole = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, words = int(whole[0] or 0) + ends, int(whole[1]) + (ends > 0)

    # the step of frequency in which the KNOWN-th word lies, from a histogram of at most a few hundred steps; of the
    # words in that step, which may be any number, a part by hash
    step = F.floor(F.log2("n") * 8).cast("int")
    short = counts.filter(F.octet_length("word") <= LONGEST)
    steps = sorted(((r["step"], r["count"]) for r in short.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, last, part = 0, -1, 1.0
    for value, n in steps:
        if total + n > KNOWN:
            last, part = value, (KNOWN - total) / n
            break
        total += n
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))
    frequent = short.filter((step > last) | (step == last) & drawn).collect()
    frequent = sorted(((-r["n"], r["word"].encode()) for r in frequent))[:KNOWN]
    known = {w: i for i, (_, w) in enumerate(frequent)}
    frequency = np.array([-n for n, _ in frequent], np.int64)
    shape = [min(len(w) >> 2, SHAPES - 1) for _, w in frequent]
    unit = np.array([i if i < CLUSTERED else CLUSTERED + s for i, s in enumerate(shape)], np.int64)
    clustered = min(CLUSTERED, len(frequent))

    pairs = written(_pairs(texts, known, unit), "pairs")
    group = np.concatenate([np.arange(CLUSTERED) % CLASSES, CLASSES + np.arange(SHAPES + 1)])
    best, most = group, -np.inf
    for turn in range(rounds + 1):
        both, table = _summed(pairs, group)
        value = _likelihood(table)
        if value > most:
            best, most, best_table = group, value, table
        if turn == rounds or clustered == 0:
            break
        group = _exchanged(both, table, group, turn)
    group, table = best, best_table

    classes = CLASSES + SHAPES + 1
    share = (table.sum(axis=0) + 1) / (table.sum() + classes)
    transition = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
    sizes, kinds = np.zeros(classes), np.zeros(classes)
    np.add.at(sizes, group[:clustered], frequency[:clustered])
    np.add.at(kinds, group[:clustered], 1)
    length = F.least(F.floor(F.octet_length("word") / 4), F.lit(SHAPES - 1)).cast("int")
    for row in counts.groupBy(length.alias("shape")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[CLASSES + row["shape"]] += row["n"]
        kinds[CLASSES + row["shape"]] += row["v"]
    for s, n in zip(shape[:clustered], frequency[:clustered], strict=True):
        sizes[CLASSES + s] -= n
        kinds[CLASSES + s] -= 1
    emission = -np.log10(sizes + kinds + 1)
    emission[-1] = 0.0  # the end is the only word of its class
    return ClassModel(counts, tokens, words, ends, known, frequency, unit, group, transition, emission)


def _pairs(texts: DataFrame, known: dict, unit) -> DataFrame:
    """(a, b, n): how often unit b follows unit a."""
    shared = texts.sparkSession.sparkContext.broadcast((known, unit))
    size = CLUSTERED + SHAPES + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def handed(held):
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["a", "b", "n"])

        held, some = [], 0
        for batch in batches:
            for t in each_text(batch.column(0)):
                units = _units(t.lower().split(), shared.value)
                held.append(units[:-1] * size + units[1:])
                some += len(units)
                if some >= PAIRS_AT_ONCE:
                    yield handed(held)
                    held, some = [], 0
        if held:
            yield handed(held)

    return texts.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _summed(pairs: DataFrame, group):
    """The pairs with the classes ``ca`` and ``cb`` of their units, and the counts of class pairs as a matrix."""
    import numpy as np
    import pyarrow as pa

    spark, size = pairs.sparkSession, CLASSES + SHAPES + 1
    # a row for each unit: a fixed number
    named = spark.createDataFrame(pa.table({"unit": np.arange(len(group), dtype=np.int32), "class": np.asarray(group, np.int32)}))
    both = pairs.join(F.broadcast(named.toDF("a", "ca")), "a").join(F.broadcast(named.toDF("b", "cb")), "b")
    table = np.zeros((size, size))
    for row in both.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
        table[row["ca"], row["cb"]] = row["n"]
    return both, table


def _f(x):
    import numpy as np

    return x * np.log(np.maximum(x, 1))


def _likelihood(table) -> float:
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def _exchanged(both: DataFrame, table, group, turn: int):
    """The classes after one round: every other known word moves to its best class."""
    own = (F.col("a") == F.col("b")).alias("own")
    sides = both.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.lit(0).alias("side"), F.col("cb").alias("class"), "n", own),
        F.struct(F.col("b").alias("word"), F.lit(1).alias("side"), F.col("ca").alias("class"), "n", own),
    )).alias("x")).select("x.*").filter((F.col("word") < CLUSTERED) & (F.col("word") % 2 == turn % 2))
    contexts = sides.groupBy("word", "side", "class", "own").agg(F.sum("n").alias("n"))

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        word, side, kind, own, n = (rows.column(c).to_numpy() for c in ("word", "side", "class", "own", "n"))
        words, at = np.unique(word, return_inverse=True)
        right, left, self = np.zeros((len(words), len(table))), np.zeros((len(words), len(table))), np.zeros(len(words))
        for into, mine in ((right, side == 0), (left, side == 1)):
            mine = mine & ~own
            np.add.at(into, (at[mine], kind[mine]), n[mine])
        mine = own & (side == 0)
        np.add.at(self, at[mine], n[mine])
        found = [best_class(table, int(group[w]), r, b, s) for w, r, b, s in zip(words, right, left, self, strict=True)]
        return pa.table({"word": pa.array(words, pa.int32()), "class": pa.array(found, pa.int32())})

    share = F.pmod(F.floor(F.col("word") / 2), F.lit(SHARES)).alias("share")
    moved = contexts.groupBy(share).applyInArrow(run, "word int, class int").toArrow()
    after = group.copy()
    after[moved["word"].to_numpy()] = moved["class"].to_numpy()
    return after


def best_class(table, now: int, right, left, own: float) -> int:
    """The class in which a word makes the class pairs likeliest; its present one if none is better.

    ``right`` and ``left`` count the classes of other words after and before it, ``own`` its followings of itself.
    """
    import numpy as np

    rest = table.copy()
    rest[now] -= right
    rest[:, now] -= left
    rest[now, now] -= own
    n_right, n_left = right.sum() + own, left.sum() + own
    # whatever its class, other classes get back what stands before and after the word
    rows, columns = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    before = _f(rest)
    gain = (_f(rest + right) - before).sum(axis=1) + (_f(rest + left[:, None]) - before).sum(axis=0)
    d = np.arange(len(table))
    gain += _f(rest[d, d] + right + left + own) + _f(rest[d, d]) - _f(rest[d, d] + right) - _f(rest[d, d] + left)
    gain -= _f(rows + n_right) - _f(rows) + _f(columns + n_left) - _f(columns)
    best = int(np.argmax(gain[:CLASSES]))
    return best if gain[best] > gain[now] + 1e-9 else now


def score(docs: DataFrame, model: ClassModel, text: str = "text") -> DataFrame:
    """The table with its text replaced by ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    Tokens are the words and one end. ``base_score`` sums log10 of add-one word probabilities, ``score`` log10 of the
    class model: the class given the class before, times the word in its class, add-one with one more for unseen
    words. Words that tasks do not hold look up their counts in the distributed table, once for each document; these
    look-ups and the sums over them are keyed by word and by row, so no word or document is a task of its own.
    A null text counts as an empty one, which is its end alone; an empty table gives an empty one, other columns stay.
    """
    import numpy as np

    kept = [f.name for f in docs.schema.fields if f.name not in (text, "n_tokens", "n_known", "base_score", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model.light())
    low = float(np.log10(model.tokens + model.words + 1))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        seen = np.log10(np.append(m.frequency, 0) + 1.0)
        inner = np.append(seen[:-1] + m.emission[m.group[m.unit]], 0.0)
        for whole in batches:
            # some documents at a time: their rare words are many small objects
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                n, known, base, total, ends, words, times = [], [], [], [], [0], [], []
                for t in each_text(batch.column(batch.num_columns - 1)):
                    found = _scored(t.lower().split(), m, seen, inner)
                    for column, value in zip((n, known, base, total), found, strict=False):
                        column.append(value)
                    words += found[4]
                    times += found[4].values()
                    ends.append(len(words))
                asked = pa.StructArray.from_arrays(
                    [pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), asked)],
                    names=[*batch.schema.names[:-1], "n", "known", "base", "total", "rare"])

    source = docs.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, n bigint, known bigint, base double, total double, " \
             "rare array<struct<word:string,n:bigint>>"
    part = written(source.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()), "scored")
    asked = part.select("id", F.inline("rare")).withColumnRenamed("n", "times")
    found = asked.join(model.counts, "word").groupBy("id").agg(
        F.sum("times").alias("known2"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    end = float(np.log10(model.ends + 1))
    more = F.coalesce("more", F.lit(0.0))
    return part.join(found, "id", "left").select(
        *[F.col("row")[c].alias(c) for c in kept], (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", F.lit(0)) + int(model.ends > 0)).alias("n_known"),
        (F.col("base") + more + end - (F.col("n") + 1) * low).alias("base_score"), (F.col("total") + more).alias("score"))


def _scored(words: list[bytes], m, seen, inner):
    """Tokens, known tokens, their sums in both scores, and the words to be looked up."""
    from collections import Counter

    import numpy as np

    code = np.array(_codes(words, m.known), np.int64)
    held = code >= 0
    place = code[held]
    units = np.where(held, m.unit[np.maximum(code, 0)], CLUSTERED - 1 - code) if len(m.unit) else CLUSTERED - 1 - code
    edge = CLUSTERED + SHAPES
    group = m.group[np.concatenate([[edge], units, [edge]])]
    total = m.transition[group[:-1], group[1:]].sum() + inner[place].sum() + m.emission[group[1:-1][~held]].sum()
    rare = Counter(w for w, c in zip(words, code.tolist(), strict=True) if c < 0) if len(place) < len(words) else {}
    return len(words), len(place), float(seen[place].sum()), float(total), rare


