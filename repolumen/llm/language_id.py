"""Language identification by bit-sliced Bloom filters of character n-grams."""
from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, written

GRAM = 4
#: Slots of the filter are numbered by three slices of this many bits of an n-gram's hash.
SLOT_BITS, SLICES = 21, 3
#: Languages in one slice of the filter.
LANES = 62
#: A language contains an n-gram if it is at least this part as frequent there as where it is most frequent.
LEAST_PART = 0.25
#: Characters of one language that are counted at once.
CHUNK = 1 << 21
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageFilters:
    """A number per slot with a bit per language, in slices of LANES languages; and how often bits are set by chance."""

    languages: list[str]
    slots: object  # numpy array, slices x slots
    chance: object  # numpy array, one probability per language


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", least_part: float = LEAST_PART) -> LanguageFilters:
    """The filters of the languages of all rows with text and language.

    N-grams are counted by language in the tasks, summed by Spark, and each sets its language's bit in three slots. Of
    size, only the filter comes to the driver: at most ``2 ** SLOT_BITS`` numbers for every LANES languages, whatever
    the number of documents.
    """
    import numpy as np

    counts = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(
        _counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)]) if languages else None
    slots = np.zeros((max(1, -(-len(languages) // LANES)), 1 << SLOT_BITS), np.int64)
    if not languages:
        return LanguageFilters([], slots, np.zeros(0))
    shares = counts.join(totals, "lang").select(number[F.col("lang")].alias("i"), "gram", (F.col("n") / F.col("total")).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    within = shares.join(most, "gram").filter(F.col("share") >= least_part * F.col("most"))
    places = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(SLICES)])
    bits = within.select(
        (F.col("i") / LANES).cast("int").alias("slice"), F.explode(places).alias("slot"),
        F.expr(f"shiftleft(1L, i % {LANES})").alias("bit"))
    filled = bits.groupBy("slice", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots[filled["slice"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy()
    full = np.array([np.count_nonzero(slots[i // LANES] >> (i % LANES) & 1) for i in range(len(languages))]) / (1 << SLOT_BITS)
    return LanguageFilters(languages, slots, full ** SLICES)


def predict(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """The table with its text replaced by ``lang_pred`` and ``score``.

    Every n-gram occurrence of the whole text asks the filter once for all the languages that contain it. A language's
    hits, less those that chance gives it, decide; ties go to the smaller name. The score is the winner's part of all
    corrected hits. An empty table gives an empty one, other columns stay. A null text or one without a letter is ``und`` with score 0, and so is all if nothing was learned;
    a text with letters but no hit goes to the first language with score 0.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # plain values, which executors without this library can read
    shared = docs.sparkSession.sparkContext.broadcast(
        SimpleNamespace(languages=filters.languages, slots=filters.slots, chance=filters.chance))

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            found = [_language(t.decode("utf-8", "replace"), model) for t in each_text(batch.column(text))]
            names, scores = zip(*found, strict=True) if found else ((), ())
            rest = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest.schema.names, "lang_pred", "score"])

    return docs.drop("lang_pred", "score").mapInArrow(run, schema)


def _letters():
    """For each code point itself if it is a letter or mark, otherwise a blank; made once in each worker."""
    import sys
    import unicodedata

    import numpy as np

    store = sys.__dict__.setdefault("_repolumen_llm", {})
    if "letters" not in store:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] in "LM":
                table[c] = c
        store["letters"] = table
    return store["letters"]


def grams(text: str):
    """The hash of every run of GRAM characters, in lower case, each run of other characters than letters one blank."""
    import numpy as np

    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    codes = np.concatenate([np.full(GRAM - 2, 32, np.uint64), codes])
    if len(codes) < GRAM:
        return np.zeros(0, np.uint64)
    # a product with a large odd number for each character, then mixed so that all slices depend on all of them
    mixed = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        mixed = (mixed + codes[k:len(codes) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _counted(batches):
    """(lang, gram, n) of a task, a bounded number of characters at a time."""
    import numpy as np
    import pyarrow as pa

    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def counted(lang):
        found, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
            names=["lang", "gram", "n"])

    for batch in batches:
        for t, lang in zip(each_text(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = grams(t.decode("utf-8", "replace"))
            if len(found):
                held.setdefault(lang, []).append(found)
                sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes[lang] >= CHUNK:
                    yield counted(lang)
    for lang in list(held):
        yield counted(lang)


def _language(text: str, model) -> tuple[str, float]:
    import numpy as np

    found = grams(text)
    blank = len(found) == 0 or not any(map(str.isalpha, text))
    if blank or not model.languages:
        return UNKNOWN, 0.0
    mask = np.uint64((1 << SLOT_BITS) - 1)
    places = [(found >> np.uint64(SLOT_BITS * k) & mask).astype(np.int64) for k in range(SLICES)]
    hits = np.zeros(len(model.languages))
    for s, slots in enumerate(model.slots):
        held = slots[places[0]]
        for p in places[1:]:
            held = held & slots[p]
        for i in range(s * LANES, min(len(hits), (s + 1) * LANES)):
            hits[i] = np.count_nonzero(held & (1 << (i - s * LANES)))
    chance = model.chance
    sure = np.maximum(0.0, (hits - len(found) * chance) / np.maximum(1 - chance, 1e-9))
    best, total = int(np.argmax(sure)), float(sure.sum())
    return model.languages[best], float(sure[best] / total) if total else 0.0


