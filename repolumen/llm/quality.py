"""Quality rules: how far a document's histograms lie from those of its language. Built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import divided, fresh, written

#: Frequent function words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
    "fr": ["de", "la", "et", "le", "les", "des", "en", "un"],
}
#: The character classes of the first histogram, in order; white space is left out, and a run of digits counts once.
CLASSES = ("lower", "upper", "other letter", "number", "symbol", "other")

REPEAT_WINDOW = 8
#: Texts of fewer words are not held against a reference.
LEAST_WORDS = 50
#: Jensen-Shannon distances (0 to 1) beyond which a document is rejected.
MOST_CLASSES, MOST_WORDS = 0.2, 0.6


def text_counts(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "counts",
                common_words: dict[str, list[str]] | None = None) -> DataFrame:
    """The table with a struct column ``into`` of counts of the whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_dup_lines`` (lines with a
    word that equal an earlier line), ``n_repeat_words`` (words inside 8-word windows that occur twice or more),
    ``classes`` (code points by CLASSES, numbers once each) and ``words`` (occurrences of each common word of the row's language, then
    of all other words; null if the language has no list). Windows are told apart by 64-bit hashes.
    Everything is computed inside the row; null texts count as empty.
    """
    lists = common_words or COMMON_WORDS
    kept = [c for c in docs.columns if c != into]
    t, w, ls, g = (fresh(docs, x) for x in ("text", "words", "lines", "grams"))
    blank, n = F.array().cast("array<bigint>"), REPEAT_WINDOW
    base = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t))
    base = base.withColumn(w, F.array_remove(divided(F.col(t)), ""))
    base = base.withColumn(ls, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = _given(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n),
                                                  lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))
    base = base.withColumn(g, F.when(F.size(w) >= n, windows).otherwise(blank))
    odd, joined, apart = (fresh(docs, x) for x in ("odd", "joined", "apart"))
    base = base.withColumn(joined, F.array_join(w, "  "))
    base = base.withColumn(odd, F.regexp_replace(joined, r"[\p{Ll}\x20]+", ""))
    base = base.withColumn(apart, F.concat(F.lit(" "), F.col(joined), F.lit(" ")))
    found = fresh(docs, "found")
    base = base.withColumn(found, F.struct(
        (F.length(joined) - 2 * F.greatest(F.size(w) - 1, F.lit(0))).alias("chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).alias("symbols"),
        F.length(odd).alias("odd"),
        F.length(F.regexp_replace(odd, r"[^\p{Lu}\p{Lt}]+", "")).alias("upper"),
        F.length(F.regexp_replace(odd, r"[^\p{Lo}\p{Lm}\p{M}]+", "")).alias("letter"),
        F.length(F.regexp_replace(odd, r"[^\p{N}]+", "")).alias("digits"),
        F.regexp_count(odd, F.lit(r"\p{N}+")).alias("numbers")))
    chars, symbols, odds, upper, letter, digits, numbers = (
        F.col(f"{found}.{x}") for x in ("chars", "symbols", "odd", "upper", "letter", "digits", "numbers"))
    some = [upper, letter, numbers, symbols]
    rest = odds - upper - letter - digits - symbols
    counts = F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(F.col(g)))

    def occurrences(words: list[str]) -> Column:
        each = [((F.octet_length(apart) - F.octet_length(F.replace(F.col(apart), F.lit(f" {x} "), F.lit(""))))
                 / (len(x.encode()) + 2)).cast("long") for x in words]
        # a removed word takes its own two blanks only, as neighbours are two blanks apart
        return _given(F.array(*each), lambda a: F.concat(a, F.array(
            F.size(w) - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))

    words = F.lit(None).cast("array<bigint>")
    for language, entries in sorted(lists.items()):
        words = F.when(F.col(lang) == language, occurrences(entries)).otherwise(words)
    as_long = lambda c: c.cast("long")
    return base.select(*kept, F.struct(
        as_long(F.size(w)).alias("n_words"), as_long(chars).alias("word_chars"), as_long(symbols).alias("n_symbols"),
        as_long(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"), as_long(counts).alias("n_repeat_words"),
        F.array(*map(as_long, [chars - odds, *some, rest])).alias("classes"), words.alias("words")).alias(into))


def _given(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(windows: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    n = REPEAT_WINDOW
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _given(placed, lambda s: F.filter(s, lambda x, k: (
        (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return _given(starts, lambda p: F.aggregate(
        p, F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"]))


def base_failed(counts: str) -> Column:
    """The plain rules: under 20 words, or over 30 % of the words repeated in long runs."""
    return (F.col(f"{counts}.n_words") < 20) | (
        100 * F.col(f"{counts}.n_repeat_words") > 30 * F.col(f"{counts}.n_words"))


def language_references(counted: DataFrame, lang: str = "lang", counts: str = "counts", least_words: int = LEAST_WORDS,
                        wanted: Column | None = None) -> DataFrame:
    """(language, ref_classes, ref_words): the mean histogram, as shares, of the documents of a language.

    Every document counts the same, so a few very long ones do not make the reference. Documents that the plain rules reject, under the least number of words, or not ``wanted``, are left out.
    A null language is ''.
    """
    used = counted.filter(~base_failed(counts) & (F.col(f"{counts}.n_words") >= least_words))
    used = used if wanted is None else used.filter(wanted)
    used = used.select(F.coalesce(F.col(lang), F.lit("")).alias("language"), *[
        _shares(F.col(f"{counts}.{k}")).alias(k) for k in ("classes", "words")])
    lengths = {"classes": len(CLASSES), "words": 1 + max(map(len, COMMON_WORDS.values()))}
    means = used.groupBy("language").agg(*[
        F.avg(F.get(F.col(k), F.lit(i))).alias(f"{k}{i}") for k, m in lengths.items() for i in range(m)])
    # a list shorter than the longest has no mean for the places that it lacks
    return means.select("language", *[F.nullif(
        F.filter(F.array(*[F.col(f"{k}{i}") for i in range(m)]), lambda x: x.isNotNull()), F.array().cast("array<double>")).alias(f"ref_{k}")
        for k, m in lengths.items()])


def _shares(a: Column) -> Column:
    return _given(F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y), lambda total: F.when(
        total > 0, F.transform(a, lambda x: x / total)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, 0 to 1; null if either is missing."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda x, y: x + y) / 2))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality",
                  least_words: int = LEAST_WORDS, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS, keep_text: bool = True) -> DataFrame:
    """The table with a struct ``into``: the counts, ``class_distance``, ``word_distance``, ``base_failed``, ``kept``.

    A document is kept if the plain rules keep it and its distances to the references of its language, learned from
    all documents of that language, are within the limits. Texts under ``least_words``, and languages that have no
    reference or word list, are not held against them. References are learned twice: from all documents, then from
    those within twice the limits of the first, so that a share of junk does not pass for the language. Counts are
    written without texts, and references are small groupings of them, written so that Spark knows their size when it
    plans the join. If the result is to have the texts, these are counted again as it is read, which costs less than a
    copy or a shuffle of them. Repeated rows get equal verdicts; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != into and (keep_text or c != text)]
    counted = text_counts(docs, text, lang, into)
    known = written(counted.select(lang, into) if keep_text else counted.select(*kept, into), "counts")
    counted = counted.select(*kept, into) if keep_text else known
    first = written(language_references(known, lang, into, least_words), "references")
    seen = judged(known, first, [lang], lang, into, least_words, 2 * most_classes, most_words)
    refs = written(language_references(seen, lang, into, least_words, F.col(f"{into}.kept")), "references")
    return judged(counted, refs, kept, lang, into, least_words, most_classes, most_words)


def judged(counted: DataFrame, refs: DataFrame, kept: list[str], lang: str, into: str,
           least_words: int, most_classes: float, most_words: float) -> DataFrame:
    key, names = fresh(counted, "language"), {c: fresh(counted, c) for c in ("ref_classes", "ref_words")}
    refs = refs.select(F.col("language").alias(key), *[F.col(c).alias(x) for c, x in names.items()])
    joined = counted.withColumn(key, F.coalesce(F.col(lang), F.lit(""))).join(refs, key, "left")
    long_enough = F.col(f"{into}.n_words") >= least_words

    def far(part: str) -> Column:
        return F.when(long_enough, divergence(_shares(F.col(f"{into}.{part}")), F.col(names[f"ref_{part}"])))

    joined = joined.withColumn(fresh(joined, "far"), F.struct(far("classes").alias("c"), far("words").alias("w")))
    c, w = (F.col(f"{joined.columns[-1]}.{x}") for x in "cw")
    verdict = ~base_failed(into) & (F.coalesce(c, F.lit(0.0)) <= most_classes) & (F.coalesce(w, F.lit(0.0)) <= most_words)
    return joined.select(*[F.col(x) for x in kept], F.struct(
        f"{into}.*", c.alias("class_distance"), w.alias("word_distance"),
        base_failed(into).alias("base_failed"), verdict.alias("kept")).alias(into))
