"""The queries of this subpackage: each operator over the whole of its table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, chat, class_lm, language_id, mixing, nearest, negatives, ngram_join, oracle, packing, periodic, quality, secret_scan, simhash
from .common import divided, held_out, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Two turns that hold the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"
ORACLE: dict[str, str] = {
    "op2_quality_rules": oracle.quality_rules(),
    "op7_source_mixing": oracle.source_mixing(),
    "op9_chat_formatting": oracle.chat_formatting(MARKS),
    "op12_hard_negatives": oracle.hard_negatives(),
}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = quality.quality_rules(docs, keep_text=False)
    q = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return judged.select("doc_id", *q, *[F.round(f"quality.{c}", 4).alias(c) for c in ("class_distance", "word_distance")])


@query
def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = ("assign", "access", "hex")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    plain = F.filter("secrets", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of documents in sequences; the vocabulary is the word-level one by default."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.tokenized(docs.select("doc_id", "text"), vocabulary, capacity=capacity)
    pieces = written(pieces.select("doc_id", "tokens.*"), "pieces")
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity)


@query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), mixing.letter_share(F.col("text")), keep_text=False)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                        (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    filters = language_id.learn(docs.filter(~out & F.col("doc_id").isNotNull()))
    return language_id.predict(docs.select("doc_id", out.alias("held_out"), "text"), filters)


@query
def op5_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    def scaled(x):  # beyond 2 ** 45 every such number is whole
        return F.when(F.abs(x) < 2.0 ** 45, F.floor(256 * x).cast("double")).otherwise(256 * x)

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, F.col("vec_id") % 50 == 0)


@query
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = boilerplate.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, chat.TRAINED, MARKS)], turns.schema)
    return chat.read_back(chat.examples(turns.union(more)))


@query
def op10_class_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    model = class_lm.learn(docs.filter(~out))
    scored = class_lm.score(docs.select("doc_id", out.alias("held_out"), "text"), model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", perplexity)


@query
def op13_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.components(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("text", F.when(h % 10 == 0, cycled(F.col("text"), F.floor(h / 10))).otherwise(F.col("text")))
    found = periodic.find_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -longest["less"]
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest["start"].alias("start"), length.alias("length"), longest["period"].alias("period"),
        F.floor(1000 * length / longest["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def cycled(text, g):
    """The text with a cycle from word ``a = g % n`` on, of ``1 + (n - a) / (3 + g % 8)`` words, over and over."""
    def turned(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        return F.when(n > 0, F.slice(F.concat(F.slice(w, 1, a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), times))), 1, n)).otherwise(w)

    words = F.array_remove(divided(text), "")
    return F.array_join(F.element_at(F.transform(F.array(words), turned), 1), " ")


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    def scaled(x):  # beyond 2 ** 45 every such number is whole
        return F.when(F.abs(x) < 2.0 ** 45, F.floor(256 * x).cast("double")).otherwise(256 * x)

    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: scaled(x.cast("double"))).alias("embedding"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)
