"""Near copies by five-word similarity against brute force over all pairs."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolumen.llm import simhash, similar, trees
from repolumen.llm.common import numbered

SCHEMA = "doc_id bigint, text string"


def made(seed=3):
    """Groups of copies with some words changed, a crowd of near copies, short, equal and blank texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(20, 300))]
        for changes in (0, 1, 2, 3, 6):
            text = list(base)
            for _ in range(changes * len(base) // 100 + (changes > 0)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    crowd = [word() for _ in range(120)]
    for i in range(150):
        text = list(crowd)
        for _ in range(i % 5):  # the last of these are as far from each other as no link may be long
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text) + f" {i}")
    out += [out[7], out[7].upper(), "a b c", "A  b\nc", "a b d", None, "", " \t"]
    rng.shuffle(out)
    return list(enumerate(out))


def runs(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute(rows):
    """The ids that stay, and the similar pairs of distinct sets."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = sorted({runs(t) for _, t in rows}, key=sorted)
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1:] if len(a & b) >= 0.8 * len(a | b) > 0]
    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        least[find(runs(t))] = min(i, least.get(find(runs(t)), i))
    return set(least.values()), pairs


@pytest.mark.parametrize("held", [512, 8])
def test_similar_texts_stay_once(spark, monkeypatch, held):
    monkeypatch.setattr(trees, "HELD", held)  # crowds are divided in blocks beyond it
    rows = made()
    want, pairs = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(pairs) > 1000 and got == want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_simhash_proposes_links(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(w) for w in (["first", *words], words, [*words[:399], "other"])] + ["quite another text of a few words", ""]
    prints = [simhash._fingerprint(t.encode(), 3) for t in texts[:3]]
    assert all((prints[1] ^ p).bit_count() <= 2 for p in prints)
    kept, mark = numbered(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    columns = kept.select(F.col("doc_id").alias("key"), "text", F.col(mark).alias("mark"))
    # every set in a band of its own, so that no band finds anything
    classes = similar._signed(columns, 5).withColumn("bands", F.when(F.size("bands") > 0, F.array("fingerprint")).otherwise(F.array().cast("array<bigint>")))
    links = similar.similar_pairs(classes, columns, 0.8, 5).collect()
    near = {r["key"]: r["fingerprint"] for r in classes.collect()}
    assert {x for link in links for x in link} == {near[0], near[1], near[2]} and len(links) >= 2
