"""Periodic runs against all periods of all stretches."""
import random

import pytest
from pyspark.sql import functions as F

from repolumen.llm import catalog, periodic


def brute(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    drop = {k for i, length, q in out for k in range(i + q, i + length)}
    return sorted(out, key=lambda r: (r[0], r[2])), " ".join(w for k, w in enumerate(words) if k not in drop)


def made(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 30]))]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):  # a cycle, sometimes with a last part, and the same words elsewhere
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(2, 6))[:rng.randint(4, 40)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least", [12, 4, 1])
def test_runs_equal_brute_force(seed, least):
    texts = made(seed)
    got = periodic._runs([[w.encode() for w in t] for t in texts], least)
    for words, runs in zip(texts, got, strict=True):
        want, collapsed = brute(words, least)
        assert runs == want
        assert periodic._collapsed([w.encode() for w in words], runs).decode() == collapsed


def test_long_texts():
    assert periodic._runs([[b"x"] * 50000, [], [b"a", b"b"] * 30000 + [b"a"]], 12) == [[(0, 50000, 1)], [], [(0, 60001, 2)]]


def test_table(spark):
    texts = [" ".join(w) for w in made(9)] + [None, "", " \t\n", "a  b\n" * 9]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id bigint, text string, runs string")
    got = {r["doc_id"]: r for r in periodic.find_runs(docs).collect()}
    for i, t in enumerate(texts):
        want, collapsed = brute((t or "").split())
        assert [tuple(r) for r in got[i]["runs"]] == want and got[i]["collapsed"] == collapsed
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_cycled_words(spark):
    rows = [(" ".join(f"w{i}" for i in range(n)), g) for n in (0, 1, 2, 7, 60) for g in (0, 5, 123456789, 429496729)]
    df = spark.createDataFrame([*rows, (None, 3)], "text string, g bigint")
    for r in df.select("text", "g", catalog.cycled(F.col("text"), F.col("g")).alias("out")).collect():
        words = (r["text"] or "").split()
        n = len(words)
        if n:
            a = r["g"] % n
            p = 1 + (n - a) // (3 + r["g"] % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r["out"] or "") == " ".join(words)
