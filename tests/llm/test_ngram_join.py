"""The n-gram join against all pairs; its trees against set arithmetic."""
import random

import numpy as np
import pytest

from repolumen.llm import ngram_join, trees

SCHEMA = "doc_id bigint, text string, n bigint, _row string"


def made(seed=5):
    """Groups of near copies on both sides of the limit, a wide crowd, a passage in many texts, short and blank texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out, passage = [], [word() for _ in range(30)]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 250))]
        for changes in (0, 1, 1, 2, 4):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    out += [" ".join([word() for _ in range(rng.randint(0, 9))] + passage + [word() for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    crowd = [word() for _ in range(150)]
    for i in range(120):
        text = list(crowd)
        for _ in range(i % 6):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text))
    out += [out[3], out[3].upper(), "a b", "A\tb", "a b c", "c", None, "", " \n", "x " * 5000, "x " * 4000]
    rng.shuffle(out)
    return list(enumerate(out))


def brute(rows, num=90, den=100):
    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets, up = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and den * len(a & b) >= num * len(a | b):
                links += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}, links


@pytest.mark.parametrize("held", [512, 6])
def test_components_equal_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(trees, "HELD", held)
    rows = made()
    want, links = brute(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n"], r["component"]) for r in ngram_join.components(docs).collect()}
    assert links > 500 and got == want
    assert ngram_join.components(docs.limit(0)).count() == 0


def test_null_and_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (4, text + " more"), (4, text), (None, "on its own here"), (7, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n"], r["component"]) for r in ngram_join.components(docs).collect()), key=str)
    assert got == sorted([(None, 58, 4), (4, 59, 4), (4, 58, 4), (None, 2, None), (7, 0, 7)], key=str)


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_what_sets_share(seed):
    rng = random.Random(seed)
    base = rng.sample(range(300), 90)
    sets = [np.array(sorted(set(base) - set(rng.sample(base, rng.randint(0, 9))) | set(rng.sample(range(300), rng.randint(0, 4))))) for _ in range(40)]
    sizes = [len(s) + rng.randint(0, 3) for s in sets]  # n-grams that no other set has
    stored, asks = list(range(25)), list(range(15, 40))
    label = {i: i for i in range(40)}
    pick = lambda at: ([sets[i] for i in at], [sizes[i] for i in at], at)
    links = trees.tree_links(*pick(stored), *pick(asks), 90, 100, label)
    similar = {(a, b) for a in stored for b in asks if a != b
               and 190 * len(np.intersect1d(sets[a], sets[b])) >= 90 * (sizes[a] + sizes[b])}
    assert set(links) <= similar and len(links) < 40 and similar
    assert all(label[a] == label[b] for a, b in similar)
    assert len(set(label.values())) == 40 - len(links)


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_linked_sets_share_a_sign(num):
    """Sets as different as a link allows, of all sizes, also where the number of pieces changes."""
    rng = np.random.default_rng(num)
    for n in [*range(1, 60), *rng.integers(60, 1500, 400)]:
        out = int(rng.integers(0, n * (100 - num) // 100 + 1))
        more = (n - out) * (100 - num) // num - out
        hashes = rng.integers(0, 1 << 64, n + more, np.uint64)
        a, b = np.sort(hashes[:n]), np.sort(hashes[out:])
        assert 100 * (n - out) >= num * len(hashes)
        if out or more:
            assert len(np.intersect1d(ngram_join._signs(a, num, 100), ngram_join._signs(b, num, 100)))


def test_only_sets_with_a_near_copy_are_read_in_full(spark, monkeypatch):
    """Texts made of the same phrases have many n-grams in common with others, but only some have a near copy."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    phrases = [" ".join(word() for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.sample(phrases, 30)) for _ in range(100)]
    texts += [t + " end" for t in texts[:10]]
    read = {}
    write = ngram_join.written

    def kept(df, name):
        out = write(df, name)
        read[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component"] for r in ngram_join.components(docs).collect()}
    assert got == {i: i % 100 for i in range(110)}
    assert 20 <= read["grams"] <= 30
