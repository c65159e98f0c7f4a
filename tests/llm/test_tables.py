"""Vector, page and conversation operators, and the pipeline, against brute force."""
import hashlib
import random
import re
from collections import Counter
from html import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolumen.llm import boilerplate, chat, nearest

from .test_documents import SCHEMA, components, counts_of, fingerprint, rows, targets, texts


def vectors(n=1500, dim=20):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(n, dim)).astype(np.float32)
    made[300:700] = made[7]  # a large group of copies
    made[700:900] = made[8] + rng.normal(size=(200, dim)).astype(np.float32) * 1e-3
    made[900] = 2 * made[8]
    odd = {950: None, 1000: [0.0] * dim, 1050: [float("nan")] + [1.0] * (dim - 1), 1051: [float("inf")] + [1.0] * (dim - 1), 1052: [None] + [1.0] * (dim - 1)}
    found = [(i, odd.get(i, [float(x) for x in v]), 1, 2.0) for i, v in enumerate(made)]
    return [*found, (None, [1.0] * dim, 1, 2.0), found[50], found[51], (5000, [1.0, 2.0, 3.0], 1, 0.0), (5050, [3.0, 2.0, 1.0], 1, 0.0)]


def test_neighbours(spark):
    made = vectors()
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<float>, rank int, score double")
    got = nearest.search(df, F.col("vec_id") % 50 == 0).collect()
    usable = {i: np.array(v, float) for i, v, *_ in made if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    by, hits, total = {}, 0, 0
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in usable if i % 50 == 0}
    for q, found in by.items():
        others = [i for i in usable if i != q and len(usable[i]) == len(usable[q])]
        x = np.stack([usable[i] for i in others])
        cosine = (x * usable[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((usable[q] ** 2).sum()))
        best = sorted(zip(-cosine, others))[:5]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, min(5, len(others)) + 1))
        score = dict(zip(others, cosine))
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
        total += len(best)
        if q == 350 or q == 650:  # a copy: the smallest other copies, exactly
            assert [i for _, i, _ in found] == [7, 300, 301, 302, 303]
    assert hits >= 0.9 * total


def test_neighbours_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], schema)
    got = nearest.search(df, F.col("vec_id") == 0, tables=1, probes=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 0.0), (2, 1, -1.0)]
    # more ties than places: different vectors of exactly the same cosine, the smallest keys first
    made = np.random.default_rng(3).normal(size=(61, 8)).tolist()
    made += [[x * 2.0 ** (20 - i) for x in made[50]] for i in range(40)]
    got = nearest.search(spark.createDataFrame(list(enumerate(made)), schema), F.col("vec_id") == 50).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 61), (2, 62), (3, 63), (4, 64), (5, 65)]


def pages():
    """(page, its main text by how it was made): repeated passages of articles stay, what most pages of a host hold goes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    made, want = [], []
    shared = text(40)
    for i in range(60):
        host = "big.example.com" if i % 3 else f"h{i % 2}.example.com"
        body = [text(20) + " & <x>", shared if i % 5 == 0 else text(30), "Summary", text(3)]
        menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("home page", "about us now", "contact"))
        notice = f"<div>{host} uses small files to remember who is reading this page today</div>"
        inside = f"<div>All words of {host} may be</div><div>used again</div>"  # neutral markup, one run over two blocks
        inner = "".join(f"<p>{escape(b)}" + ("</p>" if j % 2 else "\n\t<br>") for j, b in enumerate(body))
        article = f"<article><header><h1>Title {i}</h1></header>{inner}{inside}<div class='share-buttons'>share it</div></article>"
        page = (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if(a<b)'</p>'</script></head><body class='page menu'>"
                f"<nav><ul>{menu}</ul></nav><!-- c <p> -->{notice}{article if i % 2 else f'<div>{inner}{inside}</div>'}"
                f"<section id='comments'><p>Nice {word()}</p></section><footer>&copy; {host}</footer></body></html>")
        made.append((i, f"https://{host}/p/{i}?q=1", page, "x", 1))
        want.append("\n".join(([f"Title {i}"] if i % 2 else []) + body))
    return made, want


def by_suffix_array(made):
    """The text of each page, from the sorted suffixes of all distinct pages of its host."""
    hosts = {}
    for i, url, page, *_ in made:
        hosts.setdefault(re.search("(?://([^/?#]*)|$)", url or "")[1] or "", []).append((i, boilerplate.blocks_of(page or "")))
    run, found = boilerplate.SHARED_RUN, []
    for held in hosts.values():
        distinct = sorted({tuple(t for t, *_ in blocks) for _, blocks in held})
        streams = [[w for t in p for w in t.split(" ")] for p in distinct]
        suffixes = sorted((s[at:at + run], n) for n, s in enumerate(streams) for at in range(len(s) - run + 1))
        common, at = set(), 0
        while at < len(suffixes):
            end = at
            while end < len(suffixes) and suffixes[end][0] == suffixes[at][0]:
                end += 1
            n = len({p for _, p in suffixes[at:end]})
            if n >= boilerplate.LEAST_PAGES and n >= boilerplate.LEAST_SHARE * len(streams):
                common.add(tuple(suffixes[at][0]))
            at = end
        for i, blocks in held:
            words = [w for t, *_ in blocks for w in t.split(" ")]
            covered = [any(tuple(words[k:k + run]) in common for k in range(max(0, p - run + 1), p + 1)) for p in range(len(words))]
            has_main, place, mine = any(m and not f for _, m, f in blocks), 0, []
            for t, m, f in blocks:
                n = t.count(" ") + 1
                if not f and (m or not has_main):
                    mine.append((t, n, sum(covered[place:place + n]) >= boilerplate.LEAST_COVERED * n))
                place += n
            total, gone = sum(n for _, n, _ in mine), sum(n for _, n, g in mine if g)
            copies = gone > boilerplate.MOST_SHARED * total if has_main else gone == total
            found.append((i, "\n".join(t for t, _, g in mine if copies or not g)))
    return found


def test_main_text(spark):
    made, want = pages()
    edge = [(100, None, None, "x", 1), (101, "u", "", "x", 1), (102, "https://one.example/", "<p>A&amp;B&nbsp;C &lt;d&gt; &#233;<p>E<b>F</b>G", "x", 1),
            (103, "x", "<script>never closed", "x", 1), (104, "x", "plain < text", "x", 1), made[1], (None, None, "<p>no key</p>", "x", 1)]
    # a host of copies: their texts stay, with and without an article; and one very long page
    copy, twice = "<p>one text of many words that two pages of a host hold in full</p>", "<article><p>near copies of one long article all keep its words {}</p></article>"
    edge += [(105, "//copies/a", copy, "x", 1), (106, "//copies/b", copy, "x", 1)]
    edge += [(110 + i, "//near/", twice.format(i), "x", 1) for i in range(4)]
    edge += [(120, "//big.example.com/", "<article><p>" + " ".join(f"w{i}" for i in range(100_000)) + "</p></article>", "x", 1)]
    df = spark.createDataFrame([*made, *edge], "page_id bigint, url string, html string, text string, row int")
    got = boilerplate.main_text(df).collect()
    assert len(got) == len(made) + len(edge)
    by = {r["page_id"]: r["text"] for r in got}
    for i, text in enumerate(want):
        assert by[i] == text, i
    assert (by[100], by[101], by[103], by[104], by[None]) == ("", "", "", "plain < text", "no key")
    assert by[102] == "A&B C <d> é\nEFG"
    assert by[105] == by[106] == copy[3:-4] and by[112] == twice.format(2)[12:-14] and len(by[120].split()) == 100_000
    assert sorted(map(str, ((r["page_id"], r["text"]) for r in got))) == sorted(map(str, by_suffix_array([*made, *edge])))
    assert boilerplate.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_main_text_equals_suffix_array(spark, seed):
    """Random pages of few words on hosts of one to many pages, so that runs of every share and place occur."""
    rng = random.Random(seed)
    pieces = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 12))) for _ in range(25)]
    made = []
    for i in range(120):
        host = rng.choice(["a", "a", "a", "b", "b", "c", f"h{i}"])
        parts = [rng.choice(pieces[:6] if rng.random() < 0.6 else pieces) for _ in range(rng.randint(0, 7))]
        tags = [rng.choice(["div", "p", "nav", "div"]) for _ in parts]
        inner = "".join(f"<{t}>{p}</{t}>" for t, p in zip(tags, parts))
        half = rng.random() < 0.5
        made.append((i, f"http://{host}/{i}", f"<div>{pieces[0]}</div>" + (f"<article>{inner}</article>" if half else inner), "x", 1))
    df = spark.createDataFrame(made, "page_id bigint, url string, html string, text string, row int").repartition(7)
    got = sorted((r["page_id"], r["text"]) for r in boilerplate.main_text(df).collect())
    assert got == sorted(by_suffix_array(made))


def test_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "|", "\\", "a", "<|im_end|>", "\n"]) for _ in range(rng.randint(0, 9)))
        assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text
        assert chat._role_back(chat._role(text)) == text and "\n" not in chat._role(text)


def test_chat_examples(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    made = [(1, 0, "system", "s"), (1, 1, "user", marks), (1, 2, "assistant", marks), (1, 3, "user", "<\\|x"), (1, 4, "assistant", None),
            (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (4, 0, None, "n"), (4, 0, "assistant", "é😀"),
            (None, 0, "assistant", "null"), (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"), (6, None, "user\n<|", "x")]
    made += [(7, i, ("user", "assistant")[i % 2], f"{i} " * 50) for i in range(60)]
    df = spark.createDataFrame([(*m, 1, "f") for m in made], "conv_id bigint, turn bigint, role string, text string, example int, formatted string")
    kept = {}
    for c, k, r, t in made:
        kept.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    examples = chat.examples(df)
    by = {}
    for r in examples.collect():
        by.setdefault(r["conv_id"], []).append(r)
    for c, turns in kept.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        mine = sorted(by[c], key=lambda r: r["example"])
        replies = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        assert len(mine) == len(replies) + (not turns or turns[-1][0] != "assistant")
        for r, i in zip(mine, replies):
            assert chat.parsed(r["formatted"]) == turns[:i + 1]
            assert chat.unescaped(r["formatted"][r["loss_start"]:r["loss_end"]]) == turns[i][1]
    for r in chat.read_back(examples).collect():
        turns = [(a, t) for _, _, a, t in sorted(kept[r["conv_id"]])]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x["formatted"]) for x in by[r["conv_id"]])
    assert chat.examples(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    made = rows(texts(7)) + [(500, "password=abcdefgh12 " + " ".join(f"w{i}" for i in range(300)), "en", "s0", 0, None, None, None)]
    docs = spark.createDataFrame(made, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        at = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert at.columns == docs.columns
        seen.append(at.collect())
    judged, distinct, clean, mixed = seen
    text = {m[0]: m[1] for m in made}
    failed = {i for i, t in text.items() if (c := counts_of(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert not failed & {r["doc_id"] for r in judged}
    assert {i for i in range(7, 67) if i not in failed} <= {r["doc_id"] for r in judged}  # plain prose stays
    component = components([(r["doc_id"], fingerprint(r["text"])) for r in judged])
    assert sorted(r["doc_id"] for r in distinct) == sorted(set(component.values()))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in distinct}
    changed = [r for r in clean if r["text"] != text[r["doc_id"]]]
    assert [r["doc_id"] for r in changed] == [500] and changed[0]["text"].startswith("[secret] w0") and changed[0]["n_chars"] == len(changed[0]["text"])
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3 and {r["text"] for r in mixed} <= {r["text"] for r in clean}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += words(r["text"])
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(words(r["text"]) for r in clean if r["source"] == s) for s in want)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in whole if r["piece"] == 0) == copies
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
