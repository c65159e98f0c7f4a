"""Document operators against brute force on texts with nulls, blanks, repeats, copies and one very long document."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from repolumen.llm import class_lm, language_id, mixing, packing, quality, secret_scan, simhash
from repolumen.llm.catalog import packed

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, quality int, secrets int"


def texts(seed=1):
    rng = random.Random(seed)
    words = {"en": "the of and to cat dog house river walking talking".split(),
             "fr": "le la et les été où garçon château manger parler".split()}
    made = [(None, "en"), ("", "en"), (" \t\n", None), ("Hi", "en"), ("hi", "en"), ("HI there", "fr"), ("\x0bx\x0cy\rz", "en")]
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        made.append((" ".join(rng.choice(words[lang]) + rng.choice(["", "", ",", ".\n"]) for _ in range(rng.randint(1, 150))), lang))
    base = " ".join(rng.choice(words["en"]) + str(rng.randint(0, 99)) for _ in range(400))
    made += [(base, "en"), (base, "en"), (base.replace("cat", "Cat"), "en"), (base + " end", "en")]
    made.append((" ".join(rng.choice(words["en"]) for _ in range(50_000)), "en"))
    made += [("same line here\n" * 30, "en"), ("### $$$ %%% " * 60, "en"), ("LOUD WORDS SHOUT, " * 5 + base.upper(), "en")]
    return made


def rows(made, start=0):
    return [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 1, 2) for i, (t, lang) in enumerate(made, start)]


@pytest.fixture(scope="module")
def docs(spark):
    made = rows(texts())
    return spark.createDataFrame([*made, made[9], (None, "null id " * 30, "en", "s0", 5, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    """From [(id, fingerprint)] the smallest id of each one's component."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {(i, f): least.get(find(f)) for i, f in prints}


def test_simhash_components(docs, empty):
    want = components([(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()])
    got = simhash.components(docs).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["fingerprint"] % (1 << 64)): r["component"] for r in got} == want
    assert simhash.components(empty).count() == 0
    stay = simhash.first_of_each(docs)
    assert stay.columns == docs.columns
    kept = [r["doc_id"] for r in stay.collect()]
    assert sorted(x for x in kept if x is not None) == sorted({v for v in want.values() if v is not None})
    assert simhash.first_of_each(empty).count() == 0


@pytest.mark.parametrize("distance,crowded", [(1, 128), (2, 128), (2, 4), (3, 8)])
def test_multi_index_pairs(spark, distance, crowded):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) % (1 << 64) for c in centres for _ in range(60)}
    prints |= {centres[0] ^ (i << 7) for i in range(64)} | {centres[1] ^ (i << 40) for i in range(64)}
    prints = sorted({p % (1 << 64) for p in prints})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"), distance, crowded).collect()
    found = [frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in got]
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= distance}
    assert len(found) == len(set(found)) and set(found) == want


def counts_of(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            inside.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_quality_counts(docs, empty):
    got = quality.quality_rules(docs, into="quality").select("doc_id", "text", "quality.*").collect()
    assert len(got) == docs.count()
    for r in got:
        want = counts_of(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
        assert sum(r["classes"]) <= want[1]
    odd = [r for r in got if r["text"] and (r["text"].startswith("LOUD") or r["text"].startswith("###"))]
    assert len(odd) == 2 and not any(r["kept"] for r in odd)
    assert quality.quality_rules(empty).count() == 0


def test_divergence_is_the_square_root_of_jensen_shannon(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(x * math.log2(x / z) for x, z in zip(p, m) if x) / 2 + sum(x * math.log2(x / z) for x, z in zip(q, m) if x) / 2)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert df.select(quality.divergence(F.col("p"), F.col("q"))).first()[0] == pytest.approx(want)


def base_spans(text):
    found = []
    for kind, pattern, flags, least in (("assign", secret_scan.ASSIGN, re.I | re.A, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def secrets():
    import base64

    number = lambda n: der(2, bytes([1] * n))
    rsa = der(0x30, number(1), *[number(40) for _ in range(8)])
    wrapped = der(0x30, number(1), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, bytes(34)))
    text = lambda b: base64.b64encode(b).decode()
    url = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    field = lambda b: len(b).to_bytes(4) + b
    ssh = secret_scan.OPENSSH + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(bytes(51)) + field(bytes(90))
    begin = "-----BEGIN {} KEY-----\n{}\n-----END {} KEY-----"
    return {
        "pem": begin.format("PRIVATE", text(wrapped), "PRIVATE"), "der": text(rsa), "ssh": text(ssh),
        "jwt": ".".join([url('{"alg":"HS256","typ":"JWT"}'), url('{"sub":"1"}'), url("signature" * 4)]),
        "broken pem": begin.format("PRIVATE", text(bytes(range(60))), "PRIVATE"), "broken der": text(rsa[:-30]), "noise": text(bytes(range(90))),
        "broken jwt": ".".join([url('{"typ":"none, of this"}'), url('{"sub":"1"}'), url("signature" * 4)]), "hex der": rsa.hex(),
    }


def test_secret_structure_is_confirmed():
    made = secrets()
    for name, text in made.items():
        kinds = [k for k, _, _ in secret_scan.find_secrets(f"é see {text} here") if k not in ("assign", "access", "hex")]
        want = [] if name.startswith("broken") or name == "noise" else ["der"] if name == "hex der" else [name]
        assert kinds == want, name
        for k, a, b in secret_scan.find_secrets(f"é see {text} here"):
            assert f"é see {text} here"[a:b] == text or k == "hex"


def test_secret_spans_and_redaction(spark, empty):
    made = secrets()
    cases = [None, "", "password=abc", "password = 'hunter22' Token:secret=abcdefg", "ſecret=abcdefgh passwd: xyzxyz12", "secret=token: abcdefgh",
             "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 14, "f" * 24, "f" * 23, "api_key=" + "0f" * 20, "é" * 5 + "token=" + "ab" * 15 + " x",
             *(f"a {t} b" for t in made.values())]
    df = spark.createDataFrame([(i, t, 1, "s", 9, "x", 1, 2) for i, t in enumerate(cases)],
                               "doc_id bigint, text string, lang int, source string, n_chars bigint, fingerprint string, quality int, secrets int")
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secret_scan.secret_spans(df).collect()}
    for i, t in enumerate(cases):
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == base_spans(t), t
    clean = {r["doc_id"]: r for r in secret_scan.redacted(df).collect()}
    for i, t in enumerate(cases):
        want, at = t, 0
        if got[i]:
            merged = []
            for a, b in sorted((a, b) for _, a, b in got[i]):
                if merged and merged[-1][1] >= a:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            want = ""
            for a, b in merged:
                want, at = want + t[at:a] + "[secret]", b
            want += t[at:]
        assert clean[i]["text"] == want
        assert clean[i]["n_chars"] == (len(want) if got[i] else 9)
    assert secret_scan.redacted(empty).columns == empty.columns and secret_scan.redacted(empty).count() == 0


def test_language_filters(docs, empty):
    model = language_id.learn(docs)
    assert model.languages == ["en", "fr"] and (model.chance < 0.01).all()
    got = language_id.predict(docs.select("doc_id", "text", F.lit(1).alias("score"), "lang"), model).collect()
    for r in got:
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    # texts of made-up words: all long ones are told apart
    wrong = [i for i, (t, lang) in enumerate(texts()) if t and len(t) > 200 and t[0] not in "#" and by[i]["lang_pred"] != lang]
    assert not wrong
    none = language_id.learn(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_filter_returns_all_languages_of_a_gram(spark):
    df = spark.createDataFrame([("abcd efgh", "x"), ("abcd ijkl", "y"), ("mnop", "z")], "text string, lang string")
    model = language_id.learn(df)
    import numpy as np

    def found(word):
        g = language_id.grams(word)[2:3]  # the run inside the word
        at = [(g >> np.uint64(language_id.SLOT_BITS * k) & np.uint64((1 << language_id.SLOT_BITS) - 1)).astype(int) for k in range(3)]
        bits = model.slots[0][at[0]] & model.slots[0][at[1]] & model.slots[0][at[2]]
        return [lang for i, lang in enumerate(model.languages) if bits[0] >> i & 1]

    assert found("abcd") == ["x", "y"] and found("ijkl") == ["y"] and found("mnop") == ["z"] and found("qrst") == []


def test_packing_plan():
    rng = random.Random(2)
    for n, capacity in ((0, 16), (1, 16), (50, 16), (3000, 64), (500, 7)):
        lengths = Counter(rng.randint(1, capacity) for _ in range(n))
        made = packing.plan(dict(lengths), capacity)
        used = Counter()
        for parts, times in made:
            assert times > 0 and sum(parts) <= capacity
            for x in parts:
                used[x] += times
        assert used == lengths
        whole = sum(k * v for k, v in lengths.items())
        assert sum(t for _, t in made) <= -(-whole // capacity) * 1.25 + 1
    assert packing.plan({9: 2, 4: 1, 3: 2, 1: 3}, 16) and ((9, 4, 3), 1) in packing.plan({9: 1, 4: 1, 3: 1}, 16)


def test_packed_pieces(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, want = Tokenizer.from_file(path), Counter()
    hard = "don't STOP<|endoftext|>now  x ½² ŉ ǅ İstanbul é \u0085 I'M 12three"
    more = docs.sparkSession.createDataFrame([(900, hard, "en", "s", 1, "x", 1, 2)], SCHEMA)
    some = docs.union(more)
    for r in some.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k:k + 64]
            want[(r["doc_id"], k // 64, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    got = packed(some, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1
    assert packed(empty).count() == 0


def targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        out = {s: 3 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in full and out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above


def test_mixing(docs, empty):
    def mixed(df):
        return mixing.mix(df, mixing.word_count(F.col("text")), mixing.letter_share(F.col("text")), keep_text=False).select(
            "doc_id", "source", "mix.*").collect()

    got = mixed(docs)
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixed(docs)))
    assert mixed(empty) == []


def test_mixing_takes_whole_epochs_then_the_smallest_keys(spark):
    rng = random.Random(3)
    made = [(i, " ".join(["w"] * rng.randint(0, 9)), "a" if i < 300 else "b") for i in range(400)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    got = mixing.mix(df, mixing.word_count(F.col("text")), F.lit(1.0)).select("doc_id", "source", "mix.*").collect()

    def key(i):
        return -math.log((int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13)

    for source in "ab":
        part = sorted((r for r in got if r["source"] == source), key=lambda r: key(r["doc_id"]))
        copies = [r["copies"] for r in part]
        assert copies == sorted(copies, reverse=True) and len(set(copies)) <= 2
        assert min(copies) == int(part[0]["target"] / part[0]["source_size"])


def test_weights_favour_quality(spark):
    df = spark.createDataFrame([(i, "w w", "ab"[i % 2 == 0]) for i in range(2000)], "doc_id bigint, text string, source string")
    good = F.when(F.col("doc_id") % 4 < 2, F.lit(1.0)).otherwise(F.lit(0.1))
    got = mixing.mix(df, F.lit(2).cast("long"), good).select("doc_id", "source", "mix.copies").collect()
    extra = [r for r in got if r["copies"] > min(x["copies"] for x in got if x["source"] == r["source"])]
    assert sum(r["doc_id"] % 4 < 2 for r in extra) > 0.7 * len(extra) > 0


def test_class_scores(docs, empty):
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    counts, ends = Counter(), 0
    for r in docs.collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update((r["text"] or "").encode().lower().split())
            ends += 1
    counts["end"] = ends
    n, v = sum(counts.values()), len(counts)
    model = class_lm.learn(docs.filter(~out))
    assert (model.tokens, model.words) == (n, v)
    got = class_lm.score(docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("known")), model).collect()
    by = {r["doc_id"]: r for r in docs.collect()}
    for r in got:
        words = [*(by[r["doc_id"]]["text"] or "").encode().lower().split(), "end"]
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in counts for w in words) and r["known"] == "x"
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] < 0
    none = class_lm.learn(empty)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in class_lm.score(docs.select("doc_id", "text"), none).collect())


def test_class_score_by_brute_force(docs, monkeypatch):
    """The score from the classes alone: every count and probability again, from the texts."""
    monkeypatch.setattr(class_lm, "KNOWN", 40)  # so that some words have a class by length
    texts = [(r["text"] or "").encode().lower().split() for r in docs.collect()]
    model = class_lm.learn(docs)
    assert len(model.known) <= 40
    counts = Counter(w for t in texts for w in t)
    edge, classes = class_lm.CLASSES + class_lm.SHAPES, class_lm.CLASSES + class_lm.SHAPES + 1

    def kind(w):
        return int(model.group[model.known[w]]) if w in model.known else class_lm.CLASSES + min(len(w) // 4, class_lm.SHAPES - 1)

    after, pairs, size, kinds = Counter(), Counter(), Counter(), Counter()
    for w, n in counts.items():
        size[kind(w)] += n
        kinds[kind(w)] += 1
    for t in texts:
        row = [edge, *map(kind, t), edge]
        pairs.update(zip(row, row[1:]))
        after.update(row[1:])
    whole = sum(pairs.values())
    first = Counter()
    for (a, _), n in pairs.items():
        first[a] += n

    def chance(a, b):
        share = (after[b] + 1) / (whole + classes)
        return (pairs[a, b] + class_lm.PRIOR * share) / (first[a] + class_lm.PRIOR)

    more = ["the of unseenword cat", "zz", ""]
    asked = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(-1 - i, t) for i, t in enumerate(more)], "a bigint, b string"))
    text = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in asked.collect()}
    for r in class_lm.score(asked, model).collect():
        want, last = 0.0, edge
        for w in text[r["doc_id"]]:
            k = kind(w)
            want += math.log10(chance(last, k)) + math.log10((counts[w] + 1) / (size[k] + kinds[k] + 1))
            last = k
        assert r["score"] == pytest.approx(want + math.log10(chance(last, edge)))


def test_frequent_words_of_an_even_vocabulary(spark, monkeypatch):
    """Words as frequent as each other are held too, as many as there is room for."""
    monkeypatch.setattr(class_lm, "KNOWN", 200)
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(3000)),)], "text string")
    assert 120 <= len(class_lm.learn(df, rounds=1).known) <= 200


def test_languages_of_unseen_texts(docs):
    """Texts that the filters did not learn from get the language they are written in."""
    rng = random.Random(9)
    words = {"en": "the of and to cat dog house river walking talking".split(), "fr": "le la et les été où garçon château manger parler".split()}
    made = [(i, " ".join(rng.choices(words[("en", "fr")[i % 2]], k=30))) for i in range(40)]
    df = docs.sparkSession.createDataFrame(made, "doc_id bigint, text string")
    got = language_id.predict(df, language_id.learn(docs.filter("doc_id < 80"))).collect()
    assert all(r["lang_pred"] == ("en", "fr")[r["doc_id"] % 2] and r["score"] > 0.5 for r in got)


def test_class_probabilities_sum_to_one(docs):
    import numpy as np

    model = class_lm.learn(docs)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    words = [w for w in model.known]
    place = np.arange(len(words))
    inner = 10 ** (np.log10(model.frequency + 1) + model.emission[model.group[model.unit]])
    for c in set(model.group[model.unit].tolist()):
        assert inner[place[model.group[model.unit] == c]].sum() <= 1


def test_exchange_finds_the_better_class():
    import numpy as np

    size = class_lm.CLASSES + class_lm.SHAPES + 1
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 5, (12, 12))
    group = np.arange(12) % 3
    table = np.zeros((size, size))
    np.add.at(table, (group[:, None].repeat(12, 1), group[None].repeat(12, 0)), pairs)
    for w in range(12):
        right, left = np.zeros(size), np.zeros(size)
        for x in range(12):
            if x != w:
                right[group[x]] += pairs[w, x]
                left[group[x]] += pairs[x, w]

        def value(c):
            g = group.copy()
            g[w] = c
            t = np.zeros((size, size))
            np.add.at(t, (g[:, None].repeat(12, 1), g[None].repeat(12, 0)), pairs)
            return class_lm._likelihood(t)

        best = class_lm.best_class(table, int(group[w]), right, left, float(pairs[w, w]))
        assert value(best) == pytest.approx(max(value(c) for c in range(class_lm.CLASSES)))
