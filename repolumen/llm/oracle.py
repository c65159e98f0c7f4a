"""SQL that states the results of the queries that SQL can state."""
from __future__ import annotations

from . import chat, quality

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _divergence(p: str, q: str) -> str:
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END"
    both = f"{part.format(x='z[1]', y='z[2]')} + {part.format(x='z[2]', y='z[1]')}"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {both})) / 2))"


def quality_rules() -> str:
    n = quality.REPEAT_WINDOW
    lists = "CASE lang " + " ".join(
        "WHEN '{}' THEN [{}]".format(lang, ", ".join(f"'{w}'" for w in words)) for lang, words in sorted(quality.COMMON_WORDS.items())) + " END"
    size, places = len(quality.CLASSES), 1 + max(map(len, quality.COMMON_WORDS.values()))

    def keep(kind: str) -> str:
        return f"length(regexp_replace(odd, '[^{kind}]+', '', 'g'))"

    def references(name: str, rows: str) -> str:
        means = ", ".join(f"[{', '.join(f'avg({k}s[{i}])' for i in range(1, m + 1))}] AS ref_{k}" for k, m in (("class", size), ("word", places)))
        return f"{name} AS (SELECT lang, {means} FROM {rows} WHERE NOT base_failed AND n_words >= {quality.LEAST_WORDS} GROUP BY 1)"

    def judged(name: str, refs: str, factor: int) -> str:
        far = ", ".join(
            f"CASE WHEN n_words >= {quality.LEAST_WORDS} THEN {_divergence(f'{k}s', f'ref_{k}')} END AS {k}_distance" for k in ("class", "word"))
        return (
            f"{name} AS (SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {factor * quality.MOST_CLASSES} AND "
            f"coalesce(word_distance, 0) <= {quality.MOST_WORDS} AS kept FROM (SELECT s.*, {far} FROM shares s LEFT JOIN {refs} r ON r.lang = s.lang))")

    return rf"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
runs AS (SELECT row, i, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM (SELECT row, w, unnest(range(1, len(w) - {n - 2})) AS i FROM docs WHERE len(w) >= {n})),
often AS (SELECT row, run FROM runs GROUP BY 1, 2 HAVING count(*) > 1),
inside AS (SELECT row, count(DISTINCT pos) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + {n})) AS pos FROM runs JOIN often USING (row, run)) GROUP BY 1),
counted AS (SELECT row, doc_id, lang, w, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    regexp_replace(array_to_string(w, '  '), '[\p{{Ll}}\x20]+', '', 'g') AS odd
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs) LEFT JOIN inside USING (row)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {keep(r'\p{Lu}\p{Lt}')} AS upper, {keep(r'\p{Lo}\p{Lm}\p{M}')} AS letter, {keep(r'\p{N}')} AS digits,
    len(regexp_extract_all(odd, '\p{{N}}+')) AS numbers, {lists} AS common FROM counted),
bins AS (SELECT *, [word_chars - length(odd), upper, letter, numbers, n_symbols, length(odd) - upper - letter - digits - n_symbols] AS cs,
    list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS found FROM based),
whole AS (SELECT *, list_append(found, n_words - list_sum(found)) AS ws FROM bins),
shares AS (SELECT * EXCLUDE (w, odd, common, found), CASE WHEN list_sum(cs) > 0 THEN list_transform(cs, lambda c: CAST(c AS DOUBLE) / list_sum(cs)) END AS classs,
    CASE WHEN n_words > 0 THEN list_transform(ws, lambda c: CAST(c AS DOUBLE) / n_words) END AS words FROM whole),
{references('first', 'shares')}, {judged('seen', 'first', 2)}, {references('refs', '(SELECT * FROM seen WHERE kept)')}, {judged('final', 'refs', 1)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, round(class_distance, 4) AS class_distance, round(word_distance, 4) AS word_distance FROM final"""


def source_mixing() -> str:
    other = r"length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))"
    return rf"""WITH docs AS (SELECT doc_id, source, len({WORDS}) AS size, greatest(0.05, coalesce(1 - CAST({other} AS DOUBLE) / nullif(length(text), 0), 0.0)) AS quality,
    (CAST('0x' || substr(md5('0:' || doc_id), 1, 13) AS BIGINT) + 0.5) / {16 ** 13}.0::DOUBLE AS u FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
weighed AS (SELECT *, CAST(([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sums),
steps AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS k, sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source) - 3 * source_size AS given,
    sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, source DESC) AS free, sum(source_size) OVER () AS whole FROM weighed),
first AS (SELECT given, free, whole, k FROM steps WHERE 3 * source_size >= (whole - given) * weight / free ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN s.k < f.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(f.whole - f.given AS DOUBLE) * weight / f.free END AS target FROM steps s, first f),
parts AS (SELECT *, target - epochs * source_size AS part FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets)),
placed AS (SELECT d.*, source_size, target, epochs, part, sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, doc_id) AS upto FROM docs d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN 2 * upto - size < 2 * part THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed"""


def chat_formatting(marks: str) -> str:
    def length(text: str) -> str:
        return f"length({text}) + len(regexp_extract_all({text}, '<\\\\*\\|'))"

    role = "replace(replace(r, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')"
    fixed = len(chat.START) + len(chat.END) + 2
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', '{marks}' UNION ALL SELECT -1, 1, '{chat.TRAINED}', '{marks}'),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum({fixed} + {length(role)} + {length('t')}) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = '{chat.TRAINED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE r = '{chat.TRAINED}'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN r = '{chat.TRAINED}' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars FROM placed GROUP BY 1"""


def hard_negatives() -> str:
    first = "row_number() OVER (PARTITION BY {by} ORDER BY score DESC, v.vec_id)"
    score = "CAST(list_sum(list_transform(list_zip(a.v, v.v), lambda z: z[1] * z[2])) AS BIGINT)"
    return f"""WITH vectors AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, {score} AS score FROM vectors a JOIN vectors v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.v) = len(v.v)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, {first.format(by='anchor_id')} AS rank FROM scored v WHERE alike) WHERE rank <= 5),
negatives AS (SELECT v.anchor_id, positive_id, positive_score, v.vec_id AS negative_id, score AS negative_score, CAST({first.format(by='v.anchor_id, positive_id')} AS INTEGER) AS rank
  FROM scored v JOIN positives p ON p.anchor_id = v.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""
