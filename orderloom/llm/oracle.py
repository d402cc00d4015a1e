"""DuckDB SQL of the text operators that SQL can express."""

from orderloom.llm.licenses import RULES, SENTENCES

SPACE = r"[\x20\x09-\x0D]"


def _licenses() -> str:
    """Every sentence of every text against every pattern; no filter goes before."""
    every = "|".join(f"(?:{pattern})" for _, pattern in SENTENCES)
    names = " ".join(f"WHEN regexp_matches(h, '^(?:{pattern})') THEN '{name}'" for name, pattern in SENTENCES)
    steps, last = [], "s0"
    for i, (name, run) in enumerate(RULES, 1):
        ids = r"(<\?>){0,3}".join(f"<{x}>" for x in run)
        steps.append(
            f"s{i} AS (SELECT doc_id, sentence_ids, CASE WHEN regexp_matches(rest, '{ids}') THEN list_append(found, '{name}') "
            f"ELSE found END AS found, regexp_replace(rest, '{ids}', '|', 'g') AS rest FROM {last})"
        )
        last = f"s{i}"
    # a mark is no end in "License-Identifier: MIT", after a lone v, nor a dot before a number; such marks
    # become other characters first
    return rf"""
WITH c AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g') AS flat FROM documents),
p AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(flat,
           '(?i)(license[- ]identifier): ', '\1- ', 'g'),
           '(?i)(^|[^a-z0-9])v\. ', '\1v- ', 'g'),
           '\.( [0-9])', '-\1', 'g') AS held
  FROM c),
n AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(held, '([.:;!?]) ', '\1' || chr(10), 'g'), chr(10)),
           lambda s: trim(regexp_replace(regexp_replace(
             translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+', ' ', 'g'),
             '[.]+( |$)', ' ', 'g'), ' ')) AS plain
  FROM p),
x AS (
  SELECT doc_id, list_transform(plain, lambda s: CASE WHEN contains(s, 'spdx license identifier ')
           THEN replace(regexp_replace(replace(s, ' or later', ' or_later'), ' (or|and) ', ' spdx license identifier ', 'g'),
                        ' or_later', ' or later') ELSE s END) AS plain
  FROM n),
i AS (
  SELECT doc_id, flatten(list_transform(plain, lambda s: CASE
           WHEN regexp_matches(s, '{every}') THEN list_transform(regexp_extract_all(s, '{every}', 0), lambda h: CASE {names} END)
           WHEN regexp_matches(s, 'licen[sc]|copyright|warrant|redistribut|permission|spdx|public domain|as is|liable|all rights reserved') THEN ['?']
           ELSE CAST([] AS VARCHAR[]) END)) AS sentence_ids
  FROM x),
s0 AS (
  SELECT doc_id, sentence_ids, CAST([] AS VARCHAR[]) AS found,
         coalesce(array_to_string(list_transform(sentence_ids, lambda x: '<' || x || '>'), ''), '') AS rest
  FROM i),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses,
       coalesce(array_to_string(sentence_ids, ','), '') AS sentence_ids,
       CAST(len(list_filter(regexp_split_to_array(rest, '[|<>]+'), lambda s: s <> '')) AS BIGINT) AS unmatched
FROM {last}
"""

STATEMENTS = {
    "op1_licenses": _licenses(),
    "op3_source_mix": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS most,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
w AS (
  SELECT *, sum(source_size) OVER () * 3 / 2 AS budget, sum(weight) OVER () AS weight_total,
         coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM s WINDOW o AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * (weight_total - weight_before) <= weight * (budget - most_before) AS stops FROM w),
t AS (
  SELECT source, source_size, budget,
         CASE WHEN stops THEN CAST(most AS DOUBLE)
              ELSE weight * (budget - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ())
                   / (weight_total - sum(CASE WHEN stops THEN weight ELSE 0 END) OVER ()) END AS target
  FROM f),
q AS (
  SELECT d.*, source_size, target, budget, r.round,
         coalesce(sum(size) OVER (PARTITION BY source, r.round ORDER BY place, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + r.round * source_size AS base
  FROM d JOIN t USING (source) CROSS JOIN (VALUES (0), (1)) r(round)),
p AS (SELECT *, greatest(least(size, floor(target) - base), 0) AS early FROM q),
v AS (
  SELECT *, early AS words, 0 AS part, (base + early) / target AS finish FROM p WHERE early > 0
  UNION ALL
  SELECT *, size - early, 1, (base + size) / target FROM p WHERE size > early),
c AS (
  SELECT doc_id, words, budget, coalesce(sum(words) OVER (
    ORDER BY finish, source, place, doc_id, size, round, part
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM v),
g AS (SELECT doc_id, sum(least(words, greatest(floor(budget) - before, 0))) AS got FROM c GROUP BY doc_id)
SELECT d.doc_id, size, source_size, target, CAST(coalesce(got, 0) AS BIGINT) AS taken
FROM d JOIN t USING (source) LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op6_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
""",
    "op9_exact_dedup": rf"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM rows
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
    "op10_warc_revisits": r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x
  FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5)) AS BIGINT)
             // CAST(power(32, 3 - i % 4) AS BIGINT) % 32 + 1, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY 1),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM words, range(1, 5) AS t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : c.cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1 :], ' ')),
low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (
  SELECT lang, f, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS size FROM f WHERE k > 2),
inner_phrases AS (
  SELECT lang, f, array_to_string(ws[i : i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM inner_runs)),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY 1, 2),
kept AS (
  SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase)
  WHERE longer.f IS NULL OR CAST(100 AS HUGEINT) * longer.f < CAST(80 AS HUGEINT) * low.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
""",
}
