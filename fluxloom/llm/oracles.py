"""DuckDB SQL twins of the queries that SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
         FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM pos JOIN wins USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY 1),
h AS (SELECT page_id, last, strlen(html) AS n, upper(sha1(html)) AS x FROM p JOIN m USING (html))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(x, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""

_WORD = "[^\\x20\\x09-\\x0D]+"
_BAD_LINE = f"""(20 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > length(l)
  OR 5 * len(regexp_extract_all(l, '[!?][!?]+')) > len(regexp_extract_all(l, '{_WORD}'))
  OR (NOT regexp_matches(l, '\\p{{Ll}}') AND regexp_matches(l, '\\p{{Lu}}.*\\p{{Lu}}.*\\p{{Lu}}') AND len(regexp_extract_all(l, '{_WORD}')) >= 5)
  OR (len(regexp_extract_all(l, ' [|»›·•>/] ')) >= 3 AND 3 * len(regexp_extract_all(l, ' [|»›·•>/] ')) >= len(regexp_extract_all(l, '{_WORD}')))
  OR (len(string_split_regex(l, '[ \\x09-\\x0D]+')) >= 6 AND 3 * len(list_filter(list_zip(string_split_regex(l, '[ \\x09-\\x0D]+')[2:],
      string_split_regex(l, '[ \\x09-\\x0D]+')[:-2]), lambda z: z[1] = z[2])) >= len(string_split_regex(l, '[ \\x09-\\x0D]+')))
  OR (len(regexp_extract_all(l, '{_WORD}')) < 4 AND NOT regexp_matches(l, '[.!?:;…"”’»)\\]][ \\x09-\\x0D]*\\z'))
  OR (length(l) <= 200 AND regexp_matches(l, '(?i)({"|".join(BOILERPLATE)})')))"""
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n
      FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY 1),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(lines, lambda l: regexp_matches(l, '{_WORD}')) AS filled,
        coalesce(r.n, 0) AS n_repeat_words, lines,
        list_filter(lines, lambda l: NOT (regexp_matches(l, '{_WORD}') AND {_BAD_LINE})) AS good FROM w LEFT JOIN r USING (doc_id)),
y AS (SELECT *, CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, CAST(len(filled) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(good) AS BIGINT) AS n_bad_lines, length(array_to_string(lines, '')) AS chars,
        CAST(length(array_to_string(lines, '')) - length(array_to_string(good, '')) AS BIGINT) AS lost_chars,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x),
quality AS (SELECT *, NOT base_failed AND 100 * lost_chars <= 40 * chars AND 2 * n_dup_lines <= n_lines AS kept, array_to_string(good, chr(10)) AS cleaned FROM y)
"""
OP5 = QUALITY + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bad_lines, lost_chars
FROM quality"""

_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
OP11 = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
h AS (SELECT doc_id, source, text, coalesce('=' || source, '') AS s, hex(encode(coalesce(text, ''))) AS x, md5(text) AS digest FROM documents),
d AS (SELECT doc_id, source, s, digest, CAST(length(x) // 2 + 1 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM h, tab),
c AS (SELECT *, (row_number() OVER (PARTITION BY s, doc_id, digest) - 1) AS k, count(*) OVER (PARTITION BY s) AS n FROM d),
b AS (SELECT *, k // 1000 AS block FROM c),
w AS (SELECT *, CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(digest, '') || ':' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT) AS draw,
        (CAST('0x' || substr(md5('20:' || s), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS phase FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY draw, doc_id NULLS FIRST, size, text_crc32, digest NULLS FIRST, block, k) AS r FROM w),
g AS (SELECT *, row_number() OVER (ORDER BY (r - phase) / n, s, r) - 1 AS g, count(*) OVER () AS total FROM r)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(g * 16 // total AS INT) AS shard,
       CAST(g - (g * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM g
"""


def _kmeans(rounds: int = 3) -> str:
    """One pair of common table expressions per round: assignment (a) and centroids (c)."""
    near = """a{r} AS (SELECT vec_id, x, k AS cluster, distance FROM (
      SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept, c{r})
      QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, k) = 1)"""
    move = """m{r} AS (SELECT cluster AS k, list(CAST(floor_div AS BIGINT) ORDER BY d) AS c FROM (
      SELECT cluster, d, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (
        SELECT cluster, unnest(x) AS v, unnest(range(64)) AS d FROM a{p}) GROUP BY ALL) GROUP BY ALL),
    c{r} AS (SELECT k, coalesce(m{r}.c, c{p}.c) AS c FROM c{p} LEFT JOIN m{r} USING (k))"""
    parts = []
    for r in range(rounds + 1):
        parts += ([move.format(r=r, p=r - 1)] if r else []) + [near.format(r=r)]
    return ",\n".join(parts)


OP12 = f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) <= 16),
{_kmeans()}
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON cluster = k
"""

ORACLES = {"op1_warc": OP1, "op5_quality_rules": OP5, "op9_decontamination": OP9, "op11_sharding": OP11, "op12_centroid_clusters": OP12}
