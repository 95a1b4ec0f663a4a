"""DuckDB SQL of the queries that SQL can express, for all rows of the same tables.

The others are held to brute force in tests/llm: HTML trees (op1), the seeded mix (op2),
look-ahead rules (op4), Viterbi and naive Bayes (op5), base-32 digests (op6), SimHash (op7),
64-bit xxhash trees (op8), the language model (op10) and tokenizers (op13) have no SQL form. What SQL can say of
op2, op4, op5 and op8 stands in queries of its own.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS k FROM w, range(1, len(ws) - 33) r(s)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM again, range(0, 35) r(j)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
mark AS (SELECT a.doc_id, a.i, a.word, g.i IS NOT NULL AS gone FROM word a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM mark),
per AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
        string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM run GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN per ON w.doc_id = per.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k FROM w, range(1, greatest(len(ws) - 4, 1) + 1) r(s)
       WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id
         GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y, c = p.n AND c = q.n AS same FROM pair JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id
         WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE x = w.doc_id) AS component_id,
       1 + (SELECT count(*) FROM link WHERE x = w.doc_id AND same) AS n_same
FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""


TOP_PRODUCTS = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
f AS (SELECT lang, m, ws[i:i + m - 1] AS ph, count(*) AS a FROM w, range(1, 4) x(m), range(1, len(ws) - m + 2) y(i)
      GROUP BY ALL),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
cut AS (SELECT c.*, k, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
    FROM c, range(1, 3) z(k) JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]
    WHERE k < c.m),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
sub AS (SELECT lang, ph[s:s + 1] AS ph, a FROM c, range(1, 3) v(s) WHERE m = 3),
free AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = b.lang AND sub.ph = b.ph AND 100 * sub.a >= 50 * b.a)),
top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank,
    array_to_string(ph, ' ') AS phrase, a, l, r, score FROM free),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT top.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM top JOIN n ON n.lang = top.lang WHERE rank <= 2000"""


MIX_TARGETS = f"""WITH d AS (SELECT doc_id, source, len({WORDS.format(text="coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
r AS (SELECT *, 2 * n / w AS r, (SELECT 1.5 * sum(size) FROM d) AS t,
    coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY 2 * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
u AS (SELECT arg_min((t - full_) / free, (r, i)) AS u FROM r WHERE (t - full_) / free < r)
SELECT doc_id, size, n::BIGINT AS source_size, round(least(coalesce(u * w, 2 * n), 2 * n)::DOUBLE, 3) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, u"""

LICENSE_PHRASES = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'),
    (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
hit AS (SELECT doc_id, i - 1 AS place, label FROM w, range(1, len(ws) + 1) r(i), p WHERE ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase),
per AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN per ON w.doc_id = per.doc_id"""

URL_RULES = """WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')),
fit AS (SELECT page_id, host, path, h || p AS rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule FROM fit GROUP BY ALL)
SELECT u.page_id, u.host, u.path, best.rule FROM u LEFT JOIN best ON u.page_id = best.page_id"""

EDITED_TEXTS = """WITH t AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(lead(text) OVER (ORDER BY doc_id), CASE WHEN lead(doc_id) OVER
        (ORDER BY doc_id) IS NULL THEN first_value(text) OVER (ORDER BY doc_id) END, '') AS b FROM documents)
SELECT doc_id, length(a) AS n_chars, sha256(substr(a, 1, length(a) - length(a) // 2) || substr(b, 1, length(a) // 2)) AS edited_sha256 FROM t"""
