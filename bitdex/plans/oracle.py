"""DuckDB SQL for the registered queries (the correctness oracle).

Each builder returns one SELECT over the driver's views (``documents``,
``embeddings``, ``benchmark``, ``conversations``). Expressions are written
independently of the Spark plans: row-level rules as SQL string functions,
the per-row steps of the Spark plans as joins, unnests and windows. Nothing is
imported from the code under test; every constant stands here again.
"""

from __future__ import annotations

import unicodedata

WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PUNCT = r"[!-/:-@\[-`{-~]"
TOKEN = r"([!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0b\f\r]+)"
CAP = 1200
LONG = 8000
DIM = 384
K = 256
CONTEXT = 510
TOP = 5
URL = "https://simple.wikipedia.org/?curid={id}"
URL_RAW = "https://simple.wikipedia.org/?curid={id}&action=raw"
URL_JSON = ("https://simple.wikipedia.org/w/api.php?action=query&prop=extracts"
            "&explaintext=1&format=json&pageids={id}")


def n_words(k: int) -> int:
    return -(-k // 64)


def _base(ch: str) -> str:
    """First character of the full canonical decomposition."""
    parts = unicodedata.decomposition(ch)
    return ch if not parts or parts[0] == "<" else _base(chr(int(parts.split()[0], 16)))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def cap(x: str, n: int = CAP) -> str:
    upto = f"regexp_extract(substr({x}, 1, {n}), '(?s)^(.*[.!?]{WS})', 1)"
    return (f"(CASE WHEN length({x}) > {n} THEN (CASE WHEN {upto} <> '' "
            f"THEN {strip(upto)} ELSE substr({x}, 1, {n}) END) ELSE {x} END)")


def lead(x: str) -> str:
    return cap(norm(x))


def title_of(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def clean_title(x: str) -> str:
    return f"translate(coalesce({x}, ''), chr(9) || chr(10), '  ')"


def title_query(x: str) -> str:
    return f"coalesce(nullif({strip(x)}, ''), 'article')"


def units(x: str) -> str:
    paras = (f"list_filter(list_transform(string_split_regex({x}, '\\n{WS}*\\n'), "
             f"lambda p: {norm('p')}), lambda p: length(p) > 1)")
    sents = (f"list_filter(string_split(regexp_replace({norm(x)}, '([.!?]){WS}+', "
             f"'\\1' || chr(10), 'g'), chr(10)), lambda p: length(p) > 1)")
    return f"(CASE WHEN len({paras}) < 4 THEN {sents} ELSE {paras} END)"


def fold(x: str) -> str:
    pairs = [(chr(c), chr(c + 32)) for c in range(65, 91)]
    pairs += [(chr(c), _base(chr(c)).lower()) for c in range(0xC0, 0x180)
              if _base(chr(c)).isascii() and _base(chr(c)).isalpha()]
    pairs += [("\u0131", "i"), ("\u013f", "l"), ("\u0140", "l"), ("\u017f", "s"), ("\u00a0", " ")]
    pairs += [(chr(c), "-") for c in range(0x2010, 0x2016)]
    pairs += [(c, "'") for c in "\u2018\u2019\u02bb"] + [(c, '"') for c in "\u201c\u201d"]
    dropped = "".join(map(chr, range(0x300, 0x370)))
    return f"translate({x}, {lit(''.join(a for a, _ in pairs) + dropped)}, {lit(''.join(b for _, b in pairs))})"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {lit(TOKEN)}, 1)"


# -- reusable CTEs ---------------------------------------------------------

CORPUS = (f"corpus AS (SELECT doc_id AS id, {title_of('text')} AS title, text "
          f"FROM documents WHERE text IS NOT NULL AND text <> '')")

ROUTED = (f"routed AS (SELECT id, title, text, CASE WHEN length(text) > {LONG} "
          f"THEN {units('text')} END AS units FROM corpus), "
          f"ext AS (SELECT * FROM routed WHERE units IS NOT NULL AND len(units) >= 4)")


def token_vectors(src: str, key: str, name: str) -> str:
    """CTEs ``{name}`` (key..., i, s) and ``{name}_v`` (key..., v list):
    hash-pool token sums and their normalised vectors for ``src(key, line)``."""
    keys = key
    return f"""
{name}_t AS (SELECT {keys}, unnest({tokens('line')}) AS tok FROM {src}),
{name}_c AS (SELECT {keys}, tok, count(*) AS c FROM {name}_t GROUP BY ALL),
{name}_h AS (SELECT {keys}, c, g, md5(g::VARCHAR || ':' || tok) AS h
             FROM {name}_c, range(0, {DIM // 128}) r(g)),
{name}_b AS (SELECT {keys}, g * 128 + j AS i,
             c * (2 * ((('0x' || substr(h, (j // 32) * 8 + 1, 8))::BIGINT >> (31 - j % 32)) & 1) - 1) AS x
             FROM {name}_h, range(0, 128) r2(j)),
{name} AS (SELECT {keys}, i, sum(x) AS s FROM {name}_b GROUP BY ALL),
{name}_n AS (SELECT *, sum(s * s) OVER (PARTITION BY {keys}) AS ss FROM {name}),
{name}_v AS (SELECT {keys}, list(CASE WHEN ss > 0 THEN s / sqrt(ss) ELSE 0.0 END ORDER BY i) AS v
             FROM {name}_n GROUP BY ALL)"""


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), "
            f"lambda x, y: x + y)")


def bodies_ctes() -> str:
    """CTEs ending in ``bodies(id, title, body)`` (the full selection)."""
    return f"""{CORPUS}, {ROUTED},
lines AS (SELECT id, -1 AS pos, {title_query('title')} AS line FROM ext
          UNION ALL
          SELECT id, unnest(generate_series(0, len(units) - 1)) AS pos, unnest(units) AS line FROM ext),
{token_vectors('lines', 'id, pos', 'lv')},
scores AS (SELECT u.id, u.pos, {dot('u.v', 't.v')} AS score
           FROM lv_v u JOIN lv_v t ON u.id = t.id AND t.pos = -1 WHERE u.pos >= 0),
ranked AS (SELECT l.id, l.pos, l.line AS unit, coalesce(s.score, 0.0) AS score,
           row_number() OVER (PARTITION BY l.id ORDER BY coalesce(s.score, 0.0) DESC, l.pos) AS rnk
           FROM lines l LEFT JOIN scores s ON l.id = s.id AND l.pos = s.pos WHERE l.pos >= 0),
run AS (SELECT *, sum(length(unit) + 1) OVER (PARTITION BY id ORDER BY rnk
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ranked),
chosen AS (SELECT id, string_agg(unit, ' ' ORDER BY pos) AS joined FROM run
           WHERE rnk = 1 OR running <= {CAP} GROUP BY id),
sel AS (SELECT id, {cap('joined')} AS body FROM chosen
        UNION ALL
        SELECT id, {lead('text')} AS body FROM routed
        WHERE NOT (units IS NOT NULL AND len(units) >= 4)),
bodies AS (SELECT c.id, {clean_title('c.title')} AS title, s.body FROM sel s JOIN corpus c ON s.id = c.id
           WHERE s.body <> '')"""


def pack_words(src: str, key: str, k: int, name: str) -> str:
    """CTE ``{name}(key, w0..)`` from ``src(key, i, b)`` sign bits."""
    nw = n_words(k)
    ws = ", ".join(f"max(x) FILTER (WHERE w = {j}) AS w{j}" for j in range(nw))
    return f"""
{name}_u AS (SELECT {key}, i // 64 AS w,
             sum(CASE WHEN b THEN (1::HUGEINT << (63 - i % 64)) ELSE 0 END) AS u
             FROM {src} GROUP BY ALL),
{name}_x AS (SELECT {key}, w, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616
             ELSE u END)::BIGINT AS x FROM {name}_u),
{name} AS (SELECT {key}, {ws} FROM {name}_x GROUP BY ALL)"""


def hamming(a: str, b: str, k: int) -> str:
    return " + ".join(f"bit_count(xor({a}.w{j}, {b}.w{j}))::INTEGER" for j in range(n_words(k)))


def key_hex(a: str, k: int) -> str:
    return "lower(" + " || ".join(f"lpad(hex({a}.w{j}), 16, '0')" for j in range(n_words(k))) + ")"


def band(d: str, k: int) -> str:
    s = k / 256
    return (f"CASE WHEN {d} < {60 * s} THEN 'strong' WHEN {d} <= {76 * s} THEN 'relevant' "
            f"WHEN {d} <= {82 * s} THEN 'weak' ELSE 'none' END")


def doc_keys_ctes() -> str:
    """... ending in ``dkeys(id, w0..w3)`` and ``dmean(i, m)``."""
    return f"""{bodies_ctes()},
blines AS (SELECT id, body AS line FROM bodies),
{token_vectors('blines', 'id', 'bv')},
bvi AS (SELECT id, unnest(generate_series(0, {DIM - 1})) AS i, unnest(v) AS v FROM bv_v),
dmean AS (SELECT i, avg(v) AS m FROM bvi GROUP BY i),
dbits AS (SELECT d.id, d.i, (d.v - m.m) > 0 AS b FROM bvi d JOIN dmean m ON d.i = m.i WHERE d.i < {K}),
{pack_words('dbits', 'id', K, 'dkeys')}"""


def query_keys_ctes(src_sql: str) -> str:
    """``qsrc(qid, line)`` -> ``qkeys(qid, w0..w3)`` with the document mean."""
    return f"""qsrc AS ({src_sql}),
{token_vectors('qsrc', 'qid', 'qv')},
qvi AS (SELECT qid, unnest(generate_series(0, {DIM - 1})) AS i, unnest(v) AS v FROM qv_v),
qbits AS (SELECT q.qid, q.i, (q.v - m.m) > 0 AS b FROM qvi q JOIN dmean m ON q.i = m.i WHERE q.i < {K}),
{pack_words('qbits', 'qid', K, 'qkeys')}"""


BENCH_QUERIES = "SELECT item_id AS qid, text AS line FROM benchmark"
CONV_QUERIES = "SELECT conv_id * 100000 + turn AS qid, text AS line FROM conversations"
ONE_QUERIES = ("SELECT 0 AS qid, arg_min(text, doc_id) AS line FROM documents "
               "UNION ALL SELECT 1, arg_max(text, doc_id) FROM documents")


def url(id_expr: str, template: str) -> str:
    left, right = template.split("{id}")
    return f"{lit(left)} || CAST({id_expr} AS VARCHAR) || {lit(right)}"


def search_sql(src_sql: str) -> str:
    return f"""WITH {doc_keys_ctes()}, {query_keys_ctes(src_sql)},
dist AS (SELECT q.qid, d.id, {hamming('q', 'd', K)} AS dist FROM qkeys q, dkeys d),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM dist)
{hits("rk r JOIN bodies b ON r.id = b.id", "r.id")}"""


def hits(source: str, id_expr: str) -> str:
    return f"""SELECT r.qid, r.rank, r.dist, {id_expr} AS id, b.title,
       {url(id_expr, URL)} AS url, {url(id_expr, URL_RAW)} AS url_raw, {url(id_expr, URL_JSON)} AS url_json,
       r.dist > 82 AS low, {band('r.dist', K)} AS band, round(cos(pi() * r.dist / {K}), 6) AS est_cosine
FROM {source} WHERE r.rank <= {TOP}"""


EDGE_IDS = """eids AS (SELECT id, (CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END)
              * ('0x' || substr(md5(id::VARCHAR), 1, 15))::BIGINT AS eid FROM bodies)"""
EDGE_QID = "CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'q' || qid END"


def search_edge_sql() -> str:
    """Every query row for itself (ids may be shared); every index row twice."""
    return f"""WITH {doc_keys_ctes()}, {query_keys_ctes(BENCH_QUERIES)}, {EDGE_IDS},
dist AS (SELECT q.qid AS item, {EDGE_QID} AS qid, d.id, e.eid, {hamming('q', 'd', K)} AS dist
         FROM qkeys q, dkeys d JOIN eids e ON d.id = e.id, range(2) twice(t)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dist, eid) AS rank FROM dist)
{hits("rk r JOIN bodies b ON r.id = b.id", "r.eid")}"""


def stats_edge_sql() -> str:
    return f"""WITH {doc_keys_ctes()}, {query_keys_ctes(BENCH_QUERIES)},
dist AS (SELECT q.qid, {hamming('q', 'd', K)} AS d FROM qkeys q, dkeys d, range(2) twice(t)),
qids AS (SELECT qid FROM qkeys), each AS (WITH {histogram_tail(K)})
SELECT {EDGE_QID} AS qid, * EXCLUDE (qid) FROM each"""


def histogram_tail(k: int) -> str:
    """Turn ``dist(qid, d)`` and ``qids(qid)`` into the histogram select."""
    nb = (k // 8 + 1)
    s = k / 256
    return f"""hb AS (SELECT qid, least(d // 8, {nb - 1}) AS bin, count(*) AS c, min(d) AS md FROM dist GROUP BY ALL),
grid AS (SELECT qid, unnest(generate_series(0, {nb - 1})) AS bin FROM qids),
full_ AS (SELECT g.qid, g.bin, coalesce(h.c, 0) AS count, min(h.md) OVER (PARTITION BY g.qid) AS min_d,
          sum(coalesce(h.c, 0)) OVER (PARTITION BY g.qid) AS total
          FROM grid g LEFT JOIN hb h ON g.qid = h.qid AND g.bin = h.bin)
SELECT qid, bin, bin * 8 AS lo, CASE WHEN bin = {nb - 1} THEN {k} ELSE bin * 8 + 7 END AS hi,
       count, round(100.0 * count / total, 4) AS pct, min_d, total,
       NOT (count = 0 AND bin * 8 > min_d + {40 * s} AND bin < {24 * s}) AS visible
FROM full_"""


def stats_sql(src_sql: str) -> str:
    return f"""WITH {doc_keys_ctes()}, {query_keys_ctes(src_sql)},
dist AS (SELECT q.qid, {hamming('q', 'd', K)} AS d FROM qkeys q, dkeys d),
qids AS (SELECT qid FROM qkeys),
{histogram_tail(K)}"""


# -- embeddings (64-d fixture vectors, identity projection, k = 64) ----------
EK = 64


def emb_ctes() -> str:
    return f"""ev AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS i,
               unnest(embedding)::DOUBLE AS v FROM embeddings),
emean AS (SELECT i, avg(v) AS m FROM ev GROUP BY i),
ebits AS (SELECT e.vec_id, e.i, (e.v - m.m) > 0 AS b FROM ev e JOIN emean m ON e.i = m.i WHERE e.i < {EK}),
{pack_words('ebits', 'vec_id', EK, 'ekeys')},
cen AS (SELECT label AS qid, i, avg(v) AS v FROM ev GROUP BY label, i),
cbits AS (SELECT c.qid, c.i, (c.v - m.m) > 0 AS b FROM cen c JOIN emean m ON c.i = m.i WHERE c.i < {EK}),
{pack_words('cbits', 'qid', EK, 'ckeys')}"""


def label_knn_sql() -> str:
    return f"""WITH {emb_ctes()},
dist AS (SELECT q.qid, e.vec_id, {hamming('q', 'e', EK)} AS dist FROM ckeys q, ekeys e),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM dist)
SELECT qid, rank, vec_id, dist, dist > {82 * EK / 256} AS low,
       {band('dist', EK)} AS band, round(cos(pi() * dist / {EK}), 6) AS est_cosine
FROM rk WHERE rank <= {TOP}"""


def label_histogram_sql() -> str:
    return f"""WITH {emb_ctes()},
dist AS (SELECT q.qid, {hamming('q', 'e', EK)} AS d FROM ckeys q, ekeys e),
qids AS (SELECT qid FROM ckeys),
{histogram_tail(EK)}"""


def label_nearest_sql() -> str:
    return f"""WITH {emb_ctes()}
SELECT q.qid, min({hamming('q', 'e', EK)}) AS min_d, count(*) AS total FROM ckeys q, ekeys e GROUP BY q.qid"""


# -- PCA of the embeddings by repeated squaring ------------------------------
PK = 4
SQUARINGS = 12


def pca_ctes() -> str:
    """CTEs ``comp(c, i, x)``: the leading components, largest entry positive, and
    ``lam(c, x)``: their eigenvalues. Each is the dominant column of the covariance
    squared again and again; then it is taken out (deflation)."""
    out = [f"""{emb_ctes()},
c0 AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS x FROM ev a JOIN ev b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)"""]
    for c in range(PK):
        out.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, x FROM c{c})")
        for n in range(1, SQUARINGS + 1):
            out.append(f"""p{c}_{n} AS MATERIALIZED (SELECT i, j, x / max(abs(x)) OVER () AS x FROM
 (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM p{c}_{n - 1} a JOIN p{c}_{n - 1} b ON a.j = b.i GROUP BY a.i, b.j))""")
        out.append(f"""u{c} AS (SELECT i, x FROM p{c}_{SQUARINGS} WHERE j = (SELECT arg_max(j, x) FROM p{c}_{SQUARINGS} WHERE i = j)),
v{c} AS MATERIALIZED (SELECT i, x * (SELECT sign(arg_max(x, abs(x))) / sqrt(sum(x * x)) FROM u{c}) AS x FROM u{c}),
l{c} AS MATERIALIZED (SELECT sum(a.x * m.x * b.x) AS x FROM v{c} a JOIN c{c} m ON a.i = m.i JOIN v{c} b ON b.i = m.j),
c{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.x - l{c}.x * a.x * b.x AS x FROM c{c} m JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j, l{c})""")
    out.append("comp AS (" + " UNION ALL ".join(f"SELECT {c} AS c, i, x FROM v{c}" for c in range(PK)) + ")")
    out.append("lam AS (" + " UNION ALL ".join(f"SELECT {c} AS c, x FROM l{c}" for c in range(PK)) + ")")
    return ",\n".join(out)


def pca_keys_ctes() -> str:
    return f"""{pca_ctes()},
pbits AS (SELECT e.vec_id, p.c AS i, sum((e.v - m.m) * p.x) > 0 AS b
          FROM ev e JOIN emean m ON e.i = m.i JOIN comp p ON p.i = e.i GROUP BY ALL),
{pack_words('pbits', 'vec_id', PK, 'pkeys')},
qbits AS (SELECT e.qid, p.c AS i, sum((e.v - m.m) * p.x) > 0 AS b
          FROM cen e JOIN emean m ON e.i = m.i JOIN comp p ON p.i = e.i GROUP BY ALL),
{pack_words('qbits', 'qid', PK, 'qkeys')}"""


def pca_keys_sql() -> str:
    return f"WITH {pca_keys_ctes()} SELECT vec_id, w0 FROM pkeys"


def pca_variance_sql() -> str:
    return f"""WITH {pca_ctes()}, total AS (SELECT sum(x) AS t FROM c0 WHERE i = j)
SELECT c AS component, round(x / t, 6) AS explained_variance, round(sum(x / t) OVER (ORDER BY c), 6) AS cumulative
FROM lam, total"""


def pca_search_sql() -> str:
    return f"""WITH {pca_keys_ctes()},
dist AS (SELECT q.qid, e.vec_id, {hamming('q', 'e', PK)} AS dist FROM qkeys q, pkeys e),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM dist)
SELECT qid, rank, vec_id, dist FROM rk WHERE rank <= {TOP}"""


def pca_stats_sql() -> str:
    return f"""WITH {pca_keys_ctes()},
dist AS (SELECT q.qid, {hamming('q', 'e', PK)} AS d FROM qkeys q, pkeys e),
qids AS (SELECT qid FROM qkeys),
{histogram_tail(PK)}"""


def pca_checks_sql() -> str:
    """What a right fit of the documents' vectors says of each component."""
    return f"""WITH {bodies_ctes()}
SELECT unnest(generate_series(0, {K - 1}))::INTEGER AS component, count(*) >= 2 AS is_eigenvector,
       count(*) >= 2 AS is_unit, count(*) >= 2 AS is_orthogonal FROM bodies"""


def doc_means_sql() -> str:
    return f"""WITH {bodies_ctes()},
tk AS (SELECT id, unnest({tokens('body')}) AS t FROM bodies),
m AS (SELECT id, i AS dim, avg(CASE WHEN ('0x' || substr(md5(t), i + 1, 1))::INTEGER > 7 THEN 1.0 ELSE -1.0 END) AS a
      FROM tk, range(8) r(i) GROUP BY ALL),
n AS (SELECT *, sqrt(sum(a * a) OVER (PARTITION BY id)) AS s FROM m)
SELECT id, dim, round(CASE WHEN s > 0 THEN a / s ELSE 0.0 END, 6) AS x FROM n"""


def corpus_scan_sql() -> str:
    return "SELECT doc_id AS id, source AS title, text FROM documents"


def centered_keys_sql() -> str:
    return f"""WITH {emb_ctes()}
SELECT e.vec_id, e.w0, {key_hex('e', EK)} AS key_hex FROM ekeys e"""


def dim_mean_sql() -> str:
    return """SELECT i AS dim, round(avg(v), 10) AS mean FROM
 (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
 GROUP BY i"""


def covariance_sql() -> str:
    return """WITH ev AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i,
                     unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 10) AS cov
FROM ev a JOIN ev b ON a.vec_id = b.vec_id GROUP BY a.i, b.i"""


# -- text-only queries -------------------------------------------------------

def corpus_titles_sql() -> str:
    return f"""WITH {CORPUS}
SELECT id, title, {clean_title('title')} AS clean_title, {title_query('title')} AS title_query,
       length(text) AS n_chars FROM corpus"""


def normalized_text_sql() -> str:
    return f"WITH {CORPUS} SELECT id, {norm('text')} AS normalized FROM corpus"


def lead_bodies_sql() -> str:
    return f"WITH {CORPUS} SELECT id, {lead('text')} AS body FROM corpus"


def text_units_sql() -> str:
    return f"""WITH {CORPUS}, {ROUTED}
SELECT id, unnest(generate_series(0, len(units) - 1)) AS pos, unnest(units) AS unit
FROM routed WHERE units IS NOT NULL"""


def routes_sql() -> str:
    return f"""WITH {CORPUS}, {ROUTED}
SELECT id, length(text) > {LONG} AS is_long, len(units) AS n_units,
       coalesce(len(units) >= 4, false) AS extractive FROM routed"""


def worklist_sql() -> str:
    return f"""WITH {CORPUS}, {ROUTED}
SELECT id, -1 AS pos, {title_query('title')} AS line FROM ext
UNION ALL
SELECT id, unnest(generate_series(0, len(units) - 1)) AS pos, unnest(units) AS line FROM ext"""


def folded_text_sql() -> str:
    return f"WITH {CORPUS} SELECT id, {fold('text')} AS folded FROM corpus"


def basic_tokens_sql() -> str:
    return f"""WITH {CORPUS}, tk AS (SELECT id, {tokens('text')} AS t FROM corpus)
SELECT id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM tk"""


def token_profile_sql() -> str:
    p = PUNCT
    return f"""WITH {CORPUS}, tk AS (SELECT id, {tokens('text')} AS t FROM corpus)
SELECT id, len(t) AS n_tokens,
       len(list_filter(t, lambda x: regexp_full_match(x, {lit(p)}))) AS n_punct,
       len(t) > {CONTEXT} AS over_context FROM tk"""


def doc_token_sums_sql() -> str:
    return f"""WITH {bodies_ctes()},
blines AS (SELECT id, body AS line FROM bodies),
{token_vectors('blines', 'id', 'bv')}
SELECT id, i AS dim, s::BIGINT AS s FROM bv"""


def bodies_sql() -> str:
    return f"WITH {bodies_ctes()} SELECT id, title, body FROM bodies"


def records_sql() -> str:
    return f"WITH {bodies_ctes()} SELECT CAST(id AS VARCHAR) AS id, title, body AS text FROM bodies"


def unit_scores_sql() -> str:
    return f"""WITH {bodies_ctes()}
SELECT id, pos, round(score, 6) AS score, rnk AS rank, running, rnk = 1 OR running <= {CAP} AS chosen
FROM run"""


def extracted_bodies_sql() -> str:
    return f"WITH {bodies_ctes()} SELECT id, {cap('joined')} AS body FROM chosen"


def doc_keys_sql() -> str:
    return f"WITH {doc_keys_ctes()} SELECT d.id, {key_hex('d', K)} AS key_hex FROM dkeys d"


def index_count_sql() -> str:
    return f"WITH {bodies_ctes()} SELECT count(*) AS n_keys FROM bodies"


def corpus_profile_sql() -> str:
    return f"""WITH {CORPUS}, {ROUTED}
SELECT count(*) AS n_articles,
       count(*) FILTER (WHERE length(text) <= {CAP}) AS n_within_cap,
       round(avg(CASE WHEN length(text) <= {CAP} THEN 1.0 ELSE 0.0 END), 6) AS share_within_cap,
       count(*) FILTER (WHERE length(text) > {LONG}) AS n_long,
       count(*) FILTER (WHERE units IS NOT NULL AND len(units) >= 4) AS n_extractive
FROM routed"""


def fit_sample_sql() -> str:
    return f"WITH {bodies_ctes()} SELECT id FROM bodies"


DENSE = "dense AS (SELECT doc_id AS id, row_number() OVER () - 1 AS row FROM documents)"


def dense_rows_sql() -> str:
    return f"WITH {DENSE} SELECT row, id FROM dense"


def sampled_rows_sql() -> str:
    """The draws one after the other, in 128-bit arithmetic."""
    return f"""WITH RECURSIVE {DENSE}, n AS (SELECT count(*) AS n FROM documents),
draw(i, s) AS (SELECT 0, 11400714819323198485::UHUGEINT
    UNION ALL SELECT i + 1, (s * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT)
        % 18446744073709551616::UHUGEINT FROM draw, n WHERE i < n.n // 2)
SELECT dense.row, dense.id FROM draw, n JOIN dense ON dense.row = (s // 8589934592::UHUGEINT) % n.n::UHUGEINT WHERE i > 0"""


def fit_guard_sql() -> str:
    return """SELECT 'one row' AS input, 'need >= 2 rows to fit PCA; got 1' AS outcome
UNION ALL SELECT 'all rows', 'fitted on ' || count(*) FROM embeddings"""


def histogram_order_sql() -> str:
    return f"""SELECT row_number() OVER (ORDER BY qid, bin) - 1 AS place, qid, bin, count
FROM ({stats_sql(BENCH_QUERIES)})"""


def nearest_bodies_sql() -> str:
    return f"""WITH {doc_keys_ctes()}
SELECT a.id, min(b.id) AS nearest, 0 AS dist
FROM dkeys a JOIN dkeys b ON a.w0 = b.w0 AND a.w1 = b.w1 AND a.w2 = b.w2 AND a.w3 = b.w3 GROUP BY a.id"""


# -- word pieces (vocab from benchmark, segmentation of document words) -------

def _wordpiece_ctes(source: str = "SELECT id, text FROM corpus") -> str:
    pre = "'▁'"
    return f"""{CORPUS},
btok AS (SELECT unnest({tokens('text')}) AS t FROM benchmark),
bch AS (SELECT unnest(string_split(t, '')) AS c FROM btok),
pieces AS (SELECT {pre} || t AS token FROM btok UNION SELECT c FROM bch WHERE c <> ''
           UNION SELECT {pre} || c FROM bch WHERE c <> ''),
vocab AS (SELECT token, ('0x' || substr(md5(token), 1, 15))::BIGINT AS tid FROM pieces),
maxlen AS (SELECT max(length(token)) AS m FROM vocab),
dtok AS (SELECT id, unnest(generate_series(0, len(tk) - 1)) AS pos, unnest(tk) AS token
         FROM (SELECT id, {tokens('text')} AS tk FROM ({source}))),
words AS (SELECT DISTINCT token AS word, {pre} || token AS w1 FROM dtok),
cand AS (SELECT w.word, s.start, l.len, v.tid FROM words w, maxlen,
         range(0, length(w.w1)) s(start), range(1, maxlen.m + 1) l(len), vocab v
         WHERE s.start + l.len <= length(w.w1) AND v.token = substr(w.w1, s.start + 1, l.len)),
best AS (SELECT word, start, max(len) AS len, arg_max(tid, len) AS tid FROM cand GROUP BY ALL),
walk AS (SELECT * FROM (WITH RECURSIVE wk(word, pos, k, tid) AS (
            SELECT word, 0, 0, NULL::BIGINT FROM words
            UNION ALL
            SELECT wk.word, wk.pos + b.len, wk.k + 1, b.tid FROM wk JOIN best b
            ON b.word = wk.word AND b.start = wk.pos)
         SELECT * FROM wk)),
seg AS (SELECT w.word, coalesce(max(k.pos) = length(w.w1), false) AS known,
        list(k.tid ORDER BY k.k) FILTER (WHERE k.k > 0) AS ids
        FROM words w LEFT JOIN walk k ON k.word = w.word GROUP BY w.word, w.w1),
seg2 AS (SELECT word, known, CASE WHEN known THEN ids ELSE [0::BIGINT] END AS piece_ids FROM seg)"""


def wordpiece_words_sql() -> str:
    return f"""WITH {_wordpiece_ctes()}
SELECT word, known, len(piece_ids) AS n_pieces,
       array_to_string(list_transform(piece_ids, lambda x: x::VARCHAR), ' ') AS pieces FROM seg2"""


def token_pieces_sql() -> str:
    return f"""WITH {_wordpiece_ctes()}
SELECT d.id, d.pos, d.token, s.known, len(s.piece_ids) AS n_pieces FROM dtok d JOIN seg2 s ON d.token = s.word"""


def wordpiece_profile_sql() -> str:
    everything = (f"SELECT id, text FROM corpus UNION ALL SELECT -1 - qid AS id, line AS text FROM ({CONV_QUERIES})")
    return f"""WITH {_wordpiece_ctes(everything)},
per AS (SELECT d.id, sum(len(s.piece_ids)) AS n_pieces, count(*) FILTER (WHERE NOT s.known) AS n_unk, count(*) AS n
        FROM dtok d JOIN seg2 s ON d.token = s.word GROUP BY d.id)
SELECT a.id, coalesce(n_pieces, 0) + 2 AS n_ids, coalesce(n_unk, 0) AS n_unk, round(n_unk / n, 6) AS unk_share,
       coalesce(n_pieces, 0) + 2 > 512 AS over_context
FROM ({everything}) a LEFT JOIN per ON a.id = per.id"""


FLUSH = r"([^!-/:-@\[-`{-~ \t\n\x0b\f\r]*[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0b\f\r]+)"


def token_ids_limited_sql() -> str:
    return f"""WITH {_wordpiece_ctes()},
turns AS (SELECT id, unnest(generate_series(1, len(f))) AS e, unnest(f) AS turn
          FROM (SELECT id, regexp_extract_all({fold('text')}, {lit(FLUSH)}, 1) AS f FROM corpus)),
toks AS (SELECT id, e, unnest(generate_series(1, len(tk))) AS t, unnest(tk) AS token
         FROM (SELECT id, e, regexp_extract_all(turn, {lit(TOKEN)}, 1) AS tk FROM turns)),
pcs AS (SELECT k.id, k.e, k.t, s.piece_ids AS p FROM toks k JOIN seg2 s ON k.token = s.word),
size AS (SELECT id, e, sum(len(p)) AS n FROM pcs GROUP BY id, e),
before AS (SELECT id, e, coalesce(sum(n) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
           FROM size),
kept AS (SELECT p.id, flatten(list(p.p ORDER BY p.e, p.t)) AS ids FROM pcs p JOIN before b ON p.id = b.id AND p.e = b.e
         WHERE 1 + b.b < 511 GROUP BY p.id),
tot AS (SELECT id, sum(n) AS n FROM size GROUP BY id),
f AS (SELECT c.id, list_concat(list_concat([1::BIGINT], coalesce(k.ids, [])), [2::BIGINT])[1:512] AS ids, coalesce(t.n, 0) AS n
      FROM corpus c LEFT JOIN kept k ON c.id = k.id LEFT JOIN tot t ON c.id = t.id)
SELECT id, len(ids) AS n_ids, n <= 510 AS whole, array_to_string(list_transform(ids, lambda x: x::VARCHAR), ' ') AS ids FROM f"""


def query_texts_sql() -> str:
    words = f"list_filter(string_split({norm('line')}, ' '), lambda w: w <> '')"
    return f"""SELECT qid, array_to_string({words}, ' ') AS query, len({words}) AS n_words
FROM ({CONV_QUERIES})"""
