"""DuckDB SQL that gives the registered queries' rows by another way, from shared CTEs."""

from __future__ import annotations

from quarry.functions.text import ABSTENTIONS, STOP_WORDS
from quarry.operators.evaluation import GRID_B, GRID_K1

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKEN = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)?"


def _fold(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_TOKEN}'), lambda t: replace(lower(t), 'ß', 'ss'))"


def _terms(source: str, keys: str, text: str, least: int = 2) -> str:
    """Rows (keys, term, position) of the terms that count."""
    return f"(SELECT * FROM (SELECT {keys}, unnest(ts) AS term, unnest(range(len(ts))) AS position FROM (SELECT {keys}, {_fold(text)} AS ts FROM {source})) WHERE length(term) >= {least} AND term NOT IN ({_STOPS}))"


CHUNKS = r"""
words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + CAST(greatest(ceil((len(ws) - 500) / 425.0), 0) AS BIGINT) END)) AS position FROM words),
raw AS (SELECT doc_id, position, list_slice(ws, position * 425 + 1, position * 425 + 500) AS own, coalesce(length(array_to_string(list_slice(ws, 1, position * 425), '')), 0) AS before FROM starts),
chunks AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) || '-' || lpad(CAST(position AS VARCHAR), 5, '0') AS chunk_id, CAST(position AS INTEGER) AS position,
         regexp_replace(array_to_string(own, ''), '^\s+', '') AS text, CAST(len(own) AS INTEGER) AS token_count,
         before + length(array_to_string(own, '')) - length(regexp_replace(array_to_string(own, ''), '^\s+', '')) AS char_start FROM raw)"""

INDEX = (
    CHUNKS
    + f""",
tok AS MATERIALIZED {_terms("chunks", "chunk_id, document_id", "text")},
post AS MATERIALIZED (SELECT term, chunk_id, document_id, CAST(count(*) AS INTEGER) AS tf, min(position) AS p0, max(position) AS p1 FROM tok GROUP BY ALL),
lens AS MATERIALIZED (SELECT c.chunk_id, c.document_id, CAST(count(t.term) AS INTEGER) AS length FROM chunks c LEFT JOIN tok t USING (chunk_id) GROUP BY ALL),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS MATERIALIZED (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
norms AS MATERIALIZED (SELECT chunk_id, sqrt(list_sum(list(power((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 2) ORDER BY term))) AS norm FROM post JOIN dfs USING (term), st GROUP BY chunk_id),
champ AS MATERIALIZED (SELECT * FROM (SELECT term, chunk_id, tf, CAST(row_number() OVER (PARTITION BY term ORDER BY tf DESC, chunk_id) AS INTEGER) AS rank FROM post) WHERE rank <= 50),
q AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf, any_value(df) AS df FROM {_terms("benchmark", "item_id AS query_id", "text")} JOIN dfs USING (term) GROUP BY query_id, term)"""
).replace("SELECT item_id AS query_id, unnest", "SELECT query_id, unnest")


def _top(scored: str, k: int, out: str = "top", keys: str = "query_id", extra: str = "") -> str:
    """CTE of the k best rows by score, ties to the smaller chunk_id."""
    return f"{out} AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM {scored}) WHERE rank <= {k}{extra})"


def _tfidf(weights: str, name: str, only: str = "") -> str:
    """CTE: cosine of weighted queries (query_id, term, w)."""
    return f"""{name}_n AS MATERIALIZED (SELECT query_id, sqrt(list_sum(list(w * w ORDER BY term))) AS qnorm FROM {weights} WHERE w <> 0 GROUP BY query_id),
{name}_c AS MATERIALIZED (SELECT query_id, chunk_id, p.document_id, term, w * ((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)) / (qnorm * norm) AS c
  FROM post p JOIN {weights} USING (term) JOIN dfs USING (term) JOIN {name}_n USING (query_id) JOIN norms USING (chunk_id) CROSS JOIN st WHERE w <> 0{only}),
{name} AS MATERIALIZED (SELECT query_id, chunk_id, document_id, list_sum(list(c ORDER BY term)) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM {name}_c GROUP BY ALL)"""


def _bm25(weights: str, name: str, only: str = "", k1: str = "1.5", b: str = "0.75") -> str:
    return f"""{name}_c AS MATERIALIZED (SELECT query_id, chunk_id, p.document_id, term, CAST(w AS DOUBLE) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / avgdl)) AS c
  FROM post p JOIN {weights} USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id) CROSS JOIN st WHERE w <> 0{only}),
{name} AS MATERIALIZED (SELECT query_id, chunk_id, document_id, list_sum(list(c ORDER BY term)) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM {name}_c GROUP BY ALL)"""


QTF = "qw AS MATERIALIZED (SELECT query_id, term, CAST(qtf AS DOUBLE) AS w FROM q)"
QTI = "qi AS MATERIALIZED (SELECT query_id, term, (1 + ln(qtf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM q, st)"


def _candidates(k: int) -> str:
    return f"""short AS MATERIALIZED (SELECT DISTINCT query_id, chunk_id FROM champ JOIN q USING (term)),
enough AS (SELECT query_id FROM short GROUP BY query_id HAVING count(*) >= {k}),
cand AS MATERIALIZED (SELECT * FROM short WHERE query_id IN (FROM enough) UNION SELECT DISTINCT query_id, chunk_id FROM post JOIN q USING (term) WHERE query_id NOT IN (FROM enough))"""


IN_CAND = " AND (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM cand)"
SHOWN = "SELECT query_id, rank, chunk_id, round(score, 6) AS score, matched FROM top"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _feedback(first: str, second: str) -> str:
    """CTEs of both passes; `second` scores the widened query."""
    return ",\n".join([
        QTI, QTF, _tfidf("qi", "one") if first == "tfidf" else _bm25("qw", "one"), _top("one", 5, "fb"),
        "nfb AS (SELECT query_id, count(*) AS n_fb FROM fb GROUP BY query_id)",
        "cent AS MATERIALIZED (SELECT query_id, term, list_sum(list((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) ORDER BY chunk_id)) / any_value(n_fb) AS mean FROM post JOIN fb USING (chunk_id) JOIN dfs USING (term) JOIN nfb USING (query_id) CROSS JOIN st GROUP BY query_id, term)",
        "wide AS MATERIALIZED (SELECT query_id, term, 1.0 * coalesce(w, 0) + 0.75 * coalesce(mean, 0) AS w, qi.w IS NULL AS added FROM qi FULL JOIN cent USING (query_id, term) WHERE query_id IN (SELECT query_id FROM fb))",
        "fresh AS MATERIALIZED (SELECT query_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, term) AS k FROM wide WHERE added AND w > 0) WHERE k <= 10)",
        "q2 AS MATERIALIZED (SELECT query_id, term, w FROM wide WHERE NOT added UNION ALL FROM fresh)",
        *([_tfidf("q2", "two"), _top("two", 10)] if second == "tfidf" else [_bm25("q2", "two"), _top("two", 10)] if second == "bm25" else []),
    ])


def _hash(text: str) -> str:
    """The 8-bin hash embedding of a text, unit length or zeros."""
    bins = f"list_transform({_fold(text)}, lambda t: list_sum(list_transform(string_split(t, ''), lambda c: ord(c))) % 8)"
    counts = f"list_transform(range(8), lambda k: CAST(len(list_filter({bins}, lambda b: b = k)) AS DOUBLE))"
    return counts


HYBRID = ",\n".join([
    QTF, _candidates(20), _bm25("qw", "arm", IN_CAND), _top("arm", 20, "lex"),
    f"cv0 AS MATERIALIZED (SELECT chunk_id, {_hash('text')} AS h FROM chunks), cv AS MATERIALIZED (SELECT chunk_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS s FROM cv0)",
    f"qv0 AS MATERIALIZED (SELECT item_id AS query_id, {_hash('text')} AS h FROM benchmark), qv AS MATERIALIZED (SELECT query_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS s FROM qv0)",
    "dist AS MATERIALIZED (SELECT query_id, chunk_id, CASE WHEN cv.s * qv.s > 0 THEN 1 - list_sum(list_transform(range(1, 9), lambda i: cv.h[i] / cv.s * (qv.h[i] / qv.s))) ELSE 1.0 END AS distance FROM cv, qv)",
    "den AS MATERIALIZED (SELECT *, greatest(0, least(1, 1 - distance)) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS INTEGER) AS rank FROM dist) WHERE rank <= 20)",
    "rrf AS MATERIALIZED (SELECT query_id, chunk_id, d.rank AS dense_rank, l.rank AS bm25_rank, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS score, d.score AS dense_score, l.score AS bm25_score FROM den d FULL JOIN lex l USING (query_id, chunk_id))",
    _top("rrf", 20, "fused"),
])

EVIDENCE = ",\n".join([
    HYBRID,
    r"pool AS MATERIALIZED (SELECT f.*, concat_ws(chr(10), source, nullif(trim(regexp_replace(regexp_replace(c.text, '\[n?(\d+)\]', '', 'g'), '[ \t]{2,}', ' ', 'g')), '')) AS searchable FROM fused f JOIN chunks c USING (chunk_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.document_id)",
    "eq AS MATERIALIZED (SELECT DISTINCT query_id, term FROM " + _terms("benchmark", "item_id AS query_id", "text", 1).replace("SELECT item_id AS query_id, unnest", "SELECT query_id, unnest") + ")",
    "ew AS MATERIALIZED (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM eq LEFT JOIN dfs USING (term) CROSS JOIN st)",
    "et AS MATERIALIZED (SELECT query_id, count(*) AS nt, list_sum(list(idf ORDER BY term)) AS idf_sum FROM ew GROUP BY query_id)",
    "has AS MATERIALIZED (SELECT DISTINCT query_id, chunk_id, term FROM " + _terms("pool", "query_id, chunk_id", "searchable", 1) + ")",
    "met AS MATERIALIZED (SELECT query_id, chunk_id, count(*) AS nm, list_sum(list(idf ORDER BY term)) AS idf_met FROM has JOIN ew USING (query_id, term) GROUP BY query_id, chunk_id)",
    "ev0 AS MATERIALIZED (SELECT p.*, CASE WHEN idf_sum > 0 THEN coalesce(nm, 0) / nt END AS coverage, CASE WHEN idf_sum > 0 THEN coalesce(idf_met, 0) / idf_sum END AS idf_coverage, coalesce(nt, 0) > 0 AND coalesce(nm, 0) = nt AS all_terms, bm25_score / nullif(max(bm25_score) OVER (PARTITION BY p.query_id), 0) AS relative_bm25 FROM pool p LEFT JOIN et USING (query_id) LEFT JOIN met USING (query_id, chunk_id))",
    "ev AS MATERIALIZED (SELECT *, coalesce(bm25_score IS NOT NULL AND coverage >= 0.6 AND idf_coverage >= 0.4, false) AS strong FROM ev0)",
    "pin AS MATERIALIZED (SELECT * FROM ev WHERE strong QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(idf_coverage, 9) DESC NULLS LAST, round(relative_bm25, 9) DESC NULLS LAST, round(score, 9) DESC NULLS LAST, chunk_id) = 1)",
    "weak AS (SELECT query_id, max(rank) AS last FROM ev WHERE rank <= 4 GROUP BY query_id HAVING NOT bool_or(strong))",
    "sel AS MATERIALIZED (SELECT query_id, rank, chunk_id, strong, dense_score, all_terms FROM ev WHERE rank <= 4 AND (query_id, rank) NOT IN (SELECT (query_id, last) FROM weak JOIN pin USING (query_id)) UNION ALL SELECT query_id, last, chunk_id, strong, dense_score, all_terms FROM weak JOIN pin USING (query_id))",
])

# Octets at and beside the ends of address ranges that are not public, the ranges, and starts of URLs.
FIRST = ("0", "8", "10", "100", "127", "169", "172", "192", "198", "203", "223", "224", "239", "240", "255")
SECOND = ("0", "15", "16", "17", "18", "19", "20", "31", "32", "51", "64", "168", "254")
THIRD = ("0", "2", "100", "113", "255")
STARTS = ("ftp://host", "file://", "http://", "https://user@", "HTTP://host", "https://[::1]", "http://[2606:4700::1111]", "http://[fe80::1]", "javascript:host", "https://user:word@host:8443")
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.11/32",
    "192.0.0.12/30", "192.0.0.16/28", "192.0.0.32/27", "192.0.0.64/26", "192.0.0.128/25", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def _quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_OCTETS = "list_transform(string_split(a, '.'), lambda x: CAST(x AS BIGINT))"
_NUMBER = "list_sum(list_transform(range(1, 5), lambda i: {0}[i] * CAST(power(256, 4 - i) AS BIGINT)))"
ADDRESSES = f"""addresses AS (SELECT page_id, concat_ws('.', {_quoted(FIRST)}[1 + page_id % {len(FIRST)}], {_quoted(SECOND)}[1 + (page_id // 3) % {len(SECOND)}], {_quoted(THIRD)}[1 + (page_id // 5) % {len(THIRD)}], page_id % 256) AS a FROM pages),
numbers AS MATERIALIZED (SELECT page_id, {_NUMBER.format("o")} AS n FROM (SELECT page_id, {_OCTETS} AS o FROM addresses)),
ranges AS MATERIALIZED (SELECT {_NUMBER.format("o")} AS low, CAST(power(2, 32 - size) AS BIGINT) AS width FROM (SELECT {_OCTETS} AS o, size FROM (SELECT string_split(r, '/')[1] AS a, CAST(string_split(r, '/')[2] AS INTEGER) AS size FROM (SELECT unnest({_quoted(NOT_PUBLIC)}) AS r))))"""
PUBLIC_URLS = (
    _with(ADDRESSES)
    + f"""SELECT page_id, 'address' AS kind, CASE WHEN EXISTS (SELECT 1 FROM ranges WHERE n >= low AND n < low + width) THEN 'the host is not public' END AS problem FROM numbers
UNION ALL SELECT page_id, 'page', CASE WHEN url IS NULL OR NOT regexp_matches(url, '^(?i)https?:') THEN 'only http and https are allowed' WHEN NOT regexp_matches(url, '^[^:]*://[^/?#]') THEN 'the URL names no host' END FROM pages
UNION ALL SELECT page_id, 'start', CASE WHEN s LIKE 'ftp%' OR s LIKE 'file%' OR s LIKE 'javascript%' THEN 'only http and https are allowed' WHEN s LIKE '%//' OR s LIKE '%@' THEN 'the URL names no host' WHEN s LIKE '%[::1]' OR s LIKE '%[fe80%' THEN 'the host is not public' END
FROM (SELECT page_id, {_quoted(STARTS)}[1 + page_id % {len(STARTS)}] AS s FROM pages)"""
)
_LETTER = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"  # what words are of, where matches are marked
HIGHLIGHTED = rf"SELECT query_id, chunk_id, CAST(len(regexp_extract_all(text, '(?i)(?:^|[^{_LETTER}])(?:' || replace(matched, ' ', '|') || ')[{_LETTER}]*')) AS INTEGER) AS n_marks FROM top JOIN chunks USING (chunk_id)"
CONTEXTS = r"""SELECT query_id, sha256(string_agg('[' || i || '] ' || source || chr(10) || body, chr(10) || chr(10) ORDER BY i)) AS context_sha256, string_agg(chunk_id, ',' ORDER BY i) AS chunk_ids
FROM (SELECT query_id, s.chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY s.rank) AS i, trim(regexp_replace(regexp_replace(c.text, '\[n?(\d+)\]', '', 'g'), '[ \t]{2,}', ' ', 'g')) AS body
  FROM sel s JOIN chunks c USING (chunk_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.document_id) GROUP BY query_id"""

HITS = ",\n".join([QTF, _bm25("qw", "s"), _top("s", 10)])
CELLS = "cells AS MATERIALIZED (SELECT query_id, t.chunk_id, t.document_id, term, c FROM top t JOIN s_c USING (query_id, chunk_id))"
DOCS = "ds AS MATERIALIZED (SELECT t.query_id, t.document_id, greatest(max(t.score), 0) AS score, list_distinct(flatten(list(string_split(matched, ' ')))) AS terms FROM top t GROUP BY ALL)"
JUDGED = ",\n".join([
    QTF, _bm25("qw", "s"), _top("s", 4),
    "rel AS MATERIALIZED (SELECT DISTINCT b.item_id AS query_id, CAST(d.doc_id AS VARCHAR) AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))",
    "nrel AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id)",
    "hit AS (SELECT query_id, min(rank) AS rank FROM top JOIN rel USING (query_id, document_id) GROUP BY query_id, document_id)",
    "m AS MATERIALIZED (SELECT b.item_id AS query_id, count(h.rank) / 4 AS precision, coalesce(1.0 / min(h.rank), 0) AS reciprocal_rank, CASE WHEN any_value(nrel.n) > 0 THEN coalesce(list_sum(list(1 / log2(h.rank + 1) ORDER BY h.rank)), 0) / list_sum(list_transform(range(1, CAST(least(any_value(nrel.n), 4) AS BIGINT) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END AS ndcg FROM benchmark b LEFT JOIN nrel ON nrel.query_id = b.item_id LEFT JOIN hit h ON h.query_id = b.item_id GROUP BY b.item_id)",
])
M6 = "round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg"
_GRID = ", ".join(f"({k1}, {b})" for k1 in GRID_K1 for b in GRID_B)

ORACLES = {
    "tokenize_terms": _with(f"t AS {_terms('documents', 'doc_id', 'text')}") + "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_documents, CAST(min(position) AS INTEGER) AS first_position FROM t GROUP BY term",
    "chunk_windows": _with(CHUNKS) + "SELECT chunk_id, position, token_count, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(text) AS INTEGER) AS char_end, sha256(text) AS text_sha256 FROM chunks",
    "chunk_rules": _with(CHUNKS) + ", r AS (SELECT document_id, position, (char_start + token_count) % 8 AS r FROM chunks) SELECT 'x' || document_id AS document_id, CAST(CASE WHEN r = 0 THEN -1 - position ELSE position END AS INTEGER) AS position FROM r UNION SELECT 'd' || document_id, position FROM r WHERE r = 0 AND position = 0",
    "term_frequency": _with(INDEX) + "SELECT term, chunk_id, tf, CAST(p0 AS INTEGER) AS first_position, CAST(p1 AS INTEGER) AS last_position FROM post",
    "chunk_lengths": _with(INDEX) + "SELECT chunk_id, length FROM lens",
    "document_frequency": _with(INDEX) + "SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS tfidf_idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS bm25_idf FROM dfs, st",
    "collection_stats": _with(INDEX) + "SELECT n AS n_chunks, round(avgdl, 6) AS avg_length, (SELECT count(DISTINCT document_id) FROM lens) AS n_documents, (SELECT count(*) FROM dfs) AS n_terms, (SELECT CAST(sum(df) AS BIGINT) FROM dfs) AS n_postings FROM st",
    "tfidf_norms": _with(INDEX) + "SELECT chunk_id, round(norm, 6) AS norm FROM norms",
    "champion_lists": _with(INDEX) + "SELECT term, rank, chunk_id, tf FROM champ",
    "tfidf_topk": _with(INDEX, QTI, _tfidf("qi", "s"), _top("s", 10)) + SHOWN,
    "bm25_topk": _with(INDEX, QTF, _bm25("qw", "s"), _top("s", 10)) + SHOWN,
    "champion_tfidf_topk": _with(INDEX, QTI, _candidates(10), _tfidf("qi", "s", IN_CAND), _top("s", 10)) + SHOWN,
    "champion_bm25_topk": _with(INDEX, QTF, _candidates(10), _bm25("qw", "s", IN_CAND), _top("s", 10)) + SHOWN,
    "champion_diagnostics": _with(INDEX, _candidates(10))
    + """, tot AS (SELECT query_id, sum(df) AS av, sum(least(df, 50)) AS cp FROM q GROUP BY query_id),
al AS (SELECT query_id, count(DISTINCT chunk_id) AS n_all FROM post JOIN q USING (term) GROUP BY query_id), sh AS (SELECT query_id, count(*) AS n_short FROM short GROUP BY query_id),
r AS (SELECT item_id AS query_id, coalesce(av, 0) AS av, coalesce(cp, 0) AS cp, coalesce(n_all, 0) AS n_all, coalesce(n_short, 0) AS n_short, coalesce(n_short, 0) < 10 AS fell FROM benchmark LEFT JOIN tot ON tot.query_id = item_id LEFT JOIN al ON al.query_id = item_id LEFT JOIN sh ON sh.query_id = item_id)
SELECT query_id, 'champion' AS retrieval_mode, 50 AS champion_size, CAST(av AS BIGINT) AS postings_available, CAST(CASE WHEN fell THEN av ELSE least(av, cp) END AS BIGINT) AS postings_visited,
  CASE WHEN fell THEN n_all ELSE n_short END AS candidate_count, round(CASE WHEN av > 0 THEN 100.0 * (av - CASE WHEN fell THEN av ELSE least(av, cp) END) / av ELSE 0 END, 6) AS reduction_percentage, fell AS fallback_occurred FROM r""",
    "champion_overlap": _with(INDEX, QTF, _candidates(10), _bm25("qw", "s", IN_CAND), _top("s", 10), _bm25("qw", "e"), _top("e", 10, "best"))
    + "SELECT item_id AS query_id, round(coalesce((SELECT count(*) FROM top JOIN best USING (query_id, chunk_id) WHERE query_id = item_id) / nullif((SELECT least(count(*), 10) FROM best WHERE query_id = item_id), 0), 1.0), 6) AS exact_top_k_overlap FROM benchmark",
    "prf_expansion": _with(INDEX, _feedback("tfidf", "")) + "SELECT query_id, term, round(w, 6) AS weight FROM fresh",
    "prf_tfidf_topk": _with(INDEX, _feedback("tfidf", "tfidf")) + SHOWN,
    "prf_bm25_topk": _with(INDEX, _feedback("bm25", "bm25")) + SHOWN,
    "vector_knn": """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS MATERIALIZED (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM v),
d AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_inner_product(a.v, b.v) / (a.s * b.s) AS distance FROM n a, n b)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, abs(round(distance, 6)) AS distance, abs(round(greatest(0, least(1, 1 - distance)), 6)) AS score FROM d WINDOW w AS (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) QUALIFY row_number() OVER w <= 10""",
    "vector_normalised": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM v) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / s)), 6) AS component_sum, 1.0::DOUBLE AS distance_to_zero FROM n",
    "hybrid_topk": _with(INDEX, HYBRID) + "SELECT query_id, rank, chunk_id, round(score, 6) AS fusion_score, dense_rank, bm25_rank, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END) AS sources FROM fused",
    "lexical_coverage": _with(INDEX, EVIDENCE) + "SELECT query_id, chunk_id, round(coverage, 6) AS coverage, round(idf_coverage, 6) AS idf_coverage, all_terms, round(relative_bm25, 6) AS relative_bm25, strong FROM ev",
    "pinned_context": _with(INDEX, EVIDENCE) + "SELECT query_id, rank, chunk_id, strong FROM sel",
    "relevance_gate": _with(INDEX, EVIDENCE) + "SELECT item_id AS query_id, coalesce(bool_or(coalesce(dense_score >= 0.3, false) OR strong OR all_terms), false) AS passes, CASE WHEN count(s.chunk_id) = 0 THEN 'no_context' WHEN NOT bool_or(coalesce(dense_score >= 0.3, false) OR strong OR all_terms) THEN 'low_relevance' END AS reason FROM benchmark LEFT JOIN sel s ON s.query_id = item_id GROUP BY item_id",
    "reranked_topk": _with(INDEX, QTF, _bm25("qw", "s"), _top("s", 25), f"a AS MATERIALIZED (SELECT item_id AS query_id, list_distinct({_fold('text')}) AS asked FROM benchmark)", f"tk AS MATERIALIZED (SELECT chunk_id, {_fold('text')} AS ts FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM top))", "r AS (SELECT query_id, chunk_id, len(list_filter(asked, lambda t: list_contains(ts, t))) / greatest(len(asked), 1) AS score FROM top JOIN a USING (query_id) JOIN tk USING (chunk_id))", _top("r", 10, "best"))
    + "SELECT query_id, rank, chunk_id, round(score, 6) AS rerank_score FROM best",
    "retrieval_metrics": _with(INDEX, JUDGED) + f"SELECT query_id, {M6} FROM m",
    "macro_metrics": _with(INDEX, JUDGED) + "SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1",
    "rank_positions": _with(INDEX, JUDGED) + ", b AS (SELECT query_id, document_id, min(rank) AS rank FROM top GROUP BY ALL), r AS (SELECT rank FROM rel LEFT JOIN b USING (query_id, document_id)) SELECT count_if(rank = 1) AS rank_1, count_if(rank = 2) AS rank_2, count_if(rank = 3) AS rank_3, count_if(rank = 4) AS rank_4, count_if(rank IS NULL) AS missed FROM r",
    "heat_map": _with(INDEX, HITS, CELLS)
    + """, v AS MATERIALIZED (SELECT query_id, document_id, term, list_sum(list(c ORDER BY chunk_id)) AS value FROM cells GROUP BY ALL),
w AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list(abs(value) ORDER BY document_id)), 9) DESC, term) AS k FROM v GROUP BY query_id, term),
x AS (SELECT v.*, coalesce(value / nullif(max(value) OVER (PARTITION BY v.query_id), 0), 0) AS share FROM v JOIN w ON w.query_id = v.query_id AND w.term = v.term AND k <= 8)
SELECT query_id, document_id, term, round(value, 6) AS value, round(share, 6) AS share, CASE WHEN share <= 0 THEN 0 WHEN share < 0.25 THEN 1 WHEN share < 0.5 THEN 2 WHEN share < 0.75 THEN 3 ELSE 4 END AS bucket FROM x""",
    "document_scores": _with(INDEX, HITS, DOCS) + "SELECT query_id, document_id, round(score, 6) AS score, CAST(len(terms) AS INTEGER) AS n_terms FROM ds",
    "relation_graph_lexical": _with(INDEX, HITS, DOCS) + "SELECT a.query_id, a.document_id AS a, b.document_id AS b, CAST(len(list_intersect(a.terms, b.terms)) AS DOUBLE) AS weight FROM ds a JOIN ds b ON a.query_id = b.query_id AND a.document_id < b.document_id WHERE len(list_intersect(a.terms, b.terms)) > 0",
    "relation_graph_semantic": _with(INDEX, HITS, DOCS) + "SELECT a.query_id, a.document_id AS a, b.document_id AS b, round(1 / (1 + abs(a.score - b.score)), 6) AS weight FROM ds a JOIN ds b ON a.query_id = b.query_id AND a.document_id < b.document_id",
    "relation_graph_nodes": _with(INDEX, HITS, DOCS)
    + """, n AS (SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM ds)
SELECT query_id, document_id, place, round(240 + CASE WHEN n <= 2 THEN 80 ELSE 96 END * cos(-pi() / 2 + 2 * pi() * place / n), 4) + 0.0 AS x, round(140 + CASE WHEN n <= 2 THEN 80 ELSE 96 END * sin(-pi() / 2 + 2 * pi() * place / n), 4) + 0.0 AS y FROM n WHERE n >= 2""",
    "contribution_chart": _with(INDEX, HITS, CELLS) + "SELECT query_id, chunk_id, term, CAST(row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(c, 9) DESC, term) AS INTEGER) AS place, round(c, 6) AS contribution, round(greatest(4.0, 100 * abs(c) / max(abs(c)) OVER (PARTITION BY query_id, chunk_id)), 4) AS width FROM cells",
    "graded_terms": _with(INDEX, HITS, CELLS) + ", g AS (SELECT query_id, chunk_id, term, coalesce(abs(c) / nullif(max(abs(c)) OVER (PARTITION BY query_id, chunk_id), 0), 0) AS i FROM cells) SELECT query_id, chunk_id, term, round(i, 6) AS intensity, CASE WHEN i <= 0 THEN 0 WHEN i < 0.25 THEN 1 WHEN i < 0.5 THEN 2 WHEN i < 0.75 THEN 3 ELSE 4 END AS bucket FROM g",
    "bm25_sweep": _with(INDEX, QTF, f"grid AS (SELECT * FROM (VALUES {_GRID}) AS g(k1, b))")
    + """, c AS (SELECT k1, b, query_id, chunk_id, term, w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (CAST(k1 AS DOUBLE) + 1) / (tf + CAST(k1 AS DOUBLE) * (1 - CAST(b AS DOUBLE) + CAST(b AS DOUBLE) * length / avgdl)) AS c FROM post JOIN qw USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id) CROSS JOIN st CROSS JOIN grid),
s AS (SELECT k1, b, query_id, chunk_id, list_sum(list(c ORDER BY term)) AS score FROM c GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 4)
SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, count(*) AS n, round(sum(round(score, 6)), 4) AS score_sum, string_agg(CASE WHEN rank = 1 THEN chunk_id END, ',' ORDER BY query_id) AS first_ids FROM t GROUP BY k1, b""",
    "listing_page": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 40",
    "dedup_sha256": "SELECT doc_id, sha256(text) AS sha256, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents",
    "upsert_vectors": "SELECT vec_id AS chunk_id, label AS document_id, 'kept' AS state FROM embeddings WHERE label >= 5 OR vec_id % 2 = 0 OR label NOT IN (SELECT label FROM embeddings WHERE label < 5 AND vec_id % 2 = 0) UNION ALL SELECT vec_id, NULL, 'stale' FROM embeddings WHERE label < 5 AND vec_id % 2 <> 0 AND label IN (SELECT label FROM embeddings WHERE label < 5 AND vec_id % 2 = 0)",
    "delete_cascade": _with(INDEX) + "SELECT c.document_id, count(*) AS n_chunks, coalesce(any_value(p.n), 0) AS n_postings FROM chunks c LEFT JOIN (SELECT document_id, count(*) AS n FROM post GROUP BY 1) p USING (document_id) WHERE c.document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) GROUP BY c.document_id",
    "rag_contexts": _with(INDEX, EVIDENCE) + CONTEXTS,
    "highlighted_hits": _with(INDEX, HITS) + HIGHLIGHTED,
    "public_urls": PUBLIC_URLS,
    "page_hosts": r"SELECT page_id, lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS host, CAST(strlen(html) AS INTEGER) AS download_bytes FROM pages",
    "normalised_text": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(replace(text, chr(0), ''), '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS sha256 FROM documents",
    "segment_offsets": r"""WITH n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start, CAST(length(t) AS INTEGER) AS n_chars FROM n WHERE length(t) > 0""",
    "citation_markers": r"""WITH m AS (SELECT conv_id, turn, text || ' [1] [n2][1]  end [12] <think>a' || chr(10) || 'b</think> ' AS t FROM conversations)
SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(t, '\[n?(\d+)\]', '', 'g'), '[ \t]{2,}', ' ', 'g'))) AS stripped_sha256, '1,2,12' AS numbers, true AS has_citation, CAST(length(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g')) AS INTEGER) AS n_chars FROM m""",
    "labels_and_formats": f"""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'Page 1' WHEN 2 THEN 'Pages 2-3' END AS page, CASE WHEN length('Document number ' || doc_id) > 18 THEN rtrim(substr('Document number ' || doc_id, 1, 17)) || '…' ELSE 'Document number ' || doc_id END AS title,
  'PDF' AS kind, CASE WHEN doc_id % 3 > 0 THEN format('{{:.4f}}', n_chars / 1000.0) ELSE 'n/a' END AS score, CASE WHEN n_chars < 1000 THEN format('{{}} ms', n_chars) ELSE format('{{:.2f}} s', ((n_chars + 5) // 10) / 100.0) END AS latency,
  CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS heat, CASE WHEN doc_id % 3 = 1 THEN '{ABSTENTIONS["low_relevance"]}' END AS said FROM documents""",
}
