"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from passage_engine.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _terms(c: str) -> str:
    t = _tokens(c)
    content = f"list_filter({t}, lambda x: NOT list_contains({_STOP}, x))"
    return f"CASE WHEN len({content}) > 0 THEN list_distinct({content}) ELSE list_distinct({t}) END"


_DOCS, _ITEMS = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark"
_LIBRARY = r"""
SELECT doc_id, source || '_' || doc_id || '.md' AS filename,
       CASE WHEN source IN ('src1', 'src2') THEN 'memory' ELSE 'document' END AS doc_type,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, sha256(text) AS content_hash,
       CAST(floor(n_chars / 850) AS BIGINT) + 1 AS chunk_count
FROM documents"""
_TAGS = "SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, lower(lang) AS tag FROM documents UNION ALL SELECT doc_id, lower(source) FROM documents)"
_MEMORIES = "SELECT conv_id AS id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"


def _bm25(docs: str, queries: str, scope: str = "") -> str:
    """CTEs that end with hits(query_id, id, score, rank), unlimited."""
    return f"""
d AS ({docs}), q AS ({queries}),
qt AS (SELECT query_id, unnest({_terms('query')}) AS term FROM q),
tok AS (SELECT id, {_tokens('text')} AS t FROM d),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok),
post AS (SELECT id, term, len_, count(*) AS tf FROM (SELECT id, len(t) AS len_, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, al, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM freq, corpus),
part AS (SELECT id, term, idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len_ / al)) AS s FROM post JOIN idf USING (term) {scope}),
total AS (SELECT query_id, id, sum(s) AS score FROM part JOIN qt USING (term) GROUP BY query_id, id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM total)"""


def _dense(vectors: str, queries: str) -> str:
    return f"""
v AS ({vectors}), vq AS ({queries}),
pairs AS (SELECT query_id, id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS score
          FROM (SELECT query_id, id, vq.e AS a, v.e AS b FROM v, vq)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pairs)"""


_V = "SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings"
_VQ = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0"
_ASKED = _ITEMS
_AV = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"


def _norm(c: str, by: str = "query_id") -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY {by})", f"max({c}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {hi} = {lo} THEN 1.0::DOUBLE ELSE ({c} - {lo}) / ({hi} - {lo}) END"


def _fused(depth: int, scope: str = "", vscope: str = "") -> str:
    return f"""
{_bm25(_DOCS, _ASKED, scope)}, {_dense(_V + vscope, _AV)},
both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS ds, b.score AS ss, a.rank AS dr, b.rank AS sr
          FROM (SELECT * FROM dense WHERE rank <= {depth}) a FULL JOIN (SELECT * FROM hits WHERE rank <= {depth}) b ON a.query_id = b.query_id AND a.id = b.id),
normed AS (SELECT *, 0.3 * coalesce({_norm('ds')}, 0) + 0.7 * coalesce({_norm('ss')}, 0) AS fused FROM both_),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS fused_rank FROM normed)"""


_PAIRS = "list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def _coverage(pairs: str) -> str:
    """CTEs after d, q, qt, freq, corpus: cover(query_id, id, coverage) for pairs (query_id, id)."""
    return f"""
w AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM qt LEFT JOIN freq USING (term), corpus),
pr AS ({pairs}),
body AS (SELECT pr.query_id, pr.id, {_tokens('d.text')} AS t, {_tokens('q.query')} AS r FROM pr JOIN d ON d.id = pr.id JOIN q ON q.query_id = pr.query_id),
hit AS (SELECT b.query_id, b.id, sum(CASE WHEN list_contains(t, term) THEN w ELSE 0 END) / sum(w) AS base FROM body b JOIN w ON w.query_id = b.query_id GROUP BY b.query_id, b.id),
cover AS (SELECT b.query_id, b.id, CASE WHEN len(t) = 0 THEN 0.0 ELSE least(1.0, base + CASE WHEN len(r) > 1
          THEN 0.25 * len(list_intersect({_PAIRS.format(t='r')}, {_PAIRS.format(t='t')})) / len({_PAIRS.format(t='r')}) ELSE 0 END) END AS coverage
          FROM body b JOIN hit h ON h.query_id = b.query_id AND h.id = b.id)"""


def _hybrid(k: int, scope: str = "", vscope: str = "", extra: str = "", join: str = "", score: str = "") -> str:
    depth, pool = max(5 * k, 25), max(3 * k, 15)
    score = score or f"0.5 * {_norm('fused', 'p.query_id')} + 0.5 * coverage"
    return f"""WITH {_fused(depth, scope, vscope)},
pool AS (SELECT f.* FROM fused f JOIN d ON d.id = f.id WHERE fused_rank <= {pool}),
{_coverage('SELECT query_id, id FROM pool')},
final AS (SELECT p.*, {score} AS score FROM (SELECT p.*, -abs(length(q.query) - length(d.text)) / 100.0::DOUBLE AS logit FROM pool p JOIN d ON d.id = p.id JOIN q ON q.query_id = p.query_id) p
          JOIN cover c ON c.query_id = p.query_id AND c.id = p.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fused_rank) AS rank FROM final)
SELECT query_id, rank, r.id, round(score, 4) AS score, round(coalesce(ss, 0), 4) AS sparse_score, round(coalesce(ds, 0), 4) AS dense_score, fused_rank{extra}
FROM ranked r {join} WHERE rank <= {k}"""


_FIRST = "SELECT conv_id AS query_id, text AS query FROM conversations WHERE turn = 0 AND conv_id % 50 = 0"
_METRICS = f"""WITH {_bm25(_MEMORIES, _FIRST)},
run AS (SELECT query_id, id, rank FROM hits WHERE rank <= 10),
rel AS (SELECT DISTINCT query_id, query_id AS id FROM q),
n_rel AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
found AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM run JOIN rel USING (query_id, id) GROUP BY query_id),
each AS (SELECT query_id, coalesce(h, 0) / n AS recall, coalesce(h, 0) / 5.0::DOUBLE AS precision, CASE WHEN coalesce(h, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit,
                coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda r: 1 / log2(r + 1.0))) AS ndcg, coalesce(1.0::DOUBLE / first, 0.0) AS rr
         FROM n_rel LEFT JOIN found USING (query_id))"""
# RE2 has no look-behind: the character before a guarded token is captured, and the step runs twice for neighbours.
_GUARD = r"(^|[ \x{0001}\x{0002}])((?i:mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|e\.g|i\.e|fig)\.|(?:[A-Z]\.)+)\x{0001}"
_S = "regexp_replace(regexp_replace(coalesce(text, ''), chr(13) || chr(10), chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_S = f"regexp_replace({_S}, '\\n\\s*\\n', chr(2), 'g')"
_S = f"regexp_replace(regexp_replace({_S}, '\\s+', ' ', 'g'), ' ?\\x{{0002}} ?', chr(2), 'g')"
_S = f"""regexp_replace({_S}, '([.!?…]["''”’)\\]]*) ', '\\1' || chr(1), 'g')"""
for _ in range(2):
    _S = f"regexp_replace({_S}, '{_GUARD}', '\\1\\2 ', 'g')"

SQL: dict[str, str] = {
    "html_text": r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
  '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
FROM pages""",
    "ascii_tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "content_terms": f"SELECT item_id AS query_id, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM benchmark",
    "sentence_split": f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, list_filter(string_split(replace({_S}, chr(2), chr(1)), chr(1)), lambda x: x <> '') AS s FROM documents)",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "dedup_lookup": f"SELECT content_hash, doc_type, arg_max(doc_id, (created_at, doc_id)) AS doc_id FROM ({_LIBRARY}) GROUP BY content_hash, doc_type",
    "library_metadata": f"SELECT doc_id, filename, doc_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, chunk_count FROM ({_LIBRARY})",
    "documents_with_tags": f"SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAGS}) GROUP BY doc_id",
    "list_page": f"SELECT doc_id, filename FROM ({_LIBRARY}) WHERE doc_type = 'document' AND contains(lower(filename), 'src1') ORDER BY lower(filename), doc_id LIMIT 50 OFFSET 20",
    "list_newest": f"SELECT doc_id, filename FROM ({_LIBRARY}) WHERE doc_type = 'memory' ORDER BY created_at DESC, doc_id DESC LIMIT 25",
    "tag_histogram": f"SELECT tag, count(*) AS n FROM ({_TAGS}) GROUP BY tag",
    "tag_and": f"SELECT doc_id FROM ({_TAGS}) WHERE tag IN ('en', 'src3') GROUP BY doc_id HAVING count(DISTINCT tag) = 2",
    "since_filter": f"SELECT doc_id FROM ({_LIBRARY}) WHERE created_at >= TIMESTAMP '2024-01-01 05:00:00'",
    "scope_intersection": f"SELECT doc_id FROM ({_TAGS}) WHERE tag = 'en' INTERSECT SELECT doc_id FROM ({_LIBRARY}) WHERE doc_type = 'document' INTERSECT SELECT doc_id FROM ({_LIBRARY}) WHERE created_at >= TIMESTAMP '2024-01-01 02:00:00'",
    "library_version": f"""SELECT (SELECT count(*) FROM l) AS documents, (SELECT CAST(sum(chunk_count) AS BIGINT) FROM l) AS chunks, (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM l) AS latest,
(SELECT count(*) FROM t) AS tags, (SELECT CAST(sum(length(tag)) AS BIGINT) FROM t) AS tag_chars FROM (SELECT 1) x""",
    "term_frequencies": f"WITH {_bm25(_DOCS, _ITEMS)} SELECT term, coalesce(df, 0) AS df, round(CASE WHEN ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) END, 6) AS bm25_idf, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) AS coverage_idf FROM (SELECT DISTINCT term FROM qt) LEFT JOIN freq USING (term), corpus",
    "bm25_search": f"WITH {_bm25(_DOCS, _ITEMS)} SELECT query_id, id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10",
    "bm25_scoped": f"WITH {_bm25(_DOCS, _ITEMS, 'WHERE id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, id, round(score, 6) AS score, rank FROM hits WHERE rank <= 5",
    "dense_search": f"WITH {_dense(_V, _VQ)} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10",
    "dense_scoped": f"WITH {_dense(_V + ' WHERE label IN (1, 2, 3)', _VQ)} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 5",
    "dense_widths": "SELECT count(*) FILTER (len(embedding) = 64) AS n_used, count(*) FILTER (len(embedding) <> 64) AS n_skipped FROM embeddings",
    "l2_normalized": f"SELECT id, md5(array_to_string(list_transform(e, lambda x: CAST(floor(x / n * 1e6 + 0.5) AS BIGINT)), ',')) AS components_md5, round(1.0::DOUBLE, 6) AS length FROM (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM ({_V}))",
    "convex_fusion": f"WITH {_fused(50)} SELECT query_id, id, round(fused, 6) AS fused, fused_rank FROM fused",
    "rrf_fusion": f"WITH {_fused(50)}, r AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) AS score FROM both_) SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM r",
    "coverage_rerank": f"WITH {_bm25(_DOCS, _ITEMS)}, {_coverage('SELECT query_id, id FROM hits WHERE rank <= 30')} SELECT query_id, id, round(coverage, 6) AS coverage FROM cover",
    "hybrid_search": _hybrid(10),
    "hybrid_scoped": _hybrid(
        5,
        "WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2'))",
        " WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2'))",
        ", l.filename, l.doc_type",
        f"JOIN ({_LIBRARY}) l ON l.doc_id = r.id",
    ),
    "conversation_memories": f"SELECT id, length(text) AS n_chars, sha256(text) AS content_hash FROM ({_MEMORIES})",
    "retrieval_metrics": f"{_METRICS} SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit, 6) AS hit, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr FROM each",
    "retrieval_summary": f"{_METRICS} SELECT count(*) AS queries, round(avg(round(recall, 4)), 4) AS recall, round(avg(round(precision, 4)), 4) AS precision, round(avg(round(hit, 4)), 4) AS hit, round(avg(round(ndcg, 4)), 4) AS ndcg, round(avg(rr), 4) AS mrr, round((SELECT count(DISTINCT query_id) FROM rel WHERE query_id NOT IN (SELECT query_id FROM run)) / count(*), 4) AS zero_result_rate FROM each",
    "latency_stats": "SELECT count(*) AS count, round(avg(value), 4) AS mean_s, round(quantile_disc(value, 0.5), 4) AS p50_s, round(quantile_disc(value, 0.95), 4) AS p95_s, round(min(value), 4) AS min_s, round(max(value), 4) AS max_s FROM events",
}
SQL["library_version"] = f"WITH l AS ({_LIBRARY}), t AS ({_TAGS}) " + SQL["library_version"]
SQL |= {
    "normalized_tags": r"SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 64) AS tag FROM benchmark",
    "safe_filenames": r"""SELECT page_id, f AS filename, CASE WHEN regexp_matches(lower(f), '\.(txt|md|markdown)$') THEN f ELSE f || '.md' END AS title, regexp_matches(lower(f), '\.(txt|md|markdown|rst|org|tex|textile|log|nfo|png|jpg|jpeg|tif|tiff|bmp|webp|pdf|docx|pptx|html|htm|xml|csv|tsv|xlsx|xlsm|xltx|epub|odt|ods|odp|rtf|json)$') AS supported
FROM (SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N}._\- ]', '_', 'g')) AS f FROM pages)""",
    "list_oldest": f"SELECT doc_id, filename FROM ({_LIBRARY}) ORDER BY created_at, doc_id LIMIT 100 OFFSET 10",
    "memories_only": "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')",
    "id_lookup": f"SELECT doc_id, filename FROM ({_LIBRARY}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "extracted_pages": f"SELECT *, '' AS error FROM ({SQL['html_text']})",
}

_CROSS = f"0.3 * {_norm('fused', 'p.query_id')} + 0.7 * {_norm('logit', 'p.query_id')}"
_WORDS = f"array_to_string({_tokens('text')}, ' ')"


def _report(k: int) -> str:
    ideal = f"list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda r: 1 / log2(r + 1.0)))"
    h = f"count(*) FILTER (r.rank <= {k})"
    return f"""round({h} / any_value(n), 4) AS recall_at_{k}, round({h} / {k}.0::DOUBLE, 4) AS precision_at_{k}, CASE WHEN {h} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_at_{k},
round(coalesce(sum(CASE WHEN r.rank <= {k} THEN 1 / log2(r.rank + 1.0) END), 0) / {ideal}, 4) AS ndcg_at_{k}"""


# Chunks: sentences are cut to pieces of the chunk's size; runs of sentences that no full piece interrupts are then walked
# chunk by chunk over the sums of their lengths.
_CHUNKS = f"""
WITH RECURSIVE src AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS body, list_filter(string_split(replace({_S}, chr(2), chr(1)), chr(1)), lambda x: x <> '') AS ss FROM documents),
cuts AS (SELECT doc_id, no, s, CASE WHEN length(s) > 1000 THEN CAST(ceil((length(s) - 1000) / 850.0) AS INT) ELSE 0 END AS w
         FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS no FROM src)),
full_ AS (SELECT doc_id, no, k, substr(s, 850 * k + 1, 1000) AS t FROM (SELECT *, unnest(range(w)) AS k FROM cuts WHERE w > 0)),
part AS (SELECT doc_id, no, substr(s, 850 * w + 1) AS t, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM cuts),
runs AS (SELECT doc_id, run, min(no) AS no, list(t ORDER BY no) AS ts FROM part GROUP BY doc_id, run),
ends AS (SELECT *, list_concat([0::BIGINT], list_transform(range(1, len(ts) + 1), lambda k: CAST(list_sum(list_transform(ts[1:k], lambda x: length(x) + 1)) AS BIGINT))) AS e FROM runs),
walk AS (
  SELECT doc_id, run, no, ts, e, 0::BIGINT AS step, 0::BIGINT AS i, CAST(len(list_filter(e, lambda x: x <= 1001)) - 1 AS BIGINT) AS j FROM ends
  UNION ALL
  SELECT doc_id, run, no, ts, e, step + 1, n, CAST(len(list_filter(e, lambda x: x <= e[n + 1] + 1001)) - 1 AS BIGINT)
  FROM (SELECT *, greatest(i, least(len(list_filter(e, lambda x: x < e[j + 1] - 151)), j - 1), len(list_filter(e, lambda x: x < e[j + 2] - 1001))) AS n FROM walk WHERE j < len(ts))),
packed AS (SELECT doc_id, no, 1 AS kind, step AS k, array_to_string(ts[i + 1:j], ' ') AS t FROM walk UNION ALL SELECT doc_id, no, 0, k, t FROM full_),
kept AS (SELECT * FROM packed WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) >= 50),
raw AS (SELECT doc_id, 1 AS no, 1 AS kind, unnest(range(CAST(ceil(length(body) / 1000.0) AS BIGINT))) AS k, body FROM src WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
every AS (SELECT doc_id, no, kind, k, t FROM kept UNION ALL SELECT doc_id, no, kind, k, substr(body, 1000 * k + 1, 1000) FROM raw),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, kind, k) - 1 AS INT) AS chunk_no, t AS text FROM every)"""
_EXPORT = f"""SELECT l.doc_id, to_json({{'filename': l.filename, 'text': d.text, 'tags': t.tags, 'doc_type': l.doc_type, 'created_at': strftime(l.created_at, '%Y-%m-%dT%H:%M:%SZ')}})::VARCHAR AS document, l.*, t.tags, d.text
FROM ({_LIBRARY}) l JOIN documents d USING (doc_id) JOIN (SELECT doc_id, list(tag ORDER BY tag) AS tags FROM ({_TAGS}) GROUP BY doc_id) t USING (doc_id) WHERE trim(d.text) <> ''"""
_LIFE = r"""
WITH g AS (SELECT *, sha256(text) AS h, arg_min(doc_id, doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE source <> 'src4' AND trim(text) <> ''),
t AS (SELECT DISTINCT first, unnest([lang, 'from ' || source]) AS tag FROM g),
d AS (SELECT first, any_value(h) AS h, first || '.md' AS filename FROM g GROUP BY first),
has AS (SELECT first, list(tag) AS tags, list_contains(list(tag), 'fr') AS fr, list_contains(list(tag), 'de') AS de, list_contains(list(tag), 'es') AS es FROM t GROUP BY first)
SELECT filename, 'ready' AS status, '' AS error, 'document' AS doc_type, CASE WHEN es AND NOT de THEN sha256('A new note on ' || filename || '.') ELSE h END AS content_hash,
       CASE WHEN de THEN 'neu' ELSE array_to_string(list_sort(tags), ',') END AS tags
FROM d JOIN has USING (first) WHERE NOT fr
UNION ALL
SELECT doc_id || '.md', 'failed', 'unreadable', 'document', '', '' FROM documents WHERE source = 'src4'"""
SQL |= {
    "hybrid_cross": _hybrid(10, score=_CROSS),
    "hybrid_cross_fallback": SQL["hybrid_search"],
    "backend_gate": _hybrid(5, vscope=" WHERE false"),
    "relative_scores": f"WITH {_bm25(_DOCS, _ITEMS)} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relative FROM hits WHERE rank <= 10",
    "status_counts": "SELECT CASE WHEN length(text) < 50 THEN 'failed' WHEN source = 'src3' THEN 'duplicate' ELSE 'ready' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "page_counts": "SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM documents",
    "newest_rows": "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, (turn, text))) AS text_md5 FROM conversations GROUP BY conv_id",
    "query_levels": "SELECT count(*) FILTER (length(text) > 300) AS chunk_queries, count(*) FILTER (length(text) <= 300) AS doc_queries FROM benchmark",
    "run_report": f"""{_METRICS}, listed AS (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS retrieved FROM run GROUP BY query_id),
good AS (SELECT n_rel.query_id, n, id, rank FROM n_rel LEFT JOIN (SELECT * FROM run JOIN rel USING (query_id, id)) USING (query_id))
SELECT r.query_id, any_value(n) AS n_relevant, coalesce(any_value(retrieved), '') AS retrieved, round(coalesce(1.0::DOUBLE / min(r.rank), 0.0), 4) AS rr, {', '.join(map(_report, (1, 5, 10)))}
FROM good r LEFT JOIN listed USING (query_id) GROUP BY r.query_id""",
    "extracted_formats": f"""SELECT item_id, kind, CASE kind WHEN 'doc' THEN '' WHEN 'txt' THEN 'Title' || chr(10) || w WHEN 'csv' THEN 'Title | words' || chr(10) || '1 | ' || w WHEN 'tsv' THEN 'Title | words' || chr(10) || '1 | ' || w
  WHEN 'json' THEN 'Title' || p || w WHEN 'rtf' THEN 'Title' || chr(10) || w WHEN 'docx' THEN 'Title' || p || ' ' || w WHEN 'pptx' THEN 'Title' || p || w WHEN 'odt' THEN '# Title' || p || ' ' || w
  WHEN 'xlsx' THEN '# One' || chr(10) || w || ' |  | 2.5' WHEN 'epub' THEN '# Title' || p || w WHEN 'html' THEN 'Title ' || w WHEN 'xml' THEN 'Title ' || w END AS text,
  CASE kind WHEN 'doc' THEN 'ValueError: .doc files are not supported; convert to .docx' ELSE '' END AS error
FROM (SELECT item_id, {_WORDS} AS w, chr(10) || chr(10) AS p, unnest(['txt', 'html', 'xml', 'csv', 'tsv', 'json', 'rtf', 'docx', 'pptx', 'odt', 'xlsx', 'epub', 'doc']) AS kind FROM benchmark)""",
    "library_life": _LIFE,
    "export_library": f"SELECT doc_id, document FROM ({_EXPORT})",
    "imported_library": f"SELECT filename, md5(text) AS text_md5, array_to_string(tags, ',') AS tags, doc_type, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, '' AS error FROM ({_EXPORT})",
    "json_strings": "SELECT event_id, props AS text, '' AS error FROM events",
    "chunks": f"{_CHUNKS} SELECT doc_id || ':' || chunk_no AS chunk_id, doc_id, chunk_no, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks",
    "document_from_chunks": f"{_CHUNKS} SELECT doc_id, count(*) AS chunk_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_no)) AS text_md5 FROM chunks GROUP BY doc_id",
}
