"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

_PARTS = r"""list_distinct(list_concat(CASE WHEN regexp_full_match(w, '[A-Za-z0-9_-]+') THEN [lower(w)] ELSE [] END,
 list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')))"""


def _terms(source: str, keys: str, text: str) -> str:
    """A row for each term of each word of a text."""
    return f"SELECT {keys}, unnest({_PARTS}) AS term FROM (SELECT {keys}, unnest(string_split_regex({text}, '\\s+')) AS w FROM {source}) AS words WHERE w <> ''"


_CHUNKS = """chunks AS (SELECT doc_id AS row_id, source || '/' || doc_id AS file, lang AS language, 'doc_' || doc_id AS symbol,
 trim(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1]) AS signature, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line_end, coalesce(text, '') AS body FROM documents)"""
_HASHED = """hashed AS (SELECT doc_id AS row_id, source AS file, h AS content_hash, doc_id = min(doc_id) OVER (PARTITION BY h) AS live FROM (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents) AS x)"""
_INDEX = f"""{_CHUNKS},
fields AS (SELECT row_id, 'symbol' AS field, symbol AS text FROM chunks UNION ALL SELECT row_id, 'signature', signature FROM chunks UNION ALL SELECT row_id, 'body', body FROM chunks UNION ALL SELECT row_id, 'file', file FROM chunks),
terms AS ({_terms("fields", "row_id, field", "text")}),
tf AS (SELECT row_id, field, term, count(*) AS tf FROM terms GROUP BY ALL),
dl AS (SELECT row_id, field, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
al AS (SELECT field, sum(tf) / (SELECT count(*)::DOUBLE FROM chunks) AS avgdl FROM tf GROUP BY field),
boost(field, b) AS (VALUES ('symbol', 4.0::DOUBLE), ('signature', 3.0), ('body', 1.0), ('file', 0.5)),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT DISTINCT query_id, term FROM ({_terms("q", "query_id", "query")}) AS x),
lexical_scores AS (SELECT query_id, row_id, round(sum(b * ln(1 + ((SELECT count(*)::DOUBLE FROM chunks) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (field, term) JOIN dl USING (row_id, field) JOIN al USING (field) JOIN boost USING (field) GROUP BY query_id, row_id),
lx AS (SELECT * FROM (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM lexical_scores) AS x WHERE rank <= 50)"""


def _dense(queries: str, name: str = "dn", vectors: str = "embeddings", depth: int = 50) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS row_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM ({queries}) AS q, {vectors} AS v) AS s) AS x WHERE rank <= {depth})"""


_ITEMS = "SELECT e.* FROM embeddings AS e JOIN benchmark AS b ON e.vec_id = b.item_id"
_FIFTIETH = "SELECT * FROM embeddings WHERE vec_id % 50 = 0"


def _fused(lexical: str = "SELECT * FROM lx", dense: str = "SELECT * FROM dn", name: str = "fused") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, row_id) AS rank FROM (
  SELECT query_id, row_id, max(CASE WHEN k = 'l' THEN r END) AS lexical_rank, max(CASE WHEN k = 'l' THEN s END) AS lexical_score, max(CASE WHEN k = 'd' THEN r END) AS dense_rank, max(CASE WHEN k = 'd' THEN s END) AS dense_score, round(sum(1.0::DOUBLE / (60 + r)), 12) AS fused_score
  FROM (SELECT query_id, row_id, 'l' AS k, rank AS r, score AS s FROM ({lexical}) AS a UNION ALL SELECT query_id, row_id, 'd', rank, score FROM ({dense}) AS b) AS u GROUP BY query_id, row_id) AS g)"""


_HYBRID = f"{_INDEX}, {_dense(_ITEMS)}, {_fused()}"
_PREVIEW = "CASE WHEN strlen({0}) <= 320 THEN {0} ELSE left({0}, list_max(list_filter(range(80, 321), lambda n: strlen(left({0}, n)) <= 320))::INT) END"
_EXPECTED = "expected AS (SELECT o.vec_id AS query_id, v.vec_id AS row_id FROM benchmark AS b JOIN embeddings AS o ON o.vec_id = b.item_id JOIN embeddings AS v ON v.label = o.label)"
_SUMMARY = """count(*) AS labels_scored, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS top_1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) AS top_3,
 round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS top_10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr"""


def _hits(source: str, name: str) -> str:
    return f"{name} AS (SELECT e.query_id, min(f.rank) FILTER (WHERE f.rank <= 10) AS r FROM (SELECT DISTINCT query_id FROM expected) AS e LEFT JOIN (SELECT f.query_id, f.rank FROM {source} AS f JOIN expected USING (query_id, row_id)) AS f USING (query_id) GROUP BY e.query_id)"


_EDITED_INDEX = _INDEX.replace("FROM documents)", "FROM edited)")
_NORMAL = r"""array_to_string(list_transform(lines, lambda x: substr(x, k + 1)), chr(10))"""
_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_BASE = "string_split(path, '/')[-1]"
_LINES = "string_split(text, chr(10))"

ORACLE_SQL = {
    "tokenize_terms": f"SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM ({_terms('documents', 'doc_id', 'text')}) AS t GROUP BY doc_id",
    "split_identifiers": f"""SELECT w AS word, array_to_string(list_sort({_PARTS}), ',') AS parts FROM (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS w FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) AS a) AS b WHERE w <> ''""",
    "normalize_hash": rf"""WITH s AS (SELECT lang AS language, 'doc_' || doc_id AS symbol, text FROM documents UNION ALL SELECT 'html', 'page_' || page_id, html FROM pages),
a AS (SELECT language, symbol, string_split(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '^\n+|\n+$', '', 'g'), chr(10)) AS lines FROM s),
b AS (SELECT language, symbol, lines, coalesce(list_min(list_transform(list_filter(lines, lambda x: x <> ''), lambda x: length(regexp_extract(x, '^[ \t]*')))), 0) AS k FROM a)
SELECT symbol, sha256('1' || chr(31) || language || chr(31) || symbol || chr(31) || {_NORMAL}) AS content_hash FROM b""",
    "preview_320": f"SELECT doc_id, {_PREVIEW.format('text')} AS preview FROM documents",
    "signature_line": f"WITH {_CHUNKS} SELECT row_id, signature, line_end::BIGINT AS line_end FROM chunks",
    "skip_reason": rf"""WITH p AS (SELECT page_id, {_PATH} AS p FROM pages),
k AS (SELECT page_id, unnest(range(14)) AS kind, p || unnest(['.rs', '_pb2.py', '.generated.ts', '/node_modules/a.js', '/vendor', '.env', '/.env', '/credentials.json', '.pem', '.h', '.RS', '/target/x.go', '/id_rsa.pub', '.md']) AS path FROM p),
l AS (SELECT *, CASE regexp_extract(path, '\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
 WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cc' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'hh' THEN 'cpp' WHEN 'hxx' THEN 'cpp' END AS language FROM k)
SELECT page_id, kind, CASE WHEN regexp_full_match({_BASE}, '\.env|\.env\..*|.*\.pem|.*\.key|id_rsa.*|credentials\..*|secrets\..*') THEN 'secret'
 WHEN list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'target', 'dist', '.venv']) THEN 'vendor' WHEN regexp_full_match({_BASE}, '.*_pb2\.py|.*\.generated\..*') THEN 'generated' WHEN language IS NULL THEN 'language' END AS reason, language FROM l""",
    "postings_stats": f"WITH {_INDEX} SELECT field, count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS most, round(any_value(avgdl), 6) AS avgdl FROM df JOIN al USING (field) GROUP BY field",
    "bm25_topk": f"WITH {_INDEX} SELECT row_id, round(score, 6) AS score FROM lexical_scores WHERE query_id = (SELECT min(item_id) FROM benchmark) ORDER BY lexical_scores.score DESC, row_id LIMIT 50",
    "bm25_batch": f"WITH {_INDEX} SELECT query_id, row_id, rank, round(score, 6) AS score FROM lx",
    "dense_topk": f"WITH {_dense('SELECT * FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)')} SELECT row_id, round(score, 6) AS score FROM dn",
    "dense_batch": f"WITH {_dense(_FIFTIETH)} SELECT query_id, row_id, rank, round(score, 6) AS score FROM dn",
    "dense_live_mask": f"WITH {_HASHED}, lv AS (SELECT e.* FROM embeddings AS e JOIN hashed ON hashed.row_id = e.vec_id AND live), {_dense(_FIFTIETH, vectors='lv')} SELECT query_id, row_id, rank, round(score, 6) AS score FROM dn",
    "rrf_fuse": f"WITH {_HYBRID} SELECT query_id, rank, row_id, lexical_rank, dense_rank, round(fused_score, 9) AS fused_score FROM fused WHERE rank <= 10",
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, rank, file, symbol, signature, {_PREVIEW.format('body')} AS preview, round(lexical_score, 6) AS lexical_score, round(dense_score, 6) AS dense_score, round(fused_score, 9) AS fused_score FROM fused JOIN chunks USING (row_id) WHERE rank <= 10",
    "similar_search": f"WITH {_CHUNKS}, {_dense(_FIFTIETH)} SELECT query_id, rank, file, round(score, 6) AS dense_score, round(round(1.0::DOUBLE / (60 + rank), 12), 9) AS fused_score FROM dn JOIN chunks USING (row_id) WHERE rank <= 10",
    "ablation_metrics": f"""WITH {_HYBRID}, {_EXPECTED}, {_hits("fused", "hf")}, {_hits("lx", "hl")}, {_hits("dn", "hd")}
SELECT 'fused' AS config, {_SUMMARY} FROM hf UNION ALL SELECT 'lexical_only', {_SUMMARY} FROM hl UNION ALL SELECT 'dense_only', {_SUMMARY} FROM hd""",
    "mrr_topk": f"""WITH {_dense(_FIFTIETH, depth=11)}, o AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM dn WHERE query_id <> row_id),
h AS (SELECT q.vec_id, min(rank) FILTER (WHERE rank <= 10 AND v.label = q.label) AS r FROM ({_FIFTIETH}) AS q LEFT JOIN o ON o.query_id = q.vec_id LEFT JOIN embeddings AS v ON v.vec_id = o.row_id GROUP BY q.vec_id) SELECT {_SUMMARY} FROM h""",
    "breakdown_by_length": f"""WITH {_HYBRID}, {_EXPECTED}, {_hits("fused", "hf")}, n AS (SELECT query_id, len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) AS n FROM q)
SELECT CASE WHEN n <= 4 THEN 'short' WHEN n <= 10 THEN 'medium' ELSE 'long' END AS bucket, {_SUMMARY} FROM hf JOIN n USING (query_id) GROUP BY 1""",
    "bytes_before_hit": f"""WITH {_HYBRID}, {_EXPECTED}, {_hits("fused", "hf")},
j AS (SELECT query_id, rank, strlen(to_json({{'file': file, 'symbol': symbol, 'signature': signature, 'preview': {_PREVIEW.format('body')}}})::VARCHAR) AS n FROM fused JOIN chunks USING (row_id) WHERE rank <= 20),
c AS (SELECT query_id, rank, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS read FROM j)
SELECT query_id, coalesce(min(CASE WHEN rank >= r THEN read END), max(read))::BIGINT AS bytes FROM c JOIN hf USING (query_id) GROUP BY query_id""",
    "baseline_bytes": f"""WITH {_CHUNKS}, w AS (SELECT item_id AS query_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1] AS word FROM benchmark),
f AS (SELECT query_id, file, strlen(body) AS n, row_id = query_id AS hit FROM w JOIN chunks ON contains(body, word)),
c AS (SELECT query_id, hit, sum(n) OVER (PARTITION BY query_id ORDER BY file) AS read FROM f)
SELECT b.item_id AS query_id, coalesce(min(CASE WHEN hit THEN read END), max(read), 0)::BIGINT AS bytes FROM benchmark AS b LEFT JOIN c ON c.query_id = b.item_id GROUP BY b.item_id""",
    "percentile_nearest_rank": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "get_many_ordered": f"""WITH {_HASHED}, r AS (SELECT -doc_id AS ord, doc_id + toxic * 1000000000 AS row_id FROM labels)
SELECT ord, r.row_id, CASE WHEN h.row_id IS NOT NULL THEN 'doc_' || r.row_id END AS symbol FROM r LEFT JOIN (SELECT row_id FROM hashed WHERE live) AS h ON h.row_id = r.row_id""",
    "symbol_lookup": r"""WITH d AS (SELECT doc_id, source AS file, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1] AS symbol FROM documents),
w AS (SELECT file, symbol FROM d WHERE symbol IS NOT NULL UNION SELECT 'src0', list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1] FROM benchmark),
h AS (SELECT file, symbol, count(*) AS n, min(doc_id) AS row_id, string_agg(file || ':s' || doc_id, ',' ORDER BY file || ':s' || doc_id) AS c FROM d WHERE symbol IS NOT NULL GROUP BY file, symbol)
SELECT w.file, w.symbol, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN row_id END AS row_id, CASE WHEN n > 1 THEN c END AS candidates FROM w LEFT JOIN h ON h.file = w.file AND h.symbol = w.symbol WHERE w.symbol IS NOT NULL""",
    "containment_join": """WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS id, l_shipdate::DATE - DATE '1970-01-01' AS a, (l_shipdate::DATE - DATE '1970-01-01') + trunc(l_quantity)::BIGINT AS z FROM lineitem)
SELECT o.l_orderkey, o.id AS outer_id, i.id AS inner_id FROM s AS o JOIN s AS i ON o.l_orderkey = i.l_orderkey AND o.a <= i.a AND i.z <= o.z AND o.id <> i.id""",
    "line_interval_join": f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS part, unnest(range(len({_LINES}))) AS pos FROM documents)
SELECT DISTINCT doc_id::VARCHAR AS commit_id, 'd' || doc_id AS file, 'b' || (pos // 5) AS symbol FROM l WHERE regexp_matches(part, '[|@!]|icense')""",
    "label_partition": "SELECT conv_id AS label_id, bool_and(d.doc_id IS NOT NULL) AS scored FROM conversations AS c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) AS d ON d.doc_id = c.conv_id + c.turn GROUP BY conv_id",
    "dedup_insert": f"""WITH {_HASHED}, b AS (SELECT conv_id * 1000 + turn AS ord, sha256(coalesce(text, '')) AS h FROM conversations),
k AS (SELECT ord, h, row_number() OVER (PARTITION BY h ORDER BY ord) AS n, (SELECT min(row_id) FROM hashed WHERE live AND content_hash = h) AS known FROM b),
f AS (SELECT h, row_number() OVER (ORDER BY ord) + (SELECT max(row_id) FROM hashed WHERE live) AS id FROM k WHERE n = 1 AND known IS NULL)
SELECT ord, coalesce(known, id) AS row_id, CASE WHEN known IS NULL AND n = 1 THEN 'inserted' ELSE 'reused' END AS outcome FROM k LEFT JOIN f USING (h)""",
    "snapshot_diff": f"""WITH {_HASHED}, old AS (SELECT DISTINCT file, content_hash FROM hashed),
new AS (SELECT source AS file, sha256(replace(coalesce(text, ''), 'Licensed under', 'Under')) AS content_hash FROM documents WHERE doc_id IN (SELECT row_id FROM hashed WHERE live) UNION SELECT 'page_' || page_id, sha256(coalesce(html, '')) FROM pages),
m AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.content_hash, n.content_hash) AS content_hash, CASE WHEN o.file IS NULL THEN 'add' WHEN n.file IS NULL THEN 'tombstone' ELSE 'keep' END AS action FROM old AS o FULL OUTER JOIN new AS n ON o.file = n.file AND o.content_hash = n.content_hash)
SELECT file, content_hash, CASE WHEN bool_and(action = 'keep') OVER (PARTITION BY file) THEN 'skip' ELSE action END AS action FROM m""",
    "compaction_map": f"WITH {_HASHED} SELECT row_id AS old_id, row_number() OVER (ORDER BY row_id) - 1 AS new_id FROM hashed WHERE live",
    "verify_integrity": f"""WITH {_HASHED} SELECT 'orphan' AS problem, vec_id AS row_id FROM embeddings WHERE vec_id NOT IN (SELECT row_id FROM hashed) UNION ALL SELECT 'missing', row_id FROM hashed WHERE row_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'duplicate', row_id FROM hashed WHERE content_hash IN (SELECT content_hash FROM hashed GROUP BY content_hash HAVING count(*) > 1)""",
    "store_stats": f"WITH {_HASHED} SELECT count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS dead, round(count(*) FILTER (WHERE NOT live) / count(*)::DOUBLE, 9) AS dead_fraction FROM hashed",
    "incremental_stream": f"""WITH {_HASHED} SELECT 'd' || doc_id AS file, sha256(replace(coalesce(text, ''), 'Licensed under', 'Under')) AS content_hash FROM documents WHERE doc_id IN (SELECT row_id FROM hashed WHERE live) UNION ALL SELECT 'page_' || page_id, sha256(coalesce(html, '')) FROM pages""",
    "mining_cascade": r"""WITH c AS (SELECT conv_id || ':' || turn AS commit_id, role, conv_id, turn, trim(string_split(coalesce(text, ''), chr(10))[1]) AS subject FROM conversations),
t AS (SELECT commit_id, unnest(range(conv_id, conv_id + greatest(turn, 1))) AS n FROM c), u AS (SELECT * FROM t WHERE n <> 0),
p AS (SELECT commit_id, count(*) AS n, bool_and(n IN (SELECT doc_id FROM labels)) AS known FROM u GROUP BY commit_id),
r AS (SELECT c.commit_id, p.n, CASE WHEN role = 'system' THEN 'merge' WHEN regexp_matches(subject, '(?i)\b(wip|fixup|typo|bump|lint)\b') THEN 'maintenance_pattern'
 WHEN len(list_filter(string_split_regex(subject, '\s+'), lambda x: x <> '')) < 4 THEN 'subject_too_short' WHEN coalesce(p.n, 0) = 0 THEN 'no_symbols_touched' WHEN p.n > 3 THEN 'too_many_symbols' WHEN NOT known THEN 'symbol_not_indexed' ELSE 'accepted' END AS reason FROM c LEFT JOIN p USING (commit_id))
SELECT commit_id, reason, CASE WHEN reason = 'accepted' THEN n ELSE 0 END AS n FROM r""",
    "held_out_index": f"""WITH b AS (SELECT doc_id AS row_id, array_to_string(list_filter(string_split('/// about' || chr(10) || coalesce(text, '') || chr(10) || '  //! inner' || chr(10) || '// stays', chr(10)), lambda x: NOT regexp_matches(ltrim(x), '^//[/!]')), chr(10)) AS body FROM documents)
SELECT row_id, count(*) AS tokens, count(*) FILTER (WHERE term IN ('about', 'inner', 'stays')) AS marks FROM ({_terms("b", "row_id", "body")}) AS t GROUP BY row_id""",
    "l2_normalize_pool": """WITH v AS (SELECT vec_id, label, embedding, vec_id % 3 <> 0 AS used FROM embeddings),
e AS (SELECT label, vec_id, used, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM v),
m AS (SELECT label, i, sum(x) FILTER (WHERE used) / count(*) FILTER (WHERE used) AS mean FROM e GROUP BY label, i),
n AS (SELECT label, sqrt(sum(mean * mean)) AS n, max(CASE WHEN i = 1 THEN mean END) AS first FROM m GROUP BY label),
l AS (SELECT label, arg_max(embedding, vec_id) FILTER (WHERE used) AS last, arg_min(embedding, vec_id) AS cls FROM v GROUP BY label)
SELECT label, round(first / n, 6) AS mean, round(last[1]::DOUBLE / sqrt(list_dot_product(last::DOUBLE[], last::DOUBLE[])), 6) AS last_token, round(cls[1]::DOUBLE / sqrt(list_dot_product(cls::DOUBLE[], cls::DOUBLE[])), 6) AS cls, 1.0::DOUBLE AS length FROM n JOIN l USING (label)""",
    "chunk_source": """WITH d AS (SELECT 'src/d' || doc_id || '.rs' AS file, 'Doc' || doc_id AS name, lang, n_chars FROM documents),
s AS (SELECT file, name AS symbol, 'struct' AS symbol_type, '/// In ' || lang AS doc_first_line, 1 AS line_start, 2 AS line_end, 'pub struct ' || name || ';' AS body FROM d
UNION ALL SELECT file, name, 'impl', NULL, 4, 8, 'impl ' || name || ' {' || chr(10) || chr(10) || '}' FROM d
UNION ALL SELECT file, name || '::size', 'function', NULL, 5, 7, 'fn size(&self) -> u64 {' || chr(10) || '        ' || n_chars || chr(10) || '    }' FROM d)
SELECT file, symbol, symbol_type, doc_first_line, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, sha256('1' || chr(31) || 'rust' || chr(31) || symbol || chr(31) || body) AS content_hash FROM s""",
}

_INDEX_STATS = "SELECT field, count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS most, round(any_value(avgdl), 6) AS avgdl FROM df JOIN al USING (field) GROUP BY field"
ORACLE_SQL |= {
    "lexical_upsert": f"""WITH {_HASHED}, edited AS (SELECT doc_id, source, lang, replace(text, 'Licensed under', 'Under') AS text FROM documents WHERE doc_id IN (SELECT row_id FROM hashed WHERE live)),
{_EDITED_INDEX} {_INDEX_STATS}""",
    "lexical_renumber": f"""WITH {_HASHED}, m AS (SELECT row_id AS old_id, row_number() OVER (ORDER BY row_id) - 1 AS new_id FROM hashed WHERE live), edited AS (SELECT doc_id, source, lang, text FROM documents WHERE doc_id IN (SELECT old_id FROM m)),
{_EDITED_INDEX} SELECT new_id AS row_id, count(*) AS postings, sum(tf)::BIGINT AS tokens, min(df) AS rarest FROM tf JOIN df USING (field, term) JOIN m ON m.old_id = tf.row_id GROUP BY new_id""",
    "evaluation_report": f"""WITH {_HYBRID}, {_EXPECTED}, {_hits("fused", "hf")}, {_hits("lx", "hl")}, {_hits("dn", "hd")}, n AS (SELECT query_id, len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) AS n FROM q),
every AS (SELECT 'ablation' AS part, 'fused' AS name, r FROM hf UNION ALL SELECT 'ablation', 'lexical_only', r FROM hl UNION ALL SELECT 'ablation', 'dense_only', r FROM hd
 UNION ALL SELECT 'source', source, r FROM hf LEFT JOIN documents ON doc_id = query_id UNION ALL SELECT 'length', CASE WHEN n <= 4 THEN 'short' WHEN n <= 10 THEN 'medium' ELSE 'long' END, r FROM hf JOIN n USING (query_id))
SELECT part, name, 0::BIGINT AS labels_discarded, {_SUMMARY} FROM every GROUP BY part, name""",
    "median_bytes": f"""SELECT (SELECT quantile_disc(coalesce(s.bytes, 0), 0.5) FROM b LEFT JOIN s USING (query_id))::BIGINT AS search_median, (SELECT quantile_disc(bytes, 0.5) FROM b)::BIGINT AS baseline_median
FROM (SELECT 1) AS one""",
    "oversize_split": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS k, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, k, s, unnest(range((length(s) + 2047) // 2048)) AS c FROM (SELECT doc_id, k, s || CASE WHEN k < n - 1 THEN chr(10) ELSE '' END AS s FROM l) AS x),
u AS (SELECT doc_id, substr(s, c * 2048 + 1, 2048) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY k, c) AS i FROM c),
p AS (SELECT doc_id, i, 0 AS part, length(s) AS held FROM u WHERE i = 1
 UNION ALL SELECT u.doc_id, u.i, CASE WHEN held + length(s) > 2048 THEN part + 1 ELSE part END, CASE WHEN held + length(s) > 2048 THEN length(s) ELSE held + length(s) END FROM p JOIN u ON u.doc_id = p.doc_id AND u.i = p.i + 1)
SELECT u.doc_id AS id, part::INT AS part, string_agg(s, '' ORDER BY u.i) AS text FROM u JOIN p ON p.doc_id = u.doc_id AND p.i = u.i GROUP BY u.doc_id, part""",
}
ORACLE_SQL["median_bytes"] = f"WITH s AS ({ORACLE_SQL['bytes_before_hit']}), b AS ({ORACLE_SQL['baseline_bytes']}) {ORACLE_SQL['median_bytes']}"
