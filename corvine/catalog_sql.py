"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

DOCS = "docs AS (SELECT *, concat_ws('/', source, lang, doc_id::VARCHAR) AS path FROM documents)"


def toks(c: str) -> str:
    return f"list_transform(list_filter(string_split_regex(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"


def md5n(c: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({c}), 1, {digits}))::BIGINT"


TOK = f"tok AS (SELECT doc_id, {toks('text')} AS tokens FROM documents)"
ASKED = f"asked AS (SELECT item_id AS query_id, unnest({toks('text')}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL)"
POST = "ex AS (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS term FROM tok), post AS (SELECT doc_id, size, term, count(*) AS tf FROM ex GROUP BY ALL), st AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), idf AS (SELECT term, df, greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 1e-6) AS idf FROM df, st)"
BM = f"{TOK}, {ASKED}, {POST}, bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / greatest(avg_len, 1e-9)))) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), st GROUP BY ALL)"


def bm_top(k: int) -> str:
    return f"{BM}, every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(bm.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.query_id = b.item_id AND bm.doc_id = d.doc_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM every QUALIFY rank <= {k})"


NORMED = "nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
COS = f"{NORMED}, cs AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(q.v, b.v) AS score FROM nv q, nv b WHERE q.vec_id % 100 = 0)"


def knn(k: int, more: str = "") -> str:
    return f"{COS}, nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cs {more} QUALIFY rank <= {k})"


GOLD = "gold AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"
DENSE = f"{NORMED}, ds AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(q.v, b.v) AS score FROM nv q, nv b WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM documents)), dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds QUALIFY rank <= 200)"
FUSED = "fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r0, b.rank AS r1, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf FROM one a FULL JOIN two b ON a.query_id = b.query_id AND a.doc_id = b.doc_id), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank FROM fu QUALIFY rank <= 10)"
FUSE = f"{FUSED} SELECT query_id, rank, doc_id, round(rrf, 9) AS rrf FROM best"
POOLED = f"""{TOK}, {ASKED}, lt AS (SELECT query_id, doc_id, rank, len(tokens) AS size, tokens FROM dense JOIN tok USING (doc_id)),
st AS (SELECT query_id, count(*) AS n_docs, avg(size) AS avg_len FROM lt GROUP BY 1), ex AS (SELECT query_id, doc_id, size, unnest(tokens) AS term FROM lt),
tf AS (SELECT query_id, doc_id, size, term, times, count(*) AS tf FROM ex JOIN qt USING (query_id, term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(times * greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 1e-6) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / greatest(avg_len, 1e-9)))) AS score FROM tf JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL),
one AS (SELECT query_id, doc_id, rank FROM dense), two AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(bm.score, 0), 9) DESC, dense.rank) AS rank FROM dense LEFT JOIN bm USING (query_id, doc_id))"""


def hashed(table: str, key: str) -> str:
    bins = f"list_transform({toks('text')}, lambda t: {md5n('t', 7)} % 64)"
    return f"""{table}b AS (SELECT {key} AS id, {bins} AS b FROM {table}),
{table}c AS (SELECT id, list_transform(range(64), lambda d: len(list_filter(b, lambda x: x = d))::DOUBLE) AS c FROM {table}b),
{table}v AS (SELECT id, list_transform(c, lambda x: x / CASE WHEN list_sum(list_transform(c, lambda y: y * y)) > 0 THEN sqrt(list_sum(list_transform(c, lambda y: y * y))) ELSE 1 END) AS v FROM {table}c)"""


HASHED = f"""{hashed("documents", "doc_id")}, {hashed("benchmark", "item_id")},
hs AS (SELECT q.id AS query_id, d.id AS doc_id, list_dot_product(q.v, d.v) AS score FROM benchmarkv q, documentsv d),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hs QUALIFY rank <= 200)"""


def shown(ranking: str, score: str) -> str:
    return f"{DOCS} SELECT query_id, rank, doc_id AS chunk_id, path, substr(string_split(text, chr(10))[1], 1, 96) AS snippet, round({score}, 6) AS score FROM {ranking} JOIN docs USING (doc_id) WHERE rank <= 10"




def closed(ranks: str) -> str:
    a = lambda k: f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)"
    return f"SELECT round({a(1)}, 6) AS accuracy_at_1, round({a(5)}, 6) AS accuracy_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END), 6) AS ndcg_at_10, round({a(10)}, 6) AS recall_at_10 FROM {ranks}"


CLOSED = f"{bm_top(10)}, {GOLD}, cr AS (SELECT gold.item_id AS query_id, top.rank FROM gold LEFT JOIN top ON top.query_id = gold.item_id AND top.doc_id = gold.doc_id)"


def label_ranks(k: int) -> str:
    return f"{knn(k, 'WHERE query_id <> doc_id')}, lr AS (SELECT q.vec_id AS query_id, min(rank) AS rank FROM embeddings q LEFT JOIN (SELECT nn.query_id, nn.rank, e.label FROM nn JOIN embeddings e ON e.vec_id = nn.doc_id) h ON h.query_id = q.vec_id AND h.label = q.label WHERE q.vec_id % 100 = 0 GROUP BY 1)"


LINES = "ln AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents), dn AS (SELECT doc_id, text, len(l) AS n, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: starts_with(regexp_replace(x, '^\\s+', ''), 'Re'))) / len(l) ELSE 0.0 END AS ratio FROM ln)"
JUDGED = f"{LINES}, jd AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN 'unreadable' WHEN strlen(text) > 10000 THEN 'oversized' WHEN contains(substr(text, 1, 8192), chr(0)) THEN 'binary' WHEN n >= 3 AND ratio >= 0.1 THEN 'generated' ELSE 'kept' END AS disposition FROM dn)"
VAL = f"{md5n('path')} % 1000000"
CUT8 = "substr(CASE WHEN len(string_split(text, chr(10))) > 8 THEN array_to_string(list_concat(list_slice(string_split(text, chr(10)), 1, 8), [chr(9) || '/* ... truncated ... */', '}']), chr(10)) ELSE text END, 1, 6000)"
HITS = f"{bm_top(8)}, hits AS (SELECT query_id, rank, '[' || rank || '] ' || concat_ws('/', source, lang, doc_id::VARCHAR) || ':1  (' || lang || ' d' || doc_id || ')' || chr(10) || '```c' || chr(10) || text || chr(10) || '```' || chr(10) AS block FROM top JOIN documents USING (doc_id)), used AS (SELECT *, (sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used FROM hits), fit AS (SELECT * FROM used WHERE used <= 12000 OR rank = 1)"
SCORES = f"{NORMED}, g AS (SELECT vec_id AS id, v, list_transform(v[1:32], lambda x: x / sqrt(list_sum(list_transform(v[1:32], lambda y: y * y)))) AS g, vec_id // 2 AS i, vec_id // 32 AS batch FROM nv), sc AS (SELECT a.batch, a.i, b.i AS j, 20 * list_dot_product(a.v, b.v) AS s, list_dot_product(a.g, b.g) AS gs FROM g a JOIN g b USING (batch) WHERE a.id % 2 = 0 AND b.id % 2 = 1), own AS (SELECT batch, i, max(CASE WHEN i = j THEN gs END) AS o FROM sc GROUP BY ALL)"
NCE = "SELECT avg(l) AS loss FROM (SELECT ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM {0} GROUP BY batch, i)"
IDS = f"pk0 AS (SELECT doc_id, list_transform({toks('text')}, lambda t: 5 + {md5n('t', 7)} % 32763) AS ids FROM documents), pk AS (SELECT doc_id, ids, (coalesce(sum(len(ids) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM pk0)"
WINDOWS = f"{IDS}, fl AS (SELECT start + unnest(range(len(ids) + 1)) AS pos, unnest(list_append(ids, 3)) AS id FROM pk), win AS (SELECT pos // 128 AS \"window\", list(id ORDER BY pos) AS ids FROM fl GROUP BY 1 HAVING count(*) = 128)"


def draw(kind: str) -> str:
    return md5n(f"'42{kind}|' || w || '|' || p", 7)


def seeded(seed: int, c: str) -> str:
    return f"md5('{seed}|' || {c})"


def ring(name: str, group: str) -> str:
    """i -> j of the next name in the group's ring of hashed names."""
    return f"""{name}h AS (SELECT {group} AS g, md5('42|' || name) AS h, name, arg_min(i, {seeded(42, "i")}) AS j FROM rows GROUP BY ALL),
{name}f AS (SELECT g, name, j, lead(j) OVER w AS nx, first(j) OVER w AS fs FROM {name}h WINDOW w AS (PARTITION BY g ORDER BY h, name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT i, coalesce(nx, CASE WHEN fs <> j THEN fs END) AS j FROM rows JOIN {name}f ON {name}f.g = {group} AND {name}f.name = rows.name WHERE coalesce(nx, CASE WHEN fs <> j THEN fs END) IS NOT NULL)"""


C_FILES = f"cw AS (SELECT *, source || '/' || doc_id || '.c' AS path, trim(substr(regexp_replace(text, '[^a-z]+', ' ', 'g'), 1, 60)) AS w FROM documents)"
#: What each dressed document defines, written out: name, kind, its comment and code, line.
C_DEFINED = """
cd AS (SELECT path, 'fn' || doc_id AS name, 'function' AS kind, concat('/**', chr(10), ' * fn', doc_id, ' - ', w, chr(10), ' * @a: value number ', n_chars, chr(10), ' */', chr(10), 'static int fn', doc_id, '(int a)', chr(10), '{', chr(10), chr(9), 'return a + ', n_chars, ';', chr(10), '}') AS code, 5 AS line FROM cw WHERE doc_id % 4 = 0
UNION ALL SELECT path, 'make' || doc_id, 'function', concat(rtrim('// ' || w), chr(10), 'struct pair *', chr(10), 'make', doc_id, '(struct pair *p)', chr(10), '{', chr(10), chr(9), 'char *s = "}";', chr(10), chr(9), 'return p; /* } */', chr(10), '}'), 5 FROM cw WHERE doc_id % 4 = 1
UNION ALL SELECT path, 'node' || doc_id, 'struct', concat('typedef struct node', doc_id, ' {', chr(10), chr(9), 'int x;', chr(10), chr(9), 'char c;', chr(10), '}'), 1 FROM cw WHERE doc_id % 4 = 3)"""
BLANK, SHORT = r"\t-\r \x{85}\p{Z}", "|".join(f"''{x}" for x in "s t re ve m ll d".split())
#: A run of blanks gives its last character to the word after it, so the text is cut there first.
PRETOKENS = rf"""cut AS (SELECT unnest(string_split(regexp_replace(text, '([{BLANK}]+)([{BLANK}])([^{BLANK}])', '\1' || chr(1) || '\2\3', 'g'), chr(1))) AS part FROM documents),
pre AS (SELECT unnest(regexp_extract_all(part, '{SHORT}| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+')) AS word FROM cut)"""


ORACLES: dict[str, str] = {
    "extract_definitions": f"WITH {C_FILES}, {C_DEFINED} SELECT path, name, kind, code, line FROM cd",
    "kdoc_mine": f"""WITH {C_FILES}, k AS (SELECT path, 'fn' || doc_id AS name, 'function' AS kind, w || ' Parameters: a: value number ' || n_chars AS anchor, concat('static int fn', doc_id, '(int a)', chr(10), '{{', chr(10), chr(9), 'return a + ', n_chars, ';', chr(10), '}}') AS positive FROM cw WHERE doc_id % 4 = 0 AND w <> '')
SELECT * FROM k WHERE length(anchor) >= 40 AND length(positive) >= 40""",
    "chunk_with_fallback": f"""WITH {C_FILES}, {C_DEFINED}, every AS (SELECT * FROM cd UNION ALL SELECT path, doc_id || '.c:1', 'window', concat(w, chr(10), w, chr(10), chr(10)), 1 FROM cw WHERE doc_id % 4 = 2 AND w <> '')
SELECT path, name, kind, code, line FROM every WHERE length(code) >= 60""",
    "scan_tree": "SELECT * FROM (VALUES ('lib/ring.c', 'kept', 52), ('lib/_hidden.h', 'kept', 25), ('lib/table.h', 'generated', 10780), ('lib/table_short.h', 'kept', 10758), ('lib/nul.c', 'binary', 9), ('lib/empty.c', 'kept', 0)) AS t(path, disposition, length)",
    "pretoken_counts": f"WITH {PRETOKENS} SELECT word, count(*) AS n FROM pre GROUP BY 1",
    "identifier_tokens": f"WITH {TOK} SELECT doc_id, len(tokens) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM tok",
    "term_freq": f"WITH {TOK}, ex AS (SELECT doc_id, unnest(tokens) AS term FROM tok) SELECT doc_id, term, count(*) AS tf FROM ex GROUP BY ALL",
    "doc_stats": f"WITH {TOK} SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens, round(avg(len(tokens)), 6) AS avg_len FROM tok",
    "idf": f"WITH {TOK}, {POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_scores": f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score FROM bm",
    "bm25_topk": f"WITH {bm_top(10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM top",
    "l2_normalize": f"WITH {NORMED} SELECT vec_id, unnest(range(len(v))) AS pos, round(unnest(v), 6) AS x FROM nv",
    "cosine_scores": f"WITH {COS} SELECT query_id, doc_id, round(score, 6) AS score FROM cs",
    "cosine_distance": f"WITH {COS} SELECT query_id, doc_id, round(1 - score, 6) + 0.0 AS distance FROM cs",
    "knn_topk": f"WITH {knn(10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM nn",
    "knn_with_metadata": f"WITH {knn(10)} SELECT query_id, rank, doc_id, label, round(score, 6) AS score FROM nn JOIN embeddings e ON e.vec_id = nn.doc_id",
    "topk_global": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "topk_per_query": "SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5",
    "mean_pool": "WITH x AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, pos, round(avg(x), 6) AS mean FROM x GROUP BY ALL",
    "quantize_int8": "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS top FROM embeddings), z AS (SELECT *, CASE WHEN top > 0 THEN top / 127 ELSE 1.0 END AS scale FROM m) SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE / scale)::INT), ',') AS codes FROM z",
    "rrf": "WITH d AS (SELECT lang AS query_id, doc_id, n_chars, len(string_split(text, chr(10))) AS n FROM documents), one AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM d QUALIFY rank <= 100), two AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM d QUALIFY rank <= 100) SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL",
    "hybrid_independent": f"WITH {DENSE}, {bm_top(200)}, one AS (SELECT * FROM dense), two AS (SELECT query_id, doc_id, rank FROM top), {FUSE}",
    "hybrid_rerank": f"WITH {DENSE}, {POOLED}, {FUSE}",
    "search_dense": f"WITH {HASHED}, {shown('dense', 'score')}",
    "search_hybrid": f"WITH {HASHED}, {bm_top(200)}, one AS (SELECT query_id, doc_id, rank FROM dense), two AS (SELECT query_id, doc_id, rank FROM top), {FUSED}, {shown('best', 'rrf')}",
    "search_rerank": f"WITH {HASHED}, {POOLED}, {FUSED}, {shown('best', 'rrf')}",
    "gold_lookup": f"WITH {GOLD}, {DOCS} SELECT item_id, doc_id, path FROM gold JOIN docs USING (doc_id)",
    "resolvable_queries": f"WITH {GOLD} SELECT item_id, length(text) AS n FROM benchmark WHERE item_id IN (SELECT item_id FROM gold) ORDER BY item_id LIMIT 400",
    "eval_corpus_layout": "WITH p AS (SELECT row_number() OVER (ORDER BY a.conv_id, md5(a.text), md5(b.text)) - 1 AS pos, md5(a.text) AS x, md5(b.text) AS y FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn = 1) SELECT 'q' || pos AS query_id, 'p' AS side, 2 * pos AS doc, x AS digest FROM p UNION ALL SELECT 'q' || pos, 'n', 2 * pos + 1, y FROM p",
    "ir_metrics_closed": f"WITH {CLOSED} {closed('cr')}",
    "ir_metrics_dense": f"WITH {label_ranks(10)} {closed('lr')}",
    "ir_metrics_open": f"WITH {label_ranks(500)} SELECT {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}' for k in (1, 5, 10, 50, 100, 500))}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, floor(quantile_cont(rank, 0.5))::INT AS median_rank FROM lr",
    "metric_pivot": f"WITH {CLOSED}, c AS ({closed('cr')}), {label_ranks(10)}, n AS ({closed('lr')}), cl AS (UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE v), nl AS (UNPIVOT n ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, cl.v AS bm25, nl.v AS dense, round(nl.v - cl.v, 6) AS delta FROM cl JOIN nl USING (metric)",
    "line_density": f"WITH {LINES} SELECT doc_id, round(ratio, 9) AS ratio, n FROM dn",
    "drop_generated": f"WITH {LINES} SELECT doc_id FROM dn WHERE NOT (n >= 3 AND ratio >= 0.1)",
    "corpus_disposition": f"WITH {JUDGED} SELECT doc_id, disposition FROM jd",
    "corpus_summary": f"WITH {JUDGED} SELECT disposition, count(*) AS n, sum(length(text))::BIGINT AS chars FROM jd GROUP BY 1",
    "min_length_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 60",
    "kind_counts": "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1",
    "subsystem_key": "SELECT doc_id, source || '/' || lang AS subsystem FROM documents",
    "snippet": "SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 96) AS snippet FROM documents",
    "val_span": f"WITH {DOCS} SELECT DISTINCT source AS top FROM docs WHERE {VAL} < 100000 ORDER BY 1",
    "load_documents": "SELECT source AS path, md5(lower(text)) AS name, 'function' AS kind, 0 AS line, md5(text) AS code_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(lower(text)) ORDER BY doc_id) = 1",
    "index_info": "SELECT count(*) AS n_vectors, max(len(embedding)) AS width, sum(len(embedding) * 4)::BIGINT AS vector_bytes FROM embeddings",
    "dedup_prefix": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(substr(text, 1, 200)) ORDER BY doc_id) = 1",
    "hash_split_md5": f"WITH {DOCS} SELECT doc_id, {VAL} < 10000 AS val FROM docs",
    "split_summary": f"WITH {DOCS} SELECT {VAL} < 100000 AS val, count(*) AS n, count(DISTINCT source) AS n_top, sum(n_chars)::BIGINT AS chars FROM docs GROUP BY 1",
    "positional_split": f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {seeded(42, 'doc_id')}, doc_id) - 1 AS pos FROM documents) SELECT *, pos < 200 AS held_out FROM p",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {seeded(7, 'doc_id')}, doc_id) - 1 AS pos FROM documents",
    "window_chunks": f"WITH {DOCS}, l AS (SELECT path, doc_id, string_split(text, chr(10)) AS r FROM docs), s AS (SELECT path, doc_id, r, unnest(range(0, greatest(len(r) - 1, 1), 4)) AS pl FROM l), b AS (SELECT path, doc_id, pl + 1 AS line, array_to_string(list_slice(r, pl + 1, pl + 6), chr(10)) AS code FROM s WHERE pl = 0 OR pl + 2 < len(r)) SELECT path, doc_id || ':' || line AS name, 'window' AS kind, line, md5(code) AS code_md5 FROM b WHERE regexp_matches(code, '\\S')",
    "truncate_lines": f"WITH c AS (SELECT doc_id, {CUT8} AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c",
    "context_budget": f"WITH {HITS} SELECT query_id, rank, used FROM fit",
    "rag_prompt": f"WITH {HITS}, cx AS (SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS c FROM fit GROUP BY 1), pr AS (SELECT query_id, 'Answer from the excerpts alone.' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Question: ' || text || chr(10) AS p FROM cx JOIN benchmark ON item_id = query_id) SELECT query_id, length(p) AS n, md5(p) AS digest FROM pr",
    "hard_negatives": f"WITH rows AS (SELECT doc_id AS i, source || '/' || lang AS path, substr(text, 1, 20) AS name, text FROM documents), {ring('near', 'path')}, {ring('wide', 'path')}, ch AS (SELECT i, j, 0 AS tier FROM near UNION ALL SELECT i, j, 1 FROM wide WHERE i NOT IN (SELECT i FROM near)) SELECT ch.i, ch.j, tier, md5(r.text) AS negative_md5 FROM ch JOIN rows r ON r.i = ch.j",
    "grouped_batches": f"WITH r AS (SELECT doc_id AS i, source || '/' || lang AS g, {seeded(42, 'doc_id')} AS h FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY h, i) - 1 AS pl FROM r), t AS (SELECT i, row_number() OVER (ORDER BY h, i) - 1 AS pos FROM n WHERE pl >= n // 16 * 16) SELECT i, g || '#' || pl // 16 AS batch, pl % 16 AS place, true AS full FROM n WHERE pl < n // 16 * 16 UNION ALL SELECT i, 'tail#' || pos // 16, pos % 16, false FROM t",
    "distinct_batches": f"WITH c AS (SELECT doc_id AS i, {seeded(42, 'doc_id')} AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY {seeded(42, 'doc_id')}, doc_id) AS layer FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY h, i) - 1 AS pos FROM c) SELECT i, layer || '#' || pos // 16 AS batch FROM p",
    "infonce": f"WITH {SCORES}, l AS ({NCE.format('sc')}) SELECT round(loss, 6) AS loss FROM l",
    "infonce_hard": f"WITH {NORMED}, v AS (SELECT vec_id AS id, vec_id // 2 AS i, vec_id // 32 AS batch, v FROM nv), c AS (SELECT batch, i AS j, v FROM v WHERE id % 2 = 1 UNION ALL SELECT batch, -1 - (i - 1), v FROM v WHERE id % 2 = 1 AND (i - 1) // 16 = batch AND i > 0), sc AS (SELECT a.batch, a.i, c.j, 20 * list_dot_product(a.v, c.v) AS s FROM v a JOIN c USING (batch) WHERE a.id % 2 = 0), l AS ({NCE.format('sc')}) SELECT round(loss / 4, 6) AS loss FROM l",
    "metric_filter": "WITH k AS (SELECT source || '_' || lang || '_' || (['Accuracy@1', 'MRR@10', 'loss', 'recall@100', 'NDCG@10', 'steps'])[doc_id % 6 + 1] AS key, n_chars AS value FROM documents), m AS (SELECT key, max(value) AS value FROM k GROUP BY 1) SELECT lower(string_split(key, '_')[-1]) AS metric, arg_max(value, key) AS value FROM m WHERE lower(string_split(key, '_')[-1]) IN ('accuracy@1', 'accuracy@5', 'mrr@10', 'ndcg@10', 'recall@10') GROUP BY 1",
    "rag_ask": f"WITH {HASHED}, {POOLED}, {FUSED}, {DOCS}, hits AS (SELECT query_id, rank, '[' || rank || '] ' || path || ':1  (' || lang || ' d' || doc_id || ')' || chr(10) || '```c' || chr(10) || text || chr(10) || '```' || chr(10) AS block FROM best JOIN docs USING (doc_id) WHERE rank <= 10), used AS (SELECT *, (sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used FROM hits), fit AS (SELECT * FROM used WHERE used <= 12000 OR rank = 1), cx AS (SELECT query_id, count(*)::INT AS n_blocks, string_agg(block, chr(10) ORDER BY rank) AS c FROM fit GROUP BY 1), pr AS (SELECT query_id, n_blocks, 'Answer from the excerpts alone.' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Question: ' || text || chr(10) AS p FROM cx JOIN benchmark ON item_id = query_id) SELECT query_id, n_blocks, length(p) AS n, md5(p) AS digest FROM pr",
    "gist_loss": f"WITH {SCORES}, kept AS (SELECT sc.* FROM sc JOIN own USING (batch, i) WHERE i = j OR NOT gs > o), a AS ({NCE.format('sc')}), b AS ({NCE.format('kept')}) SELECT round(a.loss, 6) AS infonce, round(b.loss, 6) AS gist, round(0.6 * b.loss + 0.4 * a.loss, 6) AS total FROM a, b",
    "perplexity": "SELECT round(avg(n_chars % 97 / 100), 6) AS loss, round(exp(avg(n_chars % 97 / 100)), 6) AS perplexity FROM documents",
    "vocab_equality": f"WITH w AS (SELECT source, unnest({toks('text')}) AS t FROM documents), a AS (SELECT DISTINCT t FROM w WHERE source = 'src0'), b AS (SELECT DISTINCT t FROM w WHERE source = 'src1'), c AS (SELECT count(*) AS n_different FROM a FULL JOIN b ON a.t = b.t WHERE a.t IS NULL OR b.t IS NULL) SELECT n_different, n_different = 0 AS equal FROM c",
    "pack_offsets": f"WITH {IDS} SELECT doc_id, len(ids) AS n, start FROM pk",
    "token_windows": f"WITH {WINDOWS} SELECT \"window\", len(list_filter(ids, lambda x: x < 5)) AS n_special, array_to_string(ids, ',') AS ids FROM win",
    "mlm_mask": f"WITH {WINDOWS}, e AS (SELECT \"window\" AS w, unnest(range(128)) AS p, unnest(ids) AS id FROM win), m AS (SELECT *, id >= 5 AND {draw('a')} < {int(0.15 * 16**7)} AS dr, CASE WHEN {draw('b')} < {int(0.8 * 16**7)} THEN 4 WHEN {draw('b')} < {int(0.9 * 16**7)} THEN 5 + {draw('c')} % 32763 ELSE id END AS nw FROM e) SELECT w AS \"window\", string_agg(CASE WHEN dr THEN nw ELSE id END, ',' ORDER BY p) AS input_ids, string_agg(CASE WHEN dr THEN id ELSE -100 END, ',' ORDER BY p) AS labels FROM m GROUP BY w",
    "linspace_sample": f"WITH {WINDOWS}, c AS (SELECT count(*) AS n FROM win), pl AS (SELECT DISTINCT floor(i * ((n - 1)::DOUBLE / (least(n, 64) - 1)))::BIGINT AS \"window\" FROM c, range(64) t(i) WHERE i < least(n, 64)) SELECT \"window\", ids[1] AS first_id FROM win JOIN pl USING (\"window\")",
}
