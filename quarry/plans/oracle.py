"""DuckDB twins of the driver queries (tables are pre-registered views).

Column names equal the Spark query columns. Doubles are rounded the
same way on both sides.
"""

_KNN_PAIRS = """
  SELECT q.vec_id AS query_id, i.vec_id AS item_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score,
         q.label = i.label AS relevant
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id {extra}
"""

_KNN_RANKED = """
WITH pairs AS ({pairs}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM pairs)
"""

TOPK_METRICS = _KNN_RANKED.format(pairs=_KNN_PAIRS.format(extra="")) + """,
cut AS (SELECT * FROM ranked WHERE rank <= 5),
nt AS (SELECT e.vec_id AS query_id, c.n - 1 AS n_true
       FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c
       USING (label)),
pq AS (SELECT query_id, count(DISTINCT item_id) AS n_ret,
              count(DISTINCT CASE WHEN relevant THEN item_id END) AS tp,
              min(CASE WHEN relevant THEN rank END) AS first_hit
       FROM cut GROUP BY query_id),
s AS (SELECT pq.*, tp::DOUBLE / n_ret AS p, tp::DOUBLE / n_true AS r
      FROM pq JOIN nt USING (query_id) WHERE n_true > 0)
SELECT round(coalesce(avg(p), 0), 4) AS precision,
       round(coalesce(avg(r), 0), 4) AS recall,
       round(coalesce(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 0), 4) AS f1,
       round(coalesce(avg(coalesce(1.0 / first_hit, 0)), 0), 4) AS mrr,
       round(coalesce(avg(CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END), 0), 4) AS topk_accuracy,
       count(*) AS n_queries
FROM s
"""

KNN_JOIN_EXACT = _KNN_RANKED.format(pairs=_KNN_PAIRS.format(extra="")) + """
SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 5
"""

KNN_BY_KEY = _KNN_RANKED.format(pairs=_KNN_PAIRS.format(extra="AND q.label = i.label")) + """
SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 5
"""

ORACLE_SQL = {
    "topk_metrics": TOPK_METRICS,
    "knn_join_exact": KNN_JOIN_EXACT,
    "knn_by_key": KNN_BY_KEY,
}


# ---------------------------------------------------------------------------
# Fixed values, spelled once more in RE2's dialect (`.` stops at `\\n`), so
# that a wrong constant in the package is not wrong on both sides.

_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_IDENT = "[a-zA-Z_][a-zA-Z_0-9]*"
_WORD_RUN = r"[\p{L}\p{N}_]+"
_TYPE_PHRASE = rf"(?:^|[^\p{{L}}\p{{N}}_])({_IDENT}[{_WS}]*:[{_WS}]*[\p{{L}}\p{{N}}_]+)"
_DOC_TOKEN = (r"[^" + _WS + r",'\"`.():\[\]=*;>{\}+-/\\]+|\\+|\.+|\(\)|\{\}|\[\]|\(+|\)+|:+|\[+|\]+"
              r"|\{+|\}+|=+|\*+|;+|>+|\++|-+|/+")
_PATCH_DEF = rf"[{_WS}]*def[{_WS}]+({_IDENT})[{_WS}]*\(.*\):"
_PATCH_CLASS = rf"[{_WS}]*class[{_WS}]+({_IDENT})[{_WS}]*\(.*\):"
_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before
being below between both but by can did do does doing down during each few for from
further had has have having he her here hers herself him himself his how i if in into
is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the
their theirs them themselves then there these they this those through to too under
until up very was we were what when where which while who whom why will with you your
yours yourself yourselves
""".split()
_PROMPT = (
    "### Task\n"
    "Rewrite the issue below into a search query that retrieves the functions "
    "a fix will touch. Use the tag context when it helps.\n\n"
    "### Issue\n{issue}\n\n"
    "### Tag context\n{context}\n\n"
    "Return only the rewritten query.\n"
)


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_STOPS = "[" + ", ".join("'" + w + "'" for w in _STOP_WORDS) + "]"
_IDENTIFIERS = (f"list_filter(regexp_extract_all(text, {_lit(_WORD_RUN)}), "
                f"lambda w: regexp_full_match(w, {_lit(_IDENT)}))")
_TYPES = (f"list_filter(regexp_extract_all(text, {_lit(_TYPE_PHRASE)}, 1), "
          f"lambda w: regexp_full_match(w, {_lit(_IDENT + '[' + _WS + ']*:[' + _WS + ']*' + _IDENT)}))")

DOCSTRING_TOKENS = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(text, {_lit(_DOC_TOKEN)}) AS t FROM documents)
"""

KEYWORDS = f"""
WITH k AS (
  SELECT doc_id,
         list_sort(list_filter(list_distinct(list_concat({_IDENTIFIERS}, {_TYPES})),
                               lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, lower(w)))) AS kw
  FROM documents)
SELECT doc_id, len(kw) AS n_keywords, md5(array_to_string(kw, '|')) AS keywords_md5 FROM k
"""

_FOLDED = """
  SELECT doc_id, source || ':' || doc_id::VARCHAR AS hash_key,
         ('0x' || right(md5(source || ':' || doc_id::VARCHAR), 4))::INTEGER AS hash_val
  FROM documents
"""

FOLD_LABELS = f"""
SELECT doc_id, hash_key, hash_val,
       CASE WHEN hash_val <= 39321 THEN 'train' WHEN hash_val <= 49151 THEN 'valid'
            WHEN hash_val <= 58981 THEN 'test' ELSE 'holdout' END AS partition
FROM ({_FOLDED})
"""

FOLD_SUMMARY = f"""
SELECT partition, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS pct
FROM ({FOLD_LABELS}) GROUP BY partition
"""

NEGATIVES_SAMPLE = """
WITH r AS (SELECT d.doc_id, coalesce(l.quality, 0) AS relevance
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, relevance FROM r
WHERE relevance = 1
   OR ('0x' || substr(md5('42' || doc_id::VARCHAR), 26, 7))::BIGINT / 268435456.0 < 0.1
"""

SHUFFLED_ORDER = """
SELECT doc_id, row_number() OVER (ORDER BY md5('20181026' || doc_id::VARCHAR), doc_id) - 1 AS pos
FROM documents
"""

EXACT_DEDUP = """
SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text
"""

NEAR_DEDUP = f"""
WITH RECURSIVE
toks AS (SELECT doc_id, lang, unnest({_IDENTIFIERS}) AS tok FROM documents),
cnt AS (SELECT doc_id, lang, tok, count(*) AS c FROM toks GROUP BY ALL),
docs AS (SELECT doc_id, lang, count(*) AS n, sum(c) AS total FROM cnt GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT cnt.* FROM cnt JOIN docs USING (doc_id)),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, sum(least(a.c, b.c)) AS m
          FROM c2 a JOIN c2 b ON a.lang = b.lang AND a.tok = b.tok AND a.doc_id < b.doc_id
          GROUP BY ALL),
edges AS (SELECT a, b FROM inter
          JOIN docs da ON da.doc_id = inter.a JOIN docs db ON db.doc_id = inter.b
          WHERE 5 * i >= 4 * (da.n + db.n - i) AND 10 * m >= 7 * (da.total + db.total - m)),
und AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(node, label) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT und.b, reach.label FROM reach JOIN und ON reach.node = und.a)
SELECT node AS doc_id, min(label) AS cluster_id, node = min(label) AS kept
FROM reach GROUP BY node
"""

_REQUESTS = """
  SELECT p_partkey AS request_id,
         'acme/' || lower(replace(p_brand, '#', '')) AS repo,
         md5(p_brand || ':' || (p_partkey // 1000)::VARCHAR) AS base_commit,
         concat_ws(chr(10),
           '@@ -1,3 +1,4 @@ def ' || split_part(p_name, ' ', 1) || '(self):',
           '-    def ' || replace(p_name, ' ', '_') || '(a):',
           '+    def ' || replace(p_name, ' ', '_') || '_v' || p_size::VARCHAR || '(a, b):',
           '+    def typed_' || replace(p_name, ' ', '_') || '(x) -> int:',
           '+class ' || p_type || '(Base):',
           '+class Plain' || p_size::VARCHAR || ':',
           '+def multi_' || replace(p_name, ' ', '_') || '(',
           '+    a):',
           '+ undef ' || split_part(p_name, ' ', 2) || '(x):') AS patch,
         'Fix ' || p_name || ' handling for ' || p_type || ' parts of size ' || p_size::VARCHAR
           AS problem_statement
  FROM part
"""

PATCH_LABELS = f"""
SELECT request_id, string_split(repo, '/')[-1] || '_' || base_commit AS save_path,
       array_to_string(regexp_extract_all(patch, {_lit(_PATCH_DEF)}, 1), ',') AS functions,
       array_to_string(regexp_extract_all(patch, {_lit(_PATCH_CLASS)}, 1), ',') AS classes
FROM ({_REQUESTS})
"""

_PARSED = """
  SELECT p_partkey AS request_id,
         CASE WHEN p_size <= 10 THEN '' ELSE replace(p_name, ' ', '_') || ',' || split_part(p_name, ' ', 1) END
           AS functions,
         CASE WHEN p_size > 40 OR p_size <= 5 THEN '' ELSE p_type END AS classes,
         CASE WHEN p_size <= 10 THEN 0 ELSE 2 END::BIGINT AS n_functions,
         CASE WHEN p_size > 40 OR p_size <= 5 THEN 0 ELSE 1 END::BIGINT AS n_classes
  FROM part WHERE p_size > 5
"""

PARSE_LABEL = f"SELECT * FROM ({_PARSED})"

LABEL_STATS = f"""
SELECT round(avg(n_functions), 6) AS n_functions_mean, round(stddev_samp(n_functions), 6) AS n_functions_std,
       max(n_functions) AS n_functions_max, min(n_functions) AS n_functions_min,
       round(avg(n_classes), 6) AS n_classes_mean, round(stddev_samp(n_classes), 6) AS n_classes_std,
       max(n_classes) AS n_classes_max, min(n_classes) AS n_classes_min
FROM ({_PARSED})
"""

LABEL_ARGMAX = f"""
WITH pl AS ({_PARSED})
SELECT request_id, n_functions + n_classes AS n_total FROM pl
WHERE n_functions + n_classes = (SELECT max(n_functions + n_classes) FROM pl)
"""

_LABEL_TEXTS = """
  SELECT p_partkey AS request_id,
         '(' || CASE WHEN p_size <= 10 THEN '[]'
                     ELSE '[''' || replace(p_name, ' ', '_') || ''', ''' || split_part(p_name, ' ', 1) || ''']' END
         || ', ' || CASE WHEN p_size > 40 OR p_size <= 5 THEN '[]' ELSE '[''' || p_type || ''']' END || ')'
           AS label_text,
         'Fix ' || p_name || ' handling for ' || p_type || ' parts of size ' || p_size::VARCHAR
           AS problem_statement
  FROM part
"""

ONE_PER_QUERY = f"""
SELECT problem_statement, min(request_id) AS request_id, arg_min(label_text, request_id) AS label_text
FROM ({_LABEL_TEXTS}) GROUP BY problem_statement
"""

COUNT_SUMMARIES = """
SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'distinct_source', NULL, count(DISTINCT source) FROM documents
UNION ALL SELECT 'total', NULL, count(*) FROM documents
"""

_REL = """
ann AS (SELECT d.lang AS Language, d.source AS Query, d.doc_id::VARCHAR AS GitHubUrl,
               l.quality AS Relevance
        FROM labels l JOIN documents d USING (doc_id)),
mean AS (SELECT Query, Language, GitHubUrl, avg(Relevance::DOUBLE) AS rel FROM ann GROUP BY ALL),
rel AS (SELECT language, query, url, relevance FROM (
          SELECT lower(Language) AS language, lower(Query) AS query, GitHubUrl AS url, rel AS relevance,
                 row_number() OVER (PARTITION BY lower(Language), lower(Query), GitHubUrl
                                    ORDER BY Query DESC, Language DESC) AS o
          FROM mean) WHERE o = 1),
pred AS (SELECT lang AS language, source AS query, doc_id::VARCHAR AS url,
                row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank
         FROM documents),
cut AS (SELECT * FROM (
          SELECT lower(language) AS language, lower(query) AS query, url,
                 row_number() OVER (PARTITION BY lower(language), lower(query)
                                    ORDER BY rank, language, query, url) AS pos
          FROM pred) WHERE pos <= 300),
langs AS (SELECT DISTINCT language FROM cut)
"""

RELEVANCE_MEAN = f"WITH {_REL} SELECT language, query, url, round(relevance, 6) AS relevance FROM rel"

COVERAGE = f"""
WITH {_REL},
cov AS (SELECT r.language, count(*) AS n_ann, count(c.url) AS n_cov,
               count(*) FILTER (WHERE r.relevance > 0) AS n_ann_pos,
               count(c.url) FILTER (WHERE r.relevance > 0) AS n_cov_pos
        FROM rel r LEFT JOIN (SELECT DISTINCT language, query, url FROM cut) c USING (language, query, url)
        GROUP BY r.language)
SELECT l.language, round(n_cov::DOUBLE / nullif(n_ann, 0), 6) AS coverage_all,
       round(n_cov_pos::DOUBLE / nullif(n_ann_pos, 0), 6) AS coverage_positive
FROM langs l LEFT JOIN cov USING (language)
"""

_NDCG = """
WITH {rel},
hits AS (SELECT c.*, r.relevance FROM cut c JOIN rel r USING (language, query, url)),
ranked AS (SELECT *, {rank} AS r FROM hits),
dcg AS (SELECT language, query, sum((pow(2, relevance) - 1) / log2(r + 1)) AS dcg FROM ranked GROUP BY ALL),
ideal AS (SELECT language, query, sum((pow(2, relevance) - 1) / log2(i + 1)) AS idcg FROM (
            SELECT *, row_number() OVER (PARTITION BY language, query ORDER BY relevance DESC) AS i FROM rel)
          GROUP BY ALL),
pq AS (SELECT i.language, i.query, coalesce(d.dcg, 0) / i.idcg AS v
       FROM ideal i LEFT JOIN dcg d USING (language, query) WHERE i.idcg <> 0)
SELECT l.language, round(sum(pq.v) / nullif(count(pq.v), 0), 6) AS {name}
FROM langs l LEFT JOIN pq USING (language) GROUP BY l.language
"""

NDCG_ANNOTATED = _NDCG.format(rel=_REL, name="ndcg",
                              rank="row_number() OVER (PARTITION BY language, query ORDER BY pos)")
NDCG_FULL = _NDCG.format(rel=_REL, name="ndcg_full", rank="pos")

ORACLE_SQL.update({
    "docstring_tokens": DOCSTRING_TOKENS,
    "keywords": KEYWORDS,
    "fold_labels": FOLD_LABELS,
    "fold_summary": FOLD_SUMMARY,
    "negatives_sample": NEGATIVES_SAMPLE,
    "shuffled_order": SHUFFLED_ORDER,
    "exact_dedup": EXACT_DEDUP,
    "near_dedup": NEAR_DEDUP,
    "patch_labels": PATCH_LABELS,
    "parse_label": PARSE_LABEL,
    "label_stats": LABEL_STATS,
    "label_argmax": LABEL_ARGMAX,
    "one_per_query": ONE_PER_QUERY,
    "count_summaries": COUNT_SUMMARIES,
    "relevance_mean": RELEVANCE_MEAN,
    "coverage": COVERAGE,
    "ndcg_annotated": NDCG_ANNOTATED,
    "ndcg_full": NDCG_FULL,
})


# ---------------------------------------------------------------------------
# Keyword context, prompts, rewriting: brute force over every
# (issue, tag line) pair of a snapshot.

_KW = (f"list_sort(list_filter(list_distinct(list_concat({_IDENTIFIERS}, {_TYPES})), "
       f"lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, lower(w))))")
_LINE_IDS = _IDENTIFIERS.replace("text", "pattern")

_MATCH = f"""
req AS (SELECT doc_id AS request_id, source || '@' || (doc_id // 1000)::VARCHAR AS save_path, text, {_KW} AS kw FROM documents),
lines AS (SELECT source || '@' || (doc_id // 1000)::VARCHAR AS save_path, doc_id::VARCHAR AS path, string_split(text, chr(10)) AS ls FROM documents),
tags AS (SELECT save_path, path, line, ls[line] AS pattern
         FROM (SELECT save_path, path, ls, unnest(generate_series(1, len(ls))) AS line FROM lines)),
tags2 AS (SELECT save_path, path, line::BIGINT AS line, coalesce(list_extract({_LINE_IDS}, 1), '') AS name, pattern
          FROM tags WHERE NOT contains(pattern, 'test') AND NOT contains(pattern, 'Test')),
hits AS (SELECT r.request_id, t.path, t.line, t.name, t.pattern,
                len(list_filter(r.kw, lambda k: contains(t.pattern, k))) AS hits
         FROM req r JOIN tags2 t USING (save_path) WHERE len(r.kw) > 0),
top AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, path, line, name) AS rank
          FROM hits WHERE hits >= 3) WHERE rank <= 10)
"""

TAG_CONTEXT = f"WITH {_MATCH} SELECT request_id, rank, path, line, hits FROM top"

_before, _rest = _PROMPT.split("{issue}", 1)
_middle, _after = _rest.split("{context}", 1)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PROMPTS = f"""
ctx AS (SELECT request_id,
               string_agg(path || ':' || line::VARCHAR || ': ' || pattern || ' (' || hits::VARCHAR || ')',
                          chr(10) ORDER BY rank) AS context
        FROM top GROUP BY request_id),
prompts AS (SELECT r.request_id,
                   {_q(_before)} || r.text || {_q(_middle)} || coalesce(c.context, '') || {_q(_after)} AS prompt
            FROM req r LEFT JOIN ctx c USING (request_id) WHERE len(r.kw) > 0)
"""

PROMPT_TABLE = f"WITH {_MATCH}, {_PROMPTS} SELECT request_id, prompt FROM prompts"

ORACLE_SQL.update({
    "tag_context": TAG_CONTEXT,
    "prompt_table": PROMPT_TABLE,
})


# ---------------------------------------------------------------------------
# Source parsing: closed forms of the generated modules.

_MOD = '''
  SELECT p_partkey::VARCHAR AS k, p_size::VARCHAR AS s, p_size, p_type, p_name,
         (p_type IN ('SMALL', 'STANDARD'))::BIGINT AS x, (p_type = 'SMALL')::BIGINT AS deco,
         'acme/' || lower(replace(p_brand, '#', '')) AS repo,
         CASE WHEN p_type = 'PROMO' THEN 'tests/test_mod_' || p_partkey::VARCHAR || '.py'
              ELSE 'pkg/mod_' || p_partkey::VARCHAR || '.py' END AS path
  FROM part
'''


def _tabs(sql: str) -> str:
    return f"CASE WHEN p_type = 'LARGE' THEN replace({sql}, '    ', chr(9)) ELSE {sql} END"


def _raw(sql: str) -> str:
    return (f"CASE WHEN p_type = 'LARGE' THEN replace({sql}, '    ', chr(9)) "
            f"WHEN p_type = 'ECONOMY' THEN replace({sql}, chr(10), chr(13) || chr(10)) ELSE {sql} END")


_Q = '"""'
_ABOVE = ("CASE p_type WHEN 'SMALL' THEN '' WHEN 'STANDARD' THEN chr(10) || chr(10) || '# priced by size' || chr(10) "
          "ELSE chr(10) || chr(10) END")
_PRICE_CODE = _tabs(_ABOVE + " || 'def price_' || k || '(x):' || chr(10) || '    " + _Q + "Compute the retail price quickly." + _Q + "' "
                    "|| chr(10) || '    # scale by the size' || chr(10) || '    return x * ' || s")
_SIZE_CODE = _tabs("'def size_' || k || '(self):' || chr(10) || '    " + _Q + "Return the size of the part." + _Q + "' || chr(10) "
                   "|| '    total = ' || s || chr(10) || '    return total'")

EXTRACT_FUNCTIONS = f'''
WITH m AS ({_MOD} WHERE p_size <= 45)
SELECT repo, path, 'price_' || k AS func_name, 17 + x AS lineno, 'python' AS language,
       {_PRICE_CODE} AS code, '"""Compute the retail price quickly."""' AS docstring
FROM m WHERE p_size <= 25
UNION ALL
SELECT repo, path, 'size_' || k, 7::BIGINT, 'python', {_SIZE_CODE}, '"""Return the size of the part."""'
FROM m
'''

_DOC_PRICE = ("CASE WHEN p_size > 25 THEN '" + _Q + "Price." + _Q + "' ELSE '" + _Q
              + "Compute the retail price quickly." + _Q + "' END")
_CLASS_BODY = _raw("'" + _Q + "Holds ' || p_name || CASE WHEN p_type = 'MEDIUM' THEN ' größere — 部品' ELSE '' END || ' parts." + _Q + "' "
                   "|| chr(10) || chr(10) || '    def size_' || k || '(self):' || chr(10) "
                   "|| '        " + _Q + "Return the size of the part." + _Q + "' || chr(10) || '        total = ' || s || chr(10) "
                   "|| '        return total' || chr(10) || chr(10) || '    def test_' || k || '(self):' || chr(10) "
                   "|| '        " + _Q + "A test method that is skipped." + _Q + "' || chr(10) || '        return None'")
_SIZE_BODY = _raw("'" + _Q + "Return the size of the part." + _Q + "' || chr(10) || '        total = ' || s || chr(10) || '        return total'")
_TEST_BODY = _raw("'" + _Q + "A test method that is skipped." + _Q + "' || chr(10) || '        return None'")
_PRICE_BODY = _raw(f"{_DOC_PRICE} || chr(10) || '    # scale by the size' || chr(10) || '    return x * ' || s")

EXTRACT_DEFINITIONS = f'''
WITH m AS ({_MOD} WHERE p_size <= 45)
SELECT path, 'class' AS kind, p_type || 'Widget' || k AS name, 4::BIGINT AS start_line, 14::BIGINT AS end_line,
       {_CLASS_BODY} AS body
FROM m
UNION ALL
SELECT path, 'function', 'size_' || k, 7, 10, {_SIZE_BODY} FROM m
UNION ALL
SELECT path, 'function', 'test_' || k, 12, 14, {_TEST_BODY} FROM m
UNION ALL
SELECT path, 'function', 'price_' || k, 17 + x - deco, 20 + x, {_PRICE_BODY} FROM m
UNION ALL
SELECT path, 'function', 'tiny_' || k, 23 + x, 24 + x, 'return 1' FROM m
'''

BUILD_TAGS = f'''
WITH m AS ({_MOD} WHERE p_type <> 'PROMO' AND p_size <= 45)
SELECT path, 'class' AS kind, p_type || 'Widget' || k AS name, 4::BIGINT AS line, 14::BIGINT AS "end",
       '/^class ' || p_type || 'Widget' || k || '(Base):$/' AS pattern FROM m
UNION ALL SELECT path, 'function', 'size_' || k, 7, 10, {_tabs("'/^    def size_' || k || '(self):$/'")} FROM m
UNION ALL SELECT path, 'function', 'test_' || k, 12, 14, {_tabs("'/^    def test_' || k || '(self):$/'")} FROM m
UNION ALL SELECT path, 'function', 'price_' || k, 17 + x - deco, 20 + x, '/^def price_' || k || '(x):$/' FROM m
UNION ALL SELECT path, 'function', 'tiny_' || k, 23 + x, 24 + x, '/^def tiny_' || k || '():$/' FROM m
'''

CODE_TOKENS = f'''
WITH m AS ({_MOD} WHERE p_size <= 45)
SELECT path, 'price_' || k AS func_name, 10::BIGINT AS n_code_tokens,
       'def price_' || k || ' ( x ) : return x * ' || s AS code_tokens,
       'scale by the size' AS comment_tokens
FROM m WHERE p_size <= 25
UNION ALL
SELECT path, 'size_' || k, 11::BIGINT, 'def size_' || k || ' ( self ) : total = ' || s || ' return total', ''
FROM m
'''

ORACLE_SQL.update({
    "extract_functions": EXTRACT_FUNCTIONS,
    "extract_definitions": EXTRACT_DEFINITIONS,
    "build_tags": BUILD_TAGS,
    "code_tokens": CODE_TOKENS,
})


# ---------------------------------------------------------------------------
# Sources and sinks: what was written must come back unchanged.

IO_ROUNDTRIP = f"""
WITH f AS ({FOLD_LABELS})
SELECT f.doc_id, f.partition, f.partition AS pq_partition, md5(d.text) AS text_md5, md5(d.text) AS chunk_md5
FROM f JOIN documents d USING (doc_id)
"""

IO_BLOBS_CSV = """
SELECT source AS repo, doc_id::VARCHAR AS path, md5(text) AS content_md5, length(text)::BIGINT AS n_chars
FROM documents
"""

IO_SOURCES = EXTRACT_DEFINITIONS.replace("SELECT path,", "SELECT repo || '/' || path AS file,")

IO_TAGS = BUILD_TAGS.replace("SELECT path,", "SELECT repo AS save_path, path,")

IO_ANNOTATIONS = f"SELECT language, coverage_all FROM ({COVERAGE})"

IO_REQUESTS = f"""
WITH r AS ({_REQUESTS})
SELECT string_split(repo, '/')[-1] || '_' || base_commit AS save_path, md5(patch) AS patch_md5,
       array_to_string(regexp_extract_all(patch, {_lit(_PATCH_DEF)}, 1), ',') AS functions,
       array_to_string(regexp_extract_all(patch, {_lit(_PATCH_CLASS)}, 1), ',') AS classes
FROM r
"""

ORACLE_SQL.update({
    "io_roundtrip": IO_ROUNDTRIP,
    "io_blobs_csv": IO_BLOBS_CSV,
    "io_sources": IO_SOURCES,
    "io_tags": IO_TAGS,
    "io_annotations": IO_ANNOTATIONS,
    "io_requests": IO_REQUESTS,
})


_PAIR_TABLES = f"""
r AS (
  SELECT request_id, problem_statement, string_split(repo, '/')[-1] || '_' || base_commit AS save_path,
         regexp_extract_all(patch, {_lit(_PATCH_DEF)}, 1) AS functions,
         regexp_extract_all(patch, {_lit(_PATCH_CLASS)}, 1) AS classes
  FROM ({_REQUESTS})),
d AS (
  SELECT *, row_number() OVER (PARTITION BY save_path ORDER BY file, start_line, kind, name) - 1 AS idx FROM (
  SELECT lower(replace(p_brand, '#', '')) || '_' || md5(p_brand || ':' || (p_partkey // 1000)::VARCHAR) AS save_path,
         'function' AS kind, replace(p_name, ' ', '_') AS name, '    return ' || p_partkey::VARCHAR AS body,
         'mod' || p_size::VARCHAR || '.py' AS file, p_partkey AS start_line FROM part
  UNION ALL
  SELECT lower(replace(p_brand, '#', '')) || '_' || md5(p_brand || ':' || (p_partkey // 1000)::VARCHAR), 'class', p_type,
         '    size = ' || p_size::VARCHAR, 'mod' || p_size::VARCHAR || '.py', p_partkey FROM part)),
pos AS (
  SELECT r.request_id, d.kind, d.save_path || '#' || d.name AS GitHubUrl, 1 AS Relevance, problem_statement, d.body
  FROM r JOIN d USING (save_path)
  WHERE (d.kind = 'function' AND list_contains(r.functions, d.name))
     OR (d.kind = 'class' AND list_contains(r.classes, d.name)))
"""

_PAIR_COLUMNS = """request_id, kind, 'Python' AS Language, md5(problem_statement) AS query_md5, GitHubUrl, Relevance,
       '' AS Notes, md5(body) AS code_md5"""

PAIR_POSITIVES = f"WITH {_PAIR_TABLES} SELECT {_PAIR_COLUMNS} FROM pos"

# Negatives: every request skips through its snapshot's definitions by gaps
# ln(u) / ln(1 - p), which is a coin of chance p for each definition.
BUILD_PAIRS = f"""
WITH RECURSIVE {_PAIR_TABLES},
sizes AS (SELECT save_path, count(*) AS n FROM d GROUP BY save_path),
walk(request_id, save_path, n, j, idx) AS (
  SELECT request_id, save_path, n, 0, floor(ln((('0x' || substr(md5('7:' || request_id::VARCHAR || ':0'), 1, 13))::BIGINT + 1)
         / 4503599627370496.0::DOUBLE) / ln(0.9::DOUBLE))::BIGINT
  FROM r JOIN sizes USING (save_path) WHERE len(functions) > 0 OR len(classes) > 0
  UNION ALL
  SELECT request_id, save_path, n, j + 1, idx + 1 + floor(ln((('0x' || substr(md5('7:' || request_id::VARCHAR || ':'
         || (j + 1)::VARCHAR), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / ln(0.9::DOUBLE))::BIGINT
  FROM walk WHERE idx < n),
neg AS (
  SELECT r.request_id, d.kind, d.save_path || '#' || d.name AS GitHubUrl, 0 AS Relevance, problem_statement, d.body
  FROM walk JOIN r ON r.request_id = walk.request_id JOIN d ON d.save_path = walk.save_path AND d.idx = walk.idx
  WHERE NOT (d.kind = 'function' AND list_contains(r.functions, d.name))
    AND NOT (d.kind = 'class' AND list_contains(r.classes, d.name)))
SELECT {_PAIR_COLUMNS} FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)
"""

ORACLE_SQL.update({"pair_positives": PAIR_POSITIVES, "build_pairs": BUILD_PAIRS})


STREAM_CORPUS = f"""
WITH f AS ({EXTRACT_FUNCTIONS}),
h AS (SELECT *, ('0x' || right(md5(repo || ':' || path), 4))::INTEGER AS hash_val FROM f)
SELECT repo, path, func_name, lineno,
       CASE WHEN hash_val <= 39321 THEN 'train' WHEN hash_val <= 49151 THEN 'valid'
            WHEN hash_val <= 58981 THEN 'test' ELSE 'holdout' END AS partition,
       hash_val,
       CASE WHEN func_name LIKE 'price%' THEN 10 ELSE 11 END::BIGINT AS n_code_tokens,
       CASE WHEN func_name LIKE 'price%' THEN 6 ELSE 7 END::BIGINT AS n_docstring_tokens
FROM h
"""

ORACLE_SQL.update({"stream_corpus": STREAM_CORPUS})


EXTRACT_DEFINITIONS_NO_METHODS = f"""
SELECT * FROM ({EXTRACT_DEFINITIONS}) WHERE NOT (kind = 'function' AND (name LIKE 'size\\_%' ESCAPE '\\'
                                                                   OR name LIKE 'test\\_%' ESCAPE '\\'))
"""

EXTRACTION_SUMMARY = f"""
WITH m AS ({_MOD})
SELECT repo, count(*) AS n_blobs,
       (count(*) FILTER (WHERE p_size <= 45) + count(*) FILTER (WHERE p_size <= 25))::BIGINT AS n_functions
FROM m GROUP BY ROLLUP (repo)
"""

ORACLE_SQL.update({
    "extract_definitions_no_methods": EXTRACT_DEFINITIONS_NO_METHODS,
    "extraction_summary": EXTRACTION_SUMMARY,
})


# ---------------------------------------------------------------------------
# Hashing encoder, deep search, evaluation reports.

_VECTORS = """
{n}_t AS (SELECT {key} AS id, unnest(string_split(trim(regexp_replace(coalesce(text, ''), {ws}, ' ', 'g'), ' '), ' ')) AS t FROM {table}),
{n}_c AS (SELECT id, ('0x' || substr(md5(t), 1, 4))::INTEGER AS c, length(t) > 0 AS one FROM {n}_t),
{n}_s AS (SELECT id, c % 64 AS place, sum(CASE WHEN one THEN CASE WHEN c >= 32768 THEN 1 ELSE -1 END ELSE 0 END) AS s FROM {n}_c GROUP BY ALL),
{n}_n AS (SELECT id, count(*) FILTER (one) AS n FROM {n}_c GROUP BY id),
{n} AS (SELECT id, list(coalesce(s, 0)::DOUBLE / greatest(n, 1) ORDER BY p) AS vec
        FROM {n}_n CROSS JOIN (SELECT unnest(range(64)) AS p) LEFT JOIN {n}_s ON {n}_s.id = {n}_n.id AND place = p GROUP BY ALL)
"""

def _vectors(n: str, key: str, table: str) -> str:
    sql = _VECTORS.format(n=n, key=key, table=table, ws=_lit("[" + _WS + "]+"))
    return sql.replace(f"SELECT id, list(", f"SELECT {n}_n.id AS id, list(").replace("place = p GROUP BY ALL)", f"place = p GROUP BY {n}_n.id)")


ENCODE_HASH = f"""
WITH {_vectors("dv", "doc_id", "documents")}
SELECT id AS doc_id, 64::BIGINT AS dim, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm FROM dv
"""

KNN_TEXT = f"""
WITH {_vectors("dv", "doc_id", "documents")}, {_vectors("qv", "item_id", "benchmark")},
pairs AS (SELECT qv.id AS query_id, dv.id AS item_id, round(list_cosine_similarity(qv.vec, dv.vec), 6) AS score
          FROM qv JOIN dv ON list_sum(list_transform(dv.vec, lambda x: x * x)) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
SELECT query_id, item_id, source, score, rank FROM ranked JOIN documents ON doc_id = item_id WHERE rank <= 5
"""

KNN_DEEP = _KNN_RANKED.format(pairs=_KNN_PAIRS.format(extra="")) + """
SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 1000
"""

TOPK_TRUTH = """
WITH pred AS (SELECT lang || '/' || source AS q, doc_id AS url,
                     row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
truth AS (SELECT DISTINCT d.lang || '/' || d.source AS q, doc_id AS url FROM labels JOIN documents d USING (doc_id) WHERE quality = 1),
n AS (SELECT q, count(*) AS n_true FROM truth GROUP BY q),
pq AS (SELECT p.q, count(DISTINCT p.url) AS n_ret, count(DISTINCT t.url) AS tp, min(CASE WHEN t.url IS NOT NULL THEN rank END) AS first_hit
       FROM pred p LEFT JOIN truth t ON t.q = p.q AND t.url = p.url WHERE rank <= 5 GROUP BY p.q),
s AS (SELECT tp::DOUBLE / n_ret AS p, tp::DOUBLE / n_true AS r, first_hit, tp FROM pq JOIN n USING (q))
SELECT round(coalesce(avg(p), 0), 4) AS precision, round(coalesce(avg(r), 0), 4) AS recall,
       round(coalesce(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 0), 4) AS f1,
       round(coalesce(avg(coalesce(1.0 / first_hit, 0)), 0), 4) AS mrr,
       round(coalesce(avg(CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END), 0), 4) AS topk_accuracy, count(*) AS n_queries
FROM s
"""

RELEVANCE_REPORT = f"""
SELECT language, coverage_all, coverage_positive, ndcg, ndcg_full
FROM ({COVERAGE}) JOIN ({NDCG_ANNOTATED}) USING (language) JOIN ({NDCG_FULL}) USING (language)
"""

ORACLE_SQL.update({"encode_hash": ENCODE_HASH, "knn_text": KNN_TEXT, "knn_deep": KNN_DEEP, "topk_truth": TOPK_TRUTH,
                   "relevance_report": RELEVANCE_REPORT})

BATCH_CORPUS = STREAM_CORPUS

LABELS_BY_COUNT = f"""
SELECT request_id, n_functions + n_classes AS n_total,
       row_number() OVER (ORDER BY n_functions + n_classes DESC, request_id) - 1 AS place
FROM ({_PARSED})
"""

IO_BROKEN_LINES = """
SELECT source, count(*) AS n_good FROM documents GROUP BY source
UNION ALL SELECT 'broken lines', count(*) FROM documents
"""

ORACLE_SQL.update({"batch_corpus": BATCH_CORPUS, "labels_by_count": LABELS_BY_COUNT, "io_broken_lines": IO_BROKEN_LINES})

EXTRACTION_ERRORS = f"""
WITH m AS ({_MOD}) SELECT repo, count(*) AS n_broken FROM m WHERE p_size > 45 GROUP BY repo
"""

ORACLE_SQL.update({"extraction_errors": EXTRACTION_ERRORS})


# ---------------------------------------------------------------------------
# Definitions in six languages: what each generated file holds, by hand
# (kind, in a class, name, first line, last line, body).

_HELD = {
    "STANDARD": ("python", "src/part_@K.py", [
        ("class", False, "Part@K", 1, 8, """def price(self):
        return "class X:" * @S

    @cached
    def size(self):
        def inner(): pass
        return inner"""),
        ("function", True, "price", 2, 3, """return "class X:" * @S"""),
        ("function", True, "size", 5, 8, """def inner(): pass
        return inner"""),
        ("function", False, "check@K", 11, 11, """return {"def": x}""")]),
    "ECONOMY": ("go", "src/part_@K.go", [
        ("class", False, "Part@K", 4, 6, """{
	Size int // }
}"""),
        ("class", False, "Shape@K", 9, 9, "{ Area() float64 }"),
        ("function", False, "Price", 13, 16, """{
	label := "}" + `{` + string('}')
	return func() int { return x * @S }(), check(label)
}"""),
        ("function", False, "Map@K", 17, 17, "{ return nil }")]),
    "MEDIUM": ("java", "src/main/Part@K.java", [
        ("class", False, "Part@K", 4, 15, """{
  private final Runnable task = new Runnable() { public void run() { go(); } };
  Part@K(int x) { super(x); }
  @Override
  public <R> Map<String, R> price(int x) throws IOException, BadPrice {
    if (x > @S) { return "}"; } // }
    return null;
  }
  abstract int none();
  enum Kind { SMALL, LARGE; int rank() { return '}'; } }
}"""),
        ("function", True, "run", 6, 6, "{ go(); }"),
        ("function", True, "Part@K", 7, 7, "{ super(x); }"),
        ("function", True, "price", 8, 12, """{
    if (x > @S) { return "}"; } // }
    return null;
  }"""),
        ("class", False, "Kind", 14, 14, "{ SMALL, LARGE; int rank() { return '}'; } }"),
        ("function", True, "rank", 14, 14, "{ return '}'; }")]),
    "PROMO": ("php", "lib/part_@K.php", [
        ("function", False, "check@K", 3, 5, """{ # }
  return "{$y["k"]} }" . @S;
}"""),
        ("class", False, "Part@K", 6, 15, """{
  use Priced;
  public static function price(int $x) {
    $f = function () { return 1; };
    return <<<TEXT
      } class Hidden {
      TEXT;
  }
  abstract protected function none();
}"""),
        ("function", True, "price", 8, 13, """{
    $f = function () { return 1; };
    return <<<TEXT
      } class Hidden {
      TEXT;
  }"""),
        ("class", False, "Priced@K", 16, 16, "{ private function &cost() { return $this->cost; } }"),
        ("function", True, "cost", 16, 16, "{ return $this->cost; }")]),
    "LARGE": ("ruby", "lib/part_@K.rb", [
        ("class", False, "Parts@K", 2, 20, """class Part < Base::Part
    attr_reader :end, :class
    def initialize(size, rest = {})
      @size = size if rest
      rest.each do |x| puts "end #{x ? "end" : @S}" end
    end
    def self.price x, *rest
      while x do x.pop end
      <<~TEXT
        end def
      TEXT
    end
    def cost = @size / 2 / 3
    class << self
      def single; begin; 1; rescue; 2; end; end
    end
  end"""),
        ("class", False, "Part", 3, 19, """attr_reader :end, :class
    def initialize(size, rest = {})
      @size = size if rest
      rest.each do |x| puts "end #{x ? "end" : @S}" end
    end
    def self.price x, *rest
      while x do x.pop end
      <<~TEXT
        end def
      TEXT
    end
    def cost = @size / 2 / 3
    class << self
      def single; begin; 1; rescue; 2; end; end
    end"""),
        ("function", True, "initialize", 5, 8, """@size = size if rest
      rest.each do |x| puts "end #{x ? "end" : @S}" end"""),
        ("function", True, "price", 9, 14, """while x do x.pop end
      <<~TEXT
        end def
      TEXT"""),
        ("function", True, "cost", 15, 15, "@size / 2 / 3"),
        ("function", True, "single", 17, 17, "begin; 1; rescue; 2; end;"),
        ("function", False, "check@K", 21, 21, "{ if: x, end: %w[end def] }")]),
    "SMALL": ("javascript", "web/part_@K.js", [
        ("function", False, "check@K", 2, 2, """{ return `a ${x ? `{${x}` : "}"} }`; }"""),
        ("class", False, "Part@K", 4, 12, """{
  #size = 1;
  constructor(x) { super(x); }
  static async *price() { yield @S }
  get size() {
    return this.#size;
  }
  task = () => { class Inner { run() {} } };
}"""),
        ("function", True, "constructor", 6, 6, "{ super(x); }"),
        ("function", True, "price", 7, 7, "{ yield @S }"),
        ("function", True, "size", 8, 10, """{
    return this.#size;
  }"""),
        ("class", False, "Inner", 11, 11, "{ run() {} }"),
        ("function", True, "run", 11, 11, "{}"),
        ("function", False, "nested@K", 13, 13, "{ function deep() {} }")]),
}


def _filled(text: str) -> str:
    literal = "'" + text.replace("'", "''") + "'"
    return f"replace(replace({literal}, '@K', p_partkey::VARCHAR), '@S', p_size::VARCHAR)"


def _held(methods: bool, path: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{language}' AS language, {path}{_filled(file)} AS path, '{kind}' AS kind, {_filled(name)} AS name, "
        f"{first}::BIGINT AS start_line, {last}::BIGINT AS end_line, {_filled(body)} AS body "
        f"FROM part WHERE p_type = '{type_}' AND p_size <= 45"
        for type_, (language, file, rows) in _HELD.items() for kind, in_class, name, first, last, body in rows
        if methods or not (in_class and kind == "function"))


ORACLE_SQL.update({
    "definitions_by_language": _held(True, ""),
    "io_sources_by_language": _held(False, "lower(replace(p_brand, '#', '')) || '/' || "),
    "broken_by_language": f"""
SELECT CASE p_type {' '.join(f"WHEN '{t}' THEN '{v[0]}'" for t, v in _HELD.items())} END AS language, count(*) AS n_broken
FROM part WHERE p_size > 45 GROUP BY 1""",
})


# ---------------------------------------------------------------------------
# Python files of the older grammar: what each holds, by hand.

_SHOW = """def show(self, (x, y), mode=0755):
    \"\"\"Show the price of parts.\"\"\"
    print >>self.out, "price: %s" % `x`, @S
    try: exec self.code in self.space
    except (IOError, OSError), e:
        raise ValueError, "no price"
    return lambda (p, q): p <> 10L"""
_PRICE = """
def price@K(x):
    ur\"\"\"Compute the größte price quickly.\"\"\"
    if x: print "priced"  # now
    return x * @S"""
_GOOD = """def good@K(self, x):
    \"\"\"Return the size of it.\"\"\"
    return x"""
_FINE = """def fine@K(self):
    \"\"\"Print the size of parts.\"\"\"
    print self.size"""
_SHOW_DOC, _PRICE_DOC = '"""Show the price of parts."""', 'ur"""Compute the größte price quickly."""'


def _old(rows, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'old/mod_' || p_partkey::VARCHAR || '.py' AS path, {_filled(name)} AS func_name, {line}::BIGINT AS lineno, "
        f"{_filled(code)} AS code, {_filled(doc)} AS docstring FROM part WHERE {where}" for name, line, code, doc in rows)


_SOUND = [("show", 4, _SHOW, _SHOW_DOC), ("price@K", 12, _PRICE, _PRICE_DOC)]
_RECOVERED = [("good@K", 17, _GOOD, '"""Return the size of it."""'), ("fine@K", 23, _FINE, '"""Print the size of parts."""')]


def _indented(text: str, by: str = "    ") -> str:
    return ("\n" + by).join(text.split("\n"))


_OLD_DEFINITIONS = [
    ("class", "Old@K", 2, 10, '"""Holds größere parts."""\n    ' + _indented(_SHOW)),
    ("function", "show", 4, 10, _indented(_SHOW).split("\n", 1)[1].lstrip()),
    ("function", "price@K", 12, 15, _PRICE.split("\n", 2)[2].lstrip())]

_OLD_TOKENS = [
    ("show", 'def show ( self , ( x , y ) , mode = 0755 ) : print >> self . out , "price: %s" % ` x ` , @S try : exec self . code in self . space '
             'except ( IOError , OSError ) , e : raise ValueError , "no price" return lambda ( p , q ) : p <> 10L',
     "show self x y mode self out x self code self space IOError OSError e ValueError p q p",
     'show ( self , ( x , y ) , mode = 0755 ) : >> self . out , "price: %s" % ` x ` , @S : self . code self . space '
     '( IOError , OSError ) , e : ValueError , "no price" ( p , q ) : p <> 10L', ': print >>', f": {_SHOW_DOC} print >>", ""),
    ("price@K", 'def price@K ( x ) : if x : print "priced" return x * @S', "price@K x x x", 'price@K ( x ) : x : "priced" x * @S',
     ": if x", f": {_PRICE_DOC} if x", "now"),
]

ORACLE_SQL.update({
    "functions_old_grammar": _old(_SOUND, "p_size <= 45"),
    "functions_recovered": _old(_SOUND, "true") + " UNION ALL " + _old(_RECOVERED, "p_size > 45"),
    "definitions_old_grammar": " UNION ALL ".join(
        f"SELECT 'old/mod_' || p_partkey::VARCHAR || '.py' AS path, '{kind}' AS kind, {_filled(name)} AS name, {a}::BIGINT AS start_line, "
        f"{b}::BIGINT AS end_line, {_filled(body)} AS body FROM part WHERE p_size <= 45" for kind, name, a, b, body in _OLD_DEFINITIONS),
    "code_tokens_flags": " UNION ALL ".join(
        f"SELECT 'old/mod_' || p_partkey::VARCHAR || '.py' AS path, {_filled(name)} AS func_name, {_filled(tokens)} AS tokens, "
        f"{_filled(ids)} AS ids, {_filled(bare)} AS no_keywords, {_filled(tokens.replace(cut, whole, 1))} AS whole, "
        f"'{comments}' AS comment_tokens FROM part WHERE p_size <= 45"
        for name, tokens, ids, bare, cut, whole, comments in _OLD_TOKENS),
})

# The stored index, searched in all its leaves, gives what the exact join gives.
ORACLE_SQL["knn_index_by_key"] = KNN_BY_KEY


# ---------------------------------------------------------------------------
# Shards, byte ranges, numbered chunks, tag files, token-list records, encoders.

ORACLE_SQL.update({
    "io_shards": """
SELECT source AS repo, doc_id::VARCHAR AS path, md5(text) AS content_md5 FROM documents
UNION ALL SELECT 'given up', (max(doc_id) // 50 + 1)::VARCHAR, NULL FROM documents""",
    "io_blob_ranges": "SELECT source AS repo, doc_id::VARCHAR AS path, md5(text) AS content_md5 FROM documents",
    "io_chunks": """
SELECT 'chunk_' || (place // 100)::VARCHAR || '.jsonl' AS file, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) GROUP BY 1""",
    "io_tag_files": BUILD_TAGS.replace("SELECT path,", "SELECT replace(repo, '/', '_') || '_' || right(k, 1) AS save_path, path,"),
    "io_definition_records": f"SELECT func_name AS identifier, path || '#' || func_name AS url, code_tokens AS tokens FROM ({CODE_TOKENS})",
    "encode_custom": "SELECT doc_id, " + " || ',' || ".join(
        f"(length(text) - length(replace(text, '{c}', '')))::VARCHAR" for c in "aeiou") + " AS vowels FROM documents",
})
# A forest has no SQL; what it must reach, on every table, has: the queries are all vectors that have a neighbour.
ORACLE_SQL["knn_forest"] = """
SELECT count(DISTINCT q.vec_id) AS n_queries, true AS recall_reached, true AS work_spared
FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id"""
