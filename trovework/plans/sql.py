"""SQL for the registered queries, written on its own for another engine (DuckDB)."""

from __future__ import annotations

from trovework.operators.entities import NOT_NAMES, PATTERNS

# Fixed values, written out here on their own so that an error in the library's lists shows.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with would public private protected static final class interface enum abstract extends implements import return void int long double"
    " float boolean char byte short new this super null true false if else while do switch case default try catch finally throw throws break continue"
).split()
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "c#": "csharp", "cs": "csharp", "rs": "rust", "rb": "ruby", "kt": "kotlin", "yml": "yaml", "sh": "shell"}
SOURCE_EXTENSIONS = "java py js ts cpp c h cs go rs scala kt rb php swift".split()
BINARY_EXTENSIONS = "class jar war exe dll so png jpg jpeg gif pdf zip gz".split()
PARSERS = dict(x.split(":") for x in "java:java py:python pyi:python js:javascript jsx:javascript ts:typescript tsx:typescript c:c h:c cpp:cpp cc:cpp cxx:cpp hpp:cpp go:go rs:rust kt:kotlin kts:kotlin rb:ruby scala:scala sc:scala swift:swift php:php cs:csharp".split())


def _list(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_NAME = "(length({0}) > 1 AND position('.' IN {0}) = 0)"
_COMMON = "('java', 'com', 'org', 'net', 'io')"
_DIRS = "('src', 'main', 'test', 'docs')"


def _first(holds: str, value: str) -> str:
    return f"list_transform(list_filter(range(1, len(p) + 1), lambda i: coalesce({holds}, false)), lambda i: {value})[1]"


REPO = f"""lower(coalesce(
  {_first("p[i] IN ('github.com', 'gitlab.com', 'bitbucket.org') AND " + _NAME.format("p[i + 2]"), "p[i + 2]")},
  {_first(f"p[i + 1] IN {_DIRS} AND " + _NAME.format("p[i]") + f" AND p[i] NOT IN {_COMMON}", "p[i]")},
  {_first("p[i + 1] IN ('README', 'package.json', 'pom.xml', 'build.gradle', 'Cargo.toml', 'go.mod') AND " + _NAME.format("p[i]"), "p[i]")},
  CASE WHEN len(p) > 1 AND {_NAME.format("p[-1]")} AND {_NAME.format("p[-2]")} AND p[-1] NOT IN {_COMMON} AND p[-2] NOT IN {_COMMON} THEN p[-1] END,
  list_filter(p[1:len(p) - 1], lambda x: {_NAME.format("x")} AND x NOT IN {_COMMON} AND x NOT IN {_DIRS} AND x NOT IN ('bin', 'target', 'build', 'out', 'dist'))[-1],
  'unknown'))"""

#: the chunk table cleaned
CLEAN = f"""c AS (
  SELECT *, source_file || ':' || entity_name || ':' || start_line || ':' || end_line AS document_id,
    (SELECT {REPO} FROM (SELECT string_split(source_file, '/') AS p)) AS repository FROM (
  SELECT DISTINCT ON (id) id, content, coalesce({_map(LANGUAGE_ALIASES)}[lower(trim(language))], lower(trim(language))) AS language, lower(entity_type) AS entity_type,
    entity_name, source_file, start_line, end_line, created_at, updated_at
  FROM code_chunks_vectors ORDER BY id, greatest(created_at, updated_at) DESC NULLS LAST, created_at DESC NULLS LAST))"""


def _terms(column: str) -> str:
    split = rf"string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')), '[ _]+')"
    parts = f"list_filter({split}, lambda x: x <> '')"
    one = f"CASE WHEN len({parts}) > 1 THEN list_concat([lower(t)], list_filter(list_distinct({parts}), lambda x: length(x) > 1 AND x <> lower(t))) ELSE [lower(t)] END"
    bare = rf"regexp_replace(coalesce({column}, ''), '([\p{{L}}\p{{N}}])[''’][sS]($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return rf"list_filter(flatten(list_transform(regexp_extract_all({bare}, '[\p{{L}}\p{{N}}_]+'), lambda t: {one})), lambda x: x NOT IN ({_list(STOP_WORDS)}))"


def _postings(source: str, fields: dict[str, str], key: str = "id") -> str:
    return (
        "f AS (" + " UNION ALL ".join(f"SELECT {key} AS doc, '{f}' AS field, {_terms(c)} AS terms FROM {source}" for f, c in fields.items()) + "),\n"
        "post AS (SELECT doc, field, term, dl, count(*) AS tf FROM (SELECT doc, field, len(terms) AS dl, unnest(terms) AS term FROM f) GROUP BY ALL),\n"
        "st AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT field, doc, dl FROM post) GROUP BY field)"
    )


Q = f"q AS (SELECT DISTINCT query_id, term FROM (SELECT doc_id AS query_id, unnest({_terms('text')}) AS term FROM documents WHERE doc_id % 20 = 0))"


def _bm25(weights: dict[str, float]) -> str:
    w = "CASE field " + " ".join(f"WHEN '{f}' THEN {x}" for f, x in weights.items()) + " END"
    return f"""df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
s AS (SELECT query_id, doc, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * {w}) AS score
  FROM post JOIN q USING (term) JOIN df USING (field, term) JOIN st USING (field) WHERE field IN ({_list(weights)}) GROUP BY ALL)"""


RANKED = "SELECT query_id, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM ({}))  WHERE r <= 10"
CHUNK_FIELDS = {"content": "content", "entity_name": "entity_name", "doc_summary": "doc_summary"}
#: the cleaned chunks with the first of their summaries
SAID = CLEAN + """, cs AS (SELECT c.*, doc_summary FROM c LEFT JOIN (SELECT source_file, entity_name, start_line, end_line, min(doc_summary) AS doc_summary FROM search_results WHERE trim(doc_summary, ' ') <> '' GROUP BY ALL) USING (source_file, entity_name, start_line, end_line))"""
CHANGES = """ch AS (SELECT * REPLACE (upper(trim(change_type)) AS change_type) FROM (SELECT DISTINCT ON (change_id) * FROM file_changes ORDER BY change_id, received_at DESC NULLS LAST)
  WHERE upper(trim(change_type)) IN ('ADDED', 'MODIFIED', 'DELETED', 'RENAMED') AND file_path IS NOT NULL)"""
STATE = CHANGES + """, says AS (SELECT file_path AS path, change_type <> 'DELETED' AS alive, changed_at, change_id FROM ch
  UNION ALL SELECT old_path, false, changed_at, change_id FROM ch WHERE change_type = 'RENAMED' AND old_path IS NOT NULL AND old_path <> file_path),
state AS (SELECT DISTINCT ON (path) path, alive FROM says ORDER BY path, changed_at DESC NULLS LAST, change_id DESC, alive DESC)"""


def queries() -> dict[str, str]:
    from trovework.plans.catalogue import DAY

    ext = "CASE WHEN position('.' IN b) > 0 THEN regexp_extract(b, '([^.]*)$', 1) ELSE '' END"
    chunk_search = f"WITH {SAID}, {_postings('cs', CHUNK_FIELDS)}, {Q}, {_bm25({'content': 1.0, 'entity_name': 3.0, 'doc_summary': 2.0})}, t AS (SELECT query_id, doc, round(sum(score), 6) AS score FROM s GROUP BY ALL)"
    posted = f"WITH {SAID}, {_postings('cs', CHUNK_FIELDS)}"
    phrased = lambda c: f"contains(' ' || array_to_string({_terms(c)}, ' ') || ' ', ' nightly job ')"
    window = "CASE " + " ".join(f"WHEN contains(lower(coalesce(model, '')), '{a}') THEN {n}" for a, n in (("claude-3", 100000), ("claude-2", 100000), ("gpt-4-32k", 32768), ("gpt-4", 8192), ("gpt-3.5-turbo-16k", 16384), ("gpt-3.5-turbo", 4096), ("llama-3", 8192), ("llama3", 8192), ("mistral", 8192), ("phi", 2048))) + " ELSE 8192 END"
    once = "u AS (SELECT DISTINCT ON (usage_id) * FROM llm_usage ORDER BY usage_id)"
    edges = """e AS (SELECT DISTINCT p[i] AS src, p[i + 1] AS dst FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT DISTINCT relationship_path AS p FROM search_results WHERE len(relationship_path) > 1)) WHERE p[i] <> p[i + 1])"""
    url = r"'^(?:https?://|ssh://git@|git@)(?:[^@/]*@)?([^/:]+)[/:](?:scm/)?(.+?)(?:\.git)?/?$'"
    hybrid = f"""WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_postings('d', {'content': 'text'})}, {Q}, {_bm25({'content': 1.0})},
  k AS ({RANKED.format('SELECT query_id, doc, round(score, 6) AS score FROM s')}), km AS (SELECT query_id, min(score) AS a, max(score) AS b FROM k GROUP BY 1), kn AS (SELECT query_id, doc, CASE WHEN a = b THEN 1.0 ELSE (score - a) / (b - a) END AS kw FROM k JOIN km USING (query_id)),
  e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT id FROM d)),
  x AS ({RANKED.format('SELECT q1.vec_id AS query_id, e.vec_id AS doc, round(list_cosine_similarity(q1.v, e.v), 9) AS score FROM e q1, e WHERE q1.vec_id % 20 = 0 AND list_cosine_similarity(q1.v, e.v) >= 0')}), xm AS (SELECT query_id, min(score) AS a, max(score) AS b FROM x GROUP BY 1), xn AS (SELECT query_id, doc, CASE WHEN a = b THEN 1.0 ELSE (score - a) / (b - a) END AS vec FROM x JOIN xm USING (query_id))"""
    quality = f"""{hybrid}, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS doc FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0),
  lists AS (SELECT 'keyword' AS mode, query_id, doc, round(kw, 4) AS score FROM kn UNION ALL SELECT 'vector', query_id, doc, round(vec, 4) FROM xn UNION ALL SELECT 'hybrid', query_id, doc, round(CASE WHEN kw IS NOT NULL AND vec IS NOT NULL THEN 0.6 * kw + 0.4 * vec ELSE coalesce(kw, vec) END, 4) FROM kn FULL JOIN xn USING (query_id, doc)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, doc) AS r FROM lists),
  quality AS (SELECT query_id, mode, round(count(*) FILTER (WHERE (query_id, doc) IN (SELECT (query_id, doc) FROM rel)) / count(*), 6) AS p FROM ranked WHERE r <= 10 GROUP BY ALL),
  cmp AS (SELECT query_id, max(p) FILTER (WHERE mode = 'keyword') AS keyword, max(p) FILTER (WHERE mode = 'vector') AS vector, max(p) FILTER (WHERE mode = 'hybrid') AS hybrid, arg_max(mode, (p, mode = 'hybrid', mode)) AS best FROM quality GROUP BY 1)"""
    patterns = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PATTERNS)
    declared = rf"""WITH {CLEAN}, p(lang, tp, fp) AS (VALUES {patterns}), l AS (SELECT id, {_map(PARSERS)}[regexp_extract(lower(source_file), '([^.]*)$', 1)] AS lang, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c),
  j AS (SELECT *, regexp_extract(line, tp, 2) AS t, regexp_extract(line, fp, 2) AS f FROM l JOIN p USING (lang)), decl AS (SELECT id, line_no::INT AS line_no, CASE WHEN t <> '' THEN lower(regexp_extract(line, tp, 1)) ELSE 'function' END AS kind, CASE WHEN t <> '' THEN t ELSE f END AS name FROM j WHERE NOT regexp_matches(line, '^\s*(//|/\*|\*|#)') AND (t <> '' OR f <> '') AND (CASE WHEN t <> '' THEN t ELSE f END) NOT IN ({_list(NOT_NAMES)}))"""
    return {
        "file_kinds": f"SELECT source_file, {ext} AS extension, b NOT LIKE '.%' AND {ext} IN ({_list(SOURCE_EXTENSIONS)}) AS is_source, b NOT LIKE '.%' AND {ext} NOT IN ({_list(BINARY_EXTENSIONS)}) AS is_text, {_map(PARSERS)}[{ext}] AS parser FROM (SELECT DISTINCT source_file, lower(regexp_extract(source_file, '([^/]*)$', 1)) AS b FROM code_chunks_vectors)",
        "repository_urls": rf"""SELECT repo_name, CASE WHEN h = 'github.com' THEN 'github' WHEN h = 'bitbucket.org' THEN 'bitbucket' WHEN contains(clone_url, '/scm/') THEN 'bitbucket_server' WHEN contains(h, 'gitlab') THEN 'gitlab' WHEN h <> '' THEN 'other' ELSE 'unknown' END AS client,
  nullif(regexp_extract(r, '^(.*)/[^/]+$', 1), '') AS owner, nullif(regexp_extract(r, '([^/]+)$', 1), '') AS name, CASE WHEN h <> '' AND regexp_extract(r, '^(.*)/[^/]+$', 1) <> '' THEN 'https://' || h || '/' || r || '.git' END AS url,
  regexp_replace(regexp_replace(regexp_replace(clone_url, '^[a-z]+://', ''), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g') || '.json' AS state_file
  FROM (SELECT *, lower(regexp_extract(clone_url, {url}, 1)) AS h, regexp_extract(clone_url, {url}, 2) AS r FROM repositories)""",
        "repository_of_file": f"SELECT source_file, {REPO} AS repository FROM (SELECT DISTINCT source_file, string_split(source_file, '/') AS p FROM code_chunks_vectors)",
        "chunk_violations": """SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN content IS NULL THEN 'content is null' END, CASE WHEN language IS NULL THEN 'language is null' END, CASE WHEN entity_type IS NULL THEN 'entity_type is null' END,
  CASE WHEN entity_name IS NULL THEN 'entity_name is null' END, CASE WHEN source_file IS NULL THEN 'source_file is null' END, CASE WHEN start_line < 1 THEN 'start_line below 1' END, CASE WHEN end_line < start_line THEN 'end_line before start_line' END,
  CASE WHEN start_byte < 0 THEN 'start_byte below 0' END, CASE WHEN end_byte < start_byte THEN 'end_byte before start_byte' END, CASE WHEN updated_at IS NULL THEN 'updated_at is null' END, CASE WHEN updated_at < created_at THEN 'updated_at before created_at' END], lambda x: x IS NOT NULL), ', ') AS violations
  FROM code_chunks_vectors WHERE violations <> ''""",
        "clean_chunks": f"WITH {CLEAN} SELECT id, document_id, language, entity_type, length(content) AS n_chars FROM c",
        "index_stats": f"WITH {CLEAN} SELECT count(*) AS rows, count(DISTINCT id) AS documents, count(DISTINCT source_file) AS files, sum(length(content))::BIGINT AS characters FROM c",
        "parse_progress": f"WITH {CLEAN}, p AS (SELECT language, count(*) AS chunks, count(DISTINCT source_file) AS files FROM c GROUP BY 1) SELECT *, floor(100 * sum(files) OVER (ORDER BY language ROWS UNBOUNDED PRECEDING) / (SELECT sum(files) FROM p))::INT AS percent FROM p",
        "appended": f"WITH {CLEAN} SELECT source_file, count(*) AS n FROM c WHERE created_at IS NOT NULL GROUP BY 1",
        "deleted_files": f"WITH {CLEAN}, {CHANGES} SELECT id FROM c WHERE source_file NOT IN (SELECT file_path FROM ch WHERE change_type = 'DELETED')",
        "replaced_files": f"WITH {CLEAN} SELECT id FROM c WHERE created_at >= '{DAY}' OR source_file NOT IN (SELECT source_file FROM c WHERE created_at >= '{DAY}')",
        "upserted": f"""SELECT DISTINCT ON (id) id, epoch_us(greatest(created_at, updated_at)) AS at, md5(content) AS md5 FROM code_chunks_vectors WHERE created_at IS NOT NULL
  ORDER BY id, created_at >= '{DAY}' DESC, greatest(created_at, updated_at) DESC NULLS LAST, created_at DESC NULLS LAST""",
        "upserted_vectors": "SELECT CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1",
        "snapshot_changes": f"""WITH {CLEAN}, n AS (SELECT source_file AS path, string_agg(md5(content), '' ORDER BY start_line, md5(content)) AS h FROM c GROUP BY 1), o AS (SELECT source_file AS path, string_agg(md5(content), '' ORDER BY start_line, md5(content)) AS h FROM c WHERE created_at < '{DAY}' GROUP BY 1),
  come AS (SELECT path, h, count(*) OVER (PARTITION BY h) AS r FROM n WHERE path NOT IN (SELECT path FROM o)), gone AS (SELECT path, h, count(*) OVER (PARTITION BY h) AS r FROM o WHERE path NOT IN (SELECT path FROM n)),
  moved AS (SELECT gone.path AS old_path, come.path AS file_path FROM gone JOIN come USING (h) WHERE gone.r = 1 AND come.r = 1)
  SELECT 'MODIFIED' AS change_type, path AS file_path, NULL AS old_path FROM o JOIN n USING (path) WHERE o.h <> n.h UNION ALL SELECT 'ADDED', path, NULL FROM come WHERE path NOT IN (SELECT file_path FROM moved) UNION ALL SELECT 'DELETED', path, NULL FROM gone WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT 'RENAMED', file_path, old_path FROM moved""",
        "similar_files": rf"""WITH {CLEAN}, f AS (SELECT source_file AS path, day(min(created_at)) % 2 AS odd FROM c GROUP BY 1), ln AS (SELECT DISTINCT path, odd, line FROM (SELECT path, odd, trim(regexp_replace(unnest(string_split(content, chr(10))), '[\t\r]', ' ', 'g'), ' ') AS line FROM c JOIN f ON path = source_file) WHERE line <> ''),
  sz AS (SELECT path, odd, count(*) AS size FROM ln GROUP BY ALL), sh AS (SELECT a.path AS old_path, b.path AS file_path, count(*) AS shared FROM ln a JOIN ln b ON a.line = b.line AND a.odd = 1 AND b.odd = 0 GROUP BY ALL),
  m AS (SELECT old_path, file_path, shared / greatest(x.size, y.size) AS sim FROM sh JOIN sz x ON x.path = old_path JOIN sz y ON y.path = file_path WHERE shared / greatest(x.size, y.size) >= 0.5)
  SELECT old_path, file_path, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY sim DESC, old_path) AS p, row_number() OVER (PARTITION BY old_path ORDER BY sim DESC, file_path) AS q FROM m) WHERE p = 1 AND q = 1""",
        "file_states": f"WITH {STATE} SELECT path, alive FROM state",
        "applied_changes": f"WITH {CLEAN}, {STATE} SELECT language, count(*) AS n FROM c WHERE source_file NOT IN (SELECT path FROM state WHERE NOT alive) GROUP BY 1",
        "index_states": f"WITH {CHANGES} SELECT repository, commit_sha, changes FROM (SELECT DISTINCT ON (repository) repository, commit_sha FROM ch WHERE repository IS NOT NULL ORDER BY repository, changed_at DESC NULLS LAST, change_id DESC) JOIN (SELECT repository, count(*) AS changes FROM ch GROUP BY 1) USING (repository)",
        "declarations": f"{declared} SELECT id, line_no, kind, name FROM decl",
        "declaration_extents": rf"""{declared}, ln AS (SELECT id, lang, line_no, line, regexp_replace(regexp_replace(line, '\\.', '', 'g'), '"[^"]*"|''[^'']*''|//.*', '', 'g') AS pl FROM l WHERE regexp_replace(line, '\s', '', 'g') <> ''),
  st AS (SELECT *, coalesce(lang IN ('python', 'ruby'), false) AS ind, length(regexp_extract(line, '^[ \t]*')) AS indent, (length(pl) - length(replace(pl, '{{', ''))) AS opens, (length(pl) - length(replace(pl, '}}', ''))) AS shuts FROM ln),
  su AS (SELECT *, sum(CASE WHEN ind THEN 0 ELSE opens - shuts END) OVER (PARTITION BY id ORDER BY line_no) AS deep, lead(indent) OVER (PARTITION BY id ORDER BY line_no) AS nxt FROM st),
  lv AS (SELECT *, CASE WHEN ind THEN coalesce(nxt, 0) ELSE deep END AS after, CASE WHEN ind THEN indent ELSE deep - opens + shuts END AS level FROM su),
  dl AS (SELECT decl.*, level FROM decl JOIN lv USING (id, line_no)), lst AS (SELECT id, max(line_no) AS last FROM ln GROUP BY 1),
  en AS (SELECT dl.id, dl.line_no, dl.kind, dl.name, coalesce((SELECT min(lv.line_no) FROM lv WHERE lv.id = dl.id AND lv.line_no >= dl.line_no AND (lv.after < lv.level AND greatest(lv.after, 0) <= dl.level AND dl.level <= greatest(lv.after, lv.level - 1, 0)
     OR NOT lv.ind AND lv.opens = lv.shuts AND lv.opens > 0 AND greatest(lv.after, 0) <= dl.level AND dl.level <= greatest(lv.after, lv.level, 0))), last)::INT AS end_line FROM dl JOIN lst USING (id)),
  q AS (SELECT DISTINCT en.*, (SELECT string_agg(o.name, '.' ORDER BY o.line_no, o.name) FROM en o WHERE o.id = en.id AND o.line_no < en.line_no AND en.line_no <= o.end_line AND o.kind IN ('class', 'interface', 'enum', 'record', 'struct', 'union', 'trait', 'impl', 'object', 'protocol', 'extension', 'module')) AS above FROM en)
  SELECT id, line_no, kind, name, end_line, concat_ws('.', above, name) AS qualified FROM q""",
        "term_statistics": f"WITH {CLEAN}, {_postings('c', {'content': 'content'})} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1",
        "field_statistics": f"{posted} SELECT field, n, round(avgdl, 6) AS avgdl FROM st",
        "index_build": f"{posted} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS occurrences, max(df) AS most_df FROM (SELECT *, count(*) OVER (PARTITION BY field, term) AS df FROM post) GROUP BY 1",
        "keyword_search": f"{chunk_search} SELECT query_id, doc, score FROM ({RANKED.format('SELECT * FROM t')})",
        "keyword_search_filtered": f"{chunk_search} SELECT query_id, doc, score FROM ({RANKED.format("""SELECT * FROM t WHERE doc IN (SELECT id FROM c WHERE language IN ('java', 'python') AND entity_type IN ('method', 'function'))""")})",
        "field_search": f"WITH {CLEAN}, {_postings('c', {'entity_name': 'entity_name'})}, {Q}, {_bm25({'entity_name': 1.0})}, t AS (SELECT query_id, doc, round(sum(score), 6) AS score FROM s GROUP BY ALL) SELECT query_id, doc, score FROM ({RANKED.format('SELECT * FROM t')})",
        "keyword_normalised": f"{chunk_search}, k AS ({RANKED.format('SELECT * FROM t')}), m AS (SELECT query_id, min(score) AS a, max(score) AS b FROM k GROUP BY 1) SELECT query_id, doc, round(CASE WHEN a = b THEN 1.0 ELSE (score - a) / (b - a) END, 5) AS score FROM k JOIN m USING (query_id)",
        "field_match": f"{chunk_search}, k AS ({RANKED.format('SELECT * FROM t')}) SELECT query_id, doc, string_agg(field, ',' ORDER BY field) AS matched_fields FROM (SELECT DISTINCT query_id, doc, field FROM s JOIN k USING (query_id, doc)) GROUP BY ALL",
        "boolean_search": f"{posted} SELECT doc FROM post GROUP BY doc HAVING count(DISTINCT term) FILTER (WHERE term IN ('token', 'ledger')) = 2 AND count(*) FILTER (WHERE term IN ('nightly', 'caller')) > 0 AND count(*) FILTER (WHERE term = 'unknown') = 0",
        "wildcard_search": f"{posted} SELECT DISTINCT doc FROM post WHERE term LIKE 'snap%sh_t%'",
        "fuzzy_search": f"{posted} SELECT DISTINCT doc FROM post WHERE levenshtein(term, 'ledgr') <= 1",
        "phrase_search": f"WITH {SAID} SELECT id AS doc, array_to_string(list_filter([CASE WHEN {phrased('content')} THEN 'content' END, CASE WHEN {phrased('entity_name')} THEN 'entity_name' END, CASE WHEN {phrased('doc_summary')} THEN 'doc_summary' END], lambda x: x IS NOT NULL), ',') AS fields FROM cs WHERE fields <> ''",
        "all_documents": f"WITH {CLEAN} SELECT id AS doc, 1.0::DOUBLE AS score FROM c",
        "path_filter": f"WITH {CLEAN} SELECT id FROM c WHERE source_file LIKE 'copperway/%' OR source_file LIKE 'oakline/facet%'",
        "name_lookup": f"WITH {CLEAN} SELECT entity_name, id AS doc FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY id) AS r FROM c WHERE entity_name IN (SELECT entity_name FROM search_results WHERE is_transitive AND trim(entity_name) <> '')) WHERE r <= 3",
        "facets": f"WITH {CLEAN}, v AS (SELECT 'language' AS dimension, language AS value, count(*) AS count FROM c GROUP BY 2 UNION ALL SELECT 'repository', repository, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*) FROM c GROUP BY 2) SELECT dimension, value, count FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS r FROM v WHERE trim(value) <> '') WHERE r <= 10",
        "facets_of_query": f"{posted}, h AS (SELECT * FROM c WHERE id IN (SELECT doc FROM post WHERE term = 'token')), v AS (SELECT 'language' AS dimension, language AS value, count(*) AS count FROM h GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*) FROM h GROUP BY 2) SELECT dimension, value, count FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS r FROM v WHERE trim(value) <> '') WHERE r <= 5",
        "nearest_vectors": "SELECT query_id, doc, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE score >= 0) WHERE r <= 10",
        "nearest_by_cells_recall": "SELECT sum(least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS pairs, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
        "hybrid_search": f"""{hybrid} SELECT query_id, doc, round(CASE WHEN kw IS NOT NULL AND vec IS NOT NULL THEN 0.6 * kw + 0.4 * vec ELSE coalesce(kw, vec) END, 4) AS score, kw IS NOT NULL AND vec IS NOT NULL AS both FROM kn FULL JOIN xn USING (query_id, doc)""",
        "hybrid_keyword_mode": f"{hybrid} SELECT query_id, doc, round(kw, 4) AS score, false AS both FROM kn",
        "hybrid_vector_mode": f"{hybrid} SELECT query_id, doc, round(vec, 4) AS score, false AS both FROM xn",
        "transitive_search": f"""WITH RECURSIVE {SAID}, {_postings('cs', CHUNK_FIELDS)}, {edges}, roots AS (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)),
  q AS (SELECT DISTINCT query_id, term FROM (SELECT src AS query_id, unnest({_terms('src')}) AS term FROM roots)), {_bm25({'content': 1.0, 'entity_name': 3.0, 'doc_summary': 2.0})},
  t AS (SELECT query_id, doc, round(sum(score), 6) AS score FROM s GROUP BY ALL), k AS ({RANKED.format('SELECT * FROM t')}), m AS (SELECT query_id, min(score) AS a, max(score) AS b FROM k GROUP BY 1),
  w AS (SELECT src AS start, src AS name, 0 AS depth, src AS path FROM roots UNION SELECT w.start, e.dst, w.depth + 1, w.path || '>' || e.dst FROM w JOIN e ON e.src = w.name WHERE w.depth < 5),
  b AS (SELECT start, name, min(depth) AS depth FROM w GROUP BY ALL), below AS (SELECT start, name, min(path) AS path FROM b JOIN w USING (start, name, depth) WHERE depth > 0 GROUP BY ALL),
  named AS (SELECT entity_name, id FROM (SELECT entity_name, id, row_number() OVER (PARTITION BY entity_name ORDER BY id) AS r FROM c WHERE entity_name IN (SELECT name FROM below)) WHERE r <= 10),
  rel AS (SELECT start AS query_id, id AS doc, min(path) AS path FROM below JOIN named ON name = entity_name GROUP BY ALL)
  SELECT query_id, doc, round(CASE WHEN a = b THEN 1.0 ELSE (score - a) / (b - a) END, 5) AS score, false AS is_transitive, NULL AS path FROM k JOIN m USING (query_id) UNION ALL SELECT query_id, doc, 1.0, true, path FROM rel ANTI JOIN k USING (query_id, doc)""",
        "mode_comparison": f"{quality} SELECT query_id, keyword, vector, hybrid, best, round(CASE WHEN coalesce(keyword, 0) = 0 THEN CASE WHEN hybrid > 0 THEN 100.0 ELSE 0.0 END ELSE (coalesce(hybrid, 0) - keyword) / keyword * 100 END, 3) AS improvement FROM cmp",
        "weight_recommendation": f"""{quality}, m AS (SELECT coalesce(avg(keyword), 0) AS keyword, coalesce(avg(vector), 0) AS vector, coalesce(avg(hybrid), 0) AS hybrid, count(*) FILTER (WHERE best = 'keyword') AS keyword_wins, count(*) FILTER (WHERE best = 'vector') AS vector_wins, count(*) FILTER (WHERE best = 'hybrid') AS hybrid_wins FROM cmp),
  w AS (SELECT *, CASE WHEN keyword > vector + 0.1 THEN 0.7 WHEN vector > keyword + 0.1 THEN 0.4 ELSE 0.6 END::DOUBLE AS keyword_weight FROM m) SELECT round(keyword, 5) AS keyword, round(vector, 5) AS vector, round(hybrid, 5) AS hybrid, keyword_wins, vector_wins, hybrid_wins, keyword_weight, round(1 - keyword_weight, 6) AS vector_weight FROM w""",
        "vector_statistics": "SELECT count(*) AS vectors, count(*) FILTER (WHERE coalesce(len(embedding), 0) = 0) AS empty, sum(coalesce(len(embedding), 0))::BIGINT AS numbers, min(coalesce(len(embedding), 0))::INT AS least, max(coalesce(len(embedding), 0))::INT AS most FROM embeddings",
        "search_page": "WITH r AS (SELECT result_id AS doc, max({'q': query_id, 's': score::DOUBLE}) AS m FROM search_results GROUP BY 1), t AS (SELECT m.q AS query_id, doc, row_number() OVER (PARTITION BY m.q ORDER BY m.s DESC, doc) AS n, count(*) OVER (PARTITION BY m.q) AS total FROM r) SELECT query_id, doc, total, 0 AS page FROM t WHERE n BETWEEN 6 AND 15",
        "result_quality": "WITH r AS (SELECT DISTINCT ON (result_id) query_id, result_id AS doc, score, is_transitive FROM search_results ORDER BY result_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS n FROM r) SELECT query_id, round(count(*) FILTER (WHERE n <= 5 AND NOT is_transitive) / least(5, count(*) FILTER (WHERE n <= 20)), 6) AS p_at_5, round(count(*) FILTER (WHERE n <= 10 AND NOT is_transitive) / least(10, count(*) FILTER (WHERE n <= 20)), 6) AS p_at_10, round(CASE WHEN count(*) FILTER (WHERE NOT is_transitive) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE n <= 20 AND NOT is_transitive) / count(*) FILTER (WHERE NOT is_transitive) END, 6) AS recall FROM t GROUP BY 1",
        "inheritance_closure": f"WITH RECURSIVE {edges}, w AS (SELECT DISTINCT src AS start, src AS name, 0 AS depth, src AS path FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT w.start, e.dst, w.depth + 1, w.path || '>' || e.dst FROM w JOIN e ON e.src = w.name WHERE w.depth < 5), b AS (SELECT start, name, min(depth) AS depth FROM w GROUP BY ALL) SELECT start, name, depth, min(path) AS path FROM b JOIN w USING (start, name, depth) WHERE depth > 0 GROUP BY ALL",
        "graph_degrees": f"WITH {edges} SELECT name, sum(c)::BIGINT AS children, sum(p)::BIGINT AS parents FROM (SELECT src AS name, 1 AS c, 0 AS p FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
        "usage": f"WITH {once} SELECT coalesce(nullif(trim(provider), ''), 'unknown') AS provider, coalesce(nullif(trim(model), ''), 'unknown') AS model, count(*) AS calls, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, round(sum(coalesce(cost_estimate, 0)), 6) AS cost FROM u GROUP BY 1, 2",
        "usage_estimate": f"""WITH {once}, r AS (SELECT *, CASE WHEN contains(lower(coalesce(provider, '')), 'openai') THEN CASE WHEN contains(lower(coalesce(model, '')), 'gpt-3.5') OR contains(lower(coalesce(model, '')), 'gpt-35') THEN [0.0005, 0.0015] ELSE [0.03, 0.06] END
  WHEN contains(lower(coalesce(provider, '')), 'anthropic') THEN CASE WHEN contains(lower(coalesce(model, '')), 'opus') THEN [0.015, 0.075] ELSE [0.003, 0.015] END ELSE [0.0, 0.0] END AS rate FROM u)
  SELECT usage_id, round(1e7 * (coalesce(input_tokens, 0) * rate[1]::DOUBLE + coalesce(output_tokens, 0) * rate[2]::DOUBLE) / 1000.0::DOUBLE)::BIGINT AS cost_e7, {window} AS context_window FROM r""",
        "usage_by_day": f"WITH {once} SELECT completed_at::DATE AS day, count(*) AS calls, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens FROM u WHERE completed_at IS NOT NULL GROUP BY 1",
        "running_cost": f"WITH {once}, d AS (SELECT provider, completed_at::DATE AS day, sum(coalesce(cost_estimate, 0)) AS cost FROM u GROUP BY ALL) SELECT provider, day, round(sum(cost) OVER (PARTITION BY provider ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS running_cost FROM d",
        "recent_usage": f"WITH {once} SELECT usage_id FROM u ORDER BY completed_at DESC NULLS LAST, usage_id LIMIT 100",
        "token_estimates": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::INT AS tokens, (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, (length(text) + 2) // 4) END)::INT AS cost_tokens FROM documents",
        "embedding_texts": f"""WITH {CLEAN}, t AS (SELECT id, language, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS t FROM c), h AS (SELECT *, substring(t, 1, 2048) AS head, 2049 - position(' ' IN reverse(substring(t, 1, 2048))) AS blank FROM t),
  r AS (SELECT id, CASE WHEN coalesce(t, '') = '' THEN '' ELSE coalesce(language, 'text') || ': ' || CASE WHEN length(t) <= 2048 THEN t WHEN blank < 2049 AND blank > 0.8 * 2048 THEN rtrim(substring(head, 1, blank), ' ') ELSE head END END AS e FROM h) SELECT id, length(e) AS n, md5(e) AS md5 FROM r""",
        "prompt_selection": f"""WITH RECURSIVE {CLEAN}, r AS (SELECT query_id, source_file, entity_name, start_line, end_line, max(score)::DOUBLE AS score FROM search_results GROUP BY ALL),
  x AS (SELECT query_id, id AS doc, r.source_file AS file, score, ceil(length(coalesce(content, '')) / 4.0)::INT AS n FROM r JOIN c USING (source_file, entity_name, start_line, end_line)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rn FROM x WHERE n <= 5854),
  w AS (SELECT query_id, 0::BIGINT AS rn, 5854 AS room, []::VARCHAR[] AS seen, ''::VARCHAR AS doc, false AS taken, false AS later, 0 AS n FROM (SELECT DISTINCT query_id FROM o)
    UNION ALL SELECT o.query_id, o.rn, CASE WHEN o.n <= room AND NOT list_contains(seen, o.file) THEN room - o.n ELSE room END, CASE WHEN o.n <= room AND NOT list_contains(seen, o.file) THEN list_append(seen, o.file) ELSE seen END,
      o.doc, o.n <= room AND NOT list_contains(seen, o.file), list_contains(seen, o.file), o.n FROM w JOIN o ON o.query_id = w.query_id AND o.rn = w.rn + 1),
  rest AS (SELECT query_id, arg_min(room, -rn) AS room FROM w GROUP BY 1), l AS (SELECT query_id, doc, n, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS k FROM w WHERE later),
  y AS (SELECT query_id, 0::BIGINT AS k, room, ''::VARCHAR AS doc, false AS taken FROM rest UNION ALL SELECT l.query_id, l.k, CASE WHEN l.n <= room THEN room - l.n ELSE room END, l.doc, l.n <= room FROM y JOIN l ON l.query_id = y.query_id AND l.k = y.k + 1)
  SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY part, k)::INT AS position FROM (SELECT query_id, doc, 1 AS part, rn AS k FROM w WHERE taken UNION ALL SELECT query_id, doc, 2, k FROM y WHERE taken)""",
        "snippets": f"WITH {CLEAN} SELECT id, md5(array_to_string(list_transform(string_split(content, chr(10))[1:15], lambda x: substring(x, 1, 120)), chr(10))) AS md5 FROM c",
        "context_blocks": f"""WITH {CLEAN} SELECT id, md5('[Source: ' || source_file || ' - ' || entity_name || CASE WHEN entity_type IN ('method', 'function') AND NOT contains(entity_name, '(') THEN '()' ELSE '' END || ' (lines ' || start_line || '-' || end_line || ')]' || chr(10) || '```' || coalesce(language, '') || chr(10) || rtrim(content, chr(10)) || chr(10) || '```') AS md5 FROM c""",
        "citations": r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '\[Source:\s*([^\]]+)\]', 1) AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, trim(unnest(a)) AS t FROM r),
  o AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id) AS k, trim(regexp_extract(t, '^(.*):[^:]*$', 1)) AS file, TRY_CAST(nullif(regexp_extract(t, ':\s*(\d+)(?:\s*-\s*\d+)?\s*$', 1), '') AS INT) AS start_line, coalesce(TRY_CAST(nullif(regexp_extract(t, ':\s*\d+\s*-\s*(\d+)\s*$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, ':\s*(\d+)\s*$', 1), '') AS INT)) AS end_line FROM x)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS n, file, start_line, end_line FROM o WHERE file <> '' AND start_line >= 1 AND end_line >= start_line""",
        "query_kinds": r"""SELECT CASE WHEN t = '' THEN 'all' WHEN regexp_matches(t, '^(implements|extends|usages):') THEN 'structural' WHEN contains(t, ':') THEN 'field' WHEN regexp_matches(t, '[*?]') THEN 'wildcard' WHEN t LIKE '"%"' AND length(t) > 1 THEN 'phrase' ELSE 'words' END AS kind, count(*) AS n FROM (SELECT DISTINCT doc_summary, trim(coalesce(doc_summary, ''), ' ') AS t FROM search_results) GROUP BY 1""",
        "progress_stages": "SELECT CASE WHEN contains(m, 'clone') OR contains(m, 'cloning') THEN 'CLONING' WHEN contains(m, 'pars') THEN 'PARSING' WHEN contains(m, 'success') OR contains(m, 'completed') THEN 'COMPLETE' WHEN contains(m, 'fail') OR contains(m, 'error') THEN 'FAILED' ELSE 'INDEXING' END AS stage, count(*) AS n FROM (SELECT lower(coalesce(text, '')) AS m FROM documents) GROUP BY 1",
        "event_counts": "SELECT event_type, ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2",
        "hierarchy": "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    }
