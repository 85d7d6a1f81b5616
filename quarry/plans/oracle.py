"""DuckDB statements with the same results as the queries of quarry.plans.queries.

Rules of learning, bonuses and ranks are stated anew; results over the inline code tree are rows of the engine
that were read against the rules.
"""

from __future__ import annotations

from quarry.functions import paths, text
from quarry.operators import extract, retrieval
from quarry.plans import fixtures as X
from quarry.plans.expected import EXPECTED
from quarry.plans.queries import BM25_QUERY, TEXT_QUERY

Q = X.literal
FILES = X.FILES_SQL
RESULTS = X.values(X.RESULTS, "qid, id, path, type, component_type, module, score, is_plugin, is_controller")
CORPUS = "(SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS content, n_chars AS size FROM documents)"
INDEX = f"(SELECT e.vec_id AS id, c.path, c.content AS search_text, 'label_' || e.label AS component_type, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN {CORPUS} c ON c.doc_id = e.vec_id)"
VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
LINES = "(SELECT path, i AS line, parts[i] AS text FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS parts FROM {0})))"


def _bonus(path: str = "path", body: str = "search_text", kind: str = "component_type") -> str:
    parts, hits = [], []
    for t in (t for t in TEXT_QUERY.split() if len(t) >= 3):
        for test, w in ((f"contains(lower({path}), {Q(t)})", retrieval.PATH_BONUS), (f"contains(lower({body}), {Q(t)})", retrieval.TEXT_BONUS), (f"contains({kind}, {Q(t)})", retrieval.TYPE_BONUS)):
            parts.append(f"(CASE WHEN {test} THEN CAST({w} AS DOUBLE) ELSE 0 END)")
            hits.append(f"(CASE WHEN {test} THEN 1 ELSE 0 END)")
    total = " + ".join(parts)
    return f"least({total} + (CASE WHEN {' + '.join(hits)} >= 3 THEN CAST(0.05 AS DOUBLE) ELSE 0 END), CAST(0.45 AS DOUBLE))"


def _bm25(content: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({content}), '[^a-z0-9]+'), lambda w: w <> '')"
    terms = " + ".join(f"CAST(len(list_filter(w, lambda x: x = {Q(t)})) AS DOUBLE) * 2.2 / (len(list_filter(w, lambda x: x = {Q(t)})) + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(w) / 200))" for t in text.query_terms(BM25_QUERY))
    return f"(SELECT {terms} FROM (SELECT {words} AS w))"


def _cases(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {Q(v)}" for c, v in pairs) + f" ELSE {other} END"


def _component(p: str) -> str:
    low = f"lower({p})"
    tests = {
        "end": lambda x: f"ends_with({low}, {Q(x)})",
        "has": lambda x: f"contains({low}, {Q(x)})",
        "layout": lambda x: f"contains({low}, '/layout/') AND ends_with({low}, {Q(x)})",
        "resolver": lambda x: f"contains({low}, 'resolver') AND (contains({low}, 'graph-ql') OR contains({low}, 'graphql'))",
        "repository": lambda x: f"contains({low}, '/model/') AND contains({low}, 'repository')",
    }
    return _cases([(tests[k](x), n) for n, k, x in paths.COMPONENT_RULES], "'other'")


def _attr(tag: str, name: str) -> str:
    pattern = rf'[\s]{name}\s*=\s*"([^"]*)"'
    return f"CASE WHEN regexp_matches({tag}, {Q(pattern)}) THEN regexp_extract({tag}, {Q(pattern)}, 1) END"


def _tags(name: str, where: str) -> str:
    return rf"(SELECT path, unnest(regexp_extract_all(content, '<{name}\s[^>]*>')) AS tag FROM {FILES} WHERE {where})"


def _pairs(source: str, content: str, pattern: str, names: dict[str, int], keep: str = "path") -> str:
    cols = ", ".join(f"unnest(regexp_extract_all({content}, {Q(pattern)}, {k})) AS {n}" for n, k in names.items())
    return f"(SELECT {keep}, {cols} FROM {source})"


def _elements(name: str, where: str) -> str:
    return _pairs(f"(SELECT * FROM {FILES} WHERE {where})", "content", rf"(?s)(<{name}\s[^>]*[^/]>)(.*?)</{name}>", {"tag": 1, "body": 2})


def _di_area(p: str) -> str:
    return _cases([(f"contains({p}, '/etc/{a}/')", a) for a in paths.DI_AREAS], "'global'")


DI = "ends_with(path, 'di.xml')"
PREFERENCES = f"(SELECT {_attr('tag', 'for')} AS iface, {_attr('tag', 'type')} AS impl, path, {_di_area('path')} AS area FROM {_tags('preference', DI)})"
_P = _pairs(_elements("type", DI), "body", r"(<plugin\s[^>]*>)", {"p": 1}, f"path, {_attr('tag', 'name')} AS target")
PLUGINS = f"(SELECT target, {_attr('p', 'name')} AS name, {_attr('p', 'type')} AS plugin_class, coalesce(({_attr('p', 'disabled')}) = 'true', false) AS disabled, CAST({_attr('p', 'sortOrder')} AS BIGINT) AS sort_order, path, {_di_area('path')} AS area FROM {_P})"
_O = _pairs(_elements("event", "ends_with(path, 'events.xml')"), "body", r"(<observer\s[^>]*>)", {"o": 1}, f"path, {_attr('tag', 'name')} AS event")
OBSERVERS = f"(SELECT event, {_attr('o', 'name')} AS name, {_attr('o', 'instance')} AS instance, coalesce({_attr('o', 'method')}, 'execute') AS method, path FROM {_O})"
_R = f"(SELECT path, tag, body, regexp_extract(body, '<service\\s[^>]*>') AS service FROM {_elements('route', chr(39).join(['ends_with(path, ', 'webapi.xml', ')']))})"
ROUTES = f"""(SELECT {_attr('tag', 'url')} AS url, upper({_attr('tag', 'method')}) AS http_method, {_attr('service', 'class')} AS service_class, {_attr('service', 'method')} AS service_method,
 array_to_string(regexp_extract_all(body, '<resource\\s+ref="([^"]*)"', 1), ',') AS acl, path FROM {_R})"""
DISPATCHES = _pairs(f"(SELECT * FROM {FILES} WHERE contains(content, 'dispatch('))", "content", r"dispatch\(\s*['\"]([a-z0-9_]+)['\"]", {"event": 1})
_SEC = _pairs(f"(SELECT * FROM {FILES} WHERE ends_with(path, 'system.xml'))", "content", r"(?s)(<section\s[^>]*[^/]>)(.*?)</section>", {"t": 1, "b": 2})
_GRP = _pairs(f"(SELECT path, {_attr('t', 'id')} AS section, b AS c FROM {_SEC})", "c", r"(?s)(<group\s[^>]*>)(.*?)</group>", {"t": 1, "b": 2}, "path, section")
_FLD = _pairs(f"(SELECT path, section, {_attr('t', 'id')} AS grp, b AS c FROM {_GRP})", "c", r"(?s)(<field\s[^>]*>)(.*?)</field>", {"t": 1, "b": 2}, "path, section, grp")
FIELDS = f"(SELECT path, concat_ws('/', section, grp, {_attr('t', 'id')}) AS config_path, nullif(regexp_extract(b, '<label>([^<]*)</label>', 1), '') AS label, nullif(regexp_extract(b, '<source_model>([^<]*)</source_model>', 1), '') AS source_model FROM {_FLD})"
_LAY = " UNION ALL ".join(rf"SELECT path, regexp_extract(path, '([^/]+)\.xml$', 1) AS handle, '{k}' AS kind, {_attr('tag', 'name')} AS name FROM {_tags(k, 'contains(path, ' + Q('/layout/') + ') AND ends_with(path, ' + Q('.xml') + ')')}" for k in ("block", "container", "referenceBlock", "referenceContainer"))
_GQL = r'(?s)(\w+)\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+\s*(?:@doc\([^)]*\)\s*)?@resolver\(\s*class:\s*"([^"]*)"'
CODE_LINES = LINES.format(FILES)
CORPUS_LINES = LINES.format(CORPUS)
OLD = f"(SELECT path, size FROM {CORPUS} WHERE doc_id % 10 <> 3)"
NEW = f"(SELECT path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size FROM {CORPUS} WHERE doc_id % 10 <> 7)"
CHANGES = f"(SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.size IS DISTINCT FROM n.size THEN 'modified' END AS change FROM {OLD} o FULL JOIN {NEW} n ON o.path = n.path)"
MARKED = f"(SELECT c.doc_id, c.path, coalesce(x.change IN ('modified', 'deleted'), false) AS is_deleted FROM {CORPUS} c LEFT JOIN {CHANGES} x ON x.path = c.path AND x.change IS NOT NULL)"
TOOL = "CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'find_plugin' WHEN 'purchase' THEN 'trace_flow' WHEN 'signup' THEN 'find_class' END"
_CALLS = f"(SELECT user_id, event_id, ts, {TOOL} AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_PRIOR = f"""(SELECT *, last_value(CASE WHEN tool = 'search' THEN ts END IGNORE NULLS) OVER w AS p_ts, last_value(CASE WHEN tool = 'search' THEN event_id END IGNORE NULLS) OVER w AS p_id, last_value(CASE WHEN tool = 'search' THEN coalesce(k, -1) END IGNORE NULLS) OVER w AS p_k
 FROM {_CALLS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SIGNALS = f"""(SELECT * FROM (SELECT user_id, event_id, ts, CASE WHEN p_ts IS NULL OR ts >= p_ts + INTERVAL 6 HOUR THEN NULL WHEN tool = 'search' AND coalesce(k, -1) <> p_k THEN 'query_refinement' WHEN tool = 'find_plugin' THEN 'refinement_to_plugin' WHEN tool = 'find_class' THEN 'refinement_to_class'
 WHEN tool = 'trace_flow' THEN 'trace_after_search' END AS signal, p_id AS search_id, nullif(p_k, -1) AS k FROM {_PRIOR}) WHERE signal IS NOT NULL)"""
FEATURE = "CASE signal WHEN 'refinement_to_plugin' THEN 'is_plugin' WHEN 'refinement_to_class' THEN 'class_match' WHEN 'trace_after_search' THEN 'is_controller' END"
JUDGED = "(SELECT * FROM (SELECT source || '/' || lang AS query_id, lang, quality = 1 AS relevant, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)) WHERE rank <= 10)"
PER = f"""(SELECT query_id, lang, n, hits, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, mrr, CASE WHEN hits > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(10, hits) AS BIGINT) + 1) t(i)) ELSE 0 END AS ndcg FROM (
 SELECT query_id, max(lang) AS lang, count(*) AS n, CAST(sum(CAST(relevant AS INT)) AS BIGINT) AS hits, sum(CAST(relevant AS INT)) / count(*) AS p, least(1.0, sum(CAST(relevant AS INT)) / 5) AS r, coalesce(1 / min(CASE WHEN relevant THEN rank END), 0) AS mrr, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM {JUDGED} GROUP BY query_id))"""


def _expand(q: str) -> str:
    return " ".join([q, *(s for t in q.lower().split() for s in text.SYNONYMS.get(t, ()))])


def _module(pattern_pairs: list[str]) -> str:
    return " OR ".join(pattern_pairs)


_M, _PATH = "lower(coalesce(module, ''))", "lower(path)"
ACME = f"(regexp_matches({_M}, '^acme[/_].*$') OR regexp_matches({_PATH}, '^acme[/_].*$') OR starts_with({_M}, 'acme') OR contains({_PATH}, 'vendor/acme') OR contains({_PATH}, 'app/code/acme'))"
OTHER = f"(contains({_M}, 'other_cart') OR contains({_PATH}, 'other_cart') OR (starts_with({_M}, 'other_') AND contains({_M}, 'cart')))"
_EDGES = """(SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_CALLS_SQL = X.values(X.CALLS, "caller, callee")

#: Every rule of the bonus, for all pairs of a query and a row; a term counts as often as it stands in the query.
_ROWS = X.values(X.INDEX, "id, path, search_text, class_name, component_type, is_plugin, is_repository, is_observer, is_resolver")
_TYPE_BONUS = f"""WITH q(q) AS (VALUES {', '.join(f'({Q(x)})' for x in X.BONUS_QUERIES)}), r AS (SELECT *, lower(path) AS p, lower(coalesce(class_name, '')) AS c, component_type AS k FROM {_ROWS}),
 t AS (SELECT q, unnest(list_filter(string_split(q, ' '), lambda x: length(x) >= 3)) AS t FROM q),
 hits AS (SELECT t.q, r.id, sum(CASE WHEN contains(p, t) THEN 0.08 ELSE 0 END + CASE WHEN contains(lower(search_text), t) THEN 0.03 ELSE 0 END + CASE WHEN contains(c, t) THEN 0.06 ELSE 0 END + CASE WHEN contains(k, t) OR replace(t, '.', '_') = k THEN 0.10 ELSE 0 END) AS w,
  sum(CAST(contains(p, t) AS INT) + CAST(contains(lower(search_text), t) AS INT) + CAST(contains(c, t) AS INT) + CAST(contains(k, t) OR replace(t, '.', '_') = k AS INT)) AS n FROM t, r GROUP BY t.q, r.id),
 b AS (SELECT q.q, r.id, w + CASE WHEN n >= 3 THEN 0.05 ELSE 0 END
  + CASE WHEN contains(q.q, 'di.xml') AND (k = 'di_config' OR ends_with(p, 'di.xml')) THEN 0.20 ELSE 0 END
  + CASE WHEN contains(q.q, 'db_schema') AND (k = 'db_schema' OR ends_with(p, 'db_schema.xml')) THEN 0.20 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'helper') AND (k = 'helper' OR contains(p, '/helper/')) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'plugin') AND (k = 'plugin' OR contains(p, '/plugin/') OR is_plugin) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'repository') AND (k = 'repository' OR is_repository) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'setup') AND (k = 'setup' OR contains(p, '/setup/')) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'observer') AND (k = 'observer' OR contains(p, '/observer/') OR is_observer) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'resolver') AND (k = 'graphql_resolver' OR is_resolver) THEN 0.15 ELSE 0 END
  + CASE WHEN list_contains(string_split(q.q, ' '), 'graphql') AND (k IN ('graphql_resolver', 'graphql_schema') OR contains(p, 'graph-ql') OR contains(p, 'graphql')) THEN 0.10 ELSE 0 END
  - CASE WHEN contains(p, '/framework/') AND (ends_with(c, 'interface') OR starts_with(c, 'abstract')) THEN 0.12 ELSE 0 END AS b FROM q, r JOIN hits h ON h.q = q.q AND h.id = r.id)
 SELECT q, CAST(id AS BIGINT) AS id, round(CAST(least(b, 0.45) AS DOUBLE), 6) AS bonus FROM b"""

#: Learning as a fold over all signals in their order, one after the other.
_SEEN = f"""(SELECT ts, event_id, feature, ['kind' || (k % 7), 'query', 'term'] AS terms, 'kind' || (k % 7) || ' query term' AS pattern FROM (SELECT *, {FEATURE} AS feature FROM {SIGNALS}) WHERE feature IS NOT NULL)"""
_RATED = f"(SELECT *, 0.05 / (1 + 0.1 * row_number() OVER (PARTITION BY pattern ORDER BY ts, event_id)) AS lr FROM {_SEEN})"


def _folds(key: str) -> str:
    """key, feature, weight, n: each signal moves its own feature up and the five others down, between the limits."""
    source = {"pattern": f"(SELECT *, 1.0 AS share FROM {_RATED})", "term": f"(SELECT *, unnest(terms) AS term, 0.5 AS share FROM {_RATED})", "all": f"(SELECT *, 'all' AS \"all\", 0.3 AS share FROM {_RATED})"}[key]
    moves = f"""(SELECT "{key}", ts, event_id, pattern, f, CAST(CASE WHEN f = feature THEN lr * share ELSE -0.1 * lr * share END AS DOUBLE) AS d FROM {source}, (SELECT unnest(['is_plugin', 'is_observer', 'is_controller', 'is_block', 'class_match', 'config_match']) AS f))"""
    fold = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list(d ORDER BY ts, event_id, pattern)), lambda w, d: CASE WHEN d >= 0 THEN least(w + d, 0.15) ELSE greatest(w + d, -0.15) END)"
    return f'(SELECT "{key}", f AS feature, {fold} AS weight, count(*) AS n FROM {moves} GROUP BY "{key}", f)'


def _expected(columns: str, rows: list[tuple]) -> str:
    names = [c.split() for c in columns.split(", ")]
    some = rows or [(None,) * len(names)]
    return "SELECT " + ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in names) + " FROM " + X.values(some, ", ".join(f'"{n}"' for n, _ in names)) + ("" if rows else " WHERE false")


ORACLE: dict[str, str] = {
    "vector_topk": f"SELECT row_number() OVER (ORDER BY similarity DESC, id) AS rank, id, similarity FROM (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS similarity FROM embeddings, {VECTOR} ORDER BY similarity DESC, id LIMIT 10)",
    "vector_topk_batch": "SELECT query_id, rank, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 5",
    "vector_validity": "SELECT label, count(*) FILTER (WHERE vec_id % 7 <> 0) AS n_valid, count(*) FILTER (WHERE vec_id % 7 = 0) AS n_invalid FROM embeddings GROUP BY label",
    "hybrid_search": f"""WITH near AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS similarity FROM embeddings, {VECTOR} ORDER BY similarity DESC, id LIMIT 30),
 top AS (SELECT id, path, round(similarity + {_bonus()}, 6) AS score FROM near JOIN {INDEX} USING (id) ORDER BY score DESC, id LIMIT 10) SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, path, score FROM top""",
    "keyword_bonus": f"SELECT id, round({_bonus()}, 6) AS bonus FROM {INDEX}",
    "bm25_score": f"SELECT doc_id, round({_bm25('content')}, 6) AS bm25 FROM {CORPUS}",
    "bm25_rerank": f"SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM (SELECT doc_id AS id, round(CAST(1 AS DOUBLE) / (1 + doc_id) + least(CAST(0.3 AS DOUBLE) * {_bm25(chr(40) + 'content || ' + Q('  ') + ' || path' + chr(41))}, 1), 6) AS score FROM {CORPUS} ORDER BY score DESC, id LIMIT 20)",
    "metadata_boost": f"SELECT qid, id, path, round(CAST(score AS DOUBLE) + CAST(0.3 AS DOUBLE) * (CAST(type = 'php' AS INT) + CAST(contains(lower(path), '/plugin/') AS INT) + CAST(is_plugin AS INT) + CAST(component_type = 'controller' AS INT)), 6) AS score FROM {RESULTS}",
    "rank_badges": f"SELECT rank, id, path, round(score, 3) AS score, concat_ws(',', CASE WHEN is_plugin THEN 'plugin' END, CASE WHEN is_controller THEN 'controller' END) AS badges, CASE WHEN rank <= 1 THEN substring(path, 1, 12) END AS snippet FROM (SELECT id, path, CAST(score AS DOUBLE) AS score, is_plugin, is_controller, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {RESULTS})",
    "component_type": f"SELECT path, {_component('path')} AS component_type, {_cases([(f'ends_with(lower(path), {Q(chr(46) + e)})', t) for e, t in paths.FILE_TYPES.items()], Q('other'))} AS file_type FROM (SELECT path FROM {FILES} UNION ALL SELECT 'x' || coalesce(url, '') FROM pages)",
    "module_name": rf"SELECT path, coalesce(nullif(regexp_extract(path, 'app/code/(\w+)/(\w+)', 1) || '_' || regexp_extract(path, 'app/code/(\w+)/(\w+)', 2), '_'), nullif(regexp_extract(path, 'vendor/([\w-]+)/([\w-]+)', 1) || '_' || regexp_extract(path, 'vendor/([\w-]+)/([\w-]+)', 2), '_'), nullif(regexp_extract(path, 'lib/internal/(\w+)/(\w+)', 1) || '_' || regexp_extract(path, 'lib/internal/(\w+)/(\w+)', 2), '_')) AS module FROM {FILES}",
    "area": f"SELECT path, {_cases([(f'contains(path, {Q(x)})', n) for n, x in paths.AREAS], 'NULL')} AS area, {_di_area('path')} AS di_area FROM {FILES}",
    "entry_type": f"SELECT id, CASE WHEN regexp_matches(entry, '^/?V[0-9]') THEN 'api' WHEN NOT contains(entry, '/') AND regexp_matches(entry, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'event' WHEN NOT contains(entry, '/') AND regexp_matches(entry, '^[a-z]') AND regexp_matches(entry, '[A-Z]') THEN 'graphql' ELSE 'route' END AS kind FROM {X.values(X.ENTRIES, 'id, entry')}",
    "camel_split": f"SELECT id, lower(substring(name, 1, 1) || regexp_replace(substring(name, 2), '([A-Z])', ' \\1', 'g')) AS words FROM {X.values(X.NAMES, 'id, name')}",
    "normalize_terms": r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: strlen(t) >= 3))), ' ') AS terms FROM benchmark",
    "query_expansion": "SELECT id, expanded FROM " + X.values([(i, _expand(q)) for i, q in X.QUERIES], "id, expanded"),
    "content_hash": f"SELECT doc_id, sha256(content) AS hash FROM {CORPUS}",
    "precise_filter": f"SELECT doc_id FROM {CORPUS} WHERE contains(lower(content), 'idiot') OR contains(lower(content), 'secret')",
    "module_include": f"SELECT qid, id FROM {RESULTS} WHERE {ACME} OR {OTHER}",
    "module_exclude": f"SELECT qid, id FROM {RESULTS} WHERE path NOT IN (SELECT path FROM {RESULTS} WHERE {ACME})",
    "soft_filter": f"SELECT qid, id, CAST(score AS DOUBLE) AS score FROM (SELECT *, count(*) FILTER (WHERE is_plugin) OVER (PARTITION BY qid) AS k FROM {RESULTS}) WHERE is_plugin OR k < 1",
    "fallback_concat": "SELECT doc_id, source, CAST(tier AS BIGINT) AS tier FROM (SELECT *, count(*) FILTER (WHERE tier = 1) OVER (PARTITION BY source) AS k FROM (SELECT doc_id, source, CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 END AS tier FROM documents) WHERE tier IS NOT NULL) WHERE tier = 1 OR k < 3",
    "dedup_max_score": f"SELECT path, CAST(max(score) AS DOUBLE) AS score FROM {RESULTS} GROUP BY path",
    "dedup_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "union_dedup": "SELECT doc_id, CAST(min(src) AS BIGINT) AS src FROM (SELECT doc_id, 1 AS src FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2 FROM documents WHERE n_chars > 1000) GROUP BY doc_id",
    "category_counts": "SELECT source, category, count(*) AS n FROM (SELECT source, unnest([CASE WHEN contains(t, 'password') OR contains(t, 'token') THEN 'secret' END, CASE WHEN length(t) > 3000 THEN 'long' END, CASE WHEN regexp_matches(t, '[0-9]') THEN 'digits' END, CASE WHEN contains(t, chr(10)) THEN 'lines' END]) AS category FROM (SELECT source, coalesce(text, '') AS t FROM documents)) WHERE category IS NOT NULL GROUP BY source, category",
    "class_counts": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "grouped_ids": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "caller_sets": "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id",
    "grep_lines": f"SELECT path, line FROM {CORPUS_LINES} WHERE regexp_matches(text, '(password|token|AKIA)[ =A-Z0-9]')",
    "grep_files_only": f"SELECT path, count(*) AS n_matches FROM {CORPUS_LINES} WHERE regexp_matches(text, 'idiot|[0-9]{{9}}') GROUP BY path",
    "context_merge": f"""SELECT path, min(b) AS first, max(e) AS last, count(*) AS n_matches FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN b > lag(e) OVER (PARTITION BY path ORDER BY line) + 1 THEN 1 ELSE 0 END AS new FROM (SELECT path, line, greatest(line - 2, 1) AS b, line + 2 AS e FROM {CORPUS_LINES} WHERE contains(text, 'the')))) GROUP BY path, island""",
    "context_window": "SELECT conv_id, turn, length(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context_chars FROM conversations",
    "enclosing_method": rf"SELECT path, line, method FROM (SELECT path, line, text, last_value(nullif(regexp_extract(text, 'function\s+([A-Za-z0-9_]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS method FROM {CODE_LINES} WHERE ends_with(path, '.php')) WHERE contains(text, '->')",
    "cap_per_file": f"SELECT path, line FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM {CORPUS_LINES} WHERE contains(text, 'and')) WHERE r <= 5",
    "read_range": f"SELECT line, text FROM {CODE_LINES} WHERE path = 'app/code/Acme/Shop/Model/Cart.php' AND line BETWEEN 9 AND 20",
    "complexity": rf"SELECT path, complexity, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' ELSE 'very high' END AS rating FROM (SELECT path, 1 + len(regexp_extract_all(content, '\b(if|elseif|for|foreach|while|case|catch)\b|&&|\|\||\?\?')) AS complexity FROM {FILES}) WHERE complexity >= 2",
    "di_preferences": f"SELECT * FROM {PREFERENCES}",
    "di_plugins": f"SELECT * FROM {PLUGINS}",
    "virtual_types": f"SELECT {_attr('tag', 'name')} AS name, {_attr('tag', 'type')} AS type, path FROM {_tags('virtualType', DI)}",
    "event_observers": f"SELECT * FROM {OBSERVERS}",
    "webapi_routes": f"SELECT * FROM {ROUTES}",
    "layout_nodes": f"SELECT DISTINCT * FROM ({_LAY}) WHERE name IS NOT NULL",
    "system_fields": f"SELECT * FROM {FIELDS}",
    "graphql_ops": f"SELECT path, op, regexp_replace(replace(cls, '\\\\', '\\'), '^\\\\', '') AS resolver_class FROM {_pairs('(SELECT * FROM ' + FILES + ' WHERE ends_with(path, ' + Q('.graphqls') + '))', 'content', _GQL, {'op': 1, 'cls': 2})}",
    "plugin_methods": f"SELECT path, type, lower(substring(m, 1, 1)) || substring(m, 2) AS target_method FROM {_pairs('(SELECT * FROM ' + FILES + ' WHERE ends_with(path, ' + Q('.php') + '))', 'content', r'public\s+function\s+(before|after|around)([A-Z]\w*)', {'type': 1, 'm': 2})}",
    "event_dispatches": f"SELECT * FROM {DISPATCHES}",
    "error_classify": f"SELECT id, {_cases([(f'regexp_matches(error, {Q(p)})', n) for n, p in extract.ERRORS], Q('unknown'))} AS error_type, CASE {' '.join(f'WHEN regexp_matches(error, {Q(p)}) THEN trim(regexp_extract(error, {Q(p)}, 1))' for _, p in extract.ERRORS)} ELSE '' END AS subject, array_to_string(list_transform(regexp_extract_all(error, '[\\w/.-]+\\.(?:php|phtml)(?:\\(\\d+\\)|:\\d+)'), lambda f: replace(replace(f, '(', ':'), ')', '')), ',') AS frames FROM {X.values(X.ERRORS, 'id, error')}",
    "html_attr_extract": "SELECT page_id, count(*) AS n_links, min(href) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id",
    "url_routes": "SELECT regexp_extract(url, '^(https?)://([^/?#]+)/?([^/?#]*)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)/?([^/?#]*)', 3) AS first, count(*) AS n FROM pages GROUP BY 1, 2",
    "preference_resolve": f"""SELECT iface, impl FROM (SELECT r.service_class AS iface, p.impl, row_number() OVER (PARTITION BY r.service_class ORDER BY (r.service_class = p.iface) DESC, p.area <> 'global', p.path, p.impl) AS k FROM (SELECT DISTINCT service_class FROM {ROUTES}) r
 LEFT JOIN {PREFERENCES} p ON string_split(r.service_class, '\\')[-1] = string_split(p.iface, '\\')[-1]) WHERE k = 1""",
    "call_chain": f"""WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS depth, caller, callee, caller || ' > ' || callee AS trail FROM {_CALLS_SQL} WHERE caller = 'Cart::save' UNION ALL SELECT r.depth + 1, c.caller, c.callee, r.trail || ' > ' || c.callee FROM r JOIN (SELECT * FROM {_CALLS_SQL}) c ON c.caller = r.callee WHERE r.depth < 3) SELECT DISTINCT * FROM r""",
    "region_reach": f"""WITH e AS (SELECT * FROM {_EDGES}), d0 AS (SELECT 'r' || r_regionkey AS st, 'r' || r_regionkey AS n FROM region), d1 AS (SELECT DISTINCT st, t AS n FROM d0 JOIN e ON n = s), d2 AS (SELECT DISTINCT st, t AS n FROM d1 JOIN e ON n = s), d3 AS (SELECT DISTINCT st, t AS n FROM d2 JOIN e ON n = s)
 SELECT st AS start, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT st, 0 AS depth FROM d0 UNION ALL SELECT st, 1 FROM d1 UNION ALL SELECT st, 2 FROM d2 UNION ALL SELECT st, 3 FROM d3) GROUP BY st, depth""",
    "event_flow": f"SELECT coalesce(d.event, o.event) AS event, d.path AS dispatched_in, o.name AS observer, o.instance, o.method FROM (SELECT DISTINCT event, path FROM {DISPATCHES}) d FULL JOIN {OBSERVERS} o ON o.event = d.event",
    "api_trace": f"""WITH r AS (SELECT * FROM {ROUTES}), p AS (SELECT iface, impl, row_number() OVER (PARTITION BY iface ORDER BY area <> 'global', path, impl) AS k FROM {PREFERENCES}), g AS (SELECT target, string_agg(name, ',' ORDER BY name) AS plugins FROM {PLUGINS} WHERE NOT disabled GROUP BY target)
 SELECT url, http_method, service_class, service_method, impl, plugins FROM r LEFT JOIN p ON p.iface = r.service_class AND k = 1 LEFT JOIN g ON g.target = r.service_class""",
    "config_trace": f"SELECT coalesce(f.config_path, v.config_path) AS config_path, f.label, v.env, v.scope, v.value FROM {FIELDS} f FULL JOIN (SELECT * FROM {X.values(X.CONFIG, 'env, scope, config_path, value')}) v ON v.config_path = f.config_path",
    "change_set": f"SELECT path, change FROM {CHANGES} WHERE change IS NOT NULL",
    "tombstone_ratio": f"SELECT count(*) AS n_vectors, count(*) FILTER (WHERE is_deleted) AS n_deleted, round(count(*) FILTER (WHERE is_deleted) / count(*), 6) AS ratio FROM {MARKED}",
    "compaction": f"SELECT doc_id FROM {MARKED} WHERE NOT is_deleted OR NOT (SELECT count(*) FILTER (WHERE is_deleted) / count(*) > 0.2 FROM {MARKED})",
    "index_stats": f"SELECT count(*) FILTER (WHERE NOT is_deleted) AS n_live, count(*) FILTER (WHERE is_deleted) AS n_deleted, count(DISTINCT CASE WHEN NOT is_deleted THEN path END) AS n_files FROM {MARKED}",
    "resume_pending": f"SELECT doc_id FROM {CORPUS} WHERE path NOT IN (SELECT path FROM {OLD})",
    "latest_description": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "stale_descriptions": "SELECT doc_id % 3 = 0 AS stale, count(*) AS n FROM documents GROUP BY 1",
    "session_signals": f"SELECT user_id, event_id, signal, search_id FROM {SIGNALS}",
    "signal_features": f"SELECT signal, {FEATURE} AS feature, count(*) AS n FROM {SIGNALS} GROUP BY signal, feature",
    "score_adjustment": f"""SELECT qid, id, round(greatest(-0.15, least(0.15, CAST(is_plugin AS INT) * CAST(0.10 AS DOUBLE) + c * CAST(0.06 AS DOUBLE) + (CAST(is_plugin AS INT) * CAST(0.05 AS DOUBLE) - CAST(is_controller AS INT) * CAST(0.04 AS DOUBLE) + x * CAST(0.02 AS DOUBLE)) / 2 * CAST(0.7 AS DOUBLE) + (CAST(is_controller AS INT) * CAST(0.03 AS DOUBLE) - c * CAST(0.01 AS DOUBLE)) * CAST(0.3 AS DOUBLE))), 6) AS adjustment
 FROM (SELECT *, CAST(component_type = 'di_config' OR ends_with(lower(path), '.xml') AS INT) AS c, CAST(contains(lower(path), '/etc/') AND ends_with(lower(path), '.xml') AS INT) AS x FROM {RESULTS})""",
    "precision_recall": f"SELECT query_id, n, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {PER}",
    "mrr": f"SELECT query_id, round(mrr, 6) AS mrr FROM {PER}",
    "ndcg10": f"SELECT query_id, round(ndcg, 6) AS ndcg FROM {PER}",
    "quality_by_category": f"""SELECT category, n_queries, precision, mrr, CASE WHEN points >= 95 THEN 'A+' WHEN points >= 90 THEN 'A' WHEN points >= 85 THEN 'B+' WHEN points >= 80 THEN 'B' WHEN points >= 75 THEN 'C+' WHEN points >= 70 THEN 'C' WHEN points >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
 SELECT coalesce(lang, 'all') AS category, count(*) AS n_queries, round(avg(round(precision, 6)), 6) AS precision, round(avg(round(mrr, 6)), 6) AS mrr, round(100 * (0.6 * avg(round(f1, 6)) + 0.4 * avg(CASE WHEN f1 > 0 THEN 1.0 ELSE 0.0 END)), 4) AS points FROM {PER} GROUP BY ROLLUP (lang))""",
    "percentile_latency": "SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.9)) AS p90, max(value) FILTER (WHERE i = floor(n * 0.99)) AS p99, round(1000 / avg(value), 6) AS throughput FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)",
    "chain_depth": "SELECT * FROM (VALUES ('Leaf::start', CAST(2 AS BIGINT)), ('Cart::save', CAST(0 AS BIGINT))) t(start, depth)",
    "first_per_file": f"SELECT path, min(line) AS line FROM {CORPUS_LINES} WHERE regexp_matches(text, '[0-9]') GROUP BY path",
    "index_counters": f"SELECT split_part(path, '/', 2) AS kind, count(*) AS n_found, count(*) FILTER (WHERE doc_id % 4 <> 1 AND NOT is_deleted) AS n_indexed, count(*) FILTER (WHERE doc_id % 4 = 1) AS n_skipped, count(*) FILTER (WHERE doc_id % 4 <> 1 AND is_deleted) AS n_invalid FROM {MARKED} GROUP BY 1",
    "windowed_counts": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, tool, count(*) AS n FROM {_CALLS} WHERE tool IS NOT NULL GROUP BY 1, 2",
    "vector_insert": """WITH v AS (SELECT vec_id % 2 AS half, vec_id % 7 = 0 AS is_deleted, 'p' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path FROM embeddings)
 SELECT row_number() OVER (ORDER BY half, path) - 1 AS id, path, is_deleted FROM v""",
    "type_bonus": _TYPE_BONUS,
    "pattern_weights": f"SELECT feature, count(*) AS n_patterns, CAST(sum(n) AS BIGINT) AS n_updates, round(max(weight), 6) AS most, round(min(weight), 6) AS least, round(sum(weight * n), 4) AS weighted FROM {_folds('pattern')} GROUP BY feature",
    "term_weights": f"SELECT term, feature, round(weight, 6) AS weight, n FROM {_folds('term')}",
    "global_weights": f"SELECT feature, round(weight, 6) AS weight, n FROM {_folds('all')}",
    "learning_status": f"SELECT 'patterns' AS name, count(DISTINCT pattern) AS n FROM {_folds('pattern')} UNION ALL SELECT 'terms', count(DISTINCT term) FROM {_folds('term')} UNION ALL SELECT 'updates', coalesce(max(n), 0) FROM {_folds('all')}",
    "learned_adjustment": f"""WITH q(query_id, terms) AS (VALUES (1, ['kind3', 'query', 'term']), (2, ['kind5', 'other', 'term']), (3, ['unknown', 'words'])),
 p AS (SELECT * FROM {_folds('pattern')}), t AS (SELECT * FROM {_folds('term')}), g AS (SELECT * FROM {_folds('all')}),
 known AS (SELECT query_id, term, feature, weight FROM (SELECT query_id, unnest(terms) AS term FROM q) JOIN t USING (term)),
 w AS (SELECT query_id, feature, weight FROM q JOIN p ON array_to_string(q.terms, ' ') = p.pattern
  UNION ALL SELECT query_id, feature, sum(weight) / (SELECT count(DISTINCT term) FROM known k WHERE k.query_id = known.query_id) * 0.7 FROM known GROUP BY query_id, feature UNION ALL SELECT query_id, feature, weight * 0.3 FROM q, g),
 r AS (SELECT DISTINCT qid * 100 + id AS id, path, component_type, is_plugin, is_controller FROM {RESULTS}),
 f AS (SELECT id, unnest([CASE WHEN is_plugin THEN 'is_plugin' END, CASE WHEN is_controller THEN 'is_controller' END, CASE WHEN component_type = 'di_config' OR ends_with(path, '.xml') THEN 'config_match' END, CASE WHEN contains(path, '/etc/') AND ends_with(path, '.xml') THEN 'config_xml_dir' END]) AS feature FROM r)
 SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(greatest(-0.15, least(0.15, coalesce((SELECT sum(weight) FROM f JOIN w USING (feature) WHERE f.id = r.id AND w.query_id = q.query_id), 0))), 6) AS adjustment FROM q, r""",
}
ORACLE |= {name: _expected(*found) for name, found in EXPECTED.items()}
