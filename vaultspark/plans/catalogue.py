"""Queries of the engine's own operators, with DuckDB SQL for those that SQL can express.

Notes are the table files (latest row per path, readable frontmatter), calls are tool_calls, chunks are hits, vectors are
embeddings, texts are documents. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vaultspark.functions import paths
from vaultspark.functions import text as tx
from vaultspark.operators import browse, mutate, rules, search, telemetry, versions
from vaultspark.operators import predicates as pr
from vaultspark.operators.index import SearchIndex
from vaultspark.sources import formats
from vaultspark.session import shared_folder
from vaultspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def also(name: str, f) -> None:
    """A second name for a query."""
    QUERIES[name], ORACLES[name] = f, ORACLES[f.__name__]


def calls(spark, d):
    return table(spark, d, "tool_calls")


def docs(spark, d):
    return table(spark, d, "documents")


def notes(spark, d, *keep):
    return pr.catalog(table(spark, d, "files"), *keep)


def chunks(spark, d):
    """Hits once each, as chunks of their notes in order of lines."""
    return table(spark, d, "hits").dropDuplicates(["hit_id"]).withColumnRenamed("hit_id", "chunk_id").withColumn("ord", F.col("start_line"))


# --- telemetry ---------------------------------------------------------------------------------------------------------

_OK = "coalesce(ok, false)"
_AVG = lambda c: f"round(avg(CASE WHEN {c} IS NULL OR isnan({c}::DOUBLE) THEN 0 WHEN isinf({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END), 6)"
_MEASURES = f"count(*) AS calls, count(*) FILTER (WHERE {_OK}) AS ok, count(*) FILTER (WHERE NOT {_OK}) AS error, {_AVG('duration_ms')} AS avg_duration_ms, {_AVG('req_bytes')} AS avg_req_bytes, {_AVG('resp_bytes')} AS avg_resp_bytes"
_TOOL = "coalesce(nullif(tool, ''), '?')"
_SHAPES = f"(SELECT {_TOOL} AS tool, shape FROM (SELECT tool, unnest(CASE json_type(error_shape) WHEN 'ARRAY' THEN from_json(error_shape, '[\"VARCHAR\"]') WHEN 'VARCHAR' THEN [json_extract_string(error_shape, '$')] ELSE [] END) AS shape FROM tool_calls WHERE json_valid(error_shape)) WHERE shape <> '')"
_FLAG_SUMS = ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in telemetry.FLAGS)


@query(f"SELECT {_TOOL} AS tool, {_MEASURES}, {_FLAG_SUMS} FROM tool_calls GROUP BY 1")
def calls_by_tool(spark, d):
    """All calls count; those of infinite duration are left out of the average duration only."""
    return telemetry.by_tool(calls(spark, d))


also("calls_by_tool_all", calls_by_tool)


@query(f"SELECT coalesce(nullif(error, ''), 'error') AS error, count(*) AS calls FROM tool_calls WHERE NOT {_OK} GROUP BY 1")
def calls_by_error(spark, d):
    return telemetry.by_error(calls(spark, d))


@query(f"SELECT tool, shape, count(*) AS n FROM {_SHAPES} GROUP BY ALL")
def calls_by_error_shape(spark, d):
    return telemetry.by_error_shape(calls(spark, d))


@query("SELECT CASE WHEN length(ts) >= 10 THEN substr(ts, 1, 10) ELSE '?' END AS day, count(*) AS calls FROM tool_calls GROUP BY 1")
def calls_by_day(spark, d):
    return telemetry.by_day(calls(spark, d))


_VERSION = "apo_version"


@query(f"SELECT coalesce(nullif(trim({_VERSION}), ''), 'unknown') AS version, count(*) AS calls, count(*) FILTER (WHERE {_OK}) AS ok, count(*) FILTER (WHERE NOT {_OK}) AS error FROM tool_calls GROUP BY 1")
def calls_by_version(spark, d):
    return telemetry.by_version(calls(spark, d), _VERSION)


@query(f"""WITH e AS (SELECT {_TOOL} AS tool, CASE WHEN length(ts) >= 10 THEN substr(ts, 1, 10) ELSE '?' END AS day, coalesce(collection, '?') AS collection, {_OK} AS ok FROM tool_calls)
SELECT CASE grouping(tool, day, collection) WHEN 3 THEN 'tool' WHEN 5 THEN 'day' WHEN 6 THEN 'collection' ELSE 'all' END AS level, coalesce(tool, day, collection, '') AS key, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors
FROM e GROUP BY GROUPING SETS ((tool), (day), (collection), ())""")
def calls_grouping_sets(spark, d):
    return telemetry.all_rollups(calls(spark, d))


@query(f"""WITH p AS (SELECT trim(note_path) AS path, {_TOOL} AS tool, count(*) AS n, count(*) FILTER (WHERE {_OK}) AS ok FROM tool_calls WHERE trim(note_path) <> '' GROUP BY ALL)
SELECT path, CAST(sum(n) OVER w AS BIGINT) AS calls, CAST(sum(ok) OVER w AS BIGINT) AS ok, CAST(sum(n - ok) OVER w AS BIGINT) AS error, row_number() OVER (PARTITION BY path ORDER BY n DESC, tool) - 1 AS place, tool, n FROM p WINDOW w AS (PARTITION BY path)""")
def calls_by_path_nested(spark, d):
    p = telemetry.by_path(calls(spark, d))
    return p.select("path", "calls", "ok", "error", F.posexplode("by_tool").alias("place", "t")).select("path", "calls", "ok", "error", F.col("place").cast("long").alias("place"), "t.tool", "t.n")


@query(f"""WITH a AS (SELECT count(*) AS calls, count(*) FILTER (WHERE tool = 'search_notes') AS search_calls, count(*) FILTER (WHERE tool = 'search_notes' AND folder_set) AS scoped,
  count(*) FILTER (WHERE tool = 'get_note' AND chunk_hash IS NOT NULL) AS chunk_reads, count(*) FILTER (WHERE NOT {_OK}) AS errors, count(*) FILTER (WHERE tool = 'patch_note') AS patch_calls,
  count(*) FILTER (WHERE tool = 'patch_note' AND expected_mtime_set) AS patch_guarded, CAST(coalesce(sum(flaws_emitted), 0) AS BIGINT) AS flaws_emitted, CAST(coalesce(sum(flaws_auto_fixed), 0) AS BIGINT) AS flaws_auto_fixed FROM tool_calls),
b AS (SELECT *, coalesce(round(100.0 * scoped / nullif(search_calls, 0), 1), 0) AS folder_scoped_pct, coalesce(round(100.0 * chunk_reads / nullif(search_calls, 0), 1), 0) AS read_to_search_pct, coalesce(round(100.0 * errors / nullif(calls, 0), 1), 0) AS error_pct FROM a)
SELECT * EXCLUDE (scoped), array_to_string(list_filter([CASE WHEN search_calls > 0 AND folder_scoped_pct < 80 THEN 'scope searches to a folder' END, CASE WHEN search_calls > 0 AND read_to_search_pct < 10 THEN 'read chunks after a search' END,
  CASE WHEN error_pct > 5 THEN 'too many failed calls' END, CASE WHEN patch_guarded * 2 < patch_calls THEN 'guard repeated writes by their mtime' END], lambda x: x IS NOT NULL), '; ') AS tips FROM b""")
def kpi_ratios(spark, d):
    return telemetry.ratios(calls(spark, d))


@query(f"""WITH s AS {_SHAPES}, t AS (SELECT {_TOOL} AS tool, count(*) AS c FROM tool_calls GROUP BY 1), p AS (SELECT tool, shape, count(*) AS n FROM s GROUP BY ALL)
SELECT shape, CAST(sum(n) AS BIGINT) AS n, first(tool ORDER BY c DESC, tool) AS tool FROM p JOIN t USING (tool) GROUP BY shape ORDER BY n DESC, shape LIMIT 10""")
def top_shapes(spark, d):
    return telemetry.top_shapes(calls(spark, d))


@query(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n FROM tool_calls" for f in telemetry.FLAGS))
def flag_totals(spark, d):
    return telemetry.flag_totals(calls(spark, d))


@query("SELECT call_id, ts, tool FROM tool_calls WHERE ts >= '2017-01-03' AND ts < '2017-01-05' AND tool = 'search_notes'")
def calls_window(spark, d):
    return telemetry.window_of(calls(spark, d), since="2017-01-03", until="2017-01-05", tool="search_notes").select("call_id", "ts", "tool")


@query("SELECT CASE WHEN vault_id IN ('v-kimend', 'v-wanras') AND collection = 'default' THEN vault_id ELSE collection END AS collection, count(*) AS n FROM (SELECT vault_id, CASE WHEN call_id % 2 = 0 THEN 'default' ELSE collection END AS collection FROM tool_calls) GROUP BY 1")
def calls_remap(spark, d):
    half = calls(spark, d).withColumn("collection", F.when(F.col("call_id") % 2 == 0, "default").otherwise(F.col("collection")))
    return telemetry.remap_default(half, ["v-kimend", "v-wanras"]).groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT call_id, received_at, CAST(NULL AS VARCHAR) AS note_path, path_hash FROM tool_calls")
def calls_private(spark, d):
    return telemetry.private_paths(calls(spark, d)).select("call_id", "received_at", "note_path", "path_hash")


@query(f"""SELECT substr(sha256('trace:' || coalesce(conversation_id, call_id::VARCHAR)), 1, 32) AS trace_id, substr(sha256('span:' || call_id::VARCHAR), 1, 16) AS span_id, {_TOOL} AS name,
CASE WHEN {_OK} THEN 'OK' ELSE 'ERROR' END AS status, received_at, duration_ms FROM tool_calls""")
def calls_spans(spark, d):
    return telemetry.spans(calls(spark, d))


@query("SELECT conversation_id, call_id, received_at FROM tool_calls QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY received_at DESC, call_id DESC, ts) <= 2")
def latest_per_key(spark, d):
    return telemetry.latest_per(calls(spark, d), ["conversation_id"], [F.desc("received_at"), F.desc("call_id"), F.col("ts")], 2).select("conversation_id", "call_id", "received_at")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOURS AS due, count(*) AS n FROM n GROUP BY user_id, s""")
def debounce_sessions(spark, d):
    from vaultspark.streaming.debounce import quiet_periods

    return quiet_periods(table(spark, d, "events"), "user_id", "ts", "6 hours").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("due").cast("timestamp_ntz").alias("due"), "n")


# --- frontmatter predicates --------------------------------------------------------------------------------------------

_NOTES = """notes AS (SELECT path, mtime, vault_id, fm FROM (SELECT *, CASE WHEN json_valid(inner_text) AND json_type(inner_text) = 'OBJECT' THEN inner_text END AS fm FROM (
  SELECT *, CASE WHEN NOT json_valid(frontmatter) THEN NULL WHEN json_type(frontmatter) = 'VARCHAR' THEN json_extract_string(frontmatter, '$') ELSE frontmatter END AS inner_text FROM (
    SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1))) WHERE fm IS NOT NULL)"""
_HAS = lambda k: f"coalesce(json_type(fm, '$.{k}'), 'NULL') <> 'NULL'"
_STR = lambda k: f"json_extract_string(fm, '$.{k}')"
_LIST = lambda k: f"json_type(fm, '$.{k}') = 'ARRAY'"


def _select(test: str) -> str:
    return f"WITH {_NOTES} SELECT path, mtime FROM notes WHERE {test}"


def _where(spark, d, clauses, folder=None):
    n = notes(spark, d)
    return n.where(pr.in_folder(F.col("path"), folder) & pr.where(F.col("fm"), clauses)).select("path", "mtime")


@query(_select(f"{_HAS('status')} AND NOT {_HAS('tags')}"))
def filter_exists(spark, d):
    return _where(spark, d, {"status": {"$exists": True}, "tags": {"$exists": False}})


@query(_select(f"CASE WHEN {_LIST('pinned')} THEN len(list_filter(json_extract(fm, '$.pinned[*]'), lambda x: lower(trim(json_extract_string(x, '$'))) = 'true' OR x = '1')) > 0 ELSE {_HAS('pinned')} AND (lower(trim({_STR('pinned')})) = 'true' OR (json_type(fm, '$.pinned') IN ('UBIGINT', 'BIGINT') AND {_STR('pinned')} = '1')) END"))
def filter_eq_loose(spark, d):
    return _where(spark, d, {"pinned": True})


@query(_select(f"CASE WHEN {_LIST('status')} THEN NOT list_contains(list_transform(json_extract(fm, '$.status[*]'), lambda x: json_extract_string(x, '$')), 'open') ELSE {_HAS('status')} AND {_STR('status')} <> 'open' END"))
def filter_ne_not_null(spark, d):
    return _where(spark, d, {"status": {"$ne": "open"}})


@query(_select(f"CASE WHEN {_LIST('okf_type')} THEN false ELSE {_HAS('okf_type')} AND {_STR('okf_type')} IN ('decision', 'meeting') END"))
def filter_in(spark, d):
    return _where(spark, d, {"okf_type": {"$in": ["decision", "meeting"]}})


@query(_select(f"CASE WHEN {_LIST('tags')} THEN list_contains(list_transform(json_extract(fm, '$.tags[*]'), lambda x: json_extract_string(x, '$')), 'filter') WHEN json_type(fm, '$.tags') = 'VARCHAR' THEN contains(lower({_STR('tags')}), 'filter') ELSE false END"))
def filter_contains_list(spark, d):
    return _where(spark, d, {"tags": {"$contains": "filter"}})


@query(_select(f"json_type(fm, '$.title') = 'VARCHAR' AND contains(lower({_STR('title')}), 'queue')"))
def filter_contains_substring(spark, d):
    return _where(spark, d, {"title": {"$contains": "Queue"}})


@query(_select(f"{_HAS('priority')} AND CASE WHEN try_cast(trim({_STR('priority')}) AS DOUBLE) IS NOT NULL THEN try_cast(trim({_STR('priority')}) AS DOUBLE) >= 300 AND try_cast(trim({_STR('priority')}) AS DOUBLE) < 700 ELSE {_STR('priority')} >= '300' AND {_STR('priority')} < '700' END"))
def filter_range_numeric(spark, d):
    return _where(spark, d, {"priority": {"$gte": 300, "$lt": 700}})


@query(_select(f"{_HAS('last_activity')} AND {_STR('last_activity')} > '2015-06-01'"))
def filter_range_string(spark, d):
    return _where(spark, d, {"last_activity": {"$gt": "2015-06-01"}})


@query(_select(f"{_LIST('todos')} AND len(list_filter(json_extract(fm, '$.todos[*]'), lambda x: json_type(x) = 'OBJECT' AND json_extract_string(x, '$.status') = 'open')) > 0"))
def filter_elem_match(spark, d):
    return _where(spark, d, {"todos": {"$elemMatch": {"status": "open", "id": {"$exists": True}}}})


@query(_select("CASE json_type(fm, '$.todos') WHEN 'ARRAY' THEN len(list_filter(json_extract(fm, '$.todos[*]'), lambda x: json_type(x) = 'OBJECT' AND json_extract_string(x, '$.status') = 'done')) > 0 WHEN 'OBJECT' THEN coalesce(json_extract_string(fm, '$.todos.status') = 'done', false) ELSE false END"))
def filter_dotted_path(spark, d):
    return _where(spark, d, {"todos.status": "done"})


@query(_select("json_type(fm, '$.attendees') = 'ARRAY' AND coalesce(json_extract_string(fm, '$.attendees[0].contact.channel') = 'call', false)"))
def filter_indexed_path(spark, d):
    return _where(spark, d, {"attendees.0.contact.channel": "call"})


@query(_select("starts_with(path, 'projects/')"))
def filter_folder_prefix(spark, d):
    return _where(spark, d, None, "projects")


@query(f"WITH {_NOTES} SELECT path, mtime FROM notes WHERE NOT (starts_with(path, 'projects/') OR regexp_full_match(path, '.*/_drafts/.*') OR regexp_full_match(path, 'library/2024/[a-m].*'))")
def filter_exclude_globs(spark, d):
    return notes(spark, d).where(~pr.excluded(F.col("path"), ["projects/*", "*/_drafts/*", "library/2024/[a-m]*"])).select("path", "mtime")


@query(f"WITH {_NOTES}, m AS (SELECT path, mtime, count(*) OVER () AS total FROM notes WHERE {_HAS('status')}) SELECT * FROM m ORDER BY mtime DESC, path LIMIT 20 OFFSET 10")
def filter_page_total(spark, d):
    n, c = notes(spark, d), {"status": {"$exists": True}}
    total = pr.filter_total(n, c).scalar()
    return pr.filter_notes(n, c, limit=20, offset=10).select("path", "mtime", total.alias("total"))


_SORTED = "SELECT path, row_number() OVER (ORDER BY {gone}, {word}, {num} NULLS LAST, {txt} NULLS LAST, mtime DESC, path) AS place FROM (SELECT *, CASE WHEN p THEN try_cast(trim(t) AS DOUBLE) END AS num, CASE WHEN p THEN t END AS txt FROM (SELECT *, " + _HAS("priority") + " AS p, " + _STR("priority") + " AS t FROM notes)) QUALIFY place <= 50"


@query(f"WITH {_NOTES} " + _SORTED.format(gone="NOT p", word="p AND num IS NULL", num="num", txt="txt"))
def sort_nulls_last_asc(spark, d):
    return _placed(notes(spark, d), "asc")


@query(f"WITH {_NOTES} " + _SORTED.format(gone="NOT p", word="(p AND num IS NULL) DESC", num="num DESC", txt="txt DESC"))
def sort_nulls_last_desc(spark, d):
    return _placed(notes(spark, d), "desc")


def _placed(n, order):
    top = n.orderBy(*pr.sort_columns("priority", order)).limit(50)
    return top.select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*pr.sort_columns("priority", order))).cast("long").alias("place"))


@query(f"WITH {_NOTES} SELECT path, {_STR('title')} AS title, {_STR('status')} AS status, json_type(fm, '$.tags') AS has_tags FROM (SELECT path, fm FROM notes)".replace("json_type(fm, '$.tags') AS has_tags", "json_exists(fm, '$.tags') AS has_tags"))
def project_fields(spark, d):
    p = F.parse_json("frontmatter")
    got = notes(spark, d).select("path", pr.project(F.col("fm"), ["title", "status", "tags", "nowhere"]).alias("frontmatter"))
    return got.select("path", F.variant_get(p, "$.title", "string").alias("title"), F.variant_get(p, "$.status", "string").alias("status"), F.variant_get(p, "$.tags", "variant").isNotNull().alias("has_tags"))


# --- search ------------------------------------------------------------------------------------------------------------

_FOLD = f"translate(lower(coalesce(text, '')), '{tx.ACCENTED}', '{tx.FOLDED}')"
_TOK = f"regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(terms: list[str], every: bool, n: int = 24, scope: str = "true", base: str = "documents") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN n - df{i} + 0.5 > df{i} + 0.5 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) ELSE 1e-6 END * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avg))" for i in range(len(terms)))
    test = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok AS (SELECT doc_id, lang, {_TOK} AS t FROM {base}), tf AS (SELECT doc_id, lang, len(t) AS dl, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avg, {df} FROM tf),
lex AS (SELECT doc_id, round({part}, 6) AS score FROM tf, st WHERE ({test}) AND {scope} ORDER BY score DESC, doc_id LIMIT {n})"""


@query(f"SELECT count(*) AS n_docs, CAST(sum(len({_TOK})) AS BIGINT) AS n_tokens, round(avg(len({_TOK})), 6) AS avg_len FROM documents")
def corpus_stats(spark, d):
    return search.corpus_statistics(docs(spark, d))


_BUILT: dict[tuple[str, str], SearchIndex] = {}


def built(spark, d) -> SearchIndex:
    """The index of this folder's documents, made once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = SearchIndex.build(docs(spark, d), shared_folder(spark, "index"), keep=("lang",))
    return _BUILT[key]


@query(f"WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT (SELECT count(*) FROM t) AS n_docs, (SELECT CAST(sum(len(t)) AS BIGINT) FROM t) AS n_tokens, count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM t)")
def search_index_build(spark, d):
    """Builds the stored index anew; the queries below read it."""
    _BUILT.pop((spark.sparkContext.applicationId, d), None)
    i = built(spark, d)
    p = i.part("postings").agg(F.count("*").alias("n_postings"), F.countDistinct("term").alias("n_terms"))
    return i.part("statistics").crossJoin(p)  # one row each


@query(f"SELECT w AS term, doc_id, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS dl FROM (SELECT doc_id, {_TOK} AS t FROM documents), (SELECT unnest(['ranking', 'kiln', 'der']) AS w) WHERE list_contains(t, w)")
def index_postings(spark, d):
    """The postings of three terms, as they are stored."""
    return built(spark, d).part("postings").where(F.col("term").isin("ranking", "kiln", "der")).select("term", F.col("id").alias("doc_id"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@query(f"WITH {_bm25_sql(['sensor', 'kiln', 'budget'], False)} SELECT * FROM lex")
def bm25_scan(spark, d):
    """Without an index: the texts are read and counted."""
    return search.bm25(docs(spark, d), "sensor kiln budget")


@query(f"WITH {_bm25_sql(['ranking', 'quota'], True)} SELECT * FROM lex")
def bm25_and(spark, d):
    return built(spark, d).bm25("ranking quota")


@query(f"WITH {_bm25_sql(['sensor', 'kiln', 'echeance', 'archiv'], False)} SELECT * FROM lex")
def bm25_or(spark, d):
    return built(spark, d).bm25("sensor kiln échéance Archiv")


@query(f"WITH {_bm25_sql(['sensor', 'kiln', 'budget'], False, 24, 'lang = ' + chr(39) + 'en' + chr(39))} SELECT * FROM lex")
def bm25_folder(spark, d):
    return built(spark, d).bm25("sensor kiln budget", scope=F.coalesce(F.col("lang") == "en", F.lit(False)))


_DIST = "round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6)"


def _vector_of(spark, d, vec_id):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").scalar()


@query(f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, vec_id LIMIT 24")
def knn_exact(spark, d):
    return search.knn(table(spark, d, "embeddings"), _vector_of(spark, d, 7))


@query(f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 3 ORDER BY distance, vec_id LIMIT 10")
def knn_scoped(spark, d):
    return search.knn(table(spark, d, "embeddings"), _vector_of(spark, d, 7), 10, scope=F.col("label") == 3)


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p QUALIFY rank <= 10""")
def knn_queries(spark, d):
    e = table(spark, d, "embeddings")
    return search.knn_many(e, e.where(F.col("vec_id") % 100 == 0)).withColumn("rank", F.col("rank").cast("long"))


_SLOTS = f"list_transform({_TOK}, lambda w: ('0x' || right(md5(w), 7))::BIGINT % 32)"
_EMB = f"(SELECT doc_id, list_transform(c, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0 END) AS embedding FROM (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm FROM (SELECT doc_id, list_transform(range(32), lambda i: len(list_filter(s, lambda y: y = i))::DOUBLE) AS c FROM (SELECT doc_id, {_SLOTS} AS s FROM @FROM@))))"
_QUERY = "sensor kiln échéance Archiv"
_LEX = _bm25_sql(["sensor", "kiln", "echeance", "archiv"], False, 32)
_DENSE = f"emb AS {_EMB.replace('@FROM@', 'documents WHERE text IS NOT NULL')}, qe AS {_EMB.replace('@FROM@', '(SELECT 0 AS doc_id, ' + chr(39) + _QUERY + chr(39) + ' AS text)')}, den AS (SELECT e.doc_id, {_DIST} AS distance FROM emb e, qe q ORDER BY distance, doc_id LIMIT 32)"
_FUSED = f"""{_LEX}, {_DENSE}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS ra FROM lex), b AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) - 1 AS rb FROM den),
f AS (SELECT doc_id, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS raw FROM a FULL JOIN b USING (doc_id)), fused AS (SELECT doc_id, round(raw / max(raw) OVER (), 6) AS score FROM f)"""


def _two(spark, d):
    i = built(spark, d)
    return search.ranked(i.bm25(_QUERY, 32), F.desc("score"), "doc_id"), search.ranked(i.knn(search.embed(F.lit(_QUERY)), 32), "distance", "doc_id")


@query(f"WITH {_FUSED} SELECT * FROM fused")
def rrf_fusion(spark, d):
    return search.fuse(*_two(spark, d), "doc_id")


@query(f"WITH {_FUSED} SELECT doc_id, score FROM fused ORDER BY score DESC, doc_id LIMIT 8")
def hybrid_search(spark, d):
    return built(spark, d).hybrid(_QUERY)


@query(f"WITH {_FUSED} SELECT doc_id, score FROM fused ORDER BY score DESC, doc_id LIMIT 8")
def hybrid_scan(spark, d):
    """Without an index: texts are counted and embedded as they are read."""
    return search.hybrid(docs(spark, d), _QUERY)


@query(f"WITH {_FUSED}, h AS (SELECT doc_id, score FROM fused ORDER BY score DESC, doc_id LIMIT 8) SELECT h.doc_id, h.score, d.lang, d.source, d.path FROM h LEFT JOIN documents d USING (doc_id)")
def hydrate_left_join(spark, d):
    hits = built(spark, d).hybrid(_QUERY)
    return hits.join(docs(spark, d).select("doc_id", "lang", "source", "path"), "doc_id", "left")


@query(f"WITH {_LEX}, h AS (SELECT doc_id, length(text)::DOUBLE AS s FROM lex JOIN documents USING (doc_id)) SELECT doc_id, round(CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END, 6) AS score FROM h ORDER BY score DESC, doc_id LIMIT 10")
def rerank_minmax(spark, d):
    hits = built(spark, d).bm25(_QUERY, 32).select("doc_id").join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return search.rerank(hits, F.length("text"), 10, "doc_id")


def _lang_sql(lang: str) -> str:
    return f"(WITH {_bm25_sql(['sensor', 'archiv', 'budget'], False, 12, 'lang = ' + chr(39) + lang + chr(39))} SELECT doc_id, round(score / max(score) OVER (), 6) AS score FROM lex)"


@query(f"SELECT doc_id, max(score) AS score FROM (SELECT * FROM {_lang_sql('en')} UNION ALL SELECT * FROM {_lang_sql('de')} UNION ALL SELECT * FROM {_lang_sql('fr')}) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10")
def fan_out_merge(spark, d):
    per = [built(spark, d).bm25("sensor archiv budget", 12, scope=F.coalesce(F.col("lang") == x, F.lit(False))) for x in ("en", "de", "fr")]
    best = F.max("score").over(Window.partitionBy(F.lit(0)))
    return search.fan_out([r.select("doc_id", F.round(F.col("score") / best, 6).alias("score")) for r in per], 10, id="doc_id")


@query(f"WITH {_LEX} SELECT doc_id, score, true AS has_more FROM lex ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5")
def page_has_more(spark, d):
    return search.page(built(spark, d).bm25(_QUERY, 32), 5, 5, F.desc("score"), "doc_id")


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.label::VARCHAR || '/' || e.vec_id AS path, CASE WHEN q.vec_id % 200 = 0 THEN q.label::VARCHAR || '/' ELSE q.label::VARCHAR || '/' || (q.vec_id + 10) END AS expect, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
f AS (SELECT query_id, min(rank) FILTER (WHERE rank <= 5 AND (path = expect OR (expect LIKE '%/' AND starts_with(path, expect)))) AS first FROM p GROUP BY 1)
SELECT 5 AS k, count(*) AS n_queries, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f""")
def eval_hit_mrr(spark, d):
    """Vector search graded by labels, which it doesn't know: a neighbour of the query's own label, or one given vector, is right."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0)
    r = search.knn_many(e, q, 5).join(e.select("vec_id", "label"), "vec_id").select("query_id", "rank", F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("path"))
    folder = F.concat(F.col("label").cast("string"), F.lit("/"))
    return search.evaluate(r, q.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 200 == 0, folder).otherwise(F.concat(folder, (F.col("vec_id") + 10).cast("string"))).alias("expect")), 5)


_REF = "(SELECT path AS doc_id, '' AS lang, frontmatter AS text FROM ref_files WHERE tree_oid = (SELECT max(tree_oid) FROM ref_files) QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1)"


@query(f"WITH {_bm25_sql(['open', 'queue', 'tree'], False, 12, 'true', _REF)} SELECT doc_id AS path, round(1 / (1 + score), 6) AS score FROM lex")
def ref_search(spark, d):
    files = table(spark, d, "ref_files")
    tree = files.agg(F.max("tree_oid").alias("t")).scalar()
    return search.at_ref(files.where(F.col("tree_oid") == tree), "open queue tree", 12)


@query(f"""WITH {_bm25_sql(['sensor', 'kiln', 'budget'], False, 10)}, w AS (SELECT doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents JOIN lex USING (doc_id)),
c AS (SELECT doc_id, ws, i, len(list_filter(list_slice(ws, i, i + 23), lambda x: len(list_intersect(regexp_extract_all(translate(lower(x), '{tx.ACCENTED}', '{tx.FOLDED}'), '[\\p{{L}}\\p{{N}}]+'), ['sensor', 'kiln', 'budget'])) > 0)) AS n FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 23, 1) + 1)) AS i FROM w))
SELECT doc_id, array_to_string(list_slice(ws, i, i + 23), ' ') AS snippet FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1""")
def snippets(spark, d):
    hits = built(spark, d).bm25("sensor kiln budget", 10).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return hits.select("doc_id", tx.snippet(F.col("text"), ["sensor", "kiln", "budget"]).alias("snippet"))


# --- links, chunks, browsing -------------------------------------------------------------------------------------------

_CHUNKS = "chunks AS (SELECT DISTINCT ON (hit_id) *, hit_id AS chunk_id, start_line AS ord FROM hits)"
_LINKS = """lines AS (SELECT path, unnest(l) AS line_text, generate_subscripts(l, 1) AS line FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{0085}\\x{2028}\\x{2029}]') AS l FROM documents WHERE contains(text, '[['))),
links AS (SELECT source, line, key, split_part(key, '/', -1) AS stem, text FROM (SELECT path AS source, line, lower(regexp_replace(trim(k), '\\.md$', '')) AS key, substr(trim(line_text), 1, 200) AS text FROM (SELECT path, line, line_text, unnest(regexp_extract_all(line_text, '\\[\\[([^\\]#|]+)(?:[#|][^\\]]*)?\\]\\]', 1)) AS k FROM lines)) WHERE key <> '')"""
_NAMES = "named AS (SELECT DISTINCT path, lower(regexp_replace(path, '\\.(?:md|markdown|yaml|yml|mmd)$', '')) AS k, lower(regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1)) AS s FROM documents WHERE path IS NOT NULL)"


def link_rows(spark, d):
    return browse.links(docs(spark, d))


@query(f"WITH {_LINKS} SELECT source, CAST(line AS INTEGER) AS line, key, stem, text FROM links")
def wikilinks(spark, d):
    return link_rows(spark, d)


_WANTED = _NAMES.replace("FROM documents WHERE path IS NOT NULL", "FROM (SELECT path FROM documents WHERE path IS NOT NULL UNION SELECT key || '.md' FROM links)")


@query(f"WITH {_LINKS}, {_WANTED}, hit AS (SELECT DISTINCT path, source, line, key, text FROM links, named WHERE key = k AND source <> path UNION SELECT DISTINCT path, source, line, key, text FROM links, named WHERE stem = s AND source <> path) SELECT path, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM hit GROUP BY path")
def backlinks(spark, d):
    """Of all documents and of the notes that links name, which the test data lacks."""
    l = link_rows(spark, d)
    return browse.backlink_counts(l, docs(spark, d).select("path").unionByName(l.select(F.concat("key", F.lit(".md")).alias("path"))))


_STATES = f"WITH {_LINKS}, {_NAMES}, t AS (SELECT key, count(DISTINCT path) AS n_targets FROM (SELECT path, k AS key FROM named UNION SELECT path, s FROM named) GROUP BY 1), st AS (SELECT key, count(*) AS n_links, coalesce(any_value(n_targets), 0) AS n_targets FROM links LEFT JOIN t USING (key) GROUP BY key) SELECT *, CASE WHEN n_targets = 0 THEN 'broken' WHEN n_targets > 1 THEN 'ambiguous' ELSE 'ok' END AS state FROM st"


@query(_STATES)
def link_states(spark, d):
    return browse.link_states(link_rows(spark, d), docs(spark, d))


@query(f"""WITH {_LINKS}, own AS (SELECT lower(regexp_replace(path, '\\.(?:md|markdown|yaml|yml|mmd)$', '')) AS name, min(path) AS target FROM documents WHERE path IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT source, line, key, stem, regexp_replace(key, '^/+', '') AS k, regexp_extract(source, '^(.*/)?[^/]*$', 1) AS home FROM links)
SELECT source, CAST(line AS INTEGER) AS line, key, coalesce(a.target, b.target, c.target) AS target FROM l LEFT JOIN own a ON a.name = k LEFT JOIN own b ON b.name = k || '/' || stem LEFT JOIN own c ON c.name = lower(home || k)""")
def resolved_links(spark, d):
    return browse.resolved_links(link_rows(spark, d), docs(spark, d))


def _edge_sql(order: str) -> str:
    return f"WITH {_CHUNKS} SELECT path, chunk_id, ord, heading FROM chunks QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord {order} NULLS LAST, chunk_id {order}) = 1"


@query(_edge_sql("ASC"))
def first_chunk(spark, d):
    """The first chunk of every note; of chunks at the same place the one with the least id."""
    return browse.edge_chunks(chunks(spark, d)).select("path", "chunk_id", "ord", "heading")


@query(_edge_sql("DESC"))
def last_chunk(spark, d):
    return browse.edge_chunks(chunks(spark, d), "last").select("path", "chunk_id", "ord", "heading")


also("first_chunk_all", first_chunk)
also("last_chunk_all", last_chunk)


@query(f"WITH {_CHUNKS} SELECT path, chunk_id, ord, CAST(row_number() OVER w AS INTEGER) AS place, count(*) OVER (PARTITION BY path) AS total, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY path ORDER BY ord, chunk_id)")
def nav_prev_next(spark, d):
    return browse.navigation(chunks(spark, d))


@query(f"WITH {_CHUNKS} SELECT path, chunk_id, chunk_kind, heading_level, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY path, chunk_kind, heading_level ORDER BY ord, chunk_id)")
def sibling_same_kind(spark, d):
    return browse.siblings(chunks(spark, d))


@query(f"WITH {_CHUNKS}, i AS (SELECT path, chunk_id, start_line AS line FROM chunks WHERE chunk_kind <> 'section'), h AS (SELECT chunk_id, max(o.ord) AS owner FROM (SELECT path, chunk_id AS c, ord, start_line, end_line FROM chunks WHERE chunk_kind = 'section') o JOIN i ON i.path = o.path AND i.line BETWEEN o.start_line AND o.end_line GROUP BY 1) SELECT i.chunk_id, owner FROM i LEFT JOIN h USING (chunk_id)")
def interval_containment(spark, d):
    c = chunks(spark, d)
    return browse.containing(c.where("chunk_kind <> 'section'").withColumn("line", F.col("start_line")), c.where("chunk_kind = 'section'"), "chunk_id")


@query(f"WITH {_CHUNKS}, r AS (SELECT chunk_id AS request, path, CASE WHEN chunk_id % 4 = 0 THEN 'gone' ELSE chunk_hash END AS chunk_hash, CASE WHEN chunk_id % 8 = 0 THEN NULL ELSE 'Fallback' END AS heading FROM chunks), k AS (SELECT path, chunk_hash, min(coalesce(heading, '')) AS found FROM chunks GROUP BY 1, 2) SELECT request, CASE WHEN found IS NOT NULL THEN found ELSE heading END AS heading, CASE WHEN found IS NOT NULL THEN 'hash' WHEN heading IS NOT NULL THEN 'heading' ELSE 'stale' END AS state FROM r LEFT JOIN k USING (path, chunk_hash)")
def chunk_anchors(spark, d):
    c = chunks(spark, d)
    n = F.col("chunk_id")
    requests = c.select(n.alias("request"), "path", F.when(n % 4 == 0, "gone").otherwise(F.col("chunk_hash")).alias("chunk_hash"), F.when(n % 8 == 0, None).otherwise("Fallback").alias("heading"))
    return browse.anchors(requests, c).select("request", "heading", "state")


@query("""WITH f AS (SELECT DISTINCT path, mtime FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST) = 1),
p AS (SELECT path, mtime FROM f WHERE starts_with(path, 'projects/') AND NOT regexp_full_match(path, '.*/_drafts/.*') ORDER BY mtime DESC, path LIMIT 30),
c AS (SELECT path, min(heading) AS heading, count(*) AS n FROM (SELECT DISTINCT ON (hit_id) * FROM hits) GROUP BY path)
SELECT p.path, p.mtime, c.n AS n_chunks FROM p LEFT JOIN c USING (path)""")
def recent_notes(spark, d):
    f = table(spark, d, "files").groupBy("path").agg(F.max("mtime").alias("mtime"))
    page = browse.recent(f, 30, folder="projects", exclude=["*/_drafts/*"])
    return page.join(chunks(spark, d).groupBy("path").agg(F.count("*").alias("n_chunks")), "path", "left")


_CUT = lambda n: f"CASE WHEN length(text) <= {n} THEN text WHEN regexp_matches(substr(text, 1, {n}), '[ \\t\\n\\x0b\\f\\r]') THEN regexp_replace(regexp_extract(substr(text, 1, {n}), '(?s)^(.*)[ \\t\\n\\x0b\\f\\r]', 1), '[ \\t\\n\\x0b\\f\\r]+$', '') ELSE substr(text, 1, {n}) END"


@query(f"""WITH {_CHUNKS}, p AS (SELECT path, max(mtime) AS mtime FROM files GROUP BY path ORDER BY mtime DESC, path LIMIT 30), c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord NULLS LAST, chunk_id) = 1)
SELECT p.path, p.mtime, c.heading, regexp_replace({_CUT(200)}, '', '') AS preview FROM p LEFT JOIN c USING (path)""")
def recent_preview(spark, d):
    f = table(spark, d, "files").groupBy("path").agg(F.max("mtime").alias("mtime"))
    return browse.recent_preview(f, chunks(spark, d), 30)


@query("SELECT path, max(mtime) AS mtime FROM files GROUP BY path HAVING max(mtime) BETWEEN epoch(timezone('America/New_York', TIMESTAMP '2017-01-05')) AND epoch(timezone('America/New_York', TIMESTAMP '2017-01-11')) - 0.000001 ORDER BY mtime DESC, path LIMIT 40")
def since_until_window(spark, d):
    since, until = browse.day_bounds("2017-01-05", "2017-01-10")
    f = table(spark, d, "files").groupBy("path").agg(F.max("mtime").alias("mtime"))
    return browse.recent(f, 40, since=since, until=until)


@query("SELECT coalesce(nullif(array_to_string(list_slice(string_split(path, '/')[:-2], 1, 2), '/'), ''), '.') AS folder, count(*) AS n FROM (SELECT DISTINCT path FROM files) GROUP BY 1 ORDER BY n DESC, folder LIMIT 3")
def folder_top3(spark, d):
    return browse.folder_summary(table(spark, d, "files").select("path").distinct(), tx.folder_key(F.col("path")))


@query("WITH f AS (SELECT coalesce(nullif(array_to_string(list_slice(string_split(path, '/')[:-2], 1, 2), '/'), ''), '.') AS folder, count(*) AS n FROM (SELECT DISTINCT path FROM files) GROUP BY 1), t AS (SELECT * FROM f ORDER BY n DESC, folder LIMIT 3) SELECT (SELECT string_agg(folder || ' (' || n || ')', ', ' ORDER BY n DESC, folder) FROM t) || (SELECT CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END FROM f) AS summary")
def folder_summary_line(spark, d):
    return browse.summary_line(table(spark, d, "files").select("path").distinct(), tx.folder_key(F.col("path")))


@query(f"WITH {_NOTES} SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS n, string_agg('- [' || coalesce(nullif(trim(CASE WHEN json_type(fm, '$.title') = 'VARCHAR' THEN {_STR('title')} END), ''), split_part(path, '/', -1)) || '](' || split_part(path, '/', -1) || ')', chr(10) ORDER BY split_part(path, '/', -1)) AS listing FROM notes GROUP BY 1")
def folder_listing(spark, d):
    title = F.when(F.schema_of_variant(pr.member(F.col("fm"), "title")) == "STRING", pr.text_of(pr.member(F.col("fm"), "title")))
    return browse.folder_listing(notes(spark, d).select("path", title.alias("title")))


@query("SELECT path, regexp_matches(path, '(^|/)_drafts/|^projects(/|$)|ü') AS never FROM (SELECT DISTINCT path FROM files)")
def never_commit(spark, d):
    return table(spark, d, "files").select("path").distinct().select("path", paths.never_committed(F.col("path"), ["**/_drafts/*", "projects/", "*ü*", " "]).alias("never"))


@query("""SELECT call_id, CASE WHEN call_id % 4 = 3 THEN NULL ELSE CASE WHEN call_id % 4 = 2 THEN 'elsewhere' ELSE vault_id END END AS vault, note_path AS path, CASE call_id % 4 WHEN 3 THEN 'plain' WHEN 2 THEN 'bad_vault' ELSE 'ok' END AS state
FROM tool_calls WHERE note_path IS NOT NULL AND vault_id IN (SELECT vault_id FROM vaults)""")
def note_references(spark, d):
    v = table(spark, d, "vaults").select("vault_id")
    known = [r[0] for r in v.collect()]  # the registry: a row per vault
    c = calls(spark, d).where("note_path is not null").join(v, "vault_id", "left_semi")
    n = F.col("call_id") % 4
    made = F.when(n == 3, F.col("note_path")).when(n == 2, F.concat(F.lit("elsewhere:"), "note_path")).when(n == 1, F.concat(F.lit(" "), "vault_id", F.lit(":/"), "note_path")).otherwise(F.concat("vault_id", F.lit(":"), "note_path"))
    return c.select("call_id", paths.note_reference(made, known).alias("r")).select("call_id", "r.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# New' || chr(10) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'replaced' WHEN doc_id % 3 = 1 THEN 'stale' ELSE 'unchanged' END AS result FROM documents WHERE text IS NOT NULL AND path IS NOT NULL AND ends_with(path, '.md') AND text <> '# New' || chr(10)""")
def write_whole(spark, d):
    n = docs(spark, d).where("text is not null and path is not null and endswith(path, '.md') and text <> '# New\n'").select("doc_id", "path", "text", F.lit(5.0).alias("mtime"))
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    new = F.when(k == 2, F.col("text")).otherwise(mutate.assembled(none, F.array(F.struct(F.lit("New").alias("heading"), F.lit(1).alias("level"), none.alias("text"))), none))
    w = n.select("path", new.alias("text"), F.when(k == 1, 9.0).otherwise(5.0).alias("expected_mtime"), none.alias("expected_frontmatter"), F.when(k == 1, "other").alias("expected_body"), none.alias("heading"), none.alias("expected_section"))
    return mutate.write_whole(n.select("path", "mtime", "text"), w).join(n.select("doc_id", "path"), "path").select("doc_id", "text", "result")


# --- rules and lint ----------------------------------------------------------------------------------------------------

RULES = [
    {"match": "projects/**/*.md", "okf_type": "project", "required": ["title", "status", "owner"]},
    {"match": "decisions/_drafts/*", "enforcement": "exempt"},
    {"match": "decisions/**", "okf_type": "decision", "required": ["title", "topic"]},
    {"match": "decisions/2024/*", "okf_type": "decision", "required": ["origin"]},
    {"match": "**/*.md", "required": ["title"], "enforcement": "soft"},
]
NEW_RULES = [*RULES[:2], {"match": "decisions/**", "okf_type": "decision", "required": ["title", "topic", "sponsor"]}, *RULES[4:]]
_RULE = "CASE WHEN regexp_full_match(path, 'projects/(?:.*/)?[^/]*\\.md') THEN 0 WHEN regexp_full_match(path, 'decisions/_drafts/[^/]*') THEN 1 WHEN regexp_full_match(path, 'decisions/.*') THEN 2 WHEN regexp_full_match(path, 'decisions/2024/[^/]*') THEN 3 WHEN regexp_full_match(path, '(?:.*/)?[^/]*\\.md') THEN 4 END"
_MISS = lambda ks: "list_filter([" + ", ".join(f"CASE WHEN NOT {_HAS(k)} OR trim({_STR(k)}) = '' THEN '{k}' END" for k in ks) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT path, CAST({_RULE} AS INTEGER) AS rule FROM (SELECT DISTINCT path FROM files)")
def first_match_rule(spark, d):
    return table(spark, d, "files").select("path").distinct().select("path", rules.first_rule(F.col("path"), [r["match"] for r in RULES]).alias("rule"))


@query("SELECT 3 AS rule, 2 AS by")
def shadowed_rules(spark, d):
    return rules.shadowed_rules(spark, [r["match"] for r in RULES])


@query(f"""WITH {_NOTES}, r AS (SELECT path, fm, CAST({_RULE} AS INTEGER) AS rule FROM notes), c AS (SELECT path, rule, CASE rule WHEN 0 THEN 'project' WHEN 2 THEN 'decision' WHEN 3 THEN 'decision' END AS expected, {_STR('okf_type')} AS found,
CASE rule WHEN 0 THEN {_MISS(['title', 'status', 'owner'])} WHEN 2 THEN {_MISS(['title', 'topic'])} WHEN 3 THEN {_MISS(['origin'])} WHEN 4 THEN {_MISS(['title'])} ELSE [] END AS missing FROM r)
SELECT path, rule, expected, found, array_to_string(missing, ',') AS missing, coalesce(rule, 1) IN (1, 4) OR (len(missing) = 0 AND (expected IS NULL OR expected IS NOT DISTINCT FROM found)) AS ok FROM c""")
def okf_required_missing(spark, d):
    return rules.classify(notes(spark, d), RULES).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {_NOTES}, r AS (SELECT path, fm, CAST({_RULE} AS INTEGER) AS o FROM notes), c AS (SELECT path, o AS old_rule, CASE o WHEN 4 THEN 3 ELSE o END AS new_rule, CASE WHEN o = 2 AND {_MISS(['sponsor'])} <> [] THEN 'sponsor' ELSE '' END AS new_missing FROM r)
SELECT path, CAST(old_rule AS INTEGER) AS old_rule, CAST(new_rule AS INTEGER) AS new_rule, new_missing FROM c WHERE old_rule IS DISTINCT FROM new_rule OR new_missing <> ''""")
def okf_dry_run(spark, d):
    return rules.dry_run(notes(spark, d), RULES, NEW_RULES).withColumn("new_missing", F.array_join("new_missing", ","))


#: SQL has LF as its only line end. Four signs that no text of the test data holds (noncharacters) go before an LF that stands for CRLF, CR,
#: NEL, LS or PS; the text's own LF has none. _RAW puts them back.
_ENDS = (("chr(13) || chr(10)", 64976), ("chr(13)", 64977), ("chr(133)", 64978), ("chr(8232)", 64979), ("chr(8233)", 64980))


def _lf_sql(text: str) -> str:
    text = f"replace({text}, chr(13) || chr(10), chr(64976) || chr(1114109))"  # hide the CRLF's LF first
    for end, mark in _ENDS[1:]:
        text = f"replace({text}, {end}, chr({mark}) || chr(10))"
    return f"replace({text}, chr(1114109), chr(10))"


def _raw_sql(text: str) -> str:
    for end, mark in _ENDS:
        text = f"replace({text}, chr({mark}) || chr(10), {end})"
    return text


_MARKS = "\\x{FDD0}-\\x{FDD4}"
_TRAILING = f"len(regexp_extract_all(t, '(?m)[ \\t]+[{_MARKS}]?$'))"


@query(f"SELECT doc_id, {_TRAILING} AS n FROM (SELECT doc_id, {_lf_sql('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE n > 0")
def trailing_ws(spark, d):
    """Of the texts as they are: blanks before any line end count, CRLF included."""
    return docs(spark, d).select("doc_id", tx.trailing_blank_lines(F.col("text")).cast("long").alias("n")).where("n > 0")


also("trailing_ws_all", trailing_ws)


@query(f"""WITH {_LINKS}, {_NAMES}, tg AS (SELECT key, count(DISTINCT path) AS n_targets FROM (SELECT path, k AS key FROM named UNION SELECT path, s FROM named) GROUP BY 1),
st AS (SELECT key, CASE WHEN coalesce(any_value(n_targets), 0) = 0 THEN 'broken_link' WHEN any_value(n_targets) > 1 THEN 'ambiguous_link' END AS code FROM links LEFT JOIN tg USING (key) GROUP BY key),
d AS (SELECT path, coalesce(text, '') AS text, {_lf_sql("coalesce(text, '')")} AS t FROM documents),
f AS (SELECT path, 'trailing_blanks' AS code FROM d WHERE {_TRAILING} > 0 UNION ALL SELECT path, 'no_final_newline' FROM d WHERE text <> '' AND text NOT LIKE '%' || chr(10)
UNION ALL SELECT path, 'callout' FROM d WHERE regexp_matches(t, '(?m)^>(?:[ \\t\\n\\x0b\\f]|[\\x{{FDD0}}\\x{{FDD1}}]\\n)*\\[!') UNION ALL SELECT path, 'unexpected_folder' FROM d WHERE path LIKE '%/%' AND split_part(path, '/', 1) NOT IN ('note', 'stub', 'chat', 'log')
UNION ALL SELECT source, code FROM links JOIN st USING (key) WHERE code IS NOT NULL)
SELECT code, count(*) AS n, count(DISTINCT path) AS n_notes FROM f GROUP BY code""")
def lint_counts(spark, d):
    n = docs(spark, d).select("path", "text")
    l = link_rows(spark, d)
    return rules.flaw_counts(rules.flaws(n, folders=["note", "stub", "chat", "log"], links=l, link_states=browse.link_states(l, n)))


@query(f"""WITH {_NOTES}, t AS (SELECT path, json_type(fm, '$.todos') AS k, json_extract(fm, '$.todos[*]') AS items FROM notes), e AS (SELECT path, generate_subscripts(items, 1) - 1 AS place, unnest(items) AS item FROM t WHERE k = 'ARRAY')
SELECT path, -1 AS place, 'not_a_list' AS code FROM t WHERE k <> 'ARRAY' UNION ALL SELECT path, place, 'not_a_map' FROM e WHERE json_type(item) <> 'OBJECT'
UNION ALL SELECT path, place, 'missing_id' FROM e WHERE json_type(item) = 'OBJECT' AND NOT json_exists(item, '$.id') UNION ALL SELECT path, place, 'missing_status' FROM e WHERE json_type(item) = 'OBJECT' AND NOT json_exists(item, '$.status')
UNION ALL SELECT path, place, 'bad_status' FROM e WHERE json_type(item) = 'OBJECT' AND json_type(item, '$.status') <> 'NULL' AND json_extract_string(item, '$.status') NOT IN ('open', 'done')""")
def type_profile_check(spark, d):
    return rules.profile_flaws(notes(spark, d), "todos", ["id", "status"], ["open", "done"])


# --- versions ----------------------------------------------------------------------------------------------------------


def _perturbed(df, shift):
    """A copy of documents of which 1 % is changed, 1 % gone and 1 % new."""
    kept = df.select("doc_id", "text").where((F.col("doc_id") + shift) % 100 != 1)
    changed = kept.withColumn("text", F.when((F.col("doc_id") + shift) % 100 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(f" {shift}"))).otherwise(F.col("text")))
    new = df.where((F.col("doc_id") + shift) % 100 == 3).select((F.col("doc_id") + 10_000_000 * (1 + shift)).alias("doc_id"), "text")
    return changed.unionByName(new)


def _perturbed_sql(shift):
    return f"(SELECT doc_id, CASE WHEN (doc_id + {shift}) % 100 = 2 THEN coalesce(text, '') || ' {shift}' ELSE text END AS text FROM documents WHERE (doc_id + {shift}) % 100 <> 1 UNION ALL SELECT doc_id + {10_000_000 * (1 + shift)}, text FROM documents WHERE (doc_id + {shift}) % 100 = 3)"


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state FROM documents o FULL JOIN {_perturbed_sql(0)} n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text")
def diff_added_changed_removed(spark, d):
    digest = lambda df: df.select("doc_id", F.sha2(F.col("text"), 256).alias("h"))
    return versions.difference(digest(docs(spark, d)), digest(_perturbed(docs(spark, d), 0)), "doc_id", "h")


@query(f"SELECT n.doc_id, md5(n.text) AS content_hash, o.doc_id IS NOT NULL AS reused FROM {_perturbed_sql(0)} n LEFT JOIN (SELECT DISTINCT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL) o ON n.doc_id = o.doc_id AND md5(n.text) = o.h")
def embedding_reuse(spark, d):
    old = docs(spark, d).where("text is not null").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    new = _perturbed(docs(spark, d), 0).select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    return versions.reuse(new, old).select(F.col("path").alias("doc_id"), "content_hash", F.col("embedding").isNotNull().alias("reused"))


@query(f"""WITH j AS (SELECT coalesce(b.doc_id, o.doc_id, t.doc_id) AS doc_id, b.doc_id IS NOT NULL AS hb, o.doc_id IS NOT NULL AS ho, t.doc_id IS NOT NULL AS ht, md5(b.text) AS b, md5(o.text) AS o, md5(t.text) AS t FROM documents b FULL JOIN {_perturbed_sql(0)} o ON b.doc_id = o.doc_id FULL JOIN {_perturbed_sql(1)} t ON coalesce(b.doc_id, o.doc_id) = t.doc_id),
s AS (SELECT *, CASE WHEN ho AND ht AND o IS NOT DISTINCT FROM t THEN 'same' WHEN hb AND ho AND ht AND b IS NOT DISTINCT FROM t THEN 'ours' WHEN hb AND ho AND ht AND b IS NOT DISTINCT FROM o THEN 'theirs' WHEN NOT hb AND ho AND NOT ht THEN 'ours' WHEN NOT hb AND ht AND NOT ho THEN 'theirs' ELSE 'conflict' END AS state FROM j WHERE ho OR ht)
SELECT doc_id, CASE WHEN state IN ('same', 'ours') THEN o WHEN state = 'theirs' THEN t END AS value, state FROM s""")
def three_way_merge(spark, d):
    side = lambda df: df.select("doc_id", F.md5("text").alias("value"))
    dd = docs(spark, d)
    return versions.three_way(side(dd), side(_perturbed(dd, 0)), side(_perturbed(dd, 1)), "doc_id")


@query("""SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN
(SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0) n USING (o_orderkey)""")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 = 0").select(F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return versions.upsert(o, new, "o_orderkey")


@query("SELECT tree_oid, max(built_at) AS built_at FROM ref_trees GROUP BY 1 ORDER BY built_at DESC, tree_oid LIMIT 8")
def keep_newest_8(spark, d):
    return versions.keep_newest(table(spark, d, "ref_trees"))


@query("""WITH k AS (SELECT path, max(mtime) AS mtime, max_by(hash, mtime) AS hash FROM files GROUP BY 1), n AS (SELECT CASE WHEN mtime::BIGINT % 10 = 1 THEN path || 'x' ELSE path END AS path, CASE WHEN mtime::BIGINT % 10 = 2 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN mtime::BIGINT % 20 = 2 THEN 'h' ELSE hash END AS hash FROM k)
SELECT n.path, n.mtime, n.hash FROM n LEFT JOIN k ON n.path = k.path WHERE k.path IS NULL OR (abs(n.mtime - k.mtime) >= 1e-6 AND n.hash IS DISTINCT FROM k.hash)""")
def stale_files(spark, d):
    k = table(spark, d, "files").groupBy("path").agg(F.max("mtime").alias("mtime"), F.max_by("hash", "mtime").alias("hash"))
    s = F.bround("mtime").cast("long")
    n = k.select(F.when(s % 10 == 1, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(s % 10 == 2, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(s % 20 == 2, F.lit("h")).otherwise(F.col("hash")).alias("hash"))
    return versions.stale(k, n)


@query("SELECT path, CASE WHEN length(path) % 3 = 0 THEN NULL WHEN length(path) % 3 = 1 THEN md5(path) ELSE 'old' END AS expected, CASE WHEN length(path) % 3 = 2 THEN 'stale' ELSE 'ok' END AS state FROM (SELECT DISTINCT path FROM files)")
def compare_and_set(spark, d):
    f = table(spark, d, "files").select("path").distinct()
    n = F.length("path") % 3
    writes = f.select("path", F.when(n == 1, F.md5("path")).when(n == 2, "old").alias("expected"))
    return versions.compare_and_set(f, writes, "path", F.md5("path"))


@query("SELECT path, coalesce(max(t.committed_at), TIMESTAMP '2016-01-01') AS touched FROM (SELECT DISTINCT path FROM files) f LEFT JOIN (SELECT r.path AS p, t.committed_at FROM ref_files r JOIN (SELECT tree_oid, max(committed_at) AS committed_at FROM ref_trees GROUP BY 1) t USING (tree_oid)) t ON f.path = t.p GROUP BY path")
def last_touch(spark, d):
    t = table(spark, d, "ref_trees").groupBy("tree_oid").agg(F.max("committed_at").alias("ts"))
    log = table(spark, d, "ref_files").select("tree_oid", "path").join(t, "tree_oid")
    return versions.last_touch(log, table(spark, d, "files").select("path").distinct(), None).select("path", F.coalesce("mtime", F.expr("timestamp_ntz'2016-01-01'")).alias("touched"))


# --- texts -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 'Order > ' || l_orderkey || ' — Part: ' || l_partkey || ', Flag: ' || l_returnflag || ', ' || l_linestatus AS line FROM lineitem")
def row_flatten(spark, d):
    l = table(spark, d, "lineitem")
    heads = F.array(F.lit("Part"), F.lit(" Flag"), F.lit(""), F.lit(""))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" "))
    return l.select("l_orderkey", "l_linenumber", tx.flat_row(F.array(F.lit("Order"), F.lit(""), F.col("l_orderkey").cast("string")), heads, cells).alias("line"))


def _clean_sql() -> str:
    """undecorated() in SQL: RE2 has no look-around, so runs of two stars and more are hidden while single ones are paired."""
    t = _lf_sql("text")
    t = f"regexp_replace({t}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    t = f"regexp_replace({t}, '\\*\\*([^\\n{_MARKS}]+?)\\*\\*', '\\1', 'g')"
    t = f"replace(replace({t}, '**', chr(64981) || chr(64981)), chr(64981) || '*', chr(64981) || chr(64981))"
    t = f"regexp_replace({t}, '\\*((?:[^*\\n{_MARKS}\\x{{FDD5}}]|[\\x{{FDD1}}-\\x{{FDD4}}]\\n)+)\\*', '\\1', 'g')"
    t = f"replace({t}, chr(64981), '*')"
    for pattern, to in (("(?m)^#{1,6}[ \\t]+", ""), ("(?m)^([ \\t]*)[-*+][ \\t]+", "\\1"), ("(?m)^>[ \\t]?", "")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return _raw_sql(t)


@query(f"SELECT doc_id, md5({_clean_sql()}) AS h FROM documents WHERE text IS NOT NULL")
def text_clean(spark, d):
    """Of all texts as they are, italics included."""
    return docs(spark, d).where("text is not null").select("doc_id", F.md5(tx.undecorated(F.col("text"))).alias("h"))


also("text_clean_all", text_clean)


@query("SELECT doc_id, regexp_replace(CASE WHEN length(text) <= 120 THEN text WHEN regexp_matches(substr(text, 1, 120), '[ \\t\\n\\x0b\\f\\r]') THEN regexp_replace(regexp_extract(substr(text, 1, 120), '(?s)^(.*)[ \\t\\n\\x0b\\f\\r]', 1), '[ \\t\\n\\x0b\\f\\r]+$', '') ELSE substr(text, 1, 120) END, '', '') AS cut FROM documents WHERE text IS NOT NULL")
def word_truncate(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", tx.cut_at_word(F.col("text"), 120).alias("cut"))


@query("SELECT DISTINCT heading, trim(regexp_replace(lower(trim(heading)), '[^a-z0-9]+', '_', 'g'), '_') AS header_key, lower(trim(regexp_replace(heading, '^#{1,6}[ \\t]+', ''))) AS heading_key, split_part(heading, ' › ', -1) AS short FROM hits WHERE heading IS NOT NULL")
def heading_normalize(spark, d):
    h = table(spark, d, "hits").where("heading is not null").select("heading").distinct()
    return h.select("heading", tx.header_key(F.col("heading")).alias("header_key"), tx.heading_key(F.col("heading")).alias("heading_key"), tx.short_title(F.col("heading")).alias("short"))


@query("SELECT hit_id, substr(sha256(concat_ws(':', 'markdown', source, start_line, end_line, content_hash, 'model')), 1, 16) AS chunk_id FROM hits")
def chunk_ids(spark, d):
    h = table(spark, d, "hits")
    return h.select("hit_id", tx.chunk_id(F.col("source"), F.col("start_line"), F.col("end_line"), F.col("content_hash"), F.lit("model")).alias("chunk_id"))


@query("SELECT CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.yaml' THEN 'yaml' WHEN lower(path) LIKE '%.mmd' THEN 'mermaid' END AS format, count(*) AS n, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def note_formats(spark, d):
    return docs(spark, d).groupBy(tx.note_format(F.col("path")).alias("format")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?s)^---\\r?\\n.*?\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)', '')) AS body FROM documents WHERE text IS NOT NULL")
def strip_frontmatter(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.md5(tx.body(F.col("text"))).alias("body"))


# --- parsers, edits, streams -------------------------------------------------------------------------------------------


@query()
def chunk_index(spark, d):
    """All chunks of all documents: sections, table headers and rows, diagrams."""
    return formats.chunk_rows(docs(spark, d))


@query()
def section_chunks(spark, d):
    return docs(spark, d).select("doc_id", F.explode(formats.sections("text")).alias("s")).select("doc_id", "s.*")


@query()
def gfm_tables(spark, d):
    return formats.table_rows(docs(spark, d)).select("path", "table", "row_index", F.explode("cells").alias("header", "cell"))


@query()
def mermaid_graph(spark, d):
    """The edges of all diagrams: diagram files and fenced blocks in other documents."""
    found = docs(spark, d).select("doc_id", F.posexplode(formats.diagrams("text", "path")).alias("diagram", "g"))
    return found.select("doc_id", "diagram", F.explode("g.edges").alias("e")).select("doc_id", "diagram", "e.*")


@query()
def frontmatter_catalog(spark, d):
    return docs(spark, d).select("path", formats.frontmatter("text", "path").alias("frontmatter")).where("frontmatter is not null")


@query()
def patch_ops(spark, d):
    n = docs(spark, d).where("text is not null and path is not null").select("path", "text")
    ops = '[{"op": "set_field", "field": "review.state", "value": "open"}, {"op": "append_eof", "text": "## Log"}]'
    done = mutate.patch_notes(n, n.select("path", F.lit(ops).alias("ops")))
    return done.select("path", F.array_join("results", ",").alias("results"), "changed", F.sha2("text", 256).alias("h"))


@query()
def table_ops(spark, d):
    n = docs(spark, d).where("text is not null and path is not null").select("path", "text")
    done = mutate.patch_notes(n, n.select("path", F.lit('[{"op": "append_row", "table": 0, "values": ["new"]}]').alias("ops")))
    return done.groupBy(F.array_join("results", ",").alias("results")).agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("int")).alias("n_changed"))


@query()
def merge_sections(spark, d):
    n = docs(spark, d).where("text is not null and path is not null").select("path", "text", "doc_id")
    ours = n.select("path", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\n# Ours\nx"))).otherwise(F.col("text")).alias("text"))
    theirs = n.select("path", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n\n# Theirs\ny"))).otherwise(F.col("text")).alias("text"))
    return mutate.merge_notes(n, ours, theirs).groupBy("state").agg(F.count("*").alias("n"))


@query(ORACLES["debounce_sessions"])
def stream_debounce_available_now(spark, d):
    """The debounce over events as a stream, run to its end; a last touch of a key of its own closes all runs."""
    from vaultspark.streaming.debounce import closing_touch, quiet_periods

    events, folder = table(spark, d, "events").select("user_id", "ts"), shared_folder(spark, "debounce")
    closing_touch(events, "user_id", "ts", "6 hours", -1).write.parquet(f"{folder}/close")
    stream = spark.readStream.schema(events.schema)
    source = stream.format("parquet").load(f"{d}/events.parque[t]").unionByName(stream.format("parquet").load(f"{folder}/close"))
    quiet = quiet_periods(source, "user_id", "ts", "6 hours", "1 second")
    quiet.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(quiet.schema).parquet(f"{folder}/out")
    return out.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("due").cast("timestamp_ntz").alias("due"), "n")
