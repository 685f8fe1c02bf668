"""Queries of the general problems (1, 2, 4, 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultspark.operators import drift, nested, sessions, snapshots
from vaultspark.sources.tables import table


def p1_found(spark, d):
    return drift.field_changes(table(spark, d, "ref_trees"), table(spark, d, "ref_files"), table(spark, d, "files"))


def p1_table(spark, d):
    return drift.consistent_table(table(spark, d, "ref_trees"), table(spark, d, "ref_files"), table(spark, d, "files"))


def p1_paths(spark, d):
    """Path-kind statistics of each tree and of the working copies, members of nested objects included."""
    notes = drift.notes_of(drift.latest_notes(table(spark, d, "ref_files"), table(spark, d, "files")), deep=True)
    return drift.path_statistics(notes).withColumn("kind", drift.kind_name(F.col("kind")))


def p1_failed_casts(spark, d):
    return drift.failed_casts(drift.unified(table(spark, d, "ref_trees"), table(spark, d, "ref_files"), table(spark, d, "files"))[0])


def p2_found(spark, d):
    return nested.nested_objects(table(spark, d, "files"))


def p2_variants(spark, d):
    return nested.variants(nested.nodes(table(spark, d, "files"))).select("role", "state", "n", "n_role", F.to_json("members").alias("members"))


def p2_supertypes(spark, d):
    return nested.supertypes(nested.variants(nested.nodes(table(spark, d, "files"))))


def p2_subtypes(spark, d):
    """The typed subtype tables of all variants."""
    return nested.subtype_rows(nested.nodes_once(table(spark, d, "files")))


def p2_members(spark, d):
    """Every scalar member of every object, from the typed subtype tables: with its row, its kind and its typed value."""
    rows = p2_subtypes(spark, d)
    kind = lambda c, k, *v: rows.select("path", "node_ptr", "role", F.lit(k).alias("kind"), F.explode(c).alias("name", "value")).select("path", "node_ptr", "role", "kind", "name", *v)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    number = kind("numbers", "number", F.round("value", 6).alias("number"), none("boolean", "truth"), none("string", "text"))
    truth = kind("booleans", "boolean", none("double", "number"), F.col("value").alias("truth"), none("string", "text"))
    return number.unionByName(truth).unionByName(kind("strings", "string", none("double", "number"), none("boolean", "truth"), F.col("value").alias("text")))


def p2_elements(spark, d):
    return nested.list_elements(table(spark, d, "files"))


def p2_places(spark, d):
    """The places and kinds of p2_elements, without their values."""
    return nested.list_elements(table(spark, d, "files")).drop("raw")


def _sessions(spark, d):
    return sessions.sessions(sessions.calls_once(table(spark, d, "tool_calls")))


def p4_found(spark, d):
    return _sessions(spark, d).select("conversation_id", "start_us", "end_us", "n_calls")


def p4_sessions(spark, d):
    return _sessions(spark, d).select("conversation_id", "session", "start_us", "end_us", "duration_us", "n_calls", F.explode("by_label").alias("tool", "n_tool"))


def p5_found(spark, d):
    return snapshots.catalog_changes(table(spark, d, "ref_trees"), table(spark, d, "ref_files"))


def p5_counts(spark, d):
    return p5_found(spark, d).groupBy("tree_oid", "change_kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p1_paths, p1_failed_casts, p2_found, p2_variants, p2_supertypes, p2_subtypes, p2_members, p2_elements, p2_places, p4_found, p4_sessions, p5_found, p5_counts)}

_CALLS_SQL = r"""
raw AS (
  SELECT call_id, received_at, tool, nullif(lower(regexp_replace(conversation_id, '^\s+|\s+$', '', 'g')), '') AS conversation_id, trim(ts) AS t FROM tool_calls),
parsed AS (
  SELECT call_id, received_at, tool, conversation_id,
    CASE
      WHEN regexp_full_match(t, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)?') THEN
        epoch_us(try_cast(substr(t, 1, 10) || ' ' || substr(t, 12, 8) AS TIMESTAMP))
        + CAST(rpad(regexp_extract(t, '\.(\d{1,6})', 1), 6, '0') AS BIGINT)
        - CASE WHEN regexp_matches(t, '[+-]\d\d:?\d\d$') THEN
            (CASE WHEN regexp_extract(t, '([+-])\d\d:?\d\d$', 1) = '-' THEN -1 ELSE 1 END)
            * (CAST(regexp_extract(t, '[+-](\d\d):?\d\d$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(t, '[+-]\d\d:?(\d\d)$', 1) AS BIGINT) * 60) * 1000000
          ELSE 0 END
      WHEN regexp_full_match(t, '\d{10}(\.\d{1,6})?') THEN CAST(CAST(t AS DECIMAL(20, 6)) * 1000000 AS BIGINT)
      WHEN regexp_full_match(t, '\d{13}') THEN CAST(t AS BIGINT) * 1000
    END AS us
  FROM raw),
calls AS (
  SELECT conversation_id, tool, us FROM parsed WHERE conversation_id IS NOT NULL AND us IS NOT NULL
  QUALIFY call_id IS NULL OR row_number() OVER (PARTITION BY call_id ORDER BY received_at, us, conversation_id, tool) = 1),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens FROM calls WINDOW w AS (PARTITION BY conversation_id ORDER BY us)),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conversation_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)
"""

_OPENED = "CASE WHEN NOT json_valid(frontmatter) THEN NULL WHEN json_type(frontmatter) = 'VARCHAR' THEN json_extract_string(frontmatter, '$') ELSE frontmatter END"
#: Each distinct frontmatter opened once; j is null for an unreadable one.
_READ_SQL = f"""
texts AS (SELECT frontmatter, CASE WHEN json_valid(o) AND json_type(o) = 'OBJECT' THEN CAST(o AS JSON) END AS j FROM (SELECT frontmatter, {_OPENED} AS o FROM (SELECT frontmatter FROM ref_files UNION SELECT frontmatter FROM files) WHERE frontmatter IS NOT NULL))"""


def _canonical_sql(source: str, *keys: str) -> str:
    """(keys, canon) of a table (keys, j): one text per JSON value, of all its nodes in order of their places."""
    ks = ", ".join(keys)
    return rf"""SELECT {ks}, string_agg(fullkey || ' ' || CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') THEN type || coalesce(atom ->> '$', '') WHEN type = 'VARCHAR' THEN 'S' || (atom ->> '$') ELSE 'N' || CAST(CAST(atom ->> '$' AS DOUBLE) AS VARCHAR) END, chr(1) ORDER BY fullkey) AS canon
    FROM (SELECT {ks}, t.fullkey, t.type, t.atom FROM {source} q, json_tree(q.j) t WHERE q.j IS NOT NULL) GROUP BY {ks}"""


_TREES_SQL = """
delivered AS (SELECT DISTINCT tree_oid FROM ref_files WHERE tree_oid IS NOT NULL),
parents AS (SELECT tree_oid, max(parent_oid) AS parent FROM ref_trees WHERE tree_oid IS NOT NULL GROUP BY 1),
up AS (SELECT d.tree_oid, p.parent AS anc FROM delivered d JOIN parents p USING (tree_oid) WHERE p.parent IS NOT NULL
  UNION ALL SELECT u.tree_oid, p.parent FROM up u JOIN parents p ON p.tree_oid = u.anc WHERE u.anc NOT IN (SELECT tree_oid FROM delivered) AND p.parent IS NOT NULL),
edges AS (SELECT tree_oid, anc AS from_oid FROM up WHERE anc IN (SELECT tree_oid FROM delivered)),
snaps AS (SELECT tree_oid, nfc_normalize(path) AS path, frontmatter FROM ref_files WHERE tree_oid IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tree_oid, nfc_normalize(path) ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1)"""
_CHANGES_SQL = f"""WITH RECURSIVE {_TREES_SQL}, {_READ_SQL}, canons AS ({_canonical_sql('texts', 'frontmatter')}),
marked AS (SELECT tree_oid, path, CASE WHEN s.frontmatter IS NULL THEN 'n' ELSE coalesce('j' || canon, 't' || s.frontmatter) END AS mark FROM snaps s LEFT JOIN canons c ON s.frontmatter = c.frontmatter),
later AS (SELECT e.tree_oid, e.from_oid, m.path, m.mark FROM edges e JOIN marked m USING (tree_oid)), earlier AS (SELECT e.tree_oid, e.from_oid, m.path, m.mark FROM edges e JOIN marked m ON m.tree_oid = e.from_oid),
changes AS (SELECT tree_oid, path, CASE WHEN a.mark IS NULL THEN 'added' WHEN b.mark IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM earlier a FULL JOIN later b USING (tree_oid, path) WHERE a.mark IS DISTINCT FROM b.mark)"""
_KIND_SQL = "CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END"
_DRIFT_SQL = f"""WITH RECURSIVE {_TREES_SQL}, {_READ_SQL},
latest AS (SELECT tree_oid AS oid, '' AS base, path, frontmatter FROM snaps UNION ALL
  SELECT 'working', coalesce(base_oid, ''), nfc_normalize(path), frontmatter FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nfc_normalize(path) ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1),
notes AS (SELECT oid, base, path, frontmatter, json_extract_string(j, '$.okf_type') AS okf_type FROM latest JOIN texts USING (frontmatter) WHERE j IS NOT NULL AND json_type(j, '$.okf_type') = 'VARCHAR'),
parts AS (SELECT frontmatter, name, json_extract(j, '/' || replace(replace(name, '~', '~0'), '/', '~1')) AS v FROM (SELECT frontmatter, j, unnest(json_keys(j)) AS name FROM texts WHERE j IS NOT NULL)),
held AS (SELECT frontmatter, name, {_KIND_SQL} AS kind, v AS j FROM parts WHERE json_type(v) <> 'NULL'),
fields AS (SELECT n.*, h.name, h.kind FROM notes n JOIN held h USING (frontmatter)),
sizes AS (SELECT oid, base, okf_type, count(*) AS n_notes FROM notes GROUP BY ALL),
kinds AS (SELECT oid, base, okf_type, name, kind, count(*) AS n FROM fields GROUP BY ALL),
belongs AS (SELECT oid, base, okf_type, name, sum(n) AS n, first(kind ORDER BY n DESC, kind) AS kind FROM kinds GROUP BY ALL),
member AS (SELECT b.* FROM belongs b JOIN sizes s USING (oid, base, okf_type) WHERE b.n * 100 >= s.n_notes * 20),
every AS (SELECT from_oid, tree_oid AS to_oid, '' AS to_base FROM edges UNION ALL SELECT DISTINCT base, 'working', base FROM latest WHERE oid = 'working' AND base IN (SELECT tree_oid FROM delivered)),
pairs AS (SELECT e.*, a.okf_type FROM every e JOIN sizes a ON a.oid = e.from_oid AND a.base = '' JOIN sizes b ON b.oid = e.to_oid AND b.base = e.to_base AND b.okf_type = a.okf_type),
old AS (SELECT p.*, m.name, m.kind FROM pairs p JOIN member m ON m.oid = p.from_oid AND m.base = '' AND m.okf_type = p.okf_type),
new AS (SELECT p.*, m.name, m.kind FROM pairs p JOIN member m ON m.oid = p.to_oid AND m.base = p.to_base AND m.okf_type = p.okf_type),
moved AS (SELECT from_oid, to_oid, to_base, okf_type, name, o.kind AS old_kind, n.kind AS new_kind FROM old o FULL JOIN new n USING (from_oid, to_oid, to_base, okf_type, name) WHERE o.kind IS DISTINCT FROM n.kind),
canons AS ({_canonical_sql('held', 'frontmatter', 'name', 'kind')}),
had AS (SELECT m.from_oid, m.to_oid, m.to_base, m.okf_type, f.path, m.name, c.canon FROM moved m JOIN fields f ON f.oid = m.from_oid AND f.base = '' AND f.okf_type = m.okf_type AND f.name = m.name JOIN canons c ON c.frontmatter = f.frontmatter AND c.name = f.name
  JOIN notes x ON x.oid = m.to_oid AND x.base = m.to_base AND x.okf_type = m.okf_type AND x.path = f.path WHERE m.new_kind IS NULL),
has AS (SELECT m.from_oid, m.to_oid, m.to_base, m.okf_type, f.path, m.name, c.canon FROM moved m JOIN fields f ON f.oid = m.to_oid AND f.base = m.to_base AND f.okf_type = m.okf_type AND f.name = m.name JOIN canons c ON c.frontmatter = f.frontmatter AND c.name = f.name WHERE m.old_kind IS NULL),
totals AS (SELECT from_oid, to_oid, to_base, okf_type, name, count(*) AS n FROM had GROUP BY ALL),
shares AS (SELECT h.from_oid, h.to_oid, h.to_base, h.okf_type, h.name AS field_name, x.name AS new_name, count(*) AS same FROM had h JOIN has x USING (from_oid, to_oid, to_base, okf_type, path, canon) GROUP BY ALL),
good AS (SELECT s.*, same / n AS share FROM shares s JOIN totals t ON s.from_oid = t.from_oid AND s.to_oid = t.to_oid AND s.to_base = t.to_base AND s.okf_type = t.okf_type AND s.field_name = t.name WHERE same * 100 >= n * 80),
taken AS (SELECT from_oid, to_oid, to_base, okf_type, list_reduce(list(struct_pack(olds := [field_name], news := [new_name]) ORDER BY share DESC, field_name, new_name),
  lambda a, x: CASE WHEN list_contains(a.olds, x.olds[1]) OR list_contains(a.news, x.news[1]) THEN a ELSE struct_pack(olds := a.olds || x.olds, news := a.news || x.news) END) AS r FROM good GROUP BY ALL),
renamed AS (SELECT from_oid, to_oid, to_base, okf_type, unnest(r.olds) AS field_name, unnest(r.news) AS new_name FROM taken)
SELECT from_oid, to_oid, okf_type, 'renamed' AS change_kind, field_name, new_name FROM renamed
UNION ALL SELECT m.from_oid, m.to_oid, m.okf_type, CASE WHEN old_kind IS NULL THEN 'added' WHEN new_kind IS NULL THEN 'removed' ELSE 'retyped' END, m.name, '' FROM moved m LEFT JOIN renamed r
  ON r.from_oid = m.from_oid AND r.to_oid = m.to_oid AND r.to_base = m.to_base AND r.okf_type = m.okf_type AND (r.field_name = m.name OR r.new_name = m.name) WHERE r.okf_type IS NULL"""

_LATEST_FILES_SQL = f"""latest AS (SELECT path, frontmatter FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1),
opened AS (SELECT path, {_OPENED} AS j FROM latest)"""
#: All values of the notes, with their pointers and roles; step by step, as JSON Pointers are.
_VALUES_SQL = rf"""WITH RECURSIVE {_LATEST_FILES_SQL},
tree AS (
  SELECT path, '' AS node_ptr, CAST(NULL AS VARCHAR) AS parent_ptr, '' AS role, '' AS list_ptr, '' AS name, '' AS step, false AS element, CAST(j AS JSON) AS v FROM opened WHERE json_valid(j) AND json_type(j) = 'OBJECT'
  UNION ALL
  SELECT path, node_ptr || '/' || step, CASE json_type(v) WHEN 'OBJECT' THEN node_ptr ELSE parent_ptr END, role || '/' || CASE json_type(v) WHEN 'OBJECT' THEN step ELSE '*' END, node_ptr, CASE json_type(v) WHEN 'OBJECT' THEN replace(replace(step, '~1', '/'), '~0', '~') ELSE name END, step, json_type(v) = 'ARRAY', json_extract(v, '/' || step) FROM (
    SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: replace(replace(k, '~', '~0'), '/', '~1')) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) END) AS step FROM (SELECT * EXCLUDE (step) FROM tree WHERE json_type(v) IN ('OBJECT', 'ARRAY')))),
kinds AS (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM tree)"""

ORACLES = {
    "p1_found": _DRIFT_SQL,
    "p5_found": f"{_CHANGES_SQL} SELECT * FROM changes",
    "p5_counts": f"{_CHANGES_SQL} SELECT tree_oid, change_kind, count(*) AS n FROM changes GROUP BY ALL",
    "p2_supertypes": f"""{_VALUES_SQL}, objects AS (SELECT role, count(*) AS n_role FROM kinds WHERE kind = 'object' GROUP BY 1),
      m AS (SELECT k.path, k.node_ptr, substr(k.role, 1, length(k.role) - length(k.step) - 1) AS role, k.name AS key, k.kind FROM kinds k WHERE node_ptr <> '' AND NOT element),
      g AS (SELECT role, key, count(*) AS n, count(DISTINCT kind) AS n_kinds, min(kind) AS kind FROM m GROUP BY ALL)
      SELECT role, key, CASE WHEN n_kinds = 1 THEN kind ELSE 'mixed' END AS kind, n, n = n_role AND n_kinds = 1 AS common FROM g JOIN objects USING (role)""",
    "p2_members": f"""{_VALUES_SQL} SELECT path, parent_ptr AS node_ptr, substr(role, 1, length(role) - length(step) - 1) AS role, kind, name, CASE kind WHEN 'number' THEN round(CAST(v ->> '$' AS DOUBLE), 6) END AS number,
      CASE kind WHEN 'boolean' THEN CAST(v ->> '$' AS BOOLEAN) END AS truth, CASE kind WHEN 'string' THEN v ->> '$' END AS text FROM kinds WHERE NOT element AND node_ptr <> '' AND kind IN ('number', 'boolean', 'string')""",
    "p2_places": f"""{_VALUES_SQL} SELECT path, parent_ptr, name, list_ptr, CAST(step AS INTEGER) AS position, kind FROM kinds WHERE element AND kind <> 'object'""",
    "p4_found": f"WITH {_CALLS_SQL} SELECT conversation_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_calls FROM numbered GROUP BY conversation_id, session",
    "p4_sessions": f"""WITH {_CALLS_SQL}, s AS (
      SELECT conversation_id, session, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_calls FROM numbered GROUP BY conversation_id, session)
      SELECT s.*, coalesce(n.tool, '') AS tool, count(*) AS n_tool FROM numbered n JOIN s USING (conversation_id, session) GROUP BY ALL""",
    "p2_found": r"""WITH RECURSIVE latest AS (SELECT path, frontmatter FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, frontmatter DESC NULLS LAST) = 1),
    opened AS (SELECT path, CASE WHEN NOT json_valid(frontmatter) THEN NULL WHEN json_type(frontmatter) = 'VARCHAR' THEN json_extract_string(frontmatter, '$') ELSE frontmatter END AS j FROM latest),
    tree AS (
      SELECT path, '' AS node_ptr, '' AS parent_ptr, CAST(j AS JSON) AS v FROM opened WHERE json_valid(j) AND json_type(j) = 'OBJECT'
      UNION ALL
      SELECT path, node_ptr || '/' || step, CASE json_type(v) WHEN 'OBJECT' THEN node_ptr ELSE parent_ptr END, json_extract(v, '/' || step) FROM (
        SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: replace(replace(k, '~', '~0'), '/', '~1')) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) END) AS step FROM tree WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
    SELECT path, node_ptr, parent_ptr FROM tree WHERE json_type(v) = 'OBJECT' AND node_ptr <> ''""",
}
