"""Queries of the problems for language-model data (3, 6, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultspark.llm import packing, quantiles, spans, splitting, tokenizer
from vaultspark.sources.tables import table


def p3_found(spark, d):
    return splitting.natural_boundaries(table(spark, d, "hits"))


def p3_pieces(spark, d):
    return splitting.pieces(table(spark, d, "hits"))


def p6_percentiles(spark, d):
    return quantiles.percentiles(table(spark, d, "tool_calls"))


def p6_daily(spark, d):
    """Percentiles of each day alone, from the sketches that p6_percentiles combines."""
    return quantiles.answers(quantiles.daily_sketches(table(spark, d, "tool_calls")), "day", "tool", "collection")


def p6_bounds(spark, d):
    """Whether the rank error of each percentile of p6_percentiles is 0.01 at most, by exact ranks over all values."""
    calls = table(spark, d, "tool_calls")
    exact = quantiles.rank_errors(quantiles.durations_once(calls), quantiles.percentiles(calls), "tool", "collection")
    return exact.select("tool", "collection", "n", *[(F.col(f"{name}_error") <= 0.01).alias(f"{name}_ok") for name in quantiles.RANKS])


def p7_ids(spark, d):
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p8_checks(spark, d):
    """Facts about p8_containers: texts placed, pieces, how many break a rule, and whether few containers more than the least are used."""
    docs = table(spark, d, "documents")
    sized = docs.select("doc_id", tokenizer.token_count(F.col("text")).alias("n_tokens"))
    return packing.facts(sized, packing.pack(docs))


def p9_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p9_shared(spark, d):
    """Per document, how much of it is shared elsewhere; documents without a shared character have 0."""
    docs = table(spark, d, "documents")
    n = spans.shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"), F.count("*").alias("n_spans"))
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).join(n, "doc_id", "left").na.fill(0, ["n_shared", "n_spans"])


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p6_percentiles, p6_daily, p6_bounds, p7_ids, p8_containers, p8_checks, p9_found, p9_shared)}
_CALLS = r"""raw AS (SELECT call_id, received_at, tool, collection, duration_ms FROM tool_calls WHERE duration_ms >= 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms)),
  once AS (SELECT * FROM raw QUALIFY call_id IS NULL OR row_number() OVER (PARTITION BY call_id ORDER BY received_at, duration_ms, tool, collection) = 1)"""
_SPANS = """w AS (SELECT doc_id, i, hash(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL)),
  shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
  marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS opens FROM w JOIN shared USING (h) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
  spans AS (SELECT doc_id, min(i) AS start_pos, max(i) + 200 AS end_pos FROM runs GROUP BY doc_id, run)"""

_FIRST_CALLS = f"""WITH {_CALLS} SELECT tool, collection, count(*) AS n, true AS p50_ok, true AS p90_ok, true AS p99_ok FROM once GROUP BY ALL"""
_BOUNDARIES = r"""WITH RECURSIVE h AS (SELECT hit_id, start_line, text FROM hits WHERE length(text) > 2000 QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id) = 1),
  l AS (SELECT hit_id, start_line, i, rtrim(line, chr(13)) AS line FROM (SELECT hit_id, start_line, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM h)),
  t AS (SELECT *, regexp_full_match(line, '[ \t]*') AS blank, regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') AS heading, coalesce(nullif(regexp_extract(line, '^ {0,3}(`{3,})[^`]*$', 1), ''), regexp_extract(line, '^ {0,3}(~{3,})', 1)) AS opens, regexp_extract(line, '^ {0,3}(`{3,}|~{3,})[ \t]*$', 1) AS closes FROM l),
  walk AS (SELECT hit_id, i, false AS inside, opens AS fence FROM t WHERE i = 0 UNION ALL
    SELECT t.hit_id, t.i, w.fence <> '', CASE WHEN w.fence = '' THEN t.opens WHEN t.closes <> '' AND starts_with(t.closes, w.fence) THEN '' ELSE w.fence END FROM walk w JOIN t ON t.hit_id = w.hit_id AND t.i = w.i + 1)
  SELECT hit_id, CAST(start_line AS BIGINT) + i AS line_no FROM (SELECT t.hit_id, t.start_line, t.i, t.blank, t.heading, w.inside, lag(t.blank AND NOT w.inside) OVER (PARTITION BY t.hit_id ORDER BY t.i) AS after_blank FROM t JOIN walk w ON w.hit_id = t.hit_id AND w.i = t.i)
  WHERE i = 0 OR (NOT blank AND NOT inside AND (after_blank OR heading))"""

ORACLES: dict[str, str] = {
    "p3_found": _BOUNDARIES,
    "p6_bounds": _FIRST_CALLS,
    "p8_checks": """SELECT unnest(['texts in containers', 'texts without tokens', 'pieces of texts that fit cut up', 'pieces beyond the capacity', 'pieces that overlap or leave a gap', 'tokens missing or twice', 'places not in order', 'containers above the bound']) AS fact,
      unnest([(SELECT count(*) FROM documents WHERE text <> ''), (SELECT count(*) FROM documents WHERE coalesce(text, '') = ''), 0, 0, 0, 0, 0, 0]) AS n""",
    "p9_found": f"WITH {_SPANS} SELECT * FROM spans",
    "p9_shared": f"WITH {_SPANS}, n AS (SELECT doc_id, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_shared, count(*) AS n_spans FROM spans GROUP BY doc_id) SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_shared, 0) AS n_shared, coalesce(n_spans, 0) AS n_spans FROM documents LEFT JOIN n USING (doc_id)",
}
