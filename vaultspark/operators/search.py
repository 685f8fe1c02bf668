"""Retrieval: exact BM25, exact vectors, reciprocal rank fusion, hybrid search, rerank, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.text import query_terms, squared_distance, tokens

RRF_K, CANDIDATES, DIM = 60, 24, 32
K1, B = 1.2, 0.75


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, n_tokens, avg_len): partial sums, so statistics of parts can be added up."""
    return docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avg_len"))


def bm25(docs: DataFrame, query: str, n: int = CANDIDATES, id: str = "doc_id", text: str = "text", scope: Column | None = None) -> DataFrame:
    """(id, score), the n best; ties by id. Statistics are those of all docs, whatever the scope.

    No posting is shuffled: each row counts the few query terms in its own tokens, one global aggregate gives N, average
    length and document frequencies, and comes back as a scalar subquery. No terms, no rows.
    """
    terms, every = query_terms(query)
    own = docs.select(F.col(id).alias("id"), (F.lit(True) if scope is None else scope).alias("in_scope"), tokens(F.col(text)).alias("t"))
    # By a generator, not a projection: the filter on the counts would be pushed below that, and take the tokens anew per term.
    counts = F.struct(F.size("t").alias("dl"), *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)])
    tf = own.select("id", "in_scope", F.inline(F.array(counts)))
    if not terms:
        return tf.select(F.col("id").alias(id), F.lit(0.0).alias("score")).where("false")
    stats = tf.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))]).alias("s")).scalar()
    return scored(tf.where("in_scope").select(F.col("id").alias("id"), "dl", *[f"tf{i}" for i in range(len(terms))]), stats, len(terms), every, id, n)


def scored(tf: DataFrame, stats: Column, terms: int, every: bool, id: str, n: int) -> DataFrame:
    """(id, score), the n best of rows (id, dl, tf0, tf1, ...); stats: a struct with n, avg and the document frequencies df0, df1, ..."""
    held = [F.col(f"tf{i}") > 0 for i in range(terms)]
    hit = tf.where(_all(held) if every else _some(held)).withColumn("s", stats)

    def part(i: int) -> Column:
        df, f = F.col(f"s.df{i}"), F.col(f"tf{i}").cast("double")
        idf = F.greatest(F.ln((F.col("s.n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        idf = F.when(F.col("s.n") - df + 0.5 > df + 0.5, idf).otherwise(1e-6)
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("s.avg")))

    score = sum((part(i) for i in range(1, terms)), part(0))
    return hit.select(F.col("id").alias(id), F.round(score, 6).alias("score")).orderBy(F.desc("score"), id).limit(n)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _some(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def embed(text: Column, dim: int = DIM) -> Column:
    """A deterministic bag of words as a unit vector: the last seven hex digits of a token's MD5, modulo dim, are its slot."""
    # A lambda's body is evaluated per element, so whatever it needs is bound to a variable first.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    slots = F.transform(tokens(text), lambda t: (F.conv(F.right(F.md5(t), F.lit(7)), 16, 10).cast("long") % dim).cast("int"))
    count = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(s) - F.size(F.array_remove(s, i))).cast("double"))
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return let(let(slots, count), unit)


def with_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs that have a text, with its vector as _v; by a generator, so that no filter on the vector makes it twice."""
    return docs.where(F.col(text).isNotNull()).select("*", F.explode(F.array(embed(F.col(text)))).alias("_v"))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(rows: DataFrame, query: Column, n: int = CANDIDATES, id: str = "vec_id", embedding: str = "embedding", scope: Column | None = None) -> DataFrame:
    """(id, distance), the n nearest by exact Euclidean distance; ties by id. A top-n per task, then of those: no sort of all rows."""
    near = rows.where(F.lit(True) if scope is None else scope).where(F.col(embedding).isNotNull()).withColumn("_q", query)
    return near.select(F.col(id), F.round(F.sqrt(squared_distance(F.col(embedding), F.col("_q"))), 6).alias("distance")).orderBy("distance", id).limit(n)


def knn_many(rows: DataFrame, queries: DataFrame, n: int = 10, id: str = "vec_id", embedding: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, distance, rank): the n nearest rows of each query, the query's own row left out. Exact.

    Rows and queries are put in blocks of about `block` vectors (by hash, so near that size); each pair of blocks is one matrix
    product, and the exact distances of the few rows near the n-th decide. n rows per query are kept, so what is shuffled is n rows per query and block, not all pairs. Ties are cut by id. Null vectors don't count.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        size = df.agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("b")).scalar()
        v = df.where(F.col(embedding).isNotNull()).select(F.col(id).alias("i"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
        return v.withColumn("b", F.pmod(F.xxhash64("i"), F.greatest(size, F.lit(1)))).groupBy("b").agg(F.collect_list("i").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vs")).drop("b")

    def nearest(batches):
        for pdf in batches:
            out = []
            for q_ids, q_vs, r_ids, r_vs in zip(pdf.q_ids, pdf.q_vs, pdf.r_ids, pdf.r_vs):
                q, r, ids = np.stack(q_vs), np.stack(r_vs), np.asarray(r_ids)
                # The product of the blocks gives distances but for rounding; of those near enough the exact ones decide.
                near = (q * q).sum(1)[:, None] - 2 * (q @ r.T) + (r * r).sum(1)
                near[np.asarray(q_ids)[:, None] == ids] = np.inf
                most = min(n, len(ids)) - 1
                edge = np.partition(near, most, axis=1)[:, most] if len(ids) else np.zeros(len(q))
                slack = 1e-9 * (1 + (q * q).sum(1) + (r * r).sum(1).max(initial=0)) + 2e-6 * (1 + np.sqrt(np.maximum(np.where(np.isfinite(edge), edge, 0), 0)))
                for k, one in enumerate(q):
                    close = np.flatnonzero((near[k] <= edge[k] + slack[k]) & np.isfinite(near[k]))
                    d = np.round(np.sqrt(((r[close] - one) ** 2).sum(1)), 6)
                    best = np.lexsort((ids[close], d))[:n]
                    out.append(pd.DataFrame({"query_id": q_ids[k], id: ids[close][best], "distance": d[best]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], id: [], "distance": []})

    kind = rows.schema[id].dataType.simpleString()
    pairs = blocks(queries, "q").join(blocks(rows, "r"), F.lit(True))
    near = pairs.mapInPandas(nearest, f"query_id {kind}, {id} {kind}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse(left: DataFrame, right: DataFrame, id: str, k: int = RRF_K) -> DataFrame:
    """(id, score) of two rankings (id, rank from 0): the sum of 1 / (k + rank), best = 1."""
    j = left.select(id, F.col("rank").alias("ra")).join(right.select(id, F.col("rank").alias("rb")), id, "full")
    s = j.select(id, (F.coalesce(1.0 / (F.lit(k) + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (F.lit(k) + F.col("rb")), F.lit(0.0))).alias("raw"))
    return s.select(id, F.round(F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(0))), 6).alias("score"))


def ranked(top: DataFrame, *order) -> DataFrame:
    """rank from 0 of a short list (a top-n, never a table)."""
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def hybrid(docs: DataFrame, query: str, k: int = 8, id: str = "doc_id", text: str = "text", n: int = CANDIDATES, scope: Column | None = None, query_vector: list[float] | None = None, embedding: str | None = None, lexical_only: bool = False, vector_only: bool = False, pools: tuple[int, int] | None = None) -> DataFrame:
    """(id, score): BM25 and vectors, n candidates each (or as many as pools says), fused, the best k. One lazy plan.

    Without an embedding column and a query vector the deterministic embedder stands in. lexical_only is what remains when
    a query can't be embedded.
    """
    few, near = pools or (max(n, 4 * k),) * 2
    if not vector_only:
        lexical = ranked(bm25(docs, query, few, id, text, scope), F.desc("score"), id).select(id, "rank")
    if not lexical_only:
        vectors = docs if embedding else with_vectors(docs, text)
        q = vector(query_vector) if query_vector is not None else embed(F.lit(query))
        dense = ranked(knn(vectors, q, near, id, embedding or "_v", scope), "distance", id).select(id, "rank")
    none = docs.select(id, F.lit(0).alias("rank")).where("false")
    return fuse(none if vector_only else lexical, none if lexical_only else dense, id).orderBy(F.desc("score"), id).limit(k)


def rerank(hits: DataFrame, scorer: Column, k: int, id: str) -> DataFrame:
    """(id, score): hits ordered anew by a scorer (any Column, such as a pandas UDF over texts), scaled to 0..1."""
    w = Window.partitionBy(F.lit(0))
    s = hits.select(id, scorer.cast("double").alias("s"))
    lo, hi = F.min("s").over(w), F.max("s").over(w)
    return s.select(id, F.round(F.when(hi > lo, (F.col("s") - lo) / (hi - lo)).otherwise(1.0), 6).alias("score")).orderBy(F.desc("score"), id).limit(k)


def fan_out(results: list[DataFrame], k: int, offset: int = 0, id: str = "path") -> DataFrame:
    """Results of several vaults or folders merged by their own normalised scores; of an id found twice the better counts."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    best = every.groupBy(id).agg(F.max("score").alias("score"))
    out = best.orderBy(F.desc("score"), id)
    return (out.offset(offset) if offset else out).limit(k)


def page(ranking: DataFrame, k: int, offset: int, *order) -> DataFrame:
    """k rows after offset, each with has_more: only k + offset + 1 rows are ever sorted out."""
    top = ranking.orderBy(*order).limit(k + offset + 1)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("rn", F.row_number().over(w)).withColumn("has_more", n > k + offset).where((F.col("rn") > offset) & (F.col("rn") <= k + offset)).drop("rn")


def has_catalog(folder: str | None) -> bool:
    """Whether a folder is a diagram catalog or lies in one."""
    return "mermaid-catalog" in (folder or "")


def catalog_boost(score: Column, path: Column, kind: Column, folder: str) -> Column:
    """Scores below a diagram catalog: diagrams and their chunks count more, their pages less."""
    if not has_catalog(folder):
        return score
    diagram = kind.isin("mermaid_file", "mermaid_header", "mermaid_node", "mermaid_edge")
    pages = path.contains("/pages/")
    return score * F.when(path.endswith("diagram.mmd"), 1.18).otherwise(1.0) * F.when(diagram, 1.10).otherwise(1.0) * F.when(pages, 0.82).otherwise(1.0) * F.when(pages & (kind == "table_row"), 0.75).otherwise(1.0)


def pools(k: int, exclude: bool, folder: bool, total: int, least: int = CANDIDATES, floor: int = 500, vectors: int = 64) -> tuple[int, int]:
    """How many lexical and vector candidates a search takes; with globs to exclude and no folder, more lexical ones."""
    base = max(4 * k, least)
    return (min(total, max(base, floor)), min(total, vectors)) if exclude and not folder else (base, base)


def evaluate(ranking: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(k, n_queries, hit_at_k, mrr): ranking (query_id, rank from 1, path) against expected (query_id, expect).

    A hit is the expected path or, for an expectation that ends with /, a path below it. Queries without a hit count as 0.
    """
    r, e = ranking.alias("r"), expected.alias("e")
    folder = F.col("e.expect").endswith("/")
    good = (F.col("r.path") == F.col("e.expect")) | (folder & F.col("r.path").startswith(F.col("e.expect")))
    first = r.join(e, F.col("r.query_id") == F.col("e.query_id")).where(good & (F.col("r.rank") <= k)).groupBy(F.col("r.query_id").alias("query_id")).agg(F.min("r.rank").alias("first"))
    all_ = expected.select("query_id").distinct().join(first, "query_id", "left")
    return all_.agg(F.lit(k).alias("k"), F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def at_ref(rows: DataFrame, query: str, k: int, offset: int = 0) -> DataFrame:
    """(path, score): the k best of a full-text search over the notes of one snapshot (path, mtime, frontmatter), with statistics
    of that snapshot alone. score is 1 / (1 + relevance), as readers of snapshots expect it, so it falls with relevance."""
    from vaultspark.operators.nested import latest_rows

    one = latest_rows(rows.where("path is not null").select("path", "mtime", "frontmatter"), "path")
    best = bm25(one, query, k + offset, "path", "frontmatter")
    page_ = best.orderBy(F.desc("score"), "path").offset(offset) if offset else best
    return page_.select("path", F.round(ref_score(F.col("score")), 6).alias("score"))


def ref_score(rank: Column) -> Column:
    """The score of a full-text hit in a snapshot, from its (negative) rank."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(rank))
