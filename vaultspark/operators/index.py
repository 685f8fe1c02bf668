"""A stored search index: postings and vectors, written once and read by every query.

postings/   term, id, tf, dl and the columns kept for scopes, in order of term (then id): a query's few terms are found by the
            statistics of the files' row groups, and a term that a third of all texts hold is spread over many files.
vectors/    id, the kept columns and the text's vector.
statistics/ one row: n_docs, n_tokens.
Postings are made in one pass over the texts; only (term, id, tf, dl) and the kept columns travel, after each text has counted
its own terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import query_terms, tokens
from vaultspark.operators import search


def term_counts(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """(columns..., dl, term, tf): the terms of each text with their numbers and the text's number of tokens.

    A text's tokens are sorted, and a run of equal ones ends where the next differs: n log n in the tokens. By generators, so
    that what the lambdas need is a column and not an expression to be taken anew for each element.
    """
    words = docs.select(*columns, F.explode(F.array(F.array_sort(tokens(F.col(text))))).alias("t"))
    last = F.filter(F.transform("t", lambda x, i: F.when((i == F.size("t") - 1) | (F.get("t", i + 1) != x), F.struct(x.alias("term"), i.alias("at")))), lambda e: e.isNotNull())
    ends = words.select(*columns, F.size("t").alias("dl"), F.explode(F.array(last)).alias("e"))
    runs = F.transform("e", lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.get("e", i - 1)["at"], F.lit(-1))).alias("tf")))
    return ends.select(*columns, "dl", F.inline(runs))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    folder: str
    id: str = "doc_id"

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), embedding: str | None = None) -> SearchIndex:
        """Write the index of docs; their ids are unique. keep are columns that scopes may use. Without an embedding column the
        deterministic embedder makes the vectors. A null text has no postings and no vector, but counts as one of length 0."""
        named = docs.select(F.col(id).alias("id"), *keep, F.col(text).alias("_text"), *([F.col(embedding).alias("_vector")] if embedding else []))
        postings = term_counts(named, "_text", "id", *keep).select("term", "id", "tf", "dl", *keep)
        postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        vector = F.col("_vector") if embedding else search.embed(F.col("_text"))
        named.where("_text is not null").select("id", *keep, vector.alias("embedding")).write.mode("overwrite").parquet(f"{folder}/vectors")
        search.corpus_statistics(named, "_text").select("n_docs", "n_tokens").write.mode("overwrite").parquet(f"{folder}/statistics")
        return cls(docs.sparkSession, folder, id)

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def bm25(self, query: str, n: int = search.CANDIDATES, scope: Column | None = None) -> DataFrame:
        """(id, score), the n best, as search.bm25 of the texts: only the postings of the query's terms are read. No terms, no rows."""
        terms, every = query_terms(query)
        p = self.part("postings").where(F.col("term").isin(terms))
        if not terms:
            return p.select(F.col("id").alias(self.id), F.lit(0.0).alias("score")).where("false")
        of = lambda i, w: F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}")
        found = p if scope is None else p.where(scope)
        tf = found.groupBy("id").agg(F.max("dl").alias("dl"), *[of(i, w) for i, w in enumerate(terms)])
        whole = self.part("statistics").agg(F.sum("n_docs").alias("n"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg"))
        df = p.agg(*[F.coalesce(F.sum(F.when(F.col("term") == w, 1).otherwise(0)), F.lit(0)).alias(f"df{i}") for i, w in enumerate(terms)])
        stats = whole.crossJoin(df).select(F.struct("*").alias("s")).scalar()  # one row each
        return search.scored(tf, stats, len(terms), every, self.id, n)

    def knn(self, query: Column, n: int = search.CANDIDATES, scope: Column | None = None) -> DataFrame:
        """(id, distance), the n nearest of the stored vectors; exact."""
        return search.knn(self.part("vectors").withColumnRenamed("id", self.id), query, n, self.id, "embedding", scope)

    def hybrid(self, query: str, k: int = 8, scope: Column | None = None, query_vector: list[float] | None = None, pools: tuple[int, int] | None = None, lexical_only: bool = False) -> DataFrame:
        """(id, score): postings and vectors fused, the best k. pools: how many lexical and vector candidates (see search.pools)."""
        lexical, dense = pools or (max(search.CANDIDATES, 4 * k),) * 2
        lex = search.ranked(self.bm25(query, lexical, scope), F.desc("score"), self.id).select(self.id, "rank")
        if lexical_only:
            return search.fuse(lex, lex.where("false"), self.id).orderBy(F.desc("score"), self.id).limit(k)
        q = search.vector(query_vector) if query_vector is not None else search.embed(F.lit(query))
        den = search.ranked(self.knn(q, dense, scope), "distance", self.id).select(self.id, "rank")
        return search.fuse(lex, den, self.id).orderBy(F.desc("score"), self.id).limit(k)
