"""The engine as one object: structured queries, search, reading, browsing, statistics and edits over a vault's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import index_text
from vaultspark.operators import browse, mutate, predicates, rules, search, telemetry
from vaultspark.operators.index import SearchIndex
from vaultspark.sources import formats, vault


class Engine:
    """notes: path, mtime, text. chunks and the catalog are derived from them unless given, lazily, as DataFrames."""

    def __init__(self, notes: DataFrame, chunks: DataFrame | None = None, calls: DataFrame | None = None):
        self.spark: SparkSession = notes.sparkSession
        self.notes, self.calls = notes, calls
        self.chunks = chunks if chunks is not None else formats.chunk_rows(notes)
        raw = notes.select("path", "mtime", formats.frontmatter("text", "path").alias("frontmatter"))
        self.catalog = predicates.catalog(raw)
        self.stored: SearchIndex | None = None
        self.skipped: DataFrame | None = None

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, **options: str) -> Engine:
        return cls(vault.read_vault(spark, root, **options))

    @classmethod
    def from_git(cls, spark: SparkSession, root: str, ref: str) -> Engine:
        """The notes as they were at a ref. Notes too large to be read (see read_tree) are in skipped: (path, oid)."""
        tree = vault.read_tree(spark, root, ref)
        engine = cls(tree.where("text is not null").select("path", "mtime", "text"))
        engine.skipped = tree.where("text is null").select("path", "oid")
        return engine

    def _indexed(self) -> DataFrame:
        return self.chunks.withColumn("text", index_text(F.col("text"), F.col("chunk_kind")))

    def build_index(self, folder: str, embedding: str | None = None) -> SearchIndex:
        """Write a stored index of the chunks; searches use it from then on, as they do one that was opened."""
        self.stored = SearchIndex.build(self._indexed(), folder, "chunk_hash", "text", ("path", "chunk_kind"), embedding)
        return self.stored

    def open_index(self, folder: str) -> SearchIndex:
        self.stored = SearchIndex(self.spark, folder, "chunk_hash")
        return self.stored

    def filter_notes(self, where: dict | None = None, **options) -> DataFrame:
        return predicates.filter_notes(self.catalog, where, **options)

    def search(self, query: str, k: int = 5, offset: int = 0, folder: str | None = None, exclude: list[str] | None = None, **options) -> DataFrame:
        """(chunk_hash, score, path, heading, text, chunk_kind, start_line, end_line, has_more), best first."""
        scope = predicates.in_folder(F.col("path"), folder) & ~predicates.excluded(F.col("path"), exclude)
        wanted, diagrams = k + offset + 1, search.has_catalog(folder)
        options = {"pools": search.pools(wanted, bool(exclude), bool(folder), 1 << 31)} | options
        take = sum(options["pools"]) if diagrams else wanted
        if self.stored is not None:
            top = self.stored.hybrid(query, take, scope, **options)
        else:
            top = search.hybrid(self._indexed(), query, take, "chunk_hash", "text", scope=scope, **options)
        if diagrams:  # boosted scores have another order, so all candidates are boosted before the page is cut
            own = top.join(self.chunks.select("chunk_hash", "path", "chunk_kind"), "chunk_hash")
            top = own.select("chunk_hash", F.round(search.catalog_boost(F.col("score"), F.col("path"), F.col("chunk_kind"), folder), 6).alias("score")).orderBy(F.desc("score"), "chunk_hash").limit(wanted)
        page = search.page(top, k, offset, F.desc("score"), "chunk_hash")
        return page.join(self.chunks.select("chunk_hash", "path", "heading", "text", "chunk_kind", "start_line", "end_line"), "chunk_hash").orderBy(F.desc("score"), "chunk_hash")

    def read(self, path: str, first: int | None = None, last: int | None = None, heading: str | None = None) -> DataFrame:
        """(path, text): a note, some of its lines, or its sections under a heading."""
        if heading is not None:
            c = self.chunks.where((F.col("path") == path) & (F.col("chunk_kind") == "section") & browse.heading_matches(F.col("heading"), heading))
            return c.orderBy("ord").select("path", "text")
        lines = F.split("text", "\n")
        part = F.array_join(F.slice(lines, F.lit(first or 1), F.greatest(F.lit(0), (F.lit(last) if last else F.size(lines)) - (first or 1) + 1)), "\n")
        return self.notes.where(F.col("path") == path).select("path", part.alias("text"))

    def read_chunk(self, chunk_hash: str) -> DataFrame:
        """A chunk with its neighbours."""
        own = self.chunks.where(F.col("chunk_hash") == chunk_hash)
        near = browse.navigation(self.chunks.join(own.select("path"), "path", "left_semi"), "chunk_hash")
        return own.join(near.select("chunk_hash", "place", "total", "prev", "next"), "chunk_hash")

    def toc(self, path: str) -> DataFrame:
        return browse.table_of_contents(self.chunks, path)

    def backlinks(self, path: str, limit: int | None = None) -> DataFrame:
        key = path.rsplit(".", 1)[0].lower()
        return browse.backlinks(browse.links(self.notes), [key, key.rsplit("/", 1)[-1]], path, limit)

    def history(self, limit: int = 20, since: str | None = None, until: str | None = None, **options) -> DataFrame:
        a, b = browse.day_bounds(since, until)
        return browse.recent_preview(self.notes, self.chunks, limit, since=a, until=b, **options)

    def lint(self, **options) -> DataFrame:
        links = browse.links(self.notes)
        return rules.flaws(self.notes, links=links, link_states=browse.link_states(links, self.notes), **options)

    def patch(self, edits: DataFrame, strict: bool = True) -> DataFrame:
        return mutate.patch_notes(self.notes, edits, strict)

    def stats(self) -> DataFrame:
        """(n_notes, n_chunks): counts of the index."""
        n = self.notes.agg(F.count("*").alias("n")).scalar()
        return self.chunks.agg(n.alias("n_notes"), F.count("*").alias("n_chunks"))

    def tool_stats(self) -> DataFrame:
        return telemetry.by_tool(self.calls)
