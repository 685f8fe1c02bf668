"""Note formats as DataFrames: parsers wrapped as Arrow UDFs, so a note is parsed where it lies and its rows are exploded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.arrow import arrow_fn
from vaultspark.parse import markdown, mermaid

_S, _I = pa.string(), pa.int32()
CHUNK = pa.struct([("path", _S), ("ord", _I), ("heading", _S), ("text", _S), ("start_line", _I), ("end_line", _I), ("heading_level", _I), ("chunk_hash", _S), ("content_hash", _S), ("section_bytes", _I), ("chunk_kind", _S), ("parent_chunk_hash", _S), ("table_id", _S), ("table_schema_hash", _S), ("row_index", _I), ("row_key", _S)])
SECTION = pa.struct([("heading", _S), ("level", _I), ("text", _S), ("start_line", _I), ("end_line", _I)])
TABLE = pa.struct([("headers", pa.list_(_S)), ("rows", pa.list_(pa.list_(_S))), ("aligns", pa.list_(_S)), ("start", _I), ("end", _I), ("number", _I)])
DIAGRAM = pa.struct([
    ("type", _S), ("direction", _S), ("error", _S), ("groups", pa.list_(_S)),
    ("nodes", pa.list_(pa.struct([("id", _S), ("label", _S), ("group", _S)]))), ("edges", pa.list_(pa.struct([("from", _S), ("to", _S), ("label", _S)]))),
])


@arrow_fn(_S)
def frontmatter(text: pa.Array, path: pa.Array) -> pa.Array:
    """Frontmatter of a note as JSON; null for a note without."""
    return pa.array([markdown.frontmatter_json(t, p or "") for t, p in zip(text.to_pylist(), path.to_pylist())], _S)


def chunk_rows(notes: DataFrame, path: str = "path", text: str = "text", model: str = "", key_column: str | None = None) -> DataFrame:
    """All chunks of notes. Null texts have none; a null path counts as ''."""

    @arrow_fn(pa.list_(CHUNK))
    def of(t: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([markdown.chunks(a, b or "", model, key_column) for a, b in zip(t.to_pylist(), p.to_pylist())], pa.list_(CHUNK))

    return notes.where(F.col(text).isNotNull()).select(F.explode(of(text, path)).alias("c")).select("c.*")


@arrow_fn(pa.list_(SECTION))
def sections(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else markdown.sections(t) for t in text.to_pylist()], pa.list_(SECTION))


@arrow_fn(pa.list_(TABLE))
def tables(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else markdown.tables(t.split("\n")) for t in text.to_pylist()], pa.list_(TABLE))


def _graph(text: str) -> dict:
    d = mermaid.parse(text)
    return d | {"nodes": [{"id": n[0], "label": n[1], "group": n[2]} for n in d["nodes"]], "edges": [{"from": e[0], "to": e[1], "label": e[2]} for e in d["edges"]]}


@arrow_fn(DIAGRAM)
def diagram(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _graph(t) for t in text.to_pylist()], DIAGRAM)


@arrow_fn(pa.list_(DIAGRAM))
def diagrams(text: pa.Array, path: pa.Array) -> pa.Array:
    """The diagrams of a document in order: a .mmd file is one, other texts hold them in fenced blocks. Null for a null text."""

    def of(t: str, p: str) -> list[dict]:
        return [_graph(t)] if p.lower().endswith(".mmd") else [_graph(b) for _, b in markdown.diagram_blocks(t.split("\n"))]

    return pa.array([None if t is None else of(t, p or "") for t, p in zip(text.to_pylist(), path.to_pylist())], pa.list_(DIAGRAM))


@arrow_fn(_S)
def collapse_tables(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else markdown.collapse_tables(t) for t in text.to_pylist()], _S)


def blake2b(text: Column, size: int = 8) -> Column:
    """Hex digest of `size` bytes, for ids that other tools made so."""

    @arrow_fn(_S)
    def digest(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=size).hexdigest() for x in t.to_pylist()], _S)

    return digest(text)


def table_rows(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, table, row_index, cells): every row of every table, cells as a map from header to text (of equal headers the last)."""
    t = notes.where(F.col(text).contains("|")).select(path, F.explode(tables(text)).alias("t"))
    r = t.select(path, F.col("t.number").alias("table"), "t.headers", F.posexplode("t.rows").alias("row_index", "row"))
    pairs = F.map_from_entries(F.transform(F.array_distinct("headers"), lambda h: F.struct(h, F.element_at(F.transform(F.filter(F.arrays_zip(F.col("headers").alias("h"), F.col("row").alias("c")), lambda x: x["h"] == h), lambda x: x["c"]), -1))))
    return r.select(path, "table", "row_index", pairs.alias("cells"))


def diagrams_with_catalog(diagrams: DataFrame, catalog: DataFrame) -> DataFrame:
    """diagrams (path, ...) with title and type of the catalog entry (slug, title, type) of their folder or, else, their name."""
    d = diagrams.withColumn("_folder", F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).withColumn("_stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    one = catalog.groupBy("slug").agg(F.min(F.struct("title", "type")).alias("c"))
    j = d.join(one.select(F.col("slug").alias("_folder"), F.col("c").alias("_a")), "_folder", "left").join(one.select(F.col("slug").alias("_stem"), F.col("c").alias("_b")), "_stem", "left")
    return j.select(*diagrams.columns, F.coalesce("_a.title", "_b.title", F.initcap(F.replace(F.col("_stem"), F.lit("-"), F.lit(" ")))).alias("title"), F.coalesce("_a.type", "_b.type", F.lit("flowchart")).alias("diagram_type"))
