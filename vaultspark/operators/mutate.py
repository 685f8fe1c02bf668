"""Edits over DataFrames of notes: patches, guarded writes, three-way merges of whole notes by section."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.arrow import arrow_fn
from vaultspark.functions.text import with_suffix
from vaultspark.operators.versions import compare_and_set, three_way
from vaultspark.parse import markdown as md
from vaultspark.parse.patch import patch_json
from vaultspark.sources.formats import blake2b, sections

_RESULT = pa.struct([("text", pa.string()), ("results", pa.list_(pa.string()))])


def patch_notes(notes: DataFrame, edits: DataFrame, strict: bool = True) -> DataFrame:
    """(path, text, results, changed) of notes (path, text) with edits (path, ops as JSON, perhaps expected).

    expected is the text's hash as the writer knew it: a note that has changed since gets the result 'stale', one that isn't
    there 'missing', and keeps its text. One join by path; edits run row by row in Arrow batches.
    """

    @arrow_fn(_RESULT)
    def run(text: pa.Array, ops: pa.Array, path: pa.Array) -> pa.Array:
        done = [patch_json(t, o, strict, p or "") for t, o, p in zip(text.to_pylist(), ops.to_pylist(), path.to_pylist())]
        return pa.array([{"text": t, "results": r} for t, r in done], _RESULT)

    e = edits if "expected" in edits.columns else edits.withColumn("expected", F.lit(None).cast("string"))
    state = compare_and_set(notes, e, "path", blake2b(F.col("text")))
    j = state.join(notes.select("path", F.col("text").alias("old")), "path", "left")
    ok = F.col("state") == "ok"
    r = j.select("path", "old", "state", run(F.when(ok, F.col("old")), "ops", "path").alias("r"))
    there = ok & F.col("old").isNotNull()
    return r.select(
        "path", F.when(there, F.col("r.text")).otherwise(F.col("old")).alias("text"),
        F.when(there, F.col("r.results")).otherwise(F.array(F.when(ok, "missing").otherwise(F.col("state")))).alias("results"),
        F.coalesce(there & (F.col("r.text") != F.col("old")), F.lit(False)).alias("changed"),
    )


def section_rows(notes: DataFrame) -> DataFrame:
    """(key, value) of notes: a row per section, keyed by path, breadcrumb and number of that breadcrumb in the note."""
    s = notes.select("path", F.posexplode(sections("text")).alias("i", "s")).select("path", "i", "s.heading", "s.text")
    n = F.row_number().over(Window.partitionBy("path", "heading").orderBy("i"))
    return s.select(F.to_json(F.struct("path", "heading", n.alias("n"))).alias("key"), F.col("text").alias("value"))


def merge_notes(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, value, state): three-way merge of notes by section, see versions.three_way."""
    return three_way(section_rows(base), section_rows(ours), section_rows(theirs))


_REGIONS = pa.struct([("frontmatter", pa.string()), ("body", pa.string()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("hash", pa.string())])))])


@arrow_fn(_REGIONS)
def region_hashes(text: pa.Array) -> pa.Array:
    """Hashes of a note's parts: its frontmatter (null without one), its body, and each section by its breadcrumb."""

    def of(t: str) -> dict:
        raw, at = md.fence(t)
        return {"frontmatter": None if raw is None else md.content_hash(raw), "body": md.content_hash(t[at:]), "sections": [{"heading": s["heading"], "hash": md.content_hash(s["text"])} for s in md.sections(t)]}

    return pa.array([None if t is None else of(t) for t in text.to_pylist()], _REGIONS)


def guarded(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """writes with state: ok, stale or missing, by what the writer knew of the note.

    notes: path, mtime, text. writes: path, expected_mtime, expected_frontmatter, expected_body, heading, expected_section, each null
    where the writer asks for nothing. An mtime within a millisecond is enough. Under another mtime the hashes that were given must
    still hold, so that an edit of one part doesn't fail for a change of another; without any hash the write is stale. Of sections
    with one breadcrumb the first counts. A write that expects nothing is ok, and so creates its note.
    """
    n = notes.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), region_hashes("text").alias("_r"))
    j = writes.join(n, F.col("path") == F.col("_path"), "left")
    section = F.get(F.filter("_r.sections", lambda s: s["heading"] == F.col("heading")), F.lit(0))["hash"]
    pairs = [("expected_frontmatter", F.col("_r.frontmatter")), ("expected_body", F.col("_r.body")), ("expected_section", section)]
    holds, asked = F.lit(True), F.lit(False)
    for name, now in pairs:
        holds, asked = holds & (F.col(name).isNull() | F.coalesce(F.col(name) == now, F.lit(False))), asked | F.col(name).isNotNull()
    state = (
        F.when(~asked & F.col("expected_mtime").isNull(), "ok")
        .when(F.col("_path").isNull(), "missing")
        .when(F.abs(F.col("expected_mtime") - F.col("_mtime")) < 1e-3, "ok")
        .when(asked & holds, "ok")
        .otherwise("stale")
    )
    return j.select(*writes.columns, state.alias("state"))


def assembled(frontmatter: Column, sections: Column, body: Column) -> Column:
    """A whole note from its parts: YAML text of the frontmatter (null or blank for none), sections (array<struct<heading, level,
    text>>; level 1 to 6, a null one is 2, a blank heading none) and a body that comes before them. Parts stand apart by a blank
    line; the note ends with one line end. All parts empty give the empty text."""
    mark = lambda s: F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(s["level"], F.lit(2)))))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\A\s+|\s+\z", "")), F.lit(""))
    one = lambda s: F.array_join(F.filter(F.array(F.when(blank(s["heading"]) != "", F.concat(mark(s), F.lit(" "), blank(s["heading"]))).otherwise(""), blank(s["text"])), lambda x: x != ""), "\n\n")
    parts = F.concat(F.array(blank(body)), F.transform(F.coalesce(sections, F.array().cast("array<struct<heading:string,level:int,text:string>>")), one))
    text = F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    head = F.when(blank(frontmatter) != "", F.concat(F.lit("---\n"), blank(frontmatter), F.lit("\n---\n"))).otherwise("")
    whole = F.concat(head, F.when((head != "") & (text != ""), "\n").otherwise(""), text)
    return F.when((text != "") & ~whole.endswith("\n"), F.concat(whole, F.lit("\n"))).otherwise(whole)


def write_whole(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """(path, text, result): notes (path, mtime, text) after writes (path, text and what guarded() asks for) of whole notes.

    result is created, replaced, unchanged or, where the guard refuses, stale or missing, with the text as it was. Paths are
    made whole first (see functions.text.with_suffix); of several writes of a path the last by text counts. Notes without a write
    aren't returned.
    """
    w = writes.where("path is not null and text is not null").withColumn("path", with_suffix(F.col("path")))
    w = guarded(notes, w.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("text")))).where("_rn = 1").drop("_rn"))
    j = w.join(notes.select("path", F.col("text").alias("old")), "path", "left")
    ok = F.col("state") == "ok"
    result = F.when(~ok, F.col("state")).when(F.col("old").isNull(), "created").when(F.col("old") == F.col("text"), "unchanged").otherwise("replaced")
    return j.select("path", F.when(ok, F.col("text")).otherwise(F.col("old")).alias("text"), result.alias("result"))


def append_notes(notes: DataFrame, appends: DataFrame, create: bool = True) -> DataFrame:
    """(path, text, result): notes (path, text) with text put at their end or, under a heading, at the end of its section.

    appends: path, text, heading (null for the end of the note), one per path. result is ok, created (no such note and create),
    missing, or the code of an edit that can't be made (see parse.patch), with the text as it was.
    """
    a = appends.where("path is not null and text is not null").withColumn("path", with_suffix(F.col("path"))).select("path", F.col("text").alias("new"), "heading")
    j = a.join(notes.select("path", "text"), "path", "left")
    at_end = F.to_json(F.array(F.struct(F.lit("append_eof").alias("op"), F.col("new").alias("text"))))
    under = F.to_json(F.array(F.struct(F.lit("append").alias("op"), F.col("heading"), F.col("new").alias("text"))))

    @arrow_fn(_RESULT)
    def run(text: pa.Array, ops: pa.Array, path: pa.Array) -> pa.Array:
        done = [patch_json(t, o, True, p or "") for t, o, p in zip(text.to_pylist(), ops.to_pylist(), path.to_pylist())]
        return pa.array([{"text": t, "results": r} for t, r in done], _RESULT)

    r = j.select("path", "text", "new", run("text", F.when(F.col("heading").isNull(), at_end).otherwise(under), "path").alias("r"))
    fresh = F.concat(F.regexp_replace("new", r"\n+\z", ""), F.lit("\n"))
    there = F.col("text").isNotNull()
    return r.select(
        "path", F.when(there, F.col("r.text")).when(F.lit(create), fresh).alias("text"),
        F.when(there, F.get("r.results", F.lit(0))).when(F.lit(create), "created").otherwise("missing").alias("result"),
    )
