"""Links, recency and navigation: joins and windows over notes and their chunks."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.text import SEPARATOR, cut_at_word, stem, wikilinks
from vaultspark.operators.predicates import excluded, in_folder


def links(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(source, line, key, stem, text): every wikilink of every note."""
    return notes.where(F.col(text).contains("[[")).select(F.col(path).alias("source"), F.inline(wikilinks(F.col(text))))


def note_keys(path: Column) -> Column:
    """What a link may call a note: its path without suffix, in lower case."""
    return F.lower(F.regexp_replace(path, r"\.(?:md|markdown|yaml|yml|mmd)$", ""))


def backlinks(link_rows: DataFrame, keys: list[str], exclude_source: str | None = None, limit: int | None = None) -> DataFrame:
    """(source, line, text): links whose key or last part is one of keys, without those of the note itself."""
    low = [k.lower() for k in keys]
    hit = link_rows.where(F.col("key").isin(low) | F.col("stem").isin(low))
    if exclude_source is not None:
        hit = hit.where(F.col("source") != exclude_source)
    out = hit.select("source", "line", "text").distinct().orderBy("source", "line", "text")
    return out if limit is None else out.limit(limit)


def backlink_counts(link_rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, n_links, n_sources) of each note that others link to, by key or by last part; links of a note to itself don't count.

    Links are counted per last part before any join, so a name that many notes and many links share makes no pairs of them. A
    link that fits a note's whole key has its last part too; only names with dots that are no note suffixes need the key as well.
    """
    targets = notes.where("path is not null").select("path", note_keys(F.col("path")).alias("k"), F.lower(stem(F.col("path"))).alias("s")).distinct()
    targets = targets.withColumn("odd", F.element_at(F.split("k", "/"), -1) != F.col("s"))
    l = link_rows.where("source is not null").select("source", "line", "key", "stem", "text").distinct()
    per = l.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))
    own = l.join(targets.where("not odd"), (l["source"] == targets["path"]) & (l["stem"] == targets["s"])).groupBy("path").agg(F.count("*").alias("own"))
    plain = targets.where("not odd").join(per, F.col("s") == F.col("stem")).join(own, "path", "left").na.fill(0, ["own"])
    plain = plain.select("path", (F.col("n") - F.col("own")).alias("n_links"), (F.col("n_sources") - F.when(F.col("own") > 0, 1).otherwise(0)).cast("long").alias("n_sources")).where("n_links > 0")
    names = targets.where("odd").select("path", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("k").alias("name")), F.struct(F.lit(False).alias("whole"), F.col("s").alias("name")))).alias("x")).select("path", "x.*")
    found = l.select("*", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("key").alias("name")), F.struct(F.lit(False).alias("whole"), F.col("stem").alias("name")))).alias("x")).select("source", "line", "key", "text", "x.*")
    hit = found.join(names, ["whole", "name"]).where("source <> path").select("path", "source", "line", "key", "text").distinct()
    return plain.unionByName(hit.groupBy("path").agg(F.count("*").alias("n_links"), F.countDistinct("source").alias("n_sources")))


def resolved_links(link_rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, line, key, target): the note a link leads to, null without one.

    Tried in this order: the key as a path, as a folder's note of the same name, and as a path from the source's folder. The
    few candidates of each link are joined to the notes at once, and the first that exists is kept.
    """
    own = notes.where("path is not null").groupBy(note_keys(F.col("path")).alias("name")).agg(F.min("path").alias("target"))
    home = F.regexp_extract("source", "^(.*/)?[^/]*$", 1)
    key = F.regexp_replace("key", "^/+", "")
    tried = F.array(key, F.concat(key, F.lit("/"), F.col("stem")), F.lower(F.concat(home, key)))
    each = link_rows.select("source", "line", "key", "stem").distinct().select("source", "line", "key", F.posexplode(tried).alias("order", "name"))
    hit = each.join(own, "name", "left")
    return hit.groupBy("source", "line", "key").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("order"))).alias("target"))


def link_states(link_rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(key, n_links, n_targets, state): broken without a target, ambiguous with several, else ok. One row per link target.

    A key with a folder names a path; one without also any note of that name.
    """
    n = notes.where("path is not null").select("path", note_keys(F.col("path")).alias("k"), F.lower(stem(F.col("path"))).alias("s")).distinct()
    names = n.select("path", F.explode(F.array_distinct(F.array("k", "s"))).alias("key"))
    targets = names.groupBy("key").agg(F.countDistinct("path").alias("n_targets"))
    used = link_rows.groupBy("key").agg(F.count("*").alias("n_links"))
    found = F.coalesce("n_targets", F.lit(0))
    return used.join(targets, "key", "left").select("key", "n_links", found.alias("n_targets"), F.when(found == 0, "broken").when(found > 1, "ambiguous").otherwise("ok").alias("state"))


def day_bounds(since: str | None, until: str | None, zone: str = "America/New_York") -> tuple[float | None, float | None]:
    """Epoch seconds from ISO texts; a date alone means its first and, for until, its last moment in the zone; naive times are of the zone."""

    def parse(raw: str | None, end: bool) -> float | None:
        if raw is None or not raw.strip():
            return None
        t = datetime.fromisoformat(raw.strip())
        t = t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))
        return (t + timedelta(days=1) - timedelta(microseconds=1) if end and len(raw.strip()) == 10 else t).timestamp()

    return parse(since, False), parse(until, True)


def heading_matches(heading: Column, wanted: str, separator: str = SEPARATOR) -> Column:
    """A breadcrumb equals a heading, begins with it, or has it as its last or any other part; letter case doesn't matter."""
    h, w = F.lower(heading), wanted.strip().lower()
    return F.coalesce((h == w) | h.startswith(w + separator) | h.endswith(separator + w) | h.contains(separator + w + separator), F.lit(False))


def edge_chunks(chunks: DataFrame, which: str = "first", heading: str | None = None) -> DataFrame:
    """The first or last chunk of each note by ord, perhaps only of those under a heading: one aggregate, no sort.

    Ties go by chunk_id and chunk_hash, those that the chunks have, in the order of navigation. Chunks without an ord count only where a note has no others.
    """
    c = chunks if heading is None else chunks.where(heading_matches(F.col("heading"), heading))
    first = which == "first"
    pick = F.min_by if first else F.max_by
    place = F.struct((F.col("ord").isNull() if first else F.col("ord").isNotNull()).alias("last"), "ord", *[x for x in ("chunk_id", "chunk_hash") if x in chunks.columns])
    rest = [x for x in chunks.columns if x != "path"]
    return c.groupBy("path").agg(pick(F.struct(*rest), place).alias("c")).select("path", *[f"c.{x}" for x in rest])


def recent(notes: DataFrame, limit: int, folder: str | None = None, since: float | None = None, until: float | None = None, exclude: list[str] | None = None, offset: int = 0) -> DataFrame:
    """(path, mtime, ...) newest first, ties by path. All filters come before the limit, so pages are full."""
    t = in_folder(F.col("path"), folder) & ~excluded(F.col("path"), exclude)
    if since is not None:
        t = t & (F.col("mtime") >= since)
    if until is not None:
        t = t & (F.col("mtime") <= until)
    out = notes.where(t).orderBy(F.desc("mtime"), "path")
    return (out.offset(offset) if offset else out).limit(limit)


def recent_preview(notes: DataFrame, chunks: DataFrame, limit: int, which: str = "first", heading: str | None = None, chars: int = 200, **filters) -> DataFrame:
    """recent() with the beginning of each note's first or last chunk, null where it has none. Only the page's notes are joined."""
    page = recent(notes, limit, **filters).select("path", "mtime")
    shown = edge_chunks(chunks.join(page.select("path"), "path", "left_semi"), which, heading)
    return page.join(shown.select("path", "heading", cut_at_word(F.col("text"), chars).alias("preview")), "path", "left")


def navigation(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Each chunk with its place, the number of chunks of its note and its neighbours' ids."""
    w = Window.partitionBy("path").orderBy("ord", id)
    return chunks.select("path", id, "ord", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("path")).alias("total"), F.lag(id).over(w).alias("prev"), F.lead(id).over(w).alias("next"))


def siblings(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Each chunk with its neighbours of the same kind and heading level in its note."""
    w = Window.partitionBy("path", "chunk_kind", "heading_level").orderBy("ord", id)
    return chunks.select("path", id, "chunk_kind", "heading_level", F.lag(id).over(w).alias("prev"), F.lead(id).over(w).alias("next"))


def anchors(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (path, chunk_hash, heading, ...) with the heading of the chunk they name, and state: hash, or, where the note has
    no such chunk any more, heading if the request brings one to fall back on, else stale."""
    known = chunks.groupBy("path", "chunk_hash").agg(F.min(F.coalesce("heading", F.lit(""))).alias("_found"))
    j = requests.join(known, ["path", "chunk_hash"], "left")
    state = F.when(F.col("_found").isNotNull(), "hash").when(F.col("heading").isNotNull(), "heading").otherwise("stale")
    return j.withColumn("state", state).withColumn("heading", F.coalesce("_found", "heading")).drop("_found")


def table_of_contents(chunks: DataFrame, path: str) -> DataFrame:
    """(ord, heading, heading_level, start_line, end_line) of a note's sections in order."""
    return chunks.where((F.col("path") == path) & (F.col("chunk_kind") == "section")).select("ord", "heading", "heading_level", "start_line", "end_line").orderBy("ord")


def containing(inner: DataFrame, outer: DataFrame, id: str) -> DataFrame:
    """(id, owner): for each inner line of a note the last outer span around it, by ord.

    An equi-join on the note, then the interval: the pairs are those of one note. Lines in no span have a null owner.
    """
    i = inner.select("path", id, "line")
    o = outer.select("path", F.col("ord").alias("owner"), "start_line", "end_line")
    hit = i.join(o, "path").where("start_line <= line and line <= end_line").groupBy(id).agg(F.max("owner").alias("owner"))
    return i.select(id).join(hit, id, "left")


def folder_summary(paths: DataFrame, key: Column, top: int = 3) -> DataFrame:
    """(folder, n) of the fullest folders, ties by name."""
    return paths.groupBy(key.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(top)


def summary_line(paths: DataFrame, key: Column, top: int = 3) -> DataFrame:
    """(summary,): the fullest folders with their numbers, and how many folders more there are, in one row; '' for no paths.

    Only the counts of folders are put in order, never paths.
    """
    n = paths.groupBy(key.alias("folder")).agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), "folder").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "folder", "n"))).alias("best"))
    more = n.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("more"))
    j = best.crossJoin(more)  # one row each
    bits = F.array_join(F.transform("best", lambda b: F.concat(b["folder"], F.lit(" ("), b["n"].cast("string"), F.lit(")"))), ", ")
    return j.select(F.concat(bits, F.when(F.col("more") > 0, F.concat(F.lit(", +"), F.col("more").cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))


def folder_listing(notes: DataFrame) -> DataFrame:
    """(folder, n, listing): each folder's notes (path, title) as a Markdown list in order of name: what its index file says.

    A note without a title goes by its name. Lists are as long as a folder is full, as the file itself.
    """
    name = F.element_at(F.split("path", "/"), -1)
    entry = F.struct(name.alias("name"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), name).alias("title"))
    folder = F.regexp_replace(F.regexp_extract("path", r"(?s)\A(.*/)?[^/]*\z", 1), r"/\z", "")
    g = notes.where("path is not null").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("folder", "n", F.array_join(F.transform("e", lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["name"], F.lit(")"))), "\n").alias("listing"))
