"""Text as Columns: tokens, headings, links, cleaning, cutting. All built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " › "
#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįłńňōőœřśşšťūůűźżž"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiilnnooorssstuuuzzz"


def tokens(text: Column, fold: bool = True) -> Column:
    """array<string>: runs of letters and digits in lower case, accents folded; null gives the empty array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.translate(low, ACCENTED, FOLDED) if fold else low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str, most: int = 24) -> tuple[list[str], bool]:
    """(terms, whether all are required): words of two signs or more, at most 24; up to two must all occur."""
    words = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1][:most]
    folded = [p for w in words for p in re.findall(r"[^\W_]+", w.translate(str.maketrans(ACCENTED, FOLDED)))]
    return list(dict.fromkeys(folded)), len(words) <= 2


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def header_key(name: Column) -> Column:
    """A table header as a key: lower case, runs of other signs than a-z and 0-9 as one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def heading_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"^#{1,6}\s+", "")))


def short_title(heading: Column, separator: str = SEPARATOR) -> Column:
    """The last part of a breadcrumb."""
    return F.element_at(F.split(heading, re.escape(separator)), -1)


def body(text: Column) -> Column:
    """A note without its frontmatter fence."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def body_line(text: Column) -> Column:
    """Number from 1 of the body's first line."""
    cut = F.substring(text, F.lit(1), F.length(text) - F.length(body(text)))
    return F.length(cut) - F.length(F.replace(cut, F.lit("\n"))) + 1


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def note_format(path: Column) -> Column:
    """markdown, yaml, mermaid, or null for a file that is no note."""
    s = suffix(path)
    return F.when(s.isin(".md", ".markdown"), "markdown").when(s.isin(".yaml", ".yml"), "yaml").when(s == ".mmd", "mermaid")


def with_suffix(path: Column) -> Column:
    """Separators as /, no leading ./ or /, and .md where no note suffix is given."""
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")
    return F.when(note_format(p).isNotNull(), p).otherwise(F.concat(p, F.lit(".md")))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def title(frontmatter_title: Column, path: Column) -> Column:
    """The given title, else the file's name with blanks for - and _."""
    return F.coalesce(F.nullif(F.trim(frontmatter_title), F.lit("")), F.trim(F.regexp_replace(stem(path), "[-_]", " ")))


def first_heading(text: Column) -> Column:
    """Title of the first level-1 heading, null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)), F.lit(""))


def undecorated(text: Column) -> Column:
    """Prose without Markdown signs: links to their text, bold, italic, heading marks, list marks, quote marks."""
    for pattern, to in (
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*([^*\n]+?)\*(?!\*)", "$1"),
        (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^([ \t]*)[-*+][ \t]+", "$1"), (r"(?m)^>[ \t]?", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def index_text(text: Column, kind: Column) -> Column:
    """What is indexed of a chunk: sections undecorated, without table rules and blank runs; other kinds as they are."""
    clean = F.regexp_replace(text, r"(?m)^[ \t]*\|?[ \t:|-]*-[ \t:|-]*\|?[ \t]*$", "")
    clean = F.trim(F.regexp_replace(undecorated(clean), r"\n{3,}", "\n\n"))
    clean = F.regexp_replace(clean, r"\A\s+|\s+\z", "")
    section = kind.isNull() | kind.isin("", "section")
    return F.when(section, F.coalesce(F.nullif(clean, F.lit("")), text)).otherwise(text)


def cut_at_word(text: Column, limit: int) -> Column:
    """At most limit characters, cut before the last white space; a limit of 0 or less cuts nothing."""
    if limit <= 0:
        return text
    head = F.substring(text, 1, limit)
    at_space = F.regexp_extract(head, r"(?s)\A(.*)\s", 1)
    cut = F.when(head.rlike(r"\s"), at_space).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(cut, r"\s+\z", ""))


def snippet(text: Column, terms: list[str], words: int = 24) -> Column:
    """The stretch of so many words that holds most words with a query term, the first of equals."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    ws = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", ""), r"\s+")
    spots = lambda w: F.filter(F.transform(w, lambda x, i: F.when(F.arrays_overlap(tokens(x), wanted), i)), lambda i: i.isNotNull())

    def best(w: Column) -> Column:
        last = F.greatest(F.size(w) - words, F.lit(0))
        starts = F.sequence(F.lit(0), last)
        return let(spots(w), lambda s: F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.filter(s, lambda p: (p >= i) & (p < i + words))).alias("n"), (-i).alias("less")))))

    return let(ws, lambda w: F.array_join(F.slice(w, 1 - best(w)["less"], words), " "))


def wikilinks(text: Column) -> Column:
    """array<struct<line, key, stem, text>>: each [[link]] with its line from 1, target without .md in lower case, and line."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")

    def of(line: Column, i: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(r"\[\[([^\]#|]+)(?:[#|][^\]]*)?\]\]"), F.lit(1))
        keys = F.filter(F.transform(found, lambda t: F.lower(F.regexp_replace(F.trim(t), r"\.md$", ""))), lambda k: k != "")
        return F.transform(keys, lambda k: F.struct((i + 1).alias("line"), k.alias("key"), F.element_at(F.split(k, "/"), -1).alias("stem"), F.substring(F.trim(line), 1, 200).alias("text")))

    return F.flatten(F.filter(F.transform(lines, of), lambda x: F.size(x) > 0))


def escaped_cell(value: Column) -> Column:
    out = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.trim(out)


def flat_row(crumbs: Column, headers: Column, cells: Column) -> Column:
    """One line for a table row: 'A > B — Header: cell, Header: cell'. Pairs with neither header nor cell are left out."""
    pairs = F.filter(F.zip_with(F.transform(headers, lambda h: F.trim(h)), F.transform(cells, lambda c: F.trim(c)), lambda h, c: F.struct(F.coalesce(h, F.lit("")).alias("h"), F.coalesce(c, F.lit("")).alias("c"))), lambda p: (p["h"] != "") | (p["c"] != ""))
    line = F.array_join(F.transform(pairs, lambda p: F.when(p["h"] != "", F.concat(p["h"], F.lit(": "), p["c"])).otherwise(p["c"])), ", ")
    head = F.array_join(F.filter(crumbs, lambda c: c != ""), " > ")
    return F.when((head != "") & (line != ""), F.concat(head, F.lit(" — "), line)).otherwise(F.concat(head, line))


def lines_between(text: Column, first: int, last: int) -> Column:
    """Lines first to last, numbered from 1, both ends inside."""
    return F.array_join(F.slice(F.split(text, "\n"), max(first, 1), max(last - max(first, 1) + 1, 0)), "\n")


def preview(text: Column, gate_bytes: int = 8192, chars: int = 2048) -> Column:
    """Long texts by their beginning only."""
    return F.when(F.octet_length(text) > gate_bytes, F.substring(text, 1, chars)).otherwise(text)


def chunk_id(source: Column, start: Column, end: Column, content_hash: Column, model: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of what makes a chunk, with the format's scheme before the source."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit("markdown"), source, start.cast("string"), end.cast("string"), content_hash, model), 256), 1, 16)


def folder_key(path: Column) -> Column:
    """The first two folders of a path; . for a file at the top."""
    dirs = F.split(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/")
    return F.coalesce(F.nullif(F.array_join(F.slice(dirs, 1, 2), "/"), F.lit("")), F.lit("."))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors in double precision; 1e9 where their lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(1e9))


def trailing_blank_lines(text: Column) -> Column:
    """Lines that end with blanks or tabs."""
    return F.regexp_count(text, F.lit(r"(?m)[ \t]+$"))


def without_trailing_blanks(text: Column) -> Column:
    """Lines without blanks at their ends, and one line end at the end of the text."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n*\z", ""), F.lit("\n"))
