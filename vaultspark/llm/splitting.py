r"""Splitting oversized texts at natural boundaries (problem 3), by bounded-quantifier regular expressions.

Everything is SQL. A first expression takes a text apart into lines and whole code fences, array functions tell which of them
begin at a natural boundary, and the line ends before such places are replaced by two marks: the one place where the rule for
boundaries is applied. A second expression then takes pieces off the marked text: its alternatives are ordered by the strength of
the boundary they end at, each with a bounded quantifier that takes as much as the limit allows, and the last one takes
characters as they come. Overlap looks back. The natural boundaries themselves come out of the same extraction, with a first
alternative that ends at the very next mark. Time is proportional to the length of a text, whatever its number of boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Two noncharacters of Unicode stand for the line ends before headings and paragraphs. A text that holds one of them lends them
#: two signs that it lacks meanwhile: other noncharacters or private ones, of which there are more than six thousand.
_HEAD, _PARA = chr(0xFDD0), chr(0xFDD1)
_LENT = "".join(map(chr, [*range(0xFDD2, 0xFDF0), 0xFFFE, 0xFFFF, *range(0xE000, 0xF900)]))

_CLOSE = r"[ \t]*(?:\r?\n|\z)"
#: A code fence with its opening and closing line (an open one lasts to the end of the text), or one line. All repeated
#: parts are single character classes, which the JVM repeats without recursion, whatever the length of a text.
_TOKEN = (
    r" {0,3}(`{3,})[^`\n]*(?:\n(?:[\s\S]*?(?<=\n) {0,3}\1`*" + _CLOSE + r"|[\s\S]*\z)|\z)"
    r"| {0,3}(~{3,})[^\n]*(?:\n(?:[\s\S]*?(?<=\n) {0,3}\2~*" + _CLOSE + r"|[\s\S]*\z)|\z)"
    r"|[^\n]*\n|[^\n]+\z"
)
_BLANK = r"\A[ \t]*(?:\r?\n)?\z"
_HEADING = r"\A {0,3}#{1,6}(?:[ \t]|(?:\r?\n)?\z)"


def tokens(text: Column) -> Column:
    """The text's lines with their ends, a code fence as one token. Null for a null, the empty array for an empty text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def hits_once(hits: DataFrame, *columns: str) -> DataFrame:
    """Hits delivered twice count once; of rows that differ under one hit_id the first by text and line counts.

    A null hit_id identifies nothing: each such row is a hit. _row tells them apart, so (hit_id, _row) is unique; the table is
    read once, and rows without an id are spread by it.
    """
    slim = hits.select("hit_id", "text", "start_line", *columns, F.when(F.col("hit_id").isNull(), F.monotonically_increasing_id()).alias("_row"))
    w = Window.partitionBy("hit_id", "_row").orderBy(F.xxhash64("text"), "start_line", *columns)
    return slim.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _marked(parts: Column) -> Column:
    """The text of tokens with the line end before a natural boundary as a mark, one for headings and one for others; of the same length.

    A boundary is before a token that is not blank and is a heading or follows a blank line. Lines inside a fence are no tokens.
    """

    def one(p: Column, i: Column) -> Column:
        after = F.get(parts, i + 1)
        mark = F.when(after.rlike(_HEADING), F.lit(_HEAD)).when(p.rlike(_BLANK) & ~after.rlike(_BLANK), F.lit(_PARA))
        return F.when(after.isNotNull() & mark.isNotNull() & p.endswith("\n"), F.concat(F.substring(p, F.lit(1), F.length(p) - 1), mark)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def _cutter(limit: int, overlap: int, every: bool = False) -> str:
    """Takes off what is new in each piece: up to limit characters for the first, up to limit - overlap for later ones.

    every: the first alternative ends at the next mark, so that every natural boundary ends a piece.
    """
    end = f"\\n{_HEAD}{_PARA}"

    def ladder(n: int, fewest: int) -> list[str]:
        least = max(1, n // 2)
        some, early = f"[\\s\\S]{{{least},{n}}}", f"[\\s\\S]{{{fewest},{n}}}"
        return [
            *([f"[^{_HEAD}{_PARA}]{{0,{n - 1}}}[{_HEAD}{_PARA}]"] if every else []),
            f"[\\s\\S]{{1,{n}}}\\z",
            f"{some}(?<={_HEAD})",
            f"{some}(?<={_PARA})",
            f"{early}(?<={_HEAD})",
            f"{early}(?<={_PARA})",
            f"{some}(?<=[{end}])",
            f"{some}(?<=[.!?…。](?:[\"')\\]]|)\\s)",
            f"{some}(?<=\\s)",
            f"[\\s\\S]{{1,{n}}}",
        ]

    if not overlap:
        return "|".join(ladder(limit, 1))
    return "|".join([f"\\A(?:{'|'.join(ladder(limit, max(1, overlap)))})", *ladder(limit - overlap, 1)])


def _extracted(once: DataFrame, limit: int, cutter: str) -> DataFrame:
    """once with `cut`, the array of what the cutter takes off each text above the limit, marks for line ends, and `lent`: the
    signs that stand for the text's own marks, null for a text without. A text within the limit is one element as it is."""
    long = F.length("text") > limit
    lent = F.when(long & F.col("text").rlike(f"[{_HEAD}{_PARA}]"), F.substring(F.call_function("translate", F.lit(_LENT), F.col("text"), F.lit("")), 1, 2))
    clear = F.when(F.col("lent").isNull(), F.col("text")).otherwise(F.call_function("translate", F.col("text"), F.lit(_HEAD + _PARA), F.col("lent")))
    # The tokens are a column of their own: inside the lambdas of array functions they would be taken anew for each element.
    parts = once.withColumn("lent", lent).withColumn("parts", F.when(long, tokens(clear)))
    return parts.withColumn("cut", F.when(long, F.regexp_extract_all(_marked(F.col("parts")), F.lit(cutter), F.lit(0))).otherwise(F.array("text"))).drop("parts")


def _lines(s: Column) -> Column:
    """How many lines end in an extracted text."""
    return F.length(s) - F.length(F.translate(s, "\n" + _HEAD + _PARA, ""))


def natural_boundaries(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(hit_id, line_no): the natural boundaries of texts above the limit; line_no is start_line plus the line's number.

    They are where the extraction of pieces, told to stop at every mark, begins a piece after one, or the text. Null and shorter
    texts have none. Without a start_line line_no is null, and a hit has one such row.
    """
    big = _extracted(hits_once(hits.where(F.length("text") > limit)), limit, _cutter(limit, 0, every=True))
    # Outer, though no array is empty: for an inner one a filter on the array would be made and pushed below, tokens and all.
    each = big.select("hit_id", "_row", "start_line", F.posexplode_outer("cut").alias("piece", "s"))
    each = each.select("hit_id", "_row", "start_line", "piece", _lines(F.col("s")).alias("n"), F.right("s", F.lit(1)).isin(_HEAD, _PARA).alias("marked"))
    w = Window.partitionBy("hit_id", "_row").orderBy("piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line = each.select("hit_id", "_row", "start_line", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("line"), F.coalesce(F.lag("marked").over(w), F.lit(True)).alias("natural"))
    return line.where("natural and (start_line is not null or piece = 0)").select("hit_id", (F.col("start_line").cast("long") + F.col("line")).alias("line_no"))


def pieces(hits: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(hit_id, piece, heading, text, start_line, end_line) of every hit, in pieces of at most limit characters.

    A text within the limit is one piece. Later pieces begin with the last `overlap` characters of the piece before, so
    without those the pieces are the text. Pieces end before a heading, else before another natural boundary (never one
    inside a code fence), the last that fills half a piece, else the last within reach; the first piece has `overlap`
    characters at least, since the second begins with so many of it. Without a natural boundary within reach they end at a
    line end, after a sentence, at white space, provided that fills half a piece; else anywhere.
    start_line and end_line are the lines of the first and the last character, null without a start_line. Null texts
    have no piece, an empty text has one. Code points that stand for marks are kept as they are, and texts that hold them are
    cut like any other.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    ready = _extracted(hits_once(hits.where("text is not null"), "heading"), limit, _cutter(limit, overlap))
    own = lambda s: F.when(F.length("text") <= limit, s).when(F.col("lent").isNull(), F.translate(s, _HEAD + _PARA, "\n\n")).otherwise(F.call_function("translate", s, F.concat(F.lit(_HEAD + _PARA), F.col("lent")), F.lit("\n\n" + _HEAD + _PARA)))
    start = F.expr("named_struct('line', 0, 'tail', '', 'out', cast(array() as array<struct<line: int, tail: string, new: string>>))")

    def step(acc: Column, s: Column) -> Column:
        tail = F.right(F.concat(acc["tail"], s), F.lit(overlap)) if overlap else F.lit("")
        return F.struct((acc["line"] + _newlines(s)).alias("line"), tail.alias("tail"), F.array_append(acc["out"], F.struct(acc["line"].alias("line"), acc["tail"].alias("tail"), s.alias("new"))).alias("out"))

    placed = ready.select("hit_id", "heading", "start_line", F.transform("cut", own).alias("new"))
    placed = placed.select("hit_id", "heading", "start_line", F.posexplode_outer(F.aggregate("new", start, step)["out"]).alias("piece", "p"))
    body = F.concat("p.tail", "p.new")
    first = F.col("p.line") - _newlines(F.col("p.tail"))
    ends_line = F.when(body.endswith("\n"), 1).otherwise(0)
    return placed.select("hit_id", "piece", "heading", body.alias("text"), (F.col("start_line") + first).cast("long").alias("start_line"), (F.col("start_line") + first + _newlines(body) - ends_line).cast("long").alias("end_line"))
