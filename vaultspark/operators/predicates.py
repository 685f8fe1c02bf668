"""Structured queries over frontmatter: a predicate dict becomes one Column over VARIANT, a sort spec becomes sort Columns.

Values compare loosely, as notes are written by hand: see loose_equal and compare. Everything is built-in expressions, so a
filter is evaluated in the JVM; nothing is collected. A clause never yields null: what can't be decided doesn't match.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.operators.nested import latest_rows

_SAFE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def readable_object(once: Column) -> Column:
    """Of a parsed text the object that it is, or that it holds as a string; null for anything else."""
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    value = F.when(F.schema_of_variant(once) == "STRING", inner).otherwise(once)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def catalog(files: DataFrame, *keep: str) -> DataFrame:
    """(path, mtime, fm, keep...): the latest row of each path whose frontmatter is readable, with fm as VARIANT."""
    one = latest_rows(files.where("path is not null").select("path", "mtime", "frontmatter", *keep), "path")
    # By a generator: filters on fm would be pushed below a projection, and read the JSON anew for each use of fm.
    parsed = one.select("path", "mtime", F.explode(F.array(F.try_parse_json("frontmatter"))).alias("v"), *keep)
    return parsed.select("path", "mtime", F.explode(F.array_compact(F.array(readable_object(F.col("v"))))).alias("fm"), *keep)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def member(v: Column, key: str) -> Column:
    """The member of an object; null where it is missing or v is no object."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def present(v: Column) -> Column:
    """Neither missing nor a JSON null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def elements(v: Column) -> Column:
    """array<variant> of a list, null for anything else."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def text_of(v: Column) -> Column:
    """How a value reads as text: 5.0 stays apart from 5, truth values are true and false, a null is none."""
    t = F.try_variant_get(v, "$", "string")
    k = _kind(v)
    return F.when(k == "VOID", "none").when(k.rlike(r"^DECIMAL\(\d+,0\)$"), F.concat(t, F.lit(".0"))).otherwise(t)


def loose_equal(v: Column, literal: object) -> Column:
    """Values of one type are equal as they are; otherwise their trimmed lower-case texts are compared.

    So "true" equals True, "5" equals 5, but "5.0" does not equal 5, nor does 5.0; truth values equal 1 and 0.
    """
    k = _kind(v)
    as_text = F.lower(F.trim(text_of(v))) == str(literal).strip().lower()
    whole = F.try_variant_get(v, "$", "bigint")
    if isinstance(literal, bool):
        out = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean") == literal).when(k == "BIGINT", whole == int(literal)).otherwise(as_text)
    elif isinstance(literal, int):
        out = F.when(k == "BIGINT", whole == literal).when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int") == literal).otherwise(as_text)
    elif isinstance(literal, float):
        out = F.when(k.startswith("DECIMAL") | (k == "DOUBLE"), F.try_variant_get(v, "$", "double") == literal).otherwise(as_text)
    elif isinstance(literal, str):
        out = F.when(k == "STRING", F.try_variant_get(v, "$", "string") == literal).otherwise(as_text)
    elif isinstance(literal, (list, dict)):
        out = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(literal))))
    else:
        out = as_text
    return F.coalesce(out, F.lit(False))


def compare(v: Column, literal: object) -> tuple[Column, Column]:
    """(less, greater): as numbers if both sides are numbers or read as such, as texts otherwise."""
    number = F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.trim(F.try_variant_get(v, "$", "string")).try_cast("double"))
    try:
        n = float(literal)
    except (TypeError, ValueError):
        n = None
    t, s = text_of(v), F.lit(str(literal))
    if n is None:
        return F.coalesce(t < s, F.lit(False)), F.coalesce(t > s, F.lit(False))
    return F.coalesce(F.when(number.isNotNull(), number < n).otherwise(t < s), F.lit(False)), F.coalesce(F.when(number.isNotNull(), number > n).otherwise(t > s), F.lit(False))


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _one_operator(v: Column, op: str, rhs: object) -> Column:
    items = elements(v)
    if op == "$exists":
        return present(v) if rhs else ~present(v)
    if op == "$eq":
        test = matches(v, rhs)
    elif op == "$ne":
        test = ~matches(v, rhs)
    elif op == "$contains":
        held = F.lower(F.try_variant_get(v, "$", "string")).contains(str(rhs).lower())
        test = F.when(items.isNotNull(), _any(items, lambda x: loose_equal(x, rhs))).when(_kind(v) == "STRING", held).otherwise(False)
    elif op == "$in":
        if not isinstance(rhs, (list, tuple)) or not rhs:
            return F.lit(False)
        among = lambda x: _or(loose_equal(x, y) for y in rhs)
        test = F.when(items.isNotNull(), _any(items, among)).otherwise(among(v))
    elif op == "$elemMatch":
        if not isinstance(rhs, dict) or not rhs:
            return F.lit(False)
        test = _any(items, lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False)) & _and(matches(member(x, k), c) for k, c in rhs.items()))
    elif op in ("$lt", "$lte", "$gt", "$gte"):
        less, greater = compare(v, rhs)
        test = {"$lt": less, "$lte": ~greater, "$gt": greater, "$gte": ~less}[op]
    else:
        return F.lit(False)
    return present(v) & test


def _and(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _or(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def matches(v: Column, condition: object) -> Column:
    """Whether a value meets a condition: a literal (a list holds it, anything else equals it) or a dict of operators (all hold)."""
    if isinstance(condition, dict):
        return _and(_one_operator(v, op, rhs) for op, rhs in condition.items())
    items = elements(v)
    return F.when(items.isNotNull(), _any(items, lambda x: loose_equal(x, condition))).otherwise(present(v) & loose_equal(v, condition))


def parse_path(field: str) -> list[tuple]:
    """A field path as steps: ('key', name), ('index', n), ('where', key, value). Raises ValueError for what is none.

    Names are identifiers, separated by dots; a number takes a list element, name[key=value] the elements whose key has a value.
    """
    steps, rest = [], str(field).strip()
    step = re.compile(r"(?:([A-Za-z_]\w*)(?:\[([A-Za-z_]\w*)=([^\]]+)\])?|(\d+))(\.(?=.)|$)", re.ASCII)
    while True:
        m = step.match(rest)
        if not m:
            raise ValueError(f"not a field path: {field!r}")
        if m[4]:
            steps.append(("index", int(m[4])))
        else:
            steps.append(("key", m[1]))
            if m[2]:
                steps.append(("where", m[2], m[3]))
        rest = rest[m.end() :]
        if not m[5]:
            return steps


def _step(kind: str, *args):
    """From one value to array<variant>, the values one step further."""
    none = F.array().cast("array<variant>")
    is_object = lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))
    if kind == "key":
        of = lambda e: member(e, args[0])
        return lambda x: F.when(_kind(x).startswith("ARRAY"), F.transform(F.filter(elements(x), is_object), of)).otherwise(F.array(of(x)))
    if kind == "index":
        return lambda x: F.when(_kind(x).startswith("ARRAY"), F.array(F.get(elements(x), F.lit(args[0])))).otherwise(none)
    key, wanted = args
    test = lambda e: is_object(e) & (loose_equal(member(e, key), wanted) | (F.lit(wanted.strip().lower() == "none") & ~present(member(e, key))))
    return lambda x: F.when(_kind(x).startswith("ARRAY"), F.filter(elements(x), test)).otherwise(none)


def values_at(v: Column, field: str) -> Column:
    """array<variant>: all values at a path; lists on the way are opened. Explicit nulls are values, missing ones are not."""
    found = F.array(v)
    for step in parse_path(field):
        found = F.filter(F.flatten(F.transform(found, _step(*step))), lambda x: x.isNotNull())
    return found


def where_clause(fm: Column, key: str, condition: object) -> Column:
    """One clause. A plain key is one value (null counts as missing); a path matches if any of its values does, and a lone
    $exists on a path asks for any value, an explicit null included. A path that can't be read has no values."""
    if "." not in key and "[" not in key:
        return matches(member(fm, key), condition)
    try:
        values = values_at(fm, key)
    except ValueError:
        return F.lit(isinstance(condition, dict) and set(condition) == {"$exists"} and not condition["$exists"])
    if isinstance(condition, dict) and set(condition) == {"$exists"}:
        there = F.coalesce(F.size(values) > 0, F.lit(False))
        return there if condition["$exists"] else ~there
    return _any(values, lambda x: matches(x, condition))


def where(fm: Column, clauses: dict | None) -> Column:
    """All clauses hold."""
    return _and(where_clause(fm, k, c) for k, c in (clauses or {}).items())


def in_folder(path: Column, folder: str | None, ignore_case: bool = False) -> Column:
    """The path lies below a folder; pushed to the scan as a prefix. Slashes around the folder don't matter."""
    f = (folder or "").strip().strip("/")
    if not f:
        return F.lit(True)
    return F.lower(path).startswith(f.lower() + "/") if ignore_case else path.startswith(f + "/")


def glob_regex(pattern: str, stars_cross: bool = True) -> str:
    """A glob as a regular expression over whole paths: *, ?, [...]; ** crosses folders in any case, * only if stars_cross."""
    out, i = [], 0
    one = "." if stars_cross else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and not stars_cross:
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i) and not stars_cross:
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\^" + body[1:] if body[0] == "^" else body) + "]")
            i = end
        else:
            out.append(re.sub(r"([\\.+^$(){}|\[\]])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def excluded(path: Column, globs: list[str] | None) -> Column:
    """Any of the globs matches; folder/* without other signs becomes a prefix, which the scan can use."""
    tests = []
    for g in (x.replace("\\", "/").strip() for x in globs or []):
        if g.endswith("/*") and not re.search(r"[*?\[]", g[:-2]):
            tests.append(path.startswith(g[:-1]))
        elif g:
            tests.append(path.rlike(glob_regex(g)))
    return _or(tests)


def effective_exclude(caller: list[str] | None, contract: dict | None, folder: str | None, query: str, default: list[str] | None = None) -> list[str]:
    """Which globs hold for a search: the caller's, else the first rule of the folder that applies, else the vault's, else the default.

    A rule {folder, exclude, unless_query} applies to its folder and below, unless the query holds one of its words.
    """
    if caller is not None:
        return list(caller)
    contract, here = contract or {}, (folder or "").strip("/")
    for rule in contract.get("folder_exclude") or []:
        home = str(rule.get("folder", "")).strip("/")
        if here and (here == home or here.startswith(home + "/")) and not any(w.lower() in query.lower() for w in rule.get("unless_query") or []):
            return list(rule.get("exclude") or [])
    return list(contract.get("default_exclude") or default or [])


def sort_columns(sort: str = "mtime", order: str = "desc") -> list[Column]:
    """Order of a catalog: by mtime or by a frontmatter key; nulls last either way, numbers before texts, then newest, then path."""
    order = (order or "desc").strip().lower()
    key = (sort or "mtime").strip()
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    if key == "mtime":
        first = [F.col("mtime").asc_nulls_last() if order == "asc" else F.col("mtime").desc_nulls_last()]
        return [*first, F.col("path").asc()]
    if not _SAFE_KEY.fullmatch(key):
        raise ValueError("sort must be mtime or a plain frontmatter key")
    v = member(F.col("fm"), key)
    number = F.when(present(v), F.try_variant_get(v, "$", "double"))
    text = F.when(present(v), text_of(v))
    gone, word = (~present(v)).asc(), (present(v) & number.isNull())
    if order == "asc":
        return [gone, word.asc(), number.asc_nulls_last(), text.asc_nulls_last(), F.col("mtime").desc(), F.col("path").asc()]
    return [gone, word.desc(), number.desc_nulls_last(), text.desc_nulls_last(), F.col("mtime").desc(), F.col("path").asc()]


def filter_notes(notes: DataFrame, clauses: dict | None = None, folder: str | None = None, sort: str = "mtime", order: str = "desc", limit: int | None = None, offset: int = 0, fields: list[str] | None = None) -> DataFrame:
    """The structured query: notes (path, mtime, fm) that meet all clauses, sorted, one page, with frontmatter as JSON."""
    hit = notes.where(in_folder(F.col("path"), folder) & where(F.col("fm"), clauses)).orderBy(*sort_columns(sort, order))
    hit = hit.offset(offset) if offset else hit
    hit = hit.limit(limit) if limit is not None else hit
    return hit.select("path", "mtime", project(F.col("fm"), fields).alias("frontmatter"))


def filter_total(notes: DataFrame, clauses: dict | None = None, folder: str | None = None) -> DataFrame:
    """(total): how many notes meet the clauses, over all pages."""
    return notes.where(in_folder(F.col("path"), folder) & where(F.col("fm"), clauses)).agg(F.count("*").alias("total"))


def project(fm: Column, fields: list[str] | None) -> Column:
    """Frontmatter as JSON; with a list of fields only those that are there. None or an empty list means all."""
    if not fields:
        return F.to_json(fm)
    parts = [F.when(member(fm, f).isNotNull(), F.concat(F.lit(json.dumps(f) + ":"), F.to_json(member(fm, f)))) for f in dict.fromkeys(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
