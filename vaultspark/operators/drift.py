"""Schemas that drift between files (problem 1): path-value maps, type statistics, change report, one typed table."""

from __future__ import annotations

import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import jsonval
from vaultspark.functions.arrow import arrow_fn
from vaultspark.operators.prefilter import probably_in, split_by
from vaultspark.operators.snapshots import nfc
from vaultspark.operators.trees import nearest_delivered
from vaultspark.session import cut, cut_to_table

WORKING = "working"
#: Of equally frequent types the first in this order counts.
KIND_ORDER = [jsonval.ARRAY, jsonval.BOOLEAN, jsonval.NUMBER, jsonval.OBJECT, jsonval.STRING]
#: Kinds of notes as a whole: a frontmatter that can't be read, one that is null. They count as failed casts.
UNREADABLE, MISSING = "unreadable", "missing"
BELONGS_PERCENT, SAME_PERCENT = 20, 80

_ENTRY = pa.struct([("name", pa.string()), ("kind", pa.int8()), ("digest", pa.int64())])
_RAW = pa.struct([("name", pa.string()), ("kind", pa.int8()), ("raw", pa.string()), ("text", pa.string())])
_NUMBER_OF = {k: i for i, k in enumerate(KIND_ORDER)}


def members(value: dict, deep: bool = False):
    """(path, value) of the non-null members of a record: by name or, if deep, of every object in it as JSON Pointers.

    A member that is an object comes itself, and its own members after it if deep. Lists are values. The walk keeps its own
    stack, so depth is no matter.
    """
    if not deep:
        yield from ((k, v) for k, v in value.items() if v is not None)
        return
    todo = [iter([("", value)])]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            continue
        at, v = step
        if at and v is not None:
            yield at, v
        if type(v) is dict:
            todo.append(iter([(at + jsonval.pointer_step(k), c) for k, c in v.items()]))


def path_values(deep: bool = False, raw: bool = False):
    """A function of frontmatter Columns: struct<okf_type, fields: array<struct<name, kind, ...>>>, the path-value map of a note.

    name is a member's name or, if deep, its JSON Pointer (see members); kind is the number in KIND_ORDER of its value. digest
    is a 64-bit hash of the value; if raw, its canonical JSON and, of a string, its content as text come instead. okf_type is
    null unless it is a string, fields is null for an unreadable frontmatter. Everything about fields comes through these maps.
    """
    entry = _RAW if raw else _ENTRY
    columns = [pa.string(), pa.int8(), pa.string(), pa.string()] if raw else [pa.string(), pa.int8(), pa.int64()]

    @arrow_fn(pa.struct([("okf_type", pa.string()), ("fields", pa.list_(entry))]))
    def read(texts: pa.Array) -> pa.Array:
        types, unread, offsets, out = [], [], [0], [[] for _ in columns]
        names, kinds, values = out[0].append, out[1].append, out[2].append
        for text in texts.to_pylist():
            value = jsonval.readable(text)
            unread.append(value is None)
            okf = value.get("okf_type") if value else None
            types.append(jsonval.clean(okf) if type(okf) is str else None)
            for k, v in members(value, deep) if value else ():
                names(jsonval.clean(k))
                kinds(_NUMBER_OF[jsonval.kind(v)])
                if raw:
                    values(jsonval.canonical(v))
                    out[3].append(jsonval.clean(v) if type(v) is str else None)
                else:
                    values(jsonval.value_digest(v))
            offsets.append(len(out[0]))
        entries = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, columns)], fields=list(entry))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries, mask=pa.array(unread, pa.bool_()))
        return pa.StructArray.from_arrays([pa.array(types, pa.string()), lists.cast(pa.list_(entry))], names=["okf_type", "fields"])

    return read


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KIND_ORDER)), number.cast("int") + 1)


def latest_notes(ref_files: DataFrame, files: DataFrame) -> DataFrame:
    """(oid, base, path, frontmatter): the latest row of every note of delivered trees (base null) and of working copies.

    Working copies have oid 'working' and their base_oid as base. Of several rows of an (oid, path), with the path in NFC, the
    one with the greatest mtime counts (ties: the greatest frontmatter; null last), whether or not it is readable.
    Few notes have several rows, so texts don't travel for the others: one pass over the keys alone finds which have, and a
    filter of checked size (see prefilter) sends only those, and few more, through the window.
    """
    side = lambda df, oid, base: df.where("path is not null").select(oid.alias("oid"), base.alias("base"), "path", "mtime", "frontmatter")
    both = side(ref_files.where("tree_oid is not null"), F.col("tree_oid"), F.lit(None).cast("string")).unionByName(side(files, F.lit(WORKING), F.col("base_oid")))
    keys = both.select(F.xxhash64("oid", nfc(F.col("path"))).alias("k"), F.xxhash64("oid", "path").alias("as_written"))
    # Each spelling of the path of a note with several rows: the texts are filtered before their paths are put in NFC.
    several = keys.groupBy("k").agg(F.count("*").alias("n"), F.collect_set("as_written").alias("as_written")).where("n > 1").select(F.explode("as_written").alias("as_written"))
    some, single = split_by(both.withColumn("as_written", F.xxhash64("oid", "path")), cut(several), "as_written")
    normal = lambda df: df.select("oid", "base", nfc(F.col("path")).alias("path"), "mtime", "frontmatter")
    w = Window.partitionBy("oid", "path").orderBy(F.desc_nulls_last("mtime"), F.desc_nulls_last("frontmatter"))
    last = normal(some).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return last.select("oid", "base", "path", "frontmatter").unionByName(normal(single).select("oid", "base", "path", "frontmatter"))


def notes_of(latest: DataFrame, deep: bool = False) -> DataFrame:
    """(oid, base, path, okf_type, fields): the path-value maps of latest_notes; fields is null for an unreadable frontmatter."""
    return latest.select("oid", "base", "path", path_values(deep)("frontmatter").alias("n")).select("oid", "base", "path", "n.okf_type", "n.fields")


def path_statistics(notes: DataFrame) -> DataFrame:
    """(oid, base, okf_type, name, kind, n): how many values of each kind each path has in each file (tree or working copy).

    Counts are combined before their shuffle, so a tree that holds a third of all notes makes no hot task.
    """
    return notes.select("oid", "base", "okf_type", F.explode("fields").alias("f")).groupBy("oid", "base", "okf_type", F.col("f.name").alias("name"), F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))


def field_statistics(notes: DataFrame, per: DataFrame | None = None) -> DataFrame:
    """(oid, base, okf_type, name, n, kind, n_notes, belongs) of each field of each group; kind is the most frequent one.

    Groups are the notes with a string okf_type. per: path_statistics of the notes, made here unless given.
    """
    group = ["oid", "base", "okf_type"]
    typed = notes.where("okf_type is not null")
    per = (path_statistics(notes) if per is None else per).where("okf_type is not null")
    size = typed.groupBy(*group).agg(F.count("*").alias("n_notes"))
    field = per.groupBy(*group, "name").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("less"), F.col("kind").cast("int").alias("kind"))).alias("top"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    return (
        field.alias("a").join(size.alias("b"), same[0] & same[1] & same[2])
        .select(*[f"a.{c}" for c in group], "a.name", "a.n", kind_name(F.col("top.kind")).alias("kind"), "b.n_notes", (F.col("n") * 100 >= F.col("n_notes") * BELONGS_PERCENT).alias("belongs"))
    )


def _greedy(pairs: Column) -> Column:
    """Of sorted candidate pairs each one whose two names are still free; pairs: array<struct<rank, field_name, new_name>>."""
    start = F.expr("named_struct('old', cast(array() as array<string>), 'new', cast(array() as array<string>))")

    def step(acc: Column, p: Column) -> Column:
        free = ~F.array_contains(acc["old"], p["field_name"]) & ~F.array_contains(acc["new"], p["new_name"])
        taken = F.struct(F.array_append(acc["old"], p["field_name"]).alias("old"), F.array_append(acc["new"], p["new_name"]).alias("new"))
        return F.when(free, taken).otherwise(acc)

    return F.aggregate(pairs, start, step)


def field_changes(ref_trees: DataFrame, ref_files: DataFrame, files: DataFrame) -> DataFrame:
    """(from_oid, to_oid, okf_type, change_kind, field_name, new_name): see TESTDATA.md, p1_found.

    Compared are each delivered tree with its nearest delivered ancestor and each working copy with its base, where both
    are delivered; groups of one side only are not compared. Empty inputs give no rows.
    """
    notes = cut_to_table(notes_of(latest_notes(ref_files, files)), "notes")
    return changes_of(notes, field_statistics(notes), ref_trees, ref_files)


def changes_of(notes: DataFrame, stats: DataFrame, ref_trees: DataFrame, ref_files: DataFrame) -> DataFrame:
    """field_changes from path-value maps (notes_of, cut off before) and their statistics."""
    stats, notes = cut(stats), notes.where("okf_type is not null")
    delivered = ref_files.where("tree_oid is not null").select("tree_oid").distinct()
    edges = nearest_delivered(ref_trees, delivered).select("from_oid", F.col("tree_oid").alias("to_oid"), F.lit(None).cast("string").alias("base"))
    bases = notes.where(F.col("oid") == WORKING).where("base is not null").select(F.col("base").alias("from_oid"), F.lit(WORKING).alias("to_oid"), "base").distinct()
    edges = cut(edges.unionByName(bases))

    belongs = stats.where("belongs").select("oid", F.coalesce("base", F.lit("")).alias("base"), "okf_type", "name", "kind")
    groups = stats.select("oid", F.coalesce("base", F.lit("")).alias("base"), "okf_type").distinct()  # okf_type itself is a field, so every group has a row
    e = edges.select("from_oid", "to_oid", F.coalesce("base", F.lit("")).alias("to_base"))
    before = groups.where("base = ''").select(F.col("oid").alias("from_oid"), "okf_type")
    after = groups.select(F.col("oid").alias("to_oid"), F.col("base").alias("to_base"), "okf_type")
    both = cut(e.join(before, "from_oid").join(after, ["to_oid", "to_base", "okf_type"]))
    old = both.join(belongs.where("base = ''").select(F.col("oid").alias("from_oid"), "okf_type", "name", F.col("kind").alias("old_kind")), ["from_oid", "okf_type"])
    new = both.join(belongs.select(F.col("oid").alias("to_oid"), F.col("base").alias("to_base"), "okf_type", "name", F.col("kind").alias("new_kind")), ["to_oid", "to_base", "okf_type"])
    key = ["from_oid", "to_oid", "to_base", "okf_type"]
    moved = cut(old.join(new, [*key, "name"], "full").where("old_kind is null or new_kind is null or old_kind <> new_kind"))

    lists = moved.groupBy(*key).agg(F.collect_list(F.when(F.col("new_kind").isNull(), F.col("name"))).alias("lost"), F.collect_list(F.when(F.col("old_kind").isNull(), F.col("name"))).alias("gained"))
    lists = cut(lists.where("size(lost) > 0 and size(gained) > 0"))
    held = lambda names: F.filter("fields", lambda f: F.array_contains(F.col(names), f["name"]))
    old_notes = probably_in(notes.where("base is null").withColumnRenamed("oid", "from_oid"), lists, "from_oid", "okf_type")
    left = old_notes.join(lists, ["from_oid", "okf_type"]).select(*key, "path", held("lost").alias("had")).where("size(had) > 0")
    new_notes = probably_in(notes.withColumn("to_base", F.coalesce("base", F.lit(""))).withColumnRenamed("oid", "to_oid"), lists, "to_oid", "to_base", "okf_type")
    right = new_notes.join(lists, ["to_oid", "to_base", "okf_type"]).select(*key, "path", held("gained").alias("has"))
    met = left.join(right, [*key, "path"])
    tried = met.select(*key, F.explode("had").alias("h"), "has")
    totals = tried.groupBy(*key, F.col("h.name").alias("field_name")).agg(F.count("*").alias("n"))
    equal = tried.select(*key, F.col("h.name").alias("field_name"), F.explode(F.filter("has", lambda x: (x["digest"] == F.col("h.digest")) & (x["kind"] == F.col("h.kind")))).alias("x"))
    counts = equal.groupBy(*key, "field_name", F.col("x.name").alias("new_name")).agg(F.count("*").alias("same"))
    pairs = counts.join(totals, [*key, "field_name"]).where(F.col("same") * 100 >= F.col("n") * SAME_PERCENT)
    ranked = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("same") / F.col("n")).alias("rank"), "field_name", "new_name"))).alias("pairs"))
    renamed = cut(ranked.select(*key, _greedy(F.col("pairs")).alias("r")).select(*key, F.explode(F.arrays_zip("r.old", "r.new")).alias("r")).select(*key, F.col("r.old").alias("field_name"), F.col("r.new").alias("new_name")))

    spent = renamed.select(*key, F.explode(F.array("field_name", "new_name")).alias("name"), F.lit(True).alias("spent"))
    plain = moved.join(spent, [*key, "name"], "left").where("spent is null")
    change = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("retyped")
    out = ["from_oid", "to_oid", "okf_type"]
    report = plain.select(*out, change.alias("change_kind"), F.col("name").alias("field_name"), F.lit("").alias("new_name"))
    return report.unionByName(renamed.select(*out, F.lit("renamed").alias("change_kind"), "field_name", "new_name"))


def renames(changes: DataFrame) -> DataFrame:
    """(okf_type, field_name, final_name): each renamed field's last name, following renames of renames, however many.

    Where trees disagree, the most frequent rename of a field counts, then the first by name. Names that are renamed in a circle,
    and those that lead into it, all get the circle's first name in order. Pointer doubling: the rounds are the logarithm of the
    number of renamed fields at most, of the longest chain without circles. One row per (type, name).
    """
    r = changes.where("change_kind = 'renamed'").groupBy("okf_type", "field_name", "new_name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("okf_type", "field_name").orderBy(F.desc("n"), "new_name")
    step = cut(r.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("okf_type", "field_name", F.col("new_name").alias("to"), F.col("new_name").alias("least")))
    for _ in range(step.count().bit_length() + 1):
        far = step.select("okf_type", F.col("field_name").alias("to"), F.col("to").alias("far"), F.col("least").alias("far_least"))
        step = cut(
            step.select("okf_type", "field_name", "to", "least").join(far, ["okf_type", "to"], "left")
            .select("okf_type", "field_name", F.coalesce("far", "to").alias("to"), F.least("least", "far_least").alias("least"), F.col("far").isNotNull().alias("on"))
        )
        if step.where("on").isEmpty():
            break
    # After as many steps as there are names, whatever still goes on is in a circle: `least` of the place reached is the circle's.
    ring = step.where("on").select("okf_type", F.col("field_name").alias("to"), F.col("least").alias("ring"))
    return step.join(ring, ["okf_type", "to"], "left").select("okf_type", "field_name", F.coalesce("ring", "to").alias("final_name"))


#: Texts that count as numbers and as truth values, besides JSON's own: fixed values, the same in SQL and in Python.
NUMBER_TEXT = r"[ \t\r\n]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*"
TRUE_TEXT, FALSE_TEXT = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
_TARGET = {jsonval.NUMBER: "double", jsonval.BOOLEAN: "boolean"}
#: Up to so many rows the tables of renames and of types are broadcast; beyond it they are joined by shuffles.
SMALL_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """df, cut off before, to be broadcast if it has SMALL_ROWS rows at most."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def column_types(per: DataFrame, final: DataFrame) -> DataFrame:
    """(name, target, n): of each last name the most frequent kind of its values, over all files; from path_statistics and renames."""
    named = per.join(final.withColumnRenamed("field_name", "name"), ["okf_type", "name"], "left").select(F.coalesce("final_name", "name").alias("name"), kind_name(F.col("kind")).alias("kind"), "n")
    kinds = named.groupBy("name", "kind").agg(F.sum("n").alias("n"))
    return kinds.groupBy("name").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("target"), F.sum("n").alias("n"))


def _prepared(ref_trees: DataFrame, ref_files: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(latest notes, renames, types): what the consistent table is made with; one set of path-value maps serves all."""
    latest = latest_notes(ref_files, files)
    notes = cut_to_table(notes_of(latest), "notes")
    per = cut_to_table(path_statistics(notes), "paths")
    final = cut(renames(changes_of(notes, field_statistics(notes, per), ref_trees, ref_files)))
    return latest, final, cut(column_types(per, final))


def unified(ref_trees: DataFrame, ref_files: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All notes under one naming and typing, long: (values, types).

    values: oid, base, path, okf_type, name, source_name, kind, target, value_text, failed, value_number, value_boolean. name is
    the field's last name (see renames), target the most frequent kind of that name over all notes. value_text is the value in
    the target's form, value_number and value_boolean the typed value where the target is one of these, whatever the number of
    names; where the value can't be cast it is null and failed is true, and raw keeps the original. types: name, target, n.
    Every latest note has a row. One that can't be read has a failed row with the name '',
    kind 'unreadable' or, for null, 'missing', target 'object' and the frontmatter as raw. A readable one without values,
    {} or nulls only, has a row with null name, kind, target, raw and value_text that didn't fail.
    """
    latest, final, types = _prepared(ref_trees, ref_files, files)
    read = latest.select("oid", "base", "path", "frontmatter", path_values(raw=True)("frontmatter").alias("n"))
    held = F.transform("n.fields", lambda f: F.struct(f["name"].alias("name"), kind_name(f["kind"]).alias("kind"), f["raw"].alias("raw"), F.coalesce(f["text"], f["raw"]).alias("text")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.when(F.col("frontmatter").isNull(), MISSING).otherwise(UNREADABLE).alias("kind"), F.col("frontmatter").alias("raw"), F.lit(None).cast("string").alias("text")))
    rows = read.select("oid", "base", "path", "n.okf_type", F.explode_outer(F.when(F.col("n.fields").isNull(), whole).otherwise(held)).alias("p"))
    rows = rows.select("oid", "base", "path", "okf_type", F.col("p.name").alias("source_name"), "p.kind", "p.raw", F.col("p.text").alias("text"))
    rows = rows.join(_small(final.withColumnRenamed("field_name", "source_name")), ["okf_type", "source_name"], "left").withColumn("name", F.coalesce("final_name", "source_name")).drop("final_name")
    text, target, kind = F.col("text"), F.col("target"), F.col("kind")
    number = F.when((kind == jsonval.NUMBER) | ((kind == jsonval.STRING) & text.rlike(rf"\A{NUMBER_TEXT}\z")), text.try_cast("double"))
    low = F.lower(F.trim(text))
    truth = F.when(kind.isin(jsonval.BOOLEAN, jsonval.STRING, jsonval.NUMBER), F.when(low.isin(*TRUE_TEXT), True).when(low.isin(*FALSE_TEXT), False))
    cast = (
        F.when(target == jsonval.NUMBER, number.cast("string"))
        .when(target == jsonval.BOOLEAN, truth.cast("string"))
        .when(target == jsonval.STRING, text)
        .when(target == jsonval.ARRAY, F.when(kind == jsonval.ARRAY, F.col("raw")).otherwise(F.concat(F.lit("["), "raw", F.lit("]"))))
        .when(kind == jsonval.OBJECT, F.col("raw"))
    )
    values = rows.join(_small(types.select("name", "target")), "name", "left").withColumn("value_text", cast)
    values = values.withColumn("value_number", F.when(target == jsonval.NUMBER, number)).withColumn("value_boolean", F.when(target == jsonval.BOOLEAN, truth)).drop("text")
    whole = F.col("name").isNull() & F.col("kind").isNotNull()
    values = values.withColumn("target", F.when(whole, jsonval.OBJECT).otherwise(F.col("target"))).withColumn("source_name", F.when(whole, "").otherwise(F.col("source_name"))).withColumn("name", F.when(whole, "").otherwise(F.col("name")))
    return values.withColumn("failed", F.col("value_text").isNull() & F.col("kind").isNotNull()), types


def _columns(types: DataFrame, max_columns: int) -> list[tuple[str, str, str]]:
    """(name, target, label) of the max_columns most frequent names; all that the driver reads of the data."""
    used, out = set(), []
    for r in types.orderBy(F.desc("n"), "name").select("name", "target").limit(max_columns).collect():
        stem = f"f_{r['name']}".replace("`", "_")
        label, i = stem, 2
        while label.lower() in used:
            label, i = f"{stem}_{i}", i + 1
        used.add(label.lower())
        out.append((r["name"], r["target"], label))
    return out


def typed_table(values: DataFrame, types: DataFrame, max_columns: int = 400) -> DataFrame:
    """One row per note with typed columns: oid, base, path, okf_type, readable, one column f_<name> per frequent field, rest, failed.

    readable is false for a note with null or unreadable frontmatter, which failed holds under the name ''.

    The max_columns most frequent names (then by name) become columns: double, boolean or string (lists and objects as
    JSON). rest maps all other names to their text, and failed maps names to the JSON of values that could not be cast:
    no value is lost; typed values of all names, however many, are in the long form of unified(). Names are told apart with
    case; a name that would clash with another column in lower case gets a number after it. typed_notes() gives the same
    without a shuffle of the values.
    """
    columns = _columns(types, max_columns)
    top = [c[0] for c in columns]
    pair = lambda v: F.map_from_entries(F.collect_list(v))
    # Two source names may meet under one final name: a value that could be cast counts, then the first by source name.
    value = F.min_by(F.struct("raw", "value_text", "failed", "kind"), F.struct("failed", "source_name"))
    note = ["oid", "base", "path", "okf_type"]
    one = values.groupBy(*note, "name").agg(value.alias("v")).groupBy(*note).agg(
        pair(F.when(~F.col("v.failed") & F.col("name").isNotNull(), F.struct("name", "v.value_text"))).alias("ok"),
        pair(F.when(F.col("v.failed"), F.struct("name", "v.raw"))).alias("failed"),
        F.bool_and(~F.coalesce("v.kind", F.lit(jsonval.OBJECT)).isin(UNREADABLE, MISSING)).alias("readable"),
    )
    out = [F.col("ok")[F.lit(name)].try_cast(_TARGET.get(target, "string")).alias(label) for name, target, label in columns]
    rest = F.map_filter("ok", lambda k, _: ~k.isin(top)) if top else F.col("ok")
    return one.select("oid", "base", "path", "okf_type", "readable", *out, rest.alias("rest"), "failed")


_ARROW = {jsonval.NUMBER: pa.float64(), jsonval.BOOLEAN: pa.bool_()}
_MAP = pa.map_(pa.string(), pa.string())


def _cast(value: object, target: str):
    """A non-null value in the form of its column, None where it can't be; the same rules as in unified()."""
    kind = jsonval.kind(value)
    if target == jsonval.STRING:
        return jsonval.clean(value) if kind == jsonval.STRING else jsonval.canonical(value)
    if target == jsonval.ARRAY:
        return jsonval.canonical(value) if kind == jsonval.ARRAY else f"[{jsonval.canonical(value)}]"
    if target == jsonval.OBJECT:
        return jsonval.canonical(value) if kind == jsonval.OBJECT else None
    if target == jsonval.NUMBER:
        if kind == jsonval.NUMBER or kind == jsonval.STRING and _NUMBER_TEXT(value):
            try:
                return float(value)
            except OverflowError:
                return float("inf") if value > 0 else float("-inf")
        return None
    if kind in (jsonval.ARRAY, jsonval.OBJECT):
        return None
    low = (value if kind == jsonval.STRING else jsonval.canonical(value)).strip(" ").lower()
    return True if low in TRUE_TEXT else False if low in FALSE_TEXT else None


_NUMBER_TEXT = re.compile(NUMBER_TEXT).fullmatch


def _text_of(value: object) -> str:
    """A cast value as the text that `rest` holds."""
    return str(value).lower() if type(value) is bool else java_double(value) if type(value) is float else value


def java_double(x: float) -> str:
    """A double as the JVM writes it: the shortest digits, with an exponent below 1e-3 and from 1e7 on."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        r = repr(x)
        return r if "e" not in r else format(x, "f")
    digits, power = f"{Decimal(repr(x)):E}".split("E")
    digits = (digits if "." in digits else digits + ".0").rstrip("0")
    return f"{digits}{'0' if digits.endswith('.') else ''}E{int(power)}"


def typed_notes(latest: DataFrame, final: DataFrame, types: DataFrame, max_columns: int = 400) -> DataFrame:
    """typed_table of the latest notes, by one pass over each note's path-value map: nothing but duplicates was shuffled.

    The workers get the renames (SMALL_ROWS at most, checked), the columns' names and, of names without a column, the targets (as
    many at most). Where there are more renames or names than that, None is returned: the long form does it then.
    """
    if final.limit(SMALL_ROWS + 1).count() > SMALL_ROWS or types.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return None
    columns = _columns(types, max_columns)
    rename: dict[str, dict[str, str]] = {}
    for r in final.collect():
        rename.setdefault(r["okf_type"], {})[r["field_name"]] = r["final_name"]
    target = {r["name"]: r["target"] for r in types.select("name", "target").collect()}
    place = {name: i for i, (name, _, _) in enumerate(columns)}
    kinds = [_ARROW.get(t, pa.string()) for _, t, _ in columns]
    labels = [f"c{i}" for i in range(len(columns))]
    schema = pa.struct([("okf_type", pa.string()), ("readable", pa.bool_()), *zip(labels, kinds), ("rest", _MAP), ("failed", _MAP)])
    fixed = {"": {}}

    @arrow_fn(schema)
    def project(texts: pa.Array) -> pa.Array:
        n = len(texts)
        types_, readable, cells = [], [], [{} for _ in columns]
        rest, failed = [], []
        for i, text in enumerate(texts.to_pylist()):
            value = jsonval.readable(text)
            readable.append(value is not None)
            if value is None:
                types_.append(None)
                rest.append([])
                failed.append([("", text)])
                continue
            okf = value.get("okf_type")
            okf = jsonval.clean(okf) if type(okf) is str else None
            types_.append(okf)
            names, best = rename.get(okf, fixed[""]) if okf is not None else fixed[""], {}
            for k, v in members(value):
                source = jsonval.clean(k)
                name = names.get(source, source)
                out = _cast(v, target[name])
                mine = (out is None, source)
                if name not in best or mine < best[name][0]:
                    best[name] = (mine, out, v)
            more, bad = [], []
            for name, (_, out, v) in best.items():
                if out is None:
                    bad.append((name, jsonval.canonical(v)))
                elif name in place:
                    cells[place[name]][i] = out
                else:
                    more.append((name, _text_of(out)))
            rest.append(more)
            failed.append(bad)
        arrays = [pa.array(map(c.get, range(n)), t) if c else pa.nulls(n, t) for c, t in zip(cells, kinds)]
        return pa.StructArray.from_arrays([pa.array(types_, pa.string()), pa.array(readable, pa.bool_()), *arrays, pa.array(rest, _MAP), pa.array(failed, _MAP)], fields=list(schema))

    t = latest.select("oid", "base", "path", project("frontmatter").alias("t"))
    named = [F.col(f"t.{c}").alias(label) for c, (_, _, label) in zip(labels, columns)]
    return t.select("oid", "base", "path", "t.okf_type", "t.readable", *named, "t.rest", "t.failed")


def consistent_table(ref_trees: DataFrame, ref_files: DataFrame, files: DataFrame, max_columns: int = 400) -> DataFrame:
    """One consistent table of all notes: typed_table, by the cheaper of its two ways that the number of names allows."""
    wide = typed_notes(*_prepared(ref_trees, ref_files, files), max_columns)
    return typed_table(*unified(ref_trees, ref_files, files), max_columns) if wide is None else wide


def failed_casts(values: DataFrame) -> DataFrame:
    """(name, target, kind, n, example): how many values of each kind could not be cast to their field's type.

    Notes with null or unreadable frontmatter count under the name '', kinds 'missing' and 'unreadable'.
    """
    return values.where("failed").groupBy("name", "target", "kind").agg(F.count("*").alias("n"), F.min(F.substring("raw", 1, 200)).alias("example"))
