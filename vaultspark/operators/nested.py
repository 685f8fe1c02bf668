"""Deeply nested records as flat tables (problem 2): structural variants by a tree automaton."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import jsonval
from vaultspark.functions.arrow import arrow_fn
from vaultspark.session import cut_to_table

_FIELD = pa.struct([("name", pa.string()), ("kind", pa.string()), ("raw", pa.string())])
_ELEMENT = pa.struct([("parent_ptr", pa.string()), ("name", pa.string()), ("list_ptr", pa.string()), ("position", pa.int32()), ("kind", pa.string()), ("raw", pa.string())])
_NODE = pa.struct([("node_ptr", pa.string()), ("parent_ptr", pa.string()), ("role", pa.string()), ("state", pa.string()), ("fields", pa.list_(_FIELD))])


def classify(root: dict) -> list[dict]:
    """Every object of a record, the outermost first, with the state that a bottom-up tree automaton gives it.

    Leaves have their kind as state. An array's state is the set of its elements' states, so its length and order don't
    matter. An object's state is its sorted (key, state) pairs. Two objects have the same state just when they have the
    same structure. States of inner nodes are hashed, so that a state has a fixed size at any depth. A null is a state of
    its own, not a missing key. The walk keeps its own stack: depth is bounded by the JSON reader only.
    """
    out: list[dict] = []
    states: dict[int, str] = {}
    todo: list[tuple] = [(root, "", None, "", False)]  # value, pointer, enclosing object's pointer, role, children done
    while todo:
        value, ptr, parent, role, done = todo.pop()
        is_object = type(value) is dict
        if not done:
            slot = None
            if is_object:
                slot = len(out)
                out.append({"node_ptr": jsonval.clean(ptr), "parent_ptr": parent, "role": jsonval.clean(role)})
            todo.append((value, slot, parent, role, True))
            if is_object:
                todo += [(v, ptr + (s := jsonval.pointer_step(k)), out[slot]["node_ptr"], role + s, False) for k, v in reversed(value.items()) if type(v) in (dict, list)]
            else:
                todo += [(value[i], f"{ptr}/{i}", parent, role + "/*", False) for i in range(len(value) - 1, -1, -1) if type(value[i]) in (dict, list)]
            continue
        state_of = lambda v: states.pop(id(v)) if type(v) in (dict, list) else jsonval.kind(v)
        if is_object:
            fields, parts = [], []
            for k in sorted(value):
                v = value[k]
                s = state_of(v)
                parts.append(f"{k}\x00{s}")
                fields.append({"name": jsonval.clean(k), "kind": jsonval.kind(v), "raw": None if type(v) in (dict, list) else jsonval.canonical(v)})
            states[id(value)] = "o" + format(jsonval.digest("\x01".join(parts)) & (2**64 - 1), "016x")
            out[ptr] |= {"state": states[id(value)], "fields": fields}
        else:
            states[id(value)] = "a" + format(jsonval.digest("\x01".join(sorted({state_of(v) for v in value}))) & (2**64 - 1), "016x")
    return out


def elements(root: dict) -> list[dict]:
    """Every element of a record's lists that is no object, in the order of the record; the walk keeps its own stack."""
    out: list[dict] = []
    todo: list[tuple] = [(root, "", None, None)]  # value, pointer, enclosing object's pointer, name there
    while todo:
        value, ptr, parent, name = todo.pop()
        if type(value) is dict:
            inner = [(v, ptr + jsonval.pointer_step(k), ptr, k) for k, v in value.items() if type(v) in (dict, list)]
        else:
            at = {"parent_ptr": jsonval.clean(parent), "name": jsonval.clean(name), "list_ptr": jsonval.clean(ptr)}
            out += [at | {"position": i, "kind": jsonval.kind(v), "raw": None if type(v) is list else jsonval.canonical(v)} for i, v in enumerate(value) if type(v) is not dict]
            inner = [(v, f"{ptr}/{i}", parent, name) for i, v in enumerate(value) if type(v) in (dict, list)]
        todo += reversed(inner)
    return out


@arrow_fn(pa.list_(_ELEMENT))
def _elements(texts: pa.Array) -> pa.Array:
    return pa.array([None if (v := jsonval.readable(t)) is None else elements(v) for t in texts.to_pylist()], pa.list_(_ELEMENT))


@arrow_fn(pa.list_(_NODE))
def _nodes(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        value = jsonval.readable(text)
        rows.append(None if value is None else classify(value))
    return pa.array(rows, pa.list_(_NODE))


def latest_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest mtime (ties: the greatest frontmatter; null last)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mtime"), F.desc_nulls_last("frontmatter"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def nodes(files: DataFrame) -> DataFrame:
    """(path, node_ptr, parent_ptr, role, state, fields): a row for every object of every readable frontmatter.

    node_ptr is a JSON Pointer, '' for the outermost object; parent_ptr is that of the nearest enclosing object, null for
    the outermost. role is the pointer with * for list positions. fields has each member's name, kind and, for scalars,
    canonical JSON. Unreadable or null frontmatter and null paths give no rows; of a path's rows the latest counts.
    Cost is one shuffle of (path, mtime, frontmatter) for the latest row; the walk itself is row by row, in Arrow batches.
    """
    one = latest_rows(files.where("path is not null").select("path", "mtime", "frontmatter"), "path")
    return one.select("path", F.explode(_nodes("frontmatter")).alias("n")).select("path", "n.*")


def list_elements(files: DataFrame) -> DataFrame:
    """(path, parent_ptr, name, list_ptr, position, kind, raw): the elements of all lists of the notes of nodes(), but objects.

    The child table of subtype_rows: parent_ptr is the node_ptr of the nearest enclosing object, name its member that holds
    the list, list_ptr the list's JSON Pointer and position the element's place from 0. raw is canonical JSON, null for a
    list within a list, whose elements are rows with its pointer as list_ptr. Objects in lists are rows of nodes(), with
    list_ptr/position as node_ptr. An array member with rows in neither is an empty list.
    """
    one = latest_rows(files.where("path is not null").select("path", "mtime", "frontmatter"), "path")
    return one.select("path", F.explode(_elements("frontmatter")).alias("e")).select("path", "e.*")


def nested_objects(files: DataFrame) -> DataFrame:
    """(path, node_ptr, parent_ptr) of every object but the outermost."""
    return nodes(files).where("parent_ptr is not null").select("path", "node_ptr", "parent_ptr")


def variants(node_rows: DataFrame) -> DataFrame:
    """(role, state, n, n_role, members): the structural variants of each role with their number of objects."""
    v = node_rows.groupBy("role", "state").agg(F.count("*").alias("n"), F.first(F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["kind"].alias("kind")))).alias("members"))
    return v.withColumn("n_role", F.sum("n").over(Window.partitionBy("role")))


def supertypes(variant_rows: DataFrame) -> DataFrame:
    """(role, key, kind, n, common): of each role's keys in how many objects they occur, and whether in all with one kind.

    Computed from variants, not from objects: the input is small whatever the number of records.
    """
    m = variant_rows.select("role", "n", "n_role", F.inline("members"))
    k = m.groupBy("role", F.col("name").alias("key")).agg(F.sum("n").alias("n"), F.max("n_role").alias("n_role"), F.collect_set("kind").alias("kinds"))
    return k.select("role", "key", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise(F.lit("mixed")).alias("kind"), "n", ((F.col("n") == F.col("n_role")) & (F.size("kinds") == 1)).alias("common"))


def nodes_once(files: DataFrame) -> DataFrame:
    """nodes(), written once to the shared folder in order of role and state: what follows reads it as often as it needs.

    The rows of one variant lie together, so that reading one of them skips the rest by the statistics of the files.
    """
    return cut_to_table(nodes(files).repartitionByRange("role", "state", "path").sortWithinPartitions("role", "state"), "nodes")


def _scalar(f: Column) -> Column:
    """A string member's content; of other scalars their JSON."""
    return F.when(f["kind"] == jsonval.STRING, F.get_json_object(F.concat(F.lit('{"v":'), f["raw"], F.lit("}")), "$.v")).otherwise(f["raw"])


def subtype_rows(node_rows: DataFrame) -> DataFrame:
    """Each object routed to its variant: path, node_ptr, parent_ptr, role, state, common, own, numbers, booleans, strings.

    common maps the keys that every variant of the role shares to canonical JSON (the supertype's columns), own maps the
    variant's other scalar members. numbers, booleans and strings hold all scalar members by their types: all rows of a state
    have the same keys there, so they are the typed subtype tables of all variants in one. Nested objects are rows of their
    own, other elements of lists are rows of list_elements(); both are reached by parent_ptr. node_rows is read twice: see
    nodes_once. The keys of the supertypes, one row per role, are all that is joined.
    """
    keys = supertypes(variants(node_rows)).where("common").groupBy("role").agg(F.collect_set("key").alias("keys"))
    j = node_rows.join(keys, "role", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    scalar = F.filter("fields", lambda f: f["raw"].isNotNull())
    as_map = lambda a, value=lambda f: f["raw"]: F.map_from_entries(F.transform(a, lambda f: F.struct(f["name"], value(f))))
    of = lambda kind: F.filter("fields", lambda f: f["kind"] == kind)
    return j.select(
        "path", "node_ptr", "parent_ptr", "role", "state",
        as_map(F.filter(scalar, lambda f: F.array_contains(F.col("keys"), f["name"]))).alias("common"),
        as_map(F.filter(scalar, lambda f: ~F.array_contains(F.col("keys"), f["name"]))).alias("own"),
        as_map(of(jsonval.NUMBER), lambda f: f["raw"].try_cast("double")).alias("numbers"),
        as_map(of(jsonval.BOOLEAN), lambda f: f["raw"].try_cast("boolean")).alias("booleans"),
        as_map(of(jsonval.STRING), _scalar).alias("strings"),
    )


def write_subtypes(files: DataFrame, folder: str) -> None:
    """The typed tables of all variants in one write: subtype_rows, clustered by role and state.

    A variant's table is the rows of its role and state; see subtype_table for its columns by name.
    """
    subtype_rows(nodes_once(files)).repartitionByRange("role", "state", "path").sortWithinPartitions("role", "state").write.mode("overwrite").parquet(folder)


_CAST = {jsonval.NUMBER: "double", jsonval.BOOLEAN: "boolean", jsonval.STRING: "string"}


def subtype_table(node_rows: DataFrame, role: str, state: str) -> DataFrame:
    """The typed table of one variant: the links path, node_ptr, parent_ptr and a column per scalar member.

    The schema is read from one object of the variant, since all objects of a state have the same members.
    A member called like a link column gets a trailing underscore, again until its name is free.
    """
    own = node_rows.where((F.col("role") == role) & (F.col("state") == state))
    one = own.select("fields").first()
    used, columns = {"path", "node_ptr", "parent_ptr"}, []
    for i, f in enumerate(one["fields"] if one else []):
        if f["kind"] in _CAST:
            name = f["name"] or "_"
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            raw = F.col("fields")[i]["raw"]
            value = _scalar(F.col("fields")[i]) if f["kind"] == jsonval.STRING else raw.try_cast(_CAST[f["kind"]])
            columns.append(value.alias(name))
    return own.select("path", "node_ptr", "parent_ptr", *columns)
