"""Problems 1, 2, 4 and 5 against plain versions, and their odd inputs."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests import brute
from vaultspark.functions import jsonval
from vaultspark.operators import drift, nested, sessions, snapshots, trees
from vaultspark.plans import problems

TREES = "tree_oid string, parent_oid string"
REF = "tree_oid string, path string, mtime double, frontmatter string"
FILES = "path string, mtime double, frontmatter string, base_oid string"


def rows(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def got(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_found_on_the_small_tables(spark, small):
    t, r, f = (rows(spark, small, n) for n in ("ref_trees", "ref_files", "files"))
    assert got(problems.p1_found(spark, small)) == brute.p1(t, r, f)
    assert got(problems.p2_found(spark, small)) == brute.p2(f)
    assert got(problems.p5_found(spark, small)) == brute.p5(t, r)


def random_catalog(seed):
    """Trees with forks and undelivered ones; frontmatter readable, broken, encoded twice, null."""
    rng = random.Random(seed)
    t, r = [], []
    for i in range(14):
        t.append({"tree_oid": f"t{i}", "parent_oid": rng.choice([None, *[f"t{k}" for k in range(i)]]) if i else None})
    t.append(dict(t[3]))
    names = [f"f{i}" for i in range(7)]

    def value():
        return rng.choice([None, 1, 1.0, True, "x", "1", [], [1, None], {"a": 1}, {"b": None}])

    def text():
        v = {"okf_type": rng.choice(["a", "b", None, 3])} | {rng.choice(names): value() for _ in range(rng.randint(0, 6))}
        s = json.dumps(v, sort_keys=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": ")]))
        return rng.choice([s, s, s, s, json.dumps(s), json.dumps(json.dumps(s)), s[:-2], None, "[1]", "3", ""])

    for i in range(14):
        if rng.random() < 0.7:
            for p in range(12):
                if rng.random() < 0.8:
                    r.append({"tree_oid": f"t{i}", "path": rng.choice([f"p{p}", f"é{p}", f"é{p}"]), "mtime": float(rng.randint(0, 10**6)), "frontmatter": text()})
    r = list({(x["tree_oid"], x["path"], x["mtime"]): x for x in r}.values())
    f = [{"path": f"w{i}" if i % 5 else f"p{i}", "mtime": float(i), "frontmatter": text(), "base_oid": f"t{rng.randint(0, 15)}"} for i in range(60)]
    return t, r, f


@pytest.mark.parametrize("seed", range(3))
def test_found_on_random_catalogs(spark, seed):
    t, r, f = random_catalog(seed)
    dt, dr, df = (spark.createDataFrame([tuple(x.values()) for x in rows], s) for rows, s in ((t, TREES), (r, REF), (f, FILES)))
    assert got(snapshots.catalog_changes(dt, dr.withColumn("digest", F.lit(1)))) == brute.p5(t, r)
    assert got(drift.field_changes(dt, dr, df)) == brute.p1(t, r, f)
    assert got(nested.nested_objects(df)) == brute.p2(f)


def test_empty_tables(spark):
    t, r, f = (spark.createDataFrame([], s) for s in (TREES, REF, FILES))
    assert drift.field_changes(t, r, f).count() == snapshots.catalog_changes(t, r).count() == nested.nested_objects(f).count() == 0
    assert drift.typed_table(*drift.unified(t, r, f)).count() == 0


def test_null_keys_are_left_out(spark):
    t = spark.createDataFrame([(None, "a"), ("a", None), ("b", "a"), ("c", "gone"), ("d", "d")], TREES)
    r = spark.createDataFrame([(None, "x", 1.0, "{}"), ("a", None, 1.0, "{}"), ("a", "x", None, "{}"), ("b", "x", 1.0, None), ("c", "x", 1.0, "{}"), ("d", "y", 1.0, "{}")], REF)
    assert got(snapshots.catalog_changes(t, r)) == {("b", "x", "changed")}


def test_chains_hold_every_edge_once(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "b"), ("f", "e")]
    e = spark.createDataFrame(edges, "tree_oid string, from_oid string")
    d = spark.createDataFrame([(x,) for x in "abcdefg"], "tree_oid string")
    chains = defaultdict(dict)
    for x in trees.chains(e, d).collect():
        chains[x["chain"]][x["idx"]] = x["tree_oid"]
    pairs = [(c[i], c[i - 1]) for c in chains.values() for i in c if i]
    assert sorted(pairs) == sorted(edges) and all(sorted(c) == list(range(len(c))) for c in chains.values())


def test_long_run_of_undelivered_trees(spark):
    t = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(40)], TREES)
    d = spark.createDataFrame([("t0",), ("t33",), ("t39",)], "tree_oid string")
    assert got(trees.nearest_delivered(t, d)) == {("t33", "t0"), ("t39", "t33")}


def test_typed_table_loses_nothing(spark, small):
    t, r, f = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("ref_trees", "ref_files", "files"))
    values, types = drift.unified(t, r, f)
    wide = drift.typed_table(values, types, max_columns=5)
    names = [c for c in wide.columns if c.startswith("f_")]
    assert len(names) == 5
    kept = wide.select(F.sum(sum([F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in names], F.lit(0)) + F.size("rest") + F.size("failed"))).first()[0]
    assert kept == values.groupBy("oid", "base", "path", "okf_type", "name").count().count()
    assert drift.failed_casts(values).agg(F.sum("n")).first()[0] == values.where("failed").count()
    assert problems.p1_table(spark, small).count() == wide.count()


def test_variants(spark):
    notes = [{"todos": [{"id": 1, "s": "a"}, {"s": "b", "id": 2}, {"id": "x"}], "m": {"a/b": {"~": None}}}, {"todos": {"id": 3, "s": "c"}, "e": {}}]
    df = spark.createDataFrame([(f"p{i}", 1.0, json.dumps(n), None) for i, n in enumerate(notes)], FILES)
    n = nested.nodes(df).cache()
    assert {(r["path"], r["node_ptr"], r["parent_ptr"]) for r in n.collect()} >= {("p0", "/m/a~1b", "/m"), ("p0", "/todos/1", ""), ("p1", "/e", "")}
    states = {r["node_ptr"]: r["state"] for r in n.where("path = 'p0'").collect()}
    assert states["/todos/0"] == states["/todos/1"] != states["/todos/2"]
    v = {(r["role"], r["n"]) for r in nested.variants(n).collect()}
    assert ("/todos/*", 2) in v and ("/todos/*", 1) in v
    keys = {(r["role"], r["key"]): (r["kind"], r["common"]) for r in nested.supertypes(nested.variants(n)).collect()}
    assert keys["/todos/*", "id"] == ("mixed", False) and keys["/todos/*", "s"] == ("string", False) and keys["/todos", "id"] == ("number", True)
    assert nested.subtype_rows(n).count() == n.count()
    one = nested.subtype_table(n, "/todos/*", states["/todos/0"]).orderBy("node_ptr").collect()
    assert [(r["node_ptr"], r["id"], r["s"]) for r in one] == [("/todos/0", 1.0, "a"), ("/todos/1", 2.0, "b")]


def test_typed_table_has_every_note(spark, small):
    t = spark.createDataFrame([("a", None)], TREES)
    r = spark.createDataFrame([("a", p, 1.0, x) for p, x in (("cut", '{"n": 1'), ("null", None), ("list", "[1]"), ("empty", "{}"), ("nulls", '{"n": null}'), ("ok", '{"n": 1, "": "x"}'), ("text", '{"n": "x"}'), ("more", '{"n": 2}'))], REF)
    f = spark.createDataFrame([("w", 1.0, None, "a"), ("w", 2.0, "{", "a")], FILES)
    values, types = drift.unified(t, r, f)
    for columns in (0, 1, 9):
        got = {r["path"]: (r["readable"], r["failed"]) for r in drift.typed_table(values, types, max_columns=columns).collect()}
        lost = {"cut": '{"n": 1', "null": None, "list": "[1]", "w": "{"}
        assert got == {p: (False, {"": x}) for p, x in lost.items()} | {p: (True, {}) for p in ("empty", "nulls", "ok", "more")} | {"text": (True, {"n": '"x"'})}
    wide = {r["path"]: r for r in drift.typed_table(values, types).collect()}
    assert wide["ok"]["f_"] == "x" and wide["ok"]["f_n"] == 1.0 and wide["empty"]["f_"] is wide["cut"]["f_"] is None and not wide["empty"]["rest"]
    assert {(r["name"], r["kind"], r["n"]) for r in drift.failed_casts(values).collect()} == {("", "missing", 1), ("", "unreadable", 3), ("n", "string", 1)}
    assert {r["name"]: (r["target"], r["n"]) for r in types.collect()} == {"n": ("number", 3), "": ("string", 1)}
    latest = len({r["path"] for r in rows(spark, small, "files")}) + sum(map(len, brute.catalogs(rows(spark, small, "ref_files")).values()))
    assert problems.p1_table(spark, small).count() == latest


def leaves(v, ptr=""):
    """(pointer, JSON) of every scalar of a value."""
    if not isinstance(v, (dict, list)):
        return {(ptr, json.dumps(v))}
    step = lambda k: str(k).replace("~", "~0").replace("/", "~1")
    return set().union(*(leaves(c, f"{ptr}/{step(k)}") for k, c in (v.items() if isinstance(v, dict) else enumerate(v))))


def scalars(files):
    """(path, pointer, JSON) of every scalar in the flat tables of problem 2."""
    step = lambda k: k.replace("~", "~0").replace("/", "~1")
    out = [(r["path"], f"{r['node_ptr']}/{step(k)}", v) for r in nested.subtype_rows(nested.nodes(files)).collect() for k, v in (r["common"] | r["own"]).items()]
    out += [(r["path"], f"{r['list_ptr']}/{r['position']}", r["raw"]) for r in nested.list_elements(files).where("raw is not null").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_flat_tables_hold_every_scalar(spark, small):
    notes = [{"tags": ["a", 1, None, {"k": [True, [2, [], {"z": [3]}]]}, [["b"], []]], "none": [], "t": "x", "a/b": {"~": ["c"]}}, {"tags": "a"}]
    df = spark.createDataFrame([(f"p{i}", 1.0, json.dumps(n), None) for i, n in enumerate(notes)], FILES)
    assert scalars(df) == {(f"p{i}", *x) for i, n in enumerate(notes) for x in leaves(n)}
    e = {(r["parent_ptr"], r["name"], r["list_ptr"], r["position"], r["kind"]) for r in nested.list_elements(df).collect()}
    assert {("", "tags", "/tags/4", 1, "array"), ("/tags/3", "k", "/tags/3/k/1", 0, "number"), ("/a~1b", "~", "/a~1b/~0", 0, "string")} <= e
    f = spark.read.parquet(f"{small}/files.parquet")
    latest = {r["path"]: brute.read(r["frontmatter"]) for r in sorted(rows(spark, small, "files"), key=lambda r: r["mtime"])}
    assert {(p, at) for p, at, _ in scalars(f)} == {(p, at) for p, v in latest.items() if v for at, _ in leaves(v)}
    assert problems.p2_elements(spark, small).count() == nested.list_elements(f).count() > 0


def test_deep_and_odd_json(spark):
    texts = ["[" * 500 + "]" * 500, '{"a":' * 450 + "1" + "}" * 450, '{"a":' * 60 + "1" + "}" * 60, '{"k": "\\ud800"}', '{"\\ud800": {}}', '{"n": NaN}', "{}", '"\\"{}\\""', '{"a": 1e400}']
    df = spark.createDataFrame([(f"p{i}", 1.0, t, None) for i, t in enumerate(texts)], FILES)
    counts = {r["path"]: r["n"] for r in nested.nodes(df).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert counts == {"p1": 450, "p2": 60, "p3": 1, "p4": 2, "p6": 1, "p7": 1, "p8": 1}


def test_notes_nested_thousands_deep(spark):
    deep = lambda n, end: '{"okf_type":"a","k":' + '{"a":' * n + end + "}" * n + "}"
    t = spark.createDataFrame([("t0", None), ("t1", "t0")], TREES)
    r = spark.createDataFrame([("t0", "p", 1.0, deep(2000, "1")), ("t1", "p", 1.0, deep(2000, "2")), ("t0", "q", 1.0, deep(2000, "1")), ("t1", "q", 1.0, deep(2000, "1.0").replace(":", " : "))], REF)
    f = spark.createDataFrame([("w", 1.0, deep(2000, "[{}]").replace('"k"', '"l"'), "t1"), ("lists", 1.0, '{"x":' + "[" * 3000 + "{}" + "]" * 3000 + "}", "t1")], FILES)
    assert got(snapshots.catalog_changes(t, r)) == {("t1", "p", "changed")}
    assert got(drift.field_changes(t, r, f)) == {("t1", "working", "a", "added", "l", ""), ("t1", "working", "a", "removed", "k", "")}
    counts = {x["path"]: x["n"] for x in nested.nested_objects(f).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert counts == {"w": 2001, "lists": 1}
    assert nested.list_elements(f).where("path = 'lists'").count() == 2999


def test_readers_without_recursion():
    rng = random.Random(5)

    def value(d):
        k = rng.random()
        if d and k < 0.6:
            return {rng.choice('abé"\\/') * rng.randint(0, 2): value(d - 1) for _ in range(rng.randint(0, 3))} if k < 0.35 else [value(d - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 1, -2.5, 5.0, 1e30, "x", '"', "\ud800"])

    for _ in range(300):
        v = value(5)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert jsonval.decode_deep(text) == v and jsonval.canonical_deep(v) == jsonval.canonical(v)
        at = rng.randrange(len(text))
        bad = text[:at] + rng.choice(["", "x", ",", "}", "]", '"']) + text[at + 1 :]
        try:
            want = json.loads(bad)
        except ValueError:
            with pytest.raises(ValueError):
                jsonval.decode_deep(bad)
        else:
            assert repr(jsonval.decode_deep(bad)) == repr(want)


def test_renames_follow_long_chains_and_circles(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)] + [("b", "c"), ("c", "a"), ("a", "b"), ("into", "c"), ("self", "self")]
    rows_ = [("x", "y", "t", "renamed", a, b) for a, b in pairs] + [("x", "z", "u", "renamed", "n000", "other"), ("x", "z", "t", "added", "q", "")]
    c = spark.createDataFrame(rows_, "from_oid string, to_oid string, okf_type string, change_kind string, field_name string, new_name string")
    want = {("t", a, "n300") for a, _ in pairs[:300]} | {("t", x, "a") for x in ("a", "b", "c", "into")} | {("t", "self", "self"), ("u", "n000", "other")}
    assert got(drift.renames(c)) == want
    assert drift.renames(c.where("false")).count() == 0


def test_both_ways_to_the_typed_table_agree(spark, small):
    texts = ['{"okf_type": "a", "n": 1, "b": true, "s": "x"}', '{"okf_type": "a", "n": " -2.50e3 ", "b": " YES ", "s": 1.0, "l": 3}', '{"okf_type": "a", "n": "1_0", "b": 0, "s": [true], "l": [1]}', '{"okf_type": "a", "n": 1e400, "b": 7, "N": 1, "n`x": null}',
             '{"okf_type": 5, "n": 12345678901, "s": {"k": "\\ud800"}, "o": {"z": 1}}', '{"okf_type": "a", "o": {"z": 1}, "n": 0.00012345, "s": 1e7}', "{}", "[]", None, '{"okf_type": "a", "n": "1d", "b": "maybe", "o": 4}', '{"okf_type": "b", "n": ' + "9" * 400 + "}"]
    t = spark.createDataFrame([("a", None)], TREES)
    r = spark.createDataFrame([("a", f"p{i}", 1.0, x) for i, x in enumerate(texts)] + [("a", "p0", 0.5, "{"), ("a", "p1", None, None)], REF)
    f = spark.createDataFrame([("w", 1.0, texts[0], "a"), ("é", 1.0, texts[0], "a"), ("é", 2.0, texts[1], "a")], FILES)
    for given, several in ((t, r, f), (0, 3)), (tuple(spark.read.parquet(f"{small}/{n}.parquet") for n in ("ref_trees", "ref_files", "files")), (400,)):
        prepared, (values, types) = drift._prepared(*given), drift.unified(*given)
        for columns in several:
            wide, long = drift.typed_notes(*prepared, columns), drift.typed_table(values, types, columns)
            assert wide.columns == long.columns and [x.dataType for x in wide.schema] == [x.dataType for x in long.schema]
            plain = lambda df: sorted(repr([sorted(v.items()) if isinstance(v, dict) else v for v in x]) for x in df.collect())
            assert plain(wide) == plain(long)
    assert values.where("target = 'number' and not failed and value_number is null or target = 'boolean' and not failed and value_boolean is null").count() == 0


def test_path_statistics_hold_nested_members(spark):
    r = spark.createDataFrame([("a", "p", 1.0, '{"okf_type": "x", "o": {"k": 1, "l": [{"z": 1}], "n": null, "a/b": {}}}'), ("a", "q", 1.0, '{"okf_type": "x", "o": 3}')], REF)
    n = drift.notes_of(drift.latest_notes(r, spark.createDataFrame([], FILES)), deep=True)
    stats = {(x["name"], drift.KIND_ORDER[x["kind"]], x["n"]) for x in drift.path_statistics(n).collect()}
    assert stats == {("/okf_type", "string", 2), ("/o", "object", 1), ("/o", "number", 1), ("/o/k", "number", 1), ("/o/l", "array", 1), ("/o/a~1b", "object", 1)}


def test_filters_of_checked_size_lose_nothing(spark, monkeypatch):
    from vaultspark.operators import prefilter

    rows_, wanted = spark.range(5000).selectExpr("id", "cast(id as string) as s"), spark.range(0, 5000, 7).withColumn("s", F.col("id").cast("string"))
    for most in (1 << 26, 1 << 16, 64):
        monkeypatch.setattr(prefilter, "MOST", most)
        monkeypatch.setattr(prefilter, "LEAST", min(most, 1 << 16))
        kept = {x["id"] for x in prefilter.probably_in(rows_, wanted, "id", "s").collect()}
        assert set(range(0, 5000, 7)) <= kept and (len(kept) < 1200) == (most > 64)
        some, rest = (got(x) for x in prefilter.split_by(rows_, wanted, "id", "s"))
        assert not some & rest and len(some | rest) == 5000 and {(i, str(i)) for i in range(0, 5000, 7)} <= some
    assert prefilter.probably_in(rows_, wanted.where("false"), "id").count() == 0


def brute_sessions(events, gap):
    by = defaultdict(list)
    for k, us in events:
        if k is not None and us is not None:
            by[k].append(us)
    out = set()
    for k, x in by.items():
        x.sort()
        start, n = x[0], 1
        for a, b in zip(x, [*x[1:], None]):
            if b is None or b - a > gap:
                out.add((k, start, a, n))
                start, n = b, 0
            n += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, rng.randint(-3000, 3000), rng.randint(-30, 30) * 100])) for _ in range(900)]
    df = spark.createDataFrame([(k, us, rng.choice(["x", "y", None])) for k, us in events], "k string, us long, tool string").withColumn("t", F.lit(1)).withColumn("n", F.lit(1))
    s = sessions.sessions(df, "k", gap_us=100)
    assert got(s.select("k", "start_us", "end_us", "n_calls")) == brute_sessions(events, 100)
    assert s.where("n_calls <> aggregate(map_values(by_label), 0L, (a, x) -> a + x) or duration_us <> end_us - start_us").count() == 0
    assert sessions.sessions(df.limit(0), "k").count() == 0


def test_instants(spark):
    from vaultspark.functions.times import instant_us

    texts = {"2017-01-02T00:00:01Z": 1483315201000000, "2017-01-02 00:00:01.5": 1483315201500000, "2017-01-02T05:45:01+05:45": 1483315201000000, "2017-01-02T05:45:01.000001+0545": 1483315201000001, "2017-01-01T16:00:01-0800": 1483315201000000, "1483315201": 1483315201000000, "1483315201.25": 1483315201250000, "1483315201000": 1483315201000000, " 1483315201 ": 1483315201000000}
    none = ["", "n/a", "2017-01-02", "2017-13-02T00:00:00", "2017-02-30T00:00:00Z", "2017-01-08T25:61:00", "0000-00-00T00:00:00Z", "148331520", "14833152010000", "2017-01-02T00:00:01+5", None]
    df = spark.createDataFrame([(t,) for t in [*texts, *none]], "ts string")
    assert {r["ts"]: r["us"] for r in df.select("ts", instant_us(F.col("ts")).alias("us")).collect()} == texts | dict.fromkeys(none)


def test_calls_count_once(spark):
    c = [(1, " A ", "2017-01-02T00:00:01Z", 1, "t"), (1, "a", "1483315201", 2, "t"), (2, "a", "x", 1, "t"), (3, "  ", "1483315201", 1, "t"), (4, None, "1483315201", 1, "t"), (None, "a", "1483315201", 1, None), (None, "a", "1483315201", 1, None)]
    df = spark.createDataFrame(c, "call_id long, conversation_id string, ts string, r long, tool string").withColumn("received_at", F.timestamp_seconds("r"))
    assert sorted(tuple(r)[1:] for r in sessions.calls_once(df).collect() if r["call_id"]) == [("a", "t", 1483315201000000)]
    assert sessions.calls_once(df).count() == 3
