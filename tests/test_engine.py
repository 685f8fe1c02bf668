"""The engine's own operators on hand-made notes."""

import json
import re
import subprocess
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vaultspark.api import Engine
from vaultspark.functions import text as tx
from vaultspark.operators import browse, mutate, rules, search, telemetry, versions
from vaultspark.operators import predicates as pr
from vaultspark.parse import markdown as md
from vaultspark.parse import mermaid
from vaultspark.parse.patch import patch
from vaultspark.sources import formats, vault
from vaultspark.streaming import debounce, reindex

VALUES = {"gone": {}, "null": {"v": None}, "true": {"v": True}, "one": {"v": 1}, "five": {"v": 5}, "five0": {"v": 5.0}, "frac": {"v": 2.5}, "text5": {"v": " 5 "}, "word": {"v": "Open"}, "list": {"v": ["Open", 5]}, "maps": {"v": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}, "map": {"v": {"id": "a"}}, "empty": {"v": []}}
CONDITIONS = [
    (True, {"true", "one"}), (1, {"true", "one"}), (5, {"five", "text5", "list"}), (5.0, {"five0"}), ("5", {"five", "list"}), (" 5 ", {"five", "text5", "list"}), ("Open", {"word", "list"}), ("open", set()), (2.5, {"frac"}),
    ({"$exists": True}, set(VALUES) - {"gone", "null"}), ({"$exists": False}, {"gone", "null"}), ({"$eq": "Open"}, {"word", "list"}),
    ({"$ne": "Open"}, set(VALUES) - {"gone", "null", "word", "list"}), ({"$contains": "OPE"}, {"word"}), ({"$contains": "Open"}, {"word", "list"}), ({"$contains": 5}, {"list", "text5"}),
    ({"$in": ["Open", 2.5]}, {"word", "frac", "list"}), ({"$in": []}, set()), ({"$elemMatch": {"id": "a", "n": {"$gte": 1}}}, {"maps"}), ({"$elemMatch": {"id": "b", "n": {"$gte": 0}}}, set()), ({"$elemMatch": {}}, set()),
    ({"$gte": 5}, {"five", "five0", "text5", "word", "list", "maps", "map", "empty"}), ({"$lt": 5}, {"true", "one", "frac"}), ({"$gt": 1, "$lt": 3}, {"frac"}), ({"$gt": "N"}, {"word", "list", "maps", "map", "empty", "true"}), ({"$near": 1}, set()),
]


def test_condition_matrix(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in VALUES.items()], "name string, j string").select("name", F.parse_json("j").alias("fm")).cache()
    wrong = {}
    for condition, want in CONDITIONS:
        have = {r["name"] for r in df.where(pr.where(F.col("fm"), {"v": condition})).collect()}
        if have != want:
            wrong[str(condition)] = have ^ want
    # Texts of lists and maps order after letters in JSON; only scalars are promised for ranges.
    assert all(set(w) <= {"list", "maps", "map", "empty", "true", "word"} and ("$g" in c or "$l" in c) for c, w in wrong.items()), wrong


def test_paths(spark):
    note = {"todos": [{"id": "x", "s": "open", "n": None}, {"id": "y", "s": "done"}, 3], "m": {"k": [1, 2]}}
    fm = spark.createDataFrame([(json.dumps(note),)], "j string").select(F.parse_json("j").alias("fm"))
    holds = lambda **w: fm.where(pr.where(F.col("fm"), {k.replace("__", "."): v for k, v in w.items()})).count() == 1
    assert holds(todos__s="done") and holds(todos__0__s="open") and not holds(todos__1__s="open") and holds(m__k=2)
    check = lambda key, c: fm.where(pr.where(F.col("fm"), {key: c})).count() == 1
    assert check("todos[id=y].s", "done") and not check("todos[id=y].s", "open")
    assert check("todos.n", {"$exists": True}) and not check("todos.zz", {"$exists": True}) and check("m.k.9", {"$exists": False})
    assert not check("a..b", 1) and check("a..b", {"$exists": False})
    with pytest.raises(ValueError):
        pr.parse_path("")


def test_globs_and_sort(spark):
    df = spark.createDataFrame([("a/b.md",), ("a/_d/c.md",), ("x.md",), ("a[1].md",)], "path string")
    has = lambda test: {r["path"] for r in df.where(test).collect()}
    p = F.col("path")
    assert has(pr.excluded(p, ["a/*"])) == {"a/b.md", "a/_d/c.md"} and has(pr.excluded(p, ["*/_d/*", "?.md"])) == {"a/_d/c.md", "x.md"} and has(pr.excluded(p, ["a[[]1[]].md"])) == {"a[1].md"}
    assert has(rules.first_rule(p, ["a/*", "**/*.md"]) == 0) == {"a/b.md"} and has(pr.in_folder(p, "/a/")) == {"a/b.md", "a/_d/c.md"} and has(pr.in_folder(p, "A", True)) == {"a/b.md", "a/_d/c.md"}
    assert pr.effective_exclude(None, {"default_exclude": ["d"], "folder_exclude": [{"folder": "a", "exclude": ["x"], "unless_query": ["raw"]}]}, "a/b", "q") == ["x"]
    assert pr.effective_exclude(None, {"default_exclude": ["d"], "folder_exclude": [{"folder": "a", "exclude": ["x"], "unless_query": ["raw"]}]}, "a", "RAW q") == ["d"] and pr.effective_exclude([], {"default_exclude": ["d"]}, "", "") == []
    n = spark.createDataFrame([(k, float(i), json.dumps(v)) for i, (k, v) in enumerate(VALUES.items())], "path string, mtime double, frontmatter string")
    order = [r["path"] for r in pr.filter_notes(pr.catalog(n), sort="v", order="asc").collect()]
    assert set(order[-2:]) == {"gone", "null"} and order.index("one") < order.index("frac") < order.index("five")
    page = pr.filter_notes(pr.catalog(n), {"v": {"$exists": True}}, limit=3, offset=2, fields=["v", "w"]).collect()
    assert len(page) == 3 and all(set(json.loads(r["frontmatter"])) == {"v"} for r in page)
    for bad in ({"order": "up"}, {"sort": "a b"}):
        with pytest.raises(ValueError):
            pr.sort_columns(**bad)


NOTE = "---\ntitle: My note\nd: 2017-00-00\n---\nintro\n\n# Alpha\ntext [[b|B]] and [[folder/B.md]]\n### Gamma\n| Date | Miles \\| km |\n| :-- | --: |\n| 1 | a \\| b |\n| 2 |\n```\n# no\n| x |\n|---|\n```\n# Beta\n```mermaid\nflowchart LR\nsubgraph s [\"Group\"]\nA[One] -->|go| B\nend\n```\n"


def test_parsers():
    s = md.sections(NOTE)
    assert [(x["heading"], x["level"], x["start_line"]) for x in s] == [("", 0, 5), ("Alpha", 1, 7), ("Alpha › Gamma", 3, 9), ("Beta", 1, 19)] and s[1]["end_line"] == 18
    (t,) = md.tables(NOTE.split("\n"))
    assert t["headers"] == ["Date", "Miles | km"] and t["rows"] == [["1", "a | b"], ["2", ""]] and t["aligns"] == ["left", "right"]
    assert md.tables(md.render_table(t["headers"], t["rows"], t["aligns"]).split("\n"))[0] | {"start": 0, "end": 0} == t | {"start": 0, "end": 0}
    kinds = [c["chunk_kind"] for c in md.chunks(NOTE, "x/n.md")]
    assert kinds == ["section"] * 4 + ["table_header", "table_row", "table_row", "mermaid_file", "mermaid_header", "mermaid_node", "mermaid_node", "mermaid_edge"]
    row = md.chunks(NOTE, "x/n.md")[5]
    assert row["text"] == "My note > Alpha > Gamma — Date: 1, Miles | km: a | b" and row["row_key"] == "1" and row["parent_chunk_hash"] == md.chunks(NOTE, "x/n.md")[2]["chunk_hash"]
    assert json.loads(md.frontmatter_json(NOTE)) == {"title": "My note", "d": "2017-00-00"} and md.frontmatter_json("no") is None and md.frontmatter_json("---\n---\n") == "{}" and md.frontmatter_json("a: [", "x.yaml") is None
    assert md.sections("") == [] and md.chunks(None, "") == [] and md.collapse_tables("a\n|x|y|\n|-|-|\n|1|2|") == "a\n[table: 1 row — x, y]"
    d = mermaid.parse('sequenceDiagram\nparticipant A as "Al"\nA->>B: hi')
    assert d["nodes"][0][:2] == ("A", "Al") and d["edges"][0][:3] == ("A", "B", "hi")
    assert mermaid.parse("flowchart\nA[x] --> B[y]", inline_labels=False)["edges"] == [] and mermaid.parse("flowchart\n-->")["error"]
    assert md.read_csv("a,b\n\n1\n") == (["a", "b"], [["1", ""]]) and md.read_json_table('[{"a":1},{"b":2}]') == (["a", "b"], [["1", ""], ["", "2"]])
    assert md.fuzzy_headers(["Milage", "zzz"], ["Mileage", "Date"]) == {"Milage": "Mileage", "zzz": None}


def test_patches():
    one = lambda *ops, strict=True: patch(NOTE, list(ops), strict)
    text, res = one({"op": "set_field", "field": "a.b", "value": 1}, {"op": "delete_field", "field": "d"}, {"op": "update_cell", "row_key": "2", "column": "miles KM", "value": "x|y"}, {"op": "append", "heading": "Alpha", "text": "more"})
    assert res == ["ok"] * 4 and "a:\n  b: 1" in text and "d:" not in text.split("---")[1] and "x\\|y" in text and text.index("more") < text.index("# Beta")
    assert one({"op": "replace_text", "old": "intro", "new": "new"})[0].count("new") == 1 and one({"op": "replace_text", "old": "zz", "new": ""})[1] == ["text_not_found"]
    assert one({"op": "delete_row", "row_key": "9"}, {"op": "append_eof", "text": "end"}) == (NOTE, ["row_not_found", "ok"]) and one({"op": "delete_row", "row_key": "9"}, {"op": "append_eof", "text": "end"}, strict=False)[0].endswith("end\n")
    assert one({"op": "alter_table_schema", "rename": {"Date": "Day"}})[1] == ["confirm_required"] and "| Day |" in one({"op": "alter_table_schema", "rename": {"Date": "Day"}, "add": ["N"], "confirm": True})[0]
    up = one({"op": "replace_table", "mode": "upsert", "rows": [["2", "u"], ["3", "v"], ["3", "w"]]})[0]
    assert md.tables(up.split("\n"))[0]["rows"] == [["1", "a | b"], ["2", "u"], ["3", "w"]]
    assert one({"op": "replace_section", "heading": "### Gamma", "text": "short"})[1] == ["ok"] and one({"op": "append", "heading": "nowhere", "text": "x"})[1] == ["anchor_not_found"] and one({"nothing": 1})[1] == ["invalid_op"]
    assert one({"op": "update_row", "row_key": "1", "values": {"Date": "5"}, "expected_row_hash": "no"})[1] == ["stale_row"]


def test_notes_as_dataframes(spark, tmp_path):
    root = tmp_path / "vault"
    for name, text in {"a/n.md": NOTE, "a/_u.md": "see [[n]]", ".hid/b.md": "# B\n[[zz]]", ".git/x.md": "x", "c.yaml": "title: C\nn: 1", "skip/d.md": "d", "e.txt": "e"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".indexignore").write_text("# c\nskip/*\n")
    e = Engine.from_folder(spark, str(root), filesPerTask="2")
    assert {r["path"] for r in e.notes.collect()} == {"a/n.md", "a/_u.md", ".hid/b.md", "c.yaml"}
    assert [r["path"] for r in e.filter_notes({"title": {"$exists": True}}, sort="title", order="asc").collect()] == ["c.yaml", "a/n.md"]
    assert e.stats().first()["n_notes"] == 4 and e.search("Gamma miles", 3).count() == 3 and e.search("Gamma miles", 3, folder="nowhere").count() == 0
    assert [r["source"] for r in e.backlinks("a/n.md").collect()] == ["a/_u.md"] and e.read("a/n.md", 5, 5).first()["text"] == "intro" and e.read("a/n.md", heading="gamma").count() == 1
    assert {(r["key"], r["state"]) for r in browse.link_states(browse.links(e.notes), e.notes).collect()} >= {("zz", "broken"), ("n", "ok"), ("b", "ok")}
    chunk = e.toc("a/n.md").collect()
    assert [r["heading"] for r in chunk] == ["", "Alpha", "Alpha › Gamma", "Beta"] and e.read_chunk(e.chunks.where("ord = 1 and path = 'a/n.md'").first()["chunk_hash"]).first()["total"] == 12
    assert e.history(2).count() == 2 and e.lint(folders=["a"]).where("code = 'broken_link'").count() >= 1
    edits = spark.createDataFrame([("a/_u.md", '[{"op":"append_eof","text":"x"}]', None), ("c.yaml", '[{"op":"set_field","field":"n","value":2}]', "stale"), ("q.md", "[]", None), ("a/n.md", "no json", None)], "path string, ops string, expected string")
    out = {r["path"]: (r["results"], r["changed"]) for r in e.patch(edits).collect()}
    assert out == {"a/_u.md": (["ok"], True), "c.yaml": (["stale"], False), "q.md": (["missing"], False), "a/n.md": (["invalid_op"], False)}
    done = {r["status"]: r["n"] for r in vault.write_notes(e.notes.select("path", "text").unionByName(spark.createDataFrame([("../x.md", "x"), (None, "x")], "path string, text string")), str(tmp_path / "out")).collect()}
    assert done == {"written": 4, "skipped": 2} and (tmp_path / "out/a/n.md").read_text() == NOTE
    merged = mutate.merge_notes(*[spark.createDataFrame([("p", t)], "path string, text string") for t in ("# A\n1\n# B\n2", "# A\n9\n# B\n2", "# A\n1\n# B\n3")])
    assert {r["state"] for r in merged.collect()} == {"ours", "theirs"}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "é.md").write_text("# A")
    (tmp_path / "b.md").write_text("# A")
    run("add", "."), run("commit", "-m", "one")
    (tmp_path / "b.md").write_text("---\nt: 1\n---\n")
    run("commit", "-am", "two"), run("tag", "v1")
    t = {r["path"]: r["text"] for r in vault.read_tree(spark, str(tmp_path), "main").collect()}
    assert t == {"é.md": "# A", "b.md": "---\nt: 1\n---\n"} and vault.list_refs(spark, str(tmp_path)).count() == 2 and vault.file_log(spark, str(tmp_path), "b.md").count() == 2
    assert Engine.from_git(spark, str(tmp_path), "main~1").catalog.count() == 0
    with pytest.raises(ValueError):
        vault.resolve_ref(str(tmp_path), "--x")


def test_incremental_index(spark, tmp_path):
    incoming, index, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    go = lambda: reindex.run(spark, incoming, index, state, buckets=4).awaitTermination()
    reindex.enqueue(incoming, [{"op": "index", "path": f"{p}.md", "ts": "2020-01-01T00:00:00Z", "text": f"# {p}\nsame"} for p in "abc"] + [{"op": "index", "path": "x.tmp", "ts": "2020-01-01T00:00:00Z", "text": "x"}])
    go()
    assert {r["path"] for r in spark.read.parquet(index).collect()} == {"a.md", "b.md", "c.md"}
    reindex.enqueue(incoming, [{"op": "index", "path": "a.md", "ts": "2020-01-02T00:00:00Z", "text": "# a\nnew\n# more"}, {"op": "purge", "path": "b.md", "ts": "2020-01-02T00:00:00Z", "text": None}, {"op": "index", "path": "c.md", "ts": "2020-01-02T00:00:00Z", "text": " "}])
    go()
    assert sorted((r["path"], r["heading"]) for r in spark.read.parquet(index).collect()) == [("a.md", "a"), ("a.md", "more")]


def test_streamed_debounce_equals_the_batch(spark, tmp_path):
    rows = [{"op": "index", "path": p, "ts": f"2020-01-01T00:00:{s:02d}Z", "text": ""} for p, ss in (("a", (0, 1, 5)), ("b", (2,))) for s in ss]
    reindex.enqueue(str(tmp_path / "in"), rows)
    reindex.enqueue(str(tmp_path / "in"), [{"op": "index", "path": "last", "ts": "2020-01-02T00:00:00Z", "text": ""}])
    reindex.debounced(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = debounce.quiet_periods(spark.read.schema(reindex.CHANGE).json(str(tmp_path / "in")).where("path <> 'last'"), "path", "ts", "2 seconds")
    stream = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, stream.where("path <> 'last'").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 3


def test_versions(spark):
    kv = lambda **x: spark.createDataFrame(list(x.items()), "key string, value string")
    assert set(map(tuple, versions.difference(kv(a="1", b="2", n=None), kv(b="3", c="1", n=None), "key", "value").collect())) == {("a", "removed"), ("b", "changed"), ("c", "added")}
    m = {r["key"]: (r["value"], r["state"]) for r in versions.three_way(kv(s="1", o="1", t="1", c="1", do="1", dt="1", dd="1", n=None), kv(s="2", o="2", t="1", c="2", dt="1", ao="1", ac="1", n=None), kv(s="2", o="1", t="2", c="3", do="1", at="1", ac="2", n=None)).collect()}
    assert m == {"s": ("2", "same"), "o": ("2", "ours"), "t": ("2", "theirs"), "c": (None, "conflict"), "do": (None, "conflict"), "dt": (None, "conflict"), "ao": ("1", "ours"), "at": ("1", "theirs"), "ac": (None, "conflict"), "n": (None, "same")}
    new = spark.createDataFrame([("a", "9", 1), ("a", "8", 2), ("z", "7", 1)], "key string, value string, o int")
    assert set(map(tuple, versions.upsert(kv(a="1", b="2"), new, "key", "o").collect())) == {("a", "8"), ("b", "2"), ("z", "7")}
    c = spark.createDataFrame([("p", "h", [1.0]), ("p", "i", None), ("q", "h", [float("nan")])], "path string, content_hash string, embedding array<double>")
    assert versions.drop_failed(c).count() == 0 and versions.drop_failed(c.limit(1)).count() == 1 and versions.reuse(c.select("path", "content_hash"), c.limit(1)).where("embedding is not null").count() == 1


def test_search_edges(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None), (4, ""), (5, "Béta_alpha")], "doc_id long, text string")
    ids = lambda df: [r["doc_id"] for r in df.collect()]
    assert ids(search.bm25(d, "alpha beta")) == [1, 5] and ids(search.bm25(d, "? !")) == [] and set(ids(search.bm25(d, "alpha beta gamma"))) == {1, 2, 5}
    assert len(ids(search.hybrid(d, "alpha", lexical_only=True))) == 3 and len(ids(search.hybrid(d, "alpha", vector_only=True, k=2))) == 2
    assert ids(search.fan_out([search.hybrid(d, "alpha", 2), search.hybrid(d, "beta", 2)], 1, id="doc_id")) and search.pools(5, True, False, 10_000) == (500, 64)
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)] + [(9, None)], "vec_id long, embedding array<double>")
    near = {r["query_id"]: r["vec_id"] for r in search.knn_many(v, v, 1, block=2).where("rank = 1").collect()}
    assert near == {0: 1, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4} and search.knn_many(v.limit(0), v, 1).count() == 0


def test_edge_chunks_with_ties(spark, small):
    c = [("a", 3, 1), ("a", 2, 1), ("a", 9, 7), ("a", 8, 7), ("b", 5, 1), ("b", 4, 1), ("c", 7, None), ("c", 6, None), ("d", 1, None), ("d", 2, 5)]
    df = spark.createDataFrame(c, "path string, chunk_id long, ord int")
    for which, want in (("first", {("a", 2), ("b", 4), ("c", 6), ("d", 2)}), ("last", {("a", 9), ("b", 5), ("c", 7), ("d", 2)})):
        assert {(r["path"], r["chunk_id"]) for r in browse.edge_chunks(df, which).collect()} == want
    by_hash = df.withColumn("chunk_hash", F.col("chunk_id").cast("string")).drop("chunk_id")
    assert {(r["path"], r["chunk_hash"]) for r in browse.edge_chunks(by_hash).collect()} == {("a", "2"), ("b", "4"), ("c", "6"), ("d", "2")}
    best = {}
    for r in spark.read.parquet(f"{small}/hits.parquet").collect():
        best.setdefault(r["path"], set()).add((r["start_line"], r["hit_id"]))
    for name, pick in (("first_chunk_all", min), ("last_chunk_all", max)):
        assert {(r["path"], r["ord"], r["chunk_id"]) for r in entry.queries()[name](spark, small).collect()} == {(p, *pick(x)) for p, x in best.items()}


def test_infinite_durations_count_as_calls(spark, tmp_path):
    inf = float("inf")
    c = [("a", True, 2.0, 10), ("a", False, inf, 40), ("a", None, None, 10), ("b", True, -inf, 7), ("a", True, float("nan"), 0)]
    spark.createDataFrame([(*x, True, None, True, False) for x in c], "tool string, ok boolean, duration_ms double, req_bytes int, expected_mtime_set boolean, fields_set boolean, folder_set boolean, used_alias boolean").withColumn("resp_bytes", F.lit(1)).write.parquet(f"{tmp_path}/tool_calls.parquet")
    got = {r["tool"]: (r["calls"], r["ok"], r["error"], r["avg_duration_ms"], r["avg_req_bytes"], r["folder_set"]) for r in entry.queries()["calls_by_tool_all"](spark, str(tmp_path)).collect()}
    assert got == {"a": (4, 2, 2, round(2 / 3, 6), 15.0, 4), "b": (1, 1, 0, None, 7.0, 1)}


def plain_clean(text):
    """undecorated() line by line."""
    for pattern, to in ((r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("\\*\\*([^\n\r\x85\u2028\u2029]+?)\\*\\*", r"\1"), (r"(?<!\*)\*([^*\n]+?)\*(?!\*)", r"\1")):
        text = re.sub(pattern, to, text)
    parts = LINE_END.split(text)
    for pattern, to in ((r"\A#{1,6}[ \t]+", ""), (r"\A([ \t]*)[-*+][ \t]+", r"\1"), (r"\A>[ \t]?", "")):
        parts[::2] = [re.sub(pattern, to, x) for x in parts[::2]]
    return "".join(parts)


LINE_END = re.compile("(\r\n|[\n\r\x85\u2028\u2029])")


def test_texts_as_they_are(spark, small, tmp_path):
    texts = ["*it* and **bold** \r\n# H \t\r\n- *x* y\n> q", "a \r\nb\t\rc \x85d \u2028e \u2029f ", "a*b*c ** d", "", None, "x  ", "* l\r\n* m *n*", "[t](u) *i*\u2028- l"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), small):
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None}
        ends = {k: sum(x.endswith((" ", "\t")) for x in LINE_END.split(t)[::2]) for k, t in docs.items()}
        assert {r["doc_id"]: r["n"] for r in entry.queries()["trailing_ws_all"](spark, folder).collect()} == {k: n for k, n in ends.items() if n}
        assert {r["doc_id"]: r["h"] for r in entry.queries()["text_clean_all"](spark, folder).collect()} == {k: md5(plain_clean(t).encode()).hexdigest() for k, t in docs.items()}


def test_telemetry_edges(spark):
    schema = "tool string, ok boolean, error string, error_shape string, duration_ms double, req_bytes int, resp_bytes int, expected_mtime_set boolean, fields_set boolean, folder_set boolean, used_alias boolean, ts string, collection string, note_path string, chunk_hash string, flaws_emitted int, flaws_auto_fixed int, call_id long"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(None, None, None, '["a", "", "b"]', None, None, None, None, True, None, None, "x", None, " ", None, None, None, 1)], schema)
    assert telemetry.by_tool(one).first()["tool"] == "?" and telemetry.by_error(one).first()["error"] == "error" and telemetry.by_day(one).first()["day"] == "?" and telemetry.by_error_shape(one).count() == 2 and telemetry.by_path(one).count() == 0
    assert telemetry.ratios(none).first()["calls"] == 0 and telemetry.by_tool(none).count() == 0 and telemetry.flag_totals(none).count() == 4
    with pytest.raises(ValueError):
        telemetry.private_paths(one, "all")
    args = spark.createDataFrame([('{"top_k": 3, "folder": "", "ops": [1, 2], "fields": null, "chunk_hash": "x"}', "t"), ('{"text": "x"}', "write_note"), ("{}", None)], "a string, tool string")
    flags = [tuple(r["f"]) for r in args.select(telemetry.argument_flags(F.parse_json("a"), F.col("tool")).alias("f")).collect()]
    assert flags == [(True, False, True, False, False, 2), (True, False, False, False, False, None), (False, False, False, False, False, None)]


def test_links_lead_to_the_first_candidate(spark):
    n = spark.createDataFrame([("a/x.md", "[[y]] [[z]] [[f]] [[none]]"), ("a/y.md", ""), ("y.md", ""), ("a/z.md", ""), ("f/f.md", None)], "path string, text string")
    got = {r["key"]: r["target"] for r in browse.resolved_links(browse.links(n), n).collect()}
    assert got == {"y": "y.md", "z": "a/z.md", "f": "f/f.md", "none": None}


def test_text_functions(spark):
    d = spark.createDataFrame([("a  b [x](u) **bo** *it*\n## H\n> q\n- l",)], "t string")
    v = lambda c: d.select(c.alias("v")).first()["v"]
    assert v(tx.undecorated(F.col("t"))) == "a  b x bo it\nH\nq\nl" and v(tx.cut_at_word(F.lit("abc def"), 5)) == "abc" and v(tx.cut_at_word(F.lit("abcdef"), 3)) == "abc" and v(tx.cut_at_word(F.lit("ab"), 0)) == "ab"
    assert v(tx.with_suffix(F.lit("./a\\b"))) == "a/b.md" and v(tx.title(F.lit(" "), F.lit("x/my-note_1.md"))) == "my note 1" and v(tx.first_heading(F.lit("x\n# T  \n"))) == "T" and v(tx.folder_key(F.lit("a/b/c/d.md"))) == "a/b" and v(tx.folder_key(F.lit("d.md"))) == "."
    assert v(tx.body_line(F.lit("---\na: 1\n---\nx"))) == 4 and v(tx.without_trailing_blanks(F.lit("a \nb\t\n\n"))) == "a\nb\n" and v(tx.lines_between(F.lit("1\n2\n3"), 2, 3)) == "2\n3"
    assert [tuple(x)[:3] for x in v(tx.wikilinks(F.lit("[[A.md#h|t]]\r\nx [[f/B]] [[ ]]")))] == [(1, "a", "a"), (2, "f/b", "b")]
    assert v(formats.blake2b(F.lit("a"))) == md.content_hash("a")


def test_every_query_has_a_stable_schema(spark, small):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and entry.entry(spark).count() > 0
    for name, f in queries.items():
        if name not in ("p1_table", "stream_debounce_available_now"):
            assert f(spark, small).columns, name


def test_stored_index_finds_what_a_scan_finds(spark, tmp_path):
    notes = spark.createDataFrame([(f"{'mermaid-catalog' if i % 2 else 'p'}/n{i}/diagram.mmd" if i % 5 == 0 else f"p/n{i}.md", float(i), f"# Note {i}\nsensor {'kiln ' * (i % 4)}x{i}") for i in range(12)], "path string, mtime double, text string")
    scan, stored = Engine(notes), Engine(notes)
    stored.build_index(str(tmp_path / "index"))
    for query, options in (("sensor kiln", {}), ("kiln", {"offset": 2}), ("sensor", {"folder": "p"}), ("sensor", {"exclude": ["p/n1*"]}), ("diagram note", {"folder": "mermaid-catalog"}), ("nowhere", {})):
        want = [tuple(r) for r in scan.search(query, 3, **options).collect()]
        assert [tuple(r) for r in stored.search(query, 3, **options).collect()] == want
    again = Engine(notes)
    again.open_index(str(tmp_path / "index"))
    assert [r["path"] for r in again.search("kiln", 2).collect()] == [r["path"] for r in scan.search("kiln", 2).collect()]


def test_index_of_odd_texts(spark, tmp_path):
    from vaultspark.operators.index import SearchIndex, term_counts

    rows = [(1, None), (2, ""), (3, "a a B é e"), (4, "b " * 3000 + "a"), (5, "!!!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["dl"], r["term"], r["tf"]) for r in term_counts(d, "text", "doc_id").collect()} == {(3, 5, "a", 2), (3, 5, "b", 1), (3, 5, "e", 2), (4, 3001, "a", 1), (4, 3001, "b", 3000)}
    i = SearchIndex.build(d, str(tmp_path / "i"))
    assert i.part("statistics").first()["n_docs"] == 5 and {r["id"] for r in i.part("vectors").collect()} == {2, 3, 4, 5}
    for q in ("ee bb", "aa", "", "é"):
        assert i.bm25(q).collect() == search.bm25(d, q).collect()
    assert SearchIndex.build(d.where("false"), str(tmp_path / "none")).hybrid("aa bb").count() == 0


def test_reconcile_and_rebuild(spark, tmp_path):
    index = str(tmp_path / "index")
    notes = spark.createDataFrame([("a.md", "# A\nx"), ("b.md", "# B\ny"), ("c.md", "")], "path string, text string")
    assert {(r["op"], r["path"]) for r in reindex.reconcile(notes, index).collect()} == {("index", "a.md"), ("index", "b.md")}
    reindex.index_batch(reindex.reconcile(notes, index), index, buckets=4)
    assert reindex.reconcile(notes, index).count() == 0
    later = spark.createDataFrame([("a.md", "# A\nx"), ("b.md", "# B\nz"), ("d.md", "# D")], "path string, text string")
    changes = reindex.reconcile(later.where("path <> 'a.md'"), index)
    assert {(r["op"], r["path"]) for r in changes.collect()} == {("purge", "a.md"), ("index", "b.md"), ("index", "d.md")}
    batch = changes.unionByName(spark.createDataFrame([("rebuild", None, None, None)], reindex.CHANGE))
    reindex.index_batch(batch, index, buckets=4, notes=lambda: later)
    assert {r["path"] for r in spark.read.parquet(index).select("path").distinct().collect()} == {"a.md", "b.md", "d.md"}
    assert reindex.reconcile(later, index).count() == 0


def test_diagrams_by_a_scanner():
    d = mermaid.parse("graph TD\nsubgraph s1 [\"The group\"]\nA[[q]] ---|a b| B((x))\nC[(db)] === D{y}\nend\nsubgraph two\nE ----> F>flag]\nG -- H\nI --> J --> K\nL[open\nend\n%% M --> N\nP")
    assert [(n[0], n[1], n[2]) for n in d["nodes"]] == [("A", "q", "The group"), ("B", "x", "The group"), ("C", "db", "The group"), ("D", "y", "The group"), ("E", "E", "two"), ("F", "flag", "two"), ("G", "G", "two"), ("H", "H", "two"), ("P", "P", "")]
    assert [e[:3] for e in d["edges"]] == [("A", "B", "a b"), ("C", "D", ""), ("E", "F", ""), ("G", "H", "")] and d["groups"] == ["The group", "two"] and d["direction"] == "TD"
    s = mermaid.parse("sequenceDiagram\nparticipant A as \"Al\"\nparticipant b-c\nA->>b-c: one: two\nb-c --> A\nx y->z\nparticipant d as")
    assert [e[:3] for e in s["edges"]] == [("A", "b-c", "one: two"), ("b-c", "A", "")] and [n[:2] for n in s["nodes"]] == [("A", "Al"), ("b-c", "b-c")]


def test_backlinks_of_shared_names(spark):
    l = spark.createDataFrame([("s1.md", 1, "readme", "readme", "t"), ("s1.md", 1, "readme", "readme", "t"), ("s2.md", 2, "a/readme", "readme", "t"), ("a/readme.md", 3, "readme", "readme", "t"), (None, 1, "readme", "readme", "t"), ("s1.md", 4, "x.txt", "x.txt", "t"), ("s1.md", 5, "x", "x", "t")], "source string, line int, key string, stem string, text string")
    n = spark.createDataFrame([("a/readme.md",), ("b/readme.md",), ("x.txt",), ("lone.md",), (None,)], "path string")
    assert {tuple(r) for r in browse.backlink_counts(l, n).collect()} == {("a/readme.md", 2, 2), ("b/readme.md", 3, 3), ("x.txt", 2, 1)}


def test_guards_and_whole_writes(spark):
    text = "---\nt: 1\n---\n# A\nx\n# B\ny\n"
    n = spark.createDataFrame([("a.md", 5.0, text), ("b.md", 5.0, None)], "path string, mtime double, text string")
    h = n.where("path = 'a.md'").select(mutate.region_hashes("text").alias("r")).first()["r"]
    assert [s["heading"] for s in h["sections"]] == ["A", "B"] and h["frontmatter"] != h["body"]
    cases = {
        "free": (None, None, None, None, None), "same mtime": (5.0004, "no", None, None, None), "mtime": (6.0, None, None, None, None), "front": (6.0, h["frontmatter"], None, None, None), "body": (None, None, h["body"], None, None),
        "wrong body": (None, h["frontmatter"], "no", None, None), "section": (6.0, None, None, "B", h["sections"][1]["hash"]), "other section": (6.0, None, None, "A", h["sections"][1]["hash"]), "no section": (6.0, None, None, "C", "no"),
    }
    w = spark.createDataFrame([(k, "a.md", *v) for k, v in cases.items()] + [("gone", "z.md", 1.0, None, None, None, None), ("new", "z.md", None, None, None, None, None)], "k string, path string, expected_mtime double, expected_frontmatter string, expected_body string, heading string, expected_section string")
    good = {"free", "same mtime", "front", "body", "section", "new"}
    assert {r["k"]: r["state"] for r in mutate.guarded(n, w).collect()} == {k: "ok" if k in good else "missing" if k == "gone" else "stale" for k in [*cases, "gone", "new"]}
    writes = w.select(F.when(F.col("k") == "new", "z").otherwise(F.col("path")).alias("path"), F.when(F.col("k") == "new", "n").otherwise("new").alias("text"), "expected_mtime", "expected_frontmatter", "expected_body", "heading", "expected_section", "k")
    one = lambda k: [tuple(r) for r in mutate.write_whole(n, writes.where(F.col("k") == k).drop("k")).collect()]
    assert one("free") == [("a.md", "new", "replaced")] and one("mtime") == [("a.md", text, "stale")] and one("new") == [("z.md", "n", "created")]
    parts = spark.createDataFrame([("t: 1", [("A", 1, "x\n"), (None, None, "free"), ("B", 9, None)], " intro "), (None, None, None), ("", [], "b")], "f string, s array<struct<heading:string,level:int,text:string>>, b string")
    assert [r[0] for r in parts.select(mutate.assembled(F.col("f"), F.col("s"), F.col("b"))).collect()] == ["---\nt: 1\n---\n\nintro\n\n# A\n\nx\n\nfree\n\n###### B\n", "", "b\n"]


def test_appended_notes(spark):
    n = spark.createDataFrame([("a.md", "# A\nx\n# B\ny\n"), ("b.md", "z")], "path string, text string")
    a = spark.createDataFrame([("a", "more", "A"), ("b.md", "more", None), ("c.md", "new\n\n", None), (None, "x", None), ("d.md", None, None)], "path string, text string, heading string")
    got = {r["path"]: (r["text"], r["result"]) for r in mutate.append_notes(n, a).collect()}
    assert got.keys() == {"a.md", "b.md", "c.md"} and got["c.md"] == ("new\n", "created") and got["a.md"][1] == got["b.md"][1] == "ok"
    assert got["a.md"][0].index("more") < got["a.md"][0].index("# B") and got["b.md"][0].startswith("z") and "more" in got["b.md"][0]
    assert mutate.append_notes(n, a, create=False).where("path = 'c.md'").first()["result"] == "missing"
    assert mutate.append_notes(n, spark.createDataFrame([("a.md", "x", "Nowhere")], a.schema)).first()["result"] == "anchor_not_found"


def test_references_and_tests_of_paths(spark):
    from vaultspark.functions import paths

    refs = {"v:a/b.md": ("v", "a/b.md", "ok"), " v : /a ": ("v", " /a", "ok"), "w:a": ("w", "a", "bad_vault"), "a/b:c": (None, "a/b:c", "plain"), "https://x:1": (None, "https://x:1", "plain"), "/v:a": (None, "/v:a", "plain"), ":a": (None, ":a", "plain"), "": (None, "", "plain")}
    d = spark.createDataFrame([(k,) for k in [*refs, None]], "r string")
    assert {x["r"]: None if x["p"] is None else tuple(x["p"]) for x in d.select("r", paths.note_reference(F.col("r"), ["v"]).alias("p")).collect()} == refs | {None: None}
    u = spark.createDataFrame([("note://v/a/b.md",), ("note://v/",), ("x",), (None,)], "u string").select(paths.note_uri(F.col("u")).alias("p")).collect()
    assert [x["p"] and tuple(x["p"]) for x in u] == [("v", "a/b.md"), None, None, None]
    p = spark.createDataFrame([(x,) for x in ("private/a.md", "privates/a.md", "x/secret.md", "deep/x/y.key", "./private/b", "a\\tmp\\b.md", "", None)], "p string")
    got = {x["p"] for x in p.where(paths.never_committed(F.col("p"), ["private/", "secret*", "**/*.key", "tmp/*", ""])).collect()}
    assert got == {"private/a.md", "x/secret.md", "deep/x/y.key", "./private/b", "a\\tmp\\b.md"}
