"""Problems 3, 6, 7, 8 and 9 against plain versions, and their odd inputs."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.brute import boundaries
from vaultspark.llm import packing, quantiles, queries, spans, splitting, tokenizer

HITS = "hit_id long, text string, start_line int, heading string"


def test_boundaries_and_pieces(spark, small):
    hits = {r["hit_id"]: r for r in spark.read.parquet(f"{small}/hits.parquet").collect()}
    want = {(k, r["start_line"] + b) for k, r in hits.items() if r["text"] and len(r["text"]) > 2000 for b in boundaries(r["text"])}
    got = [tuple(r) for r in queries.p3_found(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    check_pieces(hits, queries.p3_pieces(spark, small).collect(), 2000, 200)


def check_pieces(hits, rows, limit, overlap):
    by = defaultdict(list)
    for r in rows:
        by[r["hit_id"]].append(r)
    assert by.keys() == {k for k, r in hits.items() if r["text"] is not None}
    for k, x in by.items():
        x.sort(key=lambda r: r["piece"])
        text, start, at = hits[k]["text"], hits[k]["start_line"], 0
        assert [r["piece"] for r in x] == list(range(len(x)))
        for i, r in enumerate(x):
            at -= overlap if i else 0
            assert r["text"] == text[at : at + len(r["text"])] and len(r["text"]) <= limit and r["heading"] == hits[k]["heading"]
            if start is None:
                assert r["start_line"] is None and r["end_line"] is None
            else:
                assert r["start_line"] == start + text.count("\n", 0, at)
                assert r["end_line"] == start + text.count("\n", 0, max(at + len(r["text"]) - 1, 0))
            at += len(r["text"])
        assert at == len(text)


def test_splitting_odd_texts(spark):
    rng = random.Random(3)
    parts = ["# h", "## h\r", "", " ", "\t", "```", "````", "~~~", "~~~ x", "   ```py", "    ```", "``` a`b", "#x", "text. More", " ", "\x0b", "\r", "é𝔘", "#\r", "######", "   # z", "~~~~", "- a"]
    rows = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 60))), 5, None) for i in range(150)]
    rows += [(1000, None, 1, "a"), (1001, "", 1, "a"), (1002, "x" * 500, None, "a"), (1003, "𝔘" * 301, 0, ""), (1004, "\ufdd0\ufdd1\n" * 99, 2, None), (1005, "\n" * 300, 1, None)]
    df = spark.createDataFrame(rows + rows[:9], HITS)
    hits = {r[0]: dict(zip(("hit_id", "text", "start_line", "heading"), r)) for r in rows}
    got = splitting.natural_boundaries(df, 20).collect()
    want = {(k, None if r["start_line"] is None else r["start_line"] + b) for k, r in hits.items() if r["text"] and len(r["text"]) > 20 for b in boundaries(r["text"])}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    check_pieces(hits, splitting.pieces(df, 60, 7).collect(), 60, 7)
    check_pieces(hits, splitting.pieces(df, 60, 0).collect(), 60, 0)
    with pytest.raises(ValueError):
        splitting.pieces(df, 10, 10)
    assert splitting.pieces(df.limit(0)).count() == splitting.natural_boundaries(df.limit(0)).count() == 0


def test_pieces_end_at_the_strongest_boundary(spark):
    text = "a b. " * 30 + "\n\n" + "c " * 20 + "\n# Head\n" + "d " * 20 + "\n```\n# no\n```\n" + "e" * 300
    ends = [r["text"] for r in splitting.pieces(spark.createDataFrame([(1, text, 1, "h")], HITS), 250, 0).orderBy("piece").collect()]
    assert ends[0].endswith("c \n") and ends[1].startswith("# Head")
    inside = "```\n" + "# no heading\n" * 40 + "```\n"
    plain = [r["text"] for r in splitting.pieces(spark.createDataFrame([(1, inside, 1, "h")], HITS), 100, 0).orderBy("piece").collect()]
    assert all(p.endswith("\n") for p in plain)


def test_pieces_end_at_an_early_boundary(spark):
    texts = ["a b. c\n# Head\n" + "d e. " * 100, "a b. c\n\nd\n\n" + "e" * 300, "a\n# H\nb\n\n" + "x y\n" * 200, "a\n# H\n" + "b " * 70 + "\n\n" + "c " * 200]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in enumerate(texts)], HITS)
    for overlap in (0, 2):
        first = {r["hit_id"]: r["text"] for r in splitting.pieces(df, 200, overlap).where("piece = 0").collect()}
        assert first == {0: "a b. c\n", 1: "a b. c\n\nd\n\n", 2: "a\n", 3: texts[3][: texts[3].index("c ")]}
    later = "a " * 99 + "\n\n" + "b\n\n" + "c" * 500
    assert [r["text"] for r in splitting.pieces(spark.createDataFrame([(1, later, 1, "h")], HITS), 200, 0).orderBy("piece").collect()][:2] == ["a " * 99 + "\n\n", "b\n\n"]


def rank_error(values, answer, q):
    v = np.sort(values)
    return max(np.searchsorted(v, answer, "left") / len(v) - q, q - np.searchsorted(v, answer, "right") / len(v), 0)


def test_percentiles(spark, small):
    calls = spark.read.parquet(f"{small}/tool_calls.parquet").toPandas().drop_duplicates("call_id")
    calls = calls[np.isfinite(calls.duration_ms) & (calls.duration_ms >= 0)]
    groups = {k: v.to_numpy() for k, v in calls.groupby(["tool", "collection"]).duration_ms}
    got = queries.p6_percentiles(spark, small).collect()
    assert len(got) == len(groups)
    for r in got:
        assert r["n"] == len(groups[r["tool"], r["collection"]])
        assert all(rank_error(groups[r["tool"], r["collection"]], r[n], q) <= 0.01 for n, q in quantiles.RANKS.items())
    assert sum(r["n"] for r in queries.p6_daily(spark, small).collect()) == sum(r["n"] for r in got)


def test_sketches_combine_within_the_bound(spark):
    rows = spark.range(300_000).select((F.col("id") % 7).cast("string").alias("day"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.rand(1), 6) * 1e6).alias("value"))
    rows = rows.unionByName(spark.createDataFrame([("0", float("nan")), ("1", None)], "day string, value double")).cache()
    values = np.array([r["value"] for r in rows.collect() if r["value"] is not None and r["value"] == r["value"]])
    days = quantiles.sketches(rows, "day")
    one = quantiles.answers(quantiles.merged(days), ranks={"lo": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "hi": 1.0}).first()
    assert one["n"] == len(values) == 300_000 and one["lo"] == values.min() and one["hi"] == values.max()
    assert max(rank_error(values, one[n], q) for n, q in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))) <= 0.01
    assert quantiles.sketches(rows.where("value is null"), "day").count() == 0


def test_durations_count_once(spark):
    rows = [(1, "2017-01-01T00:00:00Z", 10, "t", "c", 5.0), (1, "x", 20, "t", "c", 5.0), (2, None, 30, None, None, 0.0), (3, "", 40, "t", "c", -1.0), (4, "", 40, "t", "c", float("inf")), (5, "", 1, "t", "c", float("nan")), (6, "", 1, "t", "c", None), (None, "", 1, "t", "c", 1.0), (None, "", 1, "t", "c", 1.0)]
    df = spark.createDataFrame(rows, "call_id long, ts string, r long, tool string, collection string, duration_ms double").withColumn("received_at", F.timestamp_seconds("r"))
    got = quantiles.percentiles(df).collect()
    assert Counter((r["tool"], r["n"]) for r in got) == Counter([("t", 3), (None, 1)])
    assert quantiles.percentiles(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def plain_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids(spark, small, plain_encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, small).collect()}
    assert got == {k: plain_encoder(t) if t else [] for k, t in texts.items()}


def test_ids_of_odd_texts(spark, plain_encoder):
    rng = random.Random(5)
    texts = [None, "", " ", "a" * 3000, " " * 900 + "x", "\n" * 400, "=-" * 700, "日本語" * 200, "<|endoftext|> don't", "\x00\x1f﻿‍", "🙂" * 90]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x300, 0xD7FF), rng.randint(0x1F300, 0x1F900)])) for _ in range(150)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(df).collect()}
    assert all(got[i] == (plain_encoder(t) if t else []) for i, t in enumerate(texts))
    counts = df.select("doc_id", tokenizer.token_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(got[r["doc_id"]]) for r in counts)
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


def test_forgetting_pieces_changes_nothing(plain_encoder):
    e = tokenizer.Encoder(keep=50)
    texts = [f"word{i} and {i * 7} more-{i % 13}" for i in range(300)]
    for k in range(0, 300, 7):
        part = texts[k : k + 7]
        ids, at = e.encode(part)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == list(map(plain_encoder, part))


def check_packing(rows, sizes, capacity):
    """rows: (doc_id, piece, token_start, n_tokens, container, place, offset)."""
    docs, containers = defaultdict(list), defaultdict(list)
    for d, piece, start, n, c, place, offset in rows:
        docs[d].append((piece, start, n))
        containers[c].append((place, offset, n))
    assert docs.keys() == {d for d, n in sizes.items() if n}
    for d, x in docs.items():
        x.sort()
        assert [p for p, _, _ in x] == list(range(len(x))) and (sizes[d] > capacity or len(x) == 1)
        assert [s for _, s, _ in x] == [sum(n for _, _, n in x[:i]) for i in range(len(x))] and sum(n for _, _, n in x) == sizes[d]
    for x in containers.values():
        x.sort()
        assert [(p, o) for p, o, _ in x] == [(i, sum(n for _, _, n in x[:i])) for i in range(len(x))]
        assert sum(n for _, _, n in x) <= capacity
    assert sorted(containers) == list(range(len(containers)))
    return len(containers)


def best_fit_decreasing(sizes, capacity):
    spaces = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, x in enumerate(spaces) if x >= s]
        if fit:
            i = min(fit, key=lambda i: spaces[i])
            spaces[i] -= s
        else:
            spaces.append(capacity - s)
    return len(spaces)


@pytest.mark.parametrize("capacity", [7, 50, 300])
def test_plans(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randint(1, 300))] + [capacity // 3 + 1] * rng.randint(0, 200)
        groups = rng.choice([1, 5, 40])
        p = packing.plan(Counter(sizes), capacity, groups)
        rows, n = [], 0
        for size, rank, count, container, place, offset in p.tolist():
            rows += [((size, rank + i), 0, 0, size, container + i, place, offset) for i in range(count)]
        want = {(s, i): s for s, c in Counter(sizes).items() for i in range(c)}
        n = check_packing(rows, want, capacity)
        assert groups < 40 or n <= best_fit_decreasing(sizes, capacity) * 1.1 + 2


def test_packing(spark, small):
    sizes = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", tokenizer.token_count(F.col("text")).alias("n")).collect()}
    n = check_packing([tuple(r) for r in queries.p8_containers(spark, small).collect()], sizes, packing.CAPACITY)
    assert n <= sum(sizes.values()) / packing.CAPACITY * 1.03 + 2


def test_packing_a_hot_size(spark):
    rows = [(i, 700) for i in range(4000)] + [(5000 + i, 1 + i % 2600) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("size", F.lit("x"))
    n = check_packing([tuple(r) for r in packing.pack_sizes(df).collect()], {d: n or 0 for d, n in rows}, 2048)
    assert n <= best_fit_decreasing([s % 2048 for _, s in rows if s and s % 2048], 2048) * 1.03 + sum((s or 0) // 2048 for _, s in rows)
    assert packing.pack_sizes(df.limit(0)).count() == 0


def brute_spans(texts, width):
    where = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t or "") - width + 1):
            where[t[i : i + width]].add(d)
    out = set()
    for d, t in texts.items():
        shared = sorted({c for i in range(len(t or "") - width + 1) if len(where[t[i : i + width]]) > 1 for c in range(i, i + width)})
        for i, c in enumerate(shared):
            if i == 0 or shared[i - 1] != c - 1:
                start = c
            if i + 1 == len(shared) or shared[i + 1] != c + 1:
                out.add((d, start, c + 1))
    return out


def test_spans(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = [tuple(r) for r in queries.p9_found(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 200)
    shared = {r["doc_id"]: r["n_shared"] for r in queries.p9_shared(spark, small).collect()}
    assert shared.keys() == texts.keys() and sum(shared.values()) == sum(b - a for _, a, b in got)


@pytest.mark.parametrize("seed", range(3))
def test_spans_of_odd_texts(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é𝔘\n") for _ in range(rng.randint(10, 90))) for _ in range(8)] + ["a" * 120, "ab" * 60]
    texts = {i: "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 5))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "x" * 39, 103: "y" * 40, 104: "y" * 40, 105: "y" * 41, 106: texts[3], 107: texts[3]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    got = [tuple(r) for r in spans.shared_spans(df, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 40)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert spans.shared_spans(df).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, 30)


def test_time_of_splitting_is_linear_in_the_text(spark):
    import time

    def seconds(times):
        text = "# Head\ntext. more\n\n```\ncode\n```\nline\n" * times
        df = spark.createDataFrame([(1, text, 1, "h")], HITS)
        start = time.time()
        assert splitting.natural_boundaries(df).count() == 2 * times and splitting.pieces(df).agg(F.max("end_line")).first()[0] == 7 * times
        return time.time() - start

    seconds(100)
    assert seconds(10_000) < 60  # 20,000 boundaries; it took minutes when each looked at all fences before it


def test_candidates_beyond_a_text_are_no_windows(spark):
    d = spark.createDataFrame([(5, "ab" * 150), (3, "ab" * 150), (4, "c" * 220)], "doc_id long, text string")
    key = d.where("doc_id <> 5").select(F.xxhash64("text").alias("key"), F.expr("array(struct(90 as lo, 10000 as hi), struct(500 as lo, 600 as hi))").alias("ranges"))
    got = spans.window_rows(d, key).groupBy("key").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"), F.countDistinct("h", "g").alias("m")).collect()
    assert {tuple(r) for r in got} == {(3, 90, 100, 11, 2)}


def test_no_token_lies_across_a_cut(plain_encoder):
    e = tokenizer.encoder(tokenizer.VOCABULARY)
    rng = random.Random(2)
    alphabets = ["abcde", "日本語中文", [chr(c) for c in range(0x4E00, 0x4F00)], [chr(c) for c in range(0xE01, 0xE2F)], "=-", [chr(c) for c in range(0x1F600, 0x1F640)], "é̈́ü"]
    for _ in range(200):
        piece = "".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.1 else alphabets[2]) for _ in range(rng.randint(12, 300)))
        parts = e._cut(piece.encode())
        assert b"".join(parts) == piece.encode() and len(parts) > 1
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (40, 300, 1200)]
    ids, at = e.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [plain_encoder(t) for t in texts]


def test_rank_errors_are_exact(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 2, 3]] + [(None, 5.0)], "k string, value double")
    said = spark.createDataFrame([("a", 2.0, 9.0), (None, 5.0, 4.0)], "k string, p50 double, p99 double")
    got = {r["k"]: (r["n"], round(r["p50_error"], 6), round(r["p99_error"], 6)) for r in quantiles.rank_errors(rows, said, "k", ranks={"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (5, 0.0, 0.01), None: (1, 0.0, 0.99)}


def test_facts_find_a_wrong_packing(spark):
    sized = spark.createDataFrame([(1, 5), (2, 7), (3, 25), (4, 0)], "doc_id long, n_tokens long")
    right = packing.pack_sizes(sized, 10, (4,))
    facts = lambda p: {r["fact"]: r["n"] for r in packing.facts(sized, p, 10).collect()}
    good = facts(right)
    assert good.pop("texts in containers") == 3 and good.pop("texts without tokens") == 1 and not any(good.values())
    bad = facts(right.where("not (doc_id = 3 and piece = 1)").withColumn("offset", F.col("offset") + 1))
    assert bad["tokens missing or twice"] and bad["pieces that overlap or leave a gap"] and bad["pieces beyond the capacity"]
