"""Rollups and ratios over an event log of tool calls. Every rollup is one groupBy, combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.predicates import elements, member, present, text_of

FLAGS = ("expected_mtime_set", "fields_set", "folder_set", "used_alias")


def _number(c: str) -> Column:
    """A null or NaN measure counts as 0; an infinite one is null, so that averages leave it out."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | (F.abs(v) != float("inf")), F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def _yes(c: str) -> Column:
    """A null flag counts as false."""
    return F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long")


def _measures() -> list[Column]:
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return [
        F.count("*").alias("calls"),
        F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("ok"),
        F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("error"),
        F.round(F.avg(_number("duration_ms")), 6).alias("avg_duration_ms"),
        F.round(F.avg(_number("req_bytes")), 6).alias("avg_req_bytes"),
        F.round(F.avg(_number("resp_bytes")), 6).alias("avg_resp_bytes"),
    ]


def tool_name() -> Column:
    return F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("?"))


def day() -> Column:
    """The first ten characters of ts; ? where it is shorter."""
    return F.when(F.length("ts") >= 10, F.substring("ts", 1, 10)).otherwise("?")


def version(column: str) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("unknown"))


def by_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy(tool_name().alias("tool")).agg(*_measures(), *[_yes(f).alias(f) for f in FLAGS])


def by_error(calls: DataFrame) -> DataFrame:
    """Failures only; a failure without a message counts as 'error'."""
    failed = calls.where(~F.coalesce(F.col("ok"), F.lit(False)))
    return failed.groupBy(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("error")).alias("error")).agg(F.count("*").alias("calls"))


def error_shapes(calls: DataFrame) -> DataFrame:
    """(tool, shape): one row per shape of each call; error_shape is JSON, a list of shapes or one."""
    v = F.try_parse_json("error_shape")
    many = F.try_variant_get(v, "$", "array<string>")
    one = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    shapes = F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), many), one)
    return calls.where("error_shape is not null").select(tool_name().alias("tool"), F.explode(shapes).alias("shape")).where("shape is not null and shape <> ''")


def by_error_shape(calls: DataFrame) -> DataFrame:
    return error_shapes(calls).groupBy("tool", "shape").agg(F.count("*").alias("n"))


def by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(day().alias("day")).agg(F.count("*").alias("calls"))


def by_version(calls: DataFrame, column: str) -> DataFrame:
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return calls.groupBy(version(column).alias("version")).agg(F.count("*").alias("calls"), F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("ok"), F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("error"))


def flag_totals(calls: DataFrame) -> DataFrame:
    """(flag, n), a row per flag; one aggregate row turned over."""
    total = calls.agg(*[_yes(f).alias(f) for f in FLAGS])
    return total.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(f, F.lit(0)).cast("long").alias("n")) for f in FLAGS])).alias("x")).select("x.*")


def all_rollups(calls: DataFrame) -> DataFrame:
    """(level, key, calls, errors): by tool, by day, by collection and in all, in one pass and one shuffle by grouping sets."""
    e = calls.select(tool_name().alias("tool"), day().alias("day"), F.coalesce("collection", F.lit("?")).alias("collection"), F.coalesce(F.col("ok"), F.lit(False)).alias("ok"))
    g = e.groupingSets([["tool"], ["day"], ["collection"], []], "tool", "day", "collection").agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("long").alias("errors"))
    level = F.when(F.col("g") == 3, "tool").when(F.col("g") == 5, "day").when(F.col("g") == 6, "collection").otherwise("all")
    return g.select(level.alias("level"), F.coalesce("tool", "day", "collection", F.lit("")).alias("key"), "calls", "errors")


def by_path(calls: DataFrame) -> DataFrame:
    """(path, calls, ok, error, by_tool): per note path, with the calls per tool as an ordered list."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    pair = calls.where(F.trim("note_path") != "").groupBy(F.trim("note_path").alias("path"), tool_name().alias("tool")).agg(F.count("*").alias("n"), F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("ok"))
    out = pair.groupBy("path").agg(F.sum("n").alias("calls"), F.sum("ok").alias("ok"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tool", "n"))).alias("t"))
    return out.select("path", "calls", "ok", (F.col("calls") - F.col("ok")).alias("error"), F.transform("t", lambda x: F.struct(x["tool"].alias("tool"), x["n"].alias("n"))).alias("by_tool"))


def ratios(calls: DataFrame, search: str = "search_notes", read: str = "get_note", patch: str = "patch_note", targets: dict | None = None) -> DataFrame:
    """One row of key ratios, in per cent with one decimal, and the tips that follow from the targets."""
    t = {"folder_scoped": 80.0, "read_to_search": 10.0, "error_max": 5.0} | (targets or {})
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    tool = F.col("tool")
    a = calls.agg(
        F.count("*").alias("calls"), n(tool == search).alias("search_calls"), n((tool == search) & F.col("folder_set")).alias("scoped"),
        n((tool == read) & F.col("chunk_hash").isNotNull()).alias("chunk_reads"), n(~F.coalesce(F.col("ok"), F.lit(False))).alias("errors"),
        n(tool == patch).alias("patch_calls"), n((tool == patch) & F.col("expected_mtime_set")).alias("patch_guarded"),
        F.coalesce(F.sum("flaws_emitted"), F.lit(0)).alias("flaws_emitted"), F.coalesce(F.sum("flaws_auto_fixed"), F.lit(0)).alias("flaws_auto_fixed"),
    ).na.fill(0)
    share = lambda x, of: F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col(x), F.col(of)), 1), F.lit(0.0))
    a = a.withColumn("folder_scoped_pct", share("scoped", "search_calls")).withColumn("read_to_search_pct", share("chunk_reads", "search_calls")).withColumn("error_pct", share("errors", "calls"))
    tips = F.array_compact(F.array(
        F.when((F.col("search_calls") > 0) & (F.col("folder_scoped_pct") < t["folder_scoped"]), "scope searches to a folder"),
        F.when((F.col("search_calls") > 0) & (F.col("read_to_search_pct") < t["read_to_search"]), "read chunks after a search"),
        F.when(F.col("error_pct") > t["error_max"], "too many failed calls"),
        F.when(F.col("patch_guarded") * 2 < F.col("patch_calls"), "guard repeated writes by their mtime"),
    ))
    return a.withColumn("tips", F.array_join(tips, "; ")).drop("scoped")


def top_shapes(calls: DataFrame, k: int = 10) -> DataFrame:
    """(shape, n, tool): the k most frequent error shapes, each with the busiest tool that has it."""
    per = by_error_shape(calls)
    busy = calls.groupBy(tool_name().alias("tool")).agg(F.count("*").alias("tool_calls"))
    owned = per.join(busy, "tool")
    return owned.groupBy("shape").agg(F.sum("n").alias("n"), F.min_by("tool", F.struct((-F.col("tool_calls")).alias("less"), "tool")).alias("tool")).orderBy(F.desc("n"), "shape").limit(k)


def window_of(calls: DataFrame, since: str | None = None, until: str | None = None, collection: str | None = None, tool: str | None = None, conversation: str | None = None) -> DataFrame:
    """Calls of a collection, tool, conversation and span of ts (compared as text, as it is stored); filters reach the scan."""
    tests = [("ts", ">=", since), ("ts", "<", until), ("collection", "=", collection), ("tool", "=", tool), ("conversation_id", "=", conversation)]
    for column, op, value in tests:
        if value is not None:
            c = F.col(column)
            calls = calls.where(c >= value if op == ">=" else c < value if op == "<" else c == value)
    return calls


def remap_default(calls: DataFrame, vault_ids: list[str]) -> DataFrame:
    """Events of the collection 'default' move to the collection named as their vault, for the given vaults."""
    hit = (F.col("collection") == "default") & F.col("vault_id").isin(vault_ids)
    return calls.withColumn("collection", F.when(hit, F.col("vault_id")).otherwise(F.col("collection")))


def private_paths(calls: DataFrame, mode: str = "hash_only", root: str = "") -> DataFrame:
    """note_path by privacy mode: 'none' drops path and hash, 'hash_only' the path, 'vault_relative' keeps both; 'absolute' keeps both
    with the vault's root before the path. A null path stays null."""
    if mode not in ("none", "hash_only", "vault_relative", "absolute"):
        raise ValueError(f"unknown mode {mode!r}")
    nothing = F.lit(None).cast("string")
    whole = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("note_path", "^/+", ""))
    path = F.col("note_path") if mode == "vault_relative" else whole if mode == "absolute" else nothing
    return calls.withColumn("note_path", path).withColumn("path_hash", nothing if mode == "none" else F.col("path_hash"))


def spans(calls: DataFrame) -> DataFrame:
    """Events as trace spans with ids that depend on the event alone, so that a sink may receive them twice."""
    trace = F.substring(F.sha2(F.concat_ws(":", F.lit("trace"), F.coalesce("conversation_id", F.col("call_id").cast("string"))), 256), 1, 32)
    span = F.substring(F.sha2(F.concat_ws(":", F.lit("span"), F.col("call_id").cast("string")), 256), 1, 16)
    status = F.when(F.coalesce(F.col("ok"), F.lit(False)), "OK").otherwise("ERROR")
    return calls.select(trace.alias("trace_id"), span.alias("span_id"), tool_name().alias("name"), status.alias("status"), "received_at", "duration_ms")


def argument_flags(arguments: Column, tool: Column) -> Column:
    """What a call's arguments (VARIANT) tell without giving content away, as a struct of the log's flags and the number of edits.

    used_alias: an old name of a parameter; folder_set and chunk_hash_set: not empty; fields_set and expected_mtime_set: not null.
    """
    there = lambda k: present(member(arguments, k))
    filled = lambda k: there(k) & ~text_of(member(arguments, k)).isin("", "[]", "{}", "false", "0")
    alias = there("top_k") | there("filters") | ((tool == "append_note") & (there("content") | there("body"))) | ((tool == "write_note") & (there("text") | there("body")))
    return F.struct(
        F.coalesce(alias, F.lit(False)).alias("used_alias"), (filled("folder") | filled("folders")).alias("folder_set"), filled("chunk_hash").alias("chunk_hash_set"),
        there("fields").alias("fields_set"), there("expected_mtime").alias("expected_mtime_set"), F.size(elements(member(arguments, "ops"))).alias("ops_count"),
    )


def latest_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; WindowGroupLimit keeps n per task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
