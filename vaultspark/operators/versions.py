"""Versions of keyed rows: difference, reuse, three-way merge, upsert, compare and set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): added, removed or changed. One full outer join; equal rows don't leave it. Nulls are values."""
    o = old.select(F.col(key).alias("ok"), F.col(value).alias("ov"))
    n = new.select(F.col(key).alias("nk"), F.col(value).alias("nv"))
    j = o.join(n, F.col("ok") == F.col("nk"), "full")
    state = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when(~F.col("ov").eqNullSafe(F.col("nv")), "changed")
    return j.select(F.coalesce("ok", "nk").alias(key), state.alias("state")).where("state is not null")


def stale(known: DataFrame, disk: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows of disk (path, mtime, hash) to be read again: unknown, or with another mtime and then another hash.

    The cheap test comes first; hash may be a costly expression of the caller's and is only looked at after it.
    """
    k = known.select(F.col("path").alias("kp"), F.col("mtime").alias("km"), F.col("hash").alias("kh"))
    j = disk.join(k, F.col("path") == F.col("kp"), "left")
    moved = F.col("kp").isNull() | (F.abs(F.col("mtime") - F.col("km")) >= eps)
    return j.where(moved).where(F.col("kp").isNull() | ~F.col("hash").eqNullSafe(F.col("kh"))).select(*disk.columns)


def reuse(chunks: DataFrame, known: DataFrame, vector: str = "embedding") -> DataFrame:
    """Chunks (path, content_hash, ...) with the vector that the same text of the same note already has, else null."""
    k = known.where(F.col(vector).isNotNull()).groupBy("path", "content_hash").agg(F.first(vector).alias(vector))
    return chunks.join(k, ["path", "content_hash"], "left")


def drop_failed(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Without every chunk of a note of which any chunk has no usable vector: a note is indexed whole or not at all."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    failed = chunks.where(bad).select("path").distinct()
    return chunks.join(failed, "path", "left_anti")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, state) merged from two sides with a common base.

    state: same (both sides agree), ours or theirs (only that side changed or added it), conflict otherwise; value is null in
    a conflict. A row that one side deleted is a conflict, even where the other left it alone; one that both deleted is gone.
    Whether a row is there is told apart from a null value.
    """
    side = lambda df, s: df.select(F.col(key), F.col(value).alias(s), F.lit(True).alias(f"has_{s}"))
    j = side(base, "b").join(side(ours, "o"), key, "full").join(side(theirs, "t"), key, "full")
    has = {s: F.coalesce(f"has_{s}", F.lit(False)) for s in "bot"}
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    state = (
        F.when(has["o"] & has["t"] & same("o", "t"), "same")
        .when(has["b"] & has["o"] & has["t"] & same("b", "t"), "ours")
        .when(has["b"] & has["o"] & has["t"] & same("b", "o"), "theirs")
        .when(~has["b"] & has["o"] & ~has["t"], "ours")
        .when(~has["b"] & has["t"] & ~has["o"], "theirs")
        .otherwise("conflict")
    )
    kept = j.where(has["o"] | has["t"]).select(key, "o", "t", state.alias("state"))
    return kept.select(key, F.when(F.col("state").isin("same", "ours"), F.col("o")).when(F.col("state") == "theirs", F.col("t")).alias("value"), "state")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key; of several new rows of a key the last by order."""
    columns = [c for c in old.columns if c != key]
    n = new.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order) if order else F.struct(*columns)).alias("n"))
    j = old.select(key, F.struct(*columns).alias("o")).join(n, key, "full")
    return j.select(key, F.coalesce("n", "o").alias("x")).select(key, *[f"x.{c}" for c in columns])


def compare_and_set(current: DataFrame, writes: DataFrame, key: str, hash: Column, expected: str = "expected") -> DataFrame:
    """writes with state: ok, stale (the row's hash is another than expected) or missing. A null expectation accepts anything."""
    c = current.select(F.col(key).alias("_k"), hash.alias("_h"))
    j = writes.join(c, F.col(key) == F.col("_k"), "left")
    state = F.when(F.col(expected).isNull(), "ok").when(F.col("_k").isNull(), "missing").when(F.col("_h") == F.col(expected), "ok").otherwise("stale")
    return j.select(*writes.columns, state.alias("state"))


def purge(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """rows without those of purged keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def keep_newest(trees: DataFrame, keep: int = 8) -> DataFrame:
    """The trees built last, one row each; a top-n, not a sort."""
    return trees.groupBy("tree_oid").agg(F.max("built_at").alias("built_at")).orderBy(F.desc("built_at"), "tree_oid").limit(keep)


def last_touch(log: DataFrame, paths: DataFrame, tip: float) -> DataFrame:
    """(path, mtime): when each path was last touched in a log (path, ts), else the tip's time."""
    seen = log.groupBy("path").agg(F.max("ts").alias("ts"))
    return paths.select("path").join(seen, "path", "left").select("path", F.coalesce("ts", F.lit(tip)).alias("mtime"))
