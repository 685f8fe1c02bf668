"""Percentiles of very large numeric columns (problem 6) by randomized compactor hierarchies.

A sketch is a hierarchy of compactors: a full one sorts its values and passes every other one, beginning with the first or the
second by chance, to the next level, where each value stands for twice as many. Two sketches are merged level by level.
These are the JVM's KLL sketches: they are aggregated before the shuffle, so a group that holds a third of all rows sends one
sketch per task, and a sketch's size depends on K and, by its logarithm, on the number of values, not on the group's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.times import instant_us

#: Width of the top compactor. The rank error is below 2.3 / K**0.9 (0.0038) with a probability of 0.99, normal in its
#: tails, so that an error of 0.01 is out by more than six standard deviations, after any number of merges.
K = 1200
RANKS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def durations_once(calls: DataFrame) -> DataFrame:
    """(day, tool, collection, value): the durations that count, each call_id once.

    Only finite values of at least 0 count. Of deliveries under one call_id the one received first counts; a null call_id
    identifies nothing, so each such row counts. day is that of ts, else of received_at, else null.
    """
    us = F.coalesce(instant_us(F.col("ts")), F.unix_micros(F.col("received_at").cast("timestamp")))
    slim = calls.select("call_id", "received_at", "tool", "collection", F.col("duration_ms").alias("value"), F.to_date(F.timestamp_micros(us)).alias("day"))
    slim = slim.where((F.col("value") >= 0) & ~F.isnan("value") & (F.col("value") != float("inf")))
    # Rows without an id are told apart, and spread, by their place in the table: one scan serves both kinds.
    own = slim.withColumn("row", F.when(F.col("call_id").isNull(), F.monotonically_increasing_id()))
    first = Window.partitionBy("call_id", "row").orderBy("received_at", "value", "tool", "collection", "day")
    return own.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("day", "tool", "collection", "value")


def sketches(rows: DataFrame, *by: str, value: str = "value", k: int = K) -> DataFrame:
    """(by..., n, sketch, lowest, highest): one mergeable sketch per group. Nulls in `by` are a group like any other.

    Nulls and NaN values don't count, and a group without any other value has no row.
    """
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    kept = rows.where(v.isNotNull())
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.min(v).alias("lowest"), F.max(v).alias("highest"))


def merged(parts: DataFrame, *by: str, k: int = K) -> DataFrame:
    """Sketches of finer groups (days, partitions, deliveries) combined to coarser ones, in any order and grouping."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def answers(sketched: DataFrame, *by: str, ranks: dict[str, float] = RANKS) -> DataFrame:
    """(by..., n, one column per rank): the percentiles that the sketches give; rank 0 and 1 are exact."""
    at = lambda q: F.col("lowest") if q == 0 else F.col("highest") if q == 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return sketched.select(*by, "n", *[at(q).alias(name) for name, q in ranks.items()])


def daily_sketches(calls: DataFrame, k: int = K) -> DataFrame:
    """(day, tool, collection, n, sketch, lowest, highest): what a day leaves behind."""
    return sketches(durations_once(calls), "day", "tool", "collection", k=k)


def percentiles(calls: DataFrame, k: int = K) -> DataFrame:
    """(tool, collection, n, p50, p90, p99) over all days, from the days' sketches."""
    return answers(merged(daily_sketches(calls, k), "tool", "collection", k=k), "tool", "collection")


def rank_errors(rows: DataFrame, answered: DataFrame, *by: str, ranks: dict[str, float] = RANKS, value: str = "value") -> DataFrame:
    """(by..., n, <name>_error per rank): how far each answer's rank is from the rank asked for, as a share of all values; exact.

    An answer among equal values has all their ranks. Values are counted, never sorted: one aggregate, combined before its shuffle.
    """
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    j = rows.alias("r").join(answered.alias("a"), on)
    counts = j.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.count("*").alias("n"), *[F.struct(F.sum(F.when(F.col(f"r.{value}") < F.col(f"a.{x}"), 1).otherwise(0)).alias("below"), F.sum(F.when(F.col(f"r.{value}") <= F.col(f"a.{x}"), 1).otherwise(0)).alias("upto")).alias(x) for x in ranks])
    error = lambda x, q: F.greatest(F.col(f"{x}.below") / F.col("n") - q, q - F.col(f"{x}.upto") / F.col("n"), F.lit(0.0))
    return counts.select(*by, "n", *[error(x, q).alias(f"{x}_error") for x, q in ranks.items()])
