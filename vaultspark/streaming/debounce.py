"""Reset-on-touch: a key is due once it has been quiet for a while. The same expression serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_periods(touches: DataFrame, key: str, ts: str, delay: str, watermark: str | None = None) -> DataFrame:
    """(key, first_ts, due, n): runs of touches less than `delay` apart; due is the last touch plus the delay.

    On a stream a watermark is needed, and a run comes out once the watermark has passed its end; touches later than the
    watermark are dropped, and a full scan (reindex.reconcile) finds what they touched. The last runs stay open until a later touch
    of any key moves the watermark past them: see closing_touch.
    """
    t = touches.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_t", F.col(ts).cast("timestamp"))
    if watermark is not None:
        t = t.withWatermark("_t", watermark)
    g = t.groupBy(F.session_window("_t", delay).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.min("_t").alias("first_ts"))
    return g.select(key, "first_ts", F.col("w.end").alias("due"), "n")


def closing_touch(touches: DataFrame, key: str, ts: str, delay: str, of: object) -> DataFrame:
    """One touch of a key `of` that nothing else has, late enough that the watermark closes every run of a finished stream.

    Its own run stays open and never comes out. An empty table of touches has none.
    """
    last = touches.where(F.col(key).isNotNull()).agg(F.max(ts).alias("last")).where("last is not null")
    late = (F.col("last").cast("timestamp") + F.expr(f"interval {delay}") * 2 + F.expr("interval 1 day")).cast(touches.schema[ts].dataType)
    return last.select(F.lit(of).cast(touches.schema[key].dataType).alias(key), late.alias(ts))
