"""Grouping activity into sessions (problem 4) by sweep-line deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.times import instant_us

GAP_US = 1_800_000_000


def normal_id(c: Column) -> Column:
    """An id without white space around it, in lower case; null for a blank one."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def calls_once(calls: DataFrame) -> DataFrame:
    """(call_id, conversation_id, tool, us): the calls that count, each once.

    Calls without a conversation or whose ts names no instant don't count; of deliveries under one call_id the one
    received first counts (ties: the least instant). A null call_id identifies nothing: each such row is a call.
    Filters and projection run before the only shuffle of whole rows, on call_id, which has no hot value.
    """
    slim = calls.select("call_id", "received_at", normal_id(F.col("conversation_id")).alias("conversation_id"), "tool", instant_us(F.col("ts")).alias("us"))
    slim = slim.where("conversation_id is not null and us is not null")
    keyed = slim.where("call_id is not null")
    first = Window.partitionBy("call_id").orderBy("received_at", "us", "conversation_id", "tool")
    once = keyed.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "received_at")
    return once.unionByName(slim.where("call_id is null").drop("received_at"))


def sessions(events: DataFrame, key: str = "conversation_id", us: str = "us", label: str = "tool", gap_us: int = GAP_US) -> DataFrame:
    """One row per session: key, session (from 1), start_us, end_us, duration_us, n_calls, by_label (map label -> calls).

    A session ends where more than gap_us lie between consecutive events; a distance of exactly gap_us does not end it.
    Null keys and instants don't count; a null label counts as ''. An empty input gives no session.

    First the events of one key within one slot as wide as the gap are summed up, which never joins two sessions and is
    combined before the shuffle: a key that holds a third of all events shrinks to one row per slot and label, so no
    task has to sort its events. Then +1 at the first event of each slot and -1 at its last event plus the gap are swept
    in order of time (+1 first where they meet): where the running sum returns to zero, a session closes.
    """
    at = F.col(us)
    e = events.where(at.isNotNull() & F.col(key).isNotNull())
    slot = F.expr(f"`{us}` div {gap_us} - if(`{us}` % {gap_us} < 0, 1, 0)")
    cell = e.groupBy(F.col(key).alias("k"), slot.alias("slot"), F.coalesce(F.col(label), F.lit("")).alias("label")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    cell = cell.groupBy("k", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"))
    delta = cell.select(
        "k", "hi", "n", "labels",
        F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct((F.col("hi") + gap_us).alias("t"), F.lit(-1).alias("d")))).alias("x"),
    ).select("k", F.col("x.t").alias("t"), F.col("x.d").alias("d"), "hi", "n", "labels")
    sweep = Window.partitionBy("k").orderBy("t", F.desc("d"))
    upto = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = delta.withColumn("depth", F.sum("d").over(upto))
    # A session opens where the sum rises from 0 to 1: the running count of such rows numbers the sessions.
    numbered = open_.withColumn("session", F.sum(F.when((F.col("d") == 1) & (F.col("depth") == 1), 1).otherwise(0)).over(upto))
    rows = numbered.where("d = 1").groupBy("k", "session").agg(F.min("t").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_calls"), F.collect_list("labels").alias("maps"))
    add = lambda acc, m: F.map_zip_with(acc, m, lambda _, a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long")))
    total = F.aggregate("maps", F.expr("cast(map() as map<string,bigint>)"), add)
    return rows.select(F.col("k").alias(key), F.col("session").cast("long").alias("session"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_calls", total.alias("by_label"))
