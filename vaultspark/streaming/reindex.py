"""Changes of notes as a stream: debounce, then index incrementally into buckets of Parquet."""

from __future__ import annotations

import json
import os

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.operators.versions import drop_failed, reuse
from vaultspark.sources.formats import chunk_rows
from vaultspark.sources.vault import replace_keys, write_buckets
from vaultspark.streaming.debounce import quiet_periods

CHANGE = "op string, path string, ts timestamp, text string"


def changes(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The stream of change rows (op 'index', 'purge' or 'rebuild', path, ts, text) that arrive as JSON files in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).json(folder)


def is_noise(path):
    """Paths that are no notes: temporary files and those below hidden system folders."""
    return path.rlike(r"(^|/)(\.git|\.obsidian|\.trash)/|~$|\.(swp|tmp|part)$") | ~F.lower(path).rlike(r"\.(md|markdown|yaml|yml|mmd)$")


def last_per_path(batch: DataFrame) -> DataFrame:
    """The last change of each path; at equal times a purge counts over an index."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("op"))
    return batch.where(F.col("path").isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of its own file system, be it remote or local."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def reconcile(notes: DataFrame, index: str, model: str = "") -> DataFrame:
    """Change rows (op, path, ts, text) that bring an index in line with notes (path, text): what a full scan finds that no event told.

    A note is to be indexed where its chunks differ from the index's, purged where only the index has it. Only paths and hashes
    are compared; an index that isn't there yet has nothing.
    """
    spark = notes.sparkSession
    one = lambda chunks: chunks.groupBy("path").agg(F.sum(F.xxhash64("ord", "content_hash").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    new = one(chunk_rows(notes, model=model)).select("path", F.struct("h", "n").alias("new"))
    old = (one(spark.read.parquet(index)) if exists(spark, index) else new.where("false").select("path", "new.h", "new.n")).select("path", F.struct("h", "n").alias("old"))
    moved = new.join(old, "path", "full").where(~F.col("new").eqNullSafe(F.col("old"))).select("path", F.when(F.col("new").isNull(), "purge").otherwise("index").alias("op"))
    return moved.join(notes.select("path", "text"), "path", "left").select("op", "path", F.current_timestamp().alias("ts"), "text")


def rebuild(notes: DataFrame, index: str, embedder=None, buckets: int = 64, model: str = "") -> None:
    """Write the index of notes (path, text) anew, whatever it held."""
    from vaultspark.operators.search import embed

    rows = chunk_rows(notes, model=model)
    write_buckets(drop_failed(rows.withColumn("embedding", (embedder or embed)(F.col("text")))), index, buckets=buckets)


def index_batch(batch: DataFrame, index: str, embedder=None, buckets: int = 64, model: str = "", notes: Callable[[], DataFrame] | None = None) -> None:
    """Put one batch of changes into the chunk index: purged paths go, others are chunked anew.

    A change with the op 'rebuild' beats all others of its batch: the index is written anew from notes(), all notes as they are.

    Chunks whose text the index already has for the same note keep their vector; only the others are embedded. A note of
    which a chunk can't be embedded keeps its old rows and will be indexed with its next change. Running a batch twice
    changes nothing, so a restart after a failure is safe.
    """
    from vaultspark.operators.search import embed
    from vaultspark.session import cut

    spark = batch.sparkSession
    if notes is not None and not batch.where("op = 'rebuild'").isEmpty():
        rebuild(notes(), index, embedder, buckets, model)
        return
    last = cut(last_per_path(batch.where(~is_noise(F.col("path")))))
    new = chunk_rows(last.where("op = 'index' and text is not null"), model=model)
    there = exists(spark, index)
    if there:
        # Only the buckets of the batch's notes can hold vectors for them.
        touched = [r[0] for r in last.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).distinct().collect()]
        old = spark.read.parquet(index).where(F.col("bucket").isin(touched)).select("path", "content_hash", "embedding")
        kept = reuse(new, old)
    else:
        kept = new.withColumn("embedding", F.lit(None).cast("array<double>"))
    made = (embedder or embed)(F.col("text"))
    rows = cut(drop_failed(kept.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(made))))
    if not there:
        write_buckets(rows, index, buckets=buckets)
        return
    gone = last.where("op = 'purge'").select("path").unionByName(rows.select("path").distinct())
    empty = last.where("op = 'index'").join(new.select("path").distinct(), "path", "left_anti").select("path")  # notes that are blank now
    replace_keys(spark, index, rows, gone.unionByName(empty), buckets=buckets)


def run(spark: SparkSession, incoming: str, index: str, checkpoint: str, embedder=None, every: str | None = None, buckets: int = 64, notes: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Index changes as they come; with every=None all that is there, then stop. Offsets in the checkpoint make it exactly once
    together with the idempotent batches."""
    writer = changes(spark, incoming).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: index_batch(b, index, embedder, buckets, notes=notes))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def debounced(spark: SparkSession, incoming: str, out: str, checkpoint: str, delay: str = "2 seconds", watermark: str = "0 seconds") -> StreamingQuery:
    """Write (path, first_ts, due, n) for every path that has been quiet, as Parquet, as soon as the watermark allows."""
    quiet = quiet_periods(changes(spark, incoming).select("path", "ts"), "path", "ts", delay, watermark)
    return quiet.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def calls_sink(spark: SparkSession, incoming: str, out: str, checkpoint: str) -> StreamingQuery:
    """Telemetry that arrives as JSON files, appended to Parquet by day. Redelivered calls are dropped within a day of event time."""
    schema = "call_id long, received_at timestamp, collection string, tool string, ok boolean, duration_ms double"
    rows = spark.readStream.schema(schema).json(incoming).withWatermark("received_at", "1 day").dropDuplicatesWithinWatermark(["call_id"])
    return rows.withColumn("day", F.to_date("received_at")).writeStream.format("parquet").partitionBy("day").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enqueue(folder: str, rows: list[dict]) -> str:
    """Drop change rows into the incoming folder: one file, there at once and whole."""
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}-{abs(hash(json.dumps(rows, default=str)))}.json")
    hidden = os.path.join(folder, "." + os.path.basename(name))
    with open(hidden, "w") as f:
        f.writelines(json.dumps(r, default=str) + "\n" for r in rows)
    os.replace(hidden, name)
    return name
