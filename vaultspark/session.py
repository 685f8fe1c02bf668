"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What every session of this engine assumes; sizes (partitions, memory) are the cluster's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vaultspark")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in spark.checkpoint.dir, or one set earlier. Only in a local session without either, as in
    tests, a temporary folder is taken; on a cluster that is an error, since a folder of one machine is lost with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"vaultspark-{os.getpid()}-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared one."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_to_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a wide df by a Parquet table in the shared folder: columnar and compressed, where a checkpoint
    holds plain rows. The table stays until the folder is cleared."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
