"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Turn off the partitioning that a union claims from its inputs.

    On Spark 4.1 a later shuffle by the same key is dropped on that claim, although adaptive execution
    may have changed the partitions of the inputs; rows of one key then end up in several tasks.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a folder of our own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)


def written(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them back.

    Unlike a checkpoint this carries no plan properties over, which pile up in loops of joins and make
    planning slower each round.
    """
    spark = df.sparkSession
    prepare(spark)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and continue from there."""
    prepare(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
