"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "quantloom", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings win where they exist.

    ``shuffle_partitions`` is only the *initial* number: adaptive execution coalesces small
    partitions, so on a cluster it is set high (about input bytes / 128 MB) and left alone.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        settings["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder the cluster names in ``spark.checkpoint.dir``, and read back.

    Neither the plan nor recovery from a lost executor grows with what produced it. A checkpoint
    would keep the constraints of the old plan (what each column was computed from), and later plans
    multiply those; it also holds rows uncompressed and has no column to leave out.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names. Only a session on one machine, as in tests, gets one of
    its own where none is named; on a cluster that is an error, for executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")
