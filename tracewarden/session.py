"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tracewarden", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a running one is reused."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session's checkpoints are in.

    Where neither is named, a session in one process gets a temporary folder of its own. On a cluster
    that would be a folder of the driver's machine, which executors do not see, so it raises there.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracewarden-')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; ``forget`` removes it."""
    return f"{shared_dir(spark).rstrip('/')}/tw-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and executors may be lost."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a ``settled`` table that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        deleted(spark, folder)


def forget(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; frames that still read them fail afterwards."""
    deleted(spark, work_dir(spark))
