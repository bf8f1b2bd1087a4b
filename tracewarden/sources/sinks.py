"""Sinks: artifacts, all-or-nothing publication, coverage gates and routing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_scores(scores: DataFrame, top_features: DataFrame, key: str, path: str) -> None:
    """Scores with their top features as one JSON column, as compressed CSV."""
    listed = top_features.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "name", "value")))).alias("top_feature_json"))
    scores.join(listed, key, "left").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


#: The file in a publication's folder that names its present version.
POINTER = "CURRENT"


def publish(parts: dict[str, DataFrame], failures: dict[str, str], path: str) -> DataFrame:
    """Writes the union of all parts, numbered in the parts' order, only if nothing failed; ``published`` reads it.

    Every publication is a folder of its own under ``path``; a pointer file is swapped to it in one
    rename when it is complete. A crash at any time leaves the publication of before as it was. A
    failure report goes to ``path``-report in any case. Raises if anything failed.
    """
    spark = next(iter(parts.values())).sparkSession if parts else SparkSession.active()
    report = spark.createDataFrame(sorted(failures.items()) or [("", "")], "dataset string, error string").where("dataset <> ''")
    report.write.mode("overwrite").json(f"{path}-report")
    if failures:
        raise RuntimeError(f"not published; failed: {', '.join(sorted(failures))}")
    if not parts:
        raise ValueError("nothing to publish")
    out = None
    for n, part in enumerate(parts.values()):
        own = part.withColumn("part_no", F.lit(n))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    version = f"version-{uuid.uuid4().hex}"
    out.write.json(f"{path}/{version}")
    _point(spark, path, version)
    return out


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Swaps the pointer: written aside, then renamed over the old one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}-{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    stream = aside.getFileSystem(conf).create(aside, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, pointer, options)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The present publication under ``path``."""
    version = spark.read.text(f"{path}/{POINTER}").first()[0]
    return spark.read.json(f"{path}/{version}")


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows), one job over all tables."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


def require_nonzero(tables: dict[str, DataFrame]) -> None:
    """Raises if any table has no rows."""
    none = [r["table"] for r in coverage(tables).where("rows = 0").collect()]
    if none:
        raise ValueError(f"tables without rows: {', '.join(sorted(none))}")


def routed(df: DataFrame, probability: str, is_anomaly: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(high, low): confident anomalies, and all others."""
    high = F.coalesce((F.col(probability) >= threshold) & F.col(is_anomaly), F.lit(False))
    return df.where(high), df.where(~high)
