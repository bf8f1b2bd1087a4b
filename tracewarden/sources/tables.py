"""Typed reads: only the columns that are asked for, missing ones as nulls, missing tables as empty."""

from __future__ import annotations

import os
import urllib.request

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions.scalars import canonical_node


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder; the columns reach the scan as its read schema."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: cast, in order, null where ``df`` lacks them; NaN becomes null."""
    out = []
    for field in schema.fields:
        col = F.col(f"`{field.name}`") if field.name in df.columns else F.lit(None)
        col = col.try_cast(field.dataType)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        out.append(col.alias(field.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """CSV with a header, a byte-order mark allowed; malformed last records are dropped.

    A missing path gives an empty table when a schema is given. Columns that do not exist are
    left out; with a schema they come as nulls.
    """
    try:
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "DROPMALFORMED")
        df = reader.csv(path)
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    except AnalysisException:
        if schema is None:
            raise
        return empty_like(spark, schema)
    if columns:
        df = df.select(*(c for c in columns if c in df.columns))
    if schema is not None:
        df = conform(df, schema)
    return df.limit(limit) if limit and limit > 0 else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def merge_segments(parts: list[DataFrame]) -> DataFrame:
    """Time segments as one table without exact repeats; columns that a segment lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.dropDuplicates()


def cleaned_text(col: Column) -> Column:
    """Trimmed text; the usual missing markers become null."""
    text = F.trim(col.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def cleaned_number(col: Column) -> Column:
    """A finite double, or null."""
    number = cleaned_text(col).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


# fixed values: what counts as missing
MISSING = ("", "nan", "null", "none", "\\n", "na", "n/a")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of missing cells of each column."""
    return df.agg(*(F.count_if(cleaned_text(F.col(c)).isNull()).alias(c) for c in columns))


def discover(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """(dataset, kind, path) of CSV files below ``root``: the folder that holds a file names its dataset.

    ``kinds`` maps a kind to a pattern on the file name; of several files the least path wins.
    The listing is done by Spark's file source, so any store that it reads will do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(root).select("path")
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/(?:processed/)?[^/]+$", 1).alias("dataset"), F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file"))
    kind = F.coalesce(*(F.when(F.col("file").rlike(pattern), F.lit(k)) for k, pattern in kinds.items()))
    return named.withColumn("kind", kind).where("kind is not null").groupBy("dataset", "kind").agg(F.min("path").alias("path"))


# fixed values: the columns of flow records, and what they are
FLOW_TEXTS, FLOW_NUMBERS, FLOW_TIMES = ("interface_id", "protocol", "src_addr", "dst_addr"), ("packets", "bytes", "flow_record_count"), ("first_seen", "last_seen")


def flow_records(raw: DataFrame) -> DataFrame:
    """Flow records in one form: time, minute since 1970, element, texts without nulls, numbers without nulls, times to the millisecond. Rows without a time go."""
    for c in ("minute_utc", "src_addr", "dst_addr"):
        if c not in raw.columns:
            raise ValueError(f"flow records need {c}")
    name = next((c for c in ("node_key", "node") if c in raw.columns), None)
    if name is None:
        raise ValueError("flow records need node_key or node")
    ts = F.col("minute_utc").try_cast("timestamp")
    text = lambda c: F.coalesce(cleaned_text(F.col(c)), F.lit("")) if c in raw.columns else F.lit("")
    number = lambda c: F.coalesce(cleaned_number(F.col(c)), F.lit(0.0)) if c in raw.columns else F.lit(0.0)
    time = lambda c: F.col(c).try_cast("timestamp") if c in raw.columns else F.lit(None).cast("timestamp")
    node = cleaned_text(F.col(name))
    out = raw.select(
        ts.alias("timestamp"),
        F.floor(F.unix_timestamp(ts) / 60).alias("ts_min"),
        F.when(node.isNull(), "unknown").otherwise(canonical_node(node)).alias("node"),
        *(text(c).alias(c) for c in FLOW_TEXTS),
        *(number(c).alias(c) for c in FLOW_NUMBERS),
        *(time(c).alias(c) for c in FLOW_TIMES),
    )
    return out.where("ts_min >= 0")


def trimmed(spark: SparkSession, path: str) -> tuple[int, int]:
    """Cuts a text file after its last complete line; (bytes before, bytes after). Without any line end it stays. The cut copy replaces the file in one rename."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(conf)
    before, step = store.getFileStatus(source).getLen(), 1 << 16
    stream, keep, end = store.open(source), before, before
    while end > 0 and keep == before:
        start = max(0, end - step)
        stream.seek(start)
        found = bytes(stream.readNBytes(end - start)).rfind(b"\n")
        if found >= 0:
            keep = start + found + 1
            break
        end = start
    stream.close()
    if keep == before or end == 0:
        return before, before
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    reader, writer = store.open(source), store.create(aside, True)
    left = keep
    while left > 0:
        part = reader.readNBytes(min(left, 1 << 20))
        writer.write(part)
        left -= len(part)
    reader.close()
    writer.close()
    store.delete(source, False)
    if not store.rename(aside, source):
        raise RuntimeError(f"could not rename {path}.part")
    return before, keep


def fetched(url: str, target: str, tries: int = 3, block: int = 1 << 20) -> int:
    """Loads a file from a web address to a local path, by way of a part file, tried again if it comes short; the number of bytes. On the driver."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=600) as answer, open(f"{target}.part", "wb") as out:
                size = 0
                while part := answer.read(block):
                    out.write(part)
                    size += len(part)
                wanted = answer.headers.get("Content-Length")
            if wanted is not None and int(wanted) != size:
                raise OSError(f"{size} of {wanted} bytes")
            os.replace(f"{target}.part", target)
            return size
        except OSError:
            if n + 1 == tries:
                raise
    raise RuntimeError("not reached")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, is_dir) of what a folder of any store holds, one level deep."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return spark.createDataFrame([(x.getPath().toString(), x.getLen(), x.isDirectory()) for x in found], "path string, length long, is_dir boolean")
