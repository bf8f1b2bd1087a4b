"""Streaming twins of the batch operators: bins, sessions, first-of-duplicates, online memory, idempotent publication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StructField, StructType


def source(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def table_source(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream, be it one file or a folder of part files."""
    # a pattern of one name: the source takes a plain path for a folder and fails on a file
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Mean and count per bin; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("bin"), *keys, "n", "mean")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of rows at most ``gap`` apart; the end is the last row's time."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), F.count("*").alias("n")).drop("session_window")


def sliding(events: DataFrame, ts: str, keys: list[str], value: str, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "mean", "peak", "n")


def first_only(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """One row for each key while the watermark remembers it: a key that comes again later than ``late`` after its first row, by event time, is let through again, and its state is gone by then."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def published(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch goes to a folder of its own number, so a repeated batch replaces itself; ends when all input is read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def memory(stream: DataFrame, by: str, order: str, vector: str, tau: float) -> DataFrame:
    """(by, order, template, hits): online memory over a stream. Each key keeps its templates; a row that is as near as ``tau`` to one adds to its hits, others become new ones.

    Rows of a batch are taken in order; a later batch goes on where the one before stopped. A key's state is
    its unit vectors and their hits, as bytes in the state store, so a restart goes on too.
    """
    kinds = stream.select(by, order).schema.fields
    out = StructType([*kinds, StructField("template", LongType()), StructField("hits", LongType())])
    held = StructType([StructField("size", LongType()), StructField("templates", BinaryType()), StructField("hits", BinaryType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        size, packed, counted = state.get if state.exists else (0, b"", b"")
        hits = np.frombuffer(counted, dtype=np.int64).tolist()
        rows = pd.concat(list(parts)).sort_values(order)
        size = size or len(rows[vector].iloc[0])
        templates = np.frombuffer(packed, dtype=float).reshape(-1, size)  # with room for more, doubled when full
        which, counts = [], []
        for v in rows[vector]:
            x = np.asarray(v, dtype=float)
            x = x / max(float(np.linalg.norm(x)), 1e-300)
            near = templates[: len(hits)] @ x
            j = int(near.argmax()) if len(near) and near.max() >= tau else len(hits)
            if j == len(hits):
                if j == len(templates):
                    templates = np.concatenate([templates, np.empty((max(64, j), size))])
                templates[j] = x
                hits.append(0)
            hits[j] += 1
            which.append(j)
            counts.append(hits[j])
        state.update((size, templates[: len(hits)].tobytes(), np.array(hits, dtype=np.int64).tobytes()))
        yield rows[[by, order]].assign(template=which, hits=counts)

    return stream.select(by, order, vector).groupBy(by).applyInPandasWithState(step, out, held, "append", "NoTimeout")
