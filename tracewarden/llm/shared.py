"""What the operators share: keys of documents, text batches and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import graph
from tracewarden.session import removed, settled, work_dir

__all__ = ["NO_ID", "components", "joined_bytes", "keyed", "partitions", "removed", "retext", "sliced", "work_dir", "written"]

#: ``settled`` under the name that the operators use.
written = settled

#: Stands for a null doc_id in join keys; a null id never meets another id.
NO_ID = -(2**63)
#: Texts are worked on in slices of about so many bytes, whatever the batch size is.
SLICE_BYTES = 1_000_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, text, k1, k2) of ``docs``; null texts become empty. keep: also rest, a struct of all columns but the text.

    k1 is the id (``NO_ID`` for null) and k2 a hash of the text, so that rows which share an
    id but not a text stay apart in joins. Rows equal in both are one document given twice.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest")] if keep else []
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), *rest).select(
        "doc_id", "text", *(["rest"] if keep else []), F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2")
    )


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text each; one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(size):
        return
    run = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column without nulls, and the offset at which each text starts (one more at the end)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def retext(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """``docs`` with ``change`` applied to each text that is not null; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                new = pa.array([None if t is None else change(t) for t in part.column("text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == "text" else part.column(c) for c in part.schema.names], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) reaches; see ``graph.components``."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), rounds).withColumnRenamed("component", "root")
