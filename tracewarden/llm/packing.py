"""Best-fit packing of token pieces into sequences, certified by lower bounds and repaired by exchange.

Pieces are dealt to partitions of a fixed size, each packed by best-fit decreasing. Dual feasible
functions of the lengths give a lower bound on the sequences that the partition needs. Where
the bound is met the partition is certified and done. Where there is a gap its least filled
sequences are released; the released pieces of several partitions meet in fewer partitions and are
packed anew, and the new packing is taken only if it needs fewer sequences. What is released
is bounded per partition, so the last round, in one partition, is bounded too.

Null texts count as empty; every document ends with the end token, so an empty one has one
piece of length 1. Very long texts are cut into pieces of the full size. Of equally long pieces
any comes first, which changes no count. Repeated rows are packed once each. Empty tables give
empty results; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import bpe
from tracewarden.llm.shared import removed, sliced, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, done boolean"
#: Pieces in a partition; partitions that meet in one; sequences that a partition with a gap releases, besides four for each of the gap.
DEAL, MEET, RELEASE = 50_000, 16, 32


def pieces(docs: DataFrame, path: str | None = None, size: int = 1024, end: int = 2) -> DataFrame:
    """Token pieces of each document: only longer ones are cut, and the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = bpe.coder(path or bpe.default_path()), end.to_bytes(4, "little")
        for batch in batches:
            for part in sliced(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encoded_by_rank(part.column("text").to_pylist())):
                    ids += last
                    n = len(ids) // 4
                    first = (n - 1) % size + 1
                    edges = [0, *range(first, n + 1, size)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return bpe.texts_of(docs).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece by best-fit decreasing: the fullest bin that still has room."""
    out = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_, n = 0, 0  # bit r of open_ is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_ >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            own = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, own, n = size, n, n + 1
        out[i] = own
        if r > need:
            room[r - need].append(own)
            open_ |= 1 << (r - need)
    return out


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    total, pieces_ = np.cumsum(count * x), np.cumsum(count)
    best = -(-int(total[-1]) // size)
    for eps in range(1, size // 2 + 1):  # long pieces count as whole bins, short ones not at all
        whole = int(pieces_[-1] - pieces_[size - eps])
        best = max(best, whole - (-int(total[size - eps] - total[eps - 1]) // size))
    for k in range(1, 101):  # rounded to multiples of 1 / k, exact multiples of 1 / (k + 1) kept
        scaled = x * (k + 1)
        value = np.where(scaled % size == 0, x * k, scaled // size * size)  # k * size times the function
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def _pack(size: int, round_: int, last: bool):
    names = [x.split()[0] for x in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths, old = (table.column(c).to_numpy() for c in ("length", "sequence_id"))
        bins = best_fit(lengths, size)
        n, before = int(bins.max()) + 1, len(np.unique(old)) if round_ else 1 << 62
        if n < before:
            ids = (round_ << 56) + (TaskContext.get().partitionId() << 32) + bins
        else:
            n, ids = before, old
        _, bins = np.unique(ids, return_inverse=True)
        gap = n - lower_bound(lengths, size)
        order = np.argsort(bins, kind="stable")
        run_ = np.cumsum(lengths[order]) - lengths[order]
        firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(ids), dtype=np.int64)
        offset[order] = run_ - np.repeat(run_[firsts], np.diff([*firsts, len(order)]))
        done = np.ones(n, dtype=bool)
        if not last:  # a certified partition gives its least filled sequence only: bounds are rounded up once per partition
            fill = np.bincount(bins, weights=lengths, minlength=n)
            least = np.argsort(fill, kind="stable")[: RELEASE + 4 * gap if gap else 1]
            done[least[fill[least] < size]] = False
        out = table.drop_columns(["sequence_id"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("done", pa.array(done[bins]))
        yield from out.select(names).combine_chunks().to_batches()

    return run


def pack(items: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = items.sparkSession
    now = written(items, "pieces")
    n = now.count()
    deal, round_, out = max(1, -(-n // DEAL)), 0, None
    todo = now.withColumn("sequence_id", F.lit(-1).cast("long"))
    while True:
        last = round_ > 0 and deal == 1 or round_ >= 60
        # released sequences move whole, so that each is counted in one partition and keeps its id in one
        key = ["sequence_id"] if round_ else ["doc_id", "piece"]
        dealt = todo.repartition(deal, F.xxhash64(*key, F.lit(round_)))
        packed = written(dealt.mapInArrow(_pack(size, round_, last), PACKED), f"packed{round_}")
        if round_ == 0:
            removed(spark, now)
        done = packed.where("done").drop("done")
        out = done if out is None else out.unionByName(done)
        todo = packed.where("not done").drop("done", "offset")
        if last or todo.isEmpty():
            return out
        deal, round_ = -(-deal // MEET), round_ + 1


def packed(docs: DataFrame, path: str | None = None, size: int = 1024, end: int = 2) -> DataFrame:
    """Every piece of every document with its place: sequence_id (any numbers) and a gapless offset from 0."""
    return pack(pieces(docs, path, size, end), size)
