"""Islands, intervals, as-of joins and interval algebra.

Interval joins put both sides into cells of time and join on the cell; a pair is kept in the
first cell that both share, so it appears once. Nothing joins without an equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewarden.functions.scalars import dice


def islands(df: DataFrame, by: list[str], order: str, gap: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of rows of a group whose neighbours are at most ``gap`` (an interval or number) apart."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(order).over(w).isNull() | (F.col(order) > F.lag(order).over(w) + gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")


def union_segments(df: DataFrame, by: list[str], start: str, end: str, touch: bool = True) -> DataFrame:
    """The union of a group's intervals as disjoint segments; touching ones are joined if ``touch``."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) > before) if touch else (F.col(start) >= before)
    marked = df.withColumn("__new", F.when(before.isNull() | apart, 1).otherwise(0)).withColumn("__seg", F.sum("__new").over(w))  # equal intervals count together, in whatever order they come
    return marked.groupBy(*by, "__seg").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__seg")


def _cells(df: DataFrame, start: str, end: str, cell: float, name: str) -> DataFrame:
    low, high = F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)
    return df.withColumn(f"__low_{name}", low).withColumn("__cell", F.explode(F.sequence(low, high)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], cell: float, how: str = "inner") -> DataFrame:
    """Pairs of rows, equal in ``on``, whose closed intervals of numbers share a point; how: inner or left_semi.

    ``cell`` is the width of the cells; near the usual length of the intervals is best. Column
    names of the two sides must differ, but for ``on``. left_semi keeps every left row that meets a right one, repeated
    rows as often as they are given.
    """
    names = left.columns
    if how == "left_semi":  # equal rows go on as one with a count, so that none is lost below
        left = left.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("__copies"))
    x, y = _cells(left, *a, cell, "a"), _cells(right, *b, cell, "b")
    meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    if how == "left_semi":
        first = (x["__cell"] == y["__cell"]) & meets
        for c in on:
            first = first & (x[c] == y[c])
        found = x.join(y, first, "left_semi").select(*names, "__copies").dropDuplicates(names)
        return found.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names)
    once = F.col("__cell") == F.greatest("__low_a", "__low_b")
    return x.join(y, [*on, "__cell"]).where(meets & once).drop("__cell", "__low_a", "__low_b")


def point_join(points: DataFrame, windows: DataFrame, on: list[str], at: str, window: tuple[str, str], cell: float) -> DataFrame:
    """Points with every window of the same keys that holds them, both ends included."""
    x = points.withColumn("__cell", F.floor(F.col(at) / cell))
    y = windows.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(window[0]) / cell), F.floor(F.col(window[1]) / cell))))
    return x.join(y, [*on, "__cell"]).where(F.col(at).between(F.col(window[0]), F.col(window[1]))).drop("__cell")


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, a: tuple[str, str], b: tuple[str, str], cell: float) -> DataFrame:
    """For each left interval the right one with the largest Dice coefficient (the least id among equals)."""
    pairs = interval_join(left, right, on, a, b, cell).withColumn("dice", dice(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])))
    best = pairs.groupBy(left_id).agg(F.max(F.struct(F.col("dice"), (-F.col(right_id)).alias("m"))).alias("s"))
    return best.select(left_id, (-F.col("s.m")).alias(right_id), F.col("s.dice").alias("dice"))


def mutual_best(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, a: tuple[str, str], b: tuple[str, str], cell: float, least: float) -> DataFrame:
    """Pairs of intervals that are each the best of the other by Dice coefficient, which is ``least`` or more; the least id among equals. One to one."""
    pairs = interval_join(left, right, on, a, b, cell).withColumn("dice", dice(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))).where(F.col("dice") >= least)
    first = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc(F.round("dice", 9)), other))
    return pairs.withColumn("__l", first(left_id, right_id)).withColumn("__r", first(right_id, left_id)).where("__l = 1 and __r = 1").drop("__l", "__r")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the right row that is last at or before it, first at or after it, or nearest.

    Both sides are merged in order and the last (next) right row is carried along: one shuffle on
    ``by`` and a sort, no pairs. ``on`` is a number; right rows equal in it must be told apart
    by their values. Of equally near rows the earlier wins. Outside the tolerance gives nulls.
    """
    side = F.struct(F.col(on).alias("at"), *take)
    x = left.withColumn("__r", F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType)).withColumn("__side", F.lit(1))
    y = right.select(*by, on, side.alias("__r")).withColumn("__side", F.lit(0))
    both = x.unionByName(y, allowMissingColumns=True)
    keys = Window.partitionBy(*by)
    back = F.last("__r", True).over(keys.orderBy(F.col(on), F.col("__side"), F.col("__r")).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("__r", True).over(keys.orderBy(F.col(on).desc(), F.col("__side"), F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    if direction == "backward":
        chosen = both.withColumn("__p", back)
    elif direction == "forward":
        chosen = both.withColumn("__p", ahead)
    else:
        near = F.when(F.col("__b").isNull(), F.col("__f")).when(F.col("__f").isNull(), F.col("__b")).when(F.col(on) - F.col("__b.at") <= F.col("__f.at") - F.col(on), F.col("__b")).otherwise(F.col("__f"))
        chosen = both.withColumn("__b", back).withColumn("__f", ahead).withColumn("__p", near).drop("__b", "__f")
    found = chosen.where("__side = 1")
    if tolerance is not None:
        found = found.withColumn("__p", F.when(F.abs(F.col(on) - F.col("__p.at")) <= tolerance, F.col("__p")))
    return found.select(*left.columns, F.col("__p.at").alias(f"{on}_matched"), *(F.col(f"__p.{c}").alias(c) for c in take))


def split_intervals(df: DataFrame, start: str, end: str, longest: float, least: float) -> DataFrame:
    """Intervals of numbers in pieces of at most ``longest``; a last piece shorter than ``least`` goes, unless it is the only one."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / longest))
    pieces = df.withColumn("piece", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    low = F.col(start) + F.col("piece") * longest
    return pieces.withColumn("piece_start", low).withColumn("piece_end", F.least(F.col(end), low + longest)).where((F.col("piece") == 0) | (F.col("piece_end") - F.col("piece_start") >= least))


def clamp_duration(start: Column, end: Column, least: float, most: float) -> Column:
    """The end that makes the duration lie between the bounds."""
    return start + F.greatest(F.lit(least), F.least(F.lit(most), end - start))


def baseline_window(start: Column, length: float, gap: float) -> tuple[Column, Column]:
    """The window of ``length`` that ends ``gap`` before the start."""
    return start - gap - length, start - gap


def _per_group(df: DataFrame, by: list[str], fold, schema: str) -> DataFrame:
    return df.groupBy(*by).applyInPandas(fold, schema)


def _streamed(df: DataFrame, by: list[str], order: list[str], start, step, schema: StructType) -> DataFrame:
    """Each group's rows in order through ``step(state, row) -> value or None``, which sees one row at a time; rows with a value stay.

    ``start()`` makes the state of a group. A task holds one batch and one state, however large the group is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            values = []
            for own, row in zip(zip(*(rows[c] for c in by)), rows[order].itertuples(index=False, name=None)):
                if own != key:
                    key, state = own, start()
                values.append(step(state, row))
            kept = [v is not None for v in values]
            out = rows[kept]
            if len(schema.fields) > len(rows.columns):
                out = out.assign(**{schema.fields[-1].name: [v for v in values if v is not None]})
            yield out

    # dealt by a hash of its own: where both sides of a union lie by ``by`` already, Spark leaves out a shuffle by the same columns,
    # and adaptive execution then joins the partitions of each side in its own way, which tears groups apart
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def disjoint_subset(df: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """The most intervals of a group that share no point inside: always the one that ends first, and starts after the last."""

    def step(last: list, row: tuple):
        if row[1] < last[0]:
            return None
        last[0] = row[0]
        return True

    return _streamed(df, by, [end, start, tie], lambda: [float("-inf")], step, df.schema)


def greedy_dice_dedup(df: DataFrame, by: list[str], start: str, end: str, tie: str, limit: float) -> DataFrame:
    """Keeps intervals in the order of their centrality (the sum of Dice coefficients with the group) unless one already kept is closer than ``limit``.

    A group is one segment of the union of intervals, so it is bounded by what overlaps.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[start].to_numpy(), rows[end].to_numpy()
        length = b - a

        def row(i: int):
            import numpy as np

            shared = np.clip(np.minimum(b, b[i]) - np.maximum(a, a[i]), 0, None)
            total = length + length[i]
            return np.where(total > 0, 2 * shared / np.where(total > 0, total, 1), 0)

        order = sorted(range(len(rows)), key=lambda i: (-round(float(row(i).sum()), 9), rows[tie].iloc[i]))
        kept: list[int] = []
        for i in order:
            near = row(i)
            if all(near[j] <= limit for j in kept):
                kept.append(i)
        return rows.iloc[sorted(kept)]

    return _per_group(df, by, fold, df.schema)


def gap_span_clusters(df: DataFrame, by: list[str], at: str, tie: str, gap: float, span: float) -> DataFrame:
    """Clusters in order of time; a new one starts after a gap, or when the cluster would span too much."""

    def step(state: dict, row: tuple) -> int:
        t = row[0]
        if not state:
            state.update(first=t, number=0)
        elif t - state["last"] > gap or t - state["first"] > span:
            state.update(first=t, number=state["number"] + 1)
        state["last"] = t
        return state["number"]

    return _streamed(df, by, [at, tie], dict, step, StructType([*df.schema.fields, StructField("cluster", LongType())]))


def greedy_insert(new: DataFrame, existing: DataFrame, by: list[str], start: str, end: str, tie: str, limit: float, cell: float = 24.0) -> DataFrame:
    """New intervals, in order of start, end and tie, that have no Dice coefficient above ``limit`` with an existing one or one inserted before.

    Existing intervals are matched by cells; then the rest is streamed in order. Only inserted
    intervals that have not ended yet can be close to a later one, so only those are held. tie tells
    intervals that are equal otherwise apart; ``cell`` is near the usual length of the intervals.
    """
    fresh = new.select(*by, start, end, tie)
    x = fresh.select(*(F.col(c).alias(f"__{c}") for c in (start, end, tie)), *by)
    y = existing.select(*by, F.col(start).alias("__c"), F.col(end).alias("__d"))
    pairs = interval_join(x, y, by, (f"__{start}", f"__{end}"), ("__c", "__d"), cell)
    close = pairs.where(dice(F.col(f"__{start}"), F.col(f"__{end}"), F.col("__c"), F.col("__d")) > limit)
    taken = close.select(*by, *(F.col(f"__{c}").alias(c) for c in (start, end, tie))).distinct()
    open_ = fresh.join(taken, [*by, start, end, tie], "left_anti")

    def step(held: list, row: tuple):
        a, b = row[0], row[1]
        held[:] = [(c, d) for c, d in held if d > a]
        for c, d in held:
            if (b - a + d - c) > 0 and 2 * max(0.0, min(b, d) - max(a, c)) / (b - a + d - c) > limit:
                return None
        held.append((a, b))
        return True

    return _streamed(open_, by, [start, end, tie], list, step, open_.schema).select(*fresh.columns)
