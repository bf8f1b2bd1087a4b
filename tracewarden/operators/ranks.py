"""Ranks and scales: over whole tables without a single partition, and within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import settled


def value_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, v, n, below): how often each value occurs, and how many rows of the same keys have smaller ones; nulls are left out.

    Values are counted first, then dealt by range; a running sum within each range is added to
    the totals of the ranges before it. Only one number per range and key meets in one task, also
    where one key has most of the rows.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = settled(counts.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()), "ranks")
    totals = dealt.groupBy("part", *keys).agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", *(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = dealt["part"] == before["part"]
    for k in keys:
        mine = mine & dealt[k].eqNullSafe(before[f"__{k}"])
    return dealt.withColumn("within", within).join(before, mine).select(*keys, "v", "n", (F.col("within") + F.col("before")).alias("below"))


def _at_places(ranked: DataFrame, keys: list[str], shares: list[float], n: Column, value: str = "v") -> DataFrame:
    """(keys, q): values interpolated between the rows at the two places next to share * (n - 1)."""

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))

    parts = []
    for share in shares:
        place = F.lit(share) * (n - 1)
        parts += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
    found = ranked.groupBy(*keys).agg(*(c.alias(f"__q{i}") for i, c in enumerate(parts)))
    q = [F.col(f"__q{i}") + (F.col(f"__q{i + 1}") - F.col(f"__q{i}")) * F.col(f"__q{i + 2}") for i in range(0, len(parts), 3)]
    return found.select(*keys, F.array(*q).alias("q"))


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q): exact interpolated quantiles as an array; no task holds the values of a key. No rows give no row, without keys a null."""
    keys = keys or []
    ranked = value_ranks(df, value, keys)
    total = ranked.groupBy(*keys).agg(F.sum("n").alias("__n"))
    if not keys:
        return _at_places(ranked.withColumn("__n", total.scalar()), keys, shares, F.col("__n"))
    named = total.select(*(F.col(k).alias(f"__{k}") for k in keys), "__n")
    mine = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return _at_places(ranked.join(named, mine).drop(*(f"__{k}" for k in keys)), keys, shares, F.col("__n"))


def at_quantile(df: DataFrame, value: str, share: float) -> Column:
    """One quantile of a whole table as a scalar subquery."""
    return quantiles(df, value, [share]).select(F.col("q")[0].alias("a")).scalar()


def rank_to_unit(df: DataFrame, value: str, out: str, shares: list[float] | None = None, edges: str = "edges") -> DataFrame:
    """``df`` with the average rank of ``value`` scaled to 0..1; null stays null and a single row gets 0.

    shares: also ``edges``, an array of these quantiles of ``out``, from the same counts.
    """
    ranked = value_ranks(df, value)
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select("total").scalar()
    unit = (F.col("below") + (F.col("n") - 1) / F.lit(2.0)) / F.greatest(F.lit(1), F.col("total") - 1)
    scaled = ranked.withColumn("total", total).withColumn("unit", unit)
    found = df.join(scaled.select(F.col("v").alias("__v"), F.col("unit").alias(out)), F.col(value) == F.col("__v"), "left").drop("__v")
    return found.withColumn(edges, _at_places(scaled, [], shares, F.col("total"), "unit").scalar()) if shares else found


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """A number from 1 for each row in the order of columns that identify rows."""
    key = F.struct(*order)
    dealt = settled(df.withColumn("__key", key).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()), "rows")
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__total"))
    before = parts.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return dealt.withColumn("__n", number).join(before, "__part").withColumn(out, F.col("__n") + F.col("__before")).drop("__key", "__part", "__n", "__before")


def rank_priority(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """1 for the least ``value`` of a group down to 0 for the largest, by dense rank; ties share theirs, all tied give 0 and a single row gets 1."""
    whole = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.dense_rank().over(whole.orderBy(value))).withColumn("__m", F.max("__r").over(whole)).withColumn("__n", F.count("*").over(whole))
    return ranked.withColumn(out, F.when(F.col("__n") == 1, 1.0).when(F.col("__m") == 1, 0.0).otherwise(1 - (F.col("__r") - 1) / (F.col("__m") - 1))).drop("__r", "__m", "__n")


def min_max(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Scaled to 0..1 within the group; no spread gives 0."""
    whole = Window.partitionBy(*group)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def earliest_first(df: DataFrame, group: list[str], ts: str, tie: str, out: str) -> DataFrame:
    """1 for the earliest row of a group down to 0 for the latest; a single row gets 1."""
    whole = Window.partitionBy(*group)
    n = F.count("*").over(whole)
    return df.withColumn(out, F.when(n == 1, 1.0).otherwise(1 - (F.row_number().over(whole.orderBy(ts, tie)) - 1) / (n - 1)))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def evenly_spaced(df: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """At most ``k`` rows of each group at evenly spaced places, the first and the last among them."""
    whole = Window.partitionBy(*group)
    numbered = df.withColumn("__i", F.row_number().over(whole.orderBy(order)) - 1).withColumn("__n", F.count("*").over(whole))
    # a row stays if some j of 0..k-1 lands on it: round(j * (n - 1) / (k - 1)) = i
    place = F.floor(F.col("__i") * (k - 1) / F.greatest(F.lit(1), F.col("__n") - 1) + 0.5)
    lands = F.round(place * (F.col("__n") - 1) / F.lit(k - 1)) == F.col("__i")
    return numbered.where((F.col("__n") <= k) | lands).drop("__i", "__n")


def clean_and_even(df: DataFrame, group: list[str], gap: str, order: str, tie: str, least: float, k: int) -> DataFrame:
    """At most ``k`` rows of each group: up to half, rounded up, with the largest gaps of ``least`` or more, the rest at evenly spaced places among the others."""
    whole = Window.partitionBy(*group)
    placed = df.withColumn("__c", F.row_number().over(whole.orderBy(F.desc(F.round(gap, 9)), order, tie)))
    marked = placed.withColumn("__clean", (F.col("__c") <= (k + 1) // 2) & (F.col(gap) >= least))
    counted = marked.withColumn("__need", k - F.count_if("__clean").over(whole))
    rest = Window.partitionBy(*group, "__clean")
    numbered = counted.withColumn("__i", F.row_number().over(rest.orderBy(order, tie)) - 1).withColumn("__n", F.count("*").over(rest))
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__need") - 1)), lambda j: F.round(j * (F.col("__n") - 1) / F.greatest(F.lit(1), F.col("__need") - 1)).cast("int"))
    lands = (F.col("__need") > 0) & ((F.col("__n") <= F.col("__need")) | F.array_contains(places, F.col("__i")))
    return numbered.where(F.col("__clean") | lands).select(*df.columns)


def rank_factor(df: DataFrame, group: list[str], value: str, tie: str, low: float, high: float, out: str) -> DataFrame:
    """A factor from ``low`` to ``high`` by the place of ``value`` in its group, in the middle of each place's share."""
    whole = Window.partitionBy(*group)
    share = (F.row_number().over(whole.orderBy(value, tie)) - 0.5) / F.count("*").over(whole)
    return df.withColumn(out, F.lit(low) + share * (high - low))
