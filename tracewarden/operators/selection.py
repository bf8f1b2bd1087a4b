"""Selections, votes and lookups on tables of any names: prefixes of addresses, windows over series, stability of ranks, gates, and decisions about incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(addresses: DataFrame, networks: DataFrame, lengths: tuple[int, ...], width: int = 32) -> DataFrame:
    """(address columns, owner): the owner of the most specific network that holds an address.

    ``addresses`` has ip, ``networks`` has net, bits and owner (whole numbers). An address is cut to every length in use, so
    networks are found by equality; of equally specific ones the least owner wins. Addresses in no network are left out.
    """
    lead = lambda c, bits: F.call_function("shiftrightunsigned", c, (width - bits).cast("int"))
    cut = addresses.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)))).withColumn("__lead", lead(F.col("ip"), F.col("bits")))
    found = cut.join(networks.select("owner", "bits", lead(F.col("net"), F.col("bits")).alias("__lead")), ["bits", "__lead"])
    return found.groupBy(*addresses.columns).agg(F.max_by("owner", F.struct("bits", (-F.col("owner")).alias("o"))).alias("owner"))


def round_robin(df: DataFrame, strata: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` rows: the first of every stratum, then the second of every one, and so on; strata by their names."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("__place", place).orderBy("__place", *strata).limit(k).drop("__place")


def window_errors(df: DataFrame, by: list[str], order: str, value: str, size: int, stride: int, out: str = "error") -> DataFrame:
    """(by, order, error): the mean, over the windows of ``size`` rows that hold a row, of the population deviation within the window; a new one starts every ``stride`` rows."""
    placed = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    first = F.floor(F.col("__i") / stride)
    held = placed.withColumn("__k", F.explode(F.filter(F.sequence(F.greatest(F.lit(0), first - (size - 1) // stride), first), lambda k: F.col("__i") < k * stride + size)))
    errors = held.groupBy(*by, "__k").agg(F.stddev_pop(value).alias("__e"))
    return held.join(errors, [*by, "__k"]).groupBy(*by, order).agg(F.avg("__e").alias(out))


def rank_stability(scores: DataFrame, group: list[str], node: str, repeat: str, score: str, repeats: int) -> DataFrame:
    """(group, node, top1, top3, mean_rank, rank_std): how often, of ``repeats``, a node is among the first, and how its rank spreads; ranks by falling score, then name."""
    ranked = scores.withColumn("__k", F.row_number().over(Window.partitionBy(repeat, *group).orderBy(F.desc(score), node)))
    share = lambda n: F.count_if(F.col("__k") <= n) / float(repeats)
    return ranked.groupBy(*group, node).agg(share(1).alias("top1"), share(3).alias("top3"), F.avg("__k").alias("mean_rank"), F.stddev_pop("__k").alias("rank_std"))


def criteria_rank(scores: DataFrame, group: list[str], node: str, criterion: str, score: str, weights: dict[str, float]) -> DataFrame:
    """(group, node, mean_rank): the weighted mean of a node's ranks under several criteria; where it has none it counts as last of the group."""
    ranked = scores.withColumn("__r", F.row_number().over(Window.partitionBy(*group, criterion).orderBy(F.desc(score), node)))
    last = ranked.groupBy(*group).agg(F.count_distinct(node).alias("__n"))
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.max(F.when(F.col(criterion) == name, F.col("__r"))), F.col("__n"))
    return ranked.join(last, group).groupBy(*group, node, "__n").agg(total.alias("mean_rank")).drop("__n")


def gate(df: DataFrame, keys: list[str], value: str, least: float, k: int) -> DataFrame:
    """(keys, n, n_high): keys with ``k`` rows or more whose value is ``least`` or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value) >= least).alias("n_high")).where(F.col("n_high") >= k)


def element_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, names): elements at int(share * (n - 1)) in order; by row number, so no group is held in one array."""
    whole = Window.partitionBy(*group)
    placed = df.withColumn("__i", F.row_number().over(whole.orderBy(value)) - 1).withColumn("__n", F.count("*").over(whole))
    return placed.groupBy(*group).agg(*(F.max(F.when(F.col("__i") == F.floor(s * (F.col("__n") - 1)), F.col(value))).alias(name) for name, s in shares.items()))


def firsts(observations: DataFrame, node: str, ts: str, source: str, priority: str) -> DataFrame:
    """(node, first, source, n, n_sources): the first observation of each node, of equal times that of the least priority."""
    return observations.groupBy(node).agg(F.min(ts).alias("first"), F.min_by(source, F.struct(ts, priority)).alias("source"), F.count("*").alias("n"), F.count_distinct(source).alias("n_sources"))


def prediction_window(points: DataFrame, group: list[str], score: str, ts: str, tie: str, k: int, most: float, pad: float) -> DataFrame:
    """(group, a, b): from the first to the last of a group's ``k`` best points, or ``pad`` around the best one if that is longer than ``most``."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie, ts))
    best = points.withColumn("__r", place).where(F.col("__r") <= k)
    w = best.groupBy(*group).agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.min(F.when(F.col("__r") == 1, F.col(ts))).alias("c"))
    near = F.col("b") - F.col("a") <= most
    return w.select(*group, F.when(near, F.col("a")).otherwise(F.col("c") - pad).alias("a"), F.when(near, F.col("b")).otherwise(F.col("c") + pad).alias("b"))


def applied(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, a, b, n): incidents (id, a, b) after decisions (id, act, into): dropped ones go, merged ones become one with the one they name, those without a decision stay."""
    whole = incidents.join(decisions, "id", "left").where(F.coalesce("act", F.lit("keep")) != "drop")
    into = F.when(F.col("act") == "merge", F.col("into")).otherwise(F.col("id"))
    return whole.groupBy(into.alias("id")).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))
