"""Aggregates and statistics: bins, pivots, counters, baselines against incidents, change points, regressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from tracewarden.functions.scalars import bin_of
from tracewarden.operators.ranks import quantiles


def binned(df: DataFrame, ts: str, minutes: int, keys: list[str], aggs: list[Column]) -> DataFrame:
    """One row per bin and keys; rows without a time are dropped, null keys kept."""
    return df.where(F.col(ts).isNotNull()).groupBy(bin_of(F.col(ts), minutes).alias("bin"), *keys).agg(*aggs)


def pivoted(df: DataFrame, keys: list[str], name: str, names: list[str], value: str) -> DataFrame:
    """Mean, minimum, maximum, sample deviation and count of ``value`` for each of the given names, in columns."""
    out = []
    for n in names:
        own = F.when(F.col(name) == n, F.col(value))
        out += [F.avg(own).alias(f"{n}_mean"), F.min(own).alias(f"{n}_min"), F.max(own).alias(f"{n}_max"), F.stddev_samp(own).alias(f"{n}_std"), F.count(own).alias(f"{n}_count")]
    return df.groupBy(*keys).agg(*out)


#: Names of numeric columns that tell of traffic, and endings of counters, whose change counts.
TRAFFIC, COUNTERS = r"(?i)_flow_|^(?:dns_|web_|auth_|elephant_)", ("_total", "_sum", "_count")


def traffic_columns(df: DataFrame) -> list[str]:
    """The numeric columns whose name tells of traffic."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and re.search(TRAFFIC, f.name)]


def traffic_wide(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Mean and maximum of each traffic column per keys and kind, one flat column traffic_kind_column_mean (max) for each of the given kinds."""
    out = []
    for k in kinds:
        for c in traffic_columns(df):
            own = F.when(F.col(kind) == k, F.col(c))
            out += [F.avg(own).alias(f"traffic_{k}_{c}_mean"), F.max(own).alias(f"traffic_{k}_{c}_max")]
    return df.groupBy(*keys).agg(*out)


def counters_as_changes(df: DataFrame, series: list[str], ts: str, tie: str) -> DataFrame:
    """``df`` with every traffic column whose name ends as a counter's does replaced by its change within the series, never below 0; the first row of a series has none."""
    w = Window.partitionBy(*series).orderBy(ts, tie)
    own = [c for c in traffic_columns(df) if c.lower().endswith(COUNTERS)]
    return df.withColumns({c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in own}) if own else df


def flat_names(df: DataFrame) -> DataFrame:
    """Columns of structs as columns of their own, named by both with an underscore."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name}") for x in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def states(rows: DataFrame, keys: list[str], state: str, order: list[str], best: str) -> DataFrame:
    """(keys, best, last): the first state of each key, or ``best`` if it ever had that; and the last one."""
    place = F.struct(*order)
    ever = F.bool_or(F.lower(state) == best.lower())
    return rows.groupBy(*keys).agg(F.when(ever, F.lit(best)).otherwise(F.min_by(state, place)).alias("best"), F.max_by(state, place).alias("last"))


def rebuilt_rates(rows: DataFrame, keys: list[str], step: str, amount: str, span: str, inside: tuple[int, int], before: tuple[int, int], least: float = 0.5) -> DataFrame:
    """Rates per step inside a window against those before it, the ratio of mean positive spans, and an error rate of 1 where the rate fell below ``least`` of its baseline; keys with a baseline only."""
    now, base = F.col(step).between(*inside), F.col(step).between(*before)
    rate = lambda test, w: F.sum(F.when(test, F.col(amount))) / float(w[1] - w[0] + 1)
    mean = lambda test: F.avg(F.when(test & (F.col(span) > 0), F.col(span)))
    x = rows.groupBy(*keys).agg(rate(now, inside).alias("now"), rate(base, before).alias("base"), mean(now).alias("span"), mean(base).alias("span0")).where("base > 0 and now is not null")
    ratio = F.col("now") / F.col("base")
    return x.select(*keys, ratio.alias("rate_ratio"), (F.col("span") / F.col("span0")).alias("span_ratio"), F.when(ratio < least, 1.0).otherwise(0.0).alias("error_rate"))


def frequent(df: DataFrame, name: str, k: int) -> DataFrame:
    """Rows of the ``k`` most frequent names (the least name among equals)."""
    top = df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k).select(name)
    return df.join(top, name, "left_semi")


def counter_diff(df: DataFrame, series: list[str], ts: str, tie: str, value: str, out: str = "diff", clip: bool = False) -> DataFrame:
    """The change from the row before within each series; the first row goes. clip: never below 0."""
    w = Window.partitionBy(*series).orderBy(ts, tie)
    change = F.col(value) - F.lag(value).over(w)
    found = df.withColumn(out, change).where(F.col(out).isNotNull())
    return found.withColumn(out, F.greatest(F.lit(0.0), F.col(out))) if clip else found


def counter_rate(df: DataFrame, series: list[str], ts: str, tie: str, value: str, out: str = "rate") -> DataFrame:
    """The change per minute; rows without time between them, and resets, have none and go."""
    w = Window.partitionBy(*series).orderBy(ts, tie)
    minutes = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / F.lit(60e6)
    change = F.col(value) - F.lag(value).over(w)
    return df.withColumn("__m", minutes).withColumn("__c", change).where("__m > 0 and __c >= 0").withColumn(out, F.col("__c") / F.col("__m")).drop("__m", "__c")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails if a key of the right side is not unique."""
    checked = right.withColumn("__n", F.count("*").over(Window.partitionBy(*on))).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("right keys are not unique"))).otherwise(F.lit(True)))
    return left.join(checked.where("__ok").drop("__n", "__ok"), on, "left")


def robust_deviation(df: DataFrame, columns: list[str], keys: list[str], k: int) -> DataFrame:
    """The ``k`` columns of each row that are furthest from their median, in interquartile ranges (one that is near 0 counts as 1)."""
    long = df.unpivot(keys, columns, "name", "value").where("value is not null")
    scale = quantiles(long.select("name", "value"), "value", [0.25, 0.5, 0.75], ["name"])
    spread = F.col("q")[2] - F.col("q")[0]
    far = long.join(F.broadcast(scale), "name").withColumn("deviation", (F.col("value") - F.col("q")[1]) / F.when(F.abs(spread) < 1e-12, 1.0).otherwise(spread)).drop("q")
    return far.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("deviation")), "name"))).where(F.col("rank") <= k)


def baseline_stats(rows: DataFrame, keys: list[str], value: str, inside: str, ts: str) -> DataFrame:
    """Baseline (not ``inside``) against incident (``inside``) for each key: medians, p95, peak, trough, changes and a clipped robust z."""
    base = rows.where(~F.col(inside)).groupBy(*keys).agg(F.percentile(value, 0.5).alias("base_median"), F.percentile(value, 0.95).alias("base_p95"), F.count("*").alias("n_base"))
    spread = rows.where(~F.col(inside)).join(base, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("base_median")), 0.5).alias("mad"))
    own = rows.where(F.col(inside)).groupBy(*keys).agg(F.max(value).alias("peak"), F.min(value).alias("trough"), F.percentile(value, 0.5).alias("median"), F.count("*").alias("n_inside"), F.min_by(ts, F.struct((-F.col(value)).alias("v"), ts)).alias("peak_time"))
    scale = F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(1e-6))
    nonzero = F.greatest(F.abs("base_median"), F.lit(1e-6))
    return own.join(base, keys).join(spread, keys).withColumn("relative_change", (F.col("peak") - F.col("base_median")) / nonzero).withColumn("drop_ratio", (F.col("base_median") - F.col("trough")) / nonzero).withColumn(
        "z", F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.col("peak") - F.col("base_median")) / scale))
    )


def cusum(df: DataFrame, by: list[str], ts: str, tie: str, z: str, drift: float = 0.5) -> DataFrame:
    """The time at which the running sum of z - drift peaks, and that sum; only groups where it is above 0."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    summed = df.withColumn("__s", F.sum(F.col(z) - drift).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = summed.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("__s", 9)), ts, tie))).where("__r = 1 and __s > 0")
    return best.select(*by, F.col(ts).alias("change_time"), F.col("__s").alias("change_sum"))


def appeared_and_gone(rows: DataFrame, keys: list[str], series: str, inside: str) -> DataFrame:
    """Series seen only inside the incident, or only in its baseline."""
    sides = rows.groupBy(*keys, series).agg(F.bool_or(inside).alias("now"), F.bool_or(~F.col(inside)).alias("before"))
    return sides.where("now <> before").select(*keys, series, F.when(F.col("now"), "appeared").otherwise("disappeared").alias("change"))


def lagged_regression(df: DataFrame, by: list[str], step: str, x: str, y: str, lags: int, normal: Column) -> DataFrame:
    """The lag of 0..``lags`` steps at which x correlates best with y, and y regressed on x at it, over rows where ``normal``.

    x is moved along by an equality join on the step, so one row meets lags + 1 others.
    """
    moved = df.select(*by, F.col(step).alias("__s"), F.col(x).alias("__x")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn(step, F.col("__s") + F.col("lag"))
    pairs = df.where(normal).select(*by, step, F.col(y).alias("__y")).join(moved.select(*by, step, "lag", "__x"), [*by, step])
    per_lag = pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("r"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept")).where("n >= 3 and r is not null and not isnan(r)")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs("r"), 9)), "lag"))
    return per_lag.withColumn("__r", rank).where("__r = 1").drop("__r")


def trailing_z(df: DataFrame, by: list[str], ts: str, value: str, hours: int, least: int) -> DataFrame:
    """(value - median) / IQR over the hours before each row; null with fewer than ``least`` rows or no spread."""
    w = Window.partitionBy(*by).orderBy(F.col("__t")).rangeBetween(-hours * 3_600_000_000, -1)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    out = df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__q", q).withColumn("__n", F.count(value).over(w))
    spread = F.col("__q")[2] - F.col("__q")[0]
    return out.withColumn("z", F.when((F.col("__n") >= least) & (spread >= 1e-9), (F.col(value) - F.col("__q")[1]) / spread)).drop("__t", "__q", "__n")


def imputed_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's median; then mean 0 and population deviation 1 (a deviation of 0 counts as 1)."""
    kept = [c for c in df.columns if c not in columns]
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "value")
    middles = quantiles(long, "value", [0.5], ["name"]).select("name", F.col("q")[0].alias("m"))
    middle = middles.agg(F.map_from_entries(F.collect_list(F.struct("name", "m")))).scalar()  # one entry for each column
    filled = df.withColumn("__m", middle).select(*kept, *(F.coalesce(F.col(c), F.col("__m")[c], F.lit(0.0)).alias(c) for c in columns))
    scale = filled.agg(F.struct(*(F.avg(c).alias(f"a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))).scalar()
    deviation = {c: F.when(F.col(f"__s.s_{c}") > 0, F.col(f"__s.s_{c}")).otherwise(1.0) for c in columns}
    return filled.withColumn("__s", scale).select(*kept, *(((F.col(c) - F.col(f"__s.a_{c}")) / deviation[c]).alias(c) for c in columns))
