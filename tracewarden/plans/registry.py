"""Where queries register, each with its DuckDB twin if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
#: The same points in SQL: events by user and hour, times in microseconds.
EVENTS = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
POINTS = f"{EVENTS}, pt AS (SELECT user_id, us // {HOUR} AS h, avg(value) AS m, max(value) AS mx, count(*) AS n FROM ev GROUP BY 1, 2)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the time in microseconds and the number in their properties."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Events by user and hour: mean, maximum and count of the value.

    Values are added up in the order of their ids, as SQL does in one thread: partial sums would make means that are
    equal differ in the last bit, and ranks with them. A window does it, which spills where one hour has many events.
    """
    rows = events(spark, folder).withColumn("h", F.floor(F.col("us") / HOUR))
    so_far = Window.partitionBy("user_id", "h").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = rows.select("user_id", "h", "event_id", "value", F.avg("value").over(so_far).alias("m"))
    return means.groupBy("user_id", "h").agg(F.max_by("m", "event_id").alias("m"), F.max("value").alias("mx"), F.count("*").alias("n"))
