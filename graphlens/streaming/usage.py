"""The request log as a stream: usage, savings, repeats, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.routes import normalise_route, route_saving

DELAY = "10 minutes"


def hourly_usage(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """Calls, errors and duration per hour and route.

    A 24-hour window sliding by an hour keeps 24 counts per key. Hourly counts
    keep one, and `trailing_day` adds them up.
    """
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour").alias("hour"), "route")
        .agg(
            F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") >= 400).alias("errors"),
            F.sum(F.col("duration_ms").cast("bigint")).alias("duration_ms"),
        )
        .select(F.col("hour.start").alias("hour_start"), F.col("hour.end").alias("hour_end"), "route", "calls", "errors", "duration_ms")
    )


def trailing_day(hourly: DataFrame) -> DataFrame:
    """Sums over the 24 hours up to the end of every hour, per route.

    Each hourly row is added to the 24 windows it lies in; the input is hourly
    already, so the rows multiplied are few.
    """
    ends = F.explode(F.sequence(F.col("hour_end"), F.col("hour_end") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR")))
    return (
        hourly.select("route", "calls", "errors", ends.alias("window_end"))
        .groupBy("window_end", "route")
        .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    )


def daily_savings(log: DataFrame, price: float, delay: str = DELAY) -> DataFrame:
    """Tokens and dollars (at `price` per million) spared per day; a day is final once the watermark passes it."""
    each = route_saving(normalise_route(F.col("route")))
    return (
        log.withWatermark("ts", delay)
        .withColumn("each", each)
        .filter(F.col("each") > 0)
        .groupBy(F.window("ts", "1 day").alias("day"))
        .agg(F.sum("each").alias("tokens_saved"))
        .select(
            F.date_format("day.start", "yyyy-MM-dd").alias("day"), "tokens_saved",
            F.round(F.col("tokens_saved") * F.lit(price) / 1e6, 4).alias("dollars_saved"),
        )
    )


def first_deliveries(deliveries: DataFrame, delay: str = DELAY) -> DataFrame:
    """Deliveries without replays that come within the delay."""
    return deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["delivery_id"])
