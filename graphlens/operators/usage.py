"""Roll-ups of the request log: usage, top lists, estimated savings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.routes import integration, normalise_route, route_saving

N = lambda: F.count(F.lit(1))


def in_window(log: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Rows of the last hours; the bound is a literal, so the scan can skip by it."""
    return log.filter(F.col("ts") >= F.lit(as_of - timedelta(hours=hours)))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def usage_totals(log: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    errors = F.count_if(F.col("status") >= 400)
    return in_window(log, as_of, hours).agg(
        N().alias("total_calls"),
        F.round(N() / float(hours), 1).alias("calls_per_hour"),
        F.countDistinct("token_name").alias("distinct_tokens"),
        _pct(errors, N()).alias("error_rate_pct"),
    )


def top_tokens(log: DataFrame, as_of: datetime, hours: int = 24, k: int = 10) -> DataFrame:
    return (
        in_window(log, as_of, hours)
        .groupBy("token_id", F.coalesce("token_name", F.lit("anonymous")).alias("token_name"))
        .agg(N().alias("calls"), F.max("ts").alias("last_call"), F.max_by("status", "id").alias("last_status"))
        .orderBy(F.col("calls").desc(), "token_name")
        .limit(k)
    )


def route_latency(log: DataFrame, share: float = 0.95) -> DataFrame:
    """Calls, exact interpolated percentile and error share per (route, method).

    Equal durations are counted first, so what is gathered for a busy route
    is one entry per distinct duration, not one per call.
    """
    per_ms = log.groupBy("route", "method", "duration_ms").agg(
        N().alias("n"), F.count_if(F.col("status") >= 400).alias("bad")
    )
    return per_ms.groupBy("route", "method").agg(
        F.sum("n").alias("calls"),
        F.rint(F.coalesce(F.percentile("duration_ms", F.lit(share), F.col("n")), F.lit(0.0))).cast("int").alias("p95"),
        F.round(100.0 * F.sum("bad") / F.sum("n"), 1).alias("error_rate_pct"),
    )


def top_endpoints(log: DataFrame, as_of: datetime, hours: int = 24, k: int = 12) -> DataFrame:
    return (
        route_latency(in_window(log, as_of, hours))
        .orderBy(F.col("calls").desc(), "route", "method")
        .limit(k)
    )


def recent_calls(log: DataFrame, k: int = 20) -> DataFrame:
    """The newest rows, whatever their age."""
    return log.orderBy(F.col("id").desc()).limit(k)


def saving_calls(log: DataFrame, *keys: str) -> DataFrame:
    """Calls and tokens spared per normal route and `keys`.

    Raw routes are counted before they are normalised: the text work is done
    once per route, not once per call. Routes that spare nothing are dropped.
    """
    raw = log.groupBy("route", *keys).agg(N().alias("calls"))
    named = raw.withColumn("route", normalise_route(F.col("route"))).withColumn("each", route_saving(F.col("route")))
    return (
        named.filter(F.col("each") > 0)
        .groupBy("route", *keys)
        .agg(F.sum("calls").alias("calls"), F.sum(F.col("calls") * F.col("each")).alias("tokens_saved"))
    )


def _dollars(price: Column, digits: int = 4) -> Column:
    return F.round(F.col("tokens_saved") * price / 1e6, digits).alias("dollars_saved")


def savings_by_route(log: DataFrame, price: Column, as_of: datetime, hours: int = 24, k: int | None = 15) -> DataFrame:
    out = saving_calls(in_window(log, as_of, hours)).select(
        "route", integration(F.col("route")).alias("integration"), "calls", "tokens_saved", _dollars(price)
    )
    return out.orderBy(F.col("tokens_saved").desc(), "route").limit(k) if k else out


def savings_total(log: DataFrame, price: Column) -> DataFrame:
    """Tokens and dollars over everything in `log`; pass a window of it as needed."""
    return (
        saving_calls(log)
        .agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"))
        .select("tokens_saved", _dollars(price, 2))
    )


def savings_by_token(log: DataFrame, price: Column, as_of: datetime, hours: int = 24, k: int = 10) -> DataFrame:
    named = in_window(log, as_of, hours).withColumn("token_name", F.coalesce("token_name", F.lit("anonymous")))
    return (
        saving_calls(named, "token_id", "token_name")
        .groupBy("token_id", "token_name")
        .agg(F.sum("calls").alias("calls"), F.sum("tokens_saved").alias("tokens_saved"))
        .select("token_id", "token_name", "calls", "tokens_saved", _dollars(price))
        .orderBy(F.col("tokens_saved").desc(), "token_name", "token_id")
        .limit(k)
    )


def savings_by_integration(log: DataFrame, price: Column, as_of: datetime, hours: int = 24) -> DataFrame:
    return (
        saving_calls(in_window(log, as_of, hours))
        .groupBy(integration(F.col("route")).alias("integration"))
        .agg(F.sum("calls").alias("calls"), F.sum("tokens_saved").alias("tokens_saved"))
        .select("integration", "calls", "tokens_saved", _dollars(price))
    )


def savings_daily(log: DataFrame, price: Column, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row per UTC day with savings; days without any are left out."""
    dated = in_window(log, as_of, hours).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return (
        saving_calls(dated, "day")
        .groupBy("day")
        .agg(F.sum("tokens_saved").alias("tokens_saved"))
        .select("day", "tokens_saved", _dollars(price))
    )


def savings_summary(log: DataFrame, price: Column, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row with every savings report nested; each list is bounded by its report."""

    def nested(df: DataFrame, name: str, *order: Column) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("r")))).alias("l")).select(
            F.transform("l", lambda x: x["r"]).alias(name)
        )

    down = (-F.col("tokens_saved")).alias("o")
    window = in_window(log, as_of, hours)
    saving = savings_by_integration(log, price, as_of, hours)
    parts = [
        window.agg(N().alias("total_calls")),
        saving.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls_saving")),
        savings_total(window, price),
        savings_total(log, price).select(
            F.col("tokens_saved").alias("lifetime_tokens_saved"), F.col("dollars_saved").alias("lifetime_dollars_saved")
        ),
        nested(savings_by_route(log, price, as_of, hours), "by_route", down, F.col("route").alias("p")),
        nested(savings_by_token(log, price, as_of, hours), "by_token", down, F.col("token_name").alias("p")),
        nested(saving, "by_integration", down, F.col("integration").alias("p")),
        nested(savings_daily(log, price, as_of, hours), "daily", F.col("day").alias("o")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        row = p.select(F.struct("*").alias("row")).scalar()
        out = out.withColumn("_row", row).select(*out.columns, "_row.*")
    return out.withColumn("window_hours", F.lit(hours))


def shares(df: DataFrame, value: str) -> DataFrame:
    """Share of the sum and of the maximum, in percent, for a report of few rows."""
    every = Window.partitionBy()
    total, top = F.sum(value).over(every), F.max(value).over(every)
    return df.withColumn("pct_of_total", F.round(F.when(total > 0, 100.0 * F.col(value) / total).otherwise(0.0), 3)).withColumn(
        "pct_of_max", F.round(F.when(top > 0, 100.0 * F.col(value) / top).otherwise(0.0), 3)
    )
