"""Bands that reports colour values by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stability_band(instability: Column) -> Column:
    return F.when(instability > 0.6, "unstable").when(instability > 0.3, "medium").otherwise("stable")


def error_band(rate_pct: Column) -> Column:
    return F.when(rate_pct > 20, "bad").when(rate_pct > 5, "warn").otherwise("ok")


def age_text(ts: Column, as_of: Column) -> Column:
    """How long ago, in the largest unit that fits: `12s ago`, `3h ago`."""
    seconds = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6)
    step = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(seconds < 0, "just now")
        .when(seconds < 60, step(1, "s"))
        .when(seconds < 3600, step(60, "m"))
        .when(seconds < 86400, step(3600, "h"))
        .otherwise(step(86400, "d"))
    )
