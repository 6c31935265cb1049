"""Raw push deliveries as one stream: verified, read, replays dropped, matched to tracked repos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import webhooks
from graphlens.operators.registry import match_events

DELAY = "10 minutes"


def hooks(sources: DataFrame) -> DataFrame:
    """(source_id, secret, pads) of the sources (id, webhook_secret) that take deliveries."""
    known = sources.where("webhook_secret <> ''").select(F.col("id").alias("source_id"), F.col("webhook_secret").alias("secret"))
    return known.join(webhooks.padded_secrets(known), "secret")


def pushes(deliveries: DataFrame, known: DataFrame) -> DataFrame:
    """Genuine pushes (source_id, delivery_id, ts, full_name, ref) of raw deliveries.

    A delivery has source_id, delivery_id, ts, headers, body and query_token. Those of
    unknown sources, without proof of the secret, and of other events or broken
    bodies fall away. `known` is static (`hooks`), so a stream keeps no state for it.
    """
    h = F.col("headers")
    proved = deliveries.join(known, "source_id").where(
        webhooks.genuine(webhooks.provider(h), h, F.col("body"), F.col("secret"), F.col("query_token"), F.col("pads"))
    )
    said = proved.select("source_id", "delivery_id", "ts", webhooks.push(webhooks.provider(h), h, F.col("body")).alias("push"))
    return said.where("push is not null").select("source_id", "delivery_id", "ts", "push.*")


def runs(deliveries: DataFrame, known: DataFrame, links: DataFrame, repos: DataFrame, delay: str = DELAY) -> DataFrame:
    """The runs that raw deliveries ask for: each push once, with the tracked repo it concerns, and its ingest mode.

    Replays are dropped after the proof, so that a forged delivery cannot take the place
    of the genuine one whose id it bears. On a stream a replay is known for as long
    as the watermark allows; a table is looked at as a whole, its first delivery counts.
    """
    made = pushes(deliveries.withWatermark("ts", delay) if deliveries.isStreaming else deliveries, known)
    if deliveries.isStreaming:
        once = made.dropDuplicatesWithinWatermark(["source_id", "delivery_id"])
    else:
        rest = ["full_name", "ref"]
        first = F.min_by(F.struct(*rest), "ts").alias("r")
        once = made.groupBy("source_id", "delivery_id").agg(first, F.min("ts").alias("ts")).select("source_id", "delivery_id", "ts", "r.*")
    return match_events(once, links, repos)
