"""Repos a provider reports against the repos the registry holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.text import render_slug
from graphlens.operators.runs import ingest_mode

DEFAULT_TEMPLATE = "{owner}-{name}"


def visible(discovered: DataFrame, specs: DataFrame) -> DataFrame:
    """Reported repos that the settings of their source let in.

    `specs` has source_id, kind, include_private, include_forks,
    include_archived. Bitbucket has no archived repos to leave out.
    """
    keep = (
        (F.col("include_private") | ~F.col("private"))
        & (F.col("include_forks") | ~F.col("fork"))
        & (F.col("include_archived") | ~F.col("archived") | (F.col("kind") == "bitbucket_workspace"))
    )
    return discovered.join(specs, "source_id").filter(keep).select(*discovered.columns)


def link_repos(discovered: DataFrame, links: DataFrame, registry: DataFrame, template: Column | None = None) -> DataFrame:
    """What registering each reported repo would do.

    already: linked before. taken: the slug belongs to a repo registered by
    hand. owned: it belongs to another source. relink: it is this source's own
    repo without a link. new: to be registered and queued. Rows are judged as
    if they arrived in the order of (source_id, external_id), so within one
    batch the first claim on a slug wins.
    """
    slug = render_slug(template if template is not None else F.lit(DEFAULT_TEMPLATE), F.col("owner"), F.col("name"), F.col("full_name"))
    linked = links.select("source_id", "full_name", F.lit(True).alias("linked")).distinct()
    held = registry.select(F.col("id").alias("slug"), F.col("source_id").alias("holder"), F.lit(True).alias("held"))
    open_ = (
        discovered.withColumn("slug", slug)
        .join(linked, ["source_id", "full_name"], "left")
        .join(held, "slug", "left")
    )
    fresh = F.col("linked").isNull()
    first_claim = (
        open_.filter(fresh & F.col("held").isNull())
        .groupBy("slug")
        .agg(F.min(F.struct("source_id", "external_id")).alias("claim"))
    )
    first_name = open_.filter(fresh).groupBy("source_id", "full_name").agg(F.min("external_id").alias("first_id"))
    repeat = F.col("external_id") != F.col("first_id")
    mine = F.col("claim.source_id") == F.col("source_id")
    status = (
        F.when(~fresh, "already")
        .when(F.col("held") & F.col("holder").isNull(), "taken")
        .when(F.col("held") & (F.col("holder") != F.col("source_id")), "owned")
        .when(F.col("held"), F.when(repeat, "already").otherwise("relink"))
        .when(mine & (F.col("claim.external_id") == F.col("external_id")), "new")
        .when(mine, F.when(repeat, "already").otherwise("relink"))
        .otherwise("owned")
    )
    return (
        open_.join(first_claim, "slug", "left")
        .join(first_name, ["source_id", "full_name"], "left")
        .select("source_id", "external_id", "full_name", "slug", status.alias("status"))
    )


def sync_stats(linked: DataFrame) -> DataFrame:
    """Counters of one sync per source."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return linked.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("discovered"), n("new").alias("added"), n("already", "relink").alias("already"),
        n("taken", "owned").alias("skipped"), n("new").alias("queued"),
    )


def sync_errors(linked: DataFrame) -> DataFrame:
    """One row per repo that could not be registered."""
    why = F.when(F.col("status") == "taken", "is registered by hand").otherwise("belongs to another source")
    return linked.filter(F.col("status").isin("taken", "owned")).select(
        "source_id", "external_id", F.concat("full_name", F.lit(": slug "), "slug", F.lit(" "), why).alias("error")
    )


def match_events(events: DataFrame, links: DataFrame, repos: DataFrame) -> DataFrame:
    """Push events with the tracked repo they concern and the run to queue.

    Works on a stream of events too: both joins are stream-static left joins.
    """
    known = links.select("source_id", "full_name", F.col("repo_id").alias("linked_id"))
    held = repos.select(F.col("id").alias("repo_id"), "last_indexed_at")
    return (
        events.join(known, ["source_id", "full_name"], "left")
        .join(held, F.col("linked_id") == F.col("repo_id"), "left")
        .withColumn("matched", F.col("repo_id").isNotNull())
        .withColumn("mode", F.when(F.col("matched"), ingest_mode(F.col("last_indexed_at"))))
        .drop("linked_id", "last_indexed_at")
    )
