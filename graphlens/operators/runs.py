"""Ingest runs, sources, repos and tokens: latest states, progress, what is due."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import clean_error, filled

N = lambda: F.count(F.lit(1))
STATUSES = ("queued", "running", "success", "failed")
# Fixed values, in seconds: shortest poll interval, age of a lost queued run and of a dead running one.
INTERVAL_FLOOR = 60
QUEUED_AGE = 300
RUNNING_AGE = 1800


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the highest id per repo; an aggregate, so a busy repo is reduced map-side."""
    rest = [c for c in runs.columns if c != "repo_id"]
    return runs.groupBy("repo_id").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("repo_id", "r.*")


def queue_depth(runs: DataFrame) -> DataFrame:
    return latest_run(runs).agg(F.count_if(F.col("status") == "queued").alias("queue_depth"))


def ingest_summary(runs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= F.lit(as_of - timedelta(hours=hours)))
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return recent.agg(
        N().alias("total"), ok.alias("success"), bad.alias("failed"),
        F.when(ok + bad > 0, F.round(100.0 * ok / (ok + bad), 1)).otherwise(F.lit(0.0)).alias("success_rate_pct"),
    )


def recent_failures(runs: DataFrame, k: int = 5) -> DataFrame:
    """Newest failures; a failure without finish time counts as newest."""
    return (
        runs.filter((F.col("status") == "failed") & F.col("error").isNotNull())
        .orderBy(F.col("finished_at").desc_nulls_first(), F.col("id").desc())
        .limit(k)
        .select("repo_id", clean_error(F.col("error"), 240).alias("error"), "finished_at")
    )


def run_history(runs: DataFrame, repo_id: str | None = None) -> DataFrame:
    if repo_id is not None:
        runs = runs.filter(F.col("repo_id") == repo_id)
    return runs.orderBy(F.col("id").desc())


def source_progress(sources: DataFrame, repos: DataFrame, runs: DataFrame) -> DataFrame:
    """How far the repos of every source are, from their latest runs."""
    last = latest_run(runs.select("repo_id", "id", "status", "started_at", "finished_at")).select(
        "repo_id", "status", F.coalesce("finished_at", "started_at").alias("at")
    )
    of_repo = repos.select(F.col("id").alias("repo_id"), "source_id", "last_indexed_at").join(last, "repo_id", "left")
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    sums = of_repo.groupBy("source_id").agg(
        N().alias("total"),
        count(F.col("last_indexed_at").isNotNull()).alias("indexed"),
        *[count(F.col("status") == s).alias(s) for s in STATUSES],
        count(F.col("status").isNull()).alias("unstarted"),
        F.max("at").alias("last_run_at"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        sources.select(F.col("id").alias("source_id"), "last_synced_at")
        .join(sums, "source_id", "left")
        .select(
            "source_id", *[zero(c) for c in ("total", "indexed", *STATUSES, "unstarted")],
            F.coalesce((F.col("queued") > 0) | (F.col("running") > 0), F.lit(False)).alias("in_progress"),
            "last_run_at", "last_synced_at",
        )
    )


def progress_pct(progress: DataFrame) -> DataFrame:
    """Whole percentages of indexed, failed and running repos per source."""
    total = F.greatest("total", F.lit(1))
    pct = lambda c: F.floor(100.0 * F.col(c) / total + 0.5).alias(f"pct_{c}")
    return progress.select("source_id", pct("indexed"), pct("failed"), pct("running"))


def source_failures(repos: DataFrame, runs: DataFrame, k: int = 5) -> DataFrame:
    """Up to `k` repos per source whose latest run left an error, newest first.

    The row-number filter lets Spark keep only `k` rows per source before the
    shuffle, so a source with most of the repos stays cheap.
    """
    last = latest_run(runs.select("repo_id", "id", "status", "error", "finished_at"))
    error = clean_error(F.col("error"), 400)
    found = (
        repos.select(F.col("id").alias("repo_id"), "source_id")
        .join(last.filter((F.col("status") == "failed") | (error != "")), "repo_id")
        .select("source_id", "repo_id", error.alias("error"), "finished_at")
        .filter(F.col("error") != "")
    )
    order = Window.partitionBy("source_id").orderBy(F.col("finished_at").desc_nulls_last(), "repo_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def source_summary(sources: DataFrame) -> DataFrame:
    """Counts over all sources: one row per kind, and the totals as kind `*`."""
    cols = [
        N().alias("total"),
        F.count_if(F.col("webhook_enabled") & filled(F.col("webhook_secret"))).alias("with_webhook"),
        F.count_if(F.coalesce("sync_interval_seconds", F.lit(0)) > 0).alias("with_schedule"),
        F.max("last_synced_at").alias("last_synced_at"),
    ]
    doubled = sources.withColumn("kind", F.explode(F.array("kind", F.lit("*"))))
    return doubled.groupBy("kind").agg(*cols)


def token_summary(tokens: DataFrame, as_of: datetime) -> DataFrame:
    since = F.lit(as_of - timedelta(hours=24))
    return tokens.agg(
        N().alias("total"), F.count_if(~F.col("revoked")).alias("active"), F.count_if(F.col("revoked")).alias("revoked"),
        F.count_if(F.coalesce(F.col("last_used_at") >= since, F.lit(False))).alias("used_in_last_24h"),
        F.max("last_used_at").alias("most_recent_use"),
    )


def repo_summary(repos: DataFrame) -> DataFrame:
    return repos.agg(
        N().alias("total"), F.count("last_indexed_at").alias("indexed"), F.max("last_indexed_at").alias("most_recent_index")
    )


def language_histogram(repos: DataFrame) -> DataFrame:
    return (
        repos.select(F.explode(F.split("languages", ",")).alias("l"))
        .select(F.trim("l").alias("language"))
        .filter(F.col("language") != "")
        .groupBy("language")
        .agg(N().alias("repos"))
        .orderBy(F.col("repos").desc(), "language")
    )


def source_repo_counts(sources: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy(F.col("source_id").alias("id")).agg(N().alias("repos"))
    return sources.join(counts, "id", "left").select(
        "id", "kind", "name", F.coalesce("repos", F.lit(0)).alias("repos")
    ).orderBy("id")


def source_flags(sources: DataFrame) -> DataFrame:
    return sources.select(
        "id", filled(F.col("webhook_secret")).alias("has_secret"), F.coalesce("webhook_enabled", F.lit(False)).alias("webhook_enabled")
    )


def _elapsed(last: Column, interval: Column, as_of: datetime) -> Column:
    wait = F.greatest(interval, F.lit(INTERVAL_FLOOR))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return (interval > 0) & (last.isNull() | (age >= wait.cast("bigint") * 1_000_000))


def due_sources(sources: DataFrame, as_of: datetime) -> DataFrame:
    return sources.filter(_elapsed(F.col("last_synced_at"), F.col("sync_interval_seconds"), as_of)).select("id")


def ingest_mode(last_indexed_at: Column) -> Column:
    return F.when(last_indexed_at.isNull(), "full").otherwise("incremental")


def due_repos(repos: DataFrame, as_of: datetime) -> DataFrame:
    due = repos.filter(_elapsed(F.col("last_indexed_at"), F.col("poll_interval_seconds"), as_of))
    return due.select("id", ingest_mode(F.col("last_indexed_at")).alias("mode"))


def stuck_runs(runs: DataFrame, as_of: datetime, queued_age: int = QUEUED_AGE, running_age: int = RUNNING_AGE) -> DataFrame:
    """Runs that stopped moving, and what to do with them."""
    lost = (F.col("status") == "queued") & (F.col("started_at") < F.lit(as_of - timedelta(seconds=queued_age)))
    dead = (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of - timedelta(seconds=running_age)))
    return runs.filter(lost | dead).select(
        "id", "repo_id", "mode",
        F.when(lost, "requeue").otherwise("fail").alias("action"),
        F.when(lost, "queued").otherwise("failed").alias("status"),
        F.when(dead, F.lit(f"no final status after {running_age}s")).otherwise("").alias("error"),
    )


def run_state(changes: DataFrame) -> DataFrame:
    """Latest status per run from its changes (run_id, seq, status)."""
    return changes.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), N().alias("changes"))


STATS = "files_parsed bigint, files_added bigint, files_changed bigint, files_removed bigint, functions bigint"


def run_deltas(runs: DataFrame) -> DataFrame:
    """Run rows with the counters of the JSON column `stats`; missing ones are null."""
    return runs.withColumn("s", F.from_json("stats", STATS)).select(
        "id", "repo_id", "mode", "status", "s.files_parsed", "s.files_added", "s.files_changed", "s.files_removed",
        "s.functions", F.left(F.coalesce("error", F.lit("")), F.lit(60)).alias("error"),
    )


def page(df: DataFrame, order: list[Column | str], page_no: int, size: int = 25) -> DataFrame:
    """One page of a sorted list; a page past the end means the last one.

    Sort, offset and limit become one top-k per partition. It counts the list and
    reads what it skips; `page_after` does neither.
    """
    total = df.count()
    last = max(0, -(-total // size) - 1)
    return df.orderBy(*order).offset(min(page_no, last) * size).limit(size).withColumn("total", F.lit(total))


def search_page(df: DataFrame, text: str, columns: list[str], order: list[Column | str], page_no: int, size: int = 25) -> DataFrame:
    q = text.strip().lower()
    if q:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
        df = df.filter(hit)
    return page(df, order, page_no, size)


@dataclass(frozen=True)
class Key:
    """A column to sort by; the keys of a list together tell its rows apart."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def beyond(self, value, or_at: bool = False) -> Column:
        """Whether a row's key comes after `value` in this order, or is at it as well."""
        c = F.col(self.name)
        if value is None:
            later = c.isNotNull() if self.nulls_first else F.lit(False)
            return (later | c.isNull()) if or_at else later
        if self.descending:
            later = c <= F.lit(value) if or_at else c < F.lit(value)
        else:
            later = c >= F.lit(value) if or_at else c > F.lit(value)
        return later if self.nulls_first else later | c.isNull()


def page_after(df: DataFrame, keys: list[Key], after: Sequence | None = None, size: int = 25) -> DataFrame:
    """The page that follows the row with the key values `after` (the first page without).

    A row follows if, at the first key in which it differs, it comes later in that
    key's own direction. The bound on the first key alone stands beside, as that
    reaches the scan. Nothing is counted or skipped: any page is one top-k over what
    is left of the list, and rows added before it do not shift it.
    """
    if after is not None:
        follows = F.lit(False)
        for k, key in enumerate(keys):
            same = F.lit(True)
            for earlier, value in zip(keys[:k], after, strict=False):
                same = same & F.col(earlier.name).eqNullSafe(F.lit(value))
            follows = follows | (same & key.beyond(after[k]))
        df = df.filter(keys[0].beyond(after[0], or_at=True)).filter(follows)
    return df.orderBy(*[k.order() for k in keys]).limit(size)


def last_key(rows: DataFrame, keys: list[Key]) -> tuple | None:
    """Key values of the last row of a page, to ask for the next one by; None after an empty page."""
    found = rows.select(*[k.name for k in keys]).tail(1)
    return tuple(found[0]) if found else None


def repo_picker(repos: DataFrame) -> DataFrame:
    """Indexed repos first, then by name."""
    return repos.orderBy(F.col("last_indexed_at").isNull(), "id")
