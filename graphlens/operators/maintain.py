"""Keep stored tables current: upsert, rebuild, purge, cascade, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.session import exists, remove


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored rows overlaid by incoming ones; the last incoming row of a key wins."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("r")
    return both.groupBy(*keys).agg(last).select(*keys, "r.*")


def purge_files(table: DataFrame, gone: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of `table` that belong to none of the files in `gone` (repo_id, path)."""
    return table.join(gone.select("repo_id", F.col("path").alias(path)), ["repo_id", path], "left_anti")


def cascade_delete(sources: DataFrame, doomed: DataFrame, links: DataFrame, repos: DataFrame, **by_repo: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table after dropping the sources in `doomed` (id).

    A source takes along its links and the repos they name; a repo takes along
    every table in `by_repo`.
    """
    gone = doomed.select("id").distinct()
    gone_links = links.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    gone_repos = gone_links.select("repo_id").distinct()
    out = {
        "sources": sources.join(gone, "id", "left_anti"),
        "source_repos": links.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(
            gone_repos, "repo_id", "left_anti"
        ),
        "repos": repos.join(gone_repos.withColumnRenamed("repo_id", "id"), "id", "left_anti"),
    }
    for name, table in by_repo.items():
        out[name] = table.join(gone_repos, "repo_id", "left_anti")
    return out


# Paths the request log leaves out.
SKIPPED_PATHS = ("/healthz", "/readyz", "/")
SKIPPED_PREFIXES = ("/v1/analytics/", "/v1/graphql", "/docs", "/openapi", "/static")
ROUTE_LENGTH = 200


def log_rows(requests: DataFrame) -> DataFrame:
    """Requests worth logging, under their route template where one is known."""
    path = F.col("path")
    skip = path.isin(*SKIPPED_PATHS)
    for prefix in SKIPPED_PREFIXES:
        skip = skip | path.startswith(prefix)
    return requests.filter(~skip).select(
        "id",
        "ts",
        F.coalesce("principal", F.lit("anonymous")).alias("token_name"),
        F.left(F.coalesce("template", "path"), F.lit(ROUTE_LENGTH)).alias("route"),
        "status",
        "duration_ms",
    )


def prune_log(log: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Rows not older than `days` before `as_of` (a timestamp value, so it is pushed to the scan)."""
    from datetime import timedelta

    return log.filter(F.col("ts") >= F.lit(as_of - timedelta(days=days)))


def audit_rows(df: DataFrame, actor: Column, action: Column, target: Column, **detail: Column) -> DataFrame:
    return df.select(
        actor.alias("actor"),
        action.alias("action"),
        target.cast("string").alias("target"),
        F.to_json(F.struct(*[c.alias(n) for n, c in detail.items()])).alias("detail"),
    )


DETAIL = (
    "files bigint, fan_in bigint, fan_out bigint, threshold int, cluster_id bigint, cohesion double, "
    "file_count bigint, source_cluster bigint, target_cluster bigint, source_instability double, "
    "target_instability double, weight bigint, incoming_clusters bigint"
)


def decode_detail(warnings: DataFrame) -> DataFrame:
    """Warnings with the stored JSON detail as a struct."""
    return warnings.withColumn("detail", F.from_json("detail_json", DETAIL)).drop("detail_json")


def full_rebuild(df: DataFrame, location: str, rebuilt: DataFrame | None = None) -> None:
    """Replace the repos in `rebuilt` (repo_id), or else those in `df`, in the table at `location`; others stay.

    A repo that was rebuilt and has no rows left loses those it had. Only the ids of
    such repos reach the driver, which deletes their partitions.
    """
    spark = df.sparkSession
    emptied = []
    if rebuilt is not None and exists(spark, location):
        rest = rebuilt.select("repo_id").distinct().join(df.select("repo_id").distinct(), "repo_id", "left_anti")
        emptied = [r.repo_id for r in rest.collect()]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(location)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for repo in emptied:
        remove(spark, f"{location}/repo_id={escape(repo)}")
