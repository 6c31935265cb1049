"""File dependency graph, cluster metrics and design warnings, all repos at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.modules import parent_dir
from graphlens.functions.skew import running_total
from graphlens.operators.dependencies import NamedEdges
from graphlens.session import cut

KEY = ["repo_id", "kind", "target_kind", "target_id"]


@dataclass(frozen=True)
class Limits:
    """When a finding becomes a warning."""

    fan_in: int = 20
    fan_out: int = 15
    cohesion: float = 0.4
    hub: int = 8
    instability_gap: float = 0.1


def _n() -> Column:
    return F.count(F.lit(1))


def dependency_edges(*parts: DataFrame | NamedEdges) -> DataFrame:
    """Sum the weights of call and import edges per (src, dst); those held by name, alone, come summed."""
    edges = parts[0]
    if isinstance(edges, NamedEdges):
        if len(parts) == 1:
            return edges.edges()
        edges = edges.edges()
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges.groupBy("repo_id", "src", "dst").agg(F.sum("weight").alias("weight"))


def directory_edges(files: DataFrame) -> DataFrame:
    """A star per directory: its first file to each other file.

    The first file is found by an aggregate and joined back, so a directory
    with most of the files is never gathered in one place.
    """
    placed = files.select("repo_id", "path", parent_dir(F.col("path")).alias("dir"))
    first = placed.groupBy("repo_id", "dir").agg(F.min("path").alias("src"))
    return (
        placed.join(first, ["repo_id", "dir"])
        .filter(F.col("path") != F.col("src"))
        .select("repo_id", "src", F.col("path").alias("dst"), F.lit(1).cast("bigint").alias("weight"))
    )


def edge_counts(edges: DataFrame | NamedEdges) -> DataFrame:
    """(repo_id, edges)"""
    if isinstance(edges, NamedEdges):
        return edges.fan().groupBy("repo_id").agg(F.sum("fan_out").alias("edges"))
    return edges.groupBy("repo_id").agg(_n().alias("edges"))


def edge_source(repos: DataFrame, files: DataFrame, edges: DataFrame | NamedEdges) -> DataFrame:
    """Which edges describe each repo: its own, its directories, or none."""
    n_edges = edges.two_at_most() if isinstance(edges, NamedEdges) else edge_counts(edges).withColumnRenamed("edges", "n_edges")
    n_files = files.groupBy("repo_id").agg(_n().alias("n_files"))
    return (
        repos.select("repo_id")
        .join(n_edges, "repo_id", "left")
        .join(n_files, "repo_id", "left")
        .select(
            "repo_id",
            F.when(F.coalesce("n_edges", F.lit(0)) >= 2, "calls+imports")
            .when(F.coalesce("n_files", F.lit(0)) > 0, "directory_fallback")
            .otherwise("no_files")
            .alias("edge_source"),
        )
    )


def chosen_edges(repos: DataFrame, files: DataFrame, edges: DataFrame | NamedEdges) -> DataFrame:
    """The edges each repo is judged by, with a column saying where they come from.

    Of edges held by name, those of the repos that are judged by them are built.
    """
    source = edge_source(repos, files, edges)
    if isinstance(edges, NamedEdges):
        source = cut(source)
        own = lambda kind: source.where(F.col("edge_source") == kind).select("repo_id")
        return edges.of(own("calls+imports")).edges().withColumn("edge_source", F.lit("calls+imports")).unionByName(
            directory_edges(files).join(own("directory_fallback"), "repo_id", "left_semi").withColumn("edge_source", F.lit("directory_fallback"))
        )
    both = edges.withColumn("edge_source", F.lit("calls+imports")).unionByName(
        directory_edges(files).withColumn("edge_source", F.lit("directory_fallback"))
    )
    return both.join(source, ["repo_id", "edge_source"], "left_semi")


def undirected_edges(edges: DataFrame | NamedEdges, places: bool = False) -> DataFrame:
    """Both ways between two files as one; of edges held by name also between the places of files instead of their paths."""
    if isinstance(edges, NamedEdges):
        return edges.undirected_places() if places else edges.undirected()
    return edges.groupBy(
        "repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.sum("weight").alias("weight"))


def file_fan(edges: DataFrame | NamedEdges) -> DataFrame:
    """Fan-in and fan-out per file in one pass: each edge counts at both ends."""
    if isinstance(edges, NamedEdges):
        return edges.fan()
    ends = edges.select(
        "repo_id",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    )
    return ends.groupBy("repo_id", "e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def placed_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the cluster of either end."""
    src = membership.select("repo_id", F.col("path").alias("src"), F.col("cluster_id").alias("cs"))
    dst = membership.select("repo_id", F.col("path").alias("dst"), F.col("cluster_id").alias("cd"))
    return edges.join(src, ["repo_id", "src"]).join(dst, ["repo_id", "dst"])


def between_clusters(edges: DataFrame | NamedEdges, membership: DataFrame) -> DataFrame:
    """(repo_id, cs, cd, weight, n) over all edges, also those within a cluster."""
    if isinstance(edges, NamedEdges):
        return edges.between(membership)
    return placed_edges(edges, membership).groupBy("repo_id", "cs", "cd").agg(F.sum("weight").alias("weight"), _n().alias("n"))


def cluster_edges(edges: DataFrame | NamedEdges, membership: DataFrame) -> DataFrame:
    return (
        between_clusters(edges, membership)
        .filter(F.col("cs") != F.col("cd"))
        .select("repo_id", F.col("cs").alias("src"), F.col("cd").alias("dst"), "weight", F.col("n").alias("cross_file_edges"))
    )


def cluster_names(membership: DataFrame) -> DataFrame:
    """Longest common folder path of the members, else the shortest member.

    Only the smallest and the largest path of a cluster can differ earliest,
    so two aggregates stand in for the member list.
    """
    parts = F.split("path", "/")
    ends = membership.groupBy("repo_id", "cluster_id").agg(
        F.min(parts).alias("lo"),
        F.max(parts).alias("hi"),
        F.min(F.struct(F.length("path"), F.col("path").alias("p"))).alias("short"),
        _n().alias("file_count"),
    )
    same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs_at = F.array_position(same, False)
    shared = F.when(differs_at == 0, F.size("lo")).otherwise(differs_at - 1).cast("int")
    return ends.select(
        "repo_id",
        "cluster_id",
        F.when(shared > 0, F.array_join(F.slice("lo", F.lit(1), shared), "/")).otherwise(F.col("short.p")).alias("name"),
        "file_count",
    )


def cluster_metrics(edges: DataFrame | NamedEdges, membership: DataFrame) -> DataFrame:
    """Fan sums, instability and cohesion per cluster from one pass over edges."""
    inside = (F.col("cs") == F.col("cd")).cast("int")

    def end(cluster: str, i: int, o: int, intra: Column) -> Column:
        return F.struct(
            F.col(cluster).alias("cluster_id"), F.lit(i).alias("i"), F.lit(o).alias("o"),
            intra.alias("intra"), (1 - inside).alias("ext"),
        )

    # an edge inside a cluster is counted once, at its source
    sums = (
        between_clusters(edges, membership)
        .select(
            "repo_id", "n",
            F.explode(F.array(end("cs", 0, 1, inside), end("cd", 1, 0, F.lit(0)))).alias("e"),
        )
        .groupBy("repo_id", "e.cluster_id")
        .agg(*[F.sum(F.col(f"e.{c}") * F.col("n")).alias(c) for c in ("i", "o", "intra", "ext")])
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda part, whole, empty: F.when(whole > 0, F.round(part / whole, 3)).otherwise(F.lit(empty))
    fan_in, fan_out = zero("i"), zero("o")
    return (
        cluster_names(membership)
        .join(sums, ["repo_id", "cluster_id"], "left")
        .select(
            "repo_id", "cluster_id", "name", "file_count",
            fan_in.alias("fan_in"), fan_out.alias("fan_out"),
            share(fan_out, fan_in + fan_out, 0.0).alias("instability"),
            share(zero("intra"), zero("intra") + zero("ext"), 1.0).alias("cohesion"),
        )
    )


def stable_ids(labelled: DataFrame) -> DataFrame:
    """Number communities of a repo from 0 in the order of their smallest path."""
    first = labelled.groupBy("repo_id", "label").agg(F.min("path").alias("first"))
    numbered = running_total(first, ["repo_id"], ["first"], F.lit(1).cast("bigint"), "cluster_id")
    return labelled.join(numbered.select("repo_id", "label", "cluster_id"), ["repo_id", "label"]).select(
        "repo_id", "path", "cluster_id"
    )


# --- warnings


def _warning(df: DataFrame, kind: str, severity: str, target_kind: str, target: Column, message: Column, detail: Column) -> DataFrame:
    return df.select(
        "repo_id",
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        F.lit(target_kind).alias("target_kind"),
        target.cast("string").alias("target_id"),
        message.alias("message"),
        F.to_json(detail).alias("detail_json"),
    )


def warn_cycles(components: DataFrame) -> DataFrame:
    """One warning per cycle; its files stay rows of `components`."""
    sizes = components.groupBy("repo_id", "component").agg(_n().alias("files"))
    return _warning(
        sizes, "cyclic_dependency", "high", "file_group", F.col("component"),
        F.concat(F.col("files").cast("string"), F.lit(" files depend on each other in a cycle")),
        F.struct("files"),
    )


def warn_fan_in(fan: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _warning(
        fan.filter(F.col("fan_in") > limits.fan_in), "high_fan_in", "medium", "file", F.col("path"),
        F.concat("path", F.lit(" is used by "), F.col("fan_in").cast("string"), F.lit(f" files (limit {limits.fan_in})")),
        F.struct("fan_in", F.lit(limits.fan_in).alias("threshold")),
    )


def warn_fan_out(fan: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _warning(
        fan.filter(F.col("fan_out") > limits.fan_out), "high_fan_out", "medium", "file", F.col("path"),
        F.concat("path", F.lit(" uses "), F.col("fan_out").cast("string"), F.lit(f" files (limit {limits.fan_out})")),
        F.struct("fan_out", F.lit(limits.fan_out).alias("threshold")),
    )


def warn_cohesion(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    loose = metrics.filter((F.col("cohesion") < limits.cohesion) & (F.col("file_count") > 1))
    return _warning(
        loose, "low_cohesion", "low", "cluster", F.col("cluster_id"),
        F.concat(F.lit("cluster "), "name", F.lit(" has cohesion "), F.col("cohesion").cast("string")),
        F.struct("cluster_id", "cohesion", "file_count"),
    )


def warn_sdp(metrics: DataFrame, c_edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A cluster that leans on one clearly less stable than itself."""
    end = lambda key, i, n: metrics.select(
        "repo_id", F.col("cluster_id").alias(key), F.col("instability").alias(i), F.col("name").alias(n)
    )
    bad = (
        c_edges.join(end("src", "i_src", "n_src"), ["repo_id", "src"])
        .join(end("dst", "i_dst", "n_dst"), ["repo_id", "dst"])
        .filter(F.col("i_src") + limits.instability_gap < F.col("i_dst"))
    )
    return _warning(
        bad, "sdp_violation", "medium", "cluster_edge",
        F.concat(F.col("src").cast("string"), F.lit("->"), F.col("dst").cast("string")),
        F.concat(F.lit("stable cluster "), "n_src", F.lit(" depends on less stable "), "n_dst"),
        F.struct(
            F.col("src").alias("source_cluster"), F.col("dst").alias("target_cluster"),
            F.col("i_src").alias("source_instability"), F.col("i_dst").alias("target_instability"), "weight",
        ),
    )


def warn_hub(metrics: DataFrame, c_edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    incoming = c_edges.groupBy("repo_id", F.col("dst").alias("cluster_id")).agg(_n().alias("incoming_clusters"))
    hubs = incoming.filter(F.col("incoming_clusters") > limits.hub).join(
        metrics.select("repo_id", "cluster_id", "name"), ["repo_id", "cluster_id"]
    )
    return _warning(
        hubs, "hub_cluster", "low", "cluster", F.col("cluster_id"),
        F.concat(F.lit("cluster "), "name", F.lit(" is used by "), F.col("incoming_clusters").cast("string"), F.lit(" clusters")),
        F.struct("cluster_id", "incoming_clusters"),
    )


def all_warnings(fan, metrics, c_edges, components, limits: Limits = Limits()) -> DataFrame:
    parts = [
        warn_cycles(components), warn_fan_in(fan, limits), warn_fan_out(fan, limits),
        warn_cohesion(metrics, limits), warn_sdp(metrics, c_edges, limits), warn_hub(metrics, c_edges, limits),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_warnings(warnings: DataFrame, severity: str | None = None) -> DataFrame:
    """Warnings in reading order; severities sort as text."""
    if severity is not None:
        warnings = warnings.filter(F.col("severity") == severity)
    return warnings.orderBy("severity", "kind", "target_id", "repo_id")


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("repo_id", "kind").agg(_n().alias("n"))


def arch_stats(source: DataFrame, edges: DataFrame | NamedEdges, membership: DataFrame, warnings: DataFrame) -> DataFrame:
    """One line per repo: clusters, files, edges, warnings and warnings by kind."""
    members = membership.groupBy("repo_id").agg(
        F.countDistinct("cluster_id").alias("clusters"), _n().alias("files")
    )
    n_edges = edge_counts(edges)
    kinds = (
        warning_counts(warnings)
        .groupBy("repo_id")
        .agg(F.sum("n").alias("warnings"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        source.join(members, "repo_id", "left")
        .join(n_edges, "repo_id", "left")
        .join(kinds, "repo_id", "left")
        .select(
            "repo_id", "edge_source", zero("clusters"), zero("files"), zero("edges"), zero("warnings"),
            F.col("by").alias("warnings_by_kind"),
        )
    )


def list_clusters(metrics: DataFrame, membership: DataFrame) -> DataFrame:
    """Clusters with their files, one row per file, clusters without files kept."""
    return metrics.join(membership, ["repo_id", "cluster_id"], "left").orderBy("repo_id", "cluster_id", "path")
