"""The architecture map of all repos, from stored symbols to stored clusters and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphlens.operators import architecture as arch
from graphlens.operators.communities import communities
from graphlens.operators.components import cycles
from graphlens.operators.maintain import full_rebuild
from graphlens.operators.resolve import file_call_edges_by_name, import_edges
from graphlens.session import cut


@dataclass
class Map:
    """What is known about the structure of each repo."""

    sources: DataFrame  # repo_id, edge_source
    edges: DataFrame  # repo_id, src, dst, weight
    membership: DataFrame  # repo_id, path, cluster_id
    clusters: DataFrame
    cluster_edges: DataFrame
    cycle_files: DataFrame  # repo_id, component, path
    warnings: DataFrame

    def stats(self) -> DataFrame:
        return arch.arch_stats(self.sources, self.edges, self.membership, self.warnings)

    def store(self, root: str) -> None:
        """Replace what `root` holds for the repos of this map; other repos stay.

        A repo that has lost its last warning or edge has none stored either.
        """
        for name in ("clusters", "membership", "cluster_edges", "cycle_files", "warnings"):
            full_rebuild(getattr(self, name), f"{root}/{name}", self.sources)


def compute(
    repos: DataFrame, files: DataFrame, functions: DataFrame, imports: DataFrame, call_sites: DataFrame,
    limits: arch.Limits = arch.Limits(),
) -> Map:
    """Edges, clusters and warnings of every repo in `repos` (repo_id).

    Repos with fewer than two edges of their own are described by their
    directories instead. Edges and membership are stored once, since every
    report reads them.
    """
    own = arch.dependency_edges(file_call_edges_by_name(call_sites, functions), import_edges(imports, files))
    own = cut(own)
    sources = arch.edge_source(repos, files, own)
    edges = cut(arch.chosen_edges(repos, files, own).drop("edge_source"))
    membership = cut(communities(edges))
    metrics = arch.cluster_metrics(edges, membership)
    between = arch.cluster_edges(edges, membership)
    cycle_files = cut(cycles(edges))
    return Map(
        sources, edges, membership, metrics.join(sources, "repo_id"), between, cycle_files,
        arch.all_warnings(arch.file_fan(edges), metrics, between, cycle_files, limits),
    )
