"""Bring a stored code graph up to date from a snapshot of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import extract
from graphlens.operators.maintain import purge_files
from graphlens.operators.resolve import current_calls
from graphlens.session import cut, forget
from graphlens.sources.trees import fingerprint, snapshot_diff


@dataclass
class Graph:
    """The stored tables of a code graph."""

    files: DataFrame
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    call_sites: DataFrame
    calls: DataFrame | None = None
    parsed: DataFrame | None = None

    @classmethod
    def of(cls, sources: DataFrame) -> Graph:
        """A full ingest of source files (repo_id, path, content), parsed once and stored."""
        parsed = cut(extract.parsed(sources))
        functions, sites = extract.extract_functions(sources, parsed), extract.extract_call_sites(sources, parsed)
        return cls(
            fingerprint(sources), functions, extract.extract_classes(sources, parsed), extract.extract_imports(sources, parsed), sites,
            current_calls(None, sites, functions), parsed,
        )

    def release(self) -> None:
        """Delete what was parsed, once the tables are written."""
        if self.parsed is not None:
            forget(self.parsed)

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("files", "functions", "classes", "imports", "call_sites")}


def update(stored: Graph, sources: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after ingesting `sources`, the whole present tree, and the state of each file.

    Only new and changed files are extracted. Rows belong to the file they came
    from, so dropping the rows of changed and removed files and adding the
    fresh ones gives what a full ingest would. Call edges are resolved anew, as a
    name may have got or lost a bearer anywhere in the repo; refined edges stay while
    both their ends do.
    """
    states = snapshot_diff(stored.files, fingerprint(sources))
    gone = states.filter(F.col("state").isin("changed", "removed")).select("repo_id", "path")
    todo = states.filter(F.col("state").isin("changed", "added")).select("repo_id", "path")
    fresh = Graph.of(sources.join(todo, ["repo_id", "path"], "left_semi"))
    merged = {
        name: purge_files(table, gone, "path" if name == "files" else "file_path").unionByName(fresh.tables()[name])
        for name, table in stored.tables().items()
    }
    calls = current_calls(stored.calls, merged["call_sites"], merged["functions"])
    return Graph(**merged, calls=calls, parsed=fresh.parsed), states
