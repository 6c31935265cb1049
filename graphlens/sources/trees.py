"""Source trees: which files count, their language, size and fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and base names no scan enters.
SKIP_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", "out", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "target", "vendor",
)
SKIP_ENDINGS = (".min.js", ".map", ".lock", ".snap")
PROBE_SKIP_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target")
# Language of a file ending.
LANGUAGES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"),
    "rust": (".rs",),
    "go": (".go",),
    "java": (".java",),
    "ruby": (".rb",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"),
    "csharp": (".cs",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala", ".sc"),
    "swift": (".swift",),
    "php": (".php", ".phtml"),
    "solidity": (".sol",),
    "dart": (".dart",),
    "r": (".r", ".rmd"),
    "perl": (".pl", ".pm", ".t"),
    "lua": (".lua",),
    "zig": (".zig",),
    "powershell": (".ps1", ".psm1", ".psd1"),
    "julia": (".jl",),
    "nix": (".nix",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "ipynb": (".ipynb",),
}
TYPESCRIPT = (".ts", ".tsx", ".mts", ".cts")


def _one_of(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def under(path: Column, dirs: tuple[str, ...]) -> Column:
    """Whether one of the folders above the file is in `dirs`."""
    return path.rlike(f"(^|/)({_one_of(dirs)})/")


def scannable(path: Column) -> Column:
    return ~under(path, SKIP_DIRS) & ~path.rlike(f"({_one_of(SKIP_ENDINGS)})$")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by file ending, null where none is known."""
    pairs = [F.lit(x) for lang, ends in LANGUAGES.items() for e in ends for x in (e, lang)]
    return F.element_at(F.create_map(*pairs), suffix(path))


def file_label(path: Column) -> Column:
    """The language a stored file carries: typescript is told from javascript."""
    return F.when(suffix(path).isin(*TYPESCRIPT), "typescript").otherwise(language(path))


def scan_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """Files under a checkout: repo_id, path, content. Filters on path prune before reading."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^(file:/*)?/?", "/")
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    return (
        raw.select(F.lit(repo_id).alias("repo_id"), F.substr(rel, F.lit(len(base) + 1)).alias("path"), "content")
        .filter(scannable(F.col("path")))
    )


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Stored file rows: language, size and content hash; unknown languages are left out."""
    raw = F.col(content).cast("binary")
    return files.withColumn("language", file_label(F.col("path"))).filter(F.col("language").isNotNull()).select(
        "repo_id", "path", "language", F.octet_length(raw).cast("bigint").alias("size_bytes"), F.sha1(raw).alias("sha")
    )


def has_source(files: DataFrame) -> DataFrame:
    """Per repo, whether any file outside the usual output folders has a known language."""
    known = language(F.col("path")).isNotNull() & ~under(F.col("path"), PROBE_SKIP_DIRS)
    return files.groupBy("repo_id").agg(F.max(known).alias("has_source"))


def snapshot_diff(stored: DataFrame, present: DataFrame) -> DataFrame:
    """State of every file by hash: added, changed, unchanged or removed."""
    old = stored.select("repo_id", "path", F.col("sha").alias("old_sha"))
    new = present.select("repo_id", "path", F.col("sha").alias("new_sha"))
    state = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull(), "removed")
        .when(F.col("old_sha") == F.col("new_sha"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, ["repo_id", "path"], "full_outer").select("repo_id", "path", "new_sha", state.alias("state"))


def removed_paths(stored: DataFrame, present: DataFrame) -> DataFrame:
    return stored.select("repo_id", "path").join(present.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
