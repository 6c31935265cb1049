"""Names of modules, symbols and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders between the repo root and the package root, and the
# file endings that module names leave out.
LAYOUT_PREFIXES = (
    "src/main/java/",
    "src/main/kotlin/",
    "src/main/scala/",
    "src/main/groovy/",
    "src/test/java/",
    "src/test/kotlin/",
    "src/test/scala/",
    "src/",
    "app/",
    "lib/",
    "pkg/",
    "internal/",
)
MODULE_ENDINGS = ("py", "java", "kt", "kts", "scala", "groovy", "ts", "tsx", "js", "jsx")
# Separator in qualified names, where it is not a dot.
SEPARATORS = {"rust": "::", "ruby": "::", "c": "::", "cpp": "::", "perl": "::", "php": "\\"}


def without_suffix(path: Column) -> Column:
    """The path without the last ending of its base name."""
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def separator(language: Column) -> Column:
    pairs = [F.lit(x) for item in SEPARATORS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), language), F.lit("."))


def module_qname(path: Column, language: Column) -> Column:
    """Dotted (or language-specific) module name of a repo-relative path.

    Rust crates leave out the folder `src`.
    """
    parts = F.filter(
        F.split(without_suffix(path), "/"),
        lambda p: ~p.isin("", ".") & ~((language == "rust") & (p == "src")),
    )
    # array_join wants a literal separator, so join on a character no path holds
    return F.replace(F.array_join(parts, "\n"), F.lit("\n"), separator(language))


def module_candidates(path: Column) -> Column:
    """Every module name a file answers to, best first, without repeats.

    The path itself, then the part after the longest matching layout prefix
    (dotted and with slashes), then the dotted path.
    """
    stem = F.regexp_replace(path, r"\.(" + "|".join(MODULE_ENDINGS) + ")$", "")
    rest = F.lit(None).cast("string")
    for prefix in sorted(LAYOUT_PREFIXES, key=len):
        rest = F.when(stem.startswith(prefix), F.substr(stem, F.lit(len(prefix) + 1))).otherwise(rest)
    names = F.array(path, F.replace(rest, F.lit("/"), F.lit(".")), rest, F.replace(stem, F.lit("/"), F.lit(".")))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def short_name(qualified: Column) -> Column:
    """Last part of a qualified name, split at `::` where it has any, else at dots."""
    last = lambda pattern: F.element_at(F.split(qualified, pattern), -1)
    return F.when(qualified.contains("::"), last("::")).otherwise(last(r"\."))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
