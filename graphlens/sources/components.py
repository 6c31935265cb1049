"""Single-file components: their script blocks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.sources.notebooks import newlines

# A script block (the closing tag may hold junk), its language, and the ending for it.
SCRIPT_BLOCK = r"(?is)<script\b([^>]*)>(.*?)</script[^>]*>"
LANG_ATTRIBUTE = r"""(?i)lang\s*=\s*["']([^"']+)["']"""
DIALECT_ENDING = {"ts": ".ts", "typescript": ".ts", "tsx": ".tsx", "jsx": ".jsx"}


def script_blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """Every script block with its dialect and the lines before its body.

    A text splits into as many pieces as it has blocks plus one; the piece
    before a block and the blocks before it give the block's position.
    """
    text = F.col(content)
    keep = [c for c in files.columns if c != content]
    blocks = F.regexp_extract_all(text, F.lit("(" + SCRIPT_BLOCK.replace("(?is)", "(?is:", 1) + "))"), F.lit(1))
    between = F.split(text, SCRIPT_BLOCK)
    sep = F.col("block")
    before = F.concat(
        F.array_join(F.slice("between", F.lit(1), F.col("pos") + 1), ""), F.array_join(F.slice("blocks", F.lit(1), F.col("pos")), "")
    )
    attrs = F.regexp_extract(sep, r"(?is)^<script\b([^>]*)>", 1)
    head = F.regexp_extract(sep, r"(?is)^(<script\b[^>]*>)", 1)
    body = F.regexp_replace(F.substr(sep, F.length(head) + 1), r"(?is)</script[^>]*>$", "")
    pairs = [F.lit(x) for kv in DIALECT_ENDING.items() for x in kv]
    dialect = F.lower(F.regexp_extract(attrs, LANG_ATTRIBUTE, 1))
    return (
        files.withColumn("blocks", blocks)
        .filter(F.size("blocks") > 0)
        .withColumn("between", between)
        .select(*keep, "blocks", "between", F.posexplode("blocks").alias("pos", "block"))
        .select(
            *keep, (F.col("pos") + 1).alias("block_no"),
            F.coalesce(F.element_at(F.create_map(*pairs), dialect), F.lit(".js")).alias("ending"),
            (newlines(before) + newlines(head)).alias("line_offset"),
            body.alias("code"),
        )
    )


def as_script(path: Column, ending: Column) -> Column:
    """The path a block is extracted under, so that its dialect is recognised."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), ending)
