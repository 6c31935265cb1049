"""Notebooks: their code as one text whose lines match the notebook's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total

# Language and file ending of a notebook kernel.
KERNEL_LANGUAGE = {
    "python": "python", "ir": "r", "r": "r", "julia": "julia", "scala": "scala", "javascript": "javascript",
    "typescript": "javascript", "ruby": "ruby", "go": "go", "rust": "rust", "java": "java", "c#": "csharp",
    "csharp": "csharp", "powershell": "powershell",
}
CODE_ENDING = {
    "python": ".py", "r": ".R", "julia": ".jl", "scala": ".scala", "javascript": ".js", "ruby": ".rb", "go": ".go",
    "rust": ".rs", "java": ".java", "csharp": ".cs", "powershell": ".ps1",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def cell_text(code: Column, lines: Column) -> Column:
    """What a cell adds: code and a blank line, or blank lines as high as the cell.

    `lines` is the cell's source as an array of lines, as notebooks store it.
    """
    joined = F.array_join(lines, "")
    ended = F.when(joined.endswith("\n"), joined).otherwise(F.concat(joined, F.lit("\n")))
    height = newlines(joined) + F.when(F.size(lines) > 0, 1).otherwise(0)
    return F.when(code, F.concat(ended, F.lit("\n"))).otherwise(F.repeat(F.lit("\n"), height))


def notebook_source(content: Column) -> Column:
    """struct(language, ending, code) of a notebook file; null for unknown kernels."""
    v = F.try_parse_json(content)
    get = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    kernel = F.lower(F.trim(F.coalesce(get("$.metadata.kernelspec.language"), get("$.metadata.language_info.name"), F.lit("python"))))
    language = _lookup(KERNEL_LANGUAGE, kernel)
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.array().cast("array<variant>"))

    def one(cell: Column) -> Column:
        listed = F.try_variant_get(cell, "$.source", "array<string>")
        # a source given as one text counts one line more than it has breaks, like a list
        single = F.array(F.try_variant_get(cell, "$.source", "string"))
        is_list = F.schema_of_variant(F.variant_get(cell, "$.source", "variant")).startswith("ARRAY")
        lines = F.when(is_list, listed).otherwise(F.filter(single, lambda s: s.isNotNull()))
        return cell_text(F.try_variant_get(cell, "$.cell_type", "string") == "code", lines)

    code = F.array_join(F.transform(cells, one), "")
    return F.when(
        language.isNotNull(), F.struct(language.alias("language"), _lookup(CODE_ENDING, language).alias("ending"), code.alias("code"))
    )


def cell_offsets(cells: DataFrame, notebook: str, order: str, code: Column, text: Column) -> DataFrame:
    """Cells held as rows, with the number of lines before each in its notebook.

    The sum over earlier cells is taken slice by slice, so a notebook with most
    of the cells does not end up in one task.
    """
    placed = cells.withColumn("cell_text", cell_text(code, F.array(text))).withColumn("is_code", code)
    return running_total(placed, [notebook], [order], newlines(F.col("cell_text")).cast("bigint"), "line_offset")
