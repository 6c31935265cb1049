"""Definition lookups as their servers return them, brought to repo paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def definition_locations(payloads: DataFrame) -> DataFrame:
    """First-to-last locations inside the repo: path, 1-based line, character, order.

    `payloads` has repo_root and result (JSON: a location, a list, or null); the
    other columns are kept. Places outside the repo root are dropped.
    """
    v = F.col("_v")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>")).otherwise(F.array(v))
    text = lambda p: F.try_variant_get("item", p, "string")
    num = lambda *ps: F.coalesce(*[F.try_variant_get("item", p, "int") for p in ps], F.lit(0))
    spans = ("range", "targetSelectionRange", "targetRange")
    has_span = F.coalesce(*[F.try_variant_get("item", f"$.{s}", "variant").isNotNull() for s in spans])
    for s in spans[1:]:
        has_span = has_span | F.try_variant_get("item", f"$.{s}", "variant").isNotNull()
    uri = F.coalesce(text("$.uri"), text("$.targetUri"))
    # a plus sign is a plus sign in a path, unlike in a form
    absolute = F.url_decode(F.replace(F.regexp_replace(uri, "^[a-z]+://[^/]*", ""), F.lit("+"), F.lit("%2B")))
    keep = [c for c in payloads.columns if c != "result"]
    return (
        payloads.withColumn("_v", F.try_parse_json("result"))
        .select(*keep, F.posexplode(items).alias("pos", "item"))
        .filter(uri.isNotNull() & has_span)
        .select(
            *keep, "pos", absolute.alias("_abs"),
            (num(*[f"$.{s}.start.line" for s in spans]) + 1).alias("line"),
            num(*[f"$.{s}.start.character" for s in spans]).alias("character"),
        )
        .filter(F.col("_abs").startswith(F.col("repo_root")))
        .withColumn("file_path", F.regexp_replace(F.substr("_abs", F.length("repo_root") + 1), "^/+", ""))
        .drop("_abs")
    )
