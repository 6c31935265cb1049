"""Provider listings staged as JSON pages, brought to one row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.urls import owner_name

NEXT_LINK = r'<([^>]+)>;\s*rel="next"'


def flatten_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of a page: a bare list, an envelope with `values`, or one object."""
    v = F.col("_v")
    shape = F.schema_of_variant(v)
    items = (
        F.when(shape.startswith("ARRAY"), v.cast("array<variant>"))
        .when(F.variant_get(v, "$.values", "variant").isNotNull(), F.try_variant_get(v, "$.values", "array<variant>"))
        .otherwise(F.array(v))
    )
    return pages.withColumn("_v", F.try_parse_json(body)).withColumn("item", F.explode(items)).drop("_v", body)


def next_page(link_header: Column, body: Column) -> Column:
    """Address of the following page: from the envelope, else from the link header."""
    linked = F.nullif(F.regexp_extract(link_header, NEXT_LINK, 1), F.lit(""))
    v = F.try_parse_json(body)
    inside = F.try_variant_get(v, "$.values", "variant").isNotNull()
    return F.when(inside, F.try_variant_get(v, "$.next", "string")).otherwise(linked)


def _text(path: str) -> Column:
    return F.try_variant_get("item", path, "string")


def _flag(path: str) -> Column:
    return F.coalesce(F.try_variant_get("item", path, "boolean"), F.lit(False))


def _present(path: str) -> Column:
    return F.try_variant_get("item", path, "variant").isNotNull()


def _some(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _rows(items: DataFrame, **cols: Column) -> DataFrame:
    keep = [c for c in items.columns if c != "item"]
    return items.select(*keep, *[c.alias(n) for n, c in cols.items()])


def discover_github(items: DataFrame) -> DataFrame:
    return _rows(
        items, external_id=_text("$.id"), owner=_text("$.owner.login"), name=_text("$.name"),
        full_name=_text("$.full_name"), clone_url=_text("$.clone_url"),
        default_branch=_some(_text("$.default_branch"), F.lit("main")),
        private=_flag("$.private"), archived=_flag("$.archived"), fork=_flag("$.fork"),
    )


def discover_gitlab(items: DataFrame) -> DataFrame:
    owner = F.coalesce(_some(_text("$.namespace.full_path"), _text("$.namespace.path")), F.lit(""))
    return _rows(
        items, external_id=_text("$.id"), owner=owner, name=_text("$.path"),
        full_name=_some(_text("$.path_with_namespace"), F.concat(owner, F.lit("/"), _text("$.path"))),
        clone_url=_text("$.http_url_to_repo"),
        default_branch=_some(_text("$.default_branch"), F.lit("main")),
        private=F.coalesce(_text("$.visibility"), F.lit("private")) != "public",
        archived=_flag("$.archived"), fork=_present("$.forked_from_project"),
    )


def discover_bitbucket(items: DataFrame) -> DataFrame:
    full = F.coalesce(_text("$.full_name"), F.lit(""))
    links = F.try_variant_get("item", "$.links.clone", "array<struct<name string, href string>>")
    https = F.try_element_at(F.filter(links, lambda x: x["name"] == "https"), F.lit(1))["href"]
    return _rows(
        items, external_id=F.coalesce(_some(_text("$.uuid"), full), F.lit("")),
        owner=F.substring_index(full, "/", 1),
        name=F.coalesce(_some(F.regexp_extract(full, "^[^/]*/(.*)$", 1), _text("$.slug")), F.lit("")),
        full_name=full,
        clone_url=_some(https, F.concat(F.lit("https://bitbucket.org/"), full, F.lit(".git"))),
        default_branch=_some(_text("$.mainbranch.name"), F.lit("main")),
        private=_flag("$.is_private"), archived=F.lit(False), fork=_present("$.parent"),
    )


def discover_manifest(items: DataFrame, override: Column | None = None) -> DataFrame:
    """Items are addresses or objects with url (or clone_url), id and branch."""
    bare = F.schema_of_variant("item") == "STRING"
    url = F.when(bare, F.col("item").cast("string")).otherwise(_some(_text("$.url"), _text("$.clone_url")))
    who = owner_name(url)
    branch = F.when(~bare, _text("$.branch"))
    return _rows(
        items, external_id=_some(F.when(~bare, _text("$.id")), url), owner=who["owner"], name=who["name"],
        full_name=F.concat(who["owner"], F.lit("/"), who["name"]), clone_url=url,
        default_branch=_some(branch, override if override is not None else F.lit(None).cast("string"), F.lit("main")),
        private=F.lit(False), archived=F.lit(False), fork=F.lit(False),
    )


def manifest_items(docs: DataFrame, body: str = "body") -> DataFrame:
    """Items of manifests that are a list or an object with `repos`."""
    v = F.col("_v")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>")).otherwise(
        F.try_variant_get(v, "$.repos", "array<variant>")
    )
    return docs.withColumn("_v", F.try_parse_json(body)).withColumn("item", F.explode(items)).drop("_v", body)
