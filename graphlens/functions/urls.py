"""Addresses: which provider, which handle, which owner and repo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cloud hosts, what a name directly below them is, the folders
# below them that mean something else, and the short prefixes.
NAMED_BELOW = {"github.com": "github_user", "gitlab.com": "gitlab_user", "bitbucket.org": "bitbucket_workspace"}
FOLDERS = {("github.com", "orgs"): "github_org", ("github.com", "users"): "github_user", ("gitlab.com", "groups"): "gitlab_group"}
SHORT = {"gh": "github_user", "gl": "gitlab_user", "bb": "bitbucket_workspace"}
MANIFEST_ENDINGS = (".json", ".yaml", ".yml")
DEFAULT_BASE = "https://gitlab.com"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def source_kind(url: Column) -> Column:
    """struct(kind, name) for a pasted address, nulls where no form fits.

    The address is taken apart once: a scheme if there is one, the host, and the
    path between slashes, of which one at the end does not count. What it is
    follows from the host and the number of parts. Queries and fragments are only
    accepted where the rest of the path does not matter.
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1))
    web = scheme.isin("http", "https")
    rest = F.when(web, F.substr(u, F.length(scheme) + 4)).otherwise(u)
    at = F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.substr(rest, F.length(at) + 1)
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", ""), "/")
    first, second, n = parts[0], F.get(parts, F.lit(1)), F.size(parts)
    plain = ~path.rlike("[?#]")
    folder = F.lower(first)
    tail = F.array_join(F.slice(parts, 2, F.greatest(n - 1, F.lit(1))), "/")
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    found = F.when(F.exists(F.array(*[F.lit(e) for e in MANIFEST_ENDINGS]), lambda e: F.endswith(u, e)), pair("manifest", u))
    for (where, name), kind in FOLDERS.items():
        inside = (at == where) & (folder == name) & (n >= 2)
        if kind == "gitlab_group":  # groups nest, so all of the path is the name
            found = found.when(inside & (tail != ""), pair(kind, tail))
        else:
            handle = F.regexp_extract(second, "^([^?#]+)", 1)
            found = found.when(inside & (handle != ""), pair(kind, handle))
    for where, kind in NAMED_BELOW.items():
        found = found.when((at == where) & (n == 1) & (first != "") & plain, pair(kind, first))
    for prefix, kind in SHORT.items():
        name = F.substr(u, F.lit(len(prefix) + 2))
        found = found.when((F.lower(F.left(u, F.lit(len(prefix) + 1))) == f"{prefix}:") & (name != "") & ~name.rlike("[/?#]"), pair(kind, name))
    # a host of one's own needs its scheme; its name keeps it
    own = web & (at != "") & ~at.isin(*NAMED_BELOW)
    bare = F.rtrim(u, F.lit("/"))
    found = found.when(own & (folder == "groups") & (tail != ""), pair("gitlab_group", bare))
    return found.when(own & path.isin("", "/"), pair("gitlab_instance", bare))


def host_handle(name: Column) -> Column:
    """struct(base, handle): where a group lives and its path there."""
    full = r"^(https?://[^/?#]*)/*([^?#]*)"
    bare = F.regexp_replace(name, "/+$", "")
    path = F.regexp_replace(F.regexp_extract(bare, full, 2), "^groups/", "")
    return F.when(
        name.rlike("^https?://"),
        F.struct(F.regexp_extract(bare, full, 1).alias("base"), path.alias("handle")),
    ).otherwise(F.struct(F.lit(DEFAULT_BASE).alias("base"), name.alias("handle")))


def owner_name(url: Column) -> Column:
    """struct(owner, name) from a git address; missing parts get stand-ins."""
    path = F.regexp_replace(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "^/+", "")
    parts = F.filter(F.split(F.regexp_replace(path, r"\.git$", ""), "/"), lambda p: p != "")
    n = F.size(parts)
    owner = F.when(n >= 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "/")).otherwise("manifest")
    name = F.when(n >= 1, F.try_element_at(parts, F.lit(-1))).otherwise("repo")
    return F.struct(owner.alias("owner"), name.alias("name"))
