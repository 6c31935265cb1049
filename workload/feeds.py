"""Scalars, source trees, provider feeds and push deliveries."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphlens.functions import text as tx
from graphlens.functions import urls, webhooks
from graphlens.functions.modules import module_qname
from graphlens.sources import components, definitions, feeds, notebooks, trees
from workload import views
from workload.harness import Bed, query

# --- slugs, lists, text ------------------------------------------------------

SLUG_SQL = "left(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 63)"


@query("slugify", f"""
SELECT doc_id, CASE WHEN s = '' THEN 'repo' ELSE s END AS slug, left(regexp_replace(t, '^[^a-z0-9]+', ''), 63) AS typed
FROM (SELECT doc_id, {SLUG_SQL.format("concat(source, '-', text)")} AS s,
             regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS t
      FROM documents) x
""")
def _(bed: Bed):
    return bed.table("documents").select(
        "doc_id", tx.render_slug(F.lit("{owner}-{name}"), F.col("source"), F.col("text"), F.lit("")).alias("slug"),
        tx.typed_slug(F.col("text")).alias("typed"),
    )


@query("slug_valid", f"""
SELECT doc_id, regexp_matches(text, '^[a-z0-9][a-z0-9_-]{{0,62}}$') AS raw_ok,
       regexp_matches({SLUG_SQL.format('text')}, '^[a-z0-9][a-z0-9_-]{{0,62}}$') AS slug_ok
FROM documents
""")
def _(bed: Bed):
    return bed.table("documents").select(
        "doc_id", tx.slug_valid(F.col("text")).alias("raw_ok"), tx.slug_valid(tx.slugify(F.col("text"))).alias("slug_ok")
    )


REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(https?://)[^/@\s]+:[^/@\s]+@', '\1***:***@', 'g'),
  '\b(?:ghp|gho|ghs|ghu|github_pat)_[A-Za-z0-9_]{{20,}}\b', '***', 'g'), '\bglpat-[A-Za-z0-9_.-]{{10,}}\b', '***', 'g')"""


@query("redact_secrets", f"""
SELECT doc_id, sha1({REDACT_SQL.format("concat('clone https://u:p', doc_id, '@git.example.com/x ghp_', repeat('a', 20), ' glpat-', repeat('b', 12), ' ', text)")}) AS redacted_sha,
       left({REDACT_SQL.format("concat('https://u:p', doc_id, '@h/x ', text)")}, 40) AS head
FROM documents
""")
def _(bed: Bed):
    noisy = F.concat(
        F.lit("clone https://u:p"), F.col("doc_id").cast("string"), F.lit("@git.example.com/x ghp_" + "a" * 20 + " glpat-" + "b" * 12 + " "), "text"
    )
    short = F.concat(F.lit("https://u:p"), F.col("doc_id").cast("string"), F.lit("@h/x "), "text")
    return bed.table("documents").select(
        "doc_id", F.sha1(tx.redact(noisy)).alias("redacted_sha"), F.left(tx.redact(short), F.lit(40)).alias("head")
    )


@query("clean_error", r"""
SELECT doc_id, left(regexp_replace(concat(chr(10), ' ', text, ' '), '^\s+|\s+$', '', 'g'), 240) AS e240,
       left(regexp_replace(concat(chr(10), ' ', text, ' '), '^\s+|\s+$', '', 'g'), 400) AS e400,
       sha1(left(regexp_replace(concat(chr(10), ' ', text, ' '), '^\s+|\s+$', '', 'g'), 1900)) AS e1900
FROM documents
""")
def _(bed: Bed):
    raw = F.concat(F.lit("\n "), "text", F.lit(" "))
    return bed.table("documents").select(
        "doc_id", tx.clean_error(raw, 240).alias("e240"), tx.clean_error(raw, 400).alias("e400"),
        F.sha1(tx.clean_error(raw, 1900)).alias("e1900"),
    )


@query("parse_duration", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey WHEN '2-HIGH' THEN o_orderkey * 60
       WHEN '3-MEDIUM' THEN o_orderkey * 3600 WHEN '5-LOW' THEN 0 ELSE o_orderkey * 86400 END AS seconds
FROM orders
""")
def _(bed: Bed):
    unit = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "S").when(F.col("o_orderpriority") == "2-HIGH", "m ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "h").otherwise("d")
    )
    written = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), unit))
    return bed.table("orders").select("o_orderkey", tx.parse_duration(written).alias("seconds"))


@query("split_lists", """
SELECT 'token' AS list, CAST(id AS VARCHAR) AS key, item FROM (SELECT id, unnest(string_split(scopes, '|')) AS item FROM v_tokens) t WHERE item <> ''
UNION ALL
SELECT 'repo', id, item FROM (SELECT id, unnest(string_split(languages, ',')) AS item FROM v_repos) t WHERE item <> ''
""")
def _(bed: Bed):
    tokens = bed.view("v_tokens").select(F.lit("token").alias("list"), F.col("id").cast("string").alias("key"), F.explode(tx.split_list(F.col("scopes"), "|")).alias("item"))
    repos = bed.view("v_repos").select(F.lit("repo").alias("list"), F.col("id").alias("key"), F.explode(tx.split_list(F.col("languages"), ",")).alias("item"))
    return tokens.unionByName(repos)


@query("effective_branch", """
SELECT external_id, coalesce(CASE WHEN private THEN '  ' WHEN fork THEN 'release' END, '') AS given,
       CASE WHEN NOT private AND fork THEN 'release' ELSE coalesce(default_branch, 'main') END AS branch FROM v_discovered
""")
def _(bed: Bed):
    given = F.when(F.col("private"), "  ").when(F.col("fork"), "release")
    return bed.view("v_discovered").select(
        "external_id", F.coalesce(given, F.lit("")).alias("given"), tx.effective_branch(given, F.col("default_branch")).alias("branch")
    )


# --- addresses ---------------------------------------------------------------

views.SHARED["v_addresses"] = """
SELECT page_id, url, k, CASE k
    WHEN 0 THEN concat('https://github.com/orgs/o', page_id, '/') WHEN 1 THEN concat('github.com/users/u', page_id)
    WHEN 2 THEN concat('HTTPS://GitHub.com/u', page_id) WHEN 3 THEN concat('gh:u', page_id)
    WHEN 4 THEN concat('https://gitlab.com/groups/g', page_id, '/sub/') WHEN 5 THEN concat('gl:u', page_id)
    WHEN 6 THEN concat(' https://bitbucket.org/w', page_id, ' ') WHEN 7 THEN concat('bb:w', page_id)
    WHEN 8 THEN regexp_replace(url, '[?#].*$', '.yaml') WHEN 9 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/')
    WHEN 10 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/groups/team/p', page_id, '/')
    WHEN 11 THEN concat('https://github.com/o', page_id, '/repo.git') ELSE url END AS address
FROM (SELECT page_id, url, page_id % 13 AS k FROM {pages}) p
"""


@query("detect_source_kind", r"""
SELECT page_id, k,
       CASE WHEN k = 0 THEN 'github_org' WHEN k IN (1, 2, 3) THEN 'github_user' WHEN k IN (4, 10) THEN 'gitlab_group'
            WHEN k = 5 THEN 'gitlab_user' WHEN k IN (6, 7) THEN 'bitbucket_workspace'
            WHEN k = 8 AND regexp_matches(a, '\.(yaml|yml|json)$') THEN 'manifest' WHEN k = 9 THEN 'gitlab_instance'
            ELSE '-' END AS kind,
       CASE WHEN k = 0 THEN concat('o', page_id) WHEN k IN (1, 2, 3, 5) THEN concat('u', page_id)
            WHEN k = 4 THEN concat('g', page_id, '/sub') WHEN k IN (6, 7) THEN concat('w', page_id)
            WHEN k = 8 AND regexp_matches(a, '\.(yaml|yml|json)$') THEN a WHEN k IN (9, 10) THEN rtrim(a, '/') ELSE '-' END AS name
FROM (SELECT page_id, k, trim(address) AS a FROM v_addresses) t
""")
def _(bed: Bed):
    got = urls.source_kind(F.col("address"))
    return bed.view("v_addresses").select(
        "page_id", "k", F.coalesce(got["kind"], F.lit("-")).alias("kind"), F.coalesce(got["name"], F.lit("-")).alias("name")
    )


@query("split_host_handle", r"""
SELECT page_id, k, CASE WHEN a LIKE 'http%' THEN regexp_extract(a, '^(https?://[^/?#]*)', 1) ELSE 'https://gitlab.com' END AS base,
       CASE WHEN a LIKE 'http%' THEN regexp_replace(rtrim(regexp_extract(a, '^https?://[^/?#]*/*([^?#]*)', 1), '/'), '^groups/', '') ELSE a END AS handle
FROM (SELECT page_id, k, trim(address) AS a FROM v_addresses) t
""")
def _(bed: Bed):
    got = urls.host_handle(F.trim("address"))
    return bed.view("v_addresses").select("page_id", "k", got["base"].alias("base"), got["handle"].alias("handle"))


@query("git_owner_name", r"""
SELECT page_id, CASE WHEN len(p) >= 2 THEN array_to_string(p[1:len(p) - 1], '/') ELSE 'manifest' END AS owner,
       CASE WHEN len(p) >= 1 THEN p[len(p)] ELSE 'repo' END AS name
FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_extract(url || '.git', '^https?://[^/?#]*/*([^?#]*)', 1), '\.git$', ''), '/'), lambda x: x <> '') AS p
      FROM pages) t
""")
def _(bed: Bed):
    got = urls.owner_name(F.concat("url", F.lit(".git")))
    return bed.table("pages").select("page_id", got["owner"].alias("owner"), got["name"].alias("name"))


# --- trees -------------------------------------------------------------------

# endings and folders occurring in the derived tree, told apart one by one
views.DUCK["v_tree_facts"] = r"""
SELECT *, CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN path LIKE '%.tsx' OR path LIKE '%.d.ts' OR path LIKE '%.js' THEN 'javascript'
               WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.Rmd' THEN 'r' WHEN path LIKE '%.h' THEN 'c'
               WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.cc' THEN 'cpp' END AS language,
       path NOT LIKE 'node_modules/%' AND path NOT LIKE '.git/%' AND path NOT LIKE 'lib/build/%' AS outside,
       path NOT LIKE '%.min.js' AND path NOT LIKE '%.lock' AS kept_name
FROM v_tree
"""


@query("scan_filter_paths", "SELECT repo_id, path FROM v_tree_facts WHERE outside AND kept_name")
def _(bed: Bed):
    return bed.view("v_tree").filter(trees.scannable(F.col("path"))).select("repo_id", "path")


@query("detect_language", "SELECT repo_id, path, coalesce(language, '-') AS language FROM v_tree_facts")
def _(bed: Bed):
    return bed.view("v_tree").select("repo_id", "path", F.coalesce(trees.language(F.col("path")), F.lit("-")).alias("language"))


@query("has_source", "SELECT repo_id, max(CASE WHEN outside AND language IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_source FROM v_tree_facts GROUP BY 1")
def _(bed: Bed):
    return trees.has_source(bed.view("v_tree"))


@query("file_fingerprint", """
SELECT repo_id, path, CASE WHEN path LIKE '%.tsx' OR path LIKE '%.ts' THEN 'typescript' ELSE language END AS language,
       CAST(strlen(content) AS BIGINT) AS size_bytes, sha1(content) AS sha
FROM v_tree_facts WHERE language IS NOT NULL
""")
def _(bed: Bed):
    return trees.fingerprint(bed.view("v_tree"))


PARTS_SQL = r"""list_filter(string_split(regexp_replace(path, '([^/])\.[^./]+$', '\1'), '/'),
   lambda p: p <> '' AND p <> '.' AND NOT (coalesce(language, '') = 'rust' AND p = 'src'))"""
MODULE_SQL = f"""CASE WHEN language IN ('rust', 'c', 'cpp') THEN array_to_string({PARTS_SQL}, '::') ELSE array_to_string({PARTS_SQL}, '.') END"""


@query("module_qname", f"SELECT repo_id, path, {MODULE_SQL} AS module FROM v_tree_facts")
def _(bed: Bed):
    language = F.coalesce(trees.language(F.col("path")), F.lit(""))
    return bed.view("v_tree").select("repo_id", "path", module_qname(F.col("path"), language).alias("module"))


@query("snapshot_diff", """
SELECT repo_id, path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT * FROM v_snapshots WHERE snap = 'old') o FULL JOIN (SELECT * FROM v_snapshots WHERE snap = 'new') n USING (repo_id, path)
""")
def _(bed: Bed):
    s = bed.view("v_snapshots")
    return trees.snapshot_diff(s.filter("snap = 'old'"), s.filter("snap = 'new'")).drop("new_sha")


@query("removed_paths", """
SELECT repo_id, path FROM v_snapshots WHERE snap = 'old' EXCEPT SELECT repo_id, path FROM v_snapshots WHERE snap = 'new'
""")
def _(bed: Bed):
    s = bed.view("v_snapshots")
    return trees.removed_paths(s.filter("snap = 'old'"), s.filter("snap = 'new'"))


# --- notebooks and components ------------------------------------------------


@query("notebook_code_cells", """
SELECT conv_id, turn, is_code, line_offset, text_sha FROM (
  SELECT conv_id, turn, role = 'user' AS is_code, sha1(cell) AS text_sha,
         CAST(coalesce(sum(len(cell) - len(replace(cell, chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_offset
  FROM (SELECT *, CASE WHEN role <> 'user' THEN repeat(chr(10), len(text) - len(replace(text, chr(10), '')) + 1)
                       WHEN text LIKE concat('%', chr(10)) THEN concat(text, chr(10)) ELSE concat(text, chr(10), chr(10)) END AS cell
        FROM conversations) c) t
""")
def _(bed: Bed):
    cells = notebooks.cell_offsets(bed.table("conversations"), "conv_id", "turn", F.col("role") == "user", F.col("text"))
    return cells.select("conv_id", "turn", "is_code", "line_offset", F.sha1("cell_text").alias("text_sha"))


@query("notebook_source", """
SELECT conv_id, turn, 'python' AS language, '.py' AS ending,
       sha1(concat(chr(10), chr(10), CASE WHEN role <> 'user' THEN repeat(chr(10), len(text) - len(replace(text, chr(10), '')) + 1)
            WHEN text LIKE concat('%', chr(10)) THEN concat(text, chr(10)) ELSE concat(text, chr(10), chr(10)) END)) AS code_sha
FROM conversations
""")
def _(bed: Bed):
    """Every turn as a notebook file of two cells."""
    cell = lambda kind, text: F.struct(kind.alias("cell_type"), F.array(text).alias("source"))
    cells = F.array(
        cell(F.lit("markdown"), F.concat(F.lit("# "), "role", F.lit("\n"))),
        cell(F.when(F.col("role") == "user", "code").otherwise("markdown"), F.col("text")),
    )
    files = bed.table("conversations").select("conv_id", "turn", F.to_json(F.struct(cells.alias("cells"))).alias("content"))
    got = notebooks.notebook_source(F.col("content"))
    return files.select("conv_id", "turn", got["language"].alias("language"), got["ending"].alias("ending"), F.sha1(got["code"]).alias("code_sha"))


@query("script_blocks", r"""
SELECT page_id, CAST(1 AS INTEGER) AS block_no, '.js' AS ending,
       CAST(len(before) - len(replace(before, chr(10), '')) AS INTEGER) AS line_offset, body AS code
FROM (SELECT page_id, string_split(html, '<script>')[1] AS before, concat('var t="</p>";track(', page_id, ');') AS body FROM pages) t
UNION ALL
SELECT page_id, 2, '.ts', CAST(len(replace(html, chr(10), concat(chr(10), chr(10)))) - len(html) + 2 AS INTEGER), concat('let a = ', page_id, ';', chr(10)) FROM pages
""")
def _(bed: Bed):
    extra = F.concat("html", F.lit('\n<SCRIPT setup lang="ts"\n>let a = '), F.col("page_id").cast("string"), F.lit(";\n</script junk>\n<p>end</p>"))
    return components.script_blocks(bed.table("pages").select("page_id", extra.alias("content")))


# --- provider feeds ----------------------------------------------------------


def _paged(bed: Bed, item: F.Column) -> DataFrame:
    """Items as provider pages of at most a hundred: lists, envelopes, single objects."""
    rows = bed.table("customer").select(
        F.floor(F.col("c_custkey") / 100).alias("no"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("one"), F.col("c_custkey").cast("string")))
        .when(F.col("c_mktsegment") == "BUILDING", "values").otherwise("list").alias("shape"),
        F.to_json(item).alias("j"),
    )
    listed = F.array_join(F.sort_array(F.collect_list("j")), ",")
    body = (
        F.when(F.first("shape") == "values", F.concat(F.lit('{"next":"https://h/?page=2","values":['), listed, F.lit("]}")))
        .when(F.first("shape") == "list", F.concat(F.lit("["), listed, F.lit("]")))
        .otherwise(listed)
    )
    return rows.groupBy("no", "shape").agg(body.alias("body"))


CUST_OWNER = "concat('Org_', c_nationkey)"


@query("flatten_pages", "SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS no, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def _(bed: Bed):
    items = feeds.flatten_pages(_paged(bed, F.struct(F.col("c_custkey").alias("id"), "c_name")))
    return items.select("no", F.try_variant_get("item", "$.id", "string").alias("id"))


@query("next_page", """
SELECT no, shape, CASE WHEN shape = 'values' THEN 'https://h/?page=2' WHEN shape = 'list' THEN concat('https://h/list?page=', no + 1) ELSE '-' END AS next FROM (
  SELECT DISTINCT CAST(floor(c_custkey / 100) AS BIGINT) AS no, CASE c_mktsegment WHEN 'FURNITURE' THEN concat('one', c_custkey) WHEN 'BUILDING' THEN 'values' ELSE 'list' END AS shape FROM customer) t
""")
def _(bed: Bed):
    pages = _paged(bed, F.struct(F.col("c_custkey").alias("id")))
    header = F.when(F.col("shape") == "list", F.concat(F.lit('<https://h/list?page=0>; rel="prev", <https://h/list?page='), (F.col("no") + 1).cast("string"), F.lit('>; rel="next"')))
    return pages.select("no", "shape", F.coalesce(feeds.next_page(header, F.col("body")), F.lit("-")).alias("next"))


@query("discover_github", f"""
SELECT CAST(c_custkey AS VARCHAR) AS external_id, {CUST_OWNER} AS owner, c_name AS name, concat({CUST_OWNER}, '/', c_name) AS full_name,
       concat('https://h/', c_custkey, '.git') AS clone_url, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'dev' ELSE 'main' END AS default_branch,
       c_acctbal < 0 AS private, c_acctbal > 8000 AS archived, false AS fork FROM customer
""")
def _(bed: Bed):
    owner = F.concat(F.lit("Org_"), F.col("c_nationkey").cast("string"))
    item = F.struct(
        F.col("c_custkey").alias("id"), F.struct(owner.alias("login")).alias("owner"), F.col("c_name").alias("name"),
        F.concat(owner, F.lit("/"), "c_name").alias("full_name"), F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string"), F.lit(".git")).alias("clone_url"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "dev").alias("default_branch"),
        (F.col("c_acctbal") < 0).alias("private"), (F.col("c_acctbal") > 8000).alias("archived"),
    )
    return feeds.discover_github(feeds.flatten_pages(_paged(bed, item))).drop("no", "shape")


@query("discover_gitlab", f"""
SELECT CAST(c_custkey AS VARCHAR) AS external_id, {CUST_OWNER} AS owner, c_name AS name, concat({CUST_OWNER}, '/', c_name) AS full_name,
       concat('https://h/', c_custkey, '.git') AS clone_url, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'dev' ELSE 'main' END AS default_branch,
       c_acctbal < 5000 AS private, c_acctbal > 8000 AS archived, c_mktsegment = 'HOUSEHOLD' AS fork FROM customer
""")
def _(bed: Bed):
    owner = F.concat(F.lit("Org_"), F.col("c_nationkey").cast("string"))
    home = c = F.col("c_mktsegment") == "HOUSEHOLD"
    item = F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.when(c, owner).alias("full_path"), owner.alias("path")).alias("namespace"), F.col("c_name").alias("path"),
        F.when(c, F.concat(owner, F.lit("/"), "c_name")).alias("path_with_namespace"),
        F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string"), F.lit(".git")).alias("http_url_to_repo"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "dev").alias("default_branch"),
        F.when(F.col("c_acctbal") >= 5000, "public").when(F.col("c_acctbal") < 0, "internal").alias("visibility"),
        (F.col("c_acctbal") > 8000).alias("archived"), F.when(home, F.struct(F.lit(1).alias("id"))).alias("forked_from_project"),
    )
    return feeds.discover_gitlab(feeds.flatten_pages(_paged(bed, item))).drop("no", "shape")


@query("discover_bitbucket", f"""
SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('u', c_custkey) ELSE concat({CUST_OWNER}, '/', c_name) END AS external_id, {CUST_OWNER} AS owner, c_name AS name,
       concat({CUST_OWNER}, '/', c_name) AS full_name,
       CASE WHEN c_acctbal < 0 THEN concat('https://bitbucket.org/', {CUST_OWNER}, '/', c_name, '.git') ELSE concat('https://h/', c_custkey, '.git') END AS clone_url,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'dev' ELSE 'main' END AS default_branch,
       c_acctbal < 5000 AS private, false AS archived, c_mktsegment = 'AUTOMOBILE' AS fork FROM customer
""")
def _(bed: Bed):
    owner = F.concat(F.lit("Org_"), F.col("c_nationkey").cast("string"))
    url = F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string"), F.lit(".git"))
    link = lambda n, h: F.struct(F.lit(n).alias("name"), h.alias("href"))
    item = F.struct(
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("uuid"),
        F.concat(owner, F.lit("/"), "c_name").alias("full_name"),
        F.struct(F.when(F.col("c_acctbal") < 0, F.array(link("ssh", url))).otherwise(F.array(link("ssh", F.lit("git@h")), link("https", url))).alias("clone")).alias("links"),
        F.struct(F.when(F.col("c_mktsegment") == "MACHINERY", "dev").alias("name")).alias("mainbranch"),
        (F.col("c_acctbal") < 5000).alias("is_private"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.struct(F.lit("x").alias("full_name"))).alias("parent"),
    )
    return feeds.discover_bitbucket(feeds.flatten_pages(_paged(bed, item))).drop("no", "shape")


@query("discover_manifest", """
SELECT CASE WHEN c_acctbal > 8000 THEN concat('id', c_custkey) ELSE u END AS external_id,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'manifest' ELSE concat('g', c_nationkey, '/sub') END AS owner, concat('r', c_custkey) AS name,
       concat(CASE WHEN c_mktsegment = 'FURNITURE' THEN 'manifest' ELSE concat('g', c_nationkey, '/sub') END, '/r', c_custkey) AS full_name, u AS clone_url,
       CASE WHEN c_acctbal >= 5000 AND c_mktsegment = 'MACHINERY' THEN 'dev' ELSE 'release' END AS default_branch, false AS private, false AS archived, false AS fork
FROM (SELECT *, CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('https://h/r', c_custkey) ELSE concat('https://h/g', c_nationkey, '/sub/r', c_custkey, '.git') END AS u FROM customer) c
""")
def _(bed: Bed):
    key = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("https://h/r"), key)).otherwise(
        F.concat(F.lit("https://h/g"), F.col("c_nationkey").cast("string"), F.lit("/sub/r"), key, F.lit(".git"))
    )
    obj = F.to_json(F.struct(
        F.when(F.col("c_acctbal") > 6000, url).alias("url"), F.when(F.col("c_acctbal") <= 6000, url).alias("clone_url"),
        F.when(F.col("c_acctbal") > 8000, F.concat(F.lit("id"), key)).alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "dev").alias("branch"),
    ))
    docs = (
        bed.table("customer")
        .select(F.floor(F.col("c_custkey") / 100).alias("no"), F.when(F.col("c_acctbal") < 5000, F.concat(F.lit('"'), url, F.lit('"'))).otherwise(obj).alias("j"))
        .groupBy("no").agg(F.array_join(F.sort_array(F.collect_list("j")), ",").alias("list"))
        .select("no", F.when(F.col("no") < 3, F.concat(F.lit('{"repos":['), "list", F.lit("]}"))).otherwise(F.concat(F.lit("["), "list", F.lit("]"))).alias("body"))
    )
    return feeds.discover_manifest(feeds.manifest_items(docs), F.lit("release")).drop("no")


@query("definition_locations", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(0 AS INTEGER) AS pos, concat('src/m ', l_suppkey, '+.py') AS file_path,
       CAST(l_quantity AS INTEGER) + 1 AS line, CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END AS character
FROM lineitem WHERE l_returnflag <> 'N'
""")
def _(bed: Bed):
    n = F.col("l_quantity").cast("int").cast("string")
    inside = F.concat(F.lit("file:///work/repo/src/m%20"), F.col("l_suppkey").cast("string"), F.lit("+.py"))
    start = F.concat(F.lit('{"start":{"line":'), n, F.when(F.col("l_linestatus") == "O", F.concat(F.lit(',"character":'), F.col("l_linenumber").cast("string"))).otherwise(""), F.lit("}}"))
    loc = F.concat(F.lit('{"uri":"'), inside, F.lit('","range":'), start, F.lit("}"))
    link = F.concat(F.lit('{"targetUri":"'), inside, F.lit('","targetSelectionRange":'), start, F.lit("}"))
    away = F.concat(F.lit('{"uri":"file:///usr/lib/x.py","range":'), start, F.lit("}"))
    result = (
        F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "null").otherwise(F.concat(F.lit("["), away, F.lit("]"))))
        .when(F.col("l_returnflag") == "A", loc).otherwise(F.concat(F.lit("["), link, F.lit(","), away, F.lit("]")))
    )
    rows = bed.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("/work/repo").alias("repo_root"), result.alias("result"))
    return definitions.definition_locations(rows).drop("repo_root")


# --- push deliveries ---------------------------------------------------------


@F.pandas_udf(StringType())
def _signed(body: pd.Series) -> pd.Series:
    """What a provider would put in the signature header; the checked code is not used here."""
    return body.map(lambda b: "sha256=" + hmac.new(b"top secret of the hook", b.encode(), hashlib.sha256).hexdigest())


SECRET = "top secret of the hook"


def deliveries(events: DataFrame, name: Column) -> DataFrame:
    """A delivery per event, of pushes to `name`. Errors are forged, views are not pushes, clicks have broken bodies."""
    e = events.withColumn("p", F.col("event_id") % 4)
    body = (
        F.when(F.col("event_type") == "click", F.lit("{broken"))
        .when(F.col("p") == 1, F.to_json(F.struct(F.lit("refs/heads/dev").alias("ref"), F.struct(name.alias("path_with_namespace")).alias("project"))))
        .when(F.col("p") == 2, F.to_json(F.struct(F.struct(name.alias("full_name")).alias("repository"), F.struct(F.array(F.struct(F.struct(F.lit("dev").alias("name")).alias("new"))).alias("changes")).alias("push"))))
        .otherwise(F.to_json(F.struct(F.lit("refs/heads/dev").alias("ref"), F.struct(name.alias("full_name")).alias("repository"))))
    )
    e = e.withColumn("body", body).withColumn("sig", _signed("body"))
    quiet, forged = F.col("event_type") == "view", F.col("event_type") == "error"
    pair = lambda k, v: F.create_map(F.lit(k), v)
    headers = (
        F.when(F.col("p") == 0, F.map_concat(pair("X-GitHub-Event", F.when(quiet, "ping").otherwise("push")), pair("X-Hub-Signature-256", F.when(forged, F.concat("sig", F.lit("0"))).otherwise(F.col("sig")))))
        .when(F.col("p") == 1, F.map_concat(pair("X-Gitlab-Event", F.when(quiet, "Issue Hook").otherwise("Push Hook")), pair("X-Gitlab-Token", F.when(forged, "no").otherwise(F.lit(SECRET)))))
        .when(F.col("p") == 2, pair("X-Event-Key", F.when(quiet, "repo:fork").otherwise("repo:push")))
        .otherwise(pair("Content-Type", F.lit("application/json")))
    )
    token = F.when(F.col("p") == 2, F.when(forged, "no").otherwise(F.lit(SECRET)))
    secret = F.when(F.col("user_id") > 140, "").otherwise(SECRET)
    return e.select("event_id", "ts", "user_id", headers.alias("headers"), "body", secret.alias("secret"), token.alias("query_token"))


def _deliveries(bed: Bed) -> DataFrame:
    return deliveries(bed.table("events"), F.concat(F.lit("org/r"), F.col("user_id").cast("string")))


@query("webhook_provider", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE '-' END AS provider FROM events
""")
def _(bed: Bed):
    return _deliveries(bed).select("event_id", F.coalesce(webhooks.provider(F.col("headers")), F.lit("-")).alias("provider"))


@query("webhook_verify", """
SELECT event_id, event_id % 4 <> 3 AND event_type <> 'error' AND user_id <= 140 AS genuine FROM events
""")
def _(bed: Bed):
    h, sent = F.col("headers"), _deliveries(bed)
    return sent.join(webhooks.padded_secrets(sent), "secret", "left").select(
        "event_id", webhooks.genuine(webhooks.provider(h), h, F.col("body"), F.col("secret"), F.col("query_token"), F.col("pads")).alias("genuine")
    )


@query("webhook_parse", """
SELECT event_id, concat('org/r', user_id) AS full_name, 'refs/heads/dev' AS ref FROM events
WHERE event_id % 4 <> 3 AND event_type NOT IN ('view', 'click')
""")
def _(bed: Bed):
    h = F.col("headers")
    got = _deliveries(bed).select("event_id", webhooks.push(webhooks.provider(h), h, F.col("body")).alias("p"))
    return got.filter(F.col("p").isNotNull()).select("event_id", "p.full_name", "p.ref")
