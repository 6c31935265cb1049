"""Extraction from rendered source, and upkeep of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import extract, maintain
from graphlens.session import scratch_path
from graphlens.sources.trees import snapshot_diff
from workload import views
from workload.harness import Bed, query

# --- rendered Python files: four functions, twelve lines apart, and imports at the end;
#     in a file with a class, all but the first function are its methods

views.SHARED["v_placed_functions"] = """
SELECT f.repo_id, f.file_path, f.name, f.qualified_name AS node, f.is_async, f.doc, f.fid % 4 AS slot, 12 * (f.fid % 4) + 2 AS at,
       c.file_path IS NOT NULL AND f.fid % 4 > 0 AS is_method,
       concat(replace(replace(f.file_path, '.py', ''), '/', '.'), CASE WHEN c.file_path IS NOT NULL AND f.fid % 4 > 0 THEN '.K' ELSE '' END) AS holder
FROM {v_functions} f LEFT JOIN {v_classes} c ON c.repo_id = f.repo_id AND c.file_path = f.file_path
"""


def rendered(bed: Bed) -> DataFrame:
    """Source text of every file of the derived graph."""
    return bed.stored("rendered", lambda: _render(bed))


def parsed(bed: Bed) -> DataFrame:
    """What those texts hold, read once for all queries of a session."""
    return bed.stored("parsed", lambda: extract.parsed(rendered(bed)))


def _render(bed: Bed) -> DataFrame:
    f = bed.view("v_placed_functions")
    pad = F.when(F.col("is_method"), "    ").otherwise("")
    line = lambda df, no, text: df.select("repo_id", F.col("file_path").alias("path"), no.cast("int").alias("no"), text.alias("text"))
    head = F.concat(pad, F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "), "name", F.lit("(self, a=len('fn(')):  # fn_0(x)"))
    calls = (
        bed.view("v_call_sites").join(f.select("repo_id", F.col("node").alias("caller_qname"), "at", "is_method"), ["repo_id", "caller_qname"])
        .groupBy("repo_id", "file_path", "at", "is_method", "line")
        .agg(F.array_join(F.sort_array(F.collect_set(F.concat("callee_name", F.lit("(a)")))), "; x.").alias("t"))
    )
    imports = bed.view("v_imports").groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_set("module")).alias("m"))
    m = F.col("module")
    written = (
        F.when(m.startswith("src."), F.concat(F.lit("from "), F.regexp_extract(m, r"^(.*)\.[^.]*$", 1), F.lit(" import "), F.regexp_extract(m, r"([^.]*)$", 1)))
        .when(m.startswith("ext."), F.concat(F.lit("import "), m, F.lit(" as e")))
        .otherwise(F.concat(F.lit("import "), m))
    )
    rows = (
        line(f, F.col("at"), head)
        .unionByName(line(f, F.col("at") + 1, F.concat(pad, F.lit('    """'), "doc", F.lit('"""'))))
        .unionByName(line(f, F.col("at") + 2, F.concat(pad, F.lit("    pass"))))
        .unionByName(line(calls, F.col("at") + 2 + F.col("line"), F.concat(pad, F.lit("    "), "t")))
        .unionByName(line(bed.view("v_classes"), F.lit(13), F.lit("class K:")))
        .unionByName(line(bed.view("v_classes"), F.lit(60), F.lit("from . import near")))
        .unionByName(line(imports.select("repo_id", "file_path", F.posexplode("m").alias("i", "module")), F.col("i") + 61, written))
    )
    text = F.transform(F.sequence(F.lit(1), F.max("no")), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("no", "text"))), i), F.lit("")))
    return rows.groupBy("repo_id", "path").agg(F.array_join(text, "\n").alias("content"))


views.DUCK["v_found_functions"] = """
SELECT f.repo_id, f.file_path, f.name, concat(f.holder, '.', f.name) AS qualified_name, f.at AS start_line, f.at + 2 + coalesce(k, 0) AS end_line,
       f.is_method, f.is_async, CASE WHEN f.is_method THEN f.holder ELSE '-' END AS class_qname, f.node, f.doc
FROM v_placed_functions f
LEFT JOIN (SELECT repo_id, caller_qname AS node, max(line) AS k FROM v_call_sites GROUP BY 1, 2) s ON s.repo_id = f.repo_id AND s.node = f.node
"""


@query("extract_functions", """
SELECT repo_id, file_path, name, qualified_name, start_line, end_line, is_method, is_async, class_qname, doc FROM v_found_functions
""")
def _(bed: Bed):
    return extract.extract_functions(rendered(bed), parsed(bed)).withColumn("class_qname", F.coalesce("class_qname", F.lit("-"))).drop("body_sha")


@query("extract_body_sha", """
WITH c AS (SELECT repo_id, caller_qname AS node, line, string_agg(call, '; x.' ORDER BY call) AS t
           FROM (SELECT DISTINCT repo_id, caller_qname, line, concat(callee_name, '(a)') AS call FROM v_call_sites) d GROUP BY 1, 2, 3),
l AS (SELECT f.repo_id, f.node, k.k AS off, CASE WHEN c.t IS NULL THEN '' ELSE concat(CASE WHEN f.is_method THEN '        ' ELSE '    ' END, c.t) END AS t
      FROM v_found_functions f JOIN (SELECT unnest(range(1, 8)) AS k) k ON k.k <= f.end_line - f.start_line - 2
      LEFT JOIN c ON c.repo_id = f.repo_id AND c.node = f.node AND c.line = k.k),
b AS (SELECT repo_id, node, string_agg(t, chr(10) ORDER BY off) AS t FROM l GROUP BY 1, 2)
SELECT f.repo_id, f.qualified_name, sha1(concat(CASE WHEN f.is_async THEN 'async ' ELSE '' END, 'def ', f.name, '(self, a=len(''fn('')):  # fn_0(x)', chr(10),
       CASE WHEN f.is_method THEN '        ' ELSE '    ' END, '\"\"\"', f.doc, '\"\"\"', chr(10), CASE WHEN f.is_method THEN '        ' ELSE '    ' END, 'pass',
       CASE WHEN b.t IS NULL THEN '' ELSE concat(chr(10), b.t) END)) AS body_sha
FROM v_found_functions f LEFT JOIN b ON b.repo_id = f.repo_id AND b.node = f.node
""")
def _(bed: Bed):
    return extract.extract_functions(rendered(bed), parsed(bed)).select("repo_id", "qualified_name", "body_sha")


@query("extract_classes", """
SELECT c.repo_id, c.file_path, 'K' AS name, c.qualified_name, CAST(13 AS INTEGER) AS start_line, f.e AS end_line
FROM v_classes c JOIN (SELECT repo_id, file_path, max(end_line) AS e FROM v_found_functions GROUP BY 1, 2) f
  ON f.repo_id = c.repo_id AND f.file_path = c.file_path
""")
def _(bed: Bed):
    return extract.extract_classes(rendered(bed), parsed(bed)).drop("doc")


@query("extract_call_sites", """
SELECT DISTINCT s.repo_id, s.file_path, f.qualified_name AS caller_qname, s.callee_name, f.start_line + 2 + s.line AS line
FROM v_call_sites s JOIN v_found_functions f ON f.repo_id = s.repo_id AND f.node = s.caller_qname
""")
def _(bed: Bed):
    return extract.extract_call_sites(rendered(bed), parsed(bed)).drop("character")


@query("extract_imports", """
SELECT repo_id, file_path, module, CASE WHEN module LIKE 'ext.%' THEN 'e' ELSE '-' END AS alias, false AS is_relative FROM v_imports
UNION ALL SELECT repo_id, file_path, '..near', '-', true FROM v_classes
""")
def _(bed: Bed):
    return extract.extract_imports(rendered(bed), parsed(bed)).withColumn("alias", F.coalesce("alias", F.lit("-")))


@query("extract_docs", "SELECT repo_id, file_path, qualified_name, doc FROM v_found_functions")
def _(bed: Bed):
    return extract.extract_docs(rendered(bed), parsed(bed))


@query("ingest_stats", """
SELECT f.repo_id, count(DISTINCT f.file_path) AS files_parsed, CAST(0 AS BIGINT) AS files_skipped, 'python' AS languages, count(*) AS functions,
       (SELECT count(*) FROM v_classes c WHERE c.repo_id = f.repo_id) AS classes,
       (SELECT count(*) FROM (SELECT DISTINCT repo_id, caller_qname, callee_name, line FROM v_call_sites) s WHERE s.repo_id = f.repo_id) AS calls,
       (SELECT count(*) FROM v_imports i WHERE i.repo_id = f.repo_id) + (SELECT count(*) FROM v_classes c WHERE c.repo_id = f.repo_id) AS imports
FROM v_functions f GROUP BY f.repo_id
""")
def _(bed: Bed):
    return extract.ingest_stats(rendered(bed))


@query("method_class", """
SELECT concat('m', p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN '.go' WHEN p_type IN ('SMALL', 'LARGE') THEN '.cpp' ELSE '.rs' END) AS file_path,
       concat('fn_', p_partkey) AS name,
       concat('m', p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN '.' ELSE '::' END, 'T', p_size) AS class_qname
FROM part
""")
def _(bed: Bed):
    key, owner = F.col("p_partkey").cast("string"), F.concat(F.lit("T"), F.col("p_size").cast("string"))
    go, cpp = F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_type").isin("SMALL", "LARGE")
    code = (
        F.when(go, F.concat(F.lit("package p\n\nfunc (r *"), owner, F.lit(") fn_"), key, F.lit("(x int) int {\n\treturn f(x)\n}\n")))
        .when(cpp, F.concat(F.lit("int "), owner, F.lit("::fn_"), key, F.lit("(int x) {\n    return f(x);\n}\n")))
        .otherwise(F.concat(F.lit("impl "), owner, F.lit(" {\n    pub fn fn_"), key, F.lit("(&self) -> i32 {\n        f(1)\n    }\n}\n")))
    )
    ending = F.when(go, ".go").when(cpp, ".cpp").otherwise(".rs")
    files = bed.table("part").select(F.lit("r").alias("repo_id"), F.concat(F.lit("m"), key, ending).alias("path"), code.alias("content"))
    return extract.extract_functions(files).select("file_path", "name", "class_qname")


@query("package_name", r"""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN CASE lang WHEN 'en' THEN '' WHEN 'de' THEN concat('src\', source, '\D', doc_id) ELSE concat('src.', source, '.D', doc_id) END
       ELSE CASE lang WHEN 'de' THEN concat('App\', source) ELSE concat('com.', source) END END AS module
FROM documents
""")
def _(bed: Bed):
    lang, none = F.col("lang"), F.col("n_chars") % 3 == 0
    head = (
        F.when(none, "")
        .when(lang == "en", F.concat(F.lit("package com."), "source", F.lit(";\n")))
        .when(lang == "de", F.concat(F.lit("<?php\nnamespace App\\"), "source", F.lit(";\n")))
        .when(lang == "fr", F.concat(F.lit("// a\npackage com."), "source", F.lit("\n")))
        .otherwise(F.concat(F.lit("namespace com."), "source", F.lit(" {\n")))
    )
    ending = F.when(lang == "en", ".java").when(lang == "de", ".php").when(lang == "fr", ".kt").otherwise(".cs")
    files = bed.table("documents").select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("src/"), "source", F.lit("/D"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.concat(head, "text").alias("content"),
    )
    return extract.package_names(files).select(F.regexp_extract("path", r"/D(\d+)\.", 1).cast("bigint").alias("doc_id"), "module")


# --- upkeep ------------------------------------------------------------------


@query("upsert_nodes", """
SELECT repo_id, qualified_name, file_path, start_line,
       CASE WHEN p_size > 25 THEN concat(body_sha, '-2') WHEN p_type = 'PROMO' THEN concat(body_sha, '-1') ELSE body_sha END AS body_sha
FROM v_functions
UNION ALL
SELECT repo_id, concat(qualified_name, '.new'), file_path, 50, body_sha FROM v_functions WHERE p_size < 4
""")
def _(bed: Bed):
    keep = ["repo_id", "qualified_name", "file_path", "start_line", "body_sha"]
    f = bed.view("v_functions")
    marked = lambda cond, batch: f.filter(cond).withColumn("body_sha", F.concat("body_sha", F.lit(f"-{batch}"))).withColumn("batch", F.lit(batch))
    fresh = f.filter("p_size < 4").withColumn("qualified_name", F.concat("qualified_name", F.lit(".new"))).withColumn("start_line", F.lit(50)).withColumn("batch", F.lit(1))
    incoming = marked("p_type = 'PROMO'", 1).unionByName(marked("p_size > 25", 2)).unionByName(fresh)
    stored = f.select(*keep).withColumn("batch", F.lit(0))
    return maintain.upsert(stored, incoming.select(*keep, "batch"), ["repo_id", "qualified_name"], ["batch"]).drop("batch")


@query("purge_files", """
WITH gone AS (SELECT repo_id, path AS file_path FROM v_snapshots GROUP BY 1, 2 HAVING max(CASE WHEN snap = 'old' THEN sha END) <> coalesce(max(CASE WHEN snap = 'new' THEN sha END), ''))
SELECT 'function' AS kind, repo_id, qualified_name AS key FROM v_functions f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = f.repo_id AND g.file_path = f.file_path)
UNION ALL SELECT 'site', repo_id, concat(caller_qname, callee_name, line) FROM v_call_sites f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = f.repo_id AND g.file_path = f.file_path)
UNION ALL SELECT 'import', repo_id, concat(file_path, module) FROM v_imports f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = f.repo_id AND g.file_path = f.file_path)
""")
def _(bed: Bed):
    s = bed.view("v_snapshots")
    gone = snapshot_diff(s.filter("snap = 'old'"), s.filter("snap = 'new'")).filter(F.col("state").isin("changed", "removed"))
    part = lambda v, kind, key: maintain.purge_files(bed.view(v), gone).select(F.lit(kind).alias("kind"), "repo_id", key.alias("key"))
    return (
        part("v_functions", "function", F.col("qualified_name"))
        .unionByName(part("v_call_sites", "site", F.concat("caller_qname", "callee_name", F.col("line").cast("string"))))
        .unionByName(part("v_imports", "import", F.concat("file_path", "module")))
    )


@query("full_rebuild", """
SELECT repo_id, path, CASE WHEN repo_id = 'asia' THEN concat(sha, '-2') ELSE sha END AS sha FROM v_files
""")
def _(bed: Bed):
    """All repos are stored, then one is rebuilt; the others must stay as they are."""
    location = scratch_path(bed.spark, "files")
    files = bed.view("v_files").select("repo_id", "path", "sha")
    maintain.full_rebuild(files, location)
    maintain.full_rebuild(files.filter("repo_id = 'asia'").withColumn("sha", F.concat("sha", F.lit("-2"))), location)
    return bed.spark.read.schema(files.schema).parquet(location)
