"""Code graph, request log and registry derived from the test tables.

`SHARED` text runs unchanged in Spark and in DuckDB; a name in braces is
another view or a table. Every view reads its whole tables.
"""

from __future__ import annotations

SHARED: dict[str, str] = {}
SPARK: dict[str, str] = {}
DUCK: dict[str, str] = {}

# --- code graph: a function per part, a file per four parts, a repo per region

SHARED["v_functions"] = """
SELECT lower(r_name) AS repo_id,
       concat('src/', lower(n_name), '/m', CAST(floor(p_partkey / 4) AS BIGINT), '.py') AS file_path,
       concat('fn_', p_partkey % 500) AS name,
       concat('src.', lower(n_name), '.m', CAST(floor(p_partkey / 4) AS BIGINT), '.f', p_partkey) AS qualified_name,
       1 + 10 * (p_partkey % 4) AS start_line,
       CASE WHEN p_partkey % 4 = 0 THEN 40 ELSE 9 + 10 * (p_partkey % 4) END AS end_line,
       p_partkey % 4 <> 0 AS is_method, p_size > 40 AS is_async,
       CASE WHEN p_partkey % 4 <> 0
            THEN concat('src.', lower(n_name), '.m', CAST(floor(p_partkey / 4) AS BIGINT), '.K') END AS class_qname,
       p_name AS doc, sha1(concat(p_name, p_brand)) AS body_sha,
       p_type, p_size, p_partkey AS fid
FROM {part}
JOIN {supplier} ON s_suppkey = CAST(floor(p_partkey / 20) AS BIGINT)
JOIN {nation} ON n_nationkey = s_nationkey
JOIN {region} ON r_regionkey = n_regionkey
"""

SHARED["v_files"] = """
SELECT repo_id, file_path AS path, 'python' AS language, count(*) * 100 AS size_bytes,
       sha1(concat(file_path, CAST(max(fid) AS STRING))) AS sha
FROM {v_functions} GROUP BY repo_id, file_path
"""

SHARED["v_classes"] = """
SELECT repo_id, file_path, 'K' AS name,
       replace(replace(file_path, '.py', '.K'), '/', '.') AS qualified_name,
       1 AS start_line, 40 AS end_line, doc
FROM {v_functions} WHERE start_line = 1 AND p_type NOT IN ('ECONOMY', 'PROMO')
"""

SHARED["v_call_sites"] = """
SELECT DISTINCT a1.repo_id, a1.qualified_name AS caller_qname, b1.name AS callee_name,
       a.l_linenumber AS line, a1.file_path
FROM {lineitem} a
JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN {v_functions} a1 ON a1.fid = a.l_partkey
JOIN {v_functions} b1 ON b1.fid = b.l_partkey AND a1.repo_id = b1.repo_id
WHERE a.l_returnflag = 'R'
"""

SHARED["v_calls"] = """
SELECT cs.repo_id, cs.caller_qname AS src, f.qualified_name AS dst, max(cs.line) AS line
FROM {v_call_sites} cs
JOIN {v_functions} f ON f.repo_id = cs.repo_id AND f.name = cs.callee_name
GROUP BY cs.repo_id, cs.caller_qname, f.qualified_name
"""

SHARED["v_imports"] = """
SELECT DISTINCT a1.repo_id, a1.file_path,
       CASE b1.fid % 3
         WHEN 0 THEN replace(replace(b1.file_path, '.py', ''), '/', '.')
         WHEN 1 THEN replace(replace(substring(b1.file_path, 5), '.py', ''), '/', '.')
         ELSE concat('ext.lib', b1.p_size) END AS module
FROM {lineitem} a
JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN {v_functions} a1 ON a1.fid = a.l_partkey
JOIN {v_functions} b1 ON b1.fid = b.l_partkey AND a1.repo_id = b1.repo_id
WHERE a.l_returnflag <> 'R'
"""

SHARED["v_definitions"] = """
SELECT cs.repo_id, cs.caller_qname, cs.callee_name, cs.line,
       min(f.file_path) AS target_path, 1 + (cs.line * 7) % 40 AS target_line
FROM {v_call_sites} cs
JOIN {v_functions} f ON f.repo_id = cs.repo_id AND f.name = cs.callee_name
GROUP BY cs.repo_id, cs.caller_qname, cs.callee_name, cs.line
"""

# Spark builds the two tables above without the product of callers and bearers where the rows
# do not need it: the first path of a name is found once per name, and edges are grouped again
# only where a function bears several names
SPARK["v_calls"] = """
WITH w AS (SELECT repo_id, caller_qname, callee_name, max(line) AS line FROM {v_call_sites} GROUP BY repo_id, caller_qname, callee_name),
b AS (SELECT repo_id, qualified_name, min(name) AS name, max(name) AS last FROM {v_functions} GROUP BY repo_id, qualified_name),
m AS (SELECT DISTINCT f.repo_id, f.qualified_name, f.name FROM {v_functions} f
      JOIN b ON b.repo_id = f.repo_id AND b.qualified_name <=> f.qualified_name AND b.name <> b.last)
SELECT w.repo_id, w.caller_qname AS src, b.qualified_name AS dst, w.line FROM w
JOIN b ON b.repo_id = w.repo_id AND b.name = w.callee_name AND b.name = b.last
UNION ALL
SELECT w.repo_id, w.caller_qname, m.qualified_name, max(w.line) FROM w
JOIN m ON m.repo_id = w.repo_id AND m.name = w.callee_name
GROUP BY w.repo_id, w.caller_qname, m.qualified_name
"""
SPARK["v_definitions"] = """
SELECT /*+ MERGE(f) */ cs.repo_id, cs.caller_qname, cs.callee_name, cs.line, f.target_path, 1 + (cs.line * 7) % 40 AS target_line
FROM (SELECT DISTINCT repo_id, caller_qname, callee_name, line FROM {v_call_sites}) cs
JOIN (SELECT repo_id, name, min(file_path) AS target_path FROM {v_functions} GROUP BY repo_id, name) f
  ON f.repo_id = cs.repo_id AND f.name = cs.callee_name
"""

# the stored functions are many times in memory what their files weigh, so that they are not
# sent to the driver to meet the lines
for _name in ("v_call_sites", "v_imports"):
    SPARK[_name] = SHARED[_name].replace("SELECT DISTINCT", "SELECT /*+ MERGE(a1, b1) */ DISTINCT", 1)

# files without a small part are new; files without a large part are gone
SHARED["v_snapshots"] = """
SELECT 'old' AS snap, repo_id, file_path AS path, sha1(file_path) AS sha
FROM {v_functions} GROUP BY repo_id, file_path HAVING min(p_size) <= 20
UNION ALL
SELECT 'new' AS snap, repo_id, file_path AS path,
       CASE WHEN max(p_size) > 46 THEN sha1(concat(file_path, 'edited')) ELSE sha1(file_path) END AS sha
FROM {v_functions} GROUP BY repo_id, file_path HAVING max(p_size) >= 26
"""

# directory of a file as its cluster: a membership both engines agree on
SHARED["v_membership"] = """
SELECT repo_id, path, CAST(regexp_extract(path, 'nation_([0-9]+)', 1) AS BIGINT) AS cluster_id
FROM {v_files}
"""

# --- request log

SHARED["v_api_calls"] = """
SELECT event_id AS id, ts,
       CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 9 END AS token_id,
       CASE WHEN user_id % 9 = 0 THEN 'anonymous' ELSE concat('token_', user_id % 9) END AS token_name,
       CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
       CASE event_type
         WHEN 'view' THEN '/v1/graph/callers_of'
         WHEN 'click' THEN '/v1/search/keyword'
         WHEN 'purchase' THEN '/v1/mcp'
         WHEN 'signup' THEN concat('/v1/sources/', user_id, '/progress')
         ELSE '/v1/graph/blast_radius' END AS route,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       CAST(floor(value) AS INTEGER) AS duration_ms
FROM {events}
"""

SHARED["v_requests"] = """
SELECT event_id AS id, ts,
       CASE WHEN user_id % 9 = 0 THEN NULL ELSE concat('token_', user_id % 9) END AS principal,
       CASE event_type
         WHEN 'view' THEN concat('/v1/repos/r', user_id, '/architecture')
         WHEN 'click' THEN '/healthz'
         WHEN 'purchase' THEN '/v1/analytics/usage'
         WHEN 'signup' THEN concat('/v1/unknown/', repeat('x', CAST(user_id AS INTEGER) * 2))
         ELSE '/v1/graphql' END AS path,
       CASE WHEN event_type = 'view' THEN concat('/v1/repos/', chr(123), 'repo_id', chr(125), '/architecture') END AS template,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       CAST(floor(value) AS INTEGER) AS duration_ms
FROM {events}
"""

# --- registry: sources per nation, repos per customer, runs per order

SHARED["v_sources"] = """
SELECT n_nationkey AS id,
       CASE n_nationkey % 4 WHEN 0 THEN 'github_org' WHEN 1 THEN 'gitlab_group'
            WHEN 2 THEN 'bitbucket_workspace' ELSE 'manifest' END AS kind,
       lower(n_name) AS name, (n_nationkey % 5) * 30 AS sync_interval_seconds,
       n_nationkey % 2 = 0 AS webhook_enabled,
       CASE n_nationkey % 4 WHEN 0 THEN 's' WHEN 2 THEN '' END AS webhook_secret,
       s.last_synced_at
FROM {nation}
LEFT JOIN (SELECT c_nationkey, max(o_orderdate) AS last_synced_at
           FROM {customer} JOIN {orders} ON o_custkey = c_custkey
           WHERE o_orderpriority = '1-URGENT' GROUP BY c_nationkey) s
  ON s.c_nationkey = n_nationkey
"""

SHARED["v_ingest_runs"] = """
SELECT o_orderkey AS id, concat('repo_', o_custkey) AS repo_id,
       CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'success'
            WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'running' END AS status,
       CASE WHEN o_totalprice > 200000 THEN 'full' ELSE 'incremental' END AS mode,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' THEN o_orderdate END AS finished_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN '  '
            WHEN o_orderstatus = 'F' THEN concat(' branch missing ', o_orderpriority, ' ') END AS error
FROM {orders}
"""

SHARED["v_repos"] = """
SELECT concat('repo_', c_custkey) AS id, c_nationkey AS source_id,
       concat('https://user:pw@git.example.com/', lower(c_mktsegment), '/r', c_custkey, '.git') AS url,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'python,go'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'java, rust' ELSE '' END AS languages,
       (c_custkey % 4) * 45 AS poll_interval_seconds,
       s.last_indexed_at
FROM {customer}
LEFT JOIN (SELECT repo_id, max(finished_at) AS last_indexed_at FROM {v_ingest_runs}
           WHERE status = 'success' GROUP BY repo_id) s
  ON s.repo_id = concat('repo_', c_custkey)
"""

SHARED["v_tokens"] = """
SELECT s_suppkey AS id, concat('token_', s_suppkey) AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'repo:read|repo:write' ELSE 'repo:read|' END AS scopes,
       u.last_used_at, s_acctbal < 0 AS revoked
FROM {supplier}
LEFT JOIN (SELECT token_id, max(ts) AS last_used_at FROM {v_api_calls} GROUP BY token_id) u
  ON u.token_id = s_suppkey
"""

SHARED["v_discovered"] = """
SELECT c_nationkey AS source_id, CAST(c_custkey AS STRING) AS external_id,
       concat('Org_', c_nationkey) AS owner, concat(c_mktsegment, '.', c_custkey % 40) AS name,
       concat('Org_', c_nationkey, '/', c_mktsegment, '.', c_custkey % 40) AS full_name,
       concat('https://git.example.com/org_', c_nationkey, '/', c_custkey, '.git') AS clone_url,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'develop' END AS default_branch,
       c_acctbal < 0 AS private, c_acctbal > 8500 AS archived, c_mktsegment = 'AUTOMOBILE' AS fork
FROM {customer}
"""

SHARED["v_source_repos"] = """
SELECT DISTINCT source_id, full_name, lower(concat(owner, '-', replace(name, '.', '-'))) AS repo_id
FROM {v_discovered} WHERE archived OR fork
"""

# repos as the registry holds them, keyed by slug: some owned by their source,
# some registered by hand, some owned by a source that took the slug first
SHARED["v_registry"] = """
SELECT slug AS id,
       CASE WHEN max_bal < 3000 THEN NULL WHEN max_bal < 5500 THEN source_id + 100 ELSE source_id END AS source_id,
       indexed AS last_indexed_at
FROM (SELECT lower(concat('Org_', c_nationkey, '-', c_mktsegment, '-', c_custkey % 40)) AS slug,
             c_nationkey AS source_id, max(c_acctbal) AS max_bal,
             max(CASE WHEN c_acctbal > 4000 THEN '2024-01-01' END) AS indexed
      FROM {customer} GROUP BY 1, 2) g
WHERE max_bal < 7000
"""

# --- free text as source trees

SHARED["v_tree"] = """
SELECT source AS repo_id, doc_id,
       concat(CASE WHEN n_chars % 11 = 0 THEN 'node_modules/' WHEN n_chars % 11 = 1 THEN 'lib/build/'
                   WHEN n_chars % 11 = 2 THEN 'src/main/java/' WHEN n_chars % 11 = 3 THEN '.git/'
                   WHEN n_chars % 11 = 4 THEN 'src/' ELSE '' END,
              lang, '/d', doc_id,
              CASE n_chars % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.lock' WHEN 3 THEN '.PY'
                   WHEN 4 THEN '.md' WHEN 5 THEN '.tsx' WHEN 6 THEN '.java' WHEN 7 THEN '.Rmd'
                   WHEN 8 THEN '' WHEN 9 THEN '.h' WHEN 10 THEN '.d.ts' WHEN 11 THEN '.rs' ELSE '.cc' END) AS path,
       text AS content
FROM {documents}
"""

# --- architecture over the derived code graph, as text for the second engine

DUCK["v_call_edges"] = """
SELECT c.repo_id, a.file_path AS src, b.file_path AS dst, count(*) AS weight
FROM {v_calls} c
JOIN {v_functions} a ON a.repo_id = c.repo_id AND a.qualified_name = c.src
JOIN {v_functions} b ON b.repo_id = c.repo_id AND b.qualified_name = c.dst
WHERE a.file_path <> b.file_path
GROUP BY 1, 2, 3
"""

DUCK["v_candidates"] = """
SELECT repo_id, path, cand FROM (
  SELECT repo_id, path, unnest([path, replace(substring(replace(path, '.py', ''), 5), '/', '.'),
                                substring(replace(path, '.py', ''), 5), replace(replace(path, '.py', ''), '/', '.')]) AS cand
  FROM {v_files}) t
"""

DUCK["v_import_edges"] = """
SELECT i.repo_id, i.file_path AS src, o.dst, count(*) AS weight
FROM {v_imports} i
JOIN (SELECT repo_id, cand, min(path) AS dst FROM {v_candidates} GROUP BY 1, 2) o
  ON o.repo_id = i.repo_id AND o.cand = i.module
WHERE o.dst <> i.file_path
GROUP BY 1, 2, 3
"""

DUCK["v_file_edges"] = """
SELECT repo_id, src, dst, CAST(sum(weight) AS BIGINT) AS weight
FROM (SELECT * FROM {v_call_edges} UNION ALL SELECT * FROM {v_import_edges}) e
GROUP BY 1, 2, 3
"""

DUCK["v_fan"] = """
SELECT repo_id, path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
FROM (SELECT repo_id, dst AS path, 1 AS i, 0 AS o FROM {v_file_edges}
      UNION ALL SELECT repo_id, src, 0, 1 FROM {v_file_edges}) t
GROUP BY 1, 2
"""

DUCK["v_placed"] = """
SELECT e.*, a.cluster_id AS cs, b.cluster_id AS cd
FROM {v_file_edges} e
JOIN {v_membership} a ON a.repo_id = e.repo_id AND a.path = e.src
JOIN {v_membership} b ON b.repo_id = e.repo_id AND b.path = e.dst
"""

DUCK["v_cluster_edges"] = """
SELECT repo_id, cs AS src, cd AS dst, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS cross_file_edges
FROM {v_placed} WHERE cs <> cd GROUP BY 1, 2, 3
"""

DUCK["v_metrics"] = """
SELECT m.repo_id, m.cluster_id, m.name, m.file_count, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out,
       CASE WHEN i + o > 0 THEN round(o / (i + o), 3) ELSE 0.0 END AS instability,
       CASE WHEN intra + ext > 0 THEN round(intra / (intra + ext), 3) ELSE 1.0 END AS cohesion
FROM (SELECT repo_id, cluster_id, count(*) AS file_count,
             CASE WHEN count(*) = 1 THEN min(path) ELSE concat('src/nation_', cluster_id) END AS name
      FROM {v_membership} GROUP BY 1, 2) m
LEFT JOIN (SELECT repo_id, cluster_id, CAST(sum(fan_in) AS BIGINT) AS i, CAST(sum(fan_out) AS BIGINT) AS o
           FROM {v_fan} JOIN {v_membership} USING (repo_id, path) GROUP BY 1, 2) f USING (repo_id, cluster_id)
LEFT JOIN (SELECT repo_id, c AS cluster_id, CAST(sum(n) AS BIGINT) AS intra, CAST(sum(x) AS BIGINT) AS ext FROM (
             SELECT repo_id, cs AS c, CASE WHEN cs = cd THEN 1 ELSE 0 END AS n, CASE WHEN cs = cd THEN 0 ELSE 1 END AS x
             FROM {v_placed}
             UNION ALL SELECT repo_id, cd, 0, 1 FROM {v_placed} WHERE cs <> cd) t GROUP BY 1, 2) h
  USING (repo_id, cluster_id)
"""

DUCK["v_reach"] = """
SELECT repo_id, src, dst FROM {v_file_edges} WHERE src <> dst
"""

# --- price cards: one per region, in dollars per million tokens

SHARED["v_price_cards"] = """
SELECT lower(r_name) AS card, CAST(1.5 + r_regionkey AS DOUBLE) AS per_in, CAST(6 + 3 * r_regionkey AS DOUBLE) AS per_out FROM {region}
"""
