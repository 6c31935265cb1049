"""Column layout of the graph and registry tables."""

from __future__ import annotations

# Symbol and edge tables are keyed by repo_id first, so that it can be the
# partition column of every stored table.
SCHEMAS: dict[str, str] = {
    "repos": "id string, url string, default_branch string, languages string, last_indexed_at timestamp, "
             "last_indexed_sha string, source_id bigint, poll_interval_seconds int",
    "files": "repo_id string, path string, language string, size_bytes bigint, sha string",
    "classes": "repo_id string, file_path string, name string, qualified_name string, start_line int, "
               "end_line int, doc string",
    "functions": "repo_id string, file_path string, name string, qualified_name string, start_line int, "
                 "end_line int, is_method boolean, is_async boolean, doc string, body_sha string, "
                 "class_qname string",
    "imports": "repo_id string, file_path string, module string, alias string, is_relative boolean",
    "call_sites": "repo_id string, file_path string, caller_qname string, callee_name string, line int, "
                  "character int",
    "calls": "repo_id string, src string, dst string, line int, precise boolean",
    "clusters": "repo_id string, id bigint, name string, file_count bigint, instability double, "
                "cohesion double, fan_in bigint, fan_out bigint, edge_source string",
    "cluster_files": "repo_id string, cluster_id bigint, path string",
    "cluster_edges": "repo_id string, src bigint, dst bigint, weight bigint, cross_file_edges bigint",
    "warnings": "repo_id string, kind string, severity string, target_kind string, target_id string, "
                "message string, detail_json string",
    "api_calls": "id bigint, ts timestamp, token_id bigint, token_name string, method string, route string, "
                 "status int, duration_ms int",
    "ingest_runs": "id bigint, repo_id string, status string, mode string, started_at timestamp, "
                   "finished_at timestamp, stats string, error string",
    "source_repos": "source_id bigint, repo_id string, external_id string, full_name string, "
                    "default_branch string, private boolean, archived boolean, fork boolean",
}
