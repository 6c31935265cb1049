"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names) select what is run. Each query is run to
its last row into a sink that discards them. Tables an ingest would have stored
are written first and timed as `setup`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphlens.session import build_session
from workload import QUERIES
from workload.harness import STORED, Bed
from workload.search import standing_index, standing_vectors
from workload.streams import standing

HEADLINE = (
    "resolve_calls file_call_edges resolve_imports file_dependency_edges innermost_function upgrade_edges has_method_edges "
    "callers_of blast_radius blast_radius_all entry_points graph_stats file_fan cluster_metrics cluster_edges warn_fan_in warn_sdp "
    "usage_totals top_tokens top_endpoints savings_by_route savings_by_token savings_daily latest_run source_progress source_failures "
    "link_repos match_events snapshot_diff webhook_verify extract_functions extract_classes extract_imports extract_call_sites cycles stream_ingest stream_ingest_small text_index keyword_search semantic_search "
    "stream_hourly_usage"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    bed, begun = Bed(spark, sf_dir), time.perf_counter()
    for view in sorted(STORED):
        bed.view(view)
    times["setup"] = round(time.perf_counter() - begun, 3)
    if "stream_ingest_small" in names:  # the graph that five files change: a first ingest of all
        begun = time.perf_counter()
        standing(bed)
        times["first_ingest"] = round(time.perf_counter() - begun, 3)
    if "keyword_search" in names:
        begun = time.perf_counter()
        standing_index(bed)
        times["index_documents"] = round(time.perf_counter() - begun, 3)
    if "semantic_search" in names:
        begun = time.perf_counter()
        standing_vectors(bed)
        times["index_vectors"] = round(time.perf_counter() - begun, 3)
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir), "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
