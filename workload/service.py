"""Request log, ingest runs, sources and registry reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlens.functions.bands import age_text, error_band
from graphlens.functions.routes import blend, integration, normalise_route, price_of, route_saving
from graphlens.operators import maintain, registry, runs, usage
from workload import views
from workload.harness import Bed, query


def stamp(c: str | Column) -> Column:
    """Timestamps as text, so both engines print them alike."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-"))


def sql_stamp(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '-')"


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


DAY = "(SELECT * FROM v_api_calls WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS log"
WEEK = "(SELECT * FROM v_api_calls WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR) AS log"
WEEK_HOURS = 168

views.DUCK["v_saving_map"] = """
SELECT * FROM (VALUES ('/v1/graph/callers_of', 15600), ('/v1/graph/callees_of', 15600), ('/v1/graph/blast_radius', 23400),
  ('/v1/graph/downstream_dependencies', 23400), ('/v1/graph/imports_of', 1300), ('/v1/graph/file', 1700),
  ('/v1/graph/entry_points', 14400), ('/v1/search/keyword', 7500), ('/v1/search/semantic', 7500),
  ('/v1/repos/' || chr(123) || 'repo_id' || chr(125) || '/architecture', 28500),
  ('/v1/repos/' || chr(123) || 'repo_id' || chr(125) || '/architecture/warnings', 4600),
  ('/v1/mcp', 11200), ('/v1/graphql', 5200)) t(route, each)
"""
views.DUCK["v_week_savings"] = f"""
SELECT log.*, m.each FROM {WEEK}
JOIN v_saving_map m ON m.route = regexp_replace(regexp_replace(log.route, '/[0-9]+(/|$)', '/id\\1', 'g'), '/[0-9]+(/|$)', '/id\\1', 'g')
"""
RATE = "(SELECT max(per_in * 0.85 + per_out * (1 - 0.85)) FROM v_price_cards WHERE card = 'asia') / 1e6"


def _log(bed: Bed):
    return bed.view("v_api_calls")


def _price(bed: Bed):
    return price_of(bed.view("v_price_cards"), "asia")


@query("usage_totals", f"""
SELECT count(*) AS total_calls, round(count(*) / 24.0, 1) AS calls_per_hour, count(DISTINCT token_name) AS distinct_tokens,
       round(100.0 * count(*) FILTER (status >= 400) / count(*), 1) AS error_rate_pct
FROM {DAY}
""")
def _(bed: Bed):
    return usage.usage_totals(_log(bed), bed.as_of())


@query("top_tokens", f"""
SELECT coalesce(CAST(token_id AS VARCHAR), '-') AS token_id, token_name, count(*) AS calls, {sql_stamp('max(ts)')} AS last_call,
       arg_max(status, id) AS last_status
FROM {DAY} GROUP BY log.token_id, token_name ORDER BY calls DESC, token_name LIMIT 10
""")
def _(bed: Bed):
    return usage.top_tokens(_log(bed), bed.as_of()).withColumn("last_call", stamp("last_call")).withColumn("token_id", text("token_id"))


@query("top_endpoints", f"""
SELECT route, method, count(*) AS calls, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS INTEGER) AS p95,
       round(100.0 * count(*) FILTER (status >= 400) / count(*), 1) AS error_rate_pct
FROM {DAY} GROUP BY 1, 2 ORDER BY calls DESC, route, method LIMIT 12
""")
def _(bed: Bed):
    return usage.top_endpoints(_log(bed), bed.as_of())


@query("route_latency", """
SELECT route, method, count(*) AS calls, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS INTEGER) AS p95,
       round(100.0 * count(*) FILTER (status >= 400) / count(*), 1) AS error_rate_pct
FROM v_api_calls GROUP BY 1, 2
""")
def _(bed: Bed):
    return usage.route_latency(_log(bed))


@query("recent_calls", f"""
SELECT id, {sql_stamp('ts')} AS ts, token_name, method, route, status, duration_ms FROM v_api_calls ORDER BY id DESC LIMIT 20
""")
def _(bed: Bed):
    return usage.recent_calls(_log(bed)).select("id", stamp("ts").alias("ts"), "token_name", "method", "route", "status", "duration_ms")


@query("savings_by_route", f"""
SELECT route, CASE WHEN route LIKE '/v1/mcp%' THEN 'mcp' WHEN route LIKE '/v1/graphql%' THEN 'graphql' ELSE 'rest' END AS integration,
       count(*) AS calls, CAST(sum(each) AS BIGINT) AS tokens_saved, round(sum(each) * {RATE}, 4) AS dollars_saved
FROM v_week_savings GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 15
""")
def _(bed: Bed):
    return usage.savings_by_route(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS)


@query("savings_lifetime", f"""
SELECT CAST(sum(each) AS BIGINT) AS tokens_saved, round(sum(each) * {RATE}, 2) AS dollars_saved
FROM v_api_calls JOIN v_saving_map USING (route)
""")
def _(bed: Bed):
    return usage.savings_total(_log(bed), _price(bed))


@query("savings_by_token", f"""
SELECT coalesce(CAST(token_id AS VARCHAR), '-') AS token_id, token_name, count(*) AS calls, CAST(sum(each) AS BIGINT) AS tokens_saved,
       round(sum(each) * {RATE}, 4) AS dollars_saved
FROM v_week_savings w GROUP BY w.token_id, token_name ORDER BY 4 DESC, 2 LIMIT 10
""")
def _(bed: Bed):
    return usage.savings_by_token(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS).withColumn("token_id", text("token_id"))


BY_INTEGRATION = f"""
SELECT CASE WHEN route LIKE '/v1/mcp%' THEN 'mcp' WHEN route LIKE '/v1/graphql%' THEN 'graphql' ELSE 'rest' END AS integration,
       count(*) AS calls, CAST(sum(each) AS BIGINT) AS tokens_saved, round(sum(each) * {RATE}, 4) AS dollars_saved
FROM v_week_savings GROUP BY 1
"""


@query("savings_by_integration", BY_INTEGRATION)
def _(bed: Bed):
    return usage.savings_by_integration(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS)


@query("savings_daily", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(each) AS BIGINT) AS tokens_saved, round(sum(each) * {RATE}, 4) AS dollars_saved
FROM v_week_savings GROUP BY 1
""")
def _(bed: Bed):
    return usage.savings_daily(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS)


@query("shares", f"""
SELECT integration, tokens_saved, round(100.0 * tokens_saved / sum(tokens_saved) OVER (), 3) AS pct_of_total,
       round(100.0 * tokens_saved / max(tokens_saved) OVER (), 3) AS pct_of_max
FROM ({BY_INTEGRATION}) b
""")
def _(bed: Bed):
    by = usage.savings_by_integration(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS).select("integration", "tokens_saved")
    return usage.shares(by, "tokens_saved")


@query("savings_summary")
def _(bed: Bed):
    return usage.savings_summary(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS)


@query("savings_summary_heads", f"""
SELECT (SELECT count(*) FROM {WEEK}) AS total_calls, count(*) AS total_calls_saving, CAST(sum(each) AS BIGINT) AS tokens_saved,
       count(DISTINCT route) AS routes, count(DISTINCT token_name) AS tokens, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days
FROM v_week_savings
""")
def _(bed: Bed):
    return usage.savings_summary(_log(bed), _price(bed), bed.as_of(), WEEK_HOURS).select(
        "total_calls", "total_calls_saving", "tokens_saved", F.size("by_route").cast("bigint").alias("routes"),
        F.size("by_token").cast("bigint").alias("tokens"), F.size("daily").cast("bigint").alias("days"),
    )


@query("normalise_route", r"""
SELECT id, replace(replace(regexp_replace(regexp_replace(route, '/[0-9]+(/|$)', '/id\1', 'g'), '/[0-9]+(/|$)', '/id\1', 'g'), '/id', '/' || chr(123) || 'id' || chr(125)), '//', '/') AS route
FROM v_api_calls
""")
def _(bed: Bed):
    return _log(bed).select("id", normalise_route(F.col("route")).alias("route"))


@query("integration_bucket", """
SELECT id, CASE WHEN path LIKE '/v1/mcp%' THEN 'mcp' WHEN path LIKE '/v1/graphql%' THEN 'graphql'
                WHEN path LIKE '/v1/%' THEN 'rest' ELSE 'other' END AS bucket FROM v_requests
""")
def _(bed: Bed):
    return bed.view("v_requests").select("id", integration(F.col("path")).alias("bucket"))


@query("route_saving", """
SELECT id, CAST(coalesce(m.each, 0) AS BIGINT) AS saving FROM v_requests r LEFT JOIN v_saving_map m ON m.route = coalesce(r.template, r.path)
""")
def _(bed: Bed):
    return bed.view("v_requests").select("id", route_saving(F.coalesce("template", "path")).alias("saving"))


@query("price_cards", """
SELECT card, CAST(round(per_in * 0.85 + per_out * (1 - 0.85), 4) AS DOUBLE) AS per_million,
       CAST(round(t.tokens * (per_in * 0.85 + per_out * (1 - 0.85)) / 1e6, 2) AS DOUBLE) AS dollars
FROM v_price_cards, (SELECT sum(each) AS tokens FROM v_week_savings) t
""")
def _(bed: Bed):
    week = usage.in_window(_log(bed), bed.as_of(), WEEK_HOURS)
    tokens = usage.savings_total(week, _price(bed)).select("tokens_saved").scalar()
    each = blend(F.col("per_in"), F.col("per_out"))
    return bed.view("v_price_cards").select("card", F.round(each, 4).alias("per_million"), F.round(tokens * each / 1e6, 2).alias("dollars"))


@query("price_unknown", "SELECT CAST(sum(each) AS BIGINT) AS tokens_saved, CAST(NULL AS DOUBLE) AS dollars_saved FROM v_week_savings")
def _(bed: Bed):
    week = usage.in_window(_log(bed), bed.as_of(), WEEK_HOURS)
    return usage.savings_total(week, price_of(bed.view("v_price_cards"), "no such card"))


@query("status_bands", f"""
SELECT route, error_rate_pct, CASE WHEN error_rate_pct > 20 THEN 'bad' WHEN error_rate_pct > 5 THEN 'warn' ELSE 'ok' END AS band,
       CASE WHEN s < 0 THEN 'just now' WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago')
            WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS age
FROM (SELECT route, round(100.0 * count(*) FILTER (status >= 400) / count(*), 1) AS error_rate_pct,
             (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) // 1000000 AS s
      FROM v_api_calls GROUP BY 1) t
""")
def _(bed: Bed):
    rate = F.round(100.0 * F.count_if(F.col("status") >= 400) / F.count(F.lit(1)), 1)
    per = _log(bed).groupBy("route").agg(rate.alias("error_rate_pct"), F.max("ts").alias("last"))
    return per.select(
        "route", "error_rate_pct", error_band(F.col("error_rate_pct")).alias("band"),
        age_text(F.col("last"), F.lit(bed.as_of())).alias("age"),
    )


# --- log maintenance ---------------------------------------------------------


@query("log_filter", f"""
SELECT id, {sql_stamp('ts')} AS ts, coalesce(principal, 'anonymous') AS token_name, left(coalesce(template, path), 200) AS route, status, duration_ms
FROM v_requests WHERE path NOT IN ('/healthz', '/readyz', '/') AND NOT (path LIKE '/v1/analytics/%' OR path LIKE '/v1/graphql%')
""")
def _(bed: Bed):
    return maintain.log_rows(bed.view("v_requests")).withColumn("ts", stamp("ts"))


@query("prune_log", "SELECT id FROM v_api_calls WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(bed: Bed):
    return maintain.prune_log(_log(bed), bed.as_of()).select("id")


# --- runs and sources --------------------------------------------------------


def _run_clock(bed: Bed):
    return bed.table("orders").agg(F.max("o_orderdate")).first()[0]


LATEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) AS rn FROM v_ingest_runs) t WHERE rn = 1
"""


@query("latest_run", f"SELECT repo_id, id, status, {sql_stamp('started_at')} AS started_at FROM ({LATEST}) l")
def _(bed: Bed):
    return runs.latest_run(bed.view("v_ingest_runs")).select("repo_id", "id", "status", stamp("started_at").alias("started_at"))


@query("queue_depth", f"SELECT count(*) AS queue_depth FROM ({LATEST}) l WHERE status = 'queued'")
def _(bed: Bed):
    return runs.queue_depth(bed.view("v_ingest_runs"))


@query("ingest_summary", """
SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
       CASE WHEN count(*) FILTER (status IN ('success', 'failed')) > 0
            THEN round(100.0 * count(*) FILTER (status = 'success') / count(*) FILTER (status IN ('success', 'failed')), 1) ELSE 0.0 END AS success_rate_pct
FROM v_ingest_runs WHERE started_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR
""")
def _(bed: Bed):
    return runs.ingest_summary(bed.view("v_ingest_runs"), _run_clock(bed))


@query("recent_failures", f"""
SELECT repo_id, left(trim(error), 240) AS error, {sql_stamp('finished_at')} AS finished_at
FROM (SELECT * FROM v_ingest_runs WHERE status = 'failed' AND error IS NOT NULL
      ORDER BY finished_at DESC NULLS FIRST, id DESC LIMIT 5) t
""")
def _(bed: Bed):
    return runs.recent_failures(bed.view("v_ingest_runs")).withColumn("finished_at", stamp("finished_at"))


@query("run_history", f"SELECT id, repo_id, status, mode, {sql_stamp('finished_at')} AS finished_at FROM v_ingest_runs ORDER BY id DESC")
def _(bed: Bed):
    return runs.run_history(bed.view("v_ingest_runs")).select("id", "repo_id", "status", "mode", stamp("finished_at").alias("finished_at"))


PROGRESS = f"""
SELECT s.id AS source_id, count(r.id) AS total, count(r.last_indexed_at) AS indexed,
       count(*) FILTER (l.status = 'queued') AS queued, count(*) FILTER (l.status = 'running') AS running,
       count(*) FILTER (l.status = 'success') AS success, count(*) FILTER (l.status = 'failed') AS failed,
       count(*) FILTER (r.id IS NOT NULL AND l.status IS NULL) AS unstarted,
       count(*) FILTER (l.status IN ('queued', 'running')) > 0 AS in_progress,
       max(coalesce(l.finished_at, l.started_at)) AS last_run_at, any_value(s.last_synced_at) AS last_synced_at
FROM v_sources s LEFT JOIN v_repos r ON r.source_id = s.id LEFT JOIN ({LATEST}) l ON l.repo_id = r.id
GROUP BY s.id
"""


@query("source_progress", f"""
SELECT * REPLACE ({sql_stamp('last_run_at')} AS last_run_at, {sql_stamp('last_synced_at')} AS last_synced_at) FROM ({PROGRESS}) p
""")
def _(bed: Bed):
    p = runs.source_progress(bed.view("v_sources"), bed.view("v_repos"), bed.view("v_ingest_runs"))
    return p.withColumn("last_run_at", stamp("last_run_at")).withColumn("last_synced_at", stamp("last_synced_at"))


@query("progress_pct", f"""
SELECT source_id, CAST(floor(100.0 * indexed / greatest(total, 1) + 0.5) AS BIGINT) AS pct_indexed,
       CAST(floor(100.0 * failed / greatest(total, 1) + 0.5) AS BIGINT) AS pct_failed,
       CAST(floor(100.0 * running / greatest(total, 1) + 0.5) AS BIGINT) AS pct_running
FROM ({PROGRESS}) p
""")
def _(bed: Bed):
    return runs.progress_pct(runs.source_progress(bed.view("v_sources"), bed.view("v_repos"), bed.view("v_ingest_runs")))


@query("source_failures", f"""
SELECT source_id, repo_id, error, {sql_stamp('finished_at')} AS finished_at, rank FROM (
  SELECT r.source_id, l.repo_id, left(trim(l.error), 400) AS error, l.finished_at,
         row_number() OVER (PARTITION BY r.source_id ORDER BY l.finished_at DESC NULLS LAST, l.repo_id) AS rank
  FROM v_repos r JOIN ({LATEST}) l ON l.repo_id = r.id WHERE trim(l.error) <> '') t
WHERE rank <= 5
""")
def _(bed: Bed):
    return runs.source_failures(bed.view("v_repos"), bed.view("v_ingest_runs")).withColumn("finished_at", stamp("finished_at"))


@query("source_summary", f"""
SELECT kind, count(*) AS total, count(*) FILTER (webhook_enabled AND webhook_secret <> '') AS with_webhook,
       count(*) FILTER (sync_interval_seconds > 0) AS with_schedule, {sql_stamp('max(last_synced_at)')} AS last_synced_at
FROM (SELECT * FROM v_sources UNION ALL SELECT * REPLACE ('*' AS kind) FROM v_sources) s GROUP BY 1
""")
def _(bed: Bed):
    return runs.source_summary(bed.view("v_sources")).withColumn("last_synced_at", stamp("last_synced_at"))


@query("token_summary", f"""
SELECT count(*) AS total, count(*) FILTER (NOT revoked) AS active, count(*) FILTER (revoked) AS revoked,
       count(*) FILTER (last_used_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS used_in_last_24h,
       {sql_stamp('max(last_used_at)')} AS most_recent_use
FROM v_tokens
""")
def _(bed: Bed):
    return runs.token_summary(bed.view("v_tokens"), bed.as_of()).withColumn("most_recent_use", stamp("most_recent_use"))


@query("repo_summary", f"""
SELECT count(*) AS total, count(last_indexed_at) AS indexed, {sql_stamp('max(last_indexed_at)')} AS most_recent_index FROM v_repos
""")
def _(bed: Bed):
    return runs.repo_summary(bed.view("v_repos")).withColumn("most_recent_index", stamp("most_recent_index"))


@query("language_histogram", """
SELECT trim(l) AS language, count(*) AS repos FROM (SELECT unnest(string_split(languages, ',')) AS l FROM v_repos) t
WHERE trim(l) <> '' GROUP BY 1 ORDER BY 2 DESC, 1
""")
def _(bed: Bed):
    return runs.language_histogram(bed.view("v_repos"))


@query("source_repo_counts", """
SELECT s.id, s.kind, s.name, count(r.repo_id) AS repos FROM v_sources s LEFT JOIN v_source_repos r ON r.source_id = s.id GROUP BY 1, 2, 3
""")
def _(bed: Bed):
    return runs.source_repo_counts(bed.view("v_sources"), bed.view("v_source_repos"))


@query("source_flags", "SELECT id, coalesce(webhook_secret <> '', false) AS has_secret, webhook_enabled FROM v_sources")
def _(bed: Bed):
    return runs.source_flags(bed.view("v_sources"))


CLOCK = "(SELECT max(o_orderdate) FROM orders)"


@query("due_sources", f"""
SELECT id FROM v_sources WHERE sync_interval_seconds > 0 AND
  (last_synced_at IS NULL OR epoch({CLOCK}) - epoch(last_synced_at) >= greatest(60, sync_interval_seconds))
""")
def _(bed: Bed):
    return runs.due_sources(bed.view("v_sources"), _run_clock(bed))


@query("due_repos", f"""
SELECT id, CASE WHEN last_indexed_at IS NULL THEN 'full' ELSE 'incremental' END AS mode FROM v_repos WHERE poll_interval_seconds > 0 AND
  (last_indexed_at IS NULL OR epoch({CLOCK}) - epoch(last_indexed_at) >= greatest(60, poll_interval_seconds))
""")
def _(bed: Bed):
    return runs.due_repos(bed.view("v_repos"), _run_clock(bed))


@query("stuck_runs", f"""
SELECT id, repo_id, mode, CASE status WHEN 'queued' THEN 'requeue' ELSE 'fail' END AS action,
       CASE status WHEN 'queued' THEN 'queued' ELSE 'failed' END AS status,
       CASE status WHEN 'queued' THEN '' ELSE 'no final status after 1800s' END AS error
FROM v_ingest_runs r
WHERE (r.status = 'queued' AND started_at < {CLOCK} - INTERVAL 300 SECOND)
   OR (r.status = 'running' AND started_at < {CLOCK} - INTERVAL 1800 SECOND)
""")
def _(bed: Bed):
    return runs.stuck_runs(bed.view("v_ingest_runs"), _run_clock(bed))


views.SHARED["v_run_changes"] = """
SELECT id AS run_id, 1 AS seq, 'queued' AS status FROM {v_ingest_runs}
UNION ALL SELECT id, 2, 'running' FROM {v_ingest_runs} WHERE status <> 'queued'
UNION ALL SELECT id, 3, status FROM {v_ingest_runs} WHERE status IN ('success', 'failed')
"""


@query("run_state", """
SELECT id AS run_id, status, CAST(CASE status WHEN 'queued' THEN 1 WHEN 'running' THEN 2 ELSE 3 END AS BIGINT) AS changes FROM v_ingest_runs
""")
def _(bed: Bed):
    return runs.run_state(bed.view("v_run_changes"))


views.SHARED["v_run_stats"] = """
SELECT r.*, CASE WHEN status = 'success' THEN
         concat(chr(123), '"files_parsed":', CAST(floor(o_totalprice / 1000) AS BIGINT), CASE WHEN mode = 'incremental' THEN
                concat(',"files_added":', o_custkey % 50, ',"files_removed":', o_custkey % 7) ELSE '' END, chr(125)) END AS stats,
       CAST(floor(o_totalprice / 1000) AS BIGINT) AS parsed, o_custkey % 50 AS added, o_custkey % 7 AS removed
FROM {v_ingest_runs} r JOIN {orders} ON o_orderkey = id
"""


@query("run_deltas", """
SELECT id, repo_id, mode, status, CASE WHEN status = 'success' THEN CAST(parsed AS VARCHAR) ELSE '-' END AS files_parsed,
       CASE WHEN status = 'success' AND mode = 'incremental' THEN CAST(added AS VARCHAR) ELSE '-' END AS files_added, '-' AS files_changed,
       CASE WHEN status = 'success' AND mode = 'incremental' THEN CAST(removed AS VARCHAR) ELSE '-' END AS files_removed, '-' AS functions,
       left(coalesce(error, ''), 60) AS error
FROM v_run_stats
""")
def _(bed: Bed):
    out = runs.run_deltas(bed.view("v_run_stats"))
    for c in ("files_parsed", "files_added", "files_changed", "files_removed", "functions"):
        out = out.withColumn(c, text(c))
    return out


@query("paged_list", """
WITH hit AS (SELECT id, url FROM v_repos WHERE lower(id) LIKE '%build%' OR lower(url) LIKE '%build%'),
n AS (SELECT count(*) AS total FROM hit)
SELECT id, url, CAST(total AS INTEGER) AS total FROM hit, n ORDER BY id LIMIT 25
OFFSET (SELECT least(2, greatest(0, CAST(ceil(total / 25.0) AS BIGINT) - 1)) * 25 FROM n)
""")
def _(bed: Bed):
    return runs.search_page(bed.view("v_repos").select("id", "url"), " Build", ["id", "url"], ["id"], 2)


@query("paged_last", """
WITH hit AS (SELECT id FROM v_repos WHERE id LIKE '%repo_1%'), n AS (SELECT count(*) AS total FROM hit)
SELECT id, CAST(total AS INTEGER) AS total FROM hit, n ORDER BY id LIMIT 25
OFFSET (SELECT (CAST(ceil(total / 25.0) AS BIGINT) - 1) * 25 FROM n)
""")
def _(bed: Bed):
    return runs.search_page(bed.view("v_repos").select("id"), "REPO_1", ["id"], ["id"], 10**6)


@query("paged_after", """
SELECT id, coalesce(strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S'), '-') AS indexed FROM v_repos ORDER BY last_indexed_at DESC NULLS LAST, id LIMIT 25 OFFSET 50
""")
def _(bed: Bed):
    """The third page, newest first, each page asked for by the last row of the one before."""
    keys = [runs.Key("last_indexed_at", descending=True, nulls_first=False), runs.Key("id")]
    repos, after = bed.view("v_repos").select("id", "last_indexed_at"), None
    for _ in range(2):
        after = runs.last_key(runs.page_after(repos, keys, after), keys)
    shown = F.coalesce(F.date_format("last_indexed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    return runs.page_after(repos, keys, after).select("id", shown.alias("indexed"))


@query("repo_picker", "SELECT id, last_indexed_at IS NOT NULL AS indexed FROM v_repos ORDER BY last_indexed_at IS NULL, id")
def _(bed: Bed):
    return runs.repo_picker(bed.view("v_repos")).select("id", F.col("last_indexed_at").isNotNull().alias("indexed"))


@query("listings", """
SELECT 'repo' AS list, id AS key, url AS label FROM v_repos
UNION ALL SELECT 'source', CAST(id AS VARCHAR), name FROM v_sources
UNION ALL SELECT 'source_repo', concat(source_id, ':', full_name), repo_id FROM v_source_repos
UNION ALL SELECT 'token', CAST(id AS VARCHAR), name FROM v_tokens
""")
def _(bed: Bed):
    one = lambda v, kind, key, label, *order: bed.view(v).orderBy(*order).select(
        F.lit(kind).alias("list"), key.cast("string").alias("key"), label.alias("label")
    )
    return (
        one("v_repos", "repo", F.col("id"), F.col("url"), "id")
        .unionByName(one("v_sources", "source", F.col("id"), F.col("name"), "id"))
        .unionByName(one("v_source_repos", "source_repo", F.concat(F.col("source_id").cast("string"), F.lit(":"), "full_name"), F.col("repo_id"), "full_name"))
        .unionByName(one("v_tokens", "token", F.col("id"), F.col("name"), "id"))
    )


# --- registry ----------------------------------------------------------------

SPEC = """
SELECT id AS source_id, kind, webhook_enabled AS include_private, sync_interval_seconds > 30 AS include_forks,
       sync_interval_seconds > 60 AS include_archived FROM {v_sources}
"""
views.SHARED["v_specs"] = SPEC


@query("visibility_filter", """
SELECT d.source_id, d.external_id, d.full_name FROM v_discovered d JOIN v_specs s USING (source_id)
WHERE (include_private OR NOT private) AND (include_forks OR NOT fork) AND (include_archived OR NOT archived OR kind = 'bitbucket_workspace')
""")
def _(bed: Bed):
    return registry.visible(bed.view("v_discovered"), bed.view("v_specs")).select("source_id", "external_id", "full_name")


views.DUCK["v_linked"] = """
WITH d AS (SELECT *, lower(concat(owner, '-', replace(name, '.', '-'))) AS slug FROM v_discovered),
j AS (SELECT d.*, l.full_name IS NOT NULL AS linked, g.id IS NOT NULL AS held, g.source_id AS holder
      FROM d LEFT JOIN v_source_repos l ON l.source_id = d.source_id AND l.full_name = d.full_name
      LEFT JOIN v_registry g ON g.id = d.slug),
o AS (SELECT *, row_number() OVER (PARTITION BY slug, linked, held ORDER BY source_id, external_id) AS nth,
             row_number() OVER (PARTITION BY source_id, full_name, linked ORDER BY external_id) AS nth_name,
             first_value(source_id) OVER (PARTITION BY slug, linked, held ORDER BY source_id, external_id) AS first_source FROM j)
SELECT source_id, external_id, full_name, slug,
       CASE WHEN linked THEN 'already'
            WHEN held AND holder IS NULL THEN 'taken' WHEN held AND holder <> source_id THEN 'owned'
            WHEN held THEN CASE WHEN nth_name = 1 THEN 'relink' ELSE 'already' END
            WHEN nth = 1 THEN 'new' WHEN first_source <> source_id THEN 'owned'
            WHEN nth_name = 1 THEN 'relink' ELSE 'already' END AS status
FROM o
"""


def _linked(bed: Bed):
    return registry.link_repos(bed.view("v_discovered"), bed.view("v_source_repos"), bed.view("v_registry"))


@query("link_repos", "SELECT * FROM v_linked")
def _(bed: Bed):
    return _linked(bed)


@query("sync_stats", """
SELECT source_id, count(*) AS discovered, count(*) FILTER (status = 'new') AS added, count(*) FILTER (status IN ('already', 'relink')) AS already,
       count(*) FILTER (status IN ('taken', 'owned')) AS skipped, count(*) FILTER (status = 'new') AS queued
FROM v_linked GROUP BY 1
""")
def _(bed: Bed):
    return registry.sync_stats(_linked(bed))


@query("sync_errors", """
SELECT source_id, external_id, concat(full_name, ': slug ', slug, ' ', CASE status WHEN 'taken' THEN 'is registered by hand' ELSE 'belongs to another source' END) AS error
FROM v_linked WHERE status IN ('taken', 'owned')
""")
def _(bed: Bed):
    return registry.sync_errors(_linked(bed))


@query("audit_rows", """
SELECT 'system' AS actor, 'repo.register.from_source' AS action, slug AS target,
       concat('{"source_id":', source_id, ',"full_name":"', full_name, '"}') AS detail
FROM v_linked WHERE status = 'new'
""")
def _(bed: Bed):
    return maintain.audit_rows(
        _linked(bed).filter(F.col("status") == "new"), F.lit("system"), F.lit("repo.register.from_source"), F.col("slug"),
        source_id=F.col("source_id"), full_name=F.col("full_name"),
    )


views.SHARED["v_pushes"] = """
SELECT event_id, CAST(user_id % 25 AS INTEGER) AS source_id,
       concat('Org_', user_id % 25, '/', CASE event_type WHEN 'view' THEN 'AUTOMOBILE' WHEN 'click' THEN 'BUILDING'
              WHEN 'purchase' THEN 'FURNITURE' WHEN 'signup' THEN 'HOUSEHOLD' ELSE 'MACHINERY' END, '.', user_id % 40) AS full_name, ts
FROM {events}
"""


@query("match_events", """
SELECT p.event_id, p.source_id, p.full_name, coalesce(g.id, '-') AS repo_id, g.id IS NOT NULL AS matched,
       CASE WHEN g.id IS NULL THEN '-' WHEN g.last_indexed_at IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM v_pushes p LEFT JOIN v_source_repos l ON l.source_id = p.source_id AND l.full_name = p.full_name
LEFT JOIN v_registry g ON g.id = l.repo_id
""")
def _(bed: Bed):
    out = registry.match_events(bed.view("v_pushes"), bed.view("v_source_repos"), bed.view("v_registry"))
    return out.withColumn("repo_id", text("repo_id")).withColumn("mode", text("mode")).drop("ts")


@query("cascade_delete", """
WITH gone AS (SELECT id FROM v_sources WHERE kind = 'manifest'),
links AS (SELECT source_id, full_name, repo_id FROM v_source_repos),
dead AS (SELECT DISTINCT repo_id FROM links WHERE source_id IN (SELECT id FROM gone))
SELECT 'sources' AS tbl, count(*) AS n FROM v_sources WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'source_repos', count(*) FROM links WHERE source_id NOT IN (SELECT id FROM gone) AND repo_id NOT IN (SELECT repo_id FROM dead)
UNION ALL SELECT 'repos', count(*) FROM v_registry WHERE id NOT IN (SELECT repo_id FROM dead)
UNION ALL SELECT 'runs', count(*) FROM v_linked WHERE slug NOT IN (SELECT repo_id FROM dead)
""")
def _(bed: Bed):
    sources = bed.view("v_sources")
    left = maintain.cascade_delete(
        sources, sources.filter(F.col("kind") == "manifest"), bed.view("v_source_repos"), bed.view("v_registry"),
        runs=_linked(bed).withColumnRenamed("slug", "repo_id"),
    )
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
