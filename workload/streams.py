"""Streams over the event table, each with the batch result it must reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators import registry
from graphlens.session import scratch_path
from graphlens.streaming import deliveries
from graphlens.streaming import ingest as live
from graphlens.streaming import runs as run_stream
from graphlens.streaming import usage as usage_stream
from graphlens.streaming.run import ROCKSDB, drain, drain_batches, drain_counted, read_files
from workload import feeds
from workload.harness import Bed, query
from workload.ingest import rendered
from workload.service import stamp

END = "(SELECT max(ts) FROM events)"


def _events(bed: Bed) -> DataFrame:
    """The event table as a stream, its times as instants."""
    raw = read_files(bed.spark, bed.dir, "events.parquet", bed.table("events").schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _log(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    route = (
        F.when(kind == "view", "/v1/graph/callers_of").when(kind == "click", "/v1/search/keyword").when(kind == "purchase", "/v1/mcp")
        .when(kind == "signup", F.concat(F.lit("/v1/sources/"), F.col("user_id").cast("string"), F.lit("/progress")))
        .otherwise("/v1/graph/blast_radius")
    )
    return events.select("ts", route.alias("route"), F.when(kind == "error", 500).otherwise(200).alias("status"), F.floor("value").cast("int").alias("duration_ms"))


# hours and days are final once their end lies ten minutes before the newest event
HOURLY = f"""
SELECT date_trunc('hour', ts) AS hour_start, route, count(*) AS calls, count(*) FILTER (status >= 400) AS errors, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM v_api_calls GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {END} - INTERVAL 10 MINUTE
"""


def _hour_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query("stream_hourly_usage", f"SELECT strftime(hour_start, '%Y-%m-%d %H:%M') AS hour_start, route, calls, errors, duration_ms FROM ({HOURLY}) h")
def _(bed: Bed):
    return drain(usage_stream.hourly_usage(_log(_events(bed))), "hourly").select(_hour_text("hour_start"), "route", "calls", "errors", "duration_ms")


@query("stream_usage", f"""
SELECT strftime(hour_start + INTERVAL (k) HOUR, '%Y-%m-%d %H:%M') AS window_end, route, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors
FROM ({HOURLY}) h, (SELECT unnest(range(1, 25)) AS k) k GROUP BY 1, 2
""")
def _(bed: Bed):
    hourly = drain(usage_stream.hourly_usage(_log(_events(bed))), "hourly")
    return usage_stream.trailing_day(hourly).select(_hour_text("window_end"), "route", "calls", "errors")


@query("usage_by_hour", f"SELECT strftime(hour_start, '%Y-%m-%d %H:%M') AS hour_start, route, calls, errors, duration_ms FROM ({HOURLY.split('HAVING')[0]}) h")
def _(bed: Bed):
    """The batch twin: the same plan over a table, with the open hours too."""
    log = _log(bed.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return usage_stream.hourly_usage(log).select(_hour_text("hour_start"), "route", "calls", "errors", "duration_ms")


@query("stream_savings_daily", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(each) AS BIGINT) AS tokens_saved, round(sum(each) * 7.5123 / 1e6, 4) AS dollars_saved
FROM v_api_calls JOIN v_saving_map USING (route)
GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {END} - INTERVAL 10 MINUTE
""")
def _(bed: Bed):
    return drain(usage_stream.daily_savings(_log(_events(bed)), 7.5123), "daily")


@query("stream_dedupe", "SELECT user_id, count(DISTINCT event_id) AS deliveries FROM events GROUP BY 1")
def _(bed: Bed):
    events = _events(bed)
    twice = events.select("user_id", "ts", F.explode(F.array(F.col("event_id"), F.col("event_id"))).alias("delivery_id"))
    return drain(usage_stream.first_deliveries(twice), "deliveries").groupBy("user_id").agg(F.count(F.lit(1)).alias("deliveries"))


@query("stream_push_events", """
SELECT p.event_id, g.id IS NOT NULL AS matched, CASE WHEN g.id IS NULL THEN '-' WHEN g.last_indexed_at IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM v_pushes p LEFT JOIN v_source_repos l ON l.source_id = p.source_id AND l.full_name = p.full_name LEFT JOIN v_registry g ON g.id = l.repo_id
""")
def _(bed: Bed):
    e = _events(bed)
    kind, org = F.col("event_type"), (F.col("user_id") % 25).cast("int")
    name = (
        F.when(kind == "view", "AUTOMOBILE").when(kind == "click", "BUILDING").when(kind == "purchase", "FURNITURE")
        .when(kind == "signup", "HOUSEHOLD").otherwise("MACHINERY")
    )
    full = F.concat(F.lit("Org_"), org.cast("string"), F.lit("/"), name, F.lit("."), (F.col("user_id") % 40).cast("string"))
    pushes = e.select("event_id", org.alias("source_id"), full.alias("full_name"))
    out = registry.match_events(pushes, bed.view("v_source_repos"), bed.view("v_registry")).select("event_id", "matched", F.coalesce("mode", F.lit("-")).alias("mode"))
    return drain(out, "pushes")


RUNS_ASKED_FOR = """
SELECT p.event_id, g.id IS NOT NULL AS matched, CASE WHEN g.id IS NULL THEN '-' WHEN g.last_indexed_at IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM (SELECT * FROM v_pushes JOIN events USING (event_id)
      WHERE event_id % 4 <> 3 AND event_type NOT IN ('error', 'view', 'click') AND source_id % 5 <> 4) p
LEFT JOIN v_source_repos l ON l.source_id = p.source_id AND l.full_name = p.full_name LEFT JOIN v_registry g ON g.id = l.repo_id
"""


def _raw(bed: Bed, events: DataFrame) -> DataFrame:
    """Every delivery as it is posted: first a forged copy, then the genuine one, then a replay of it."""
    kind, org = F.col("event_type"), (F.col("user_id") % 25).cast("int")
    name = F.concat(
        F.lit("Org_"), org.cast("string"), F.lit("/"), F.when(kind == "purchase", "FURNITURE").otherwise("HOUSEHOLD"), F.lit("."), (F.col("user_id") % 40).cast("string")
    )
    sent = feeds.deliveries(events, name).withColumn("source_id", (F.col("user_id") % 25).cast("int"))
    forged = F.transform_values("headers", lambda k, v: F.when(F.lower(k).contains("signature") | F.lower(k).contains("token"), F.lit("forged")).otherwise(v))
    copies = sent.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return copies.select(
        "source_id", F.col("event_id").alias("delivery_id"), (F.col("ts") + F.make_dt_interval(mins=F.col("copy"))).alias("ts"),
        F.when(F.col("copy") == 0, forged).otherwise(F.col("headers")).alias("headers"), "body",
        F.when(F.col("copy") == 0, "forged").otherwise(F.col("query_token")).alias("query_token"),
    )


def _hooks(bed: Bed) -> DataFrame:
    """The sources of the deliveries; a fifth of them takes none."""
    ids = bed.table("nation").select(F.col("n_nationkey").cast("int").alias("id"))
    return deliveries.hooks(ids.withColumn("webhook_secret", F.when(F.col("id") % 5 != 4, feeds.SECRET)))


@query("stream_deliveries", RUNS_ASKED_FOR)
def _(bed: Bed):
    asked = deliveries.runs(_raw(bed, _events(bed)), _hooks(bed), bed.view("v_source_repos"), bed.view("v_registry"))
    return drain(asked.select(F.col("delivery_id").alias("event_id"), "matched", F.coalesce("mode", F.lit("-")).alias("mode")), "deliveries")


@query("push_deliveries", RUNS_ASKED_FOR)
def _(bed: Bed):
    """The batch twin of the stream."""
    events = bed.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = deliveries.runs(_raw(bed, events), _hooks(bed), bed.view("v_source_repos"), bed.view("v_registry"))
    return asked.select(F.col("delivery_id").alias("event_id"), "matched", F.coalesce("mode", F.lit("-")).alias("mode"))


# a batch drops what lies behind the watermark that the batch before it worked with, which the batches before that had set
# three arrivals: the later half of the events, then all others on time or behind, then a third of the first once more under new ids
@query("stream_late_rows", f"""
WITH a AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 1 WHEN ts >= (SELECT median(ts) FROM events) THEN 0 ELSE 2 END AS batch, ts FROM events),
w AS (SELECT batch, count(*) AS n, epoch_ms(max(ts)) - 600000 AS mark FROM a GROUP BY 1)
SELECT a.batch, count(*) AS rows, count(*) FILTER (epoch_ms(a.ts) < (SELECT coalesce(max(w.mark), -1) FROM w WHERE w.batch < a.batch - 1)) AS late
FROM a GROUP BY 1
""")
def _(bed: Bed):
    """How many rows of each arrival came behind the watermark and were dropped."""
    events = bed.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    half = events.agg(F.median(F.unix_micros("ts")).alias("m")).first().m
    arrival = F.when(F.col("event_id") % 3 == 0, 1).when(F.unix_micros("ts") >= half, 0).otherwise(2)
    folder = scratch_path(bed.spark, "arrivals")
    for k in range(3):  # written one after the other, and read in the order of their times
        events.where(arrival == k).coalesce(1).write.mode("append").parquet(folder)
    arrivals = bed.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    _, late = drain_counted(usage_stream.first_deliveries(arrivals.withColumnRenamed("event_id", "delivery_id")), "late")
    return late


@query("stream_stuck_runs", f"""
WITH last AS (SELECT user_id AS run_id, arg_max(event_type, event_id) AS kind, max(ts) AS since FROM events GROUP BY 1)
SELECT run_id, CASE WHEN kind = 'signup' THEN 'requeue' ELSE 'fail' END AS action
FROM last WHERE kind IN ('signup', 'view') AND since + (CASE WHEN kind = 'signup' THEN INTERVAL 300 SECOND ELSE INTERVAL 1800 SECOND END) <= {END} - INTERVAL 10 MINUTE
""")
def _(bed: Bed):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "error", "failed").otherwise("success")
    changes = _events(bed).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), status.alias("status"), "ts")
    return drain(run_stream.stuck_runs(changes), "stuck", state_store=ROCKSDB).select("run_id", "action")


@query("stream_ingest", """
SELECT f.repo_id, f.file_path, concat(f.holder, '.', f.name) AS qualified_name FROM v_placed_functions f
JOIN (SELECT repo_id, file_path FROM v_functions GROUP BY 1, 2 HAVING max(p_size) >= 26) k ON k.repo_id = f.repo_id AND k.file_path = f.file_path
""")
def _(bed: Bed):
    """Files arrive in two batches: all of them first, then edits and removals."""
    folder = scratch_path(bed.spark, "arrivals")
    files = rendered(bed)
    keep = bed.view("v_functions").groupBy("repo_id", F.col("file_path").alias("path")).agg(F.max("p_size").alias("m"))
    first = files.withColumn("content", F.concat(F.lit("def draft(x):\n    return x\n"), "content")).withColumn("seq", F.lit(1))
    then = files.join(keep, ["repo_id", "path"]).select("repo_id", "path", F.when(F.col("m") >= 26, F.col("content")).alias("content"), F.lit(2).alias("seq"))
    first.write.parquet(f"{folder}/a")
    then.write.parquet(f"{folder}/b")
    root = scratch_path(bed.spark, "graph")
    for part in ("a", "b"):  # a stream of its own per arrival, as after a restart
        arrivals = bed.spark.readStream.schema(first.schema).parquet(f"{folder}/{part}")
        drain_batches(arrivals, f"ingest-{part}", lambda df, i: live.apply_batch(root, df))
    return live.read(bed.spark, root).functions.select("repo_id", "file_path", "qualified_name")


_standing: dict[tuple[str, str], str] = {}


def standing(bed: Bed) -> str:
    """Where the graph of all files is stored: ingested once per session and input folder."""
    key = (bed.spark.sparkContext.applicationId, bed.dir)
    if key not in _standing:
        root = scratch_path(bed.spark, "standing")
        live.apply_batch(root, rendered(bed).withColumn("seq", F.lit(1)))
        _standing[key] = root
    return _standing[key]


@query("stream_ingest_small", """
WITH picked AS (SELECT repo_id, file_path, row_number() OVER (ORDER BY sha1(file_path), repo_id) AS place FROM v_functions GROUP BY 1, 2),
f AS (
    SELECT p.repo_id, p.name, concat(p.holder, '.', p.name) AS qualified_name FROM v_placed_functions p
    LEFT JOIN picked k ON k.repo_id = p.repo_id AND k.file_path = p.file_path AND place <= 2 WHERE place IS NULL
    UNION ALL SELECT repo_id, 'draft', concat(replace(replace(file_path, '.py', ''), '/', '.'), '.draft') FROM picked WHERE place BETWEEN 3 AND 5),
s AS (
    SELECT DISTINCT c.repo_id, p.qualified_name AS src, c.callee_name FROM v_call_sites c
    JOIN v_found_functions p ON p.repo_id = c.repo_id AND p.node = c.caller_qname
    LEFT JOIN picked k ON k.repo_id = c.repo_id AND k.file_path = c.file_path AND place <= 2 WHERE place IS NULL
    UNION ALL SELECT repo_id, qualified_name, 'fn_1' FROM f WHERE name = 'draft')
SELECT s.repo_id, s.src, f.qualified_name AS dst FROM s JOIN f ON f.repo_id = s.repo_id AND f.name = s.callee_name
""")
def _(bed: Bed):
    """Five files change in a graph that stands: two go, three get a function more. All call edges after that."""
    root = standing(bed)
    files = rendered(bed)
    first = files.select("repo_id", "path").orderBy(F.sha1("path"), "repo_id").limit(5)
    place = F.row_number().over(Window.orderBy(F.sha1("path"), "repo_id"))  # of five rows
    draft = F.concat(F.lit("def draft(x):\n    return fn_1(x)\n"), "content")
    batch = files.join(first.withColumn("place", place), ["repo_id", "path"]).select(
        "repo_id", "path", F.when(F.col("place") > 2, draft).alias("content"), F.lit(2).alias("seq")
    )
    folder = scratch_path(bed.spark, "edits")
    batch.write.parquet(folder)
    arrivals = bed.spark.readStream.schema(batch.schema).parquet(folder)
    drain_batches(arrivals, "ingest-small", lambda df, i: live.apply_batch(root, df))
    return live.read(bed.spark, root).calls.select("repo_id", "src", "dst")
