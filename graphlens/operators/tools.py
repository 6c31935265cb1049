"""The questions of the agent tools as SQL table functions over the tables of a code graph.

    register(spark, files=..., functions=..., classes=..., imports=..., calls=...)
    spark.sql("SELECT * FROM callers_of('my-repo', 'src.a.f', 2) ORDER BY qn LIMIT 100")

Each is a SQL function of the session, so Catalyst sees one plan and the repo's name
reaches every scan. Walks are up to four calls deep, as the tools allow; a hop goes from
functions to names and on to functions and keeps both distinct, so call edges need not
be built: `calls` are edges (repo_id, src, dst) or `CallNames`. Keyword and vector search need the stored indexes and stay
functions on `KeywordIndex` and `VectorIndex`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.traverse import CallNames

DEEPEST = 4
TABLES = ("files", "functions", "classes", "imports", "calls")


def _hops(start: str, near: str, far: str) -> str:
    """CTEs h1..h4: the functions reached by a walk of one to four calls against (or along) the arrows."""
    side = {"src": ("code_written", "caller"), "dst": ("code_bearers", "fn")}
    (enter, at), (leave, to) = side[near], side[far]
    steps = []
    for k in range(1, DEEPEST + 1):
        before = f"({start})" if k == 1 else f"h{k - 1}"
        steps.append(f"n{k} AS (SELECT DISTINCT e.name FROM {enter} e JOIN {before} s ON e.{at} = s.fn WHERE e.repo_id = repo AND depth >= {k})")
        steps.append(f"h{k} AS (SELECT DISTINCT l.{to} AS fn FROM {leave} l JOIN n{k} n ON l.name = n.name WHERE l.repo_id = repo)")
    union = " UNION ".join(f"SELECT fn FROM h{k}" for k in range(1, DEEPEST + 1))
    return ", ".join(steps) + f", met AS ({union})"


def _neighbours(near: str, far: str) -> str:
    start = "SELECT qualified_name AS fn FROM code_functions WHERE repo_id = repo AND qualified_name = of GROUP BY qualified_name"
    return f"""WITH {_hops(start, near, far)}
SELECT DISTINCT f.qualified_name, f.file_path, f.start_line FROM code_functions f JOIN met ON f.qualified_name = met.fn WHERE f.repo_id = repo"""


def _files_met(near: str, far: str) -> str:
    start = "SELECT DISTINCT qualified_name AS fn FROM code_functions WHERE repo_id = repo AND file_path = of"
    return f"""WITH {_hops(start, near, far)}
SELECT DISTINCT p.path, p.language FROM code_functions f JOIN met ON f.qualified_name = met.fn
JOIN code_files p ON p.repo_id = repo AND p.path = f.file_path WHERE f.repo_id = repo AND f.file_path <> of"""


WALK = "repo STRING, of STRING, depth INT DEFAULT 2"
FOUND = "qn STRING, path STRING, line INT"
FUNCTIONS = {
    "callers_of": (WALK, FOUND, _neighbours("dst", "src")),
    "callees_of": (WALK, FOUND, _neighbours("src", "dst")),
    "blast_radius": (WALK, "path STRING, language STRING", _files_met("dst", "src")),
    "downstream_dependencies": (WALK, "path STRING, language STRING", _files_met("src", "dst")),
    "imports_of": ("repo STRING, of STRING", "name STRING, label STRING", "SELECT DISTINCT module, 'Module' FROM code_imports WHERE repo_id = repo AND file_path = of"),
    "file_overview": (
        "repo STRING, of STRING", "kind STRING, name STRING, qualified_name STRING, start_line INT, end_line INT",
        """SELECT DISTINCT 'class', name, qualified_name, start_line, end_line FROM code_classes WHERE repo_id = repo AND file_path = of
UNION ALL SELECT DISTINCT 'function', name, qualified_name, start_line, end_line FROM code_functions WHERE repo_id = repo AND file_path = of""",
    ),
    "repo_counts": (
        "repo STRING", "files BIGINT, functions BIGINT, classes BIGINT, calls BIGINT",
        """WITH kinds AS (
  SELECT 1 AS kind FROM code_files WHERE repo_id = repo
  UNION ALL SELECT 2 FROM (SELECT DISTINCT qualified_name FROM code_functions WHERE repo_id = repo)
  UNION ALL SELECT 3 FROM (SELECT DISTINCT qualified_name FROM code_classes WHERE repo_id = repo)),
written AS (SELECT DISTINCT caller, name FROM code_written WHERE repo_id = repo AND name IS NOT NULL),
bearers AS (SELECT fn, name, count(*) OVER (PARTITION BY fn) AS names FROM (SELECT DISTINCT fn, name FROM code_bearers WHERE repo_id = repo AND name IS NOT NULL)),
edges AS (  -- those to functions of one name are counted per name, the others one by one
  SELECT b.n * w.n AS n FROM (SELECT name, count(*) AS n FROM bearers WHERE names = 1 GROUP BY name) b
  JOIN (SELECT name, count(*) AS n FROM written GROUP BY name) w ON b.name = w.name
  UNION ALL SELECT count(*) FROM (SELECT DISTINCT caller, fn FROM bearers b JOIN written w ON b.name = w.name WHERE names > 1))
SELECT count_if(kind = 1), count_if(kind = 2), count_if(kind = 3), (SELECT coalesce(sum(n), 0) FROM edges) FROM kinds""",
    ),
}


def register(spark: SparkSession, **tables: DataFrame | CallNames) -> None:
    """Make the tables known as `code_<name>` and the functions above known to the session's SQL.

    Calls are known as `code_calls` too, and as who writes a name and who bears it;
    an edge given as such stands for a name of its target alone.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"tables are {', '.join(TABLES)}")
    calls = tables["calls"]
    if isinstance(calls, CallNames):
        written, bearers = calls.calls, calls.names
        calls = written.join(bearers, ["repo_id", "name"]).select("repo_id", F.col("caller").alias("src"), F.col("fn").alias("dst")).distinct()
    else:
        own = F.coalesce(F.concat(F.lit("="), "dst"), F.lit("-")).alias("name")
        written = calls.select("repo_id", F.col("src").alias("caller"), own)
        bearers = calls.select("repo_id", own, F.col("dst").alias("fn"))
    for name, table in {**tables, "calls": calls, "written": written, "bearers": bearers}.items():
        table.createOrReplaceTempView(f"code_{name}")
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({gives}) RETURN {body}")
