"""The architecture map end to end, and the stored graph over batches of files."""

import os

from graphlens.plans import architecture


def test_map_is_computed_stored_and_replaced(spark, tmp_path):
    fn = "repo_id string, file_path string, name string, qualified_name string, start_line int, end_line int"
    functions = spark.createDataFrame([("r", f"src/{x}.py", f"f_{x}", f"src.{x}.f_{x}", 1, 9) for x in "abcd"], fn)
    sites = spark.createDataFrame(
        [("r", f"src.{a}.f_{a}", f"f_{b}", 2) for a, b in ("ab", "ba", "cd", "dc", "bc")],
        "repo_id string, caller_qname string, callee_name string, line int",
    )
    files = spark.createDataFrame([("r", f"src/{x}.py") for x in "abcd"] + [("s", "lib/x.py"), ("s", "lib/y.py")], "repo_id string, path string")
    imports = spark.createDataFrame([], "repo_id string, file_path string, module string")
    repos = spark.createDataFrame([("r",), ("s",)], "repo_id string")
    found = architecture.compute(repos, files, functions, imports, sites)
    root = str(tmp_path / "map")
    found.store(root)
    found.store(root)  # storing again replaces
    stats = {r.repo_id: r for r in found.stats().collect()}
    assert stats["r"].edge_source == "calls+imports" and stats["s"].edge_source == "directory_fallback"
    assert (stats["r"].files, stats["r"].edges, stats["s"].files) == (4, 5, 2)
    warnings = spark.read.parquet(f"{root}/warnings")
    assert {(r.kind, r.target_id) for r in warnings.filter("repo_id = 'r' and kind = 'cyclic_dependency'").collect()} == {
        ("cyclic_dependency", "src/a.py"), ("cyclic_dependency", "src/c.py")
    }
    assert spark.read.parquet(f"{root}/membership").count() == 6
    assert spark.read.parquet(f"{root}/cycle_files").count() == 4


def test_a_rebuilt_repo_loses_what_it_no_longer_has(spark, tmp_path):
    from graphlens.operators.maintain import full_rebuild

    root = str(tmp_path / "t")
    of = lambda *rows: spark.createDataFrame(rows, "repo_id string, x int")
    full_rebuild(of(("r/1 a", 1), ("s", 2), ("t", 3)), root)
    full_rebuild(of(("s", 4)), root, of(("r/1 a", 0), ("s", 0)))
    assert {(r.repo_id, r.x) for r in spark.read.schema("x int, repo_id string").parquet(root).collect()} == {("s", 4), ("t", 3)}


def test_batches_survive_restarts_and_replays(spark, tmp_path):
    from graphlens.streaming.ingest import apply_batch, read

    batch = lambda *rows: spark.createDataFrame(rows, "repo_id string, path string, content string, seq int")
    one = batch(("r", "a.py", "def f():\n    return g()\n", 1), ("r", "b.py", "def g():\n    pass\n", 1), ("s", "c.py", "def h():\n    h()\n", 1))
    two = batch(("r", "b.py", "def g2():\n    pass\n", 2), ("r", "b.py", "old", 1), ("r", "d.py", "def g():\n    'doc'\n", 2))
    three = batch(("r", "a.py", None, 3))
    root = str(tmp_path / "graph")  # nothing but the folder passes from batch to batch

    def state():
        g = read(spark, root)
        return sorted(r.qualified_name for r in g.functions.collect()), sorted((r.src, r.dst) for r in g.calls.collect()), sorted(r.path for r in g.files.collect())

    apply_batch(root, one)
    assert state() == (["a.f", "b.g", "c.h"], [("a.f", "b.g"), ("c.h", "c.h")], ["a.py", "b.py", "c.py"])
    for _ in range(2):
        apply_batch(root, two)
        assert state() == (["a.f", "b.g2", "c.h", "d.g"], [("a.f", "d.g"), ("c.h", "c.h")], ["a.py", "b.py", "c.py", "d.py"])
    apply_batch(root, three)
    assert state() == (["b.g2", "c.h", "d.g"], [("c.h", "c.h")], ["b.py", "c.py", "d.py"])
    assert {r.doc for r in read(spark, root).functions.collect()} == {None, "doc"}


def _rows_by_stage(spark):
    """Rows read from and written to files by every stage that has run."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(
        sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    )
    return {stages.apply(k).stageId(): (stages.apply(k).inputRecords(), stages.apply(k).outputRecords()) for k in range(stages.size())}


def _bucket_files(root, tables):
    """Data files of the tables with what tells a rewritten one from one left alone."""
    return {
        os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns
        for t in tables for d, _, names in os.walk(f"{root}/{t}") for f in names if f.endswith(".parquet")
    }


def _sources(spark, n, edit=()):
    """Modules of three functions each; a function calls one of the next module and one that all modules have."""
    body = lambda k: (
        f"def f{k}(x):\n    return g{(k + 1) % n}(x)\n\n\ndef g{k}(x):\n    return shared(h{(k + 7) % n}(x))\n\n\ndef h{k}(x):\n    pass\n"
    )
    return [("r", f"src/m{k}.py", edit[k] if k in edit else body(k), 1) for k in range(n)]


def _edges(graph):
    return {(r.src, r.dst, r.line, r.precise) for r in graph.calls.collect()}


def test_a_small_batch_costs_what_it_changes(spark, tmp_path, monkeypatch):
    """Five of 2,000 files: only their buckets and those of their names are read and written; the result is that of a full ingest."""
    from graphlens.plans import live
    from graphlens.plans.incremental import Graph

    monkeypatch.setattr(live, "FILES_PER_BUCKET", 64)
    n, layout = 2000, "repo_id string, path string, content string, seq int"
    root, other = str(tmp_path / "live"), str(tmp_path / "full")
    before = _sources(spark, n)
    live.apply_batch(root, spark.createDataFrame(before, layout))
    files, seen = _bucket_files(root, live.STORED), _rows_by_stage(spark)
    edits = {3: "def f3(x):\n    return new(x)\n", 10: "def g9(x):\n    pass\n", 11: before[11][2] + "\n\ndef new(x):\n    return g5(x)\n", 12: None, 1500: "x = 1\n"}
    changed = [("r", f"src/m{k}.py", c, 2) for k, c in edits.items()]
    live.apply_batch(root, spark.createDataFrame(changed, layout))

    now = _bucket_files(root, live.STORED)
    buckets = lambda t, some: {f.split("/bucket=")[1].split("/")[0] for f in some if f.startswith(f"{t}/")}
    touched = {t: (len(buckets(t, set(now) - set(files))), len(buckets(t, files))) for t in live.STORED}
    assert touched["functions"][0] <= 5 < touched["functions"][1] == 32  # five files
    # names that gained or lost a bearer: g3, h3, f10, g10, h10, new, g9, three of m12, three of m1500, each called from one module
    assert touched["bearers"][0] <= 14 < touched["bearers"][1] and touched["callers"][0] <= 30 and touched["edges"][0] <= 5 + 14
    assert all(files[f] == now[f] for f in set(files) & set(now))
    rows = [v for k, v in _rows_by_stage(spark).items() if k not in seen]
    whole = 3 * n + 3 * n + 3 * n + n  # functions, call sites, edges, files
    read, written = (sum(x) for x in zip(*rows, strict=True))
    # every row is written twice, on the side first
    assert read < 2 * whole and written / 2 < 0.3 * whole, (read, written, touched)

    after = [(r, p, c, 1) for r, p, c, _ in _sources(spark, n, edits) if c is not None]
    full = Graph.of(spark.createDataFrame(after, layout).drop("seq"))
    got = live.read(spark, root)
    assert _edges(got) == _edges(full)
    for name, table in full.tables().items():
        key = [c for c in ("repo_id", "path", "file_path", "qualified_name", "sha", "module", "caller_qname", "callee_name", "line", "start_line") if c in table.columns]
        assert sorted(map(str, got.tables()[name].select(key).collect())) == sorted(map(str, table.select(key).collect()))
    live.apply_batch(other, spark.createDataFrame(after, layout))
    assert _edges(live.read(spark, other)) == _edges(full)


def test_refined_edges_stand_until_an_end_goes(spark, tmp_path):
    from graphlens.plans import live

    batch = lambda *rows: spark.createDataFrame(rows, "repo_id string, path string, content string, seq int")
    root = str(tmp_path / "live")
    live.apply_batch(root, batch(("r", "a.py", "def f():\n    alias()\n    g()\n", 1), ("r", "b.py", "def g():\n    pass\n", 1), ("r", "c.py", "def h():\n    pass\n", 1)))
    live.refine(root, spark.createDataFrame([("r", "a.f", "c.h", 2), ("r", "a.f", "b.g", 3)], "repo_id string, src string, dst string, line int"))
    assert _edges(live.read(spark, root)) == {("a.f", "c.h", 2, True), ("a.f", "b.g", 3, True)}
    live.apply_batch(root, batch(("r", "c.py", "def h():\n    g()\n", 2), ("r", "b.py", "def g2():\n    pass\n", 2)))
    assert _edges(live.read(spark, root)) == {("a.f", "c.h", 2, True)}
    live.apply_batch(root, batch(("r", "b.py", "def g():\n    pass\n", 3)))
    assert _edges(live.read(spark, root)) == {("a.f", "c.h", 2, True), ("a.f", "b.g", 3, False), ("c.h", "b.g", 2, False)}
    live.apply_batch(root, batch(("r", "a.py", None, 4)))
    assert _edges(live.read(spark, root)) == {("c.h", "b.g", 2, False)}


def test_stored_edges_grow_with_callers_not_with_pairs(spark, tmp_path):
    """Thirty callers of a name with thirty bearers are thirty rows, and nine hundred edges when read."""
    from graphlens.plans import live

    root, n = str(tmp_path / "live"), 30
    rows = [("r", f"m{k}.py", "def shared():\n    pass\n\n\ndef f():\n    shared()\n", 1) for k in range(n)]
    live.apply_batch(root, spark.createDataFrame(rows, "repo_id string, path string, content string, seq int"))
    assert live.Store(spark, root).rows("edges").count() == n
    calls = live.read(spark, root).calls
    assert calls.select("src", "dst").distinct().count() == calls.count() == n * n
    # one file gets a function more: what else it bears stays known, in whatever bucket
    live.apply_batch(root, spark.createDataFrame([(*rows[1][:2], rows[1][2] + "".join(f"\n\ndef x{k}():\n    pass\n" for k in range(8)), 2)], "repo_id string, path string, content string, seq int"))
    calls = live.read(spark, root).calls
    assert calls.select("src", "dst").distinct().count() == calls.count() == n * n
    live.refine(root, spark.createDataFrame([("r", "m1.f", "m2.shared", 9), ("r", "m1.f", "m3.f", 9)], "repo_id string, src string, dst string, line int"))
    calls = live.read(spark, root).calls
    assert calls.count() == n * n + 1 and sorted((r.dst, r.line) for r in calls.where("precise").collect()) == [("m2.shared", 9), ("m3.f", 9)]
