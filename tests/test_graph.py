"""Graph rules on small graphs, and properties that hold on any."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total, split_hot_join
from graphlens.operators import architecture as arch
from graphlens.operators import dependencies, resolve, tools, traverse
from graphlens.operators.communities import both_ways, communities, connected_parts, modularity
from graphlens.operators.components import cycles
from workload import harness, views

EDGE = "repo_id string, src string, dst string, weight long"


def edges(spark, *pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b, 1) for a, b in pairs], EDGE)


def test_cycle_of_three(spark):
    assert {tuple(r) for r in cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))).collect()} == {("r", "a", x) for x in "abc"}


def test_chain_has_no_cycle(spark):
    assert cycles(edges(spark, ("a", "b"), ("b", "c"))).collect() == []


def test_cycles_are_told_apart(spark):
    # two cycles joined one way, a self loop, and the same names in another repo
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "x"), ("e", "z"))
    e = e.unionByName(edges(spark, ("b", "c"), ("c", "b"), repo="s"))
    got = {tuple(r) for r in cycles(e).collect()}
    assert got == {("r", "a", "a"), ("r", "a", "b"), ("r", "c", "c"), ("r", "c", "d"), ("r", "c", "e"), ("s", "b", "b"), ("s", "b", "c")}


def test_cycles_equal_mutual_reachability(spark):
    n = 40
    pairs = [(f"n{i:02}", f"n{(i * 7 + 3) % n:02}") for i in range(n)] + [(f"n{i:02}", f"n{(i * 5 + 1) % n:02}") for i in range(0, n, 3)]
    reach = {(a, b) for a, b in pairs if a != b}
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c} - reach
        if not more:
            break
        reach |= more
    want = set()
    for v in {a for a, _ in reach}:
        scc = {w for w in {a for a, _ in reach} if (v, w) in reach and (w, v) in reach} | {v}
        if len(scc) > 1:
            want.add(("r", min(scc), v))
    assert {tuple(r) for r in cycles(edges(spark, *pairs)).collect()} == want


def names(spark, *paths):
    m = spark.createDataFrame([("r", p, 0) for p in paths], "repo_id string, path string, cluster_id int")
    return arch.cluster_names(m).first().name


def test_cluster_names(spark):
    assert names(spark, "src/foo/a.py", "src/foo/b.py", "src/foo/c/d.py") == "src/foo"
    assert names(spark, "src/a.py", "tests/b.py") == "src/a.py"
    assert names(spark, "only.py") == "only.py"


def test_fan_limits(spark):
    many = [(f"u{i}", "hub.py") for i in range(25)] + [("busy.py", f"d{i}") for i in range(16)]
    fan = arch.file_fan(edges(spark, *many))
    assert [(r.target_id, r.severity) for r in arch.warn_fan_in(fan).collect()] == [("hub.py", "medium")]
    assert [r.target_id for r in arch.warn_fan_out(fan).collect()] == ["busy.py"]


def test_stability_and_cohesion(spark):
    metrics = spark.createDataFrame(
        [("r", 0, "core", 3, 9, 1, 0.1, 0.2), ("r", 1, "edge", 3, 1, 9, 0.9, 0.8), ("r", 2, "one", 1, 1, 1, 0.5, 0.1)],
        "repo_id string, cluster_id int, name string, file_count long, fan_in long, fan_out long, instability double, cohesion double",
    )
    c = spark.createDataFrame([("r", 0, 1, 2, 1), ("r", 1, 0, 2, 1)], "repo_id string, src int, dst int, weight long, cross_file_edges long")
    assert [r.target_id for r in arch.warn_sdp(metrics, c).collect()] == ["0->1"]
    assert [r.target_id for r in arch.warn_cohesion(metrics).collect()] == ["0"]


def test_one_edge_falls_back_to_directories(spark):
    files = spark.createDataFrame([("r", "src/a.py"), ("r", "src/b.py"), ("r", "c.py"), ("s", "x.py")], "repo_id string, path string")
    repos = spark.createDataFrame([("r",), ("s",), ("t",)], "repo_id string")
    one = edges(spark, ("src/a.py", "c.py"))
    assert {tuple(r) for r in arch.edge_source(repos, files, one).collect()} == {
        ("r", "directory_fallback"), ("s", "directory_fallback"), ("t", "no_files")
    }
    assert [(r.src, r.dst) for r in arch.chosen_edges(repos, files, one).collect()] == [("src/a.py", "src/b.py")]


def calls_of(spark, fns, sites):
    functions = spark.createDataFrame([("r", q, q.split(".")[-1], f, 1, 9) for q, f in fns], "repo_id string, qualified_name string, name string, file_path string, start_line int, end_line int")
    s = spark.createDataFrame([("r", a, b, i) for i, (a, b) in enumerate(sites)], "repo_id string, caller_qname string, callee_name string, line int")
    return functions, s


def test_start_is_reached_only_by_a_cycle(spark):
    functions, sites = calls_of(spark, [("m.f", "m.py"), ("m.g", "m.py"), ("n.h", "n.py")], [("m.f", "g"), ("m.g", "f"), ("n.h", "h"), ("n.h", "f"), ("gone", "f")])
    g = traverse.CallNames.of(sites, functions)
    at = lambda d: [r.qn for r in traverse.callers_of(g, functions, "r", "m.f", d).collect()]
    assert at(1) == ["m.g", "n.h"]
    assert at(2) == ["m.f", "m.g", "n.h"]
    assert [r.qn for r in traverse.callers_of(g, functions, "r", "n.h", 1).collect()] == ["n.h"]
    assert [r.path for r in traverse.blast_radius(g, functions, functions.select("repo_id", F.col("file_path").alias("path"), F.lit("python").alias("language")).distinct(), "r", "m.py").collect()] == ["n.py"]


def test_shared_definitions_keep_one_node(spark):
    functions, sites = calls_of(spark, [("m.f", "a.py"), ("m.f", "b.py"), ("m.g", "c.py")], [("m.g", "f"), ("m.g", "f")])
    assert [tuple(r) for r in resolve.resolve_calls(sites, functions).collect()] == [("r", "m.g", "m.f", 1)]
    assert {(r.src, r.dst) for r in resolve.file_call_edges_by_name(sites, functions).collect()} == {("c.py", "a.py"), ("c.py", "b.py")}


def test_hot_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 60).alias("k"), F.col("id").alias("b"))
    got = split_hot_join(left, right, ["k"], F.col("a"), hot_rows=100)
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_running_total_equals_window(spark):
    # one group holds most of the rows
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"), F.col("id").alias("o"), (F.col("id") % 13).alias("v"))
    got = running_total(df, ["g"], ["o"], F.col("v"), "t")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.select("g", "o", "t").exceptAll(want.select("g", "o", "t")).isEmpty() and got.count() == 2000


def test_communities(spark):
    # two cliques joined by one edge, twice, in two repos
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(5) if i < j]
    pairs = clique("a") + clique("b") + [("a0", "b0")]
    e = edges(spark, *pairs).unionByName(edges(spark, *pairs, repo="s"))
    got = {(r.repo_id, r.path): r.cluster_id for r in communities(e).collect()}
    assert len(got) == 20
    for repo in "rs":
        assert {got[repo, f"a{i}"] for i in range(5)} == {0} and {got[repo, f"b{i}"] for i in range(5)} == {1}


def test_communities_do_not_depend_on_partitions_and_raise_modularity(spark):
    pairs = [(f"n{i:02}", f"n{(i * 7 + 3) % 30:02}") for i in range(30)] + [(f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)]
    e = edges(spark, *[(a, b) for a, b in pairs if a != b])
    first = communities(e)
    again = communities(e.repartition(5))
    assert first.exceptAll(again).isEmpty()
    assert first.select("repo_id", "path").distinct().count() == first.count() == 30
    arcs = both_ways(arch.undirected_edges(e))
    found = modularity(arcs, first.select("repo_id", F.col("path").alias("node"), F.col("cluster_id").alias("label"))).first().q
    alone = modularity(arcs, first.select("repo_id", F.col("path").alias("node"), F.col("path").alias("label"))).first().q
    assert found > alone


def test_rounds_of_communities_move_numbers(spark, monkeypatch):
    import graphlens.operators.communities as module

    moved, level = [], module._one_level

    def seen(arcs, *rest):
        moved.extend(kind for name, kind in arcs.dtypes if name in ("repo_id", "src", "dst"))
        return level(arcs, *rest)

    monkeypatch.setattr(module, "_one_level", seen)
    e = edges(spark, ("b", "a"), ("é", "Z")).unionByName(edges(spark, ("a", "b"), repo="q"))
    got = {tuple(r) for r in communities(e).collect()}
    assert got == {("r", "a", 1), ("r", "b", 1), ("r", "Z", 0), ("r", "é", 0), ("q", "a", 0), ("q", "b", 0)}
    assert moved and set(moved) == {"bigint"}


def test_repos_that_fit_a_task_settle_without_jobs_per_round(spark, monkeypatch):
    """The same communities from one task per repo and from rounds over all arcs."""
    import graphlens.operators.communities as module

    rng = np.random.default_rng(8)
    ends = [(f"n{a:02}", f"n{b:02}", int(w)) for a, b, w in zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.integers(1, 9, 160), strict=True)]
    few = [("s", "é", "a", 2), ("s", "a", "a", 3), ("s", "b", "c", 1), ("t", "x", "x", 4)]
    e = spark.createDataFrame([("r", a, b if b < "n30" or a >= "n30" else a, w) for a, b, w in ends] + few, EDGE)
    rounds, run = [], module._round
    monkeypatch.setattr(module, "_round", lambda *a: rounds.append(1) or run(*a))
    got = sorted(map(tuple, communities(e).collect()))
    assert not rounds
    monkeypatch.setattr(module, "HELD_EDGES", 0)
    assert sorted(map(tuple, communities(e).collect())) == got and len(rounds) > 3
    assert len({x[2] for x in got if x[0] == "r"}) > 2


def test_quality_of_communities_moves_numbers(spark, monkeypatch):
    from workload import graph

    moved, arcs_of = [], graph.both_ways
    monkeypatch.setattr(graph, "both_ways", lambda e: moved.extend(kind for name, kind in e.dtypes if name in "ab") or arcs_of(e))
    rows = harness.QUERIES["community_quality"](spark, "/root/testdata/sf0.001").collect()
    assert moved == ["bigint", "bigint"] and rows and all(r.connected and r.as_good for r in rows)


def test_long_chains_settle(spark):
    chain = edges(spark, *[(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)])
    ring = edges(spark, *[(f"n{i:04}", f"n{(i + 1) % 40:04}") for i in range(40)], repo="s")
    assert {(r.repo_id, r.component) for r in cycles(chain.unionByName(ring)).collect()} == {("s", "n0000")}


def test_any_depth(spark):
    names = [f"m.f{i}" for i in range(9)]
    functions, sites = calls_of(spark, [(n, "m.py") for n in names], [(f"m.f{i}", f"f{i + 1}") for i in range(8)])
    g = traverse.CallNames.of(sites, functions)
    met = lambda d: [r.qn for r in traverse.callees_of(g, functions, "r", "m.f0", d).collect()]
    assert met(7) == names[1:8] and met(50) == names[1:]


def test_edges_to_what_is_gone_are_stale(spark):
    functions, sites = calls_of(spark, [("m.f", "a.py"), ("m.g", "b.py"), ("m.k", "b.py")], [("m.f", "g"), ("m.f", "gone")])
    calls = spark.createDataFrame(
        [("r", "m.f", "m.g", 1, False), ("r", "m.f", "m.gone", 1, False), ("r", "m.left", "m.g", 1, False), ("r", "m.f", "m.k", 1, False), ("r", "m.k", "m.f", 1, True), ("r", "m.k", "m.gone", 1, True)],
        "repo_id string, src string, dst string, line int, precise boolean",
    )
    assert {(r.src, r.dst) for r in resolve.stale_calls(calls, sites, functions).collect()} == {("m.f", "m.gone"), ("m.left", "m.g"), ("m.f", "m.k"), ("m.k", "m.gone")}
    kept = {(r.src, r.dst, r.precise) for r in resolve.current_calls(calls, sites, functions).collect()}
    assert kept == {("m.f", "m.g", False), ("m.k", "m.f", True)}


def test_innermost_function_on_any_spans(spark):
    """Spans that nest, overlap and coincide, against a look at all of them."""
    import random

    from graphlens.operators import resolve

    rng = random.Random(4)
    spans = []
    for k in range(400):
        first = rng.randint(0, 900)
        spans.append(("r", f"f{k % 3}.py", f"q{k:03}", first, first + rng.choice([0, 1, 3, 40, 700, -1])))
    spans.append(("r", "f0.py", "q1 twin", spans[0][3], spans[0][4]))
    lines = [("r", f"f{rng.randint(0, 3)}.py", rng.randint(0, 1700)) for _ in range(600)] + [("s", "f0.py", 5), ("r", "f0.py", None)]
    functions = spark.createDataFrame(spans, "repo_id string, file_path string, qualified_name string, start_line int, end_line int")
    definitions = spark.createDataFrame([(*x, k) for k, x in enumerate(lines)], "repo_id string, target_path string, target_line int, site int")
    got = {r.site: r.dst for r in resolve.innermost_function(definitions, functions).collect()}
    want = {}
    for k, (repo, path, line) in enumerate(lines):
        around = [(e - s, q) for r, p, q, s, e in spans if (r, p) == (repo, path) and line is not None and s <= line <= e]
        if around:
            want[k] = min(around)[1]
    assert got == want and len(want) > 300
    assert resolve.innermost_function(definitions, functions.limit(0)).collect() == []


def _shuffled(spark):
    """Rows that each stage so far has read from a shuffle."""
    sc = spark.sparkContext
    nothing = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(sc._jvm.double, 0), nothing)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleReadRecords() for k in range(stages.size())}


def test_innermost_function_in_a_generated_file(spark):
    """50,000 functions and 50,000 lines of one file meet in a number of rows that grows with both, not with their product."""
    from pyspark.sql import functions as F

    from graphlens.operators import resolve

    n = 50_000
    k = F.col("id").cast("int")
    functions = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.lit("big.py").alias("file_path"), F.concat(F.lit("f"), "id").alias("qualified_name"),
        (4 * k).alias("start_line"), (4 * k + F.when(k % 1000 == 0, 3999).otherwise(2)).alias("end_line"),
    )
    definitions = spark.range(n).select(F.lit("r").alias("repo_id"), F.lit("big.py").alias("target_path"), (4 * k + 1).alias("target_line"))
    found = resolve.innermost_function(definitions, functions)
    seen = set(_shuffled(spark))
    rows = found.where(F.col("dst") == F.concat(F.lit("f"), ((F.col("target_line") - 1) / 4).cast("int").cast("string"))).count()
    assert rows == n
    # a row per line and level, and two per function and level at most
    assert sum(v for k, v in _shuffled(spark).items() if k not in seen) < 40 * n


def _broadcast(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_stored_functions_are_not_sent_to_the_driver(spark):
    """Tables that look small on disk are many times that in memory, so the joins that meet them are sorted."""
    bed = harness.Bed(spark, "/root/testdata/sf0.001")
    definitions, functions = bed.view("v_definitions"), bed.view("v_functions")
    assert _broadcast(resolve.innermost_function(definitions, functions)) == 0
    assert _broadcast(resolve.refined_edges(definitions, functions)) == 0
    assert _broadcast(spark.sql(views.SPARK["v_call_sites"], lineitem=bed.table("lineitem"), v_functions=functions)) <= 1  # lines may meet lines


def test_named_edges_are_upgraded_as_built_ones(spark):
    functions, sites = odd_graph(spark)
    calls = spark.sql(views.SHARED["v_calls"], v_functions=functions, v_call_sites=sites)
    refined = [("r", "a.f", "b.f", 7), ("r", "a.f", "a.f", None), ("r", "x.g", "a.f", 5), ("r", "a.f", None, 3), ("s", "a.f", "z.g", 8), (None, "e.f", "e.f", 2), ("u", "a.f", "b.f", 1)]
    refined = spark.createDataFrame(refined, "repo_id string, src string, dst string, line int")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(resolve.upgrade_edges(calls, refined))
    assert rows(resolve.upgrade_edges(resolve.NamedCalls.of(sites, functions), refined)) == want
    assert sum("precise=True" in x for x in want) == 7 and sum("precise=False" in x for x in want) > 3


def test_affected_files_of_all_files_against_walks(spark):
    """Bit sets over several blocks of 512 files, with names that many share, against a walk from every file."""
    import random

    rng = random.Random(5)
    n = 1200
    functions = [("r", f"m{k:04}.py", f"m{k}.f{j}", "hot" if rng.random() < 0.01 else f"n{rng.randrange(2 * n)}", 1) for k in range(n) for j in range(2)]
    functions += [("r", "m0001.py", "m0.f0", functions[0][3], 9), ("s", "a.py", "a.f", "f", 1), ("s", "b.py", "b.g", "g", 1), ("s", "empty.py", "e.f", "h", 1)]
    sites = [("r", q, rng.choice(["hot", f"n{rng.randrange(2 * n)}", f"n{rng.randrange(60)}"]), 3) for _, _, q, _, _ in functions[: 2 * n] if rng.random() < 0.7]
    sites += [("s", "a.f", "g", 1), ("s", "b.g", "f", 2), ("s", "a.f", "f", 3), ("r", "no such caller", "hot", 1)]
    f = spark.createDataFrame(functions, "repo_id string, file_path string, qualified_name string, name string, start_line int")
    c = spark.createDataFrame(sites, "repo_id string, caller_qname string, callee_name string, line int")
    files = f.selectExpr("repo_id", "file_path as path").distinct().unionByName(spark.createDataFrame([("s", "lone.py")], "repo_id string, path string"))
    graph = traverse.CallNames.of(c, f)
    bearers, files_of, calls = {}, {}, {}
    for repo, path, q, name, _ in functions:
        bearers.setdefault((repo, name), set()).add(q)
        files_of.setdefault((repo, q), set()).add(path)
    callers = {}
    for repo, q, name, _ in sites:
        if (repo, q) in files_of:
            for g in bearers.get((repo, name), ()):
                callers.setdefault((repo, g), set()).add(q)
    for depth in (1, 3):
        want = {}
        for repo, path in {(r, p) for r, p, _, _, _ in functions} | {("s", "lone.py")}:
            at, seen = {q for r, p, q, _, _ in functions if (r, p) == (repo, path)} if depth == 1 or repo == "s" or path < "m0040" else None, set()
            if at is None:
                continue
            for _ in range(depth):
                at = set().union(*(callers.get((repo, q), set()) for q in at)) - seen
                seen |= at
            want[repo, path] = len(set().union(*(files_of[repo, q] for q in seen)) - {path})
        got = {(r.repo_id, r.path): r.affected_files for r in traverse.blast_radius_all(graph, f, files, depth).collect()}
        assert {k: got[k] for k in want} == want and len(got) == n + 4 and max(want.values()) > 10


def test_a_name_hot_on_both_sides_is_spread(spark):
    """Most callers and most bearers share one key: the join is whole, and no partition has much more than its share."""
    left = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 60)).alias("k"), F.col("id").alias("b"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        plain = sizes(left.join(right, "k"))
        got = split_hot_join(left, right, ["k"], F.col("a"), hot_rows=100, spread_right=F.col("b"))
        spread = sizes(got)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert sum(spread) == sum(plain) and max(plain) > 0.9 * sum(plain)
    assert max(spread) < 2 * sum(spread) / 8
    assert got.exceptAll(left.join(right, "k").select(got.columns)).isEmpty()
    assert split_hot_join(left.limit(0), right, ["k"], F.col("a"), spread_right=F.col("b")).isEmpty()


def _louvain(weights):
    """A sequential run: nodes in order move to the neighbouring community that gains most, then communities become nodes."""
    m2 = 2 * sum(weights.values())
    name = {n: n for e in weights for n in e}
    arcs = {}
    for (a, b), w in weights.items():
        for x, y in ((a, b), (b, a)):
            arcs.setdefault(x, {})
            arcs[x][y] = arcs[x].get(y, 0) + w
    while True:
        label = {n: n for n in arcs}
        k = {n: sum(arcs[n].values()) for n in arcs}
        tot, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for n in sorted(arcs):
                near = {}
                for x, w in arcs[n].items():
                    if x != n:
                        near[label[x]] = near.get(label[x], 0) + w
                own = label[n]
                tot[own] -= k[n]
                best = max(sorted({own, *near}), key=lambda c: (m2 * near.get(c, 0) - k[n] * tot[c], c == own))
                tot[best] += k[n]
                if best != own:
                    label[n], moved, any_move = best, True, True
        name = {n: label[c] for n, c in name.items()}
        if not any_move:
            return name
        merged = {}
        for a in arcs:
            for b, w in arcs[a].items():
                merged.setdefault(label[a], {})
                merged[label[a]][label[b]] = merged[label[a]].get(label[b], 0) + w
        arcs = merged


def test_communities_are_connected_and_near_a_sequential_run(spark):
    """Groups of files with more links inside than across: modularity at most 0.03 below that of moves one by one."""
    import random

    rng = random.Random(6)
    pairs = {}
    for _ in range(500):
        a = rng.randrange(60)
        b = (a // 12 * 12 + rng.randrange(12)) if rng.random() < 0.75 else rng.randrange(60)
        if a != b:
            key = tuple(sorted((f"n{a:03}", f"n{b:03}")))
            pairs[key] = pairs.get(key, 0) + 1
    e = spark.createDataFrame([("r", a, b, w) for (a, b), w in pairs.items()], "repo_id string, src string, dst string, weight long")
    arcs = both_ways(arch.undirected_edges(e))
    found = communities(e).select("repo_id", F.col("path").alias("node"), F.col("cluster_id").alias("label"))
    one_by_one = spark.createDataFrame([("r", n, c) for n, c in _louvain(pairs).items()], "repo_id string, node string, label string")
    ours, theirs = modularity(arcs, found).first().q, modularity(arcs, one_by_one).first().q
    assert ours > theirs - 0.03, (ours, theirs)
    assert connected_parts(arcs, found).select("label").distinct().count() == found.select("label").distinct().count()


def test_communities_fall_into_connected_parts(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("d", "e"), ("e", "x"), ("x", "a"))
    arcs = both_ways(arch.undirected_edges(e))
    labels = spark.createDataFrame([("r", n, "x" if n == "x" else "one") for n in "abcdex"], "repo_id string, node string, label string")
    got = {r.node: r.label for r in connected_parts(arcs, labels).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x"}


ODD_FUNCTIONS = [
    ("r", "a.py", "f", "a.f"), ("r", "a.py", "f", "a.f"), ("r", "b.py", "f", "b.f"), ("r", "b.py", "g", "b.f"), ("r", "c.py", "h", None), ("r", "c.py", "f", None),
    ("r", None, "g", "x.g"), ("r", "d.py", None, "d.n"), (None, "e.py", "f", "e.f"), ("s", "a.py", "f", "a.f"), ("s", "z.py", "g", "z.g"),
]
ODD_SITES = [
    ("r", "a.f", "f", 1, "a.py"), ("r", "a.f", "f", 4, "a.py"), ("r", "a.f", "g", 9, "a.py"), ("r", "x.g", "g", 2, None), ("r", None, "f", 3, "a.py"), ("r", "b.f", None, 3, "b.py"),
    (None, "e.f", "f", 1, "e.py"), ("s", "z.g", "f", 5, "z.py"), ("s", "a.f", "g", 6, "a.py"), ("r", "a.f", "h", None, "a.py"), ("r", "a.f", "none", 2, "a.py"),
]


def odd_graph(spark):
    functions = spark.createDataFrame([(*f, 1, 9) for f in ODD_FUNCTIONS], "repo_id string, file_path string, name string, qualified_name string, start_line int, end_line int")
    sites = spark.createDataFrame(ODD_SITES, "repo_id string, caller_qname string, callee_name string, line int, file_path string")
    return functions, sites


def test_stored_tables_are_those_of_their_sql(spark):
    functions, sites = odd_graph(spark)
    for name in ("v_calls", "v_definitions"):
        want, got = (spark.sql(text[name], v_functions=functions, v_call_sites=sites) for text in (views.SHARED, views.SPARK))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = spark.sql(views.SPARK["v_definitions"], v_functions=functions, v_call_sites=sites)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # names are grouped before they meet their callers


def test_tools_walk_names_as_they_walk_edges(spark):
    functions, sites = odd_graph(spark)
    files = functions.select("repo_id", F.col("file_path").alias("path"), F.lit("python").alias("language")).distinct()
    symbols = functions.select("repo_id", "file_path", "name", "qualified_name", "start_line", "end_line")
    imports = spark.createDataFrame([("r", "a.py", "b")], "repo_id string, file_path string, module string")
    edges = spark.sql(views.SHARED["v_calls"], v_functions=functions, v_call_sites=sites)
    by_name = traverse.CallNames(
        sites.select("repo_id", F.col("caller_qname").alias("caller"), F.col("callee_name").alias("name")), functions.select("repo_id", "name", F.col("qualified_name").alias("fn"))
    )
    found, n = [], functions.where("repo_id = 'r'").select("qualified_name").distinct().count()
    for calls in (edges, by_name):
        tools.register(spark, files=files, functions=functions, classes=symbols, imports=imports, calls=calls)
        asked = [f"{q}('{repo}', '{of}', {depth})" for q, of in (("callers_of", "b.f"), ("callees_of", "a.f"), ("blast_radius", "b.py"), ("downstream_dependencies", "a.py"))
                 for repo in "rs" for depth in (1, 2)]
        found.append([sorted(map(str, spark.sql(f"SELECT * FROM {a}").collect())) for a in [*asked, "repo_counts('r')", "repo_counts('s')", "repo_counts('t')"]])
    assert found[0] == found[1] and found[0][-3] == [str(spark.sql(f"SELECT {files.where('repo_id = \'r\'').count()}L AS files, {n}L AS functions, {n}L AS classes, {edges.where('repo_id = \'r\'').count()}L AS calls").first())]
    assert sum(map(len, found[0])) > 12


def test_questions_build_no_call_edges(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(harness, "_written", written)
    for name in ("callers_of", "sql_callers_of", "sql_imports_of"):
        assert harness.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert "v_calls" not in {view for _, _, view in written}


def test_counts_by_name_are_those_of_the_edges(spark):
    functions, sites = odd_graph(spark)
    more = [("r", f"m{i % 17}.py", f"n{i * 7 % 11}", f"q{i}", 1, 9) for i in range(60)]
    calls = [("r", f"q{i * 13 % 60}", f"n{i % 11}", i % 5, f"m{i * 13 % 60 % 17}.py") for i in range(0, 90, 2)]
    functions, sites = functions.unionByName(spark.createDataFrame(more, functions.schema)), sites.unionByName(spark.createDataFrame(calls, sites.schema))
    imports = spark.createDataFrame([("r", "m1.py", "m2.py", 2), ("r", "m2.py", "b.py", 1), ("r", "b.py", "x.py", 3), ("s", "z.py", "a.py", 1), ("t", "a", "b", 1), ("t", "b", "a", 5)], EDGE)
    built = arch.dependency_edges(resolve.file_call_edges_by_name(sites, functions), imports).localCheckpoint()
    members = [("r", f"m{i}.py", i % 3) for i in range(17)] + [("r", "m1.py", 2), ("r", "m1.py", 2), ("r", "b.py", None), ("s", "a.py", 0), ("s", "z.py", 1), ("t", "a", 7), ("t", "b", 7)]
    members = spark.createDataFrame(members, "repo_id string, path string, cluster_id long")
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    asked = [arch.file_fan, cycles, arch.edge_counts, lambda e: arch.cluster_edges(e, members), lambda e: arch.cluster_metrics(e, members)]
    want = [rows(ask(built)) for ask in asked]
    assert all(want)
    for chunk in (32768, 5):
        held = resolve.named_file_edges(sites, functions, imports)
        held.chunk = chunk
        assert [rows(ask(held)) for ask in asked] == want


def test_counts_build_no_file_edges(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(harness, "_written", written)
    for name in ("file_fan", "cluster_metrics", "warn_hub", "edge_source"):
        harness.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert "file_edges" not in {view for _, _, view in written}


def test_edges_from_the_grid_are_those_of_joins(spark):
    """Edges held by name, handed out cell by cell, against the joined and grouped ones."""
    functions, sites = odd_graph(spark)
    more = [("r", f"m{i % 17}.py", f"n{i * 7 % 11}", f"q{i}", 1, 9) for i in range(60)] + [("r", "m3.py", "n2", "q1", 1, 9), ("r", "m4.py", "n5", None, 1, 9)]
    calls = [("r", f"q{i * 13 % 60}", f"n{i % 11}", i % 5, f"m{i * 13 % 60 % 17}.py") for i in range(0, 90, 2)] + [("r", None, "n2", 1, "m1.py"), ("r", "lost", "n2", 1, "m1.py")]
    functions, sites = functions.unionByName(spark.createDataFrame(more, functions.schema)), sites.unionByName(spark.createDataFrame(calls, sites.schema))
    imports = spark.createDataFrame([("r", "m1.py", "m2.py", 2), ("r", "m2.py", "b.py", 1), ("r", "b.py", "x.py", 3), ("s", "z.py", "a.py", 1), ("t", "a", "b", 1), ("t", "b", "a", 5)], EDGE)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))

    edges = spark.sql(views.SHARED["v_calls"], v_functions=functions, v_call_sites=sites).localCheckpoint()
    held = resolve.NamedCalls.of(sites, functions)
    assert rows(held.edges()) == rows(edges) and edges.count() > 100
    few, left = sites.where("line < 3"), functions.where("coalesce(qualified_name, '') not in ('q7', 'q13', 'a.f')")
    for now, defined in ((few, functions), (sites, left), (few, left)):
        assert rows(resolve.stale_calls(held, now, defined)) == rows(resolve.stale_calls(edges, now, defined))
    assert rows(resolve.file_call_edges(held, functions)) == rows(resolve.file_call_edges(edges, functions))

    named = resolve.named_file_edges(sites, functions, imports)
    callers, bearers = named.callers, named.bearers
    joined = callers.join(bearers, ["repo_id", "name"]).where("src <> dst").select("repo_id", "src", "dst", (F.col("n_callers") * F.col("n_defined")).alias("weight"))
    built = joined.unionByName(imports).groupBy("repo_id", "src", "dst").agg(F.sum("weight").alias("weight")).localCheckpoint()
    repos = spark.createDataFrame([("r",), ("r-bare",), ("s",), ("t",), ("u",)], "repo_id string")
    files = spark.createDataFrame([(r, p) for r in ("r", "r-bare", "s") for p in ("a.py", "b.py", "d/c.py", "d/e.py")], "repo_id string, path string")
    asked = [arch.dependency_edges, arch.undirected_edges, lambda e: arch.chosen_edges(repos, files, e), lambda e: both_ways(arch.undirected_edges(e))]
    for chunk in (16384, 5):
        named.edge_chunk = chunk
        assert [rows(ask(named)) for ask in asked] == [rows(ask(built)) for ask in asked]


def test_edges_are_summed_a_few_files_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = ({"place": rng.integers(40, 80, 200), "key": rng.integers(0, 9, 200), "n": rng.integers(1, 5, 200)} for _ in range(2))
    given = {"place": rng.integers(30, 90, 50), "to": rng.integers(30, 90, 50), "n": rng.integers(1, 5, 50)}
    empty = {c: np.zeros(0, np.int64) for c in ("place", "key", "to", "n")}
    for pairs in (1 << 22, 64, 1):
        monkeypatch.setattr(dependencies, "PAIRS", pairs)
        for ordered in (False, True):
            for one, two, more in ((left, right, given), (left, right, empty), (empty, empty, given), (empty, right, empty)):
                want = Counter()
                for a, k, n in zip(one["place"], one["key"], one["n"], strict=True):
                    for b, m in zip(two["place"][two["key"] == k], two["n"][two["key"] == k], strict=True):
                        want[a, b] += n * m
                for a, b, n in zip(more["place"], more["to"], more["n"], strict=True):
                    want[a, b] += n
                steps = list(dependencies._sums(one, two, more, ordered))
                got = [(a, b, w) for step in steps for a, b, w in zip(*step, strict=True)]
                assert len({x[:2] for x in got}) == len(got)
                assert {x[:2]: x[2] for x in got} == {k: w for k, w in want.items() if (k[0] < k[1] if ordered else k[0] != k[1])}
                assert pairs > 64 or one is empty or len(steps) > 5


def test_edges_are_not_moved_or_stored(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(harness, "_written", written)
    for name in ("chosen_edges", "undirected_edges", "file_edges_of_calls", "stale_calls", "file_call_edges", "file_dependency_edges"):
        plan = harness.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = plan.split("FlatMapGroupsInArrow")[0] if name != "stale_calls" else ""
        assert "Exchange" not in above and ("FlatMapGroupsInArrow" in plan) == (name != "stale_calls")
    assert not {"v_calls", "file_edges"} & {view for _, _, view in written}


def test_the_grid_moves_a_value_for_a_chunk(spark):
    """Callers and bearers are moved once, then as one value for each chunk and cell."""
    files, names, n = 200, 40, 2000
    rows = lambda file, count, step: spark.range(n).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("n"), (F.col("id") * step % names).cast("string")).alias("name"),
        F.format_string("f%03d", F.col("id") % files).alias(file), F.lit(1).cast("long").alias(count),
    )
    held = dependencies.NamedEdges(rows("src", "n_callers", 7).localCheckpoint(), rows("dst", "n_defined", 3).localCheckpoint(), spark.createDataFrame([], EDGE), edge_chunk=20)
    held._places()
    for ask in (held.edges, held.undirected):
        seen = set(_shuffled(spark))
        assert ask().count() > 0
        assert sum(v for k, v in _shuffled(spark).items() if k not in seen) < 4 * n * 2


def test_the_source_of_edges_counts_two(spark, monkeypatch):
    """Whether a repo has two edges is known without counting them all."""
    calls = [("one", "n", "a"), ("fan", "n", "a"), ("self", "n", "a"), ("names", "n", "a"), ("names", "m", "a"), ("same", "n", "a"), ("same", "m", "a"), ("both", "n", "a"), ("both", "n", "b")]
    bears = [("one", "n", "b"), ("one", "n", "a"), *[("fan", "n", x) for x in "abc"], ("self", "n", "a"), ("names", "n", "b"), ("names", "m", "c"), ("same", "n", "b"), ("same", "m", "b"), ("both", "n", "a"), ("both", "n", "b")]
    imports = [("imports", "a", "b", 1), ("imports", "b", "a", 1), ("import", "a", "b", 2), ("import", "a", "a", 2), ("one", "a", "b", 3)]
    frame = lambda rows, names: spark.createDataFrame([(*r, 1) for r in rows] if len(rows[0]) == 3 else rows, names)
    held = dependencies.NamedEdges(
        frame(calls, "repo_id string, name string, src string, n_callers long"), frame(bears, "repo_id string, name string, dst string, n_defined long"), frame(imports, EDGE)
    )
    want = {r.repo_id: min(r.edges, 2) for r in arch.edge_counts(held).collect()}
    monkeypatch.setattr(dependencies.NamedEdges, "fan", None)
    assert {r.repo_id: r.n_edges for r in held.two_at_most().collect()} == want
    repos = spark.createDataFrame([(r,) for r in want], "repo_id string")
    got = {r.repo_id: r.edge_source for r in arch.edge_source(repos, spark.createDataFrame([], "repo_id string, path string"), held).collect()}
    assert {r for r, s in got.items() if s == "calls+imports"} == {"fan", "names", "both", "imports"}


def test_sets_of_files_are_united_a_few_keys_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    key, name, held, block = rng.integers(0, 30, 150), rng.integers(0, 12, 150), rng.integers(0, 12, 60), rng.integers(0, 5, 60)
    bits = rng.integers(-(1 << 63), (1 << 63) - 1, (60, traverse.LANES), dtype=np.int64)
    want = {}
    for k, n in zip(key, name, strict=True):
        for b, x in zip(block[held == n], bits[held == n], strict=True):
            want[k, b] = want.get((k, b), 0) | x
    for meetings in (1 << 19, 16):
        monkeypatch.setattr(traverse, "MEETINGS", meetings)
        steps = list(traverse._unions(key, name, held, block, bits))
        got = [((k, b), tuple(x)) for step in steps for k, b, x in zip(*step, strict=True)]
        assert len(got) == len(want) and dict(got) == {k: tuple(x) for k, x in want.items()}
        assert meetings > 16 or len(steps) > 5


def test_affected_files_in_many_cells(spark, monkeypatch):
    """The same counts whatever the parts; and no row for a file and a block of others leaves a task."""
    n = 600
    functions = spark.createDataFrame([("r", f"m{i:03}.py", f"n{i % 40}", f"q{i}", 1, 9) for i in range(n)], "repo_id string, file_path string, name string, qualified_name string, start_line int, end_line int")
    sites = spark.createDataFrame([("r", f"q{i}", f"n{i * 7 % 41}", 1, f"m{i:03}.py") for i in range(0, n, 3)], "repo_id string, caller_qname string, callee_name string, line int, file_path string")
    files, found = functions.select("repo_id", F.col("file_path").alias("path")), []
    graph = traverse.CallNames.of(sites, functions)
    for pairs, sets in ((250_000, 500_000), (50, 9)):
        monkeypatch.setattr(traverse, "PAIRS_PER_CELL", pairs)
        monkeypatch.setattr(traverse, "SETS_PER_CELL", sets)
        got = traverse.blast_radius_all(graph, functions, files)
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and max(x[2] for x in found[0]) > 20
