"""Small tables of inputs and outcomes for scalar rules, snapshots and feeds."""

import json

import pytest
from pyspark.sql import functions as F

from graphlens.functions import text, urls, webhooks
from graphlens.operators import registry, usage
from graphlens.plans.incremental import Graph, update
from graphlens.sources import definitions, feeds, notebooks, trees

# every host with one, two and three parts, folders, prefixes, schemes, case, ports, queries, slashes
URLS = [
    ("bitbucket.org/harbour-tools", "bitbucket_workspace", "harbour-tools"),
    ("HTTP://BitBucket.org/Harbour/", "bitbucket_workspace", "Harbour"),
    ("https://bitbucket.org/harbour/crane", None, None),
    ("BB:harbour", "bitbucket_workspace", "harbour"),
    ("bb:", None, None),
    ("gl:tide/pool", None, None),
    ("GL:tide", "gitlab_user", "tide"),
    ("gitlab.com/groups/sea/reef/deep/", "gitlab_group", "sea/reef/deep"),
    ("https://GitLab.com/Groups/sea", "gitlab_group", "sea"),
    ("https://gitlab.com/groups/", "gitlab_user", "groups"),
    ("gitlab.com/tide", "gitlab_user", "tide"),
    ("https://gitlab.com/tide/pool", None, None),
    ("https://gitlab.com/tide?tab=all", None, None),
    ("gh:light-house", "github_user", "light-house"),
    ("https://github.com/orgs/lamp-works/repositories?type=all", "github_org", "lamp-works"),
    ("github.com/ORGS/lamp-works?x=1", "github_org", "lamp-works"),
    ("http://github.com/users/keeper/projects", "github_user", "keeper"),
    ("github.com/keeper/", "github_user", "keeper"),
    ("github.com/keeper/lamp", None, None),
    ("github.com", None, None),
    ("https://github.com/", None, None),
    ("https://git.dock.test:8443", "gitlab_instance", "https://git.dock.test:8443"),
    ("  https://git.dock.test//  ", None, None),
    ("http://git.dock.test/groups/quay/north/?sort=name", "gitlab_group", "http://git.dock.test/groups/quay/north/?sort=name"),
    ("https://git.dock.test/groups/", None, None),
    ("git.dock.test", None, None),
    ("ftp://git.dock.test/", None, None),
    ("https://dock.test/fleet.yml", "manifest", "https://dock.test/fleet.yml"),
    ("fleet.json", "manifest", "fleet.json"),
    ("https://dock.test/fleet.JSON", None, None),
    ("https://github.com/keeper.yaml", "manifest", "https://github.com/keeper.yaml"),
    ("", None, None),
]


def test_source_kinds(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string").select("u", urls.source_kind(F.col("u")).alias("k"))
    got = {r.u: (r.k.kind, r.k.name) if r.k else (None, None) for r in df.collect()}
    assert got == {u: (k, n) for u, k, n in URLS}


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("written,seconds", [("30s", 30), ("5M", 300), (" 2h ", 7200), ("1d", 86400), ("45", 45), ("", 0), ("7x", 7)])
def test_durations(spark, written, seconds):
    assert one(spark, text.parse_duration(F.col("t")), t=written) == seconds


@pytest.mark.parametrize("raw,slug", [("Acme-My.Repo", "acme-my-repo"), ("--__", "repo"), ("A" * 80, "a" * 63), ("a b  c!", "a-b-c")])
def test_slugs(spark, raw, slug):
    assert one(spark, text.slugify(F.col("t")), t=raw) == slug


def test_hmac_against_the_standard_library(spark):
    import hashlib
    import hmac

    for key, msg in (("shhh", '{"hello": "world"}'), ("k" * 100, "x"), ("ключ", "тело"), ("a", "")):
        want = hmac.new(key.encode(), msg.encode(), hashlib.sha256).hexdigest()
        assert one(spark, webhooks.hmac_sha256(F.col("k"), F.col("m")), k=key, m=msg) == want


def test_deliveries(spark):
    rows = [
        ("a", {"X-GitHub-Event": "push"}, json.dumps({"ref": "refs/heads/main", "repository": {"full_name": "acme/foo"}}), ("acme/foo", "refs/heads/main")),
        ("b", {"X-GitHub-Event": "ping"}, "{}", None),
        ("c", {"X-Gitlab-Event": "Push Hook"}, json.dumps({"ref": "refs/heads/main", "project": {"path_with_namespace": "g/p"}}), ("g/p", "refs/heads/main")),
        ("d", {"X-Event-Key": "repo:push"}, json.dumps({"repository": {"full_name": "w/r"}, "push": {"changes": [{"new": {"name": "main"}}]}}), ("w/r", "refs/heads/main")),
        ("e", {"X-Event-Key": "repo:push"}, json.dumps({"repository": {"full_name": "w/r"}, "push": {"changes": []}}), ("w/r", None)),
        ("f", {"Content-Type": "application/json"}, "{}", None),
        ("g", {"X-GitHub-Event": "push"}, "not json", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "k string, h map<string,string>, b string")
    p = webhooks.push(webhooks.provider(F.col("h")), F.col("h"), F.col("b"))
    got = {r.k: tuple(r.p) if r.p else None for r in df.select("k", p.alias("p")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_snapshot_states(spark):
    s = "repo_id string, path string, sha string"
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "old"), ("r", "c", "3")], s)
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "new"), ("r", "d", "4")], s)
    states = lambda o, n: {r.path: r.state for r in trees.snapshot_diff(o, n).collect()}
    assert states(old, new) == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert set(states(old.limit(0), new).values()) == {"added"}
    assert set(states(old, new.limit(0)).values()) == {"removed"}


def test_incremental_equals_full(spark):
    s = "repo_id string, path string, content string"
    before = [("r", "a.py", "def f():\n    g()\n"), ("r", "b.py", "class K:\n    def f(self):\n        pass\n"), ("r", "c.py", "import os\n")]
    after = [("r", "a.py", "def f():\n    h()\n"), ("r", "b.py", before[1][2]), ("r", "d.go", 'package d\nimport "fmt"\nfunc D() {\n\tfmt.Print(1)\n}\n')]
    graph, states = update(Graph.of(spark.createDataFrame(before, s)), spark.createDataFrame(after, s))
    assert {r.path: r.state for r in states.collect()} == {"a.py": "changed", "b.py": "unchanged", "c.py": "removed", "d.go": "added"}
    full = Graph.of(spark.createDataFrame(after, s)).tables()
    for name, table in graph.tables().items():
        want = full[name].select(table.columns)
        assert table.exceptAll(want).isEmpty() and want.exceptAll(table).isEmpty(), name


def test_visibility(spark):
    repos = spark.createDataFrame(
        [(1, "open", False, False, False), (1, "private", True, False, False), (1, "fork", False, True, False), (1, "archived", False, False, True)],
        "source_id int, full_name string, private boolean, fork boolean, archived boolean",
    )
    spec = lambda p, f, a, kind="github_org": spark.createDataFrame([(1, kind, p, f, a)], "source_id int, kind string, include_private boolean, include_forks boolean, include_archived boolean")
    names = lambda s: {r.full_name for r in registry.visible(repos, s).collect()}
    assert names(spec(True, False, False)) == {"open", "private"}
    assert names(spec(False, True, True)) == {"open", "fork", "archived"}
    assert names(spec(True, False, False, "bitbucket_workspace")) == {"open", "private", "archived"}


def test_manifest_forms(spark):
    doc = json.dumps({"repos": ["https://h/g/p.git", {"id": "x", "clone_url": "https://h/solo.git", "branch": "dev"}, {"url": "https://h/a/b/c"}]})
    rows = feeds.discover_manifest(feeds.manifest_items(spark.createDataFrame([(doc,)], "body string"))).collect()
    assert {(r.external_id, r.owner, r.name, r.default_branch) for r in rows} == {
        ("https://h/g/p.git", "g", "p", "main"), ("x", "manifest", "solo", "dev"), ("https://h/a/b/c", "a/b", "c", "main")
    }


def test_definition_payloads(spark):
    span = lambda n: {"start": {"line": n, "character": 2}}
    rows = [
        ("a", json.dumps([{"uri": "file:///w/repo/src/x.py", "range": span(4)}, {"uri": "file:///usr/json.py", "range": span(0)}])),
        ("b", json.dumps([{"targetUri": "file:///w/repo/src/y.py", "targetSelectionRange": span(9)}])),
        ("c", "null"), ("d", json.dumps({"uri": "file:///w/repo/z.py"})),
    ]
    df = spark.createDataFrame([(k, "/w/repo", r) for k, r in rows], "k string, repo_root string, result string")
    got = {(r.k, r.file_path, r.line, r.character) for r in definitions.definition_locations(df).collect()}
    assert got == {("a", "src/x.py", 5, 2), ("b", "src/y.py", 10, 2)}


def test_notebook_lines(spark):
    nb = json.dumps({"metadata": {"language_info": {"name": "R"}}, "cells": [{"cell_type": "markdown", "source": "two\nlines"}, {"cell_type": "code", "source": ["x <- 1\n", "y"]}]})
    got = one(spark, notebooks.notebook_source(F.col("c")), c=nb)
    assert (got.language, got.ending, got.code) == ("r", ".R", "\n\nx <- 1\ny\n\n")


def test_empty_log(spark):
    import datetime

    log = spark.createDataFrame([], "id long, ts timestamp, token_id long, token_name string, method string, route string, status int, duration_ms int")
    now = datetime.datetime(2024, 1, 1)
    row = usage.usage_totals(log, now).first()
    assert (row.total_calls, row.error_rate_pct, row.distinct_tokens) == (0, 0.0, 0)
    assert usage.savings_total(log, F.lit(5.0)).first().tokens_saved == 0
    assert usage.top_endpoints(log, now).collect() == []


def test_scan_of_a_folder(spark, tmp_path):
    for rel in ("a.py", "node_modules/b.js", "src/c.min.js", "src/d.go"):
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text("x")
    got = trees.scan_tree(spark, str(tmp_path), "r")
    assert {r.path for r in got.collect()} == {"a.py", "src/d.go"}
    assert {(r.path, r.size_bytes) for r in trees.fingerprint(got).collect()} == {("a.py", 1), ("src/d.go", 1)}


def test_pads_are_made_once_per_secret(spark):
    import hashlib
    import hmac

    from graphlens.functions import webhooks

    secrets = ["s", "k" * 64, "long " * 30, "é漢"]
    rows = [(k, secrets[k % 4], f"body {k} é") for k in range(40)] + [(40, "", "x"), (41, None, "x")]
    sent = spark.createDataFrame(rows, "id int, secret string, body string")
    padded = webhooks.padded_secrets(sent)
    assert padded.count() == len(secrets)
    got = {r.id: r.h for r in sent.join(padded, "secret", "left").select("id", webhooks.hmac_with(F.col("pads"), F.col("body")).alias("h")).collect()}
    assert got == {k: hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() if s else None for k, s, b in rows}


def test_deliveries_count_once_and_only_with_proof(spark):
    import hashlib
    import hmac
    import json

    from graphlens.streaming import deliveries

    body = json.dumps({"ref": "refs/heads/x", "repository": {"full_name": "o/r"}})
    sign = lambda key: "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    head = lambda key: {"X-GitHub-Event": "push", "X-Hub-Signature-256": sign(key)}
    at = "2024-01-01 00:0"
    sent = [
        (1, "a", at + "0:00", head("wrong"), body, None), (1, "a", at + "1:00", head("one"), body, None), (1, "a", at + "2:00", head("one"), body, None),
        (2, "a", at + "0:00", head("two"), body, None), (2, "b", at + "0:00", head("one"), body, None), (3, "a", at + "0:00", head(""), body, None),
        (9, "a", at + "0:00", head("one"), body, None), (1, "c", at + "0:00", head("one") | {"X-GitHub-Event": "ping"}, body, None), (1, "d", at + "0:00", {}, None, None),
    ]
    raw = spark.createDataFrame(sent, "source_id int, delivery_id string, ts string, headers map<string,string>, body string, query_token string").withColumn("ts", F.to_timestamp("ts"))
    known = deliveries.hooks(spark.createDataFrame([(1, "one"), (2, "two"), (3, ""), (4, None)], "id int, webhook_secret string"))
    links = spark.createDataFrame([(1, "o/r", "repo-1")], "source_id int, full_name string, repo_id string")
    repos = spark.createDataFrame([("repo-1", None)], "id string, last_indexed_at timestamp")
    rows = {(r.source_id, r.delivery_id): (r.full_name, r.ref, r.repo_id, r.matched, r.mode, r.ts.minute) for r in deliveries.runs(raw, known, links, repos).collect()}
    assert rows == {(1, "a"): ("o/r", "refs/heads/x", "repo-1", True, "full", 1), (2, "a"): ("o/r", "refs/heads/x", None, False, None, 0)}


def test_pages_follow_the_last_key(spark, tmp_path):
    """All pages in a row are the whole list, in mixed directions, with nulls and ties; the bound reaches the scan."""
    import itertools

    from graphlens.operators.runs import Key, last_key, page_after

    values = [None, 1, 1, 2, 5, None, 5, 3, 2, 2, None]
    rows = [(x, y, k) for k, (x, y) in enumerate(zip(values, values[3:] + values[:3], strict=True))]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "x int, y int, id int").write.parquet(path)
    df = spark.read.parquet(path)
    for dx, nx, dy, ny in itertools.product((False, True), repeat=4):
        keys = [Key("x", dx, nx), Key("y", dy, ny), Key("id")]
        want = [r.id for r in df.orderBy(*[k.order() for k in keys]).collect()]
        got, after = [], None
        for _ in range(10):
            page = page_after(df, keys, after, 4)
            got += [r.id for r in page.collect()]
            after = last_key(page, keys)
            if after is None:
                break
        assert got == want, (keys, got, want)
    explained = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    plan = explained(page_after(df, [Key("x"), Key("id")], (2, 3), 4)._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(x,2)" in plan and "Offset" not in plan
