"""Questions about the call graph: callers, callees, affected files, degrees.

The graph is held as two tables (`CallNames`): which names a function calls,
and which functions bear a name. One hop crosses both, and what is remembered
between hops are names, so each name is opened once per start whatever the
number of paths to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.modules import short_name
from graphlens.functions.skew import running_total
from graphlens.operators.resolve import named_functions, written_calls
from graphlens.session import cut, forget


@dataclass
class CallNames:
    calls: DataFrame  # repo_id, caller, name
    names: DataFrame  # repo_id, name, fn

    @classmethod
    def of(cls, sites: DataFrame, functions: DataFrame) -> CallNames:
        """Both tables, stored once for all hops.

        They are not laid out by name: a name with most of the calls would make
        one partition of them, and a join that finds its input in place cannot
        be split by the adaptive planner.
        """
        calls = written_calls(sites, functions).select("repo_id", "caller", "name")
        return cls(cut(calls), cut(named_functions(functions)))

    def within(self, repo_id: str) -> CallNames:
        """One repo's part, so that no hop of a question about it reads another's."""
        mine = F.col("repo_id") == repo_id
        return CallNames(self.calls.filter(mine), self.names.filter(mine))


def _sides(graph: CallNames, upward: bool) -> tuple[DataFrame, DataFrame]:
    """How a hop enters a name from a function, and how it leaves to the next one."""
    if upward:
        return graph.names.withColumnRenamed("fn", "at"), graph.calls.withColumnRenamed("caller", "to")
    return graph.calls.withColumnRenamed("caller", "at"), graph.names.withColumnRenamed("fn", "to")


def opened_names(graph: CallNames, seeds: DataFrame, depth: int, upward: bool) -> DataFrame:
    """Names crossed within `depth` hops of each start: (repo_id, start, name, hops).

    `seeds` holds (repo_id, start, fn). A name is kept with its first hop only. Any
    depth may be asked for; hops end when none leads to a name not yet opened.
    """
    if depth < 1:
        raise ValueError("depth starts at 1")
    enter, leave = _sides(graph, upward)
    frontier = seeds.select("repo_id", "start", F.col("fn").alias("at"))
    opened: list[DataFrame] = []
    for hop in range(1, depth + 1):
        names = frontier.join(enter, ["repo_id", "at"]).select("repo_id", "start", "name").distinct()
        for earlier in opened:
            names = names.join(earlier, ["repo_id", "start", "name"], "left_anti")
        if hop < depth:
            names = cut(names)
            if names.isEmpty():
                break
            frontier = (
                names.join(leave, ["repo_id", "name"]).select("repo_id", "start", F.col("to").alias("at")).distinct()
            )
        opened.append(names)
    if not opened:
        return names.withColumn("hops", F.lit(1))
    out = opened[0].withColumn("hops", F.lit(1))
    for i, names in enumerate(opened[1:], 2):
        out = out.unionByName(names.withColumn("hops", F.lit(i)))
    return out


def reach(graph: CallNames, seeds: DataFrame, depth: int, upward: bool) -> DataFrame:
    """Functions met within `depth` hops of each start: (repo_id, start, fn, hops).

    A start's own functions are in the answer only when a cycle leads back to
    them.
    """
    _enter, leave = _sides(graph, upward)
    return (
        opened_names(graph, seeds, depth, upward)
        .join(leave, ["repo_id", "name"])
        .groupBy("repo_id", "start", F.col("to").alias("fn"))
        .agg(F.min("hops").alias("hops"))
    )


def _neighbours(
    graph: CallNames, functions: DataFrame, repo_id: str, qualified_name: str, depth: int, limit: int, upward: bool
) -> DataFrame:
    graph = graph.within(repo_id)
    at = functions.filter((F.col("repo_id") == repo_id) & (F.col("qualified_name") == qualified_name))
    seeds = at.select("repo_id", F.col("qualified_name").alias("start"), F.col("qualified_name").alias("fn")).distinct()
    met = reach(graph, seeds, depth, upward)
    where = functions.filter(F.col("repo_id") == repo_id).select(
        "repo_id", F.col("qualified_name").alias("fn"), F.col("file_path").alias("path"), F.col("start_line").alias("line")
    )
    return (
        met.join(where, ["repo_id", "fn"])
        .select(F.col("fn").alias("qn"), "path", "line")
        .orderBy("qn", "path", "line")
        .limit(limit)
    )


def callers_of(graph, functions, repo_id, qualified_name, depth=1, limit=100) -> DataFrame:
    """Functions that lead to the given one through at most `depth` calls."""
    return _neighbours(graph, functions, repo_id, qualified_name, depth, limit, upward=True)


def callees_of(graph, functions, repo_id, qualified_name, depth=1, limit=100) -> DataFrame:
    """Functions the given one leads to through at most `depth` calls."""
    return _neighbours(graph, functions, repo_id, qualified_name, depth, limit, upward=False)


def _file_pairs(graph: CallNames, functions: DataFrame, starts: DataFrame, depth: int, upward: bool) -> DataFrame:
    owner = functions.select("repo_id", F.col("qualified_name").alias("fn"), F.col("file_path").alias("path")).distinct()
    seeds = starts.select("repo_id", F.col("path").alias("start")).join(
        owner.withColumnRenamed("path", "start"), ["repo_id", "start"]
    )
    # a name leads to few files through many functions: go to the files at once
    _enter, leave = _sides(graph, upward)
    files_of = leave.join(owner.withColumnRenamed("fn", "to"), ["repo_id", "to"]).select("repo_id", "name", "path").distinct()
    return (
        opened_names(graph, seeds, depth, upward)
        .join(files_of, ["repo_id", "name"])
        .filter(F.col("path") != F.col("start"))
        .select("repo_id", "start", "path")
        .distinct()
    )


def _affected(graph, functions, files, repo_id, path, depth, limit, upward) -> DataFrame:
    mine = F.col("repo_id") == repo_id
    graph, functions, files = graph.within(repo_id), functions.filter(mine), files.filter(mine)
    start = files.filter(F.col("path") == path)
    return (
        _file_pairs(graph, functions, start, depth, upward)
        .join(files.select("repo_id", "path", "language"), ["repo_id", "path"])
        .select("path", "language")
        .orderBy("path")
        .limit(limit)
    )


def blast_radius(graph, functions, files, repo_id, path, depth=2, limit=500) -> DataFrame:
    """Files whose functions call into the given file, directly or not."""
    return _affected(graph, functions, files, repo_id, path, depth, limit, upward=True)


def downstream_dependencies(graph, functions, files, repo_id, path, depth=2, limit=500) -> DataFrame:
    """Files the functions of the given file call into, directly or not."""
    return _affected(graph, functions, files, repo_id, path, depth, limit, upward=False)


LANES = 8
WORD = 64
BITS = [f"b{k}" for k in range(LANES)]


def _united(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sets of files (eight longs for 512 of them a row), put together per key and block."""
    return rows.groupBy(*keys, "block").agg(*[F.bit_or(b).alias(b) for b in BITS])


def _as_bits(ordinal: str) -> list[Column]:
    """A file's place among the files of its repo: number of the block, and the longs with its bit."""
    bit = F.expr(f"shiftleft(1L, cast({ordinal} % {WORD} as int))")
    lane = F.expr(f"cast(({ordinal} div {WORD}) % {LANES} as int)")
    return [F.expr(f"{ordinal} div {WORD * LANES}").alias("block"), *[F.when(lane == k, bit).otherwise(F.lit(0).cast("long")).alias(b) for k, b in enumerate(BITS)]]


PAIRS_PER_CELL = 250_000
SETS_PER_CELL = 500_000
MEETINGS = 1 << 19


def _unions(key: np.ndarray, name: np.ndarray, held: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, block, set) of the sets of all names of a key put together, some keys at a time and each of them whole."""
    by_name, by_key = np.argsort(held, kind="stable"), np.argsort(key, kind="stable")
    held, block, bits, key, name = held[by_name], block[by_name], bits[by_name], key[by_key], name[by_key]
    first, last = (np.searchsorted(held, name, side) for side in ("left", "right"))
    met = np.concatenate([[0], np.cumsum(last - first)])
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    step, width = met[begin] // MEETINGS, int(block.max(initial=0)) + 1
    for k in np.unique(step):
        lo, hi = np.searchsorted(step, [k, k + 1])
        r = np.arange(begin[lo], begin[hi] if hi < len(begin) else len(key))
        row = np.repeat(r, last[r] - first[r])
        at = np.arange(len(row)) - np.repeat(met[r] - met[r[0]], last[r] - first[r]) + first[row]
        code = key[row] * width + block[at]
        if len(code):
            order = np.argsort(code, kind="stable")
            code = code[order]
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            yield code[new] // width, code[new] % width, np.bitwise_or.reduceat(bits[at[order]], new, axis=0)


def _cell_of_sets(cell: pa.Table) -> tuple[pa.Array, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The keys of a cell, their places among the files (-1: none), and the sets put together by key."""
    cell = cell.combine_chunks()
    is_pair = cell["kind"].to_numpy() == 0
    pairs, sets = cell.filter(pa.array(is_pair)), cell.filter(pa.array(~is_pair))
    name = cell["name"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pairs["key"].combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ordinal = np.full(len(keys.dictionary), -1, np.int64)
    ordinal[code] = pairs["ordinal"].to_numpy()
    bits = np.stack([sets[b].to_numpy() for b in BITS], axis=1)
    return keys.dictionary, ordinal, _unions(code, name[is_pair], name[~is_pair], sets["block"].to_numpy(), bits)


def _carry(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, _, unions = _cell_of_sets(pa.Table.from_batches(list(batches)))
    for name, block, bits in unions:
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(key[0], len(name)), names.take(pa.array(name)), pa.array(block), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LANES)]], names=["repo_id", "name", "block", *BITS]
        )


def _count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, ordinal, unions = _cell_of_sets(pa.Table.from_batches(list(batches)))
    met = np.zeros(len(paths), np.int64)
    for path, block, bits in unions:
        np.add.at(met, path, np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64))
        own = np.flatnonzero(ordinal[path] // (WORD * LANES) == block)
        place = ordinal[path[own]]
        met[path[own]] -= (bits[own, place // WORD % LANES] >> (place % WORD)) & 1
    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(paths)), paths, pa.array(met)], names=["repo_id", "path", "met"])


def _cells_of_sets(pairs: DataFrame, sets: DataFrame):
    """Pairs (repo_id, key, name, ordinal) and sets (repo_id, name, block, bits) in cells: every part of a repo's keys meets every part of its blocks."""
    pairs, sets = pairs.where("name is not null and key is not null"), sets.where("name is not null")
    part = lambda df, most, name: df.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = cut(part(pairs, PAIRS_PER_CELL, "_is").join(part(sets, SETS_PER_CELL, "_js"), "repo_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("long")
    dealt = pairs.join(parts, "repo_id").select(
        "repo_id", F.pmod(F.xxhash64("key"), F.col("_is")).cast("int").alias("i"), every("_js").alias("j"), F.lit(0).alias("kind"), "key", "name", "ordinal", none.alias("block"), *[none.alias(b) for b in BITS]
    ).unionByName(sets.join(parts, "repo_id").select(
        "repo_id", every("_is").alias("i"), F.pmod("block", "_js").cast("int").alias("j"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("key"), "name", none.alias("ordinal"), "block", *BITS
    ))
    return dealt.groupBy("repo_id", "i", "j")


def blast_radius_all(graph: CallNames, functions: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """Number of affected files for every file at once.

    What leads to a name is a set of files, held as bits over their places in the
    repo, 512 to a row. A hop takes the sets of the names that callers bear to the
    names they call and unites them there; the sets of the names of a file are
    united and counted. Both happen within cells, where a part of a repo's names or files
    meets a part of its blocks: what is moved are names and sets, once per part of the
    other side, and neither (file, file) pairs nor the sets of single files leave a task.
    """
    if depth < 1:
        raise ValueError("depth starts at 1")
    owner = functions.select("repo_id", F.col("qualified_name").alias("fn"), F.col("file_path").alias("path")).distinct()
    places = cut(running_total(owner.select("repo_id", "path").distinct(), ["repo_id"], ["path"], F.lit(1).cast("long"), "ordinal").select("repo_id", "path", "ordinal"))
    bits = places.select("repo_id", "path", *_as_bits("ordinal"))
    named = ["repo_id", "name"]
    leads = cut(_united(
        graph.calls.join(owner.withColumnRenamed("fn", "caller"), ["repo_id", "caller"]).select(*named, "path").distinct().join(bits, ["repo_id", "path"]), named
    ))
    if depth > 1:
        # what a caller calls, by the names that it bears itself; what has led to a name still does
        passes = graph.calls.withColumnRenamed("name", "key").join(graph.names.withColumnRenamed("fn", "caller"), ["repo_id", "caller"]).select("repo_id", "key", "name")
        passes = cut(passes.unionByName(leads.select("repo_id", F.col("name").alias("key"), "name")).distinct().withColumn("ordinal", F.lit(-1).cast("long")))
    for _ in range(depth - 1):
        step = cut(_cells_of_sets(passes, leads).applyInArrow(_carry, f"repo_id string, name string, block long, {', '.join(f'{b} long' for b in BITS)}"))
        forget(leads)
        leads = step
    borne = cut(owner.join(graph.names, ["repo_id", "fn"]).select("repo_id", "path", "name").distinct().join(places, ["repo_id", "path"]).select("repo_id", F.col("path").alias("key"), "name", "ordinal"))
    met = _cells_of_sets(borne, leads).applyInArrow(_count, "repo_id string, path string, met long")
    counts = met.groupBy("repo_id", "path").agg(F.sum("met").alias("affected_files"))
    return (
        files.select("repo_id", "path")
        .join(counts, ["repo_id", "path"], "left")
        .select("repo_id", "path", F.coalesce("affected_files", F.lit(0).cast("long")).alias("affected_files"))
    )


def imports_of(imports: DataFrame, repo_id: str, path: str, limit: int = 200) -> DataFrame:
    return (
        imports.filter((F.col("repo_id") == repo_id) & (F.col("file_path") == path))
        .select(F.col("module").alias("name"), F.lit("Module").alias("label"))
        .distinct()
        .orderBy("name")
        .limit(limit)
    )


def file_symbols(files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Overview of files, one row per symbol; a file without any keeps one row.

    Classes and functions are stacked, never multiplied with each other, and a
    file with very many symbols stays spread over rows.
    """
    cols = ["repo_id", F.col("file_path").alias("path"), "name", "qualified_name", "start_line", "end_line"]
    symbols = (
        classes.select(F.lit("class").alias("kind"), *cols, F.lit(None).cast("boolean").alias("is_async"))
        .unionByName(functions.select(F.lit("function").alias("kind"), *cols, "is_async"))
        .distinct()
    )
    return files.select("repo_id", "path", "language", "size_bytes").join(symbols, ["repo_id", "path"], "left")


def file_overview(files: DataFrame, classes: DataFrame, functions: DataFrame, repo_id: str, path: str) -> DataFrame:
    """One file with its classes and functions nested."""
    here = lambda df, col: df.filter((F.col("repo_id") == repo_id) & (F.col(col) == path))
    rows = file_symbols(here(files, "path"), here(classes, "file_path"), here(functions, "file_path"))
    symbol = F.struct("name", "qualified_name", "start_line", "end_line", "is_async")
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, symbol)))
    return rows.groupBy("repo_id", "path", "language", "size_bytes").agg(
        pick("class").alias("classes"), pick("function").alias("functions")
    )


def degrees(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct callers and callees per function, counted without pairing them.

    All bearers of a name share its callers; a caller's callees are the sum of
    the bearers of the names it writes.
    """
    calls = written_calls(sites, functions)
    names = named_functions(functions)
    per_name = (
        calls.select("repo_id", "name", F.lit(1).alias("c"), F.lit(0).alias("d"))
        .unionByName(names.select("repo_id", "name", F.lit(0).alias("c"), F.lit(1).alias("d")))
        .groupBy("repo_id", "name")
        .agg(F.sum("c").alias("callers"), F.sum("d").alias("bearers"))
    )
    zero = F.lit(0).cast("bigint")
    incoming = names.join(per_name, ["repo_id", "name"]).select("repo_id", "fn", "callers", zero.alias("callees"))
    outgoing = calls.join(per_name, ["repo_id", "name"]).select(
        "repo_id", F.col("caller").alias("fn"), zero.alias("callers"), F.col("bearers").alias("callees")
    )
    return (
        incoming.unionByName(outgoing)
        .groupBy("repo_id", "fn")
        .agg(F.sum("callers").alias("callers"), F.sum("callees").alias("callees"))
    )


def entry_points(sites: DataFrame, functions: DataFrame, repo_id: str | None = None, limit: int = 20) -> DataFrame:
    """The best connected functions: callers plus callees, most first."""
    if repo_id is not None:
        sites = sites.filter(F.col("repo_id") == repo_id)
        functions = functions.filter(F.col("repo_id") == repo_id)
    where = functions.groupBy("repo_id", F.col("qualified_name").alias("fn")).agg(
        F.max(F.struct("file_path", "start_line")).alias("at")
    )
    return (
        degrees(sites, functions)
        .withColumn("total", F.col("callers") + F.col("callees"))
        .filter(F.col("total") > 0)
        .join(where, ["repo_id", "fn"])
        .select(
            "repo_id", F.col("fn").alias("qn"), F.col("at.file_path").alias("path"),
            F.col("at.start_line").alias("line"), "callers", "callees", "total",
        )
        .orderBy(F.col("total").desc(), "qn", "repo_id")
        .limit(limit)
    )


def graph_stats(repos, files, classes, functions, imports, sites) -> DataFrame:
    """Node, edge, repo and file counts over the whole graph; call edges are
    counted as callees per caller, without building them."""
    from graphlens.operators.resolve import defines_edges, has_method_edges

    def part(df: DataFrame, nodes: int, edges: int, **more: int) -> DataFrame:
        n = F.count(F.lit(1))
        cols = {"nodes": nodes, "edges": edges, "repos": more.get("repos", 0), "files": more.get("files", 0)}
        return df.agg(*[(n * k).alias(c) for c, k in cols.items()])

    keyed = lambda df, *cols: df.select(*cols).distinct()
    calls = degrees(sites, functions).agg(
        F.lit(0).cast("bigint").alias("nodes"), F.sum("callees").alias("edges"),
        F.lit(0).cast("bigint").alias("repos"), F.lit(0).cast("bigint").alias("files"),
    )
    owned_sites = sites.join(
        functions.select("repo_id", F.col("qualified_name").alias("caller_qname")).distinct(),
        ["repo_id", "caller_qname"], "left_semi",
    )
    parts = [
        part(repos, 1, 0, repos=1),
        part(keyed(files, "repo_id", "path"), 1, 1, files=1),  # the file and its place in the repo
        part(keyed(classes, "repo_id", "qualified_name"), 1, 0),
        part(keyed(functions, "repo_id", "qualified_name"), 1, 0),
        part(keyed(imports, "repo_id", "module"), 1, 0),
        part(keyed(imports, "repo_id", "file_path", "module"), 0, 1),
        part(keyed(owned_sites, "repo_id", "caller_qname", "callee_name", "line"), 1, 1),  # the site and its owner
        part(defines_edges(classes, files), 0, 1),
        part(defines_edges(functions, files), 0, 1),
        part(has_method_edges(functions, classes), 0, 1),
        calls,
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "edges", "repos", "files")])


def ego_network(graph: CallNames, functions: DataFrame, repo_id: str, qualified_name: str, limit: int = 100) -> DataFrame:
    """Nodes and links around one function, as rows (part, a, b, label)."""
    up = callers_of(graph, functions, repo_id, qualified_name, 1, limit).select("qn", F.lit(True).alias("up"))
    down = callees_of(graph, functions, repo_id, qualified_name, 1, limit).select("qn", F.lit(False).alias("up"))
    around = up.unionByName(down)
    me = F.lit(qualified_name)
    links = around.distinct().select(
        F.lit("link").alias("part"),
        F.when(F.col("up"), F.col("qn")).otherwise(me).alias("a"),
        F.when(F.col("up"), me).otherwise(F.col("qn")).alias("b"),
        F.lit("").alias("label"),
    )
    nodes = (
        around.select("qn")
        .unionByName(functions.sparkSession.range(1).select(me.alias("qn")))
        .distinct()
        .select(
            F.lit("node").alias("part"),
            F.col("qn").alias("a"),
            F.when(F.col("qn") == me, "self").otherwise("fn").alias("b"),
            short_name(F.col("qn")).alias("label"),
        )
    )
    return nodes.unionByName(links)
