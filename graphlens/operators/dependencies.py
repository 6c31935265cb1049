"""File dependencies held by name: counts over all edges between files without storing the edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total
from graphlens.session import cut

CHUNK = 32768
TOGETHER = 128
PAIRS = 1 << 22
EDGE_CHUNK = 16384
BATCH = 1 << 18
DENSE, EXACT = 2, 1 << 53
MOST = 4096

FILE, NAME = "0", "1"


class Sums:
    """Whole numbers summed by code; few distinct codes are kept, however many are added."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, codes: np.ndarray, *values: np.ndarray) -> None:
        if len(codes):
            self.parts.append(pd.DataFrame({"code": codes, **dict(enumerate(values))}).groupby("code", sort=False).sum())
            self.held += len(self.parts[-1])
        if self.held > PAIRS:
            self.parts = [self.total()]
            self.held = 0

    def total(self) -> pd.DataFrame:
        return pd.concat(self.parts).groupby(level=0).sum() if self.parts else pd.DataFrame()


def _pairs(pdf: pd.DataFrame, met, ended) -> None:
    """Every edge of one cell, a few sources at a time.

    `met(s, d, weight)` gets the sources and targets (rows of the tables below) of every
    shared name and import, `ended(s, d)` those of every distinct edge, by their places.
    """
    codes = pd.factorize(pdf["name"])[0]
    kind = pdf["kind"].to_numpy()
    col = {c: pdf[c].to_numpy(np.int64) for c in ("at", "head", "n", "to", "to_head")}
    c, b, m = (np.flatnonzero(kind == k) for k in range(3))
    b = b[np.argsort(codes[b], kind="stable")]
    first, last = (np.searchsorted(codes[b], codes[c], side) for side in ("left", "right"))
    source = np.concatenate([c, m])
    start, length = np.concatenate([first, len(b) + np.arange(len(m))]), np.concatenate([last - first, np.ones(len(m), np.int64)])
    target, target_head = np.concatenate([col["at"][b], col["to"][m]]), np.concatenate([col["head"][b], col["to_head"][m]])
    times = np.concatenate([col["n"][b], np.ones(len(m), np.int64)])
    order = np.argsort(col["at"][source], kind="stable")
    source, start, length = source[order], start[order], length[order]
    at = col["at"][source]
    width = int(target.max()) + 1 if len(target) else 1
    places, local = np.unique(at, return_inverse=True)
    seen = np.zeros(TOGETHER * width, bool)
    for low in range(0, len(places), TOGETHER):
        rows = slice(*np.searchsorted(local, [low, low + TOGETHER]))
        ends = np.cumsum(length[rows])
        steps = np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS)) + 1
        begin = 0
        for stop in [*steps.tolist(), len(ends)]:
            r = np.arange(rows.start + begin, rows.start + min(stop, len(ends)))
            begin = max(begin, min(stop, len(ends)))
            if not len(r) or not length[r].sum():
                continue
            s = np.repeat(r, length[r])
            d = np.arange(len(s)) - np.repeat(np.cumsum(length[r]) - length[r], length[r]) + start[s]
            differ = col["head"][source[s]] != target_head[d]
            s, d = s[differ], d[differ]
            met(at[s], target[d], col["n"][source[s]] * times[d])
            seen[(local[s] - low) * width + target[d]] = True
        found = np.flatnonzero(seen)
        ended(places[low + found // width], found % width)
        seen[found] = False


def _fan_of_cell(chunk: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into, out = np.zeros(chunk, np.int64), np.zeros(chunk, np.int64)

        def ended(s, d):
            into[:] += np.bincount(d, minlength=chunk)
            out[:] += np.bincount(s, minlength=chunk)

        _pairs(pdf, lambda s, d, weight: None, ended)
        repo, i, j = pdf[["repo_id", "i", "j"]].iloc[0]
        parts = []
        for side, n, fans in ((i, out, ("fan_out", "fan_in")), (j, into, ("fan_in", "fan_out"))):
            at = np.flatnonzero(n)
            parts.append(pd.DataFrame({"repo_id": repo, "place": side * chunk + at, fans[0]: n[at], fans[1]: 0}))
        return pd.concat(parts)[["repo_id", "place", "fan_in", "fan_out"]]

    return run


def _clusters_of_cell(chunk: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of_source, of_target = np.zeros(chunk, np.int64), np.zeros(chunk, np.int64)
        for kinds, at, group, of in (((0, 2), "at", "grp", of_source), ((1,), "at", "grp", of_target), ((2,), "to", "to_grp", of_target)):
            some = pdf[pdf["kind"].isin(kinds)]
            of[some[at].to_numpy(np.int64)] = some[group].to_numpy(np.int64)
        kinds, of_target = np.unique(of_target, return_inverse=True)
        sums = Sums()
        code = lambda s, d: of_source[s] * len(kinds) + of_target[d]
        _pairs(
            pdf, lambda s, d, weight: sums.add(code(s, d), weight, np.zeros(len(s), np.int64)),
            lambda s, d: sums.add(code(s, d), np.zeros(len(s), np.int64), np.ones(len(s), np.int64)),
        )
        total = sums.total()
        if total.empty:
            return pd.DataFrame(columns=["repo_id", "gs", "gd", "weight", "n"])
        codes = total.index.to_numpy()
        return pd.DataFrame({"repo_id": pdf["repo_id"].iloc[0], "gs": codes // len(kinds), "gd": kinds[codes % len(kinds)], "weight": total[0].to_numpy(), "n": total[1].to_numpy()})

    return run


def _sums(left: dict, right: dict, given: dict, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, weight) of every edge between rows of `left` and `right` with the same key, and of those given.

    Some left files at a time, with all their edges, so that what is summed in one
    step is whole. With `ordered` an edge runs from the smaller place.
    """
    by_key = np.argsort(right["key"], kind="stable")
    keys, to, times = (right[c][by_key] for c in ("key", "place", "n"))
    order = np.argsort(left["place"], kind="stable")
    place, key, n = (left[c][order] for c in ("place", "key", "n"))
    first, last = (np.searchsorted(keys, key, side) for side in ("left", "right"))
    met = np.concatenate([[0], np.cumsum(last - first)])
    files = np.unique(np.concatenate([place, given["place"]]))
    begin = np.searchsorted(place, files)
    step = met[begin] // PAIRS
    width = int(max(to.max(initial=0), given["to"].max(initial=0))) + 1
    low = files[0] if len(files) else 0
    for k in np.unique(step):
        lo, hi = np.searchsorted(step, [k, k + 1])
        r = np.arange(begin[lo], begin[hi] if hi < len(files) else len(place))
        row = np.repeat(r, last[r] - first[r])
        at = np.arange(len(row)) - np.repeat(met[r] - met[r[0]] if len(r) else r, last[r] - first[r]) + first[row]
        own = (given["place"] >= files[lo]) & (given["place"] <= files[hi - 1])
        a, b = np.concatenate([place[row], given["place"][own]]), np.concatenate([to[at], given["to"][own]])
        weight = np.concatenate([n[row] * times[at], given["n"][own]])
        some = a < b if ordered else a != b
        code, weight = (a[some] - low) * width + b[some], weight[some]
        cells = (int(files[hi - 1] - low) + 1) * width
        base = (int(files[lo]) - low) * width
        if len(code) and cells - base <= DENSE * len(code) and weight.min() > 0 and weight.max() <= EXACT // len(code):
            total = np.bincount(code - base, weights=weight)  # below 2^53 a double adds whole numbers exactly
            found = np.flatnonzero(total)
            yield low + (found + base) // width, found % width, total[found].astype(np.int64)
        elif len(code):
            order = np.argsort(code, kind="stable")
            code, weight = code[order], weight[order]
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            yield low + code[new] // width, code[new] % width, np.add.reduceat(weight, new)


CALLS, BEARS, GIVEN, PATHS = range(4)


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The rows of one kind and chunk as one compressed value; texts are held once."""
    rows = rows.select(["place", "text", "n", "to"]).sort_by([("place", "ascending"), ("text", "ascending")]).combine_chunks()
    rows = rows.set_column(1, "text", rows["text"].dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return pa.table({"repo_id": [key[0]], "kind": [key[1]], "c": [key[2]], "d": [key[3]], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _edges_of_cell(ordered: bool, named: bool = True):
    """The edges of one cell as rows; with `ordered`, both ways between two files as one, from the smaller path. Files go by their paths or, if not `named`, by their places."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for kind, c, rows in zip(*(batch[x].to_pylist() for x in ("kind", "c")), batch["rows"], strict=True):
                held.setdefault(kind, {})[c] = pa.ipc.open_stream(rows.as_buffer()).read_all()
        i, j = key[1].as_py(), key[2].as_py()
        texts = {}

        def side(kind, c, way=0):
            rows = held.get(kind, {}).get(c)
            if rows is None:
                return {x: np.zeros(0, np.int64) for x in ("place", "key", "n")}
            name = rows["text"].combine_chunks()
            code = np.array([texts.setdefault(x, len(texts)) for x in name.dictionary.to_pylist()], np.int64)[name.indices.to_numpy()] if len(name) else np.zeros(0, np.int64)
            return {"place": rows["place"].to_numpy(), "key": 2 * code + way, "n": rows["n"].to_numpy()}

        both = lambda *sides: {x: np.concatenate([s[x] for s in sides]) for x in ("place", "key", "n")}
        if ordered:
            left, right = both(side(CALLS, i), side(BEARS, i, 1)), both(side(BEARS, j), side(CALLS, j, 1))
        else:
            left, right = side(CALLS, i), side(BEARS, j)
        given = {x: np.concatenate([np.zeros(0, np.int64), *(rows[x].to_numpy() for rows in held.get(GIVEN, {}).values())]) for x in ("place", "to", "n")}
        if ordered:
            given["place"], given["to"] = np.minimum(given["place"], given["to"]), np.maximum(given["place"], given["to"])
        ends = [(held[PATHS][c]["place"].to_numpy()[0], held[PATHS][c]["text"].combine_chunks().dictionary_decode()) for c in (i, j)] if named else []
        for a, b, weight in _sums(left, right, given, ordered):
            for k in range(0, len(a), BATCH):
                some = slice(k, k + BATCH)
                places = [paths.take(pa.array(x[some] - first)) for (first, paths), x in zip(ends, (a, b), strict=True)] if named else [pa.array(a[some]), pa.array(b[some])]
                yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(places[0])), *places, pa.array(weight[some])], names=["repo_id", *(("a", "b") if ordered else ("src", "dst")), "weight"])

    return run


@dataclass
class NamedEdges:
    """Edges between files: one for each caller and bearer of a name in two files, and the imports.

    Weights are callers times bearers, summed over names, plus those of the imports.
    Counts of edges are made on a grid: files of a repo are numbered and cut into chunks,
    every chunk of sources meets every chunk of targets in one task, and only counts per
    file or cluster leave it. What is moved are callers and bearers, once per chunk of the
    other side; the pairs, whose number grows with the square of the tables, exist a few
    million at a time within a task. Where the edges are the result themselves, a cell sums
    and hands out some sources at a time, and nothing is grouped after it; the callers, bearers
    and paths of a chunk go to its cells as one compressed value.
    """

    callers: DataFrame  # repo_id, name, src, n_callers
    bearers: DataFrame  # repo_id, name, dst, n_defined
    imports: DataFrame  # repo_id, src, dst, weight
    chunk: int = CHUNK
    edge_chunk: int = EDGE_CHUNK
    _placed: DataFrame | None = field(default=None, repr=False)
    _fan: DataFrame | None = field(default=None, repr=False)
    _chunks: dict[int, DataFrame] = field(default_factory=dict, repr=False)
    _between: list[tuple[DataFrame, DataFrame]] = field(default_factory=list, repr=False)

    def arcs(self) -> DataFrame:
        """(repo_id, src, dst): the same ways between files, over the names; files are marked `0` and names `1`."""
        mark = lambda kind, c: F.concat(F.lit(kind), c)
        return (
            self.callers.select("repo_id", mark(FILE, "src").alias("src"), mark(NAME, "name").alias("dst"))
            .unionByName(self.bearers.select("repo_id", mark(NAME, "name").alias("src"), mark(FILE, "dst").alias("dst")))
            .unionByName(self.imports.select("repo_id", mark(FILE, "src").alias("src"), mark(FILE, "dst").alias("dst")))
        )

    def _cells(self, nodes: DataFrame) -> DataFrame:
        """Callers, bearers and imports in the cells (repo_id, i, j) of the grid; nodes are (repo_id, path, place, head, grp)."""
        chunks = nodes.groupBy("repo_id").agg((F.max("place") / self.chunk).cast("int").alias("last"))
        at = nodes.select("repo_id", "path", (F.col("place") / self.chunk).cast("int").alias("c"), (F.col("place") % self.chunk).alias("at"), "head", "grp").join(chunks, "repo_id")
        every, none = F.explode(F.sequence(F.lit(0), "last")), F.lit(-1).cast("long")
        callers = self.callers.where("name is not null").withColumnRenamed("src", "path").join(at, ["repo_id", "path"]).select(
            "repo_id", F.col("c").alias("i"), every.alias("j"), F.lit(0).alias("kind"), "at", "head", "grp", "name", F.col("n_callers").alias("n"), none.alias("to"), none.alias("to_head"), none.alias("to_grp"),
        )
        bearers = self.bearers.where("name is not null").withColumnRenamed("dst", "path").join(at, ["repo_id", "path"]).select(
            "repo_id", every.alias("i"), F.col("c").alias("j"), F.lit(1).alias("kind"), "at", "head", "grp", "name", F.col("n_defined").alias("n"), none.alias("to"), none.alias("to_head"), none.alias("to_grp"),
        )
        to = at.select("repo_id", F.col("path").alias("dst"), F.col("c").alias("j"), F.col("at").alias("to"), F.col("head").alias("to_head"), F.col("grp").alias("to_grp"))
        imports = self.imports.join(at.withColumnRenamed("path", "src"), ["repo_id", "src"]).join(to, ["repo_id", "dst"]).select(
            "repo_id", F.col("c").alias("i"), "j", F.lit(2).alias("kind"), "at", "head", "grp", F.lit("").alias("name"), F.col("weight").alias("n"), "to", "to_head", "to_grp",
        )
        return callers.unionByName(bearers).unionByName(imports).groupBy("repo_id", "i", "j")

    def _places(self) -> DataFrame:
        """(repo_id, path, place): the files of a repo numbered by path."""
        if self._placed is None:
            paths = (
                self.callers.select("repo_id", F.col("src").alias("path")).unionByName(self.bearers.select("repo_id", F.col("dst").alias("path")))
                .unionByName(self.imports.select("repo_id", F.explode(F.array("src", "dst")).alias("path")))
            ).where("path is not null").distinct()
            self._placed = cut(running_total(paths, ["repo_id"], ["path"], F.lit(1).cast("long"), "place").select("repo_id", "path", "place"))
        return self._placed

    def at_places(self, labels: DataFrame) -> DataFrame:
        """(repo_id, node, label) of labels (repo_id, path, label), with the places of files for their paths."""
        return labels.join(self._places(), ["repo_id", "path"]).select("repo_id", F.col("place").alias("node"), "label")

    def _pack(self) -> DataFrame:
        """(repo_id, kind, c, d, rows): callers, bearers and paths of each chunk c, and the imports from c to d, each as one value."""
        if self._chunks.get(self.edge_chunk) is None:
            placed = self._places().withColumn("c", F.floor(F.col("place") / self.edge_chunk).cast("int"))
            shape = ["repo_id", "kind", "c", "d", "place", "text", "n", "to"]
            none = F.lit(-1).cast("long")
            sides = [
                df.where("name is not null").select("repo_id", F.col(file).alias("path"), F.col("name").alias("text"), F.col(n).alias("n"))
                .join(placed, ["repo_id", "path"]).select("repo_id", F.lit(kind).alias("kind"), "c", F.lit(-1).alias("d"), "place", "text", "n", none.alias("to"))
                for kind, df, file, n in ((CALLS, self.callers, "src", "n_callers"), (BEARS, self.bearers, "dst", "n_defined"))
            ]
            ends = lambda key, place, c: placed.select("repo_id", F.col("path").alias(key), F.col("place").alias(place), F.col("c").alias(c))
            given = self.imports.join(ends("src", "place", "c"), ["repo_id", "src"]).join(ends("dst", "to", "d"), ["repo_id", "dst"]).select(
                "repo_id", F.lit(GIVEN).alias("kind"), "c", "d", "place", F.lit("").alias("text"), F.col("weight").cast("long").alias("n"), "to"
            )
            paths = placed.where("repo_id is not null").select("repo_id", F.lit(PATHS).alias("kind"), "c", F.lit(-1).alias("d"), "place", F.col("path").alias("text"), F.lit(0).cast("long").alias("n"), none.alias("to"))
            rows = sides[0].unionByName(sides[1]).unionByName(given).unionByName(paths).select(*shape)
            self._chunks[self.edge_chunk] = cut(rows.groupBy("repo_id", "kind", "c", "d").applyInArrow(_packed, "repo_id string, kind int, c int, d int, rows binary"))
        return self._chunks[self.edge_chunk]

    def _edges(self, ordered: bool, schema: str, named: bool = True) -> DataFrame:
        """Every edge, summed within a cell (repo_id, i, j) of the grid; with `ordered`, both ways between two files lie in one cell."""
        packed = self._pack()
        last = packed.where(F.col("kind") == PATHS).groupBy("repo_id").agg(F.max("c").alias("last"))
        size = (F.col("last") + 1).cast("long")
        cells = last.agg(F.coalesce(F.sum(size * (size + 1) / 2 if ordered else size * size), F.lit(0)).cast("long")).first()[0]
        met = packed.join(F.broadcast(last), "repo_id").withColumn("o", F.explode(F.when(F.col("kind") == GIVEN, F.array("d")).otherwise(F.sequence(F.lit(0), "last"))))
        one, two = F.struct(F.col("c").alias("i"), F.col("o").alias("j")), F.struct(F.col("o").alias("i"), F.col("c").alias("j"))
        if ordered:
            at = F.array(F.struct(F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")))
        else:
            at = F.when((F.col("kind") == PATHS) & (F.col("c") != F.col("o")), F.array(one, two)).when(F.col("kind") == BEARS, F.array(two)).otherwise(F.array(one))
        met = met.where((F.col("kind") != PATHS) | F.lit(named)).select("repo_id", F.inline(at), "kind", "c", "rows")
        # values are small and what they are unpacked to is not, so tasks are dealt by cells and not by bytes
        n = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * cells, MOST))
        return met.repartition(n, "repo_id", "i", "j").groupBy("repo_id", "i", "j").applyInArrow(_edges_of_cell(ordered, named), schema)

    def edges(self) -> DataFrame:
        """(repo_id, src, dst, weight): the edges themselves, which neither a shuffle nor a stored table holds."""
        return self._edges(False, "repo_id string, src string, dst string, weight long")

    def undirected(self) -> DataFrame:
        """(repo_id, a, b, weight): both ways between two files as one, a before b."""
        return self._edges(True, "repo_id string, a string, b string, weight long")

    def undirected_places(self) -> DataFrame:
        """`undirected` between the numbers of `_places` instead of paths."""
        return self._edges(True, "repo_id string, a long, b long, weight long", named=False)

    def two_at_most(self) -> DataFrame:
        """(repo_id, n_edges): the number of edges of a repo, 2 standing for any more.

        Three callers and three bearers of a name hold two edges if all of them do.
        """
        def some(df: DataFrame, file: str) -> DataFrame:
            by = Window.partitionBy("repo_id", "name").orderBy(file)
            files = df.where(f"name is not null and repo_id is not null and {file} is not null").select("repo_id", "name", file)
            return files.withColumn("_k", F.dense_rank().over(by)).where("_k <= 3").distinct().drop("_k")

        met = some(self.callers, "src").join(some(self.bearers, "dst"), ["repo_id", "name"]).select("repo_id", "src", "dst")
        pairs = met.unionByName(self.imports.select("repo_id", "src", "dst")).where("repo_id is not null and src <> dst").distinct()
        return pairs.groupBy("repo_id").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n_edges"))

    def of(self, repos: DataFrame) -> NamedEdges:
        """Those of some repos (repo_id)."""
        some = lambda df: df.join(repos, "repo_id", "left_semi")
        return NamedEdges(some(self.callers), some(self.bearers), some(self.imports), self.chunk, self.edge_chunk, _placed=some(self._places()), _chunks={k: some(v) for k, v in self._chunks.items()})

    def fan(self) -> DataFrame:
        """(repo_id, path, fan_in, fan_out) of every file with an edge."""
        if self._fan is None:
            place = F.col("place")
            nodes = cut(self._places().select("repo_id", "path", "place", place.alias("head"), place.alias("grp")))
            found = self._cells(nodes).applyInPandas(_fan_of_cell(self.chunk), "repo_id string, place long, fan_in long, fan_out long")
            sums = found.groupBy("repo_id", "place").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))
            self._fan = cut(sums.join(nodes, ["repo_id", "place"]).select("repo_id", "path", "fan_in", "fan_out"))
        return self._fan

    def between(self, membership: DataFrame) -> DataFrame:
        """(repo_id, cs, cd, weight, n): weights and numbers of the edges from one cluster to another, or to itself."""
        for known, sums in self._between:
            if known is membership:
                return sums
        members = membership.select("repo_id", "path", "cluster_id").where("path is not null")
        placed = cut(running_total(members, ["repo_id"], ["path"], F.lit(1).cast("long"), "place").select("repo_id", "path", "cluster_id", "place"))
        heads = placed.groupBy("repo_id", "path").agg(F.min("place").alias("head"))
        groups = placed.groupBy("repo_id", "cluster_id").agg(F.min("place").alias("grp"))
        same = F.col("a.repo_id").eqNullSafe(F.col("g.repo_id")) & F.col("a.cluster_id").eqNullSafe(F.col("g.cluster_id"))
        nodes = cut(placed.alias("a").join(groups.alias("g"), same).select("a.*", "g.grp").join(heads, ["repo_id", "path"]))
        found = self._cells(nodes).applyInPandas(_clusters_of_cell(self.chunk), "repo_id string, gs long, gd long, weight long, n long")
        named = lambda key, name: groups.select("repo_id", F.col("grp").alias(key), F.col("cluster_id").alias(name))
        sums = cut(
            found.groupBy("repo_id", "gs", "gd").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
            .join(named("gs", "cs"), ["repo_id", "gs"]).join(named("gd", "cd"), ["repo_id", "gd"]).select("repo_id", "cs", "cd", "weight", "n")
        )
        self._between.append((membership, sums))
        return sums
