"""Turn names into edges: calls, imports, definitions, ownership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.modules import module_candidates
from graphlens.functions.skew import split_hot_join
from graphlens.operators.dependencies import NamedEdges
from graphlens.session import cut

REPO_QNAME = ["repo_id", "qualified_name"]


def collapse_functions(functions: DataFrame) -> DataFrame:
    """One row per qualified name; of several definitions the last by path and line."""
    rest = [c for c in functions.columns if c not in REPO_QNAME]
    last = F.max_by(F.struct(*rest), F.struct("file_path", "start_line")).alias("f")
    return functions.groupBy(*REPO_QNAME).agg(last).select(*REPO_QNAME, "f.*")


def written_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, caller, name, line): what each existing function calls by name.

    This is the call graph before names are multiplied out. Traversals work on
    it, so that a name shared by many functions costs its callers plus its
    definitions instead of their product.
    """
    callers = functions.select("repo_id", F.col("qualified_name").alias("caller_qname")).distinct()
    return (
        sites.groupBy("repo_id", "caller_qname", "callee_name")
        .agg(F.max("line").alias("line"))
        .join(callers, ["repo_id", "caller_qname"], "left_semi")
        .select("repo_id", F.col("caller_qname").alias("caller"), F.col("callee_name").alias("name"), "line")
    )


def named_functions(functions: DataFrame) -> DataFrame:
    return collapse_functions(functions.select("repo_id", "qualified_name", "name", "file_path", "start_line")).select(
        "repo_id", "name", F.col("qualified_name").alias("fn")
    )


def called_functions(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """The functions whose name some site of their repo writes: the targets of all call edges, without the edges."""
    written = sites.select("repo_id", F.col("callee_name").alias("name")).distinct()
    return functions.join(written, ["repo_id", "name"], "left_semi")


def resolve_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Call edges: every function of the repo that bears the written name."""
    return split_hot_join(
        written_calls(sites, functions), named_functions(functions), ["repo_id", "name"], F.col("caller"),
        counted=sites.select("repo_id", F.col("callee_name").alias("name")), spread_right=F.col("fn"),
    ).select("repo_id", F.col("caller").alias("src"), F.col("fn").alias("dst"), "line")


@dataclass
class NamedCalls:
    """Call edges held by name: src calls the name, dst bears it. A pair (src, dst) shares one name at most."""

    calls: DataFrame  # repo_id, src, name, line
    names: DataFrame  # repo_id, name, dst

    @classmethod
    def of(cls, sites: DataFrame, functions: DataFrame) -> NamedCalls:
        """The edges from every site to the bearers of its name. A function that bears several names gets one of its own, called by all who call one of them."""
        calls = sites.groupBy("repo_id", F.col("caller_qname").alias("src"), F.col("callee_name").alias("name")).agg(F.max("line").alias("line")).where("name is not null")
        borne = functions.where("name is not null").select("repo_id", "name", F.col("qualified_name").alias("dst")).distinct()
        kinds = borne.groupBy("repo_id", "dst").agg(F.min("name").alias("name"), F.max("name").alias("last"))
        mark = lambda kind, c: F.concat(F.lit(kind), c).alias("name")
        both = kinds.where("name <> last").select("repo_id", "dst")
        several = borne.alias("n").join(both.alias("k"), (F.col("n.repo_id") == F.col("k.repo_id")) & F.col("n.dst").eqNullSafe(F.col("k.dst"))).select("n.*")
        own = F.coalesce(mark("2", F.col("dst")), F.lit("3"))
        shared = calls.join(several, ["repo_id", "name"]).groupBy("repo_id", "src", own.alias("name")).agg(F.max("line").alias("line"))
        return cls(
            calls.withColumn("name", mark("1", F.col("name"))).unionByName(shared),
            kinds.select("repo_id", F.when(F.col("name") == F.col("last"), mark("1", F.col("name"))).otherwise(own).alias("name"), "dst"),
        )

    def edges(self) -> DataFrame:
        """(repo_id, src, dst, line): the product."""
        return split_hot_join(self.calls, self.names, ["repo_id", "name"], F.col("src"), spread_right=F.col("dst")).select("repo_id", "src", "dst", "line")


def _stale_by_name(calls: NamedCalls, sites: DataFrame, functions: DataFrame) -> NamedCalls:
    """What `stale_calls` keeps of edges held by name.

    Whether an edge stands hangs on its caller and on the name that its target bears
    now, so targets are told apart by that name, and callers of each are dropped whole.
    """
    ends = named_functions(functions)
    now = F.coalesce(F.concat(F.lit("1"), "now"), F.lit("0")).alias("now")
    names = cut(calls.names.join(ends.select("repo_id", F.col("fn").alias("dst"), F.col("name").alias("now")), ["repo_id", "dst"], "left").select("repo_id", "name", "dst", now))
    written = sites.select("repo_id", F.col("caller_qname").alias("src"), F.concat(F.lit("1"), "callee_name").alias("now")).distinct()
    standing = written.join(ends.select("repo_id", F.col("fn").alias("src")), ["repo_id", "src"], "left_semi")
    stale = calls.calls.join(names.select("repo_id", "name", "now").distinct(), ["repo_id", "name"]).join(standing, ["repo_id", "src", "now"], "left_anti")
    both = F.concat(F.length("name").cast("string"), F.lit(":"), "name", "now").alias("name")
    return NamedCalls(cut(stale.select("repo_id", "src", both, "line")), names.select("repo_id", both, "dst"))


def stale_calls(calls: DataFrame | NamedCalls, sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges that no longer stand.

    Either end has vanished, or no call site supports the edge any more. Edges
    refined by definition need no call site, but both ends. Of edges held by name only
    the stale ones are built.
    """
    if isinstance(calls, NamedCalls):
        return _stale_by_name(calls, sites, functions).edges()
    ends = named_functions(functions)
    callers = ends.select("repo_id", F.col("fn").alias("src"), F.lit(True).alias("_caller"))
    targets = ends.select("repo_id", F.col("fn").alias("dst"), "name")
    written = sites.select(
        "repo_id", F.col("caller_qname").alias("src"), F.col("callee_name").alias("name"), F.lit(True).alias("_written")
    ).distinct()
    known = calls.join(targets, ["repo_id", "dst"], "left").join(callers, ["repo_id", "src"], "left").join(
        written, ["repo_id", "src", "name"], "left"
    )
    refined = F.coalesce(F.col("precise"), F.lit(False)) if "precise" in calls.columns else F.lit(False)
    gone = F.col("name").isNull() | F.col("_caller").isNull() | (F.col("_written").isNull() & ~refined)
    return known.filter(gone).select(*calls.columns)


def current_calls(stored: DataFrame | None, sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, src, dst, line, precise): the edges the names give now, and the stored refined ones that still stand."""
    named = resolve_calls(sites, functions).withColumn("precise", F.lit(False))
    if stored is None:
        return named
    refined = stored.filter("precise")
    kept = refined.join(stale_calls(refined, sites, functions), ["repo_id", "src", "dst"], "left_anti")
    return named.join(kept, ["repo_id", "src", "dst"], "left_anti").unionByName(kept.select(*named.columns))


def defines_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, qualified_name); a name defined in two files has two edges."""
    return (
        symbols.select("repo_id", F.col("file_path").alias("path"), "qualified_name")
        .distinct()
        .join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    )


def has_method_edges(functions: DataFrame, classes: DataFrame) -> DataFrame:
    known = classes.select("repo_id", F.col("qualified_name").alias("class_qname")).distinct()
    return (
        functions.filter(F.col("class_qname").isNotNull())
        .select("repo_id", "class_qname", "qualified_name")
        .distinct()
        .join(known, ["repo_id", "class_qname"], "left_semi")
    )


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File -> file edges by module name; weight counts the modules behind an edge."""
    owner = (
        files.select("repo_id", "path", F.explode(module_candidates(F.col("path"))).alias("module"))
        .groupBy("repo_id", "module")
        .agg(F.min("path").alias("dst"))
    )
    return (
        imports.select("repo_id", F.col("file_path").alias("src"), "module")
        .distinct()
        .join(owner, ["repo_id", "module"])
        .filter(F.col("dst") != F.col("src"))
        .groupBy("repo_id", "src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def file_call_edges(calls: DataFrame | NamedCalls, functions: DataFrame) -> DataFrame:
    """File -> file edges; weight counts the (caller, callee) pairs behind an edge.

    Edges held by name are counted per (file, name) at either end, and files are paired,
    not functions.
    """
    owner = functions.select("repo_id", "qualified_name", "file_path").distinct()
    if isinstance(calls, NamedCalls):
        counted = lambda df, end, file, n: (
            df.join(owner.withColumnRenamed("qualified_name", end), ["repo_id", end]).groupBy("repo_id", "name", F.col("file_path").alias(file)).agg(F.count(F.lit(1)).alias(n))
        )
        return NamedEdges(
            cut(counted(calls.calls, "src", "src", "n_callers")), cut(counted(calls.names, "dst", "dst", "n_defined")), _no_imports(functions)
        ).edges()
    src = owner.select("repo_id", F.col("qualified_name").alias("src"), F.col("file_path").alias("a"))
    dst = owner.select("repo_id", F.col("qualified_name").alias("dst"), F.col("file_path").alias("b"))
    return (
        calls.select("repo_id", "src", "dst")
        .distinct()
        .join(src, ["repo_id", "src"])
        .join(dst, ["repo_id", "dst"])
        .filter(F.col("a") != F.col("b"))
        .groupBy("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _callers_and_bearers(sites: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Callers counted per (file, name) and definitions per (name, file)."""
    owner = functions.select("repo_id", F.col("qualified_name").alias("fn"), "file_path").distinct()
    callers = (
        written_calls(sites, functions)
        .join(owner.withColumnRenamed("fn", "caller"), ["repo_id", "caller"])
        .groupBy("repo_id", "name", F.col("file_path").alias("src"))
        .agg(F.count(F.lit(1)).alias("n_callers"))
    )
    defined = (
        named_functions(functions)
        .join(owner, ["repo_id", "fn"])
        .groupBy("repo_id", "name", F.col("file_path").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n_defined"))
    )
    return callers, defined


def named_file_edges(sites: DataFrame, functions: DataFrame, imports: DataFrame) -> NamedEdges:
    """The edges of `file_call_edges_by_name` and of `imports` (file -> file) together, held by name: stored once for all that counts them."""
    callers, defined = _callers_and_bearers(sites, functions)
    return NamedEdges(cut(callers), cut(defined), cut(imports))


def _no_imports(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "repo_id string, src string, dst string, weight long")


def file_call_edges_by_name(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """The same edges straight from written names.

    Callers are counted per (file, name) and definitions per (name, file), so names
    pair files, not functions; pairs are summed on a grid of files and not moved.
    """
    return named_file_edges(sites, functions, _no_imports(sites)).edges()


def _halvings(first: Column, last: Column) -> Column:
    """The fewest aligned stretches of lines, each a power of two long, that make up first..last: (level, node).

    A level's stretches are numbered from line 0; at most two of a level are needed.
    """
    end = last + 1

    def at(k: Column) -> Column:
        low, high = -F.floor(-first / F.pow(F.lit(2.0), k)), F.floor(end / F.pow(F.lit(2.0), k))
        odd = lambda n: n % 2 != 0
        node = lambda n: F.struct(k.alias("level"), n.cast("long").alias("node"))
        return F.when(low < high, F.array_compact(F.array(F.when(odd(low), node(low)), F.when(odd(high), node(high - 1)))))

    levels = F.sequence(F.lit(0), _level(first, last))
    return F.filter(F.flatten(F.filter(F.transform(levels, at), lambda x: x.isNotNull())), lambda x: x.isNotNull())


def _level(first: Column, last: Column) -> Column:
    """The highest level of which a stretch can lie in first..last."""
    return F.floor(F.log2((last - first + 1).cast("double"))).cast("int")


def innermost_function(definitions: DataFrame, functions: DataFrame) -> DataFrame:
    """The narrowest function around each definition line (ties by name).

    A span is cut into aligned stretches, at most two per power of two of its
    length, and of all spans on a stretch only the narrowest is kept. A line lies in
    one stretch per level, so it meets at most one row on each: a file with as many
    functions as lines costs both times the levels, not their product, and its
    stretches are spread over all tasks. Spans may overlap in any way; those without
    lines hold none. Lines are made distinct first: a popular target is looked up
    once, however many call sites point at it. Stretches and lines are many times
    what their tables weigh on disk, so the joins are sorted: none is sent to the driver
    because its table looks small.
    """
    file = ["repo_id", "target_path"]
    spans = functions.where("end_line >= start_line and start_line >= 0").select(
        "repo_id", F.col("file_path").alias("target_path"), "qualified_name", F.col("start_line").cast("long").alias("first"), F.col("end_line").cast("long").alias("last")
    )
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "qualified_name")).alias("best")
    narrowest = (
        spans.select(*file, "first", "last", "qualified_name", F.inline(_halvings(F.col("first"), F.col("last"))))
        .groupBy(*file, "level", "node").agg(best)
    )
    highest = spans.agg(F.coalesce(F.max(_level(F.col("first"), F.col("last"))), F.lit(0)).alias("most")).scalar()
    lines = definitions.select(*file, "target_line").where("target_line >= 0").distinct()
    found = (
        lines.withColumn("level", F.explode(F.sequence(F.lit(0), highest)))
        .withColumn("node", F.expr("shiftright(cast(target_line as bigint), level)"))
        .join(narrowest.hint("merge"), [*file, "level", "node"])
        .groupBy(*file, "target_line").agg(F.min("best").alias("best"))
        .select(*file, "target_line", F.col("best.qualified_name").alias("dst"))
    )
    return definitions.join(found.hint("merge"), [*file, "target_line"])


def refined_edges(definitions: DataFrame, functions: DataFrame) -> DataFrame:
    return (
        innermost_function(definitions, functions)
        .join(
            functions.select("repo_id", F.col("qualified_name").alias("caller_qname")).distinct().hint("merge"),
            ["repo_id", "caller_qname"],
            "left_semi",
        )
        .groupBy("repo_id", F.col("caller_qname").alias("src"), "dst")
        .agg(F.max("line").alias("line"))
    )


def _upgraded_by_name(calls: NamedCalls, refined: DataFrame) -> DataFrame:
    """`upgrade_edges` of edges held by name: the refined edges of a caller go along with its call of their target's name.

    They are at most as many as the sites of that call in one function. The product is
    built once and handed out; neither it nor the named edges are sorted or moved by edge.
    """
    better = cut(refined.select("repo_id", "src", "dst", "line"))
    named, names = cut(calls.calls), cut(calls.names)
    met = better.join(names.hint("merge"), ["repo_id", "dst"]).join(named.select("repo_id", "src", "name").hint("merge"), ["repo_id", "src", "name"], "left_semi")
    met = cut(met.select("repo_id", "src", "name", "dst", "line"))
    along = met.groupBy("repo_id", "src", "name").agg(F.collect_list(F.struct(F.col("dst").alias("to"), F.col("line").alias("at"))).alias("better"))
    product = split_hot_join(
        named.join(along.hint("merge"), ["repo_id", "src", "name"], "left"), names, ["repo_id", "name"], F.col("src"),
        counted=named, spread_right=F.col("dst"),
    )
    upgraded = product.select("repo_id", "src", "dst", "line", F.explode_outer(F.filter("better", lambda x: x["to"] == F.col("dst"))).alias("hit"))
    left = better.join(met.select("repo_id", "src", "dst").hint("merge"), ["repo_id", "src", "dst"], "left_anti")
    return upgraded.select("repo_id", "src", "dst", F.coalesce("hit.at", "line").alias("line"), F.col("hit").isNotNull().alias("precise")).unionByName(
        left.withColumn("precise", F.lit(True))
    )


def upgrade_edges(calls: DataFrame | NamedCalls, refined: DataFrame) -> DataFrame:
    """Lay refined edges over named ones: theirs are the line and the precise mark."""
    if isinstance(calls, NamedCalls):
        return _upgraded_by_name(calls, refined)
    precise = F.col("precise") if "precise" in calls.columns else F.lit(False)
    named = calls.select("repo_id", "src", "dst", F.col("line").alias("named_line"), precise.alias("was_precise"))
    better = refined.select("repo_id", "src", "dst", F.col("line").alias("refined_line"), F.lit(True).alias("hit"))
    return named.join(better, ["repo_id", "src", "dst"], "full_outer").select(
        "repo_id",
        "src",
        "dst",
        F.coalesce("refined_line", "named_line").alias("line"),
        F.coalesce("hit", "was_precise", F.lit(False)).alias("precise"),
    )


def sites_by_language(sites: DataFrame, functions: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """Call sites whose caller is defined in a file of one language, in that file."""
    wanted = files.filter(F.col("language") == language).select("repo_id", F.col("path").alias("file_path"))
    callers = (
        functions.select("repo_id", "file_path", F.col("qualified_name").alias("caller_qname"))
        .distinct()
        .join(wanted, ["repo_id", "file_path"], "left_semi")
    )
    return sites.join(callers, ["repo_id", "file_path", "caller_qname"], "left_semi")
