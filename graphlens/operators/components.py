"""Strongly connected components by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.dependencies import FILE, NamedEdges
from graphlens.session import cut

TRIMS = 2


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges at nodes nothing enters or nothing leaves, a layer or two.

    This only makes the labels cheaper: what lies on no cycle and is left here ends
    up in a part of its own.
    """
    for _ in range(TRIMS):
        heads = edges.select("repo_id", F.col("dst").alias("src")).distinct()
        tails = edges.select("repo_id", F.col("src").alias("dst")).distinct()
        edges = edges.join(heads, ["repo_id", "src"], "left_semi").join(tails, ["repo_id", "dst"], "left_semi")
    return cut(edges)


def _smallest_reaching(edges: DataFrame, part: DataFrame, forward: bool) -> DataFrame:
    """The smallest node of the same part that reaches (or is reached by) a node.

    Each round takes the best label of the neighbours and then the label of
    that label, which doubles the distance covered. Labels only ever get smaller,
    so the rounds end.
    """
    near, far = ("src", "dst") if forward else ("dst", "src")
    labels = part.select("repo_id", "node", F.col("node").alias("label"))
    while True:
        offered = (
            edges.select("repo_id", F.col(near).alias("node"), F.col(far).alias("to"))
            .join(labels, ["repo_id", "node"])
            .select("repo_id", F.col("to").alias("node"), "label")
        )
        better = labels.unionByName(offered).groupBy("repo_id", "node").agg(F.min("label").alias("label"))
        hop = better.select("repo_id", F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = (
            better.join(hop, ["repo_id", "label"])
            .select("repo_id", "node", F.least("label", "further").alias("label"))
        )
        before = labels.select("repo_id", "node", F.col("label").alias("was"))
        merged = cut(jumped.join(before, ["repo_id", "node"]))
        labels = merged.select("repo_id", "node", "label")
        if merged.filter(F.col("label") != F.col("was")).isEmpty():
            return labels


def cycles(edges: DataFrame | NamedEdges) -> DataFrame:
    """Members of components with more than one node: (repo_id, component, path).

    Edges held by name are followed over the names: files that lead to each other over
    names are those that lead to each other, and files sort before names.

    A component is named by its smallest member. Ends are trimmed; the rest is split by the smallest node reaching each and the smallest node
    each reaches, until both agree everywhere, which leaves the components.
    """
    if isinstance(edges, NamedEdges):
        plain = lambda c: F.expr(f"substring({c}, 2)").alias(c)
        found = cut(cycles(edges.arcs()).filter(F.col("path").startswith(FILE)).select("repo_id", plain("component"), plain("path")))
        many = found.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        return found.join(many.select("repo_id", "component"), ["repo_id", "component"], "left_semi")
    edges = edges.filter(F.col("src") != F.col("dst")).select("repo_id", "src", "dst").distinct()
    edges = cut(edges)
    done = None
    while True:  # the smallest node of every part is settled each time
        edges = _trim(edges)
        if edges.isEmpty():
            break
        nodes = edges.select("repo_id", F.col("src").alias("node")).distinct()
        fwd = _smallest_reaching(edges, nodes, True).withColumnRenamed("label", "f")
        bwd = _smallest_reaching(edges, nodes, False).withColumnRenamed("label", "b")
        both = cut(fwd.join(bwd, ["repo_id", "node"]))
        # the smallest node of the part a node lies in reaches it and is reached: same component
        closed = both.filter(F.col("f") == F.col("b")).select("repo_id", F.col("f").alias("component"), F.col("node").alias("path"))
        done = closed if done is None else done.unionByName(closed)
        open_ = both.filter(F.col("f") != F.col("b"))
        src = open_.select("repo_id", F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1"))
        dst = open_.select("repo_id", F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        edges = cut(
            edges.join(src, ["repo_id", "src"])
            .join(dst, ["repo_id", "dst"])
            .filter((F.col("f1") == F.col("f2")) & (F.col("b1") == F.col("b2")))
            .select("repo_id", "src", "dst")
        )
    if done is None:
        return edges.select("repo_id", F.col("src").alias("component"), F.col("src").alias("path"))
    many = done.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return done.join(many.select("repo_id", "component"), ["repo_id", "component"], "left_semi")
