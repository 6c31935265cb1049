"""A generalised additive model with pairwise interactions for text quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import map_slices, slices, small_batches, small_table, text_buffers
from graphlens.llm.text_features import NAMES, features

BINS = 48
PAIR_BINS = 12
SAMPLE = 20_000


@dataclass
class Model:
    """Lookup tables: one per feature, one per pair of features, and a constant."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p in self.pairs for f in p}
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin borders between values, at even shares of the rows."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        return values
    return (values[1:] + values[:-1]) / 2


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """Where to cut a row of bins in two, and what that gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return at + 1, float(gain[at])


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """The values of a small tree over the bins of one feature."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        found = max(((*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda x: x[1])
        if found[1] <= 1e-9:
            break
        at, _, a, b = found
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over two features: a cut of the first, then one of the second on either side."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for row in range(1, a.shape[0]):
            cuts = [(_split(a[p].sum(0), b[p].sum(0), ridge), p) for p in (slice(0, row), slice(row, None))]
            rows = _split(a.sum(1), b.sum(1), ridge)
            gain = sum(c[0][1] for c in cuts)
            if gain > best:
                best, made = gain, np.zeros_like(a)
                for (at, _), p in cuts:
                    for q in (slice(0, at), slice(at, None)):
                        made[p, q] = a[p, q].sum() / (b[p, q].sum() + ridge)
                out = made.T if flip else made
            del rows
    return out, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, ridge: float = 4.0) -> Model:
    """Boost one feature after the other, again and again, by a shallow tree each time.

    A tree over one feature only changes that feature's table of values per bin,
    so the model stays a sum of lookups. The pairs whose trees explain most of
    what the single features leave get tables of their own in the same way.
    """
    n = x.shape[1]
    edges = [_edges(x[:, f], BINS) for f in range(n)]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(n)]
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n)]
    pair_bins = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(n)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    model = Model(base, edges, tables, coarse, [], [])
    if not len(y) or y.min() == y.max():
        return model
    total = np.full(len(y), base)
    slope = lambda: 1 / (1 + np.exp(-total))
    for _ in range(rounds):
        for f in range(n):
            q = slope()
            g, h = np.bincount(bins[f], y - q, len(tables[f])), np.bincount(bins[f], q * (1 - q), len(tables[f]))
            step = rate * _shallow(g, h, ridge)
            tables[f] += step
            total += step[bins[f]]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = slope()
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        at = pair_bins[f] * shape[1] + pair_bins[k]
        size = shape[0] * shape[1]
        return np.bincount(at, y - q, size).reshape(shape), np.bincount(at, q * (1 - q), size).reshape(shape), at

    gains = sorted(((-_shallow_pair(*grid(f, k)[:2], ridge)[1], f, k) for f in range(n) for k in range(f + 1, n)))[:pairs]
    model.pairs = [(f, k) for _, f, k in gains]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for i, (f, k) in enumerate(model.pairs):
            g, h, at = grid(f, k)
            step = rate * _shallow_pair(g, h, ridge)[0]
            model.pair_tables[i] += step
            total += step.ravel()[at]
    return model


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every document."""
    arrow = pa.schema([("id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def make(rows, raw, offsets):
        x = features(raw, offsets)
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return {"id": rows.column(0), "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))}

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(source, "text", "id long, features array<double>", arrow, make)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Model:
    """Train on the labelled documents that are not held out, at most `sample` of them.

    The sample is the labelled ids with the smallest hashes; only they and their
    features reach the driver. Ids with labels that disagree count once per label.
    Without labels, or with one label only, the model is a constant.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y"))
        .where("label_id is not null and y in (0, 1)").where(~held_out(F.col("label_id"))).distinct()
        .orderBy(F.xxhash64("label_id"), "label_id", "y").limit(sample)
    )
    rows = chosen.collect()
    known = small_table(
        docs.sparkSession, label_id=pa.array([r.label_id for r in rows], pa.int64()), y=pa.array([r.y for r in rows], pa.int32())
    )
    asked = docs.join(F.broadcast(known.select("label_id").distinct()), docs[id_col].cast("long") == F.col("label_id"), "left_semi")
    made = text_features(asked, id_col, text_col).join(F.broadcast(known), F.col("id") == F.col("label_id")).toPandas()
    made = made.sort_values(["id", "y"], kind="stable")
    x = np.array(made["features"].tolist(), float).reshape(-1, len(NAMES))
    return train(x, made["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the model's score of each text, between 0 and 1."""

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        raw, offsets = text_buffers(text)
        parts = [model.score(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return small_batches(docs).withColumn(name, of(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= `threshold`) for every document.

    Texts are all the model sees. Null and empty texts have features of zero and
    are scored too; null ids are never held out; repeated rows are scored alike.
    Other columns are left out.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return scored(narrow, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
