"""Tokens and their postings, and vectors of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """The index: (doc, token, tf, length).

    Equal tokens of a document are counted map-side, so a frequent word costs
    one row per document it occurs in.
    """
    words = docs.select(F.col(key).alias("doc"), tokens(text).alias("words"))
    return words.select("doc", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy("doc", "token", "length").agg(
        F.count(F.lit(1)).alias("tf")
    )


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def embed(df: DataFrame, text: Column, encode=None, dims: int = 384) -> DataFrame:
    """Add `vector`, of length one.

    `encode` maps a list of texts to a list of vectors and is called batch by
    batch. Without it, words are counted by hash, which needs no model.
    """
    if encode is None:
        worded = df.withColumn("_words", tokens(text))
        counted = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(worded)
        unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
        return unit.withColumn("vector", vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        import numpy as np

        raw = np.asarray(encode(list(texts)), dtype="float64")
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        return pd.Series(list((raw / np.where(norm == 0, 1, norm)).astype("float32")))

    return df.withColumn("vector", run(text))
