"""The place of models: scorers over DataFrames, with deterministic stand-ins. A run with a stand-in is marked by the
column `scorer`, and its scores say nothing of a model's quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


class Scorer(Protocol):
    """score: pairs (query, text, ...) with `score` and `scorer` added. encode: rows (text, ...) with `vector` and `scorer`."""

    def score(self, pairs: DataFrame, query: str, text: str) -> DataFrame: ...

    def encode(self, texts: DataFrame, text: str) -> DataFrame: ...


class TokenOverlap:
    """Stand-in: the share of the query's words that the text has; vectors of hashed words at length 1."""

    name = "stand-in:token-overlap"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def score(self, pairs: DataFrame, query: str, text: str) -> DataFrame:
        q, t = X.content_words(F.col(query)), X.content_words(F.col(text))
        s = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
        return pairs.withColumn("score", F.coalesce(s, F.lit(0.0))).withColumn("scorer", F.lit(self.name))

    def encode(self, texts: DataFrame, text: str) -> DataFrame:
        """A dimension holds how many of the text's distinct content words hash to it; null and empty texts are zero."""
        words = X.content_words(F.coalesce(F.col(text), F.lit("")))
        at = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, F.lit(8)), 16, 10).cast("long") % self.dims)
        src = texts.select("*", at.cast("array<int>").alias("_at"))
        dims, name = self.dims, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(batch.num_columns - 1)
                row = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
                m = np.zeros((len(col), dims))
                np.add.at(m, (row, col.flatten().to_numpy(zero_copy_only=False)), 1.0)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                flat = pa.array((m / np.where(n > 0, n, 1)).ravel())
                vector = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1, dtype=np.int32) * dims), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector, pa.array([name] * len(col), pa.string())], names=[*batch.schema.names[:-1], "vector", "scorer"])

        schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("scorer", T.StringType())])
        return src.mapInArrow(run, schema)


def by_model(df: DataFrame, column: str, call: Callable[[list[str]], list[str | None]], out: str, batch: int = 32) -> DataFrame:
    """`out` by a model's call over batches of `column`, in order; texts of a batch whose call fails, and nulls, get null and
    don't fail the rows around them. The call runs in the workers, one batch of Arrow rows at a time."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made: list[str | None] = []
            for a in range(0, len(f), batch):
                part = f[column].iloc[a : a + batch].tolist()
                try:
                    got = call([x for x in part if x is not None])
                    it = iter(got)
                    made += [None if x is None else next(it, None) for x in part]
                except Exception:  # one bad call costs its batch only
                    made += [None] * len(part)
            yield f.assign(**{out: pd.Series(made, index=f.index, dtype=object)})[[*names, out]]

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string")


def judged(scores: Column, least: float = 0.0, most: float = 1.0) -> Column:
    """A judge's number within bounds, null as 0."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(scores.cast("double"), F.lit(0.0))))
