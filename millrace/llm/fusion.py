"""One order from several scores of different scales.

Method: a Markov chain over the items of a list. From an item the walk picks one of the item's scores at random and jumps
to an item that is higher in it, each with the same chance; where none is higher it stays. With a damping share it jumps
anywhere. Items are ordered by their share of the walk's time. Only ranks enter, so no score's range matters. A step of
the power iteration needs no pairs: sorted by one score, the inflow of an item is a prefix sum of mass per higher item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stationary(scores: np.ndarray, damping: float = 0.9, rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Stationary shares of the items, for lists of one length: scores is lists x items x scores, NaN for null."""
    lists, n, m = scores.shape
    valid = ~np.isnan(scores)
    order = np.argsort(np.where(valid, scores, np.inf), axis=1, kind="stable")  # ascending, nulls last
    s = np.take_along_axis(np.where(valid, scores, np.inf), order, axis=1)
    count = valid.sum(axis=1)[:, None, :]
    idx = np.broadcast_to(np.arange(n)[None, :, None], s.shape)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(new, idx, 0), axis=1)  # start of an item's ties
    ends = np.ones(s.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, idx, n)[:, ::-1], axis=1)[:, ::-1]
    ok = np.take_along_axis(valid, order, axis=1)
    higher = np.where(ok, count - 1 - last, 0)
    inverse = np.argsort(order, axis=1, kind="stable")
    own = valid.sum(axis=2)
    pick = np.where(own > 0, 1.0 / np.maximum(own, 1), 0.0)
    x = np.full((lists, n), 1.0 / n)
    for _ in range(rounds):
        mass = np.take_along_axis((x * pick)[:, :, None] * valid, order, axis=1)
        per = np.where(higher > 0, mass / np.maximum(higher, 1), 0.0)
        below = np.concatenate([np.zeros((lists, 1, m)), np.cumsum(per, axis=1)], axis=1)
        inflow = np.where(ok, np.take_along_axis(below, first, axis=1), 0.0) + np.where(ok & (higher == 0), mass, 0.0)
        y = np.take_along_axis(inflow, inverse, axis=1).sum(axis=2)
        y = damping * y
        y += (1.0 - y.sum(axis=1, keepdims=True)) / n  # damping, and what items without any score hold
        if np.abs(y - x).max() < tolerance:
            x = y
            break
        x = y
    return x


def _field(s: str) -> Column:
    return F.transform("_items", lambda x: x[s].cast("double"))


def _beaten(others: Column, s: str) -> Column:
    return F.exists(others, lambda x: F.coalesce(x[s] >= F.col(f"top.{s}"), F.lit(False)))


def rank_walk(df: DataFrame, scores: tuple[str, ...], items: str = "context_chunks", item: str = "source_id", keep: tuple[str, ...] = ("row_id",), damping: float = 0.9) -> DataFrame:
    """(keep, item, the scores, share, position): the items of each row's list in one order, position 1 first.

    Equal shares are ordered by the item's key. A null score is not compared; an item without any score comes by its key
    behind those that are ahead of some other. Null items and items with a null key are left out; a null or empty list
    gives no rows; NaN counts as null. Lists are ordered one by one without a shuffle; drop repeated rows before."""
    src = df.select(*keep, F.filter(F.col(items), lambda x: x.isNotNull() & x[item].isNotNull()).alias("_items")).where(F.size("_items") > 0)
    flat = src.select(*keep, F.transform("_items", lambda x: x[item]).alias("_item"), *(_field(s).alias(s) for s in scores))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(item, T.StringType())] + [T.StructField(s, T.DoubleType()) for s in scores] + [T.StructField("share", T.DoubleType()), T.StructField("position", T.IntegerType())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(k)
            lengths = np.diff(names.offsets.to_numpy())
            starts = names.offsets.to_numpy()[:-1]
            keys = names.values
            raw = [batch.column(k + 1 + j) for j in range(len(scores))]
            cols = [c.values for c in raw]
            base = [c.offsets.to_numpy()[0] - starts[0] for c in raw]
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float)[b:] if b else c.to_numpy(zero_copy_only=False).astype(float) for c, b in zip(cols, base)], axis=1)
            text = np.array(keys.to_pylist(), object)
            rows, at, share, place = [], [], [], []
            for n in np.unique(lengths):
                which = np.flatnonzero(lengths == n)
                step = max(1, 200_000 // int(n))
                for b in range(0, len(which), step):
                    w = which[b : b + step]
                    pos = starts[w][:, None] + np.arange(n)[None, :]
                    x = stationary(values[pos], damping)
                    for r, p, v in zip(w, pos, x):
                        o = sorted(range(n), key=lambda i: (-round(v[i], 10), text[p[i]]))
                        rows += [r] * int(n)
                        at += p[o].tolist()
                        share += v[o].tolist()
                        place += range(1, int(n) + 1)
            rows_a, at_a = pa.array(rows, pa.int32()), np.array(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows_a) for i in range(k)), keys.take(pa.array(at_a)), *(pa.array(values[at_a, j], pa.float64(), from_pandas=True) for j in range(len(scores))), pa.array(share, pa.float64()), pa.array(place, pa.int32())],
                names=[*keep, item, *scores, "share", "position"],
            )

    return flat.mapInArrow(run, schema)


def balanced_leaders(ranked: DataFrame, scores: tuple[str, ...], item: str = "source_id", key: str = "row_id", least: int = 3) -> DataFrame:
    """(key, item): first items of `rank_walk` that are strictly highest in at least `least` scores while another item of
    the list has the larger plain sum (null as 0). The sums and maxima of a list are taken in one grouping by its key."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in scores), F.lit(0.0))
    row = F.struct(F.col("position"), F.col(item).alias("item"), total.alias("total"), *(F.col(s) for s in scores))
    lists = ranked.groupBy(key).agg(F.min(row).alias("top"), F.collect_list(row).alias("all"))
    others = F.filter("all", lambda x: x["position"] > 1)
    ahead = sum(
        (F.when(F.col(f"top.{s}").isNotNull() & ~_beaten(others, s), 1).otherwise(0) for s in scores),
        F.lit(0),
    )
    return lists.where((ahead >= least) & F.exists(others, lambda x: x["total"] > F.col("top.total"))).select(key, F.col("top.item").alias(item))
