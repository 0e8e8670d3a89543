"""Dense and sparse similarity, rank fusion and retrieval metrics as DataFrame operators."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Queries that a worker holds at once; more are taken in blocks, a pass over the items each.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def blend(a: Column, b: Column) -> Column:
    """The mean of two vectors at length 1."""
    return unit(F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def clean_vector(a: Column, least: float = 0.05) -> Column:
    """Not finite components as 0; a vector of nearly no length as null."""
    v = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    return F.when(norm(v) >= least, v)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ranked(df: DataFrame, score: str = "score", query: str = "query_id", item: str = "item_id", k: int | None = None, name: str = "rank") -> DataFrame:
    """`rank` of the items of each query, best first and by item on ties; the best `k` if given (only these are shuffled)."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    out = df.withColumn(name, F.row_number().over(w))
    return out if k is None else out.where(F.col(name) <= k)


def cosines(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    nq, nm = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
    return (q / np.where(nq > 0, nq, 1)[:, None]) @ (m / np.where(nm > 0, nm, 1)[:, None]).T


def nearness(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The negative sum of absolute differences."""
    return -np.stack([np.abs(m - x).sum(axis=1) for x in q]) if len(q) else np.zeros((0, len(m)))


def late_interaction(parts: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Vectors taken as `parts` short ones each: for every one of the query the best dot product in the item, summed."""

    def score(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        a, b = q.reshape(len(q), parts, -1), m.reshape(len(m), parts, -1)
        return sum(np.max([a[:, i] @ b[:, j].T for j in range(parts)], axis=0) for i in range(parts))

    return score


def _matrix(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows, their vectors) of an array column: those of `dims` components without a null."""
    keep = [i for i, v in enumerate(col.to_pylist()) if v is not None and len(v) == dims and None not in v] if col.null_count or len(col.flatten()) != dims * len(col) or col.flatten().null_count else range(len(col))
    keep = np.fromiter(keep, np.int64)
    flat = (col if len(keep) == len(col) else col.take(pa.array(keep))).flatten()
    return keep, np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def scored(queries: DataFrame, items: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosines, k: int | None = None, least: float | None = None, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score) of a stated set of queries (query_id, q) against all items (item_id, v), an item with the
    query's id left out: the `k` best of each query by score and item if given, and those of `least` at least.

    Queries are collected in blocks of at most about `block`, one pass over the items each; a task hands on k of each
    query, so items are never shuffled. Null vectors and those of another length than the first query's take no part.
    Starts one job to count the queries and one for each block."""
    spark = queries.sparkSession
    src = items.select("item_id", "v").where(F.col("v").isNotNull() & F.col("item_id").isNotNull())
    kind = src.schema["item_id"].dataType.simpleString()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {kind}, score double"
    mine = queries.select("query_id", "q").where("q IS NOT NULL AND query_id IS NOT NULL")
    blocks = max(1, -(-mine.count() // block))
    out = None
    for b in range(blocks):
        t = (mine if blocks == 1 else mine.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if not t.num_rows:
            continue
        dims = len(t.column("q")[0])
        rows, q = _matrix(t.column("q").combine_chunks(), dims)
        names = t.column("query_id").combine_chunks().take(pa.array(rows))
        ids = np.array(names.to_pylist())

        def run(batches: Iterator[pa.RecordBatch], q=q, ids=ids, names=names, dims=dims) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    keep, m = _matrix(part.column(1), dims)
                    if not len(keep):
                        continue
                    item = np.array(part.column(0).take(pa.array(keep)).to_pylist())
                    s = np.round(measure(q, m), digits)
                    s[ids[:, None] == item[None, :]] = -np.inf
                    bar = np.full((len(q), 1), -np.inf) if k is None or s.shape[1] <= k else np.partition(s, -k, axis=1)[:, -k][:, None]
                    r, c = np.nonzero((s >= bar) & (s > -np.inf) & (True if least is None else s >= least))
                    new = (r, item[c], s[r, c])
                    if k is None:
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(new[0])), pa.array(new[1]).cast(batch.schema.field(0).type), pa.array(new[2])], names=["query_id", "item_id", "score"])
                        continue
                    top = new if top is None else tuple(map(np.concatenate, zip(top, new)))
                    o = np.lexsort((top[1], -top[2], top[0]))
                    r = top[0][o]
                    o = o[np.arange(len(r)) - np.searchsorted(r, r) < k]
                    top = tuple(x[o] for x in top)
            if top is not None and len(top[0]):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(top[0])), pa.array(top[1]).cast(batch.schema.field(0).type), pa.array(top[2])], names=["query_id", "item_id", "score"])

        one = src.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def dense_top(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank) by cosine; see `scored`."""
    return ranked(scored(queries, items, k=k), k=k)


def l1_top(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same by the negative sum of absolute differences."""
    return ranked(scored(queries, items, nearness, k=k), k=k)


def fuse(a: DataFrame, b: DataFrame, wa: float = 0.8, wb: float = 0.2, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, item_id, rank): the full outer join as a union and one grouping,
    which is combined before the shuffle."""
    parts = a.select("query_id", "item_id", (F.lit(wa) / (k + F.col("rank"))).alias("part")).unionByName(b.select("query_id", "item_id", (F.lit(wb) / (k + F.col("rank"))).alias("part")))
    return parts.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), 9).alias("score"))


_COMPOUND = re.compile(X.COMPOUND_JVM)
_PART = re.compile("[a-z0-9]+")


def tokens(text: str) -> list[str]:
    """What `functions.text.identifier_tokens` gives for a text."""
    out = []
    for w in _COMPOUND.findall(text):
        w = w.lower()
        out.append(w)
        out += [p for p in _PART.findall(w) if len(p) > 1]
    return out + [w for w in _PART.findall(_COMPOUND.sub(" ", text).lower()) if len(w) > 1]


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, n, total): how often each token is in a document, and how many tokens that has. Counted within the
    row, so nothing is shuffled; null and empty texts have none."""
    src = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, words, ns, totals = [], [], [], []
                for r, s in enumerate(part.column(1).to_pylist()):
                    if s:
                        c = Counter(tokens(s))
                        rows += [r] * len(c)
                        words += c.keys()
                        ns += c.values()
                        totals += [c.total()] * len(c)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(totals, pa.int32())], names=[key, "token", "n", "total"])

    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, token string, n long, total int")


def inverse_frequencies(rows: DataFrame, total: Column) -> DataFrame:
    """(token, df, idf) with idf = ln((N - df + 0.5) / (df + 0.5) + 1); `rows` has a row per document and token."""
    df = F.count(F.lit(1))
    return rows.groupBy("token").agg(df.alias("df")).withColumn("idf", F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Long (query_id, k, metric, value) from hits (query_id, rank, rel) and relevant (query_id, n_relevant).

    precision and recall at k, all_found, ndcg (ideal: the relevant there are) and ndcg_compat (gains of all hits against
    `n_contexts` ideal ones, which can exceed 1). A query without hits has zeros; one without relevant ones no recall."""
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    gain = F.when(F.col("rel"), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.select("query_id", "rank", "rel", k).where("rank <= k").groupBy("query_id", "k").agg(F.count_if("rel").alias("got"), F.sum(gain).alias("dcg"))
    want = relevant.select("query_id", "n_relevant", k)
    m = want.join(per, ["query_id", "k"], "left").fillna(0, ["got"]).fillna(0.0, ["dcg"])
    ideal = F.reduce(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant").cast("int"), F.col("k")), F.lit(1))), F.lit(0.0), lambda s, j: s + F.log(F.lit(2.0)) / F.log(j + 1.0))
    n = F.col("n_relevant")
    wide = m.select(
        "query_id", "k", (F.col("got") / F.col("k")).alias("precision"), F.when(n > 0, F.col("got") / n).alias("recall"), F.when(n > 0, (F.col("got") >= n).cast("double")).alias("all_found"), F.when(n > 0, F.col("dcg") / ideal).alias("ndcg")
    )
    return wide.unpivot(["query_id", "k"], ["precision", "recall", "all_found", "ndcg"], "metric", "value")


def first_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, first_rank, last_rank, mrr, mrr_last): reciprocal ranks of the first and of the last relevant hit."""
    at = F.when(F.col("rel"), F.col("rank"))
    g = hits.groupBy("query_id").agg(F.min(at).alias("first_rank"), F.max(at).alias("last_rank"))
    return g.select("*", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), F.coalesce(1 / F.col("last_rank"), F.lit(0.0)).alias("mrr_last"))


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, population deviation, minimum, maximum, median and the linear 95th and 99th percentiles, nulls left out."""
    v = F.col(value)
    r = lambda c: F.round(c, 6)
    return df.groupBy(*by).agg(r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"), r(F.median(v)).alias("median"), r(F.percentile(v, F.lit(0.95))).alias("p95"), r(F.percentile(v, F.lit(0.99))).alias("p99"))
