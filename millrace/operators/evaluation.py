"""Comparing answers and systems: surface metrics, paired bootstrap, breakdowns, alignment of values."""

from __future__ import annotations

import difflib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_WORD = re.compile(r"[a-z0-9]+")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of cells as the bits of one number."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, 0
    for w in b:
        m = where.get(w, 0)
        x = row | m
        row = x & ((x - (row << 1 | 1)) ^ x) & full
    return row.bit_count()


def bleu4(answer: str, reference: str) -> float:
    """Sentence BLEU of four-grams with the standard brevity penalty; an order without a match counts half a match of half
    of the last (exponential smoothing). From the published definition; not the reference library's tokens."""
    a, r = re.findall(r"\w+|[^\w\s]", answer), re.findall(r"\w+|[^\w\s]", reference)
    if not a or not r:
        return 0.0
    logs, smooth = 0.0, 1.0
    for n in range(1, 5):
        x, y = Counter(zip(*(a[i:] for i in range(n)))), Counter(zip(*(r[i:] for i in range(n))))
        total = max(1, sum(x.values()))
        hit = sum((x & y).values())
        if not hit:
            smooth *= 2
            hit = 1 / smooth
        logs += math.log(hit / total) / 4
    return 100 * min(1.0, math.exp(1 - len(r) / len(a))) * math.exp(logs)


def rouge(answer: str, reference: str) -> tuple[float, float]:
    """ROUGE-1 and ROUGE-L, F measure, over lower-case words of ASCII letters and digits, without a stemmer."""
    a, r = _WORD.findall(answer.lower()), _WORD.findall(reference.lower())
    if not a or not r:
        return 0.0, 0.0
    f = lambda hit: 2 * hit / (len(a) + len(r))
    return f(sum((Counter(a) & Counter(r)).values())), f(lcs(a, r))


def surface_metrics(df: DataFrame, keep: tuple[str, ...], answer: str, reference: str) -> DataFrame:
    """keep, bleu4, rouge1, rouge_l of every row; a null or empty side gives zeros. No shuffle."""
    src = df.select(*keep, answer, reference)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, r1, rl = [], [], []
            for a, r in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                b.append(bleu4(a or "", r or ""))
                x, y = rouge(a or "", r or "")
                r1.append(x)
                rl.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(c, pa.float64()) for c in (b, r1, rl))], names=[*keep, "bleu4", "rouge1", "rouge_l"])

    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{schema}, bleu4 double, rouge1 double, rouge_l double")


#: Cumulated chances of 0, 1, 2, ... of a Poisson count of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _uniform(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 by mixing the bits of a key and a counter."""
    with np.errstate(over="ignore"):
        x = key ^ (n + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
        x ^= x >> np.uint64(33)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def bootstrap(deltas: DataFrame, value: str = "delta", key: str | None = None, rounds: int = 10_000, alpha: float = 0.05, seed: int = 12345) -> DataFrame:
    """(n, mean, low, high, winner): a confidence interval of the mean of paired differences.

    Every row weighs in each round by a Poisson count of mean 1, which resampling with replacement tends to; rounds are
    sums, so a batch hands on its sums and no task holds all rows (unlike drawing indices). The counts follow from `key` (a
    column that tells rows apart; without one from a running number of the partition), so with a key the result is the
    same however rows are parted. Nulls are left out."""
    own = F.xxhash64(key) if key else F.monotonically_increasing_id()
    src = deltas.select(F.col(value).cast("double").alias("d"), own.alias("k")).where("d IS NOT NULL AND NOT isnan(d)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            d, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a in range(0, len(d), 256):
                # a row's draws follow from its key and the round alone, by a counter-based generator
                u = _uniform(k[a : a + 256].astype(np.int64).view(np.uint64)[:, None] + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)), np.arange(rounds, dtype=np.uint64)[None, :])
                x = np.searchsorted(_POISSON, u.ravel(), "right").reshape(u.shape)
                s += d[a : a + 256] @ x
                w += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds), pa.int32()), pa.array(s), pa.array(w)], names=["round", "s", "w"])

    means = src.mapInArrow(run, "round int, s double, w double").groupBy("round").agg((F.sum("s") / F.sum("w")).alias("m")).where("m IS NOT NULL")
    ci = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return src.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean")).crossJoin(ci).withColumn("winner", F.when(F.col("low") > 0, "first").when(F.col("high") < 0, "second").otherwise("tie"))


def value_status(path: Column, gold: Column, got: Column, most: float = 0.85) -> Column:
    """MATCH, NEAR_MATCH, MISMATCH or MISSING_VALUE. Numbers and identifiers must be equal; phrases may be near."""
    del path
    a, b = X.loose_value(gold), X.loose_value(got)
    na, nb = X.numeric_value(gold), X.numeric_value(got)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    wa, wb = words(gold), words(got)
    jac = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))
    text = (X.value_kind(gold) == "text") & (X.value_kind(got) == "text")
    return (
        F.when(got.isNull() | (X.strip(got) == ""), "MISSING_VALUE")
        .when((X.strict_value(gold) == X.strict_value(got)) | ((a == b) & (a != "")), "MATCH")
        .when(na.isNotNull() & nb.isNotNull(), F.when(na == nb, "MATCH").otherwise("MISMATCH"))
        .when(text & ((jac >= most) | F.contains(X.strict_value(gold), X.strict_value(got))), "NEAR_MATCH")
        .otherwise("MISMATCH")
    )


def fuzzy(snippet: str, text: str, threshold: float = 0.8) -> bool:
    """Whether a snippet is in a text, or nearly: as it is, without blanks or pipes, or by the similarity of a sliding
    window (difflib's ratio); a text of 80 characters or more may also be in the snippet."""
    s, t = snippet.lower(), text.lower()
    flat = lambda x: re.sub(r"[\s|]+", "", x)

    def slides(x: str, y: str) -> bool:
        if not x:
            return False
        if len(x) > len(y):
            return difflib.SequenceMatcher(None, x, y).ratio() >= threshold
        step = max(1, len(x) // 4)
        m = difflib.SequenceMatcher(None)
        m.set_seq2(x)
        for i in range(0, len(y) - len(x) + 1, step):
            m.set_seq1(y[i : i + len(x) + step])
            if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                return True
        return False

    if not s:
        return False
    if s in t or (flat(s) and flat(s) in flat(t)) or slides(s, t):
        return True
    return len(t) >= 80 and len(t) < len(s) and (t in s or flat(t) in flat(s) or slides(t, s))


_FENCE = re.compile(r"^```(?:json)?\s*(.*?)\s*```$", re.S)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, as text: what the text or its fence is, or else from the first brace to
    the one that closes it, braces in strings and escaped signs aside; null if that is no JSON object."""
    if not text:
        return None
    if m := _FENCE.match(text.strip()):
        text = m.group(1)

    def parsed(s: str) -> str | None | bool:
        try:
            return s if isinstance(json.loads(s), dict) else None
        except (ValueError, RecursionError):
            return False

    if (out := parsed(text)) is not False:
        return out
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted = 0, False
    for m in re.finditer(r'\\.|["{}]', text[start:], re.S):
        c = m.group()
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return parsed(text[start : start + m.end()]) or None
    return None


def first_objects(df: DataFrame, keep: tuple[str, ...], text: str, out: str = "object") -> DataFrame:
    """keep and the first balanced JSON object of `text`; see `first_object`."""
    src = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(first_object, batch.column(len(keep)).to_pylist()), pa.string())], names=[*keep, out])

    return src.mapInArrow(run, ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` string")


def semantic_first(df: DataFrame, by: str, order: str, vector: str = "vector", least: float = 0.85) -> DataFrame:
    """The rows that a pass over each group `by`, in `order`, keeps: a row whose vector has a cosine of `least` or more with
    one kept before is dropped. Null and zero vectors are like nothing and kept.

    Rows are hashed by group, sorted and streamed; a task holds the vectors it has kept of the current group. The rule is
    sequential within a group, so a group is one task's work."""
    src = df.repartition(by).sortWithinPartitions(by, order)
    at, vec = df.columns.index(by), df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, n = None, np.zeros((0, 0)), 0
        for batch in batches:
            keep = []
            for r, (g, v) in enumerate(zip(batch.column(at).to_pylist(), batch.column(vec).to_pylist())):
                if g != group:
                    group, kept, n = g, np.zeros((0, 0)), 0
                x = np.array(v or (), float)
                norm = np.linalg.norm(x)
                if norm > 0 and np.isfinite(norm):
                    x = x / norm
                    if n and kept.shape[1] == len(x) and (kept[:n] @ x).max() >= least:
                        continue
                    if n == len(kept) or kept.shape[1] != len(x):
                        bigger = np.zeros((max(64, 2 * n), len(x)))
                        if kept.shape[1] == len(x):
                            bigger[:n] = kept[:n]
                        kept = bigger
                    kept[n] = x
                    n += 1
                keep.append(r)
            yield batch.take(pa.array(keep, pa.int64()))

    return src.mapInArrow(run, df.schema)


def rerank(pool: DataFrame, scorer, k: int, query: str = "query", text: str = "text", hop: str = "hop_index", evidence: str = "evidence", keys: tuple[str, ...] = ("query_id",), item: str = "item_id") -> DataFrame:
    """The pool with `rerank_score` and its best `k` of each of `keys` by it (`place`, equal ones by item). Items of later
    hops (`hop` of 1 and more) are scored against the query followed by the evidence of the hop before, if there is any."""
    bridge = F.concat(F.col(query), F.lit("\n\nBridge evidence from prior step:\n"), F.col(evidence))
    asked = F.when((F.col(hop) >= 1) & (F.coalesce(F.col(evidence), F.lit("")) != ""), bridge).otherwise(F.col(query))
    t = scorer.score(pool.withColumn("_asked", asked), "_asked", text).withColumnRenamed("score", "rerank_score").drop("_asked")
    w = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), item)
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


_COMMON = frozenset("the and for via with that from this not are shall release document specification requirements note used".split())


def miss_kind(context: str, retrieved: list[tuple[str, str]], pool: list[tuple[str, str]], matches=None) -> str:
    """Why a context was missed: wrong_chunk if a retrieved chunk (text, file) matches it nearly, or its first words name a
    retrieved file; if a chunk of the pool behind does, wrong_chunk with its file among the retrieved ones and else
    below_cutoff; wrong_doc otherwise."""
    matches = matches or fuzzy
    stem = lambda f: re.sub(r"\.[^.]*$", "", f or "")
    if any(t and matches(context, t) for t, _ in retrieved):
        return "wrong_chunk"
    words = {w.lower() for w in re.findall("[A-Za-z0-9]{3,}", context[:200])} - _COMMON
    if words and any(sum(w in stem(f).lower() for w in words) >= max(1, len(words) // 3) for _, f in retrieved):
        return "wrong_chunk"
    for t, f in pool:
        if t and matches(context, t):
            return "wrong_chunk" if stem(f) in {stem(g) for _, g in retrieved} else "below_cutoff"
    return "wrong_doc"


def miss_kinds(df: DataFrame, keep: tuple[str, ...], context: str, retrieved: str, pool: str) -> DataFrame:
    """keep and `kind` of rows with a missed context and the lists of structs (text, filename) retrieved and behind them."""
    src = df.select(*keep, context, retrieved, pool)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[[(x["text"], x["filename"]) for x in v or () if x] for v in batch.column(i).to_pylist()] for i in (k + 1, k + 2)]
            out = [miss_kind(c or "", a, b) for c, a, b in zip(batch.column(k).to_pylist(), *lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], names=[*keep, "kind"])

    return src.mapInArrow(run, ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", kind string")


def fuzzy_pairs(df: DataFrame, keep: tuple[str, ...], snippet: str, text: str, threshold: float = 0.8) -> DataFrame:
    """keep and `matched` for pairs already joined by an equal key; null on either side does not match."""
    src = df.select(*keep, snippet, text)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [bool(s and t) and fuzzy(s, t, threshold) for s, t in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.bool_())], names=[*keep, "matched"])

    return src.mapInArrow(run, ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", matched boolean")
