"""Passages of held-out test items inside training text.

Method: suffix arrays over the training words. A shard of the corpus is a batch of documents. Its words that can be part
of a match (in runs of `least` words whose every pair of neighbours is one of the test side's) are sorted by their whole
suffixes together with the test suffixes that occur there (prefix doubling), which is what a binary search of each test
suffix in the shard's array would find. Suffixes that share `least` words stand in one interval of the array; within it
every document's suffixes have their longest match with a test item at that item's nearest suffix before or behind them,
so a passage that repeats itself costs a neighbour and not a product of its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile("[A-Za-z0-9]+")
#: Characters of test passages that every worker holds; more passages are searched in blocks, a pass over the corpus each.
TEST_CHARS = 64_000_000
#: Documents and characters of a shard (a longer document is a shard of its own), and pairs of a suffix and an item that
#: are looked at in one go; they bound memory and change no result.
SHARD, SHARD_CHARS, PAIRS = 4_096, 16_000_000, 2_000_000


def _hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place; equal words have equal ones."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ words[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Suffixes:
    """The test passages as word ids with zeros between them, the pairs of neighbours they have, and the hashes of the
    first `least` words of their suffixes."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.vocab = least, {}
        seqs = [[self.vocab.setdefault(w.lower(), len(self.vocab) + 1) for w in WORD.findall(p or "")] for _, p in items]
        kept = [(i, s) for (i, _), s in zip(items, seqs) if len(s) >= least]
        self.words = np.array([w for _, s in kept for w in (*s, 0)], np.int64)
        self.item = np.array([i for i, s in kept for _ in range(len(s) + 1)], np.int64)
        self.base = len(self.vocab) + 1
        w = self.words
        self.pairs = np.unique(w[:-1][(w[:-1] > 0) & (w[1:] > 0)] * self.base + w[1:][(w[:-1] > 0) & (w[1:] > 0)]) if len(w) else w
        self.at = np.array([0], np.int64)[:0]
        if len(w):
            zero = np.flatnonzero(w == 0)
            left = zero[np.searchsorted(zero, np.arange(len(w)))] - np.arange(len(w))
            self.at = np.flatnonzero(left >= least)
        h = _hashes(self.words, self.at, least)
        order = np.argsort(h, kind="stable")
        self.hash, self.at_hash = h[order], self.at[order]


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """The places that lie in one of the n-word windows that begin at `at`."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + n, size), -1)
    return np.flatnonzero(np.cumsum(d[:-1]) > 0)


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places sorted by their suffixes, ranks by the first 1, 2, 4, ... words) by prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, h = [rank], 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - h)] = rank[h:] + 1
        code = rank * (n + 1) + nxt
        order = np.argsort(code, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(code[order]) != 0)])
        if (new == rank).all() or new[order[-1]] == n - 1:
            levels.append(new)
            return order, levels
        levels.append(new)
        rank, h = new, h * 2


def common(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words the suffixes at p and q have in common, from the ranks: places differ, and a last word is unique."""
    out = np.zeros(len(p), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        a, b = p + out, q + out
        ok = (a < n) & (b < n)
        same = np.zeros(len(p), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        out += same * (1 << k)
    return out


def _chains(words: np.ndarray, test: Suffixes) -> np.ndarray:
    """Places from which on `least` words follow whose neighbours all are neighbours on the test side."""
    a, b = words[:-1], words[1:]
    link = np.zeros(len(words), bool)
    some = np.flatnonzero((a > 0) & (b > 0))
    link[some[_is_in(a[some] * test.base + b[some], test.pairs)]] = True
    stop = np.flatnonzero(~link)  # the last place is one
    reach = stop[np.searchsorted(stop, np.arange(len(words)))] - np.arange(len(words))
    if test.least == 1:
        return np.flatnonzero(words > 0)
    return np.flatnonzero(reach >= test.least - 1)


def matches(texts: list[str | None], test: Suffixes) -> list[tuple[int, int, int, int]]:
    """(text number, item, words, word position) of the longest match of each text and item, of `least` words at least;
    of equally long ones the first in the text."""
    if not len(test.at):
        return []
    get, least = test.vocab.get, test.least
    seqs, owner = [], []
    for k, s in enumerate(texts):
        if s:
            # the pattern before lower case: a letter that only becomes ASCII by it is no word character
            seq = [get(w, 0) for w in WORD.findall(s.lower())] if s.isascii() else [get(w.lower(), 0) for w in WORD.findall(s)]
            if len(seq) >= least:
                seqs.append(seq)
                owner.append(k)
    if not seqs:
        return []
    sizes = np.array([len(s) + 1 for s in seqs])
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(int(first[-1]), np.int64)
    for s, a in zip(seqs, first):
        words[a : a + len(s)] = s
    at = _chains(words, test)
    h = _hashes(words, at, least)
    hit = _is_in(h, test.hash)
    if not hit.any():
        return []
    # of both sides only the words of windows that the other side may have too
    docs = _covered(at[hit], least, len(words))
    known = np.unique(h[hit])
    tests = _covered(test.at_hash[_is_in(test.hash, known)], least, len(test.words))
    place, said, ends = [], [], []
    for at_, w in ((docs, words), (tests, test.words)):
        cut = np.flatnonzero(np.diff(at_) != 1) + 1
        # a separator behind every run
        place.append(np.insert(at_, np.append(cut, len(at_)), -1))
        said.append(np.insert(w[at_], np.append(cut, len(at_)), 0))
        ends.append(len(place[-1]))
    place, said = np.concatenate(place), np.concatenate(said)
    gap = said == 0
    said[gap] = test.base + np.arange(gap.sum())  # each unlike all others, so no match runs on
    n = len(said)
    order, levels = suffix_array(said)
    lcp = np.concatenate([[0], common(levels, order[:-1], order[1:])])
    group = np.cumsum(lcp < least)
    is_test = order >= ends[0]
    real = ~gap[order]
    # test suffixes by interval and item, in order of the array
    t = np.flatnonzero(is_test & real)
    items, number = np.unique(test.item[place[order[t]]], return_inverse=True)
    key = group[t] * len(items) + number
    by = np.lexsort((t, key))
    t, key = t[by], key[by]
    pair = key * n + t  # sorted: interval and item, then the place in the array
    kinds, begins = np.unique(key, return_index=True)
    of_group = kinds // len(items)
    d = np.flatnonzero(~is_test & real)
    low, high = np.searchsorted(of_group, group[d], "left"), np.searchsorted(of_group, group[d], "right")
    d, low, high = d[high > low], low[high > low], high[high > low]
    best: list[np.ndarray] = []
    counts = high - low
    step = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(d):
        b = max(a + 1, int(np.searchsorted(step, step[a] + PAIRS, "right")) - 1)
        many = counts[a:b]
        who = np.repeat(d[a:b], many)
        kind = np.repeat(low[a:b], many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        k = kinds[kind]
        i = np.searchsorted(pair, k * n + who)
        size = np.zeros(len(who), np.int64)
        for j, ok in ((i - 1, (i > 0) & (key[np.maximum(i - 1, 0)] == k)), (i, (i < len(key)) & (key[np.minimum(i, len(key) - 1)] == k))):
            w = np.flatnonzero(ok)
            size[w] = np.maximum(size[w], common(levels, order[who[w]], order[t[j[w]]]))
        w = np.flatnonzero(size >= least)
        where = place[order[who[w]]]
        doc = np.searchsorted(first, where, "right") - 1
        best.append(_longest(np.stack([doc, k[w] % len(items), size[w], where - first[doc]])))
        a = b
    if not best:
        return []
    doc, item, size, where = _longest(np.concatenate(best, axis=1))
    return list(zip(np.array(owner)[doc].tolist(), items[item].tolist(), size.tolist(), where.tolist()))


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of the columns (document, item, words, place) the longest of each document and item, the first of equal ones."""
    rows = rows[:, np.lexsort((rows[3], -rows[2], rows[1], rows[0]))]
    if not rows.shape[1]:
        return rows
    return rows[:, np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])]


def _shards(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of the shards of a batch."""
    part, at, size = [], 0, 0
    for i, s in enumerate(column.to_pylist()):
        if part and (len(part) >= SHARD or size + len(s or "") > SHARD_CHARS):
            yield at, part
            part, at, size = [], i, 0
        part.append(s)
        size += len(s or "")
    if part:
        yield at, part


def leaked_passages(
    docs: DataFrame, tests: DataFrame, least: int = 12, text: str = "text", key: str = "doc_id", item: str = "item_id", passage: str = "passage", test_chars: int = TEST_CHARS
) -> DataFrame:
    """(key, item, n_words, word_position): every document that holds at least `least` consecutive words of a test item,
    with the longest such match. Words are runs of ASCII letters and digits, compared without case.

    Null, empty and shorter texts or passages match nothing; rows of one key are searched each, so a repeated document
    gives repeated rows, and passages of one item are searched as one. Other columns are not read. Starts one job, over
    the test side only, which is broadcast in blocks of at most about `test_chars` characters, a pass over the corpus
    each; documents are never shuffled."""
    src = docs.select(F.col(key), F.col(text))
    held = tests.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(passage).alias("passage"))
    total = held.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = -(-total // test_chars) or 1
    schema = T.StructType([T.StructField(key, src.schema[key].dataType), T.StructField(item, T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("word_position", T.IntegerType())])
    out = None
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes([(r.item, r.passage) for r in part.collect()], least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, shard in _shards(batch.column(1)):
                    if found := matches(shard, sent.value):
                        rows, items, sizes, places = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([at + r for r in rows], pa.int64())), pa.array(items, pa.int64()), pa.array(sizes, pa.int32()), pa.array(places, pa.int32())], names=[key, item, "n_words", "word_position"]
                        )

        one = src.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage; a null key is kept, as nothing was found under it."""
    return docs.join(leaks.select(key).distinct(), key, "left_anti")
