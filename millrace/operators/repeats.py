"""Texts that run into repetitions: a unit that follows itself many times, or a line that makes most of the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _runs(period: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, lengths) of the runs of places where `period` is true, for texts that equal themselves p characters on."""
    d = np.diff(np.concatenate([[0], period.view(np.int8), [0]]))
    a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return a, b - a + p


def first_repeat(s: str, unit: int = 10, times: int = 10) -> tuple[int, int] | None:
    """(begin, length of the unit) of the first place from which a unit of at least `unit` characters stands `times` times
    in a row, with the shortest such unit; None without one. Texts and units may have any length.

    Short periods are compared with the text shifted by them. For longer ones windows of doubling length are hashed: where a
    text has a period p, every window longer than p was last seen p before, so the periods to compare are few."""
    n = len(s)
    if n < unit * times:
        return None
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    best: tuple[int, int] | None = None

    def look(p: int) -> None:
        nonlocal best
        u = -(-unit // p) * p
        if n < u * times:
            return
        a, size = _runs(c[:-p] == c[p:], p)
        ok = np.flatnonzero(size >= u * times)
        if len(ok):
            found = (int(a[ok[0]]), u)
            if best is None or found < best:
                best = found

    for p in range(1, unit):
        look(p)
    power, h = np.uint64(0x9E3779B97F4A7C15), c.astype(np.uint64) + np.uint64(1)
    size = 1
    with np.errstate(over="ignore"):
        while size < 2 * unit:  # windows of the first length, by doubling
            h = h[: len(h) - size] * power + h[size:] if len(h) > size else h[:0]
            power, size = power * power, size * 2
        low = unit
        while low * times <= n and len(h):
            # windows of `size` characters, longer than the periods from `low` to below `size`
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            back = np.zeros(len(h), np.int64)
            back[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
            # a period leaves one distance at many places in a row
            step = np.flatnonzero(np.diff(back) != 0) + 1
            begins, ends = np.concatenate([[0], step]), np.concatenate([step, [len(back)]])
            p = back[begins]
            long = (p >= low) & (p < size) & (ends - begins >= p * (times - 1) - size)
            for q in np.unique(p[long]):
                look(int(q))
            low = size
            h = h[: len(h) - size] * power + h[size:] if len(h) > size else h[:0]
            power, size = power * power, size * 2
    return best


def dominant_line(s: str, least: int = 10, share: float = 0.8, run: int = 3) -> str:
    """If the most frequent line (blank ones aside; of equal ones the first) stands at least `least` times and makes `share`
    of the lines, the text ends with the first of `run` of it in a row; lines stay as they are."""
    lines = s.split("\n")
    kept = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    if len(kept) < least:
        return s
    line, n = Counter(x for _, x in kept).most_common(1)[0]
    if n < least or n < share * len(kept):
        return s
    for k in range(len(kept) - run + 1):
        if all(x == line for _, x in kept[k : k + run]):
            return "\n".join(lines[: kept[k][0] + 1])
    return s


def without_repeats(s: str | None, unit: int = 10, times: int = 10) -> str | None:
    """The text up to and with the first unit that stands `times` times in a row; other texts as they are."""
    if not s or not s.strip():
        return s
    t = s.strip()
    at = first_repeat(t, unit, times) if len(t) >= unit * times else None
    return t[: at[0] + at[1]] if at else s


def _map(df: DataFrame, column: str, f) -> DataFrame:
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array(map(f, cols[at].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def truncate_repeats(df: DataFrame, column: str = "text") -> DataFrame:
    """`column` by `without_repeats`; null and empty texts stay, other columns pass through."""
    return _map(df, column, without_repeats)


def cut_dominant_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """`column` by `dominant_line`; null and empty texts stay, other columns pass through."""
    return _map(df, column, lambda s: dominant_line(s) if s else s)
