"""Packing and cutting texts in order. Each text is a row, so these run where it is read, without a shuffle; only folds
over several rows (near copies within a parent, pages of a file) are grouped."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STOP = re.compile(r"([.!?])\s+")


def tokens(s: str) -> int:
    return max(1, len(s) // 4)


def sentences(text: str, most: int) -> list[str]:
    """Sentences without white space at their ends, longer ones cut hard at `most` tokens."""
    out = []
    for s in _STOP.sub("\\1\x01", text).split("\x01"):
        s = s.strip()
        out += [s[i : i + 4 * most] for i in range(0, len(s), 4 * most)]
    return out


def pack(text: str, size: int, overlap: int, least: int, longest: int = 512) -> list[str]:
    """Sentences put together greedily up to `size` tokens; a piece begins with the last sentences of the one before, up to
    `overlap` tokens, and is dropped below `least`."""
    pieces: list[list[str]] = []
    now: list[str] = []
    n = 0
    for s in sentences(text, longest):
        t = tokens(s)
        if now and n + t > size:
            pieces.append(now)
            kept: list[str] = []
            k = 0
            for p in reversed(now):
                if k + tokens(p) > overlap:
                    break
                kept.insert(0, p)
                k += tokens(p)
            now, n = kept, k
        now = [*now, s]
        n += t
    pieces.append(now)
    return [b for b in (" ".join(p).strip() for p in pieces if p) if tokens(b) >= least]


def windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Pieces of at most `size` characters that end at a sentence where there is one, with their begins; the next piece
    begins `overlap` characters before the end of the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            stop = max(text.rfind(". ", at + overlap + 1, end), text.rfind("\n", at + overlap + 1, end))
            end = stop + 1 if stop > at else end
        out.append((at, text[at:end]))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def rows_from_text(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]], name: str = "piece") -> DataFrame:
    """(key, place, piece) of what `cut` makes of every text; null and empty texts make nothing."""
    src = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, out = [], [], []
            for r, s in enumerate(batch.column(1).to_pylist()):
                for i, p in enumerate(cut(s) if s else ()):
                    rows.append(r)
                    place.append(i)
                    out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(place, pa.int32()), pa.array(out, pa.string())], names=[key, "place", name])

    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, place int, {name} string")


def parents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1600, least: int = 30) -> DataFrame:
    return rows_from_text(df, key, text, lambda s: pack(s, size, 0, least))


def children(df: DataFrame, key: str = "id", text: str = "text", size: int = 400, overlap: int = 40, least: int = 60) -> DataFrame:
    return rows_from_text(df, key, text, lambda s: pack(s, size, overlap, least))


_COMPOUND = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_:][A-Za-z0-9]+)+|[A-Za-z]{2,}[0-9]+[A-Za-z0-9]*")
_PLAIN = re.compile("[a-z0-9]{2,}")


def token_set(s: str) -> frozenset[str]:
    low = {m.group().lower() for m in _COMPOUND.finditer(s)}
    return frozenset(low | set(_PLAIN.findall(s.lower())))


def near_copies_dropped(df: DataFrame, group: str, order: str, key: str, text: str, window: int = 30, most: float = 0.95) -> DataFrame:
    """(group, key) of rows that are no near copy of any of the last `window` accepted ones of their group, in order. What
    is accepted depends on what was before, so a group is folded by one task; group by something small (the parent, not
    the file). Rows of a null group are each kept."""
    src = df.select(group, order, key, text)
    kind = src.schema

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(order, "ascending"), (key, "ascending")])
        kept: list[int] = []
        seen: list[frozenset[str]] = []
        for i, s in enumerate(t.column(text).to_pylist()):
            mine = token_set(s or "")
            if not any(mine and x and len(mine & x) >= most * len(mine | x) for x in seen[-window:]):
                kept.append(i)
                seen.append(mine)
        return t.select([group, key]).take(pa.array(kept, pa.int32()))

    schema = f"`{group}` {kind[group].dataType.simpleString()}, `{key}` {kind[key].dataType.simpleString()}"
    return src.where(F.col(group).isNotNull()).groupBy(group).applyInArrow(fold, schema).unionByName(src.where(F.col(group).isNull()).select(group, key))


def page_groups(df: DataFrame, doc: str, page: str, size: str, most: int, overlap: int = 1) -> DataFrame:
    """(doc, part, first_page, last_page): pages put together up to about `most` tokens, each part with the last `overlap`
    pages of the one before. A document's pages (numbers and sizes only) are folded by one task."""
    src = df.select(doc, F.col(page).cast("int").alias("page"), F.col(size).cast("long").alias("n"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("page")
        pages, sizes = t.column("page").to_pylist(), t.column("n").to_pylist()
        total = sum(sizes)
        parts: list[tuple[int, int]] = []
        if total <= most:
            parts.append((pages[0], pages[-1]))
        else:
            share = -(-(total / -(-total // most) + most) // 2)
            first, n = 0, 0
            for i, k in enumerate(sizes):
                if n + k > share and i > first:
                    parts.append((pages[first], pages[i - 1]))
                    first = max(i - overlap, 0)
                    n = sum(sizes[first:i])
                n += k
            parts.append((pages[first], pages[-1]))
        name = t.column(doc)[0].as_py()
        return pa.table({doc: pa.array([name] * len(parts), t.column(doc).type), "part": pa.array(range(len(parts)), pa.int32()), "first_page": pa.array([a for a, _ in parts], pa.int32()), "last_page": pa.array([b for _, b in parts], pa.int32())})

    return src.where(f"`{doc}` IS NOT NULL AND page IS NOT NULL").groupBy(doc).applyInArrow(fold, f"`{doc}` {src.schema[doc].dataType.simpleString()}, part int, first_page int, last_page int")
