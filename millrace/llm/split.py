"""Cutting oversized texts at natural boundaries, each piece repeating the end of the one before.

Method: dynamic programming over the boundary positions of a text. Each boundary has a cut penalty (paragraph, line,
sentence, word, bare character); the chosen cuts minimise the sum of penalties and of the squared deviations of the
pieces' sizes from an even division, among all cuts that keep every piece with its overlap within the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cut penalties, best boundary first: paragraph, line, sentence, word, bare character.
PENALTY = {"paragraph": 0.0, "line": 0.3, "sentence": 0.6, "word": 4.0, "character": 16.0}
PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*")
LINE = re.compile(r"(?:\r\n?|\n)[ \t]*")
SENTENCE = re.compile(r"(?:[.!?…][\"'”’»)\]]*(?=\s)|[。！？][」』”]*)\s*")
WORD = re.compile(r"\s+")


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where `text` may be cut, ascending, its end last, and their penalties. Between two natural boundaries
    further apart than `room` come word ends, and where these are too far apart, characters."""
    best: dict[int, float] = {}
    for kind, pattern in (("paragraph", PARAGRAPH), ("line", LINE), ("sentence", SENTENCE)):
        for m in pattern.finditer(text):
            if m.end() not in best:
                best[m.end()] = PENALTY[kind]
    best.pop(0, None)
    best[len(text)] = 0.0

    def fill(penalty: float, between) -> None:
        at = [0, *sorted(best)]
        for a, b in zip(at, at[1:]):
            if b - a > room:
                for p in between(a, b):
                    best.setdefault(p, penalty)

    fill(PENALTY["word"], lambda a, b: [m.end() for m in WORD.finditer(text, a + 1, b)])
    step = max(1, room // 8)

    def characters(a: int, b: int) -> list[int]:
        out = []
        for p in range(a + step, b, step):
            while p > a + 1 and (unicodedata.combining(text[p]) or text[p] == "‍" or text[p - 1] == "‍"):
                p -= 1  # not inside what is read as one character
            out.append(p)
        return out

    fill(PENALTY["character"], characters)
    # marks that were stepped over may leave a gap that is still too wide
    at = [0, *sorted(best)]
    for a, b in zip(at, at[1:]):
        for p in range(a + room, b, room):
            best[p] = PENALTY["character"]
    pos = np.array(sorted(best), np.int64)
    return pos, np.array([best[p] for p in pos.tolist()])


def cuts(text: str, limit: int, overlap: int, balance: float = 2.0) -> list[tuple[int, int, int]]:
    """(start with overlap, start of what is new, end) of the pieces of `text`; one piece if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    room = limit - overlap
    pos, pen = boundaries(text, room)
    at = np.concatenate([[0], pos])
    target = n / -(-n // room)
    cost = np.full(len(at), np.inf)
    cost[0] = 0.0
    back = np.zeros(len(at), np.int64)
    low = np.searchsorted(at, at - room)
    for j in range(1, len(at)):
        i = low[j]
        sizes = at[j] - at[i:j]
        c = cost[i:j] + balance * ((sizes - target) / target) ** 2
        k = int(np.argmin(c))
        cost[j], back[j] = c[k] + pen[j - 1], i + k
    ends, j = [], len(at) - 1
    while j:
        ends.append(j)
        j = int(back[j])
    out, start = [], 0
    for j in reversed(ends):
        end = int(at[j])
        over = start
        if start and overlap:
            # the repeated end begins at a boundary if there is one among its characters, else at a word
            first = max(0, start - overlap)
            i = int(np.searchsorted(at, first))
            if at[i] < start:
                over = int(at[i])
            else:
                m = WORD.search(text, first, start)
                over = m.end() if m and m.end() < start else first
                while over < start and unicodedata.combining(text[over]):
                    over += 1
        out.append((over, start, end))
        start = end
    return out


def split_oversized(
    df: DataFrame, limit: int, overlap: int = 160, text: str = "text", keep: tuple[str, ...] = ("chunk_kind", "chunk_id")
) -> DataFrame:
    """One row per piece: `keep`, piece_index, n_pieces, begin, new_from, end (code points of the text) and piece.

    text[new_from:end] of all pieces put together is the text; text[begin:new_from] repeats at most `overlap` characters.
    A text within the limit, the empty one included, is its own only piece; a null text has none. Rows of one key are
    split one by one: drop repeated deliveries before. Only longer texts reach Python, and nothing is shuffled."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    src = df.select(*keep, F.col(text).alias("_text"))
    size = F.length("_text")
    one = src.where(size <= limit).select(
        *keep, F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin"), F.lit(0).alias("new_from"), size.alias("end"), F.col("_text").alias("piece")
    )
    ints = ("piece_index", "n_pieces", "begin", "new_from", "end")
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(c, T.IntegerType()) for c in ints] + [T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, cells, pieces = [], [], []
                for r, s in enumerate(part.column(len(keep)).to_pylist()):
                    found = cuts(s, limit, overlap)
                    for k, (begin, new, end) in enumerate(found):
                        rows.append(r)
                        cells.append((k, len(found), begin, new, end))
                        pieces.append(s[begin:end])
                take = pa.array(rows, pa.int32())
                grid = np.array(cells, np.int32).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(take) for i in range(len(keep))), *(pa.array(grid[:, i]) for i in range(5)), pa.array(pieces, pa.string())], names=[*keep, *ints, "piece"]
                )

    return one.unionByName(src.where(size > limit).mapInArrow(run, schema))
