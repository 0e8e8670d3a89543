"""Encoding and decoding with a public byte-level BPE vocabulary.

Method: a streaming transducer. For every prefix of a byte string the last token of its BPE encoding is determined by
one earlier prefix: token t ends prefix i if t is one of the bytes before i, and the last token of the prefix before t
may stand left of t (no merge crosses the border, see `Bpe.fits`). No later byte changes that, so one pass over the
bytes gives the last token of every prefix. What is still open is only which prefixes the final encoding uses: a token
is emitted once the chains of all prefixes that a later token can start from (as many as the longest token that the
merges make has bytes: the sufficient lookahead) share it. Memory is thus that of the bytes not yet emitted. A text is fed in
parts that end before white space, where the published pattern always begins a new piece.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What the published split pattern calls white space (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the published split pattern, once for any text and once for text of ASCII characters only.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Characters of a text that are taken at a time.
PART = 65_536
_BORDER = re.compile(rf"[{SPACE}](?=[^{SPACE}])")
#: Pieces kept in a worker's memo. It bounds memory only: a piece that isn't there is encoded again.
MEMO = 400_000


def _byte_of_char() -> dict[str, int]:
    """The published printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A merge list, and the transducer over it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        self.id_of = vocab
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[raw(a)], vocab[raw(b)]
            t = vocab[raw(a) + raw(b)]
            self.merge[x, y] = (rank, t)
            if t not in self.parts:
                self.parts[t], self.born[t] = (x, y), rank
        # the sufficient lookahead of the merge list: a token that merges don't make never stands in an encoding
        self.lookahead = max((len(self.bytes_of[t]) for t in self.parts), default=1)
        self._fits: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._whole: dict[int, bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}

    def _spine(self, t: int, side: int, memo: dict) -> list[tuple[int, float]]:
        """The tokens at one side of t's merge tree from the byte up, each with the rank at which it is merged away."""
        out = memo.get(t)
        if out is None:
            x, until, up = t, float("inf"), []
            while True:
                up.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.born[x], self.parts[x][side]
            out = memo[t] = up[::-1]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when the bytes of a and b stand side by side."""
        key = (a, b)
        if (ok := self._fits.get(key)) is None:
            if len(self._fits) > 4 * MEMO:
                self._fits.clear()
            left, right = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
            i = j = 0
            ok = True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                m = self.merge.get((x, y))
                # of equal merges the left one comes first: one inside a before the border's, the border's before one inside b
                if m is not None and m[0] < x_until and m[0] <= y_until:
                    ok = False
                    break
                if x_until <= y_until:
                    if x_until == float("inf"):
                        break
                    i += 1
                else:
                    j += 1
            self._fits[key] = ok
        return ok

    def whole(self, t: int) -> bool:
        """Whether the merges make t out of its own bytes (an added token is not made by any)."""
        if (ok := self._whole.get(t)) is None:
            b = self.bytes_of[t]
            ok = self._whole[t] = len(b) == 1 or self.merged(b) == [t]
        return ok

    def merged(self, b: bytes) -> list[int]:
        """The textbook loop: join the pair of lowest rank, leftmost first, until none is left."""
        at = [self.id_of[b[i : i + 1]] for i in range(len(b))]
        while True:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(at, at[1:])) if p in self.merge), default=None)
            if best is None:
                return at
            i = best[1]
            at[i : i + 2] = [self.merge[at[i], at[i + 1]][1]]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece, whose bytes may come in parts of any size; emits each as soon as it is certain."""
        buf, last, ahead = bytearray(), [(-1, 0)], self.lookahead
        get, fits, whole = self.id_of.get, self.fits, self.whole
        for part in data:
            for k in range(0, len(part), 1024):
                start = len(buf)
                buf += part[k : k + 1024]
                view = bytes(buf)
                for i in range(start + 1, len(view) + 1):
                    for n in range(min(i, ahead), 0, -1):
                        t = get(view[i - n : i])
                        if t is not None and last[i - n] is not None:
                            before = last[i - n][0]
                            if (before < 0 or fits(before, t)) and whole(t):
                                last.append((t, i - n))
                                break
                    else:
                        raise ValueError("a byte that the vocabulary has no token for")
                if len(view) > 4 * ahead:
                    stable = self._meet(last, range(max(0, len(view) - ahead + 1), len(view) + 1))
                    if stable > 0:
                        yield from self._chain(last, stable)
                        # what is left keeps its last tokens; the border's token stays as the left context
                        context = last[stable][0]
                        last = [(context, 0), *((t, s - stable) if s >= stable else None for t, s in (x or (0, -1) for x in last[stable + 1 :]))]
                        buf = bytearray(view[stable:])
        yield from self._chain(last, len(buf))

    @staticmethod
    def _meet(last: list, ends: range) -> int:
        """The latest position that lies on the chains of all of these ends."""
        at = {e for e in ends if last[e] is not None}
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            at.add(last[far][1])
        return at.pop()

    @staticmethod
    def _chain(last: list, end: int) -> list[int]:
        out = []
        while end > 0:
            t, end = last[end]
            out.append(t)
        return out[::-1]

    def piece(self, s: str) -> tuple[int, ...]:
        """Ids of one piece of the split pattern."""
        b = s.encode("utf-8")
        t = self.id_of.get(b)
        ids = (t,) if t is not None and self.whole(t) else tuple(self.stream((b,)))
        if len(s) <= 64:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[s] = ids
        return ids

    def ids(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts of any size. What is held is the last run without white space."""
        rest = ""
        for part in parts:
            part = rest + part
            cut = next((m.end() for m in _BORDER.finditer(part[::-1])), 0)  # the last white space behind another character
            cut = len(part) - cut if cut else 0
            yield from self._whole_pieces(part[:cut])
            rest = part[cut:]
        yield from self._whole_pieces(rest)

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART:
            return self._whole_pieces(text)
        return list(self.ids(text[a : a + PART] for a in range(0, len(text), PART)))

    def _whole_pieces(self, text: str) -> list[int]:
        memo, piece = self._memo, self.piece
        split = ASCII_PATTERN if text.isascii() else PATTERN
        out: list[int] = []
        found = split.findall(text)
        try:
            return list(chain.from_iterable(map(memo.__getitem__, found)))
        except KeyError:
            for s in found:
                out.extend(memo.get(s) or piece(s))
            return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, by a state machine that takes bytes as they come; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(machine.decode(self.bytes_of[i]) for i in ids if i in self.bytes_of) + machine.decode(b"", True)


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the token ids of `text`, as `array<int>`. A null or empty text gives an empty list; nothing is cut,
    strings of special tokens count as ordinary text, and repeated rows stay. No shuffle: rows are encoded where read."""
    src = df.select(*keep, text)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            # results can be many times a batch: part by part, so that memory follows the part
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [coder.encode(s) if s else [] for s in part.column(len(keep)).to_pylist()]
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
                col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], col], names=[*keep, ids])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the text of the ids; null or empty lists give the empty text, ids unknown to the vocabulary nothing."""
    src = df.select(*keep, ids)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            out = pa.array([coder.decode(x or ()) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], out], names=[*keep, text])

    return src.mapInArrow(run, schema)
