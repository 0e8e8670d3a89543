"""Finding and undoing wrong character decodings.

Method: the characters of a text are mapped back to the bytes of a legacy encoding; an automaton over these bytes (built
from the well-formedness table of UTF-8) marks the maximal well-formed multibyte spans, and only these are decoded again.
This repeats while it finds more, as texts are garbled twice, too. A span counts if what it decodes to is of ordinary
use; spans that correct text might hold by chance (a quote behind an accented letter, say) count only beside surer ones.
The method can't see single-byte encodings taken for each other, which have no multibyte spans. For them the same
mapping back to bytes is read in other single-byte encodings, and the reading is taken that leaves no letter or sign
where none can stand (see `oddness`). Both, and replacement characters, make a text a found one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that UTF-8 bytes are taken for; in the first, bytes without a character stay control characters.
LEGACY = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp1254", "cp1257", "iso8859_2", "iso8859_5", "iso8859_15", "cp1253", "koi8_r", "cp437", "cp850", "cp866")
#: (taken for, really) among the single-byte encodings.
SWAPS = tuple((a, b) for b in ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "koi8_r") for a in ("cp437", "cp850", "mac_roman", "cp1252", "cp1251", "cp1250", "koi8_r", "latin_1") if a != b)
LOST = "�"


@lru_cache(None)
def byte_map(name: str) -> dict[str, int]:
    """The characters of the upper half of a single-byte encoding, with their bytes."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):  # bytes without a character usually pass as control characters
        out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def automaton(name: str) -> re.Pattern:
    """Maximal runs of well-formed multibyte sequences, over the characters that stand for their bytes in `name`."""
    m = byte_map(name)
    def cls(low: int, high: int) -> str:
        cs = "".join(re.escape(c) for c, b in m.items() if low <= b <= high)
        return f"[{cs}]" if cs else "(?!)"

    tail = cls(0x80, 0xBF)
    seqs = (
        cls(0xC2, 0xDF) + tail,
        cls(0xE0, 0xE0) + cls(0xA0, 0xBF) + tail,
        f"(?:{cls(0xE1, 0xEC)}|{cls(0xEE, 0xEF)}){tail}{tail}",
        cls(0xED, 0xED) + cls(0x80, 0x9F) + tail,
        cls(0xF0, 0xF0) + cls(0x90, 0xBF) + tail + tail,
        cls(0xF1, 0xF3) + tail * 3,
        cls(0xF4, 0xF4) + cls(0x80, 0x8F) + tail + tail,
    )
    return re.compile("(?:" + "|".join(seqs) + ")+")


#: Code points of ordinary use: Latin-1, Latin Extended-A, Greek, Cyrillic, Hebrew and Arabic letters, Devanagari, Thai,
#: additional Latin, punctuation to number forms, arrows to dingbats, kana and ideographs, Hangul, full-width forms, emoji.
ORDINARY = ((0xA0, 0x17F), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x300, 0x304), (0x308, 0x30C), (0x370, 0x3FF), (0x400, 0x482), (0x48A, 0x4FF), (0x5D0, 0x5EA), (0x60C, 0x64A), (0x660, 0x6D3), (0x904, 0x97F), (0xE01, 0xE5B),
            (0x1D62, 0x1D6A), (0x1E00, 0x1EF9), (0x2009, 0x203A), (0x2070, 0x209C), (0x20A0, 0x20BF), (0x2100, 0x27BF), (0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF9F), (0x1F300, 0x1FAFF))


@lru_cache(8192)
def ordinary(c: str) -> bool:
    o = ord(c)
    return any(a <= o <= b for a, b in ORDINARY) and unicodedata.category(c) not in ("Cn", "Cc", "Co")


def _ascii_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def surety(text: str, start: int, end: int, out: str, name: str) -> int:
    """2: text garbled for sure; 1: garbled if more of the text is; 0: not."""
    # control characters of the upper half are bytes that were garbled once more; they need another character beside them
    known = [c for c in out if not "\x80" <= c <= "\x9f"]
    if not known or not all(map(ordinary, known)):
        return 0
    lead = text[start]
    before, after = text[start - 1 : start], text[end : end + 1]
    touching = _ascii_letter(before) or _ascii_letter(after)
    if len(out) >= 2 and end - start >= 4:
        # two or more characters of one script (or joined signs) hardly arise by chance
        kinds = {("L" if c.isalpha() and ord(c) < 0x250 else ord(c) >> 8) for c in out}
        return 2 if len(kinds) <= 2 or touching else 1
    c = out[0]
    if end - start >= 3:
        # one sign of three or four bytes; a letter, a no-break space and a quote can look like one ideograph
        return 1 if ord(c) >= 0x3000 and not 0x1F300 <= ord(c) else 2
    if name in ("cp1252", "cp1254", "iso8859_15", "cp1250", "iso8859_2", "cp1257"):
        if byte_map(name).get(lead) in (0xC2, 0xC3):
            return 2
        return 2 if touching and c.isalpha() and _ascii_letter(before) and _ascii_letter(after) else 1
    if name in ("mac_roman", "cp437", "cp850"):
        # signs lead here; before a sign of the same alphabet they are formulas, so a letter must be beside
        if c.isalpha():
            return 2 if touching else 1
        return 2 if byte_map(name).get(lead) == 0xC2 and not lead.isspace() and (name != "mac_roman" or after.isalnum() or before.isalnum()) else 1
    # Cyrillic or Greek letters lead here
    return 2 if c.isalpha() and touching else 1


_RUN = re.compile(r"[^\x00-\x7f]{2,}")


@lru_cache(65536)
def decoded(run: str) -> tuple[tuple[str, tuple[tuple[int, int, str], ...]], ...]:
    """For each encoding that finds any, the well-formed spans of a run of high characters: (start, end, what they are)."""
    found = []
    for name in LEGACY:
        m, spans = byte_map(name), []
        for f in automaton(name).finditer(run):
            try:
                spans.append((f.start(), f.end(), bytes(m[c] for c in f.group()).decode("utf-8")))
            except UnicodeDecodeError:
                continue
        if spans:
            found.append((name, tuple(spans)))
    return tuple(found)


def multibyte(text: str) -> tuple[str, int]:
    """The text with its garbled spans decoded, and how many there were."""
    total = 0
    while True:  # each round leaves fewer characters
        by: dict[str, list[tuple[int, int, str, int]]] = {}
        for run in _RUN.finditer(text):  # a span has two high characters at least
            at = run.start()
            # long runs (texts of another script) are read each time, so that the memo stays small
            for name, spans in (decoded if len(run.group()) <= 64 else decoded.__wrapped__)(run.group()):
                for a, b, out in spans:
                    if level := surety(text, at + a, at + b, out, name):
                        by.setdefault(name, []).append((at + a, at + b, out, level))
        best: tuple[int, str, list] = (0, text, [])
        for name in LEGACY:
            if name in by:
                sure = sum((level == 2) * (b - a) for a, b, _, level in by[name])
                if sure > best[0]:
                    best = (sure, name, [x[:3] for x in by[name]])
        if not best[0]:
            break
        _, name, spans = best
        parts, at = [], 0
        for a, b, out in spans:
            parts += [text[at:a], out]
            at = b
        text = "".join(parts) + text[at:]
        # a no-break space that has become a blank behind its lead byte
        lead = next((c for c, b in byte_map(name).items() if b == 0xC3), None)
        if lead and lead in text:
            text = re.sub(rf"(?<!\w){re.escape(lead)} (?=\s|\w|$)", "à ", text)
        total += len(spans)
    return text, total


#: Signs that stand beside letters or digits in correct text.
BESIDE = set("°µΩ²³¹±§©®™€£¥’‘“”„«»‹›…–—‐‑·•¿¡ªºⁿ½¼¾×÷≈≤≥≠∞√∑π�\xa0\xad​‍﻿′″")
#: Of these, signs that don't stand inside a word of letters.
NOT_INSIDE = set("²³¹±§©£¥½¼¾÷≈≤≥≠∞√∑¿¡„“ªº")
_BOX = re.compile("[─-▟]")


def oddness(text: str) -> int:
    """How many characters stand where correct text has none like them: signs inside words or pressed to letters, letters
    of another alphabet in a Latin word, capitals behind small letters, control characters."""
    odd = 0
    for f in re.finditer(r"[^\x00-\x7f]", text):
        c, i = f.group(), f.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        inside = _ascii_letter(before) and _ascii_letter(after)
        near = _ascii_letter(before) or _ascii_letter(after)
        if "\x80" <= c <= "\x9f":
            odd += 1
        elif c.isalpha():
            latin = ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 or c in "ªº"
            if not latin:
                kana = ord(c) >= 0x2E80
                odd += near and not kana and not (c in "ΩµπΔΣ" and not inside) and (unicodedata.category(c) != "Lm" or (c == "ⁿ" and inside))
            elif c in "ªº":
                odd += inside or (_ascii_letter(after))
            elif c.isupper() and before.islower() and before.isalpha():
                odd += 1
            elif c in "þðÞÐ" and near:
                odd += 1
        elif c in BESIDE:
            if c in NOT_INSIDE:
                odd += inside or (c in "½¼¾³²¹" and _ascii_letter(after)) or (c in "±÷≈≤≥≠" and near) or (c in "“„" and inside)
            elif c in "·":
                odd += near
        elif _BOX.match(c):
            odd += near or before.isdigit() or after.isdigit()
        elif unicodedata.category(c) in ("Sc", "Sk", "Sm", "So", "Po", "Pi", "Pf", "No"):
            odd += inside or (near and unicodedata.category(c) in ("Sk", "Sc", "No"))
    return odd


_HIGH = re.compile(r"(\S*[^\x00-\x7f\s]\S*)")
_COMMON = re.compile(r"[äöüßéèêàáíóúñçâîôûïÄÖÜÉ«»°±µ§]")


def single_byte(text: str, mixed: bool = False) -> tuple[str, int]:
    """The text read in the single-byte encoding that leaves nothing odd, and how many characters that changed; (text, 0)
    if nothing is odd or no reading is better. Of a mixed text, which is right in part, only words that hold something odd
    are read anew."""
    before = oddness(text)
    if not before:
        return text, 0
    if mixed:
        parts = _HIGH.split(text)
        odd = [i for i, w in enumerate(parts) if i % 2 and LOST not in w and oddness(w)]
        if not odd:
            return text, 0
        # with blanks between them, the odd words are a text of their own
        out, n = single_byte(" ".join(parts[i] for i in odd))
        if n:
            for i, w in zip(odd, out.split(" ")):
                parts[i] = w
        return "".join(parts), n
    high = [c for c in text if c > "\x7f"]
    best = (before, 0, text)
    for taken, really in SWAPS:
        m = byte_map(taken)
        if any(c not in m for c in high):
            # only words whose high characters all have bytes can have come from one
            words = {w for w in set(re.findall(r"\S*[^\x00-\x7f]\S*", text)) if all(c in m for c in w if c > "\x7f")}
        else:
            words = None
        try:
            table = {ord(c): bytes([b]).decode(really) for c, b in m.items() if c in set(high)}
        except UnicodeDecodeError:
            continue
        out = text.translate(table) if words is None else re.sub(r"\S*[^\x00-\x7f]\S*", lambda f: f.group().translate(table) if f.group() in words else f.group(), text)
        odd = oddness(out)
        common = len(_COMMON.findall(out))
        if (odd, -common) < (best[0], -best[1]):
            best = (odd, common, out)
    odd, common, out = best
    if out is text or odd > before // 4 or common < sum(a != b for a, b in zip(text, out)) // 2:
        return text, 0
    return out, sum(a != b for a, b in zip(text, out))


def repair(text: str | None) -> tuple[str | None, int, int]:
    """(repaired text, repaired spans or characters, characters lost for good)."""
    if not text or text.isascii():
        return text, 0, 0
    lost = text.count(LOST)
    out, spans = multibyte(text)
    out, more = single_byte(out, bool(spans or lost))
    return out, spans + more, lost


def repair_encoding(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the repaired `text`, `n_repaired` spans and `n_lost` characters, for every row.

    Texts of ASCII only, empty and null ones come out as they are and never reach Python. Rows are treated one by one,
    without a shuffle; other columns are not read."""
    src = df.select(*keep, text)
    other = F.coalesce(F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = src.where(~other).withColumns({"n_repaired": F.lit(0), "n_lost": F.lit(0)})
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(text, T.StringType()), T.StructField("n_repaired", T.IntegerType()), T.StructField("n_lost", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = [repair(s) for s in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=[*keep, text, "n_repaired", "n_lost"]
                )

    return plain.unionByName(src.where(other).mapInArrow(run, schema))
