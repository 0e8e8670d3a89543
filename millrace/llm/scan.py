"""Noise in text from scanned pages: finding it and repairing the text.

Method. One pass counts the words of all texts and the title-like lines of every file. Frequent words get skip-gram
vectors: a second pass counts the words beside them, and the shifted pointwise mutual information of word and neighbour,
which skip-grams with negative samples factorise, is factorised directly. A rare word is linked to frequent words that
it equals once glyphs that are taken for each other are made one (`folds`); of several the one whose vector agrees best
with the neighbours where the word stands is taken. Running headers are title-like lines that name the file or repeat
in it; page numbers are recognised by their form. What remains is joined into paragraphs.

What goes to every worker is bounded: words enter the dictionary from a share of RARE of all words on, so there are at
most 1 / RARE of them, and vectors are kept for the VECTORS most frequent. Lines per file are never collected; they are
joined by file and line.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Share of all words from which on a word is in the dictionary; it then has at most 1 / RARE words.
RARE = 2e-6
#: Occurrences that a dictionary word has at least, however small the corpus.
LEAST = 5
#: How much more frequent a word must be than its misreading, if that is spelled with letters only, or with other signs.
RATIO, RATIO_SIGNS = 12.0, 2.0
#: Words with vectors, neighbours counted for them, and dimensions.
VECTORS, NEIGHBOURS, DIMENSIONS = 20_000, 1_000, 24
#: Texts of a file in which a title-like line must stand at least to be a running header without naming the file, and
#: their share of the file's texts; files in which the same form of line must stand, and their share of all files.
REPEATS, REPEATED, FORMS = 3, 0.01, 0.01
#: Share of all words from which on a word is so common that a hyphen between two such words may be their own.
COMMON = 2.5e-5

#: Glyph groups that are taken for each other, written as what they are made into.
GLYPHS = {"rn": "m", "vv": "w", "cl": "d", "ii": "u", "li": "h", "ti": "h", "0": "o", "1": "l", "|": "l", "9": "g", "@": "a", "+": "t", "c": "e", "5": "s", "$": "s", "8": "b"}
_SIGNS = re.compile(r"[0-9@+|$]")
_FOLD_A = re.compile("rn|vv|cl|ii|li|ti|[01|9@+c5$8]")
_FOLD_B = re.compile("rn|vv|ii|li|ti|cl(?!i)|[01|9@+c5$8]")
_TOKEN = re.compile(r"[^\W_](?:[\w@+|$]*[^\W_@])?|[@|+$][\w@+|$]*[^\W_]|[^\W_][\w@+|$]*[@+|](?!\w)")
#: Fixed value: hyphen-like marks at a line's end.
HYPHENS = "-­¬‐‑"
_EOL = re.compile(rf"[{HYPHENS}][ \t]*(?:\r\n?|\n)[ \t]*")
_PART = re.compile(r"[^\W\d_][\w@+|$]*")
_LINES = re.compile(r"\r\n?|\n")
_NUMBER = r"[0-9]{1,5}"
#: The words before a page number and between it and the number of pages, as they fold.
_PAGE_WORDS = r"(?:page|pagc|seite|scite|seitc|scitc|pag\.?|página|pagina|blatt|folio|pg\.?|p\.?|s\.?|side|bladzijde)"
_OF = r"(?:/|\||of|0f|von|v0n|de|sur|di|из)"
PAGE = re.compile(rf"^(?:[\[(<–—-]\s*)?(?:{_PAGE_WORDS}\s*)?({_NUMBER})(?:\s*{_OF}\s*({_NUMBER}))?(?:\s*[\])>–—-])?$", re.I)
_GAP = re.compile(r"\s{2,}|\t+")
_SECTION = re.compile(r"^(?:[0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)+)\.?\s+\S")


def fold_a(w: str) -> str:
    return _FOLD_A.sub(lambda m: GLYPHS[m.group()], w.lower())


def fold_signs(w: str) -> str:
    """Single glyphs only: for words in which two glyphs that belong to different letters look like one pair."""
    return "".join(GLYPHS.get(c, c) for c in w.lower())


def folds(w: str) -> tuple[str, ...]:
    """The word with glyphs of one look made one; twice where c, l and i can be read as two pairs."""
    a = fold_a(w)
    if "cli" in w.lower():
        b = _FOLD_B.sub(lambda m: GLYPHS[m.group()], w.lower())
        return (a, b) if a != b else (a,)
    return (a,)


def is_word(t: str) -> bool:
    """Whether a token can be a word: not a number, an identifier or a code."""
    if "_" in t or len(t) < 2:
        return False
    letters = sum(map(str.isalpha, t))
    if letters * 2 < len(t) or re.fullmatch(r"[0-9]+[A-Za-z%µ]{1,3}|0[xX][0-9a-fA-F]+", t):
        return False
    inner = t[1:]
    return inner.islower() or t.isupper() or not any(c.isupper() for c in inner)


def page_number(line: str) -> bool:
    m = PAGE.match(line)
    return bool(m) and not line.endswith(".")


class Line:
    """What a line of its own may be: `page` it is or has a page number, `head` the rest of it, if that looks like a title."""

    __slots__ = ("page", "head")

    def __init__(self, text: str):
        self.page, self.head = False, None
        if not text:
            return
        if len(text) > 120 and sum(w[0].islower() for w in _PART.findall(text[:240])) > 6:
            return  # more small words than a title and a page number have: no long line needs a closer look
        if page_number(text):
            self.page = True
            return
        parts = _GAP.split(text)
        rest = parts
        if len(parts) > 1:
            if page_number(parts[0]):
                self.page, rest = True, parts[1:]
            elif page_number(parts[-1]):
                self.page, rest = True, parts[:-1]
        head = " ".join(rest)
        if title_like(head, len(rest) > 1 or self.page):
            self.head = head
        else:
            self.page = False


def title_like(s: str, spaced: bool) -> bool:
    """No sentence: begins with a capital, ends with no stop, has no identifier, and is all capitals or set apart by signs."""
    if len(s) < 4 or s[-1] in ".:;,!?。" or _SECTION.match(s) or any(c in s for c in "_=`[]{}<>\\"):
        return False
    first = next((c for c in s if c.isalpha()), "")
    if not first or not first.isupper() or s[0] in "-*•|#":
        return False
    ws = re.findall(r"[^\W\d_][\w@+|]*", s)
    if len(ws) < 2:
        return False
    small = sum(w[0].islower() for w in ws)
    return small == 0 or (small <= 2 and (spaced or " - " in s or " | " in s or re.search(r", (?:part|teil|vol)", s, re.I) is not None) and len(ws) <= 10)


def line_key(s: str) -> str:
    """A line as it compares: glyphs made one, numbers and spacing aside."""
    return re.sub(r"[^\w#]+", " ", fold_a(re.sub(r"\b[0-9][0-9.]*\b", "#", s))).strip()


def file_words(filename: str | None) -> list[str]:
    """The words of a file's title: its name up to the release or the extension."""
    name = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", filename or "")
    name = re.sub(r"_[RVrv][0-9].*$", "", name)
    return [fold_a(w) for w in re.findall(r"[^\W_]+", name)]


def names_file(head: str, title: list[str]) -> bool:
    """Whether a title-like line is the file's title, with a few words about the release at most."""
    if not title:
        return False
    ws = re.findall(r"[^\W_]+", head)
    seen = {f for w in ws for f in (fold_a(w), fold_a(fold_signs(w)), fold_signs(w))}
    return all(w in seen or fold_a(fold_signs(w)) in seen for w in title) and len(ws) <= len(title) + 5


def template(head: str, title: list[str]) -> str | None:
    """The line with the file's words taken out, if it has any: lines of different files then compare."""
    ws = re.findall(r"[^\W_]+|#", line_key(head))
    if not any(w in title for w in ws):
        return None
    return " ".join("%" if w in title else w for w in ws)


def mend(text: str, decide: Callable[[str, str, str], bool]) -> str:
    """The text with words broken at a line's end put together where `decide` (part, mark, part) says so; else the mark
    stays and only the line feed goes. Searched from the marks, which are rare, and not from the words."""
    out, at = [], 0
    before, before_end = "", -1
    for m in _EOL.finditer(text):
        nxt = _PART.match(text, m.end())
        if not nxt:
            continue
        i = m.start()
        if i == before_end:
            part = before  # the part after one break is the part before the next
        else:
            j = i
            while j and (text[j - 1].isalnum() or text[j - 1] in "_@+|$"):
                j -= 1
            while j < i and not text[j].isalpha():
                j += 1
            part = text[j:i]
        if not part:
            continue
        sign = m.group()[0]
        whole = decide(part, sign, nxt.group())
        out += [text[at:i], "" if whole else sign.replace("\u00ad", "-").replace("¬", "-")]
        at = m.end()
        before, before_end = (part + nxt.group() if whole else nxt.group()), nxt.end()
    return "".join(out) + text[at:] if out else text


class Text:
    """A text taken apart: its lines, which of them are furniture candidates, and the running text with broken words joined."""

    __slots__ = ("lines", "kinds", "running", "joined")

    def __init__(self, text: str):
        self.lines = _LINES.split(text)
        self.kinds: dict[int, Line] = {}
        for i, s in enumerate(self.lines):
            t = s.strip()
            if t:
                c = t[0]
                # cheap: most lines are running text
                if c.isupper() or c.isdigit() or c in "[(<–—-pPsS":
                    k = Line(t)
                    if k.page or k.head:
                        self.kinds[i] = k
        self.joined: list[tuple[str, str, str]] = []
        body = "\n".join(s for i, s in enumerate(self.lines) if i not in self.kinds)

        def join(a: str, sign: str, b: str) -> bool:
            self.joined.append((a, sign, b))
            return True

        self.running = mend(body, join) if any(h in body for h in HYPHENS) else body


class Dictionary:
    """The frequent words, what misreadings of them look like, and the skip-gram vectors."""

    def __init__(self, counts: dict[str, int], words: list[str] | None = None, vectors: np.ndarray | None = None, beside: list[str] | None = None, contexts: np.ndarray | None = None):
        self.counts = counts
        self.common = max(20 * LEAST, COMMON * sum(counts.values()))
        self.memo: dict[str, list[str]] = {}
        self.by_fold: dict[str, list[str]] = {}
        for w in counts:
            if not _SIGNS.search(w):
                for k in folds(w):
                    self.by_fold.setdefault(k, []).append(w)
        self.safe = {w for w in counts if not self.partners(w)}
        self.memo.clear()
        self.at = {w: i for i, w in enumerate(words or ())}
        self.ctx = {w: i for i, w in enumerate(beside or ())}
        self.vectors, self.contexts = vectors, contexts

    def partners(self, w: str) -> list[str]:
        """Frequent words that `w` may be a misreading of."""
        w = w.lower()
        if (out := self.memo.get(w)) is None:
            n = max(self.counts.get(w, 0), 1)
            ratio = RATIO_SIGNS if _SIGNS.search(w) else RATIO
            found = {f for k in folds(w) for f in self.by_fold.get(k, ()) if f != w and self.counts[f] >= ratio * n and self.counts[f] >= LEAST}
            out = sorted(found, key=lambda f: (-self.counts[f], f))
            if len(self.memo) >= 200_000:  # it only saves time
                self.memo.clear()
            self.memo[w] = out
        return out

    def agreement(self, w: str, around: list[str]) -> float:
        """How well a word's vector agrees with the words beside it: their mean mutual information as the model has it."""
        i = self.at.get(w)
        js = [self.ctx[c] for c in around if c in self.ctx]
        if i is None or not js or self.vectors is None:
            return 0.0
        return float((self.contexts[js] @ self.vectors[i]).mean())

    def corrections(self, text: str) -> dict[tuple[int, int], str]:
        """(start, end) of misread words of a running text, and what they are."""
        out: dict[tuple[int, int], str] = {}
        tokens = None
        # most texts hold no word that could be one
        odd = {t for t in set(_TOKEN.findall(text)) if t.lower() not in self.safe and is_word(t) and self.partners(t)}
        if not odd:
            return out
        for m in _TOKEN.finditer(text):
            t = m.group()
            if t not in odd:
                continue
            low = t.lower()
            found = self.partners(low)
            if len(found) > 1 or not _SIGNS.search(low):
                if tokens is None:
                    tokens = [(x.start(), x.group().lower()) for x in _TOKEN.finditer(text)]
                    starts = [a for a, _ in tokens]
                k = int(np.searchsorted(starts, m.start()))
                around = [w for _, w in tokens[max(0, k - 2) : k] + tokens[k + 1 : k + 3]]
                scored = sorted(found, key=lambda f: -self.agreement(f, around))
                best = scored[0]
                # a word of letters only may be a rare word of its own: its neighbours must not speak against the other
                if not _SIGNS.search(low) and low in self.at and self.agreement(low, around) > self.agreement(best, around) + 1.0:
                    continue
            else:
                best = found[0]
            out[m.span()] = best.upper() if t.isupper() and len(t) > 1 else best.capitalize() if t[0].isupper() else best
        return out

    def is_broken(self, a: str, mark_: str, b: str) -> bool:
        """Whether two parts at a line's end are one word: not if it is a compound that has its hyphen anyway."""
        if mark_ not in "-‐‑":
            return True
        whole, pair = (a + b).lower(), f"{a}-{b}".lower()
        if self.counts.get(whole, 0) or self.partners(whole):
            return True
        if self.counts.get(pair, 0):
            return False
        if b[0].isupper():
            return False
        return not (self.counts.get(a.lower(), 0) > self.common and self.counts.get(b.lower(), 0) > self.common and len(a) > 2 and len(b) > 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: words with their counts (kind w), texts by file (f), title-like lines by file with the texts they stand in
    (h), and with the file's words taken out by file (t)."""
    for batch in batches:
        words: Counter = Counter()
        heads: Counter = Counter()
        for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            t = Text(text)
            words.update(map(str.lower, re.findall(r"[^\W_][\w@+|$'-]*[^\W_@]|[@|+$][\w@+|$]*[^\W_]|[^\W_]", t.running)))
            if name:
                heads["f", name, ""] += 1
            if name and t.kinds:
                for k in {line_key(x.head) for x in t.kinds.values() if x.head}:
                    heads["h", name, k] += 1
                title = file_words(name)
                for k in {template(x.head, title) for x in t.kinds.values() if x.head}:
                    if k:
                        heads["t", name, k] += 1
        # compounds with their hyphen count as they are, and by their parts
        for w in [w for w in words if "-" in w]:
            for p in w.split("-"):
                if p:
                    words[p] += words[w]
        rows = [("w", "", w, n) for w, n in words.items()] + [(kind, f, k, n) for (kind, f, k), n in heads.items()]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["kind", "filename", "key", "n"])


def dictionary(counts: DataFrame) -> dict[str, int]:
    """The words from a share of RARE of all on; at most 1 / RARE by their definition."""
    words = counts.where("kind = 'w'")
    total = words.agg(F.sum("n")).first()[0] or 0
    return {r["key"]: r["n"] for r in words.where(F.col("n") >= max(LEAST, RARE * total)).select("key", "n").toLocalIterator()}


def vectors(texts: DataFrame, counts: dict[str, int]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Skip-gram vectors of the most frequent words, and of the words beside them: a truncated factorisation of the
    shifted positive mutual information. The pair counts are summed in Spark and fill a matrix of bounded size."""
    words = sorted((w for w in counts if w.isalpha()), key=lambda w: (-counts[w], w))[:VECTORS]
    beside = words[:NEIGHBOURS]
    n, c = len(words), len(beside)
    if n < 2:
        return words, np.zeros((n, 1), np.float32), beside, np.zeros((c, 1), np.float32)
    at = {w: i for i, w in enumerate(words)}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = at.get
        total: Counter = Counter()
        for batch in batches:
            seqs = [-1]
            for text in batch.column("text").to_pylist():
                if text:
                    seqs += [get(w, -1) for w in re.findall(r"[^\W_][\w@+|$]*", text.lower())]
                    seqs += [-1, -1]
            s = np.array(seqs, np.int64)
            found = []
            for d in (1, 2):
                for a, b in ((s[:-d], s[d:]), (s[d:], s[:-d])):
                    ok = (a >= 0) & (b >= 0) & (b < c)
                    found.append(a[ok] * c + b[ok])
            code, k = np.unique(np.concatenate(found), return_counts=True)
            total.update(dict(zip(code.tolist(), k.tolist())))
            if len(total) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    m = np.zeros(n * c, np.float32)
    summed = texts.select("text").mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():
        m[r[0]] = r[1]
    m = m.reshape(n, c)
    total = m.sum() or 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(m * total / (m.sum(1, keepdims=True) * m.sum(0, keepdims=True) ** 0.75 * (m.sum() / (m.sum(0) ** 0.75).sum())))
    pmi = np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0).astype(np.float32)
    k = min(DIMENSIONS, n, c)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(pmi @ rng.standard_normal((c, min(c, k + 8))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(pmi @ (pmi.T @ q))[0]
    u, s, v = np.linalg.svd(q.T @ pmi, full_matrices=False)
    root = np.sqrt(s[:k])
    return words, ((q @ u[:, :k]) * root).astype(np.float32), beside, (v[:k].T * root).astype(np.float32)


class Model:
    """What is learned from the texts: the dictionary with its vectors; the title-like lines that repeat in a file (`heads`:
    filename, key); and those that, the file's own words aside, stand in several files (`forms`: form)."""

    def __init__(self, words: Dictionary, heads: DataFrame, forms: DataFrame):
        self.words, self.heads, self.forms = words, heads, forms


def learn(texts: DataFrame) -> Model:
    """From (text, filename), by three jobs over all texts and whole."""
    counts = stage(texts.select("filename", "text").mapInArrow(_count, "kind string, filename string, key string, n long").groupBy("kind", "filename", "key").agg(F.sum("n").alias("n")).where("kind <> 'w' OR n > 1"), "counts")
    known = dictionary(counts)
    files = counts.where("kind = 'f'").select("filename", F.col("n").alias("texts"))
    heads = counts.where("kind = 'h'").where(F.col("n") >= REPEATS).join(files, "filename").where(F.col("n") >= REPEATED * F.col("texts")).select("filename", "key")
    least = max(REPEATS, FORMS * files.count())
    forms = counts.where("kind = 't'").groupBy(F.col("key").alias("form")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("form")
    return Model(Dictionary(known, *vectors(texts, known)), heads, forms)


def noise(texts: DataFrame, model: Model, keep: tuple[str, ...] = ("chunk_kind", "chunk_id")) -> DataFrame:
    """(keep, noise): the kinds of noise in each text: hyphenation, misread, header, page_number; one row per kind.

    Null and empty texts have none; a null file name leaves headers to their form. Rows of one key give repeated rows.
    Texts stay where they are read; only title-like lines that don't name their file are shuffled, to be looked up by
    file and line, where equal lines of a file were counted before."""
    src = texts.select(*keep, "filename", "text")
    schema = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep) + ", filename string, noise string, key string, form string"
    words = model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, kinds, keys, forms = [], [], [], []
                for r, (name, text) in enumerate(zip(part.column("filename").to_pylist(), part.column("text").to_pylist())):
                    if not text:
                        continue
                    t = Text(text)
                    title = file_words(name)
                    got: set[tuple[str, str | None, str | None]] = set()
                    for x in t.kinds.values():
                        if x.page:
                            got.add(("page_number", None, None))
                        if x.head:
                            got.add(("header", None, None) if names_file(x.head, title) else ("header", line_key(x.head), template(x.head, title)))
                    if any(words.is_broken(*j) for j in t.joined):
                        got.add(("hyphenation", None, None))
                    if words.corrections(t.running):
                        got.add(("misread", None, None))
                    for n, k, f in got:
                        rows.append(r)
                        kinds.append(n)
                        keys.append(k)
                        forms.append(f)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(take) for i in range(len(keep))), part.column("filename").take(take), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(forms, pa.string())], names=[*keep, "filename", "noise", "key", "form"]
                )

    found = stage(src.mapInArrow(run, schema), "noise")
    sure = found.where("key IS NULL").select(*keep, "noise")
    open_ = found.where("key IS NOT NULL")
    by_file = open_.join(model.heads, ["filename", "key"], "left_semi").select(*keep, "noise")
    by_form = open_.join(model.forms, "form", "left_semi").select(*keep, "noise")
    return sure.unionByName(by_file).unionByName(by_form)


def repaired(text: str | None, filename: str | None, headers: set[str], words: Dictionary) -> str | None:
    """The text without furniture, with words whole and right, in one line per paragraph."""
    if not text:
        return text
    t = Text(text)
    title = file_words(filename)
    out: list[str] = []
    for i, s in enumerate(t.lines):
        x = t.kinds.get(i)
        if x and ((x.page and not x.head) or (x.head and (names_file(x.head, title) or line_key(x.head) in headers))):
            continue
        out.append(s.rstrip())
    body = "\n".join(out)

    body = mend(body, words.is_broken)
    fixed, at = [], 0
    for (a, b), w in sorted(words.corrections(body).items()):
        fixed += [body[at:a], w]
        at = b
    body = "".join(fixed) + body[at:]
    paragraphs: list[str] = []
    fresh, code = True, False
    for s in body.split("\n"):
        line = s.strip()
        if line.startswith("```"):
            code = not code
            paragraphs.append(s)
            fresh = True
        elif code or not line:
            if code:
                paragraphs.append(s)
            elif paragraphs and paragraphs[-1]:
                paragraphs.append("")
            fresh = True
        elif fresh or _SECTION.match(line) or line[0] in "-*•|[#" or (paragraphs and _SECTION.match(paragraphs[-1]) and len(paragraphs[-1]) < 80):
            paragraphs.append(line)
            fresh = False
        else:
            paragraphs[-1] = f"{paragraphs[-1]} {line}"
    return unicodedata.normalize("NFC", "\n".join(paragraphs).strip("\n"))


def repair_scans(texts: DataFrame, model: Model, keep: tuple[str, ...] = ("chunk_kind", "chunk_id")) -> DataFrame:
    """`keep` and the repaired text of every row; null and empty texts stay as they are.

    Each text is looked up for repeated title-like lines of its file by a join of those lines; it is itself shuffled
    only if it has such lines."""
    src = texts.select(*keep, "filename", "text")
    words = model.words
    has = "chunk_lines"
    base = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist()):
                title = file_words(name)
                heads = {x.head for x in Text(text).kinds.values() if x.head and not names_file(x.head, title)} if text and name else ()
                out.append([{"line": k, "form": f} for k, f in sorted({(line_key(h), template(h, title) or "") for h in heads})])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.struct([("line", pa.string()), ("form", pa.string())])))], names=[*keep, "filename", "text", has])

    marked = src.mapInArrow(lines, f"{base}, filename string, text string, {has} array<struct<line:string,form:string>>")
    plain = marked.where(F.size(has) == 0).withColumn("headers", F.array().cast("array<string>"))
    repeated = model.heads.select("filename", F.col("key").alias("line"), F.lit(True).alias("in_file"))
    forms = model.forms.select("form", F.lit(True).alias("in_forms"))
    other = (
        marked.where(F.size(has) > 0)
        .select(*keep, "filename", "text", F.explode(has).alias("x"))
        .select(*keep, "filename", "text", "x.line", "x.form")
        .join(repeated, ["filename", "line"], "left")
        .join(forms, "form", "left")
        .groupBy(*keep, "filename")
        .agg(F.first("text").alias("text"), F.collect_set(F.when(F.col("in_file") | F.col("in_forms"), F.col("line"))).alias("headers"))
    )

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [repaired(t, f, set(h or ()), words) for t, f, h in zip(batch.column("text").to_pylist(), batch.column("filename").to_pylist(), batch.column("headers").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())], names=[*keep, "text"])

    both = plain.select(*keep, "filename", "text", "headers").unionByName(other.select(*keep, "filename", "text", "headers"))
    return both.mapInArrow(fix, f"{base}, text string")
