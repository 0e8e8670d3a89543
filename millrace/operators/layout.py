"""Blocks of pages: reading order, bullets, formulas, captions, broken words, and pages stitched together.

A block is a row (doc, page, pos, label, content, box), where `page` orders the pages of a document and `pos` the blocks of
a page. Steps within a page are windows over the page; stitching is a fold that streams each document's sorted rows and
keeps one pending block. Null contents count as empty, null boxes as none; other columns pass through."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# What a caption begins with, and labels of titles.
CAPTION = r"(?i)^(?:Figure|Fig\.?|Table|Abbildung|Tabelle)\s+[0-9]+"
TITLES = ("doc_title", "paragraph_title")


def _page(*order: str | Column) -> Window:
    return Window.partitionBy("doc", "page").orderBy(*order)


def reading_order(blocks: DataFrame, gap: float = 0.15, narrow: float = 50) -> DataFrame:
    """`column_no` and `place` added: columns begin where rounded x centres, sorted, leave a gap of more than `gap` of the
    page's width of centres (a page narrower than `narrow` has one); a block belongs to the nearest beginning. Places
    follow columns and y; blocks without a box come last, and a page with fewer than two boxes keeps its order."""
    has = F.coalesce(F.size("box") >= 4, F.lit(False))
    x = F.when(has, (F.get("box", F.lit(0)) + F.get("box", F.lit(2))) / 2.0)
    t = blocks.withColumns({"_x": x, "_r": F.bround(x, -1)})
    whole = Window.partitionBy("doc", "page")
    t = t.withColumns({"_n": F.count("_x").over(whole), "_w": F.max("_x").over(whole) - F.min("_x").over(whole)})
    before = F.lag("_r", 1).over(_page(F.col("_r").asc_nulls_last()))
    begins = F.col("_r").isNotNull() & (before.isNull() | ((F.col("_r") - before > gap * F.col("_w")) & (F.col("_w") >= narrow)))
    t = t.withColumn("_b", begins).withColumn("_cols", F.array_sort(F.collect_set(F.when(F.col("_b"), F.col("_r"))).over(whole)))
    near = F.array_min(F.transform("_cols", lambda c, i: F.struct(F.abs(F.col("_x") - c).alias("d"), i.alias("i"))))["i"]
    t = t.withColumn("column_no", F.when(F.col("_x").isNotNull() & (F.col("_n") >= 2), near))
    one = F.size("_cols") <= 1
    keys = (F.col("column_no").isNull(), F.coalesce("column_no", F.lit(0)), F.when(F.col("column_no").isNotNull(), F.get("box", F.lit(1))), F.when(F.col("column_no").isNotNull() & one, F.get("box", F.lit(0))), F.col("pos"))
    return t.withColumn("place", F.row_number().over(_page(*keys)) - 1).drop("_x", "_r", "_n", "_w", "_b", "_cols")


def add_bullets(blocks: DataFrame, most: float = 10.0) -> DataFrame:
    """A text between two bulleted texts whose left edges lie within `most` of its own gets a bullet. An update needs both
    neighbours to have one already, so none follows from another."""
    w = _page("pos")
    bullet = (F.col("label") == "text") & F.coalesce(F.col("content"), F.lit("")).startswith("- ")
    left = F.get("box", F.lit(0))
    near = lambda f: f(bullet).over(w) & (F.abs(left - f(left).over(w)) <= most)
    fill = (F.col("label") == "text") & ~bullet & near(F.lag) & near(F.lead)
    return blocks.withColumn("content", F.when(fill, F.concat(F.lit("- "), F.coalesce("content", F.lit("")))).otherwise(F.col("content")))


def _paired(t: DataFrame, link: Column, order: str = "pos") -> DataFrame:
    """`_first` and `_second` of the pairs that a pass over the page makes where `link` says that a row may take the next
    one: in a run of such rows every second one takes, as a row that is taken takes none."""
    w = _page(order)
    t = t.withColumn("_link", F.coalesce(link, F.lit(False)))
    t = t.withColumn("_run", F.sum(F.when(F.col("_link") & F.coalesce(F.lag("_link").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    t = t.withColumn("_odd", (F.row_number().over(Window.partitionBy("doc", "page", "_run").orderBy(order)) % 2) == 1)
    t = t.withColumn("_first", F.col("_link") & F.col("_odd"))
    return t.withColumn("_second", F.coalesce(F.lag("_first").over(w), F.lit(False))).drop("_link", "_run", "_odd")


def merge_formula_numbers(blocks: DataFrame) -> DataFrame:
    """A formula and the number beside it, in either order, become the formula with a tag, if it ends with a line of two
    dollar signs; numbers without a formula go."""
    w = _page("pos")
    kind, nxt = F.col("label"), F.lead("label").over(w)
    t = _paired(blocks, ((kind == "formula") & (nxt == "formula_number")) | ((kind == "formula_number") & (nxt == "formula")))
    t = t.withColumns({"_nc": F.lead("content").over(w), "_nl": nxt, "_nb": F.lead("box").over(w)})
    number = X.formula_number(F.when(kind == "formula_number", F.col("content")).otherwise(F.col("_nc")))
    body = F.when(kind == "formula", F.col("content")).otherwise(F.col("_nc"))
    tagged = F.when(body.endswith("\n$$"), F.concat(F.substring(body, F.lit(1), F.length(body) - 3), F.lit(" \\tag{"), number, F.lit("}\n$$"))).otherwise(body)
    t = t.withColumns({"content": F.when(F.col("_first"), tagged).otherwise(F.col("content")), "box": F.when(F.col("_first") & (kind == "formula_number"), F.col("_nb")).otherwise(F.col("box"))})
    t = t.where(~F.col("_second") & (F.col("_first") | (kind != "formula_number")))
    return t.withColumn("label", F.when(F.col("_first"), "formula").otherwise(F.col("label"))).drop("_first", "_second", "_nc", "_nl", "_nb")


def attach_captions(blocks: DataFrame) -> DataFrame:
    """An image and the caption right behind it, labelled so or a text that begins like one, become a figure."""
    w = _page("pos")
    nl, nc = F.lead("label").over(w), F.lead("content").over(w)
    takes = (F.col("label") == "image") & ((nl == "figure_caption") | ((nl == "text") & X.strip(nc).rlike(CAPTION)))
    t = blocks.withColumns({"_nc": nc, "_takes": F.coalesce(takes, F.lit(False))}).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    body = F.concat(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+$", ""), F.lit("\n\n"), F.coalesce("_nc", F.lit("")))
    t = t.withColumns({"content": F.when(F.col("_takes"), body).otherwise(F.col("content")), "label": F.when(F.col("_takes"), "figure").otherwise(F.col("label"))})
    return t.where(~F.col("_taken")).drop("_nc", "_takes", "_taken")


def merge_broken_words(blocks: DataFrame, frequencies: DataFrame, least: float = 2.5) -> DataFrame:
    """A text that ends with a hyphen and the next text of the page that begins with a small letter become one, if the word
    they make up has a frequency of `least`. `frequencies` has (word, zipf): the decimal logarithm of a word's count in a
    thousand million; words are joined, so the dictionary may be of any size."""
    texts = blocks.where("label = 'text'")
    w = _page("pos")
    end, begin = F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+$", ""), F.regexp_replace(F.lead(F.coalesce("content", F.lit(""))).over(w), r"^\s+", "")
    t = texts.withColumns({"_end": end, "_next": begin})
    t = t.withColumn("_part", F.when(F.col("_end").endswith("-"), F.regexp_extract(F.expr("substring(_end, 1, length(_end) - 1)"), r"(\S+)\s*$", 1)))
    word = F.lower(F.concat(F.nullif("_part", F.lit("")), F.regexp_extract("_next", r"^(\S+)", 1)))
    t = t.withColumn("word", F.when(F.col("_next").rlike(r"^\p{Ll}"), word))
    ok = frequencies.where(F.col("zipf") >= least).select("word", F.lit(True).alias("_ok")).distinct()
    t = _paired(t.join(ok, "word", "left").drop("word"), F.col("_ok"))
    t = t.withColumn("content", F.when(F.col("_first"), F.concat(F.expr("substring(_end, 1, length(_end) - 1)"), F.col("_next"))).otherwise(F.col("content"))).where(~F.col("_second"))
    return t.select(*blocks.columns).unionByName(blocks.where("label <> 'text' OR label IS NULL"))


def zipf(counts: DataFrame) -> DataFrame:
    """(word, zipf) of (word, n): the frequencies of a corpus's own words."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("word", (F.log10(F.col("n") * 1e9 / F.col("total"))).alias("zipf"))


_LIST = re.compile(r"^\d+[.)]\s")
_RULE = re.compile(r"^[\s|:-]+$")
_ENDS = re.compile(r"[.!?;:。！？；]$")


def quality(s: str) -> float:
    """What `functions.text.block_quality` gives for a text."""
    t = s.strip()
    if not t:
        return 0.0
    share = sum(map(str.isalpha, t)) / len(t)
    if share < 0.1:
        return share
    ws = t.split()
    mean = sum(map(len, ws)) / len(ws)
    word = 1.0 if 3 <= mean <= 12 else 0.2 if mean < 2 or mean > 20 else 0.6
    return min(1.0, 0.35 * share + 0.25 * sum(map(str.isalnum, t)) / len(t) + 0.2 * word + 0.2 * (1.0 if " " in t else 0.3))


def unfinished(s: str) -> bool:
    """What `functions.text.is_incomplete` gives for a text."""
    t = s.rstrip()
    if not t or _ENDS.search(t) or (t[-1] in ")]}" and len(t) > 3) or t.startswith("#") or t.endswith(("|", "```")):
        return False
    return t[-1] in "-," or t[-1].islower()


def goes_on(s: str) -> bool:
    """What `functions.text.is_continuation` gives for a text."""
    t = s.lstrip()
    return bool(t) and (t[0].islower() or t.split()[0].lower().rstrip(".,;:") in X.CONTINUES)


def _joins(last: dict, first: dict, least: float) -> bool:
    if last["label"] != "text" or first["label"] != "text":
        return False
    a, b = (last["content"] or "").rstrip(), (first["content"] or "").lstrip()
    if not a or not b or quality(a) < least or quality(b) < least:
        return False
    if a.lstrip().startswith("- ") or b.startswith("- ") or _LIST.match(b) or "$$" in a or "$$" in b or ("|" in a and "|" in b):
        return False
    return (unfinished(a) and goes_on(b)) or (a.endswith("-") and b[0].islower())


def _joined(a: str, b: str) -> str:
    a, b = a.rstrip(), b.lstrip()
    if a.endswith("-"):
        before, after = (a.rstrip("-").split() or [""])[-1], (b.split() or [""])[0]
        if len(before) >= 2 and len(after) >= 2:
            return a[:-1] + b
    return f"{a} {b}"


def _piped(s: str) -> list[str]:
    return [x for x in s.split("\n") if "|" in x]


def _is_table(block: dict) -> bool:
    s = (block["content"] or "").strip().split("\n")
    n = sum("|" in x for x in s)
    return block["label"] == "table" or (n >= 2 and n / len(s) > 0.5)


def _table_goes_on(last: dict, first: dict) -> bool:
    if not _is_table(last) or not _is_table(first):
        return False
    a, b = _piped((last["content"] or "").rstrip()), _piped((first["content"] or "").lstrip())
    return bool(a and b) and abs(a[-1].count("|") - b[0].count("|")) <= 1 and not _RULE.match(b[0].strip())


def _table_joined(a: str, b: str) -> str:
    a, b = a.rstrip(), b.lstrip().split("\n")
    if len(b) >= 2 and _RULE.match(b[1].strip()):
        skip = 2 if _piped(a) and _piped(a)[0].strip() == b[0].strip() else 0
    else:
        skip = 1 if _RULE.match(b[0].strip()) else 0
    return a + "\n" + "\n".join(b[skip:])


def stitch_pages(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc, page, pos, label, content, page_end): paragraphs and tables that go on across pages become one block.

    The last block of a page waits for the next page's blocks and takes those that go on with it: a text of fair quality
    that is unfinished and one that continues it, or a table and rows of as many cells (a repeated header goes). Rows are
    hashed by document, sorted and streamed: a task keeps the pending block, not the document. A document is one task's
    work; its pages are never gathered."""
    src = blocks.select("doc", "page", "pos", "label", "content").repartition("doc").sortWithinPartitions("doc", "page", "pos")
    schema = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in src.columns) + f", page_end {src.schema['page'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the row before: whether it is its page's last is known with the next one
        pending: dict | None = None
        kind = None
        for batch in batches:
            kind, out = batch.schema, []
            for row in batch.to_pylist():
                if held is not None:
                    pending = _step(held, row["doc"] != held["doc"] or row["page"] != held["page"], pending, out, least)
                    if row["doc"] != held["doc"] and pending is not None:
                        out.append(pending)
                        pending = None
                held = row
            if out:
                yield _rows(out, kind)
        out = []
        if held is not None:
            pending = _step(held, True, pending, out, least)
            if pending is not None:
                out.append(pending)
            yield _rows(out, kind)

    return src.mapInArrow(run, schema)


def _step(block: dict, last: bool, pending: dict | None, out: list[dict], least: float) -> dict | None:
    """One block of the fold: what is pending after it; finished blocks go to `out`."""
    if pending is not None:
        if _joins(pending, block, least):
            return pending | {"content": _joined(pending["content"], block["content"]), "page_end": block["page"]}
        if _table_goes_on(pending, block):
            return pending | {"content": _table_joined(pending["content"], block["content"]), "page_end": block["page"]}
        out.append(pending)
    block = block | {"page_end": block["page"]}
    if last:
        return block
    out.append(block)
    return None


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    fields = [*schema, pa.field("page_end", schema.field("page").type)]
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], names=[f.name for f in fields])


def body_and_levels(spans: DataFrame, more: float = 1.5) -> DataFrame:
    """(doc, size, chars, level): the sizes of a document's spans (doc, size, text); level 0 is the body, the size with most
    characters (the smaller of equal ones); larger ones by more than `more` are 1, 2, ... from the largest; others null."""
    t = spans.where(F.trim("text") != "").groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    body = F.max(F.struct("chars", (-F.col("size")).alias("s"))).over(Window.partitionBy("doc"))["s"] * -1
    t = t.withColumn("_body", body).withColumn("_big", F.col("size") > F.col("_body") + more)
    rank = F.dense_rank().over(Window.partitionBy("doc", "_big").orderBy(F.desc("size")))
    return t.select("doc", "size", "chars", F.when(F.col("size") == F.col("_body"), 0).when(F.col("_big"), rank).alias("level"))


def fill_forward(df: DataFrame, order: str, columns: list[str], by: tuple[str, ...] = (), block: int = 100_000) -> DataFrame:
    """Nulls and blanks of `columns` replaced by the last value above, in order of the number `order`, within `by`.

    Rows are parted into blocks of `block` numbers, so that no task holds a whole sheet; what a block hands on is its last
    values, one small row each, carried over blocks by a window over these rows only."""
    keys = [*by, "_block"]
    t = df.withColumn("_block", F.floor(F.col(order) / block))
    value = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in columns}
    ends = t.groupBy(*keys).agg(*(F.max_by(c, F.when(value[c].isNotNull(), F.col(order))).alias(f"_e_{c}") for c in columns))
    over = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *(F.last(f"_e_{c}", ignorenulls=True).over(over).alias(f"_c_{c}") for c in columns))
    t = t.alias("t").join(carried.alias("c"), [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]).select("t.*", *(f"c._c_{c}" for c in columns))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(value[c], ignorenulls=True).over(w), F.col(f"_c_{c}")) for c in columns}
    return t.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def bookmark_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", bookmarks: str = "bookmarks") -> DataFrame:
    """(key, pos, title, hierarchy, section): the text from each bookmark's line to the next one's. A bookmark (title,
    level) is found at the first line, from the last hit on, that holds its title or is held by it, without case; one that
    isn't found is passed over. One row at a time."""
    src = docs.select(key, text, bookmarks)
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, s, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(k, i, t, h, x) for i, (t, h, x) in enumerate(sections_at(s or "", [(m["title"], m["level"]) for m in marks or () if m]))]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "pos", "title", "hierarchy", "section"])

    return src.mapInArrow(run, f"{key} {kind}, pos int, title string, hierarchy array<string>, section string")


def sections_at(text: str, marks: list[tuple[str | None, int | None]]) -> list[tuple[str, list[str], str]]:
    lines = text.split("\n")
    low = [x.lower().strip() for x in lines]
    out, stack, at = [], [], 0

    def put(end: int) -> None:
        body = "\n".join(lines[at:end]).strip()
        if body and stack:
            out.append((stack[-1][1], [t for _, t in stack], body))

    for title, level in marks:
        t = (title or "").strip()
        if not t:
            continue
        hit = next((i for i in range(at, len(low)) if t.lower() in low[i] or low[i] in t.lower()), None)
        if hit is None:
            continue
        if at > 0:
            put(hit)
        while stack and stack[-1][0] >= (level or 0):
            stack.pop()
        stack.append((level or 0, t))
        at = hit
    put(len(lines))
    return out
