"""Column functions over text. A null text gives null unless said otherwise; lines are parted by line feeds.

`\\w` and `\\s` mean ASCII in the JVM, so classes are spelled out where letters of other scripts count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide what these functions find.
COMPOUND = r"[A-Za-z][A-Za-z0-9]*(?:[_:][A-Za-z0-9]+)+|[A-Za-z]{2,}[0-9]+[A-Za-z0-9]*|[A-Za-z0-9]+(?:::[A-Za-z0-9]+)+"
# the same for the JVM, begun at the start of a run only and without going back, so that long runs take linear time
COMPOUND_JVM = (
    r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9]*+(?:[_:][A-Za-z0-9]++)+|(?<![A-Za-z])[A-Za-z]{2,}+[0-9]++[A-Za-z0-9]*+|(?<![A-Za-z0-9])[A-Za-z0-9]++(?:::[A-Za-z0-9]++)+"
)
PAGE_TAG = r"(?i)\[page\s+[0-9]+\]"
GARBAGE = (r"^[|_\-=]{5,}$", r"^[.\s]{10,}$", r"^[^\p{L}\p{N}_\s]{3,}$", r"^[|]$")
FURNITURE = (r"(?i)^(?:page|seite)\s+[0-9]+\s*(?:of|von)\s+[0-9]+$", r"^[0-9]+\s*/\s*[0-9]+$", r"^-\s*[0-9]+\s*-$", r"(?i)^©\s+[0-9]{4}", r"(?i)^confidential$", r"(?i)^draft$")
BULLETS = "•·◦▪▸►➢➤✓✔☐☑■□▶"
CONTINUES = "and or but the a an in of to for with that which where when as by from on at is are was were be been being have has had do does did".split()
XREF_PREFIXES = "SWS SRS ECUC TPS RS CONC REQ SPC TST".split()
BOILERPLATE = ("confidential", "copyright", "this document is published by")
STOPWORDS = (
    "the a an of in for to and or is are was were be been being this that these those it its with on at by from as what how can could would should may might must have has had do does did "
    "about between into through during before after above below up down"
).split()
FILLERS = "the a an of in for to and or is are what how can you please could provide explain describe detail elaborate specifically".split()
VAGUE = ("as described in section", "see section", "refer to section", "mentioned under section", "discussed under section", "discussed in section", "starting at page", "covered in section", "outlined in section")
NOISY = (r"\bwat\b", r"\bwot\b", r"\bwhot\b", r"\bwhat\s+iz\b", r"\bwher\b", r"\bwer\b", r"\biz\b", r"\bfigur\b", r"\bdescriptin\b", r"\bstuff\b", r"\bthingy\b", r"\bwut\b", r"\bsumthing\b", r"\bprolly\b", r"\bwha\s+t\b", r"\bwha\b", r"\bwhaet\b")
CONFUSABLE = {"‘": "'", "’": "'", "“": '"', "”": '"', "（": "(", "）": ")", "：": ":", "；": ";", "，": ",", "．": ".", "–": "-", " ": " ", " ": " ", " ": " "}
REMOVED = "​﻿­"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def any_of(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def identifier_tokens(c: Column) -> Column:
    """Lower-case tokens: each compound identifier whole and by its parts of over one character, then the other words of
    over one character; repeated ones stay. A compound that begins inside a run that starts with a digit takes its part."""
    whole = F.transform(F.regexp_extract_all(c, F.lit(f"({COMPOUND_JVM})"), 1), F.lower)
    parts = F.flatten(F.transform(whole, lambda w: F.concat(F.array(w), F.filter(F.regexp_extract_all(w, F.lit("([a-z0-9]+)"), 1), lambda p: F.length(p) > 1))))
    plain = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(c, COMPOUND_JVM, " ")), F.lit("([a-z0-9]+)"), 1), lambda p: F.length(p) > 1)
    return F.concat(parts, plain)


def token_count(c: Column) -> Column:
    """Tokens by length: a token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def hard_split(c: Column, tokens: int) -> Column:
    """Pieces of at most `tokens` tokens by length; the empty text has none."""
    n = 4 * tokens
    size = F.length(c)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / n).cast("int")), lambda i: F.substring(c, i * n + 1, F.lit(n)))).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def sentences(c: Column) -> Column:
    """Pieces that end with a stop, an exclamation or a question mark before white space; blank ones are left out."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001", -1), lambda s: strip(s) != "")


def strip_page_tags(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_TAG, " ")


def fold_confusables(c: Column) -> Column:
    """Typographic signs as ASCII; zero-width signs and soft hyphens gone. Composing (NFC) is `functions.unicode.nfc`."""
    keys = "".join(CONFUSABLE)
    return F.replace(F.translate(F.translate(c, keys, "".join(CONFUSABLE.values())), REMOVED, ""), F.lit("—"), F.lit("--"))


def squeeze_space(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\\t"), F.lit(" ")), r"[ \t\r\f\x0b]+", " ")
    return strip(unlines(F.transform(lines(c), lambda x: F.regexp_replace(x, r"\s+$", ""))))


def drop_garbage_lines(c: Column) -> Column:
    kept = F.filter(lines(c), lambda x: (strip(x) == "") | ~any_of(strip(x), GARBAGE))
    return unlines(F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x)))


def collapse_repeated_lines(c: Column, threshold: int = 3) -> Column:
    """No line more than twice in a row; texts of fewer lines than `threshold` stay."""
    ls = lines(c)
    s = F.transform(ls, strip)

    def keep(x: Column, i: Column) -> Column:
        return (strip(x) == "") | (i < 2) | (strip(x) != F.get(s, i - 1)) | (strip(x) != F.get(s, i - 2))

    return F.when(F.size(ls) < threshold, c).otherwise(unlines(F.filter(ls, keep)))


def is_furniture(line: Column) -> Column:
    return (strip(line) != "") & any_of(strip(line), FURNITURE)


def strip_furniture(c: Column) -> Column:
    return unlines(F.filter(lines(c), lambda x: ~is_furniture(x)))


def in_margin(y1: Column, y2: Column, height: int = 1000, share: float = 0.08) -> Column:
    """Whether a block lies in the top or bottom margin of the page."""
    t = int(height * share)
    return (y2 <= t) | (y1 >= height - t)


def dash_bullets(c: Column) -> Column:
    return unlines(F.transform(lines(c), lambda x: F.regexp_replace(x, rf"^(\s*)[{BULLETS}]\s*", "$1- ")))


def space_numbered(c: Column) -> Column:
    return unlines(F.transform(lines(c), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\s*)([0-9]{1,3}|[a-zA-Z])）", "$1$2)"), r"^(\s*)([0-9]{1,3}|[a-zA-Z])([.)\]])\s*", "$1$2$3 ")))


def is_incomplete(c: Column) -> Column:
    t = F.regexp_replace(c, r"\s+$", "")
    last = F.right(t, F.lit(1))
    return (
        F.when(t == "", False)
        .when(last.rlike(r"[.!?;:。！？；]"), False)
        .when(last.rlike(r"[)\]}]") & (F.length(t) > 3), False)
        .when(t.startswith("#") | t.endswith("|") | t.endswith("```"), False)
        .otherwise(last.rlike(r"[-,\p{Ll}]"))
    )


def is_continuation(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+", "")
    first = F.regexp_replace(F.lower(F.regexp_extract(t, r"^(\S*)", 1)), r"[.,;:]+$", "")
    return F.when(t == "", False).otherwise(t.rlike(r"^\p{Ll}") | first.isin(CONTINUES))


def trim_cells(c: Column) -> Column:
    return unlines(F.transform(lines(c), lambda x: F.when(x.contains("|"), F.array_join(F.transform(F.split(x, r"\|", -1), strip), " | ")).otherwise(x)))


def block_quality(c: Column) -> Column:
    """0 to 1: letters and digits among the characters, the words' usual length, and blanks between them."""
    t = strip(c)
    n = F.length(t)
    share = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / n
    ws = F.split(t, r"\s+")
    mean = F.length(F.regexp_replace(t, r"\s+", "")) / F.size(ws)
    word = F.when(mean.between(3, 12), 1.0).when((mean < 2) | (mean > 20), 0.2).otherwise(0.6)
    space = F.when(t.contains(" "), 1.0).otherwise(0.3)
    score = F.least(F.lit(1.0), 0.35 * share + 0.25 * alnum + 0.2 * word + 0.2 * space)
    return F.when(n == 0, F.lit(0.0)).when(share < 0.1, share).when(c.isNotNull(), score)


def cross_references(c: Column) -> Column:
    """requirements, sections, tables, figures -> distinct mentions, first seen first."""
    pick = lambda p, pre="": F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(p), 1), lambda x: F.concat(F.lit(pre), x)))
    return F.create_map(
        F.lit("requirements"), pick(r"(\[(?:" + "|".join(XREF_PREFIXES) + r")_[A-Za-z]+_[0-9]{4,6}\])"),
        F.lit("sections"), pick(r"(?:[Ss]ection|[Ss]ee|[Cc]hapter|[Aa]nnex)\s+([0-9]+(?:\.[0-9]+)*)"),
        F.lit("tables"), pick(r"[Tt]able\s+([0-9]+(?:[.-][0-9]+)?)", "Table "),
        F.lit("figures"), pick(r"(?:[Ff]igure|[Ff]ig\.?)\s+([0-9]+(?:[.-][0-9]+)?)", "Figure "),
    )


def table_rows(c: Column) -> Column:
    """The cells of a pipe table's lines, header first, rule lines left out; null with fewer than two lines of pipes."""
    piped = F.filter(F.transform(lines(c), strip), lambda x: x.contains("|"))
    cells = F.transform(piped, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), strip))
    body = F.filter(cells, lambda r: ~F.forall(r, lambda x: x.rlike(r"^:?-{2,}:?$")))
    return F.when(F.size(piped) >= 2, body)


def pad_rows(rows: Column) -> Column:
    """Every row as wide as the first: filled with empty cells or cut."""
    n = F.size(F.get(rows, F.lit(0)))
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)))), F.lit(1), F.greatest(n, F.lit(0))))


def formula_number(c: Column) -> Column:
    t = strip(c)
    inner = F.regexp_extract(t, r"^[(（](.*)[)）]$", 1)
    return F.when(t.rlike(r"^[(（].*[)）]$"), strip(inner)).otherwise(t)


def clean_region(c: Column) -> Column:
    """Literal tabs at the ends gone, runs of dots and underscores cut to three."""
    c = F.regexp_replace(c, r"^(?:\\t)+|(?:\\t)+$", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), r"_{4,}", "___"))


def strip_boilerplate(c: Column, markers=BOILERPLATE) -> Column:
    def bad(x: Column) -> Column:
        out = x.rlike(r"^\s*Document ID\s+[0-9]+\s*:") | x.rlike(r"^\s*[0-9]+\s+of\s+[0-9]+\s*$")
        for m in markers:
            out = out | F.lower(x).contains(m)
        return out

    return unlines(F.filter(lines(c), lambda x: ~bad(x)))


def filled_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: strip(x) != "")


def toc_score(c: Column) -> Column:
    """0 to 5: dotted leaders, lines that end in page numbers, numbered titles with dots."""
    ls = filled_lines(c)
    ends = F.size(F.filter(ls, lambda x: strip(x).rlike(r"\s+[0-9]{1,4}$")))
    two = lambda b: F.when(b, 2).otherwise(0)
    return F.when(strip(c) == "", 0).when(
        c.isNotNull(),
        two(c.rlike(r"(?:\. ){5,}") | c.rlike(r"\.{5,}")) + two(ends > 0.5 * F.size(ls)) + F.when(c.rlike(r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)*\s+\S+") & c.contains("..."), 1).otherwise(0)
    )


def is_toc_page(c: Column, short: int = 50, long: int = 800, least: int = 3, ratio: float = 0.4) -> Column:
    t = strip(c)
    ls = filled_lines(t)
    toc = F.size(F.filter(ls, lambda x: x.rlike(r"(?:\.\s*){2,}.*[0-9]+\s*$")))
    return F.when(F.length(t) < short, True).when(F.length(t) > long, False).when(F.size(ls) < least, False).otherwise(toc >= ratio * F.size(ls))


def toc_entry(c: Column) -> Column:
    """number, title, page of a contents line; null where the line is none."""
    p = r"^\s*((?:[0-9]+|[A-Z])(?:\.[0-9]+)*)\.?\s+(.*?\S)\s*(?:\.\s*){2,}\s*([0-9]+)\s*$"
    get = lambda i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(p), F.struct(get(1).alias("number"), get(2).alias("title"), get(3).cast("int").alias("page")))


def number_level(c: Column) -> Column:
    """Depth of a section number: parts parted by dots, six at most; a letter is 1."""
    return F.when(c.rlike("^[A-Za-z]"), 1).when(c.isNotNull(), F.least(F.lit(6), F.size(F.split(F.regexp_replace(c, r"\.+$", ""), r"\."))))


def heading(c: Column) -> Column:
    """(level, title) of a line that is a heading: markdown, numbered, annex, or all capitals; null otherwise."""
    t = strip(c)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\p{Lu}", 1)
    mk = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    return (
        F.when(t.rlike(r"^#{1,6}\s+\S"), mk(F.length(F.regexp_extract(t, "^(#+)", 1)), strip(F.regexp_replace(t, "^#+", ""))))
        .when((number != "") & (F.length(t) < 120) & ~t.rlike(r"[.;,]$"), mk(number_level(number), t))
        .when(t.rlike(r"^(?:Annex|Appendix)\s+[A-Z0-9]\b") & (F.length(t) < 120), mk(F.lit(1), t))
        .when(t.rlike(r"^[A-Z][A-Z0-9 /&-]{3,79}$") & t.rlike("[A-Z]{3}"), mk(F.lit(2), t))
    )


def number_prefix(c: Column) -> Column:
    """The numbering a title begins with: digits with dots, a letter or a Roman numeral before a stop or bracket."""
    t = strip(c)
    arabic = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)\.?(?:\s|$)", 1)
    roman = F.regexp_extract(t, r"^([IVXLC]+)[.)](?:\s|$)", 1)
    letter = F.regexp_extract(t, r"^([A-Za-z])[.)](?:\s|$)", 1)
    return F.when(arabic != "", arabic).when(roman != "", roman).when(letter != "", letter)


def top_prefix(c: Column) -> Column:
    """The first part of a title's number, or its letter; null without one."""
    p = F.regexp_extract(strip(c), r"^([0-9]+|[A-Z])(?:[.\s]|$)", 1)
    return F.when(p != "", p)


def short_summary(c: Column, longest: int = 200) -> Column:
    """The first sentence on one line, or the first `longest` characters with dots."""
    t = strip(F.regexp_replace(c, r"\s+", " "))
    first = F.regexp_extract(t, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when((first != "") & (F.length(first) <= longest), first).when(F.length(t) <= longest, t).otherwise(F.concat(F.left(t, F.lit(longest)), F.lit("...")))


def despace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def strip_pipes(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\|\s*", " "))


def values_of_pairs(c: Column) -> Column:
    """"a=1, b=2" as "1 2"; parts without an equals sign stay."""
    parts = F.split(c, r"[,;]\s*", -1)
    vals = F.transform(parts, lambda p: strip(F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(p)))
    return F.array_join(F.filter(vals, lambda v: v != ""), " ")


def join_broken_words(c: Column) -> Column:
    """For matching: words broken by a hyphen at a line's end joined, line feeds as blanks, hyphens of one kind."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")
    return F.translate(F.replace(c, F.lit("\n"), F.lit(" ")), "‐‑‒–", "----")


def context_parts(c: Column) -> Column:
    """A question parted at its "(Context n)" labels; without labels the question alone."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"(?i)\s*\(context\s+[0-9]+\)\s*", "\u0001"), "\u0001", -1), strip), lambda p: p != "")
    end = F.right(F.regexp_replace(c, r"\s+$", ""), F.lit(1))
    last = F.element_at(parts, -1)
    fixed = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.when(end.isin(".", "?", "!") & ~last.rlike("[.?!]$"), F.concat(last, end)).otherwise(last)))
    return F.when(F.size(parts) <= 1, F.array(c)).otherwise(fixed)


def question_key(c: Column) -> Column:
    """A question as it compares: lower case, letters and digits of ASCII, without filler words."""
    t = F.regexp_replace(F.lower(c), "[^a-z0-9 \t\n\r\f\x0b]", " ")
    t = F.regexp_replace(t, r"\b(?:" + "|".join(FILLERS) + r")\b", " ")
    return strip(F.regexp_replace(t, r"\s+", " "))


def question_hash(c: Column) -> Column:
    return F.md5(strip(F.regexp_replace(F.lower(c), r"\s+", " ")))


def content_words(c: Column) -> Column:
    """Distinct lower-case words that begin with a letter, have over two characters and are no stop words."""
    ws = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z0-9_]*)"), 1), F.lower)
    return F.array_distinct(F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def strict_value(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def loose_value(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def numeric_value(c: Column) -> Column:
    """A number out of text with blanks, commas or a currency before it; null if it is none."""
    t = F.regexp_replace(c, r"[\s,]|[$€£]", "")
    return F.when(t.rlike(r"^[-+]?[0-9]+(?:\.[0-9]+)?$"), t.cast("double"))


def alpha_ratio(c: Column) -> Column:
    t = despace(c)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t))


def value_kind(c: Column) -> Column:
    """numeric, identifier, text or other."""
    t = strip(c)
    return (
        F.when(numeric_value(t).isNotNull(), "numeric")
        .when(t.rlike(r"^[A-Za-z0-9_./-]{3,}$") & t.rlike("[0-9_]"), "identifier")
        .when((alpha_ratio(t) >= 0.5) & (F.length(t) >= 4), "text")
        .otherwise("other")
    )


def key_signature(c: Column) -> Column:
    """The words of a key, each once, in order of the alphabet."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))), " ")


def keywords(c: Column) -> Column:
    """Distinct words of over four characters without punctuation at their ends, sorted."""
    ws = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(ws, lambda w: F.length(w) > 4)))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def doc_key(c: Column) -> Column:
    """A source id up to its last chunk mark."""
    return F.regexp_replace(c, r"_chunk_[^_]*$", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def rule_hints(c: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The hints of all rules of which a keyword is in the text, in order of the rules."""
    low = F.lower(c)
    hits = []
    for words, hint in rules:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        hits.append(F.when(found, F.lit(hint)))
    return F.array_join(F.array_compact(F.array(*hits)), " ")


def expand_query(c: Column, synonyms: dict[str, list[str]]) -> Column:
    """The query followed by the synonyms of every key in it."""
    low = F.lower(c)
    return F.array_join(F.array_compact(F.array(c, *(F.when(low.contains(k), F.lit(" ".join(v))) for k, v in synonyms.items()))), " ")


def content_type(c: Column) -> Column:
    """code, table, list or prose, by marks per thousand characters."""
    per = lambda p: F.regexp_count(c, F.lit(p)) * 1000.0 / F.greatest(F.length(c), F.lit(1))
    return F.when(per(r"[{};]") > 8, "code").when(per(r"\|") > 8, "table").when(per(r"\n\s*[-*]\s") > 2, "list").otherwise("prose")


def is_noisy_question(c: Column) -> Column:
    """Slang and typing errors, a small first letter, or repeated marks."""
    low = F.lower(c)
    return any_of(low, NOISY) | c.rlike(r"^\p{Ll}") | c.rlike("[?!]{2,}")


def is_vague(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for v in VAGUE:
        out = out | low.rlike(rf"\b{v}\b")
    return out
