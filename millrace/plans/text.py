"""Text operators over the documents, chunks and questions, each with SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from ..operators import repeats as R
from ..runtime import table
from .registry import query

NL = "chr(10)"


def S(e: str) -> str:
    """SQL: `e` without white space at its ends."""
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def LINES(e: str) -> str:
    return f"string_split({e}, {NL})"


def per_line(expr: str, where: str | None = None, e: str = "text") -> str:
    """SQL: every line x of a text as `expr`, those with `where` only."""
    src = LINES(e)
    if where:
        src = f"list_filter({src}, lambda x: {where})"
    return f"array_to_string(list_transform({src}, lambda x: {expr}), {NL})"


def matches(e: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({e}, '{p}')" for p in patterns) + ")"


def scalar(name: str, f: Callable[[Column], Column], sql: str | None, src: str = "documents", key: str = "doc_id", col: str = "text", out: str = "value") -> None:
    """A query of one column function over all rows of a table, whole."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, src, key, col).dropDuplicates([key]).select(key, f(F.col(col)).alias(out))

    oracle = None if sql is None else f"SELECT {key}, {sql.replace('@', col)} AS {out} FROM (SELECT DISTINCT ON ({key}) {key}, {col} FROM {src})"
    query(name, oracle)(run)


TOKENS_SQL = (
    f"list_concat(flatten(list_transform(list_transform(regexp_extract_all(@, '({X.COMPOUND})', 1), lambda x: lower(x)), lambda w: list_concat([w], list_filter(regexp_extract_all(w, '[a-z0-9]+'), lambda p: length(p) > 1)))), "
    f"list_filter(regexp_extract_all(lower(regexp_replace(@, '{X.COMPOUND}', ' ', 'g')), '[a-z0-9]+'), lambda p: length(p) > 1))"
)
WORDS_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all(@, '([A-Za-z][A-Za-z0-9_]*)', 1), lambda x: lower(x)), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "], w)))"
QUESTION_KEY_SQL = S(r"regexp_replace(regexp_replace(regexp_replace(lower(@), '[^a-z0-9\s]', ' ', 'g'), '\b(?:" + "|".join(X.FILLERS) + r")\b', ' ', 'g'), '\s+', ' ', 'g')")
FURNITURE_SQL = f"{S('x')} <> '' AND {matches(S('x'), X.FURNITURE)}"
_LOW = "lower(@)"

scalar("t01_identifier_tokens", lambda c: F.array_join(X.identifier_tokens(c), " "), f"CASE WHEN @ IS NOT NULL THEN array_to_string({TOKENS_SQL}, ' ') END")
scalar("t02_token_count", X.token_count, "CAST(greatest(1, length(@) // 4) AS INTEGER)")
scalar("t05_page_tags", X.strip_page_tags, f"regexp_replace(@, '{X.PAGE_TAG}', ' ', 'g')")
scalar("t06_unicode", lambda c: X.fold_confusables(U.nfc(c)), "replace(translate(translate(nfc_normalize(@), '" + "".join(X.CONFUSABLE).replace("'", "''") + "', '" + "".join(X.CONFUSABLE.values()).replace("'", "''") + "'), '" + X.REMOVED + "', ''), '—', '--')")
scalar("t07_squeeze_space", X.squeeze_space, S(per_line(r"regexp_replace(x, '\s+$', '')", None, r"regexp_replace(replace(@, '\t', ' '), '[ \t\r\f\x0b]+', ' ', 'g')")))
scalar("t08_garbage_lines", X.drop_garbage_lines, per_line(f"CASE WHEN {S('x')} = '' THEN '' ELSE x END", f"{S('x')} = '' OR NOT {matches(S('x'), X.GARBAGE)}", "@"))
scalar("t09_repeated_lines", X.collapse_repeated_lines,
       f"CASE WHEN len({LINES('@')}) < 3 THEN @ ELSE array_to_string(list_filter({LINES('@')}, lambda x, i: {S('x')} = '' OR i <= 2 OR {S('x')} <> {S(LINES('@') + '[i - 1]')} OR {S('x')} <> {S(LINES('@') + '[i - 2]')}), {NL}) END")
scalar("t10_furniture_lines", X.strip_furniture, per_line("x", f"NOT ({FURNITURE_SQL})", "@"), "parent_chunks", "id")
scalar("t12_bullets", X.dash_bullets, per_line(rf"regexp_replace(x, '^(\s*)[{X.BULLETS}]\s*', '\1- ')", None, "@"))
scalar("t13_numbered_lists", X.space_numbered, per_line(r"regexp_replace(regexp_replace(x, '^(\s*)([0-9]{1,3}|[a-zA-Z])）', '\1\2)'), '^(\s*)([0-9]{1,3}|[a-zA-Z])([.)\]])\s*', '\1\2\3 ')", None, "@"))
_T = r"regexp_replace(@, '\s+$', '')"
scalar("t14_incomplete", X.is_incomplete,
       rf"CASE WHEN @ IS NULL THEN NULL WHEN {_T} = '' THEN false WHEN regexp_matches(right({_T}, 1), '[.!?;:。！？；]') THEN false WHEN regexp_matches(right({_T}, 1), '[)\]}}]') AND length({_T}) > 3 THEN false WHEN {_T} LIKE '#%' OR {_T} LIKE '%|' OR {_T} LIKE '%```' THEN false ELSE regexp_matches(right({_T}, 1), '[-,\p{{Ll}}]') END",
       "child_chunks", "id", "raw_text")
_H = r"regexp_replace(@, '^\s+', '')"
scalar("t15_continuation", X.is_continuation,
       rf"CASE WHEN @ IS NULL THEN NULL WHEN {_H} = '' THEN false ELSE regexp_matches({_H}, '^\p{{Ll}}') OR regexp_replace(lower(regexp_extract({_H}, '^(\S*)', 1)), '[.,;:]+$', '') IN ({', '.join(repr(w) for w in X.CONTINUES)}) END",
       "child_chunks", "id", "raw_text")
scalar("t16_table_cells", X.trim_cells, per_line(rf"CASE WHEN contains(x, '|') THEN array_to_string(list_transform(string_split(x, '|'), lambda y: {S('y')}), ' | ') ELSE x END", None, "@"))
_P = S("@")
_QUALITY = rf"""CASE WHEN @ IS NULL THEN NULL WHEN length({_P}) = 0 THEN 0.0 WHEN length(regexp_replace({_P}, '[^\p{{L}}]', '', 'g')) / length({_P}) < 0.1 THEN length(regexp_replace({_P}, '[^\p{{L}}]', '', 'g')) / length({_P})
    ELSE least(1.0, 0.35 * length(regexp_replace({_P}, '[^\p{{L}}]', '', 'g')) / length({_P}) + 0.25 * length(regexp_replace({_P}, '[^\p{{L}}\p{{N}}]', '', 'g')) / length({_P})
    + 0.2 * (CASE WHEN length(regexp_replace({_P}, '\s+', '', 'g')) / len(regexp_split_to_array({_P}, '\s+')) BETWEEN 3 AND 12 THEN 1.0 WHEN length(regexp_replace({_P}, '\s+', '', 'g')) / len(regexp_split_to_array({_P}, '\s+')) < 2 OR length(regexp_replace({_P}, '\s+', '', 'g')) / len(regexp_split_to_array({_P}, '\s+')) > 20 THEN 0.2 ELSE 0.6 END)
    + 0.2 * (CASE WHEN contains({_P}, ' ') THEN 1.0 ELSE 0.3 END)) END"""
scalar("t17_block_quality", lambda c: F.round(X.block_quality(c), 6), f"round(CAST({_QUALITY} AS DOUBLE), 6)")
scalar("t18_low_quality", lambda c: X.block_quality(c) < 0.3, f"({_QUALITY}) < 0.3")
_XREF = r"(\[(?:" + "|".join(X.XREF_PREFIXES) + r")_[A-Za-z]+_[0-9]{4,6}\])"


@query("t19_cross_references", f"""
    WITH d AS (SELECT DISTINCT ON (id) id, text FROM parent_chunks WHERE text IS NOT NULL),
    r AS (SELECT id, 'requirements' AS kind, unnest(regexp_extract_all(text, '{_XREF}', 1)) AS ref FROM d
          UNION ALL SELECT id, 'sections', unnest(regexp_extract_all(text, '(?:[Ss]ection|[Ss]ee|[Cc]hapter|[Aa]nnex)\\s+([0-9]+(?:\\.[0-9]+)*)', 1)) FROM d
          UNION ALL SELECT id, 'tables', 'Table ' || unnest(regexp_extract_all(text, '[Tt]able\\s+([0-9]+(?:[.-][0-9]+)?)', 1)) FROM d
          UNION ALL SELECT id, 'figures', 'Figure ' || unnest(regexp_extract_all(text, '(?:[Ff]igure|[Ff]ig\\.?)\\s+([0-9]+(?:[.-][0-9]+)?)', 1)) FROM d)
    SELECT DISTINCT id, kind, ref FROM r""")  # fmt: skip
def t19(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).where("text IS NOT NULL")
    return t.select("id", F.explode(X.cross_references(F.col("text"))).alias("kind", "refs")).select("id", "kind", F.explode("refs").alias("ref"))


_ROWS = r"list_filter(list_transform(list_filter(list_transform(string_split(@, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: contains(x, '|')), lambda x: list_transform(string_split(regexp_replace(x, '^\||\|$', '', 'g'), '|'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g'))), lambda r: len(list_filter(r, lambda x: NOT regexp_matches(x, '^:?-{2,}:?$'))) > 0)"
_PIPED = "len(list_filter(string_split(@, chr(10)), lambda x: contains(x, '|')))"
scalar("t20_table_header", lambda c: F.array_join(F.get(X.table_rows(c), F.lit(0)), "|"), f"CASE WHEN {_PIPED} >= 2 THEN array_to_string(({_ROWS})[1], '|') END")
scalar("t20_table_cells", lambda c: F.coalesce(F.size(X.table_rows(c)) * F.size(F.get(X.table_rows(c), F.lit(0))), F.lit(-1)), f"coalesce(CASE WHEN {_PIPED} >= 2 THEN CAST(len({_ROWS}) * len(({_ROWS})[1]) AS INTEGER) END, -1)")


@query("t22_repeats")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return R.truncate_repeats(table(spark, d, "documents", "doc_id", "text")).select("doc_id", F.md5("text").alias("content"))


@query("t23_dominant_line", rf"""
    WITH d AS (SELECT doc_id, text || chr(10) || repeat('same line' || chr(10), doc_id % 3 * 60) || text AS text FROM documents), l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
    u AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM l), k AS (SELECT doc_id, {S('x')} AS x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u WHERE {S('x')} <> ''),
    c AS (SELECT doc_id, x, count(*) AS c, min(n) AS f, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM k GROUP BY doc_id, x), t AS (SELECT doc_id, arg_max(x, (c, -f)) AS x, max(c) AS c, any_value(total) AS total FROM c GROUP BY doc_id),
    r AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY n) AS x1, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY n) AS x2 FROM k),
    h AS (SELECT r.doc_id, min(i) AS i FROM r JOIN t ON r.doc_id = t.doc_id AND r.x = t.x WHERE x1 = r.x AND x2 = r.x AND t.c >= 10 AND t.c >= 0.8 * t.total GROUP BY r.doc_id)
    SELECT l.doc_id, md5(CASE WHEN h.i IS NULL THEN text ELSE array_to_string(ls[:h.i + 1], chr(10)) END) AS content FROM l LEFT JOIN h ON l.doc_id = h.doc_id""")
def t23(spark: SparkSession, d: str) -> DataFrame:
    """Documents, some with a line many times between two copies of their text."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.concat("text", F.lit("\n"), F.repeat(F.lit("same line\n"), (F.col("doc_id") % 3 * 60).cast("int")), "text").alias("text"))
    return R.cut_dominant_lines(t).select("doc_id", F.md5("text").alias("content"))


scalar("t24_formula_number", X.formula_number, rf"CASE WHEN regexp_matches({_P}, '^[(（].*[)）]$') THEN {S('regexp_extract(' + _P + ', ' + chr(39) + '^[(（](.*)[)）]$' + chr(39) + ', 1)')} ELSE {_P} END", "child_chunks", "id", "section_title")
scalar("t25_region", X.clean_region, S(r"regexp_replace(regexp_replace(regexp_replace(@, '^(?:\\t)+|(?:\\t)+$', '', 'g'), '\.{4,}', '...', 'g'), '_{4,}', '___', 'g')"))
_BP = "NOT (regexp_matches(x, '^\\s*Document ID\\s+[0-9]+\\s*:') OR regexp_matches(x, '^\\s*[0-9]+\\s+of\\s+[0-9]+\\s*$')" + "".join(f" OR contains(lower(x), '{m}')" for m in X.BOILERPLATE) + ")"
scalar("t29_boilerplate", X.strip_boilerplate, per_line("x", _BP, "@"), "parent_chunks", "id")
_FILLED = f"list_filter({LINES('@')}, lambda x: {S('x')} <> '')"
_TOC = rf"""CASE WHEN @ IS NULL THEN NULL WHEN {_P} = '' THEN 0 ELSE (CASE WHEN regexp_matches(@, '(?:\. ){{5,}}') OR regexp_matches(@, '\.{{5,}}') THEN 2 ELSE 0 END)
    + (CASE WHEN len(list_filter({_FILLED}, lambda x: regexp_matches({S('x')}, '\s+[0-9]{{1,4}}$'))) > 0.5 * len({_FILLED}) THEN 2 ELSE 0 END)
    + (CASE WHEN regexp_matches(@, '\b[0-9]+\.[0-9]+(?:\.[0-9]+)*\s+\S+') AND contains(@, '...') THEN 1 ELSE 0 END) END"""
scalar("t30_toc_score", X.toc_score, _TOC, "parent_chunks", "id")
scalar("f02_not_toc", lambda c: X.toc_score(c) < 3, f"({_TOC}) < 3", "parent_chunks", "id")
_PF = f"list_filter({LINES(_P)}, lambda x: {S('x')} <> '')"
scalar("t31_toc_page", X.is_toc_page, rf"CASE WHEN @ IS NULL THEN NULL WHEN length({_P}) < 50 THEN true WHEN length({_P}) > 800 THEN false WHEN len({_PF}) < 3 THEN false ELSE len(list_filter({_PF}, lambda x: regexp_matches(x, '(?:\.\s*){{2,}}.*[0-9]+\s*$'))) >= 0.4 * len({_PF}) END")
scalar("t32_toc_page_headings", lambda c: (F.size(F.filter(X.lines(c), lambda x: X.toc_entry(x).isNotNull())) >= F.greatest(F.lit(3), F.ceil(0.3 * F.size(X.filled_lines(c))).cast("int"))),
       rf"len(list_filter({LINES('@')}, lambda x: regexp_matches(x, '^\s*((?:[0-9]+|[A-Z])(?:\.[0-9]+)*)\.?\s+(.*?\S)\s*(?:\.\s*){{2,}}\s*([0-9]+)\s*$'))) >= greatest(3, CAST(ceil(0.3 * len({_FILLED})) AS INTEGER))")
scalar("t34_number_level", X.number_level, r"CASE WHEN @ IS NULL THEN NULL WHEN regexp_matches(@, '^[A-Za-z]') THEN 1 ELSE CAST(least(6, len(string_split(regexp_replace(@, '\.+$', ''), '.'))) AS INTEGER) END", "child_chunks", "id", "section_title")
scalar("t36_heading", lambda c: F.concat_ws(":", X.heading(c)["level"].cast("string"), X.heading(c)["title"]), None, "child_chunks", "id", "section_title")
scalar("t39_number_prefix", X.number_prefix, rf"CASE WHEN regexp_extract({_P}, '^([0-9]+(?:\.[0-9]+)*)\.?(?:\s|$)', 1) <> '' THEN regexp_extract({_P}, '^([0-9]+(?:\.[0-9]+)*)\.?(?:\s|$)', 1) WHEN regexp_extract({_P}, '^([IVXLC]+)[.)](?:\s|$)', 1) <> '' THEN regexp_extract({_P}, '^([IVXLC]+)[.)](?:\s|$)', 1) WHEN regexp_extract({_P}, '^([A-Za-z])[.)](?:\s|$)', 1) <> '' THEN regexp_extract({_P}, '^([A-Za-z])[.)](?:\s|$)', 1) END", "child_chunks", "id", "section_title")
scalar("t40_top_prefix", X.top_prefix, rf"nullif(regexp_extract({_P}, '^([0-9]+|[A-Z])(?:[.\s]|$)', 1), '')", "child_chunks", "id", "section_title")
_ONE = S(r"regexp_replace(@, '\s+', ' ', 'g')")
scalar("t42_summary", X.short_summary, rf"CASE WHEN @ IS NULL THEN NULL WHEN regexp_extract({_ONE}, '^(.*?[.!?])(?:\s|$)', 1) <> '' AND length(regexp_extract({_ONE}, '^(.*?[.!?])(?:\s|$)', 1)) <= 200 THEN regexp_extract({_ONE}, '^(.*?[.!?])(?:\s|$)', 1) WHEN length({_ONE}) <= 200 THEN {_ONE} ELSE left({_ONE}, 200) || '...' END", "parent_chunks", "id")
scalar("t43_match_form", lambda c: X.join_broken_words(U.nfkc(c)), None, "parent_chunks", "id")
scalar("t44_despaced", lambda c: X.despace(X.strip_pipes(c)), r"regexp_replace(" + S(r"regexp_replace(@, '\s*\|\s*', ' ', 'g')") + r", '\s+', '', 'g')")
scalar("t44_pair_values", X.values_of_pairs, r"array_to_string(list_filter(list_transform(regexp_split_to_array(@, '[,;]\s*'), lambda p: regexp_replace(CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE p END, '^\s+|\s+$', '', 'g')), lambda v: v <> ''), ' ')", "gold_records", "id", "reference")
scalar("t45_context_parts", lambda c: F.array_join(X.context_parts(F.replace(c, F.lit(","), F.lit(" (Context 1)"))), "|"), None, "gold_records", "id", "user_input")
scalar("t46_question_key", X.question_key, QUESTION_KEY_SQL, "gold_records", "id", "user_input")
scalar("t47_question_hash", X.question_hash, f"md5({S('regexp_replace(lower(@), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})", "hybrid_rows", "row_id", "query")
scalar("t48_content_words", lambda c: F.array_join(F.array_sort(X.content_words(c)), " "), f"array_to_string(list_sort({WORDS_SQL}), ' ')", "gold_records", "id", "reference")
scalar("t49_values", lambda c: F.concat_ws("|", X.strict_value(c), X.loose_value(c)), S(r"regexp_replace(@, '\s+', ' ', 'g')").join(["lower(", r") || '|' || regexp_replace(lower(@), '[^a-z0-9]', '', 'g')"]), "gold_records", "id", "user_input")
scalar("t49_numbers", X.numeric_value, r"CASE WHEN regexp_matches(regexp_replace(@, '[\s,]|[$€£]', '', 'g'), '^[-+]?[0-9]+(?:\.[0-9]+)?$') THEN CAST(regexp_replace(@, '[\s,]|[$€£]', '', 'g') AS DOUBLE) END", "hybrid_rows", "row_id", "ground_truth")
scalar("t50_value_kind", X.value_kind, rf"CASE WHEN @ IS NULL THEN 'other' WHEN regexp_matches(regexp_replace({_P}, '[\s,]|[$€£]', '', 'g'), '^[-+]?[0-9]+(?:\.[0-9]+)?$') THEN 'numeric' WHEN regexp_matches({_P}, '^[A-Za-z0-9_./-]{{3,}}$') AND regexp_matches({_P}, '[0-9_]') THEN 'identifier' WHEN length(regexp_replace({_P}, '\s+', '', 'g')) > 0 AND length(regexp_replace(regexp_replace({_P}, '\s+', '', 'g'), '[^\p{{L}}]', '', 'g')) / length(regexp_replace({_P}, '\s+', '', 'g')) >= 0.5 AND length({_P}) >= 4 THEN 'text' ELSE 'other' END", "hybrid_rows", "row_id", "ground_truth")
scalar("t51_key_signature", X.key_signature, r"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(@), '[^a-z0-9]+'), lambda w: w <> ''))), ' ')", "hybrid_rows", "row_id", "query")
scalar("t52_content_type", X.content_type, r"CASE WHEN @ IS NULL THEN 'prose' WHEN len(regexp_extract_all(@, '[{};]')) * 1000.0 / greatest(length(@), 1) > 8 THEN 'code' WHEN len(regexp_extract_all(@, '\|')) * 1000.0 / greatest(length(@), 1) > 8 THEN 'table' WHEN len(regexp_extract_all(@, '\n\s*[-*]\s')) * 1000.0 / greatest(length(@), 1) > 2 THEN 'list' ELSE 'prose' END")
scalar("t55_keywords", lambda c: F.array_join(X.keywords(c), " "), r"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(@), '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: length(w) > 4))), ' ')")
scalar("t56_safe_filename", X.safe_filename, r"regexp_replace(regexp_replace(@, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')", "documents", "doc_id", "section_title")
scalar("t56_doc_key", X.doc_key, r"regexp_replace(@, '_chunk_[^_]*$', '')", "documents", "doc_id", "source")
RULES = [(["calibration", "calib"], "prefer calibration chapters"), (["session", "diag"], "prefer diagnostic chapters"), (["bus", "network"], "prefer communication chapters")]
_HINTS = "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(@), '{w}')" for w in ws) + f" THEN '{h}' END" for ws, h in RULES) + "], lambda x: x IS NOT NULL), ' ')"
scalar("t57_rule_hints", lambda c: X.rule_hints(c, RULES), _HINTS, "gold_records", "id", "user_input")
SYNONYMS = {"timeout": ["deadline", "expiry"], "gateway": ["router"], "sensor": ["detector"]}
scalar("t58_expand_query", lambda c: X.expand_query(c, SYNONYMS), "array_to_string(list_filter([@, " + ", ".join(f"CASE WHEN contains(lower(@), '{k}') THEN '{' '.join(v)}' END" for k, v in SYNONYMS.items()) + "], lambda x: x IS NOT NULL), ' ')", "gold_records", "id", "user_input")
VAGUE_QUERY = "how|why|explain|describe|compare|overview|relationship|difference|impact|effect|together|determine|purpose|role|interact|affect|influence"
scalar("t59_expansion_trigger", lambda c: F.lower(c).rlike(VAGUE_QUERY), f"regexp_matches(lower(@), '{VAGUE_QUERY}')", "gold_records", "id", "user_input")
scalar("t60_ansi", X.strip_ansi, r"regexp_replace(@, '\x1b\[[0-9;]*[A-Za-z]', '', 'g')")
scalar("f01_noisy_question", X.is_noisy_question, matches(_LOW, X.NOISY) + r" OR regexp_matches(@, '^\p{Ll}') OR regexp_matches(@, '[?!]{2,}')", "gold_records", "id", "user_input")
_BPT = S(per_line("x", _BP, "@"))
scalar("f03_substance", lambda c: (F.length(X.strip(X.strip_boilerplate(c))) >= 200) & X.strip_boilerplate(c).rlike("[.!?]"), f"length({_BPT}) >= 200 AND regexp_matches({_BPT}, '[.!?]')", "parent_chunks", "id")
scalar("f05_vague_reference", X.is_vague, matches(_LOW, [rf"\b{v}\b" for v in X.VAGUE]), "gold_records", "id", "reference")


@query("t03_hard_split", """
    SELECT doc_id, CAST(i AS INTEGER) AS pos, substring(text, CAST(i * 400 + 1 AS BIGINT), 400) AS piece
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")  # fmt: skip
def t03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(X.hard_split(F.col("text"), 100)).alias("pos", "piece"))


@query("t04_sentences", rf"""
    SELECT doc_id, CAST(i AS INTEGER) - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM
    (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {S('x')} <> '') AS s FROM documents WHERE text IS NOT NULL))""")  # fmt: skip
def t04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("t33_toc_lines", r"""
    SELECT id, regexp_extract(l, p, 1) AS number, regexp_extract(l, p, 2) AS title, CAST(regexp_extract(l, p, 3) AS INTEGER) AS page
    FROM (SELECT id, unnest(string_split(section_title || ' ..... ' || coalesce(page_number, 7), chr(10))) AS l, '^\s*((?:[0-9]+|[A-Z])(?:\.[0-9]+)*)\.?\s+(.*?\S)\s*(?:\.\s*){2,}\s*([0-9]+)\s*$' AS p
          FROM (SELECT DISTINCT ON (id) id, section_title, page_number FROM parent_chunks WHERE section_title IS NOT NULL)) WHERE regexp_matches(l, p)""")  # fmt: skip
def t33(spark: SparkSession, d: str) -> DataFrame:
    """Contents lines, made of the chunks' titles and pages."""
    t = table(spark, d, "parent_chunks", "id", "section_title", "page_number").dropDuplicates(["id"])
    line = F.explode(X.lines(F.concat(F.col("section_title"), F.lit(" ..... "), F.coalesce("page_number", F.lit(7)).cast("string")))).alias("l")
    return t.select("id", line).select("id", X.toc_entry(F.col("l")).alias("e")).where("e IS NOT NULL").select("id", "e.*")


@query("t37_block_type", r"""
    SELECT doc_id, i AS pos, CASE WHEN regexp_matches(b, '^(?:```|\s*/\*)') THEN 'code' WHEN regexp_matches(b, '^\s*\|.*\|') THEN 'table' WHEN regexp_matches(b, '^\s*[-*•]\s') THEN 'list'
           WHEN regexp_matches(b, '^[0-9]+(?:\.[0-9]+)+\s') AND NOT contains(b, chr(10)) THEN 'heading' ELSE 'paragraph' END AS kind
    FROM (SELECT doc_id, CAST(i AS INTEGER) - 1 AS i, s[i] AS b FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM
    (SELECT doc_id, list_filter(string_split(replace(text, chr(13), ''), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS s FROM documents WHERE text IS NOT NULL)))""")  # fmt: skip
def t37(spark: SparkSession, d: str) -> DataFrame:
    """Blocks parted by empty lines, by kind."""
    t = table(spark, d, "documents", "doc_id", "text")
    b = F.col("b")
    kind = F.when(b.rlike(r"^(?:```|\s*/\*)"), "code").when(b.rlike(r"^\s*\|.*\|"), "table").when(b.rlike(r"^\s*[-*•]\s"), "list").when(b.rlike(r"^[0-9]+(?:\.[0-9]+)+\s") & ~b.contains("\n"), "heading").otherwise("paragraph")
    blocks = F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n\n", -1), lambda x: X.strip(x) != "")
    return t.select("doc_id", F.posexplode(blocks).alias("pos", "b")).select("doc_id", "pos", kind.alias("kind"))


@query("t53_table_sentences", r"""
    WITH t AS (SELECT DISTINCT ON (id) id, text AS "@" FROM parent_chunks),
    r AS (SELECT id, rows FROM (SELECT id, """ + _ROWS.replace("@", '"@"') + r""" AS rows, """ + _PIPED.replace("@", '"@"') + r""" AS n FROM t) WHERE n >= 2),
    x AS (SELECT id, rows[1] AS h, unnest(rows[2:]) AS c FROM r)
    SELECT id, array_to_string(list_filter(list_transform(range(1, least(len(h), len(c)) + 1), lambda i: CASE WHEN h[i] <> '' AND c[i] <> '' THEN h[i] || ' is ' || c[i] END), lambda s: s IS NOT NULL), ', ') AS sentence FROM x""")  # fmt: skip
def t53(spark: SparkSession, d: str) -> DataFrame:
    """Every body row of a pipe table as "header is cell" pairs."""
    t = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).withColumn("rows", X.table_rows(F.col("text"))).where("rows IS NOT NULL")
    t = t.select("id", F.get("rows", F.lit(0)).alias("h"), F.explode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("c"))
    pairs = F.zip_with(F.slice("h", F.lit(1), F.least(F.size("h"), F.size("c"))), F.slice("c", F.lit(1), F.least(F.size("h"), F.size("c"))), lambda h, c: F.when((h != "") & (c != ""), F.concat(h, F.lit(" is "), c)))
    return t.select("id", F.array_join(pairs, ", ").alias("sentence"))


@query("t26_format_by_label")
def t26(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written by their kind: titles with marks, list items with dashes, code fenced, paragraphs as they are."""
    b = F.col("b")
    kinds = t37(spark, d)
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n\n", -1), lambda x: X.strip(x) != "")).alias("pos", "b"))
    made = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), b)).when(F.col("kind") == "list", X.dash_bullets(b)).when((F.col("kind") == "code") & ~b.startswith("```"), F.concat(F.lit("```\n"), b, F.lit("\n```"))).otherwise(b)
    return t.join(kinds, ["doc_id", "pos"]).select("doc_id", "pos", "kind", made.alias("block"))


@query("t27_label_map", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'conversion' ELSE 'other' END AS label FROM events""")  # fmt: skip
def t27(spark: SparkSession, d: str) -> DataFrame:
    """Labels by a map of a few entries, as a literal in the plan."""
    m = F.create_map(*(F.lit(x) for kv in {"click": "interaction", "view": "impression", "purchase": "conversion"}.items() for x in kv))
    return table(spark, d, "events", "event_id", "event_type").select("event_id", F.coalesce(m[F.col("event_type")], F.lit("other")).alias("label"))


@query("t28_markdown", None)
def t28(spark: SparkSession, d: str) -> DataFrame:
    """Markdown tidied: section numbers as headings (four levels at most), requirement ids as code, at most one empty line."""
    c = F.regexp_replace(F.replace("text", F.lit("\r"), F.lit("")), r"(?m)^([0-9]+(?:\.[0-9]+){0,3})\.?[ \t]+([A-Z][^\n.]{2,80})$", "# $1 $2")
    for depth in (3, 2, 1):
        c = F.regexp_replace(c, rf"(?m)^# ([0-9]+(?:\.[0-9]+){{{depth}}} )", "#" * (depth + 1) + " $1")
    c = F.regexp_replace(c, r"(?<![`\w])((?:REQ|SPC|TST)_[A-Za-z]+_[0-9]{4,6})(?![`\w])", "`$1`")
    return table(spark, d, "documents", "doc_id", "text", "source").select("doc_id", F.concat(F.lit("<!-- source: "), "source", F.lit(" -->\n"), F.regexp_replace(c, r"\n{3,}", "\n\n")).alias("markdown"))


@query("t21_protected_normalise")
def t21(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers stay as they are while the text around them is folded: the text is parted at identifiers, which keep
    their place, and every other part is folded by built-in functions; no placeholders are needed."""
    ident = r"(\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b)"
    parts = F.split(F.regexp_replace("text", ident, "\u0001\u0002$1\u0001"), "\u0001", -1)
    folded = F.transform(parts, lambda p: F.when(p.startswith("\u0002"), F.substring(p, 2, 1_000_000)).otherwise(F.regexp_replace(X.dash_bullets(X.fold_confusables(p)), "[ \t]+", " ")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(folded, "").alias("value"))


@query("t54_table_prose")
def t54(spark: SparkSession, d: str) -> DataFrame:
    """Pipe tables written as markdown, and as "h=v" prose."""
    t = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).withColumn("rows", X.pad_rows(X.table_rows(F.col("text")))).where("rows IS NOT NULL AND size(rows) > 1")
    head = F.get("rows", F.lit(0))
    body = F.slice("rows", F.lit(2), F.size("rows") - 1)
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(head, lambda _: F.lit("---")), "|"), F.lit("|"))
    markdown = F.array_join(F.concat(F.array(row(head), rule), F.transform(body, row)), "\n")
    prose = F.array_join(F.transform(body, lambda r: F.array_join(F.zip_with(F.get("rows", F.lit(0)), r, lambda h, v: F.concat(h, F.lit("="), v)), "; ")), ". ")
    return t.select("id", markdown.alias("markdown"), prose.alias("prose"))


@query("t35_title_before_contents", r"""
    SELECT id, title FROM (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 5 AND 120 AND NOT regexp_matches(x, '(?:\.\s*){3,}') AND NOT regexp_matches(x, '^[0-9\W]+$'))[1] AS title
    FROM (SELECT DISTINCT ON (id) id, text FROM parent_chunks WHERE text IS NOT NULL)) WHERE title IS NOT NULL""")  # fmt: skip
def t35(spark: SparkSession, d: str) -> DataFrame:
    ok = F.filter(F.transform(X.lines(F.col("text")), X.strip), lambda x: F.length(x).between(5, 120) & ~x.rlike(r"(?:\.\s*){3,}") & ~x.rlike(r"^[0-9\W]+$"))
    return table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).select("id", F.get(ok, F.lit(0)).alias("title")).where("title IS NOT NULL")


@query("t38_element_depth", r"""
    SELECT id, CASE WHEN section_title IS NULL THEN 0 WHEN regexp_matches(section_title, '^[0-9]+(?:\.[0-9]+)*\s') THEN least(6, len(string_split(regexp_extract(section_title, '^([0-9]+(?:\.[0-9]+)*)', 1), '.')))
           WHEN regexp_matches(section_title, '^(?:Annex|Appendix)') THEN 1 WHEN section_title = upper(section_title) THEN 1 ELSE 2 END AS depth FROM (SELECT DISTINCT ON (id) id, section_title FROM child_chunks)""")  # fmt: skip
def t38(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("section_title")
    depth = F.when(c.isNull(), 0).when(c.rlike(r"^[0-9]+(?:\.[0-9]+)*\s"), X.number_level(F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)*)", 1))).when(c.rlike("^(?:Annex|Appendix)"), 1).when(c == F.upper(c), 1).otherwise(2)
    return table(spark, d, "child_chunks", "id", "section_title").dropDuplicates(["id"]).select("id", depth.cast("long").alias("depth"))


@query("t41_heading_match", r"""
    WITH h AS (SELECT DISTINCT ON (id) id, section_title, text FROM parent_chunks WHERE section_title IS NOT NULL AND text IS NOT NULL),
    n AS (SELECT id, regexp_replace(lower(section_title), '[^a-z0-9]+', ' ', 'g') AS a, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g') AS b FROM h)
    SELECT id, (regexp_extract(a, '^([0-9]+)', 1) <> '' AND a = b) OR (length(a) > 0 AND length(b) > 0 AND (contains(b, a) OR contains(a, b)) AND least(length(a), length(b)) >= 0.75 * greatest(length(a), length(b))) AS matched FROM n""")  # fmt: skip
def t41(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chunk begins with its section's title: the same, or one holding the other at three quarters of its length."""
    t = table(spark, d, "parent_chunks", "id", "section_title", "text").dropDuplicates(["id"]).where("section_title IS NOT NULL AND text IS NOT NULL")
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    t = t.select("id", norm(F.col("section_title")).alias("a"), norm(F.get(X.lines(F.col("text")), F.lit(0))).alias("b"))
    a, b = F.col("a"), F.col("b")
    near = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(b, a) | F.contains(a, b)) & (F.least(F.length(a), F.length(b)) >= 0.75 * F.greatest(F.length(a), F.length(b)))
    return t.select("id", ((a.rlike("^[0-9]+") & (a == b)) | near).alias("matched"))
