"""Queries that cut and pack texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as C
from ..runtime import table
from .registry import query


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


@query("c01_parent_chunks")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return C.parents(docs(spark, d))


@query("c02_child_chunks")
def c02(spark: SparkSession, d: str) -> DataFrame:
    return C.children(table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]))


@query("c03_character_windows")
def c03(spark: SparkSession, d: str) -> DataFrame:
    return C.rows_from_text(docs(spark, d), "doc_id", "text", lambda s: [p for _, p in C.windows(s, 1000, 100)])


_HEAD = r"(?:[0-9]+(?:\.[0-9]+)+\s+[A-Z].*|\[[A-Z]+_[A-Za-z0-9_]+\].*|#{1,6}\s+.+)"


@query("c04_sections", rf"""
    WITH l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
    g AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
    SELECT doc_id, section::INTEGER AS section, max(CASE WHEN regexp_full_match(line, '{_HEAD}') THEN line END) AS title, count(*) AS n_lines FROM g GROUP BY doc_id, section""")
def c04(spark: SparkSession, d: str) -> DataFrame:
    """Sections as runs of lines that follow a heading: counted within each text, so that only counts are grouped."""
    ls = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)
    marked = F.regexp_replace(F.array_join(F.transform(ls, lambda x: F.when(x.rlike(f"^{_HEAD}$"), F.concat(F.lit("\u0001"), x)).otherwise(x)), "\n"), "^\u0001", "\u0002\u0001")
    parts = F.split(marked, "\u0001", -1)
    t = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(parts).alias("section", "body"))
    title = F.when(F.col("section") > 0, F.get(X.lines(F.col("body")), F.lit(0)))
    clean = F.regexp_replace("body", r"\n\z", "")
    last = F.col("section") == F.max("section").over(Window.partitionBy("doc_id"))
    body = F.when(last, F.col("body")).otherwise(clean)
    return t.where(F.col("body") != "\u0002").select("doc_id", "section", title.alias("title"), F.size(X.lines(body)).cast("long").alias("n_lines"))


@query("c06_heading_split", rf"""
    WITH l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL)))
    SELECT doc_id, i::INTEGER - 1 AS line_no, line AS heading FROM l WHERE regexp_full_match(line, '{_HEAD}') AND length(trim(line)) > 3""")
def c06(spark: SparkSession, d: str) -> DataFrame:
    ls = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)
    t = docs(spark, d).select("doc_id", F.posexplode(ls).alias("line_no", "line"))
    return t.where(F.col("line").rlike(f"^{_HEAD}$") & (F.length(F.trim("line")) > 3)).select("doc_id", "line_no", F.col("line").alias("heading"))


@query("c05_bookmark_split", """
    WITH c AS (SELECT DISTINCT ON (id) id, section_title AS b, text FROM parent_chunks WHERE section_title IS NOT NULL AND text IS NOT NULL)
    SELECT id, (instr(text, b) - 1)::INTEGER AS begin, CASE WHEN instr(text, b) > 0 THEN length(text) - (instr(text, b) - 1) - length(b) ELSE length(text) END::INTEGER AS body FROM c""")  # fmt: skip
def c05(spark: SparkSession, d: str) -> DataFrame:
    """Where a chunk's bookmark stands in its text (-1 if not), and how much follows."""
    c = table(spark, d, "parent_chunks", "id", "section_title", "text").dropDuplicates(["id"]).where("section_title IS NOT NULL AND text IS NOT NULL")
    at = F.instr(F.col("text"), F.col("section_title"))
    return c.select("id", (at - 1).alias("begin"), F.when(at > 0, F.length("text") - (at - 1) - F.length("section_title")).otherwise(F.length("text")).alias("body"))


@query("c07_page_marker_chunks")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return C.rows_from_text(table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]), "id", "text", lambda s: C.pack(s, 500, 120, 1))


@query("c08_page_groups")
def c08(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parent_chunks", "id", "filename", "page_number", "text").dropDuplicates(["id"]).groupBy("filename", "page_number").agg(F.sum(X.token_count(F.coalesce("text", F.lit("")))).alias("n"))
    return C.page_groups(pages, "filename", "page_number", "n", 20_000)


@query("c09_section_packing", r"""
    WITH c AS (SELECT DISTINCT filename, regexp_extract(section_title, '^([0-9]+)', 1) AS top, section_title FROM child_chunks WHERE filename IS NOT NULL AND regexp_matches(section_title, '^[0-9]+'))
    SELECT filename, top, count(*) AS sections, ((row_number() OVER (PARTITION BY filename ORDER BY top::INTEGER) - 1) // 3)::INTEGER AS pack FROM c GROUP BY filename, top""")  # fmt: skip
def c09(spark: SparkSession, d: str) -> DataFrame:
    """Sections by chapter, three chapters a pack; chapters are never parted."""
    c = table(spark, d, "child_chunks", "filename", "section_title").where(F.col("filename").isNotNull() & F.col("section_title").rlike("^[0-9]+")).distinct()
    g = c.groupBy("filename", F.regexp_extract("section_title", "^([0-9]+)", 1).alias("top")).agg(F.count(F.lit(1)).alias("sections"))
    w = Window.partitionBy("filename").orderBy(F.col("top").cast("int"))
    return g.select("filename", "top", "sections", F.floor((F.row_number().over(w) - 1) / 3).cast("int").alias("pack"))


@query("c10_page_windows", "SELECT DISTINCT id, ((page_number - 1) // 10)::INTEGER AS page_window FROM child_chunks WHERE page_number IS NOT NULL")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "child_chunks", "id", "page_number").where("page_number IS NOT NULL").select("id", F.floor((F.col("page_number") - 1) / 10).cast("int").alias("page_window")).distinct()


@query("c11_context_prefix", """
    SELECT id, 'This chunk is from ' || filename || ', section ''' || CASE WHEN len(coalesce(section_hierarchy, [])) > 0 THEN array_to_string(section_hierarchy, ' > ') ELSE coalesce(section_title, '') END || ''', covering ' || coalesce(section_title, '') || '.' || chr(10) || chr(10) || raw_text AS enriched
    FROM (SELECT DISTINCT ON (id) * FROM child_chunks) WHERE filename IS NOT NULL AND raw_text IS NOT NULL""")  # fmt: skip
def c11(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "filename", "section_hierarchy", "section_title", "raw_text").dropDuplicates(["id"]).where("filename IS NOT NULL AND raw_text IS NOT NULL")
    title = F.coalesce("section_title", F.lit(""))
    path = F.when(F.size("section_hierarchy") > 0, F.array_join("section_hierarchy", " > ")).otherwise(title)
    return c.select("id", F.concat(F.lit("This chunk is from "), "filename", F.lit(", section '"), path, F.lit("', covering "), title, F.lit(".\n\n"), "raw_text").alias("enriched"))


@query("c12_size_sweep", """
    WITH p AS (SELECT DISTINCT ON (id) id, length(text) AS n FROM parent_chunks WHERE text IS NOT NULL), s AS (SELECT unnest([256, 512, 1024]) AS size)
    SELECT size::INTEGER AS size, sum(greatest(1, ceil((n - size * 0.4) / (size * 4 * 0.9))))::BIGINT AS chunks FROM p, s GROUP BY size""")  # fmt: skip
def c12(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each size (in tokens, a tenth of overlap) would give: all sizes in one pass."""
    p = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).where("text IS NOT NULL").select(F.length("text").alias("n"), F.explode(F.array(*map(F.lit, (256, 512, 1024)))).alias("size"))
    return p.groupBy("size").agg(F.sum(F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("size") * 0.4) / (F.col("size") * 4 * 0.9)))).alias("chunks"))


@query("c13_questions_by_document", """
    WITH g AS (SELECT DISTINCT ON (id) id, source_documents[1] AS doc, user_input FROM gold_records)
    SELECT doc, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM g WHERE doc IS NOT NULL GROUP BY doc""")  # fmt: skip
def c13(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_records", "id", "source_documents").dropDuplicates(["id"]).select("id", F.get("source_documents", F.lit(0)).alias("doc")).where("doc IS NOT NULL")
    return g.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("ids"))


@query("c15_page_slices", """
    WITH p AS (SELECT DISTINCT ON (id) id, filename, section_title, page_number FROM parent_chunks WHERE filename IS NOT NULL AND page_number IS NOT NULL)
    SELECT filename, page_number, count(DISTINCT section_title) AS sections, min(section_title) AS first_section FROM p GROUP BY ALL""")  # fmt: skip
def c15(spark: SparkSession, d: str) -> DataFrame:
    """The sections that share each page."""
    p = table(spark, d, "parent_chunks", "id", "filename", "section_title", "page_number").dropDuplicates(["id"]).where("filename IS NOT NULL AND page_number IS NOT NULL")
    return p.groupBy("filename", "page_number").agg(F.countDistinct("section_title").alias("sections"), F.min("section_title").alias("first_section"))


@query("jn01_child_parent", """
    SELECT c.id, p.id AS parent_id, p.filename FROM (SELECT DISTINCT ON (id) id, parent_id FROM child_chunks) c JOIN (SELECT DISTINCT ON (id) id, filename FROM parent_chunks) p ON c.parent_id = p.id""")  # fmt: skip
def jn01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "parent_id").dropDuplicates(["id"])
    p = table(spark, d, "parent_chunks", "id", "filename").dropDuplicates(["id"]).withColumnRenamed("id", "parent_id")
    return c.join(p, "parent_id").select("id", "parent_id", "filename")


@query("jn15_near_copies")
def jn15(spark: SparkSession, d: str) -> DataFrame:
    return C.near_copies_dropped(table(spark, d, "child_chunks", "id", "parent_id", "child_index", "raw_text").dropDuplicates(["id"]), "parent_id", "child_index", "id", "raw_text")


@query("w08_section_text", r"""
    WITH l AS (SELECT doc_id, i, s[i] AS line, len(s) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
    h AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n + 1) AS nxt FROM l WHERE regexp_matches(line, '^[0-9]+(?:\.[0-9]+)+\s+\S'))
    SELECT doc_id, line AS title, (nxt - i)::INTEGER AS n_lines, i::INTEGER AS line_no FROM h""")  # fmt: skip
def w08(spark: SparkSession, d: str) -> DataFrame:
    ls = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)
    t = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(ls).alias("n"), F.posexplode(ls).alias("i", "title")).where(F.col("title").rlike(r"^[0-9]+(?:\.[0-9]+)+\s+\S"))
    nxt = F.coalesce(F.lead("i").over(Window.partitionBy("doc_id").orderBy("i")), F.col("n"))
    return t.select("doc_id", "title", (nxt - F.col("i")).alias("n_lines"), (F.col("i") + 1).alias("line_no"))


@query("a12_running_titles", """
    WITH p AS (SELECT DISTINCT ON (id) id, filename, text FROM parent_chunks WHERE text IS NOT NULL AND filename IS NOT NULL), l AS (SELECT DISTINCT id, filename, trim(unnest(string_split(text, chr(10)))) AS line FROM p)
    SELECT filename, line, count(*) AS n FROM l WHERE length(line) BETWEEN 5 AND 80 GROUP BY ALL HAVING count(*) >= 3""")  # fmt: skip
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in three chunks of a file or more."""
    p = table(spark, d, "parent_chunks", "id", "filename", "text").dropDuplicates(["id"]).where("filename IS NOT NULL")
    l = p.select("filename", F.explode(F.array_distinct(F.transform(X.lines(F.col("text")), lambda x: F.trim(x)))).alias("line"))  # noqa: E741
    return l.where(F.length("line").between(5, 80)).groupBy("filename", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("a13_repeated_furniture", r"""
    WITH p AS (SELECT DISTINCT ON (id) id, text FROM parent_chunks WHERE text IS NOT NULL), l AS (SELECT id, trim(unnest(string_split(text, chr(10)))) AS line FROM p), c AS (SELECT line, count(*) AS n FROM l WHERE line <> '' AND length(line) <= 80 GROUP BY line)
    SELECT line, n FROM c WHERE n >= 3 OR regexp_matches(line, '(?i)^(?:page|seite)\s+[0-9]+\s*(?:of|von)\s+[0-9]+$')""")  # fmt: skip
def a13(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).select(F.explode(F.transform(X.lines(F.col("text")), lambda x: F.trim(x))).alias("line"))  # noqa: E741
    c = l.where((F.col("line") != "") & (F.length("line") <= 80)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return c.where((F.col("n") >= 3) | F.col("line").rlike(r"(?i)^(?:page|seite)\s+[0-9]+\s*(?:of|von)\s+[0-9]+$"))
