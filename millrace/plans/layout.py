"""Layout queries over blocks of pages: the paragraphs of parent chunks, with labels and boxes that follow from their
position and length, so that every kind of neighbourhood occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..runtime import table
from .registry import query

BLOCKS = r"""
    p AS (SELECT DISTINCT ON (id) id AS page, filename AS doc, string_split(text, chr(10) || chr(10)) AS bl FROM parent_chunks WHERE text IS NOT NULL AND filename IS NOT NULL),
    u AS (SELECT doc, page, unnest(bl) AS t, (unnest(range(len(bl))))::INTEGER AS pos FROM p),
    k AS (SELECT doc, page, pos, t, CASE (length(t) + 3 * pos) % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'formula' WHEN 2 THEN 'formula_number' WHEN 3 THEN 'figure_caption' ELSE 'text' END AS label FROM u),
    b AS (SELECT doc, page, pos, label, CASE WHEN label = 'formula' THEN t || chr(10) || '$$' WHEN label = 'formula_number' THEN '(' || pos || ')' WHEN label = 'text' AND length(t) % 3 < 2 THEN '- ' || t ELSE t END AS content,
                 CASE WHEN length(t) % 11 > 0 THEN [(pos % 2) * 500 + length(t) % 20, pos * 10, (pos % 2) * 500 + 300, pos * 10 + 9] END AS box FROM k)"""
W = "w AS (PARTITION BY doc, page ORDER BY pos)"
# pairs of a pass over the page: of a run of rows that may take the next one every second takes
PAIRED = f"""
    l2 AS (SELECT *, CASE WHEN link AND coalesce(lag(link) OVER w, false) THEN 0 ELSE 1 END AS fresh FROM l1 WINDOW {W}), l3 AS (SELECT *, sum(fresh) OVER w AS run FROM l2 WINDOW {W}),
    l4 AS (SELECT *, link AND row_number() OVER (PARTITION BY doc, page, run ORDER BY pos) % 2 = 1 AS first FROM l3), l5 AS (SELECT *, coalesce(lag(first) OVER w, false) AS second FROM l4 WINDOW {W})"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parent_chunks", "id", "filename", "text").where("text IS NOT NULL AND filename IS NOT NULL").dropDuplicates(["id"])
    u = p.select(F.col("filename").alias("doc"), F.col("id").alias("page"), F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "t"))
    n = F.length("t")
    kind = (n + 3 * F.col("pos")) % 8
    label = F.when(kind == 0, "image").when(kind == 1, "formula").when(kind == 2, "formula_number").when(kind == 3, "figure_caption").otherwise("text")
    t = u.withColumn("label", label)
    content = F.when(F.col("label") == "formula", F.concat("t", F.lit("\n$$"))).when(F.col("label") == "formula_number", F.concat(F.lit("("), F.col("pos").cast("string"), F.lit(")"))).when((F.col("label") == "text") & (n % 3 < 2), F.concat(F.lit("- "), "t")).otherwise(F.col("t"))
    x = (F.col("pos") % 2) * 500
    box = F.when(n % 11 > 0, F.array(x + n % 20, F.col("pos") * 10, x + 300, F.col("pos") * 10 + 9).cast("array<int>"))
    return t.select("doc", "page", "pos", "label", content.alias("content"), box.alias("box"))


@query("w19_reading_order", f"""
    WITH {BLOCKS}, x AS (SELECT *, (box[1] + box[3]) / 2.0 AS x, round_even((box[1] + box[3]) / 2.0, -1) AS r FROM b),
    y AS (SELECT *, count(x) OVER g AS n, max(x) OVER g - min(x) OVER g AS wide, lag(r) OVER (PARTITION BY doc, page ORDER BY r NULLS LAST) AS before FROM x WINDOW g AS (PARTITION BY doc, page)),
    c AS (SELECT *, list_sort(list_distinct(list(CASE WHEN r IS NOT NULL AND (before IS NULL OR (r - before > 0.15 * wide AND wide >= 50)) THEN r END) OVER (PARTITION BY doc, page))) AS cols FROM y),
    z AS (SELECT *, CASE WHEN x IS NOT NULL AND n >= 2 THEN list_min(list_transform(list_filter(cols, lambda q: q IS NOT NULL), lambda q, i: [abs(x - q), i - 1]))[2]::INTEGER END AS column_no, len(list_filter(cols, lambda q: q IS NOT NULL)) <= 1 AS one FROM c)
    SELECT doc, page, pos, column_no, (row_number() OVER (PARTITION BY doc, page ORDER BY column_no IS NULL, coalesce(column_no, 0), CASE WHEN column_no IS NOT NULL THEN box[2] END NULLS FIRST, CASE WHEN column_no IS NOT NULL AND one THEN box[1] END NULLS FIRST, pos) - 1)::INTEGER AS place FROM z""")  # fmt: skip
def w19(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(blocks(spark, d)).select("doc", "page", "pos", "column_no", "place")


@query("w14_between_bullets", f"""
    WITH {BLOCKS}, y AS (SELECT *, label = 'text' AND starts_with(content, '- ') AS bu FROM b),
    z AS (SELECT *, label = 'text' AND NOT bu AND lag(bu) OVER w AND lead(bu) OVER w AND abs(box[1] - lag(box[1]) OVER w) <= 10 AND abs(box[1] - lead(box[1]) OVER w) <= 10 AS fill FROM y WINDOW {W})
    SELECT doc, page, pos, md5(CASE WHEN coalesce(fill, false) THEN '- ' || content ELSE content END) AS content FROM z""")  # fmt: skip
def w14(spark: SparkSession, d: str) -> DataFrame:
    return L.add_bullets(blocks(spark, d)).select("doc", "page", "pos", F.md5("content").alias("content"))


@query("w15_formula_numbers", f"""
    WITH {BLOCKS}, l1 AS (SELECT *, lead(content) OVER w AS nc, coalesce((label = 'formula' AND lead(label) OVER w = 'formula_number') OR (label = 'formula_number' AND lead(label) OVER w = 'formula'), false) AS link FROM b WINDOW {W}), {PAIRED},
    f AS (SELECT *, CASE WHEN label = 'formula' THEN content ELSE nc END AS body, CASE WHEN label = 'formula' THEN nc ELSE content END AS num FROM l5 WHERE NOT second AND (first OR label <> 'formula_number'))
    SELECT doc, page, pos, CASE WHEN first THEN 'formula' ELSE label END AS label, md5(CASE WHEN first THEN left(body, length(body) - 3) || ' \\tag{{' || regexp_replace(num, '[()]', '', 'g') || '}}' || chr(10) || '$$' ELSE content END) AS content FROM f""")  # fmt: skip
def w15(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_formula_numbers(blocks(spark, d)).select("doc", "page", "pos", "label", F.md5("content").alias("content"))


@query("w17_caption_merge", f"""
    WITH {BLOCKS}, y AS (SELECT *, lead(content) OVER w AS nc, coalesce(label = 'image' AND (lead(label) OVER w = 'figure_caption' OR (lead(label) OVER w = 'text' AND regexp_matches(trim(lead(content) OVER w), '(?i)^(Figure|Fig\\.?|Table|Abbildung|Tabelle)\\s+[0-9]+'))), false) AS takes FROM b WINDOW {W}),
    z AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken FROM y WINDOW {W})
    SELECT doc, page, pos, CASE WHEN takes THEN 'figure' ELSE label END AS label, md5(CASE WHEN takes THEN regexp_replace(content, '\\s+$', '') || chr(10) || chr(10) || nc ELSE content END) AS content FROM z WHERE NOT taken""")  # fmt: skip
def w17(spark: SparkSession, d: str) -> DataFrame:
    return L.attach_captions(blocks(spark, d)).select("doc", "page", "pos", "label", F.md5("content").alias("content"))


def broken(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs parted into texts at their broken words."""
    p = table(spark, d, "parent_chunks", "id", "filename", "text").where("text IS NOT NULL AND filename IS NOT NULL").dropDuplicates(["id"])
    return p.select(F.col("filename").alias("doc"), F.col("id").alias("page"), F.posexplode(F.split("text", r"(?<=-)\n", -1)).alias("pos", "content")).withColumn("label", F.lit("text"))


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return L.zipf(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("w16_broken_words", f"""
    WITH p AS (SELECT DISTINCT ON (id) id AS page, filename AS doc, string_split(replace(text, '-' || chr(10), '-' || chr(1) || chr(1)), chr(1) || chr(1)) AS bl FROM parent_chunks WHERE text IS NOT NULL AND filename IS NOT NULL),
    b AS (SELECT doc, page, unnest(bl) AS content, (unnest(range(len(bl))))::INTEGER AS pos FROM p),
    c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word), z AS (SELECT word FROM c WHERE log10(n * 1e9 / (SELECT sum(n) FROM c)) >= 2.5),
    e AS (SELECT *, regexp_replace(content, '\\s+$', '') AS en, regexp_replace(lead(content) OVER w, '^\\s+', '') AS nx FROM b WINDOW {W}),
    f AS (SELECT *, CASE WHEN en LIKE '%-' AND regexp_matches(nx, '^\\p{{Ll}}') THEN lower(nullif(regexp_extract(left(en, length(en) - 1), '(\\S+)\\s*$', 1), '') || regexp_extract(nx, '^(\\S+)', 1)) END AS word FROM e),
    l1 AS (SELECT f.*, z.word IS NOT NULL AS link FROM f LEFT JOIN z ON f.word = z.word), {PAIRED}
    SELECT doc, page, pos, md5(CASE WHEN first THEN left(en, length(en) - 1) || nx ELSE content END) AS content FROM l5 WHERE NOT second""")  # fmt: skip
def w16(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_broken_words(broken(spark, d), frequencies(spark, d)).select("doc", "page", "pos", F.md5("content").alias("content"))


@query("w18_stitched_pages")
def w18(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parent_chunks", "id", "filename", "page_number", "text").where("text IS NOT NULL AND filename IS NOT NULL AND page_number IS NOT NULL").dropDuplicates(["id"])
    b = p.select(F.col("filename").alias("doc"), F.format_string("%06d %s", "page_number", "id").alias("page"), F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "content"))
    return L.stitch_pages(b.withColumn("label", F.lit("text"))).select("doc", "page", "pos", "page_end", F.md5("content").alias("content"))


@query("a14_body_size", """
    WITH s AS (SELECT source AS doc, round(8 + page_number % 7, 1) AS size, sum(length(trim(section_title, ' ')))::BIGINT AS chars FROM documents WHERE source IS NOT NULL AND page_number IS NOT NULL AND trim(section_title, ' ') <> '' GROUP BY ALL),
    b AS (SELECT doc, arg_max(size, (chars, -size)) AS body FROM s GROUP BY doc)
    SELECT doc, size::DOUBLE AS size, chars, (CASE WHEN size = body THEN 0 WHEN size > body + 1.5 THEN dense_rank() OVER (PARTITION BY doc, size > body + 1.5 ORDER BY size DESC) END)::INTEGER AS level FROM s JOIN b USING (doc)""")  # fmt: skip
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Section titles as spans, in sizes by their page."""
    t = table(spark, d, "documents", "source", "page_number", "section_title").where("source IS NOT NULL AND page_number IS NOT NULL")
    return L.body_and_levels(t.select(F.col("source").alias("doc"), (8.0 + F.col("page_number") % 7).alias("size"), F.col("section_title").alias("text")))


@query("w13_fill_forward", """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_type || event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS section, last_value(CASE WHEN event_id % 17 = 3 THEN user_id::VARCHAR END IGNORE NULLS) OVER (ORDER BY event_id) AS unit FROM events""")  # fmt: skip
def w13(spark: SparkSession, d: str) -> DataFrame:
    """The events as a sheet whose section and group stand in some rows only."""
    t = table(spark, d, "events", "event_id", "event_type", "user_id")
    t = t.select("event_id", F.when(F.col("event_type") == "purchase", F.concat("event_type", F.col("event_id").cast("string"))).alias("section"), F.when(F.col("event_id") % 17 == 3, F.col("user_id").cast("string")).otherwise("  ").alias("unit"))
    return L.fill_forward(t, "event_id", ["section", "unit"], block=700)


@query("jn14_bookmark_sections")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their own numbered lines as bookmarks."""
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^([0-9]+(?:\.[0-9]+)*\.? +\p{Lu}[^\n]{3,80})$"), 1), lambda x: F.struct(x.alias("title"), F.size(F.split(F.regexp_extract(x, r"^([0-9.]+)", 1), r"\.")).alias("level")))
    return L.bookmark_sections(t.withColumn("bookmarks", marks)).select("doc_id", "pos", "title", F.array_join("hierarchy", " > ").alias("path"), F.length("section").alias("n_chars"))
