"""Queries over document trees and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import trees as T
from ..runtime import table
from .nested import NODES_SQL, p5_nodes
from .registry import query

_I = "CASE WHEN TRY_CAST(v->>'{0}' AS DOUBLE) = floor(TRY_CAST(v->>'{0}' AS DOUBLE)) THEN CAST(TRY_CAST(v->>'{0}' AS DOUBLE) AS INTEGER) END"
BASE = NODES_SQL + f""", t AS (SELECT doc_id, node_path, parent_path, v->>'title' AS title, v->>'summary' AS summary, {_I.format('start_index')} AS s, {_I.format('end_index')} AS e,
    list_transform(string_split(node_path, '.'), lambda x: x::INTEGER) AS steps, len(string_split(node_path, '.'))::INTEGER AS depth FROM n WHERE json_type(v) = 'OBJECT'),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY steps) - 1 AS seq FROM t) """


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return p5_nodes(spark, d).withColumnsRenamed({"start_index": "s", "end_index": "e"})


def outline(spark: SparkSession, d: str) -> DataFrame:
    return T.numbered(nodes(spark, d)).withColumn("level", T.depth(F.col("node_path")))


def order() -> Window:
    return Window.partitionBy("doc_id").orderBy("seq")


@query("w12_sequence_ids", BASE + "SELECT doc_id, node_path, lpad(seq::VARCHAR, 4, '0') AS new_id FROM o")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return outline(spark, d).select("doc_id", "node_path", "new_id")


@query("sp03_leaves", BASE + "SELECT doc_id, node_path, depth FROM t WHERE (doc_id, node_path) NOT IN (SELECT doc_id, parent_path FROM t)")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return T.leaves(nodes(spark, d)).select("doc_id", "node_path", T.depth(F.col("node_path")).alias("depth"))


@query("sp03_breadth_first", BASE + "SELECT doc_id, node_path, row_number() OVER (PARTITION BY doc_id ORDER BY depth, steps) AS place FROM t")
def p03b(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(T.depth(F.col("node_path")), T.steps(F.col("node_path")))
    return nodes(spark, d).select("doc_id", "node_path", F.row_number().over(w).alias("place"))


@query("f18_flat_trees", BASE + "SELECT doc_id, bool_and(depth = 1) AS flat FROM t GROUP BY doc_id")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("doc_id").agg(F.bool_and(T.depth(F.col("node_path")) == 1).alias("flat"))


@query("a22_depth_histogram", BASE + "SELECT depth, count(*) AS n, count(*) FILTER ((doc_id, node_path) NOT IN (SELECT doc_id, parent_path FROM t)) AS leaves FROM t GROUP BY depth")
def a22(spark: SparkSession, d: str) -> DataFrame:
    all_, leaf = nodes(spark, d), p03(spark, d)
    n = all_.groupBy(T.depth(F.col("node_path")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(leaf.groupBy("depth").agg(F.count(F.lit(1)).alias("leaves")), "depth", "left").fillna(0, ["leaves"])


@query("w24_prefix_summaries", BASE + r"""SELECT c.doc_id, c.node_path, coalesce(string_agg(CASE WHEN a.summary <> '' THEN a.summary END, chr(10) ORDER BY a.depth), '') AS prefix
    FROM t c LEFT JOIN t a ON a.doc_id = c.doc_id AND starts_with(c.node_path, a.node_path || '.') GROUP BY ALL""")
def w24(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumn("summary", F.when(F.col("summary") != "", F.col("summary")))
    return T.down(n, "summary").select("doc_id", "node_path", F.array_join("ancestors", "\n").alias("prefix"))


@query("w25_subtree_tokens", BASE + "SELECT a.doc_id, a.node_path, CAST(sum(greatest(1, length(coalesce(c.summary, '')) // 4)) AS BIGINT) AS tokens FROM t a JOIN t c ON a.doc_id = c.doc_id AND (c.node_path = a.node_path OR starts_with(c.node_path, a.node_path || '.')) GROUP BY ALL")
def w25(spark: SparkSession, d: str) -> DataFrame:
    return T.up(nodes(spark, d), X.token_count(F.coalesce("summary", F.lit(""))), F.sum, "tokens")


@query("w10_last_pages", BASE + "SELECT a.doc_id, a.node_path, max(c.e) AS last_page FROM t a JOIN t c ON a.doc_id = c.doc_id AND (c.node_path = a.node_path OR starts_with(c.node_path, a.node_path || '.')) GROUP BY ALL")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return T.up(nodes(spark, d), F.col("e"), F.max, "last_page")


@query("w11_parent_by_level", BASE + "SELECT doc_id, seq::INTEGER AS seq, (SELECT max(p.seq) FROM o p WHERE p.doc_id = o.doc_id AND p.seq < o.seq AND p.depth < o.depth)::INTEGER AS parent_pos FROM o")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return T.parents_by_level(outline(spark, d)).select("doc_id", "seq", "parent_pos")


@query("w06_end_pages", BASE + "SELECT doc_id, node_path, CASE WHEN depth = 1 THEN lead(s) OVER w - 1 ELSE lead(s) OVER w END AS end_page FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def w06(spark: SparkSession, d: str) -> DataFrame:
    """A node ends where the next begins; a chapter a page before."""
    nxt = F.lead("s").over(order())
    return outline(spark, d).select("doc_id", "node_path", F.when(F.col("level") == 1, nxt - 1).otherwise(nxt).alias("end_page"))


@query("w07_contents_ranges", BASE + "SELECT doc_id, node_path, greatest(s, lead(s) OVER (PARTITION BY doc_id ORDER BY seq) - 1) AS end_page FROM o")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return outline(spark, d).select("doc_id", "node_path", F.greatest("s", F.lead("s").over(order()) - 1).alias("end_page"))


@query("w09_next_sibling", BASE + """, x AS (SELECT doc_id, node_path, depth, lead(s) OVER (PARTITION BY doc_id, parent_path ORDER BY steps) AS nxt FROM t)
    SELECT c.doc_id, c.node_path, arg_max(a.nxt, a.depth) FILTER (a.nxt IS NOT NULL) AS next_start FROM x c JOIN x a ON a.doc_id = c.doc_id AND (a.node_path = c.node_path OR starts_with(c.node_path, a.node_path || '.')) GROUP BY ALL""")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """Where the next node of the same or a higher level begins: the node's next sibling, or its nearest ancestor's."""
    w = Window.partitionBy("doc_id", "parent_path").orderBy(T.steps(F.col("node_path")))
    x = nodes(spark, d).select("doc_id", "node_path", F.lead("s").over(w).alias("nxt"))
    above = x.select("doc_id", "node_path", F.explode(T.prefixes(F.col("node_path"))).alias("a")).join(x.select("doc_id", F.col("node_path").alias("a"), "nxt"), ["doc_id", "a"])
    return above.groupBy("doc_id", "node_path").agg(F.max(F.when(F.col("nxt").isNotNull(), F.struct(T.depth(F.col("a")), "nxt")))["nxt"].alias("next_start"))


@query("jn12_node_pages", BASE + ", sf AS (SELECT DISTINCT ON (doc_id) doc_id, filename FROM structure_files), c AS (SELECT DISTINCT filename, page_number, id FROM parent_chunks) SELECT DISTINCT t.doc_id, t.node_path, c.id FROM t JOIN sf USING (doc_id) JOIN c ON c.filename = sf.filename AND c.page_number BETWEEN t.s AND t.e")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on the pages of every node: ranges are spelled out as pages, so the join is one by equality."""
    f = table(spark, d, "structure_files", "doc_id", "filename").dropDuplicates(["doc_id"])
    n = nodes(spark, d).join(f, "doc_id").select("doc_id", "node_path", "filename", F.explode(T.page_list(F.col("s"), F.col("e"))).alias("page_number"))
    return n.join(table(spark, d, "parent_chunks", "id", "filename", "page_number").distinct(), ["filename", "page_number"]).select("doc_id", "node_path", "id").distinct()


@query("jn13_deepest_section", BASE + ", p AS (SELECT doc_id, unnest(range(s, e + 1)) AS page, depth, steps, node_path FROM t WHERE s <= e) SELECT doc_id, page::INTEGER AS page, node_path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY depth DESC, steps) AS n FROM p) WHERE n = 1")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    """The deepest node that covers each page."""
    p = nodes(spark, d).select("doc_id", "node_path", F.explode(T.page_list(F.col("s"), F.col("e"))).alias("page"))
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc(T.depth(F.col("node_path"))), T.steps(F.col("node_path")))
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "page", "node_path")


@query("jn02_resolve_nodes", BASE + ", q AS (SELECT DISTINCT doc_id, unnest(['0', '9.9', '1', '0.0']) AS node_path, unnest([1, 2, 3, 4]) AS place FROM t) SELECT q.doc_id, q.place, t.title FROM q JOIN t USING (doc_id, node_path)")
def jn02(spark: SparkSession, d: str) -> DataFrame:
    """Asked nodes in the order asked, unknown ones left out."""
    n = nodes(spark, d)
    q = n.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, ["0", "9.9", "1", "0.0"]))).alias("place", "node_path"))
    return q.join(n, ["doc_id", "node_path"]).select("doc_id", (F.col("place") + 1).alias("place"), "title")


@query("jn22_parent_by_code", r"""
    WITH c AS (SELECT DISTINCT filename, regexp_extract(section_title, '^([0-9]+(?:\.[0-9]+)*)\s', 1) AS code FROM parent_chunks WHERE regexp_matches(section_title, '^([0-9]+(?:\.[0-9]+)*)\s')),
    p AS (SELECT filename, code, regexp_replace(code, '\.?[0-9]+$', '') AS up FROM c)
    SELECT p.filename, p.code, q.code AS parent_code FROM p LEFT JOIN c q ON q.filename = p.filename AND q.code = p.up""")  # fmt: skip
def jn22(spark: SparkSession, d: str) -> DataFrame:
    """Section 1.2 below section 1 of its file; without one it is at the top."""
    c = table(spark, d, "parent_chunks", "filename", "section_title").select("filename", F.regexp_extract("section_title", r"^([0-9]+(?:\.[0-9]+)*)\s", 1).alias("code")).where("code <> ''").distinct()
    p = c.withColumn("up", F.regexp_replace("code", r"\.?[0-9]+$", ""))
    return p.join(c.select("filename", F.col("code").alias("up"), F.col("code").alias("parent_code")), ["filename", "up"], "left").select("filename", "code", "parent_code")


@query("sp04_preface", BASE + "SELECT doc_id, 'Preface' AS title, 1 AS page FROM o WHERE seq = 0 AND s > 1")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return outline(spark, d).where("seq = 0 AND s > 1").select("doc_id", F.lit("Preface").alias("title"), F.lit(1).alias("page"))


@query("a11_page_offset", """
    WITH c AS (SELECT DISTINCT ON (id) id, filename, page_number, child_index FROM child_chunks WHERE page_number IS NOT NULL AND filename IS NOT NULL), k AS (SELECT filename, page_number - child_index AS diff, count(*) AS n, min(id) AS first FROM c GROUP BY ALL)
    SELECT filename, diff AS page_offset FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY n DESC, first) AS r FROM k) WHERE r = 1""")  # fmt: skip
def a11(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent difference; of equals the one seen first."""
    c = table(spark, d, "child_chunks", "id", "filename", "page_number", "child_index").dropDuplicates(["id"]).where("page_number IS NOT NULL AND filename IS NOT NULL")
    k = c.groupBy("filename", (F.col("page_number") - F.col("child_index")).alias("diff")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return k.groupBy("filename").agg(F.min(F.struct(-F.col("n"), "first", "diff"))["diff"].alias("page_offset"))


@query("sp08_add_offset", BASE + "SELECT doc_id, node_path, s + 2 AS physical FROM t WHERE s IS NOT NULL")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("s IS NOT NULL").select("doc_id", "node_path", (F.col("s") + 2).alias("physical"))


REF = "'Pages ' || page_number || ', ' || (page_number + 2) || '-' || (page_number + 4)"
CH = "c AS (SELECT DISTINCT ON (id) id, page_number FROM child_chunks WHERE page_number IS NOT NULL)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "page_number").dropDuplicates(["id"]).where("page_number IS NOT NULL")
    return c.withColumn("ref", F.concat(F.lit("Pages "), "page_number", F.lit(", "), F.col("page_number") + 2, F.lit("-"), F.col("page_number") + 4))


@query("sp05_page_references", f"WITH {CH} SELECT id, array_to_string(list_concat([page_number], range(page_number + 2, page_number + 5)), ',') AS pages FROM c")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("id", F.array_join(F.transform(T.parse_pages(F.col("ref")), lambda x: x.cast("string")), ",").alias("pages"))


@query("sp06_strict_pages", f"WITH {CH} SELECT id, array_to_string(list_sort(list_distinct(list_concat([page_number, page_number + 1], range(page_number % 7, page_number % 7 + page_number % 5 + 1)))), ',') AS pages FROM c")
def p06(spark: SparkSession, d: str) -> DataFrame:
    """Lists such as "3, 4,3-7", of one to five pages and two that may be among them."""
    n = F.col("page_number")
    ref = F.concat_ws("", n.cast("string"), F.lit(","), (n % 7).cast("string"), F.lit("-"), (n % 7 + n % 5).cast("string"), F.lit(" , "), (n + 1).cast("string"))
    return refs(spark, d).select("id", F.array_join(F.transform(F.array_sort(F.array_distinct(T.strict_pages(ref))), lambda x: x.cast("string")), ",").alias("pages"))


@query("sp19_page_envelope", f"WITH {CH} SELECT id, array_to_string(range(page_number, page_number + 5), ',') AS pages FROM c")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("id", F.array_join(F.transform(T.page_envelope(F.col("ref")), lambda x: x.cast("string")), ",").alias("pages"))


@query("sp07_page_ranges", """
    WITH p AS (SELECT DISTINCT filename, page_number AS p FROM parent_chunks WHERE page_number IS NOT NULL AND filename IS NOT NULL), g AS (SELECT filename, p, p - row_number() OVER (PARTITION BY filename ORDER BY p) AS i FROM p),
    r AS (SELECT filename, min(p) AS a, max(p) AS b FROM g GROUP BY filename, i) SELECT filename, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY filename""")  # fmt: skip
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages by the islands of page minus row number; a file's pages are at most as many as it has."""
    p = table(spark, d, "parent_chunks", "filename", "page_number").where("page_number IS NOT NULL AND filename IS NOT NULL").distinct()
    g = p.withColumn("i", F.col("page_number") - F.row_number().over(Window.partitionBy("filename").orderBy("page_number")))
    r = g.groupBy("filename", "i").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    s = F.struct("a", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat("a", F.lit("-"), "b")).alias("s"))
    return r.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["s"]), ",").alias("pages"))


@query("w22_range_strings", BASE + "SELECT doc_id, node_path, CASE WHEN s = e THEN s::VARCHAR WHEN s < e THEN s || '-' || e ELSE '' END AS pages FROM t WHERE s IS NOT NULL AND e IS NOT NULL")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("s IS NOT NULL AND e IS NOT NULL").select("doc_id", "node_path", T.page_string(T.page_list(F.col("s"), F.col("e"))).alias("pages"))


@query("sp09_page_texts", """
    WITH c AS (SELECT DISTINCT ON (id) id, filename, page_number, text FROM parent_chunks WHERE page_number IS NOT NULL AND filename IS NOT NULL AND text IS NOT NULL)
    SELECT filename, page_number, md5(string_agg('<page_' || page_number || '>' || chr(10) || text, chr(10) ORDER BY id)) AS digest FROM c GROUP BY ALL""")  # fmt: skip
def p09(spark: SparkSession, d: str) -> DataFrame:
    """The text of every page with its mark, chunks in order of their keys (as a digest)."""
    c = table(spark, d, "parent_chunks", "id", "filename", "page_number", "text").dropDuplicates(["id"]).where("page_number IS NOT NULL AND filename IS NOT NULL AND text IS NOT NULL")
    marked = F.concat(F.lit("<page_"), "page_number", F.lit(">\n"), "text")
    return c.groupBy("filename", "page_number").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", marked.alias("t")))), lambda s: s["t"]), "\n")).alias("digest"))


@query("o03_page_overlap", BASE + "SELECT doc_id, node_path, CAST(greatest(0, least(e, s + 2) - s + 1) AS INTEGER) AS overlap FROM t WHERE s <= e")
def o03(spark: SparkSession, d: str) -> DataFrame:
    got, gold = T.page_list(F.col("s"), F.col("e")), T.page_list(F.col("s"), F.col("s") + 2)
    return nodes(spark, d).where("s <= e").select("doc_id", "node_path", F.size(F.array_intersect(got, gold)).alias("overlap"))


@query("o04_page_scores", BASE + """, x AS (SELECT doc_id, node_path, least(e, s + 2) - s + 1 AS b, e - s + 1 AS g FROM t WHERE s <= e), y AS (SELECT doc_id, node_path, round(b / g, 2) AS precision, round(b / 3, 2) AS recall FROM x)
    SELECT doc_id, node_path, precision, recall, round(2 * precision * recall / (precision + recall), 2) AS f1 FROM y""")
def o04(spark: SparkSession, d: str) -> DataFrame:
    got, gold = T.page_list(F.col("s"), F.col("e")), T.page_list(F.col("s"), F.col("s") + 2)
    return nodes(spark, d).where("s <= e").select("doc_id", "node_path", T.page_scores(got, gold).alias("x")).select("doc_id", "node_path", "x.precision", "x.recall", "x.f1")


@query("o06_tree_coverage", BASE + """, sf AS (SELECT DISTINCT ON (doc_id) doc_id, filename FROM structure_files), a AS (SELECT filename, min(doc_id) AS doc_id FROM sf WHERE filename IS NOT NULL GROUP BY filename), c AS (SELECT DISTINCT filename FROM parent_chunks WHERE filename IS NOT NULL)
    SELECT coalesce(a.filename, c.filename) AS filename, a.filename IS NOT NULL AS has_tree, c.filename IS NOT NULL AS has_chunks FROM a FULL JOIN c ON a.filename = c.filename""")
def o06(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "structure_files", "filename").where("filename IS NOT NULL").distinct().withColumn("x", F.lit(True))
    c = table(spark, d, "parent_chunks", "filename").where("filename IS NOT NULL").distinct().withColumn("y", F.lit(True))
    return a.join(c, "filename", "full").select("filename", F.coalesce("x", F.lit(False)).alias("has_tree"), F.coalesce("y", F.lit(False)).alias("has_chunks"))


@query("sp10_level_search", BASE + r""", w AS (SELECT *, len(regexp_extract_all(lower(coalesce(title, '')), 'wakeup|watchdog|wake')) AS hit FROM t),
    l1 AS (SELECT * FROM w WHERE depth = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hit DESC, steps) <= 3), l2 AS (SELECT w.* FROM w JOIN l1 ON w.doc_id = l1.doc_id AND w.parent_path = l1.node_path QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY w.hit DESC, w.steps) <= 3),
    l3 AS (SELECT w.* FROM w JOIN l2 ON w.doc_id = l2.doc_id AND w.parent_path = l2.node_path QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY w.hit DESC, w.steps) <= 3), a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT doc_id, node_path FROM a WHERE (doc_id, node_path) NOT IN (SELECT doc_id, parent_path FROM t)""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Level by level: the three best nodes of a level are opened, leaves met on the way are the answer. The selector here
    is a lexical stand-in for a model; its quality says nothing of one."""
    n = nodes(spark, d).withColumn("hit", F.regexp_count(F.lower(F.coalesce("title", F.lit(""))), F.lit("wakeup|watchdog|wake"))).select("doc_id", "node_path", "parent_path", "hit")
    w = Window.partitionBy("doc_id").orderBy(F.desc("hit"), T.steps(F.col("node_path")))
    best = lambda df: df.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
    level = best(n.where("parent_path = ''"))
    seen = level
    for _ in range(2):
        level = best(n.join(level.select("doc_id", F.col("node_path").alias("parent_path")), ["doc_id", "parent_path"], "left_semi"))
        seen = seen.unionByName(level)
    return T.leaves(n).join(seen.select("doc_id", "node_path"), ["doc_id", "node_path"], "left_semi").select("doc_id", "node_path")


@query("sp11_large_nodes", BASE + "SELECT doc_id, node_path FROM t WHERE e - s + 1 > 3")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of too many pages, which a model would part further."""
    return nodes(spark, d).where("e - s + 1 > 3").select("doc_id", "node_path")


@query("sp12_merge_trees", BASE + ", sf AS (SELECT DISTINCT ON (doc_id) doc_id, filename FROM structure_files) SELECT sf.filename, o.doc_id, o.node_path, lpad((row_number() OVER (PARTITION BY sf.filename ORDER BY o.doc_id, o.steps) - 1)::VARCHAR, 4, '0') AS new_id FROM o JOIN sf USING (doc_id) WHERE sf.filename IS NOT NULL")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """The trees of one file one after the other, numbered anew."""
    f = table(spark, d, "structure_files", "doc_id", "filename").dropDuplicates(["doc_id"]).where("filename IS NOT NULL")
    w = Window.partitionBy("filename").orderBy("doc_id", T.steps(F.col("node_path")))
    n = nodes(spark, d).join(f, "doc_id").withColumn("i", (F.row_number().over(w) - 1).cast("string"))
    return n.select("filename", "doc_id", "node_path", F.lpad("i", 4, "0").alias("new_id"))


@query("sp13_strategy", r"""
    WITH c AS (SELECT DISTINCT ON (id) id, section_hierarchy, section_title, text FROM parent_chunks)
    SELECT id, CASE WHEN len(section_hierarchy) > 1 THEN 'bookmarks' WHEN regexp_matches(coalesce(section_title, ''), '^[0-9]+(?:\.[0-9]+)*\s') THEN 'numbering' WHEN regexp_matches(coalesce(text, ''), '^[0-9]+(?:\.[0-9]+)*\s') THEN 'first_line' ELSE 'none' END AS strategy FROM c""")  # fmt: skip
def p13(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "parent_chunks", "id", "section_hierarchy", "section_title", "text").dropDuplicates(["id"])
    num = r"^[0-9]+(?:\.[0-9]+)*\s"
    return c.select("id", F.when(F.size("section_hierarchy") > 1, "bookmarks").when(F.col("section_title").rlike(num), "numbering").when(F.col("text").rlike(num), "first_line").otherwise("none").alias("strategy"))


@query("sp14_verify_pages", BASE + "SELECT doc_id, round(count(*) FILTER (s IS NOT NULL AND e IS NOT NULL AND s <= e) / count(*), 6) AS accuracy FROM t GROUP BY doc_id")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """The share of nodes with a sound page range."""
    return nodes(spark, d).groupBy("doc_id").agg(F.round(F.count_if(F.col("s") <= F.col("e")) / F.count(F.lit(1)), 6).alias("accuracy"))


@query("sp15_first_run", """
    WITH p AS (SELECT DISTINCT filename, page_number AS p FROM parent_chunks WHERE page_number IS NOT NULL AND filename IS NOT NULL AND page_number <= 30), g AS (SELECT *, p - row_number() OVER (PARTITION BY filename ORDER BY p) AS i FROM p)
    SELECT filename, min(p) AS first_page, max(p) AS last_page FROM g WHERE i = (SELECT min(i) FROM g h WHERE h.filename = g.filename) GROUP BY filename""")  # fmt: skip
def p15(spark: SparkSession, d: str) -> DataFrame:
    """The first run of pages without a gap, among the first thirty."""
    p = table(spark, d, "parent_chunks", "filename", "page_number").where("page_number <= 30 AND filename IS NOT NULL").distinct()
    g = p.withColumn("i", F.col("page_number") - F.row_number().over(Window.partitionBy("filename").orderBy("page_number")))
    r = g.groupBy("filename", "i").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    return r.groupBy("filename").agg(F.min(F.struct("i", "a", "b")).alias("x")).select("filename", F.col("x.a").alias("first_page"), F.col("x.b").alias("last_page"))


@query("sp16_distinct_entries", BASE + ", k AS (SELECT regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)\\s', 1) AS number, title FROM t WHERE title IS NOT NULL) SELECT number, title, count(*) AS n FROM k WHERE number <> '' GROUP BY ALL")
def p16(spark: SparkSession, d: str) -> DataFrame:
    k = nodes(spark, d).select(F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)\s", 1).alias("number"), "title").where("number <> ''")
    return k.groupBy("number", "title").agg(F.count(F.lit(1)).alias("n"))


@query("k06_natural_order", BASE + r", k AS (SELECT DISTINCT doc_id, regexp_extract(title, '^([0-9]+(?:\.[0-9]+)*)\s', 1) AS number FROM t WHERE regexp_matches(title, '^([0-9]+(?:\.[0-9]+)*)\s')) SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(number, '.'), lambda x: x::BIGINT)) AS place FROM k")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """Section numbers as numbers: 1.10 behind 1.9."""
    k = nodes(spark, d).select("doc_id", F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)\s", 1).alias("number")).where("number <> ''").distinct()
    return k.select("doc_id", "number", F.row_number().over(Window.partitionBy("doc_id").orderBy(T.steps(F.col("number")))).alias("place"))


@query("sp17_node_rows", BASE + "SELECT t.doc_id, t.node_path, t.depth, p.title AS parent_title, (t.doc_id, t.node_path) NOT IN (SELECT doc_id, parent_path FROM t) AS is_leaf FROM t LEFT JOIN t p ON p.doc_id = t.doc_id AND p.node_path = t.parent_path WHERE len(string_split(coalesce(t.summary, ''), ' ')) >= 5")
def p17(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    leaf = p03(spark, d).select("doc_id", "node_path", F.lit(True).alias("is_leaf"))
    up = n.select("doc_id", F.col("node_path").alias("parent_path"), F.col("title").alias("parent_title"))
    rows = n.where(F.size(F.split(F.coalesce("summary", F.lit("")), " ")) >= 5)
    return rows.join(up, ["doc_id", "parent_path"], "left").join(leaf, ["doc_id", "node_path"], "left").select("doc_id", "node_path", T.depth(F.col("node_path")).alias("depth"), "parent_title", F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"))


@query("sp18_document_index", BASE + r"SELECT doc_id, count(*) AS n_nodes, max(depth) AS depth, sum(len(regexp_extract_all(coalesce(summary, ''), '(?:REQ|SPC|TST)_[A-Za-z]+_[0-9]+')))::BIGINT AS n_refs FROM t GROUP BY doc_id")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(T.depth(F.col("node_path"))).alias("depth"), F.sum(F.regexp_count(F.coalesce("summary", F.lit("")), F.lit("(?:REQ|SPC|TST)_[A-Za-z]+_[0-9]+"))).alias("n_refs"))


@query("sp01_outline_lines", r"""
    WITH l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
    f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS code FROM l)
    SELECT doc_id, pos::INTEGER AS pos, line AS title FROM f WHERE code = 0 AND regexp_matches(line, '^(?:#{1,6}|[0-9]+(?:\.[0-9]+)*)\s+\S')""")  # fmt: skip
def p01(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines outside fenced code: a text is a row, so the fences before a line are counted within it, without a shuffle."""
    ls = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", ls.alias("ls"))
    fold = F.reduce(
        "ls",
        F.struct(F.lit(0).alias("pos"), F.lit(False).alias("code"), F.array().cast("array<struct<pos:int,title:string>>").alias("found")),
        lambda a, x: F.struct(
            (a["pos"] + 1).alias("pos"),
            F.when(x.rlike(r"^\s*```"), ~a["code"]).otherwise(a["code"]).alias("code"),
            F.when(~a["code"] & x.rlike(r"^(?:#{1,6}|[0-9]+(?:\.[0-9]+)*)\s+\S"), F.concat(a["found"], F.array(F.struct(a["pos"].alias("pos"), x.alias("title"))))).otherwise(a["found"]).alias("found"),
        ),
    )
    return t.select("doc_id", F.explode(fold["found"]).alias("x")).select("doc_id", "x.pos", "x.title")


@query("sp02_thin_tree", BASE + ", k AS (SELECT a.doc_id, a.node_path, sum(greatest(1, length(coalesce(c.summary, '')) // 4)) AS tokens FROM t a JOIN t c ON a.doc_id = c.doc_id AND (c.node_path = a.node_path OR starts_with(c.node_path, a.node_path || '.')) GROUP BY ALL), small AS (SELECT doc_id, node_path FROM k WHERE tokens < 30) SELECT t.doc_id, t.node_path FROM t WHERE NOT EXISTS (SELECT 1 FROM small x WHERE x.doc_id = t.doc_id AND starts_with(t.node_path, x.node_path || '.'))")
def p02(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below one whose whole subtree is small are taken into it."""
    small = w25(spark, d).where("tokens < 30").select("doc_id", F.col("node_path").alias("a"))
    above = nodes(spark, d).select("doc_id", "node_path", F.explode(T.prefixes(F.col("node_path"), own=False)).alias("a"))
    inside = above.join(small, ["doc_id", "a"], "left_semi").select("doc_id", "node_path").distinct()
    return nodes(spark, d).select("doc_id", "node_path").join(inside, ["doc_id", "node_path"], "left_anti")


@query("j06_drop_fields", BASE + "SELECT doc_id, node_path, title FROM t")
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Fields dropped on every level of a tree are columns not selected."""
    return nodes(spark, d).select("doc_id", "node_path", "title")


@query("j07_key_order")
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON with their keys in a set order."""
    return nodes(spark, d).select("doc_id", "node_path", F.to_json(F.struct("title", "node_path", F.col("s").alias("start_index"), F.col("e").alias("end_index"), "summary")).alias("json"))
