"""Evaluation, JSON and layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scorers import TokenOverlap
from ..operators import boxes as B
from ..operators import evaluation as V
from ..operators import leaves as L
from ..runtime import table
from .registry import query
from .text import WORDS_SQL

G = "g AS (SELECT DISTINCT ON (id) * FROM gold_records)"
TR = "t AS (SELECT DISTINCT ON (row_id) * FROM tree_rows)"
HY = "h AS (SELECT DISTINCT ON (row_id) * FROM hybrid_rows)"


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_records").dropDuplicates(["id"])


def tree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tree_rows").dropDuplicates(["row_id"])


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hybrid_rows").dropDuplicates(["row_id"])


@query("a04_summary", f"WITH {G} SELECT count(*) AS total, count(*) FILTER (scores IS NOT NULL) AS evaluable, round(count(*) FILTER (scores.answerability = 1) / count(*), 6) AS accuracy, round(avg(scores.faithfulness), 6) AS faithfulness, round(avg(scores.answer_relevance), 6) AS relevance FROM g")
def a04(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all rows, errors included; averages over rows that have the score."""
    s = F.col("scores")
    return gold(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count("scores").alias("evaluable"), F.round(F.count_if(s["answerability"] == 1) / F.count(F.lit(1)), 6).alias("accuracy"), F.round(F.avg(s["faithfulness"]), 6).alias("faithfulness"), F.round(F.avg(s["answer_relevance"]), 6).alias("relevance"))


_VERDICT = "CASE WHEN scores.faithfulness >= 0.9 THEN 'none' WHEN scores.faithfulness >= 0.7 THEN 'minor' WHEN scores.faithfulness IS NOT NULL THEN 'major' END"


@query("a05_verdicts", f"WITH {G} SELECT {_VERDICT} AS verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1")
def a05(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("scores.faithfulness")
    v = F.when(f >= 0.9, "none").when(f >= 0.7, "minor").when(f.isNotNull(), "major")
    g = gold(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("verdict", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("a06_breakdown", f"""WITH {G}, k AS (SELECT coalesce(synthesizer_name, 'unknown') AS kind, coalesce(persona, 'unknown') AS who, scores FROM g)
    SELECT kind, who, count(*) AS n, round(avg(scores.faithfulness), 6) AS faithfulness, round(sum(CASE WHEN scores.faithfulness IS NOT NULL THEN scores.faithfulness ELSE 0 END) / count(*), 6) AS over_all FROM k GROUP BY GROUPING SETS ((kind), (who), ())""")
def a06(spark: SparkSession, d: str) -> DataFrame:
    k = gold(spark, d).select(F.coalesce("synthesizer_name", F.lit("unknown")).alias("kind"), F.coalesce("persona", F.lit("unknown")).alias("who"), F.col("scores.faithfulness").alias("f"))
    return k.groupingSets([["kind"], ["who"], []], "kind", "who").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("faithfulness"), F.round(F.sum(F.coalesce("f", F.lit(0.0))) / F.count(F.lit(1)), 6).alias("over_all"))


@query("a29_older_summary", f"WITH {G} SELECT synthesizer_name, round(avg(coalesce(scores.faithfulness, 0)), 6) AS mean, count(*) FILTER (scores.question_specificity = 1) AS specific FROM g GROUP BY synthesizer_name")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).groupBy("synthesizer_name").agg(F.round(F.avg(F.coalesce("scores.faithfulness", F.lit(0.0))), 6).alias("mean"), F.count_if(F.col("scores.question_specificity") == 1).alias("specific"))


@query("a30_first_summary", f"WITH {TR} SELECT status, count(*) AS n, round(avg(len(coalesce(evidence_snippets, []))), 3) AS snippets FROM t GROUP BY status")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.array_size("evidence_snippets"), F.lit(0))), 3).alias("snippets"))


@query("a18_paired_pivot", f"""WITH {HY}, {TR}, l AS (SELECT query, 'hybrid' AS retriever, length(coalesce(ground_truth, ''))::DOUBLE AS v FROM h UNION ALL SELECT question, 'tree', length(coalesce(ground_truth, ''))::DOUBLE FROM t)
    SELECT query, avg(v) FILTER (retriever = 'hybrid') AS hybrid, avg(v) FILTER (retriever = 'tree') AS tree FROM l GROUP BY query HAVING hybrid IS NOT NULL AND tree IS NOT NULL""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    """Both systems' values per query, queries with both only."""
    v = F.length(F.coalesce("ground_truth", F.lit(""))).cast("double").alias("v")
    rows = hybrid(spark, d).select("query", F.lit("hybrid").alias("retriever"), v).unionByName(tree(spark, d).select(F.col("question").alias("query"), F.lit("tree").alias("retriever"), v))
    return rows.groupBy("query").pivot("retriever", ["hybrid", "tree"]).agg(F.avg("v")).dropna(subset=["hybrid", "tree"])


@query("a19_paired_bootstrap")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return V.bootstrap(a18(spark, d).select("query", (F.col("hybrid") - F.col("tree")).alias("delta")), key="query", rounds=2000)


@query("a20_winner")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return a19(spark, d).select("winner")


@query("jn06_outer_metrics", f"WITH {HY}, {TR}, a AS (SELECT query AS q, count(*) AS n FROM h GROUP BY 1), b AS (SELECT question AS q, count(*) AS n FROM t GROUP BY 1) SELECT coalesce(a.q, b.q) AS q, a.n AS hybrid_n, b.n AS tree_n FROM a FULL JOIN b ON a.q = b.q")
def jn06(spark: SparkSession, d: str) -> DataFrame:
    a = hybrid(spark, d).groupBy(F.col("query").alias("q")).agg(F.count(F.lit(1)).alias("hybrid_n"))
    b = tree(spark, d).groupBy(F.col("question").alias("q")).agg(F.count(F.lit(1)).alias("tree_n"))
    return a.join(b, "q", "full")


@query("a26_surface_metrics")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """BLEU-4, ROUGE-1 and ROUGE-L of the joined evidence against the ground truth."""
    return V.surface_metrics(tree(spark, d).select("row_id", F.array_join("evidence_snippets", " ").alias("answer"), "ground_truth"), ("row_id",), "answer", "ground_truth")


@query("jn20_evidence_in_context", """
    WITH h AS (SELECT DISTINCT ON (row_id) row_id, context_chunks FROM hybrid_rows), x AS (SELECT row_id, c.source_id AS source_id, c.text AS text FROM (SELECT row_id, unnest(context_chunks) AS c FROM h)),
    k AS (SELECT DISTINCT ON (id) id, raw_text FROM child_chunks)
    SELECT x.row_id, x.source_id, contains(lower(regexp_replace(k.raw_text, '\\s+', '', 'g')), lower(regexp_replace(x.text, '\\s+', '', 'g'))) AS found FROM x JOIN k ON k.id = x.source_id WHERE x.text IS NOT NULL AND k.raw_text IS NOT NULL""")  # fmt: skip
def jn20(spark: SparkSession, d: str) -> DataFrame:
    x = hybrid(spark, d).select("row_id", F.explode("context_chunks").alias("c")).select("row_id", "c.source_id", "c.text")
    k = table(spark, d, "child_chunks", "id", "raw_text").dropDuplicates(["id"]).withColumnRenamed("id", "source_id")
    flat = lambda c: F.lower(X.despace(F.col(c)))
    return x.join(k, "source_id").where("text IS NOT NULL AND raw_text IS NOT NULL").select("row_id", "source_id", F.contains(flat("raw_text"), flat("text")).alias("found"))


@query("jn10_fuzzy_context")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    """The same with near matches, pairs joined by the source id first."""
    x = hybrid(spark, d).select("row_id", F.explode("context_chunks").alias("c")).select("row_id", "c.source_id", "c.text")
    k = table(spark, d, "child_chunks", "id", "raw_text").dropDuplicates(["id"]).withColumnRenamed("id", "source_id")
    return V.fuzzy_pairs(x.join(k, "source_id"), ("row_id", "source_id"), "text", "raw_text")


@query("m06_miss_taxonomy")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Expected chunks that are not among the three best of a row, by why: their texts against the three and the rest."""
    chunk = table(spark, d, "child_chunks", "id", "raw_text", "filename").dropDuplicates(["id"])
    c = hybrid(spark, d).select("row_id", F.explode("context_chunks").alias("c")).select("row_id", "c.source_id", "c.text", "c.score")
    c = c.join(chunk.select(F.col("id").alias("source_id"), "filename"), "source_id", "left")
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc_nulls_last("score"), "source_id")))
    best = lambda near: F.collect_list(F.when(near, F.struct("text", "filename")))
    lists = c.groupBy("row_id").agg(best(F.col("n") <= 3).alias("retrieved"), best(F.col("n") > 3).alias("pool"), F.collect_set(F.when(F.col("n") <= 3, F.col("source_id"))).alias("ids"))
    want = hybrid(spark, d).select("row_id", F.explode("expected_chunks").alias("id")).join(lists, "row_id").where(~F.array_contains("ids", F.col("id")))
    missed = want.join(chunk.select("id", "raw_text"), "id").where("raw_text IS NOT NULL")
    return V.miss_kinds(missed, ("row_id", "id"), "raw_text", "retrieved", "pool")


@query("m04_ratio")
def m04(spark: SparkSession, d: str) -> DataFrame:
    return jn10(spark, d).groupBy("row_id").agg(F.count_if("matched").alias("matched"), F.count(F.lit(1)).alias("n"))


@query("m09_value_alignment", r"""
    WITH c AS (SELECT DISTINCT ON (id) id, section_title AS a, section_hierarchy[len(section_hierarchy)] AS b FROM child_chunks WHERE section_title IS NOT NULL),
    n AS (SELECT id, a, b, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS y FROM c)
    SELECT id, CASE WHEN b IS NULL OR trim(b) = '' THEN 'MISSING_VALUE' WHEN x = y AND x <> '' THEN 'MATCH' ELSE 'OTHER' END AS status FROM n""")  # fmt: skip
def m09(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "section_title", "section_hierarchy").dropDuplicates(["id"]).where("section_title IS NOT NULL")
    s = V.value_status(F.lit(""), F.col("section_title"), F.try_element_at("section_hierarchy", F.lit(-1)))
    return c.select("id", F.when(s.isin("MATCH", "MISSING_VALUE"), s).otherwise("OTHER").alias("status"))


@query("m09_value_status")
def m09b(spark: SparkSession, d: str) -> DataFrame:
    p = hybrid(spark, d).select("query", F.col("ground_truth").alias("a")).join(tree(spark, d).select(F.col("question").alias("query"), F.col("ground_truth").alias("b")), "query")
    return p.select("query", V.value_status(F.lit(""), F.col("a"), F.col("b")).alias("status"))


@query("a21_overlap_recall", """
    WITH c AS (SELECT DISTINCT ON (id) id, filename, page_number, raw_text, section_title FROM child_chunks WHERE filename IS NOT NULL AND section_title IS NOT NULL)
    SELECT filename, page_number, count(*) AS n, round(avg(contains(lower(raw_text), lower(section_title))::INTEGER), 6) AS recall FROM c WHERE raw_text IS NOT NULL GROUP BY ROLLUP (filename, page_number)""")  # fmt: skip
def a21(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "filename", "page_number", "raw_text", "section_title").dropDuplicates(["id"]).where("filename IS NOT NULL AND section_title IS NOT NULL AND raw_text IS NOT NULL")
    return c.rollup("filename", "page_number").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.contains(F.lower("raw_text"), F.lower("section_title")).cast("int")), 6).alias("recall"))


@query("jn19_scoped_containment", """
    WITH c AS (SELECT DISTINCT ON (id) id, parent_id, section_title, raw_text FROM child_chunks WHERE section_title IS NOT NULL), p AS (SELECT DISTINCT ON (id) id, text FROM parent_chunks)
    SELECT c.id, contains(lower(coalesce(p.text, c.raw_text, '')), lower(c.section_title)) AS found FROM c LEFT JOIN p ON p.id = c.parent_id""")  # fmt: skip
def jn19(spark: SparkSession, d: str) -> DataFrame:
    """A value looked for in its parent's text, or where there is none in its own."""
    c = table(spark, d, "child_chunks", "id", "parent_id", "section_title", "raw_text").dropDuplicates(["id"]).where("section_title IS NOT NULL")
    p = table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).withColumnRenamed("id", "parent_id")
    return c.join(p, "parent_id", "left").select("id", F.contains(F.lower(F.coalesce("text", "raw_text", F.lit(""))), F.lower("section_title")).alias("found"))


@query("a23_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("k07_pending", "SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY value DESC, ts, event_id LIMIT 25")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 pending tasks by priority and age: a top-k report."""
    return table(spark, d, "events", "event_id", "event_type", "value", "ts").where("event_type = 'click'").orderBy(F.desc("value"), "ts", "event_id").limit(25).select("event_id", "value")


@query("k08_paging", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 20 OFFSET 40")
def k08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "event_type", "ts").where("event_type = 'view'").orderBy("ts", "event_id").offset(40).limit(20).select("event_id")


@query("o05_undirected_edges", """
    WITH h AS (SELECT DISTINCT ON (row_id) row_id, context_chunks FROM hybrid_rows), x AS (SELECT row_id, c.source_id AS s FROM (SELECT row_id, unnest(context_chunks) AS c FROM h)),
    e AS (SELECT least(a.s, b.s) AS src, greatest(a.s, b.s) AS dst FROM x a JOIN x b ON a.row_id = b.row_id WHERE a.s <> b.s) SELECT DISTINCT src, dst FROM e""")  # fmt: skip
def o05(spark: SparkSession, d: str) -> DataFrame:
    """Chunks retrieved together, as edges without direction or loops; lists are short, so pairs are made within a row."""
    s = F.array_distinct(F.transform("context_chunks", lambda c: c["source_id"]))
    pairs = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: a < b), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return hybrid(spark, d).select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


@query("jn03_first_edge", """
    WITH c AS (SELECT DISTINCT ON (id) id, parent_id, filename FROM child_chunks WHERE filename IS NOT NULL) SELECT parent_id, min(filename) AS filename FROM c WHERE parent_id IS NOT NULL GROUP BY parent_id""")  # fmt: skip
def jn03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "parent_id", "filename").where("filename IS NOT NULL AND parent_id IS NOT NULL")
    return c.groupBy("parent_id").agg(F.min("filename").alias("filename"))


@query("jn04_title_pairs", """
    WITH a AS (SELECT DISTINCT filename, section_title, page_number FROM parent_chunks WHERE page_number IS NOT NULL), b AS (SELECT DISTINCT filename, section_title, page_number FROM child_chunks WHERE page_number IS NOT NULL)
    SELECT DISTINCT a.filename, a.section_title, a.page_number AS p, b.page_number AS q FROM a JOIN b ON a.filename = b.filename AND a.section_title = b.section_title WHERE b.page_number BETWEEN a.page_number - 5 AND a.page_number + 5""")  # fmt: skip
def jn04(spark: SparkSession, d: str) -> DataFrame:
    """Equal titles within five pages."""
    a = table(spark, d, "parent_chunks", "filename", "section_title", "page_number").where("page_number IS NOT NULL").distinct().withColumnRenamed("page_number", "p")
    b = table(spark, d, "child_chunks", "filename", "section_title", "page_number").where("page_number IS NOT NULL").distinct().withColumnRenamed("page_number", "q")
    return a.join(b, ["filename", "section_title"]).where("q BETWEEN p - 5 AND p + 5").select("filename", "section_title", "p", "q").distinct()


@query("jn07_both_ends", """
    WITH c AS (SELECT DISTINCT id, parent_id FROM child_chunks), p AS (SELECT DISTINCT id FROM parent_chunks) SELECT DISTINCT c.id FROM c WHERE parent_id IN (SELECT id FROM p)""")  # fmt: skip
def jn07(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parent_chunks", "id").select(F.col("id").alias("parent_id")).distinct()
    return table(spark, d, "child_chunks", "id", "parent_id").join(p, "parent_id", "left_semi").select("id").distinct()


RULES = [("timeout", "timing"), ("gateway", "network"), ("key", "security"), ("sensor", "hardware")]


@query("jn21_rule_join", "WITH h AS (SELECT DISTINCT ON (row_id) row_id, lower(query) AS q FROM hybrid_rows), r AS (SELECT * FROM (VALUES ('timeout', 'timing'), ('gateway', 'network'), ('key', 'security'), ('sensor', 'hardware')) v(word, topic)) SELECT row_id, topic FROM h JOIN r ON contains(q, word)")
def jn21(spark: SparkSession, d: str) -> DataFrame:
    """A table of four rules, kept in the plan as literals: every text is looked at once."""
    q = F.lower("query")
    hits = F.array_compact(F.array(*(F.when(q.contains(w), F.lit(t)) for w, t in RULES)))
    return hybrid(spark, d).select("row_id", F.explode(hits).alias("topic"))


@query("w23_heading_dedup", "WITH c AS (SELECT DISTINCT ON (id) id, filename, page_number, section_title, child_index FROM child_chunks WHERE filename IS NOT NULL AND page_number IS NOT NULL) SELECT filename, page_number, arg_max(section_title, id) AS heading, count(*) AS n FROM c WHERE section_title IS NOT NULL GROUP BY ALL")
def w23(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "filename", "page_number", "section_title").dropDuplicates(["id"]).where("filename IS NOT NULL AND page_number IS NOT NULL AND section_title IS NOT NULL")
    return c.groupBy("filename", "page_number").agg(F.max_by("section_title", "id").alias("heading"), F.count(F.lit(1)).alias("n"))


BOX = "list_value(l_partkey % 500, l_suppkey % 500, l_partkey % 500 + 100 + l_linenumber * 20, l_suppkey % 500 + 80)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made of line items: an order is a page."""
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", F.array(x, y, x + 100 + F.col("l_linenumber") * 20, y + 80).cast("array<int>").alias("box")
    )


@query("m11_normalised_boxes", f"SELECT l_orderkey, l_linenumber, array_to_string(list_transform({BOX}, lambda v, i: floor(v * 1000 / CASE WHEN i % 2 = 1 THEN 2040 ELSE 2640 END)::INTEGER), ',') AS box FROM lineitem")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("l_orderkey", "l_linenumber", F.array_join(F.transform(B.normalised(F.col("box"), F.lit(2040), F.lit(2640)), lambda v: v.cast("string")), ",").alias("box"))


@query("t11_margin_blocks", f"SELECT l_orderkey, l_linenumber, ({BOX})[4] <= 80 OR ({BOX})[2] >= 920 AS in_margin FROM lineitem")
def t11(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box")
    return boxes(spark, d).select("l_orderkey", "l_linenumber", X.in_margin(b[1], b[3]).alias("in_margin"))


@query("f21_large_regions", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE (({BOX})[3] - ({BOX})[1]) * (({BOX})[4] - ({BOX})[2]) > 0.018 * 1000000")
def f21(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box")
    return boxes(spark, d).where((b[2] - b[0]) * (b[3] - b[1]) > 0.018 * 1000000).select("l_orderkey", "l_linenumber")


_W = "greatest(0, least(a[3], b[3]) - greatest(a[1], b[1]) + 1) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2]) + 1)"


@query("m12_box_overlap", f"""WITH x AS (SELECT l_orderkey, l_linenumber AS l, {BOX} AS b FROM lineitem), p AS (SELECT x.l_orderkey, x.l AS l1, y.l AS l2, x.b AS a, y.b AS b FROM x JOIN x y ON x.l_orderkey = y.l_orderkey AND x.l < y.l)
    SELECT l_orderkey, l1, l2, round({_W} / ((a[3] - a[1] + 1) * (a[4] - a[2] + 1) + (b[3] - b[1] + 1) * (b[4] - b[2] + 1) - {_W}), 6) AS iou FROM p WHERE {_W} > 0""")
def m12(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of the boxes of a page, which are few."""
    x = boxes(spark, d)
    a, b = x.select("l_orderkey", F.col("l_linenumber").alias("l1"), F.col("box").alias("a")), x.select("l_orderkey", F.col("l_linenumber").alias("l2"), F.col("box").alias("b"))
    return a.join(b, "l_orderkey").where("l1 < l2").select("l_orderkey", "l1", "l2", F.round(B.overlap(F.col("a"), F.col("b")), 6).alias("iou")).where("iou > 0")


@query("k17_suppression")
def k17(spark: SparkSession, d: str) -> DataFrame:
    return B.suppressed(boxes(spark, d), "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "box")


@query("k18_containment", f"""WITH x AS (SELECT l_orderkey, l_linenumber AS l, {BOX} AS b FROM lineitem),
    p AS (SELECT x.l_orderkey, x.l, x.b AS a, y.b AS b FROM x JOIN x y ON x.l_orderkey = y.l_orderkey AND x.l <> y.l),
    i AS (SELECT DISTINCT l_orderkey, l FROM p WHERE greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) >= 0.8 * (a[3] - a[1]) * (a[4] - a[2]))
    SELECT x.l_orderkey, x.l AS l_linenumber FROM x ANTI JOIN i ON x.l_orderkey = i.l_orderkey AND x.l = i.l""")
def k18(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that lie to four fifths in another of their page are left out."""
    x = boxes(spark, d)
    y = x.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("box").alias("b"))
    inside = x.join(y, "l_orderkey").where(F.col("l_linenumber") != F.col("other")).where(B.contained(F.col("box"), F.col("b")) >= 0.8).select("l_orderkey", "l_linenumber").distinct()
    return x.select("l_orderkey", "l_linenumber").join(inside, ["l_orderkey", "l_linenumber"], "left_anti")


@query("j01_lenient_json", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j01(spark: SparkSession, d: str) -> DataFrame:
    """JSON found as it is, in a fence, or as the first braces of a text."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
    t = table(spark, d, "events", "event_id", "props").select("event_id", wrapped.alias("raw"))
    found = F.coalesce(F.when(F.trim("raw").startswith("{"), F.col("raw")), F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), F.lit("")))
    return t.select("event_id", F.from_json(found, "k bigint")["k"].alias("k"))


@query("j10_first_object", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """The first balanced object of a text with braces before, in strings and after it."""
    wrapped = F.concat(F.lit('As asked: {"a": "}{\\"", "b": {"x": '), "props", F.lit('}} and then {"k": -1}'))
    t = table(spark, d, "events", "event_id", "props").select("event_id", wrapped.alias("raw"))
    return V.first_objects(t, ("event_id",), "raw").select("event_id", F.from_json("object", "b struct<x: struct<k: bigint>>")["b"]["x"]["k"].alias("k"))


@query("jn16_semantic_first")
def jn16(spark: SparkSession, d: str) -> DataFrame:
    """Questions of a synthesizer and persona that are not like an earlier one, by the stand-in encoder's vectors."""
    g = gold(spark, d).select("id", "user_input", F.concat_ws("|", "synthesizer_name", "persona", F.get("source_documents", F.lit(0))).alias("maker"))
    return V.semantic_first(TokenOverlap().encode(g, "user_input"), "maker", "id").select("id")


@query("k05_rerank", f"""
    WITH {HY}, c AS (SELECT row_id, query, x.source_id AS source_id, x.text AS text, x.hop_index AS hop FROM (SELECT row_id, query, unnest(context_chunks) AS x FROM h)),
    e AS (SELECT row_id, arg_min(text, source_id) AS evidence FROM c WHERE coalesce(hop, 0) = 0 AND text IS NOT NULL GROUP BY row_id),
    a AS (SELECT c.*, CASE WHEN hop >= 1 AND coalesce(evidence, '') <> '' THEN query || chr(10) || chr(10) || 'Bridge evidence from prior step:' || chr(10) || evidence ELSE query END AS asked FROM c LEFT JOIN e USING (row_id)),
    w AS (SELECT row_id, source_id, {WORDS_SQL.replace('@', 'asked')} AS q, {WORDS_SQL.replace('@', 'text')} AS t FROM a),
    s AS (SELECT row_id, source_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS score FROM w)
    SELECT row_id, source_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, source_id) AS place FROM s) WHERE place <= 3""")  # fmt: skip
def k05(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks of each row by the stand-in scorer, those of later hops against the first hop's evidence too."""
    c = hybrid(spark, d).select("row_id", "query", F.explode("context_chunks").alias("x")).select("row_id", "query", "x.source_id", "x.text", "x.hop_index")
    e = c.where((F.coalesce("hop_index", F.lit(0)) == 0) & F.col("text").isNotNull()).groupBy("row_id").agg(F.min_by("text", "source_id").alias("evidence"))
    return V.rerank(c.join(e, "row_id", "left"), TokenOverlap(), 3, keys=("row_id",), item="source_id").select("row_id", "source_id", F.round("rerank_score", 6).alias("score"), "place")


@query("jn17_aligned_leaves")
def jn17(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of structure files against those of the same files with a changed value and a moved path here and there."""
    return L.align(_leaves(spark, d), _changed(spark, d, 5)).select("doc_id", "place", "path", "predicted_path", "status")


@query("jn18_aligned_three")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    return L.align_three(_leaves(spark, d), _changed(spark, d, 5), _changed(spark, d, 7)).select("doc_id", "place", "path", "first_path", "first_status", "second_path", "second_status")


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("path")
    return j04(spark, d).where("value IS NOT NULL").groupBy("doc_id", "path").agg(F.min("value").alias("value")).withColumn("place", F.row_number().over(w))


def _changed(spark: SparkSession, d: str, n: int) -> DataFrame:
    k = F.pmod(F.xxhash64("path"), F.lit(n))
    return _leaves(spark, d).where(k != 0).select("doc_id", "place", F.when(k == 1, F.concat(F.lit("moved."), "path")).otherwise(F.col("path")).alias("path"), F.when(k == 2, F.concat("value", F.lit(" changed"))).otherwise(F.col("value")).alias("value"))


@query("j02_repaired_json", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j02(spark: SparkSession, d: str) -> DataFrame:
    """Thoughts, None and trailing commas removed before reading."""
    raw = F.concat(F.lit("<think>{ no }</think>"), F.regexp_replace("props", r"\}$", ", \"x\": None,}"))
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"\bNone\b", "null"), r",\s*([}\]])", "$1")
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json(fixed, "k bigint")["k"].alias("k"))


@query("j03_json_array", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS total FROM events")
def j03(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("list: ["), "props", F.lit(", "), "props", F.lit("] end"))
    arr = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), "array<struct<k:bigint>>")
    return table(spark, d, "events", "event_id", "props").select("event_id", F.reduce(arr, F.lit(0).cast("bigint"), lambda s, x: s + x["k"]).alias("total"))


@query("j04_leaves")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Path, value and page of every plain value of the structure files; a node's first page is inherited."""
    from ..operators.nested import json_triples

    t = json_triples(table(spark, d, "structure_files", "doc_id", "raw_json")).where("kind <> 'object'")
    pages = t.where("column_name = 'start_index'").groupBy("doc_id", "address").agg(F.max("value").try_cast("int").alias("page"))
    return t.join(pages, ["doc_id", "address"], "left").select("doc_id", F.concat_ws(".", "address", F.nullif("column_name", F.lit(""))).alias("path"), "value", "page").distinct()


@query("j05_all_strings")
def j05(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.nested import json_triples

    return json_triples(table(spark, d, "structure_files", "doc_id", "raw_json")).where("kind = 'string' AND value <> ''").select("doc_id", "value").distinct()


@query("j08_flat_scores", f"WITH {G} SELECT id, scores.answerability AS answerability, round(scores.faithfulness, 6) AS faithfulness, metadata.judge_model AS judge_model FROM g")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("id", "scores.answerability", F.round("scores.faithfulness", 6).alias("faithfulness"), "metadata.judge_model")


@query("j09_clipped_scores", f"WITH {G} SELECT id, round(least(1.0, greatest(0.0, coalesce(scores.faithfulness, 0))), 6) AS faithfulness, coalesce(scores.answerability, 0)::INTEGER AS answerability FROM g")
def j09(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("scores")
    return gold(spark, d).select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s["faithfulness"], F.lit(0.0)))), 6).alias("faithfulness"), F.coalesce(s["answerability"], F.lit(0)).alias("answerability"))


@query("f19_page_bound", "SELECT DISTINCT ON (id) id, CASE WHEN page_number <= 100 THEN page_number END AS page FROM child_chunks")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "child_chunks", "id", "page_number").dropDuplicates(["id"]).select("id", F.when(F.col("page_number") <= 100, F.col("page_number")).alias("page"))


@query("st05_backoff", "SELECT event_id, least(60 * power(2, event_id % 8), 3600)::BIGINT AS delay, CASE WHEN event_id % 8 >= 5 THEN 'dead_letter' WHEN event_type IN ('click', 'view') THEN 'pending' ELSE 'dead_letter' END AS status FROM events")
def st05(spark: SparkSession, d: str) -> DataFrame:
    """Exponential delays with a cap, without the jitter; too many tries or an error that can't pass go to the dead letters."""
    n = F.col("event_id") % 8
    return table(spark, d, "events", "event_id", "event_type").select("event_id", F.least(60 * F.pow(F.lit(2), n), F.lit(3600)).cast("long").alias("delay"), F.when(n >= 5, "dead_letter").when(F.col("event_type").isin("click", "view"), "pending").otherwise("dead_letter").alias("status"))


@query("st08_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def st08(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "event_id", "ts")
    return t.crossJoin(F.broadcast(t.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 7 DAYS").select("event_id")
