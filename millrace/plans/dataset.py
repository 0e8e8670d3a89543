"""Queries of the evaluation-set stage over the gold records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dataset as D
from ..runtime import table
from .registry import query
from .text import QUESTION_KEY_SQL, WORDS_SQL

G = "g AS (SELECT DISTINCT ON (id) * FROM gold_records)"
REASONS = """list_concat(list_filter([CASE WHEN NOT coalesce(scores.answerability = 1, false) THEN 'answerability_0' END,
    CASE WHEN NOT coalesce(scores.question_specificity = 1, false) THEN 'question_specificity_0' END,
    CASE WHEN coalesce(scores.faithfulness, 0) < 0.85 THEN 'faithfulness_below_0.85' END,
    CASE WHEN coalesce(scores.answer_relevance, 0) < 0.80 THEN 'answer_relevance_below_0.8' END], lambda x: x IS NOT NULL),
    list_transform(coalesce(scores.structural_fail_reasons, []), lambda r: 'structural:' || r))"""
KEY = QUESTION_KEY_SQL.replace("@", "user_input")
P = f"p AS (SELECT * FROM (SELECT *, {REASONS} AS reasons FROM g) WHERE len(reasons) = 0)"
DEDUP = f"""u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY scores.answerability DESC NULLS LAST, scores.faithfulness DESC NULLS LAST,
    scores.answer_relevance DESC NULLS LAST, coalesce(len(reference_contexts), 0) DESC, id) AS rn FROM p) WHERE rn = 1)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_records").dropDuplicates(["id"])


def passed(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).where(F.size(D.gate_reasons(F.col("scores"))) == 0)


def quality() -> list:
    s = F.col("scores")
    return [F.desc_nulls_last(s["answerability"]), F.desc_nulls_last(s["faithfulness"]), F.desc_nulls_last(s["answer_relevance"]), F.desc(F.coalesce(F.array_size("reference_contexts"), F.lit(0))), F.col("id")]


def unique(spark: SparkSession, d: str) -> DataFrame:
    return D.best_per_key(passed(spark, d), X.question_key(F.col("user_input")), quality())


def source() -> Column:
    return F.coalesce(F.get("source_documents", F.lit(0)), F.lit("_unknown_"))


SOURCE = "coalesce(source_documents[1], '_unknown_')"
CAP = 40


@query("f10_score_gate", f"WITH {G} SELECT id, array_to_string({REASONS}, ',') AS reasons FROM g")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("id", F.array_join(D.gate_reasons(F.col("scores")), ",").alias("reasons"))


@query("f04_context_count", f"WITH {G} SELECT id FROM g WHERE (synthesizer_name LIKE 'multi\\_hop%' ESCAPE '\\' AND coalesce(len(reference_contexts), 0) < 2) OR (synthesizer_name LIKE 'single\\_hop%' ESCAPE '\\' AND coalesce(len(reference_contexts), 0) <> 1)")
def f04(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.array_size("reference_contexts"), F.lit(0))
    s = F.col("synthesizer_name")
    return gold(spark, d).where((s.startswith("multi_hop") & (n < 2)) | (s.startswith("single_hop") & (n != 1))).select("id")


_QW, _RW = WORDS_SQL.replace("@", "user_input"), WORDS_SQL.replace("@", "reference")


@query("f06_echo", f"""WITH {G}, w AS (SELECT id, reference, {_QW} AS q, {_RW} AS r FROM g)
    SELECT id, len(r) > 0 AND len(q) >= 5 AND len(list_intersect(q, r)) > 0.7 * len(r) AND length(reference) < 200 AS echo FROM w WHERE reference IS NOT NULL""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    q, r = X.content_words(F.col("user_input")), X.content_words(F.col("reference"))
    return gold(spark, d).where("reference IS NOT NULL").select("id", ((F.size(r) > 0) & (F.size(q) >= 5) & (F.size(F.array_intersect(q, r)) > 0.7 * F.size(r)) & (F.length("reference") < 200)).alias("echo"))


@query("f07_grounding", f"""WITH {G}, w AS (SELECT id, {_RW} AS r, flatten(list_transform(coalesce(reference_contexts, []), lambda c: {WORDS_SQL.replace('@', 'c')})) AS c FROM g WHERE reference IS NOT NULL)
    SELECT id, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, c)) / len(r) END, 6) AS overlap FROM w""")
def f07(spark: SparkSession, d: str) -> DataFrame:
    r = X.content_words(F.col("reference"))
    c = F.flatten(F.transform(F.coalesce("reference_contexts", F.array().cast("array<string>")), X.content_words))
    return gold(spark, d).where("reference IS NOT NULL").select("id", F.round(F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(r, c)) / F.size(r)), 6).alias("overlap"))


@query("f08_structural_checks")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("id", F.array_join(D.structural_reasons(F.col("user_input"), F.col("reference"), F.col("reference_contexts"), F.col("synthesizer_name")), ",").alias("reasons"))


@query("f09_page_filter", """
    WITH p AS (SELECT DISTINCT ON (id) id, text FROM parent_chunks),
    r AS (SELECT CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' WHEN length(text) < 800 THEN 'too_short' WHEN len(regexp_extract_all(text, '\\.{5,}')) > 0 THEN 'dotted' ELSE 'kept' END AS reason FROM p)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")  # fmt: skip
def f09(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    reason = F.when(c.isNull() | (X.strip(c) == ""), "empty").when(F.length(c) < 800, "too_short").when(c.rlike(r"\.{5,}"), "dotted").otherwise("kept")
    return table(spark, d, "parent_chunks", "id", "text").dropDuplicates(["id"]).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_restatement", """
    WITH g AS (SELECT DISTINCT ON (id) id, lower(user_input) AS q, lower(reference) AS a FROM gold_records WHERE reference IS NOT NULL)
    SELECT id, contains(left(a, 160), left(regexp_replace(q, '^(?:what|how|why|which|does|in what order|under which condition)\\s+', ''), 40)) OR (length(a) < 120 AND NOT regexp_matches(a, '[0-9_]')) AS restated FROM g""")  # fmt: skip
def f11(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.lower("user_input"), F.lower("reference")
    head = F.left(F.regexp_replace(q, r"^(?:what|how|why|which|does|in what order|under which condition)\s+", ""), F.lit(40))
    return gold(spark, d).where("reference IS NOT NULL").select("id", (F.contains(F.left(a, F.lit(160)), head) | ((F.length(a) < 120) & ~a.rlike("[0-9_]"))).alias("restated"))


@query("f12_both_contexts", f"""WITH {G}, w AS (SELECT id, {_RW} AS r, {WORDS_SQL.replace('@', 'reference_contexts[1]')} AS a, {WORDS_SQL.replace('@', 'reference_contexts[2]')} AS b FROM g WHERE len(reference_contexts) >= 2 AND reference IS NOT NULL)
    SELECT id, len(r) > 0 AND len(list_intersect(r, a)) >= 0.1 * len(r) AND len(list_intersect(r, b)) >= 0.1 * len(r) AS both_used FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    r = X.content_words(F.col("reference"))
    a, b = (X.content_words(F.get("reference_contexts", F.lit(i))) for i in (0, 1))
    t = gold(spark, d).where("size(reference_contexts) >= 2 AND reference IS NOT NULL").select("id", r.alias("r"), a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    n = F.size("r")
    return t.select("id", ((n > 0) & (F.size(F.array_intersect("r", "a")) >= 0.1 * n) & (F.size(F.array_intersect("r", "b")) >= 0.1 * n)).alias("both_used"))


@query("f13_degenerate_nodes", "SELECT DISTINCT id FROM parent_chunks WHERE length(text) >= 600")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parent_chunks", "id", "text").where(F.length("text") >= 600).select("id").distinct()


@query("f14_question_gate", """
    WITH g AS (SELECT DISTINCT ON (id) id, user_input, reference, reference_contexts FROM gold_records),
    n AS (SELECT *, count(*) OVER (PARTITION BY lower(user_input)) AS same FROM g)
    SELECT id, length(user_input) BETWEEN 20 AND 400 AND length(coalesce(reference, '')) >= 20 AND len(coalesce(reference_contexts, [])) > 0 AND same = 1 AS ok FROM n""")  # fmt: skip
def f14(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).withColumn("k", F.lower("user_input"))
    n = g.groupBy("k").agg(F.count(F.lit(1)).alias("same"))
    ok = F.length("user_input").between(20, 400) & (F.length(F.coalesce("reference", F.lit(""))) >= 20) & (F.coalesce(F.array_size("reference_contexts"), F.lit(0)) > 0) & (F.col("same") == 1)
    return g.join(n, g["k"].eqNullSafe(n["k"])).select("id", ok.alias("ok"))


@query("f15_problem_flags", """
    WITH g AS (SELECT DISTINCT ON (id) id, user_input, reference, source_documents FROM gold_records)
    SELECT id, array_to_string(list_filter([CASE WHEN length(user_input) < 40 THEN 'short_question' END, CASE WHEN length(coalesce(reference, '')) = 0 THEN 'no_answer' END, CASE WHEN len(coalesce(source_documents, [])) = 0 THEN 'no_source' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""")  # fmt: skip
def f15(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.length("user_input") < 40, "short_question"), F.when(F.length(F.coalesce("reference", F.lit(""))) == 0, "no_answer"), F.when(F.coalesce(F.array_size("source_documents"), F.lit(0)) == 0, "no_source")))
    return gold(spark, d).select("id", F.array_join(flags, ",").alias("flags"))


@query("f16_metadata_filter", """
    SELECT DISTINCT id FROM child_chunks WHERE filename IN ('NetIf_Integration_Guide_R6-4_00.pdf', 'PduGate_Integration_Guide_R3-6_01.pdf') AND page_number BETWEEN 10 AND 90 AND child_index = 0""")  # fmt: skip
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Membership, range and equality; all three reach the Parquet scan."""
    t = table(spark, d, "child_chunks", "id", "filename", "page_number", "child_index")
    return t.where(F.col("filename").isin("NetIf_Integration_Guide_R6-4_00.pdf", "PduGate_Integration_Guide_R3-6_01.pdf") & F.col("page_number").between(10, 90) & (F.col("child_index") == 0)).select("id").distinct()


@query("f17_snippet_prefix", """
    WITH t AS (SELECT DISTINCT ON (row_id) row_id, ground_truth, evidence_snippets FROM tree_rows)
    SELECT row_id, CAST(len(list_filter(coalesce(evidence_snippets, []), lambda s: length(s) >= 15 AND contains(ground_truth, left(s, 15)))) AS INTEGER) AS verified FROM t WHERE ground_truth IS NOT NULL""")  # fmt: skip
def f17(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tree_rows", "row_id", "ground_truth", "evidence_snippets").dropDuplicates(["row_id"]).where("ground_truth IS NOT NULL")
    hit = F.filter(F.coalesce("evidence_snippets", F.array().cast("array<string>")), lambda s: F.coalesce((F.length(s) >= 15) & F.contains(F.col("ground_truth"), F.left(s, F.lit(15))), F.lit(False)))
    return t.select("row_id", F.size(hit).alias("verified"))


@query("w03_dedup_best", f"WITH {G}, {P}, {DEDUP} SELECT id FROM u")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return unique(spark, d).select("id")


@query("w05_source_cap", f"WITH {G}, {P}, {DEDUP} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {SOURCE} ORDER BY md5('42:' || id), id) AS n FROM u) WHERE n <= {CAP}")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return D.cap_per_group(unique(spark, d), source(), CAP, F.col("id"), 42).select("id")


QUOTA = """c AS (SELECT synthesizer_name, count(*) AS n FROM u GROUP BY 1),
    q AS (SELECT *, greatest(1, CAST(round(100 * n / sum(n) OVER ()) AS INTEGER)) AS q0, row_number() OVER (ORDER BY n DESC, synthesizer_name) - 1 AS r, count(*) OVER () AS k, sum(n) OVER () AS total FROM c),
    l AS (SELECT *, 100 - sum(q0) OVER () AS rest FROM q),
    f AS (SELECT *, q0 + sign(rest) * CASE WHEN abs(rest) > r THEN floor((abs(rest) - 1 - r) / k) + 1 ELSE 0 END AS quota FROM l)"""


@query("k09_stratified", f"WITH {G}, {P}, {DEDUP}, {QUOTA} SELECT id FROM (SELECT u.id, row_number() OVER (PARTITION BY u.synthesizer_name ORDER BY md5('7:' || u.id), u.id) AS n, quota, total FROM u JOIN f ON u.synthesizer_name IS NOT DISTINCT FROM f.synthesizer_name) WHERE n <= quota OR total <= 100")
def k09(spark: SparkSession, d: str) -> DataFrame:
    return D.stratified(unique(spark, d), 100, "synthesizer_name", F.col("id"), 7).select("id")


@query("k10_split", """
    WITH o AS (SELECT id, row_number() OVER (ORDER BY md5('43:' || id), id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM gold_records))
    SELECT id, CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.6 * n) + floor(0.2 * n) THEN 'dev' ELSE 'test' END AS split FROM o""")  # fmt: skip
def k10(spark: SparkSession, d: str) -> DataFrame:
    return D.split_of(gold(spark, d).select("id"), "id", 43).select("id", "split")


@query("k11_review_sample", f"WITH {G}, r AS (SELECT id, row_number() OVER (PARTITION BY synthesizer_name ORDER BY md5('44:' || id), id) AS i, count(*) OVER (PARTITION BY synthesizer_name) AS n FROM g) SELECT id FROM r WHERE i <= greatest(1, round(0.1 * n))")
def k11(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).select("id", "synthesizer_name")
    n = g.groupBy("synthesizer_name").agg(F.greatest(F.lit(1), F.round(0.1 * F.count(F.lit(1))).cast("int")).alias("most"))
    w = D.Window.partitionBy("synthesizer_name").orderBy(D.draw(F.col("id"), 44), "id")
    r = g.withColumn("i", F.row_number().over(w))
    return r.join(n, r["synthesizer_name"].eqNullSafe(n["synthesizer_name"])).where("i <= most").select("id")


@query("k12_diverse_selection", f"WITH {G}, r AS (SELECT id, synthesizer_name, row_number() OVER (PARTITION BY synthesizer_name ORDER BY id) AS i FROM g) SELECT id FROM (SELECT id, row_number() OVER (ORDER BY i > 10, i, synthesizer_name, id) AS n FROM r) WHERE n <= 60")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Ten of each type first, then by turns: a top-k report of sixty."""
    w = D.Window.partitionBy("synthesizer_name").orderBy("id")
    return gold(spark, d).select("id", "synthesizer_name", F.row_number().over(w).alias("i")).orderBy(F.col("i") > 10, "i", F.asc_nulls_last("synthesizer_name"), "id").limit(60).select("id")


@query("k13_scenarios")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Two scenarios for each file at least and more for larger ones: chunk pairs drawn by hash, with replacement."""
    c = table(spark, d, "child_chunks", "id", "filename").dropDuplicates(["id"]).where("filename IS NOT NULL")
    n = c.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    w = D.Window.partitionBy("filename").orderBy("id")
    at = c.withColumn("i", F.row_number().over(w) - 1)
    wish = n.select("filename", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(2), F.floor(F.sqrt("n")).cast("int")))).alias("s"))
    wish = wish.select("filename", "s", *(F.pmod(F.xxhash64("filename", "s", F.lit(k)), F.col("n")).alias(f"i{k}") for k in (1, 2)))
    a, b = at.select("filename", F.col("i").alias("i1"), F.col("id").alias("node_a")), at.select("filename", F.col("i").alias("i2"), F.col("id").alias("node_b"))
    return wish.join(a, ["filename", "i1"]).join(b, ["filename", "i2"]).where("node_a <> node_b").select("filename", F.col("s").alias("scenario"), "node_a", "node_b")


@query("k14_refill", f"WITH {G}, r AS (SELECT id, row_number() OVER (PARTITION BY synthesizer_name ORDER BY len({REASONS}) > 0, md5('9:' || id), id) AS i, len({REASONS}) AS fails FROM g) SELECT id FROM r WHERE fails = 0 AND i <= 25")
def k14(spark: SparkSession, d: str) -> DataFrame:
    """Up to 25 passing records of each type: what a refill loop ends with, as one ranking with passing ones first."""
    fails = F.size(D.gate_reasons(F.col("scores")))
    w = D.Window.partitionBy("synthesizer_name").orderBy(F.col("fails") > 0, D.draw(F.col("id"), 9), "id")
    return gold(spark, d).withColumn("fails", fails).withColumn("i", F.row_number().over(w)).where("fails = 0 AND i <= 25").select("id")


@query("k15_samples", f"WITH {G} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY persona ORDER BY id) AS i FROM g) WHERE i <= 3")
def k15(spark: SparkSession, d: str) -> DataFrame:
    w = D.Window.partitionBy("persona").orderBy("id")
    return gold(spark, d).select("id", F.row_number().over(w).alias("i")).where("i <= 3").select("id")


@query("k16_suitability", f"WITH {G} SELECT id, CASE WHEN synthesizer_name LIKE 'multi%' THEN CASE WHEN len(coalesce(reference_contexts, [])) >= 2 THEN 1.0 ELSE 0.2 END ELSE CASE WHEN len(coalesce(reference_contexts, [])) = 1 THEN 0.9 ELSE 0.5 END END::DOUBLE AS score FROM g")
def k16(spark: SparkSession, d: str) -> DataFrame:
    """A lookup of kind and number of contexts."""
    n = F.coalesce(F.array_size("reference_contexts"), F.lit(0))
    m = F.create_map(F.lit("multi:yes"), F.lit(1.0), F.lit("multi:no"), F.lit(0.2), F.lit("single:yes"), F.lit(0.9), F.lit("single:no"), F.lit(0.5))
    kind = F.when(F.coalesce(F.col("synthesizer_name").startswith("multi"), F.lit(False)), "multi").otherwise("single")
    fits = F.when(F.when(kind == "multi", n >= 2).otherwise(n == 1), "yes").otherwise("no")
    return gold(spark, d).select("id", m[F.concat(kind, F.lit(":"), fits)].alias("score"))


@query("a07_distribution", f"WITH {G} SELECT synthesizer_name, count(*) AS n, round(avg(length(user_input)), 6) AS mean_length, count(*) FILTER (len(coalesce(reference_contexts, [])) > 0) AS with_evidence, round(100.0 * count(*) FILTER (len(coalesce(reference_contexts, [])) > 1) / count(*), 6) AS multi_share FROM g GROUP BY ALL")
def a07(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.array_size("reference_contexts"), F.lit(0))
    return gold(spark, d).groupBy("synthesizer_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("user_input")), 6).alias("mean_length"), F.count_if(n > 0).alias("with_evidence"), F.round(100.0 * F.count_if(n > 1) / F.count(F.lit(1)), 6).alias("multi_share"))


@query("a08_quality_report", f"WITH {G}, k AS (SELECT *, {KEY} AS k FROM g) SELECT count(*) AS n, count(*) - count(DISTINCT k) AS duplicates, round(100.0 * count(*) FILTER (length(coalesce(reference, '')) > 0) / count(*), 6) AS answered, round(100.0 * count(*) FILTER (scores IS NOT NULL) / count(*), 6) AS scored FROM k")
def a08(spark: SparkSession, d: str) -> DataFrame:
    t = gold(spark, d).withColumn("k", X.question_key(F.col("user_input")))
    n = F.count(F.lit(1))
    return t.agg(n.alias("n"), (n - F.countDistinct("k")).alias("duplicates"), F.round(100.0 * F.count_if(F.length(F.coalesce("reference", F.lit(""))) > 0) / n, 6).alias("answered"), F.round(100.0 * F.count_if(F.col("scores").isNotNull()) / n, 6).alias("scored"))


@query("a09_rejection_reasons", f"WITH {G}, r AS (SELECT unnest({REASONS}) AS reason FROM g) SELECT reason, count(*) AS n FROM r GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def a09(spark: SparkSession, d: str) -> DataFrame:
    r = gold(spark, d).select(F.explode(D.gate_reasons(F.col("scores"))).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query("a10_source_distribution", f"WITH {G}, s AS (SELECT unnest(CASE WHEN len(coalesce(source_documents, [])) = 0 THEN ['_unknown_'] ELSE source_documents END) AS source FROM g) SELECT source, count(*) AS n FROM s GROUP BY source")
def a10(spark: SparkSession, d: str) -> DataFrame:
    docs = F.when(F.coalesce(F.array_size("source_documents"), F.lit(0)) == 0, F.array(F.lit("_unknown_"))).otherwise(F.col("source_documents"))
    return gold(spark, d).select(F.explode(docs).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a24_context_counts", f"WITH {G} SELECT CAST(coalesce(len(reference_contexts), 0) AS INTEGER) AS contexts, count(*) AS n FROM g GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).groupBy(F.coalesce(F.array_size("reference_contexts"), F.lit(0)).alias("contexts")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_content_hash", """
    WITH b AS (SELECT left(md5(id), 3) AS b, sha256(string_agg(id, ',' ORDER BY id)) AS h, count(*) AS n FROM (SELECT DISTINCT id FROM gold_records) GROUP BY 1)
    SELECT left(sha256(string_agg(b || h, ',' ORDER BY b || h)), 16) AS hash, CAST(sum(n) AS BIGINT) AS n FROM b""")  # fmt: skip
def a25(spark: SparkSession, d: str) -> DataFrame:
    return D.content_hash(gold(spark, d), "id")


@query("m13_type_targets", f"WITH {G}, {P}, {DEDUP}, {QUOTA} SELECT synthesizer_name, CAST(quota AS INTEGER) AS quota FROM f")
def m13(spark: SparkSession, d: str) -> DataFrame:
    counts = unique(spark, d).groupBy("synthesizer_name").agg(F.count(F.lit(1)).alias("n"))
    return D.quotas(counts, 100, "synthesizer_name").select("synthesizer_name", "quota")


@query("m10_difficulty", """
    WITH g AS (SELECT DISTINCT ON (id) id, user_input, reference_contexts, synthesizer_name FROM gold_records)
    SELECT id, least(100, 20 * least(2, len(coalesce(reference_contexts, []))) + CASE WHEN synthesizer_name LIKE '%abstract' THEN 20 ELSE 0 END + CASE WHEN length(user_input) > 120 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(user_input), '\\b(?:why|how)\\b') THEN 20 ELSE 0 END)::INTEGER AS score FROM g""")  # fmt: skip
def m10(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.array_size("reference_contexts"), F.lit(0))
    one = lambda b: F.when(b, 20).otherwise(0)
    return gold(spark, d).select("id", F.least(F.lit(100), 20 * F.least(F.lit(2), n) + one(F.col("synthesizer_name").endswith("abstract")) + one(F.length("user_input") > 120) + one(F.lower("user_input").rlike(r"\b(?:why|how)\b"))).alias("score"))


@query("jn08_anti_by_id", "SELECT DISTINCT id FROM gold_records WHERE id NOT IN (SELECT id FROM gold_records WHERE lower(trim(split)) = 'train' AND id IS NOT NULL)")
def jn08(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).select("id", "split")
    return g.select("id").join(g.where(F.lower(F.trim("split")) == "train").select("id"), "id", "left_anti")


@query("jn09_failed_questions", f"""
    WITH {G}, h AS (SELECT DISTINCT {QUESTION_KEY_SQL.replace('@', 'query')} AS k FROM hybrid_rows WHERE ground_truth IS NULL OR trim(ground_truth) IN ('', '-', 'N/A')),
    f AS (SELECT id FROM g WHERE {KEY} IN (SELECT k FROM h))
    SELECT id, true AS biased FROM g WHERE id NOT IN (SELECT id FROM f)""")
def jn09(spark: SparkSession, d: str) -> DataFrame:
    """Records without those whose question failed; measuring afterwards is biased, which the flag says."""
    failed = table(spark, d, "hybrid_rows", "query", "ground_truth").where(F.col("ground_truth").isNull() | F.trim("ground_truth").isin("", "-", "N/A")).select(X.question_key(F.col("query")).alias("k")).distinct()
    return gold(spark, d).select("id", X.question_key(F.col("user_input")).alias("k")).join(failed, "k", "left_anti").select("id", F.lit(True).alias("biased"))


@query("o02_except", "SELECT id FROM (SELECT DISTINCT id FROM child_chunks) EXCEPT SELECT id FROM child_chunks WHERE parent_id IS NULL")
def o02(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks", "id", "parent_id")
    return c.select("id").distinct().join(c.where("parent_id IS NULL").select("id"), "id", "left_anti")
