"""Retrieval, fusion and similarity queries over the embeddings, documents and retrieval rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import vectors as V
from ..runtime import table
from .registry import query
from .text import TOKENS_SQL

E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q, label AS ql FROM e WHERE vec_id % 100 = 0)"
PAIR = "s AS (SELECT query_id, vec_id AS item_id, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS score, ql = label AS rel FROM e, q WHERE query_id <> vec_id)"
DENSE = "d AS (SELECT * FROM (SELECT query_id, item_id, score, rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 20)"
L1 = "l AS (SELECT * FROM (SELECT query_id, vec_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(-list_sum(list_transform(list_zip(q, v), lambda z: abs(z[1] - z[2]))), 6) DESC, vec_id) AS rank FROM e, q WHERE query_id <> vec_id) WHERE rank <= 20)"
FUSED = "f AS (SELECT query_id, item_id, round(sum(p), 9) AS score FROM (SELECT query_id, item_id, 0.8::DOUBLE / (60 + rank) AS p FROM d UNION ALL SELECT query_id, item_id, 0.2::DOUBLE / (60 + rank) FROM l) GROUP BY ALL)"
TOP = "t AS (SELECT f.*, x.label = y.label AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) f JOIN embeddings x ON x.vec_id = f.query_id JOIN embeddings y ON y.vec_id = f.item_id WHERE rank <= 10)"
BASE = f"WITH {E}, {PAIR}, {DENSE}, {L1}, {FUSED}, {TOP}"
K = 20


def vecs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


def top10(spark: SparkSession, d: str) -> DataFrame:
    q, v = vecs(spark, d)
    fused = V.ranked(V.fuse(V.dense_top(q, v, K), V.l1_top(q, v, K)), k=10)
    lab = table(spark, d, "embeddings", "vec_id", "label")
    a, b = lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), lab.select(F.col("vec_id").alias("item_id"), F.col("label").alias("b"))
    return fused.join(a, "query_id").join(b, "item_id").select("query_id", "item_id", "score", "rank", (F.col("a") == F.col("b")).alias("rel"))


def relevant(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings", "vec_id", "label")
    n = lab.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return lab.where("vec_id % 100 = 0").join(n, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")


@query("k01_dense_top", f"WITH {E}, {PAIR}, {DENSE} SELECT query_id, item_id, score, rank FROM d")
def k01(spark: SparkSession, d: str) -> DataFrame:
    q, v = vecs(spark, d)
    return V.dense_top(q, v, K)


@query("jn05_full_outer_fusion", f"WITH {E}, {PAIR}, {DENSE}, {L1} SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.item_id, l.item_id) AS item_id, d.rank AS dense_rank, l.rank AS other_rank FROM d FULL JOIN l ON d.query_id = l.query_id AND d.item_id = l.item_id")
def jn05(spark: SparkSession, d: str) -> DataFrame:
    q, v = vecs(spark, d)
    a, b = V.dense_top(q, v, K).select("query_id", "item_id", F.col("rank").alias("dense_rank")), V.l1_top(q, v, K).select("query_id", "item_id", F.col("rank").alias("other_rank"))
    return a.join(b, ["query_id", "item_id"], "full")


@query("w01_rrf", BASE + " SELECT query_id, item_id, score, rank FROM t")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return top10(spark, d).drop("rel")


METRICS = """, r AS (SELECT vec_id AS query_id, (SELECT count(*) - 1 FROM embeddings y WHERE y.label = x.label) AS n FROM embeddings x WHERE vec_id % 100 = 0),
    m AS (SELECT r.query_id, k, n, count(*) FILTER (t.rel) AS got, coalesce(sum(CASE WHEN t.rel THEN 1 / log2(t.rank + 1) END), 0) AS dcg FROM r CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN t ON t.query_id = r.query_id AND t.rank <= k GROUP BY ALL),
    w AS (SELECT query_id, k, got / k AS precision, got / n AS recall, (got >= n)::DOUBLE AS all_found, dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda j: 1 / log2(j + 1))) AS ndcg FROM m)"""


@query("m07_metrics_at_k", BASE + METRICS + " SELECT query_id, k, metric, round(value, 6) AS value FROM (UNPIVOT w ON precision, recall, all_found, ndcg INTO NAME metric VALUE value)")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return V.retrieval_metrics(top10(spark, d), relevant(spark, d)).withColumn("value", F.round("value", 6))


@query("w01_rrf_metrics", BASE + METRICS + " SELECT k, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (UNPIVOT w ON precision, recall, all_found, ndcg INTO NAME metric VALUE value) GROUP BY k, metric")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return V.retrieval_metrics(top10(spark, d), relevant(spark, d)).groupBy("k", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("m07_ndcg_compat", BASE + """ SELECT query_id, round(sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) / (1 + 1 / log2(3)), 6) AS ndcg_compat FROM t GROUP BY query_id""")
def m07c(spark: SparkSession, d: str) -> DataFrame:
    """Gains of all relevant hits against two ideal ones: the variant that can exceed 1, kept to compare with old figures."""
    gain = F.when(F.col("rel"), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0)
    ideal = 1 + F.log(F.lit(2.0)) / F.log(F.lit(3.0))
    return top10(spark, d).groupBy("query_id").agg(F.round(F.sum(gain) / ideal, 6).alias("ndcg_compat"))


@query("m08_document_level", BASE + " SELECT query_id, round(count(*) FILTER (rel AND rank <= 5) / 5, 6) AS p5, coalesce(1 / min(CASE WHEN rel THEN rank END), 0)::DOUBLE AS mrr, bool_or(rel) AS found FROM t GROUP BY query_id")
def m08(spark: SparkSession, d: str) -> DataFrame:
    g = top10(spark, d).groupBy("query_id").agg(F.round(F.count_if(F.col("rel") & (F.col("rank") <= 5)) / 5, 6).alias("p5"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("r"), F.bool_or("rel").alias("found"))
    return g.select("query_id", "p5", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("mrr"), "found")


@query("w21_first_ranks", BASE + " SELECT query_id, min(CASE WHEN rel THEN rank END)::INTEGER AS first_rank, max(CASE WHEN rel THEN rank END)::INTEGER AS last_rank, round(coalesce(1 / min(CASE WHEN rel THEN rank END), 0), 6) AS mrr, round(coalesce(1 / max(CASE WHEN rel THEN rank END), 0), 6) AS mrr_last FROM t GROUP BY query_id")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return V.first_ranks(top10(spark, d)).select("query_id", "first_rank", "last_rank", F.round("mrr", 6).alias("mrr"), F.round("mrr_last", 6).alias("mrr_last"))


@query("w02_second_fusion", BASE + ", h AS (SELECT query_id // 300 AS topic, item_id, rank, score FROM t) SELECT topic, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(score) AS best FROM h GROUP BY ALL")
def w02(spark: SparkSession, d: str) -> DataFrame:
    """Queries of one topic as hops: a second fusion of their rankings, with the best first score kept."""
    return top10(spark, d).groupBy(F.floor(F.col("query_id") / 300).alias("topic"), "item_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), F.max("score").alias("best"))


@query("w04_hop_dedup", BASE + ", h AS (SELECT query_id // 300 AS topic, query_id AS hop, item_id, score FROM t) SELECT topic, item_id, max(score) AS score, min(hop) AS first_hop FROM h GROUP BY ALL")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return top10(spark, d).groupBy(F.floor(F.col("query_id") / 300).alias("topic"), "item_id").agg(F.max("score").alias("score"), F.min("query_id").alias("first_hop"))


@query("o01_union_pools", BASE + ", h AS (SELECT query_id // 300 AS topic, item_id, score FROM t) SELECT topic, item_id, max(score) AS score FROM h GROUP BY ALL")
def o01(spark: SparkSession, d: str) -> DataFrame:
    return w04(spark, d).drop("first_hop")


@query("w20_coverage", BASE + """, h AS (SELECT query_id // 300 AS topic, query_id AS hop, item_id, score FROM t),
    b AS (SELECT topic, item_id, max(score) AS score, min(hop) AS hop FROM h GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY topic, hop ORDER BY score DESC, item_id) AS in_hop FROM b)
    SELECT topic, hop, item_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY in_hop > 1, score DESC, item_id) AS n FROM o) WHERE n <= 6""")
def w20(spark: SparkSession, d: str) -> DataFrame:
    """Six items per topic of which every hop has its best one, before the others fill up: seats are reserved, not swapped."""
    b = w04(spark, d).withColumnRenamed("first_hop", "hop")
    b = b.withColumn("in_hop", F.row_number().over(Window.partitionBy("topic", "hop").orderBy(F.desc("score"), "item_id")))
    n = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("in_hop") > 1, F.desc("score"), "item_id"))
    return b.withColumn("n", n).where("n <= 6").select("topic", "hop", "item_id")


@query("m01_cosine", f"WITH {E}, {PAIR} SELECT query_id, item_id, score FROM s")
def m01(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of the stated queries and all vectors."""
    return V.scored(*vecs(spark, d))


@query("m02_unit_vectors", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 5) AS total FROM n")
def m02(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings", "vec_id", "embedding")
    return t.select("vec_id", F.round(F.reduce(V.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("m02_blend")
def m02b(spark: SparkSession, d: str) -> DataFrame:
    """The blend of every query vector with its nearest neighbour."""
    q, v = vecs(spark, d)
    near = V.dense_top(q, v, 1).join(v, "item_id").join(q, "query_id")
    return near.select("query_id", V.blend(F.col("q"), F.col("v")).alias("vector"))


@query("f20_clean_vectors", """
    WITH c AS (SELECT DISTINCT ON (id) id, list_transform(CAST(dense_vec AS DOUBLE[]), lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END) AS v FROM child_chunks WHERE dense_vec IS NOT NULL AND len(dense_vec) > 0)
    SELECT id, coalesce(sqrt(list_dot_product(v, v)) >= 0.05, false) AS kept FROM c""")  # fmt: skip
def f20(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "child_chunks", "id", "dense_vec").where(F.size("dense_vec") > 0).dropDuplicates(["id"])
    return t.select("id", V.clean_vector(F.col("dense_vec")).isNotNull().alias("kept"))


TOK = f"k AS (SELECT doc_id, {TOKENS_SQL.replace('@', 'text')} AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, len(t) AS total, unnest(t) AS token FROM k), r AS (SELECT doc_id, token, total, count(*) AS n FROM x GROUP BY ALL), i AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM r GROUP BY token)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")


def idf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = docs(spark, d)
    rows = V.token_rows(t)
    n = t.agg(F.count(F.lit(1)).alias("n_docs"))
    freq = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).drop("n_docs")
    return rows, freq


@query("a15_idf", f"WITH {TOK} SELECT token, df, round(idf, 6) AS idf FROM i")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return idf(spark, d)[1].withColumn("idf", F.round("idf", 6))


@query("a16_sparse_vectors", f"WITH {TOK} SELECT doc_id, token, round(n / total * idf, 6) AS weight FROM r JOIN i USING (token)")
def a16(spark: SparkSession, d: str) -> DataFrame:
    rows, freq = idf(spark, d)
    return rows.join(freq, "token").select("doc_id", "token", F.round(F.col("n") / F.col("total") * F.col("idf"), 6).alias("weight"))


@query("a17_idf_stats", f"WITH {TOK} SELECT count(*) AS vocabulary, round(avg(idf), 6) AS mean, round(min(idf), 6) AS min, round(max(idf), 6) AS max, count(*) FILTER (df = 1) AS singletons FROM i")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return idf(spark, d)[1].agg(F.count(F.lit(1)).alias("vocabulary"), F.round(F.avg("idf"), 6).alias("mean"), F.round(F.min("idf"), 6).alias("min"), F.round(F.max("idf"), 6).alias("max"), F.count_if(F.col("df") == 1).alias("singletons"))


SPARSE = f"""WITH {TOK}, g AS (SELECT DISTINCT ON (row_id) row_id, query FROM hybrid_rows WHERE row_id % 100 = 0),
    qt AS (SELECT row_id, token, count(*) AS qn, any_value(total) AS qtotal FROM (SELECT row_id, len(t) AS total, unnest(t) AS token FROM (SELECT row_id, {TOKENS_SQL.replace('@', 'query')} AS t FROM g)) GROUP BY row_id, token),
    s AS (SELECT row_id, doc_id, round(sum((qn / qtotal * idf) * (n / total * idf)), 6) AS score FROM qt JOIN i USING (token) JOIN r USING (token) GROUP BY row_id, doc_id)"""


@query("k02_sparse_top", SPARSE + " SELECT row_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """Dot products of sparse vectors by a join on the token, for the queries whose row id is divisible by 100. A token's
    rows are joined after its weight is known, and partial sums are combined before the shuffle by query and document."""
    rows, freq = idf(spark, d)
    q = table(spark, d, "hybrid_rows", "row_id", "query").where("row_id % 100 = 0").dropDuplicates(["row_id"])
    qt = V.token_rows(q, "row_id", "query").select("row_id", "token", (F.col("n") / F.col("total")).alias("qf"))
    # rows of other tokens end here, before any shuffle if the queries' tokens are few enough to be broadcast
    mine = rows.join(qt.select("token").distinct(), "token", "left_semi")
    w = mine.join(freq.join(qt, "token"), "token").select("row_id", "doc_id", (F.col("qf") * F.col("idf") * (F.col("n") / F.col("total") * F.col("idf"))).alias("part"))
    s = w.groupBy("row_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return V.ranked(s, query="row_id", item="doc_id", k=10)


@query("k03_prefetch_rerank", f"WITH {E}, {PAIR}, {DENSE}, {L1}, u AS (SELECT query_id, item_id FROM d UNION SELECT query_id, item_id FROM l) SELECT query_id, item_id, score, rank FROM (SELECT u.*, s.score, row_number() OVER (PARTITION BY u.query_id ORDER BY s.score DESC, u.item_id) AS rank FROM u JOIN s USING (query_id, item_id)) WHERE rank <= 10")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two rankings, each once, ranked again by one score."""
    q, v = vecs(spark, d)
    pool = V.dense_top(q, v, K).select("query_id", "item_id").unionByName(V.l1_top(q, v, K).select("query_id", "item_id")).distinct()
    s = pool.join(q, "query_id").join(v, "item_id").select("query_id", "item_id", F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return V.ranked(s, k=10)


@query("k04_late_interaction", """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, list_transform(range(8), lambda i: v[i * 8 + 1:i * 8 + 8]) AS m FROM e),
    q AS (SELECT vec_id AS query_id, m AS qm FROM p WHERE vec_id % 100 = 0)
    SELECT query_id, vec_id AS item_id, round(list_sum(list_transform(qm, lambda a: list_max(list_transform(m, lambda b: list_dot_product(a, b))))), 5) AS score FROM p, q WHERE query_id <> vec_id""")  # fmt: skip
def k04(spark: SparkSession, d: str) -> DataFrame:
    """Max-sim between vectors taken as eight short ones each."""
    return V.scored(*vecs(spark, d), V.late_interaction(8), digits=5)


@query("jn11_cosine_join", f"WITH {E}, {PAIR} SELECT query_id, item_id FROM s WHERE score >= 0.3")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of queries against all vectors by a cosine threshold."""
    return V.scored(*vecs(spark, d), least=0.3).drop("score")


@query("jn23_whole_context", """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), m AS (SELECT label, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda x: x[i]))) AS c FROM (SELECT label, list(v) AS vs FROM e GROUP BY label))
    SELECT vec_id, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 5) AS score FROM e JOIN m USING (label)""")  # fmt: skip
def jn23(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the mean of its label. Means are taken by position, so that no group is gathered."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("c")), 5).alias("score"))


@query("m03_jaccard", f"""WITH g AS (SELECT DISTINCT ON (id) id, {TOKENS_SQL.replace('@', 'user_input')} AS a, {TOKENS_SQL.replace('@', 'reference')} AS b FROM gold_records WHERE reference IS NOT NULL)
    SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM g""")
def m03(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_records", "id", "user_input", "reference").dropDuplicates(["id"]).where("reference IS NOT NULL")
    return g.select("id", F.round(V.jaccard(X.identifier_tokens(F.col("user_input")), X.identifier_tokens(F.col("reference"))), 6).alias("jaccard"))


LAT = "(SELECT row_id, (epoch_us(received_at) - epoch_us(run_at)) / 1000.0::DOUBLE AS ms FROM (SELECT DISTINCT ON (row_id) row_id, run_at, received_at FROM hybrid_rows ORDER BY row_id, received_at))"


@query("a02_latency", f"SELECT round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS std, round(min(ms)::DOUBLE, 6) AS min, round(max(ms)::DOUBLE, 6) AS max, round(median(ms), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM {LAT}")
def a02(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "hybrid_rows", "row_id", "run_at", "received_at")
    t = t.groupBy("row_id").agg(F.min(F.struct("received_at", "run_at")).alias("x")).select(((F.unix_micros("x.received_at") - F.unix_micros("x.run_at")) / 1000.0).alias("ms"))
    return V.spread(t, "ms")


@query("a01_metric_spread", BASE + METRICS + " SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM (UNPIVOT w ON precision, recall, all_found, ndcg INTO NAME metric VALUE value) GROUP BY metric")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return V.spread(V.retrieval_metrics(top10(spark, d), relevant(spark, d)), "value", "metric")


@query("a03_failure_taxonomy", BASE + """, r AS (SELECT query_id, bool_or(rel) AS found, bool_or(rel AND rank <= 3) AS early FROM t GROUP BY query_id)
    SELECT CASE WHEN early THEN 'found' WHEN found THEN 'below_cutoff' ELSE 'wrong_doc' END AS kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS rate FROM r GROUP BY 1""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    r = top10(spark, d).groupBy("query_id").agg(F.bool_or("rel").alias("found"), F.bool_or(F.col("rel") & (F.col("rank") <= 3)).alias("early"))
    g = r.groupBy(F.when(F.col("early"), "found").when(F.col("found"), "below_cutoff").otherwise("wrong_doc").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("kind", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("rate"))


@query("a28_union_first_seen", BASE + ", h AS (SELECT query_id // 300 AS topic, item_id, min(struct_pack(a := query_id, b := rank)) AS f FROM t GROUP BY ALL) SELECT topic, string_agg(item_id::VARCHAR, ',' ORDER BY f.a, f.b) AS items FROM h GROUP BY topic")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """The items of all sub-queries of a topic, each once, in order of first sight."""
    h = top10(spark, d).groupBy(F.floor(F.col("query_id") / 300).alias("topic"), "item_id").agg(F.min(F.struct("query_id", "rank")).alias("f"))
    return h.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "item_id"))), lambda s: s["item_id"].cast("string")), ",").alias("items"))
