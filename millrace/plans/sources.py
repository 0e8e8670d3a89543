"""Queries that write files into the shared folder and read them again, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scorers import TokenOverlap
from ..operators import leaves as L
from ..operators import trees as T
from ..runtime import shared_dir, table
from ..sources import files as S
from ..streaming import tasks
from .nested import p5_nodes
from .registry import query
from .text import WORDS_SQL

DOC = "doc_id bigint, text string, source string"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "source")


@query("s01_jsonl_scan", "SELECT doc_id, text, source FROM documents")
def s01(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "jsonl")
    S.append_jsonl(docs(spark, d), path)
    return S.read_jsonl(spark, path, DOC)


@query("s02_missing_file", "SELECT doc_id, text, source FROM documents WHERE false")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return S.read_jsonl(spark, _path(spark, "missing"), DOC, missing_ok=True)


@query("s03_append", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents")
def s03(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "append")
    for _ in range(2):
        S.append_jsonl(docs(spark, d), path)
    return S.read_jsonl(spark, path, DOC).select("doc_id")


@query("s04_count", "SELECT count(*) AS n FROM documents")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return s01(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("s05_atomic_write", "SELECT doc_id FROM documents WHERE lang = 'de'")
def s05(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "atomic")
    t = table(spark, d, "documents", "doc_id", "lang")
    S.write_atomic(t, path)
    S.write_atomic(t.where("lang = 'de'"), path)
    return spark.read.schema("doc_id bigint").json(path)


@query("s06_result_files", "SELECT DISTINCT row_id, question FROM tree_rows WHERE status <> 'error'")
def s06(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "results")
    t = table(spark, d, "tree_rows", "row_id", "question", "status").dropDuplicates(["row_id"]).where("status IS NOT NULL")
    t.groupBy(F.pmod("row_id", F.lit(8)).alias("file")).agg(F.collect_list(F.struct("row_id", "question", "status")).alias("results")).repartition(8, "file").drop("file").write.json(path)
    return spark.read.schema("results array<struct<row_id:bigint,question:string,status:string>>").json(path).select(F.explode("results").alias("r")).select("r.*").where("status <> 'error'").drop("status")


@query("s07_contexts", "WITH h AS (SELECT DISTINCT ON (row_id) row_id, context_chunks FROM hybrid_rows) SELECT row_id, c.source_id AS source_id, round(c.score, 6) AS score FROM (SELECT row_id, unnest(context_chunks) AS c FROM h)")
def s07(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "hybrid_rows", "row_id", "context_chunks").dropDuplicates(["row_id"])
    return t.select("row_id", F.explode(S.ranked_contexts(F.col("context_chunks"))).alias("c")).select("row_id", "c.source_id", F.round("c.score", 6).alias("score"))


@query("s13_flat_elements", """
    WITH f AS (SELECT DISTINCT ON (id) id, filename, page_number, text FROM parent_chunks WHERE text IS NOT NULL AND page_number IS NOT NULL)
    SELECT id, page_number AS page, i::INTEGER - 1 AS pos FROM (SELECT id, page_number, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM f)""")  # fmt: skip
def s13(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parent_chunks", "id", "page_number", "text").dropDuplicates(["id"]).where("text IS NOT NULL AND page_number IS NOT NULL")
    return t.select("id", F.col("page_number").alias("page"), F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "block")).drop("block")


@query("s14_merge_pages", "WITH p AS (SELECT DISTINCT ON (id) id, filename, page_number FROM parent_chunks WHERE filename IS NOT NULL AND page_number IS NOT NULL) SELECT filename, md5(string_agg(id, ',' ORDER BY page_number, id)) AS merged FROM p GROUP BY filename")
def s14(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parent_chunks", "id", "filename", "page_number").dropDuplicates(["id"]).where("filename IS NOT NULL AND page_number IS NOT NULL")
    return t.groupBy("filename").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id"))), lambda s: s["id"]), ",")).alias("merged"))


@query("s15_vector_index", "SELECT vec_id, 'model-a' AS fingerprint FROM embeddings")
def s15(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "index")
    S.write_index(table(spark, d, "embeddings", "vec_id", "embedding"), path, "model-a")
    return spark.read.parquet(path).select("vec_id", "fingerprint")


@query("s16_batched_upsert", "SELECT vec_id FROM embeddings")
def s16(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "upsert")
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    S.write_index(e.where("vec_id % 2 = 0"), path, "m")
    S.write_index(S.not_indexed(e, spark.read.parquet(path), "vec_id"), path, "m")
    return spark.read.parquet(path).select("vec_id")


@query("s17_skip_indexed", "SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Texts that no even document has, by hash."""
    t = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return S.not_indexed(t, t.where("doc_id % 2 = 0"), "file_hash").select("file_hash").distinct()


@query("s18_resume", "SELECT DISTINCT row_id, retriever FROM hybrid_rows WHERE row_id % 3 <> 0 AND retriever IS NOT NULL")
def s18(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "hybrid_rows", "row_id", "retriever").where("retriever IS NOT NULL").distinct()
    return S.not_indexed(t, t.where("row_id % 3 = 0"), "row_id", "retriever")


@query("s19_resume_scored", "SELECT DISTINCT id FROM gold_records WHERE id NOT IN (SELECT id FROM gold_records WHERE scores IS NOT NULL)")
def s19(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "gold_records", "id", "scores")
    return S.not_indexed(t.select("id").distinct(), t.where("scores IS NOT NULL"), "id")


@query("s20_checkpoint", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """A step's result cut off from its lineage in the shared folder."""
    from ..runtime import stage

    return stage(table(spark, d, "documents", "doc_id", "lang").where("lang = 'fr'").select("doc_id"), "step")


@query("s21_csv_sheet", "SELECT DISTINCT id, synthesizer_name FROM gold_records")
def s21(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "csv")
    S.write_sheet(table(spark, d, "gold_records", "id", "synthesizer_name", "source_documents").dropDuplicates(["id"]), path)
    return spark.read.schema("id string, synthesizer_name string, source_documents string").option("header", True).csv(path).select("id", "synthesizer_name")


@query("s22_review_sheet", "SELECT DISTINCT ON (id) id, left(regexp_replace(user_input, '[\\t\\r\\n]', ' ', 'g'), 80) AS user_input FROM gold_records")
def s22(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "tsv")
    S.write_sheet(table(spark, d, "gold_records", "id", "user_input").dropDuplicates(["id"]), path, "\t", 80)
    return spark.read.schema("id string, user_input string").option("header", True).option("sep", "\t").option("ignoreTrailingWhiteSpace", False).csv(path)


def _passage_files(spark: SparkSession, d: str) -> str:
    """The test passages as a text file each, in a folder each."""
    path = _path(spark, "texts")
    table(spark, d, "eval_passages", "item_id", "passage").where("passage IS NOT NULL").select("passage", F.col("item_id").alias("item")).write.partitionBy("item").option("lineSep", "\n").text(path)
    return path


def _item() -> Column:
    """The item that a file's folder names."""
    return F.regexp_extract("path", "item=([^/]+)/", 1).cast("long").alias("item_id")


@query("s10_text_files", "SELECT item_id, md5(passage) AS content, 'txt' AS kind FROM eval_passages WHERE passage IS NOT NULL")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts written as files and read again by what their suffix says."""
    return S.read_documents(spark, _passage_files(spark, d)).select(_item(), F.md5(F.regexp_replace("text", r"\n$", "")).alias("content"), "kind")


@query("s11_page_tokens", "SELECT DISTINCT ON (id) id, filename, page_number AS page, greatest(1, length(text) // 4)::INTEGER AS tokens FROM parent_chunks WHERE text IS NOT NULL AND filename IS NOT NULL AND page_number IS NOT NULL")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Pages of files with their tokens."""
    t = table(spark, d, "parent_chunks", "id", "filename", "page_number", "text").where("text IS NOT NULL AND filename IS NOT NULL AND page_number IS NOT NULL").dropDuplicates(["id"])
    return S.page_tokens(t, "page_number", "text").select("id", "filename", F.col("page_number").alias("page"), "tokens")


@query("s12_discovery", "SELECT item_id FROM eval_passages WHERE passage IS NOT NULL")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """All text files below a folder, however deep."""
    return S.find_files(spark, _passage_files(spark, d), (".txt",)).select(_item())


@query("s23_combine_metrics", """
    SELECT coalesce(synthesizer_name, '__HIVE_DEFAULT_PARTITION__') AS source, false AS skipped, count(*) AS n, round(avg(scores.faithfulness), 6) AS faithfulness FROM (SELECT DISTINCT ON (id) * FROM gold_records) GROUP BY synthesizer_name
    UNION ALL SELECT 'without', true, NULL, NULL""")  # fmt: skip
def s23(spark: SparkSession, d: str) -> DataFrame:
    """A summary file for each way of making questions, and one file without a summary."""
    path = _path(spark, "summaries")
    g = table(spark, d, "gold_records", "id", "synthesizer_name", "scores").dropDuplicates(["id"])
    g = g.groupBy(F.col("synthesizer_name").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.avg("scores.faithfulness").alias("faithfulness"))
    g.select("source", F.struct("n", "faithfulness").alias("summary")).write.partitionBy("source").json(path)
    spark.range(1).select(F.lit("without").alias("source"), F.lit("no summary").alias("remark")).write.mode("append").partitionBy("source").json(path)
    t = S.combine_summaries(spark, [path], "struct<n: bigint, faithfulness: double>")
    return t.select(F.url_decode(F.regexp_extract("file", "source=([^/]+)/", 1)).alias("source"), "skipped", "n", F.round("faithfulness", 6).alias("faithfulness"))


KEY_SQL = "trim(regexp_replace(lower(regexp_replace(trim(@), '&', 'and', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"
SHEET = """
    s AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 50 = 1 THEN 'Section ' || o_orderpriority END AS section, CASE WHEN o_orderkey % 10 = 1 THEN 'Group & ' || o_orderstatus END AS grp,
          CASE WHEN o_orderkey % 4 <> 2 THEN 'Key-' || o_custkey END AS k, CASE WHEN o_orderkey % 8 < 6 THEN o_orderdate::VARCHAR ELSE 'NaN' END AS v FROM orders)"""  # fmt: skip


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a sheet whose sections and groups stand in the first of their rows only."""
    n = F.col("o_orderkey")
    return table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate").select(
        n.alias("row_no"), F.when(n % 50 == 1, F.concat(F.lit("Section "), "o_orderpriority")).alias("section"), F.when(n % 10 == 1, F.concat(F.lit("Group & "), "o_orderstatus")).alias("grp"),
        F.when(n % 4 != 2, F.concat(F.lit("Key-"), F.col("o_custkey").cast("string"))).alias("k"), F.when(n % 8 < 6, F.col("o_orderdate").cast("string")).otherwise("NaN").alias("v"))


@query("s24_sheet_paths", f"""
    WITH {SHEET}, f AS (SELECT *, last_value(section IGNORE NULLS) OVER w AS fs, last_value(grp IGNORE NULLS) OVER w AS fg FROM s WINDOW w AS (ORDER BY row_no)),
    p AS (SELECT row_no, k IS NOT NULL AND v <> 'NaN' AS deep, grp IS NOT NULL AND k IS NOT NULL AS flat, {KEY_SQL.replace('@', 'fs')} AS a, {KEY_SQL.replace('@', 'fg')} AS b, {KEY_SQL.replace('@', 'k')} AS c, k, v FROM f)
    SELECT row_no, CASE WHEN deep THEN concat_ws('.', a, b, c) ELSE concat_ws('.', a, b) END AS path, CASE WHEN deep THEN v ELSE k END AS value FROM p WHERE deep OR flat""")  # fmt: skip
def s24(spark: SparkSession, d: str) -> DataFrame:
    return L.grouped_sheet(_sheet(spark, d), "row_no", ("section", "grp", "k", "v"))


@query("s25_level_columns", f"""
    WITH {SHEET}, p AS (SELECT row_no, concat_ws('.', {KEY_SQL.replace('@', 'section')}, {KEY_SQL.replace('@', 'grp')}, {KEY_SQL.replace('@', 'k')}) AS path, CASE WHEN v = 'NaN' THEN '' ELSE v END AS value FROM s)
    SELECT row_no, path, value FROM p WHERE path <> ''
    UNION ALL SELECT row_no, replace({KEY_SQL.replace('@', 'k')}, '_', '.'), CASE WHEN v = 'NaN' THEN '' ELSE v END FROM s WHERE k IS NOT NULL""")  # fmt: skip
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of prediction sheets: levels in columns, and one path column."""
    s = _sheet(spark, d)
    a = L.flat_sheet(s.select("row_no", F.col("section").alias("L1"), F.col("grp").alias("L2"), F.col("k").alias("L3"), F.col("v").alias("Value")), "row_no")
    return a.unionByName(L.flat_sheet(s.select("row_no", F.col("k").alias("Path"), F.col("v").alias("Value")), "row_no"))


@query("s26_audit", "SELECT source, count(*) AS rows, count(*) FILTER (text IS NULL OR length(trim(text, ' ')) = 0) AS empty, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def s26(spark: SparkSession, d: str) -> DataFrame:
    return S.audit(docs(spark, d), "source", "text")


@query("s27_registry")
def s27(spark: SparkSession, d: str) -> DataFrame:
    return S.registry(p5_nodes(spark, d).where(T.depth(F.col("node_path")) == 1))


@query("u01_encoder", f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL.replace('@', 'text')} AS ws FROM documents), b AS (SELECT doc_id, CAST('0x' || left(md5(unnest(ws)), 8) AS BIGINT) % 64 AS dim FROM w),
    c AS (SELECT doc_id, dim, count(*) AS n FROM b GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
    SELECT doc_id, dim::INTEGER AS dim, round(n / norm, 6) AS value FROM c JOIN n USING (doc_id)""")  # fmt: skip
def u01(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in encoder's vectors, by their dimensions that are not zero."""
    v = TokenOverlap().encode(docs(spark, d).select("doc_id", "text"), "text").select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return v.where("value > 0").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("u06_judge", f"""
    WITH g AS (SELECT DISTINCT ON (id) id, {WORDS_SQL.replace('@', 'user_input')} AS q, {WORDS_SQL.replace('@', 'reference')} AS t FROM gold_records)
    SELECT id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS score, 'stand-in:token-overlap' AS scorer FROM g""")
def u06(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "gold_records", "id", "user_input", "reference").dropDuplicates(["id"])
    return TokenOverlap().score(t, "user_input", "reference").select("id", F.round("score", 6).alias("score"), "scorer")


@query("u11_document_selector")
def u11(spark: SparkSession, d: str) -> DataFrame:
    """The three documents whose description shares most words with each query whose row id is divisible by 100."""
    from pyspark.sql import Window

    q = table(spark, d, "hybrid_rows", "row_id", "query").where("row_id % 100 = 0").dropDuplicates(["row_id"])
    words = lambda c: F.explode(X.content_words(F.col(c))).alias("w")
    hits = q.select("row_id", words("query")).join(s27(spark, d).select("doc_id", words("description")), "w").groupBy("row_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream over their one file, run to the end."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    path, at = _path(spark, "stream"), _path(spark, "progress")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("st01_incremental_append", "SELECT DISTINCT event_id FROM events")
def st01(spark: SparkSession, d: str) -> DataFrame:
    path, at = _path(spark, "log"), _path(spark, "progress")

    def done(s: SparkSession) -> DataFrame | None:
        return s.read.schema("event_id bigint").json(path) if S._exists(s, path) else None

    for _ in range(2):  # the second run finds nothing new
        tasks.append_new(_events(spark, d).select("event_id", "event_type"), done, path, at, "event_id").awaitTermination()
    return spark.read.schema("event_id bigint").json(path)


@query("st07_once_per_key", "SELECT DISTINCT event_id FROM events")
def st07(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, tasks.once_per_key(_events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", ["event_id"], "3650 days")).select("event_id")


@query("st03_leases")
def st03(spark: SparkSession, d: str) -> DataFrame:
    """Events as claims: users are workers, every hundredth event one task."""
    e = _events(spark, d).select((F.col("event_id") % 100).cast("string").alias("task_id"), F.col("user_id").cast("string").alias("worker_id"), "ts", F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "renew").otherwise("release").alias("action"))
    return _finished(spark, tasks.leases(e, forget=False))


@query("st04_recover", "SELECT event_id, CASE WHEN event_id % 4 = 0 AND ts <= TIMESTAMP '2024-06-01' THEN CASE WHEN event_id % 3 + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END WHEN event_id % 4 = 0 THEN 'processing' ELSE 'done' END AS status FROM events")
def st04(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "event_id", "ts").select("event_id", F.when(F.col("event_id") % 4 == 0, "processing").otherwise("done").alias("status"), (F.col("event_id") % 3).alias("retry_count"), F.lit(3).alias("max_retries"), F.col("ts").alias("lock_expires_at"))
    return tasks.recover(t, F.lit("2024-06-01").cast("timestamp")).select("event_id", "status")


@query("ext_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension, no part of the survey: counts by day and type."""
    t = table(spark, d, "events", "ts", "event_type").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("w.start").alias("day"), "event_type", "n")
