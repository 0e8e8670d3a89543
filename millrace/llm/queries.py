"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

PARENT_LIMIT, CHILD_LIMIT, OVERLAP = 6400, 1600, 160
SCORES = ("dense_score", "sparse_score", "rerank_score", "rrf_score")


@lru_cache(None)
def vocabulary() -> str:
    """The vocabulary file: MILLRACE_TOKENIZER, or the one of the installed public tokenizers."""
    if at := os.environ.get("MILLRACE_TOKENIZER"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _chunk_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parent = table(spark, d, "parent_chunks", "id", "text").select(F.lit("parent").alias("chunk_kind"), F.col("id").alias("chunk_id"), "text")
    child = table(spark, d, "child_chunks", "id", "enriched_text").select(F.lit("child").alias("chunk_kind"), F.col("id").alias("chunk_id"), F.col("enriched_text").alias("text"))
    return parent, child


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .split import split_oversized

    parent, child = _chunk_texts(spark, d)
    return split_oversized(parent, PARENT_LIMIT, OVERLAP).unionByName(split_oversized(child, CHILD_LIMIT, OVERLAP)).dropDuplicates(["chunk_kind", "chunk_id", "piece_index"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .split import split_oversized

    parent, child = _chunk_texts(spark, d)
    pieces = split_oversized(parent, PARENT_LIMIT, OVERLAP).unionByName(split_oversized(child, CHILD_LIMIT, OVERLAP))
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_index") == 0)).select("chunk_kind", "chunk_id").distinct()


DIMS, ALIKE, FLOOR = 64, 0.9, 0.85


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every vector."""
    from .neighbours import exact_graph, nearest

    return nearest(exact_graph(table(spark, d, "child_chunks", "id", "dense_vec"), DIMS, 5), 5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import build_graph, nearest

    near = nearest(build_graph(table(spark, d, "child_chunks", "id", "dense_vec"), DIMS, FLOOR), 5).where(F.col("similarity") >= ALIKE)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The exact five nearest of a hundredth of the chunks (by hash of the id) among all."""
    from .neighbours import search

    rows = table(spark, d, "child_chunks", "id", "dense_vec")
    return search(rows, rows.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0), DIMS, 5)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    parent = table(spark, d, "parent_chunks", "id", "text", "filename").select(F.lit("parent").alias("chunk_kind"), F.col("id").alias("chunk_id"), "filename", "text")
    child = table(spark, d, "child_chunks", "id", "raw_text", "filename").select(F.lit("child").alias("chunk_kind"), F.col("id").alias("chunk_id"), "filename", F.col("raw_text").alias("text"))
    return parent.unionByName(child)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .scan import learn, noise

    texts = _scanned(spark, d)
    return noise(texts, learn(texts)).distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .scan import learn, repair_scans

    texts = _scanned(spark, d)
    return repair_scans(texts, learn(texts))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import find

    return find(table(spark, d, "gold_records", "id", "split", "user_input", "reference")).id_pairs()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import find

    return find(table(spark, d, "gold_records", "id", "split", "user_input", "reference")).pairs


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record that overlaps one of the other side, with its partners' number and how much of it one of them covers."""
    from .overlap import find

    found = find(table(spark, d, "gold_records", "id", "split", "user_input", "reference"))
    return found.coverage().where("n_partners > 0").withColumn("coverage", F.round("coverage", 6))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import find, report

    records = table(spark, d, "gold_records", "id", "split", "user_input", "reference", "source_documents")
    return report(find(records), records)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    hybrid = table(spark, d, "hybrid_rows", "row_id", "query", "ground_truth").select(F.lit("hybrid").alias("row_table"), "row_id", F.col("query").alias("question"), F.col("ground_truth").alias("answer"))
    tree = table(spark, d, "tree_rows", "row_id", "question", "evidence_snippets").select(
        F.lit("tree").alias("row_table"), "row_id", "question", F.array_join("evidence_snippets", "\n").alias("answer")
    )
    return hybrid.unionByName(tree)


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    from .pairs import defective_pairs

    return defective_pairs(_pairs(spark, d)).select("row_table", "row_id", F.posexplode(F.arrays_zip("defects", "posteriors")).alias("place", "x")).select("row_table", "row_id", "place", F.col("x.defects").alias("defect"), F.col("x.posteriors").alias("posterior"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .pairs import defective_pairs

    return defective_pairs(_pairs(spark, d)).select("row_table", "row_id", F.col("defects")[0].alias("defect"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Every row's chunks once, with their ids and scores only: texts are dropped where they are read."""
    chunks = F.transform("context_chunks", lambda c: F.when(c.isNotNull(), F.struct(*(c[f].alias(f) for f in ("source_id", *SCORES)))))
    return table(spark, d, "hybrid_rows", "row_id", "context_chunks").select("row_id", chunks.alias("context_chunks")).dropDuplicates(["row_id"])


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    from .fusion import rank_walk

    return rank_walk(_scores(spark, d), SCORES).select("row_id", "source_id", "position", F.round("share", 6).alias("share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .fusion import balanced_leaders, rank_walk

    return balanced_leaders(rank_walk(_scores(spark, d), SCORES), SCORES)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from .tokenize import encode

    return encode(table(spark, d, "documents", "doc_id", "text"), vocabulary())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    from .tokenize import decode, encode

    return decode(encode(table(spark, d, "documents", "doc_id", "text"), vocabulary()), vocabulary())


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaked_passages

    return leaked_passages(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_passages", "item_id", "passage"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_matches(spark, d).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import without_leaks

    return without_leaks(table(spark, d, "documents", "doc_id", "source"), p9_matches(spark, d))


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .encoding import repair_encoding

    return repair_encoding(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).where((F.col("n_repaired") > 0) | (F.col("n_lost") > 0)).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_neighbours, p2_search, p3_found, p3_repaired, p4_found, p4_pairs, p4_records, p4_report, p6_found, p6_labels, p7_found, p7_order, p8_ids, p8_decoded, p9_found, p9_matches, p9_clean, p10_found, p10_repaired)}

# windows of 12 words that both sides have; consecutive ones with one distance are a match
LEAKS = r"""
    WITH t AS (SELECT item_id, list_transform(regexp_extract_all(passage, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_passages),
    g AS (SELECT item_id, i AS j, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12)),
    d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
    m AS (SELECT doc_id, item_id, i, i - j AS far, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM h JOIN g ON h.k = g.k),
    r AS (SELECT doc_id, item_id, min(i) - 1 AS p, count(*) + 11 AS n FROM m GROUP BY doc_id, item_id, far, run),
    b AS (SELECT doc_id, item_id, max(n)::INTEGER AS n_words, arg_min(p, (-n, p))::INTEGER AS word_position FROM r GROUP BY doc_id, item_id)"""

# brute force: the five most similar of every usable vector
NEAREST = f"""
    WITH v AS (SELECT DISTINCT ON (id) id, CAST(dense_vec AS FLOAT[{DIMS}]) AS v FROM child_chunks WHERE id IS NOT NULL AND len(dense_vec) = {DIMS} AND NOT list_bool_or(list_transform(dense_vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(dense_vec, lambda x: x <> 0))),
    s AS (SELECT a.id, b.id AS neighbour, array_cosine_similarity(a.v, b.v) AS similarity FROM v a JOIN v b ON a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 6) DESC, neighbour) AS place FROM s QUALIFY place <= 5)"""

ORACLE: dict[str, str] = {
    "p2_found": f"{NEAREST} SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM n WHERE similarity >= {ALIKE}",
    "p1_found": f"""
        SELECT DISTINCT 'parent' AS chunk_kind, id AS chunk_id FROM parent_chunks WHERE length(text) > {PARENT_LIMIT}
        UNION ALL SELECT DISTINCT 'child', id FROM child_chunks WHERE length(enriched_text) > {CHILD_LIMIT}""",
    "p7_found": """
        WITH r AS (SELECT DISTINCT ON (row_id) row_id, context_chunks FROM hybrid_rows),
        c AS (SELECT row_id, unnest(context_chunks) AS x FROM r),
        s AS (SELECT row_id, x.source_id AS source_id, x.dense_score AS a, x.sparse_score AS b, x.rerank_score AS c, x.rrf_score AS d,
                     coalesce(x.dense_score, 0) + coalesce(x.sparse_score, 0) + coalesce(x.rerank_score, 0) + coalesce(x.rrf_score, 0) AS t FROM c WHERE x IS NOT NULL),
        k AS (SELECT *, max(a) OVER w AS ma, max(b) OVER w AS mb, max(c) OVER w AS mc, max(d) OVER w AS md, max(t) OVER w AS mt FROM s WINDOW w AS (PARTITION BY row_id)),
        n AS (SELECT *, count(*) FILTER (a = ma) OVER w AS na, count(*) FILTER (b = mb) OVER w AS nb, count(*) FILTER (c = mc) OVER w AS nc, count(*) FILTER (d = md) OVER w AS nd
              FROM k WINDOW w AS (PARTITION BY row_id))
        SELECT row_id, source_id FROM n
        WHERE t < mt AND (CASE WHEN a = ma AND na = 1 THEN 1 ELSE 0 END + CASE WHEN b = mb AND nb = 1 THEN 1 ELSE 0 END
                        + CASE WHEN c = mc AND nc = 1 THEN 1 ELSE 0 END + CASE WHEN d = md AND nd = 1 THEN 1 ELSE 0 END) >= 3""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"{LEAKS} SELECT doc_id, item_id FROM b",
    "p9_matches": f"{LEAKS} SELECT doc_id, item_id, n_words, word_position FROM b",
    "p9_clean": f"{LEAKS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)",
}
