"""Queries over the nested structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import json_triples, tree_lists, tree_nodes
from ..runtime import table
from .registry import query

NODES_SQL = """
    WITH RECURSIVE f AS (SELECT DISTINCT ON (doc_id) doc_id, raw_json::JSON AS j FROM structure_files WHERE json_valid(raw_json)),
    tops AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j->'structure') IN ('ARRAY', 'OBJECT') THEN j->'structure'
                              WHEN json_type(j->'hierarchy') IN ('ARRAY', 'OBJECT') THEN j->'hierarchy' WHEN json_type(j) = 'OBJECT' THEN j END AS l FROM f),
    n AS (SELECT doc_id, CAST(i AS VARCHAR) AS node_path, '' AS parent_path, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[' || i || ']') ELSE l END AS v
          FROM (SELECT doc_id, l, unnest(range(CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 1 END)) AS i FROM tops WHERE l IS NOT NULL)
          UNION ALL
          SELECT doc_id, node_path || '.' || i, node_path, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[' || i || ']') ELSE l END
          FROM (SELECT doc_id, node_path, l, unnest(range(CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 1 END)) AS i
                FROM (SELECT doc_id, node_path, v->'nodes' AS l FROM n WHERE json_type(v) = 'OBJECT' AND json_type(v->'nodes') IN ('ARRAY', 'OBJECT'))))
"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return json_triples(table(spark, d, "structure_files", "doc_id", "raw_json"))


@query("p5_found", NODES_SQL + "SELECT doc_id, node_path, parent_path FROM n WHERE json_type(v) = 'OBJECT'")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(_found(spark, d)).select("doc_id", "node_path", "parent_path")


@query(
    "p5_nodes",
    NODES_SQL
    + """SELECT doc_id, node_path, parent_path, v->>'node_id' AS node_id, v->>'title' AS title, v->>'summary' AS summary,
         CASE WHEN TRY_CAST(v->>'start_index' AS DOUBLE) = floor(TRY_CAST(v->>'start_index' AS DOUBLE)) THEN CAST(TRY_CAST(v->>'start_index' AS DOUBLE) AS INTEGER) END AS start_index,
         CASE WHEN TRY_CAST(v->>'end_index' AS DOUBLE) = floor(TRY_CAST(v->>'end_index' AS DOUBLE)) THEN CAST(TRY_CAST(v->>'end_index' AS DOUBLE) AS INTEGER) END AS end_index
         FROM n WHERE json_type(v) = 'OBJECT'""",
)
def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(_found(spark, d)).drop("ordinal")


@query(
    "p5_blocks",
    NODES_SQL
    + """, b AS (SELECT doc_id, node_path, v->'blocks' AS l FROM n WHERE json_type(v) = 'OBJECT' AND json_type(v->'blocks') = 'ARRAY'),
         e AS (SELECT doc_id, node_path, i, json_extract(l, '$[' || i || ']') AS v FROM (SELECT doc_id, node_path, l, unnest(range(json_array_length(l)::BIGINT)) AS i FROM b))
         SELECT doc_id, node_path AS parent_path, CAST(i AS INTEGER) AS ordinal, v->>'type' AS type, CAST(v->>'page' AS INTEGER) AS page FROM e WHERE json_type(v) = 'OBJECT'""",
)
def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    return tree_lists(_found(spark, d), "blocks", {"type": "string", "page": "int"}).drop("item_path")


@query("p5_refs")
def p5_refs(spark: SparkSession, d: str) -> DataFrame:
    return tree_lists(_found(spark, d), "refs", {"kind": "string", "id": "string"})


@query("p5_values")
def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Plain values inside lists (boxes, say), one row each."""
    return _found(spark, d).where((F.col("kind") != "object") & (F.col("column_name") == "")).select("doc_id", "table_name", F.col("parent").alias("parent_path"), "ordinal", "value").distinct()
