"""Trees and page ranges in adjacency form. A node's path (0.2.1) names all its ancestors, so nothing here recurses: what
goes up or down the tree is a join with the path's prefixes, whose number is the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(path: Column) -> Column:
    """A path as numbers, which order nodes as the tree is read."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def prefixes(path: Column, own: bool = True) -> Column:
    """The paths of all ancestors from the top, and (`own`) the path itself."""
    parts = F.split(path, r"\.")
    last = F.size(parts) if own else F.size(parts) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def numbered(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """`seq` from 0 and `new_id` of four digits at least, in reading order."""
    w = Window.partitionBy(key).orderBy(steps(F.col("node_path")))
    return nodes.withColumn("seq", F.row_number().over(w) - 1).withColumn("new_id", F.when(F.length(F.col("seq").cast("string")) >= 4, F.col("seq").cast("string")).otherwise(F.lpad(F.col("seq").cast("string"), 4, "0")))


def leaves(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    parents = nodes.select(key, F.col("parent_path").alias("node_path")).where("node_path <> ''").distinct()
    return nodes.join(parents, [key, "node_path"], "left_anti")


def up(nodes: DataFrame, value: Column, how, name: str, key: str = "doc_id") -> DataFrame:
    """(key, node_path, name): an aggregate of `value` over every node's subtree, itself included."""
    rows = nodes.select(key, F.explode(prefixes(F.col("node_path"))).alias("node_path"), value.alias("_v"))
    return rows.groupBy(key, "node_path").agg(how("_v").alias(name))


def down(nodes: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """(key, node_path, ancestors): the ancestors' values from the top, nulls left out; nodes at the top have none."""
    above = nodes.select(key, "node_path", F.explode_outer(prefixes(F.col("node_path"), own=False)).alias("a"))
    values = nodes.select(key, F.col("node_path").alias("a"), F.col(value).alias("v"))
    return above.join(values, [key, "a"], "left").groupBy(key, "node_path").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct(F.length("a").alias("n"), "v")))), lambda s: s["v"]).alias("ancestors"))


def parents_by_level(flat: DataFrame, levels: int | None = None, key: str = "doc_id", pos: str = "seq", level: str = "level") -> DataFrame:
    """`parent_pos` of every row of a flat outline: the nearest row before it of a lower level, null at the top. One
    window per level over the rows before, no join; without `levels` a job finds how many there are."""
    levels = levels or flat.agg(F.max(level)).first()[0] or 1
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == i, F.col(pos)), ignorenulls=True).over(w) for i in range(1, levels + 1)]
    return flat.withColumn("_last", F.array(*last)).withColumn("parent_pos", F.array_max(F.slice("_last", F.lit(1), F.greatest(F.col(level) - 1, F.lit(0))))).drop("_last")


def page_list(start: Column, end: Column) -> Column:
    """The pages of a range; none if an end is null or they are the wrong way round."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def parse_pages(ref: Column) -> Column:
    """"Pages 3, 7-9" as [3, 7, 8, 9]; parts without a number give nothing, a null or empty text an empty list."""
    parts = F.split(F.regexp_replace(F.trim(F.coalesce(ref, F.lit(""))), r"(?i)^pages?\s*", ""), ",")

    def pages(p: Column) -> Column:
        p = F.trim(p)
        a = F.regexp_extract(p, r"^([0-9]+)\s*[-–]\s*([0-9]+)$", 1)
        b = F.regexp_extract(p, r"^([0-9]+)\s*[-–]\s*([0-9]+)$", 2)
        one = F.regexp_extract(p, r"([0-9]+)", 1)
        return F.when(a != "", page_list(a.cast("int"), b.cast("int"))).when(one != "", F.array(one.cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def strict_pages(ref: Column) -> Column:
    """The same for "3,5-7" only; a range the wrong way round, or a part that is no number, is an error."""
    ok = F.forall(F.split(ref, ","), lambda p: F.trim(p).rlike("^[0-9]+(?:-[0-9]+)?$") & (~p.contains("-") | (F.split_part(F.trim(p), F.lit("-"), F.lit(1)).try_cast("int") <= F.coalesce(F.split_part(F.trim(p), F.lit("-"), F.lit(2)).try_cast("int"), F.lit(0)))))
    return F.when(ok, parse_pages(ref)).otherwise(F.raise_error(F.concat(F.lit("not a list of pages: "), ref)).cast("array<int>"))


def page_envelope(ref: Column) -> Column:
    """All pages from the smallest to the largest number in a text."""
    n = F.transform(F.regexp_extract_all(ref, F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    return F.when(F.size(n) > 0, F.sequence(F.array_min(n), F.array_max(n))).otherwise(F.array().cast("array<int>"))


def page_string(pages: Column) -> Column:
    """A list of pages as "5-7,12": a page begins a range if the one before isn't there, and ends it if the next isn't."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))
    begins = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
    ends = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))), ",")


def page_scores(got: Column, gold: Column) -> Column:
    """hit, precision, recall and f1 of two page lists; precision and recall are rounded before f1."""
    both = F.size(F.array_intersect(got, gold))
    p = F.when(F.size(F.array_distinct(got)) > 0, F.round(both / F.size(F.array_distinct(got)), 2)).otherwise(0.0)
    r = F.when(F.size(F.array_distinct(gold)) > 0, F.round(both / F.size(F.array_distinct(gold)), 2)).otherwise(0.0)
    return F.struct((both > 0).alias("hit"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, F.round(2 * p * r / (p + r), 2)).otherwise(0.0).alias("f1"))
