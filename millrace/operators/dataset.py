"""Building evaluation sets: gates, deduplication, caps, quotas, splits. Random choices follow a hash of seed and key, so
they don't depend on partitions and SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def draw(key: Column, seed: int) -> Column:
    """A fixed random place for a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def gate_reasons(scores: Column, faithfulness: float = 0.85, relevance: float = 0.80) -> Column:
    """Why a record fails the score gate, in a fixed order; empty if it passes. Null scores fail."""
    at = lambda f: scores[f]
    own = F.array(
        F.when(~F.coalesce(at("answerability") == 1, F.lit(False)), "answerability_0"),
        F.when(~F.coalesce(at("question_specificity") == 1, F.lit(False)), "question_specificity_0"),
        F.when(F.coalesce(at("faithfulness"), F.lit(0.0)) < faithfulness, f"faithfulness_below_{faithfulness}"),
        F.when(F.coalesce(at("answer_relevance"), F.lit(0.0)) < relevance, f"answer_relevance_below_{relevance}"),
    )
    more = F.transform(F.coalesce(at("structural_fail_reasons"), F.array().cast("array<string>")), lambda r: F.concat(F.lit("structural:"), r))
    return F.concat(F.array_compact(own), more)


def structural_reasons(question: Column, reference: Column, contexts: Column, synthesizer: Column) -> Column:
    """Names of the cheap checks a record fails: noise, vagueness, echo, number and grounding of contexts, and per context
    (with its place) whether it is a contents page or has no substance. A null text fails none of the checks of its own."""
    none = F.array().cast("array<string>")
    ctx = F.coalesce(contexts, none)
    q, r = F.coalesce(question, F.lit("")), F.coalesce(reference, F.lit(""))
    qw, rw = X.content_words(q), X.content_words(r)
    cw = F.flatten(F.transform(ctx, X.content_words))
    n = F.size(ctx)
    own = F.array(
        F.when(X.is_noisy_question(q), "noisy_question"),
        F.when(X.is_vague(r), "vague_reference"),
        F.when((F.size(rw) > 0) & (F.size(qw) >= 5) & (F.size(F.array_intersect(qw, rw)) > 0.7 * F.size(rw)) & (F.length(r) < 200), "echo"),
        F.when((synthesizer.startswith("multi_hop") & (n < 2)) | (synthesizer.startswith("single_hop") & (n != 1)), "context_count"),
        F.when((F.size(rw) > 0) & (F.size(F.array_intersect(rw, cw)) < 0.5 * F.size(rw)), "grounding"),
    )
    per = F.flatten(
        F.transform(
            ctx,
            lambda c, i: F.array(
                F.when(X.toc_score(c) >= 3, F.concat(F.lit("ctx["), i.cast("string"), F.lit("]:toc_only"))),
                F.when((F.length(X.strip(X.strip_boilerplate(c))) < 200) | ~X.strip_boilerplate(c).rlike("[.!?]"), F.concat(F.lit("ctx["), i.cast("string"), F.lit("]:no_substance"))),
            ),
        )
    )
    return F.array_compact(F.concat(own, per))


def best_per_key(df: DataFrame, key: Column, order: list[Column], drop: bool = False) -> DataFrame:
    """The first row of each key by `order`, or (`drop`) the others; a null key is a key. One shuffle by key, of which only
    the leading rows travel when the first ones are asked for."""
    w = Window.partitionBy("_key").orderBy(*order)
    ranked = df.withColumn("_key", key).withColumn("_n", F.row_number().over(w))
    return ranked.where(F.col("_n") > 1 if drop else F.col("_n") == 1).drop("_key", "_n")


def cap_per_group(df: DataFrame, group: Column, cap: int, key: Column, seed: int) -> DataFrame:
    """At most `cap` rows of each group, chosen by draw."""
    w = Window.partitionBy("_group").orderBy(draw(key, seed), key)
    return df.withColumn("_group", group).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_group", "_n")


def quotas(counts: DataFrame, target: int, group: str = "stratum", n: str = "n") -> DataFrame:
    """(group, n, quota): `target` in proportion to the groups' sizes, one at least; what rounding leaves over is given to
    or taken from the largest groups, one each in turn. `counts` has a row per group."""
    total = F.sum(n).over(Window.partitionBy())
    first = F.greatest(F.lit(1), F.round(F.lit(target) * F.col(n) / total).cast("int"))
    t = counts.withColumn("_q", first)
    left = F.lit(target) - F.sum("_q").over(Window.partitionBy())
    t = t.withColumn("_left", left).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(n), group)) - 1).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))
    each = F.floor((F.abs("_left") - 1 - F.col("_r")) / F.col("_k")) + 1
    share = F.when(F.abs("_left") > F.col("_r"), each).otherwise(0) * F.signum("_left")
    return t.select(group, n, (F.col("_q") + share).cast("int").alias("quota"))


def stratified(df: DataFrame, target: int, stratum: str, key: Column, seed: int) -> DataFrame:
    """`target` rows in proportion to strata; all rows if there are no more than that."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    q = quotas(counts, target, stratum).select(stratum, "quota", F.sum("n").over(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).join(q, df[stratum].eqNullSafe(q[stratum])).where((F.col("_n") <= F.col("quota")) | (F.col("_all") <= target)).drop(q[stratum]).drop("_n", "quota", "_all")


def split_of(df: DataFrame, key: str, seed: int, train: float = 0.6, dev: float = 0.2) -> DataFrame:
    """`split` by position in the drawn order: floor(train * n), floor(dev * n), the rest. Positions come from a range sort
    and counts of its partitions, not from one task: ranks within 4,096 hash prefixes, offset by the prefixes before."""
    drawn = df.withColumn("_d", draw(F.col(key), seed)).withColumn("_b", F.substring("_d", 1, 3))
    sizes = drawn.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # 4,096 rows at most
    before = sizes.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    at = drawn.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))).join(F.broadcast(before), "_b")
    place = F.col("_before") + F.col("_i") - 1
    a = F.floor(F.lit(train) * F.col("_total"))
    b = a + F.floor(F.lit(dev) * F.col("_total"))
    return at.withColumn("split", F.when(place < a, "train").when(place < b, "dev").otherwise("test")).drop("_d", "_b", "_i", "_before", "_total")


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """One row: 16 hex digits over the sorted keys, and their number. Keys are hashed in 4,096 sorted groups first, so no
    task holds more than a group's share, and the groups' hashes after."""
    g = df.select(F.col(key).cast("string").alias("k")).groupBy(F.substring(F.md5("k"), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), ","), 256), F.lit(16)).alias("hash"), F.sum("n").alias("n"))
