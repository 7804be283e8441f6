"""Exact top-k answers, and the quality of any answer against them.

Frames of scored elements have the columns element_id and score. Equal scores: the ground truth puts the larger id
first, the bounded queue keeps the smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.operators.order import numbered


def _order(id_first: str) -> list[Column]:
    return [F.desc("score"), F.desc("element_id") if id_first == "large" else F.asc("element_id")]


def scored(df: DataFrame, element_id: str, score: Column) -> DataFrame:
    """Every element's score; NaN counts as no score."""
    return df.select(F.col(element_id).alias("element_id"), F.when(~F.isnan(score), score).alias("score"))


def top_k(elements: DataFrame, k: int, tie: str = "large") -> DataFrame:
    """The k elements of the highest score."""
    return elements.filter("score is not null").orderBy(*_order(tie)).limit(k)


def rankings(elements: DataFrame) -> DataFrame:
    """Every element with its rank, from 1."""
    return numbered(elements, _order("large"), name="rank")


def group_top_k(elements: DataFrame, by: list[str], k: int, tie: str = "small") -> DataFrame:
    """The k best of each group; each task keeps k rows a group before the shuffle."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*_order(tie)))
    return elements.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


def stk_kls(elements: DataFrame, by: list[str], k: int) -> DataFrame:
    """For each group the sum of the k best scores and the k-th best, which is 0 while there are fewer than k."""
    top = group_top_k(elements, by, k).groupBy(*by)
    kth = F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(0.0))
    return top.agg(F.sum("score").alias("stk"), kth.alias("kls"))


def prefix_stk_kls(ordered: DataFrame, total: int, steps: int, k: int, rn: str = "rn") -> DataFrame:
    """STK and KLS of the first 1/steps, 2/steps, ... of the rows: (step, prefix_n, stk, kls).

    Only the k best rows of each step enter the prefixes, so the work beyond the first pass is steps^2 k rows.
    """
    step = F.least(F.floor((F.col(rn) - 1) * steps / F.lit(total)).cast("long") + 1, F.lit(steps).cast("long"))
    best = group_top_k(ordered.withColumn("own", step), ["own"], k)
    prefixes = best.withColumn("step", F.explode(F.sequence("own", F.lit(steps).cast("long"))))
    return stk_kls(prefixes, ["step"], k).select("step", F.floor(F.col("step") * total / steps).cast("long").alias("prefix_n"), "stk", "kls")


def precision_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true top k that was found; precision and recall both divide by k."""
    hit = found.join(truth.select("element_id"), "element_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(float(k))
    return hit.select(share.alias("precision_at_k"), share.alias("recall_at_k"))


def avg_worst_rank(found: DataFrame, ranks: DataFrame, k: int, total: int) -> DataFrame:
    """Mean and worst true rank of what was found; each missing element counts as rank `total`."""
    # k rows, so broadcasting them is bounded
    d = ranks.select("element_id", "rank").join(F.broadcast(found.select("element_id", "score")), "element_id")
    d = d.select("rank", F.struct(F.negate("score"), "element_id").alias("at"))
    n = F.count(F.lit(1))
    avg = (F.coalesce(F.sum("rank"), F.lit(0)) + F.greatest(F.lit(k) - n, F.lit(0)) * total) / F.lit(float(k))
    worst = F.when(n < k, F.lit(total).cast("long")).otherwise(F.max_by("rank", "at"))
    return d.agg(avg.alias("avg_rank"), worst.alias("worst_rank"))
