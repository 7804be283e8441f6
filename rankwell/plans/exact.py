"""Exact answers over events and customers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.functions.columns import relu
from rankwell.operators import exact
from rankwell.operators.order import batch_of, exact_sample, numbered
from rankwell.plans.base import SCORED, drawn, events, query, table


@query("SELECT event_id, greatest(0.0, value) AS score FROM events")
def gt_scan(spark, sf_dir):
    """The score of every element."""
    return events(spark, sf_dir).select(F.col("element_id").alias("event_id"), "score")


@query("SELECT c_custkey, greatest(0.0, c_acctbal) AS score FROM customer")
def relu_score(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", relu(F.col("c_acctbal")).alias("score"))


@query("SELECT event_id, greatest(0.0, value) AS score FROM events ORDER BY score DESC, event_id DESC LIMIT 100")
def gt_topk(spark, sf_dir):
    """The 100 best, larger ids first among equals."""
    return exact.top_k(events(spark, sf_dir), 100).select(F.col("element_id").alias("event_id"), "score")


@query("SELECT event_id, greatest(0.0, value) AS score, row_number() OVER (ORDER BY greatest(0.0, value) DESC, event_id DESC) AS rank FROM events")
def gt_rankings(spark, sf_dir):
    return exact.rankings(events(spark, sf_dir)).select(F.col("element_id").alias("event_id"), "score", "rank")


@query("SELECT event_id, greatest(0.0, value) AS score FROM events ORDER BY score DESC, event_id LIMIT 183")
def pq_topk(spark, sf_dir):
    """The 183 best, smaller ids first among equals; at this k the cut goes through equal scores."""
    return exact.top_k(events(spark, sf_dir), 183, "small").select(F.col("element_id").alias("event_id"), "score")


@query(f"SELECT element_id AS event_id, score FROM ({SCORED}) ORDER BY draw, element_id LIMIT 100")
def limited_list(spark, sf_dir):
    """The first 100 drawn, whatever their score."""
    return exact_sample(events(spark, sf_dir), "element_id", 100).select(F.col("element_id").alias("event_id"), "score")


TOP = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, element_id) AS n FROM ({SCORED})"


@query(f"SELECT event_type, CASE WHEN count(*) >= 2000 THEN min(score) ELSE 0.0 END AS s_k FROM ({TOP}) WHERE n <= 2000 GROUP BY 1")
def kth_best(spark, sf_dir):
    """The 2000th best score of each type, 0 where there are fewer."""
    return exact.stk_kls(events(spark, sf_dir), ["event_type"], 2000).select("event_type", F.col("kls").alias("s_k"))


@query(f"SELECT event_type, round(sum(score), 6) AS stk, CASE WHEN count(*) >= 100 THEN min(score) ELSE 0.0 END AS kls FROM ({TOP}) WHERE n <= 100 GROUP BY 1")
def topk_stk_kls(spark, sf_dir):
    return exact.stk_kls(events(spark, sf_dir), ["event_type"], 100).select("event_type", F.round("stk", 6).alias("stk"), "kls")


#: The ground truth, and what 100 the first quarter of the draw order gives.
FOUND = f"""
e AS ({SCORED}),
r AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id DESC) AS rank FROM e),
d AS (SELECT *, row_number() OVER (ORDER BY draw, element_id) AS ord, count(*) OVER () AS total FROM e),
f AS (SELECT element_id, score, total FROM d WHERE ord <= total // 4 ORDER BY score DESC, element_id LIMIT 100)"""


def _found(spark, sf_dir):
    d = drawn(spark, sf_dir)
    total = table(spark, sf_dir, "events").count()
    return exact.top_k(d.filter(F.col("ord") <= total // 4), 100, "small"), total


@query(f"WITH {FOUND} SELECT count(*) / 100.0::DOUBLE AS precision_at_k, count(*) / 100.0::DOUBLE AS recall_at_k FROM f JOIN r USING (element_id) WHERE rank <= 100")
def precision_recall(spark, sf_dir):
    found, _ = _found(spark, sf_dir)
    return exact.precision_recall(found, exact.top_k(events(spark, sf_dir), 100), 100)


@query(
    f"""WITH {FOUND}
SELECT (sum(rank) + greatest(100 - count(*), 0) * any_value(total))::DOUBLE / 100 AS avg_rank,
       CASE WHEN count(*) < 100 THEN any_value(total) ELSE arg_max(rank, (-score, element_id)) END AS worst_rank
FROM f JOIN r USING (element_id)"""
)
def avg_worst_rank(spark, sf_dir):
    found, total = _found(spark, sf_dir)
    return exact.avg_worst_rank(found, exact.rankings(events(spark, sf_dir)), 100, total)


PREFIX = """
s AS (SELECT *, least((rn - 1) * 10 // total + 1, 10) AS own FROM o),
p AS (SELECT unnest(range(1, 11)) AS step),
x AS (SELECT step, score, total, row_number() OVER (PARTITION BY step ORDER BY score DESC, element_id) AS n FROM s JOIN p ON own <= step)
SELECT step, step * any_value(total) // 10 AS prefix_n, round(sum(score), 6) AS stk, CASE WHEN count(*) >= 100 THEN min(score) ELSE 0.0 END AS kls FROM x WHERE n <= 100 GROUP BY step"""


@query(f"WITH o AS (SELECT element_id, score, row_number() OVER (ORDER BY draw, element_id) AS rn, count(*) OVER () AS total FROM ({SCORED})), {PREFIX}")
def anytime_curve(spark, sf_dir):
    """What a random scan knows after each tenth of the elements."""
    return _curve(drawn(spark, sf_dir).withColumnRenamed("ord", "rn"), spark, sf_dir)


def _curve(ordered, spark, sf_dir):
    total = table(spark, sf_dir, "events").count()
    return exact.prefix_stk_kls(ordered, total, 10, 100).withColumn("stk", F.round("stk", 6))


@query(f"WITH o AS (SELECT element_id, score, row_number() OVER (ORDER BY score DESC, element_id DESC) AS rn, count(*) OVER () AS total FROM ({SCORED})), {PREFIX}")
def scan_order(spark, sf_dir):
    """The best case: the scan meets the elements by descending score."""
    return _curve(numbered(events(spark, sf_dir), [F.desc("score"), F.desc("element_id")]), spark, sf_dir)


@query(f"WITH o AS (SELECT element_id, score, row_number() OVER (ORDER BY score, element_id) AS rn, count(*) OVER () AS total FROM ({SCORED})), {PREFIX}")
def scan_worst(spark, sf_dir):
    """The worst case: the same scan backwards."""
    return _curve(numbered(events(spark, sf_dir), [F.asc("score"), F.asc("element_id")]), spark, sf_dir)


@query(
    f"""WITH d AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY draw, element_id) - 1) // 400 AS batch, score FROM ({SCORED})),
b AS (SELECT event_type, batch, count(*) * 0.001 + sum(score) * 0.000001 AS cost FROM d GROUP BY 1, 2)
SELECT event_type, batch, round(sum(cost) OVER (PARTITION BY event_type ORDER BY batch), 6) AS elapsed FROM b"""
)
def cumulative_time(spark, sf_dir):
    """Time so far after each batch of 400, at a cost for each element and for its score."""
    d = drawn(spark, sf_dir, ["event_type"]).withColumn("batch", batch_of(F.col("ord"), 400))
    b = d.groupBy("event_type", "batch").agg((F.count(F.lit(1)) * 0.001 + F.sum("score") * 0.000001).alias("cost"))
    so_far = F.sum("cost").over(W.partitionBy("event_type").orderBy("batch").rowsBetween(W.unboundedPreceding, 0))
    return b.select("event_type", "batch", F.round(so_far, 6).alias("elapsed"))
