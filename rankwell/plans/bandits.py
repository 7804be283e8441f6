"""Budgeted top-k over events in a tree of type and hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions.columns import relu
from rankwell.operators import exact, experiment, tree
from rankwell.operators.bandit import Policy, budgeted_top_k
from rankwell.operators.order import draw_order
from rankwell.operators.scoring import relu_scorer
from rankwell.plans.base import SCORED, events, query, table
from rankwell.sources.files import dense_index
from rankwell.sources.shared import cut

TOP_100 = f"SELECT element_id AS event_id, score FROM ({SCORED}) ORDER BY score DESC, element_id LIMIT 100"
HISTOGRAMS = Policy("epsgreedy", alpha=0.5, bins=8, low=0.0, high=1.0, first_check=0.3, check_every=0.05)


def index(spark, sf_dir, by_score: bool = False):
    """Members (leaf_id, ord, element_id, value) and nodes of the tree: root, types, hours of a type."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("element_id"), "value", "event_type", F.hour("ts").alias("hour"))
    types = dense_index(e, "event_type").select(F.col("name").alias("event_type"), F.col("idx").cast("int").alias("t"))
    e = e.join(types, "event_type").withColumn("leaf_id", F.col("t") * 24 + F.col("hour") + 1000)
    members = tree.store(draw_order(e.select("leaf_id", "element_id", "value"), "element_id", ["leaf_id"]))
    sizes = members.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("size"))
    leaves = sizes.select(F.col("leaf_id").alias("node_id"), (F.floor((F.col("leaf_id") - 1000) / 24) + 1).cast("int").alias("parent_id"), ((F.col("leaf_id") - 1000) % 24).alias("ordinal"), F.lit(True).alias("is_leaf"), "size")
    inner = types.select((F.col("t") + 1).alias("node_id"), F.lit(0).alias("parent_id"), F.col("t").alias("ordinal"), F.lit(False).alias("is_leaf"), F.lit(0).cast("long").alias("size"))
    root = spark.range(1).select(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(False).alias("is_leaf"), F.lit(0).cast("long").alias("size"))
    return members, root.unionByName(inner).unionByName(leaves)


def run(spark, sf_dir, policy: Policy, share: float = 1.0, rounds: int = 3, k: int = 100):
    members, nodes = index(spark, sf_dir)
    budget = max(1, int(members.count() * share))
    found, trace, _ = budgeted_top_k(members, nodes, relu(F.col("value")), k, budget, policy=policy, rounds=rounds, arms=24)
    return found.withColumnRenamed("element_id", "event_id"), trace


@query(TOP_100)
def approx_topk_epsgreedy(spark, sf_dir):
    """With the whole budget the answer is exact."""
    return run(spark, sf_dir, HISTOGRAMS)[0]


@query(TOP_100)
def approx_topk_ucb(spark, sf_dir):
    return run(spark, sf_dir, Policy("ucb", c=1.0, init=100.0))[0]


@query(TOP_100)
def approx_topk_uniform(spark, sf_dir):
    return run(spark, sf_dir, Policy("uniform"))[0]


@query(TOP_100)
def approx_topk_scan(spark, sf_dir):
    return run(spark, sf_dir, Policy("scan"))[0]


TYPES = "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS t FROM (SELECT DISTINCT event_type FROM events)"


@query(
    f"""WITH drawn AS (SELECT event_id, greatest(0.0, value) AS score,
 row_number() OVER (ORDER BY t, hour(ts), md5('42:' || event_id), event_id) AS n FROM events JOIN ({TYPES}) USING (event_type))
SELECT event_id, score FROM drawn WHERE n <= greatest(1, (SELECT count(*) // 10 FROM events)) ORDER BY score DESC, event_id LIMIT 100"""
)
def approx_topk_budget(spark, sf_dir):
    """The answer of a scan in leaf and draw order after a tenth of the scorer calls."""
    return run(spark, sf_dir, Policy("scan"), 0.1)[0]


@query()
def approx_topk_budget_epsgreedy(spark, sf_dir):
    """The epsilon-greedy answer after a tenth of the scorer calls."""
    return run(spark, sf_dir, HISTOGRAMS, 0.1, 5)[0]


@query()
def approx_topk_replace(spark, sf_dir):
    """Draws with replacement, a tenth of the calls."""
    return run(spark, sf_dir, Policy("uniform", "replace"), 0.1, 2)[0]


@query(f"SELECT element_id AS event_id, score FROM ({SCORED}) ORDER BY score DESC, element_id DESC LIMIT 100")
def sorted_index_scan(spark, sf_dir):
    """The first 100 of an index sorted by score, which need no further calls."""
    ordered = exact.rankings(events(spark, sf_dir)).withColumnRenamed("rank", "ord").withColumn("leaf_id", F.lit(0))
    nodes = spark.range(1).select(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(True).alias("is_leaf"), F.lit(100).cast("long").alias("size"))
    found, _, _ = budgeted_top_k(cut(ordered).withColumnRenamed("score", "known"), nodes, F.col("known"), 100, 100, policy=Policy("scan", "sortedscan"), rounds=1, arms=1)
    return found.withColumnRenamed("element_id", "event_id")


@query()
def experiment_trace(spark, sf_dir):
    """Traces of two policies in two repetitions, averaged."""
    members, nodes = index(spark, sf_dir)
    budget, runs = max(1, members.count() // 10), {}
    for name, policy in (("EpsGreedy", HISTOGRAMS), ("UniformSample", Policy("uniform"))):
        for rep in range(2):
            _, trace, _ = budgeted_top_k(members, nodes, relu_scorer("value"), 100, budget, policy=policy, rounds=2, arms=24, seed=rep)
            runs[name, rep] = trace
    return experiment.aggregate_reps(experiment.traces(spark, runs), ["stk", "kls", "elapsed"])
