"""Vectors and models: embeddings as images' stand-in, parts as the tabular data."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions.columns import softmax_at
from rankwell.operators import scoring, tree
from rankwell.operators.order import numbered
from rankwell.plans.base import query, table

CENTROIDS = """
 x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT label AS cluster, i, avg(v) AS c FROM x GROUP BY 1, 2),
 c AS (SELECT cluster, list(c ORDER BY i) AS centroid FROM m GROUP BY 1)"""


@query(
    f"""WITH {CENTROIDS},
 d AS (SELECT vec_id, cluster, list_distance(embedding::DOUBLE[], centroid) AS dist FROM embeddings, c)
SELECT vec_id, cluster, round(dist, 5) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1"""
)
def nearest_centroid(spark, sf_dir):
    """The nearest of the labels' mean vectors."""
    e = table(spark, sf_dir, "embeddings")
    near = tree.nearest(e.select("vec_id", "embedding"), "embedding", tree.mean_vectors(e, "label", "embedding"))
    return near.select("vec_id", "cluster", F.round("dist", 5).alias("dist"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)))), 9) AS p FROM embeddings")
def softmax_target(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(softmax_at(F.col("embedding"), 0), 9).alias("p"))


@query("SELECT round(sqrt(avg(pow(900 + 2.0::DOUBLE * p_size - p_retailprice, 2))), 6) AS rmse FROM part")
def rmse(spark, sf_dir):
    """The error of a linear formula for prices."""
    d = table(spark, sf_dir, "part").withColumn("guess", F.lit(900.0) + F.col("p_size") * 2.0)
    return scoring.rmse(d, "guess", "p_retailprice").select(F.round("rmse", 6).alias("rmse"))


@query()
def trees_rmse(spark, sf_dir):
    """The error of boosted trees on held-out parts; the model is fitted on at most 2000 others."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 1000).cast("double").alias("line"), "p_retailprice")
    train = d.filter("p_partkey % 3 <> 0").orderBy(F.md5(F.col("p_partkey").cast("string"))).limit(2000)
    model = scoring.fit_trees(train, ["p_size", "line"], "p_retailprice", rounds=5, depth=4)
    held = scoring.trees_scorer(model)(d.filter("p_partkey % 3 = 0"))
    return scoring.rmse(held, "score", "p_retailprice")


@query()
def kmeans_index(spark, sf_dir):
    """Every vector's cluster, and its place in the cluster's draw order."""
    nodes, members = tree.build_index(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), 8, 1000)
    return members.select(F.col("element_id").alias("vec_id"), "leaf_id", "ord")


@query()
def dendrogram(spark, sf_dir):
    """The nodes of the tree over the labels' mean vectors."""
    means = tree.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return tree.dendrogram(means).select("node_id", "parent_id", "ordinal", "depth", "is_leaf")


@query()
def synthetic_source(spark, sf_dir):
    """For every event a draw from the normal distribution of its type."""
    e = table(spark, sf_dir, "events")
    shape = e.groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev("value").alias("sd"))
    d = numbered(e.select("event_id", "event_type"), [F.asc("event_id")], ["event_type"], "n").join(shape, "event_type")
    # from two hashes of the id, so that a retried task draws the same
    u = [(F.pmod(F.xxhash64("event_id", F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for s in (1, 2)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])
    return d.select("event_id", F.col("event_type").alias("leaf"), (F.col("mu") + F.col("sd") * normal).alias("value"))
