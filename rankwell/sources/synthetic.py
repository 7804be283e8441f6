"""Elements drawn from normal distributions, one a leaf, whose means and deviations are drawn too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *of: str) -> Column:
    """A number in (0, 1) from a hash, so that a retried task draws the same."""
    return (F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normals(spark: SparkSession, leaves: int, n: int, mu: tuple[float, float], stdev: tuple[float, float], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Elements (element_id, leaf_id, value), n a leaf, and the leaves' (cluster, centroid, stdev), the centroid being the mean alone.

    An element's id is its number as text; the mean and the deviation are uniform over the given ranges.
    """
    rng = np.random.default_rng(seed)
    means, deviations = rng.uniform(*mu, leaves), rng.uniform(*stdev, leaves)
    shape = spark.createDataFrame([(i, [float(m)], float(d)) for i, (m, d) in enumerate(zip(means, deviations))], "cluster int, centroid array<double>, stdev double")
    normal = F.sqrt(-2 * F.log(_uniform(2 * seed, "id"))) * F.cos(2 * F.pi() * _uniform(2 * seed + 1, "id"))
    d = spark.range(leaves * n).select("id", F.floor(F.col("id") / n).cast("int").alias("cluster"), normal.alias("z")).join(shape, "cluster")
    return d.select(F.col("id").cast("string").alias("element_id"), F.col("cluster").alias("leaf_id"), (F.get("centroid", F.lit(0)) + F.col("stdev") * F.col("z")).alias("value")), shape
