"""The cluster index: a table of nodes and a table of members.

nodes(node_id, parent_id, ordinal, depth, path, is_leaf, size, centroid), members(leaf_id, element_id, ord).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.columns import distance
from rankwell.operators.order import draw_order, exact_sample
from rankwell.sources.files import NODES
from rankwell.sources.shared import cut, new_path

#: Centroids that the index builder accepts; the dendrogram's work grows with the square of it.
MAX_CLUSTERS = 2000
#: Bytes of a row group of stored members.
ROW_GROUP = 8 << 20


def paths(nodes: DataFrame) -> DataFrame:
    """Rows (node_id, path): the ordinals from the root to each node, joined by dots; empty for the root."""
    nodes.createOrReplaceTempView("__tree_nodes")
    return nodes.sparkSession.sql("""
        WITH RECURSIVE walk(node_id, path) AS (
          SELECT node_id, CAST('' AS STRING) FROM __tree_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.node_id, CASE WHEN w.path = '' THEN CAST(n.ordinal AS STRING) ELSE concat(w.path, '.', n.ordinal) END
          FROM walk w JOIN __tree_nodes n ON n.parent_id = w.node_id)
        SELECT node_id, path FROM walk""")


def ancestors(nodes: DataFrame) -> DataFrame:
    """Rows (leaf_id, node_id): every leaf with itself and all nodes above it."""
    nodes.createOrReplaceTempView("__tree_nodes")
    return nodes.sparkSession.sql("""
        WITH RECURSIVE up(leaf_id, node_id) AS (
          SELECT node_id, node_id FROM __tree_nodes WHERE is_leaf
          UNION ALL
          SELECT u.leaf_id, n.parent_id FROM up u JOIN __tree_nodes n ON n.node_id = u.node_id WHERE n.parent_id IS NOT NULL)
        SELECT leaf_id, node_id FROM up""")


def rollup(values: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Rows (node_id, n, mean) at every node. Leaves are summed first, so only one row a leaf goes up the tree."""
    leaf = values.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    return leaf.join(ancestors(nodes), "leaf_id").groupBy("node_id").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))


def leaf_probability(nodes: DataFrame) -> DataFrame:
    """Rows (leaf_id, prob): how likely a walk that takes a random child at each level ends in the leaf."""
    fan = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("parent_id", "node_id")
    inner = ancestors(nodes).join(fan, "node_id").groupBy("leaf_id").agg(F.sum(F.log("k")).alias("l"))
    return inner.select("leaf_id", F.exp(-F.col("l")).alias("prob"))


def nearest(elements: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """`elements` with the cluster and distance of the nearest centroid, the lower cluster of equally near ones.

    `centroids` (cluster, centroid) is bounded by MAX_CLUSTERS, so it is gathered into one broadcast row.
    """
    one = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("__cs"))
    d = elements.crossJoin(F.broadcast(one))
    near = F.array_min(F.transform("__cs", lambda c: F.struct(distance(F.col(vector), c["centroid"]).alias("dist"), c["cluster"].alias("cluster"))))
    return d.withColumn("__near", near).select(*elements.columns, F.col("__near.cluster").alias("cluster"), F.col("__near.dist").alias("dist"))


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Rows (cluster, centroid): the mean vector of each group, dimension by dimension."""
    long = df.select(F.col(by).alias("cluster"), F.posexplode(vector).alias("i", "x"))
    means = long.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def store(members: DataFrame, path: str | None = None) -> DataFrame:
    """`members` written by leaf and draw order, by default below the shared folder, and read back: a range of a leaf's order is in few row groups."""
    path = path or new_path(members.sparkSession, "members")
    members.repartitionByRange("leaf_id", "ord").sortWithinPartitions("leaf_id", "ord").write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return members.sparkSession.read.parquet(path)


def kmeans(elements: DataFrame, element_id: str, vector: Column, clusters: int, subsample: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Centroids fitted on a subsample of exact size, and all elements with their cluster: (cluster, centroid), (element_id, cluster, dist)."""
    if clusters > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} clusters")
    d = elements.select(F.col(element_id).alias("element_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    train = cut(exact_sample(d, "element_id", subsample, seed)).select(array_to_vector("v").alias("features"))
    model = KMeans(k=clusters, seed=seed, initMode="k-means||").fit(train)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = elements.sparkSession.createDataFrame(rows, "cluster int, centroid array<double>")
    return centroids, nearest(d, "v", centroids).drop("v")


def average_linkage(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of the closest clusters by mean distance; new clusters are numbered from len(points) on.

    Distances to a merged cluster are the size-weighted means of those to its parts.
    """
    n = len(points)
    square = (points * points).sum(axis=1)
    dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))
    np.fill_diagonal(dist, np.inf)
    name, size, merges = list(range(n)), np.ones(n), []
    near = dist.min(axis=1) if n else np.empty(0)  # each one's distance to its nearest, which only a merge changes
    for step in range(n - 1):
        a = int(near.argmin())
        a, b = sorted((a, int(dist[a].argmin())))
        height, total = dist[a, b], size[a] + size[b]
        x, y = sorted((name[a], name[b]))
        merges.append((x, y, float(height), int(total)))
        row = (size[a] * dist[a] + size[b] * dist[b]) / total
        again = (near == dist[a]) | (near == dist[b])
        dist[a], dist[:, a] = row, row
        dist[b], dist[:, b] = np.inf, np.inf
        dist[a, a] = np.inf
        near = np.minimum(near, dist[a])
        again[a] = True
        near[again] = dist[again].min(axis=1)
        near[b] = np.inf
        name[a], size[a] = n + step, total
    return merges


def dendrogram(centroids: DataFrame) -> DataFrame:
    """The nodes of the average-linkage tree over the centroids, at most MAX_CLUSTERS of them."""
    rows = centroids.orderBy("cluster").limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} clusters")
    merges = average_linkage(np.array([r["centroid"] for r in rows]))
    children = {len(rows) + i: (a, b) for i, (a, b, _, _) in enumerate(merges)}
    out, todo = [], [(max(children, default=0), None, 0, [])]
    while todo:
        node, parent, ordinal, path = todo.pop()
        leaf = node < len(rows)
        out.append((node, parent, ordinal, len(path), path, leaf, 0, [float(x) for x in rows[node]["centroid"]] if leaf else None))
        todo += [] if leaf else [(c, node, i, [*path, i]) for i, c in enumerate(children[node])]
    return centroids.sparkSession.createDataFrame(out, NODES)


def build_index(elements: DataFrame, element_id: str, vector: Column, clusters: int, subsample: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of a cluster index: k-means, dendrogram, and every element in its leaf in draw order."""
    centroids, assigned = kmeans(elements, element_id, vector, clusters, subsample, seed)
    assigned = cut(assigned.select(F.col("cluster").alias("leaf_id"), "element_id"))
    sizes = assigned.groupBy(F.col("leaf_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    nodes = dendrogram(centroids).join(sizes, "node_id", "left").withColumn("size", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
    return nodes, draw_order(assigned, "element_id", ["leaf_id"])
