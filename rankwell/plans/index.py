"""Index tables over the tree region - nation - customer and over event types."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.operators import tree
from rankwell.operators.order import batch_of, numbered
from rankwell.plans.base import SCORED, drawn, events, query, table
from rankwell.sources.files import dense_index, elements, export_index, import_index, useful
from rankwell.sources.shared import new_path

NODES_SQL = """
 n0 AS (SELECT 0 AS node_id, NULL::INTEGER AS parent_id, 0 AS ordinal, 0 AS depth, false AS is_leaf
  UNION ALL SELECT 1 + r_regionkey, 0, r_regionkey, 1, false FROM region
  UNION ALL SELECT 1000 + n_nationkey, 1 + n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER, 2, true FROM nation),
 sizes AS (SELECT 1000 + c_nationkey AS node_id, count(*) AS size FROM customer GROUP BY 1),
 nodes AS (SELECT n0.*, coalesce(size, 0) AS size FROM n0 LEFT JOIN sizes USING (node_id))"""
PATHS_SQL = """
 walk(node_id, path) AS (SELECT node_id, '' FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, CASE WHEN w.path = '' THEN n.ordinal::VARCHAR ELSE w.path || '.' || n.ordinal END FROM walk w JOIN nodes n ON n.parent_id = w.node_id)"""
UP_SQL = """
 up(leaf_id, node_id) AS (SELECT node_id, node_id FROM nodes WHERE is_leaf
  UNION ALL SELECT u.leaf_id, n.parent_id FROM up u JOIN nodes n ON n.node_id = u.node_id WHERE n.parent_id IS NOT NULL)"""


def nodes(spark, sf_dir):
    """Nodes of the three-level tree; nations are leaves."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), F.lit(False).alias("is_leaf"))
    regions = region.select((F.col("r_regionkey") + 1).cast("int").alias("node_id"), F.lit(0).alias("parent_id"), F.col("r_regionkey").cast("int").alias("ordinal"), F.lit(1).alias("depth"), F.lit(False).alias("is_leaf"))
    place = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nations = nation.select((F.col("n_nationkey") + 1000).cast("int").alias("node_id"), (F.col("n_regionkey") + 1).cast("int").alias("parent_id"), place.cast("int").alias("ordinal"), F.lit(2).alias("depth"), F.lit(True).alias("is_leaf"))
    sizes = customer.groupBy((F.col("c_nationkey") + 1000).cast("int").alias("node_id")).agg(F.count(F.lit(1)).alias("size"))
    every = root.unionByName(regions).unionByName(nations)
    return every.join(sizes, "node_id", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))


@query("SELECT 0 AS leaf_id, c_custkey::VARCHAR AS element_id, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer")
def flat_index(spark, sf_dir):
    """One leaf that holds all elements in order."""
    d = numbered(table(spark, sf_dir, "customer").select("c_custkey"), [F.asc("c_custkey")])
    return d.select(F.lit(0).alias("leaf_id"), F.col("c_custkey").cast("string").alias("element_id"), (F.col("rn") - 1).alias("ord"))


@query(f"WITH RECURSIVE {NODES_SQL}, {PATHS_SQL} SELECT nodes.* REPLACE (coalesce(parent_id, -1) AS parent_id), path FROM nodes JOIN walk USING (node_id)")
def index_nodes(spark, sf_dir):
    """The nodes with their paths; the root's parent is shown as -1."""
    n = nodes(spark, sf_dir)
    return n.join(tree.paths(n), "node_id").withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)))


@query("SELECT 1000 + c_nationkey AS leaf_id, c_custkey::VARCHAR AS element_id FROM customer")
def leaf_elements(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1000).cast("int").alias("leaf_id"), F.col("c_custkey").cast("string").alias("element_id"))


@query(f"WITH RECURSIVE {NODES_SQL} SELECT node_id, coalesce(parent_id, -1) AS parent_id, ordinal, is_leaf, CASE WHEN is_leaf THEN size ELSE 0 END AS size FROM nodes")
def index_import(spark, sf_dir):
    """The nodes as a nested document and back; ids are matched again by path."""
    n = nodes(spark, sf_dir)
    d = n.join(tree.paths(n), "node_id")
    members = numbered(leaf_elements(spark, sf_dir), [F.asc("element_id")], ["leaf_id"], "ord")
    again, _ = import_index(spark, export_index(d.withColumn("centroid", F.lit(None).cast("array<double>")), members, new_path(spark, "members")))
    back = again.select(F.array_join("path", ".").alias("path"), "is_leaf", "size")
    ids = d.select("node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "ordinal", "path")
    return ids.join(back, "path").drop("path")


@query(f"WITH RECURSIVE {NODES_SQL}, {PATHS_SQL} SELECT node_id, path FROM walk")
def tree_paths(spark, sf_dir):
    return tree.paths(nodes(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, {UP_SQL}
SELECT up.node_id, count(*) AS n, round(sum(c_acctbal) / count(*), 6) AS mean FROM customer JOIN up ON leaf_id = 1000 + c_nationkey GROUP BY 1"""
)
def tree_rollup(spark, sf_dir):
    """Number and mean balance of customers at every node."""
    values = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1000).cast("int").alias("leaf_id"), "c_acctbal")
    return tree.rollup(values, nodes(spark, sf_dir), "c_acctbal").withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, {UP_SQL},
 fan AS (SELECT parent_id AS node_id, count(*) AS k FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT leaf_id, round(exp(-sum(ln(k))), 9) AS prob FROM up JOIN fan USING (node_id) GROUP BY 1"""
)
def uniform_leaf_prob(spark, sf_dir):
    return tree.leaf_probability(nodes(spark, sf_dir)).withColumn("prob", F.round("prob", 9))


@query("SELECT event_type AS leaf, count(*) AS n FROM events GROUP BY 1")
def leaf_sizes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


ORDERED = f"SELECT element_id AS event_id, event_type, score, row_number() OVER (PARTITION BY event_type ORDER BY draw, element_id) AS ord FROM ({SCORED})"


@query(f"SELECT event_type AS leaf, count(*) FILTER (ord > 400) AS n FROM ({ORDERED}) GROUP BY 1")
def remaining_size(spark, sf_dir):
    """Elements left in each leaf after 400 draws."""
    sizes = leaf_sizes(spark, sf_dir)
    return sizes.select("leaf", F.greatest(F.col("n") - 400, F.lit(0)).cast("long").alias("n"))


@query(f"SELECT event_id, event_type FROM ({ORDERED}) WHERE ord > 400")
def remaining_elements(spark, sf_dir):
    """Elements that 400 draws from each leaf leave."""
    d = drawn(spark, sf_dir, ["event_type"])
    gone = d.filter("ord <= 400").select("element_id")
    return d.join(gone, "element_id", "left_anti").select(F.col("element_id").alias("event_id"), "event_type")


@query(f"SELECT event_id, event_type, ord FROM ({ORDERED})")
def leaf_draw_order(spark, sf_dir):
    return drawn(spark, sf_dir, ["event_type"]).select(F.col("element_id").alias("event_id"), "event_type", "ord")


@query(f"SELECT event_id, event_type, (ord - 1) // 400 AS batch FROM ({ORDERED})")
def batch_numbers(spark, sf_dir):
    return leaf_draw_order(spark, sf_dir).select("event_id", "event_type", batch_of(F.col("ord"), 400).alias("batch"))


@query(f"SELECT event_id, event_type, score, ord FROM ({ORDERED}) WHERE ord <= 400")
def noreplace_batches(spark, sf_dir):
    """The first batch of each leaf."""
    return drawn(spark, sf_dir, ["event_type"]).filter("ord <= 400").select(F.col("element_id").alias("event_id"), "event_type", "score", "ord")


@query("SELECT event_type AS leaf, event_id FROM events")
def cluster_members(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("leaf"), F.col("element_id").alias("event_id"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM
(SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n
 FROM lineitem l SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON l_orderkey = o_orderkey) WHERE n = 1"""
)
def fetch_by_id(spark, sf_dir):
    """The first row of each wanted key, of which the table has several."""
    wanted = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi")
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("m"))
    return first.select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_extendedprice")


@query("SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def fetch_exclude_cols(spark, sf_dir):
    return elements(spark, f"{sf_dir}/part.parquet", ["p_name", "p_brand", "absent"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def project_useful(spark, sf_dir):
    return useful(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "listed_at", "p_size", "p_retailprice"])


@query("SELECT event_id, greatest(0.0, value) AS score FROM events")
def cached_scores(spark, sf_dir):
    """Known scores of all elements, which a run asks for."""
    asked = table(spark, sf_dir, "events").select("event_id")
    known = events(spark, sf_dir).select(F.col("element_id").alias("event_id"), "score")
    return asked.join(known, "event_id")


@query("SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def semi_chosen(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, idx FROM documents JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'es')) USING (lang)")
def map_inner(spark, sf_dir):
    """The class of each document whose language is mapped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    classes = dense_index(docs.filter("lang <> 'es'"), "lang").withColumnRenamed("name", "lang")
    return docs.join(classes, "lang").select("doc_id", "idx")
