"""Cleaning, names, labels, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions.columns import boolish as boolish_
from rankwell.functions.columns import first_number, in_unit, label_prefix as label_prefix_, positive_ints, uid
from rankwell.operators import clean, order
from rankwell.plans.base import SCORED, events, query, table
from rankwell.sources import files
from rankwell.sources.shared import new_path


@query("SELECT event_id, try_cast(regexp_extract(trim(props), '[-+]?([0-9]+([.][0-9]+)?|[.][0-9]+)', 0) AS DOUBLE) AS v FROM events")
def clean_numeric(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", first_number(F.col("props")).alias("v"))


@query("SELECT l_returnflag AS word, CASE lower(l_returnflag) WHEN 'n' THEN 0.0 WHEN 'y' THEN 1.0 END::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1, 2")
def boolish(spark, sf_dir):
    """Flags read as words of yes and no."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("word", boolish_(F.col("word")).alias("v"), "n")


GAPS = "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name, p_retailprice FROM part"


def _gaps(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(key % 5 != 0, F.col("p_size").cast("double")).alias("p_size"), F.when(key % 3 != 0, F.col("p_name")).alias("p_name"), "p_retailprice")


@query(f"WITH g AS ({GAPS}) SELECT p_partkey, round(coalesce(p_size, (SELECT avg(p_size) FROM g)), 6) AS p_size FROM g")
def impute_mean(spark, sf_dir):
    """Sizes, of which every fifth is missing, with the mean in the gaps."""
    return clean.impute_mean(_gaps(spark, sf_dir), ["p_size"]).select("p_partkey", F.round("p_size", 6).alias("p_size"))


@query(f"WITH g AS ({GAPS}), n AS (SELECT 'p_size' AS name, count(*) - count(p_size) AS nulls FROM g UNION ALL SELECT 'p_name', count(*) - count(p_name) FROM g UNION ALL SELECT 'p_partkey', count(*) - count(p_partkey) FROM g UNION ALL SELECT 'p_retailprice', count(*) - count(p_retailprice) FROM g) SELECT name, nulls FROM n ORDER BY nulls DESC, name LIMIT 3")
def null_counts(spark, sf_dir):
    return clean.null_counts(_gaps(spark, sf_dir), 3)


@query(
    """SELECT name, v AS mode FROM (
 SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY c DESC, v) AS n FROM (
  SELECT 'p_brand' AS name, p_brand AS v, count(*) AS c FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2)) WHERE n = 1"""
)
def column_mode(spark, sf_dir):
    return clean.modes(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS v, 0.0::DOUBLE AS constant FROM customer")
def minmax_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.lit(3.0).alias("constant"))
    return clean.minmax(d, ["v", "constant"]).withColumn("v", F.round("v", 6))


SPLIT = "CASE WHEN o <= {held} THEN 'val' WHEN o <= {held} + (total - {held}) * 2 // 3 THEN 'train' ELSE 'test' END"


@query(f"SELECT element_id AS event_id, {SPLIT.format(held=1000)} AS part FROM (SELECT element_id, row_number() OVER (ORDER BY draw, element_id) AS o, count(*) OVER () AS total FROM ({SCORED}))")
def shuffle_split(spark, sf_dir):
    d = events(spark, sf_dir).select("element_id")
    return order.shuffle_split(d, "element_id", 1000).select(F.col("element_id").alias("event_id"), "part")


@query(f"SELECT element_id AS event_id FROM ({SCORED}) ORDER BY draw, element_id LIMIT 500")
def exact_sample(spark, sf_dir):
    return order.exact_sample(events(spark, sf_dir), "element_id", 500).select(F.col("element_id").alias("event_id"))


@query(
    f"""WITH g AS (SELECT p_partkey::VARCHAR AS p_partkey, p_retailprice AS price, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS size, CASE WHEN p_type = 'ECONOMY' THEN 1.0 WHEN p_type = 'STANDARD' THEN 0.0 END::DOUBLE AS economy FROM part),
 i AS (SELECT p_partkey, price, coalesce(size, avg(size) OVER ()) AS size, coalesce(economy, avg(economy) OVER ()) AS economy FROM g),
 m AS (SELECT *, min(size) OVER () AS s0, max(size) OVER () AS s1, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS o, count(*) OVER () AS total FROM i)
SELECT p_partkey, price, round((size - s0) / (s1 - s0), 6) AS size, round(economy, 6) AS economy, {SPLIT.format(held=100)} AS part FROM m"""
)
def clean_pipeline(spark, sf_dir):
    """Parts as messy text, cleaned, imputed, scaled and split."""
    key = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        key.cast("string").alias("p_partkey"), F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" USD")).alias("price"),
        F.when(key % 5 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" in"))).otherwise("--").alias("size"),
        F.when(F.col("p_type") == "ECONOMY", " Yes").when(F.col("p_type") == "STANDARD", "no").otherwise("?").alias("economy"), "p_name",
    )
    d = clean.pipeline(raw, "p_partkey", ["size"], ["economy"], "price", 100)
    return d.select("p_partkey", "price", F.round("size", 6).alias("size"), F.round("economy", 6).alias("economy"), "part")


@query("SELECT doc_id, doc_id::VARCHAR || '_' || lang AS uid FROM documents")
def extract_uid(spark, sf_dir):
    """What follows the first underscore in names such as src3_17_en.png."""
    name = F.concat(F.lit("images/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), "lang", F.lit(".png"))
    return table(spark, sf_dir, "documents").select("doc_id", uid(name).alias("uid"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id ELSE 0 END::INTEGER AS label FROM documents")
def label_prefix(spark, sf_dir):
    name = F.when(F.col("lang") == "en", F.concat(F.col("doc_id").cast("string"), F.lit("_x.png"))).otherwise(F.concat("source", F.lit("_x.png")))
    return table(spark, sf_dir, "documents").select("doc_id", label_prefix_(name).alias("label"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '([.]html|[.]htm)$')")
def filter_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(files.has_suffix(F.col("url"), (".html", ".htm"))).select("page_id")


@query("SELECT count(*) AS n FROM pages WHERE regexp_matches(lower(url), '([.]html)$') AND regexp_extract(url, '://[^/]*/([a-z]+)/', 1) IN ('en', 'de')")
def count_eligible(spark, sf_dir):
    """Pages of the wanted kind in a mapped language."""
    section = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    d = table(spark, sf_dir, "pages").filter(files.has_suffix(F.col("url"), (".html",)) & section.isin("en", "de"))
    return d.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, array_to_string(list_filter([event_id % 100 - 50, user_id, event_id % 7], lambda x: x > 0), ',') AS v FROM events")
def parse_ints(spark, sf_dir):
    text = F.concat((F.col("event_id") % 100 - 50).cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(" x,"), (F.col("event_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(positive_ints(text), lambda x: x.cast("string")), ",").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS v FROM events")
def safe_float(spark, sf_dir):
    """Numbers as text, every third of which is none."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit(" s"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", files.number_or_zero(text).alias("v"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, 0.0::DOUBLE AS absent FROM events")
def safe_json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.json_number_or_zero(F.col("props"), "k").alias("k"), files.json_number_or_zero(F.col("props"), "absent").alias("absent"))


@query("SELECT event_id, round(value * 1000, 3) AS ms, round(value * 1000000, 3) AS us, round(value * 1000000000, 3) AS ns, round(value / 3600, 9) AS hr FROM events")
def time_units(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", *[F.round(in_unit(v, u), 9 if u == "hr" else 3).alias(u) for u in ("ms", "us", "ns", "hr")])


@query("SELECT event_type AS name, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)")
def dense_class_index(spark, sf_dir):
    return files.dense_index(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type AS name, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)")
def mapping_from_lines(spark, sf_dir):
    """The same from a list of one name a line, written and read back."""
    path = new_path(spark, "labels")
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    names.agg(F.array_join(F.array_sort(F.collect_set("event_type")), "\n").alias("value")).write.text(path)
    return files.label_list(spark, path)


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def combine_last_wins(spark, sf_dir):
    """Each customer's last order."""
    d = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_totalprice")
    return files.last_wins(d, "o_custkey", "at")
