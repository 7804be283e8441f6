"""Experiment reports, over traces that events stand in for: runs by type, repetitions by user, iterations by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import experiment as x
from rankwell.plans.base import query, table

TRACE = """
 t AS (SELECT event_type AS run, (user_id % 3)::INTEGER AS rep, (event_id // 50) % (20 + 5 * (user_id % 3)) + 1 AS itr, value FROM events),
 trace AS (SELECT run, rep, itr, avg(value) AS stk, min(value) AS kls, itr * 0.5::DOUBLE + max(value) / 1000 AS elapsed FROM t GROUP BY 1, 2, 3)"""


def trace(spark, sf_dir):
    """A trace whose repetitions end after 20, 25 and 30 iterations."""
    rep = (F.col("user_id") % 3).cast("int")
    itr = F.floor(F.col("event_id") / 50) % (20 + 5 * (F.col("user_id") % 3)) + 1
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), rep.alias("rep"), itr.cast("long").alias("itr"), "value")
    return d.groupBy("run", "rep", "itr").agg(F.avg("value").alias("stk"), F.min("value").alias("kls"), (F.col("itr") * 0.5 + F.max("value") / 1000).alias("elapsed"))


@query(
    f"""WITH {TRACE}, e AS (SELECT run, min(last) AS last FROM (SELECT run, rep, max(itr) AS last FROM trace GROUP BY 1, 2) GROUP BY 1)
SELECT run, itr, round(avg(stk), 6) AS stk, round(avg(kls), 6) AS kls, round(avg(elapsed), 6) AS elapsed FROM trace JOIN e USING (run) WHERE itr <= last GROUP BY 1, 2"""
)
def aggregate_reps(spark, sf_dir):
    d = x.aggregate_reps(trace(spark, sf_dir), ["stk", "kls", "elapsed"])
    return d.select("run", "itr", *[F.round(c, 6).alias(c) for c in ("stk", "kls", "elapsed")])


OVERHEADS = """
 o AS (SELECT event_type AS run, user_id % 3 AS rep, avg(value) AS algo, min(value) AS pq, max(value) AS scorer, avg(value) / 2 AS other FROM events GROUP BY 1, 2),
 means AS (SELECT run, avg(algo) AS algo, avg(pq) AS pq, avg(scorer) AS scorer, avg(other) AS other FROM o GROUP BY 1)"""


def overheads(spark, sf_dir):
    v = F.col("value")
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 3).alias("rep"))
    return d.agg(F.avg(v).alias("algo"), F.min(v).alias("pq"), F.max(v).alias("scorer"), (F.avg(v) / 2).alias("other"))


@query(f"WITH {OVERHEADS} SELECT run, round(algo, 6) AS algo, round(pq, 6) AS pq, round(scorer, 6) AS scorer, round(other, 6) AS other FROM means")
def overhead_means(spark, sf_dir):
    d = x.overhead_means(overheads(spark, sf_dir))
    return d.select("run", *[F.round(c, 6).alias(c) for c in x.OVERHEADS])


@query(
    f"""WITH {OVERHEADS} SELECT run, part, round(v * 1000, 4) AS latency FROM (
 SELECT run, 'algo' AS part, algo AS v FROM means UNION ALL SELECT run, 'pq', pq FROM means UNION ALL SELECT run, 'scorer', scorer FROM means UNION ALL SELECT run, 'other', other FROM means)"""
)
def iter_latency(spark, sf_dir):
    d = x.iter_latency(x.overhead_means(overheads(spark, sf_dir)), "ms", scorer=True)
    return d.withColumn("latency", F.round("latency", 4))


ALGORITHM = "CASE event_type WHEN 'error' THEN 'SortedIndexScan' WHEN 'click' THEN 'UniformSample' WHEN 'view' THEN 'ScanBestOrder' ELSE 'EpsGreedy-' || event_type END"
BUILD = "CASE WHEN run LIKE '%Sorted%' THEN 12.5 WHEN run LIKE '%Uniform%' OR run LIKE '%Scan%' THEN 0.0 ELSE 40.0 END::DOUBLE"


def _algorithm():
    t = F.col("event_type")
    return F.when(t == "error", "SortedIndexScan").when(t == "click", "UniformSample").when(t == "view", "ScanBestOrder").otherwise(F.concat(F.lit("EpsGreedy-"), t))


@query(f"SELECT run, {BUILD} AS seconds FROM (SELECT DISTINCT {ALGORITHM} AS run FROM events)")
def build_time_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(_algorithm().alias("run")).distinct()
    return d.select("run", x.build_time(F.col("run"), 40.0, 12.5).alias("seconds"))


@query(f"WITH {TRACE}, m AS (SELECT run, itr, max(elapsed) AS elapsed FROM trace GROUP BY 1, 2), l AS (SELECT run, arg_max(elapsed, itr) AS t FROM m GROUP BY 1) SELECT run, 5000.0::DOUBLE AS build, round(t * 1000, 3) AS run_time, round((5 + t) * 1000, 3) AS total FROM l")
def total_latency(spark, sf_dir):
    """Index building plus the time of the last iteration, in milliseconds."""
    d = trace(spark, sf_dir).groupBy("run", "itr").agg(F.max("elapsed").alias("elapsed"))
    out = x.total_latency(d, F.lit(5.0), "ms")
    return out.select("run", "build", F.round("run_time", 3).alias("run_time"), F.round("total", 3).alias("total"))


@query(f"WITH {TRACE} SELECT run, round(elapsed / 3600, 9) AS x, round(stk, 6) AS y FROM trace WHERE rep = 0")
def curve_points(spark, sf_dir):
    d = x.curve(trace(spark, sf_dir).filter("rep = 0"), "stk", "hr")
    return d.select("run", F.round("x", 9).alias("x"), F.round("y", 6).alias("y"))


MEASURED = """SELECT [25, 50, 100, 200, 400, 600, 800][event_id % 7 + 1]::INTEGER AS batch_size, value AS ms, user_id::DOUBLE AS mb, event_id,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'oom' ELSE 'ok' END AS status FROM events"""


def measured(spark, sf_dir):
    """Measurements of batch sizes that events stand in for."""
    sizes = F.array(*map(F.lit, (25, 50, 100, 200, 400, 600, 800)))
    t = F.col("event_type")
    status = F.when(t == "error", "error").when(t == "view", "oom").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.get(sizes, (F.col("event_id") % 7).cast("int")).alias("batch_size"), F.col("value").alias("ms"), F.col("user_id").cast("double").alias("mb"), "event_id", status.alias("status"))


@query(f"SELECT * FROM ({MEASURED}) WHERE status = 'ok'")
def ok_measurements(spark, sf_dir):
    return x.ok_measurements(measured(spark, sf_dir))


@query(f"SELECT batch_size, count(*) AS n, round(avg(ms / batch_size), 6) AS ms_per_element, max(mb) AS max_mb FROM ({MEASURED}) WHERE status = 'ok' GROUP BY 1")
def latency_by_batch(spark, sf_dir):
    d = x.latency_by_batch(measured(spark, sf_dir))
    return d.withColumn("ms_per_element", F.round("ms_per_element", 6))
