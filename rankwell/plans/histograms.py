"""Histograms of event scores by type, and the bandit's formulas over them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.functions import histogram as h
from rankwell.functions.columns import epsilon, relu, ucb
from rankwell.plans.base import SCORED, events, query, table

BINS, WIDTH, S_K = 8, 62.5, 100.0


@query(
    """WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_type, i, round(lo + (hi - lo) * (i / 8.0::DOUBLE), 6) AS border FROM m, (SELECT unnest(range(0, 9))::INTEGER AS i)"""
)
def hist_borders(spark, sf_dir):
    """Eight equal bins over each type's range."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = m.select("event_type", F.posexplode(h.borders(F.col("lo"), F.col("hi"), BINS)).alias("i", "border"))
    return d.select("event_type", "i", F.round("border", 6).alias("border"))


def counted(spark, sf_dir):
    """Rows (event_type, edges, counts): counts over eight bins of 62.5 from 0."""
    edges = F.array(*[F.lit(i * WIDTH) for i in range(BINS + 1)])
    d = events(spark, sf_dir).withColumn("bin", h.bin_of(F.col("score"), edges))
    sums = [F.sum((F.col("bin") == i).cast("double")) for i in range(BINS)]
    return d.groupBy("event_type").agg(F.array(*sums).alias("counts")).withColumn("edges", edges)


COUNTED = f"""
 b AS (SELECT event_type, least(7, greatest(0, ceil(score / 62.5)::BIGINT - 1)) AS bin FROM ({SCORED})),
 g AS (SELECT event_type, bin, count(*) AS c FROM b GROUP BY 1, 2),
 t AS (SELECT DISTINCT event_type FROM b),
 hc AS (SELECT t.event_type, r.i AS bin, coalesce(g.c, 0)::DOUBLE AS c, r.i * 62.5::DOUBLE AS lo, (r.i + 1) * 62.5::DOUBLE AS hi
  FROM t CROSS JOIN (SELECT unnest(range(0, 8)) AS i) r LEFT JOIN g ON g.event_type = t.event_type AND g.bin = r.i)"""


@query(f"WITH {COUNTED} SELECT event_type AS leaf, bin::INTEGER AS bin, c AS n FROM hc")
def hist_counts(spark, sf_dir):
    """Scores in each bin, borders belonging to the bin below."""
    return counted(spark, sf_dir).select(F.col("event_type").alias("leaf"), F.posexplode("counts").alias("bin", "n"))


GAIN = f"""{COUNTED},
 tot AS (SELECT event_type, sum(c) AS n FROM hc GROUP BY 1),
 gains AS (SELECT event_type, any_value(n) AS n, sum(CASE WHEN hi > 100 THEN c / n * ((hi - greatest(lo, 100)) / (hi - lo)) * ((greatest(lo, 100) + hi) / 2) ELSE 0 END) AS gain FROM hc JOIN tot USING (event_type) GROUP BY 1)"""


def gains(spark, sf_dir):
    d = counted(spark, sf_dir)
    n = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    return d.select("event_type", n.alias("n"), h.gain(F.col("edges"), F.col("counts"), F.lit(S_K)).alias("gain"))


@query(f"WITH {GAIN} SELECT event_type, round(gain, 6) AS gain FROM gains")
def hist_gain(spark, sf_dir):
    """Expected marginal gain over a threshold of 100."""
    return gains(spark, sf_dir).select("event_type", F.round("gain", 6).alias("gain"))


@query(
    f"""WITH {COUNTED},
 w AS (SELECT i AS bin, i * 100.0::DOUBLE AS nlo, (i + 1) * 100.0::DOUBLE AS nhi FROM (SELECT unnest(range(0, 8)) AS i)),
 k AS (SELECT unnest([1.0, 0.95])::DOUBLE AS decay)
SELECT event_type AS leaf, decay, w.bin::INTEGER AS bin, round(sum(c * greatest(0, least(hi, nhi) - greatest(lo, nlo)) / (hi - lo)) * decay, 6) AS n FROM hc, w, k GROUP BY 1, 2, 3"""
)
def hist_rebin(spark, sf_dir):
    """The counts over bins of 100, with and without decay."""
    new = F.array(*[F.lit(i * 100.0) for i in range(BINS + 1)])
    d = counted(spark, sf_dir)
    out = None
    for decay in (1.0, 0.95):
        part = d.select(F.col("event_type").alias("leaf"), F.lit(decay).alias("decay"), F.posexplode(h.rebin(F.col("edges"), F.col("counts"), new, decay)).alias("bin", "n"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("n", F.round("n", 6))


@query(f"WITH {COUNTED} SELECT bin::INTEGER AS bin, greatest(0, sum(c) - sum(c) FILTER (event_type = 'click'))::DOUBLE AS n FROM hc GROUP BY 1")
def hist_subtract(spark, sf_dir):
    """All scores' histogram without one leaf's."""
    d = counted(spark, sf_dir)
    total = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(BINS)])
    one = F.array(*[F.sum(F.when(F.col("event_type") == "click", F.get("counts", F.lit(i)))) for i in range(BINS)])
    return d.agg(h.subtract(total, one).alias("n")).select(F.posexplode("n").alias("bin", "n"))


@query(f"WITH {GAIN} SELECT round(max(gain), 6) AS gain FROM gains")
def greedy_gain(spark, sf_dir):
    return gains(spark, sf_dir).agg(F.round(F.max("gain"), 6).alias("gain"))


@query(f"WITH {GAIN} SELECT round(sum(gain * n) / sum(n), 6) AS gain FROM gains")
def average_gain(spark, sf_dir):
    """Gains weighted by what is left in each leaf."""
    return gains(spark, sf_dir).agg(F.round(F.sum(F.col("gain") * F.col("n")) / F.sum("n"), 6).alias("gain"))


def _gains_sql(by: str) -> str:
    """Gains of the histograms of each group, over a threshold of 100."""
    part = "(hi - greatest(lo, 100)) / (hi - lo) * ((greatest(lo, 100) + hi) / 2)"
    return f"""SELECT {by}, sum(CASE WHEN hi > 100 THEN c / n * ({part}) ELSE 0 END) AS gain FROM
 (SELECT {by}, c, sum(c) OVER (PARTITION BY {by}) AS n, bin * 62.5::DOUBLE AS lo, (bin + 1) * 62.5::DOUBLE AS hi FROM
  (SELECT {by}, least(7, greatest(0, ceil(greatest(0.0, value) / 62.5)::BIGINT - 1)) AS bin, count(*)::DOUBLE AS c FROM (SELECT *, hour(ts) AS hour FROM events) GROUP BY {by}, bin)) GROUP BY {by}"""


@query(
    f"""WITH types AS ({_gains_sql("event_type")}), leaves AS ({_gains_sql("event_type, hour")}),
 way AS (SELECT event_type FROM types ORDER BY gain DESC, event_type LIMIT 1)
SELECT max(gain) > max(gain) FILTER (event_type = (SELECT event_type FROM way)) AS flatten FROM leaves"""
)
def fallback1_condition(spark, sf_dir):
    """Whether the tree of types and hours would be flattened: greedy descent, by the types' histograms and then the hours', misses the leaf of the largest gain."""
    edges = F.array(*[F.lit(i * WIDTH) for i in range(BINS + 1)])
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), h.bin_of(relu(F.col("value")), edges).alias("bin"))
    leaves = e.groupBy("event_type", "hour").agg(F.array(*[F.sum((F.col("bin") == i).cast("double")) for i in range(BINS)]).alias("counts"))
    types = leaves.groupBy("event_type").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(BINS)]).alias("counts"))
    gain = h.gain(edges, F.col("counts"), F.lit(S_K)).alias("gain")
    way = types.select("event_type", gain).orderBy(F.desc("gain"), "event_type").limit(1).select("event_type", F.lit(True).alias("on_way"))
    d = leaves.select("event_type", gain).join(way, "event_type", "left")
    return d.agg((F.max("gain") > F.max(F.when(F.col("on_way"), F.col("gain")))).alias("flatten"))


@query(f"WITH {GAIN} SELECT sum(gain * n) / sum(n) >= max(gain) AS uniform FROM gains")
def fallback2_condition(spark, sf_dir):
    return gains(spark, sf_dir).agg((F.sum(F.col("gain") * F.col("n")) / F.sum("n") >= F.max("gain")).alias("uniform"))


@query("SELECT i AS check_no, floor(n * 0.3)::BIGINT + i * floor(n * 0.05)::BIGINT AS itr FROM (SELECT count(*) AS n FROM events), (SELECT unnest(range(0, 10)) AS i)")
def fallback_schedule(spark, sf_dir):
    """When the fallbacks are tested: first after 30 % of the elements, then every 5 %."""
    n = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    d = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return d.select(F.col("i").cast("long").alias("check_no"), (F.floor(F.col("n") * 0.3) + F.col("i") * F.floor(F.col("n") * 0.05)).cast("long").alias("itr"))


@query(f"SELECT event_type AS leaf, count(*) AS n, round(avg(score), 6) AS mean FROM ({SCORED}) GROUP BY 1")
def ucb_stats(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def _ucb(spark, sf_dir):
    d = events(spark, sf_dir).groupBy(F.col("event_type").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # one row a leaf
    return d.select("leaf", F.round(ucb(F.col("mean"), total, F.lit(1000)), 6).alias("ucb_parent"), F.round(ucb(F.col("mean"), F.col("n"), F.lit(1000), 50.0), 6).alias("ucb_child"))


UCB = f"""SELECT leaf, round(mean + sqrt(ln(1000) / sum(n) OVER ()), 6) AS ucb_parent, round(mean + 50.0 * sqrt(ln(1000) / n), 6) AS ucb_child
FROM (SELECT event_type AS leaf, count(*) AS n, avg(score) AS mean FROM ({SCORED}) GROUP BY 1)"""


@query(UCB)
def ucb_scores(spark, sf_dir):
    """Upper bounds with the parent's count, and with the child's."""
    return _ucb(spark, sf_dir)


@query(f"SELECT leaf, ucb_parent FROM ({UCB}) ORDER BY ucb_parent DESC, leaf LIMIT 1")
def ucb_choice(spark, sf_dir):
    return _ucb(spark, sf_dir).orderBy(F.desc("ucb_parent"), "leaf").limit(1).select("leaf", "ucb_parent")


@query("SELECT itr, alpha, round(alpha * pow(itr / 25.0::DOUBLE, -1.0::DOUBLE / 3), 6) AS eps FROM (SELECT DISTINCT user_id + 1 AS itr FROM events), (SELECT unnest([0.5, 3.0, 4.0])::DOUBLE AS alpha)")
def eps_schedule(spark, sf_dir):
    """The exploring share at as many iterations as there are users."""
    itr = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("itr")).distinct()
    d = itr.select("itr", F.explode(F.array(F.lit(0.5), F.lit(3.0), F.lit(4.0))).alias("alpha"))
    return d.select("itr", "alpha", F.round(epsilon(F.col("alpha"), F.col("itr")), 6).alias("eps"))
