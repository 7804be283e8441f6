"""Experiments: traces of repeated runs, their means, and the tables behind latency and quality reports."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.columns import in_unit
from rankwell.operators import exact
from rankwell.operators.bandit import Policy, budgeted_top_k
from rankwell.operators.scoring import Scorer

TRACE = "run string, rep int, itr bigint, stk double, kls double, elapsed double"
OVERHEADS = ["algo", "pq", "scorer", "other"]
#: Names of a configuration's policies and metrics, fixed values.
POLICIES = {"UniformExploration": "uniform", "UCB": "ucb", "EpsGreedy": "epsgreedy", "Scan": "scan"}
METRICS = ["STK", "KLS", "time", "Precision@K", "Recall@K", "AvgRank", "WorstRank"]


def traces(spark, runs: dict[tuple[str, int], list[dict]]) -> DataFrame:
    """The trace rows of runs (name, repetition)."""
    rows = [(name, rep, t["itr"], t["stk"], t["kls"], t["elapsed"]) for (name, rep), rows in runs.items() for t in rows]
    return spark.createDataFrame(rows, TRACE)


def aggregate_reps(trace: DataFrame, metrics: list[str]) -> DataFrame:
    """Means over repetitions by (run, itr), cut where the shortest repetition ends."""
    ends = trace.groupBy("run", "rep").agg(F.max("itr").alias("last")).groupBy("run").agg(F.min("last").alias("last"))
    kept = trace.join(ends, "run").filter("itr <= last")
    return kept.groupBy("run", "itr").agg(*[F.avg(m).alias(m) for m in metrics])


def overhead_means(overheads: DataFrame, parts: list[str] | None = None) -> DataFrame:
    return overheads.groupBy("run").agg(*[F.avg(p).alias(p) for p in parts or OVERHEADS])


def build_time(run: Column, tree_seconds: float, sorted_seconds: float) -> Column:
    """Seconds of building the index that a run needs: sorted scans a sorted index, flat samples none, others the tree."""
    return F.when(run.contains("Sorted"), sorted_seconds).when(run.contains("Uniform") | run.contains("Scan"), 0.0).otherwise(tree_seconds)


def total_latency(trace: DataFrame, build: Column, unit: str = "s") -> DataFrame:
    """Rows (run, build, run_time, total): index building plus the elapsed time of the last trace row."""
    last = trace.groupBy("run").agg(F.max_by("elapsed", "itr").alias("t"))
    return last.select("run", in_unit(build, unit).alias("build"), in_unit(F.col("t"), unit).alias("run_time"), in_unit(build + F.col("t"), unit).alias("total"))


def iter_latency(means: DataFrame, unit: str = "ms", scorer: bool = False) -> DataFrame:
    """Rows (run, part, latency) of the overheads of one iteration."""
    parts = [p for p in OVERHEADS if scorer or p != "scorer"]
    return means.unpivot(["run"], parts, "part", "latency").withColumn("latency", in_unit(F.col("latency"), unit))


def curve(trace: DataFrame, metric: str, x: str = "itr") -> DataFrame:
    """Rows (run, x, y) of a metric against iterations, seconds or hours."""
    axis = {"itr": F.col("itr").cast("double"), "s": F.col("elapsed"), "hr": in_unit(F.col("elapsed"), "hr")}[x]
    return trace.select("run", axis.alias("x"), F.col(metric).alias("y"))


def latency_by_batch(measured: DataFrame) -> DataFrame:
    """Rows (batch_size, n, ms_per_element, max_mb) of the measurements that went well."""
    return measured.filter("status = 'ok'").groupBy("batch_size").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ms") / F.col("batch_size")).alias("ms_per_element"), F.max("mb").alias("max_mb"))


def ok_measurements(measured: DataFrame) -> DataFrame:
    return measured.filter("status = 'ok'").orderBy("batch_size")


def ground_truth(elements: DataFrame, scorer: Scorer, k: int) -> tuple[DataFrame, dict]:
    """Scores and ranks of all elements (element_id, score, rank), and the document's small part: gt_solution, n, index_time."""
    started = time.perf_counter()
    ranked = exact.rankings(exact.scored(scorer(elements), "element_id", F.col("score")).filter("score is not null"))
    best = [r["element_id"] for r in ranked.orderBy("rank").limit(k).collect()]
    return ranked, {"gt_solution": best, "n": ranked.count(), "index_time": time.perf_counter() - started}


def write_ground_truth(ranked: DataFrame, head: dict, path: str) -> None:
    """The ground truth below a folder: `ranked` as Parquet, which stays a table however many elements there are, and the document's small part as JSON."""
    ranked.write.parquet(f"{path}/ranked")
    ranked.sparkSession.createDataFrame([(json.dumps(head, default=str),)], "value string").coalesce(1).write.text(f"{path}/head")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/ranked"), json.loads(spark.read.text(f"{path}/head").first()["value"])


def with_metrics(trace: list[dict], ranked: DataFrame, k: int, total: int) -> list[dict]:
    """Trace rows with Precision@K, Recall@K, AvgRank and WorstRank, all answers against the ranks in one job. Missing elements count as rank `total`."""
    kind = dict(ranked.dtypes)["element_id"]
    rows = [(n, e, s) for n, t in enumerate(trace) for e, s in t["answer"]]
    held = ranked.sparkSession.createDataFrame(rows, f"n int, element_id {kind}, score double")
    held = held.join(ranked.select("element_id", "rank"), "element_id", "left")
    last = F.max_by(F.coalesce("rank", F.lit(total)), F.struct(F.negate("score"), "element_id"))
    sums = held.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("rank") <= k).cast("long")).alias("hit"), F.sum(F.coalesce("rank", F.lit(total))).alias("ranks"), last.alias("last"))
    of = {r["n"]: r for r in sums.collect()}
    out = []
    for n, t in enumerate(trace):
        r = of.get(n)
        have, hit, ranks = (r["c"], r["hit"] or 0, r["ranks"]) if r else (0, 0, 0)
        worst = r["last"] if r and have >= k else total
        out.append(t | {"Precision@K": hit / k, "Recall@K": hit / k, "AvgRank": (ranks + (k - have) * total) / k, "WorstRank": worst})
    return out


def policy_of(config: dict) -> Policy:
    """The policy of an experiment's configuration."""
    algo, fallback = config["algo_params"], config.get("fallback_params", {})
    if algo["type"] not in POLICIES:
        raise ValueError(f"unknown algorithm {algo['type']!r}; there are {sorted(POLICIES)}")
    names = {"alpha": "alpha", "min": "low", "max": "high", "num_bins": "bins", "rebin_decay": "decay", "enlarge_max_factor": "enlarge", "enlarge_lowest": "enlarge_lowest", "subtract": "subtract", "c": "c", "init": "init"}
    given = {names[x]: v for x, v in algo.items() if x in names}
    given |= {"fallback": bool(fallback.get("enabled", False))}
    given |= {ours: fallback[theirs] for theirs, ours in (("initial_threshold", "first_check"), ("frequency", "check_every")) if theirs in fallback}
    return Policy(POLICIES[algo["type"]], config["sample_method"], **given)


def run_config(
    spark: SparkSession, configs: dict[str, dict] | str, index: Callable[[dict], tuple[DataFrame, DataFrame]], scorer: Callable[[dict], Scorer],
    ranked: DataFrame, rounds: int = 10, seed: int = 42,
) -> dict[str, dict]:
    """The aggregated results of a document of experiments, given as a dict or the path of its JSON.

    `index` opens members (with what the scorer needs) and nodes by index_params and sampling_params, `scorer` makes the
    scorer of scoring_params; with skip_scoring_fn the scores come from `ranked`, the ground truth's (element_id, score,
    rank). A whole budget is a number of calls, a fraction one of seconds. Metrics are means over repetitions, one value for
    each element up to where the shortest repetition ends, as a round's value holds for all its elements.
    """
    if isinstance(configs, str):
        configs = json.loads(spark.read.text(configs, wholetext=True).first()["value"])
    total, out = ranked.count(), {}
    for name, c in configs.items():
        members, nodes = index(c)
        policy, k = policy_of(c), c["k"]
        if c.get("skip_scoring_fn", False):
            known = ranked.select("element_id", F.col("score").alias("__known"))
            score = lambda d, known=known: d.join(known, "element_id").withColumnRenamed("__known", "score")
        else:
            score = scorer(c)
        calls = c["budget"] if isinstance(c["budget"], int) else None
        seconds = None if calls is not None else c["budget"]
        series, spent = defaultdict(list), defaultdict(list)
        for rep in range(c["reps"]):
            _, trace, used = budgeted_top_k(members, nodes, score, k, calls, seconds, policy, rounds, seed=seed + rep, batch=c["batch_size"])
            rows = with_metrics(trace, ranked, k, total)
            sizes = [t["itr"] - before for t, before in zip(rows, [0, *(t["itr"] for t in rows)])]
            for metric, key in zip(METRICS, ["stk", "kls", "elapsed", *METRICS[3:]]):
                series[metric].append([t[key] for t, n in zip(rows, sizes) for _ in range(n)])
            for part, x in used.items():
                spent[part].append(x)
        mean = lambda xs: sum(xs) / len(xs)
        out[name] = {m: [mean(x) for x in zip(*series[m])] for m in METRICS}
        out[name] |= {f"overhead_{p}": mean(spent[p]) for p in ("one_time", *OVERHEADS)}
        out[name] |= {"fallback_switch_itrs": spent["fallback_switch_itr"], "reps": c["reps"]}
    return out


def measure_batches(elements: DataFrame, load: Callable[[], Callable], sizes: list[int], most: int = 25) -> DataFrame:
    """Rows (batch_size, ms, mb, status, note): up to `most` batches of each size through a model, each size in one task.

    `load` returns what scores a pandas frame. ms is a batch's time, mb the largest memory of its process so far; a size
    that runs out of memory or fails has one row that says so, without numbers.
    """
    spark = elements.sparkSession
    need = max(sizes) * most
    d = elements.limit(need).withColumn("__size", F.explode(F.array(*map(F.lit, sizes))))

    def measure(key: tuple, frame):
        import resource

        import pandas as pd

        size, rows = int(key[0]), []
        frame = frame.drop(columns="__size")
        try:
            model = load()
            for at in range(0, min(len(frame), size * most), size):
                started = time.perf_counter()
                model(frame.iloc[at : at + size])
                rows.append((size, 1e3 * (time.perf_counter() - started), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "ok", ""))
        except MemoryError as e:
            rows = [(size, None, None, "oom", str(e))]
        except Exception as e:  # noqa: BLE001 - the measurement's result
            rows = [(size, None, None, "error", f"{type(e).__name__}: {e}")]
        return pd.DataFrame(rows, columns=["batch_size", "ms", "mb", "status", "note"])

    out = d.groupBy("__size").applyInPandas(measure, "batch_size int, ms double, mb double, status string, note string")
    return spark.createDataFrame(out.collect(), out.schema)  # at most `most` rows a size
