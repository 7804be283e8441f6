"""Operators over small fixtures with ties, nulls and empty tables."""

from __future__ import annotations

import io
import json
import tarfile
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.columns import relu
from rankwell.operators import bandit, clean, exact, experiment, order, scoring, tree
from rankwell.operators.bandit import Policy, budgeted_top_k, round_sizes
from rankwell.sources import files
from rankwell.streaming.anytime import StreamingTopK

TIED = [(1, 5.0, "a"), (2, 7.0, "a"), (3, 5.0, "b"), (4, 5.0, "b"), (5, 1.0, "c"), (6, 9.0, "c"), (7, None, "c"), (8, float("nan"), "a")]


@pytest.fixture(scope="module")
def elements(spark):
    d = spark.createDataFrame(TIED, "id long, value double, leaf string")
    return exact.scored(d, "id", F.col("value")).join(d.select(F.col("id").alias("element_id"), "leaf"), "element_id")


def test_ties_go_both_ways(elements):
    assert [r.element_id for r in exact.top_k(elements, 3).collect()] == [6, 2, 4]
    assert [r.element_id for r in exact.top_k(elements, 3, "small").collect()] == [6, 2, 1]
    assert exact.top_k(elements, 100).count() == 6


def test_rankings(elements, spark):
    ranks = {r.element_id: r["rank"] for r in exact.rankings(elements.filter("score is not null")).collect()}
    assert ranks == {6: 1, 2: 2, 4: 3, 3: 4, 1: 5, 5: 6}
    assert exact.rankings(elements.limit(0)).count() == 0


def test_group_metrics(elements):
    rows = {r.leaf: (r.stk, r.kls) for r in exact.stk_kls(elements.filter("score is not null"), ["leaf"], 2).collect()}
    assert rows == {"a": (12.0, 5.0), "b": (10.0, 5.0), "c": (10.0, 1.0)}
    few = {r.leaf: r.kls for r in exact.stk_kls(elements.filter("score is not null"), ["leaf"], 3).collect()}
    assert few == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_quality_of_an_answer(elements, spark):
    truth, ranks = exact.top_k(elements, 3), exact.rankings(elements.filter("score is not null"))
    found = exact.top_k(elements, 3, "small")
    assert exact.precision_recall(found, truth, 3).first() == (2 / 3, 2 / 3)
    r = exact.avg_worst_rank(found, ranks, 3, 6).first()
    assert (r.avg_rank, r.worst_rank) == ((1 + 2 + 5) / 3, 5)
    none = exact.avg_worst_rank(found.limit(0), ranks, 3, 6).first()
    assert (none.avg_rank, none.worst_rank) == (6.0, 6)


def test_numbered(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    rows = order.numbered(d, [F.asc("x")]).collect()
    assert all(r.rn == r.x + 1 for r in rows)
    for g in (None, 1, 2):
        own = sorted((r.x, r.rn) for r in order.numbered(d, [F.asc("x")], ["g"]).collect() if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_samples(spark):
    d = spark.range(100).withColumnRenamed("id", "element_id")
    assert order.exact_sample(d, "element_id", 10).count() == 10 and order.exact_sample(d, "element_id", 1000).count() == 100 and order.exact_sample(d, "element_id", -1).count() == 0
    parts = {r.part: r["count"] for r in order.shuffle_split(d, "element_id", 10).groupBy("part").count().collect()}
    assert parts == {"val": 10, "train": 60, "test": 30}


def test_cleaning(spark):
    raw = spark.createDataFrame([("1", "70 in", "yes", "3.5 USD", "z"), ("2", "--", "no", "4", "z"), ("3", "90", "?", "x", "z")], "id string, size string, new string, price string, junk string")
    d = {r.id: r for r in clean.pipeline(raw, "id", ["size", "absent"], ["new"], "price", 1).collect()}
    assert {k: v["size"] for k, v in d.items()} == {"1": 0.0, "2": 0.5, "3": 1.0} and d["3"].new == 0.5 and d["3"].price is None and "junk" not in d["1"].asDict()
    flat = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    assert clean.minmax(flat, ["a", "b"]).collect() == [(0.0, None), (0.0, None)]
    assert clean.modes(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), ["v"]).first()["mode"] == "a"
    assert [tuple(r) for r in clean.null_counts(flat, 1).collect()] == [("b", 2)]


def test_index_document_round_trip(spark, tmp_path):
    doc = {"children": [{"children": ["a", "b"], "centroid": [1.0]}, {"children": [{"children": ["c"]}, {"children": []}]}]}
    nodes, members = files.import_index(spark, doc)
    assert files.export_index(nodes, members) == doc
    assert {r.path for r in tree.paths(nodes).collect()} == {"", "0", "1", "1.0", "1.1"}
    (tmp_path / "leaf.csv").write_text("id,x\nq,1\nr,2\n")
    (tmp_path / "i.json").write_text(json.dumps({"children": [{"children": str(tmp_path / "leaf.csv")}]}))
    _, members = files.read_index(spark, str(tmp_path / "i.json"))
    assert [r.element_id for r in members.orderBy("ord").collect()] == ["q", "r"]


def test_archives_and_labels(spark, tmp_path):
    def tar(entries):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as t:
            for name, data in entries.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return buf.getvalue()

    (tmp_path / "all.tar").write_bytes(tar({"n01.tar": tar({"n01_1.JPEG": b"x", "readme": b"-"}), "n02.tar": tar({"d/n02_9.png": b"yy"}), "note.txt": b"n"}))
    rows = files.nested_archive(spark, str(tmp_path / "all.tar")).collect()
    assert {(r.class_name, r.name, bytes(r.content)) for r in rows} == {("n01", "n01_1.JPEG", b"x"), ("n02", "n02_9.png", b"yy")}
    (tmp_path / "c.txt").write_text("zeta\nalpha\n")
    (tmp_path / "c.json").write_text('{"zeta": 3}')
    assert {tuple(r) for r in files.label_list(spark, str(tmp_path / "c.txt")).collect()} == {("zeta", 0), ("alpha", 1)}
    assert [tuple(r) for r in files.label_list(spark, str(tmp_path / "c.json")).collect()] == [("zeta", 3)]
    (tmp_path / "img").mkdir()
    for n in ("a.PNG", "b.txt"):
        (tmp_path / "img" / n).write_bytes(b"p")
    assert [r.element_id for r in files.images(spark, str(tmp_path / "img")).collect()] == ["a.PNG"]


def test_average_linkage():
    merges = tree.average_linkage(np.array([[0.0], [1.0], [10.0], [12.0]]))
    assert [(a, b, s) for a, b, _, s in merges] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)]
    assert [h for _, _, h, _ in merges] == pytest.approx([1.0, 2.0, 10.5])


def test_cluster_index(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 3), 0.1, 4)]) for i in range(90)]
    nodes, members = tree.build_index(spark.createDataFrame(rows, "id long, v array<float>"), "id", F.col("v"), 3, 60)
    got = members.collect()
    assert len(got) == 90 and len({(r.leaf_id, r.element_id % 3) for r in got}) == 3
    assert nodes.filter("is_leaf").agg(F.sum("size")).first()[0] == 90 and nodes.count() == 5


@pytest.fixture(scope="module")
def indexed(spark):
    d = spark.range(600).select("id", (F.col("id") % 4).alias("leaf"), F.when(F.col("id") % 4 == 2, 50.0).otherwise(1.0).alias("base"))
    d = d.select(F.col("id").alias("element_id"), (F.col("leaf") + 10).cast("int").alias("leaf_id"), (F.col("base") + F.col("id") % 7).alias("value"))
    members = order.draw_order(d, "element_id", ["leaf_id"]).cache()
    rows = [(0, None, 0, False, 0), (1, 0, 0, False, 0), (2, 0, 1, False, 0)] + [(10 + k, 1 + k // 2, k % 2, True, 150) for k in range(4)]
    return members, spark.createDataFrame(rows, "node_id int, parent_id int, ordinal int, is_leaf boolean, size bigint")


@pytest.mark.parametrize("kind", ["epsgreedy", "ucb", "uniform", "scan"])
def test_whole_budget_is_exact(indexed, kind):
    members, nodes = indexed
    found, trace, spent = budgeted_top_k(members, nodes, relu(F.col("value")), 20, policy=Policy(kind), rounds=3)
    want = members.select("element_id", F.col("value").alias("score")).orderBy(F.desc("score"), "element_id").limit(20).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    assert trace[-1]["itr"] == 600 and [t["stk"] for t in trace] == sorted(t["stk"] for t in trace)


def test_budget_is_kept_and_learning_helps(indexed, spark):
    members, nodes = indexed
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b.assign(score=b["value"])

    scorer = lambda d: d.mapInPandas(count, T.StructType([*d.schema.fields, T.StructField("score", T.DoubleType())]))
    found, trace, _ = budgeted_top_k(members, nodes, scorer, 20, 120, policy=Policy("epsgreedy", high=60.0), rounds=6, arms=4, seed=1)
    assert calls.value == trace[-1]["itr"] == 120 and found.count() == 20
    assert trace[-1]["kls"] > 40
    again = budgeted_top_k(members, nodes, relu(F.col("value")), 20, 120, policy=Policy("epsgreedy", high=60.0), rounds=6, arms=4, seed=1)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_other_draws(indexed, spark):
    members, nodes = indexed
    found = budgeted_top_k(members, nodes, relu(F.col("value")), 5, 100, policy=Policy("uniform", "replace"), rounds=1)[0].collect()
    assert len({r.element_id for r in found}) == 5
    empty = budgeted_top_k(members, nodes, relu(F.col("value")), 5, seconds=0.0)[0]
    assert empty.count() == 0
    flat = spark.createDataFrame([(10, None, 0, True, 150)], nodes.schema)
    assert budgeted_top_k(members, flat, relu(F.col("value")), 5, policy=Policy("uniform"), rounds=2)[1][-1]["itr"] == 150


def test_scorers(spark):
    d = spark.createDataFrame([(1, -2.0), (2, 3.0)], "element_id long, value double")
    for s in (scoring.scorer("relu", value="value"), scoring.scorer("relu", value="value", delay=1e-6), scoring.scorer("batch", columns=["value"], load=lambda: lambda b: b["value"].clip(lower=0))):
        assert [r.score for r in s(d).orderBy("element_id").collect()] == [0.0, 3.0]
    with pytest.raises(ValueError):
        scoring.scorer("unknown")


def test_reports(spark):
    rows = [("r", 0, i, float(i), 1.0, i / 2) for i in range(1, 4)] + [("r", 1, i, 3.0 * i, 1.0, i / 2) for i in range(1, 3)]
    trace = spark.createDataFrame(rows, experiment.TRACE)
    assert [tuple(x) for x in experiment.aggregate_reps(trace, ["stk"]).orderBy("itr").collect()] == [("r", 1, 2.0), ("r", 2, 4.0)]
    last = experiment.total_latency(trace.filter("rep = 0"), F.lit(1.0), "ms").first()
    assert (last.build, last.run_time, last.total) == (1000.0, 1500.0, 2500.0)
    two = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 2.0)], "name string, n int, v double")
    assert {tuple(r) for r in files.last_wins(two, "name", "n").collect()} == {("a", 5.0), ("b", 2.0)}


def test_streaming_top_k(spark, tmp_path):
    for i in range(3):
        spark.range(i * 50, i * 50 + 50).select(F.col("id").alias("element_id"), (F.col("id") * 37 % 101).cast("double").alias("score")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    top = StreamingTopK(spark, "element_id long, score double", 7, f"file://{tmp_path}/state")
    stream = spark.readStream.schema("element_id long, score double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = top.start(stream, f"file://{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    want = sorted(((i * 37 % 101, -i) for i in range(150)), reverse=True)[:7]
    assert [(r.score, -r.element_id) for r in top.answer().collect()] == want


@pytest.fixture(scope="module")
def normal_index(spark):
    from rankwell.sources.synthetic import normals

    elements, shape = normals(spark, 20, 1000, (0.0, 20.0), (0.0, 5.0), 7)
    members = tree.store(order.draw_order(elements, "element_id", ["leaf_id"]))
    nodes = tree.dendrogram(shape.select("cluster", "centroid")).withColumn("size", F.when(F.col("is_leaf"), 1000).otherwise(0).cast("bigint"))
    return members, nodes


def test_rounds_and_overheads(normal_index):
    members, nodes = normal_index
    found, trace, spent = budgeted_top_k(members, nodes, relu(F.col("value")), 50, 2000)
    assert [t["itr"] for t in trace] == list(accumulate(round_sizes(2000, 10, 200))) and trace[-1]["itr"] == 2000
    assert min(spent[x] for x in ("algo", "pq", "scorer", "other")) >= 0 and sorted(map(tuple, found.collect())) == sorted(trace[-1]["answer"])


def simulated(v, rows, policy, k, budget, seed):
    """The controller's choices with numpy in Spark's place: precision of the answer. `v` has a row of scores for each leaf."""
    root = bandit.tree(rows, policy)
    control = bandit.Controller(root, policy, v.size, seed)
    learns, best, itr, s = policy.kind != "uniform", np.empty(0), 0, 0.0
    for n in round_sizes(budget, 10, bandit.TOUCH * len(v) if learns else 1):
        control.check(itr, n, s)
        taken = control.touch(n) if learns and not itr else control.allot(n, 4, itr, s)
        leaves, stats = {x.number: x for x in control.root.leaves()}, {}
        for leaf, m in taken.items():
            x = v[leaf, leaves[leaf].drawn : leaves[leaf].drawn + m]
            leaves[leaf].drawn += m
            counts, edges = np.histogram(x, policy.bins, (x.min(), x.max()))
            stats[leaf] = {"n": m, "total": x.sum(), "top": x.max(), "bins": list(zip(edges, edges[1:], counts))}
            best = np.sort(np.concatenate([best, x]))[::-1][:k]
        s, itr = best[-1] if len(best) == k else 0.0, itr + sum(taken.values())
        control.learn(stats, s)
        control.prune()
    return (best >= np.sort(v, axis=None)[-k]).sum() / k


def test_learning_beats_uniform_draws():
    """A tenth of the calls on normals of different means, with the default rounds and arms, over five data sets."""
    share = {"uniform": 0.0, "epsgreedy": 0.0, "ucb": 0.0}
    for seed in (1, 2, 3, 7, 42):
        rng = np.random.default_rng(seed)
        mu, sd = rng.uniform(0, 20, 20), rng.uniform(0, 5, 20)
        v = np.maximum(0, rng.normal(mu[:, None], sd[:, None], (20, 2500)))
        inner = {20 + i: ab[:2] for i, ab in enumerate(tree.average_linkage(mu[:, None]))}
        rows = [(38, None, 0, 0)] + [(c, i, o, 2500 if c < 20 else 0) for i, ab in inner.items() for o, c in enumerate(ab)]
        for policy in (Policy("uniform"), Policy("epsgreedy"), Policy("ucb", count="child", init=10.0)):
            share[policy.kind] += simulated(v, rows, policy, 100, 5000, 1) / 5
    assert min(share["epsgreedy"], share["ucb"]) >= 2.5 * share["uniform"], share


def test_experiment_config(spark, normal_index, tmp_path):
    members, nodes = normal_index
    ranked, head = experiment.ground_truth(members, scoring.relu_scorer("value"), 20)
    experiment.write_ground_truth(ranked, head, f"file://{tmp_path}/gt")
    ranked, again = experiment.read_ground_truth(spark, f"file://{tmp_path}/gt")
    assert again["n"] == 20_000 and len(again["gt_solution"]) == 20 and set(again) == {"gt_solution", "n", "index_time"}
    base = {"scoring_params": {"type": "relu", "delay": 0}, "sampling_params": {"type": "synthetic"}, "budget": 400, "reps": 2, "k": 20, "index_params": {"file": "x"}, "batch_size": 10, "skip_scoring_fn": False, "fallback_params": {"enabled": False}}
    eps = {"type": "EpsGreedy", "alpha": 0.5, "min": 0, "max": 1.0, "num_bins": 8, "rebin_decay": 1.0, "enlarge_max_factor": 1.1, "enlarge_lowest": True, "subtract": True}
    configs = {"Eps": base | {"algo_params": eps, "sample_method": "noreplace"}, "Reverse": base | {"algo_params": {"type": "Scan"}, "sample_method": "reversescan", "skip_scoring_fn": True, "reps": 1}}
    (tmp_path / "c.json").write_text(json.dumps(configs))
    out = experiment.run_config(spark, f"file://{tmp_path}/c.json", lambda c: (members, nodes), lambda c: scoring.relu_scorer("value", c["scoring_params"]["delay"]), ranked, rounds=3)
    assert set(out["Eps"]) == {*experiment.METRICS, "overhead_one_time", "overhead_algo", "overhead_pq", "overhead_scorer", "overhead_other", "fallback_switch_itrs", "reps"}
    assert all(len(out[n][m]) == 400 for n in out for m in experiment.METRICS)
    assert out["Eps"]["STK"] == sorted(out["Eps"]["STK"]) and 0 <= out["Eps"]["Precision@K"][-1] <= 1
    with pytest.raises(ValueError):
        experiment.policy_of(base | {"algo_params": {"type": "Other"}, "sample_method": "scan"})
    with pytest.raises(ValueError):
        Policy("scan", "other")


def test_metrics_against_ranks(spark):
    ranked = spark.createDataFrame([(e, float(10 - r), r) for r, e in enumerate("abcdef", 1)], "element_id string, score double, rank long")
    trace = [{"itr": 1, "answer": [("b", 8.0)]}, {"itr": 3, "answer": [("a", 9.0), ("f", 4.0)]}, {"itr": 3, "answer": []}]
    got = experiment.with_metrics(trace, ranked, 2, 6)
    assert [(t["Precision@K"], t["AvgRank"], t["WorstRank"]) for t in got] == [(0.5, 4.0, 6), (0.5, 3.5, 6), (0.0, 6.0, 6)]


def test_batch_measurement(spark):
    def load():
        def model(b):
            if len(b) > 20:
                raise MemoryError("too large")
            return b["id"] * 2

        return model

    got = experiment.measure_batches(spark.range(100), load, [5, 20, 40], most=3)
    assert {(r.batch_size, r.status, r.n) for r in got.groupBy("batch_size", "status").agg(F.count("*").alias("n")).collect()} == {(5, "ok", 3), (20, "ok", 3), (40, "oom", 1)}
    assert experiment.latency_by_batch(got).count() == 2


def test_average_linkage_equals_plain_search():
    points = np.random.default_rng(4).random((40, 3))
    groups, got = {i: [i] for i in range(40)}, tree.average_linkage(points)
    for step, (a, b, height, size) in enumerate(got):
        mean = lambda x, y: np.mean([np.linalg.norm(points[i] - points[j]) for i in groups[x] for j in groups[y]])
        best = min(mean(x, y) for x in groups for y in groups if x < y)
        assert abs(best - height) < 1e-6 and abs(mean(a, b) - height) < 1e-6
        groups[40 + step] = groups.pop(a) + groups.pop(b)
        assert len(groups[40 + step]) == size
