"""Top-k under a budget of scorer calls: the anytime answer of a bandit over the cluster index.

Elements lie in leaves in a fixed draw order. Each round the controller, which holds a few numbers for each leaf, decides how
many elements to draw from which leaves; Spark fetches and scores them, keeps the k best so far, and sums up each leaf's
scores. Only k rows and a few rows a leaf come back, however large the round. A round's choices can't see its own scores,
so rounds begin small and grow, the first one of a learning policy touches every leaf it can, and UCB counts what a
round has already given a leaf as drawn. `tree.store` lays members out by leaf and draw order, so that a round reads
the row groups of its ranges instead of the whole table.

Policies: `uniform` (a random child at every level), `scan` (leaves in order), `ucb` (the highest mean plus bonus at every
level), `epsgreedy` (at every level a random child with probability eps, else the child of the highest expected
marginal gain). Under epsgreedy two fallbacks are tested at set times: flatten the tree when greedy descent misses the
best leaf; go over to uniform draws when the average gain is no less than the greedy one.
Sampling: `noreplace`, `scan` (same, in the given order), `reversescan` (the root's children in reverse), `replace`,
`sortedscan` (the first k drawn are the answer).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.histogram import Histogram
from rankwell.sources.shared import cut


KINDS = ("epsgreedy", "ucb", "uniform", "scan")
SAMPLES = ("noreplace", "scan", "reversescan", "replace", "sortedscan")
#: Growth of the rounds; draws from each leaf in the first round of a learning policy, and the share of the budget it may take.
GROWTH, TOUCH, TOUCH_SHARE = 1.3, 10, 0.2
#: Ranges of leaves that stand in a filter, which Parquet's row group statistics can use; more are joined.
RANGES = 200


@dataclass(frozen=True)
class Policy:
    kind: str = "epsgreedy"
    sample: str = "noreplace"
    alpha: float = 0.5
    bins: int = 8
    low: float = 0.0
    high: float = 1.0
    decay: float = 1.0
    enlarge: float = 1.1
    enlarge_lowest: bool = True
    subtract: bool = True
    c: float = 1.0
    init: float = 1.0
    count: str = "parent"
    gain_mode: str = "tail_mean"
    fallback: bool = True
    first_check: float = 0.3
    check_every: float = 0.01

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown policy {self.kind!r}; there are {KINDS}")
        if self.sample not in SAMPLES:
            raise ValueError(f"unknown sampling {self.sample!r}; there are {SAMPLES}")


@dataclass
class Node:
    """A node of the tree with what the policies know about it."""

    number: int
    children: list[Node] = field(default_factory=list)
    size: int = 0
    drawn: int = 0
    mean: float = 0.0
    count: float = 0.0
    histogram: Histogram | None = None

    @property
    def remaining(self) -> int:
        return sum(c.remaining for c in self.children) if self.children else self.size - self.drawn

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def tree(rows: list[tuple[int, int | None, int, int]], policy: Policy) -> Node:
    """The tree of (node_id, parent_id, ordinal, size) rows."""
    nodes = {r[0]: Node(r[0], size=r[3] or 0, mean=policy.init, count=0.0) for r in rows}
    root = None
    for number, parent, _, _ in sorted(rows, key=lambda r: r[2]):
        if parent is None:
            root = nodes[number]
        else:
            nodes[parent].children.append(nodes[number])
    if root is not None and not root.children:  # a flat index
        nodes[-1] = Node(-1, [root], mean=policy.init)
        root = nodes[-1]
    for x in nodes.values():
        if policy.kind == "epsgreedy":
            x.histogram = Histogram(0.0 if x.children else policy.low, policy.high, policy.bins, policy.decay, policy.enlarge, policy.enlarge_lowest)
    return root


class Controller:
    """The choice of leaves. Randomness is seeded."""

    def __init__(self, root: Node, policy: Policy, total: int, seed: int):
        self.root, self.policy, self.total = root, policy, total
        self.rng = np.random.default_rng(seed)
        self.next_check = int(total * policy.first_check)
        self.flat = self.uniform = False
        self.fallback_itr = -1

    def gain(self, node: Node, s: float) -> float:
        return node.histogram.gain(s, self.policy.gain_mode)

    def choose(self, node: Node, itr: int, s: float, taken: dict[int, int], greedy: bool = False) -> Node:
        """One leaf with something left, from the root down."""
        kind = "uniform" if self.uniform else self.policy.kind
        left = lambda x: x.remaining - sum(taken.get(y.number, 0) for y in x.leaves())
        while node.children:
            open_ = [c for c in node.children if left(c) > 0]
            if kind == "scan":
                node = open_[0]
            elif kind == "ucb":
                pending = lambda x: x.count + sum(taken.get(y.number, 0) for y in x.leaves())
                bonus = lambda c, node=node: self.policy.c * math.sqrt(math.log(max(itr, 2)) / max(1e-3, pending(node if self.policy.count == "parent" else c)))
                node = max(open_, key=lambda c: c.mean + bonus(c))
            elif kind == "epsgreedy" and (greedy or self.rng.random() > self.policy.alpha * max(itr, 1e-9) ** (-1 / 3) * 25 ** (1 / 3)):
                gains = [self.gain(c, s) for c in open_]
                best = [c for c, g in zip(open_, gains) if g == max(gains)]
                node = best[self.rng.integers(len(best))]
            else:
                node = open_[self.rng.integers(len(open_))]
        return node

    def touch(self, n: int) -> dict[int, int]:
        """A first round of n draws: the same number from every leaf, one from as many as possible if n is too small."""
        leaves = self.root.leaves()
        each = n // len(leaves)
        if each == 0:
            leaves, each = [leaves[i] for i in self.rng.permutation(len(leaves))[:n]], 1
        return {x.number: min(each, x.remaining) for x in leaves if x.remaining > 0}

    def allot(self, n: int, arms: int, itr: int, s: float, batch: int | None = None) -> dict[int, int]:
        """How many elements to draw from which leaves: `arms` choices of n / arms elements each, or choices of `batch` elements."""
        taken: dict[int, int] = {}
        n = min(n, self.root.remaining)
        part = batch or max(1, math.ceil(n / arms))
        while (short := n - sum(taken.values())) > 0:
            leaf = self.choose(self.root, itr, s, taken)
            taken[leaf.number] = taken.get(leaf.number, 0) + min(part, short, leaf.remaining - taken.get(leaf.number, 0))
        return taken

    def check(self, itr: int, n: int, s: float) -> None:
        """The two fallbacks."""
        if self.policy.kind != "epsgreedy" or not self.policy.fallback or self.uniform or itr + n <= self.next_check:
            return
        self.next_check += max(1, int(self.total * self.policy.check_every))
        leaves = [x for x in self.root.leaves() if x.remaining > 0]
        if not leaves:
            return
        gains = [self.gain(x, s) for x in leaves]
        if not self.flat and max(gains) > self.gain(self.choose(self.root, itr, s, {}, greedy=True), s):
            self.root.children, self.flat = leaves, True
        left = [x.remaining for x in leaves]
        if np.average(gains, weights=left) >= max(gains):
            self.uniform, self.fallback_itr = True, itr

    def learn(self, stats: dict[int, dict], s: float) -> None:
        """Take in what a round saw of each leaf: n, total, top, and counts over the borders asked for."""

        def walk(node: Node) -> tuple[float, float, float, list[dict]]:
            if node.children:
                got = [walk(c) for c in node.children]
                n, total, top, seen = sum(g[0] for g in got), sum(g[1] for g in got), max(g[2] for g in got), [x for g in got for x in g[3]]
            else:
                x = stats.get(node.number)
                n, total, top, seen = (x["n"], x["total"], x["top"], [x]) if x else (0, 0.0, -math.inf, [])
            if n:
                node.mean = (node.mean * node.count + total) / (node.count + n)
                node.count += n
                if node.histogram is not None:
                    for x in seen:
                        for low, high, c in x["bins"]:
                            node.histogram.add_range(low, high, c, s)
            return n, total, top, seen

        walk(self.root)

    def prune(self) -> None:
        """Drop leaves with nothing left, and nodes without children; ancestors forget what the leaf's histogram holds."""

        def walk(node: Node, above: list[Node]) -> bool:
            if not node.children:
                if node.remaining > 0:
                    return True
                if self.policy.subtract and node.histogram is not None:
                    for a in above:
                        a.histogram.subtract(node.histogram)
                return False
            node.children = [c for c in node.children if walk(c, [*above, node])]
            return bool(node.children)

        walk(self.root, [])


def round_sizes(budget: int, rounds: int, least: int = 1) -> list[int]:
    """Sizes of the rounds, each larger than the one before, the first at least `least`; together the budget."""
    first = max(least, budget * (GROWTH - 1) / (GROWTH**rounds - 1)) if rounds > 1 else budget
    sizes, left = [], budget
    for i in range(rounds):
        n = left if i == rounds - 1 else min(left, math.ceil(first if i == 0 else (left / sum(GROWTH**j for j in range(rounds - i)))))
        if n > 0:
            sizes.append(n)
        left -= n
    return sizes


def budgeted_top_k(
    elements: DataFrame, nodes: DataFrame, score: Column | Callable[[DataFrame], DataFrame], k: int, budget: int | None = None, seconds: float | None = None,
    policy: Policy = Policy(), rounds: int = 10, arms: int = 4, seed: int = 42, batch: int | None = None,
) -> tuple[DataFrame, list[dict], dict]:
    """The answer (element_id, score), a trace row a round, and what was spent.

    `elements` has leaf_id, ord (from 1 within the leaf), element_id and what `score` needs: a Column, or a function that
    adds a column `score`. At most `budget` elements are scored, in `rounds` rounds, and no round starts after `seconds`.
    A choice of a leaf is for `batch` elements, else a round's share for one of `arms`. A trace row has itr, stk, kls,
    elapsed and the answer (element_id, score) of that time. Spent: one_time seconds, and seconds an element of algo, pq,
    scorer and other.
    """
    started = time.perf_counter()
    rows = [(r["node_id"], r["parent_id"], r["ordinal"], r["size"]) for r in nodes.select("node_id", "parent_id", "ordinal", F.when(F.col("is_leaf"), F.col("size")).alias("size")).collect()]
    root = tree(rows, policy)
    if policy.sample == "reversescan":
        root.children.reverse()
    total = root.remaining
    control = Controller(root, policy, total, seed)
    budget = total if budget is None else min(budget, total) if policy.sample != "replace" else budget
    spark = elements.sparkSession
    schema = "element_id " + dict(elements.dtypes)["element_id"] + ", score double"
    best: list[tuple] = []
    itr, s, trace, spent = 0, 0.0, [], {"algo": 0.0, "pq": 0.0, "scorer": 0.0}
    learns = policy.kind in ("epsgreedy", "ucb") and rounds > 1 and arms > 1
    least = min(TOUCH * len(root.leaves()), math.ceil(TOUCH_SHARE * budget)) if learns and root.children else 1
    sizes = round_sizes(budget, rounds, max(1, least))
    one_time = time.perf_counter() - started
    while itr < budget and control.root.children and control.root.remaining > 0 and (seconds is None or time.perf_counter() - started < seconds):
        at = time.perf_counter()
        n = min(sizes.pop(0) if sizes else budget - itr, budget - itr)
        control.check(itr, n, s)
        taken = control.touch(n) if learns and itr == 0 else control.allot(n, arms, itr, s, batch)
        leaves = {x.number: x for x in control.root.leaves()}
        at = _passed(spent, "algo", at)
        drawn = _draw(elements, taken, leaves, policy, control.rng)
        scored = cut(_score(drawn, score).select("leaf_id", "ord", "element_id", F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0)).alias("score")))
        at = _passed(spent, "scorer", at)
        best = _merge(best, scored, k, policy.sample)
        s = 0.0 if len(best) < k else min(r[1] for r in best)
        at = _passed(spent, "pq", at)
        stats = _stats(scored, policy.bins)
        if policy.sample != "replace":
            for number, m in taken.items():
                leaves[number].drawn += m
        itr += sum(taken.values())
        control.learn(stats, s)
        control.prune()
        _passed(spent, "algo", at)
        trace.append({"itr": itr, "stk": float(sum(r[1] for r in best)), "kls": s, "elapsed": time.perf_counter() - started, "answer": best})
    spent["other"] = max(0.0, time.perf_counter() - started - one_time - sum(spent.values()))
    spent = {name: x / max(1, itr) for name, x in spent.items()} | {"one_time": one_time, "fallback_switch_itr": control.fallback_itr}
    return spark.createDataFrame(best, schema), trace, spent


def _passed(spent: dict, part: str, since: float) -> float:
    """Add the seconds since then to a part; the time now."""
    now = time.perf_counter()
    spent[part] += now - since
    return now


def _draw(elements: DataFrame, taken: dict[int, int], leaves: dict[int, Node], policy: Policy, rng: np.random.Generator) -> DataFrame:
    """The elements of this round: a range of each chosen leaf's order, or random places of it."""
    spark = elements.sparkSession
    if policy.sample == "replace":
        chosen = spark.createDataFrame([(leaf, m, leaves[leaf].size) for leaf, m in taken.items()], "leaf_id int, m bigint, size bigint")
        draws = chosen.select("leaf_id", "size", F.explode(F.sequence(F.lit(1), "m")).alias("i"))
        place = F.pmod(F.xxhash64("leaf_id", "i", F.lit(int(rng.integers(1 << 62)))), F.col("size")) + 1
        return elements.join(draws.select("leaf_id", place.cast("bigint").alias("ord")), ["leaf_id", "ord"])
    ranges = [(leaf, leaves[leaf].drawn, leaves[leaf].drawn + m) for leaf, m in taken.items()]
    if len(ranges) <= RANGES:
        held = reduce(Column.__or__, [(F.col("leaf_id") == leaf) & (F.col("ord") > after) & (F.col("ord") <= until) for leaf, after, until in ranges])
        drawn = elements.filter(held)
    else:
        chosen = spark.createDataFrame(ranges, "leaf_id int, after bigint, until bigint")
        drawn = elements.join(chosen, "leaf_id").filter("ord > after and ord <= until").drop("after", "until")
    # few row groups hold the ranges, but every core should score
    return drawn.repartition(spark.sparkContext.defaultParallelism)


def _score(batch: DataFrame, score: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    return batch.withColumn("score", score) if isinstance(score, Column) else score(batch)


def _merge(best: list[tuple], scored: DataFrame, k: int, sample: str) -> list[tuple]:
    """The k best (element_id, score) of before and now, each element once; under `sortedscan` the first k that came. At most k rows come from Spark."""
    if sample == "sortedscan":
        return best + [tuple(r) for r in scored.orderBy("leaf_id", "ord").select("element_id", "score").limit(max(0, k - len(best))).collect()]
    now = scored.select("element_id", "score")
    now = now.distinct() if sample == "replace" else now
    both = dict(best) | dict(map(tuple, now.orderBy(F.desc("score"), F.asc("element_id")).limit(k).collect()))
    return sorted(both.items(), key=lambda r: (-r[1], r[0]))[:k]


def _stats(scored: DataFrame, bins: int) -> dict[int, dict]:
    """For each leaf of the round its number, sum and largest of scores, and their counts over `bins` equal bins of its own range."""
    leaf = scored.groupBy("leaf_id").agg(F.min("score").alias("low"), F.max("score").alias("top"))
    width = (F.col("top") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((F.col("score") - F.col("low")) / width) - 1))).otherwise(F.lit(0))
    d = scored.join(leaf, "leaf_id").select("leaf_id", "low", "top", place.alias("bin"), "score", width.alias("width"))
    counts = d.groupBy("leaf_id", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("score").alias("sum"), F.first("low").alias("low"), F.first("top").alias("top"), F.first("width").alias("width"))
    out: dict[int, dict] = {}
    for r in sorted(counts.collect()):
        own = out.setdefault(r["leaf_id"], {"n": 0, "total": 0.0, "top": r["top"], "bins": []})
        own["n"] += r["c"]
        own["total"] += r["sum"]
        own["bins"].append((r["low"] + r["bin"] * r["width"], min(r["top"], r["low"] + (r["bin"] + 1) * r["width"]), r["c"]))
    return out


def anytime_quality(trace: list[dict], exact: float) -> list[dict]:
    """Trace rows with the share of the exact answer's sum of scores."""
    return [t | {"stk_share": t["stk"] / exact if exact else 1.0} for t in trace]
