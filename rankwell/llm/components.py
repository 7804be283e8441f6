"""Connected components of a link table by alternating large-star and small-star steps, of few links within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut

#: Distinct links, of 16 bytes, up to which one task connects them.
FEW = 1 << 18


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour, or to itself if that is smaller."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these. In a link, a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    s = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(s), F.sum(s % 1_000_003)).first())


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest that each one's links reach: roots hook on smaller ones, then paths are halved."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (nearer := up[up]).tobytes() != up.tobytes():
            up = nearer
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches if len(b)]
    if links:
        found = smallest_reached(*(np.concatenate(x) for x in zip(*links)))
        yield pa.RecordBatch.from_arrays([*map(pa.array, found)], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node that has a link: the smallest node that links reach.

    `links` has long columns a and b; loops, repeats and nulls count for nothing. Every step is a shuffle with
    partial minima, and is written to the shared folder, so the plan stays flat and lost executors redo one step.
    At most FEW links are connected by one task instead, without a shuffle.
    """
    now = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= FEW:
        return cut(now.coalesce(1).mapInArrow(_connected, "node long, component long"))
    was = None
    while (is_ := _state(now)) != was:
        was = is_
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
