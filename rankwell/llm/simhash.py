"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ, and the linked components.

A fingerprint maps to the bit counts of its 2-bit segments. Flipping a bit moves one count by one, so the
Manhattan distance of two such vectors never exceeds the number of differing bits, and a Manhattan ball keeps
every link. With at most 4 differing bits, the counts of one of the two 32-bit halves are at most 2 apart;
two lattice points that far apart have a common point at most 1 from either. So each fingerprint goes into the grid
cells of its half's vector and of all vectors 1 away, once for each half, and every link shares a cell. Pairs in a
cell are then verified on the fingerprints.

A cell of over CELL members is split before it is gathered: with at most 4 differing bits, one of five blocks of the 64
bits is equal, so its members go into finer cells, one for each block, of equal block bits. Finer cells that are still too
large are split by five blocks of the bits not yet equal, and so on; every link stays in some cell, and all are verified.

Defined results: a null or wordless text has fingerprint zero and links like any other; a document with fewer
words than a shingle has its whole word sequence as the one shingle; repeated rows of an id link by each of their
texts; a row with a null id is fingerprinted but names no component (null); a very long text is fingerprinted whole; an
empty table gives an empty one; only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.common import cut, join_small
from rankwell.llm.components import components

#: Words of a shingle, hash seed, and differing bits up to which fingerprints link.
SHINGLE, SEED, BITS = 4, 42, 4
#: Members up to which a cell's pairs are compared at once; larger cells are split. At least 16, the most that differ in four bits only.
CELL = 4096
#: Blocks by which a cell is split, of which differing bits always leave one.
BLOCKS = BITS + 1
_CELLS = "cell long, used long, fp long, node long"
_LANES = np.uint64(0x0101010101010101)
_ALL = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[n:]] + [len(joined)]
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[s:e], SEED) for s, e in zip(starts, ends)), dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Eight bit positions at a time, each in a byte lane of which at most 255 are added before they are spread."""
    total, at = np.zeros(64, dtype=np.int64), np.arange(0, len(hashes), 255)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        total[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _ALL[2 * total > len(hashes)]).sum(dtype=np.uint64))


@F.pandas_udf(T.LongType())
def fingerprint_long(texts: pd.Series) -> pd.Series:
    """The fingerprint as a signed long."""
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).astype(np.int64))


def _neighbours() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 16 segments: what +1 and -1 add to a packed vector of 2-bit counts."""
    up = np.uint64(1) << (np.uint64(2) * np.arange(16, dtype=np.uint64))
    return up, np.uint64(3) * up


def vectors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of both halves and, for each, the index of its fingerprint: packed bit counts, plus 2^32 for the upper half."""
    even, keys = np.uint64(0x55555555), []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        keys.append((x & even) + ((x >> np.uint64(1)) & even) | np.uint64(half << 32))  # 2-bit counts of 0 to 2
    return np.concatenate(keys), np.tile(np.arange(len(fps), dtype=np.int64), 2)


def around(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells at most 1 from vectors, and for each the index of its vector. The vectors at most 1 from a cell are found alike."""
    own = np.arange(len(v), dtype=np.int64)
    keys, owners = [v], [own]
    for one, both in zip(*_neighbours()):
        count = v & both
        more, less = count != one + one, count != 0
        keys += [v[more] + one, v[less] - one]
        owners += [own[more], own[less]]
    return np.concatenate(keys), np.concatenate(owners)


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys and, for each, the index of its fingerprint."""
    v, of = vectors(fps)
    keys, owners = around(v)
    return keys, of[owners]


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, node = b.column("fp").to_numpy(zero_copy_only=False), b.column("node").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 20_000):
            key, own = grid_cells(fps[at : at + 20_000].view(np.uint64))
            cols = [key.view(np.int64), np.zeros(len(key), np.int64), fps[at : at + 20_000][own], node[at : at + 20_000][own]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["cell", "used", "fp", "node"])


def _to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(vectors(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))[0].view(np.int64))], ["v"])


def _to_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v").to_numpy(zero_copy_only=False)
        for at in range(0, len(v), 20_000):
            cell, of = around(v[at : at + 20_000].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 20_000][of]), pa.array(cell.view(np.int64))], ["v", "cell"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _to_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of the bits that are not yet equal in the row's cell (`used` has those that are)."""
    for b in batches:
        cell, used, fp, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "used", "fp", "node"))
        for u in np.unique(used):
            own = used == u
            free = _ALL[(np.uint64(u.view(np.uint64)) >> _ALL) & np.uint64(1) == 0]
            for k, bits in enumerate(np.array_split(free, BLOCKS)):
                mask = (np.uint64(1) << bits).sum(dtype=np.uint64)
                key = _mixed(_mixed(cell[own].view(np.uint64) + np.uint64(k)) ^ (fp[own].view(np.uint64) & mask))
                now = np.full(own.sum(), u.view(np.uint64) | mask)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key.view(np.int64), now.view(np.int64), fp[own], node[own]))], ["cell", "used", "fp", "node"])


def _small_runs(key: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows of equal key, at distance 1, 2, ... up to most - 1."""
    a, b, lag, at = [], [], 1, np.arange(len(key))
    while lag < most and len(at := at[at + lag < len(key)]) and len(at := at[key[at] == key[at + lag]]):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= BITS]
        a.append(node[hit])
        b.append(node[hit + lag])
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _spanning(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within one cell connect: breadth-first, each member reached once."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            near = np.bitwise_count(fp[left] ^ fp[x]) <= BITS
            found, left = left[near], left[~near]
            a.append(np.full(len(found), node[x]))
            b.append(node[found])
            front = np.concatenate([front, found])
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell come in, links go out. No cell has over CELL members."""
    held = [np.empty(0, np.int64)] * 3

    def done(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = ends - starts
        for s, e in zip(starts[size > 64], ends[size > 64]):
            yield out(*_spanning(fp[s:e].view(np.uint64), node[s:e]))
        small = np.repeat(size <= 64, size)
        yield out(*_small_runs(key[small], fp[small].view(np.uint64), node[small], 64))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, ("cell", "fp", "node"))]
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on in the next batch
            if last:
                yield from done(*(x[:last] for x in held))
                held = [x[last:] for x in held]
    if len(held[0]):
        yield from done(*held)


def crowded_cells(nodes: DataFrame) -> DataFrame:
    """Rows (cell) of the grid cells of over CELL members, counted on vectors. Such a cell has a vector of a 33rd of that at most 1 away."""
    counts = cut(nodes.select("fp").mapInArrow(_to_vectors, "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    heavy = counts.filter(F.col("n") * 33 > CELL).select("v")
    near = heavy.mapInArrow(_to_around, "v long, cell long").select(F.col("cell").alias("v")).distinct()
    members = near.mapInArrow(_to_around, "v long, cell long").select(F.col("v").alias("cell"), F.col("cell").alias("v"))
    return cut(members.join(counts, "v").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > CELL).select("cell"))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of `nodes` (fp long, node long; one row per fingerprint), enough to connect all that link."""
    cells, crowded, found = nodes.select("fp", "node").mapInArrow(_to_cells, _CELLS), crowded_cells(nodes), []
    while True:
        split = not crowded.isEmpty()
        whole = join_small(cells, crowded, ["cell"], "left_anti", F.lit(8)) if split else cells
        found.append(cut(whole.select("cell", "fp", "node").repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long")))
        if not split:
            return reduce(DataFrame.unionByName, found)
        cells = cut(join_small(cells, crowded, ["cell"], "left_semi", F.lit(8)).mapInArrow(_to_finer, _CELLS))
        crowded = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select("cell"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id): the fingerprint as a long and the smallest id that links reach."""
    prints = cut(docs.select(F.col(id_col).cast("long").alias("id"), fingerprint_long(F.col(text_col)).alias("fp")))
    nodes = cut(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    # an id repeated with other texts holds several fingerprints together
    several = prints.filter("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi").select("id")
    same_id = prints.join(several, "id", "left_semi").distinct().join(nodes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    reached = components(fingerprint_links(nodes).unionByName(same_id))
    label = nodes.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(label, "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, see keep_smallest."""
    return keep_smallest(docs, near_duplicates(docs, id_col, text_col), id_col)


def keep_smallest(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is their component's smallest in `found`, which has every id; one row where an id is repeated. Rows without an id all stay.

    Only ids that go or are repeated are looked up, so that most documents needn't be shuffled.
    """
    named = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count_if(F.col(id_col) == F.col("component_id")).alias("n"))
    odd = cut(named.filter("n != 1"))
    once = join_small(docs, odd.select(id_col), [id_col], "left_anti", F.lit(8)).select(docs.columns)
    again = odd.filter("n > 1").select(id_col)
    return once if again.isEmpty() else once.unionByName(docs.join(again, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col]))
