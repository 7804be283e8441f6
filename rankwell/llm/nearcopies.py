"""Near copies by Jaccard similarity of five-word shingles: the grid join of SimHash fingerprints proposes pairs, then MinHash bands do, the exact similarity decides.

Texts with equal shingle sets are one node. A node's fingerprint is that of its set, and the grid join of half vectors
under Manhattan distance (see `simhash`) finds which fingerprints link; first each node is compared with one that it
links with, later those that are not connected by then. At similarity 0.8 two fingerprints differ in about ten of 64 bits
and often in fifteen, a radius at which no grid cell tells documents apart, so the join finds the more similar copies, and
bands add the others. Two texts of similarity 0.8 share one of 24 bands of four MinHashes
with probability over 0.999996, more similar ones more surely, and differ in few bits of a sketch (see FAR); that is the
only loss.

In a band's bucket every node is first compared with the same three nodes of it, work linear in the members, which connects
most groups; then, in buckets whose nodes are not yet all connected, every two nodes of different components, by longer
sketches made for these nodes alone. So what is left out is connected already.
Sketches are compared within a task, a large bucket in blocks spread over many tasks, and only what connects the close ones
leaves it: at most one pair for each component. Clusters of components that are so connected, with all their nodes of such
buckets, are compared by exact similarity in the same manner, each with its shingles. So every two nodes of different
components with close sketches are compared exactly, and no group of texts makes more rows than it has members in each bucket
or two blocks.

Defined results: a null or wordless text has no shingle, and such texts are copies of each other; a text with fewer words
than a shingle has its word sequence as the one shingle; repeated rows of an id connect by each of their texts; a row with
a null id is in no component (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut, give_back, join_small, sole
from rankwell.llm.components import components
from rankwell.llm.simhash import SEED, fingerprint_links, keep_smallest, majority

#: Words of a shingle; similarity from which texts are near copies, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
BANDS, ROWS = 24, 4
#: MinHashes of which a sketch keeps one bit each, and bits in which sketches of near copies may differ: one in ten is
#: expected at similarity 0.8, and more than 30 with a probability below 0.00001.
SKETCH, FAR = 128, 30
#: The same for longer sketches: 102 differing bits are expected at similarity 0.8, over 155 with a probability below 0.0000001.
WIDE, WIDE_FAR = 1024, 155
#: Texts of a batch that goes back to Spark; nodes of a block of a large bucket or cluster, and shingles of one of a cluster.
BATCH, BLOCK, SHINGLES = 256, 2048, 1 << 20
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of the lower-cased text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[SHINGLE:]] + [len(joined)]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(joined[s:e], SEED) for s, e in zip(starts, ends)), dtype=np.uint64))


def minima(own: np.ndarray, n: int) -> np.ndarray:
    """The first n MinHashes of a set with a member."""
    least, (a, b) = np.full(n, ~np.uint64(0)), _FACTORS[:, :n, None]
    step = max(1, (1 << 17) // n)
    for at in range(0, len(own), step):
        mixed = own[at : at + step] * a
        mixed ^= mixed >> np.uint64(32)
        mixed *= b
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each MinHash, packed into longs."""
    return np.packbits((least & np.uint64(1)).astype(bool)).view(np.int64)


def bands(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each band's MinHashes, none for an empty set, and the sketch as two longs."""
    if not len(own):
        return np.empty(0, np.int64), np.zeros(2, np.int64)
    least = minima(own, SKETCH)
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64)
    return out, sketch(least)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long, zero for an empty one."""
    return int(np.array([majority(own) if len(own) else 0], dtype=np.uint64).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("nearcopies")
    for b in batches:
        for at in range(0, len(b), BATCH):
            part = b.slice(at, BATCH)
            sets = [shingle_set(x.as_py()) for x in part.column("text")]
            keys = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
            found, sketches = zip(*map(bands, sets))
            s0, s1 = map(pa.array, np.array(sketches).T.copy())
            fps = pa.array([*map(fingerprint, sets)], pa.int64())
            cols = [part.column("id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), fps, _lists(found), s0, s1]
            yield pa.RecordBatch.from_arrays(cols, ["id", "key", "n", "fp", "bands", "s0", "s1"])
        give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("nearcopies")
    for b in batches:
        for at in range(0, len(b), BATCH):
            sets = [shingle_set(x.as_py()) for x in b.column("text").slice(at, BATCH)]
            keys = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets)], ["key", "own"])
        give_back()


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with a shingle its number of shingles and the longer sketch, as one list."""
    sole("nearcopies")
    for b in batches:
        for at in range(0, len(b), BATCH):
            sets = [s for x in b.column("text").slice(at, BATCH) if len(s := shingle_set(x.as_py()))]
            if sets:
                keys = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists([np.append(len(s), sketch(minima(s, WIDE))) for s in sets])], ["key", "wide"])
        give_back()


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Of rows sorted by group the columns of each group, with `size` the lengths of the lists in column `name`, and these lists end to end."""
    held = {c: np.empty(0, np.int64) for c in ("group", "side", "component", "size")}
    flat = np.empty(0, np.int64)

    def split(rows: dict[str, np.ndarray], flat: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        edges = [0, *(np.flatnonzero(np.diff(rows["group"])) + 1).tolist(), len(rows["group"])]
        at = np.concatenate([[0], np.cumsum(rows["size"])])
        for s, e in zip(edges, edges[1:]):
            yield {c: v[s:e] for c, v in rows.items()}, flat[at[s] : at[e]]

    for b in batches:
        lists = b.column(name)
        new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "side", "component")} | {"size": pc.list_value_length(lists).to_numpy(zero_copy_only=False)}
        held = {c: np.concatenate([v, new[c]]) for c, v in held.items()}
        flat = np.concatenate([flat, lists.flatten().to_numpy(zero_copy_only=False)])
        if len(held["group"]) and (last := int(np.searchsorted(held["group"], held["group"][-1]))):  # the last group may go on
            at = int(held["size"][:last].sum())
            yield from split({c: v[:last] for c, v in held.items()}, flat[:at])
            held, flat = {c: v[last:] for c, v in held.items()}, flat[at:]
    if len(held["group"]):
        yield from split(held, flat)


def _spanning(component: np.ndarray, side: np.ndarray, close: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of components, enough to connect what close rows of a group connect, at most one for each component but one.

    Two sides are two blocks: what a block's own rows connect is found first and left to the group that has the block alone, then what rows of one connect with the other's.
    """
    label, a, b = component.copy(), [], []
    for across in (False, True) if side[0] != 2 else (None,):
        for x in range(len(label) - 1):
            y = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
            if across is not None:
                y = y[(side[y] != side[x]) == across]
            if not len(y) or not len(y := y[close(x, y)]):
                continue
            found, at = np.unique(label[y], return_index=True)
            if across is not False:
                a.append(np.full(len(at), component[x]))
                b.append(component[y[at]])
            label[np.isin(label, found)] = label[x]
            if (label == label[x]).all():
                break
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _close_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group what connects the components of those with close sketches and sizes near enough."""
    for rows, flat in _groups((b for b in batches if len(b)), "wide"):
        table = flat.reshape(len(rows["size"]), -1)
        n, wide = table[:, 0], table.view(np.uint64)[:, 1:]

        def close(x: int, y: np.ndarray) -> np.ndarray:
            may = np.minimum(n[x], n[y]) * LEAST[1] >= np.maximum(n[x], n[y]) * LEAST[0]
            may[may] = np.bitwise_count(wide[y[may]] ^ wide[x]).sum(axis=1, dtype=np.int64) <= WIDE_FAR
            return may

        yield from _spanning(rows["component"], rows["side"], close)


def _true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group what connects the components of those whose exact similarity is enough."""
    for rows, flat in _groups((b for b in batches if len(b)), "own"):
        n, ids = rows["size"], np.unique(flat, return_inverse=True)[1]
        starts, mark = np.cumsum(n) - n, np.zeros(int(ids.max()) + 1, np.int8)

        def alike(x: int, y: np.ndarray) -> np.ndarray:
            may = np.minimum(n[x], n[y]) * LEAST[1] >= np.maximum(n[x], n[y]) * LEAST[0]
            if len(y := y[may]):
                own = ids[starts[x] : starts[x] + n[x]]
                mark[own] = 1
                first = np.cumsum(n[y]) - n[y]
                at = np.arange(n[y].sum()) + np.repeat(starts[y] - first, n[y])
                common = np.add.reduceat(mark[ids[at]], first, dtype=np.int64)
                mark[own] = 0
                may[may] = common * LEAST[1] >= (n[x] + n[y] - common) * LEAST[0]
            return may

        yield from _spanning(rows["component"], rows["side"], alike)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band those that share it, each with the band's first three members and their sizes."""
    band, num, n, sent = (np.empty(0, t) for t in (np.int64, np.int64, np.int32, bool))
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "num", "n")]
        if not len(new[0]):
            continue
        band, num, n = (np.concatenate(x) for x in zip((band, num, n), new))
        sent = np.concatenate([sent, np.zeros(len(new[0]), bool)])
        edge = np.flatnonzero(np.diff(band)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(band)]])
        size = ends - starts
        out = np.flatnonzero(np.repeat(size > 1, size) & ~sent)
        first, last = np.repeat(starts, size)[out], np.repeat(ends, size)[out] - 1
        at = [np.minimum(first + k, last) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (band[out], num[out], n[out], *(num[x] for x in at), *(n[x] for x in at))], ["band", "num", "n", "c0", "c1", "c2", "n0", "n1", "n2"])
        # the last band may go on in the next batch
        open_ = slice(starts[-1], min(starts[-1] + 3, len(band)))
        band, num, n = band[open_], num[open_], n[open_]
        sent = np.full(len(band), size[-1] > 1)


def _alike(common: Column, a: Column, b: Column) -> Column:
    """Whether `common` of a and b members are enough."""
    return common * LEAST[1] >= (a + b - common) * LEAST[0]


def _near(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return _alike(F.least(a, b), a, b)


def _close(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Whether the sketches differ in few enough bits."""
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) <= FAR


def _of_nodes(wanted: DataFrame, d: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
    """Rows (num, name): what `made` makes of the text of each wanted node (num, node, key). Whole texts are shuffled only where the nodes are too many to send to them."""
    ids = wanted.select(F.col("node").alias("id")).distinct()
    texts = join_small(d, ids, ["id"], "left_semi", F.lit(8)).select("text")
    keyed = join_small(texts.mapInArrow(made, f"key binary, {name} array<long>"), wanted.select("key", "num"), ["key"], "inner", F.lit(24))
    return keyed.groupBy("num").agg(F.first(name).alias(name))


def _verified(pairs: DataFrame, nodes: DataFrame, d: DataFrame) -> DataFrame:
    """The pairs (a, b) of node numbers whose exact similarity is enough."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct().join(nodes.select("num", "node", "key"), "num"))
    # one exchange by number serves both joins
    sets = _of_nodes(wanted, d, _sets, "own")
    both = pairs.join(sets.select(F.col("num").alias("a"), F.col("own").alias("sa")), "a").join(sets.select(F.col("num").alias("b"), F.col("own").alias("sb")), "b")
    return cut(both.filter(_alike(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"))


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of numbers of nodes that the grid join of fingerprints links: enough to connect all whose fingerprints link. Nodes without a shingle take no part."""
    some = nodes.filter("n > 0").select("fp", "num")
    fps = cut(some.groupBy("fp").agg(F.min("num").alias("node")))
    same = some.join(fps, "fp").filter("num != node").select(F.col("node").alias("a"), F.col("num").alias("b"))
    return cut(fingerprint_links(fps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").unionByName(same).distinct())


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are not yet in one component."""
    of = lambda x: reached.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _in_blocks(members: DataFrame, by: str) -> DataFrame:
    """Rows (group, side, num, component): a member meets every block of what it shares `by` with once; within its own block it stands on both sides (2)."""
    own = F.pmod(F.xxhash64("num"), F.col("blocks"))
    dealt = members.select(by, "num", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    group = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(group.alias("group"), side.alias("side"), "num", "component")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, component_id): the smallest id that links reach."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = cut(d.mapInArrow(_prints, "id long, key binary, n int, fp long, bands array<long>, s0 long, s1 long"))
    named = prints.filter("id is not null")
    first = named.groupBy("key").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "s0", "s1")))
    nodes = cut(first.withColumn("num", F.monotonically_increasing_id()))
    # an id repeated with other texts holds several nodes together
    several = named.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo != hi").select("id")
    held = cut(named.join(several, "id", "left_semi").select("id", "key").distinct().join(nodes.select("key", "num"), "key").select("id", "num"))
    same_id = held.join(held.groupBy("id").agg(F.min("num").alias("b")), "id").select(F.col("num").alias("a"), "b")
    # one linked node for each, then what is not connected by that, with the bands' pairs
    grid = grid_pairs(nodes)
    tree = grid.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(tree, nodes, d).unionByName(same_id)
    reached = components(links)
    entries = nodes.select(F.explode("bands").alias("band"), "num", "n").repartition("band").sortWithinPartitions("band", "num")
    shared = cut(entries.mapInArrow(_shared, "band long, num long, n int, c0 long, c1 long, c2 long, n0 int, n1 int, n2 int"))
    stars = shared.select("num", "n", F.explode(F.array(*(F.struct(F.col(f"c{k}").alias("c"), F.col(f"n{k}").alias("m")) for k in range(3)))).alias("s"))
    stars = stars.filter((F.col("num") != F.col("s.c")) & _near(F.col("n"), F.col("s.m")))
    stars = cut(stars.select(F.least("num", "s.c").alias("a"), F.greatest("num", "s.c").alias("b")).distinct())
    side = lambda x: nodes.select(F.col("num").alias(x), F.col("s0").alias(f"{x}0"), F.col("s1").alias(f"{x}1"))
    likely = _apart(stars, reached)
    likely = likely.join(side("a"), "a").join(side("b"), "b").filter(_close("a0", "a1", "b0", "b1")).select("a", "b")
    likely = cut(likely.unionByName(_apart(grid.join(tree, ["a", "b"], "left_anti"), reached)).distinct())
    links = links.unionByName(_verified(likely, nodes, d))
    # buckets of several components: every two nodes of different ones
    reached = components(links)
    placed = shared.select("band", "num", "n").join(reached.withColumnRenamed("node", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    mixed = cut(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo != hi").select("band", F.ceil(F.col("m") / BLOCK).alias("blocks")))
    placed = cut(placed.join(mixed, "band").join(nodes.select("num", "key"), "num"))
    wide = _of_nodes(cut(placed.select("num", "key").distinct().join(nodes.select("num", "node"), "num")), d, _wide, "wide")
    dealt = _in_blocks(placed, "band").join(wide, "num").select("group", "side", "component", "wide")
    close = cut(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_close_links, "a long, b long").distinct())
    if not close.isEmpty():
        # every two members of components that close sketches connect, by their exact similarity
        clusters = components(close).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        members = cut(placed.select("num", "component", "n").distinct().join(clusters, "component"))
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")
        members = members.join(members.groupBy("cluster").agg(blocks), "cluster")
        sets = _of_nodes(cut(members.select("num").join(nodes.select("num", "node", "key"), "num")), d, _sets, "own")
        dealt = _in_blocks(members, "cluster").join(sets, "num").select("group", "side", "component", "own")
        true = cut(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_true_links, "a long, b long"))
        reached = components(links.unionByName(true))
    placed = nodes.select("num", "key", "node").join(reached.withColumnRenamed("node", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    least = placed.groupBy("component").agg(F.min("node").alias("component_id"))
    label = cut(placed.join(least, "component").select("key", "component_id"))
    out = prints.select("id", "key").join(label, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, see keep_smallest."""
    return keep_smallest(docs, near_copies(docs, id_col, text_col), id_col)
