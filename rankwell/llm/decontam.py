"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND, hits are verified.

Items fall in classes by their number of words, a class's size C being the power of two from there up; the passages of a
class are the 3 C-word windows that start at every C-th word, so any run of 2 C + 1 words lies whole in one: an item with
as many words put in between as it has itself. An item's score
for a passage is BM25 over the passage's distinct words, divided by what the item's own words give it. An item
of N distinct five-word shingles has, for each of its distinct words but those that first stand among its last four,
a shingle of its own that starts with the word; so a passage with 80 % of the shingles lacks at most floor(0.2 N) of
the words, besides those last ones. Its score is therefore at least 1 less the share of the last ones and of the best
floor(0.2 N) others, and the least such number over a class is its threshold: retrieval loses nothing that
verification would accept. Document frequencies and the mean length are those of all items.

The index is built by Spark in parts of a bounded size, each in one task, and every part is broadcast packed. A task reads
its documents once: it takes some, queries all parts in turn, and keeps the best overlap for each document and item, so
the number of parts changes no row. Parts stay unpacked in a worker while all of them are small enough. Items beyond
PASS_BYTES of packed parts, some hundred MB of text, take further passes over the documents.

Verification: at least 80 % of the shingles of question and answer together, and at least half of the words of the
question and of the answer, each counted once, are in the passage.

Defined results: null and wordless texts and items match nothing; an item shorter than a shingle has its word sequence
as the one shingle; a document that has an item in several passages gets one row, of the best overlap; rows with the
same item id are one item with several texts, of which the best counts, and so are those without an id; repeated
documents give repeated rows; documents and words of any length are read whole; no items or no documents give no rows;
only the named columns of both tables are read, so others may have any names.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.chunked import parts as slices
from rankwell.llm.common import cut, sole

SHINGLE, LEAST, PART = 5, 0.8, 0.5
K1, B, BLOCK = 1.2, 0.75, 8
#: Ranges of items for which bounds are kept by word.
RANGES = 32
#: Words of documents that are matched together.
TOGETHER = 50_000
#: Words of documents that are matched before the next part of the index is unpacked, where not all parts are kept.
GATHERED = 1_000_000
#: Bytes of items in one part of the index, of unpacked parts that a worker keeps, and of packed parts that are sent at once.
INDEX_BYTES, KEPT_BYTES, PASS_BYTES = 2 << 20, 64 << 20, 256 << 20
#: Everything in ASCII but a-z and 0-9 separates words; texts are lower-cased before.
_SEPARATORS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words of the lower-cased text, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SEPARATORS).split()


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    if not ids:
        return set()
    return set(zip(*(ids[k:] for k in range(SHINGLE)))) if len(ids) >= SHINGLE else {tuple(ids)}


class Index:
    """The items of one class: postings by word with block maxima, and what verification needs."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], size: int, idf: dict[int, float], mean: float):
        """items: number, word ids of the question, word ids of the answer; size: of the class; idf and mean length."""
        self.size, self.items = size, items
        words = [q + a for _, q, a in items]
        self.shingles = [shingles(w) for w in words]
        self.parts = [(set(q), set(a)) for _, q, a in items]
        self.postings: dict[int, tuple[list[int], list[float], list[float]]] = {}
        lists, least = defaultdict(list), []
        for i, w in enumerate(words):
            norm = K1 * (1 - B + B * len(w) / mean)
            gains = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            own = sum(gains.values())
            last = set(w[1 - SHINGLE :]).difference(w[: 1 - SHINGLE])
            others = sorted((g for t, g in gains.items() if t not in last), reverse=True)
            lacking = math.floor((1 - LEAST) * len(self.shingles[i]) + 1e-9)
            least.append(max(sum(others[lacking:]) / own - 1e-4, 1e-6))
            for t, g in gains.items():
                lists[t].append((i, g / own))
        self.least = min(least)
        self.per_range = math.ceil(len(items) / RANGES)
        self.range_least = np.array([min(least[i : i + self.per_range]) for i in range(0, len(items), self.per_range)])
        for t, p in lists.items():
            at, gain = [x for x, _ in p], [g for _, g in p]
            self.postings[t] = (at, gain, [max(gain[s : s + BLOCK]) for s in range(0, len(gain), BLOCK)])
        self.bound = {t: max(b) for t, (_, _, b) in self.postings.items()}

    def range_bounds(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """By word number: the word's best gain, and its best in each range of items."""
        out = np.zeros((words, len(self.range_least)), dtype=np.float32)
        for t, (at, gain, _) in self.postings.items():
            np.maximum.at(out[t], np.array(at) // self.per_range, np.array(gain, dtype=np.float32) * np.float32(1.00001))
        return out.max(axis=1).astype(float), out

    def retrieve(self, query: set[int]) -> list[int]:
        """Block-max WAND: the items whose score reaches the threshold."""
        lists = [[at, gain, block, 0, self.bound[t]] for t in query if (p := self.postings.get(t)) for at, gain, block in (p,)]
        found, least = [], self.least
        while lists:
            lists.sort(key=lambda c: c[0][c[3]])
            total, pivot = 0.0, -1
            for n, c in enumerate(lists):
                total += c[4]
                if total >= least:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][3]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]] == item:
                pivot += 1
            # the blocks that hold the item, or would
            upper, until = 0.0, None
            for c in lists[: pivot + 1]:
                at, k = c[0], c[3] // BLOCK
                while k < len(c[2]) and at[min(k * BLOCK + BLOCK, len(at)) - 1] < item:
                    k += 1
                if k < len(c[2]):
                    upper += c[2][k]
                    last = at[min(k * BLOCK + BLOCK, len(at)) - 1]
                    until = last if until is None else min(until, last)
            if upper >= least:
                if lists[0][0][lists[0][3]] == item:
                    score = sum(c[1][c[3]] for c in lists[: pivot + 1])
                    if score >= least:
                        found.append(item)
                    goal = item + 1
                else:
                    goal = item
            else:
                # nothing up to the nearest block end, or to the next list's item, can reach the threshold
                goal = item + 1 if until is None else until + 1
                if pivot + 1 < len(lists):
                    goal = max(item + 1, min(goal, lists[pivot + 1][0][lists[pivot + 1][3]]))
            for c in lists[: pivot + 1]:
                at, i = c[0], c[3]
                while i < len(at) and at[i] < goal:
                    i += 1
                c[3] = i
            lists = [c for c in lists if c[3] < len(c[0])]
        return found

    def verify(self, item: int, passage: list[int]) -> tuple[float, float, float] | None:
        """The overlaps of the whole item, its question's and its answer's words, if they are enough."""
        own = self.shingles[item]
        if len(next(iter(own))) < SHINGLE:
            n = len(next(iter(own)))
            here = set(zip(*(passage[k:] for k in range(n))))
        else:
            here = shingles(passage)
        overlap = len(own & here) / len(own)
        if overlap < LEAST:
            return None
        have = set(passage)
        parts = [len(p & have) / len(p) if p else 1.0 for p in self.parts[item]]
        return (overlap, *parts) if min(parts) >= PART else None


class Matcher:
    """The indexes of all classes over one word numbering."""

    def __init__(self, rows: list[tuple[int, str, str | None]], df: dict[bytes, int] | None = None, total: int = 0, mean: float = 0.0):
        """rows: item id, question, answer; and of all items the document frequencies, number and mean length, else those of the rows."""
        self.numbers: dict[bytes, int] = {}
        classes = defaultdict(list)
        for item, q, a in rows:
            q, a = ([self.numbers.setdefault(w, len(self.numbers) + 1) for w in tokens(x)] for x in (q, a))
            if n := len(q) + len(a):
                classes[max(3, (n - 1).bit_length()), n < SHINGLE].append((item, q, a))
        if df is None:
            words = [q + a for items in classes.values() for _, q, a in items]
            own, total, mean = Counter(t for w in words for t in set(w)), len(words), sum(map(len, words)) / max(1, len(words))
        else:
            own = {n: df[w] for w, n in self.numbers.items()}
        idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in own.items()}
        self.indexes = [Index(items, 1 << bits, idf, mean) for (bits, _), items in sorted(classes.items())]
        self.bounds = [x.range_bounds(len(self.numbers) + 1) for x in self.indexes]

    def match(self, texts: Iterable[str | None]) -> Iterator[dict[int, tuple[float, float, float]]]:
        """For each text the ids of the items it holds, with their overlaps."""
        for held in _together(map(tokens, texts), TOGETHER):
            yield from self._match(held)

    def _match(self, docs: list[list[bytes]]) -> list[dict[int, tuple[float, float, float]]]:
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in docs]
        sizes = np.array([*map(len, docs), 0])
        ids = np.fromiter(map(self.numbers.get, chain.from_iterable(docs), repeat(0)), dtype=np.int64, count=sizes.sum())
        # the words that some item has: their numbers, documents and places, and the place where each stood last before (else far below 0)
        here = np.flatnonzero(ids)
        if not len(here):
            return found
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(sizes)), sizes)[here]
        ids, at = ids[here], here - first[doc]
        order = np.argsort(doc * (len(self.numbers) + 1) + ids, kind="stable")
        same = (ids[order[1:]] == ids[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        last = np.full(len(ids), -(1 << 40))
        last[order[1:][same]] = at[order[:-1][same]]
        for index, (best, bound) in zip(self.indexes, self.bounds):
            # blocks are numbered through, with two empty ones after each document
            count = sizes // index.size + 3
            base = np.concatenate([[0], np.cumsum(count)])
            n, own = base[-1] + 1, at // index.size
            block = base[doc] + own
            # WAND's first test, for all passages at once: the sum of their distinct words' bounds. A word counts for the
            # passages that start with its block and with the two before, unless it stood there already.
            first_in = [last < (own - k) * index.size for k in range(3)]
            gain = best[ids]
            upper = sum(np.bincount(block, gain * new, n + 1)[k : k + n - 1] for k, new in enumerate(first_in))
            may = np.concatenate([[False, False], upper >= index.least])
            rows = np.flatnonzero(may[block + 2] | may[block + 1] | may[block])
            if not len(rows):
                continue
            # the same for each range of items, over what is left; first with each block's own distinct words, a looser sum
            gain, edges = bound[ids[rows]], np.searchsorted(block[rows], np.arange(n + 2))
            loose = _sums(gain * first_in[0][rows, None], edges)
            loose = (loose[: n - 1] + loose[1:n] + loose[2:] >= index.range_least).any(axis=1)
            near = np.zeros(n + 1, dtype=bool)
            for k in range(3):
                near[k : k + n - 1] |= loose
            rows, gain = rows[near[block[rows]]], gain[near[block[rows]]]
            if not len(rows):
                continue
            edges = np.searchsorted(block[rows], np.arange(n + 2))
            upper = sum(_sums(gain * new[rows, None], edges)[k : k + n - 1] for k, new in enumerate(first_in))
            for k in np.flatnonzero((upper >= index.range_least).any(axis=1)):
                d = int(np.searchsorted(base, k, "right")) - 1
                s = int(k - base[d]) * index.size
                passage = [*map(self.numbers.get, docs[d][s : s + 3 * index.size], repeat(0))]
                for i in index.retrieve(set(passage)):
                    if (got := index.verify(i, passage)) and got > found[d].get(index.items[i][0], (0.0,)):
                        found[d][index.items[i][0]] = got
        return found


def _sums(gain: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column sums of the rows between neighbouring edges."""
    full = np.flatnonzero(edges[1:] > edges[:-1])
    out = np.zeros((len(edges) - 1, gain.shape[1]), dtype=np.float32)
    if len(full):
        out[full] = np.add.reduceat(gain, edges[full], axis=0)
    return out


def _together(docs: Iterable[list[bytes]], most: int) -> Iterator[list[list[bytes]]]:
    """The documents in runs of about `most` words."""
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def index_parts(items: DataFrame, item_col: str, question: Column, answer: Column) -> DataFrame:
    """Rows (part, blob, size): the parts of the index, packed, and their sizes unpacked."""
    t = items.select(F.col(item_col).cast("long").alias("item"), question.alias("q"), answer.alias("a"))
    size = F.octet_length(F.coalesce("q", F.lit(""))) + F.octet_length(F.coalesce("a", F.lit(""))) + 64
    n = max(1, math.ceil((t.agg(F.sum(size)).first()[0] or 0) / INDEX_BYTES))
    t = cut(t.withColumn("part", F.pmod(F.xxhash64("item", "q", "a"), F.lit(n)).cast("int")))

    @F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("ws", T.ArrayType(T.BinaryType()))]))
    def counted(q: pa.Array, a: pa.Array) -> pa.Array:
        words = [tokens(x) + tokens(y) for x, y in zip(q.to_pylist(), a.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([*map(len, words)], pa.int32()), pa.array([[*dict.fromkeys(w)] for w in words], pa.list_(pa.binary()))], ["n", "ws"])

    words = cut(t.select("part", counted("q", "a").alias("c")).select("part", "c.n", "c.ws").filter("n > 0"))
    all_ = words.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean")).first()
    total, mean = all_["k"], all_["mean"] or 0.0
    each = words.select("part", F.explode("ws").alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # both lists are bounded by a part's size
    stats = each.distinct().join(df, "w").groupBy("part").agg(F.collect_list(F.struct("w", "df")).alias("dfs"))
    rows = t.groupBy("part").agg(F.collect_list(F.struct("item", "q", "a")).alias("rows")).join(stats, "part")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = Matcher([(x["item"], x["q"], x["a"]) for x in r["rows"]], {x["w"]: x["df"] for x in r["dfs"]}, total, mean)
                raw = pickle.dumps(m)
                yield pa.RecordBatch.from_pylist([{"part": r["part"], "blob": zlib.compress(raw, 1), "size": len(raw)}], pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("size", pa.int64())]))

    return cut(rows.mapInArrow(build, "part int, blob binary, size bigint"))


class Parts:
    """Parts of the index that are sent to the tasks together."""

    def __init__(self) -> None:
        self.shared: list[Broadcast] = []
        self.packed = self.size = 0
        self.keep = True

    def match(self, texts: Iterable[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the ids of the items it holds, in any of the parts, with their best overlaps."""
        out = []
        for held in _together(map(tokens, texts), TOGETHER if self.keep else GATHERED):
            found: list[dict[int, tuple[float, float, float]]] = [{} for _ in held]
            for shared in self.shared:
                matcher, at = _unpacked(shared, self.keep), 0
                for some in _together(held, TOGETHER):
                    for own, got in zip(found[at : at + len(some)], matcher._match(some)):
                        for item, overlaps in got.items():
                            if overlaps > own.get(item, (0.0,)):
                                own[item] = overlaps
                    at += len(some)
            out += found
        return out


_KEPT: dict[int, tuple[Broadcast, Matcher, int]] = {}


def _unpacked(shared: Broadcast, keep: bool) -> Matcher:
    """A part's matcher. A worker keeps KEPT_BYTES of them at most, those of its latest index."""
    sole("decontam", _KEPT.clear)
    key = id(shared)
    if key in _KEPT and _KEPT[key][0] is shared:
        return _KEPT[key][1]
    matcher, size = pickle.loads(zlib.decompress(shared.value[0])), shared.value[1]
    if keep:
        if sum(x[2] for x in _KEPT.values()) + size > KEPT_BYTES:
            _KEPT.clear()
        _KEPT[key] = shared, matcher, size
    return matcher


def _passes(items: DataFrame, item_col: str, question: Column, answer: Column) -> list[Parts]:
    """The parts of the index in as few passes as PASS_BYTES allows; the driver sees one packed part at a time."""
    out = [Parts()]
    for r in index_parts(items, item_col, question, answer).toLocalIterator():
        if out[-1].packed and out[-1].packed + len(r["blob"]) > PASS_BYTES:
            out.append(Parts())
        out[-1].shared.append(items.sparkSession.sparkContext.broadcast((bytes(r["blob"]), r["size"])))
        out[-1].packed += len(r["blob"])
        out[-1].size += r["size"]
        out[-1].keep = out[-1].size <= KEPT_BYTES
    return out


def split_answer(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item that is one text: the answer is what follows the last line or sentence end inside it."""
    answer = F.regexp_extract(text, r"(?s)^.*[.?!]\s+(.+)$", 1)
    at = F.length(text) - F.length(answer)
    return F.when(answer == "", text).otherwise(F.substring(text, F.lit(1), at)), F.when(answer != "", answer)


def contaminated(docs: DataFrame, items: DataFrame, question: Column, answer: Column, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows (id, item_id, overlap, question_overlap, answer_overlap) of documents with a passage that holds an item."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("row"))
    passes, overlaps = _passes(items, item_col, question, answer), ["overlap", "question_overlap", "answer_overlap"]
    if len(passes) > 1:  # a document's rows of different passes are told by a number of its own
        d = cut(d.withColumn("row", F.monotonically_increasing_id()))

    def finder(parts: Parts):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = parts.match(b.column("text").to_pylist())
                hits = [(i, row, item, *o) for i, row, held in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), found) for item, o in held.items()]
                cols = list(zip(*hits)) or [[]] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "row", "item_id", *overlaps])

        return find

    schema = "id long, row long, item_id long, overlap double, question_overlap double, answer_overlap double"
    out = reduce(DataFrame.unionByName, [d.mapInArrow(finder(p), schema) for p in passes])
    if len(passes) > 1:
        out = out.groupBy("id", "row", "item_id").agg(F.max(F.struct(*overlaps)).alias("m")).select("id", "item_id", "m.*")
    return out.select(F.col("id").alias(id_col), "item_id", *overlaps)


def flags(docs: DataFrame, items: DataFrame, question: Column, answer: Column, text_col: str = "text", item_col: str = "item_id") -> Column:
    """A boolean column for `docs`: whether the text holds an item. The other columns never reach Python."""

    def test(parts: Parts) -> Column:
        @F.arrow_udf(T.BooleanType())
        def holds(texts: pa.Array) -> pa.Array:
            return pa.array([bool(x) for x in parts.match(chain.from_iterable(x.to_pylist() for x in slices(texts)))], pa.bool_())

        return holds(F.col(text_col))

    return reduce(Column.__or__, map(test, _passes(items, item_col, question, answer)))
