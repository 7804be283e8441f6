"""Language identification by unigram pieces over a public vocabulary, summed over all segmentations.

Each language gives every piece of the vocabulary a probability. A word's probability is the sum, over all its
segmentations into pieces, of the product of their probabilities (the forward algorithm); a text's is the product over
its words. Piece probabilities come from a bounded sample of labelled texts by expectation maximisation on the same
sums (forward and backward), which Spark runs over the sample's distinct words.

Words are the lower-cased runs of letters of a text, with a word-start mark in front, cut after 48 letters. A letter
that no piece has stands alone, at the same small probability for every language.

Defined results: a null text or one without a letter is `und` with score 0; texts in no learned language still
get the likeliest; equal likelihoods go to the first language in order; rows are predicted one by one, so
repeated rows get equal results; a very long text is scored whole, a very long word in parts; without labelled texts, as
in an empty table, every prediction is `und`; predictions are a column of any name, so the table's names may not clash.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.chunked import distinct, parts, plain
from rankwell.llm.common import cut, join_small, sole

#: The bound of the fitting sample: texts of each language.
PER_LANGUAGE = 300
#: EM rounds; letters of a piece, letters of a word part; bytes of the words with their likelihoods that a worker keeps, of a word without them, and of the sums of words scored together.
ROUNDS, PIECE, PART, KEPT_BYTES, WORD_BYTES, SUM_BYTES = 3, 8, 48, 32 << 20, 200, 16 << 20
UNKNOWN, SMOOTH = 1e-7, 0.05
START = "▁"
_MARKS = string.punctuation + string.digits
_WORD = regex.compile(r"\p{L}+")
_ASCII_OTHER = {c: 32 for c in range(128) if not chr(c).isalpha()}


def words(text: str | None) -> list[str]:
    """The lower-cased letter runs, cut into parts of at most 48 letters."""
    text = (text or "").lower()
    parts = text.translate(_ASCII_OTHER).split()
    plain = "".join(parts)
    if not plain.isalpha():  # signs beyond ASCII
        parts = _WORD.findall(text)
    if parts and max(map(len, parts)) > PART:
        parts = [p[k : k + PART] for p in parts for k in range(0, len(p), PART)]
    return parts


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the word-start mark, of at most 8 characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= PIECE and (p == START or p.removeprefix(START).isalpha()))


class Pieces:
    """The pieces by number, as a tree of letters whose edges are sorted numbers, and for words of one length where each piece can stand."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        letters = sorted(set("".join(vocabulary)))
        code, edges, piece = {c: k for k, c in enumerate(letters)}, {}, [-1]
        self.letters, self.width = np.array([*map(ord, letters)], dtype=np.uint32), len(letters)
        for number, p in enumerate(vocabulary):
            node = 0
            for c in p:
                edge = node * self.width + code[c]
                if edge not in edges:
                    edges[edge] = len(piece)
                    piece.append(-1)
                node = edges[edge]
            piece[node] = number
        self.edges = np.array(sorted(edges), dtype=np.int64)
        self.ends, self.piece = np.array([edges[e] for e in self.edges.tolist()], dtype=np.int64), np.array(piece)

    def spans(self, group: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For equally long words: (from, to, the words' indexes, their pieces), in order of `to`. A lone unknown letter has piece -1."""
        n, m, out = len(group), len(group[0]), []
        points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, m)
        codes = np.minimum(np.searchsorted(self.letters, points), self.width - 1)
        known = self.letters[codes] == points
        for i in range(m):
            own, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for j in range(i, min(m, i + PIECE)):
                edge = node * self.width + codes[own, j]
                at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                on = known[own, j] & (self.edges[at] == edge)
                own, node = own[on], self.ends[at[on]]
                found = self.piece[node]
                if j == i:
                    lone = np.full(n, -1)
                    lone[own] = found
                    out.append((i, j + 1, np.arange(n), lone))
                elif (hit := found >= 0).any():
                    out.append((i, j + 1, own[hit], found[hit]))
                if not len(own):
                    break
        return sorted(out, key=lambda x: x[1])


def _by_length(ws: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for k, w in enumerate(ws):
        own = groups.setdefault(len(w), ([], []))
        own[0].append(k)
        own[1].append(START + w)
    return iter(groups.values())


def forward(known: Pieces, prob: np.ndarray, ws: list[str]) -> np.ndarray:
    """Log-probabilities [word, language]. `prob` is [piece, language], its last row for unknown letters."""
    out = np.zeros((len(ws), prob.shape[1]))
    for every, words_ in _by_length(ws):
        most = max(1, SUM_BYTES // (8 * (len(words_[0]) + 1) * max(1, prob.shape[1])))
        for k in range(0, len(words_), most):
            at, group = every[k : k + most], words_[k : k + most]
            alpha = np.zeros((len(group[0]) + 1, len(group), prob.shape[1]))
            alpha[0] = 1
            for i, j, own, p in known.spans(group):
                alpha[j, own] += alpha[i, own] * prob[p]
            out[at] = np.log(alpha[-1])
    return out


def expected(known: Pieces, prob: np.ndarray, ws: list[str], n: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece] of one language: forward and backward sums over the words, n times each."""
    count = np.zeros(known.size + 1)
    for at, group in _by_length(ws):
        spans, length = known.spans(group), len(group[0])
        alpha, beta = np.zeros((length + 1, len(group))), np.zeros((length + 1, len(group)))
        alpha[0] = beta[length] = 1
        for i, j, own, p in spans:
            alpha[j, own] += alpha[i, own] * prob[p]
        for i, j, own, p in reversed(spans):
            beta[i, own] += beta[j, own] * prob[p]
        weight = n[at] / alpha[length]
        for i, j, own, p in spans:
            np.add.at(count, p, alpha[i, own] * prob[p] * beta[j, own] * weight[own])
    return count[:-1]


class Model:
    def __init__(self, vocabulary: list[str], languages: list[str], prob: np.ndarray):
        self.vocabulary, self.languages, self.prob = vocabulary, languages, prob
        self._ready = None

    def _state(self) -> list:
        if self._ready is None:
            self._ready = [Pieces(self.vocabulary), {}, np.empty((0, len(self.languages)))]
        return self._ready

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _rows(self, ws: list[str]) -> np.ndarray:
        """The log-likelihoods [word, language] of distinct words, each computed once while it is kept."""
        state = self._state()
        fresh = [w for w in ws if w not in state[1]]
        if (len(state[1]) + len(fresh)) * (WORD_BYTES + 8 * len(self.languages)) > KEPT_BYTES:
            state[1], state[2], fresh = {}, state[2][:0], ws
        state[1].update(zip(fresh, range(len(state[1]), len(state[1]) + len(fresh))))
        state[2] = np.concatenate([state[2], forward(state[0], self.prob, fresh)])
        return state[2][np.fromiter(map(state[1].__getitem__, ws), dtype=np.int64, count=len(ws))]

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """Log-likelihoods [chunk, language], which are sums over a chunk's words; NaN for one without a letter. A plain chunk is one word of letters."""
        is_plain, head, _ = plain(chunks, _MARKS)
        rest = [*map(words, chunks.filter(pa.array(~is_plain)).to_pylist())]
        coded = head.dictionary_encode()
        one = [[w] if 0 < len(w) <= PART else words(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([*map(len, one), *map(len, rest)], dtype=np.int64)
        flat = [*chain.from_iterable(one), *chain.from_iterable(rest)]
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        scored = self._rows(list(number))[np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))]
        sums, full = np.full((len(sizes), len(self.languages)), np.nan), np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(scored, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
        out = np.empty((len(chunks), len(self.languages)))
        out[is_plain], out[~is_plain] = sums[: len(one)][coded.indices.to_numpy()], sums[len(one) :]
        return out

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihoods [text, language], NaN for a text without a letter."""
        chunks, which, starts = distinct(texts)
        table = self._chunks(chunks)
        lettered = ~np.isnan(table[:, 0])
        out = np.add.reduceat(np.where(lettered[:, None], table, 0.0)[which], starts[:-1], axis=0)
        out[~np.logical_or.reduceat(lettered[which], starts[:-1])] = np.nan
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the likelihoods, all languages alike beforehand."""
        names, scores = [], [np.empty(0)]
        for part in parts(texts):
            if not self.languages:
                names += ["und"] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            total = self.totals(part)
            none = np.isnan(total[:, 0])
            total[none] = 0.0
            best = np.where(none, -1, total.argmax(axis=1))
            names += [*map([*self.languages, "und"].__getitem__, best.tolist())]
            scores.append(np.where(none, 0.0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)))
        return names, np.concatenate(scores)


def sample(docs: DataFrame, id_col: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows (label, text): of each language the first texts in order of the id's hash.

    The order is drawn on narrow rows, of which a bound on the hash leaves a few times the wanted number; without
    the bound should it leave too few, as when an id is repeated very often. The ids then fetch their texts.
    """
    d = docs.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.xxhash64(id_col).alias("o"), F.col(text).alias("text"))
    sizes = cut(d.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    narrow = d.select("label", "o", "id")
    bound = F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n")) - F.lit(float(1 << 63))
    few = join_small(narrow, sizes.select("label", bound.alias("most")), ["label"], "inner", F.length("label") * 4).filter(F.col("o") <= F.col("most")).drop("most")
    rank = F.row_number().over(W.partitionBy("label").orderBy("o", "id"))
    first = cut(few.withColumn("rn", rank).filter(F.col("rn") <= per_language))
    held = first.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    if not sizes.join(held, "label", "left").filter(F.coalesce("k", F.lit(0)) < F.least("n", F.lit(per_language))).isEmpty():
        first = cut(narrow.withColumn("rn", rank).filter(F.col("rn") <= per_language))
    texts = join_small(d, first.select("label", "id").distinct(), ["label", "id"], "left_semi", F.length("label") * 4)
    # an id may be repeated
    rank = F.row_number().over(W.partitionBy("label").orderBy("o", "id", F.xxhash64("text")))
    return texts.withColumn("rn", rank).filter(F.col("rn") <= per_language).select("label", "text")


def fit(labelled: DataFrame, path: str) -> Model:
    """`labelled` has columns label and text, and is bounded (see `sample`)."""
    vocabulary = pieces(path)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    counts = cut(labelled.select("label", F.explode(split("text")).alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n")).repartition(F.col("label"), F.substring(F.md5("word"), 1, 1)))
    languages = sorted(r[0] for r in counts.select("label").distinct().collect())
    prob = np.full((len(vocabulary) + 1, len(languages)), 1 / max(1, len(vocabulary)))
    prob[-1] = UNKNOWN
    for _ in range(ROUNDS if languages else 0):
        shared = counts.sparkSession.sparkContext.broadcast((vocabulary, languages, prob))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, languages, prob = shared.value
            known, total = Pieces(vocabulary), {}
            for b in batches:
                rows = b.to_pandas()
                for label, own in rows.groupby("label"):
                    k = languages.index(label)
                    got = expected(known, prob[:, k], own["word"].tolist(), own["n"].to_numpy(float))
                    total[k] = total.get(k, 0) + got
            for k, c in total.items():
                p = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k)), pa.array(p), pa.array(c[p])], ["k", "p", "c"])

        # bounded by languages times vocabulary, whatever the sample
        got = counts.mapInArrow(count, "k long, p long, c double").groupBy("k", "p").agg(F.sum("c").alias("c")).toPandas()
        c = np.full((len(vocabulary), len(languages)), SMOOTH)
        np.add.at(c, (got["p"].to_numpy(), got["k"].to_numpy()), got["c"].to_numpy())
        prob = np.concatenate([c / c.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
        shared.unpersist()
    return Model(vocabulary, languages, prob)


def predict(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column (lang_pred, score) for `docs`; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        sole("langid")  # the model itself goes with its broadcast
        names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return judge(F.col(text))


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id's checksum puts the row among those that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """The model of the labelled documents that are not held out, by a sample in order of the id's hash."""
    return fit(sample(docs.filter(~held_out(id_col)), id_col, text, label), path)
