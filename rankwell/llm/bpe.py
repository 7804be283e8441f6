"""BPE over a public vocabulary file: encoding by a queue of merge ranks over a linked list of symbols, decoding by joining vocabulary strings.

The file names its normaliser (NFC, white space to a space, lower case), its split into letter runs, single digits
and runs of other signs, its byte alphabet, the end-of-word suffix and the special tokens; a special token's string
in a text is that token. White space never takes part in a token, so a text's chunks between ASCII white space are
encoded one by one, each distinct one of a batch once, and a worker keeps the ids of recent chunks up to a fixed
number. Chunks of letters with closing marks are normalised and split here; for all others the file's own
normaliser and splitter decide, as the tokenizers library reads them, so that one version of Unicode's tables is used.

Defined results: a null text is encoded like an empty one, to no ids; ids of no vocabulary entry are left out by
decoding; very long texts and words are encoded whole, the queue growing with the word; repeated rows and null ids
are rows like any other; an empty table gives an empty one; other columns of any name pass `encode` and `decode`,
which replace a column of their result's name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.chunked import Kept, distinct, joined, made, parts
from rankwell.llm.common import sole

#: Chunks, and words, whose ids a worker keeps: twice this number at most.
CACHE = 60_000
#: Bits of a queue entry: 17 for a symbol, 27 above for a place in the word, then the rank.
SYMBOL, PLACE = (1 << 17) - 1, (1 << 27) - 1
#: ASCII's marks but the apostrophe, which may begin an ending of its own.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_SPACES = re.compile("[\t-\r ]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def library(path: str):
    """The file as the tokenizers library reads it, for whole texts."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    return lib


def plain_words(text: str) -> tuple[str, str] | None:
    """A chunk that is a run of letters and then a run of marks, either maybe empty, lower-cased and cut in two; None for any other.

    Python's tables of letters are no newer than the library's, and a letter in both is one in both; a chunk with signs
    that are not letters here is for the library to split. A sigma's lower case depends on its place, so it goes there too.
    """
    if "<|" in text or "\u03a3" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
        return None
    text = text.lower()
    letters = text.rstrip(MARKS)
    return (letters, text[len(letters) :]) if letters.isalpha() or not letters else None


class Bpe:
    """A vocabulary file of the kind above, read once a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in chain(self.vocab.items(), self.special.items())}
        self.letters = byte_alphabet()
        if max(self.strings, default=0) > SYMBOL:
            raise ValueError(f"ids beyond {SYMBOL} have no room in a queue entry")
        if any(plain_words(x) for x in self.special):
            raise ValueError("special tokens of letters and closing marks are not told from words")
        self.lib = library(path)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocab
        # a pair of ids: its rank, and the id it merges to in the low bits; a queue entry has its place between the two
        self.merges = {v[a] << 17 | v[b]: rank << 44 | v[a + b] for rank, (a, b) in enumerate(pairs)}
        self.breaks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.hint = min(self.special, key=len)[:2] if self.special else None
        self.known, self.merged, self.read = Kept(self.chunk, CACHE), Kept(self.word, CACHE), Kept(self._string, CACHE)

    def merge(self, word: str) -> list[int]:
        """The ids of one word, written in the byte alphabet: lowest rank first, leftmost of equal ranks."""
        get = self.merges.get
        # like any symbol, the last one with its suffix is left out if the vocabulary lacks it
        ids = [*map(self.vocab.get, word[:-1]), self.vocab.get(word[-1:] + self.suffix)]
        if None in ids:
            ids = [x for x in ids if x is not None]
        n = len(ids)
        queue = [m | i << 17 for i, m in enumerate(map(get, [a << 17 | b for a, b in zip(ids, ids[1:])])) if m is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            i, new = entry >> 17 & PLACE, entry & SYMBOL
            a, j = ids[i], after[i]
            if a < 0 or j >= n or get(a << 17 | ids[j]) != entry & ~(PLACE << 17):
                continue  # stale: one of the two has merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << 17 | ids[k])) is not None:
                    push(queue, m | i << 17)
            h = before[i]
            if h >= 0 and (m := get(ids[h] << 17 | new)) is not None:
                push(queue, m | h << 17)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one normalised word, packed; none for an empty one."""
        if not word:
            return b""
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
        return array("I", self.merge(word)).tobytes()

    def _split(self, text: str) -> bytes:
        """A text without a special token: its words by the file's normaliser and splitter, in the byte alphabet."""
        words = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
        return b"".join(array("I", self.merge(w)).tobytes() for w, _ in words if w)

    def chunk(self, text: str) -> bytes:
        """The ids of a text without ASCII white space, packed."""
        if (pair := plain_words(text)) is not None:
            return self.merged[pair[0]] + self.merged[pair[1]]
        if self.hint is None or self.hint not in text:
            return self._split(text)
        out, at = [], 0
        for m in self.breaks.finditer(text):
            out += [self._split(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._split(text[at:])])

    def encode(self, text: str | None) -> array:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        return array("I", b"".join(map(self.known.__getitem__, _SPACES.split(text))) if text else b"")

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The packed ids of the texts' distinct chunks, and which of them follow each other in which text; see `distinct`."""
        chunks, which, starts = distinct(texts)
        return made(chunks, MARKS, self.merged.__getitem__, self.known.__getitem__), which, starts

    def read_all(self, ids: pa.Array) -> pa.Array:
        """The decoded strings of packed ids, a space after every one, none for none."""
        return pa.array(map(self.read.__getitem__, ids.to_pylist()), pa.large_binary())

    def _string(self, ids: bytes) -> bytes:
        return (self.decode(array("I", ids)) + " ").encode("utf-8") if ids else b""

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings, with a space between any two as the file has no decoder of its own."""
        return " ".join(filter(None, map(self.strings.get, ids)))


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Bpe:
    return Bpe(path)


def vocabulary(path: str) -> Bpe:
    sole("bpe", _vocabulary.cache_clear)
    return _vocabulary(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with an array column of ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        bpe, out = vocabulary(path), [pa.array([], pa.list_(pa.int32()))]
        for part in parts(texts):
            flat, at = joined(*bpe.encode_all(part), width=4)
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32))))
        return pa.concat_arrays(out)

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`rows` with the decoded text of an array column of ids; a null array has an empty one."""

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()) for x in ids], pa.string())

    return rows.withColumn(text_col, text(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of each text's ids and of what they decode to, in one pass."""

    @F.arrow_udf(_DIGEST)
    def digest(texts: pa.Array) -> pa.Array:
        bpe, n, of_ids, of_text = vocabulary(path), [], [], []
        for part in parts(texts):
            ids, which, starts = bpe.encode_all(part)
            flat, at = joined(ids, which, starts)
            n += (np.diff(at) // 4).tolist()
            of_ids += [hashlib.sha256(_little(flat[s:e])).hexdigest() for s, e in zip(at, at[1:])]
            # each chunk's string ends with the space that parts it from the next one
            flat, at = joined(bpe.read_all(ids), which, starts)
            of_text += [hashlib.sha256(flat[s : max(s, e - 1)]).hexdigest() for s, e in zip(at, at[1:])]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")


_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _little(ids: memoryview) -> memoryview | bytes:
    """Packed ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little":
        return ids
    swapped = array("I", bytes(ids))
    swapped.byteswap()
    return swapped.tobytes()
