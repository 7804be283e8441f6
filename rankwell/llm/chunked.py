"""Texts of an Arrow batch as chunks between ASCII white space, of which Python sees each distinct one once."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankwell.llm.common import give_back

#: Bytes of text that are taken apart together; a single longer text is taken whole.
TOGETHER = 2 << 20


class Kept(dict):
    """Texts of up to 64 characters and what is made of them when first asked for. When full it becomes the older half, from which what is still in use returns."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text):
        made = self.older.get(text)
        if made is None:
            made = self.make(text)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(text) <= 64:
            self[text] = made
        return made


def parts(texts: pa.Array, most: int = TOGETHER) -> Iterator[pa.Array]:
    """The texts in slices of about `most` bytes, none for an empty array."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + most, "right")) - at)
        yield texts.slice(at, n)
        at += n
    give_back()


def distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks, the number of each chunk in turn, and where each text's begin; a null text is an empty one, of one empty chunk."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()


def _each(texts: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
    """What is made of each text, each distinct one looked up once."""
    coded = texts.dictionary_encode()
    return pa.array(map(make, coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)


def plain(chunks: pa.Array, marks: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which chunks are ASCII letters with closing marks, either maybe none, and of those the lower-cased letters and the marks."""
    low = pc.ascii_lower(chunks)
    head, tail = pc.ascii_rtrim(low, marks), pc.ascii_ltrim(low, string.ascii_lowercase)
    is_plain = pc.and_(pc.string_is_ascii(chunks), pc.or_(pc.ascii_is_alpha(head), pc.equal(head, "")))
    return is_plain.to_numpy(zero_copy_only=False), head.filter(is_plain), tail.filter(is_plain)


def made(chunks: pa.Array, marks: str, word: Callable[[str], bytes], other: Callable[[str], bytes]) -> pa.Array:
    """A byte string for each chunk: of a plain one that of its letters and of its marks, both by `word`, of any other that by `other`."""
    is_plain, head, tail = plain(chunks, marks)
    both = pc.binary_join_element_wise(_each(head, word), _each(tail, word), pa.scalar(b"", pa.large_binary()))
    rest = pa.array(map(other, chunks.filter(pa.array(~is_plain)).to_pylist()), pa.large_binary())
    place = np.where(is_plain, np.cumsum(is_plain) - 1, len(both) + np.cumsum(~is_plain) - 1)
    return pa.concat_arrays([both, rest]).take(pa.array(place))


def joined(parts: pa.Array, which: np.ndarray, starts: np.ndarray, width: int = 1) -> tuple[memoryview, np.ndarray]:
    """The chunks' byte strings put together text by text: the bytes, and where each text's begin, in units of `width` bytes."""
    taken = parts.take(pa.array(which))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)
    return memoryview(taken.buffers()[2] or b""), offsets[starts] // width
