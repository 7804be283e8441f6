"""Token files: Parquet with a list column of ids, in ascending order of the documents' ids.

A file holds one range of ids; `part` and `row` are a document's file and place in it, `n_tokens` its number of ids with
the end id. Row groups and pages are of set sizes, ids are dictionary or delta encoded, and the writer's page index
lets a reader skip pages by doc_id; columns are apart, so lengths and places are read without any token.

Defined results: a null text has only the end id; documents with a null id come first; repeated ids are
ordered by a hash of their text; a very long text is one row, whatever its length; an empty table gives files without
rows; only the id and the text of the given table are read, so its other columns may have any names.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.llm.bpe import MARKS, byte_alphabet, library, plain_words
from rankwell.llm.chunked import Kept, distinct, joined, made, parts
from rankwell.llm.common import cut, new_path

#: Bytes of text of a file, bytes of a row group and of a page, rows of a page.
FILE_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 128 << 20, 8 << 20, 256 << 10, 1000
#: Files whose sums are added up in one window.
GROUPED = 4096
#: Bytes of text that are taken apart together.
SLICE = 4 << 20
#: Words, and other chunks, whose ids a worker keeps, at most twice these numbers, of about 200 bytes each. Words have to outlast several slices, each of which may hold 80,000 distinct ones.
WORDS, CHUNKS = 150_000, 30_000
SCHEMA = "doc_id long, part int, row int, n_tokens int, ids array<int>"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


class Encoder:
    """The tokenizers library over the chunks between white space: each distinct one, and each distinct word of letters in them, is encoded once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        self.lib = library(path)
        self.tokenize, self.letters = self.lib.model.tokenize, byte_alphabet()
        self.known, self.words = Kept(self.chunk, CHUNKS), Kept(self.word, WORDS)

    def word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
        return array("i", [t.id for t in self.tokenize(word)]).tobytes() if word else b""

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk, packed."""
        if (pair := plain_words(text)) is not None:
            return self.words[pair[0]] + self.words[pair[1]]
        return array("i", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.ListArray:
        """The ids of whole texts, `end` (packed) after each."""
        chunks, which, starts = distinct(texts)
        ids = made(chunks, MARKS, self.words.__getitem__, self.known.__getitem__)
        ids = pa.concat_arrays([ids, pa.array([end], pa.large_binary())])
        which = np.insert(which, starts[1:], len(chunks))
        flat, at = joined(ids, which, starts + np.arange(len(starts)), 4)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", file_bytes: int | None = None) -> None:
    """Encode every text and write the files below `out`, each of about `file_bytes` of text, FILE_BYTES if unset."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row, end = encoder(path), 0, array("i", [end_id]).tobytes()
        for b in batches:
            at = 0
            for texts in parts(b.column("text"), SLICE):
                lists, n = enc.encode_all(texts, end), len(texts)
                ids, place = b.column("doc_id").slice(at, n), b.column("part").slice(at, n)
                rows = pa.array(np.arange(row, row + n, dtype=np.int32))
                at, row = at + n, row + n
                yield pa.RecordBatch.from_arrays([ids, place, rows, lists.value_lengths(), lists], ["doc_id", "part", "row", "n_tokens", "ids"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = d.repartitionByRange(max(1, math.ceil(size / (file_bytes or FILE_BYTES))), F.asc("doc_id"), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.asc("doc_id"), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    options = ENCODINGS[encoding] | {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS)}
    ranged.mapInArrow(encode, SCHEMA).write.options(**options).parquet(out)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, part, row, n_tokens) without reading a token."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "row", "n_tokens")


def tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All columns of the documents with an id from `first` to `last`; other row groups and pages are skipped."""
    d = spark.read.schema(SCHEMA).parquet(path)
    d = d if first is None else d.filter(F.col("doc_id") >= first)
    return d if last is None else d.filter(F.col("doc_id") <= last)


def with_starts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """`rows` with `start`, the number of ids before each document: sums over groups of files, over the files of a group, then within each file. The files' sums come from `sizes`, as `lengths` gives them, or from `rows`."""
    earlier = W.unboundedPreceding, -1
    files = (rows if sizes is None else sizes).groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("part") / GROUPED))
    files = cut(files)  # a row a file
    groups = files.groupBy("group").agg(F.sum("n").alias("m")).select("group", F.coalesce(F.sum("m").over(W.orderBy("group").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("group").orderBy("part").rowsBetween(*earlier)), F.lit(0))
    first = files.withColumn("first", first).join(groups, "group").select("part", (F.col("first") + F.col("base")).alias("first"))
    before = W.partitionBy("part").orderBy("row").rowsBetween(*earlier)
    out = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(first, "part")
    return out.withColumn("start", (F.col("first") + F.col("before")).cast("long")).drop("first", "before")


def checksums(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, row, n_tokens, ids_crc32): each from the ids themselves."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            flat, size = memoryview(flat).cast("B"), 4 * at
            crc = np.array([zlib.crc32(flat[s:e]) for s, e in zip(size, size[1:])], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(sums, "doc_id long, part int, row int, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Write the files, by default below the shared folder, and describe each document from them: (id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    write(docs, out, path, end_id, id_col, text_col)
    found = with_starts(checksums(tokens(spark, out)), lengths(spark, out))
    return found.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
