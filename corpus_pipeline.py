"""A corpus from raw documents to token digests: language, boilerplate lines, near-duplicates, benchmark items, BPE.

Every stage takes the documents its predecessor kept and returns the columns of documents, the last one a row of
digests for each document that is left. run() writes each stage's result to the shared folder and reads it back.

Defined results: each stage has its operator's for nulls, empty and very long texts, ties and repeated rows; further
columns of documents pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import bpe, decontam, langid, linededup, nearcopies
from rankwell.llm.common import fresh, new_path
from rankwell.llm.queries import piece_path, table, vocabulary_path

#: Share of the likelihoods that the likeliest language must have.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or of an undecided language go."""
    model = langid.fit_on(docs, piece_path())
    p = fresh(docs, "__p")
    judged = docs.withColumn(p, langid.predict(model, docs))
    return judged.filter((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    out = linededup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five-word shingles of similarity 0.8 or more."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    question, answer = decontam.split_answer(F.col("text"))
    held, flag = decontam.flags(docs, table(spark, sf_dir, "benchmark"), question, answer), fresh(docs, "__held")
    return docs.withColumn(flag, held).filter(~F.col(flag)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of each document."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Fingerprints and language likelihoods have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages make of the documents."""
    docs, base = table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
