"""Cleaning of tables: typed columns, imputed and scaled; the statistics are one row, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions.columns import boolish, first_number
from rankwell.operators.order import shuffle_split
from rankwell.sources.files import useful


def typed(df: DataFrame, numeric: list[str], boolean: list[str], label: str | None = None) -> DataFrame:
    """Messy text columns as doubles; what can't be read is null."""
    out = {c: first_number(F.col(c)) for c in numeric if c in df.columns}
    out |= {c: boolish(F.col(c)) for c in boolean if c in df.columns}
    if label and label in df.columns:
        out[label] = first_number(F.col(label))
    return df.withColumns(out)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's mean; a column of nulls stays null."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the most frequent value of each column, the smallest of equally frequent ones."""
    counts = [df.groupBy(F.col(c).cast("string").alias("v")).count().filter("v is not null").select(F.lit(c).alias("name"), "v", "count") for c in columns]
    long = counts[0]
    for c in counts[1:]:
        long = long.unionByName(c)
    return long.groupBy("name").agg(F.min(F.struct((-F.col("count")).alias("c"), "v")).alias("m")).select("name", F.col("m.v").alias("mode"))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0, a column of nulls stays."""
    ends = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])

    def scaled(c: str):
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when(F.col(c).isNotNull() & (hi == lo), 0.0).otherwise((F.col(c) - lo) / (hi - lo)).alias(c)

    return df.crossJoin(F.broadcast(ends)).select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def null_counts(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows (name, nulls) of the n columns with the most nulls."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "name", "nulls").orderBy(F.desc("nulls"), "name").limit(n)


def pipeline(raw: DataFrame, key: str, numeric: list[str], boolean: list[str], label: str, held: int, seed: int = 42) -> DataFrame:
    """The useful columns of a text table, typed, imputed, scaled, and split into val, train and test."""
    d = typed(useful(raw, [key, label, *numeric, *boolean]), numeric, boolean, label)
    columns = [c for c in (*numeric, *boolean) if c in d.columns]
    return shuffle_split(minmax(impute_mean(d, columns), columns), key, held, seed)
