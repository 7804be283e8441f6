"""Row numbers, ranks and batches over whole tables without gathering them in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.functions.columns import draw_key
from rankwell.sources.shared import cut


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """`df` with the 1-based number of each row in the given order, within equal values of `by`.

    Rows are dealt by ranges of (by, order), numbered within each range, and raised by the number of rows in the ranges
    before. The order must be total for the numbers to be repeatable.
    """
    by = by or []
    ranged = df.repartitionByRange(*[F.asc(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    d = cut(ranged)  # else each use of the plan might draw other range bounds
    local = F.row_number().over(W.partitionBy("__part", *by).orderBy(*order))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sizes = d.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__part") == F.col("__p"))
    out = d.withColumn(name, local).join(sizes, same)
    return out.withColumn(name, (F.col(name) + F.col("__first")).cast("long")).select(*df.columns, name)


def batch_of(rn: Column, size: int) -> Column:
    """The batch of a 1-based row number, from 0."""
    return F.floor((rn - 1) / F.lit(size)).cast("long")


def draw_order(df: DataFrame, element_id: str, by: list[str] | None = None, seed: int = 42, name: str = "ord") -> DataFrame:
    """`df` numbered in a random-looking, repeatable order; see `columns.draw_key`."""
    key = df.withColumn("__key", draw_key(F.col(element_id), seed))
    return numbered(key, [F.asc("__key"), F.asc(element_id)], by, name).drop("__key")


def exact_sample(df: DataFrame, element_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, all if there are fewer, none for n <= 0. For an n that is itself large use `draw_order`."""
    return df.orderBy(draw_key(F.col(element_id), seed), element_id).limit(max(0, n))


def shuffle_split(df: DataFrame, element_id: str, held: int, seed: int = 42) -> DataFrame:
    """`df` with `part`: val for the first `held` rows in draw order, then train for two thirds of the rest, then test."""
    d = draw_order(df, element_id, None, seed, "__ord")
    rest = F.greatest(F.lit(df.count() - held), F.lit(0))
    train = F.floor(rest * 2 / 3)
    part = F.when(F.col("__ord") <= held, "val").when(F.col("__ord") <= held + train, "train").otherwise("test")
    return d.withColumn("part", part).drop("__ord")
