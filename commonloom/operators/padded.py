"""Padded mode: rows are marked instead of removed, so that a result shows only its input's size.

The mark is a boolean column of its own. The -1 of masked rows is for display; whether a row
counts is always asked of the mark, never of the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEL = "__sel"
MASKED = -1


def padded(df: DataFrame) -> DataFrame:
    return df if SEL in df.columns else df.withColumn(SEL, F.lit(True))


def select_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Marks stay only where the condition holds too; unknown counts as false."""
    return padded(df).withColumn(SEL, F.col(SEL) & F.coalesce(condition, F.lit(False)))


def semi_join_rows(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Marks stay where a marked row of `right` has the key."""
    keys = compact(padded(right)).select(F.col(right_key).alias("_k")).distinct()
    found = padded(left).join(keys, F.col(key) == F.col("_k"), "left")
    return found.withColumn(SEL, F.col(SEL) & F.col("_k").isNotNull()).drop("_k")


def distinct_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mark stays on one marked row of each key."""
    order = W.partitionBy(SEL, *keys).orderBy(*(c for c in df.columns if c != SEL))
    return padded(df).withColumn(SEL, F.col(SEL) & (F.row_number().over(order) == 1))


def group_rows(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], order: Sequence[str]) -> DataFrame:
    """Every row with the aggregates of its group's marked rows; the mark stays on one marked row of each group, the first in `order`."""
    rows = padded(df)
    marked = rows.filter(SEL).groupBy(*keys).agg(*(value.alias(name) for name, value in aggregates.items()))
    first = F.row_number().over(W.partitionBy(*keys, SEL).orderBy(*order)) == 1
    joined = rows.withColumn(SEL, F.col(SEL) & first).alias("l").join(marked.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    return joined.select("l.*", *(F.coalesce(F.col(f"r.{n}"), F.lit(0)).alias(n) for n in aggregates))


def join_rows(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """All pairs of rows, marked where both are and the condition holds: the size shows nothing, at the price of the product. For small relations."""
    other = padded(right).withColumnRenamed(SEL, "_other")
    pairs = padded(left).crossJoin(other)
    return pairs.withColumn(SEL, F.col(SEL) & F.col("_other") & F.coalesce(condition, F.lit(False))).drop("_other")


def count_rows(df: DataFrame, name: str = "cnt") -> DataFrame:
    return df.agg(F.count_if(SEL).alias(name))


def mask(df: DataFrame) -> DataFrame:
    """Rows without the mark show -1 in every column."""
    shown = (F.when(F.col(SEL), F.col(c)).otherwise(F.lit(MASKED).cast(df.schema[c].dataType)).alias(c) for c in df.columns if c != SEL)
    return df.select(*shown, SEL)


def compact(df: DataFrame) -> DataFrame:
    """The rows that are marked, as an ordinary relation."""
    return df.filter(SEL).drop(SEL)
