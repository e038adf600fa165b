"""The relational operators, each as the DataFrame operation that Catalyst plans best."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]

#: A block of a range join has at most 2 ** 8 rows, so that a pair of blocks makes at most 65,536.
BLOCK_BITS = 8


def scan(df: DataFrame, columns: Keys | None = None) -> DataFrame:
    return df.select(*columns) if columns else df


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows on which all conditions hold."""
    return df.filter(reduce(and_, conditions)) if conditions else df


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def row_function(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed from others of the same row."""
    return df.withColumn(name, value)


def join(left: DataFrame, right: DataFrame, *conditions: Column, how: str = "inner") -> DataFrame:
    """Inner or outer join on all conditions; equalities make it a hash or merge join, the rest are filters in it."""
    return left.join(right, reduce(and_, conditions), how) if conditions else left.crossJoin(right)


def _blocks(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows in the order of a column, by blocks: the block's number and bounds and its rows. Rows without a value are left out.

    All columns give the order, so that equal values are spread too and a repeated task makes the same blocks.
    """
    order = [column, *(c for c in df.columns if c != column)]
    rows = df.filter(F.col(column).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = rows.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias(f"{name}_block"), F.col(column).alias("_at"), F.struct(*df.columns).alias("_row"))
    return numbered.groupBy(f"{name}_block").agg(F.min("_at").alias(f"{name}_least"), F.max("_at").alias(f"{name}_most"), F.collect_list("_row").alias(name))


def range_join(left: DataFrame, right: DataFrame, column: str, right_column: str) -> DataFrame:
    """Inner join of rows whose value in `left` is at least the one in `right`; columns must have an order.

    Only pairs of blocks that can have partners are formed, dealt out evenly and opened, so the work is
    that of the result's rows, however these lie in the tables. A task that opens pairs holds one at a time; one that forms them
    holds a block's pairs, as many as there are blocks in the broadcast side, if one is broadcast.
    """
    pairs = _blocks(left, column, "_l").join(_blocks(right, right_column, "_r"), F.col("_l_most") >= F.col("_r_least"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since adaptive execution would merge by the pairs' size, not the result's
    opened = pairs.repartition(parts, "_l_block", "_r_block").select(F.explode("_l").alias("_l"), "_r").select("_l", F.explode("_r").alias("_r"))
    return opened.filter(F.col(f"_l.{column}") >= F.col(f"_r.{right_column}")).select("_l.*", "_r.*")


def semi_join(left: DataFrame, right: DataFrame, keys: Keys, right_keys: Keys | None = None, selected: Column | None = None) -> DataFrame:
    """Rows of `left` with a partner among the (selected) rows of `right`."""
    right = right if selected is None else right.filter(selected)
    other = right.select(*(F.col(c).alias(f"_r_{k}") for k, c in zip(keys, right_keys or keys, strict=True)))
    return left.join(other, reduce(and_, (F.col(k) == F.col(f"_r_{k}") for k in keys)), "left_semi")


def range_semi_join(left: DataFrame, right: DataFrame, column: str, right_column: str) -> DataFrame:
    """Rows of `left` whose value is at least some value of `right`: only the smallest one counts, so one number crosses over."""
    return left.crossJoin(F.broadcast(right.agg(F.min(right_column).alias("_least")))).filter(F.col(column) >= F.col("_least")).drop("_least")


def group(df: DataFrame, keys: Keys, *aggregates: Column, having: Column | None = None) -> DataFrame:
    """Aggregates by group (or of all rows without keys), combined map-side, and then the groups that `having` leaves."""
    out = df.groupBy(*keys).agg(*aggregates)
    return out if having is None else out.filter(having)


def group_count(df: DataFrame, keys: Keys, name: str = "cnt") -> DataFrame:
    return group(df, keys, F.count(F.lit(1)).alias(name))


def group_min_max(df: DataFrame, keys: Keys, low: str, high: str) -> DataFrame:
    return group(df, keys, F.min(low).alias(f"min_{low}"), F.max(high).alias(f"max_{high}"))


def group_sum(df: DataFrame, keys: Keys, *columns: str) -> DataFrame:
    return group(df, keys, *(F.sum(c).alias(f"sum_{c}") for c in columns))


def group_average(df: DataFrame, keys: Keys, column: str) -> DataFrame:
    """The average together with the sum and count it is made of."""
    total, n = F.sum(column), F.count(column)
    return group(df, keys, total.alias(f"sum_{column}"), n.alias(f"count_{column}"), (total.cast("double") / n).alias(f"avg_{column}"))


def partial_sum_join(left: DataFrame, right: DataFrame, key: str, right_key: str, value: str, name: str = "partial") -> DataFrame:
    """Each row of `left` with the sum of `value` over its partners, 0 without any; `right` is summed before it is joined."""
    sums = right.groupBy(F.col(right_key).alias("_k")).agg(F.sum(value).alias("_sum"))
    return left.join(sums, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_sum", F.lit(0))).drop("_k", "_sum")


def join_group_sum(left: DataFrame, right: DataFrame, key: str, right_key: str, value: str, group_keys: Keys) -> DataFrame:
    """Sum of the partners' `value` by group of `left`: partial sums first, then their sum."""
    return group(partial_sum_join(left, right, key, right_key, value), group_keys, F.sum("partial").alias(f"sum_{value}"))


def distinct(df: DataFrame, *columns: str, selected: Column | None = None) -> DataFrame:
    """Distinct rows of the columns, of selected rows only if asked for."""
    df = df if selected is None else df.filter(selected)
    return (df.select(*columns) if columns else df).distinct()


def first_of_run(df: DataFrame, keys: Keys, order: Keys, name: str = "is_first") -> DataFrame:
    """Marks the first row of each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def order_by(df: DataFrame, keys: Keys, ascending: Sequence[bool] | None = None) -> DataFrame:
    return df.orderBy(*keys, ascending=list(ascending or [True] * len(keys)))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order, without sorting the rest."""
    return df.orderBy(*order).limit(n)


def adjacent(df: DataFrame, partition: Keys, order: str, columns: Keys, consecutive: bool = False) -> DataFrame:
    """Each row with the next row's columns as `next_<name>`; with `consecutive`, only if the next row's order value is one more."""
    window = W.partitionBy(*partition).orderBy(order)
    following = F.lead(F.struct(order, *(c for c in columns if c != order))).over(window)
    out = df.withColumn("_next", following).filter(F.col("_next").isNotNull())
    if consecutive:
        out = out.filter(F.col(f"_next.{order}") == F.col(order) + 1)
    return out.select("*", *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns)).drop("_next")


def adjacent_at_least(df: DataFrame, partition: Keys, order: str, column: str, name: str = "bit") -> DataFrame:
    """For each row with a next one: is the next value at least this one?"""
    return adjacent(df, partition, order, [column]).withColumn(name, F.col(f"next_{column}") >= F.col(column))
