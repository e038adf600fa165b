"""Forms of joins that Catalyst doesn't find by itself, as functions of DataFrames.

Each gives what the plain join gives, with less to join or to shuffle. Which physical join and
which broadcast carry them out stays with Catalyst and adaptive execution. They pay where both
sides are shuffled anyway; where the side of the keys is small enough to be broadcast, the plain
join shuffles nothing either and may be as quick.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_of_join(kept: DataFrame, other: DataFrame, on: Column | Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """DISTINCT `keys` of `kept` over its inner join with `other`, as a semi-join: partners never multiply rows."""
    return kept.join(other, reduce(and_, [on] if isinstance(on, Column) else on), "left_semi").select(*keys).distinct()


def count_of_join(kept: DataFrame, other: DataFrame, on: Mapping[str, str], keys: Sequence[str], name: str, of: str | None = None, how: str = "inner") -> DataFrame:
    """COUNT by `keys` of `kept` over its equi-join with `other`, which is counted by its join keys first; the counts are added up.

    `on`: columns of `kept` to those of `other`; `of`: a column of `other` to count, else rows. A
    left join that counts rows gives 1, and one that counts a column 0, to rows without a partner;
    an inner join drops them. Null join keys have no partner.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join must be inner or left, not {how}")
    counted = F.count(F.lit(1) if of is None else F.col(of))
    counts = other.groupBy(*(F.col(c).alias(f"_j{i}") for i, c in enumerate(on.values()))).agg(counted.alias("_n"))
    joined = kept.join(counts, reduce(and_, (F.col(c) == F.col(f"_j{i}") for i, c in enumerate(on))), how)
    alone = F.lit(1 if of is None else 0).cast("long")
    return joined.groupBy(*keys).agg(F.sum(F.coalesce("_n", alone)).alias(name))


def with_next_row(rows: DataFrame, equal: Sequence[str], row: str, columns: Sequence[str]) -> DataFrame:
    """A relation joined with itself on equal columns and the next number in `row`, as one window: each row with the next one's `columns` as `next_<name>`.

    Numbers must not repeat within the equal columns. Rows without a next one, and with a null
    among the equal columns, are left out, as the join would.
    """
    window = W.partitionBy(*equal).orderBy(row)
    known = rows.filter(reduce(and_, (F.col(c).isNotNull() for c in equal)))
    found = known.withColumn("_next", F.lead(F.struct(row, *(c for c in columns if c != row))).over(window)).filter(F.col(f"_next.{row}") == F.col(row) + 1)
    return found.select("*", *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns)).drop("_next")


def distinct_count_by_extremes(left: DataFrame, right: DataFrame, key: str, left_value: str, op: str, right_value: str, name: str) -> DataFrame:
    """COUNT(DISTINCT key) over equal keys and `left_value op right_value` (< <= > >=): each side keeps one row a key, the one most likely to fit."""
    low, high = (F.min, F.max) if op in ("<", "<=") else (F.max, F.min)
    a = left.groupBy(F.col(key).alias("_k")).agg(low(left_value).alias("_a"))
    b = right.groupBy(F.col(key).alias("_k")).agg(high(right_value).alias("_b"))
    fits = {"<": F.col("_a") < F.col("_b"), "<=": F.col("_a") <= F.col("_b"), ">": F.col("_a") > F.col("_b"), ">=": F.col("_a") >= F.col("_b")}[op]
    return a.join(b, "_k").filter(fits).agg(F.count(F.lit(1)).alias(name))
