"""Tables written as nested braces, random tables, and ways out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"\s*-?\d+\s*"
_ROW = rf"\s*\{{{_NUMBER}(,{_NUMBER})*\}}\s*"
_TABLE = rf"(?s)^\s*\{{\s*({_ROW}(,{_ROW})*)?\}}\s*$"


def braced(text: Column) -> Column:
    """`{{1, 2}, {3, 4}}` as array<array<bigint>>; anything else is an error."""
    rows = F.from_json(F.translate(text, "{}", "[]"), "array<array<bigint>>")
    return F.when(text.rlike(_TABLE), rows).otherwise(F.raise_error(F.concat(F.lit("not a table in braces: "), F.coalesce(F.substring(text, 1, 60), F.lit("null")))))


def rows_of_braced(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """A row for each inner brace; rows of another width than `columns` are an error."""
    cells = F.col("_cells")
    wide = F.when(F.size(cells) == len(columns), cells).otherwise(F.raise_error(F.lit(f"a row doesn't have {len(columns)} numbers")).cast("array<bigint>"))
    rows = df.select(F.explode(braced(F.col(text))).alias("_cells")).select(wide.alias("_cells"))
    return rows.select(*(F.element_at("_cells", i + 1).alias(c) for i, c in enumerate(columns)))


def read_braced(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files of which each holds one table in braces."""
    return rows_of_braced(spark.read.text(path, wholetext=True), "value", columns)


def random_table(spark: SparkSession, rows: int, columns: list[str], seed: int = 0, below: int = 100) -> DataFrame:
    """Whole numbers from 0 up to `below`, uniform; the same for the same seed and partitions."""
    return spark.range(rows).select(*(F.floor(F.rand(seed + i) * below).cast("long").alias(c) for i, c in enumerate(columns)))


def open_relation(df: DataFrame, most: int = 100_000) -> dict[str, list]:
    """The relation column by column, for small results; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the relation instead")
    return {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}


def write_relation(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
