"""SQL texts with named constants, run by Spark's own parser and analyser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from commonloom.sources.catalog import Catalog

_SHARED = re.compile(r"\[(\w+)\]")


def run_sql(spark: SparkSession, text: str, catalog: Catalog | None = None, **constants: object) -> DataFrame:
    """A query in which `[x]` is the column x and quoted names of `constants` stand for their values.

    Constants become bound parameters, so they keep their types and can't change the query. With
    a catalog, its relations are the views; unknown relations, columns and ambiguous names are
    analysis errors.
    """
    if catalog is not None:
        for name, df in catalog.relations.items():
            df.createOrReplaceTempView(name)
    text = _SHARED.sub(r"\1", text.strip().rstrip(";"))
    for name in constants:
        text = re.sub(rf"'{re.escape(name)}'", f":{name}", text)
    return spark.sql(text, args=constants) if constants else spark.sql(text)
