"""The corpus queries and their SQL, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commonloom.llm import bpe, exact_dedup, html_extract, lang_id, line_dedup, ngram_join, packing, quality_gam, quality_rules, substring_dedup
from commonloom.llm.common import read_table


def _on(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, table))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.op4(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": _on("documents", lang_id.op1),
    "op2_ngram_join": _on("documents", ngram_join.op2),
    "op3_packing": _on("documents", packing.op3),
    "op4_quality_gam": _op4,
    "op5_line_dedup": _on("documents", line_dedup.op5),
    "op6_exact_dedup": _on("documents", exact_dedup.op6),
    "op7_bpe": _on("documents", bpe.op7),
    "op8_substring_dedup": _on("documents", substring_dedup.op8),
    "op9_html_extract": _on("pages", html_extract.op9),
    "op10_quality_rules": _on("documents", quality_rules.op10),
    "pipeline": _pipeline,
}

SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
