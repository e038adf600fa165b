"""A corpus pipeline of five operators, each stage over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commonloom.llm import line_dedup, ngram_join, packing, quality_gam, substring_dedup
from commonloom.llm.common import NO_ID, checkpointed, mark_keyed, quoted, read_table, shared_folder


def boxed(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct beside id and text, so that no column of theirs clashes with an operator's."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("whole"), "doc_id", "text")


def unboxed(rows: DataFrame, docs: DataFrame, kept: str | None = None, changed: Column | None = None) -> DataFrame:
    """The columns of `docs` from boxed rows; where `changed`, with the text `kept` and its length."""
    new = {}
    if kept is not None:
        text = F.when(changed, F.col(kept)).otherwise(F.col("whole")["text"])
        size = F.when(changed, F.char_length(kept)).otherwise(F.col("whole")["n_chars"]) if "n_chars" in docs.columns else None
        new = {"text": text.alias("text")} | ({} if size is None else {"n_chars": size.cast(docs.schema["n_chars"].dataType).alias("n_chars")})
    return rows.select(*(new.get(c, F.col("whole")[c].alias(c)) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    model = quality_gam.learn(docs, read_table(spark, sf_dir, "labels"))
    return unboxed(quality_gam.score_quality(boxed(docs), model).where("quality_score >= 0.5"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that many documents share stay in one of them only."""
    return unboxed(line_dedup.line_dedup(boxed(docs)), docs, "kept_text", F.col("n_dropped") > 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    Documents without an id all stay. Of rows with the same id and text one stays, whichever has the smallest hash.
    """
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("_keep")
    marks = ngram_join.jaccard_groups(docs).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.coalesce(F.col("component_id") != F.col("doc_id"), F.lit(False))).alias("_gone"))
    rows = mark_keyed(boxed(docs).select("*", key), checkpointed(marks.where("_gone OR _rows > 1")), ["_keep"])
    once, repeated = rows.where("_rows IS NULL"), rows.where("NOT _gone")
    one = F.min_by("whole", F.xxhash64(F.to_json("whole"))).alias("whole")
    return unboxed(once.select("whole").union(repeated.groupBy("doc_id", "text").agg(one).select("whole")), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat."""
    return unboxed(substring_dedup.substring_dedup(boxed(docs)), docs, "kept_text", F.col("n_removed") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("passages", passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over `documents`; each stage is written to the shared folder and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
