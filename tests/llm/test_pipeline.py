"""The pipeline's stages, each against a brute-force version on its own input, and the registered queries."""

from collections import Counter

from odd import by_row, odd_docs, removed_by_windows, shingles
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from commonloom.llm import common, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    before, kept = {}, {}
    for name, stage in pipeline.STAGES:
        before[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert out.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    assert set(kept["quality"]) < set(before["quality"])
    assert set(kept["lines"]) == set(before["lines"])
    near, gone = kept["near_copies"], set(before["near_copies"]) - set(kept["near_copies"])
    sets = {i: shingles(t, 5) for i, t in before["near_copies"].items()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert gone and all(any(j != i and alike(sets[i], sets[j]) for j in sets) for i in gone)
    ids = sorted(near)
    assert not any(alike(sets[i], sets[j]) for n, i in enumerate(ids) for j in ids[:n])
    left = before["passages"]
    for (i, text), (w, lost) in zip(left.items(), removed_by_windows(list(left.values())), strict=True):
        assert kept["passages"][i] == (" ".join(x for x, g in zip(w, lost, strict=True) if not g) if any(lost) else text)
    packed = Counter()
    for r in docs.collect():
        packed[r["doc_id"]] += r["length"]
        assert packed[r["doc_id"]] <= r["doc_tokens"]
    assert set(packed) == set(kept["passages"])


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


CLASHES = ("n_dropped", "_kept", "kept_text", "keep_words", "n_lines", "quality_score", "whole", "component_id", "_keep", "_rows", "n_removed", "n_words", "_k2", "_text", "a.b", "b`c", "_id", "_block")


def clashing_docs(spark):
    docs = odd_docs(spark)
    return docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES))


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """With null, empty, long and repeated texts, null and repeated ids, and columns named as the operators' own."""
    docs = clashing_docs(spark)
    columns = docs.columns
    rest = [common.quoted(c) for c in columns if c not in ("text", "n_chars")]
    seen = by_row(docs, *rest)
    for name, stage in pipeline.STAGES[1:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns, name
        kept = by_row(docs, *rest)
        assert kept <= seen if name == "near_copies" else kept == seen, name
        seen = kept
    packed = pipeline.pack(spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_quality_stage_keeps_columns(spark):
    docs = clashing_docs(spark)
    rest = [common.quoted(c) for c in docs.columns]
    out = pipeline.quality(spark, docs, DATA)
    assert out.columns == docs.columns
    assert by_row(out, *rest) <= by_row(docs, *rest)


def test_empty_tables_pass_all_stages(spark):
    docs = clashing_docs(spark).limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        assert out.columns == docs.columns or name == "packing"


def test_registry():
    found = {q.split("_")[0] for q in queries.QUERIES}
    assert found == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(queries.SQL) <= set(queries.QUERIES)
