import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from commonloom.plans.sql import run_sql
from commonloom.sources import text
from commonloom.sources.catalog import Catalog, parse_schemas, sharing
from commonloom.streaming.counts import windowed_counts


def test_schema_file(spark):
    catalog = Catalog(spark)
    catalog.add_schemas("# B, A\nR(id, ak)\n\n# B\nS([id])\n")
    assert catalog["R"].columns == ["id", "ak"]
    assert sharing(catalog["R"]) == {"id": "B", "ak": "A"}
    assert catalog["S"].columns == ["id"]
    catalog.column("R", "R.[ak]")
    for wrong in ("S.[ak]", "[zz]"):
        with pytest.raises(KeyError):
            catalog.column("R", wrong)
    with pytest.raises(ValueError):
        catalog.add("R", catalog["S"])
    with pytest.raises(KeyError):
        catalog["T"]


@pytest.mark.parametrize("wrong", ["R(id)", "# B\nR(id, x)", "# Q\nR(id)", "# B\nR(id)\n# B\nR(id)", "nonsense"])
def test_schema_file_mistakes(wrong):
    with pytest.raises(ValueError):
        parse_schemas(wrong)


def test_braces(spark, tmp_path):
    (tmp_path / "r.txt").write_text("{{1,2,3}, {4,5,-6},\n {7,8,9}}\n")
    rows = text.read_braced(spark, str(tmp_path / "r.txt"), ["a", "b", "c"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2, 3), (4, 5, -6), (7, 8, 9)]
    for bad in ("{{1,2},{3}", "{{1,x}}", "", "{{1,2}} tail"):
        with pytest.raises(Exception, match="braces|numbers"):
            text.rows_of_braced(spark.createDataFrame([(bad,)], "t string"), "t", ["a", "b"]).collect()
    with pytest.raises(Exception, match="numbers"):
        text.rows_of_braced(spark.createDataFrame([("{{1,2,3}}",)], "t string"), "t", ["a", "b"]).collect()


def test_random_open_write(spark, tmp_path):
    rows = text.random_table(spark, 500, ["a", "b"], seed=3)
    opened = text.open_relation(rows)
    assert len(opened["a"]) == 500 and 0 <= min(opened["a"]) and max(opened["b"]) < 100
    with pytest.raises(ValueError):
        text.open_relation(rows, most=10)
    text.write_relation(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def test_sql_constants_and_errors(spark):
    catalog = Catalog(spark)
    catalog.add("R", spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "id long, ak long"))
    assert [tuple(r) for r in run_sql(spark, "SELECT DISTINCT R.[id] FROM R WHERE R.[ak] = 'c';", catalog, c=5).collect()] == [(1,)]
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT nothing FROM R", catalog)
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT * FROM no_such_relation", catalog)


def test_counts_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, id % 3 AS k FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = windowed_counts(stream, "ts", ["k"], "1 hour", "10 minutes", F.col("k") > 0)
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("counted")) == key(windowed_counts(rows, "ts", ["k"], "1 hour", "10 minutes", F.col("k") > 0))
