"""Single operators and whole queries on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from commonloom.functions import algebra as X
from commonloom.functions import shares as S
from commonloom.operators import padded as P
from commonloom.operators import relational as R
from commonloom.queries import QUERIES


def table(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns.split()))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_comorbidity(spark):
    diagnosis = table(spark, "pid diag", [(0, 10), (1, 10), (2, 11), (3, 9), (4, 7), (5, 8), (6, 8), (7, 8)])
    cohort = table(spark, "pid", [(x,) for x in (0, 1, 3, 5, 6, 7, 30, 30)])
    out = R.top(R.group_count(R.semi_join(diagnosis, cohort, ["pid"]), ["diag"]), 10, F.desc("cnt"), F.asc("diag"))
    assert [tuple(r) for r in out.collect()] == [(8, 3), (10, 2), (9, 1)]


def test_password_reuse(spark):
    rows = table(spark, "uid pwd", [(0, 1), (0, 1), (1, 11), (2, 9), (2, 7), (5, 8), (6, 8), (1, 11)])
    assert got(R.group(rows, ["uid", "pwd"], F.count(F.lit(1)).alias("n"), having=F.col("n") > 1).drop("n")) == [(0, 1), (1, 11)]


def test_credit_score(spark):
    rows = table(spark, "uid year score", [(0, 2019, 400), (1, 2019, 700), (0, 2019, 1500), (0, 2018, 1200), (2, 2010, 500), (3, 2012, 0), (2, 2019, 1200), (2, 2019, 1500)])
    out = R.where(R.group_min_max(R.where(rows, F.col("year") == 2019), ["uid"], "score", "score"), F.col("max_score") - F.col("min_score") > 500)
    assert got(out.select("uid")) == [(0,)]


def test_revenue_with_both_bounds_of_the_date(spark):
    rows = [(55, 10, 6, 152), (250, 44, 6, 152), (144, 44, 6, 152), (100, 18, 4, 152), (123, 15, 8, 152), (150, 17, 5, 152), (150, 17, 7, 152), (150, 19, 6, 152), (250, 10, 6, 152)]
    lines = table(spark, "ship qty disc price", rows)
    out = R.where(lines, F.col("ship") >= 100, F.col("ship") < 200, F.col("disc").between(5, 7), F.col("qty") < 24)
    assert got(R.group(out, [], F.sum(F.col("price") * F.col("disc")).alias("s"))) == [(2736,)]


def test_filtered_join_count(spark):
    r1 = table(spark, "id att", [(1, 99), (2, -8), (3, 99), (4, 99), (5, 99), (6, 14)])
    r2 = table(spark, "id2 att2", [(1, -4), (3, 2), (5, -4), (7, -4)])
    out = R.join(R.where(r1, F.col("att") == 99), R.where(r2, F.col("att2") == -4), F.col("id") == F.col("id2"))
    assert out.count() == 2


def test_semi_join_marks(spark):
    left = table(spark, "k i", [(k, i) for i, k in enumerate((1, 2, 3, 4, 5, 5, 5, 17, 0, 5555))])
    right = table(spark, "k", [(1,), (3,), (5,), (5555,)])
    marks = {r["i"]: r[P.SEL] for r in P.semi_join_rows(left, right.withColumnRenamed("k", "rk"), "k", "rk").collect()}
    assert [int(marks[i]) for i in range(10)] == [1, 0, 1, 0, 1, 1, 1, 0, 0, 1]
    assert R.semi_join(left, right, ["k"]).count() == 6


def test_distinct_of_selected(spark):
    rows = table(spark, "k sel", [(1, 1), (2, 0), (2, 1), (2, 0), (7, 0)])
    assert got(R.distinct(rows, "k", selected=F.col("sel") == 1)) == [(1,), (2,)]
    marked = P.distinct_rows(P.select_rows(rows, F.col("sel") == 1), ["k"])
    assert marked.count() == 5
    assert got(P.compact(marked).select("k")) == [(1,), (2,)]


def test_sort_on_three_keys(spark):
    rows = [(2, 42, 3), (1, 42, 12), (3, 42, 133), (15, 142, 11), (2, 42, 1), (17, 43, 43), (1, 44, 0), (255, 1, 0)]
    out = R.order_by(table(spark, "a b c", rows), ["a", "b", "c"], [True, False, True])
    assert [tuple(r) for r in out.collect()] == [(1, 44, 0), (1, 42, 12), (2, 42, 1), (2, 42, 3), (3, 42, 133), (15, 142, 11), (17, 43, 43), (255, 1, 0)]


def test_group_min_max_of_selected(spark):
    rows = [(1, 10, 1, 1), (1, 10, 3, 3), (1, 10, 6, 6), (4, 11, 2, 12), (4, 12, 7, 7), (6, 12, 11, 11), (6, 12, 4, 4), (6, 12, 2, 2)]
    marked = table(spark, "k1 k2 a b sel", [(*r, s) for r, s in zip(rows, (1, 1, 1, 0, 1, 1, 1, 0), strict=True)])
    out = R.group_min_max(R.where(marked, F.col("sel") == 1), ["k1", "k2"], "a", "b")
    assert got(out) == [(1, 10, 1, 6), (4, 12, 7, 7), (6, 12, 4, 11)]
    masked = P.mask(P.select_rows(marked.select("k1", "k2", "a", "b", "sel"), F.col("sel") == 1))
    assert sum(tuple(r)[:4] == (-1, -1, -1, -1) for r in masked.collect()) == 2


def test_join_group_sum_keeps_groups_without_partners(spark):
    left = table(spark, "id g", [(1, 10), (2, 10), (4, 10), (3, 11), (5, 12), (6, 12), (2, 12), (0, 13)])
    right = table(spark, "rid score", [(1, 10), (2, 20), (3, 10), (4, -5), (5, 5), (6, 0)])
    assert got(R.join_group_sum(left, right, "id", "rid", "score", ["g"])) == [(10, 25), (11, 10), (12, 25), (13, 0)]


def test_adjacent_at_least(spark):
    rows = table(spark, "p i x", [(0, i, x) for i, x in enumerate((2, 1, 2, 3, 15, 15, 15, 17, 19, 18))])
    bits = R.adjacent_at_least(rows, ["p"], "i", "x").orderBy("i").collect()
    assert [int(r["bit"]) for r in bits] == [0, 1, 1, 1, 1, 1, 1, 1, 0]


def test_average_and_empty_input(spark):
    empty = table(spark, "k v", [])
    assert R.group_average(empty, ["k"], "v").collect() == []
    assert R.group(empty, [], F.count(F.lit(1)).alias("n")).first()["n"] == 0
    assert tuple(R.group_average(table(spark, "k v", [(1, 2), (1, 5)]), ["k"], "v").first()) == (1, 7, 2, 3.5)


def test_comparisons(spark):
    x = (111, -4, -17, 2345, 999, 0, -28922, 1231241, 0, 23437)
    y = (0, -4, -5, 123556, 999, 70, -243242, 12421421413421, 0, 78)
    out = table(spark, "i x y", [(i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))])
    assert got(out.filter(X.COMPARISONS["gt"](F.col("x"), F.col("y"))).select("i")) == [(0,), (6,), (9,)]
    assert got(out.filter(X.COMPARISONS["ge"](F.col("x"), F.col("y"))).select("i")) == [(0,), (1,), (4,), (6,), (8,), (9,)]


EDGES = [0, 1, -1, 567778, -567778, 2**63 - 1, -(2**63), 2**63 - 2]


def test_shares_open_to_what_was_shared(spark):
    rows = table(spark, "x", [(x,) for x in EDGES])
    x = F.col("x")
    out = rows.select(
        "x",
        S.open_boolean(S.share_boolean(x, 1, x)).alias("b"),
        S.open_arithmetic(S.share_arithmetic(x, 2, x)).alias("a"),
        S.open_boolean(S.to_boolean(S.share_arithmetic(x, 3, x), 4, x)).alias("ab"),
        S.open_arithmetic(S.to_arithmetic(S.share_boolean(x, 5, x), 6, x)).alias("ba"),
    )
    assert all(r["b"] == r["a"] == r["ab"] == r["ba"] == r["x"] for r in out.collect())


def test_addition_wraps(spark):
    pairs = [(2**63 - 1, 1, -(2**63)), (-(2**63), -1, 2**63 - 1), (567778, -567778, 0), (2**63 - 1, 2**63 - 1, -2)]
    out = table(spark, "a b want", pairs).select(S.wrapping_add(F.col("a"), F.col("b")).alias("got"), "want", S.wrapping_subtract(F.col("want"), F.col("b")).alias("back"), "a")
    assert all(r["got"] == r["want"] and r["back"] == r["a"] for r in out.collect())


def test_random_bits_agree(spark):
    rows = spark.range(200)
    b, a = S.random_bit(9, F.col("id"))
    out = rows.select(S.open_boolean(b).alias("b"), S.open_arithmetic(a).alias("a")).collect()
    assert all(r["a"] == r["b"] and r["a"] in (0, 1) for r in out)
    assert 50 < sum(r["a"] for r in out) < 150


@pytest.mark.parametrize("n", [0, 3, 64])
def test_bits(spark, n):
    rows = table(spark, "x", [(x,) for x in EDGES])
    assert all(r["y"] == (r["x"] >> n << n if n < 64 else 0) for r in rows.select("x", X.unset_low_bits(F.col("x"), n).alias("y")).collect())


@pytest.mark.parametrize("seed", range(4))
def test_range_join_is_the_plain_join(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "BLOCK_BITS", seed)
    rng = random.Random(seed)

    def rows(n, span):
        return [(rng.choice([None, *range(-span, span)]), rng.choice([None, 1, 2])) for _ in range(n)]

    left, right = spark.createDataFrame(rows(40, 30), "a long, x long"), spark.createDataFrame(rows(rng.choice([1, 60]), rng.choice([1, 30])), "b int, x long")
    for l, r in ((left, right), (left, right.filter("b > 99")), (left.filter("a > 99"), right), (left.filter("a = 1"), right)):
        out, plain = R.range_join(l, r, "a", "b"), R.join(l, r, F.col("a") >= F.col("b"))
        assert out.columns == plain.columns == ["a", "x", "b", "x"]
        assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))


def test_range_join_orders_values_as_spark_does(spark):
    left, right = (spark.createDataFrame([(float(v),) for v in ("nan", "-inf", "inf", "0", "-0", "1")], f"{c} double") for c in "ab")
    assert sorted(map(repr, R.range_join(left, right, "a", "b").collect())) == sorted(map(repr, R.join(left, right, F.col("a") >= F.col("b")).collect()))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_join_range_spreads_its_rows(spark, tmp_path, broadcast):
    n = 3000
    for name, key, rows in (("supplier", "s_suppkey", n), ("part", "p_partkey", 4 * n)):
        spark.range(1, rows + 1, 1, 1).withColumnRenamed("id", key).write.parquet(str(tmp_path / f"{name}.parquet"))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = QUERIES["join_range"](spark, str(tmp_path))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n * (n + 1) // 2
        assert max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
