"""Each rewrite gives what the plain join gives, on random tables with repeats, nulls and empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from commonloom.plans import rewrite as Q


def pair(spark, seed):
    rng = random.Random(seed)
    span = rng.choice([1, 4, 60])

    def rows(n):
        return [(rng.choice([None, *range(span)]), rng.randrange(5), rng.choice([None, *range(20)])) for _ in range(n)]

    left = spark.createDataFrame(rows(rng.choice([0, 1, 30])), "id long, ak long, t long")
    right = spark.createDataFrame(rows(rng.choice([0, 1, 40])), "rid long, bk long, rt long")
    return left, right.filter("bk < 4")


def same(plan, naive):
    assert plan.columns == naive.columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(plan.collect()) == key(naive.collect())
    return plan


@pytest.mark.parametrize("seed", range(4))
def test_distinct_of_join(spark, seed):
    l, r = pair(spark, seed)
    both = [F.col("id") == F.col("rid"), F.col("t") <= F.col("rt")]
    same(Q.distinct_of_join(l, r, both, ["ak"]), l.join(r, both).select("ak").distinct())
    same(Q.distinct_of_join(r, l, both[0], ["bk"]), l.join(r, both[0]).select("bk").distinct())
    theta = F.col("t") <= F.col("rt")
    same(Q.distinct_of_join(l, r, theta, ["ak", "id"]), l.join(r, theta).select("ak", "id").distinct())


@pytest.mark.parametrize("seed", range(4))
def test_count_of_join(spark, seed):
    l, r = pair(spark, seed + 10)
    on = F.col("id") == F.col("rid")
    same(Q.count_of_join(l, r, {"id": "rid"}, ["ak"], "n"), l.join(r, on).groupBy("ak").agg(F.count(F.lit(1)).alias("n")))
    same(Q.count_of_join(r, l, {"rid": "id"}, ["bk"], "n"), l.join(r, on).groupBy("bk").agg(F.count(F.lit(1)).alias("n")))
    same(Q.count_of_join(l, r, {"id": "rid"}, ["ak"], "n", how="left"), l.join(r, on, "left").groupBy("ak").agg(F.count(F.lit(1)).alias("n")))
    same(Q.count_of_join(l, r, {"id": "rid"}, ["ak"], "n", of="rt", how="left"), l.join(r, on, "left").groupBy("ak").agg(F.count("rt").alias("n")))
    same(Q.count_of_join(l, r, {"id": "rid", "t": "rt"}, ["ak"], "n", of="rt"), l.join(r, on & (F.col("t") == F.col("rt"))).groupBy("ak").agg(F.count("rt").alias("n")))
    with pytest.raises(ValueError):
        Q.count_of_join(l, r, {"id": "rid"}, ["ak"], "n", how="full")


@pytest.mark.parametrize("seed", range(4))
def test_with_next_row(spark, seed):
    rng = random.Random(seed)
    rows = [(p, n, rng.randrange(60)) for p in (None, 0, 1, 2, 3) for n in range(rng.choice([0, 1, 9])) if rng.random() < 0.8]
    visits = spark.createDataFrame(rows, "pid long, row_no long, time long")
    a, b = visits.alias("a"), visits.alias("b")
    joined = a.join(b, (F.col("a.pid") == F.col("b.pid")) & (F.col("b.row_no") == F.col("a.row_no") + 1) & (F.col("b.time") - F.col("a.time")).between(15, 56))
    plan = Q.with_next_row(visits, ["pid"], "row_no", ["time"]).filter((F.col("next_time") - F.col("time")).between(15, 56)).select("pid").distinct()
    same(plan, joined.select("a.pid").distinct())
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_recurrent_visits(spark):
    rows = [(0, 1, 1), (0, 17, 1), (0, 37, 1), (1, 5, 0), (1, 6, 0), (1, 7, 1), (2, 10, 1), (2, 76, 1)]
    numbered = [(p, sum(q == p for q, _, _ in rows[:i]), t, c) for i, (p, t, c) in enumerate(rows)]
    only = spark.createDataFrame(numbered, "pid long, row_no long, time long, cdiff long").filter("cdiff = 1")
    found = Q.with_next_row(only, ["pid"], "row_no", ["time"]).filter((F.col("next_time") - F.col("time")).between(15, 56))
    assert [tuple(r) for r in found.select("pid").distinct().collect()] == [(0,)]


@pytest.mark.parametrize("seed", range(4))
def test_distinct_count_by_extremes(spark, seed):
    l, r = pair(spark, seed + 20)
    other, equal = r.withColumnRenamed("rid", "id"), F.col("id") == F.col("rid")
    for op, fits in (("<", F.col("t") < F.col("rt")), ("<=", F.col("t") <= F.col("rt")), (">", F.col("t") > F.col("rt")), (">=", F.col("t") >= F.col("rt"))):
        same(Q.distinct_count_by_extremes(l, other, "id", "t", op, "rt", "n"), l.join(r, equal & fits).agg(F.count_distinct("id").alias("n")))


def test_aspirin(spark):
    diagnosis = spark.createDataFrame([(0, 3, 10), (0, 4, 10), (1, 2, 11), (2, 3, 10)], "pid long, time long, diag long")
    medication = spark.createDataFrame([(0, 2, 12), (0, 4, 12), (1, 3, 12), (2, 5, 13)], "pid long, time long, med long")
    assert Q.distinct_count_by_extremes(diagnosis.filter("diag = 10"), medication.filter("med = 12"), "pid", "time", "<=", "time", "n").first()["n"] == 1
