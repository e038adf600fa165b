"""The engine's queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commonloom.functions import algebra as X
from commonloom.functions import shares as S
from commonloom.operators import padded as P
from commonloom.operators import relational as R
from commonloom.plans import rewrite as Q
from commonloom.plans.sql import run_sql
from commonloom.sources import text as text_source
from commonloom.sources.catalog import Catalog
from commonloom.streaming.counts import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# --- the named queries: rewritten (also under their old names ending in `_rewritten`), and as written (`_naive`)


def _purchases(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("row_no"))


def _cdiff(t: Tables) -> DataFrame:
    gap = (F.col("next_ts") - F.col("ts")).between(F.expr("INTERVAL '1' DAY"), F.expr("INTERVAL '3' DAY"))
    return R.distinct(Q.with_next_row(_purchases(t), ["user_id"], "row_no", ["ts"]), "user_id", selected=gap)


def _cdiff_naive(t: Tables) -> DataFrame:
    a, b = _purchases(t).alias("r1"), _purchases(t).alias("r2")
    gap = (F.col("r2.ts") - F.col("r1.ts")).between(F.expr("INTERVAL '1' DAY"), F.expr("INTERVAL '3' DAY"))
    return R.distinct(R.join(a, b, F.col("r1.user_id") == F.col("r2.user_id"), F.col("r2.row_no") == F.col("r1.row_no") + 1, gap).select("r1.user_id"))


def _of_type(t: Tables, kind: str) -> DataFrame:
    return R.where(t.events, F.col("event_type") == kind, F.col("value") > 80)


def _aspirin_naive(t: Tables) -> DataFrame:
    d, m = _of_type(t, "click").alias("d"), _of_type(t, "purchase").alias("m")
    return R.group(R.join(d, m, F.col("d.user_id") == F.col("m.user_id"), F.col("d.ts") <= F.col("m.ts")), [], F.count_distinct("d.user_id").alias("cnt"))


def _lines(t: Tables, how: str = "inner") -> DataFrame:
    return R.join(t.orders, t.lineitem, _ON_ORDER(), how=how)


_ON_ORDER = lambda: F.col("o_orderkey") == F.col("l_orderkey")
_BY_ORDER = {"o_orderkey": "l_orderkey"}
_ROWS, _COLUMN = (lambda: F.count(F.lit(1)).alias("cnt")), (lambda: F.count("l_orderkey").alias("cnt"))
_NAMED = {
    "q1_distinct_join": (
        lambda t: Q.distinct_of_join(t.orders, t.lineitem, _ON_ORDER(), ["o_custkey"]),
        lambda t: R.distinct(_lines(t), "o_custkey"),
        "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    ),
    "q2_join_group_count": (
        lambda t: Q.count_of_join(t.orders, t.lineitem, _BY_ORDER, ["o_custkey"], "cnt"),
        lambda t: R.group(_lines(t), ["o_custkey"], _ROWS()),
        "SELECT o_custkey, count(*) AS cnt FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    ),
    "q2_left_count_rows": (
        lambda t: Q.count_of_join(t.orders, t.lineitem, _BY_ORDER, ["o_custkey"], "cnt", how="left"),
        lambda t: R.group(_lines(t, "left"), ["o_custkey"], _ROWS()),
        "SELECT o_custkey, count(*) AS cnt FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    ),
    "q2_left_count_column": (
        lambda t: Q.count_of_join(t.orders, t.lineitem, _BY_ORDER, ["o_custkey"], "cnt", of="l_orderkey", how="left"),
        lambda t: R.group(_lines(t, "left"), ["o_custkey"], _COLUMN()),
        "SELECT o_custkey, count(l_orderkey) AS cnt FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    ),
    "recurrent_cdiff": (
        _cdiff,
        _cdiff_naive,
        "WITH rcd AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no FROM events WHERE event_type = 'purchase') "
        "SELECT DISTINCT r1.user_id FROM rcd r1 JOIN rcd r2 ON r1.user_id = r2.user_id AND r2.row_no = r1.row_no + 1 "
        "WHERE r2.ts - r1.ts >= INTERVAL '1' DAY AND r2.ts - r1.ts <= INTERVAL '3' DAY",
    ),
    "aspirin_count": (
        lambda t: Q.distinct_count_by_extremes(_of_type(t, "click"), _of_type(t, "purchase"), "user_id", "ts", "<=", "ts", "cnt"),
        _aspirin_naive,
        "SELECT count(DISTINCT d.user_id) AS cnt FROM events d JOIN events m ON d.user_id = m.user_id AND d.ts <= m.ts "
        "WHERE d.event_type = 'click' AND d.value > 80 AND m.event_type = 'purchase' AND m.value > 80",
    ),
}
for _name, (_rewritten, _naive, _sql) in _NAMED.items():
    for _key, _form in ((_name, _rewritten), (f"{_name}_rewritten", _rewritten), (f"{_name}_naive", _naive)):
        query(_sql, _key)(_form)


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 1")
def q3_select_distinct(t: Tables) -> DataFrame:
    return R.distinct(t.lineitem, "l_suppkey", selected=F.col("l_linenumber") == 1)


@query(
    "SELECT event_type, count(*) AS cnt FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95) "
    "GROUP BY event_type ORDER BY cnt DESC, event_type LIMIT 10"
)
def comorbidity(t: Tables) -> DataFrame:
    cohort = R.where(t.events, F.col("event_type") == "error", F.col("value") > 95)
    return R.top(R.group_count(R.semi_join(t.events, cohort, ["user_id"]), ["event_type"]), 10, F.desc("cnt"), F.asc("event_type"))


@query("SELECT DISTINCT user_id FROM (SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) > 15)")
def password_reuse(t: Tables) -> DataFrame:
    return R.distinct(R.group(t.events, ["user_id", "event_type"], F.count(F.lit(1)).alias("n"), having=F.col("n") > 15), "user_id")


@query(
    "SELECT user_id FROM (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id) s WHERE hi - lo > 95"
)
def credit_score(t: Tables) -> DataFrame:
    within = R.where(t.events, F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return R.project(R.where(R.group_min_max(within, ["user_id"], "value", "value"), F.col("max_value") - F.col("min_value") > 95), "user_id")


@query(
    "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' "
    "AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority"
)
def tpch_q4(t: Tables) -> DataFrame:
    orders = R.where(t.orders, F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"), F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-07-01 00:00:00'"))
    late = R.join(orders, t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_shipdate") > F.col("o_orderdate"), how="left_semi")
    return R.order_by(R.group_count(late, ["o_orderpriority"], "order_count"), ["o_orderpriority"])


@query(
    "SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)))::DOUBLE AS revenue FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
)
def tpch_q6(t: Tables) -> DataFrame:
    rows = R.where(
        t.lineitem,
        F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"),
        F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"),
        F.col("l_discount").between(0.05, 0.07),
        F.col("l_quantity") < 24,
    )
    return R.group(rows, [], F.sum(money("l_extendedprice") * money("l_discount")).cast("double").alias("revenue"))


_Q13 = (
    "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders "
    "ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) c GROUP BY c_count ORDER BY custdist DESC, c_count DESC"
)


def _count_of_counts(inner: DataFrame) -> DataFrame:
    return R.order_by(R.group_count(inner, ["c_count"], "custdist"), ["custdist", "c_count"], [False, False])


def _not_urgent(t: Tables) -> DataFrame:
    return R.where(t.orders, F.col("o_orderpriority") != "1-URGENT")


@query(_Q13)
def tpch_q13(t: Tables) -> DataFrame:
    return _count_of_counts(Q.count_of_join(t.customer, _not_urgent(t), {"c_custkey": "o_custkey"}, ["c_custkey"], "c_count", of="o_orderkey", how="left"))


@query(_Q13)
def tpch_q13_naive(t: Tables) -> DataFrame:
    joined = R.join(t.customer, _not_urgent(t), F.col("c_custkey") == F.col("o_custkey"), how="left")
    return _count_of_counts(R.group(joined, ["c_custkey"], F.count("o_orderkey").alias("c_count")))


# --- sources and sinks


@query("SELECT c_custkey, c_nationkey FROM customer")
def scan_columns(t: Tables) -> DataFrame:
    return R.scan(t.customer, ["c_custkey", "c_nationkey"])


@query("SELECT n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region FROM nation")
def braced_text(t: Tables) -> DataFrame:
    cells = F.concat(F.lit("{"), F.concat_ws(", ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.lit("}"))
    texts = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(cells), ","), F.lit("}")).alias("table"))
    return text_source.rows_of_braced(texts, "table", ["nation", "region"])


@query("SELECT 1000::BIGINT AS n, true AS in_range, true AS spread")
def random_source(t: Tables) -> DataFrame:
    rows = text_source.random_table(t.spark, 1000, ["a", "b"], seed=7)
    fits = F.min(F.least("a", "b")) >= 0
    return rows.agg(F.count(F.lit(1)).alias("n"), (fits & (F.max(F.greatest("a", "b")) <= 99)).alias("in_range"), (F.count_distinct("a") > 50).alias("spread"))


@query("SELECT 'diagnosis' AS relation, 'pid' AS name, 'B' AS sharing UNION ALL SELECT 'diagnosis', 'visit_time', 'A'")
def schema_source(t: Tables) -> DataFrame:
    catalog = Catalog(t.spark)
    catalog.add_schemas("# B, A\ndiagnosis([pid], visit_time)\n")
    rows = [(name, f.name, f.metadata["sharing"]) for name, df in catalog.relations.items() for f in df.schema]
    return t.spark.createDataFrame(rows, "relation string, name string, sharing string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def relation_opened(t: Tables) -> DataFrame:
    opened = text_source.open_relation(t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))
    return t.spark.createDataFrame(list(zip(*opened.values(), strict=True)), "n_nationkey long, n_name string")


# --- filters and predicates


def _filters() -> None:
    cases = {
        "eq_constant": (lambda: F.col("l_linenumber") == 3, "l_linenumber = 3"),
        "gt_constant": (lambda: F.col("l_quantity") > 40, "l_quantity > 40"),
        "ge_constant": (lambda: F.col("l_quantity") >= 40, "l_quantity >= 40"),
        "lt_constant": (lambda: F.col("l_quantity") < 5, "l_quantity < 5"),
        "le_constant": (lambda: F.col("l_quantity") <= 5, "l_quantity <= 5"),
        "eq_column": (lambda: F.col("l_linenumber") == F.col("l_quantity"), "l_linenumber = l_quantity"),
        "gt_column": (lambda: F.col("l_discount") > F.col("l_tax"), "l_discount > l_tax"),
        "le_column": (lambda: F.col("l_discount") <= F.col("l_tax"), "l_discount <= l_tax"),
        "and_or_not": (
            lambda: ((F.col("l_quantity") > 30) & (F.col("l_discount") == 0.05)) | ~(F.col("l_returnflag") != "R"),
            "(l_quantity > 30 AND l_discount = 0.05) OR NOT (l_returnflag <> 'R')",
        ),
    }
    for name, (condition, sql) in cases.items():
        columns = ["l_orderkey", "l_linenumber", "l_quantity"]
        query(f"SELECT {', '.join(columns)} FROM lineitem WHERE {sql}", f"filter_{name}")(lambda t, c=condition: R.project(R.where(t.lineitem, c()), *columns))


_filters()


@query("SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_count(t: Tables) -> DataFrame:
    return R.group(t.orders, ["o_custkey"], F.count(F.lit(1)).alias("cnt"), having=F.col("cnt") > 12)


@query(
    "SELECT CASE WHEN s THEN s_suppkey ELSE -1 END AS s_suppkey, CASE WHEN s THEN s_nationkey::BIGINT ELSE -1 END AS s_nationkey, s AS __sel "
    "FROM (SELECT s_suppkey, s_nationkey, s_acctbal > 5000 AS s FROM supplier)"
)
def mask_padded(t: Tables) -> DataFrame:
    rows = P.select_rows(t.supplier, F.col("s_acctbal") > 5000)
    return P.mask(rows.select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), P.SEL))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def padded_semi_join_distinct(t: Tables) -> DataFrame:
    orders = P.select_rows(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "F")
    lines = P.select_rows(t.lineitem.select("l_orderkey", "l_quantity"), F.col("l_quantity") > 45)
    return P.compact(P.distinct_rows(P.semi_join_rows(orders, lines, "o_orderkey", "l_orderkey"), ["o_custkey"])).select("o_custkey")


@query("SELECT count(*) FILTER (WHERE l_quantity > 45) AS cnt FROM lineitem")
def padded_count(t: Tables) -> DataFrame:
    return P.count_rows(P.select_rows(t.lineitem, F.col("l_quantity") > 45))


@query(
    "SELECT o_custkey, n AS cnt, n > 0 AND first AS __sel FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, "
    "o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) = 1 AS first FROM orders)"
)
def padded_group_count(t: Tables) -> DataFrame:
    rows = P.select_rows(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")
    return P.group_rows(rows, ["o_custkey"], {"cnt": F.count(F.lit(1))}, ["o_orderkey"]).select("o_custkey", "cnt", P.SEL)


@query("SELECT r_name, n_name, r_regionkey = n_regionkey AND n_nationkey < 15 AS __sel FROM region CROSS JOIN nation")
def padded_join(t: Tables) -> DataFrame:
    nations = P.select_rows(t.nation.select("n_nationkey", "n_regionkey", "n_name"), F.col("n_nationkey") < 15)
    return P.join_rows(t.region.select("r_regionkey", "r_name"), nations, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", P.SEL)


# --- joins


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def join_equal(t: Tables) -> DataFrame:
    pending = R.where(t.orders, F.col("o_orderstatus") == "P")
    return R.project(R.join(pending, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")), "o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate")
def join_filter(t: Tables) -> DataFrame:
    return R.project(R.join(t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), F.col("l_shipdate") <= F.col("o_orderdate")), "o_orderkey", "l_linenumber")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey >= p_partkey")
def join_range(t: Tables) -> DataFrame:
    return R.project(R.range_join(t.supplier.select("s_suppkey"), t.part.select("p_partkey"), "s_suppkey", "p_partkey"), "s_suppkey", "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT min(s_acctbal) FROM supplier)")
def semi_join_range(t: Tables) -> DataFrame:
    return R.project(R.range_semi_join(t.customer, t.supplier, "c_acctbal", "s_acctbal"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_selected(t: Tables) -> DataFrame:
    return R.project(R.semi_join(t.customer, t.orders, ["c_custkey"], ["o_custkey"], F.col("o_totalprice") > 400000), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(t: Tables) -> DataFrame:
    pending = R.where(t.orders, F.col("o_orderstatus") == "P")
    return R.project(R.join(t.customer, pending, F.col("o_custkey") == F.col("c_custkey"), how="left_anti"), "c_custkey")


def _outer_joins() -> None:
    for how in ("left", "right", "full"):
        sql = (
            "WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) "
            f"SELECT c_custkey, o_orderkey FROM a {how.upper()} JOIN b ON c_custkey = o_custkey"
        )

        def run(t: Tables, how: str = how) -> DataFrame:
            a, b = R.where(t.customer, F.col("c_acctbal") > 5000), R.where(t.orders, F.col("o_totalprice") > 300000)
            return R.project(R.join(a, b, F.col("c_custkey") == F.col("o_custkey"), how=how), "c_custkey", "o_orderkey")

        query(sql, f"join_{how}")(run)


_outer_joins()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return R.project(R.join(t.region, t.nation), "r_name", "n_name")


@query("SELECT o_custkey, sum(l_linenumber)::BIGINT AS sum_l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def join_group_sum(t: Tables) -> DataFrame:
    return R.join_group_sum(R.semi_join(t.orders, t.lineitem, ["o_orderkey"], ["l_orderkey"]), t.lineitem, "o_orderkey", "l_orderkey", "l_linenumber", ["o_custkey"])


@query("SELECT o_orderkey, coalesce((SELECT sum(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0)::BIGINT AS partial FROM orders")
def join_partial_sum(t: Tables) -> DataFrame:
    return R.partial_sum_join(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT event_id, next_value >= value AS bit FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS next_value FROM events) WHERE next_value IS NOT NULL")
def adjacent_at_least(t: Tables) -> DataFrame:
    return R.project(R.adjacent_at_least(t.events, ["user_id"], "event_id", "value"), "event_id", "bit")


# --- aggregation, distinct, order


@query("SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus")
def group_count_selected(t: Tables) -> DataFrame:
    return R.group_count(R.where(t.lineitem, F.col("l_quantity") > 10), ["l_returnflag", "l_linestatus"])


@query("SELECT l_suppkey, min(l_quantity) AS min_l_quantity, max(l_discount) AS max_l_discount FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_suppkey")
def group_min_max_selected(t: Tables) -> DataFrame:
    return R.group_min_max(R.where(t.lineitem, F.col("l_linenumber") <= 3), ["l_suppkey"], "l_quantity", "l_discount")


@query("SELECT l_suppkey, sum(l_linenumber)::BIGINT AS sum_l_linenumber, sum(l_partkey)::BIGINT AS sum_l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
def group_sum_selected(t: Tables) -> DataFrame:
    return R.group_sum(R.where(t.lineitem, F.col("l_returnflag") == "R"), ["l_suppkey"], "l_linenumber", "l_partkey")


@query(
    "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS sum_l_linenumber, count(l_linenumber) AS count_l_linenumber, sum(l_linenumber)::DOUBLE / count(l_linenumber) AS avg_l_linenumber "
    "FROM lineitem GROUP BY l_returnflag"
)
def group_average(t: Tables) -> DataFrame:
    return R.group_average(t.lineitem, ["l_returnflag"], "l_linenumber")


@query(
    "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS total, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_linenumber)::DOUBLE / count(*) AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem"
)
def global_aggregates(t: Tables) -> DataFrame:
    n, total = F.count(F.lit(1)), F.sum("l_linenumber")
    return R.group(t.lineitem, [], n.alias("n"), total.alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), (total.cast("double") / n).alias("mean"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderkey, o_custkey * 3 AS product FROM orders")
def row_multiply(t: Tables) -> DataFrame:
    return R.project(R.row_function(t.orders, "product", F.col("o_custkey") * 3), "o_orderkey", "product")


@query("SELECT cnt, count(*) AS groups FROM (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) GROUP BY cnt")
def count_of_counts(t: Tables) -> DataFrame:
    return R.group_count(R.group_count(t.orders, ["o_custkey"]), ["cnt"], "groups")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_columns(t: Tables) -> DataFrame:
    return R.distinct(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_first FROM events")
def first_of_run(t: Tables) -> DataFrame:
    return R.project(R.first_of_run(t.events, ["user_id"], ["event_id"]), "event_id", "is_first")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_custkey DESC, o_orderkey")
def sort_keys(t: Tables) -> DataFrame:
    return R.order_by(R.project(t.orders, "o_custkey", "o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_custkey", "o_orderkey"], [True, False, True])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(t: Tables) -> DataFrame:
    return R.top(R.project(t.orders, "o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_rows(t: Tables) -> DataFrame:
    return R.limit(R.order_by(R.project(t.orders, "o_orderkey"), ["o_orderkey"]), 25)


# --- set operations, windows in time, grouping sets


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_keys(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(R.where(t.customer, F.col("c_acctbal") > 0).select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(R.distinct(R.where(t.orders, F.col("o_orderstatus") == "F"), "o_custkey"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events WHERE value > 50 GROUP BY 1, 2")
def daily_counts(t: Tables) -> DataFrame:
    counts = windowed_counts(t.events, "ts", ["event_type"], "1 day", "1 hour", F.col("value") > 50)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "cnt")


# --- column algebra and shares


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS x_add, l_partkey - l_suppkey AS x_sub, l_partkey * l_suppkey AS x_mul, l_partkey::DOUBLE / (l_suppkey + 1) AS x_div, "
    "l_partkey + 7 AS x_add7, l_partkey - 7 AS x_sub7, -l_partkey AS x_neg, l_partkey = l_suppkey AS x_eq, l_partkey <> l_suppkey AS x_ne, l_partkey > l_suppkey AS x_gt, l_partkey >= l_suppkey AS x_ge, "
    "l_partkey < l_suppkey AS x_lt, l_partkey <= l_suppkey AS x_le, l_partkey & l_suppkey AS x_and, l_partkey | l_suppkey AS x_or, xor(l_partkey, l_suppkey) AS x_xor, ~l_partkey AS x_not, "
    "xor(l_partkey & 1, 1) AS x_flip, (l_partkey > l_suppkey)::BIGINT AS x_bit, l_partkey - 100 = 0 AS x_eqz, l_partkey - 100 > 0 AS x_gtz, l_partkey - 100 >= 0 AS x_geqz, l_partkey - 100 < 0 AS x_ltz, "
    "((l_partkey >> 2) & 1)::INTEGER AS x_get, l_partkey | 8 AS x_set, l_partkey & ~(8::BIGINT) AS x_unset, (l_partkey >> 3) << 3 AS x_low, least(l_partkey, l_suppkey) AS x_least, greatest(l_partkey, l_suppkey) AS x_most FROM lineitem"
)
def column_algebra(t: Tables) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    arithmetic, compare, bits = X.ARITHMETIC, X.COMPARISONS, X.BITWISE
    less = arithmetic["subtract"](a, 100)
    columns = {
        "x_add": arithmetic["add"](a, b), "x_sub": arithmetic["subtract"](a, b), "x_mul": arithmetic["multiply"](a, b), "x_div": arithmetic["divide"](a, b + 1),
        "x_add7": arithmetic["add"](a, 7), "x_sub7": arithmetic["subtract"](a, 7), "x_neg": X.negate(a),
        **{f"x_{k}": f(a, b) for k, f in compare.items()}, **{f"x_{k}": f(a, b) for k, f in bits.items()},
        "x_not": X.bitwise_not(a), "x_flip": X.flip(a.bitwiseAND(1)), "x_bit": X.as_number(a > b),
        "x_eqz": X.equals_zero(less), "x_gtz": X.above_zero(less), "x_geqz": X.at_least_zero(less), "x_ltz": X.below_zero(less),
        "x_get": X.get_bit(a, 2).cast("int"), "x_set": X.set_bit(a, 3), "x_unset": X.unset_bit(a, 3), "x_low": X.unset_low_bits(a, 3), "x_least": X.smaller(a, b), "x_most": X.larger(a, b),
    }
    return t.lineitem.select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in columns.items()))


@query("SELECT l_returnflag, bit_and(l_partkey | 1) AS ones FROM lineitem GROUP BY l_returnflag")
def and_of_group(t: Tables) -> DataFrame:
    return R.group(t.lineitem, ["l_returnflag"], X.all_bits(F.col("l_partkey").bitwiseOR(F.lit(1).cast("long"))).alias("ones"))


@query("SELECT o_orderkey, o_custkey AS opened, o_custkey AS opened_sum, o_orderkey + o_custkey AS added, xor(o_orderkey, o_custkey) AS mixed, o_custkey AS converted, true AS hidden FROM orders")
def share_and_open(t: Tables) -> DataFrame:
    key, value = F.col("o_orderkey"), F.col("o_custkey")
    b, a = S.share_boolean(value, 11, key), S.share_arithmetic(value, 21, key)
    kb, ka = S.share_boolean(key, 31, key), S.share_arithmetic(key, 41, key)
    return t.orders.select(
        "o_orderkey", S.open_boolean(b).alias("opened"), S.open_arithmetic(a).alias("opened_sum"), S.open_arithmetic(S.add_shares(a, ka)).alias("added"),
        S.open_boolean(S.xor_shares(b, kb)).alias("mixed"), S.open_arithmetic(S.to_arithmetic(b, 51, key)).alias("converted"), (b["s1"] != value).alias("hidden"),
    )


@query("SELECT o_orderkey, o_custkey AS opened, true AS is_bit, true AS same_bit FROM orders")
def share_kinds(t: Tables) -> DataFrame:
    """From additive shares to exclusive-or ones, and random bits in both sharings."""
    key, value = F.col("o_orderkey"), F.col("o_custkey")
    b, a = S.random_bit(61, key)
    return t.orders.select(
        "o_orderkey", S.open_boolean(S.to_boolean(S.share_arithmetic(value, 71, key), 81, key)).alias("opened"), S.open_boolean(b).isin(0, 1).alias("is_bit"), (S.open_boolean(b) == S.open_arithmetic(a)).alias("same_bit")
    )


# --- SQL texts


def _sql_texts() -> None:
    texts = {
        # the named queries as texts with their constants
        "sql_q1": ("SELECT DISTINCT orders.[o_custkey] FROM orders, lineitem WHERE orders.[o_orderkey] = lineitem.[l_orderkey]", {}),
        "sql_q2": ("SELECT orders.[o_custkey], COUNT(*) AS cnt FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY orders.[o_custkey]", {}),
        "sql_q3": ("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 'line'", {"line": 1}),
        "sql_comorbidity": (
            "WITH cohort AS (SELECT user_id FROM events WHERE event_type = 'kind' AND value > 'least') SELECT event_type, COUNT(*) AS cnt FROM events WHERE user_id IN (SELECT * FROM cohort) "
            "GROUP BY event_type ORDER BY cnt DESC, event_type LIMIT 10",
            {"kind": "error", "least": 95},
        ),
        "sql_cdiff": (
            "WITH rcd AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no FROM events WHERE event_type = 'kind') "
            "SELECT DISTINCT r1.user_id FROM rcd r1 JOIN rcd r2 ON r1.user_id = r2.user_id WHERE r2.ts - r1.ts >= INTERVAL '1' DAY AND r2.ts - r1.ts <= INTERVAL '3' DAY AND r2.row_no = r1.row_no + 1",
            {"kind": "purchase"},
        ),
        "sql_aspirin": (
            "SELECT count(DISTINCT d.user_id) AS cnt FROM events AS d JOIN events AS m ON d.user_id = m.user_id WHERE d.event_type = 'first' AND d.value > 'least' "
            "AND m.event_type = 'second' AND m.value > 'least' AND d.ts <= m.ts",
            {"first": "click", "second": "purchase", "least": 80},
        ),
        "sql_password": ("SELECT DISTINCT user_id FROM events GROUP BY user_id, event_type HAVING COUNT(*) > 'times'", {"times": 15}),
        "sql_credit": (
            "SELECT s.user_id FROM (SELECT user_id, MIN(value) AS low, MAX(value) AS high FROM events WHERE events.value > 'least' GROUP BY user_id) AS s WHERE s.high - s.low > 'span'",
            {"least": 2, "span": 95},
        ),
        "sql_tpch_q4": (
            "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' "
            "AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority",
            {},
        ),
        "sql_tpch_q6": (
            "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' "
            "AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount >= 'low' AND l_discount <= 'high' AND l_quantity < 'most'",
            {"low": 0.05, "high": 0.07, "most": 24},
        ),
        "sql_tpch_q13": (
            "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> 'priority' "
            "GROUP BY c_custkey) AS c_orders(c_custkey, c_count) GROUP BY c_count ORDER BY custdist DESC, c_count DESC",
            {"priority": "1-URGENT"},
        ),
        "sql_cte_alias": (
            "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 'least') SELECT k, n FROM (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) AS b(k, n) WHERE n >= 2",
            {"least": 250000},
        ),
        "sql_exists": ("SELECT [c_custkey] FROM customer WHERE EXISTS (SELECT * FROM orders WHERE orders.[o_custkey] = customer.[c_custkey] AND o_orderstatus = 'status')", {"status": "P"}),
        "sql_in_order_limit": (
            "SELECT o_orderpriority, count(*) AS cnt FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 'nation') GROUP BY o_orderpriority ORDER BY cnt DESC, o_orderpriority LIMIT 3",
            {"nation": 3},
        ),
        "sql_comma_join": ("SELECT DISTINCT n_name FROM nation, customer WHERE n_nationkey = c_nationkey AND c_acctbal < 'low'", {"low": 0}),
        "sql_case_between_like": ("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' ELSE 'large' END AS kind FROM part WHERE p_brand LIKE 'Brand#1%'", {}),
    }
    for name, (text, constants) in texts.items():
        plain = text.replace("[", "").replace("]", "")
        for c, v in constants.items():
            plain = plain.replace(f"'{c}'", repr(v))

        def run(t: Tables, text: str = text, constants: dict = constants) -> DataFrame:
            catalog = Catalog(t.spark)
            for table in ("orders", "customer", "nation", "part", "lineitem", "events"):
                catalog.add(table, getattr(t, table))
            return run_sql(t.spark, text, catalog, **constants)

        query(plain, name)(run)


_sql_texts()
