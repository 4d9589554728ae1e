"""Named queries on the test tables: a Spark plan and the SQL that says the same."""

from __future__ import annotations

import contextlib
import datetime
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.predicates import Affine, Comparison, conjunction, move_constants
from quern.functions.scalar import exact_sum, ieee_div
from quern.operators import aggregates, joins, sharing, sorting
from quern.plans import cost, sqltext
from quern.session import setting
from quern.sources import manifest, storage, tables
from quern.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START, END = datetime.datetime(1996, 3, 1), datetime.datetime(1996, 3, 15)
FORTNIGHT = [Comparison("o_orderdate", ">=", START), Comparison("o_orderdate", "<", END)]
FORTNIGHT_SQL = "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-15'"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_totalprice"
EXACT = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
SUMMARY = f"count(*) AS n, {EXACT.format('o_totalprice')} AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, {EXACT.format('o_totalprice')} / count(o_totalprice) AS mean"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = " ".join(sql.split())
        return f

    return keep


def _t(spark, d, name):
    return tables.table(spark, d, name)


@contextlib.contextmanager
def _view(spark, df: DataFrame) -> Iterator[str]:
    """A name for a table in SQL text, gone once the text is analysed."""
    name = f"quern_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        spark.catalog.dropTempView(name)


def _ntz(x: datetime.datetime):
    return F.expr(f"TIMESTAMP_NTZ '{x:%Y-%m-%d %H:%M:%S}'")


def _fortnight(df: DataFrame) -> DataFrame:
    return df.where((F.col("o_orderdate") >= _ntz(START)) & (F.col("o_orderdate") < _ntz(END)))


# ---- scans, filters, expressions


@query("scan_project", f"SELECT {ORDER_COLUMNS} FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_eq", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return _t(spark, d, "orders").where(conjunction([Comparison("o_orderstatus", "=", "F")])).select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_range_date", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {FORTNIGHT_SQL}")
def _(spark, d):
    return _fortnight(_t(spark, d, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "filter_expr",
    "SELECT l_orderkey, l_partkey, l_extendedprice / l_quantity AS unit_price FROM lineitem WHERE l_returnflag = 'R' AND l_extendedprice / l_quantity > 100",
)
def _(spark, d):
    unit = ieee_div(F.col("l_extendedprice"), F.col("l_quantity"))
    return (
        _t(spark, d, "lineitem")
        .where((F.col("l_returnflag") == "R") & (unit > 100))
        .select("l_orderkey", "l_partkey", unit.alias("unit_price"))
    )


@query(
    "projection_computed",
    "SELECT l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charged, 0 - l_quantity AS taken FROM lineitem WHERE l_quantity <> 1",
)
def _(spark, d):
    p, x, t, q = (F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))
    return _t(spark, d, "lineitem").where(q != 1).select("l_orderkey", (p * (1 - x) * (1 + t)).alias("charged"), (0 - q).alias("taken"))


@query("filter_lower", f"SELECT {ORDER_COLUMNS} FROM orders WHERE lower(o_orderstatus) = 'f'")
def _(spark, d):
    return _t(spark, d, "orders").where(F.lower("o_orderstatus") == "f").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "filter_or_not_in_between",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE (o_totalprice BETWEEN 1000 AND 50000 OR o_orderstatus NOT IN ('F', 'O')) AND NOT (o_custkey <= 10) AND o_custkey NOT BETWEEN 20 AND 30",
)
def _(spark, d):
    c = F.col
    test = (c("o_totalprice").between(1000, 50000) | ~c("o_orderstatus").isin("F", "O")) & ~(c("o_custkey") <= 10) & ~c("o_custkey").between(20, 30)
    return _t(spark, d, "orders").where(test).select("o_orderkey", "o_custkey", "o_totalprice")


@query("fold_and_move", "SELECT o_orderkey, o_totalprice * (1 + 20 / 100) AS with_tax FROM orders WHERE o_custkey + 1 > 3")
def _(spark, d):
    return _t(spark, d, "orders").where(F.col("o_custkey") + 1 > 3).select("o_orderkey", (F.col("o_totalprice") * (1 + F.lit(20) / F.lit(100))).alias("with_tax"))


@query("moved_constant", "SELECT o_orderkey FROM orders WHERE o_custkey * 3 + 7 <= 1000")
def _(spark, d):
    moved = move_constants(Affine("o_custkey", 3, 7), "<=", 1000)
    return _t(spark, d, "orders").where(moved.to_column()).select("o_orderkey")


@query("largest", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice > 400000")
def _(spark, d):
    return _t(spark, d, "orders").where(F.col("o_totalprice") > 400000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("one_customer", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 17")
def _(spark, d):
    return _t(spark, d, "orders").where(F.col("o_custkey") == 17).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("divide_by_zero", "SELECT o_orderkey, o_totalprice / (o_custkey - o_custkey) AS ratio FROM orders")
def _(spark, d):
    zero = F.col("o_custkey") - F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", ieee_div(F.col("o_totalprice"), zero).alias("ratio"))


@query("sql_text", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1 ORDER BY 2")
def _(spark, d):
    text = "SELECT o_orderstatus AS \"status\", count(*) AS n FROM 'orders.parquet' WHERE o_totalprice >= 1000 -- cheap ones go\nGROUP BY 1 ORDER BY 2;"
    return sqltext.run(spark, text, d)


@query("sql_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def _(spark, d):
    return sqltext.run(spark, "SELECT o_orderkey FROM read_parquet('orders.parquet') WHERE o_totalprice > :least AND o_orderstatus = :status", d, {"least": 300000, "status": "O"})


# ---- aggregation


@query("agg_by_key", f"SELECT o_custkey, {SUMMARY} FROM orders GROUP BY o_custkey")
def _(spark, d):
    return aggregates.summary(_t(spark, d, "orders"), ["o_custkey"], "o_totalprice")


@query("agg_by_string", f"SELECT o_orderstatus, {SUMMARY} FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return aggregates.summary(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")


@query("agg_multi_key", f"SELECT o_custkey, o_orderstatus, {SUMMARY} FROM orders GROUP BY o_custkey, o_orderstatus")
def _(spark, d):
    return aggregates.summary(_t(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice")


@query("agg_expr_key", "SELECT l_linenumber + 1 AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber + 1")
def _(spark, d):
    return _t(spark, d, "lineitem").groupBy((F.col("l_linenumber") + 1).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_global", f"SELECT {SUMMARY} FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return aggregates.summary(_t(spark, d, "orders").where(F.col("o_orderstatus") == "F"), [], "o_totalprice")


@query("agg_int_sum", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum("o_custkey").alias("s"))


@query("agg_null_key", "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS k, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    k = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return _t(spark, d, "orders").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("count_filter", "SELECT count(*) FILTER (WHERE month(o_orderdate) = 3) AS march, count(*) AS n FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").agg(F.count_if(F.month("o_orderdate") == 3).alias("march"), F.count(F.lit(1)).alias("n"))


@query("count_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"))


@query("two_phase_agg", f"SELECT o_custkey, {SUMMARY} FROM orders GROUP BY o_custkey")
def _(spark, d):
    # Spark's own two phases: tasks aggregate before the one shuffle, which carries a row a task and key
    return aggregates.summary(_t(spark, d, "orders"), ["o_custkey"], "o_totalprice")


@query("combine_partials", f"SELECT o_custkey, {SUMMARY.replace('o_totalprice', 'price')} FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders) GROUP BY o_custkey")
def _(spark, d):
    o = _t(spark, d, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    states = aggregates.partial(o, ["o_custkey"], "price", F.date_trunc("month", "o_orderdate"))
    return aggregates.combine(states, ["o_custkey"])


@query("one_phase_agg", f"SELECT o_custkey, {SUMMARY} FROM orders GROUP BY o_custkey")
def _(spark, d):
    return aggregates.summary(_t(spark, d, "orders").repartition("o_custkey"), ["o_custkey"], "o_totalprice")


@query("heavy_hitters", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1024.0 FROM orders)")
def _(spark, d):
    return joins.heavy_keys(_t(spark, d, "orders"), "o_custkey", 512)


@query("approx_top", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, d):
    # a sketch: exact while it tracks more keys than there are
    with _view(spark, _t(spark, d, "orders")) as name:
        return spark.sql(f"SELECT x.item AS o_orderpriority, x.count AS n FROM (SELECT explode(approx_top_k(o_orderpriority, 3)) AS x FROM {name})")


@query(
    "equal_depth_histogram",
    "SELECT CAST(b AS INTEGER) AS bucket, (SELECT v[CAST(greatest(1, ceil(len(v) * b / 10.0)) AS INTEGER)] FROM (SELECT list_sort(list(o_totalprice)) AS v FROM orders)) AS bound FROM range(11) t(b)",
)
def _(spark, d):
    return aggregates.equal_depth(_t(spark, d, "orders"), "o_totalprice", 10)


# ---- subqueries and sharing

BIG = "WITH r AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT o_custkey, spent FROM r WHERE spent > 2 * (SELECT avg(CAST(spent AS DECIMAL(18,2))) FROM r)"


@query("having_scalar_subquery", BIG)
def _(spark, d):
    with _view(spark, _t(spark, d, "orders")) as name:
        return spark.sql(BIG.replace("FROM orders", f"FROM {name}"))


@query("cte_materialized", BIG)
def _(spark, d):
    o = _t(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    r = sharing.tee(o.groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice")).alias("spent")))
    mean = r.agg((2 * F.avg(F.col("spent").cast("decimal(18,2)"))).alias("least"))
    return r.join(F.broadcast(mean), F.col("spent") > F.col("least")).select("o_custkey", "spent")


@query("exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS found")
def _(spark, d):
    return sharing.exists(_t(spark, d, "orders"), F.col("o_totalprice") > 400000)


@query("exists_none", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS found")
def _(spark, d):
    return sharing.exists(_t(spark, d, "orders"), F.col("o_totalprice") < 0)


# ---- joins

TWO = "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"


def _two(spark, d, how, turned=False):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    on = o.o_custkey == c.c_custkey
    df = joins.inner(c, o, on, how) if turned else joins.inner(o, c, on, how)
    return df.select("o_orderkey", "c_name", "c_mktsegment")


query("join_inner", TWO)(lambda spark, d: _two(spark, d, "auto"))
query("join_swapped", TWO)(lambda spark, d: _two(spark, d, "auto", True))
query("join_broadcast", TWO)(lambda spark, d: _two(spark, d, "broadcast"))
query("join_shuffle", TWO)(lambda spark, d: _two(spark, d, "shuffle_hash"))
query("join_merge", TWO)(lambda spark, d: _two(spark, d, "merge"))


@query("join_salted", TWO)
def _(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    return joins.salted_join(o, c, "k", nodes=512).select("o_orderkey", "c_name", "c_mktsegment")


@query("join_filtered", TWO + " WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    c = _t(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    o = _t(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("join_residual_or", TWO + " WHERE c_mktsegment = 'BUILDING' OR o_totalprice > 400000")
def _(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    on = (o.o_custkey == c.c_custkey) & ((c.c_mktsegment == "BUILDING") | (o.o_totalprice > 400000))
    return o.join(c, on).select("o_orderkey", "c_name", "c_mktsegment")


ASIA = "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"


def _asia_frames(spark, d):
    frames = {n: _t(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    frames["region"] = frames["region"].where(F.col("r_name") == "ASIA")
    return frames


@query("join_multiway", ASIA)
def _(spark, d):
    o, c, n, r = _asia_frames(spark, d).values()
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return df.select("o_orderkey", "c_name", "n_name")


@query("join_reordered", ASIA)
def _(spark, d):
    frames = _asia_frames(spark, d)
    # row counts come from footers: Spark answers count() over Parquet without reading columns
    rows = {k: float(v.count()) for k, v in frames.items()}
    keys = {"orders": {}, "customer": {"c_custkey": rows["customer"]}, "nation": {"n_nationkey": rows["nation"]}, "region": {"r_regionkey": 5.0}}
    leaves = [cost.Leaf(k, rows[k], keys[k]) for k in frames]
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    _, tree = cost.join_order(leaves, links)
    return cost.build(tree, frames, joins.broadcast_if_small).select("o_orderkey", "c_name", "n_name")


@query("self_join_count", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def _(spark, d):
    # n rows of a key make n * n pairs: they are counted, not made
    by = _t(spark, d, "orders").where("o_custkey IS NOT NULL").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n"))


@query("self_join", "SELECT a.o_orderkey AS one, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey < b.o_orderkey")
def _(spark, d):
    a, b = (_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").alias(x) for x in "ab")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderdate") == F.col("b.o_orderdate")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("one"), F.col("b.o_orderkey").alias("other"))


@query("join_bloom", TWO + " WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    def join():
        o, c = _t(spark, d, "orders"), _t(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
        return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")

    return joins.bloom_join(spark, join)


@query(
    "join_agg_sort",
    f"SELECT n_name, count(*) AS n, {EXACT.format('o_totalprice')} AS spent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY spent DESC, n_name",
)
def join_agg_sort(spark, d):
    o, c, n = (_t(spark, d, x) for x in ("orders", "customer", "nation"))
    # aggregating by customer first halves what the second join and the last shuffle carry
    by = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    df = by.join(c, by.o_custkey == c.c_custkey).join(joins.broadcast_if_small(n), F.col("c_nationkey") == n.n_nationkey)
    out = df.groupBy("n_name").agg(F.sum("k").alias("n"), F.sum("s").cast("double").alias("spent"))
    return sorting.sort(out, [("spent", True), ("n_name", False)])


# ---- sorting


@query("sort_full", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, d):
    return sorting.sort(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)])


@query("top_k", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return sorting.top(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 10)


@query("top_k_asc", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def _(spark, d):
    return sorting.top(_t(spark, d, "orders"), [("o_orderdate", False), ("o_orderkey", False)], 10).select("o_orderkey", "o_custkey", "o_totalprice")


@query("limit_count", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 10)")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").limit(10).agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_k_per_group",
    "SELECT o_orderstatus, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3",
)
def _(spark, d):
    o = _t(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return sorting.top_per_group(o, ["o_orderstatus"], [("o_totalprice", True), ("o_orderkey", False)], 3)


@query("ordinals", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2, 1")
def _(spark, d):
    return sqltext.run(spark, "SELECT o_orderpriority, count(*) AS n FROM 'orders.parquet' GROUP BY 1 ORDER BY 2, 1", d)


@query("row_index", "SELECT o_orderkey, o_orderdate, row_number() OVER () - 1 AS file_row_number FROM orders")
def _(spark, d):
    return tables.with_row_index(_t(spark, d, "orders").select("o_orderkey", "o_orderdate", "_metadata")).drop("_metadata")


# ---- layouts


def _orders_by_day(spark, d):
    return _t(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("page_pruned", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {FORTNIGHT_SQL}")
def _(spark, d):
    at = tables.laid_out(spark, "paged", d, lambda to: tables.write_sorted(_orders_by_day(spark, d), to, "o_orderdate"))
    test = (F.col("o_orderdate") >= F.lit(START.date())) & (F.col("o_orderdate") < F.lit(END.date()))
    return spark.read.parquet(at).where(test).select("o_orderkey", "o_custkey", "o_totalprice")


def _months(spark, d) -> str:
    return tables.laid_out(spark, "months", d, lambda to: tables.write_by_month(_t(spark, d, "orders"), to, "o_orderdate"))


@query("hive_pruned", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {FORTNIGHT_SQL}")
def _(spark, d):
    months = [f"{START:%Y-%m}", f"{END:%Y-%m}"]
    return _fortnight(spark.read.parquet(_months(spark, d)).where(F.col("month").between(*months))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("glob_read", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {FORTNIGHT_SQL}")
def _(spark, d):
    return _fortnight(tables.scan(spark, f"{_months(spark, d)}/month={START:%Y}-*/*.parquet")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("manifest_pruned", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {FORTNIGHT_SQL}")
def _(spark, d):
    at = tables.laid_out(spark, "files", d, lambda to: tables.write_sorted(_orders_by_day(spark, d), to, "o_orderdate", max(12, tables.files_for(_t(spark, d, "orders")))))
    by = tables.laid_out(spark, "bounds", d, lambda to: manifest.write_manifest(spark.read.parquet(at), ["o_orderdate", "o_custkey"], to))
    tests = [Comparison("o_orderdate", ">=", START.date()), Comparison("o_orderdate", "<", END.date())]
    return manifest.read_pruned(spark, by, tests, at).select("o_orderkey", "o_custkey", "o_totalprice")


@query("storage_scan", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    with setting(spark, spark__sql__python__filterPushdown__enabled="true"):
        df = storage.storage_scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
        df = df.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")
        df._jdf.queryExecution().executedPlan()  # planned while the setting holds
        return df


@query("storage_scan_not", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000")
def _(spark, d):
    with setting(spark, spark__sql__python__filterPushdown__enabled="true"):
        df = storage.storage_scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
        df = df.where((F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_custkey", "o_totalprice")
        df._jdf.queryExecution().executedPlan()  # planned while the setting holds
        return df


# ---- other sources, functions of Python, ways to run


@query("generated_range", "SELECT i, i * i AS square FROM range(1000) t(i)")
def _(spark, d):
    return spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square"))


@query("rows_source", "SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) t(k, name)")
def _(spark, d):
    return spark.createDataFrame(pa.table({"k": pa.array([1, 2, 3], pa.int32()), "name": ["one", "two", None]}))


@query("arrow_function", "SELECT o_orderkey, o_totalprice * 1.2 AS with_tax FROM orders WHERE o_totalprice > 1000")
def _(spark, d):
    @F.arrow_udf("double")
    def taxed(x: pa.Array) -> pa.Array:
        return pc.multiply(x, 1.2)

    return _t(spark, d, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey", taxed("o_totalprice").alias("with_tax"))


@query("batch_function", "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice / o_custkey > 1000")
def _(spark, d):
    def keep(batches):
        for b in batches:
            yield b.filter(pc.greater(pc.divide(b.column("o_totalprice"), pc.cast(b.column("o_custkey"), "double")), 1000))

    o = _t(spark, d, "orders").select("o_custkey", "o_totalprice")
    return o.mapInArrow(keep, o.schema)


def _planned(spark, make, **confs) -> DataFrame:
    with setting(spark, **confs):
        df = make()
        df._jdf.queryExecution().executedPlan()
        return df


WITH_TAX = "SELECT o_orderkey, o_totalprice * (1 + 20 / 100) AS with_tax FROM orders WHERE o_totalprice > 1000"


def _with_tax(spark, d) -> DataFrame:
    return _t(spark, d, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey", (F.col("o_totalprice") * (1 + F.lit(20) / F.lit(100))).alias("with_tax"))


query("run_compiled", WITH_TAX)(lambda spark, d: _planned(spark, lambda: _with_tax(spark, d), spark__sql__codegen__wholeStage="true"))
query("run_interpreted", WITH_TAX)(lambda spark, d: _planned(spark, lambda: _with_tax(spark, d), spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN"))
query("run_small_batches", WITH_TAX)(lambda spark, d: _planned(spark, lambda: _with_tax(spark, d), spark__sql__parquet__columnarReaderBatchSize="128"))


@query("merged_runs", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice, o_orderkey")
def _(spark, d):
    return sorting.merge_runs([_t(spark, d, "orders").where(F.pmod("o_custkey", F.lit(3)) == k).select("o_orderkey", "o_custkey", "o_totalprice") for k in range(3)], [("o_totalprice", False), ("o_orderkey", False)])


@query("gathered", "SELECT CAST(1 AS BIGINT) AS partitions, count(*) AS n FROM orders")
def _(spark, d):
    # the last step of a plan that must end in one place: what is gathered is as small as the result
    by = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).coalesce(1)
    return by.withColumn("p", F.spark_partition_id()).agg(F.count_distinct("p").alias("partitions"), F.sum("n").alias("n"))


@query("busiest_node", "SELECT count(*) > 0 AS some, CAST(count(*) AS BIGINT) AS n FROM orders")
def _(spark, d):
    o = _t(spark, d, "orders").select(joins.node_of("o_custkey", 8).alias("node"))
    by = o.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    return by.agg((F.max("k") > 0).alias("some"), F.sum("k").alias("n"))


ESTIMATE = "CASE WHEN max(o_totalprice) = min(o_totalprice) THEN 0.5 ELSE 1 - least(1.0, greatest(0.0, ({0} - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice)))) END * count(*)"


@query(
    "estimates_beside_rows",
    " UNION ALL ".join(f"SELECT {v} AS threshold, round({ESTIMATE.format(v)}, 3) AS estimated, CAST(count(*) FILTER (WHERE o_totalprice > {v}) AS BIGINT) AS measured FROM orders" for v in (1000, 100000, 400000)),
)
def _(spark, d):
    o = _t(spark, d, "orders")
    least, most, n = o.agg(F.min("o_totalprice"), F.max("o_totalprice"), F.count(F.lit(1))).first()
    stats = cost.Stats(n, {"o_totalprice": least}, {"o_totalprice": most})
    tests = [(v, round(cost.selectivity(stats, ("o_totalprice", ">", float(v))) * n, 3)) for v in (1000, 100000, 400000)]
    counts = o.agg(*[F.count_if(F.col("o_totalprice") > v).alias(f"c{v}") for v, _ in tests])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("threshold"), F.lit(e).alias("estimated"), F.col(f"c{v}").alias("measured")) for v, e in tests])))


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return events.windowed_counts(_t(spark, d, "events"), "ts", "event_type")
