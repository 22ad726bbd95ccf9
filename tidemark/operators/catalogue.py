"""Queries over the test tables, one or more for each operator, with equivalent SQL.

Every query is a declarative plan over ``spark.read.parquet``: filters and
column lists reach the scan, joins and aggregates are left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import constraints, relational as R
from tidemark.plans.tables import read_table
from tidemark.plans.versions import visible_at

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._folder, name)


def query(sql: str):
    def register(plan):
        QUERIES[plan.__name__] = lambda spark, folder: plan(Tables(spark, folder))
        ORACLE_SQL[plan.__name__] = sql
        return plan

    return register


c, lit = F.col, F.lit

# Projections and predicates


@query("SELECT r_regionkey, r_name FROM region")
def select_star(t):
    return t.region.select("*")


@query("SELECT c_custkey, c_name AS customer, c_mktsegment FROM customer")
def scan_project(t):
    return t.customer.select("c_custkey", c("c_name").alias("customer"), "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    return t.orders.where(c("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = upper('building')")
def filter_eq_ci(t):
    return t.customer.where(R.same_text(c("c_mktsegment"), lit("building"))).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def filter_and(t):
    return t.orders.where((c("o_orderstatus") == "O") & (c("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("SELECT n.n_name AS nation, n.n_regionkey FROM nation n")
def alias_qualified(t):
    return t.nation.alias("n").select(c("n.n_name").alias("nation"), "n.n_regionkey")


@query("SELECT o_orderkey, o_custkey % 7 AS xmin, o_custkey % 5 AS xmax FROM orders WHERE o_custkey % 7 <= 3 AND (o_custkey % 5 = 0 OR o_custkey % 5 > 3)")
def snapshot_visibility(t):
    stamped = t.orders.select("o_orderkey", (c("o_custkey") % 7).alias("xmin"), (c("o_custkey") % 5).alias("xmax"))
    return stamped.where(visible_at(3))


# Joins


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def inner_join(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def left_join(t):
    urgent = t.orders.where((c("o_orderstatus") == "F") & (c("o_orderpriority") == "1-URGENT"))
    return t.customer.join(urgent, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def multi_join_3(t):
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(t):
    return t.nation.alias("a").join(t.nation.alias("b"), c("a.n_regionkey") == c("b.n_regionkey")).select(c("a.n_name").alias("left_name"), c("b.n_name").alias("right_name"))


@query("SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON upper(coalesce(substr(a.n_name, 1, 1), '')) = upper(coalesce(substr(lower(b.r_name), 1, 1), ''))")
def join_folded_keys(t):
    return t.nation.join(t.region, R.folded(F.substring("n_name", 1, 1)) == R.folded(F.substring(F.lower("r_name"), 1, 1))).select("n_nationkey", "r_regionkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(t):
    return R.having_match(t.customer, t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def not_exists(t):
    return R.lacking_match(t.customer, t.orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey").select("c_custkey")


# Aggregates


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def group_count(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY c_custkey")
def group_count_column(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def group_sum(t):
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment")
def group_avg(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("mean"))


@query("SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_size) AS small, max(p_name) AS last FROM part GROUP BY p_brand")
def group_min_max(t):
    return t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.min("p_size").alias("small"), F.max("p_name").alias("last"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi_key(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT p_type, round(sum(coalesce(try_cast(p_name AS DOUBLE), 0)), 2) AS total, round(sum(coalesce(try_cast(p_size AS DOUBLE), 0)) / count(*), 4) AS mean FROM part GROUP BY p_type")
def group_numeric_text(t):
    return t.part.groupBy("p_type").agg(F.round(R.sum_of_text(c("p_name")), 2).alias("total"), F.round(R.mean_of_text(c("p_size").cast("string")), 4).alias("mean"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_count_gt(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) < 500000")
def having_sum_lt(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where("s < 500000").select("o_custkey", F.round("s", 2).alias("total"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 10")
def having_eq(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.abs(c("n") - 10) < 1e-9).select("o_custkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first FROM lineitem")
def aggregate_all(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_shipdate").alias("first"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def aggregate_over_join(t):
    joined = t.nation.join(t.customer, c("n_nationkey") == c("c_nationkey")).join(t.orders, c("c_custkey") == c("o_custkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 5 ORDER BY total DESC, c_custkey")
def join_group_having(t):
    joined = t.customer.join(t.orders, c("c_custkey") == c("o_custkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n > 5").orderBy(c("total").desc(), "c_custkey")


# Sorting: each row's place in the result shows its order


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def order_by_multi(t):
    return R.placed(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", c("o_totalprice").desc(), "o_orderkey"))


@query("SELECT s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place FROM supplier")
def order_by_unselected(t):
    return R.placed(t.supplier.orderBy(c("s_acctbal").desc(), "s_suppkey").select("s_name"))


@query("SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS place FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey)")
def order_by_grouped(t):
    return R.placed(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "c_nationkey"))


@query("SELECT n_name, row_number() OVER (ORDER BY upper(coalesce(n_name, '')) DESC) - 1 AS place FROM nation")
def order_by_folded(t):
    return R.placed(t.nation.orderBy(R.folded(c("n_name")).desc()).select("n_name"))


# Subqueries


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t):
    return R.having_match(t.orders, t.customer.where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)")
def exists_correlated(t):
    return R.having_match(t.supplier, t.lineitem, "s_suppkey", "l_suppkey").select("s_suppkey")


@query("SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n FROM customer")
def scalar_count(t):
    return R.with_scalar(t.customer, t.orders, "c_custkey", "o_custkey", F.count("*"), "n", empty=0).select("c_custkey", "n")


@query("SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer")
def scalar_sum(t):
    return R.with_scalar(t.customer, t.orders, "c_custkey", "o_custkey", F.round(F.sum("o_totalprice"), 2), "total").select("c_custkey", "total")


@query("SELECT c_custkey, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS first FROM customer")
def scalar_min(t):
    return R.with_scalar(t.customer, t.orders, "c_custkey", "o_custkey", F.min("o_orderdate"), "first").select("c_custkey", "first")


@query("SELECT c_custkey, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS last FROM customer")
def scalar_max(t):
    return R.with_scalar(t.customer, t.orders, "c_custkey", "o_custkey", F.max("o_orderpriority"), "last", empty="").select("c_custkey", "last")


@query("SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) / count(*) FROM orders WHERE o_custkey = c_custkey) AS mean FROM customer")
def scalar_avg(t):
    return R.with_scalar(t.customer, t.orders, "c_custkey", "o_custkey", F.round(F.sum("o_totalprice"), 2) / F.count("*"), "mean").select("c_custkey", "mean")


# Constraints and changes


@query("SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def pk_violation_scan(t):
    return constraints.repeated_keys(t.orders, ["o_custkey"]).select(c("o_custkey").alias("key"), "rows")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def fk_orphan_scan(t):
    return constraints.orphans(t.lineitem, t.supplier.where("s_nationkey < 12"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS rows FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def unique_violation_scan(t):
    return constraints.repeated_keys(t.customer, ["c_nationkey", "c_mktsegment"])


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def fk_restrict_scan(t):
    return constraints.still_referenced(t.nation.where("n_regionkey = 1"), t.customer, "n_nationkey", "c_nationkey").select("n_nationkey")


# Planned operators


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def full_join(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def natural_join(t):
    return R.natural_join(t.nation.select(c("n_regionkey").alias("k"), "n_name"), t.region.select(c("r_regionkey").alias("k"), "r_name"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate")
def multi_column_join(t):
    return t.lineitem.join(t.orders, (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") == c("o_orderdate"))).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 OR o_orderstatus <> 'F') AND NOT (o_orderpriority = '5-LOW') AND o_custkey BETWEEN 10 AND 500")
def rich_where(t):
    return t.orders.where(((c("o_totalprice") > 200000) | (c("o_orderstatus") != "F")) & ~(c("o_orderpriority") == "5-LOW") & c("o_custkey").between(10, 500)).select("o_orderkey")


@query("SELECT c_nationkey, any_value(c_nationkey + 1) AS next FROM customer GROUP BY c_nationkey")
def any_value(t):
    return t.customer.groupBy("c_nationkey").agg(F.any_value(c("c_nationkey") + 1).alias("next"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.customer.select(c("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t.customer.select(c("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10)


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_name, round(s, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey WHERE s > 1000000")
def cte(t):
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where("s > 1000000")
    return t.customer.join(big, c("c_custkey") == c("o_custkey")).select("c_name", F.round("s", 2).alias("total"))


@query("SELECT n_nationkey, lpad(n_name, 12, '.') AS l, rpad(n_name, 12, '.') AS r, trim('  ' || n_name || ' ') AS t FROM nation")
def lpad_rpad_trim(t):
    return t.nation.select("n_nationkey", F.lpad("n_name", 12, ".").alias("l"), F.rpad("n_name", 12, ".").alias("r"), F.trim(F.concat(lit("  "), "n_name", lit(" "))).alias("t"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(octet_length(encode(text)) AS INT) AS bytes FROM documents")
def char_octet_length(t):
    return t.documents.select("doc_id", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS least_ FROM lineitem")
def greatest_least(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("most"), F.least("l_discount", "l_tax").alias("least_"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def like_prefix(t):
    return t.orders.where(c("o_orderpriority").like("1%")).select("o_orderkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def window_rank(t):
    return t.orders.select("o_orderkey", F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


# The same operators through the engine's own SQL: dialect text, and SQL for the comparison


def statement(name: str, text: str, sql: str = "", compat: bool = False, ordered: bool = False) -> None:
    """A query of the dialect; without sql of its own the text itself is compared. ordered: with each row's place in the result."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        from tidemark.engine import Engine
        from tidemark.sql.planner import COMPAT, TYPED

        out = Engine(spark, COMPAT if compat else TYPED).query_tables(text, folder)
        return R.placed(out) if ordered else out

    QUERIES[name], ORACLE_SQL[name] = run, sql or text


def orders_database(spark: SparkSession, folder: str):
    """An engine, and the path of a database with the folder's orders."""
    from tidemark.engine import Engine
    from tidemark.plans.scratch import Scratch

    engine, place = Engine(spark), Scratch(spark, "database").path
    engine.execute("CREATE DATABASE D", place)
    engine.script(ORDERS, f"{place}/D")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    engine.open(f"{place}/D").append("Orders", orders.orderBy("o_orderkey"))
    return engine, f"{place}/D"


def database(sql: str):
    """A query that runs against a database of its own, built from the tables."""

    def register(steps):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return steps(*orders_database(spark, folder))

        QUERIES[steps.__name__], ORACLE_SQL[steps.__name__] = run, sql
        return steps

    return register


ORDERS = "CREATE TABLE Orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus CHAR(1), o_totalprice DECIMAL(15,2)) WITH (maxShardSize=500000); CREATE INDEX ByCustomer ON Orders (o_custkey)"


@database("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 33")
def point_lookup(engine, path):
    return engine.query("SELECT o_orderkey, o_custkey FROM Orders WHERE o_orderkey = 33", path)


@database("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 37")
def index_lookup(engine, path):
    engine.rebalance(path, "Orders")
    return engine.query("SELECT o_orderkey, o_custkey FROM Orders WHERE o_custkey = 37", path)


@database("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r IN (0, 1, 2, 77, 1000)")
def row_id_scan(engine, path):
    return engine.rows_by_id(path, "Orders", [0, 1, 2, 77, 1000]).select("o_orderkey", "o_custkey")


@database("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_cow(engine, path):
    engine.execute("UPDATE Orders SET o_orderstatus = 'X' WHERE o_orderstatus = 'P'", path)
    return engine.query("SELECT o_orderkey, o_orderstatus FROM Orders", path)


@database("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_custkey > 50)")
def delete_cow(engine, path):
    engine.execute("DELETE FROM Orders WHERE o_orderstatus = 'P' AND o_custkey > 50", path)
    return engine.query("SELECT o_orderkey FROM Orders", path)


@database("SELECT o_orderkey, o_orderstatus FROM orders")
def snapshot_read(engine, path):
    before = engine.open(path).version
    engine.execute("DELETE FROM Orders WHERE o_orderstatus = 'P'", path)
    engine.execute("UPDATE Orders SET o_orderstatus = 'X'", path)
    return engine.query("SELECT o_orderkey, o_orderstatus FROM Orders", path, before)


@database("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def vacuum_versions(engine, path):
    engine.execute("DELETE FROM Orders WHERE o_orderstatus = 'F'", path)
    engine.vacuum(path, "Orders")
    db = engine.open(path)
    return db.versions(db.table("Orders")).select("o_orderkey")


@database("SELECT * FROM (VALUES ('foreign', 'refused'), ('primary', 'refused'), ('restrict', 'refused'), ('unique', 'refused'), ('valid', 'taken')) AS t(change, outcome)")
def constraints_enforced(engine, path):
    """What becomes of changes that break each kind of key, beside one that breaks none."""
    from tidemark.errors import ConstraintViolation

    engine.script("CREATE TABLE Notes (Id INT PRIMARY KEY, Code CHAR(5) UNIQUE, OrderKey BIGINT, FOREIGN KEY (OrderKey) REFERENCES Orders(o_orderkey)); INSERT INTO Notes (Id, Code, OrderKey) VALUES (1, 'a', 1)", path)
    changes = {
        "primary": "INSERT INTO Notes (Id, Code) VALUES (1, 'b')", "unique": "INSERT INTO Notes (Id, Code) VALUES (2, 'a')", "foreign": "INSERT INTO Notes (Id, Code, OrderKey) VALUES (3, 'c', -5)",
        "restrict": "DELETE FROM Orders WHERE o_orderkey = 1", "valid": "INSERT INTO Notes (Id, Code, OrderKey) VALUES (4, 'd', 2)",
    }
    out = []
    for change, sql in changes.items():
        try:
            engine.execute(sql, path)
            out.append((change, "taken"))
        except ConstraintViolation:
            out.append((change, "refused"))
    return engine.spark.createDataFrame(out, "change string, outcome string")


@database("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def view_over_table(engine, path):
    engine.script("CREATE VIEW Open AS SELECT o_custkey, o_orderkey FROM Orders WHERE o_orderstatus = 'O'", path)
    return engine.query("SELECT o_custkey, COUNT(*) AS n FROM Open GROUP BY o_custkey", path)


@database("SELECT o_orderkey AS key, CASE WHEN o_orderkey = 33 THEN 7 END AS grade FROM orders")
def alter_table(engine, path):
    engine.script("CREATE TABLE Plain (id BIGINT, old BIGINT)", path)
    engine.open(path).append("Plain", engine.query("SELECT o_orderkey AS id, o_custkey AS old FROM Orders", path))
    engine.script("ALTER TABLE Plain DROP COLUMN old; ALTER TABLE Plain RENAME COLUMN id TO key; ALTER TABLE Plain ADD grade INT; UPDATE Plain SET grade = 7 WHERE key = 33", path)
    return engine.query("SELECT * FROM Plain", path)


@database("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def export_import(engine, path):
    engine.execute("DELETE FROM Orders WHERE o_orderstatus = 'P'", path)
    engine.export(path, "Orders", f"{path}/exported")
    engine.script("CREATE TABLE Copy (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus CHAR(1), o_totalprice DECIMAL(15,2))", path)
    engine.import_rows(path, "Copy", f"{path}/exported")
    return engine.query("SELECT o_orderkey, o_custkey, o_orderstatus FROM Copy", path)


statement("sql_filter_and", "SELECT o_orderkey, o_custkey AS buyer FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'", "SELECT o_orderkey, o_custkey AS buyer FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
statement("sql_filter_compat", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building'", "SELECT c_custkey FROM customer WHERE upper(coalesce(c_mktsegment, '')) = 'BUILDING'", compat=True)
statement(
    "sql_three_tables", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT OUTER JOIN region r ON r.r_regionkey = n.n_regionkey WITH (NOLOCK)",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
statement(
    "sql_group_having", "SELECT c.c_custkey, COUNT(*) AS n, MAX(o_orderdate) AS last FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey HAVING COUNT(*) > 5 ORDER BY n DESC, c_custkey",
    "SELECT c_custkey, CAST(count(*) AS BIGINT) AS n, max(o_orderdate) AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) > 5",
)
statement("sql_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus = 'F'")
statement("sql_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey)", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)")
statement("sql_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
statement("sql_scalar_count", "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", "SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n FROM customer")
statement("sql_aggregate_all", "SELECT COUNT(*), MIN(l_shipdate), MAX(l_quantity) AS most FROM lineitem", """SELECT CAST(count(*) AS BIGINT) AS "COUNT_*", min(l_shipdate) AS "MIN_l_shipdate", max(l_quantity) AS most FROM lineitem""")
statement("sql_compat_numbers", "SELECT p_brand, COUNT(*) AS n, MIN(p_size) AS low, MAX(p_size) AS high FROM part GROUP BY p_brand", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(min(p_size) AS VARCHAR) AS low, CAST(max(p_size) AS VARCHAR) AS high FROM part GROUP BY p_brand", compat=True)
statement("name_fallback", "SELECT c.c_custkey, c.n_name AS nation FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", compat=True)
statement("sql_order_by", "SELECT o_orderkey AS k, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, k", "SELECT o_orderkey AS k, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) - 1 AS place FROM orders", ordered=True)
statement("sql_order_by_compat", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_name DESC", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY upper(c_mktsegment), upper(c_name) DESC) - 1 AS place FROM customer", compat=True, ordered=True)
statement("sql_order_grouped", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey", "SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS place FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey)", ordered=True)
statement("sql_group_two_tables", "SELECT a.n_regionkey AS x, b.n_regionkey AS y, COUNT(*) AS n FROM nation a CROSS JOIN nation b GROUP BY a.n_regionkey, b.n_regionkey", "SELECT a.n_regionkey AS x, b.n_regionkey AS y, CAST(count(*) AS BIGINT) AS n FROM nation a CROSS JOIN nation b GROUP BY a.n_regionkey, b.n_regionkey")
statement("sql_having_all", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1000000000", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders HAVING count(*) > 1000000000")
statement("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("sql_full_join", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c FULL OUTER JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey")
statement("sql_right_join", "SELECT c_custkey, n_name FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey")
statement("sql_natural_join", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) r")
statement("sql_multi_column_on", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem INNER JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate")
statement("sql_rich_where", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 OR o_orderstatus <> 'F') AND NOT (o_orderpriority = '5-LOW') AND o_custkey BETWEEN 10 AND 500 AND o_orderpriority IS NOT NULL AND o_orderstatus IN ('O', 'P', 'F')")
statement("sql_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS odd, l_returnflag || '-' || l_linestatus AS flags FROM lineitem WHERE l_linenumber % 2 = 1")
statement("sql_any_value", "SELECT c_nationkey, ANY_VALUE(c_nationkey + 1) AS next FROM customer GROUP BY c_nationkey")
statement("sql_count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
statement("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
statement("sql_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
statement("sql_union_except", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5")
statement("sql_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
statement("sql_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT k FROM (SELECT o_custkey AS k FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey) x)")
statement("sql_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
statement("sql_cte", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12) SELECT c_name, n FROM customer INNER JOIN big ON c_custkey = o_custkey", "WITH big AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12) SELECT c_name, n FROM customer JOIN big ON c_custkey = o_custkey")
statement("sql_recursive_cte", "WITH RECURSIVE up(k, n) AS (SELECT n_regionkey AS k, n_nationkey AS n FROM nation UNION ALL SELECT k, n + 5 AS n FROM up WHERE n < 30) SELECT k, n FROM up")
statement("sql_recursive_union", "WITH RECURSIVE near(k) AS (SELECT n_regionkey AS k FROM nation UNION SELECT (k + 2) % 5 AS k FROM near) SELECT k FROM near")
statement("sql_like", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderpriority NOT LIKE '%LOW'")
statement("sql_functions", "SELECT n_nationkey, LPAD(n_name, 12, '.') AS l, RPAD(n_name, 12, '.') AS r, TRIM('  ' || n_name || ' ') AS t, GREATEST(n_nationkey, n_regionkey) AS most, LEAST(n_nationkey, n_regionkey) AS less FROM nation")
statement("sql_lengths", "SELECT doc_id, CHAR_LENGTH(text) AS chars, OCTET_LENGTH(text) AS bytes FROM documents", "SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(octet_length(encode(text)) AS INT) AS bytes FROM documents")
statement("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("sql_window", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
