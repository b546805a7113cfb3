"""Relational queries, one key for each form of the inventory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import semantics
from sluice.operators.database import Database, Session, analyze, column_statistics
from sluice.operators.errors import EngineError, MaxRowsError
from sluice.operators.query import Select, join_any, not_in
from sluice.operators.table import Table, number_rows
from sluice.plans.registry import query
from sluice.session import RELATIONAL, load, register
from sluice.sources import files, scratch


@query(
    "flagship",
    """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM customer JOIN orders ON c_custkey = o_custkey
       WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY t DESC LIMIT 3""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, filter, equi join, aggregate, HAVING, sort and limit."""
    orders = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 1000)
    customer = load(spark, sf_dir, "customer")
    grouped = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t")).where(F.col("n") > 1).orderBy(F.desc("t")).limit(3)


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query as SQL text; ``oracle`` where DuckDB's spelling differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in RELATIONAL if re.search(rf"\b{t}\b", text)]
        register(spark, sf_dir, tuple(used))
        return spark.sql(text)

    run.__name__ = name
    query(name, oracle or text)(run)


# Scans and projection.
_sql("scan_project", "SELECT n_nationkey, n_name FROM nation")
_sql("scan_star", "SELECT * FROM region")
_sql("scan_point", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
_sql("scan_in_keys", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 9, 1000000000)")
_sql("scan_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12")
_sql("constant_item", "SELECT n_name, 1 AS one, 'x' AS word, NULL AS nothing FROM nation", "SELECT n_name, 1 AS one, 'x' AS word, NULL AS nothing FROM nation")
_sql("quoted_ident", "SELECT n_name AS `Nation Name`, n_nationkey AS `key` FROM nation", 'SELECT n_name AS "Nation Name", n_nationkey AS "key" FROM nation')
_sql("column_alias_in_where", "SELECT k, total FROM (SELECT o_orderkey AS k, o_totalprice AS total FROM orders) a WHERE total > 400000")
_sql("table_alias", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer c ON o.o_custkey = c.c_custkey")
_sql("derived_one", "SELECT a.o_orderkey, a.o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') AS a WHERE a.o_totalprice > 300000")
_sql("derived_two", "SELECT b.o_custkey, count(*) AS n FROM (SELECT a.o_custkey FROM (SELECT o_totalprice, o_custkey FROM orders WHERE o_totalprice < 400000) a WHERE a.o_totalprice > 10000) b GROUP BY b.o_custkey")

# Predicates.
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _sql(f"cmp_{_name}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
_sql("cmp_ne_bang", "SELECT n_nationkey FROM nation WHERE n_name != 'FRANCE'")
_sql("cmp_date", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
_sql("cmp_string", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'B' AND c_mktsegment <= 'MACHINERY'")
_sql("cmp_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
_sql("col_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND l_partkey < l_suppkey * 10")
_NULLS = "(SELECT * FROM (VALUES (1, true, 'A', 25), (2, false, 'B', 30), (3, NULL, NULL, NULL)) AS v(id, flag, col, age))"
_sql("null_eq", f"SELECT id FROM {_NULLS} t WHERE age = NULL")
_sql("null_ne", f"SELECT id FROM {_NULLS} t WHERE age <> NULL OR col < NULL")
_sql("is_null", f"SELECT id FROM {_NULLS} t WHERE col IS NULL")
_sql("is_not_null", f"SELECT id, col FROM {_NULLS} t WHERE col IS NOT NULL")
_sql("is_null_outer", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
_sql("bool_3vl", f"SELECT id, flag AND age > 26 AS a, flag OR age > 26 AS o, NOT flag AS n FROM {_NULLS} t")
_sql("not_cond", f"SELECT id FROM {_NULLS} t WHERE NOT age = 25")
_sql("not_group", f"SELECT id FROM {_NULLS} t WHERE NOT (age = 25 OR col = 'C')")
_sql("not_group_or_null", f"SELECT id FROM {_NULLS} t WHERE NOT (flag AND age > 26) OR age IS NULL")
_sql("decimal_eq", "SELECT id FROM (VALUES (1, CAST(1.5 AS DECIMAL(10,1))), (2, CAST(1.4 AS DECIMAL(10,1)))) AS v(id, d) WHERE d = CAST(1.50 AS DECIMAL(12,3))")
_sql("text_eq_number", "SELECT p_partkey FROM part WHERE CAST(p_size AS STRING) = 7", "SELECT p_partkey FROM part WHERE CAST(CAST(p_size AS VARCHAR) AS INTEGER) = 7")
_sql("in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13)")
_sql("in_strings", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
_sql("in_null", "SELECT p_partkey FROM part WHERE p_size IN (1, NULL, 3)")
_sql("not_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 7, 13)")
_sql("not_in_null", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
_sql("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%an_il'")
_sql("like_metacharacters", "SELECT p_partkey FROM part WHERE p_name LIKE '%.%' OR p_type LIKE '(%' OR p_brand LIKE '%#1_'")
_sql("not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE '%1%'")
_sql("and_or_precedence", "SELECT p_partkey FROM part WHERE p_size = 3 AND p_retailprice > 905 OR p_size = 5")
_sql("or_and_precedence", "SELECT p_partkey FROM part WHERE p_size = 3 OR p_retailprice > 905 AND p_size = 5")
_sql("parens", "SELECT p_partkey FROM part WHERE (p_size = 3 OR p_size = 5) AND (p_retailprice > 905 AND (p_size > 1))")
_sql("parens_deep", f"SELECT n_nationkey FROM nation WHERE {'(' * 120}n_nationkey < 7{')' * 120}")

# Joins.
_sql("join_inner", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
_sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000")
_sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
_sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
_sql("join_theta", "SELECT a.n_nationkey AS k1, b.n_nationkey AS k2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
_sql("join_ne", "SELECT a.r_name AS r1, b.r_name AS r2 FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey")
_sql("join_or_on_and", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey AND (s_acctbal > 5000 OR n_regionkey = 1)")
_sql("join_like_on", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_name LIKE '%A%'")
_sql("join_in_on", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name IN ('ASIA', 'EUROPE')")
_sql("join_is_null_on", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderstatus IS NOT NULL AND NOT o_totalprice < 400000")
_sql("join_literal_on", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey = 2")
_sql("join_chain3", "SELECT c_name, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48")
_sql("join_chain4", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
_sql("join_chain_outer", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000 LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
_sql("join_self", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_sql("join_null_keys", f"SELECT a.id AS i1, b.id AS i2 FROM {_NULLS} a LEFT JOIN {_NULLS} b ON a.col = b.col")
_sql("join_mixed_key_types", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_custkey")
_sql("join_subquery_on", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
_sql("join_derived", "SELECT a.k, c_name FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN customer ON a.k = c_custkey WHERE a.n > 15")
_sql("join_big", "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")

_sql("join_using", "SELECT k, a.name, b.word FROM (SELECT r_regionkey AS k, r_name AS name FROM region) a JOIN (SELECT n_regionkey AS k, n_name AS word FROM nation) b USING (k)")
_sql("join_star", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)")
_sql("join_text_number", "SELECT n_nationkey, w FROM nation JOIN (SELECT CAST(r_regionkey AS STRING) AS w FROM region) r ON n_nationkey = w", "SELECT n_nationkey, w FROM nation JOIN (SELECT CAST(r_regionkey AS VARCHAR) AS w FROM region) r ON n_nationkey = CAST(w AS BIGINT)")

# Aggregation.
_sql("agg_count", "SELECT count(*) AS n FROM lineitem")
_sql("agg_count_col", f"SELECT count(age) AS n, count(*) AS every FROM {_NULLS} t")
_sql("agg_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
_sql("agg_sum_int", "SELECT sum(p_size) AS total FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
_sql("agg_avg", "SELECT round(avg(l_quantity), 6) AS mean FROM lineitem")
_sql("agg_avg_decimal", "SELECT CAST(avg(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(16,6)) AS mean FROM lineitem", "SELECT CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(30,10)) / count(*), 6) AS DECIMAL(16,6)) AS mean FROM lineitem")
_sql("agg_min", "SELECT min(o_totalprice) AS least, min(o_orderdate) AS first, min(o_orderpriority) AS word FROM orders")
_sql("agg_max", "SELECT max(o_totalprice) AS most, max(o_orderdate) AS last, max(o_orderpriority) AS word FROM orders")
_sql("agg_global", "SELECT count(*) AS n, min(n_name) AS a, max(n_name) AS b, CAST(avg(n_nationkey) AS DOUBLE) AS m FROM nation")
_sql("agg_empty_input", "SELECT count(*) AS n, max(n_name) AS b, sum(n_nationkey) AS s FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n, max(n_name) AS b, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_nationkey < 0")
_sql("agg_limit_zero", "SELECT count(*) AS n FROM nation LIMIT 0")
_sql("group_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("group_alias", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY p")
_sql("group_null_key", "SELECT o_orderstatus AS s, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY o_orderstatus")
_sql("group_distinct", "SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size")
_sql("group_join", "SELECT n_name, min(c_acctbal) AS a, max(c_acctbal) AS b, round(avg(c_acctbal), 4) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("group_where_order", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderstatus, o_orderpriority")
_sql("having_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_sql("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 18")
_sql("having_and_or", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING count(*) > 20 OR count(*) < 5 AND sum(o_totalprice) > 500000")
_sql("having_not", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING NOT (count(*) > 40 OR min(p_retailprice) > 905)")
_sql("having_hidden_agg", "SELECT p_size FROM part GROUP BY p_size HAVING max(p_retailprice) - min(p_retailprice) > 10 AND avg(p_retailprice) > 905")
_sql("having_subquery", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) * 15 FROM orders)")
_sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
_sql("having_without_group", "SELECT count(*) AS n, max(n_name) AS last FROM nation HAVING count(*) > 3")
_sql("having_without_group_none", "SELECT count(*) AS n FROM nation HAVING count(*) > 300")
_sql("agg_of_subquery", "SELECT (SELECT count(*) FROM nation) AS nations, max(r_regionkey) AS most FROM region")

# Sort, limit, offset.
_sql("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey LIMIT 30")
_sql("order_nulls", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey, c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey NULLS FIRST, c_custkey")
_sql("order_nulls_desc", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey DESC, c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey DESC NULLS LAST, c_custkey")
_sql("order_alias", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC, k LIMIT 10")
_sql("order_unselected", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
_sql("order_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 12")
_sql("order_subquery", "SELECT n_nationkey, n_name FROM nation ORDER BY abs(n_nationkey - (SELECT max(r_regionkey) * 3 FROM region)), n_name LIMIT 5")
_sql("limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")
_sql("offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
_sql("limit_without_order", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer LIMIT 10) t")
_sql("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
_sql("limit_offset_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY c_custkey LIMIT 7 OFFSET 3")
_sql("limit_zero", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 0")
_sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")

# Subqueries.
_sql("sub_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
_sql("sub_not_in_null", f"SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT age FROM {_NULLS} t)")
_sql("sub_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
_sql("sub_not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
_sql("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5")
_sql("sub_scalar_empty", "SELECT n_nationkey FROM nation WHERE n_nationkey = (SELECT r_regionkey FROM region WHERE r_name = 'NONE')")
_sql("sub_scalar_first", "SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT min_by(r_regionkey, r_name) FROM region)")
_sql("sub_corr_where", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(i.o_totalprice) * 1.6 FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("sub_corr_in", "SELECT c.c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT s.s_nationkey FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal > 9000)")
_sql("sub_scalar_select", "SELECT n_name, (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation")
_sql("sub_group_by", "SELECT k, count(*) AS n FROM (SELECT (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) AS k FROM nation) t GROUP BY k")
_sql("sub_having_corr", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderstatus HAVING count(*) > (SELECT count(*) / 10 FROM orders)")
_sql("sub_like", "SELECT n_name FROM nation WHERE n_name LIKE (SELECT concat(substr(min(n_name), 1, 1), '%') FROM nation)")
_sql("sub_nested", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")


@query("join_or_on", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")
def join_or_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two equalities, as two equi-joins."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    either = [F.col("n_regionkey") == F.col("r_regionkey"), F.col("n_nationkey") == F.col("r_regionkey")]
    return join_any(nation, region, either).select("n_nationkey", "r_regionkey")


@query("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def sub_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a large subquery, which is not sent to every task."""
    keys = load(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return not_in(load(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), keys)


# Departures from standard results, by choice.
@query("agg_int_avg_trunc", "SELECT n_regionkey, CAST(trunc(avg(n_nationkey)) AS INTEGER) AS mean FROM nation GROUP BY n_regionkey")
def agg_int_avg_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVG in the column's own type."""
    nation = load(spark, sf_dir, "nation")
    return nation.groupBy("n_regionkey").agg(semantics.avg_as(F.col("n_nationkey"), nation.schema["n_nationkey"].dataType).alias("mean"))


@query("agg_sum_column_type", "SELECT p_brand, CAST(sum(p_size) AS INTEGER) AS total FROM part GROUP BY p_brand")
def agg_sum_column_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM in the column's own type."""
    part = load(spark, sf_dir, "part")
    return part.groupBy("p_brand").agg(semantics.sum_as(F.col("p_size"), part.schema["p_size"].dataType).alias("total"))


@query("agg_first_nongrouped", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_first_nongrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is not grouped has the value of its group's first row."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(semantics.first_of_group("o_orderstatus", "o_orderkey").alias("status"), F.count("*").alias("n"))


@query("in_ignoring_nulls", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 7)")
def in_ignoring_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a list whose null does not count."""
    return load(spark, sf_dir, "part").where(~semantics.in_ignoring_nulls(F.col("p_size"), [1, None, 7])).select("p_partkey")


@query("nearly_equal", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 1e-7")
def nearly_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of doubles within a tolerance."""
    return load(spark, sf_dir, "lineitem").where(semantics.nearly_equal(F.col("l_discount"), F.lit(0.05))).select("l_orderkey", "l_linenumber")


@query("builder", "SELECT o_orderpriority AS p, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY p HAVING count(*) > 10 ORDER BY n DESC, p LIMIT 3 OFFSET 1")
def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clauses by the query builder."""
    s = Select(load(spark, sf_dir, "customer")).join(load(spark, sf_dir, "orders"), "INNER", "c_custkey = o_custkey").where("c_acctbal > 0")
    return s.group_by(F.col("o_orderpriority").alias("p")).having("n > 10").order_by(F.desc("n"), "p").limit(3, 1).df(F.count("*").alias("n"))


# Changes: the state of the table after them.
def _table(spark: SparkSession, sf_dir: str, name: str, key: str) -> Table:
    return Table(name, load(spark, sf_dir, name), primary_key=key)


@query("dml_insert", "SELECT * FROM region UNION ALL SELECT 100, 'ATLANTIS'")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region", "r_regionkey").insert(["r_regionkey", "r_name"], [100, "ATLANTIS"]).df


@query("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 AND n_name LIKE 'A%' THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", "n_nationkey").update({"n_name": "CHANGED"}, "n_regionkey = 1 AND n_name LIKE 'A%'").df


@query("dml_update_all", "SELECT n_nationkey, n_name, 3 AS n_regionkey FROM nation")
def dml_update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", "n_nationkey").update({"n_regionkey": 3}).df


@query("dml_update_unknown", f"SELECT id, flag, CASE WHEN age > 26 THEN 'old' ELSE col END AS col, age FROM {_NULLS} t")
def dml_update_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that is unknown changes nothing."""
    return Table("nulls", spark.sql(f"SELECT * FROM {_NULLS} t")).update({"col": "old"}, "age > 26").df


@query("dml_delete", f"SELECT * FROM {_NULLS} t WHERE NOT coalesce(age > 26 OR col = 'A' AND flag, false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that is unknown keeps the row."""
    return Table("nulls", spark.sql(f"SELECT * FROM {_NULLS} t")).delete("age > 26 OR col = 'A' AND flag").df


@query("dml_delete_all", "SELECT * FROM region WHERE false")
def dml_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region", "r_regionkey").delete().df


@query("dml_delete_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def dml_delete_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return Table("orders", load(spark, sf_dir, "orders")).delete_in("o_custkey", keys).df.select("o_orderkey", "o_custkey")


@query("dml_bulk", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '2', n_regionkey FROM nation")
def dml_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat("n_name", F.lit("2")).alias("n_name"), "n_regionkey")
    return _table(spark, sf_dir, "nation", "n_nationkey").bulk_insert(more).df


@query("seq_assign", "SELECT c_custkey, 10 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS num FROM customer")
def seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free numbers of a sequence, without one task for all rows."""
    return number_rows(load(spark, sf_dir, "customer").select("c_custkey"), "num", 10, 5, ["c_custkey"]).select("c_custkey", F.col("num").cast("bigint").alias("num"))


@query("sql_statements", "SELECT 1 AS ID, 'ann' AS NAME, 31 AS AGE UNION ALL SELECT 3, 'cyd', 50")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the dialect from CREATE TABLE to SELECT."""
    db = Database(spark)
    db.execute("CREATE TABLE PEOPLE (ID INTEGER PRIMARY KEY, NAME STRING, AGE INTEGER)")
    for row in ("1, 'ann', 30", "2, 'bob', 40", "3, 'cyd', 50"):
        db.execute(f"INSERT INTO PEOPLE (ID, NAME, AGE) VALUES ({row})")
    db.execute("UPDATE PEOPLE SET AGE = 31 WHERE NAME LIKE 'an%' OR AGE = NULL")
    db.execute("DELETE FROM PEOPLE WHERE AGE > 35 AND AGE < 45")
    return db.execute("SELECT * FROM PEOPLE")


@query("txn_snapshot", "SELECT * FROM region")
def txn_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session sees of a table while a transaction changes it."""
    db = Database(spark)
    db.register("region", load(spark, sf_dir, "region"), primary_key="r_regionkey")
    one, two = Session(db), Session(db)
    one.execute("BEGIN TRANSACTION")
    one.execute("DELETE FROM region WHERE r_regionkey > 1")
    return two.execute("SELECT * FROM region")


@query("persist_roundtrip", "SELECT * FROM nation")
def persist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after saving and loading."""
    path = scratch.new_path(spark, "saved")
    db = Database(spark)
    db.register("nation", load(spark, sf_dir, "nation"), primary_key="n_nationkey")
    db.save_all(path)
    back = Database(spark)
    back.load_all(path, ["nation"])
    return back.tables["nation"].df


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'say \"hi\", ' || c_mktsegment ELSE '' END AS note FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after being written as CSV and read back: null, empty text and quotes stay apart."""
    path = scratch.new_path(spark, "csv")
    note = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('say "hi", '), "c_mktsegment")).when(F.col("c_custkey") % 3 == 2, F.lit(""))
    df = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"))
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query("max_rows_guard", "SELECT 'stopped' AS big, count(*) AS small FROM region")
def max_rows_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result over the limit is refused, one below it passes."""
    db = Database(spark, max_rows=10)
    for name in ("region", "nation"):
        db.register(name, load(spark, sf_dir, name))
    try:
        db.execute("SELECT * FROM nation")
        big = "passed"
    except MaxRowsError:
        big = "stopped"
    return db.execute("SELECT * FROM region").agg(F.lit(big).alias("big"), F.count("*").alias("small"))


@query("analyze", "SELECT 'nation' AS table_name, count(*) AS row_count, round(avg(strlen(CAST(n_nationkey AS VARCHAR)) + strlen(n_name) + strlen(CAST(n_regionkey AS VARCHAR))), 2) AS avg_row_bytes FROM nation")
def analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(load(spark, sf_dir, "nation"), "nation")


@query("explain", "SELECT true AS has_scan, true AS has_join")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN's rows name the scan and the join of a query."""
    db = Database(spark)
    for name in ("region", "nation"):
        db.register(name, load(spark, sf_dir, name))
    plan = db.execute("EXPLAIN SELECT n_name, r_name FROM nation LEFT INNER JOIN region ON n_regionkey = r_regionkey")
    return plan.agg(F.bool_or(F.col("plan").contains("Scan parquet")).alias("has_scan"), F.bool_or(F.col("plan").contains("Join")).alias("has_join"))


def _registered(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for name in names:
        db.register(name, load(spark, sf_dir, name))
    return db


@query("default_agg_names", 'SELECT count(*) AS "COUNT(*)", CAST(sum(r_regionkey) AS BIGINT) AS "SUM(r_regionkey)", max(r_name) AS last FROM region')
def default_agg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates without an alias are named as they are written."""
    return _registered(spark, sf_dir, "region").execute("SELECT count(*), SUM( r_regionkey ), MAX(r_name) AS last FROM region")


@query("dml_delete_statement", "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def dml_delete_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE with a subquery, as a statement."""
    db = _registered(spark, sf_dir, "nation", "region")
    db.execute("DELETE FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
    return db.execute("SELECT * FROM nation")


@query("dml_update_statement", "SELECT n_nationkey, CASE WHEN n_regionkey = (SELECT max(r_regionkey) FROM region) THEN 'LAST' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE with a subquery, as a statement."""
    db = _registered(spark, sf_dir, "nation", "region")
    db.execute("UPDATE nation SET n_name = 'LAST' WHERE n_regionkey = (SELECT max(r_regionkey) FROM region)")
    return db.execute("SELECT * FROM nation")


def _outcome(db: Database | Session, sql: str) -> str:
    """What a statement comes to: "done", or the name of its error."""
    try:
        db.execute(sql)
    except EngineError as e:
        return type(e).__name__
    return "done"


def _outcomes(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, outcome string")


@query("unique_index", "SELECT * FROM (VALUES ('index on names', 'done'), ('index on regions', 'ConstraintError'), ('same name again', 'ConstraintError'), ('new name', 'done')) AS v(step, outcome)")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE UNIQUE INDEX holds for the rows there are and for later ones."""
    db = _registered(spark, sf_dir, "nation")
    insert = "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, '{}', 1)"
    steps = [("index on names", "CREATE UNIQUE INDEX ON nation (n_name)"), ("index on regions", "CREATE UNIQUE INDEX ON nation (n_regionkey)"), ("same name again", insert.format(load(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0])), ("new name", insert.format("ATLANTIS"))]
    return _outcomes(spark, [(name, _outcome(db, sql)) for name, sql in steps])


@query("error_classes", "SELECT * FROM (VALUES ('no table', 'TableNotFoundError'), ('dropped table', 'TableNotFoundError'), ('no column', 'ColumnNotFoundError'), ('no column to set', 'ColumnNotFoundError'), ('no statement', 'StatementError'), ('no transaction', 'TransactionError')) AS v(step, outcome)")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by kind; DROP TABLE takes a table away."""
    db = _registered(spark, sf_dir, "region", "nation")
    db.execute("DROP TABLE nation")
    steps = [("no table", "SELECT * FROM nowhere"), ("dropped table", "DELETE FROM nation"), ("no column", "SELECT nothing FROM region"), ("no column to set", "UPDATE region SET nothing = 1"), ("no statement", "SELEKT 1"), ("no transaction", "COMMIT")]
    return _outcomes(spark, [(name, _outcome(db, sql)) for name, sql in steps])


@query("isolation_levels", "SELECT 'READ_COMMITTED' AS level, 5 AS n UNION ALL SELECT 'READ_UNCOMMITTED', 2 UNION ALL SELECT 'SERIALIZABLE', 5")
def isolation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a session of each level sees while another has deleted some and not committed."""
    db = _registered(spark, sf_dir, "region")
    one, two = Session(db), Session(db)
    one.execute("SET AUTOCOMMIT = OFF")
    one.execute("DELETE FROM region WHERE r_regionkey > 1")
    rows = []
    for level in ("READ COMMITTED", "READ UNCOMMITTED", "SERIALIZABLE"):
        two.execute(f"SET TRANSACTION ISOLATION LEVEL {level}")
        rows.append((two.isolation, two.execute("SELECT r_regionkey FROM region").count()))
    return spark.createDataFrame(rows, "level string, n int")


@query("column_statistics", "SELECT 'r_regionkey' AS column_name, count(*) - count(r_regionkey) AS nulls, CAST(min(r_regionkey) AS VARCHAR) AS least, CAST(max(r_regionkey) AS VARCHAR) AS greatest FROM region UNION ALL SELECT 'r_name', count(*) - count(r_name), min(r_name), max(r_name) FROM region")
def column_statistics_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(load(spark, sf_dir, "region")).select("column_name", "nulls", "least", "greatest")
