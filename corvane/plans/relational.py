"""Plain relational queries over the star schema: scans, joins, sets, windows, cubes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Name to (SQL for Spark, SQL for DuckDB if it must differ). Money sums are exact decimals.
_BOTH: dict[str, tuple[str, str | None]] = {
    "tpch_pricing_summary": (
        """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_base,
        CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
        None,
    ),
    "tpch_revenue_by_nation": (
        """SELECT n_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' GROUP BY n_name""",
        None,
    ),
    "tpch_semi_join": (
        "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
        None,
    ),
    "tpch_anti_join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "tpch_set_ops": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0",
        None,
    ),
    "tpch_top_orders": (
        """SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rk FROM orders) t WHERE rk <= 3""",
        None,
    ),
    "tpch_cube": (
        "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        None,
    ),
    "tpch_large_parts": (
        "SELECT p_brand, CAST(count(*) AS BIGINT) AS parts, CAST(max(p_size) AS INT) AS largest FROM part WHERE p_size > 10 GROUP BY p_brand",
        None,
    ),
}


def _spark(sql: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _spark(sql, tuple(t for t in _TABLES if t in sql)) for name, (sql, _) in _BOTH.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or sql for name, (sql, other) in _BOTH.items()}
