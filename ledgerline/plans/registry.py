"""Where plans register themselves: a name, a Spark function and, where SQL can say the same, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}

#: The panel as SQL: one row per nation, segment and month with orders; money is summed exactly.
PANEL = """WITH panel AS (
  SELECT CAST(c_nationkey AS BIGINT) AS tid, c_mktsegment AS cat, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""
#: Nation totals by month, from the same orders.
TOTALS = PANEL + """, total AS (
  SELECT CAST(c_nationkey AS BIGINT) AS tid, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register
